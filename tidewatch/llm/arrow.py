"""Adding computed columns batch by batch, without moving rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


def append_columns(df: DataFrame, compute: Callable[[pa.RecordBatch], dict], fields: list[T.StructField], drop: tuple = ()) -> DataFrame:
    """``df`` with ``fields`` computed from each Arrow batch; columns of the same names are replaced.

    ``drop`` names columns that ``compute`` reads and the result leaves out.
    """
    names = [f.name for f in fields]
    clash = [c for c in df.columns if c in names]
    df = df.drop(*clash)
    kept = [f for f in df.schema.fields if f.name not in drop]
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            new = compute(batch)
            columns = [batch.column(f.name) for f in kept]
            for name in names:
                x = new[name]
                columns.append(x.cast(kinds[name]) if isinstance(x, pa.Array) else pa.array(x, kinds[name]))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + names)

    return df.mapInArrow(run, T.StructType(kept + fields))


def held_out(column: str = "doc_id", parts: int = 3, part: int = 1):
    """True for the rows whose crc32 of the id's text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, limit: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """Whole texts of about ``limit`` rows of each label (0 and 1), with the labels' sizes and the shares chosen.

    The rows are chosen by the hash of ``key`` before any text is read; so they are few whatever the input and are
    broadcast to the scan. Returns (key, text, y) rows; null labels, keys and texts are no examples.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, limit / n) for y, n in sizes.items()}
    lot = F.pmod(F.xxhash64("k"), F.lit(1_000_003)) / 1_000_003
    few = marked.where(lot < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    return rows.join(F.broadcast(few), "k"), sizes, share

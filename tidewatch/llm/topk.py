"""Exact search of largest inner products: long vectors first, partial sums in rotated axes, residual bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.integers import floored, lists, matrix
from tidewatch.llm.storage import partitions, stored

ROWS = "id long, d int, n2 long, v array<long>"
#: Relative slack of the bounds: far above the rounding of sums of doubles.
SLACK = 1e-9
AXES, SEEDS, SEED_BYTES, SHARD_BYTES, PAIRS = 256, 1024, 8 << 20, 32 << 20, 1 << 16


def integer_rows(vectors: DataFrame, key: str, embedding: str, scale: int) -> DataFrame:
    """(id, d, n2, v) of the vectors that take part: length, squared norm and integer components."""

    def run(batches):
        for batch in batches:
            values, lengths, sound = floored(batch.column("v"), scale)
            row = np.repeat(np.arange(len(lengths)), lengths)
            n2 = np.zeros(len(lengths), np.int64)
            np.add.at(n2, row, values * values)
            mask = pa.array(sound)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(mask), pa.array(lengths[sound], pa.int32()), pa.array(n2[sound]), lists(values[sound[row]], lengths[sound])],
                ["id", "d", "n2", "v"],
            )

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v")).where("id is not null and v is not null").mapInArrow(run, ROWS)


def rotation(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Right singular axes of all vectors of length ``d``, by falling energy, and how many hold 70 percent of it.

    Only the first ``AXES`` components are turned. The Gram matrix is summed in tasks; its size is bounded by AXES.
    Rounding of these sums moves the bounds' sharpness and never a result.
    """
    width = min(d, AXES)

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column("v").values.to_numpy().reshape(batch.num_rows, d)[:, :width].astype(float)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    gram = np.zeros((width, width))
    for r in rows.where(F.col("d") == d).select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.s
    energy, axes = np.linalg.eigh(gram)
    energy, axes = np.maximum(energy[::-1], 0), axes[:, ::-1]
    lead = 1 + int(np.searchsorted(np.cumsum(energy), 0.7 * energy.sum()))
    return axes, min(lead, width)


class Turned:
    """Vectors in turned axes: leading coordinates, and the norm of what is left."""

    def __init__(self, x: np.ndarray, axes: np.ndarray | None, lead: int):
        y = x.astype(float)
        self.norm = np.sqrt((y * y).sum(1))
        if axes is None:
            lead = min(lead, y.shape[1])
            self.lead = np.ascontiguousarray(y[:, :lead])
        else:
            self.lead = y[:, : len(axes)] @ axes[:, :lead]
        self.tail = np.sqrt(np.maximum(self.norm**2 * (1 + SLACK) - (self.lead**2).sum(1), 0))


def best_of(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, axes: np.ndarray | None, lead: int, turned: Turned | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's ``k`` best among ``x``, as far as they reach its ``floor``.

    ``x`` comes by falling norm. Chunk by chunk, queries whose norm times the chunk's largest norm misses their k-th
    score so far are done; for the others the partial sum over the leading axes plus the product of the tails' norms
    (Cauchy-Schwarz) bounds each product, and pairs that reach the k-th score are multiplied exactly in integers.
    """
    t, qt, floor = turned or Turned(x, axes, lead), Turned(q, axes, lead), floor.astype(float).copy()
    rows, who, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, 64
    while at < len(x):
        part = slice(at, at + step)
        reach = qt.norm * t.norm[at]
        live = np.flatnonzero(reach * (1 + SLACK) + 1 >= floor)
        if not len(live):
            break
        bound = qt.lead[live] @ t.lead[part].T + qt.tail[live, None] * t.tail[None, part]
        bound += SLACK * (reach[live, None] + 1)
        r, c = np.nonzero(bound >= floor[live, None])
        r, c = live[r], c + at
        other = asked[r] != ids[c]
        r, c = r[other], c[other]
        exact = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + PAIRS]], x[c[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)] or [np.zeros(0, np.int64)])
        hit = exact >= floor[r]
        if hit.any():
            rows, who, score = np.r_[rows, r[hit]], np.r_[who, ids[c[hit]]], np.r_[score, exact[hit]]
            order = np.lexsort((who, -score, rows))
            rows, who, score = rows[order], who[order], score[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            floor[rows[place == k - 1]] = np.maximum(floor[rows[place == k - 1]], score[place == k - 1])
            rows, who, score = rows[place < k], who[place < k], score[place < k]
        at, step = at + step, min(step * 2, 2048)
    return rows, who, score


def largest_products(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products over all vectors but its own.

    Components become floor(scale * x) in double precision; products are exact; ties go to the smaller id. Fewer
    candidates than ``k`` give fewer rows.

    All vectors are sorted by falling norm into shards of about 32 MB, stored once. The ``SEEDS`` longest give each
    query a floor, the k-th of their scores. A query then visits only shards that its floor allows, and meets there the
    shard's vectors by falling norm (``best_of``). A task holds one shard and one batch of queries; copies are spread
    over shards by their ids. Each shard returns at most ``k`` rows a query; those are ranked at last.

    No part take: null and empty vectors, null or non-finite components, null ids, and vectors whose integer squared
    norm is 2**60 or more (their products may not fit in a long). Vectors of different lengths have no product.
    Repeated rows are candidates each for itself; rows with the query's own id are none. Of several queries with one id
    the one with the least integer vector asks. Empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors, key, embedding, scale)
    sizes = vectors.where(F.size(embedding) > 0).groupBy(F.size(embedding).alias("d")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = usual[0].d
    cells = sizes.agg(F.sum(F.col("n") * F.col("d"))).first()[0]
    shards = max(min(partitions(spark), math.ceil(cells / d / 1024)), math.ceil(8 * cells / SHARD_BYTES))
    axes, lead = rotation(rows, d)
    by = ["d", F.desc("n2"), "id"]
    base = stored(rows.repartitionByRange(shards, *by).sortWithinPartitions(*by).withColumn("shard", F.spark_partition_id()), "product-shards")
    seeds = base.where(F.col("d") == d).orderBy(F.desc("n2"), "id").limit(max(k + 1, min(SEEDS, SEED_BYTES // (8 * d)))).select("id", "v").collect()
    seed_ids, seed_x = np.array([r.id for r in seeds], np.int64), np.array([r.v for r in seeds], np.int64).reshape(-1, d)
    turn = lambda size: (axes, lead) if size == d else (None, AXES)

    def floors(batches):
        for batch in batches:
            values, lengths = batch.column("v").values.to_numpy(), batch.column("d").to_numpy()
            ids, floor = batch.column("id").to_numpy(), np.full(len(lengths), -np.inf)
            mine = np.flatnonzero(lengths == d)
            if len(mine) and len(seed_ids):
                r, _, s = best_of(seed_ids, seed_x, ids[mine], matrix(values, lengths, lengths == d, d), floor[mine], k, axes, lead)
                full = np.bincount(r, minlength=len(mine)) == k
                last = np.searchsorted(r, np.arange(len(mine)), "right") - 1
                floor[mine[full]] = s[last[full]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["id", "d", "n2", "v", "floor"])

    asking = integer_rows(queries, key, embedding, scale).groupBy("id").agg(F.min("v").alias("v"))
    asking = asking.select("id", F.size("v").alias("d"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("n2"), "v")
    asking = asking.mapInArrow(floors, ROWS + ", floor double")
    # one row for each 32 MB of vectors, or fewer
    reach = base.groupBy("shard", "d").agg(F.max("n2").alias("longest"))
    a, s = asking.alias("a"), F.broadcast(reach).alias("s")
    allowed = F.sqrt(F.col("a.n2").cast("double")) * F.sqrt(F.col("s.longest").cast("double")) * (1 + SLACK) + 1 >= F.col("a.floor")
    visits = a.join(s, (F.col("a.d") == F.col("s.d")) & allowed).select("s.shard", "a.d", F.lit(1).alias("kind"), "a.id", "a.n2", "a.v", "a.floor")
    both = base.select("shard", "d", F.lit(0).alias("kind"), "id", "n2", "v", F.lit(None).cast("double").alias("floor")).unionByName(visits)
    both = both.repartition(shards, "shard", "d").sortWithinPartitions("shard", "d", "kind", F.desc("n2"), "id")

    def search(batches):
        place, ids, parts, ready = None, [], [], None
        for batch in batches:
            shard, size, kind = (batch.column(c).to_numpy() for c in ("shard", "d", "kind"))
            change = np.flatnonzero((np.diff(shard) != 0) | (np.diff(size) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(shard)]):
                if lo == hi:
                    continue
                piece = batch.slice(lo, hi - lo)
                n = int(size[lo])
                x, own = piece.column("v").flatten().to_numpy().reshape(-1, n), piece.column("id").to_numpy()
                if (shard[lo], n) != place:
                    place, ids, parts, ready = (shard[lo], n), [], [], None
                if kind[lo] == 0:
                    ids.append(own)
                    parts.append(x)
                    continue
                if ready is None:
                    all_x = np.concatenate(parts)
                    ready, parts = (np.concatenate(ids), all_x, Turned(all_x, *turn(n))), []
                floor = piece.column("floor").to_numpy()
                for at in range(0, len(own), 512):
                    some = slice(at, at + 512)
                    r, who, score = best_of(ready[0], ready[1], own[some], x[some], floor[some], k, *turn(n), ready[2])
                    yield pa.RecordBatch.from_arrays([pa.array(own[some][r]), pa.array(who), pa.array(score)], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

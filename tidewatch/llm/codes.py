"""Vector codes: a codebook for each part of a vector, fitted in rounds of exact nearest search and integer sums."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.integers import floored, lists, matrix
from tidewatch.llm.storage import stored

LEAF = 2
FAR = np.iinfo(np.int64).max


class KdTree:
    """Nearest entries of one codebook by squared distance in integers; equal distances go to the lower index.

    A node is split along its widest axis at the median, until it has ``LEAF`` entries or all are equal. A child is
    visited unless its nearest coordinate is farther than the best distance so far. Children at equal bounds are
    visited, too, so an entry of lower index at the same distance is never missed.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray):
        x = self.entries[own]
        spread = x.max(0) - x.min(0) if x.size else np.zeros(1, np.int64)
        axis = int(spread.argmax())
        if len(own) <= LEAF or spread[axis] == 0:
            return np.sort(own)
        order = own[np.argsort(x[:, axis], kind="stable")]
        low, high = order[: len(own) // 2], order[len(own) // 2 :]
        return axis, self.entries[low, axis].max(), self.entries[high, axis].min(), self._node(low), self._node(high)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry."""
        who, best = np.full(len(points), len(self.entries)), np.full(len(points), FAR)

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                for i in node:
                    gap = points[rows] - self.entries[i]
                    far = (gap * gap).sum(1)
                    nearer = (far < best[rows]) | ((far == best[rows]) & (i < who[rows]))
                    who[rows[nearer]], best[rows[nearer]] = i, far[nearer]
                return
            axis, top, bottom, low, high = node
            x = points[rows, axis]
            below, above = np.maximum(bottom - x, 0), np.maximum(x - top, 0)  # distances to the high and the low child
            down = above <= below
            visit(low, rows[down])
            visit(high, rows[~down])
            visit(high, rows[down & (below * below <= best[rows])])
            visit(low, rows[~down & (above * above <= best[rows])])

        visit(self.root, np.arange(len(points)))
        return who, best


def first_vectors(rows: DataFrame, scale: int, parts: int, entries: int) -> np.ndarray:
    """The integer vectors of the ``entries`` smallest ids, ascending, as far as they are as long as the first."""

    def run(batches):
        for batch in batches:
            values, lengths, sound = floored(batch.column("v"), scale)
            sound &= (lengths % parts == 0) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            starts, ids = np.cumsum(lengths) - lengths, batch.column("id").fill_null(0).to_numpy()
            keep = []
            for d in np.unique(lengths[sound]):
                own = np.flatnonzero(sound & (lengths == d))
                last = np.sort(ids[own])[min(entries, len(own)) - 1]
                keep += own[ids[own] <= last].tolist()
            flat = [values[starts[i] : starts[i] + lengths[i]] for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(lengths[keep].astype(np.int32)), lists(np.concatenate(flat) if flat else np.zeros(0, np.int64), lengths[keep])], ["id", "d", "v"])

    few = rows.select("id", "v").mapInArrow(run, "id long, d int, v array<long>")
    found = few.orderBy("id", "v").limit(entries).collect()
    if any(r.d != found[0].d for r in found):
        found = few.where(F.col("d") == found[0].d).orderBy("id", "v").limit(entries).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), found[0].d if found else 0)


def vector_codes(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, code, error, label_error) of each kept vector, and the codebooks, one matrix of entries for each part.

    Components become floor(scale * x). Each part's codebook starts as that part of the vectors of the smallest ids.
    In each round one k-d tree a codebook is broadcast (entries times length numbers in all), every task finds the
    nearest entry of each part (``KdTree``) and adds up its vectors by entry, and the tasks' integer sums are added in
    a shuffle of at most entries times length rows a task. An entry becomes floor(sum / count); unused ones stay. The
    code names the entries in part order, two hex digits each; ``error`` is the sum of the squared distances, and
    ``label_error`` the sum of errors over the rows of one label (nulls together), null if it leaves the longs.

    Dropped: null and empty vectors, null or non-finite components, integer squared norms of 2**60 or more, lengths
    that ``parts`` does not divide, and lengths other than that of the first kept id. Vectors of null id are coded but
    start no entry; if ids repeat, the lesser integer vector comes first. Fewer vectors than ``entries`` give fewer
    entries. Without any vector there are no rows and no codebooks. Repeated rows are coded each; other columns are not
    read. ``entries`` is 256 at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"), F.col(label).alias("label")).where("v is not null")
    start = first_vectors(rows, scale, parts, entries)
    d = start.shape[1] if len(start) else 0
    books = [start[:, i * d // parts : (i + 1) * d // parts] for i in range(parts)] if d else []
    width = d // parts if d else 0

    def cut(batch):
        values, lengths, sound = floored(batch.column("v"), scale)
        chosen = sound & (lengths == d)
        return chosen, matrix(values, lengths, chosen, d)

    for _ in range(rounds if d else 0):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])

        def sums(batches, trees=trees):
            n = len(trees.value[0].entries)
            total, count = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
            for batch in batches:
                _, x = cut(batch)
                for p, tree in enumerate(trees.value):
                    own = x[:, p * width : (p + 1) * width]
                    who, _ = tree.nearest(own)
                    np.add.at(total[p], who, own)
                    count[p] += np.bincount(who, minlength=n)
            p, e, at = (a.ravel().astype(np.int32) for a in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(at), pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), width))], ["part", "entry", "at", "total", "n"])

        added = rows.select("v").mapInArrow(sums, "part int, entry int, at int, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in added.where("n > 0").collect():
            books[r.part][r.entry, r["at"]] = r.total // r.n
        trees.unpersist()

    trees = spark.sparkContext.broadcast([KdTree(b) for b in books])

    def code(batches):
        for batch in batches:
            if not d:
                continue
            chosen, x = cut(batch)
            found = [tree.nearest(x[:, p * width : (p + 1) * width]) for p, tree in enumerate(trees.value)]
            digits = np.stack([who for who, _ in found], 1).astype(np.uint8).tobytes().hex()
            error = sum(far for _, far in found)
            mask = pa.array(chosen)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(mask), batch.column("label").filter(mask), pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = stored(rows.mapInArrow(code, f"id long, label {kind}, code string, error long"), "vector-codes").alias("c")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).alias("s")
    out = coded.join(by_label, F.col("c.label").eqNullSafe(F.col("s.label")))
    return out.select(F.col("c.id").alias(key), "code", "error", "label_error"), books


def digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

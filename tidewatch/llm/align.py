"""Alignment of two tokenizers: links at shared ends, counted over the corpus by a cogroup of postings."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tidewatch.llm.bytesops import mix
from tidewatch.llm.storage import partitions, stored
from tidewatch.llm.tokens import byte_letters

#: Fixed value: how byte-level vocabularies cut texts before merging, in the notation of ``tiktoken``.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters encoded at once, and postings that one task of the cogroup reads.
CHARS, POSTINGS = 1_000_000, 2_000_000


class ByteLevel:
    """A byte-level vocabulary file of the ``tokenizers`` library; strings of special tokens are plain text.

    Where every merge makes a token of its own, in the order of the ids, merging by the rank of the result (``tiktoken``)
    gives the library's tokens much faster: two tokens whose bytes make a third meet only where the library merges them,
    too, as each token's own bytes merge to it. Files of another kind are left to the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back, special = byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
        as_bytes = lambda token: bytes(back[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else as_bytes(token)
        self.lengths = np.array([len(x) for x in self.bytes])
        made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in spec["model"]["merges"]]
        cut = spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = None
        if plain and made[:1] != [-1] and all(x < y for x, y in zip(made, made[1:])):
            ranks = {as_bytes(t): i for t, i in vocabulary.items() if t not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text."""
        if self.fast:
            return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return [np.array(self.own.encode(" " + t, add_special_tokens=False).ids, np.uint32) for t in texts]


class Pieces:
    """A ``sentencepiece`` model; it puts a space before each text itself."""

    def __init__(self, path: str):
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.own.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.own.encode(texts, num_threads=1)]


class Sides:
    """Both vocabularies, with the pieces from which a document's groups are written."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        self.written = [f"{i}{x}".encode() for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for i in range(n) for x in ends]


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """Both vocabularies, loaded once for each worker process."""
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


def links(own: Sides, texts: list[str]) -> tuple[list[tuple], list[np.ndarray]]:
    """Of non-empty texts: (n_a, n_b, n_groups, groups) of each, and (text, A id, B id, multiplicity) of all links.

    The byte offsets of all texts run on, so shared ends are found in one search; a text whose bytes either side
    doesn't give back has no tokens.
    """
    coded = list(zip(own.a.encode(texts), own.b.encode(texts)))
    given = lambda side, ids, whole: side.lengths[ids].sum() == len(whole) and b"".join(map(side.bytes.__getitem__, ids.tolist())) == whole
    good = [i for i, (t, (x, y)) in enumerate(zip(texts, coded)) if given(own.a, x, w := b" " + t.encode()) and given(own.b, y, w)]
    rows = [(0, 0, 0, b"")] * len(texts)
    if not good:
        return rows, [np.zeros(0, np.int64)] * 4
    sizes = [np.array([len(coded[i][s]) for i in good]) for s in (0, 1)]
    ids = [np.concatenate([coded[i][s] for i in good]).astype(np.int64) for s in (0, 1)]
    ends = [np.cumsum(side.lengths[x]) for side, x in zip((own.a, own.b), ids)]
    text = np.repeat(np.arange(len(good)), sizes[0])
    at = np.searchsorted(ends[1], ends[0])
    shared = ends[1][at] == ends[0]  # the last ends are equal, so no search runs out
    at, last = at[shared], [shared, np.zeros(len(ids[1]), bool)]
    last[1][at] = True
    groups = np.bincount(text[shared], minlength=len(good))

    group = [np.cumsum(x) - x for x in last]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    marks = np.concatenate([2 * ids[0] + last[0], 2 * (own.n_a + ids[1]) + last[1]])[order].tolist()
    begin = 0
    for k, i in enumerate(good):
        n_a, n_b = int(sizes[0][k]), int(sizes[1][k])
        rows[i] = (n_a, n_b, int(groups[k]), b"".join(map(own.written.__getitem__, marks[begin : begin + n_a + n_b]))[:-1])
        begin += n_a + n_b

    pair = (text[shared] * own.n_b + ids[1][at]) * own.n_a + ids[0][shared]
    pair, times = np.unique(pair, return_counts=True)
    rest, a = np.divmod(pair, own.n_a)
    k, b = np.divmod(rest, own.n_b)
    return rows, [np.array(good)[k], a, b, times]


DOCUMENTS = "row long, key {key}, n_a long, n_b long, n_groups long, groups {groups}, a array<int>, b array<int>, m array<int>"


def encoded(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, whole: bool) -> DataFrame:
    """A row for each document: its numbers, its groups or their digest, and its link multiplicities by id pair."""

    def run(batches):
        own, base, seen = sides(a_path, b_path), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= CHARS):
                    chars += len(texts[hi] or "")
                    hi += 1
                some = [i for i in range(lo, hi) if texts[i]]
                rows, (k, a, b, m) = links(own, [texts[i] for i in some])
                done = dict(zip(some, rows))
                per = np.zeros(hi - lo, np.int64)
                per[np.array(some, np.int64) - lo] = np.bincount(k, minlength=len(some)) if some else 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
                out = [done.get(i, (0, 0, 0, b"")) for i in range(lo, hi)]
                mark = [g.decode() if whole or not g else hashlib.sha256(g).hexdigest() for _, _, _, g in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(base + seen + np.arange(hi - lo)), batch.column("key").slice(lo, hi - lo),
                        *(pa.array([x[j] for x in out], pa.int64()) for j in range(3)), pa.array(mark, pa.string()),
                        *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (a, b, m)),
                    ],
                    ["row", "key", "n_a", "n_b", "n_groups", "groups", "a", "b", "m"],
                )
                seen += hi - lo
                lo = hi

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, DOCUMENTS.format(key=kind, groups="string"))


def homes(loads: dict[int, int], ids: int, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the postings of each side id go: (first slot, number of slots) of each id, and the slots' tasks.

    An id with more than half of a task's share is split over several slots, dealt by document; slots go, largest
    first, to the least loaded task. The table is bounded by the vocabulary and the number of tasks.
    """
    share = max(1, sum(loads.values()) / tasks / 2)
    number = np.ones(ids, np.int64)
    for i, n in loads.items():
        number[i] = min(tasks, -(-n // int(np.ceil(share))))
    first = np.cumsum(number) - number
    slots = np.arange(number.sum()) % tasks
    heap = [(0.0, t) for t in range(tasks)]
    for i, n in sorted(loads.items(), key=lambda x: (-x[1] / number[x[0]], x[0])):
        for j in range(number[i]):
            load, t = heapq.heappop(heap)
            slots[first[i] + j] = t
            heapq.heappush(heap, (load + n / number[i], t))
    return first, number, slots


POSTED = "task int, kind int, unit long, pairs array<long>, counts array<long>, rows array<long>, m array<int>"
SHARES = "unit long, rows array<long>, best array<long>, total array<long>"


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the exact sums of their values."""
    known, back = np.unique(keys, return_inverse=True)
    sums = [np.zeros(len(known), np.int64) for _ in values]
    for s, v in zip(sums, values):
        np.add.at(s, back, v)
    return known, *sums


def cogrouped(table: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """(row, n_best, count_sum) of each document that has links.

    ``table`` has (row, a, b, m): a document's link multiplicities. Postings are shuffled by B id, each batch of
    documents as one sorted run for each task, and beside them the batch's sums by id pair. A task's rows are sorted, by
    Spark and so with spilling: all sums of its ids come first, give each pair's count and each B id's maximum, and
    then the postings stream past them. A task holds only the pairs of its ids. The postings of frequent ids are split
    over tasks by document (see ``homes``); the sums of such an id go to each of them. What a task finds for a batch of
    documents is one row, and a second shuffle by batch adds it up by document.
    """
    spark = table.sparkSession

    def loads(batches):
        total = np.zeros(n_b, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("b").flatten().to_numpy(), minlength=n_b)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["b", "n"])

    # one row for each entry of the vocabulary at most
    load = {r.b: r.n for r in table.select("b").mapInArrow(loads, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()}
    tasks = max(partitions(spark), -(-sum(load.values()) // POSTINGS))
    first, number, slots = homes(load, n_b, tasks)

    def posted(batches):
        for batch in batches:
            size = np.diff(batch.column("a").offsets.to_numpy())
            a, b, m = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "m"))
            row = np.repeat(batch.column("row").to_numpy(), size)
            pair = b * n_a + a
            task = slots[first[b] + (mix(row.astype(np.uint64)) % number[b].astype(np.uint64)).astype(np.int64)]
            by = np.lexsort((pair, task))
            yield runs(1, batch.column("row")[0].as_py(), task[by], pair[by], None, row[by], m[by])

            known, counts = added(pair, m)
            width = number[known // n_a]
            at = np.repeat(np.arange(len(known)), width)
            place = slots[first[known[at] // n_a] + np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)]
            once = np.unique(place * len(known) + at) if len(at) else at
            place, at = np.divmod(once, max(len(known), 1))
            yield runs(0, None, place, known[at], counts[at], None, None)

    def runs(kind, unit, task, pair, counts, row, m):
        """A row for each run of one task."""
        heads = np.flatnonzero(np.r_[True, np.diff(task) != 0]) if len(task) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[heads, len(task)].astype(np.int32))
        listed = lambda x, t: pa.nulls(len(heads), pa.list_(t)) if x is None else pa.ListArray.from_arrays(offsets, pa.array(x, t))
        return pa.RecordBatch.from_arrays(
            [pa.array(task[heads].astype(np.int32)), pa.array(np.full(len(heads), kind, np.int32)), pa.array([unit] * len(heads), pa.int64()), listed(pair, pa.int64()), listed(counts, pa.int64()), listed(row, pa.int64()), listed(m, pa.int32())],
            ["task", "kind", "unit", "pairs", "counts", "rows", "m"],
        )

    def shares(batches):
        task, pairs, counts, held, most = None, np.zeros(0, np.int64), np.zeros(0, np.int64), [], None

        def settled():
            return added(np.concatenate([pairs, *(p for p, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))

        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("task")[r].as_py() != task:
                    task, pairs, counts, held, most = batch.column("task")[r].as_py(), np.zeros(0, np.int64), np.zeros(0, np.int64), [], None
                own = batch.column("pairs")[r].values.to_numpy()
                if batch.column("kind")[r].as_py() == 0:
                    held.append((own.copy(), batch.column("counts")[r].values.to_numpy().copy()))
                    if sum(len(p) for p, _ in held) > 1_000_000 + len(pairs):
                        (pairs, counts), held = settled(), []
                    continue
                if most is None:
                    (pairs, counts), held = settled(), []
                    heads = np.flatnonzero(np.r_[True, np.diff(pairs // n_a) != 0])
                    most = np.repeat(np.maximum.reduceat(counts, heads), np.diff(np.r_[heads, len(pairs)]))
                at = np.searchsorted(pairs, own)
                row, m = batch.column("rows")[r].values.to_numpy(), batch.column("m")[r].values.to_numpy().astype(np.int64)
                docs, best, total = added(row, np.where(counts[at] == most[at], m, 0), m * counts[at])
                yield pa.RecordBatch.from_arrays([batch.column("unit").slice(r, 1), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (docs, best, total))], ["unit", "rows", "best", "total"])

    def by_document(batches):
        unit, held = None, [np.zeros(0, np.int64)] * 3

        def whole():
            return pa.RecordBatch.from_arrays(list(map(pa.array, held)), ["row", "n_best", "count_sum"])

        for batch in batches:
            units = batch.column("unit").to_numpy()
            for lo, hi in zip(*(lambda c: ([0, *c], [*c, len(units)]))(np.flatnonzero(np.diff(units)) + 1)):
                if lo == hi:
                    continue
                if units[lo] != unit:
                    if unit is not None:
                        yield whole()
                    unit, held = units[lo], [np.zeros(0, np.int64)] * 3
                held = added(*(np.concatenate([h, batch.column(c).slice(lo, hi - lo).flatten().to_numpy()]) for h, c in zip(held, ("rows", "best", "total"))))
        if unit is not None:
            yield whole()

    sent = table.where(F.size("a") > 0).select("row", "a", "b", "m").mapInArrow(posted, POSTED)
    found = sent.repartition(tasks, "task").sortWithinPartitions("task", "kind").mapInArrow(shares, SHARES)
    return found.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(by_document, "row long, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    A is a byte-level vocabulary file of ``tokenizers`` and encodes a space and the text; B is a ``sentencepiece``
    model, which adds the space itself. Offsets where tokens of both end cut the tokens into groups; the two tokens
    that end there are a link. A pair of ids counts as often as it is linked in all documents: ``count_sum`` adds up
    the links' counts, ``n_best`` is the number of links whose count is the highest of their B id (ties included).
    ``groups_sha256`` is the hex digest of the groups, ``a1,a2|b1;a3|b2,b3``; with ``whole`` the groups themselves come
    in a column ``groups`` instead.

    Null and empty texts, and texts whose bytes either side doesn't give back, have zeros and an empty string.
    Repeated rows and ids are documents of their own; null keys pass. An empty table gives no rows. Other columns are
    not read. Both files must be present on every executor.
    """
    own = sides(a_path, b_path)
    table = stored(encoded(docs, a_path, b_path, key, text, whole), "aligned-documents")
    sums = cogrouped(table, own.n_a, own.n_b)
    zero = F.lit(0).cast("long")
    return table.select("row", "key", "n_a", "n_b", "n_groups", "groups").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        F.col("groups").alias("groups" if whole else "groups_sha256"),
    )

"""Long repeats in a corpus: content-routed segments and a run-length index over each shard of them.

Every 100-byte string is routed by the least hash of its 48-byte substrings, so all its occurrences meet whatever
document they stand in. Neighbouring strings with the same least hash form a segment. Equal segments are settled by
their digests, the first occurrence against the others. What remains are segments that share a least hash but differ,
mostly the edges of passages: these are concatenated in shards, and for each shard a run-compressed Burrows-Wheeler
transform with sampled run ends gives the matching statistics that mark the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm.arrow import append_columns
from tidewatch.llm.bytesops import BASE, BYTE_VALUES, INVERSE, U64, _power, chunks, mix, span_hashes, sums_to, text_bytes
from tidewatch.llm.storage import stored

GRAM = 48
#: Marks a segment's count if its text holds the least substring twice, so that the segment may repeat a string itself.
TWICE = 1 << 30
#: One segment: least hash (48 bits), digest, document, first string's start, number of strings.
SEGMENT = [("key", np.uint64), ("digest", np.uint64), ("doc", np.int64), ("start", np.int32), ("count", np.int32)]
WIDTHS = {"key": 6, "digest": 8, "doc": 8, "start": 4, "count": 4}


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[: len(x) - width + 1], have[width - span :][: len(x) - width + 1])


def recurring(grams: np.ndarray, least: np.ndarray, offsets: np.ndarray, row: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which segments may hold a string twice: those in whose strings the least substring stands twice.

    A substring is the least of some string around it if the greatest of those strings' leasts is its own hash.
    """
    width = len(grams) - len(least) + 1
    around = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    spots = np.flatnonzero(grams == ~sliding_least(~around, width))
    keys = mix(grams[spots] + (np.searchsorted(offsets, spots, "right") - 1).astype(U64) * U64(BASE))
    order = np.lexsort((spots, keys))
    keys, spots = keys[order], spots[order]
    own = mix(value + row.astype(U64) * U64(BASE))
    low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
    twice = np.zeros(len(row), bool)
    for i in np.flatnonzero(high - low > 1):
        here = spots[low[i] : high[i]]
        twice[i] = np.searchsorted(here, end[i] + width) - np.searchsorted(here, start[i]) > 1
    return twice


def segments(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All segments of a batch of texts."""
    found = []
    for low, high in chunks(offsets, 1 << 19):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        n = len(part)
        if n < length:
            continue
        sums = sums_to(BYTE_VALUES[part] * _power(BASE, n, "up"))
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * _power(INVERSE, n + 1, "down")[: n - GRAM + 1])
        least = sliding_least(grams, length - GRAM + 1)
        room = np.repeat(own[1:], np.diff(own))[: len(least)]
        valid = np.arange(len(least)) + length <= room
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (room[1:] != room[:-1])
        tail = valid.copy()
        tail[:-1] &= ~valid[1:] | (least[1:] != least[:-1]) | (room[1:] != room[:-1])
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail)
        row = np.searchsorted(own, starts, "right") - 1
        count = (ends - starts + 1) | np.where(recurring(grams, np.where(valid, least, U64(0)), own, row, least[starts], starts, ends), TWICE, 0)
        found.append((least[starts] & U64((1 << 48) - 1), span_hashes(part, starts, ends + length), docs[low + row], (starts - own[row]).astype(np.int32), count.astype(np.int32)))
    if not found:
        return {name: np.empty(0, kind) for name, kind in SEGMENT}
    return {name: np.concatenate([f[i] for f in found]) for i, (name, _) in enumerate(SEGMENT)}


def packed(columns: dict[str, np.ndarray]) -> bytes:
    """Segments as bytes, plane by plane, so that the shuffle compresses the high planes away."""
    return b"".join(np.ascontiguousarray(columns[n]).view(np.uint8).reshape(-1, np.dtype(k).itemsize)[:, : WIDTHS[n]].T.tobytes() for n, k in SEGMENT)


def unpacked(blobs) -> dict[str, np.ndarray]:
    width, parts = sum(WIDTHS.values()), {n: [] for n, _ in SEGMENT}
    for blob in blobs:
        n, at = len(blob) // width, 0
        raw = np.frombuffer(blob, np.uint8)
        for name, kind in SEGMENT:
            full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
            full[:, : WIDTHS[name]] = raw[at : at + n * WIDTHS[name]].reshape(WIDTHS[name], n).T
            parts[name].append(full.view(kind).ravel())
            at += n * WIDTHS[name]
    return {n: np.concatenate(parts[n]) if parts[n] else np.empty(0, k) for n, k in SEGMENT}


def taken(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {n: c[at] for n, c in columns.items()}


def strings(columns: dict[str, np.ndarray]) -> np.ndarray:
    """The number of strings in each segment."""
    return columns["count"].astype(np.int64) & (TWICE - 1)


def ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Covered byte ranges by document, merged, as flat lists of starts and ends."""
    if not len(doc):
        return [], []
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    turn = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + turn * (1 << 40)) - turn * (1 << 40)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    heads = np.flatnonzero(fresh)
    tails = np.r_[heads[1:] - 1, len(doc) - 1]
    pairs = np.column_stack([start[heads], reach[tails]]).ravel().astype(np.int32)
    cut = np.flatnonzero(np.r_[True, doc[heads][1:] != doc[heads][:-1]])
    return doc[heads][cut].tolist(), [x.tolist() for x in np.split(pairs, cut[1:] * 2)]


def outcome(kind: list, doc: list, edges: list, data: list) -> pd.DataFrame:
    return pd.DataFrame({"kind": pd.Series(kind, dtype="int32"), "doc": pd.Series(doc, dtype="int64"), "edges": pd.Series(edges, dtype=object), "data": pd.Series(data, dtype=object)})


def firsts(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Segments sorted by key, digest, document and start, and which of them come first among equal ones."""
    s = taken(columns, np.lexsort((columns["start"], columns["doc"], columns["digest"], columns["key"])))
    return s, np.r_[True, (s["digest"][1:] != s["digest"][:-1]) | (s["key"][1:] != s["key"][:-1])] if len(s["doc"]) else np.empty(0, bool)


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of a list of byte strings, with samples at its run ends.

    What is kept of the transform: each run's symbol, length and place, where the run maps to, and the text positions
    at its first and last row. The suffix order is dropped once the runs are known. All strings are then streamed
    backwards through the runs, which fills in the samples, and forwards over the samples, which gives the matching
    statistics.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, stride: int = 1024):
        n, rows = len(data), np.arange(len(offsets) - 1)
        self.ends = offsets[1:] + rows  # each string is followed by a separator of its own
        text = np.zeros(n + len(rows), np.int64)
        self.inside = np.ones(len(text), bool)
        self.inside[self.ends] = False
        text[self.inside] = data.astype(np.int64) + len(rows)
        text[self.ends] = rows
        self.text = text
        row = np.repeat(rows, np.diff(offsets) + 1)
        order, rank = self.sorted_suffixes(np.where(self.inside, text - len(rows) + 1, 0), self.ends[row] - np.arange(len(text)), row)
        before = text[order - 1]  # the transform; the last separator stands before the first symbol
        self.heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.symbols, self.lengths = before[self.heads], np.diff(np.r_[self.heads, len(text)])
        by = np.argsort(self.symbols, kind="stable")
        self.maps = np.empty(len(by), np.int64)  # the row that a run's first row maps to: runs in order of their symbols
        self.maps[by] = np.cumsum(self.lengths[by]) - self.lengths[by]
        begins = offsets[:-1] + rows
        pieces = (self.ends - begins) // stride + 1  # long strings are streamed in stretches, from rows kept at each
        floors = np.repeat(begins, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stride
        tops = np.minimum(floors + stride - 1, np.repeat(self.ends, pieces))
        rows_at = rank[tops]
        del order, rank, before
        self.stream(tops, floors, rows_at)

    def stream(self, tops: np.ndarray, floors: np.ndarray, at: np.ndarray) -> None:
        """Walk from each top down to its floor through the runs; note the text positions at run heads and tails."""
        self.sample, self.tail = np.full((2, len(self.heads)), -1, np.int64)
        steps = tops - floors + 1
        by = np.argsort(-steps, kind="stable")
        position, at, steps = tops[by], at[by], -steps[by]
        for t in range(int(-steps[0]) if len(steps) else 0):
            live = int(np.searchsorted(steps, -t))
            position, at = position[:live], at[:live]
            run = np.searchsorted(self.heads, at, "right") - 1
            into = at - self.heads[run]
            first, last = into == 0, into == self.lengths[run] - 1
            self.sample[run[first]], self.tail[run[last]] = position[first], position[last]
            position, at = position - 1, self.maps[run] + into

    @staticmethod
    def sorted_suffixes(symbols: np.ndarray, room: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order and ranks by prefix doubling, seven symbols at first; only ties are sorted again.

        ``room``: symbols up to the string's separator, which is 0 in ``symbols`` and sorts by ``row``.
        """
        n, width = len(symbols), 7
        key, padded = np.zeros(n, np.int64), np.concatenate([symbols, np.zeros(width, np.int64)])
        for j in range(width):
            key = key * 512 + np.where(room >= j, padded[j : j + n], 0)
        group, rank = np.zeros(n, np.int64), np.empty(n, np.int64)
        ties = np.arange(n)
        while len(ties):
            by = np.argsort(key)
            ties, group, key = ties[by], group[by], key[by]
            head = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
            outer = np.r_[True, group[1:] != group[:-1]]
            spot = np.arange(len(ties))
            rank[ties] = group + (np.maximum.accumulate(np.where(head, spot, 0)) - np.maximum.accumulate(np.where(outer, spot, 0)))
            alone = head & np.r_[head[1:], True]
            ties = ties[~alone]
            group = rank[ties]
            beyond = np.where(room[ties] < width, row[ties], rank[np.minimum(ties + width, n - 1)])
            key = group * (n + 1) + beyond + 1
            width *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return order, rank

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Lengths of common prefixes of suffix pairs, counted up to ``most``."""
        out, live = np.zeros(len(a), np.int64), np.flatnonzero((a >= 0) & (b >= 0))
        for _ in range(most):
            x, y = a[live] + out[live], b[live] + out[live]
            live = live[self.text[np.minimum(x, len(self.text) - 1)] == self.text[np.minimum(y, len(self.text) - 1)]]
            if not len(live):
                break
            out[live] += 1
        return out

    def matching(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text position the suffix sorted before it and the length matched with it, from the run samples.

        Streams forwards: at a run head the suffix before is the sampled tail of the run before, and the length is
        compared, up to the longest string; at each further position both move on by one and the match is one less.
        """
        above = np.r_[-1, self.tail[:-1]]
        by = np.argsort(self.sample)
        at, near, length = self.sample[by], above[by], self.common(self.sample[by], above[by], most)
        here = np.arange(len(self.text))
        each = np.searchsorted(at, here, "right") - 1
        return near[each] + here - at[each], np.maximum(length[each] - (here - at[each]), 0)

    def earlier(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (without separators) whose ``length`` bytes also start earlier, and those where they start first.

        Equal strings are neighbours in suffix order, so chains of long matches tie them; the chains are followed by
        doubling, and the least position of each starts first.
        """
        here, separators = np.arange(len(self.text)), self.ends
        near, match = self.matching(int(np.diff(np.r_[-1, separators]).max()))
        root = np.where(match >= length, near, here)
        while not np.array_equal(after := root[root], root):
            root = after
        least = np.empty(len(here), np.int64)
        least[root[::-1]] = here[::-1]
        later = least[root] != here
        room = separators[np.searchsorted(separators, here)] - here
        fits = (room >= length) & self.inside
        place = np.cumsum(self.inside) - 1
        return place[later & fits], place[~later & fits]


def known(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys stand in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def crowded_keys(rows: DataFrame, total: int, length: int, crowd: int, sample_bytes: int = 32 << 20) -> np.ndarray:
    """Least hashes that stand in so many different segments that one shard must not take them all.

    They are found in the documents of a hash sample, an estimate that decides routes and never results: at least
    ``sample_bytes`` and one 64th of the corpus. At most 100,000 keys come out, as each must hold ``crowd`` segments and a
    hundred-thousandth of all.
    """
    share = max(1 / 64, min(1.0, sample_bytes / max(total, 1)))
    limit = max(crowd, total / 27 / 100_000) * share

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("t"))
            ids = batch.column("doc").to_numpy()
            for low, high in chunks(offsets, 8 << 20):
                s, first = firsts(segments(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], ids[low:high], length))
                keys, n = np.unique(s["key"][first], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": keys[n > 1].astype(np.int64), "n": n[n > 1]})

    some = rows.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 16)) < share * (1 << 16))
    often = some.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= limit)
    return np.sort(np.array([r["key"] for r in often.select("key").collect()], np.uint64))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, crowd: int = 8192, shard_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, edges): the bytes of each document covered by a ``length``-byte string that also starts earlier.

    Earlier means in a smaller id, or in the same document at a smaller start. ``edges`` holds start, end, start, end
    and so on of ranges that may overlap; documents without such bytes have no row. Null texts and texts shorter than
    ``length`` have none; rows with a null id are left out. Equal rows count as one document; an id must not name
    different texts. The number of shards follows the corpus, one for ``shard_bytes`` of text. A least hash that stands in
    more than ``crowd`` different segments (see ``crowded_keys``) is dealt over all shards by the segments' digests,
    and its first strings then meet by their own digests; so no shard grows with a hot passage.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= length)).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    often = spark.sparkContext.broadcast(crowded_keys(rows, total, length, crowd))
    result = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("edges", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])

    def route(batches):
        """The segments of every few megabytes by shard. Of equal ones only the first goes on; the others are covered."""
        for batch in batches:
            data, offsets = text_bytes(batch.column("t"))
            ids = batch.column("doc").to_numpy()
            for low, high in chunks(offsets, 8 << 20):
                s, first = firsts(segments(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], ids[low:high], length))
                doc, edges = ranges(s["doc"][~first], s["start"][~first], s["start"][~first] + strings(s)[~first] + length - 1)
                s = taken(s, first)
                spread = known(s["key"], often.value)
                shard = (np.where(spread, mix(s["key"] + s["digest"]), s["key"]) % U64(shards)).astype(np.int64)
                s = taken(s, order := np.lexsort((s["start"], s["doc"], shard)))
                bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                some = np.flatnonzero(np.diff(bounds))
                blobs = [packed(taken(s, slice(bounds[i], bounds[i + 1]))) for i in some]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([*some.tolist(), *[d % shards for d in doc]], pa.int32()), "doc": pa.array([*[None] * len(some), *doc], pa.int64()),
                    "edges": pa.array([*[None] * len(some), *edges], pa.list_(pa.int32())), "data": pa.array([*blobs, *[None] * len(doc)], pa.binary()),
                })

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Equal segments of a shard: all but the first are covered. Of a key's different ones the firsts go on."""
        passed = pdf[pdf.doc.notna()]
        s, first = firsts(unpacked(pdf.data[pdf.doc.isna()]))
        doc, edges = ranges(s["doc"][~first], s["start"][~first], s["start"][~first] + strings(s)[~first] + length - 1)
        s = taken(s, first)
        head = np.r_[True, s["key"][1:] != s["key"][:-1]] if len(s["key"]) else np.empty(0, bool)
        group = np.cumsum(head) - 1
        size = np.bincount(group, minlength=1)[group] if len(group) else np.empty(0, np.int64)
        within = np.arange(len(group)) - np.flatnonzero(head)[group] if len(group) else group
        spread = known(s["key"], often.value)  # such a key's segments stand in other shards, too
        part = within // crowd + np.where(spread, (int(pdf.shard.iloc[0]) + 1) << 24, 0)
        s["digest"] = part.astype(np.uint64) * U64(2) + ((size > crowd) | spread).astype(np.uint64)
        s = taken(s, (size > 1) | spread | (s["count"] >= TWICE))
        s = taken(s, order := np.lexsort((s["start"], s["doc"])))
        cut = np.flatnonzero(np.r_[True, s["doc"][1:] != s["doc"][:-1]]) if len(order) else np.empty(0, np.int64)
        blobs = [packed(taken(s, slice(a, b))) for a, b in zip(cut, np.r_[cut[1:], len(s["doc"])])]
        kinds = [0] * (len(passed) + len(doc)) + [1] * len(cut)
        return outcome(kinds, [*passed.doc.astype("int64"), *doc, *s["doc"][cut].tolist()], [*passed.edges, *edges, *[None] * len(cut)], [*[None] * (len(passed) + len(doc)), *blobs])

    routed = rows.mapInArrow(route, "shard int, doc long, edges array<int>, data binary")
    settled = stored(routed.groupBy("shard").applyInPandas(settle, result), "segments")

    def cut_out(batches):
        """The bytes of the segments that differ, by their second shard: (metadata, bytes)."""
        for batch in batches:
            texts = batch.column("t")
            made = {"shard": [], "part": [], "meta": [], "data": []}
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                s = unpacked(batch.column("blobs")[i].as_py())
                shard = (s["key"] % U64(shards)).astype(np.int64)
                for h, p in set(zip(shard.tolist(), s["digest"].tolist())):
                    own = taken(s, (shard == h) & (s["digest"] == U64(p)))
                    ends = own["start"].astype(np.int64) + strings(own) + length - 1
                    made["shard"].append(h)
                    made["part"].append(p)
                    made["meta"].append(packed(own))
                    made["data"].append(b"".join(bytes(raw[int(a) : int(b)]) for a, b in zip(own["start"], ends)))
            if made["shard"]:
                yield pa.RecordBatch.from_pydict({"shard": pa.array(made["shard"], pa.int32()), "part": pa.array(made["part"], pa.int64()), "meta": pa.array(made["meta"], pa.binary()), "data": pa.array(made["data"], pa.binary())})

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        """Index a shard's segments and mark the strings that start earlier in it."""
        metas = [unpacked([m]) for m in pdf.meta]
        s = {n: np.concatenate([m[n] for m in metas]) for n, _ in SEGMENT}
        size = strings(s) + length - 1
        data, at = np.frombuffer(b"".join(pdf.data), np.uint8), sums_to(size)
        order = np.lexsort((s["start"], s["doc"]))
        s, own = taken(s, order), size[order]
        offsets = sums_to(own)
        data = data[np.repeat(at[:-1][order] - offsets[:-1], own) + np.arange(offsets[-1])]
        later, first = RunIndex(data, offsets).earlier(length)
        row = np.searchsorted(offsets, later, "right") - 1
        begin = s["start"][row] + later - offsets[row]
        doc, edges = ranges(s["doc"][row], begin, begin + length)
        kinds, docs_, datas = [0] * len(doc), doc, [None] * len(doc)
        row = np.searchsorted(offsets, first, "right") - 1
        some = (s["digest"][row] & U64(1)) == 1  # the key is dealt over several shards
        if some.any():
            row, first = row[some], first[some]
            own = np.rec.fromarrays([span_hashes(data, first, first + length).view(np.int64), s["doc"][row], (s["start"][row] + first - offsets[row]).astype(np.int64)])
            kinds, docs_, edges, datas = [*kinds, 2], [*docs_, 0], [*edges, None], [*datas, np.ascontiguousarray(np.column_stack([own.f0, own.f1, own.f2])).tobytes()]
        return outcome(kinds, docs_, edges, datas)

    differing = settled.where("kind = 1").groupBy("doc").agg(F.collect_list("data").alias("blobs"))
    pieces = differing.join(rows, "doc").select("t", "blobs").mapInArrow(cut_out, "shard int, part long, meta binary, data binary")
    tasks = min(-(-shards // 4), 50_000)  # the work follows the shards, not the few bytes that adaptive execution sees
    indexed = stored(pieces.repartition(tasks, "shard", "part").groupBy("shard", "part").applyInPandas(index, result), "edges")

    def loose(batches):
        for batch in batches:
            for blob in batch.column("data").to_pylist():
                x = np.frombuffer(blob, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_pydict({"h": x[:, 0], "doc": x[:, 1], "at": x[:, 2]})

    spread = indexed.where("kind = 2").select("data").mapInArrow(loose, "h long, doc long, at long")
    least = spread.groupBy("h").agg(F.min(F.struct("doc", "at")).alias("least"))
    crossed = spread.join(least, "h").where(F.struct("doc", "at") != F.col("least")).select("doc", F.array(F.col("at").cast("int"), (F.col("at") + length).cast("int")).alias("edges"))
    marks = settled.where("kind = 0").select("doc", "edges").unionByName(indexed.where("kind = 0").select("doc", "edges")).unionByName(crossed)
    return marks.groupBy("doc").agg(F.flatten(F.collect_list("edges")).alias("edges")).withColumnRenamed("doc", key)


def covered(edges, size: int) -> np.ndarray:
    """Which bytes of a text lie in the ranges."""
    step = np.zeros(size + 1, np.int64)
    e = np.minimum(np.asarray(edges, np.int64), size)
    np.add.at(step, e[0::2], 1)
    np.add.at(step, e[1::2], -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes, binary), ``n_removed`` and ``n_spans`` (maximal removed runs).

    With ``as_text`` it has ``kept_text`` instead: the remaining bytes as text, less the parts of cut characters.
    Null texts have kept = empty and nothing removed; so have rows with a null id, whose bytes all stay. Columns of
    these names are replaced, all others pass through.
    """
    spans = repeated_spans(docs, key, text, length)
    joined = docs.drop("_edges").join(spans.withColumnRenamed("edges", "_edges"), key, "left")

    def compute(batch):
        data, offsets = text_bytes(batch.column(text))
        marked = batch.column("_edges")
        kept, removed, runs = [], [], []
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            if not marked[i].is_valid:
                kept.append(own.tobytes())
                removed.append(0)
                runs.append(0)
                continue
            gone = covered(marked[i].values.to_numpy(), len(own))
            kept.append(own[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
        left = {"kept_text": [x.decode("utf-8", "ignore") for x in kept]} if as_text else {"kept": pa.array(kept, pa.binary())}
        return left | {"n_removed": removed, "n_spans": runs}

    remains = T.StructField("kept_text", T.StringType()) if as_text else T.StructField("kept", T.BinaryType())
    fields = [remains, T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]
    return append_columns(joined, compute, fields, drop=("_edges",))


def brute_force(texts: dict[int, bytes], length: int = 100) -> dict[int, np.ndarray]:
    """The definition itself, for small inputs: which bytes of each document are covered."""
    seen, out = set(), {}
    for doc in sorted(texts):
        data = texts[doc]
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        out[doc] = gone
    return out

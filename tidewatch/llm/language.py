"""Language identification by prediction by partial matching (PPM, method C escapes)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm.arrow import append_columns
from tidewatch.llm.bytesops import chunks, text_bytes

LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte it and the ``order`` bytes before it, packed; a text begins after newlines, A-Z count as a-z."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + order * (rows + 1)
    padded = np.full(len(data) + order * len(offsets), 10, np.uint32)
    padded[at] = LOWER[data]
    out = padded[at]
    for j in range(1, order + 1):
        out |= padded[at - j] << np.uint32(8 * j)
    return out


class Slots:
    """Finds packed keys in an open table; the few keys that share a slot are searched in order."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint32(32 - max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4)))))
        self.slot = np.full(1 << (32 - int(self.shift)), -1, np.int32)
        home = self.home(keys)
        self.slot[home[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        lost = self.slot[home] != np.arange(len(keys))
        self.crowded = np.zeros(len(self.slot), bool)
        self.crowded[home[lost]] = True

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        home = self.home(keys)
        at = self.slot[home]
        miss = self.keys[at] != keys
        at[miss | (at < 0)] = -1
        rest = np.flatnonzero(miss & self.crowded[home])
        if len(rest):
            place = np.searchsorted(self.keys, keys[rest])
            place[place == len(self.keys)] = 0
            at[rest] = np.where(self.keys[place] == keys[rest], place, -1)
        return at


class PartialMatching:
    """Frozen context trees of all languages, with the exact code length of every known context and byte."""

    def __init__(self, languages: list[str], order: int, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``counts[k]``: (language, packed key, count) of the contexts of k bytes."""
        self.languages, self.order = languages, order
        self.symbols: list[tuple[Slots, np.ndarray]] = []
        self.contexts: list[tuple[Slots, np.ndarray]] = []
        wide = len(languages)
        for k in range(order + 1):
            lang, key, n = counts[k]
            known, contexts = np.unique(key), np.unique(key >> np.uint32(8))
            seen = np.zeros((len(known), wide))
            seen[np.searchsorted(known, key), lang] = n
            above = np.searchsorted(contexts, known >> np.uint32(8))
            total, distinct = np.zeros((2, len(contexts), wide))
            np.add.at(total, above, seen)
            np.add.at(distinct, above, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
                self.contexts.append((Slots(contexts), escape))
                lower = self.lengths(known & np.uint32((1 << (8 * k)) - 1), k - 1) + escape[above]
                own = -np.log2(seen / (total + distinct)[above])
            self.symbols.append((Slots(known), np.where(seen > 0, own, lower)))

    def lengths(self, keys: np.ndarray, k: int | None = None) -> np.ndarray:
        """Bits of the last byte of each key under each language: from the longest known context, through escapes."""
        k = self.order if k is None else k
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        slots, bits = self.symbols[k]
        at = slots.find(keys)
        out = bits[at]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            slots, escapes = self.contexts[k]
            context = slots.find(keys[rest] >> np.uint32(8))
            more = np.where(context[:, None] >= 0, escapes[context], 0) if len(escapes) else 0
            out[rest] = self.lengths(keys[rest] & np.uint32((1 << (8 * k)) - 1), k - 1) + more
        return out


class LanguageModel:
    """Context trees of all languages, a few languages a table, so that no table is languages times contexts wide."""

    def __init__(self, languages: list[str], order: int, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], together: int = 8):
        self.languages, self.order, self.tables = languages, order, []
        for first in range(0, len(languages), together):
            some = [(lang >= first) & (lang < first + together) for lang, _, _ in counts]
            own = [(lang[x] - first, key[x], n[x]) for x, (lang, key, n) in zip(some, counts)]
            self.tables.append(PartialMatching(languages[first : first + together], order, own))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for low, high in chunks(offsets, 1 << 18):
            part = data[offsets[low] : offsets[high]]
            if len(part):
                own = offsets[low : high + 1] - offsets[low]
                some = np.flatnonzero(np.diff(own))
                keys, at = grams(part, own, self.order), 0
                for table in self.tables:
                    wide = len(table.languages)
                    out[low + some, at : at + wide] = np.add.reduceat(table.lengths(keys), own[some], axis=0)
                    at += wide
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 3, sample_bytes: int = 6_000_000) -> LanguageModel:
    """Fit on about ``sample_bytes`` bytes of whole texts of each language, chosen by the hash of ``key``.

    Every context of the sample is kept, so code lengths are exact under its statistics; a language has at most
    ``sample_bytes`` contexts of each order whatever the input. Rows with a null text or language are no examples. An
    empty input gives a model without languages, which calls every text ``und``.
    """
    docs = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k"))
    sizes = {r["l"]: r["b"] for r in docs.groupBy("l").agg(F.sum(F.octet_length("t")).alias("b")).collect()}
    languages = sorted(x for x in sizes if sizes[x])
    place = {x: i for i, x in enumerate(languages)}
    if not languages:
        empty = np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64)
        return LanguageModel([], order, [empty] * (order + 1))
    share = F.lit(0.0)
    for x in languages:
        share = F.when(F.col("l") == x, F.lit(min(1.0, sample_bytes / sizes[x]))).otherwise(share)
    chosen = docs.where(F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < share * 1_000_003).select("t", "l")
    schema = "lang int, context int, gram long, n long"

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("t"))
            lang = np.array([place[x] for x in batch.column("l").to_pylist()])
            for low, high in chunks(offsets, 1 << 20):
                part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                which = np.repeat(lang[low:high], np.diff(own)).astype(np.int64)
                for k in range(order + 1):
                    found, n = np.unique(which << 32 | grams(part, own, k).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(found >> 32, pa.int32()), "context": pa.array(np.full(len(found), k), pa.int32()), "gram": pa.array(found & 0xFFFFFFFF), "n": pa.array(n.astype(np.int64))})

    rows = chosen.mapInArrow(count, schema).groupBy("lang", "context", "gram").agg(F.sum("n").alias("n")).toPandas()
    parts = []
    for k in range(order + 1):
        own = rows[rows.context == k]
        parts.append((own.lang.to_numpy(np.int64), own.gram.to_numpy(np.uint32), own.n.to_numpy(np.int64)))
    return LanguageModel(languages, order, parts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte`` of every whole text.

    ``score`` is the posterior of the best language under equal priors. A text that is null, empty or without a
    letter is ``und`` with score 0 and null bits. Equal code lengths go to the first language by name. Columns of
    these names are replaced, all others pass through; repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def compute(batch):
        model = shared.value
        data, offsets = text_bytes(batch.column(text))
        letters = batch.column("_letters").to_numpy(zero_copy_only=False)
        n = len(letters)
        if not model.languages:
            return {"lang_pred": ["und"] * n, "score": np.zeros(n), "bits_per_byte": [None] * n}
        bits = model.score(data, offsets)
        best = bits.argmin(1)
        gap = np.minimum((bits - bits.min(1)[:, None]) * np.log(2), 700)
        size = np.diff(offsets)
        return {
            "lang_pred": [model.languages[b] if x else "und" for b, x in zip(best, letters)],
            "score": np.where(letters, 1 / np.exp(-gap).sum(1), 0.0),
            "bits_per_byte": pa.array(bits.min(1) / np.maximum(size, 1), mask=~letters),
        }

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    ready = docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return append_columns(ready, compute, fields, drop=("_letters",))

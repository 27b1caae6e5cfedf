"""Quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm.arrow import append_columns, examples
from tidewatch.llm.bytesops import chunks, span_hashes, text_bytes, words

STATISTICS = ["bytes", "words", "word_bytes", "word_spread", "upper", "digits", "points", "symbols", "other", "lines", "line_bytes", "new_words", "new_lines", "doubled", "ends"]
KIND = np.zeros(256, np.int64)  # 0: other ASCII
KIND[97:123] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 5
KIND[[32, 9, 10, 11, 12, 13]] = 6
KIND[128:] = 7


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    fresh = np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])] if len(r) else np.zeros(0, bool)
    return np.bincount(r[fresh], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text: log sizes and logits of shares, so that tails are near normal."""
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for low, high in chunks(offsets):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        n, size = high - low, np.diff(own).astype(float)
        row = np.repeat(np.arange(n), np.diff(own))
        kinds = np.bincount(row * 8 + KIND[part], minlength=8 * n).reshape(n, 8).astype(float)
        starts, ends = words(part, own)
        wrow = np.searchsorted(own, starts, "right") - 1
        nwords = np.bincount(wrow, minlength=n).astype(float)
        length = (ends - starts).astype(float)
        mean = np.bincount(wrow, length, n) / np.maximum(nwords, 1)
        spread = np.sqrt(np.maximum(np.bincount(wrow, length**2, n) / np.maximum(nwords, 1) - mean**2, 0))
        hashes = span_hashes(part, starts, ends) if len(starts) else np.empty(0, np.uint64)
        doubled = np.bincount(wrow[1:][(hashes[1:] == hashes[:-1]) & (wrow[1:] == wrow[:-1])], minlength=n) if len(starts) else np.zeros(n)
        ended = np.bincount(wrow, np.isin(part[ends - 1], [46, 44, 63]) if len(starts) else None, n)
        newline = np.flatnonzero(part == 10)
        bounds = np.unique(np.r_[own[:-1][size > 0], newline + 1, own[-1:]])
        lstarts, lends = bounds[:-1], bounds[1:]
        if len(lstarts):
            lends = lends - (part[lends - 1] == 10)
            full = lends > lstarts
            lstarts, lends = lstarts[full], lends[full]
        lrow = np.searchsorted(own, lstarts, "right") - 1
        nlines = np.bincount(lrow, minlength=n).astype(float)
        lhash = span_hashes(part, lstarts, lends) if len(lstarts) else np.empty(0, np.uint64)
        letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 7], 0)
        share = lambda a, b: np.log((a + 0.5) / (b - a + 2.0))  # noqa: E731  b >= a
        out[low:high] = np.column_stack([
            np.log1p(size), np.log1p(nwords), np.log1p(mean), np.log1p(spread), share(kinds[:, 2], letters), share(kinds[:, 3], size), share(kinds[:, 4], size),
            share(kinds[:, 5], size), share(kinds[:, 0], size), np.log1p(nlines), np.log1p(size / np.maximum(nlines, 1)), share(_distinct(wrow, hashes, n), nwords),
            share(_distinct(lrow, lhash, n), nlines), share(doubled, nwords), share(ended, nwords),
        ])
    return out


@dataclass
class Discriminant:
    """Class means, the inverses of the covariances' Cholesky factors, their log determinants and log priors."""

    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray
    temperature: float = 1.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors: by squared Mahalanobis distances."""
        side = [-0.5 * ((((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) + self.logdet[c]) + self.prior[c] for c in (0, 1)]
        return (side[1] - side[0]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = 10_000, shrinkage: float = 0.1, pooling: float = 0.05) -> Discriminant:
    """Fit on about ``sample_rows`` whole texts of each label, chosen by the hash of ``key``.

    One pass adds up counts, sums and products of the statistics of each class; priors are those of all labels. Each covariance is shrunk towards its diagonal by ``shrinkage`` and the pooled covariance by ``pooling``. Rows with
    a null text or label are no examples. A class without examples gets the pooled moments, so scores stay defined.
    """
    k = len(STATISTICS)

    def moments(batches):
        total = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            data, offsets = text_bytes(batch.column("t"))
            x, y = statistics(data, offsets), batch.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        for c in (0, 1):
            yield pa.RecordBatch.from_pydict({"y": pa.array([c] * total.shape[1], pa.int32()), "i": pa.array(np.arange(total.shape[1], dtype=np.int32)), "v": total[c]})

    rows, sizes, _ = examples(docs, labels, text, label, key, sample_rows)
    sums = rows.select(F.col("text").alias("t"), "y").mapInArrow(moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + k + k * k))
    total[sums.y, sums.i] = sums.v
    n, both = total[:, 0], total.sum(0)
    both_mean = both[1 : 1 + k] / max(both[0], 1)
    pooled = both[1 + k :].reshape(k, k) / max(both[0], 1) - np.outer(both_mean, both_mean) + 1e-3 * np.eye(k)
    mean, inverse, logdet = np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2)
    for c in (0, 1):
        mean[c] = total[c, 1 : 1 + k] / n[c] if n[c] else both_mean
        own = total[c, 1 + k :].reshape(k, k) / n[c] - np.outer(mean[c], mean[c]) if n[c] > k else pooled
        own = (1 - shrinkage) * own + shrinkage * np.diag(np.diag(own))
        factor = np.linalg.cholesky((1 - pooling) * own + pooling * pooled + 1e-3 * np.eye(k))
        inverse[c] = np.linalg.inv(factor)
        logdet[c] = 2 * np.log(np.diag(factor)).sum()
    of = np.array([sizes.get(0, 0), sizes.get(1, 0)])
    prior = np.log((of + 1) / (of.sum() + 2))
    return Discriminant(mean, inverse, logdet, prior)


def score_quality(docs: DataFrame, model: Discriminant, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1: how likely label 1 is) of every whole text.

    Null counts as an empty text, whose statistics are all defined. Equal texts get equal scores. A column named
    ``score`` is replaced; all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes whatever the input

    def compute(batch):
        return {"score": shared.value.score(statistics(*text_bytes(batch.column(text))))}

    return append_columns(docs, compute, [T.StructField("score", T.DoubleType())])

"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.storage import stored

#: Tables of benchmark shingles or of windows up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Words in a stretch of a document, in which windows meet the known shingles that they cover.
STRETCH = 256


def word_array(text: str = "text") -> Column:
    """Lower-case runs of letters and digits; empty for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def shingle_array(words: Column, size: int = 5) -> Column:
    """Hashes of all ``size``-word shingles in order; fewer words are one shingle, none give an empty array.

    The words are bound by a lambda, so that they are split once and not once for each shingle.
    """

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), hashed), F.lit(0))


def simhash(weighted: str) -> Column:
    """64-bit SimHash of an array of (sh, w): each bit is the sign of the weights' sum."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(aggregate({weighted}, 0D, (s, x) -> s + x.w * (2 * (shiftright(x.sh, b) & 1L) - 1)) > 0, shiftleft(1L, b), 0L))")


def radius(similarity: float, deviations: float = 5.0) -> int:
    """Bits in which fingerprints of similar bags may differ.

    Bags of Jaccard similarity s have a cosine of at least 2 s / (1 + s); each bit then differs with a chance of at
    most angle / pi. The radius lies ``deviations`` standard deviations above the mean of 64 such bits.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(63, math.ceil(64 * p + deviations * math.sqrt(64 * p * (1 - p))))


def hamming_blocks(fingerprint: str, radius: int) -> Column:
    """The fingerprint cut into ``radius`` + 1 blocks of bits: two of at most ``radius`` differing bits agree in one."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft(F.col(fingerprint), 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i]).alias("bits")) for i in range(n)])


def jaccard(both: str, a: str, b: str) -> Column:
    return F.col(both) / (F.col(a) + F.col(b) - F.col(both))


def prints(bags: DataFrame, keys: list[str]) -> DataFrame:
    """Two fingerprints of each bag (keys..., sh, n, w): of the plain counts (kind 0) and of the weights (kind 1)."""
    both = bags.groupBy(*keys).agg(F.collect_list(F.struct("sh", F.col("n").cast("double").alias("w"))).alias("plain"), F.collect_list(F.struct("sh", (F.col("n") * F.col("w")).alias("w"))).alias("weighted"))
    return both.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), simhash("plain").alias("print")), F.struct(F.lit(1).alias("kind"), simhash("weighted").alias("print")))).alias("p")).select(*keys, "p.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity, distance): benchmark items that documents hold.

    A window of as many words as the item matches it if the Jaccard similarity of their multisets of ``size``-word
    shingles is at least ``similarity``, plain or weighted, and the greater of the two counts. In the weighted one a
    shingle weighs 1 over the number of items that hold it, so that what items share decides less; the plain one finds
    edited copies of items that are repeated or follow a template. One row for each document and item, with the best
    window, the first of equals. Five steps:

    1. One scan of all whole texts keeps the places of shingles that the benchmark knows; texts are not read again.
    2. Each known shingle proposes the windows that it could stand in: an item's number of words, from the place where
       that item would begin, clipped to the document. Which item it is does not matter yet. A window whose known
       shingles are too few to reach ``similarity`` with any item of its size goes.
    3. The windows left are fingerprinted over the benchmark's shingles; other shingles weigh nothing there.
    4. The index cuts 64 bits into one block more than ``radius(similarity)``. Every item of the window's size whose
       fingerprint, plain or weighted, lies within the radius agrees in a block and so becomes a candidate.
    5. The exact similarity over all shingles of the window decides. ``distance`` is the lesser one of the two kinds.

    The radius is that of five standard deviations, so about one in a million windows of exactly ``similarity`` lies
    beyond it, and fewer the more alike they are. Null and empty texts and items match nothing; rows with a null id
    are left out. An item of fewer than ``size`` words is one shingle, which documents can only share if they have no
    other words. Repeated ids count as one row.
    """
    items = benchmark.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), word_array(item_text).alias("words")).dropDuplicates(["item_id"])
    items = items.withColumn("sh", shingle_array(F.col("words"), size)).where("size(sh) > 0").select("item_id", F.size("words").alias("n_words"), "sh")
    places = items.select("item_id", "n_words", F.posexplode("sh").alias("at", "sh"))
    counts = places.groupBy("item_id", "n_words", "sh").agg(F.count("*").alias("n"))
    weights = counts.groupBy("sh").agg((1 / F.count("*")).alias("w"))
    whole = Window.partitionBy("item_id")
    counts = counts.join(weights, "sh").withColumns({"weight": F.sum(F.col("w") * F.col("n")).over(whole), "total": F.sum("n").over(whole)})
    counts = stored(counts, "benchmark-shingles")
    small = (lambda df: F.broadcast(df)) if counts.count() <= BROADCAST_ROWS else (lambda df: df)
    spots = stored(places.select("sh", "n_words", "at").distinct(), "benchmark-spots")
    propose = F.broadcast if spots.count() <= BROADCAST_ROWS else (lambda df: df)
    known = counts.groupBy("sh").agg(F.min("w").alias("w"))

    base = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), shingle_array(word_array(text), size).alias("all"))
    hits = base.select("doc_id", F.size("all").alias("n_all"), F.posexplode("all").alias("at", "sh")).join(small(known), "sh")
    hits = stored(hits.select("doc_id", "n_all", "at", "sh", "w").dropDuplicates(["doc_id", "at"]), "benchmark-hits")

    first = F.greatest(F.col("h.at") - F.col("s.at"), F.lit(0))
    windows = hits.alias("h").join(propose(spots.alias("s")), F.col("h.sh") == F.col("s.sh")).select("doc_id", "n_all", "n_words", first.alias("first_word")).distinct()
    # shingles of the window: those of an item of its size, or fewer where the document ends
    windows = windows.withColumn("n_mine", F.least(F.greatest(F.col("n_words") - (size - 1), F.lit(1)), F.col("n_all") - F.col("first_word")))
    stretches = F.sequence(F.floor(F.col("first_word") / STRETCH), F.floor((F.col("first_word") + F.col("n_mine") - 1) / STRETCH))
    cut = windows.withColumn("stretch", F.explode(stretches)).alias("w")
    spread = hits.withColumn("stretch", F.floor(F.col("at") / STRETCH)).alias("h")
    inside = (F.col("w.doc_id") == F.col("h.doc_id")) & (F.col("w.stretch") == F.col("h.stretch")) & (F.col("h.at") >= F.col("first_word")) & (F.col("h.at") < F.col("first_word") + F.col("n_mine"))
    window = ["doc_id", "first_word", "n_words"]
    bags = cut.join(spread, inside).groupBy("w.doc_id", "first_word", "n_words", "n_mine", "sh").agg(F.count("*").alias("n"), F.first("w").alias("w"))
    over = Window.partitionBy(*window)
    # what an item of this size needs at least: a share of its shingles' number, or of the least weight of any such item
    least = similarity * (1 - 1e-9)
    needs = counts.groupBy("n_words").agg(F.min("total").alias("least_total"), F.min("weight").alias("least_weight"))
    bags = bags.withColumns({"n_known": F.sum("n").over(over), "w_known": F.sum(F.col("n") * F.col("w")).over(over)}).join(small(needs), "n_words")
    bags = bags.where((F.col("n_known") >= F.col("least_total") * least) | (F.col("w_known") >= F.col("least_weight") * least))
    bags = stored(bags.drop("least_total", "least_weight"), "benchmark-windows")

    r = radius(similarity)
    n_prints = counts.select("item_id").distinct().count() * 2 * (r + 1)
    of_items = prints(counts, ["item_id", "n_words"]).withColumn("b", F.explode(hamming_blocks("print", r))).select("item_id", "n_words", "kind", F.col("print").alias("item_print"), "b.block", "b.bits")
    of_windows = stored(prints(bags, window), "benchmark-prints").withColumn("b", F.explode(hamming_blocks("print", r))).select(*window, "kind", "print", "b.block", "b.bits")
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    index = F.broadcast(of_items) if n_prints <= BROADCAST_ROWS else of_items.hint("merge")
    near = of_windows.join(index, ["n_words", "kind", "block", "bits"]).withColumn("distance", apart).where(F.col("distance") <= r)
    near = stored(near.groupBy(*window, "item_id").agg(F.min("distance").alias("distance")), "benchmark-candidates")

    mine = counts.select("item_id", "sh", F.col("n").alias("n_item"), "weight", "total")
    tried = near.join(bags, window).join(small(mine), ["item_id", "sh"], "left")
    shared = F.least("n", F.coalesce("n_item", F.lit(0)))
    scored = tried.groupBy(*window, "item_id", "distance").agg(F.sum(shared).alias("n_both"), F.sum(F.col("w") * shared).alias("both"), F.first("n_mine").alias("n_mine"), F.first("n_known").alias("n_known"), F.first("w_known").alias("w_known"), F.max("weight").alias("weight"), F.max("total").alias("total"))
    scored = scored.withColumn("w_mine", F.col("w_known") + F.col("n_mine") - F.col("n_known"))  # a shingle of no item weighs 1
    found = scored.withColumn("similarity", F.greatest(jaccard("both", "w_mine", "weight"), jaccard("n_both", "n_mine", "total"))).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), (-F.col("distance")).alias("close"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"), (-F.col("b.close")).cast("int").alias("distance"))

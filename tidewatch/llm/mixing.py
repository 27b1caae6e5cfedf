"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.storage import stored

#: Tables of sources up to this many rows are broadcast; more sources are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Fixed value: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than space and tab to carriage return; 0 for null."""
    spaces = r"[\x20\x09-\x0D]+"
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), spaces), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: ``share`` of all words dealt by weight, none above ``most`` times its size.

    Sources take the weights in turn by code point, null last. Resharing the excess until none is above its cap ends
    at one water level: each source gets the lesser of its cap and level times weight. The level follows from running
    sums over the sources by cap per weight, so nothing is iterated; one row for each source takes part.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    level = F.lit(0.0)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("turn", F.col("cap") / F.col("weight"))
    before = Window.orderBy("turn", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", F.when(weight_left > 0, left / weight_left).otherwise(level))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("turn"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))


def blocks(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """Cut each source's documents, shuffled by hash and laid end to end, into blocks of ``block`` words.

    ``docs``: doc_id, source, size. Returns pieces (source, block_no, doc_id, start, words): a document's words from
    ``start`` that lie in the block. The running sums are taken inside hash buckets and then over the bucket totals,
    so that a source with a third of all rows is spread over ``buckets`` groups.
    """
    dealt = docs.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary"))).withColumn("bucket", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bases = sums.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    a, b = placed.alias("a"), bases.alias("b")
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))).select(F.col("a.source").alias("source"), "doc_id", "size", (F.col("before") + F.col("base")).alias("at"))
    width = F.lit(block).cast("long")
    cut = placed.where("size > 0").withColumn("block_no", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    low, high = F.greatest("at", F.col("block_no") * width), F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * width)
    return cut.select("source", "block_no", "doc_id", (low - F.col("at")).alias("start"), (high - low).alias("words"))


def schedule(plan: DataFrame, block: int, chunk: int = 8192) -> DataFrame:
    """Slots of the mix in order: (slot, source, rank), ``rank`` counting the source's slots from 0.

    ``plan``: source, target. Slot i maps the golden-ratio point frac(i * GOLDEN) through the cumulative targets, so
    every stretch of the schedule holds each source in proportion. The targets lie end to end on a line of equal cells,
    about one for each source, and points meet the sources of their cell. Ranks are counted within chunks of slots and
    then over the chunks' totals; no source's slots meet in one task. The plan has one row for each source.
    """
    spark = plan.sparkSession
    some = plan.where("target > 0")
    total, n = some.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    slots, cells = int(-(-total // block)), min(n, 1 << 20) or 1
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))  # one row a source
    edges = some.select("source", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("high"), F.row_number().over(order).alias("turn"))
    edges = edges.select("source", F.lag("high", 1, 0.0).over(order).alias("low"), F.when(F.col("turn") == n, F.lit(float("inf"))).otherwise(F.col("high")).alias("high"))
    cell = lambda x: F.least(F.floor(x / F.lit(max(total, 1.0)) * cells), F.lit(cells - 1))
    edges = edges.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.least("high", F.lit(total))))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN)).alias("x"))
    points = points.select("slot", ((F.col("x") - F.floor("x")) * F.lit(total)).alias("x"), F.expr(f"slot div {chunk}").alias("chunk")).withColumn("cell", cell(F.col("x")))
    met = points.join(F.broadcast(edges) if n <= BROADCAST_SOURCES else edges, "cell").where("x >= low and x < high")
    dealt = met.select("slot", "chunk", "source")
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = dealt.withColumn("own", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    a, b = inside.alias("a"), bases.alias("b")
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk"))).select("slot", F.col("a.source").alias("source"), (F.col("own") + F.col("base")).cast("long").alias("rank"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = 256, bucket_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces in schedule order, and each document's share of it.

    Returns (pieces: slot, source, block_no, doc_id, start, words) and (documents: doc_id, source, size, source_size,
    target, taken). A source's slot of rank r takes its block r modulo its blocks, so every document is taken once
    before any is taken twice, and none more than twice. Null sources are one source; documents without words are
    taken 0 times; an empty table gives empty results. Rows that repeat a doc_id are added up as one document.

    The texts are read once, for their sizes; everything else works on a table of (doc_id, source, size). A source is
    laid out in buckets of about ``bucket_rows`` documents, however many it has.
    """
    each = stored(sized(docs, key, text, source).groupBy("doc_id", "source").agg(F.sum("size").alias("size")), "mix-sizes")
    sizes = each.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = stored(sizes, "mix-sources")
    sources, largest = sizes.agg(F.count("*"), F.max("n")).first()
    small = F.broadcast if sources <= BROADCAST_SOURCES else (lambda df: df)
    plan = stored(targets(sizes.select("source", "source_size")), "mix-plan")
    cut = blocks(each, block, max(64, -(-(largest or 0) // bucket_rows)))
    slots = schedule(plan, block)
    last = sizes.select(F.col("source").alias("s"), F.expr(f"(source_size + {block - 1}) div {block}").alias("n"))
    turns = slots.join(small(last), slots.source.eqNullSafe(last.s)).where(F.col("rank") < 2 * F.col("n")).select("slot", "source", (F.col("rank") % F.col("n")).alias("block_no"))
    a, b = turns.alias("a"), cut.alias("b")
    pieces = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block_no") == F.col("b.block_no"))).select("slot", F.col("a.source").alias("source"), F.col("a.block_no").alias("block_no"), "doc_id", "start", "words")
    taken = pieces.groupBy("doc_id", "source").agg(F.sum("words").alias("taken"))
    p, d, t = plan.alias("p"), each.alias("d"), taken.alias("t")
    shares = d.join(small(p), F.col("d.source").eqNullSafe(F.col("p.source"))).join(t, F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    return pieces, shares.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))

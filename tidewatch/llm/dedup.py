"""MinHash near-duplicates: banding, signature verification, exact confirmation, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidewatch.llm.arrow import append_columns
from tidewatch.llm.bytesops import BASE, U64, chunks, mix, shingles, signed, text_bytes
from tidewatch.llm.components import connected_components
from tidewatch.llm.storage import stored

BANDS, ROWS = 24, 4
#: Coefficients of the universal hash functions h(x) = a x + b modulo 2**64, from a rule; the a are odd.
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(BASE)) | U64(1)
SHIFTS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=U64) * U64(BASE))
SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` with the shingle set's size, a 128-bit digest of the set, its minima and their band keys."""

    def compute(batch):
        data, offsets = text_bytes(batch.column(text))
        n = len(offsets) - 1
        count, digests, minima = np.zeros(n, np.int64), np.zeros((2, n), U64), np.zeros((n, BANDS * ROWS), np.uint32)
        for low, high in chunks(offsets, 1 << 18):
            row, hashes = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
            if not len(row):
                continue
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            own = low + row[heads]
            count[own] = np.diff(np.r_[heads, len(row)])
            digests[0, own] = np.add.reduceat(hashes, heads)
            digests[1, own] = np.add.reduceat(mix(hashes), heads)
            for i, (a, b) in enumerate(zip(FACTORS, SHIFTS)):
                minima[own, i] = np.minimum.reduceat(hashes * a + b, heads) >> U64(32)
        keys = np.zeros((n, BANDS), U64)
        for j in range(ROWS):
            keys = keys * U64(BASE) + minima[:, j::ROWS]
        keys = mix(keys + np.arange(BANDS, dtype=U64) * U64(0xD1B54A32D192ED03))
        bands = pa.ListArray.from_arrays(pa.array(np.where(count > 0, BANDS, 0).cumsum() - np.where(count > 0, BANDS, 0), pa.int32()).to_pylist() + [int((count > 0).sum() * BANDS)], pa.array(signed(keys[count > 0].ravel())))
        raw = minima.tobytes()
        width = BANDS * ROWS * 4
        return {"n_shingles": count, "d1": signed(digests[0]), "d2": signed(digests[1]), "sig": pa.array([raw[i : i + width] for i in range(0, n * width, width)], pa.binary()), "bands": bands}

    return append_columns(docs, compute, list(SIGNED.fields), drop=(text,))


#: Minima of the second, finer signature, of which one byte each is kept.
FINE = 640
FINE_FACTORS = mix(np.arange(2001, FINE + 2001, dtype=U64) * U64(BASE)) | U64(1)
FINE_SHIFTS = mix(np.arange(3001, FINE + 3001, dtype=U64) * U64(BASE))


def fine_signatures(texts: DataFrame, size: int) -> DataFrame:
    """(id, sig) with one byte of each of many minima: the b-bit signatures of Li and Koenig (2010)."""

    def compute(batch):
        data, offsets = text_bytes(batch.column("t"))
        out = np.zeros((batch.num_rows, FINE), np.uint8)
        for low, high in chunks(offsets, 1 << 18):
            row, hashes = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
            if len(row):
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for i, (a, b) in enumerate(zip(FINE_FACTORS, FINE_SHIFTS)):
                    out[low + row[heads], i] = mix(np.minimum.reduceat(hashes * a + b, heads)) >> U64(56)
        raw = out.tobytes()
        return {"sig": pa.array([raw[i : i + FINE] for i in range(0, len(raw), FINE)], pa.binary())}

    return append_columns(texts.select("id", "t"), compute, [T.StructField("sig", T.BinaryType())], drop=("t",))


def agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Share of equal minima of pairs of signatures."""
    left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(len(x), -1) for x in (a, b))
    return (left == right).mean(1)


def promising(edges: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``least`` of the minima."""
    both = edges.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(agreement(batch.column("sa"), batch.column("sb")) >= least)).select(["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def confirmed(edges: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets satisfy 100 * intersection >= percent * union."""
    both = edges.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def keep(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            (da, oa), (db, ob) = text_bytes(batch.column("ta")), text_bytes(batch.column("tb"))
            good = np.zeros(n, bool)
            for low, high in chunks(oa + ob, 1 << 20):
                ra, ha = shingles(da[oa[low] : oa[high]], oa[low : high + 1] - oa[low], size)
                rb, hb = shingles(db[ob[low] : ob[high]], ob[low : high + 1] - ob[low], size)
                row, h = np.r_[ra, rb], np.r_[ha, hb]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
                both = np.bincount(row[1:][same], minlength=high - low)
                union = np.bincount(row, minlength=high - low) - both
                good[low:high] = (100 * both >= percent * union) & (union > 0)
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(keep, "a long, b long")


def across(members: DataFrame, sigs: DataFrame, least: float, nearest: bool = False, block: int = 256) -> DataFrame:
    """Pairs (a, b, ca, cb, likeness) of one bucket but different components whose signatures agree enough.

    With ``nearest`` only each member's likeliest partner in its block: a first step towards components, not the whole.

    A bucket's largest component needs no comparison with itself. So its members meet only those outside, and those
    outside meet each other: a bucket of very many copies and few others costs their product, not the square. Both
    sides are cut into blocks, and each pair of blocks is one row; a pair of texts is made only if its signatures agree,
    less the share of bytes that agree by chance.
    """
    parts = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", F.col("c").alias("top"))).alias("m"), F.sum("n").alias("total"))
    parts = parts.select("key", "m.top", F.ceil(F.col("m.n") / block).cast("int").alias("inner"), F.ceil((F.col("total") - F.col("m.n")) / block).cast("int").alias("outer"))
    dealt = members.join(parts, "key").join(sigs, "id").withColumn("inside", F.col("c") == F.col("top"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = F.when(F.col("inside"), F.transform(upto("outer"), lambda o: F.struct(F.lit(0).alias("kind"), F.col("own").alias("i"), o.alias("j"))))
    met = met.otherwise(F.concat(F.transform(upto("inner"), lambda o: F.struct(F.lit(0).alias("kind"), o.alias("i"), F.col("own").alias("j"))), F.transform(upto("outer"), lambda o: F.struct(F.lit(1).alias("kind"), F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))))
    dealt = dealt.where("outer > 0").withColumn("p", F.explode(met))
    packs = dealt.groupBy("key", "p.kind", "p.i", "p.j").agg(F.collect_list(F.struct("id", "c", "sig", "bands", "own", "inside")).alias("m"))

    def compare(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            lists, (keys, kinds, first, second) = batch.column("m"), (batch.column(c).to_pylist() for c in ("key", "kind", "i", "j"))
            for r in range(batch.num_rows):
                m = lists[r].values
                ids, comp, own, inside = (m.field(x).to_numpy(zero_copy_only=False) for x in ("id", "c", "own", "inside"))
                sig = np.frombuffer(b"".join(m.field("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
                bands = m.field("bands").flatten().to_numpy().reshape(len(ids), BANDS)
                left, right = np.flatnonzero((own == first[r]) & (inside == (kinds[r] == 0))), np.flatnonzero((own == second[r]) & ~inside)
                for at in range(0, len(left), 32):
                    some = left[at : at + 32]
                    alike = ((sig[some][:, None, :] == sig[right][None, :, :]).mean(2) - 1 / 256) / (1 - 1 / 256)
                    alike = np.where(comp[some][:, None] != comp[right][None, :], alike, -1)
                    if nearest and alike.size:
                        alike = np.where(np.arange(len(right)) == alike.argmax(1)[:, None], alike, -1)
                    x, y = np.nonzero(alike >= least)
                    a, b = some[x], right[y]
                    shared = bands[a] == bands[b]  # of the buckets that both are in only the first one reports them
                    once = bands[a, shared.argmax(1)] == keys[r]
                    x, y, a, b = x[once], y[once], a[once], b[once]
                    turn = ids[a] > ids[b]
                    a, b = np.where(turn, b, a), np.where(turn, a, b)
                    for col, v in zip(out, (ids[a], ids[b], comp[a], comp[b], alike[x, y])):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_pydict({n: np.concatenate(v) for n, v in zip(("a", "b", "ca", "cb", "likeness"), out)})

    return packs.select("key", "kind", "i", "j", "m").mapInArrow(compare, "a long, b long, ca long, cb long, likeness double").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = 5, margin: float = 0.14) -> DataFrame:
    """(key, n_shingles, component_id, kept): groups of documents linked by 100 * intersection >= percent * union.

    1. Equal shingle sets form one class, known by a 128-bit digest; only its smallest id goes on, so exact copies
       never meet in a bucket.
    2. Buckets hold the classes that agree in all minima of a band. Each bucket links its members to its hub, the member
       that shares most buckets: the middle of a group of copies. Pairs with too unlike signatures (``margin`` is about
       four standard deviations) are dropped, the others confirmed on the full sets.
    3. What is left of a bucket in more than one component is compared block by block, on finer signatures within four
       standard deviations: at first only each member with its likeliest partner elsewhere, which joins most of a group,
       then all pairs that remain between components, confirmed in rounds from the likeliest pair of each two
       components on, until no promising pair is left unconfirmed between components. So no pair is skipped but those
       of one component, and no cap is set on partners.

    A pair of 85 percent shares no band once in 10**8 cases, of 80 percent once in 300,000. ``component_id`` is the
    smallest id that links reach. Null and empty texts, and texts of white space, have 0 shingles and are linked with
    nothing. Rows with a null id are linked with nothing and kept, with a null component. A repeated row is its own copy.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    signs = stored(signatures(base, "t", size), "minhash")
    some = signs.where("n_shingles > 0 and id is not null")
    classes = stored(some.groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    reps = signs.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    banded = reps.select("id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(sizes, "key"), "buckets")
    weight = members.groupBy("id").agg(F.sum("n").alias("w"))
    sigs = stored(signs.join(weight, "id").select("id", "sig", "w").dropDuplicates(["id"]), "signatures")
    texts = stored(base.join(weight.select("id"), "id", "left_semi").dropDuplicates(["id"]), "candidates")
    hubs = members.join(sigs.select("id", "w"), "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("h")).select("key", (-F.col("h.m")).alias("hub"))
    spokes = members.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    least = percent / 100 - margin
    tried = stored(promising(spokes, sigs, least), "spokes")
    links = stored(confirmed(tried, texts, percent, size), "links")

    def placed(links):
        found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        return found.select(F.col("node").alias("id"), F.col("component").alias("c"))

    def unsettled(comps):
        """The buckets that still hold more than one component."""
        own = members.join(comps, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
        mixed = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        return stored(own.join(mixed, "key", "left_semi"), "mixed-buckets")

    comps = placed(links)
    rest = unsettled(comps)
    fine = fine_signatures(texts.join(rest.select("id").distinct(), "id", "left_semi"), size)
    fine = stored(fine.join(reps.select("id", "bands"), "id"), "fine-signatures")
    near = percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / FINE) ** 0.5
    for _ in range(3):
        best = stored(across(rest, fine, near, nearest=True).join(tried, ["a", "b"], "left_anti").select("a", "b").distinct(), "nearest")
        fresh = stored(confirmed(best, texts, percent, size), "links")
        tried, found, made = tried.unionByName(best), best.count(), fresh.count()
        if made:
            links = links.unionByName(fresh)
            comps = placed(links)
            rest = unsettled(comps)
        if made * 20 < found:  # hardly anything is left to join
            break
    open_pairs = stored(across(rest, fine, near).join(tried, ["a", "b"], "left_anti").select("a", "b", "likeness"), "pairs")
    batch = 16
    while True:
        ca, cb = comps.select(F.col("id").alias("a"), F.col("c").alias("ca")), comps.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        now = open_pairs.join(ca, "a", "left").join(cb, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")
        w = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.desc("likeness"), "a", "b")
        ranked = stored(now.withColumn("r", F.row_number().over(w)).select("a", "b", "likeness", "r"), "ranked")
        if ranked.isEmpty():
            break
        fresh = stored(confirmed(ranked.where(F.col("r") <= batch).select("a", "b"), texts, percent, size), "links")
        open_pairs = ranked.where(F.col("r") > batch).select("a", "b", "likeness")
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            comps = placed(links)
        batch *= 8

    out = signs.select(F.col("id"), "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"], "left")
    out = out.join(comps.select(F.col("id").alias("rep"), "c"), "rep", "left")
    out = out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("c", "rep", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))

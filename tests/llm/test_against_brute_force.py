"""Each operator against a plain version on the smallest tables, or an exact round trip."""

import collections
import hashlib
import re

import numpy as np
import pytest

from tidewatch.llm import queries as Q
from tidewatch.llm import repeats


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_language(spark, sf_dir, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    rows = Q.op1_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and len(next(d["text"] for d in docs if d["doc_id"] == r.doc_id)) > 100]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_minhash(spark, sf_dir, docs):
    sets = {d["doc_id"]: shingle_set(d["text"]) for d in docs}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(ids, pairs)
    got = {r.doc_id: r for r in Q.op2_minhash_dedup(spark, sf_dir).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_decontamination(spark, sf_dir, docs):
    from tidewatch.llm.decontaminate import contaminated

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    bags = {r.item_id: collections.Counter(shingle_list(words(r.text))) for r in items}
    holders = collections.Counter(s for b in bags.values() for s in b)
    weight = lambda s: 1 / holders[s] if s in holders else 1.0
    want = {}
    for d in docs:
        w = words(d["text"])
        for r in items:
            n = len(words(r.text))
            if not n:
                continue
            best = 0
            for i in range(max(1, len(w) - n + 1)):
                bag = collections.Counter(shingle_list(w[i : i + n]))
                if not (bag & bags[r.item_id]):
                    continue
                both = sum(weight(s) * c for s, c in (bag & bags[r.item_id]).items())
                best = max(best, both / sum(weight(s) * c for s, c in (bag | bags[r.item_id]).items()))
            if best >= 0.8:
                want[d["doc_id"], r.item_id] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def shingle_list(words, size=5):
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def test_tokens(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d["doc_id"]: len(t.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs}
    for r in Q.op4_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 512)


def test_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    v = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows}
    label = {r.vec_id: r.label for r in rows}
    ids = sorted(v)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if label[a] == label[b] and v[a] @ v[b] >= 0.98]
    links = collections.Counter(x for p in pairs for x in p)
    want = components(ids, pairs)
    got = {r.vec_id: r for r in Q.op5_embedding_dedup(spark, sf_dir).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: links[i] for i in ids}


def test_chats(spark, sf_dir):
    chats = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        chats[r.conv_id].append((r.turn, r.role, r.text or ""))
    for c, t, role, text in Q.CONTROL_TURNS:
        chats[c].append((t, role, text))
    got = {r.conv_id: r for r in Q.op6_chat_format(spark, sf_dir).collect()}
    assert got.keys() == chats.keys()
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize(("query", "column"), [(Q.op7_toxicity, "toxic"), (Q.op9_quality, "quality")])
def test_classifiers_on_held_out_rows(spark, query, column):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right >= 0.95 * len(rows)


def test_mixing(spark, sf_dir, docs):
    sizes = collections.Counter()
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    for d in docs:
        sizes[d["source"]] += size[d["doc_id"]]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    source = {d["doc_id"]: d["source"] for d in docs}
    rows = Q.op8_mixing(spark, sf_dir).collect()
    again = Q.op8_mixing(spark, sf_dir).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    took = collections.Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * target[s] + 1e-6
        assert 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
    assert all(abs(took[s] - target[s]) <= 3 * 256 + 0.02 * target[s] for s in sizes)


def test_repeats(spark, sf_dir, docs):
    raw = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    want = repeats.brute_force(raw)
    for r in Q.op10_repeats(spark, sf_dir).collect():
        gone = want[r.doc_id]
        kept = np.frombuffer(raw[r.doc_id], np.uint8)[~gone].tobytes()
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else r.n_spans == 0


def test_decontamination_far_fingerprints(spark):
    """Items of ten shingles whose last three words differ: similarity 7/13, at any distance up to the radius."""
    from tidewatch.llm.decontaminate import contaminated, radius

    words = [[f"w{k}x{i}" for i in range(14)] for k in range(200)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join([*w[:11], "other", f"e{k}", f"f{k}"])) for k, w in enumerate(words)], "doc_id long, text string")
    rows = contaminated(docs, bench, similarity=0.5).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(k, k) for k in range(200)]
    assert all(abs(r.similarity - 7 / 13) < 1e-9 for r in rows) and 15 < max(r.distance for r in rows) <= radius(0.5)


def test_hamming_blocks(spark):
    """Fingerprints that differ in any bits up to the radius agree in a block; the blocks hold all bits once."""
    from pyspark.sql import functions as F

    from tidewatch.llm.decontaminate import hamming_blocks

    rng = np.random.default_rng(5)
    for r in (0, 7, 24, 63):
        a = rng.integers(-(2**63), 2**63 - 1, 200)
        flips = [sum(1 << int(i) for i in rng.choice(64, min(r, 64), replace=False)) for _ in a]
        rows = [(int(x), int(np.uint64(x.astype(np.uint64) ^ np.uint64(f)).astype(np.int64))) for x, f in zip(a, flips)]
        df = spark.createDataFrame(rows, "a long, b long").select(hamming_blocks("a", r).alias("x"), hamming_blocks("b", r).alias("y"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"))
        for x in df.collect():
            assert x.d == r and len(x.x) == r + 1 and any(u.bits == v.bits for u, v in zip(x.x, x.y))
        widths = [64 * (i + 1) // (r + 1) - 64 * i // (r + 1) for i in range(r + 1)]
        for (v, _), x in zip(rows, df.collect()):
            at, whole = 0, 0
            for u, w in zip(x.x, widths):
                whole |= (u.bits & ((1 << 64) - 1)) << at
                at += w
            assert whole == v & ((1 << 64) - 1)


def test_decontamination_repeated_and_templated_items(spark):
    """Edited copies of items that others repeat or share a template with, by the plain or the weighted similarity."""
    from tidewatch.llm.decontaminate import contaminated

    run = lambda name, n: [f"{name}{i}" for i in range(n)]
    edited = lambda w, at: [*w[:at], "changed", *w[at + 1 :]]
    long, form = run("a", 59), run("t", 40)
    items = dict(enumerate([long] * 10 + [form + run(f"own{k}x", 19) for k in range(5)] + [run("s", 59)] * 2))
    texts = [edited(long, 30), run("p", 20) + edited(long, 10) + run("q", 20), edited(items[10], 50), edited(items[11], 20), form + run("z", 19), edited(items[15], 30), long, edited(edited(long, 10), 40), edited(edited(edited(long, 10), 40), 25)]
    bags = {k: collections.Counter(shingle_list(w)) for k, w in items.items()}
    holders = collections.Counter(s for b in bags.values() for s in b)
    want = {}
    for d, w in enumerate(texts):
        for k, b in bags.items():
            for i in range(max(1, len(w) - len(items[k]) + 1)):
                bag = collections.Counter(shingle_list(w[i : i + len(items[k])]))
                likeness = lambda g: sum(g(s) * c for s, c in (bag & b).items()) / sum(g(s) * c for s, c in (bag | b).items())
                best = max(likeness(lambda s: 1), likeness(lambda s: 1 / holders.get(s, 1)))
                if best >= 0.8:
                    want[d, k] = max(best, want.get((d, k), 0))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, bench).collect()}
    assert {d for d, _ in want} >= {0, 1, 2, 3, 5, 6} and not {d for d, _ in want} & {4, 8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_run_index():
    """Strings of small alphabets, repeated within and across each other, streamed in stretches of any length."""
    rng = np.random.default_rng(1)
    for _ in range(150):
        length, strings = int(rng.integers(1, 9)), []
        for _ in range(int(rng.integers(1, 12))):
            x = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 80))).astype(np.uint8)
            if strings and rng.random() < 0.5:
                x = np.r_[x, strings[int(rng.integers(len(strings)))][:30]]
            strings.append(np.tile(x[:2], 50) if rng.random() < 0.1 else x)
        data, offsets = np.concatenate(strings), np.r_[0, np.cumsum([len(x) for x in strings])]
        later, first = repeats.RunIndex(data, offsets, stride=int(rng.integers(1, 40))).earlier(length)
        seen, want = set(), ([], [])
        for a, b in zip(offsets, offsets[1:]):
            for i in range(a, b - length + 1):
                want[bytes(data[i : i + length]) not in seen].append(i)
                seen.add(bytes(data[i : i + length]))
        assert (later.tolist(), first.tolist()) == want


def test_repeats_with_crowded_keys(spark):
    """A passage in most documents, its keys dealt over many small shards: every byte as by the definition."""
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = letters(300)
    texts = {i: letters(int(rng.integers(0, 150))) + (passage if i % 3 else letters(200)) + letters(int(rng.integers(0, 150))) + (passage[50:250] if i % 5 == 0 else "") for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    want = repeats.brute_force({i: t.encode() for i, t in texts.items()})
    got = {r.doc_id: r.edges for r in repeats.repeated_spans(df, crowd=16, shard_bytes=4096).collect()}
    for i, t in texts.items():
        assert np.array_equal(want[i], repeats.covered(got.get(i, []), len(t)))


def test_prefix_counts():
    """Counts of all prefixes and the longest fitting one, as the library encodes each prefix anew."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewatch.llm.tokens import PrefixCounter

    path, pick = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    library, own = Tokenizer.from_file(path), PrefixCounter(path)
    atoms = ["'ll", "'re", "'s", "'", "<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", " ", "\x1c", "\x1f", "\x85", "word", "don't", "Über", "é", "日本語", "😀", "12", "...", "!!", "<", "|", ">", "ll", "I'", "\r\n", "endoftext", "　", "x'"]
    for _ in range(3000):
        x = "".join(pick.choice(atoms) for _ in range(pick.randint(0, 9)))
        want = [len(library.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        assert own.prefixes(x).tolist() == want, x
        for budget in (0, 1, 3, 7):
            assert own.truncated(x, budget) == max(i for i, n in enumerate(want) if n <= budget), (x, budget)


def test_mixing_many_sources(spark):
    """Shares of many small sources, joined by cells, stay near their targets."""
    from tidewatch.llm import mixing

    df = spark.range(6000).selectExpr("id as doc_id", "concat('s', id % 300) as source", "repeat('word ', cast(200 + id % 97 as int)) as text")
    rows = mixing.mix(df)[1].collect()
    took, target = collections.Counter(), {}
    for r in rows:
        took[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == 6000 and all(r.taken <= 2 * r.size for r in rows) and all(abs(took[s] - target[s]) <= 3 * 256 + 0.02 * target[s] for s in target)


def test_vectors_audited(spark):
    """Vectors without any link, over several shards and blocks: the audit tells the recall of nearest neighbours."""
    from tidewatch.llm import vectors

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (2500, 16))
    df = spark.createDataFrame([(i, v.tolist(), "a" if i % 3 else "b") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    rows = vectors.near_vectors(df, shard_rows=500, block_rows=300, beam=16, audited=True).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.array([[(i % 3 > 0) == (j % 3 > 0) and i != j for j in range(len(x))] for i in range(len(x))]) & (u @ u.T >= 0.98)
    assert len(rows) == 2500 and all(0.9 <= r.audited_recall <= 1 for r in rows)
    assert {r.vec_id: r.n_links for r in rows} == dict(enumerate(near.sum(1).tolist()))


def test_language_by_plain_partial_matching(spark):
    """Code lengths of short texts against a dictionary version of method C, for more languages than one table holds."""
    import math

    from tidewatch.llm import language
    from tidewatch.llm.bytesops import text_bytes

    rng = np.random.default_rng(8)
    names = [f"l{i:02d}" for i in range(10)]
    letters = {x: rng.choice(26, 9, replace=False) + 97 for x in names}
    write = lambda x, n: "".join(map(chr, rng.choice(letters[x], n)))
    rows = [(i, write(x, 60), x) for i, x in enumerate(names * 4)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    order = model.order
    counts = {x: collections.Counter() for x in names}
    for _, t, x in rows:
        data = [10] * order + [ord(c) for c in t.lower()]
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[x][tuple(data[i - k : i]), data[i]] += 1
    below = {x: collections.defaultdict(dict) for x in names}
    for x in names:
        for (context, symbol), n in counts[x].items():
            below[x][context][symbol] = n

    def bits(x, context, symbol):
        own = below[x].get(context, {})
        total, distinct = sum(own.values()), len(own)
        if symbol in own:
            return -math.log2(own[symbol] / (total + distinct))
        escape = -math.log2(distinct / (total + distinct)) if total else 0.0
        return escape + (bits(x, context[1:], symbol) if context else 8.0)

    import pyarrow as pa

    texts = [write(x, 25) for x in names] + ["Zebra 12", "é"]
    got = model.score(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        data = [10] * order + [b + 32 if 65 <= b <= 90 else b for b in t.encode()]
        for j, x in enumerate(model.languages):
            want = sum(bits(x, tuple(data[at - order : at]), data[at]) for at in range(order, len(data)))
            assert abs(got[i, j] - want) < 1e-6, (t, x)


def test_quality_by_plain_discriminant(spark, sf_dir):
    """Scores against numpy's own inverse and determinant of the shrunk covariances."""
    from tidewatch.llm import quality
    from tidewatch.llm.bytesops import text_bytes
    import pyarrow as pa

    docs, labels = Q.examples(spark, sf_dir, "quality", 4, 2)
    model = quality.fit(docs, labels)
    y = {r.doc_id: r.label for r in labels.collect() if r.label is not None}
    rows = docs.collect()
    x = quality.statistics(*text_bytes(pa.array([r.text for r in rows])))
    own = np.array([y.get(r.doc_id, -1) if r.text is not None else -1 for r in rows])
    everything = x[own >= 0]
    k = x.shape[1]
    pooled = np.cov(everything.T, bias=True) + 1e-3 * np.eye(k)
    density = []
    for c in (0, 1):
        part = x[own == c]
        cov = np.cov(part.T, bias=True) if len(part) > k else pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov))
        cov = 0.95 * cov + 0.05 * pooled + 1e-3 * np.eye(k)
        mean = part.mean(0)
        prior = np.log((sum(v == c for v in y.values()) + 1) / (len(y) + 2))
        density.append([-0.5 * ((v - mean) @ np.linalg.inv(cov) @ (v - mean) + np.linalg.slogdet(cov)[1]) + prior for v in x])
    want = 1 / (1 + np.exp(-np.clip(np.array(density[1]) - np.array(density[0]), -40, 40)))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all(abs(got[r.doc_id] - w) < 1e-6 for r, w in zip(rows, want))


def test_pipeline_stages_by_plain_versions(spark, sf_dir):
    """Each stage's rows against a plain version on what the stage before kept, with short and foreign texts planted."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from tidewatch.llm.decontaminate import contaminated

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = [(900_001, "Нет ничего невозможного для человека с умом и сердцем, говорили они", None, "web", 60), (900_002, "%% 12 ..", "en", "web", 8), (900_003, docs.where("lang = 'en'").select(F.substring("text", 1, 80)).first()[0], "en", "web", 80)]
    now = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    stages = dict(corpus_pipeline.STAGES)

    def run(name, table):
        out = stages[name](spark, table, sf_dir)
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), {r.doc_id: r for r in rows}

    before = {r.doc_id: r for r in now.collect()}
    now, kept = run("language_id", now)
    gone = before.keys() - kept.keys()
    assert {900_001, 900_002} <= gone and 900_003 in kept
    assert all(i > 900_000 or not re.search(r"[^\W\d_]", before[i].text or "") for i in gone)

    before = kept
    now, kept = run("minhash_dedup", now)
    sets = {i: shingle_set(r.text) for i, r in before.items()}
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert kept.keys() == {i for i, c in components(ids, pairs).items() if i == c}
    assert all(kept[i] == before[i] for i in kept)

    before = kept
    now, kept = run("repeat_removal", now)
    raw = {i: (r.text or "").encode() for i, r in before.items()}
    want = {i: np.frombuffer(raw[i], np.uint8)[~cut].tobytes().decode("utf-8", "ignore") for i, cut in repeats.brute_force(raw).items()}
    assert {i: r.text or "" for i, r in kept.items()} == {i: t for i, t in want.items() if t or not raw[i]}
    assert all(r.n_chars == len(r.text) for i, r in kept.items() if r.text is not None and r.text != before[i].text)

    before = kept
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r.doc_id for r in contaminated(now, items).collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    texts = [plain(r.text) for r in items.collect() if plain(r.text)]
    exact = {i for i, r in before.items() if any(f" {t} " in f" {plain(r.text)} " for t in texts if len(t.split()) >= 5)}
    now, kept = run("decontamination", now)
    assert kept.keys() == before.keys() - leaks and exact <= leaks

    before = kept
    now, kept = run("mixing", now)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in before.items()}
    assert all(kept[i].size == size[i] and 0 < kept[i].taken <= 2 * size[i] for i in kept)
    took = collections.Counter()
    for r in kept.values():
        took[r.source] += r.taken
    assert all(abs(took[r.source] - r.target) <= 3 * 256 + 0.02 * r.target for r in kept.values())

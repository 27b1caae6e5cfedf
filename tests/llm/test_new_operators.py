"""Token alignment, vector codes and exact top-k: plain versions, hot groups and odd rows."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import align, codes, queries as Q, topk

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    """Per text (n_a, n_b, groups text, links) by bytes and dictionaries."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    out = []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            out.append((0, 0, "", []))
            continue
        ends_a, ends_b = np.cumsum([len(s) for s in xs]).tolist(), np.cumsum([len(s) for s in ys]).tolist()
        of_a, of_b = dict(zip(ends_a, x)), dict(zip(ends_b, y))
        groups, links, begin = [], [], 0
        for end in sorted(of_a.keys() & of_b.keys()):
            inside = lambda ends, ids: ",".join(str(i) for e, i in zip(ends, ids) if begin < e <= end)
            groups.append(inside(ends_a, x) + "|" + inside(ends_b, y))
            links.append((of_a[end], of_b[end]))
            begin = end
        out.append((len(x), len(y), ";".join(groups), links))
    return out


def check_alignment(rows, texts):
    """``rows``: results in the texts' order."""
    want = plain_alignment(texts)
    count = collections.Counter(x for *_, links in want for x in links)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for r, (n_a, n_b, groups, links) in zip(rows, want, strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, len(links), len(links))
        assert r.n_best == sum(count[x] == most[x[1]] for x in links)
        assert r.count_sum == sum(count[x] for x in links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_alignment_of_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(Q.op11_token_alignment(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(texts)
    check_alignment(rows, [texts[r.doc_id] for r in rows])


ODD = [None, "", " ", "a", "▁under", "\x00\r\n\t  x  ", "<|endoftext|> and </s> <s><unk>", "naïve — 漢字 🙂🙂", "word " * 3000, "ab" * 5000, "same text", "same text", "   wide"]


def test_alignment_of_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_best", "'x' as row", "'y' as key")
    rows = sorted(align.aligned(df, A, B).collect(), key=lambda r: r.doc_id)
    check_alignment(rows, ODD)


def test_alignment_of_random_texts(spark):
    rng = np.random.default_rng(8)
    letters = list(" \n\t'sdtlre.!?a1９▁é漢🙂\u00a0\u2003<>/|")
    texts = ["".join(rng.choice(letters, rng.integers(1, 25))) for _ in range(3000)] + ["  two  ", "end ", "\u3000x", "a" * 500 + " " + "b c" * 90]
    own = align.sides(A, B)
    rows, (k, a, b, m) = align.links(own, texts)
    for (n_a, n_b, n_groups, groups), (w_a, w_b, written, links) in zip(rows, plain_alignment(texts), strict=True):
        assert (n_a, n_b, groups.decode(), n_groups) == (w_a, w_b, written, len(links))
    assert m.sum() == sum(r[2] for r in rows) and len(set(zip(k.tolist(), a.tolist(), b.tolist()))) == len(k)


def test_byte_level_ids_are_the_library_s():
    """Every token's own bytes merge to it, and all characters are cut alike: what the fast merging rests on."""
    from tidewatch.llm.tokens import PrefixCounter

    own, counter = align.sides(A, B).a, PrefixCounter(A)
    assert own.fast is not None and all(counter.merged(x) == [x] for x in counter.vocabulary)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2{chr(c)} !{chr(c)}{chr(c)} {chr(c)}'s" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    rng = np.random.default_rng(2)
    texts += ["".join(rng.choice(list("ab '\n"), 60)) for _ in range(3000)] + ["a" * 3000, "ab" * 2000, " " * 500]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == own.own.encode(" " + t, add_special_tokens=False).ids


def test_alignment_groups_are_spread_and_counted_once(spark, monkeypatch):
    """One id in most links of most documents goes to several tasks; its counts stay those of all documents."""
    monkeypatch.setattr(align, "POSTINGS", 50)
    texts = ["word word"] * 150 + [f"word {i} tail" for i in range(60)] + ["other, text."]
    load = {5: 1000, 6: 30, 7: 10}
    first, number, slots = align.homes(load, 10, 8)
    assert len(set(slots[first[5] : first[5] + number[5]].tolist())) == 8 and number[9] == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sorted(align.aligned(df, A, B).collect(), key=lambda r: r.doc_id)
    check_alignment(rows, texts)


def test_alignment_of_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "two"), (1, None)], "doc_id long, text string")
    rows = align.aligned(df, A, B, whole=True).collect()
    assert {r.groups for r in rows if r.doc_id == 1} == {"", plain_alignment(["one text"])[0][2]}
    assert collections.Counter((r.doc_id, r.n_links > 0) for r in rows) == {(1, True): 2, (None, True): 1, (1, False): 1}
    assert align.aligned(df.limit(0), A, B).count() == 0


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """{id: (code, error)} and the digest, one by one."""
    x = {i: [int(np.floor(4096 * float(c))) for c in v] for i, v in sorted(vectors.items())}
    w = len(next(iter(x.values()))) // parts
    cut = {i: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for i, v in x.items()}
    books = [[cut[i][p] for i in list(cut)[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in cut.values():
                own[near(p, v[p])[1]].append(v[p])
            new.append([tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if own[k] else e for k, e in enumerate(books[p])])
        books = new
    done = {i: [near(p, v[p]) for p in range(parts)] for i, v in cut.items()}
    text = ",".join(str(c) for b in books for e in b for c in e)
    return {i: ("".join(f"{k:02x}" for _, k in v), sum(f for f, _ in v)) for i, v in done.items()}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("kind", ["ties", "few", "equal", "negative"])
def test_codes(spark, kind):
    rng = np.random.default_rng(3)
    n = 9 if kind == "few" else 300
    x = rng.integers(-2, 3, (n, 16)) / 4096 * 3 if kind == "ties" else np.full((n, 16), -0.3) if kind == "equal" else rng.normal(-1 if kind == "negative" else 0, 1, (n, 16))
    df = spark.createDataFrame([(i * 7 % 1000, v.tolist(), i % 3 or None) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(5)
    coded, books = codes.vector_codes(df)
    want, digest = plain_codes({i * 7 % 1000: v for i, v in enumerate(x)})
    rows = coded.collect()
    assert {r.vec_id: (r.code, r.error) for r in rows} == want and codes.digest(books) == digest
    label = {i * 7 % 1000: i % 3 or None for i in range(n)}
    total = collections.Counter()
    for i, (_, e) in want.items():
        total[label[i]] += e
    assert all(r.label_error == total[label[r.vec_id]] for r in rows)


def test_tree_equals_full_scan():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 16, 200):
        entries, points = rng.integers(-3, 4, (n, 4)), rng.integers(-4, 5, (500, 4))
        far = ((points[:, None] - entries[None]) ** 2).sum(2)
        who, best = codes.KdTree(entries).nearest(points)
        assert (who == far.argmin(1)).all() and (best == far.min(1)).all()


ODD_VECTORS = [
    (1, [0.5] * 8, 1), (2, None, 1), (3, [], 1), (4, [float("nan")] + [0.0] * 7, 1), (5, [float("inf")] + [0.0] * 7, None), (6, [None] + [0.0] * 7, 2),
    (7, [1.0] * 16, 1), (8, [1e30] * 8, 1), (9, [0.0] * 8, None), (9, [0.25] * 8, None), (None, [0.1] * 8, 2), (100, [-0.5] * 8, 2), (100, [-0.5] * 8, 2), (200, [1.0] * 16, 2), (300, None, 2),
]


def odd(spark):
    return spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<double>, label int").selectExpr("*", "'z' as code", "1 as d", "2 as n2", "3 as rank", "4 as score")


def test_codes_of_odd_vectors(spark):
    coded, books = codes.vector_codes(odd(spark))
    assert sorted(r.vec_id or 0 for r in coded.collect()) == [0, 1, 9, 9, 100, 100] and len(books) == 8 and books[0].shape == (5, 1)
    none, empty = codes.vector_codes(odd(spark).where("vec_id = 2"))
    assert none.count() == 0 and empty == [] and none.columns == ["vec_id", "code", "error", "label_error"]


def plain_top(rows, queries, k):
    x = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows]
    out = []
    for q, v in queries:
        v = [int(np.floor(1024 * c)) for c in v]
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in x if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "lengths", "copies", "ties", "few"])
def test_top_products(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "SHARD_BYTES", 1 << 12)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(11)
    n = 6 if kind == "few" else 1200
    x = rng.normal(0, 1, (n, 12)) @ np.diag(0.7 ** np.arange(12))
    if kind == "lengths":
        x *= rng.lognormal(0, 2, (n, 1))
    if kind == "copies":
        x[::3] = x[0]
    if kind == "ties":
        x = rng.integers(-1, 2, (n, 12)) / 1024
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    step = 3 if kind == "few" else 50
    got = topk.largest_products(df, df.where(f"vec_id % {step} = 0")).collect()
    assert sorted(map(tuple, got)) == plain_top(list(enumerate(x)), [(i, x[i]) for i in range(0, n, step)], 10)


def test_top_products_of_odd_vectors(spark):
    df = odd(spark)
    got = topk.largest_products(df, df.where("vec_id % 100 = 0")).collect()
    sound = [(i, v) for i, v, _ in ODD_VECTORS if i in (1, 7, 9, 100, 200)]
    assert sorted(map(tuple, got)) == plain_top(sound, [(100, [-0.5] * 8), (200, [1.0] * 16)], 10)
    assert topk.largest_products(df.limit(0), df.limit(0)).count() == 0
    assert topk.largest_products(df.where("vec_id = 2"), df.where("vec_id = 2")).count() == 0

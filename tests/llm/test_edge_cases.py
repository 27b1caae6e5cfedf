"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import chat, decontaminate, dedup, language, mixing, quality, repeats, tokens, toxicity, vectors

VOCABULARY = __import__("public_tokenizers").path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of the long text" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", None, 57),
    (3, None, None, "a", None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", None, "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (7, "Der schnelle Fuchs springt nicht über den faulen Hund", "de", None, 53),
    (None, "a row without an id", "en", "c", 19),
    (None, None, None, None, None),
    (8, "%%% 123 !!!", "de", "c", 11),
    (9, "one two", "en", "c", 7),
    (10, "ONE two", "en", "c", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["lang_pred", "score", "kept", "n_tokens", "_letters", "n_removed", "_edges", "component_id", "size", "taken", "clause_weight"]
    return spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(docs, empty):
    model = language.train(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert [by[i].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4 and by[3].score == 0
    assert by[1].lang_pred == "en" and by[7].lang_pred == "de" and by[1].source == "a"
    none = language.train(empty)
    assert language.identify(empty, none).count() == 0
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_near_duplicates(docs, empty):
    rows = dedup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and dedup.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[2].component_id == 1 and not by[2].kept and by[10].component_id == 9
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[5].component_id == 5
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_near_duplicates_chain(spark):
    """A chain is one component though its ends are unlike; a crowd of mutual near copies is, too."""
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[k * 8 : k * 8 + 120]) for k in range(6)]
    crowd = [" ".join([*(f"c{i}" for i in range(150)), *(f"t{k}x{j}" for j in range(6))]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate([*chain, *crowd])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(df, percent=80).collect()}
    assert {got[i] for i in range(6)} == {0} and {got[i] for i in range(6, 46)} == {6}


def test_decontamination(docs, empty, spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "one two"), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (9, 4), (10, 4)}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = tokens.count_tokens(docs, VOCABULARY).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(t.encode(x[1] or "", add_special_tokens=False).ids) for x in ROWS)
    assert tokens.count_tokens(empty, VOCABULARY).count() == 0
    short = docs.where("length(text) < 100 or text is null")
    for r in tokens.prefix_tables(short, VOCABULARY).withColumn("fit", tokens.fitting_prefix(budget=3)).collect():
        x = r.text or ""
        assert list(r.prefix_tokens) == [len(t.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        assert r.fit == max(i for i, n in enumerate(r.prefix_tokens) if n <= 3)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.001], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, 0.0], None), (10, [1.0, None], 0), (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (12, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and got[None] == (None, None, True)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_crowded(spark):
    """A crowd larger than any beam, over several shards: counts stay exact."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.vstack([np.eye(8)[0] + rng.normal(0, 0.02, (300, 8)), rng.normal(0, 1, (300, 8))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, shard_rows=200, block_rows=64, beam=16).collect()}
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[i] <= near[i] for i in got)


def test_chats(spark):
    records = [
        '{"messages": [{"role": "user", "content": "hi <|end|>\\\\ </s>"}, {"role": "assistant", "content": null}]}', '{"prompt": "p", "response": "r"}', '{"instruction": "do", "input": "", "output": "done"}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"messages": []}', '{"other": 1}', None,
    ]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "id long, json string, layout string").withColumn("record", F.parse_json("json"))
    out = chat.format_chats(chat.canonical_turns(df)).withColumn("back", chat.read_back()).withColumn("loss", chat.read_loss())
    got = {r.id: r for r in out.orderBy("id").collect()}
    assert [got[i].layout for i in range(7)] == ["messages", "prompt_response", "instruction", "conversations", "messages", None, None]
    assert [tuple(t) for t in got[0].back] == [("user", "hi <|end|>\\ </s>"), ("assistant", "")]
    assert [tuple(t) for t in got[2].back] == [("user", "do"), ("assistant", "done")] and got[3].loss == "a"
    assert got[4].formatted == "" and got[5].formatted is None
    rows = spark.createDataFrame([(1, 1, None, "b"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    back = chat.format_chats(chat.canonical_turns(chat.gathered(rows))).select("conv_id", chat.read_back().alias("b")).collect()
    assert {r.conv_id: [tuple(t) for t in r.b] for r in back} == {1: [("user", ""), ("user", ""), ("", "b")], None: [("user", "x")]}
    assert chat.format_chats(chat.canonical_turns(chat.gathered(rows.where("false")))).count() == 0


def test_classifiers(docs, empty, spark):
    labels = spark.createDataFrame([(1, 0), (6, 1), (7, 0), (9, None), (None, 1), (99, 1)], "doc_id long, label int")
    for made, score in ((toxicity.learn(docs, labels), toxicity.score_toxicity), (quality.fit(docs, labels), quality.score_quality)):
        rows = score(docs, made).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    for made, score in ((toxicity.learn(empty, labels.where("false")), toxicity.score_toxicity), (quality.fit(empty, labels.where("false")), quality.score_quality)):
        assert len(score(docs, made).collect()) == len(ROWS) and score(empty, made).count() == 0


def test_grammar():
    g = toxicity.Grammar({"idiot": 3.0}, {"moro": 2.0})
    assert g.total("you idiot") > g.total("idiot") > g.total("he said idiot") > g.total("not an idiot") > g.total("nobody here") == 0
    assert g.total("morons") == 2.0 and g.total("i will kill you") == toxicity.THREAT and g.total("i will not kill you") == 0


def test_toxicity_beside_marks(spark):
    """Whatever the grammar weighs passes the filter before it, with any sign beside the word."""
    from tidewatch.llm.bytesops import text_bytes

    g = toxicity.Grammar({"idiot": 3.0, "дурак": 2.5, "crétin": 2.0}, {"moro": 2.0})
    around = ["{}", "“{}”", "…{}", "{}—really", "'{}'", "''{}''", "{}' 'x", "\u00a0{}\u00a0", "\U0001f600{}\U0001f600", "、{}。", "‘{}’", "«{}»", "été…{}", "7{}7", "({})"]
    texts = [a.format(w) for a in around for w in ("idiot", "дурак", "crétin", "morons")] + [f"i will …{w}— you" for w in toxicity.ATTACKS]
    clean = ["", None, "'", "'" * 4, "“no”", "x'idiot", "idiots", "idiotё", "éidiot", "𐐀idiot", "niemals", "été—hiver"]
    assert all(g.total(x) > 0 for x in texts) and all(g.total(x or "") == 0 for x in clean)
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r.doc_id: r.clause_weight for r in toxicity.score_toxicity(df, g).collect()}
    assert [got[i] for i in range(len(got))] == [g.total((x or "").lower()) for x in texts + clean]
    column = df.coalesce(1).orderBy("doc_id").toArrow()["text"]
    assert list(g.suspects(*text_bytes(column))) == [True] * len(texts) + [False] * len(clean)


def test_toxicity_lexicon_without_quotes(spark):
    """Quoted and unquoted uses of a word are evidence of one word."""
    rows = [(i, f"a{i}b 'scum' c{i}d".translate({48 + k: 103 + k for k in range(10)}), 1) for i in range(12)] + [(100 + i, f"fine{chr(97 + i)} words here", 0) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert "scum" in toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "label"), least=1.0).insults


def test_mixing(docs, empty):
    pieces, shares = mixing.mix(docs)
    rows = {(r.doc_id, r.source): r for r in shares.collect()}
    assert rows[3, "a"].size == 0 and rows[3, "a"].taken == 0 and rows[2, None].source_size > 0
    assert all(r.taken <= 2 * r.size for r in rows.values()) and pieces.count() > 0
    assert mixing.mix(empty)[1].count() == 0 and mixing.mix(empty)[0].count() == 0


def test_repeats(docs, empty, spark):
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS) and repeats.remove_repeats(empty).count() == 0
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 6)
    long = next(r for r in rows if r.doc_id == 6)
    gone = repeats.brute_force({6: LONG.encode()})[6]
    assert (long.n_removed, len(long.kept)) == (int(gone.sum()), int((~gone).sum()))


def test_pipeline_on_odd_tables(spark, docs, empty, sf_dir):
    for table, least in ((docs.select("doc_id", "text", "lang", "source", "n_chars", "kept"), 1), (empty, 0)):
        now = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, now, sf_dir)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == now.columns
            now = spark.createDataFrame(after.collect(), after.schema)
        assert now.count() >= least


def test_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(0 < r.taken <= 2 * r.size for r in rows)


def test_across_blocks(spark):
    """A bucket of one large component and some others in blocks: the same pairs as by comparing all members."""
    import numpy as np

    rng = np.random.default_rng(6)
    n = 90
    comp = [0 if i < 60 else (1000 if i < 70 else 2000 + i) for i in range(n)]
    near = rng.integers(0, 256, dedup.FINE).astype(np.uint8)
    sig = [np.where(rng.random(dedup.FINE) < rng.uniform(0, 0.5), rng.integers(0, 256, dedup.FINE), near).astype(np.uint8) for _ in range(n)]
    bands = [[7] + [100 * b + i for b in range(1, dedup.BANDS)] for i in range(n)]
    members = spark.createDataFrame([(7, i, comp[i]) for i in range(n)], "key long, id long, c long")
    sigs = spark.createDataFrame([(i, bytes(sig[i]), bands[i]) for i in range(n)], "id long, sig binary, bands array<long>")
    alike = lambda a, b: ((sig[a] == sig[b]).mean() - 1 / 256) / (1 - 1 / 256)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if comp[a] != comp[b] and alike(a, b) >= 0.6}
    got = [(r.a, r.b) for r in dedup.across(members, sigs, 0.6, block=16).collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_composed_transducers():
    """The composed table against a plain reading of clauses, on random sequences of words and marks."""
    import random

    g = toxicity.Grammar({"idiot": 3.0, "said": 1.0, "you": 0.5}, {"moro": 2.0})
    pick = random.Random(9)
    words = ["idiot", "morons", "you", "they", "will", "kill", "hurt", "said", "not", "never", "tree", "house", "“", "”", '"', ".", "!", "\n", ";"]
    for _ in range(3000):
        tokens = [pick.choice(words) for _ in range(pick.randint(0, 25))]
        want, quoted = dict.fromkeys(toxicity.KINDS, 0.0), False
        clause: list[str] = []
        for t in [*tokens, "."]:
            if t not in ".!\n;":
                clause.append(t)
                continue
            targeted = any(w in toxicity.TARGETS for w in clause)
            intent = any(w in toxicity.INTENTS for w in clause)
            left, said, attack = 0, False, False
            for w in clause:
                if w in toxicity.QUOTES:
                    quoted = not quoted
                    continue
                said = said or w in toxicity.REPORTS
                attack = attack or (w in toxicity.ATTACKS and not left)
                kind = "negated" if left else "reported" if said or quoted else "targeted" if targeted else "plain"
                want[kind] += g.weight(w)
                left = 3 if w in toxicity.NEGATIONS else max(0, left - 1)
            want["threat"] += targeted and intent and attack
            clause = []
        assert g.features(" ".join(tokens)) == pytest.approx(list(want.values())), tokens


def test_vectors_ask_near_cells(spark):
    """Links over the borders of cells are found from one side, and a vector asks few cells; a crowd fills several shards."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (2400, 64))
    twins = x[:400] + rng.normal(0, 0.1, (400, 64))
    crowd = x[0] + rng.normal(0, 0.05, (500, 64))
    x = np.vstack([x, twins, crowd])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df, shard_rows=200, block_rows=64).collect()}
    assert {i: r.n_links for i, r in got.items()} == dict(enumerate(near.tolist()))
    assert {r.component_id for i, r in got.items() if i == 0 or i >= 2800} == {0} and all(got[2400 + i].component_id == i for i in range(1, 400))
    cells = vectors.Cells(vectors.diverse(u[:100], 40))
    reach = 0.2 * vectors.DEVIATIONS / 8
    home, asked = cells.of(u, reach)
    assert asked.sum(1).mean() < 5 and len(cells.pivots) == 40
    partner = np.arange(2400, 2800)
    assert ((home[:400] == home[partner]) | asked[np.arange(400), home[partner]] | asked[partner, home[:400]]).all()
    n = len(cells.pivots)
    pairs = vectors.asks(np.arange(n), n)
    assert (pairs ^ pairs.T | np.eye(n, dtype=bool)).all()


def test_vectors_of_few_dimensions(spark):
    """Each label audits its own cells: where vectors fill three of 64 dimensions, more cells are asked, whatever a crowd elsewhere meets."""
    import numpy as np

    rng = np.random.default_rng(6)
    narrow = rng.normal(0, 1, (1500, 3)) @ np.linalg.qr(rng.normal(0, 1, (64, 3)))[0].T
    crowd = np.eye(64)[1] + rng.normal(0, 0.005, (600, 64))
    x, label = np.vstack([narrow, crowd]), np.repeat([0, 1], [1500, 600])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ((u @ u.T >= 0.98) & (label[:, None] == label)).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, shard_rows=150, block_rows=64).collect()}
    assert sum(got[i] for i in range(1500)) >= 0.999 * near[:1500].sum() and all(got[i] <= near[i] for i in got) and all(got[i] == near[i] for i in range(1500, 2100))

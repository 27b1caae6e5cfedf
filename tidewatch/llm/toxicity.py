"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read a clause word by word: negation, reported speech, target, threat and insult. The first four are
small tables, composed once into one table; the insult transducer is the learned lexicon, whose weights run into the
composed machine's registers.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm.arrow import append_columns, examples
from tidewatch.llm.bytesops import chunks, span_hashes, sums_to, text_bytes
from tidewatch.llm.storage import stored

#: The closed word classes of the grammar.
NEGATIONS = "not no never none without isn't aren't wasn't don't nicht kein keine nie niemals pas jamais sans nunca jamás tampoco sin".split()
REPORTS = "said says wrote writes claimed claims quoted quotes reported allegedly sagte sagt schrieb behauptet zitiert dit disait écrit prétend dijo dice escribió afirma".split()
TARGETS = "you your yours yourself he she they him her them his their du dich dir dein ihr euch er sie ihn ihnen tu te toi ton vous votre il elle ils elles tú ti usted vosotros él ella ellos".split()
INTENTS = "will gonna shall going must werde wirst werden vais va vas voy vamos".split()
ATTACKS = "kill hurt destroy beat punch stab shoot strangle murder töten umbringen schlagen verletzen tuer frapper détruire matar golpear herir destruir".split()
#: Kinds of weight that a clause can leave, with the weights that learning starts from.
KINDS = ("plain", "targeted", "negated", "reported", "threat")
THREAT = 4.0
FACTORS = {"plain": 1.0, "targeted": 1.15, "negated": 0.4, "reported": 0.6, "threat": THREAT}
#: Input symbols of the machines: classes of words, quotation marks and the end of a clause.
SYMBOLS = ("other", "target", "intent", "attack", "report", "negation", "quote", "end")
OTHER, TARGET, INTENT, ATTACK, REPORT, NEGATION, QUOTE, END = range(len(SYMBOLS))
#: Words for which a negation stays open.
REACH = 3

APOSTROPHE = 0x27
QUOTES = frozenset("\"“”«»„")
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = True
LETTER[APOSTROPHE] = True
#: Words are letters and the apostrophes between them; those around a word are quotation.
TOKEN = regex.compile(r"\p{L}(?:[\p{L}']*\p{L})?|[.!?;:\n]+|[\"“”«»„]")


@dataclass
class Grammar:
    """Insult arcs with learned weights, and the learned weight of each kind. Bounded by the lexicon's size."""

    insults: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))

    def __post_init__(self):
        self.stems = sorted({len(x) for x in self.prefixes})
        seeds = [*self.insults, *ATTACKS]
        spans = [x.encode() for x in seeds]
        self.word_keys = np.unique(_keys(spans))
        self.stem_keys = {n: np.unique(_keys([x.encode() for x in self.prefixes if len(x.encode()) == n])) for n in {len(x.encode()) for x in self.prefixes}}

    def weight(self, word: str) -> float:
        """The insult transducer: the whole word's arc, else the longest stem's."""
        w = self.insults.get(word)
        if w is not None:
            return w
        for n in reversed(self.stems):
            if len(word) > n and (w := self.prefixes.get(word[:n])) is not None:
                return w
        return 0.0

    def features(self, text: str) -> list[float]:
        """Run the composed machine: the insults' weights by kind, summed over all clauses, and the number of threats."""
        state, out = START, [0.0] * len(KINDS)
        plain = 0.0  # insults of the clause that are neither negated nor reported: targeted or not at its end
        for token in TOKEN.findall(text):
            first = token[0]
            if first.isalpha():
                at = state * len(SYMBOLS) + CLASSES.get(token, OTHER)
                if w := self.weight(token):
                    kind = MODES[at]
                    if kind:
                        out[kind] += w
                    else:
                        plain += w
            else:
                at = state * len(SYMBOLS) + (QUOTE if first in QUOTES else END)
                if at % len(SYMBOLS) == END:
                    out[MODES[at]] += plain
                    out[4] += THREATS[at]
                    plain = 0.0
            state = NEXT[at]
        at = state * len(SYMBOLS) + END
        out[MODES[at]] += plain
        out[4] += THREATS[at]
        return out

    def total(self, text: str) -> float:
        """The text's weight: what its clauses leave, each kind by its learned weight."""
        return sum(self.factors[k] * x for k, x in zip(KINDS, self.features(text)))

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + total))))

    def suspects(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold a word or stem of the lexicon, or an attack word: a lossless filter before the grammar."""
        out = np.zeros(len(offsets) - 1, bool)
        for low, high in chunks(offsets):
            part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            letter = np.zeros(len(part) + 2, bool)
            letter[1:-1] = word_bytes(part)
            edge = np.zeros(len(part) + 1, bool)
            edge[own] = True
            edge[-1] = True
            starts = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
            ends = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
            starts, ends = bare(part, starts, ends)
            if not len(starts):
                continue
            hit = _known(span_hashes(part, starts, ends), self.word_keys)
            for n, keys in self.stem_keys.items():
                some = np.flatnonzero(ends - starts > n)
                hit[some] |= _known(span_hashes(part, starts[some], starts[some] + n), keys)
            rows = np.searchsorted(own, starts[hit], "right") - 1
            out[low + np.unique(rows)] = True
        return out


CLASSES = {w: k for k, ws in ((TARGET, TARGETS), (INTENT, INTENTS), (ATTACK, ATTACKS), (REPORT, REPORTS), (NEGATION, NEGATIONS)) for w in ws}


@dataclass(frozen=True)
class Machine:
    """A transducer: for each state and symbol the next state, the symbol passed on, and the marks left."""

    step: tuple[tuple[int, ...], ...]
    passed: tuple[tuple[int, ...], ...]
    marks: tuple[tuple[frozenset, ...], ...]


def machine(states: int, step, passed=lambda s, x: x, marks=lambda s, x: ()) -> Machine:
    table = lambda f: tuple(tuple(f(s, x) for x in range(len(SYMBOLS))) for s in range(states))
    return Machine(table(step), table(passed), table(lambda s, x: frozenset(marks(s, x))))


def negation() -> Machine:
    """State: words for which a negation stays open. A negated attack is passed on as another word."""
    step = lambda s, x: REACH if x == NEGATION else 0 if x == END else s if x == QUOTE else max(s - 1, 0)
    return machine(REACH + 1, step, lambda s, x: OTHER if x == ATTACK and s else x, lambda s, x: ["negated"] if s else [])


def reporting() -> Machine:
    """States: speech reported in this clause (1), inside quotation marks (2). Quotations outlast clauses."""
    step = lambda s, x: s | 1 if x == REPORT else s ^ 2 if x == QUOTE else s & 2 if x == END else s
    return machine(4, step, marks=lambda s, x: ["reported"] if s or x == REPORT else [])


def targeting() -> Machine:
    """State: whether the clause has a target; left as a mark at its end."""
    return machine(2, lambda s, x: 0 if x == END else s | (x == TARGET), marks=lambda s, x: ["targeted"] if x == END and s else [])


def threatening() -> Machine:
    """States: target (1), intent (2) and attack (4) seen in the clause; all of them are a threat at its end."""
    seen = {TARGET: 1, INTENT: 2, ATTACK: 4}
    return machine(8, lambda s, x: 0 if x == END else s | seen.get(x, 0), marks=lambda s, x: ["threat"] if x == END and s == 7 else [])


def composed(machines: list[Machine]) -> tuple[list[int], list[int], list[int], int]:
    """The machines run one behind the other as one table, over the states that can be reached.

    Returns, for each state and symbol, the next state, the kind that an insult's weight goes to, and whether a threat
    ends there; and the start.
    """
    start = (0,) * len(machines)
    place, todo, following, modes, threats = {start: 0}, [start], [], [], []
    for state in todo:
        for symbol in range(len(SYMBOLS)):
            marks, after, x = set(), [], symbol
            for m, s in zip(machines, state):
                marks |= m.marks[s][x]
                after.append(m.step[s][x])
                x = m.passed[s][x]
            after = tuple(after)
            if after not in place:
                place[after] = len(place)
                todo.append(after)
            following.append(place[after])
            word = "negated" if "negated" in marks else "reported" if "reported" in marks else "plain"
            modes.append(KINDS.index("targeted" if "targeted" in marks else "plain") if symbol == END else KINDS.index(word))
            threats.append(int("threat" in marks))
    return following, modes, threats, place[start]


NEXT, MODES, THREATS, START = composed([negation(), reporting(), targeting(), threatening()])


@functools.cache
def code_letters() -> np.ndarray:
    """Whether each code point is a letter to TOKEN."""
    out = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):  # without surrogates
        for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(low, high)))):
            out[low + m.start() : low + m.end()] = True
    return out


def word_bytes(part: np.ndarray) -> np.ndarray:
    """Whether each byte of a UTF-8 text is an apostrophe or part of a letter of TOKEN."""
    out = LETTER[part]
    lead = np.flatnonzero(part >= 0xC0)
    if not len(lead):
        return out
    follow = 1 + (part[lead] >= 0xE0) + (part[lead] >= 0xF0)
    code = part[lead].astype(np.int64) & (0x3F >> follow)
    for i in (1, 2, 3):
        more = np.flatnonzero(follow >= i)
        code[more] = code[more] << 6 | part[np.minimum(lead[more] + i, len(part) - 1)] & 0x3F
    known = code_letters()[np.minimum(code, 0x10FFFF)]
    for i in (0, 1, 2, 3):
        out[np.minimum(lead[known & (follow >= i)] + i, len(part) - 1)] = True
    return out


def bare(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without the apostrophes around them; those of apostrophes alone go."""
    around = np.flatnonzero((part[starts] == APOSTROPHE) | (part[ends - 1] == APOSTROPHE))
    if not len(around):
        return starts, ends
    solid = np.flatnonzero(part != APOSTROPHE)
    first, after = np.searchsorted(solid, starts[around]), np.searchsorted(solid, ends[around])
    some = first < after
    starts, ends, keep = starts.copy(), ends.copy(), np.ones(len(starts), bool)
    keep[around[~some]] = False
    starts[around[some]], ends[around[some]] = solid[first[some]], solid[after[some] - 1] + 1
    return starts[keep], ends[keep]


def _keys(spans: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = sums_to(np.array([len(x) for x in spans], np.int64))
    return span_hashes(data, ends[:-1], ends[1:])


def _known(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return keys[at] == hashes


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = 5_000, arcs: int = 4_000, least: float = math.log(12)) -> Grammar:
    """Learn the insult arcs and the weights of the kinds from labelled texts.

    Fits on about ``sample_rows`` whole texts of each label, chosen by the hash of ``key`` before any text is read, so
    the chosen labels are few whatever the input and are broadcast to the scan. A word's evidence is the number of
    distinct neighbourhoods (the words beside it) in which it stands in texts of one label only, so copies of a text
    count once. Arcs need log-odds of at least ``least``; at most ``arcs`` are kept, the best supported first. Rows
    with a null text or label are no examples. Without examples the grammar knows threats only.
    """
    rows, _, share = examples(docs, labels, text, label, key, sample_rows)
    chosen = stored(rows.select(F.lower("text").alias("text"), "y"), "toxicity-sample")
    spots = (
        chosen.select("y", F.transform(F.split("text", r"[^\p{L}']+"), lambda x: F.btrim(x, F.lit("'"))).alias("w"))
        .select("y", F.explode(F.expr("transform(w, (x, i) -> struct(x as word, xxhash64(get(w, i - 1), x, get(w, i + 1)) as spot))")).alias("s"))
        .select("y", "s.word", "s.spot")
        .where("length(word) >= 2")
        .groupBy("word", "spot")
        .agg(F.max("y").alias("y"), F.min("y").alias("least_y"))
        .where("y = least_y")
    )
    words = stored(spots.groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")), "toxicity-words")
    bad, good = (x or 0 for x in words.agg(F.sum("bad"), F.sum("good")).first())
    offset = math.log((bad + 1) / (good + 1))

    def arcs_of(df, col):
        odds = F.log(F.col("bad") + 0.5) - F.log(F.col("good") + 0.5) - offset
        best = df.where("bad >= 4").withColumn("w", odds).where(F.col("w") >= least).orderBy(F.desc(F.col("w") * F.sqrt("bad")), col).limit(arcs)
        return {r[col]: float(r["w"]) for r in best.collect()}

    insults = arcs_of(words, "word")
    stems = words.select("bad", "good", F.explode(F.expr("transform(filter(sequence(4, 7), n -> length(word) > n), n -> substring(word, 1, n))")).alias("stem"))
    prefixes = arcs_of(stems.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "stem")
    return weighed(Grammar(insults, prefixes), chosen, {y: 1 / x for y, x in share.items() if x})


def weighed(grammar: Grammar, sample: DataFrame, weight: dict[int, float]) -> Grammar:
    """Learn the bias and the weight of each kind: ridge logistic regression on the sample's features.

    The ridge pulls towards half of FACTORS, so a kind without examples keeps its place among the others; no weight
    falls below 0. ``weight``: how many labelled rows each sampled row of a label stands for. The features of a bounded
    sample come to the driver, equal ones counted once.
    """
    names = list(KINDS)
    values = [F.round(F.least(F.get("features", F.lit(i)), F.lit(30.0)), 1).alias(k) for i, k in enumerate(names)]
    bins = matched(sample, grammar, features=True).select("y", *values).groupBy("y", *names).agg(F.count("*").alias("n")).toPandas()
    if not len(bins) or bins.y.nunique() < 2:
        return grammar
    bins = bins.sort_values(["y", *names])  # sums do not depend on the order of rows
    x, y, n = np.column_stack([np.ones(len(bins)), bins[names].to_numpy(float)]), bins.y.to_numpy(float), bins.n.to_numpy(float)
    n = n * np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0))
    start = b = np.array([np.log((n[y == 1].sum() + 1) / (n[y == 0].sum() + 1)) - 1.0, *(0.5 * FACTORS[k] for k in names)])
    for _ in range(200):  # Newton steps of bounded length towards the ridge optimum, so separable samples end too
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (n * (y - p)) - (b - start)
        hess = x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(b))
        move = np.linalg.solve(hess, grad)
        b = b + move * min(1.0, 0.5 / max(np.abs(move).max(), 1e-12))
    grammar.bias, grammar.factors = float(b[0]), {k: float(max(w, 0.0)) for k, w in zip(names, b[1:])}
    return grammar


def matched(docs: DataFrame, grammar: Grammar, text: str = "text", features: bool = False) -> DataFrame:
    """``docs`` (lower-case texts) with ``clause_weight``, what the clauses leave in total, and ``toxicity``.

    With ``features`` there is ``features`` instead: what they leave of each kind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by the number of arcs

    def compute(batch):
        own = shared.value
        column = batch.column(text)
        data, offsets = text_bytes(column)
        some = np.flatnonzero(own.suspects(data, offsets))
        if features:
            each = [[0.0] * len(KINDS)] * len(column)
            for i in some:
                each[i] = own.features(column[int(i)].as_py())
            return {"features": each}
        out = np.zeros(len(column))
        for i in some:
            out[i] = own.total(column[int(i)].as_py())
        return {"clause_weight": out, "toxicity": [own.score(x) for x in out]}

    fields = [T.StructField("features", T.ArrayType(T.DoubleType()))] if features else [T.StructField("clause_weight", T.DoubleType()), T.StructField("toxicity", T.DoubleType())]
    return append_columns(docs, compute, fields)


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``clause_weight`` of every whole text.

    Null and empty texts hold no clause and get the score of weight 0. Equal texts get equal scores. Columns of these
    names (and of ``toxicity`` and ``_lower``) are replaced; all others pass through.
    """
    ready = docs.withColumn("_lower", F.coalesce(F.lower(text), F.lit("")))
    return matched(ready, grammar, "_lower").drop("_lower", "score").withColumnRenamed("toxicity", "score")

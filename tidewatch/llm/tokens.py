"""Exact token counts of byte-level BPE at every prefix, by dynamic programming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm.arrow import append_columns

#: Fixed value: how the byte-level tokenizer cuts texts before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Characters that the pattern takes for white space.
WHITE = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\p{White_Space}", c))
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Maps a piece of text to its number of tokens; a missing piece is counted by its prefix table.

    The encoding of a prefix ends in exactly one token: the one whose bytes end the prefix and that merging leaves
    beside the last token of the prefix before it. So the last token and the count of each prefix follow from
    shorter prefixes, and no prefix is encoded anew.
    """

    def __init__(self, path: str, room: int = 400_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_letters()
        as_bytes = lambda token: bytes(back[c] for c in token)
        self.room = room
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        added = set(self.special)
        self.vocabulary = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.vocabulary))
        self.stays: dict[tuple[bytes, bytes], bool] = {}
        self.find, self.scan = regex.compile(PIECES).findall, regex.compile(PIECES).finditer
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def merged(self, data: bytes) -> list[bytes]:
        """BPE of a short string by its definition: the best-ranked pair first, leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [self.ranks.get(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = self.ranks.get((parts[i], parts[i + 1]), NEVER)
        return parts

    def beside(self, left: bytes, right: bytes) -> bool:
        """Whether merging the joined bytes gives these two tokens again."""
        known = self.stays.get((left, right))
        if known is None:
            if len(self.stays) > 4 * self.room:
                self.stays.clear()
            known = self.stays[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def table(self, piece: bytes) -> list[int]:
        """The exact token count of every prefix of one piece, from the empty one on."""
        count, last, whole, stays, longest = [0], [b""], self.vocabulary, self.stays, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in whole:
                    known = stays.get((last[start], token))
                    if known or known is None and self.beside(last[start], token):
                        count.append(count[start] + 1)
                        last.append(token)
                        break
        return count

    def __missing__(self, piece: str) -> int:
        if len(self) > self.room:
            self.clear()
        n = self[piece] = self.table(piece.encode())[-1]
        return n

    def parts(self, text: str) -> list[str]:
        return self.split(text) if self.split else [text]

    def count(self, text: str) -> int:
        """Tokens of the whole text; a special token's string is one token, as the library has it by default."""
        if self.split and any(x in text for x in self.special):
            return sum(1 if x in self.special else sum(map(self.__getitem__, self.find(x))) for x in self.parts(text))
        return sum(map(self.__getitem__, self.find(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of all code-point prefixes of the text, from the empty one on.

        A cut special string is plain text that continues the text before it.
        """
        out, base = [0], 0
        parts = [x for x in self.parts(text) if x]
        for i, part in enumerate(parts):
            if part in self.special:
                if not i or parts[i - 1] in self.special:
                    out += [base + n for n in self.plain_prefixes(part[:-1])]
                base += 1
                out.append(base)
                continue
            cut = parts[i + 1][:-1] if i + 1 < len(parts) else ""
            own = [base + n for n in self.plain_prefixes(part + cut)]
            out += own
            base = own[len(part) - 1]
        return np.array(out, np.int32)

    def plain_prefixes(self, text: str) -> list[int]:
        """Counts of all prefixes but the empty one of a text without special strings."""
        out, base = [], 0
        for unit in units(self.find(text)):
            own, base = self.cuts(unit, base)
            out += own
        return out

    def cuts(self, unit: list[str], base: int) -> tuple[list[int], int]:
        """Counts at the code points of a unit, after ``base`` tokens, and the count after the whole unit.

        A cut run of white space is one piece, whatever follows it; a cut contraction falls apart.
        """
        out, white = [], "".join(unit[:-1])
        last = unit[-1]
        if white:
            lead = last if not last.strip(WHITE) else last[: len(last) - len(last.lstrip(WHITE))]
            run = white + lead
            out += self.ends(run, base)
            base += sum(map(self.__getitem__, unit[:-1]))
            if lead != last:
                out += self.ends(last, base)[len(lead) :]
        elif last[:1] == "'" and last[1:].isalpha():
            out += [base + sum(map(self.__getitem__, self.find(last[:j]))) for j in range(1, len(last) + 1)]
        else:
            out += self.ends(last, base)
        return out, base + self[last]

    def ends(self, piece: str, base: int) -> list[int]:
        """Counts at the code points of one piece, after ``base`` tokens."""
        table, at, out = self.table(piece.encode()), 0, []
        for c in piece:
            at += len(c.encode())
            out.append(base + table[at])
        return out

    def truncated(self, text: str, budget: int) -> int:
        """The most code points whose encoding has at most ``budget`` tokens.

        No prefix that ends in a unit has fewer tokens than the units before it, so only the last unit that begins
        within the budget is cut; what follows it is not looked at.
        """
        base, start, best = 0, 0, 0
        parts = [x for x in self.parts(text) if x]
        for i, part in enumerate(parts):
            if part in self.special:
                if not i or parts[i - 1] in self.special:
                    best = max([best, *(start + j + 1 for j, n in enumerate(self.plain_prefixes(part[:-1])) if base + n <= budget)])
                base, start = base + 1, start + len(part)
                best = start if base <= budget else best
            else:
                cut = parts[i + 1][:-1] if i + 1 < len(parts) else ""
                at, now = start, base
                for unit in units(m[0] for m in self.scan(part + cut)):
                    after = now + sum(map(self.__getitem__, unit))
                    if after <= budget and unit[-1].strip(WHITE):  # ends within the budget, so no shorter prefix counts
                        at, now = at + sum(map(len, unit)), after
                        best = at
                        continue
                    own, after = self.cuts(unit, now)
                    best = max([best, *(at + j + 1 for j, n in enumerate(own) if n <= budget)])
                    at, now = at + len(own), after
                    if now > budget:
                        break
                if now > budget and at <= start + len(part):
                    return best
                base, start = base + sum(map(self.__getitem__, self.find(part))), start + len(part)
            if base > budget:
                return best
        return best


def units(pieces) -> Iterator[list[str]]:
    """Pieces that a cut may join: runs of white space with the piece that begins with their last character."""
    held: list[str] = []
    for piece in pieces:
        if not piece.strip(WHITE):
            held.append(piece)
        elif held and piece[0] in WHITE:
            yield [*held, piece]
            held = []
        else:
            if held:
                yield held
                held = []
            yield [piece]
    if held:
        yield held


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary file and worker process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit and fitting_chars of every whole text.

    ``fitting_chars``: the most code points whose encoding has at most ``limit`` tokens, from the counts of prefixes.
    ``vocabulary``: path of a byte-level BPE file of the ``tokenizers`` library, present on every executor. Null
    counts as an empty text: 0 bytes, 0 tokens, not over the limit, 0 fitting. Columns of these names are replaced;
    others pass.
    """

    def compute(batch):
        own = counter(vocabulary)
        texts = batch.column(text).to_pylist()
        n = [own.count(t) if t else 0 for t in texts]
        fits = [len(t or "") if x <= limit else own.truncated(t, limit) for t, x in zip(texts, n)]
        return {"n_tokens": n, "over_limit": [x > limit for x in n], "fitting_chars": fits}

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fitting_chars", T.LongType())]
    ready = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return append_columns(ready, compute, fields)


def prefix_tables(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``prefix_tokens``: the exact token count of each code-point prefix, from the empty one on.

    With it truncation and budget questions are array look-ups. Null and empty texts have the table [0].
    """

    def compute(batch):
        own = counter(vocabulary)
        return {"prefix_tokens": [own.prefixes(t or "").tolist() for t in batch.column(text).to_pylist()]}

    return append_columns(docs, compute, [T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])


def fitting_prefix(table: str = "prefix_tokens", budget: int = 512):
    """How many code points fit in ``budget`` tokens, as a column over a prefix table."""
    return F.array_max(F.transform(F.col(table), lambda n, i: F.when(n <= budget, i).otherwise(F.lit(0))))

"""Text normalisation of reports: addresses, descriptions, keywords, digests."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F, types as T

#: Address abbreviations and what they stand for; those of the first table may end in a point.
ABBREVIATIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square",
    "n": "north", "s": "south", "e": "east", "w": "west", "apt": "apartment", "bldg": "building", "flr": "floor",
}
DIRECTIONS = {"ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
#: Words that tell of flooding.
FLOOD_WORDS = [
    "flood", "flooding", "flooded", "waterlogging", "waterlogged", "standing water", "ponding", "inundation", "inundated", "overflow", "overflowing", "backup", "backed up",
    "drain", "drainage", "clogged", "blocked", "blockage", "sewer", "storm drain", "catch basin", "culvert", "water damage", "basement flood", "street flood",
]


@F.udf(T.StringType(), useArrow=False)
def _decomposed(text: str | None) -> str | None:
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text)
    for c in set(plain):
        if unicodedata.combining(c):
            plain = plain.replace(c, "")
    return plain


def without_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks; Spark has no such function, so texts that ASCII cannot write go to
    Python, about a hundred at a time: an Arrow batch would hold ten thousand whole texts."""
    foreign = F.when(F.octet_length(text) > F.char_length(text), text)
    return F.coalesce(_decomposed(foreign), text)


def normalize_address(text: Column) -> Column:
    """Lower case, abbreviations written out, no signs but comma, point and hyphen. Accents: see ``without_accents``."""
    pairs = [*ABBREVIATIONS.items(), *((f"{k}.", v) for k, v in ABBREVIATIONS.items()), *DIRECTIONS.items()]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    words = F.split(F.trim(F.lower(text)), r"\s+")
    joined = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return F.trim(F.regexp_replace(joined, r"(?U)[^\w\s,.\-]", ""))


def normalize_description(text: Column) -> Column:
    out = F.trim(F.lower(text))
    for pattern, to in ((r"[!?]{2,}", "!"), (r"\.{2,}", "."), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def flood_keywords(text: Column) -> Column:
    """The flood words that the text holds, in alphabetical order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(w) for w in sorted(FLOOD_WORDS)]), lambda w: F.contains(low, w))


def text_digest(text: Column) -> Column:
    """Twelve hex digits of the sorted words of more than three letters; equal for reordered texts, empty without words.

    The words are bound by a lambda, so that the text is normalised once.
    """
    words = F.sort_array(F.filter(F.split(normalize_description(text), " "), lambda w: F.length(w) > 3))
    digest = lambda w: F.when(F.size(w) > 0, F.substring(F.md5(F.array_join(w, " ").cast("binary")), 1, 12)).otherwise(F.lit(""))
    return F.get(F.transform(F.array(words), digest), F.lit(0))

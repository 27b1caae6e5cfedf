"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, all in DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that a text must not show to a reader of the formatted output: the template's own and other templates'.
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """One record layout. ``paths``: its nested field paths, sorted. Either ``turns`` (path of a list, role field, text
    field) or ``fields``: (path, role) in order; adjacent fields of one role are joined by a blank line."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()

    def signature(self) -> str:
        return ";".join(sorted(self.paths))


#: Roles as layouts name them, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Layout("turns", ("turns[].role", "turns[].text"), turns=("turns", "role", "text")),
    Layout("prompt_response", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("question_answer", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
    Layout("instruction", ("input", "instruction", "output"), fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("instruction_only", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("system_prompt", ("prompt", "response", "system"), fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
)


def shape(record: Column) -> Column:
    """The nested field names of a variant, without the types of its leaves: a null and a string leave the same shape."""
    leaf = r"\b(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\s*\d+\)|VARIANT)\b"
    return F.regexp_replace(F.schema_of_variant(record), leaf, "_")


def shape_of(layout: Layout) -> str:
    """The same for a declared layout."""
    if layout.turns:
        path, role, text = layout.turns
        names = ", ".join(f"{x}: _" for x in sorted((role, text)))
        return f"OBJECT<{path}: ARRAY<OBJECT<{names}>>>"
    return "OBJECT<" + ", ".join(f"{p}: _" for p in sorted(layout.paths)) + ">"


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


def mapped(layout: Layout, record: Column) -> Column:
    """The canonical turns of a record of this layout."""
    if layout.turns:
        path, role, text = layout.turns
        items = F.variant_get(record, f"$.{path}", f"array<struct<{role}:string,{text}:string>>")
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        return F.transform(items, lambda t: F.struct(F.coalesce(F.try_element_at(names, t[role]), t[role], F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    turns: list[tuple[str, list[Column]]] = []
    for path, role in layout.fields:
        value = F.coalesce(F.variant_get(record, f"$.{path}", "string"), F.lit(""))
        if turns and turns[-1][0] == role:
            turns[-1][1].append(value)
        else:
            turns.append((role, [value]))
    filled = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*v), lambda x: x != ""), "\n\n").alias("text")) for r, v in turns]
    made = F.array(*filled)
    return F.filter(made, lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` (its name) and ``turns``, from a variant column of heterogeneous records.

    A record whose fingerprint no layout has, and a null record, get a null layout and null turns: they stay in the
    output to be looked at. Null texts and roles become empty; an empty list of turns stays empty. Columns of these
    names are replaced, all others pass through.
    """
    value = F.col(record)
    mark = fingerprint(value)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    empty = F.lit(None).cast("string")
    for x in layouts:
        known = mark == F.xxhash64(F.lit(shape_of(x)))
        if x.turns:
            known = known | (shape(value) == f"OBJECT<{x.turns[0]}: ARRAY<_>>")  # a list without turns
        name = F.when(known, F.lit(x.name)).otherwise(name)
        turns = F.when(known, mapped(x, value).cast(TURNS)).otherwise(turns)
    return records.withColumn("layout", F.coalesce(name, empty)).withColumn("turns", turns)


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    r"""Double every backslash, then put one after the first character of each control string: reversible by ``unescaped``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    for c in controls:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_chats(records: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """``records`` (with ``turns``) with ``formatted`` and ``loss_mask``.

    Each turn is TURN role TEXT text END with control strings escaped in both. ``loss_mask`` lists (start, chars) of
    the code points of ``formatted`` to learn from: each text of role ``learn_from``, once, in order, and nothing
    between. Null turns give nulls; no turns give an empty string and mask. Columns of these names are replaced.
    """
    pieces = F.transform("turns", lambda t: F.struct((t["role"] == learn_from).alias("learn"), F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(state, p):
        span = F.struct((state["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("chars"))
        at = state["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)
        return F.struct(at.alias("at"), F.when(p["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    ready = records.drop("formatted", "loss_mask").withColumn("_pieces", pieces)
    return (
        ready.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
        .withColumn("loss_mask", F.aggregate("_pieces", start, step, lambda s: s["spans"]))
        .drop("_pieces")
    )


def read_back(formatted: str = "formatted") -> Column:
    """The turns of a formatted chat, unescaped."""
    parts = F.filter(F.split(F.col(formatted), r"<\|end\|>\n"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.substring(p, F.lit(len(TURN) + 1), F.length(p)))
    return F.transform(parts, lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(F.substring_index(p, TEXT, -1)).alias("text")))


def read_loss(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(F.col(formatted), s["start"] + 1, s["chars"]))), "")


def gathered(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): rows by turn as one record in the ``messages`` layout for each conversation.

    Turns go by turn, then role and text, null first; repeated rows are repeated turns. A conversation is one value
    of the output and so meets in one task; nothing else is gathered by it.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))))
    own = rows.groupBy(key).agg(F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    return own.select(key, F.to_variant_object(F.struct("messages")).alias("record"))

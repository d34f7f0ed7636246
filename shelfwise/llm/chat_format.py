"""Chat formatting: records of many layouts become canonical turns, and turns one text with a loss mask.  Column expressions only.

A record's nested field paths (``messages[].role``, ``prompt``), as far as any layout names them, are sorted and
hashed; the hash picks the declared layout, which says how the fields become turns of a role and a text.  For a typed table the
paths are those of its schema, for JSON records each row has its own.

The library's records hold no conversations, so the operator is general; a request with the options selected for it is one of
its layouts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from itertools import chain, combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import let

TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:int,end:int>>"


# ---------------------------------------------------------------- layouts
class Said(NamedTuple):
    """One turn of a fixed role: the fields that are not blank, a blank line between them."""

    role: str
    fields: tuple[str, ...]


class Lines(NamedTuple):
    """One turn of a fixed role: a field of every list element, each on a line."""

    role: str
    path: str
    field: str


class Listed(NamedTuple):
    """One turn per list element; ``names`` maps the layout's roles to the canonical ones."""

    path: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


class Row(NamedTuple):
    """The record is itself one turn."""

    role: str
    text: str


class Layout(NamedTuple):
    name: str
    turns: tuple[Said | Lines | Listed | Row, ...]
    #: Turns that are there only where the record has their fields.
    optional: tuple[str, ...] = ()


LAYOUTS = (
    Layout("messages", (Listed("messages", "role", "content"),)),
    Layout("shared", (Said("system", ("system",)), Listed("conversations", "from", "value", (("human", "user"), ("gpt", "assistant")))), ("system",)),
    Layout("prompt", (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("completion",))), ("system",)),
    Layout("answer", (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",))), ("system",)),
    Layout("instruction", (Said("system", ("system",)), Said("user", ("instruction", "input")), Said("assistant", ("output",))), ("system", "input")),
    Layout("selection", (Said("user", ("query",)), Lines("assistant", "options", "title"))),
    Layout("turn", (Row("role", "text"),)),
)


def _rule_paths(rule) -> list[str]:
    if isinstance(rule, Said):
        return list(rule.fields)
    if isinstance(rule, Lines):
        return [f"{rule.path}[].{rule.field}"]
    if isinstance(rule, Listed):
        return [f"{rule.path}[].{rule.role}", f"{rule.path}[].{rule.text}"]
    return [rule.role, rule.text]


def layout_paths(layout: Layout) -> list[str]:
    return sorted({p for rule in layout.turns for p in _rule_paths(rule)})


def fingerprint(paths: Sequence[str]) -> str:
    """SHA-256 of the sorted paths, one a line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_paths(layouts: Sequence[Layout] = LAYOUTS) -> list[str]:
    return sorted({p for x in layouts for p in layout_paths(x)})


def fingerprints(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, int]:
    """Layout number by fingerprint, with and without every optional path; two layouts of one fingerprint are an error."""
    out: dict[str, int] = {}
    for number, layout in enumerate(layouts):
        whole = layout_paths(layout)
        for left_out in chain.from_iterable(combinations(layout.optional, n) for n in range(len(layout.optional) + 1)):
            key = fingerprint([p for p in whole if p not in left_out])
            if out.setdefault(key, number) != number:
                raise ValueError(f"layouts {layouts[out[key]].name} and {layout.name} have the same paths")
    return out


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type: fields by dots, list elements by ``[]``."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


# ---------------------------------------------------------------- records to turns
def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _element(rule: Listed) -> Callable[[Column], Column]:
    def turn(item: Column) -> Column:
        role = item[rule.role]
        for given, canonical in rule.names:
            role = F.when(item[rule.role] == given, F.lit(canonical)).otherwise(role)
        return _turn(role, item[rule.text])

    return turn


def _line(rule: Lines) -> Callable[[Column], Column]:
    return lambda item: F.coalesce(item[rule.field], F.lit(""))


def _expression(layout: Layout, has: Callable[[str], bool | Column], value: Callable[[str], Column], each: Callable[[str, Sequence[str]], Column]) -> Column:
    """Turns of a layout; ``value`` reads a field as text, ``each`` list elements as structs of texts."""
    parts = []
    for rule in layout.turns:
        if isinstance(rule, Row):
            parts.append(F.array(_turn(value(rule.role), value(rule.text))))
        elif isinstance(rule, Listed):
            parts.append(F.transform(each(rule.path, (rule.role, rule.text)), _element(rule)))
        elif isinstance(rule, Lines):
            lines = F.transform(each(rule.path, (rule.field,)), _line(rule))
            parts.append(F.array(_turn(F.lit(rule.role), F.array_join(lines, "\n"))))
        else:
            there = [f for f in rule.fields if has(f) is not False]
            filled = [F.when(value(f) != "", value(f)) for f in there]
            turn = F.array(_turn(F.lit(rule.role), F.concat_ws("\n\n", *filled)))
            if set(rule.fields) <= set(layout.optional):
                none = F.array().cast(TURNS)
                turn = none if not there else F.when(F.coalesce(*filled).isNotNull(), turn).otherwise(none)
            parts.append(turn)
    return F.coalesce(F.concat(*parts), F.array().cast(TURNS))


def canonical_turns(records: DataFrame, fields: Sequence[str] | None = None, layouts: Sequence[Layout] = LAYOUTS, name: str = "turns") -> DataFrame:
    """Adds ``name``, the turns (``role``, ``text``) of every record of a typed table.

    ``fields`` are the columns that make the record (all by default); the fingerprint of their nested paths picks the layout, paths that
    no layout names are passed over, and a table that matches none is a ValueError naming its paths.  A null
    text or role is empty, a null or empty list has no turns, a null list element is an empty turn.  Other columns are passed on.
    """
    chosen = records.select(*[F.col(f"`{c}`") for c in (records.columns if fields is None else fields)]).schema
    paths = set(field_paths(chosen)) & set(known_paths(layouts))
    number = fingerprints(layouts).get(fingerprint(sorted(paths)))
    if number is None:
        raise ValueError(f"no layout for the paths {sorted(paths)}")

    def value(field: str) -> Column:
        return F.col(field).cast("string")

    def each(path: str, names: Sequence[str]) -> Column:
        return F.transform(F.col(path), lambda x: F.struct(*[x[n].cast("string").alias(n) for n in names]))

    return records.withColumn(name, _expression(layouts[number], lambda f: f in paths, value, each))


def canonical_json(records: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS, name: str = "turns") -> DataFrame:
    """Adds ``layout`` and ``name``, the turns of JSON records of mixed layouts; every row has its own fingerprint.

    A list's paths are those of its first element.  A row that is null, no JSON or of no layout has a null ``layout`` and no turns.  Own columns
    of these names are replaced.
    """
    whole = F.try_parse_json(F.col(record))
    records = records.drop("layout", name)

    def present(path: str) -> Column:
        return F.try_variant_get("_record", "$." + path.replace("[]", "[0]"), "variant").isNotNull()

    paths = F.array_compact(F.array(*[F.when(present(p), F.lit(p)) for p in known_paths(layouts)]))
    numbers = F.create_map(*[F.lit(x) for pair in fingerprints(layouts).items() for x in pair])
    based = let(records, {"_record": whole})
    based = let(based, {"_number": F.try_element_at(numbers, F.sha2(F.array_join(paths, "\n"), 256))})

    def value(field: str) -> Column:
        return F.try_variant_get("_record", f"$.{field}", "string")

    def each(path: str, names: Sequence[str]) -> Column:
        return F.transform(
            F.try_variant_get("_record", f"$.{path}", "array<variant>"),
            lambda x: F.struct(*[F.try_variant_get(x, f"$.{n}", "string").alias(n) for n in names]),
        )

    turns, label = F.array().cast(TURNS), F.lit(None).cast("string")
    for number, layout in enumerate(layouts):
        fits = F.coalesce(F.col("_number") == number, F.lit(False))
        turns = F.when(fits, _expression(layout, lambda f: True, value, each)).otherwise(turns)
        label = F.when(fits, F.lit(layout.name)).otherwise(label)
    return based.withColumns({"layout": label, name: turns}).drop("_record", "_number")


def collect_turns(rows: DataFrame, key: str, order: str, turns: str = "turns") -> DataFrame:
    """One row per ``key`` with the turns of all its rows in the order of ``order`` (null first; ties by role, then text).

    A null key is a key of its own.  Tasks gather turns before the shuffle; a conversation's turns meet in one row, since it is one text.
    """
    pieces = rows.select(key, F.col(order).alias("_at"), F.posexplode(turns).alias("_no", "_turn"))
    listed = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "_no", "_turn"))).alias("_all"))
    return listed.select(key, F.transform("_all", lambda x: x["_turn"]).alias(turns))


# ---------------------------------------------------------------- template
# A role's opening and closing mark, and those of a turn of any other role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER, NAMED, OTHER_END = "[TURN]", "[TEXT]", "[/TURN]"
CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[TURN\]|\[TEXT\]|\[/TURN\])"
TURN = r"(?s)(<s>|\[INST\]|\[SYS\]|\[TURN\]) (.*?) (?:</s>|\[/INST\]|\[/SYS\]|\[/TURN\])"
LOSS = "assistant"


def escape(text: Column) -> Column:
    """One more backslash before every control string, so that none in a text stands behind a space or a start."""
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + CONTROL, r"$1$2")


def _before(turn: Column) -> Column:
    """What stands before a turn's text: the opening mark, and the role where the mark does not say it."""
    out = F.concat(F.lit(f"{OTHER} "), escape(turn["role"]), F.lit(f" {NAMED} "))
    for role, (opening, _) in MARKS.items():
        out = F.when(turn["role"] == role, F.lit(f"{opening} ")).otherwise(out)
    return out


def _after(turn: Column) -> Column:
    out = F.lit(f" {OTHER_END}")
    for role, (_, closing) in MARKS.items():
        out = F.when(turn["role"] == role, F.lit(f" {closing}")).otherwise(out)
    return out


def format_chats(chats: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted``, the turns between their marks, one a line, and ``loss``, the spans of the assistant's texts in it.

    Spans are code points, end exclusive, and hold the text alone.  Control strings inside texts and roles get a
    backslash; ``read_turns`` takes it off.  No or null turns give an empty text without spans.  Own columns of
    these names are replaced, others are passed on.
    """
    marked = F.transform(
        F.coalesce(turns, F.array().cast(TURNS)),
        lambda t: F.struct(_before(t).alias("before"), escape(t["text"]).alias("text"), _after(t).alias("after"), (t["role"] == LOSS).alias("loss")),
    )
    based = let(chats.drop("formatted", "loss"), {"_marked": marked})
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(t["before"])
        end = first + F.length(t["text"])
        span = F.array(F.struct(first.alias("start"), end.alias("end")))
        spans = F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + F.length(t["after"]) + 1).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("_marked", lambda t: F.concat(t["before"], t["text"], t["after"])), "\n")
    loss = F.aggregate("_marked", start, step, lambda acc: acc["spans"])
    return let(based, {"formatted": text, "loss": loss}).drop("_marked")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text was made from."""
    marks = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    inner = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))

    def turn(mark: Column, text: Column) -> Column:
        cut = F.instr(text, f" {NAMED} ")
        role = F.when(mark == OTHER, unescape(F.substring(text, F.lit(1), cut - 1)))
        for name, (opening, _) in MARKS.items():
            role = F.when(mark == opening, F.lit(name)).otherwise(role)
        said = F.when(mark == OTHER, F.substring(text, cut + len(NAMED) + 2, F.length(text))).otherwise(text)
        return F.struct(role.alias("role"), unescape(said).alias("text"))

    return F.zip_with(marks, inner, turn)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, without escapes."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))

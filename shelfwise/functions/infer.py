"""Inference of format, type, subject, context and confidence for candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .columns import bind
from .match import Rules, first_label, holds
from .text import as_col, blank_to_null, strip, visible
from .urls import path, suffix

FILE_SUFFIX = r"\.(pdf|docx?|pptx?|xlsx?|jpe?g|png|gif|webp|mp3|wav|m4a|mp4|mov|avi|zip|rar|7z)(?:[?#]|$)"
DIRECT_SUFFIX = r"\.(pdf|docx?|pptx?|xlsx?|mp3|wav|m4a|mp4|mov|zip)(?:[?#]|$)"
HINT_SUFFIX = r"\.(pdf|docx?|pptx?|xlsx?|mp3|wav|m4a|mp4|mov|zip|rar|7z)(?:[?#]|$)"


def filter_col(filters: Mapping[str, object] | None, *keys: str) -> Column:
    """A filter as a column: a literal, or a column when the value is one."""
    for key in keys:
        value = (filters or {}).get(key)
        if value is not None:
            return value if isinstance(value, Column) else F.lit(str(value))
    return F.lit(None).cast("string")


def infer_format(lowered: Column | str, word_rules: Rules = L.FORMAT_WORD_RULES) -> Column:
    """Format from a file suffix, else from words, else ``html``; the text is lower case."""
    lowered = as_col(lowered)
    by_suffix = bind(
        F.regexp_extract(lowered, FILE_SUFFIX, 1),
        lambda found: F.when(found.isin("jpg", "jpeg", "png", "gif", "webp"), F.lit("image"))
        .when(found.isin("mp3", "wav", "m4a"), F.lit("audio"))
        .when(found.isin("mp4", "mov", "avi"), F.lit("video"))
        .when(found != "", found),
    )
    return F.coalesce(by_suffix, first_label(lowered, word_rules), F.lit("html"))


def by_format(fmt: Column, table: Mapping[str, str], default: str) -> Column:
    groups: dict[str, list[str]] = {}
    for key, label in table.items():
        groups.setdefault(label, []).append(key)
    out = reduce(lambda chain, g: chain.when(fmt.isin(g[1]), g[0]), groups.items(), F)
    return out.otherwise(default)


def infer_resource_type(lowered: Column, fmt: Column, rules: Rules, by_fmt: Mapping[str, str], default: str) -> Column:
    return F.coalesce(first_label(lowered, rules), by_format(fmt, by_fmt, default))


def infer_subject(lowered: Column, rules: Sequence[tuple[str | None, str, Sequence[str]]]) -> tuple[Column, Column]:
    """(subject, domain) of the first rule with a hit."""
    domain = first_label(lowered, [(field, terms) for _, field, terms in rules])
    subject = F.nullif(first_label(lowered, [(name or "", terms) for name, _, terms in rules]), F.lit(""))
    return subject, domain


def infer_context_field(value: Column, lowered: Column) -> Column:
    """A filter value only where the (lower-case) text shows it."""
    return F.when(holds(lowered, F.lower(value)), value)


def infer_topic(topic: Column, lowered: Column) -> Column:
    """The topic where the text shows all of it or at least half of its parts."""
    parts = F.array_remove(F.split(F.lower(topic), r"[\s、,，/]+"), "")
    enough = bind(
        parts,
        lambda ps: F.size(F.filter(ps, lambda p: F.contains(lowered, p)))
        >= F.greatest(F.lit(1), F.floor(F.size(ps) / 2)),
    )
    return F.when(holds(lowered, F.lower(topic)) | enough, topic)


def filled(field: Column | str) -> Column:
    """Neither null nor blank."""
    value = as_col(field).cast("string")
    return F.coalesce(F.when(visible(value), F.lit(True)).otherwise(strip(value) != ""), F.lit(False))


def filled_share(*fields: Column | str, digits: int = 2) -> Column:
    """Share of fields that are neither null nor blank, as an exact decimal."""
    count = reduce(lambda a, b: a + b, [F.when(filled(f), 1).otherwise(0) for f in fields])
    return F.round((count * F.lit(1).cast("decimal(3,0)")) / F.lit(len(fields)).cast("decimal(3,0)"), digits)


def metadata_confidence(*fields: Column | str) -> Column:
    return filled_share(*fields).cast("double")


def link_confidence(fields: Sequence[Column | str], origin_title: Column, untitled: Column) -> Column:
    """The share plus 0.08 for a known origin page minus 0.2 for a made-up title, in [0, 1]."""
    bonus = F.when(blank_to_null(origin_title).isNotNull(), F.lit("0.08").cast("decimal(4,2)")).otherwise(F.lit(0))
    malus = F.when(untitled, F.lit("0.20").cast("decimal(4,2)")).otherwise(F.lit(0))
    share = filled_share(*fields)
    return F.round(F.greatest(F.least(share + bonus - malus, F.lit(1)), F.lit(0)), 2).cast("double")


def item_format(declared: Column, url: Column, title: Column, known: Sequence[str] = L.SITE_EXTENSIONS) -> Column:
    """Format of a search item: declared, else URL suffix, else title suffix; unknown ones are web pages."""
    plain = F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(declared, F.lit(""))), r"([^/]*)$", 1), "^jpeg$", "jpg")
    detected = F.coalesce(blank_to_null(plain), blank_to_null(suffix(path(url))), blank_to_null(suffix(title)))
    return bind(detected, lambda d: F.when(d.isin(list(known)), d).otherwise(F.lit("网页")))


def detail_format(declared: Column, url: Column) -> Column:
    """Format of a file item: playlist types, MIME tails, and the suffix for folders and sources."""
    text = F.lower(F.coalesce(blank_to_null(declared, plain=True), F.lit("")))
    plain = F.regexp_replace(text, r"^application/(?:x-mpegurl|vnd\.apple\.mpegurl)$", "m3u8")
    named = F.nullif(F.regexp_replace(F.regexp_extract(plain, r"([^/]*)$", 1), "^(?:folder|source)$", ""), F.lit(""))
    folder = F.nullif(F.regexp_extract(plain, r"(folder|source)$", 1), F.lit(""))
    found = F.coalesce(named, F.nullif(suffix(path(url)), F.lit("")), folder, F.lit("unknown"))
    return F.regexp_replace(found, "^jpeg$", "jpg")


def detail_resource_type(fmt: Column, *texts: Column) -> Column:
    out = F
    for label, formats in L.DETAIL_TYPE_BY_FORMAT.items():
        out = out.when(fmt.isin(formats), label)
    by_words = bind(F.lower(F.concat_ws(" ", fmt, *texts)), lambda blob: first_label(blob, L.DETAIL_TYPE_RULES))
    return F.coalesce(out, by_words, F.lit("文档"))


def library_format(declared: Column, file: Column) -> Column:
    """Declared format, else the file suffix, folded to one spelling."""
    fmt = F.coalesce(blank_to_null(F.ltrim(F.lower(F.regexp_replace(declared, r"^\s*\.+", "")))), blank_to_null(suffix(file)))
    return F.regexp_replace(F.coalesce(fmt, F.lit("unknown")), "^jpeg$", "jpg")


def format_family(expected: Column) -> Column:
    """The format names that satisfy an expected one."""

    def family(wanted: Column) -> Column:
        out = F
        for name, members in L.FORMAT_FAMILIES.items():
            out = out.when(wanted == name, F.array(*[F.lit(m) for m in members]))
        return out.otherwise(F.array(wanted))

    return bind(F.replace(F.lower(expected), F.lit("/"), F.lit("")), family)


def format_matches(expected: Column, actual: Column) -> Column:
    """An expected format name against an actual one, by family and then by substring."""
    have = F.replace(F.lower(F.coalesce(actual, F.lit(""))), F.lit("/"), F.lit(""))
    return bind(have, lambda h: F.exists(format_family(expected), lambda name: F.contains(h, name)))

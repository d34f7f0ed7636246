"""Text helpers as native column expressions (all stay inside code generation
except the few that need a lambda over an array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode counts as white space; Spark's \s is ASCII only.
_WHITE_CODES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F]
WHITE = "".join(map(chr, [*_WHITE_CODES, 0x205F, 0x3000]))
# White space other than the blank, in as few ranges as possible: a regular
# expression tests every range of a class for every character.
_NOT_BLANK = r"\t-\r\x1c-\x1f\x85\xa0" + "".join(
    [chr(0x1680), chr(0x2000), "-", chr(0x200A), *map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
)
WHITE_CLASS = f"[ {_NOT_BLANK}]"
# A run that is not already one blank.
WHITE_RUN = f" *[{_NOT_BLANK}]{WHITE_CLASS}*|  +"
CJK = r"[\u4e00-\u9fff]"
# What separates words of a query: white space, list marks, brackets and quotes.
# 　、 【】 （） ， ：； as ranges.
_WIDE_BREAKS = "".join(map(chr, (0x3000, 0x2D, 0x3001, 0x3010, 0x2D, 0x3011, 0xFF08, 0x2D, 0xFF09, 0xFF0C, 0xFF1A, 0x2D, 0xFF1B)))
WORD_BREAK = rf"""[\s\xa0,/|;:()\[\]"'<>{_WIDE_BREAKS}]+"""

# The character references that are decoded, ampersand last.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def visible(text: Column) -> Column:
    """True if the text begins with visible ASCII or a character behind the last white space, U+3000; false tells nothing."""
    return ((text >= "!") & (text < "\x7f")) | (text >= "\u3001")


def strip(value: Column | str, plain: bool = False) -> Column:
    """White space off both ends.  ``plain``: the value is a column or field, cheap to read more than once, and is
    only searched for white space where its first or last character may be some."""
    value = as_col(value)
    if not plain:
        return F.btrim(value, F.lit(WHITE))
    return F.when(visible(value) & visible(F.substring(value, -1, 1)), value).otherwise(F.btrim(value, F.lit(WHITE)))


def squeeze(value: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.btrim(F.regexp_replace(as_col(value), WHITE_RUN, " "), F.lit(" "))


def blank_to_null(value: Column | str, plain: bool = False) -> Column:
    return F.nullif(strip(as_col(value).cast("string"), plain), F.lit(""))


def first_value(*values: Column | str) -> Column:
    """First value that is neither null nor blank, trimmed."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def text_blob(*values: Column | str) -> Column:
    """Lower-cased fields joined by blanks; nulls and blanks vanish."""
    return F.lower(F.concat_ws(" ", *[blank_to_null(v) for v in values]))


def unescape(value: Column | str) -> Column:
    out = as_col(value)
    for reference, character in ENTITIES:
        out = F.replace(out, F.lit(reference), F.lit(character))
    return out


def clean_text(value: Column | str, tags_first: bool = True) -> Column:
    """Plain text of a markup fragment: tags to blanks, references decoded, blanks squeezed."""
    text = F.coalesce(as_col(value), F.lit(""))
    if tags_first:
        return squeeze(unescape(F.regexp_replace(text, "<[^>]+>", " ")))
    return squeeze(F.regexp_replace(unescape(text), "<[^>]+>", " "))


def clean_inline(value: Column | str) -> Column:
    """Plain text of a highlighted phrase: references decoded, tags removed without a gap."""
    return squeeze(F.regexp_replace(unescape(F.coalesce(as_col(value), F.lit(""))), "<[^>]+>", ""))


def stable_id(value: Column | str) -> Column:
    return F.substring(F.sha1(as_col(value)), 1, 16)


def content_key(value: Column | str) -> Column:
    return F.sha2(as_col(value), 256)


def words(value: Column | str) -> Column:
    """Distinct lower-cased pieces between separators, in order of appearance."""
    pieces = F.split(F.lower(as_col(value)), WORD_BREAK)
    return F.array_distinct(F.array_remove(pieces, ""))


def parts_of(value: Column, size: int) -> Column:
    """All parts of ``size`` characters, in order; a shorter value has none."""

    def part(at: Column) -> Column:
        return F.substr(value, at, F.lit(size))

    starts = F.sequence(F.lit(1), F.greatest(F.length(value) - (size - 1), F.lit(1)))
    return F.when(F.length(value) >= size, F.transform(starts, part)).otherwise(F.array().cast("array<string>"))


def tokens(value: Column | str) -> Column:
    """``words`` plus the 2-, 3- and 4-grams of every piece of four or more
    characters that holds a CJK character, since those scripts write no blanks."""

    def grams(piece: Column) -> Column:
        long_cjk = (F.length(piece) >= 4) & F.regexp_like(piece, F.lit(CJK))
        every = F.concat(F.array(piece), *[parts_of(piece, size) for size in (2, 3, 4)])
        return F.when(long_cjk, every).otherwise(F.array(piece))

    return F.array_distinct(F.flatten(F.transform(words(value), grams)))


def join_distinct(*values: Column | str, sep: str = " ") -> Column:
    """Ordered distinct non-blank values as one string."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[blank_to_null(v) for v in values]))), sep)


def safe_part(value: Column | str, fallback: str, limit: int | None = None) -> Column:
    """A path-safe name: separators to ``_``, blanks squeezed, dots and blanks off the ends."""
    raw = F.coalesce(blank_to_null(value), F.lit(fallback))
    text = F.btrim(
        F.regexp_replace(F.regexp_replace(raw, r'[\\/:*?"<>|\r\n\t]+', "_"), WHITE_RUN, " "), F.lit(" .")
    )
    named = F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))
    return named if limit is None else F.substring(named, 1, limit)


def mask_secrets(value: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order."""
    out = as_col(value)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


# How a token and a bearer header are written in logs.
SECRET_RULES = [
    (r"(accessToken=)[^&\s'\"]+", "$1***"),
    (r"(Authorization: Bearer )[A-Za-z0-9._-]+", "$1***"),
]
# Header names whose value is masked, and those that may be shown.
SECRET_HEADERS = ["authorization", "cookie", "x-nd-auth", "set-cookie", "accesstoken"]
PUBLIC_HEADERS = ["content-type", "content-length", "accept-ranges", "last-modified", "etag", "cache-control"]


def safe_headers(headers: Column | str) -> Column:
    """Map of header values with secret ones masked and unknown ones left out."""
    known = F.map_filter(as_col(headers), lambda k, _: F.lower(k).isin(SECRET_HEADERS + PUBLIC_HEADERS))
    return F.transform_values(known, lambda k, v: F.when(F.lower(k).isin(SECRET_HEADERS), F.lit("***")).otherwise(v))


# The Chinese numerals of school grades 0 to 10.
GRADE_NUMERALS = ["零", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]


def grade_to_chinese(value: Column | str) -> Column:
    """``3`` and ``3年级`` become 三年级; anything else stays."""
    text = strip(as_col(value).cast("string"))
    number = F.nullif(F.regexp_extract(text, r"^(\d{1,2})(?:\s*年级.*)?$", 1), F.lit("")).cast("int")
    name = F.get(F.array(*[F.lit(n) for n in GRADE_NUMERALS]), number)
    return F.coalesce(F.concat(name, F.lit("年级")), text)

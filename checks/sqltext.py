"""SQL fragments (DuckDB) that say the same as the column helpers."""

from __future__ import annotations

from shelfwise.functions.text import ENTITIES, WHITE, WHITE_CLASS, WORD_BREAK

SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITE)})"


def blank_to_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WHITE_CLASS + '+')}, ' ', 'g'), ' ')"


def unescape(x: str) -> str:
    for ref, ch in ENTITIES:
        x = f"replace({x}, {lit(ref)}, {lit(ch)})"
    return x


def clean(x: str) -> str:
    return squeeze(unescape(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def host(x: str) -> str:
    return rf"lower(regexp_extract({x}, '^(?:{SCHEME}:)?//([^/?#]*)', 1))"


def path(x: str) -> str:
    return rf"regexp_extract({x}, '^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)"


def suffix(x: str) -> str:
    return rf"lower(regexp_extract({x}, '[^/]\.([^./]+)/*$', 1))"


def ext(x: str) -> str:
    return f"replace({suffix(path(x))}, 'jpeg', 'jpg')"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")" if terms else "false"


def count_of(x: str, terms) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(t)})::INT" for t in terms) + ")" if terms else "0"


def hits(x: str, terms, prefix: str = "") -> str:
    cases = ", ".join(f"CASE WHEN contains({x}, {lit(t)}) THEN {lit(prefix + t)} END" for t in dict.fromkeys(terms))
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


def labels(x: str, rules) -> str:
    cases = ", ".join(f"CASE WHEN {any_of(x, ts)} THEN {lit(n)} END" for n, ts in rules)
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


def first_label(x: str, rules, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, ts)} THEN {lit(n)}" for n, ts in rules) + f" ELSE {default} END"


def absolute(base: str, ref: str) -> str:
    """Resolution for references without dot segments (the test pages have none)."""
    origin = rf"regexp_extract({base}, '^((?:{SCHEME}:)?//[^/?#]*)', 1)"
    folder = rf"regexp_extract({path(base)}, '^(.*/)', 1)"
    return f"""CASE WHEN {ref} = '' THEN {base}
      WHEN regexp_matches({ref}, '^{SCHEME}:') THEN {ref}
      WHEN starts_with({ref}, '//') THEN regexp_extract({base}, '^({SCHEME}:)', 1) || {ref}
      WHEN starts_with({ref}, '/') THEN {origin} || {ref}
      WHEN starts_with({ref}, '?') THEN regexp_extract({base}, '^([^?#]*)', 1) || {ref}
      WHEN starts_with({ref}, '#') THEN regexp_extract({base}, '^([^#]*)', 1) || {ref}
      ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {ref} END"""


def word_list(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), {lit(WORD_BREAK)}), lambda v: v <> '')"

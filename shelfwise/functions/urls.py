"""URL parts and resolution as native expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind
from .text import as_col, clean_text, unescape

SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_col(url), rf"^(?:{SCHEME}:)?//([^/?#]*)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), rf"^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def file_name(url: Column | str) -> Column:
    return F.regexp_extract(path(url), r"([^/]+)/*$", 1)


def suffix(name: Column | str) -> Column:
    """Lower-cased file suffix without the dot; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(as_col(name), r"[^/]\.([^./]+)/*$", 1))


def ext(url: Column | str) -> Column:
    return F.regexp_replace(suffix(path(url)), "^jpeg$", "jpg")


def quote(value: Column | str, keep: str = "") -> Column:
    """Percent-encode; ``keep`` lists characters that stay as they are."""
    out = F.replace(F.url_encode(as_col(value)), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    encoded = {"/": "%2F", ":": "%3A"}
    for character in keep:
        out = F.replace(out, F.lit(encoded[character]), F.lit(character))
    return out


def unquote(value: Column | str) -> Column:
    """Percent-decode; a plus stays a plus, and broken escapes leave the text as it is."""
    value = as_col(value)
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def query_value(url: Column | str, *keys: str) -> Column:
    """First non-empty value among the query keys, in key order, decoded."""

    def one(key: str) -> Column:
        raw = F.regexp_extract(as_col(url), rf"^[^#?]*\?(?:[^#]*&)?{key}=([^&#]+)", 1)
        return bind(raw, lambda r: F.when(r != "", F.coalesce(F.try_url_decode(r), r)))

    return F.coalesce(*[one(k) for k in keys])


def quote_path(url: Column | str) -> Column:
    """Decode and re-encode only the path of a URL."""
    url = as_col(url)
    head = F.regexp_extract(url, rf"^((?:{SCHEME}:)?(?://[^/?#]*)?)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.concat(head, quote(unquote(path(url)), keep="/:"), tail)


def unwrap_redirect(url: Column | str, keys: Sequence[str] = ("uddg", "url", "u", "target")) -> Column:
    return bind(unescape(url), lambda u: F.coalesce(query_value(u, *keys), u))


def fold_dots(url_path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; the fold runs only where a path has one."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part == ".", done)
            .when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
            .otherwise(F.concat(done, F.array(part)))
        )

    def fold(plain: Column) -> Column:
        parts = F.split(plain, "/")
        last = F.element_at(parts, -1)
        closed = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
        folded = F.array_join(F.aggregate(closed, F.array().cast("array<string>"), step), "/")
        return bind(folded, lambda f: F.when(f == "", F.lit("/")).otherwise(f))

    return bind(url_path, lambda p: F.when(F.contains(p, F.lit("/.")), fold(p)).otherwise(p))


def clean_ref(ref: Column | str) -> Column:
    return F.trim(unescape(ref))


def resolve(base: Column | str, ref: Column | str) -> Column:
    """Resolve a cleaned reference against the page it stands on."""
    base, ref = as_col(base), as_col(ref)
    scheme = F.regexp_extract(base, rf"^({SCHEME}:)", 1)
    origin = F.regexp_extract(base, rf"^((?:{SCHEME}:)?//[^/?#]*)", 1)
    base_page = F.regexp_extract(base, r"^([^?#]*)", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    joined = F.concat(F.when((folder == "") & (origin != ""), F.lit("/")).otherwise(folder), ref_path)
    return (
        F.when(ref == "", base)
        .when(
            F.startswith(ref, F.lit("/")),
            F.when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref)).otherwise(
                F.concat(origin, fold_dots(ref_path), ref_tail)
            ),
        )
        .when(F.regexp_like(ref, F.lit(rf"^{SCHEME}:")) | (base == ""), ref)
        .when(F.startswith(ref, F.lit("?")), F.concat(base_page, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .otherwise(F.concat(origin, fold_dots(joined), ref_tail))
    )


def absolute_url(base: Column | str, ref: Column | str) -> Column:
    """Resolve a reference as written in markup."""
    base = as_col(base)
    return bind(clean_ref(ref), lambda r: resolve(base, r))


def absolute_urls(base: Column | str, refs: Column) -> Column:
    """Resolve every reference of an array, in order."""
    base = as_col(base)
    return F.transform(F.transform(refs, clean_ref), lambda r: resolve(base, r))


def file_title(url: Column | str, fallback: str) -> Column:
    """Readable title from a file name: decoded, no suffix, dashes to blanks."""
    name = F.regexp_extract(unquote(path(url)), r"([^/]+)/*$", 1)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    title = clean_text(F.regexp_replace(stem, "[_-]+", " "), tags_first=False)
    return bind(title, lambda t: F.when(t != "", t).otherwise(F.lit(fallback)))

"""URL filters: host and path rules first, then pattern rules found by their rarest literal token.

Column expressions only.  A candidate's URL is cut into tokens; a map from token to the patterns
filed under it gives the few patterns that could match, and only those
are run as regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_PATTERNS = 10_000


@dataclass(frozen=True)
class HostRule:
    """A rule for a host with its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def label(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL, and the literal tokens every match must hold whole."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"


def parse_rule(verdict: str, text: str) -> HostRule:
    """``block``, ``net/es/`` -> the rule for host ``net`` and path ``/es/``."""
    host, _, path = text.partition("/")
    return HostRule(host, "/" + path, verdict)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?`` or ``#``.  Both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    after = F.coalesce(F.substring(url, F.length(rest) + F.lit(3), F.length(url)), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the URL, A-Z lower-cased."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != ""))


def _check(patterns: Sequence[PatternRule]) -> None:
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"{len(patterns)} patterns; the index is a constant of at most {MAX_PATTERNS}")
    for p in patterns:
        if not p.tokens or any(not re.fullmatch("[a-z0-9]+", t) for t in p.tokens):
            raise ValueError(f"pattern {p.pattern!r} needs literal tokens of a-z and 0-9 to be filed under")


def token_frequencies(candidates: DataFrame, patterns: Sequence[PatternRule]) -> dict[str, int]:
    """How many candidate URLs hold each literal token of the rules; at most one row per literal reaches the driver."""
    literals = sorted({t for p in patterns for t in p.tokens})
    if not literals:
        return {}
    held = F.array_intersect(url_tokens(F.col("source_url")), F.array(*[F.lit(t) for t in literals]))
    counts = candidates.select(F.explode(held).alias("token")).groupBy("token").count()
    return {row["token"]: row["count"] for row in counts.collect()}


def pattern_index(patterns: Sequence[PatternRule], frequencies: dict[str, int]) -> dict[str, list[int]]:
    """Places of the patterns by their rarest token (ties: the first in code point order)."""
    index: dict[str, list[int]] = {}
    for place, p in enumerate(patterns):
        rarest = min(p.tokens, key=lambda t: (frequencies.get(t, 0), t))
        index.setdefault(rarest, []).append(place)
    return index


def url_rules(
    candidates: DataFrame,
    rules: Sequence[HostRule],
    patterns: Sequence[PatternRule] = (),
    *,
    default: str = "allow",
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``pattern``, ``verdict`` to candidates by their ``source_url``.

    A host rule fits its host and all subdomains where the path starts with the rule's
    path; the longest label wins, and its verdict holds.  Other URLs get the verdict
    of the first pattern (in the given order) that matches, else ``default``.  Null URL or one without ``://``:
    host and path empty, no host rule, patterns still run (none on null).  Row by row, so repeated rows get equal
    results and nothing is shuffled; own columns of these names are replaced.
    Rules are configuration, at most 10,000 patterns; the URLs are read twice, first to count the rules' tokens.
    """
    _check(patterns)
    host, path = url_parts(F.col("source_url"))
    labels = sorted(rules, key=lambda r: (-len(r.label), -len(r.host), r.label))
    fits = [
        ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host)))
        & F.startswith(F.col("path"), F.lit(r.path))
        for r in labels
    ]
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, r in list(zip(fits, labels))[::-1]:
        rule = F.when(fit, F.lit(r.label)).otherwise(rule)
        ruled = F.when(fit, F.lit(r.verdict)).otherwise(ruled)
    added = ["host", "path", "rule", "pattern", "verdict"]
    out = packed(candidates, source_url="source_url").withColumns({"host": host, "path": path}).withColumn("rule", rule)
    if not patterns:
        out = out.withColumns({"pattern": F.lit(None).cast("string"), "verdict": F.coalesce(ruled, F.lit(default))})
        return unpacked(out, candidates.columns, added, source_url="source_url")
    index = pattern_index(patterns, token_frequencies(candidates, patterns))
    entries = [
        F.struct(
            F.lit(token).alias("token"),
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("place"),
                        F.lit(patterns[k].pattern).alias("pattern"),
                        F.lit(patterns[k].verdict).alias("verdict"),
                    )
                    for k in places
                ]
            ).alias("filed"),
        )
        for token, places in sorted(index.items())
    ]
    filed = F.map_from_entries(F.array(*entries))
    keys = F.array(*[F.lit(t) for t in sorted(index)])
    low = F.translate("source_url", UPPER, LOWER)
    fetched = F.flatten(F.transform(F.array_intersect(url_tokens(F.col("source_url")), keys), lambda t: F.element_at(filed, t)))
    hits = F.filter(fetched, lambda p: F.regexp_like(low, p["pattern"]))
    found = F.when(F.col("source_url").isNotNull(), F.array_min(hits))
    judged = out.withColumn("_found", F.when(F.col("rule").isNull(), found)).withColumns(
        {"pattern": F.col("_found.pattern"), "verdict": F.coalesce(ruled, F.col("_found.verdict"), F.lit(default))}
    )
    return unpacked(judged, candidates.columns, added, source_url="source_url")

"""Search of the library index by many queries at once.

A query token hits a record when it is part of the record's text.  Tokens hold
no separators, so every occurrence lies inside one separator-free piece of the
text.  That gives an exact plan without a cross join: distinct pieces and
distinct tokens meet on a short gram, the hits are carried back to records by
piece, and counts are combined per (query, record) before they are shuffled.

Most records that share a token with a query cannot be among its best.  A few records that hold its rarest tokens are
scored first; the k-th best of them is a score to beat.  The frequent tokens and filters that cannot
reach it together, even on the best of records, name no candidates; the others do, and of these only the pairs whose bound
still reaches it are scored.  Nothing is left out for being frequent, and the result is that of scoring every pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.infer import format_family, format_matches
from ..functions.match import compact
from ..functions.text import blank_to_null, parts_of, text_blob, tokens, words
from ..session import written
from .grouping import top_k

RECORD_FIELDS = [
    "title", "format", "resource_type", "source_url", "library_file", "stage_or_age", "grade_or_phase",
    "domain_or_subject", "topic_or_type", "source_or_version",
]
# Filter, class field it is looked for in, points, reason.
FIELD_POINTS = [
    ("stage", "stage_or_age", 8, "学段或适龄匹配"),
    ("grade", "grade_or_phase", 8, "年级或阶段匹配"),
    ("subject", "domain_or_subject", 12, "学科匹配"),
    ("learning_domain", "domain_or_subject", 10, "学习领域匹配"),
    ("core_topic", "topic_or_type", 16, "主题匹配"),
    ("topic", "topic_or_type", 16, "主题匹配"),
]


def record_text(index: DataFrame) -> Column:
    return text_blob(*[f for f in RECORD_FIELDS if f in index.columns])


def _grams(value: Column) -> Column:
    """Distinct parts of one, two, three and five characters."""
    return F.array_distinct(F.concat(*[parts_of(value, n) for n in (1, 2, 3, 5)]))


def _anchor(value: Column) -> Column:
    """The first five characters of a needle, or what it has up to three."""
    return F.when(F.length(value) >= 5, F.substring(value, 1, 5)).otherwise(F.substring(value, 1, 3))


def containment_pairs(pieces: DataFrame, piece: str, needles: DataFrame, needle: str) -> DataFrame:
    """(piece, needle) for every distinct needle that is part of a distinct piece."""
    left = pieces.select(piece).distinct().withColumn("_gram", F.explode(_grams(F.col(piece))))
    right = needles.select(needle).distinct().withColumn("_gram", _anchor(F.col(needle)))
    met = left.join(right, "_gram").where(F.contains(F.col(piece), F.col(needle)))
    return met.select(piece, needle)


def term_hits(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, term) for every term that is part of the text: the join form of
    ``functions.match.hits`` for term tables too large for literals.  Terms must
    hold no separators."""
    pieces = df.select(key, F.explode(words(text)).alias("_piece"))
    pairs = containment_pairs(pieces, "_piece", terms, term)
    return _carry(pieces, pairs, "_piece").select(key, term).distinct()


def _carry(pieces: DataFrame, pairs: DataFrame, piece: str) -> DataFrame:
    """Join hits back to records by piece.

    A piece that most records hold makes a skewed join.  Both sides come
    straight from a shuffle and the next step shuffles again, so adaptive
    execution may cut the hot partition of ``pieces`` into many tasks; salting
    here would instead repeat the whole hit table for every salt.
    """
    return pieces.join(pairs, piece)


def token_counts(records: DataFrame, queries: DataFrame, key: str = "ordinal", text: str = "_blob", query: str = "query") -> DataFrame:
    """(query_id, key, hits) for pairs with at least one hit."""
    asked = queries.select("query_id", F.explode(tokens(query)).alias("token"))
    pieces = records.select(key, F.explode(words(text)).alias("_piece"))
    pairs = containment_pairs(pieces, "_piece", asked, "token")
    return _hits(pieces, pairs, asked, key)


def _hits(pieces: DataFrame, pairs: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(query_id, key, hits): how many of a query's ``asked`` tokens a record holds, where it holds any."""
    found = _carry(pieces, pairs.join(asked.select("token").distinct(), "token", "left_semi"), "_piece").select(key, "token").distinct()
    return found.join(asked, "token").groupBy("query_id", key).agg(F.count(F.lit(1)).alias("hits"))


def _listed(queries: DataFrame, name: str) -> Column:
    return F.col(name) if name in queries.columns else F.lit(None).cast("array<string>")


def thousandths(
    hits: Column, n_tokens: Column, points: Column, confidence: Column, file_exists: Column, needs_review: Column
) -> Column:
    """Match score in whole thousandths, rounded half up, at least zero."""
    total = _share(hits, n_tokens) + points * 1000 + _static(confidence, file_exists, needs_review)
    return F.greatest(total, F.lit(0)).cast("bigint")


def _static(confidence: Column, file_exists: Column, needs_review: Column) -> Column:
    """What a record adds to its score for every query, in thousandths; ``MOST_STATIC`` at most."""
    sure = F.round(F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(1.0)).cast("decimal(9,6)") * 8000, 0).cast("bigint")
    there = F.when(file_exists, 6000).otherwise(0)
    return sure + there - F.when(F.coalesce(needs_review, F.lit(False)), 4000).otherwise(0)


def _judged(pairs: DataFrame) -> DataFrame:
    """Pairs with what they hit and their score in thousandths, ``_raw``; columns that a caller leaves out cost nothing."""
    blob = record_text(pairs)
    none = F.array().cast("array<string>")
    based = let(pairs, {"_blob": blob, "_tokens": tokens("query")})
    hit = F.filter("_tokens", lambda t: F.contains(F.col("_blob"), t))
    points, reasons, asked = F.lit(0), [], F.lit(False)
    for name, field, value, text in FIELD_POINTS:
        if name not in pairs.columns:
            continue
        wanted = blank_to_null(F.lower(F.col(name).cast("string")))
        test = F.coalesce(F.contains(F.lower(F.coalesce(field, F.lit(""))), wanted), F.lit(False))
        points = points + F.when(test, value).otherwise(0)
        reasons.append(F.when(test, F.lit(text)))
        asked = asked | wanted.isNotNull()
    types = F.transform(F.coalesce(_listed(pairs, "resource_types"), none), lambda v: F.lower(v))
    kind = F.lower(F.coalesce("resource_type", F.lit("")))
    type_hit = F.exists(types, lambda v: F.contains(kind, v) | F.contains(F.col("_blob"), v))
    formats = F.coalesce(_listed(pairs, "format_preferences"), none)
    format_hit = F.exists(formats, lambda v: format_matches(v, F.col("format")))
    asked = asked | (F.size(types) > 0) | (F.size(formats) > 0) | (F.size("_tokens") > 0)
    based = let(based, {"_hit": hit, "_type": type_hit, "_format": format_hit})
    points = points + F.when(F.col("_type"), 10).otherwise(0) + F.when(F.col("_format"), 8).otherwise(0)
    listed = F.concat(
        compact(
            [F.when(F.size("_hit") > 0, F.concat(F.lit("查询词命中："), F.array_join("_hit", ", ")))]
            + reasons
            + [F.when(F.col("_type"), F.lit("资源类型匹配")), F.when(F.col("_format"), F.lit("格式偏好匹配"))]
        )
    )
    told = based.withColumns({"_reasons": F.array_distinct(listed), "_asked": asked})
    exists = F.coalesce("file_exists", F.lit(False))
    review = F.coalesce("needs_review", F.lit(False))
    raw = thousandths(F.size("_hit"), F.size("_tokens"), points, F.col("classification_confidence"), exists, review)
    any_field = F.greatest(*[F.coalesce(r.isNotNull(), F.lit(False)) for r in reasons], F.lit(False), F.lit(False))
    met = (F.size("_hit") > 0) | any_field | F.coalesce("_type", F.lit(False)) | F.coalesce("_format", F.lit(False))
    return told.withColumns({"_raw": raw, "_met": met, "_misfit": (F.size(formats) > 0) & ~F.col("_format"), "_exists": exists, "_review": review})


def score_index(pairs: DataFrame) -> DataFrame:
    """Score of given (record, query) pairs in one projection.

    Pairs without any hit score zero and carry no reasons, as do pairs of a
    query that asks for something the record lacks.
    """
    told = _judged(pairs)
    none = F.array().cast("array<string>")
    counts = ~F.col("_asked") | F.col("_met")
    warnings = compact(
        [
            F.when(F.col("_misfit"), F.lit("格式与偏好不完全匹配")),
            F.when(counts & ~F.col("_exists"), F.lit("本地文件不存在")),
            F.when(counts & F.col("_review"), F.lit("资源分类需要复核")),
        ]
    )
    out = told.withColumns(
        {
            "match_score": F.when(counts, F.col("_raw")).otherwise(F.lit(0)) / F.lit(1000.0),
            "match_reasons": F.when(counts, F.col("_reasons")).otherwise(none),
            "match_warnings": warnings,
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


#: The most that a record's own fields add to a score, in thousandths: confidence and an existing file.
MOST_STATIC = 14_000
#: Records looked at per wanted result for a score to beat, and rows of the rarest tokens that name them.
PROBE, PROBE_ROWS = 8, 64


def _share(hits: Column, n_tokens: Column) -> Column:
    return F.when(n_tokens > 0, F.floor((hits * 80000 + n_tokens) / (n_tokens * 2))).otherwise(F.lit(0))


def _field_features(index: DataFrame, queries: DataFrame) -> list[tuple[str, Column, int]]:
    """(name, whether the query asks for it, points) of the filters that both tables know."""
    out = []
    for name, field, value, _ in FIELD_POINTS:
        if name in queries.columns and field in index.columns:
            out.append((name, blank_to_null(F.lower(F.col(name).cast("string"))).isNotNull(), value))
    for name, value in (("resource_types", 10), ("format_preferences", 8)):
        if name in queries.columns:
            out.append((name, F.coalesce(F.size(name), F.lit(0)) > 0, value))
    return out


def _feature_hits(blobbed: DataFrame, queries: DataFrame, name: str, key: str) -> DataFrame:
    """(query_id, key, hits, points) where a record has what the query's filter of this name asks for."""
    if name == "resource_types":
        wanted = queries.select("query_id", F.explode(name).alias("_want")).select("query_id", F.lower("_want").alias("_want"))
        return _field_hits(blobbed, wanted, F.concat_ws(" ", F.lower("resource_type"), "_blob"), key, 10, in_words=True)
    if name == "format_preferences":
        named = queries.select("query_id", F.explode(name).alias("_name"))
        wanted = named.select("query_id", F.explode(format_family(F.col("_name"))).alias("_want"))
        return _field_hits(blobbed, wanted, F.replace(F.lower("format"), F.lit("/"), F.lit("")), key, 8, in_words=True)
    field, value = next((f, v) for n, f, v, _ in FIELD_POINTS if n == name)
    wanted = queries.select("query_id", blank_to_null(F.lower(F.col(name).cast("string"))).alias("_want")).where("_want is not null")
    return _field_hits(blobbed, wanted, F.lower(field), key, value)


def _exact(pairs: DataFrame, index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Score in thousandths (``_t``) and hits of chosen pairs, each record read once per pair."""
    # pairs are few bytes and much work: by their size alone adaptive execution would put them in few tasks
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select("query_id", key).repartition(parts, key).join(index, key).join(queries, "query_id")
    met = _judged(rows).where("_met")
    return met.select("query_id", key, F.col("_raw").alias("_t"), F.size("_hit").cast("bigint").alias("hits"), F.size("_tokens").alias("n_tokens"))


def search_candidates(index: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.001, key: str = "ordinal") -> DataFrame:
    """(query_id, key) pairs that may be among the best ``k`` of their query, and none of the best is missing.

    Written tables: distinct pieces with their numbers of records, the (piece, token) hits, and the score to beat per query.
    """
    least = int(round(min_score * 1000))
    blobbed = index.withColumn("_blob", record_text(index))
    asked = written(queries.select("query_id", F.explode(tokens("query")).alias("token")))
    pieces = blobbed.select(key, F.explode(words("_blob")).alias("_piece"))
    held = written(pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_records")))
    pairs = written(containment_pairs(held, "_piece", asked, "token"))
    # at least as many records as hold the token; it only decides the order in which tokens are taken
    spread = pairs.join(held, "_piece").groupBy("token").agg(F.sum("_records").alias("_spread"))
    rare_first = Window.partitionBy("query_id").orderBy(F.coalesce("_spread", F.lit(0)), "token")
    order = written(
        asked.join(spread, "token", "left").select(
            "query_id",
            "token",
            F.row_number().over(rare_first).alias("_place"),
            F.coalesce(F.sum("_spread").over(rare_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)).alias("_upto"),
        )
    )
    probes = order.where((F.col("_place") == 1) | (F.col("_upto") <= PROBE_ROWS * k))
    near = top_k(_hits(pieces, pairs, probes, key), ["query_id"], [F.desc("hits"), F.col(key)], PROBE * k)
    seen = top_k(_exact(near, index, queries, key), ["query_id"], [F.desc("_t"), F.col(key)], k, "_n")
    beaten = seen.where((F.col("_n") == k) & (F.col("_t") > least)).select("query_id", F.col("_t").alias("_beat"))
    # filters that hit many records are left to the bound first, as far as they fit; then the most frequent tokens
    features = _field_features(index, queries)
    base = queries.select("*", F.size(tokens("query")).alias("n_tokens")).join(beaten, "query_id", "left")
    base = let(base, {"_beat": F.coalesce("_beat", F.lit(least)).cast("bigint")})
    room, passed, essential = F.col("_beat") - MOST_STATIC, F.lit(0), {}
    for name, wants, value in features:
        fits = wants & (room > (passed + value) * 1000)
        essential[name] = wants & ~fits
        passed = passed + F.when(fits, value).otherwise(0)
    plan = let(base, {"_passed": passed, **{f"_e_{n}": e for n, e in essential.items()}})
    below = F.filter(F.sequence(F.lit(0), F.col("n_tokens")), lambda c: _share(c, F.col("n_tokens")) < F.col("_beat") - MOST_STATIC - F.col("_passed") * 1000)
    plan = written(let(plan, {"_left": F.greatest(F.size(below) - 1, F.lit(0))}))
    chosen = order.join(plan.select("query_id", "n_tokens", "_left"), "query_id").where(F.col("_place") <= F.col("n_tokens") - F.col("_left"))
    sources = [_hits(pieces, pairs, chosen.select("query_id", "token"), key).select("query_id", key, "hits", F.lit(0).alias("points"))]
    for name, _, _ in features:
        wanting = plan.where(f"_e_{name}")
        if not wanting.isEmpty():
            sources.append(_feature_hits(blobbed, wanting.select(*queries.columns), name, key))
    met = reduce(lambda a, b: a.unionByName(b), sources)
    summed = met.groupBy("query_id", key).agg(F.sum("hits").alias("hits"), F.sum("points").alias("points"))
    bounded = summed.join(plan.select("query_id", "n_tokens", "_left", "_passed", "_beat"), "query_id")
    gained = _share(F.col("hits") + F.col("_left"), F.col("n_tokens")) + (F.col("points") + F.col("_passed")) * 1000
    own = index.select(key, _static(F.col("classification_confidence"), F.col("file_exists"), F.col("needs_review")).alias("_own"))
    reaching = bounded.withColumn("_gained", gained).where(F.col("_gained") + MOST_STATIC >= F.col("_beat"))
    return reaching.join(own, key).where(F.col("_gained") + F.col("_own") >= F.col("_beat")).select("query_id", key)


def search_index(
    index: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.001, key: str = "ordinal"
) -> DataFrame:
    """Best ``k`` records per query.

    ``queries`` has ``query_id``, ``query`` and any of the filter columns.  Only the pairs of ``search_candidates`` are
    scored; the rank is that of scoring every pair.
    """
    pairs = written(search_candidates(index, queries, k, min_score, key))
    scored = _exact(pairs, index, queries, key).where(F.col("_t") >= int(round(min_score * 1000)))
    best = top_k(scored, ["query_id"], [F.desc("_t"), F.col(key)], k)
    return best.select("query_id", key, "rank", (F.col("_t") / F.lit(1000.0)).alias("match_score"), "hits", "n_tokens")


def explain_matches(best: DataFrame, index: DataFrame, queries: DataFrame, key: str = "ordinal") -> DataFrame:
    """Records, reasons and warnings of found pairs (at most ``k`` per query)."""
    rows = best.select("query_id", key, "rank").join(index, key).join(queries, "query_id")
    return score_index(rows)


def _field_hits(index: DataFrame, wanted: DataFrame, field: Column, key: str, points: int, in_words: bool = False) -> DataFrame:
    """(query_id, key) pairs whose field holds the wanted value, each pair once.

    Values meet on the distinct field values and return to the records by field
    value.  ``in_words`` does so by the pieces of a long text: a wanted phrase of
    several pieces is found by its first one and then looked for in the text.
    """
    valued = index.select(key, field.alias("_field"))
    if not in_words:
        pairs = containment_pairs(valued.where("_field <> ''"), "_field", wanted, "_want")
        named = pairs.join(wanted, "_want").select("_field", "query_id").distinct()
        found = valued.join(named, "_field").select("query_id", key)
    else:
        asked = wanted.where("_want <> ''").distinct().withColumn("_first", F.coalesce(F.get(words("_want"), F.lit(0)), F.col("_want")))
        pieces = valued.select(key, F.explode(words("_field")).alias("_piece"))
        pairs = containment_pairs(pieces, "_piece", asked, "_first")
        named = pairs.join(asked, "_first").select("_piece", "query_id", "_want", (F.col("_first") == F.col("_want")).alias("_whole"))
        met = _carry(pieces, named, "_piece").select("query_id", key, "_want", "_whole").distinct()
        phrases = met.where("not _whole").join(valued, key).where(F.contains("_field", F.col("_want")))
        found = met.where("_whole").select("query_id", key).unionByName(phrases.select("query_id", key)).distinct()
    return found.select("query_id", key, F.lit(0).cast("bigint").alias("hits"), F.lit(points).alias("points"))

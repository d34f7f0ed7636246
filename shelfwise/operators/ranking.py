"""Explainable ranking of candidates against requests, and the short list.

Scores are whole hundredths inside, so sums never depend on binary rounding;
they are published as doubles.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.columns import let
from ..functions.match import any_of, compact, constant, contains_any, hits, holds, lower_list
from ..functions.text import blank_to_null, grade_to_chinese, text_blob
from ..session import written
from .filters import is_visible
from .grouping import ranked, top_k, with_group_value

BLOB_FIELDS = [
    "title", "source_name", "resource_type", "format", "stage", "grade", "subject", "learning_domain", "topic",
    "version", "volume", "provider",
]
TEXT_SLOTS = ["core_topic", "subject", "learning_domain", "version", "volume", "grade", "stage", "resource_goal"]
LIST_SLOTS = ["resource_types", "subtopics", "format_preferences", "constraints", "prefer", "avoid"]
DIMENSIONS = [
    "relevance", "age_fit", "authority", "accessibility", "format_fit", "safety", "metadata_quality",
    "content_evidence", "preference_fit",
]
INTENT = T.StructType(
    [T.StructField("intent_id", T.StringType())]
    + [T.StructField(s, T.StringType()) for s in TEXT_SLOTS]
    + [T.StructField("learner_age", T.IntegerType())]
    + [T.StructField(s, T.ArrayType(T.StringType())) for s in LIST_SLOTS]
)


def intents_from_rows(spark, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """A few requests as a table with every slot; its size is known to the planner."""
    text = json.dumps([{f.name: r.get(f.name) for f in INTENT.fields} for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(INTENT))))


def complete_intents(intents: DataFrame) -> DataFrame:
    """Every slot present, missing ones null."""
    cols = []
    for field in INTENT.fields:
        if field.name in intents.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return intents.select(*cols)


def pair(candidates: DataFrame, intents: DataFrame | Sequence[Mapping[str, object]]) -> DataFrame:
    """Candidates with the request they were found for as the struct ``intent``.

    They are joined on ``intent_id``, null meeting null and hot requests spread
    over salts; a candidate whose request is unknown stays, with an empty
    request.  Candidates without ``intent_id`` all belong to one request, given
    as a list of one.
    """
    if "intent_id" not in candidates.columns:
        if isinstance(intents, DataFrame) or len(intents) != 1:
            raise ValueError("candidates of several requests need intent_id, as search and source_first give it")
        row = {f.name: intents[0].get(f.name) for f in INTENT.fields}
        only = F.from_json(F.lit(json.dumps(row, ensure_ascii=False)), INTENT)
        return candidates.withColumn("intent", only).withColumn("intent_id", F.col("intent.intent_id"))
    table = intents if isinstance(intents, DataFrame) else intents_from_rows(candidates.sparkSession, intents)
    slots = complete_intents(table)
    flat = slots.select("intent_id", *[F.col(c).alias(f"_slot_{c}") for c in slots.columns])
    joined = with_group_value(candidates, flat, ["intent_id"])
    names = [f"_slot_{c}" for c in slots.columns]
    return joined.withColumn("intent", F.struct(*[F.col(n).alias(n[6:]) for n in names])).drop(*names)


def _low(column: Column | str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(value)), F.lit(""))


def _add(points: list[tuple[Column, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(test, value).otherwise(0) for test, value in points], F.lit(0))


def _reader(df: DataFrame):
    """(field, analysed): columns and analysis fields of candidates, null where absent."""

    def field(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def analysed(name: str, kind: str) -> Column:
        names = df.schema["analysis"].dataType.names if "analysis" in df.columns else []
        return F.col(f"analysis.{name}") if name in names else F.lit(None).cast(kind)

    return field, analysed


def prepare(
    candidates: DataFrame,
    suspicious: Sequence[str] = L.SUSPICIOUS_TERMS,
    trust: Sequence[str] = L.TRUST_TERMS,
    alarms: Sequence[str] = L.ANALYSIS_ALARM_TERMS,
) -> DataFrame:
    """What does not depend on a request, found once per candidate before it is
    paired: the lower-case text, its risks and signs of trust."""
    field, analysed = _reader(candidates)
    none = F.array().cast("array<string>")
    blob = text_blob(
        *[f for f in BLOB_FIELDS if f in candidates.columns],
        analysed("text_sample", "string"),
        F.array_join(F.coalesce(analysed("keywords", "array<string>"), none), " "),
    )
    base = let(
        candidates,
        {
            "_blob": blob,
            "_fmt": F.coalesce(blank_to_null(F.lower(field("format"))), _low(field("resource_type"))),
            "_title": _low(field("title")),
            "_link": _low(field("source_url")),
        },
    )
    noted = F.coalesce(analysed("warnings", "array<string>"), none)
    alarming = F.filter(noted, lambda w: (w != "") & contains_any(w, [*suspicious, *alarms]))
    # a term that starts in the text and ends in the link is none: both are searched
    found = F.array_union(hits("_blob", [t.lower() for t in suspicious]), hits("_link", [t.lower() for t in suspicious]))
    ordered = F.filter(constant([t.lower() for t in dict.fromkeys(suspicious)]), lambda t: F.array_contains(found, t))
    risks = F.transform(ordered, lambda t: F.concat(F.lit("包含风险词："), t))
    return let(
        base,
        {
            "_risks": F.array_distinct(F.concat(risks, alarming)),
            "_trusted": contains_any("_blob", [t.lower() for t in trust]),
        },
    )


def score(
    pairs: DataFrame,
    *,
    suspicious: Sequence[str] = L.SUSPICIOUS_TERMS,
    trust: Sequence[str] = L.TRUST_TERMS,
    alarms: Sequence[str] = L.ANALYSIS_ALARM_TERMS,
    printable: Sequence[str] = ("可打印", "适合打印"),
    goals: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Nine scores, their sum in [0, 100], level, recommendation, reasons and warnings.

    ``pairs`` comes from ``pair``.  ``weights`` are off by default; when given
    they are normalized to one and scale each of the seven capped dimensions.
    """
    goals = goals or {"practice": "练习", "listen": "听赏"}
    types = types or {"textbook": "教材", "practice": "习题", "audio": "音频", "video": "视频"}
    if "_risks" not in pairs.columns:
        pairs = prepare(pairs, suspicious, trust, alarms)
    field, analysed = _reader(pairs)
    slot = {s: _low(f"intent.{s}") for s in TEXT_SLOTS}
    base = let(
        pairs,
        {f"_s_{s}": c for s, c in slot.items() if s != "grade"}
        | {"_s_grade": F.lower(grade_to_chinese(F.coalesce(F.col("intent.grade"), F.lit(""))))}
        | {f"_l_{s}": lower_list(F.col(f"intent.{s}")) for s in LIST_SLOTS},
    )
    text, fmt = F.col("_blob"), F.col("_fmt")
    s = {n: F.col(f"_s_{n}") for n in TEXT_SLOTS}
    lists = {n: F.col(f"_l_{n}") for n in LIST_SLOTS}
    raw = {n: F.col(f"intent.{n}") for n in TEXT_SLOTS}

    # what is found, each test evaluated once per row
    topic = s["core_topic"]
    topic_hit = holds(text, topic)
    parts = F.array_remove(F.split(topic, r"[\s、,，/]+"), "")
    wanted_subject = F.when(s["subject"] != "", s["subject"]).otherwise(s["learning_domain"])
    textbook = (F.size(lists["resource_types"]) == 0) & (_low(field("resource_type")) == types["textbook"].lower())
    wanted_types = F.when(textbook, F.array(F.lit(types["textbook"].lower()))).otherwise(lists["resource_types"])
    grade, stage = s["grade"], s["stage"]
    age = F.col("intent.learner_age")
    asks_age = age.isNotNull() & (grade == "") & (stage == "")
    digits = F.regexp_extract_all("_title", F.lit(r"\d+"), F.lit(0))
    asked = lists["format_preferences"]
    asks = F.size(asked) > 0
    plain = F.replace(fmt, F.lit("/"), F.lit(""))
    print_words = [p.lower() for p in printable]
    wants_print = (
        F.exists(lists["constraints"], lambda c: c.isin(print_words))
        | F.array_contains(lists["prefer"], print_words[0])
        | F.contains(text, F.lit(print_words[0]))
        | F.contains(s["resource_goal"], F.lit(goals["practice"].lower()))
    )
    wants_audio = F.contains(s["resource_goal"], F.lit(goals["listen"].lower())) | F.array_contains(
        lists["resource_types"], types["audio"].lower()
    )

    def in_either(value: Column) -> Column:
        return (value != "") & (F.contains(text, value) | F.contains(F.col("_link"), value))

    tests = {
        "topic": topic_hit,
        "part": ~topic_hit & (topic != "") & F.exists(parts, lambda p: F.contains(text, p)),
        "subject": holds(text, wanted_subject),
        "type": any_of(wanted_types, text),
        "subtopic": any_of(lists["subtopics"], text),
        "version": holds(text, s["version"]),
        "volume": holds(text, s["volume"]),
        "grade": holds(text, grade),
        "stage": holds(text, stage),
        "age": asks_age & F.coalesce(F.array_contains(digits, age.cast("string")), F.lit(False)),
        "trusted": F.col("_trusted"),
        "fits": F.exists(asked, lambda p: F.contains(plain, F.replace(p, F.lit("/"), F.lit("")))),
        "named_type": F.exists(lists["resource_types"], lambda t: F.contains(text, t)),
        "printable": wants_print & fmt.isin(L.PRINTABLE_FORMATS),
        "audio": wants_audio & fmt.isin(L.AUDIO_FORMATS),
        "video": F.array_contains(lists["resource_types"], types["video"].lower()) & fmt.isin(L.VIDEO_FORMATS),
        "official": F.coalesce(field("official").cast("boolean"), F.lit(False)),
        "loadable": F.coalesce(field("downloadable").cast("boolean"), F.lit(False)),
        "linked": blank_to_null(field("source_url")).isNotNull(),
        "walled": F.coalesce(field("requires_auth").cast("boolean"), F.lit(False)),
    }
    staged = let(
        base,
        {f"_t_{n}": c for n, c in tests.items()}
        | {"_preferred": F.filter(lists["prefer"], in_either), "_avoided": F.filter(lists["avoid"], in_either)},
    )
    t = {n: F.col(f"_t_{n}") for n in tests}
    linked = ~t["loadable"] & t["linked"]
    named_format = ~asks & (fmt != "")
    n_risks = F.size("_risks")

    # points
    relevance = F.least(
        _add(
            [
                (t["topic"], 12), (t["part"], 7), (t["subject"], 7), (t["type"], 7), (t["subtopic"], 4),
                (t["version"], 3), (t["volume"], 2),
            ]
        ),
        F.lit(L.SCORE_CAPS["relevance"]),
    )
    age_fit = F.least(F.lit(8) + _add([(t["grade"], 8), (t["stage"], 4), (t["age"], 8)]), F.lit(L.SCORE_CAPS["age_fit"]))
    authority = F.least(F.lit(4) + _add([(t["official"], 8), (t["trusted"], 3)]), F.lit(15))
    accessibility = F.least(_add([(t["loadable"], 6), (linked, 3), (t["walled"], 1), (~t["walled"], 4)]), F.lit(10))
    format_fit = F.least(
        F.lit(3)
        + _add(
            [
                (asks & t["fits"], 5), (named_format, 4), (t["named_type"], 2), (t["printable"], 2), (t["audio"], 2),
                (t["video"], 2),
            ]
        ),
        F.lit(10),
    )
    safety = F.greatest(F.lit(10) - n_risks * 4, F.lit(0))
    # metadata, in hundredths
    def cents_of(conf: Column) -> Column:
        return F.round(conf.cast("decimal(10,6)") * 500, 0).cast("int")

    filled = _add([(blank_to_null(field(n)).isNotNull(), 1) for n in ("title", "source_name", "resource_type", "format", "subject", "topic")])
    share = F.floor((filled * 1000 + 6) / 12).cast("int")
    own = F.coalesce(cents_of(field("metadata_confidence")), share)
    metadata = F.greatest(own, F.coalesce(cents_of(analysed("analysis_confidence", "double")), F.lit(0)))
    # evidence
    level = analysed("evidence_level", "string")
    has_pages = F.coalesce(analysed("page_count", "int"), F.lit(0)) > 0
    has_time = F.coalesce(analysed("duration_seconds", "double"), F.lit(0.0)) > 0
    evidence = F.when(level == "strong", 5).when(level == "basic", 3).when(has_pages | has_time, 2).otherwise(0)
    thin = (
        F.array_contains(lists["resource_types"], types["practice"].lower())
        | (s["resource_goal"] == goals["practice"].lower())
    ) & (F.coalesce(analysed("text_length", "bigint"), F.lit(0)) < 40) & ~has_pages
    # preference, in hundredths
    staged = let(staged, {"_metadata": metadata})
    preference = F.greatest(
        F.least(F.size("_preferred") * 150 - F.size("_avoided") * 300, F.lit(500)), F.lit(-800)
    )
    cents = {
        "relevance": relevance * 100,
        "age_fit": age_fit * 100,
        "authority": authority * 100,
        "accessibility": accessibility * 100,
        "format_fit": format_fit * 100,
        "safety": safety * 100,
        "metadata_quality": F.col("_metadata"),
        "content_evidence": evidence * 100,
        "preference_fit": preference,
    }
    if weights:
        total = sum(weights.get(n, 0.0) for n in L.SCORE_CAPS)
        for name, cap in L.SCORE_CAPS.items():
            factor = weights.get(name, 0.0) / total * 100 / cap
            cents[name] = F.round(cents[name] * F.lit(f"{factor:.8f}").cast("decimal(12,8)"), 0).cast("int")
    scored = let(staged, {f"_c_{n}": c.cast("int") for n, c in cents.items()})
    total_cents = F.least(F.greatest(reduce(lambda a, b: a + b, [F.col(f"_c_{n}") for n in DIMENSIONS]), F.lit(0)), F.lit(10000))

    def told(test: Column, text_: str, value: Column | None = None) -> Column:
        shown = F.lit(text_) if value is None else F.concat(F.lit(text_), value)
        return F.when(test, shown)

    subject_text = F.coalesce(blank_to_null(raw["subject"]), raw["learning_domain"])
    meta = F.col("_metadata")
    reasons = F.concat(
        compact(
            [
                F.when(t["topic"], F.concat(F.lit("主题与"), raw["core_topic"], F.lit("匹配"))),
                told(t["part"], "标题或元数据包含部分主题词"),
                told(t["subject"], "领域或学科匹配", subject_text),
                told(t["type"], "资源类型符合需求"),
                told(t["subtopic"], "子主题匹配"),
                told(t["version"], "版本匹配", raw["version"]),
                told(t["volume"], "册次匹配", raw["volume"]),
                told(t["grade"], "年级匹配", raw["grade"]),
                told(t["stage"], "阶段匹配", raw["stage"]),
                F.when(t["age"], F.concat(F.lit("年龄匹配"), age.cast("string"), F.lit("岁"))),
                told(t["official"], "官方来源"),
                told(t["trusted"], "来源具备较高可信度"),
                told(t["loadable"], "资源可下载"),
                told(linked, "资源可访问"),
                told(asks & t["fits"], "文件格式符合偏好"),
                told(named_format, "候选资源格式明确"),
                told(t["printable"], "格式适合打印或练习使用"),
                told(t["audio"], "格式适合听赏"),
                told(t["video"], "格式适合视频学习"),
                told(n_risks == 0, "未发现明显儿童内容风险"),
                told(meta >= 400, "元数据较完整"),
                F.when(level == "strong", F.lit("已提取到较充分内容证据"))
                .when(level == "basic", F.lit("已提取到基础内容证据"))
                .when(has_pages | has_time, F.lit("具备页数或时长等基础证据")),
            ]
        ),
        F.transform("_preferred", lambda v: F.concat(F.lit("符合偏好："), v)),
    )
    warnings = F.concat(
        compact(
            [
                told(~t["grade"] & (grade != ""), "候选资源未明确匹配目标年级"),
                told(asks_age & ~t["age"], "候选资源未明确标注适用年龄"),
                told(~t["loadable"] & ~linked, "缺少可访问链接"),
                told(t["walled"], "需要登录或授权访问"),
                told(asks & ~t["fits"], "格式与用户偏好不完全匹配"),
            ]
        ),
        F.col("_risks"),
        compact(
            [
                told(meta < 300, "候选资源元数据不完整"),
                told(evidence == 0, "缺少可验证的资源内容证据"),
                told(thin, "练习类资源缺少题目文本或页数证据"),
            ]
        ),
        F.transform("_avoided", lambda v: F.concat(F.lit("命中需避免项："), v)),
    )
    levelled = let(scored, {"_total": total_cents})
    quality = F
    for name, least in L.QUALITY_LEVELS[:-1]:
        quality = quality.when(F.col("_total") >= least * 100, name)
    out = let(levelled, {"quality_level": quality.otherwise("reject")})
    advice = F
    for name, text_ in L.RECOMMENDATION.items():
        advice = advice.when(F.col("quality_level") == name, text_)
    out = out.withColumns(
        {
            "final_score": F.col("_total") / F.lit(100.0),
            "recommendation": advice,
            "score_breakdown": F.struct(*[(F.col(f"_c_{n}") / F.lit(100.0)).alias(n) for n in DIMENSIONS]),
            "reasons": reasons,
            "warnings": warnings,
        }
    )
    return out.drop("intent", *[c for c in out.columns if c.startswith("_")])


def rank(candidates: DataFrame, intents: DataFrame | Sequence[Mapping[str, object]], ordinal: str = "ordinal", **options) -> DataFrame:
    """Every candidate scored; rejected ones have no rank and no row is lost."""
    return rank_scored(score_for(candidates, intents, **options), ordinal)


def score_for(candidates: DataFrame, intents: DataFrame | Sequence[Mapping[str, object]], **options) -> DataFrame:
    """Scores of candidates for requests; what a request does not change is found before pairing."""
    first = {k: options[k] for k in ("suspicious", "trust", "alarms") if k in options}
    return score(pair(prepare(candidates, **first), intents), **options)


def rank_scored(scored: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rank 1..n over the rows of each request that are not rejected.

    Scores are written once; the ranks then read their narrow columns."""
    flagged = written(scored.withColumn("_visible", F.col("quality_level") != "reject"))
    placed = ranked(flagged, ["intent_id", "_visible"], "final_score", ordinal, "rank")
    return placed.withColumn("rank", F.when(F.col("_visible"), F.col("rank"))).drop("_visible")


def partition_ranked(ranked_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visible and rejected rows; together they are the input."""
    rejected = F.col("quality_level") == "reject"
    return ranked_rows.where(~rejected), ranked_rows.where(rejected)


def summary_text() -> Column:
    """Short text of an option from its flags and fields."""
    level = F.concat(F.coalesce("stage", F.lit("")), F.coalesce("grade", F.lit("")))
    parts = compact(
        [
            F.when(F.col("official"), F.lit("官方来源")),
            F.when(level != "", F.concat(F.lit("适配"), level)),
            F.when(blank_to_null("subject").isNotNull(), F.concat(F.lit("学科为"), F.col("subject"))),
            F.when(blank_to_null("version").isNotNull(), F.concat(F.lit("版本为"), F.col("version"))),
            F.when(blank_to_null("volume").isNotNull(), F.concat(F.lit("册次为"), F.col("volume"))),
        ]
    )
    chosen = F.when(F.size(parts) > 0, parts).otherwise(F.slice("reasons", 1, 2))
    return F.coalesce(blank_to_null(F.array_join(chosen, "，")), F.lit("候选资源信息较完整，可作为备选查看"))


def display_url(source: Column, detail_page: Column, source_url: Column, only: str | None = L.SITE_SOURCE) -> Column:
    """The stable page of one source's resources, else the file URL."""
    fits = F.regexp_like(detail_page, F.lit("^https?://"))
    if only is not None:
        fits = fits & (source == only)
    return F.when(fits, detail_page).otherwise(source_url)


def select_options(scored: DataFrame, k: int = 5, include_low: bool = False, ordinal: str = "ordinal") -> DataFrame:
    """Best ``k`` visible options per request, numbered from one.

    Levels follow the score, so the options are the best ``k`` rows of a request:
    a group limit that never gathers the rest of a hot request."""
    have = scored.columns
    for name in ("stage", "grade", "subject", "version", "volume", "detail_page", "source", "source_name", "provider", "resource_id"):
        if name not in have:
            scored = scored.withColumn(name, F.lit(None).cast("string"))
    for name in ("downloadable", "requires_auth", "official"):
        value = F.col(name) if name in have else F.lit(False)
        scored = scored.withColumn(name, F.coalesce(value.cast("boolean"), F.lit(False)))
    shown = scored.where(is_visible("quality_level", include_low))
    best = top_k(shown, ["intent_id"], [F.desc("final_score"), F.col(ordinal)], k, "option_no")
    return best.select(
        "intent_id",
        ordinal,
        F.col("option_no").cast("string").alias("option_id"),
        F.col("option_no").cast("bigint").alias("rank"),
        F.coalesce(blank_to_null("title"), F.lit("未命名资源")).alias("title"),
        F.coalesce(blank_to_null("source_name"), blank_to_null("provider"), F.lit("")).alias("source_name"),
        display_url(F.col("source"), F.col("detail_page"), F.col("source_url")).alias("source_url"),
        F.col("source_url").alias("download_url"),
        "resource_id",
        "resource_type",
        "format",
        "quality_level",
        F.col("final_score").alias("score"),
        "recommendation",
        "downloadable",
        "requires_auth",
        "official",
        summary_text().alias("summary"),
        "reasons",
        "warnings",
    )


def mark_shown(ranked_rows: DataFrame, k: int = 5, include_low: bool = False) -> DataFrame:
    """Flag the shown rows of a full ranking; the others are the hidden options."""
    shown = is_visible("quality_level", include_low) & (F.col("rank") <= k)
    return ranked_rows.withColumn("shown", F.coalesce(shown, F.lit(False)))


def selection_summary(scored: DataFrame, k: int = 5, include_low: bool = False) -> DataFrame:
    """Total, shown and hidden options and the status per request, with a map-side combine."""
    counted = scored.groupBy("intent_id").agg(
        F.count(F.lit(1)).alias("total_ranked"),
        F.least(F.count_if(is_visible("quality_level", include_low)), F.lit(k)).cast("bigint").alias("shown_count"),
    )
    return counted.withColumns(
        {
            "hidden_count": F.col("total_ranked") - F.col("shown_count"),
            "status": F.when(F.col("shown_count") > 0, "awaiting_user_selection").otherwise("no_suitable_options"),
        }
    )


def ranking_summary(scored: DataFrame) -> DataFrame:
    """Rows per request and quality level, zeros included, without a join."""
    names = [n for n, _ in L.QUALITY_LEVELS]
    wide = scored.groupBy("intent_id").agg(*[F.count_if(F.col("quality_level") == n).alias(n) for n in names])
    return wide.unpivot("intent_id", names, "quality_level", "n")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


ALL = "* ALL"  # holds a blank, so no listed pick equals it


def pick_options(options: DataFrame, picks: DataFrame, key: Sequence[str] = ("intent_id",)) -> DataFrame:
    """Picks (key, ``pick`` text) matched to options; unmatched ones carry an error.

    A pick is an option id, a letter for the first 26, or ``all``; several may
    be listed with commas or blanks.  Other columns of ``picks`` are kept.
    """
    number = F.col("option_id").try_cast("int")
    letter = F.when(number.between(1, 26), F.substring(F.lit(LETTERS), number, F.lit(1)))
    names = F.array_distinct(F.array_compact(F.array(F.upper("option_id"), letter, F.lit(ALL))))
    rest = [c for c in options.columns if c not in key]
    opt = options.select(*[F.col(k).alias(f"_k_{k}") for k in key], *rest, F.explode(names).alias("_name"))
    carried = [*key, *[c for c in picks.columns if c not in key and c != "pick"]]
    tidy = F.trim("pick")
    every = F.lower(tidy) == "all"
    listed = F.posexplode(F.array_remove(F.split(F.upper(tidy), r"[,，\s]+"), ""))
    single = picks.where(~every).select(*carried, listed.alias("pick_no", "picked"))
    whole = picks.where(every).select(*carried, F.lit(0).alias("pick_no"), F.lit(ALL).alias("picked")).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key] + [F.col("picked") == F.col("_name")]
    met = single.unionByName(whole).join(opt, on, "left")
    told = met.where((F.col("picked") != ALL) | F.col("option_id").isNotNull())
    is_all = F.col("picked") == ALL
    return told.select(
        *carried,
        F.when(is_all, F.col("option_id").try_cast("int") - 1).otherwise(F.col("pick_no")).alias("pick_no"),
        F.when(is_all, F.col("option_id")).otherwise(F.col("picked")).alias("picked"),
        *rest,
        F.when(F.col("option_id").isNull(), F.lit("选择编号不存在")).alias("error"),
    )

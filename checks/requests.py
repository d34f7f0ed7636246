"""Checks on requests (user turns of conversations) and on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.operators import intents as N
from shelfwise.session import shared_folder
from shelfwise.streaming.index_stream import dedupe_stream

from . import sqltext as S
from .inputs import table

QUERIES, ORACLE = {}, {}

DOMAINS = [("french", ["que", "les"]), ("german", ["der", "ung"]), ("english", ["the", "ing"]), ("spanish", ["los", "ción"])]
STAGES = [("early", ["en", "ai"]), ("middle", ["tion", "icht"]), ("late", ["ement", "keit"])]
PROFILES = [("calm", [" avec", " mit"]), ("keen", ["of", "zu"])]
TOPICS = [("motion", ["tion", "ation"]), ("unity", ["ung", "ingen"]), ("things", ["thing", "ing"]), ("houses", ["casa"])]
DOMAIN_TOPICS = [("french", [("vision", ["vi"])], "french basics"), ("german", [], "german basics")]
SUBTOPICS = [(["lesson", "lessons"], ["le", "on"])]
EARLY = [(["song", "clip"], ["oi", "sch"])]
TYPES = [("worksheet", ["ex", "er"]), ("recording", ["au", "oo"]), ("article", ["at"])]
LATE = [(["article"], ["de"]), (["clip", "worksheet"], ["a"])]
GOALS_BY_TYPE = [("listen", ["recording"]), ("practice", ["worksheet", "exam"]), ("watch", ["clip"])]
GOALS = [("start", ["en"]), ("look", ["o"])]
DIFFICULTIES = [("hard", ["eux", "keit"]), ("easy", ["le "])]
FORMATS = [("PDF", ["pa", "print"]), ("DOC", ["do", "print"])]
SOURCES = [("local", ["ver"]), ("official", ["re", "ge"])]
VERSIONS = ["chen", "eau", "ith"]
VOLUMES = ["von", "sur"]
CONSTRAINTS = [("printable", ["pr", "pf"]), ("free", ["für", "free"])]
FULL = ["ou", "all"]
COVERAGE = [("audio", ["au"]), ("video", ["vi"]), ("practice", ["pr"])]
LOCAL, LOCAL_TASK = ["lo", "ver"], ["ver", "local"]
NAMED, BROAD = ["nom"], ["br", "st"]
WIDE, VAGUE = ["french basics", "german basics"], ["french basics"]
NARROW, DOWNLOAD, PRINT = ["nar", "eur"], ["dans", "und", "on"], ["pf", "print"]

LEX = N.RequestLexicon(
    age_patterns=[r"(\d+)\s*years"], grades=[("grade one", 1), ("an", 2)], age_stages=[(3, 6, "early")], stages=STAGES,
    bridge_profile="none", preschool="pre", profiles=PROFILES, domains=DOMAINS, subjects=["les", "der", "and"], topics=TOPICS,
    domain_topics=DOMAIN_TOPICS, subtopics=SUBTOPICS, early_types=EARLY, types=TYPES, late_types=LATE,
    goals_by_type=GOALS_BY_TYPE, goals=GOALS, no_goal="none", difficulties=DIFFICULTIES, young_difficulty="easy",
    formats=FORMATS, sources=SOURCES, versions=VERSIONS, volumes=VOLUMES, constraints=CONSTRAINTS, full_scope=FULL,
    coverage=COVERAGE, local_terms=LOCAL, local_task_terms=LOCAL_TASK, named_terms=NAMED, broad_terms=BROAD,
    textbook_type="worksheet", wide_topics=WIDE, vague_topics=VAGUE, narrowing_terms=NARROW, download_terms=DOWNLOAD,
    print_terms=PRINT, print_word="printable", print_format="PDF", official_source="official", local_suffix="local",
)


def requests(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'")
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("intent_id"), F.col("text").alias("query"))


def parsed(spark, sf):
    return N.parse_intents(requests(spark, sf), LEX)


def _longest(rules):
    flat = sorted(((t, n, i) for i, (n, ts) in enumerate(rules) for t in ts), key=lambda r: (-len(r[0]), r[2]))
    return "CASE " + " ".join(f"WHEN contains(q, {S.lit(t)}) THEN {S.lit(n)}" for t, n, _ in flat) + " END"


def _list(rules):
    return ", ".join(f"CASE WHEN {S.any_of('q', ts)} THEN {S.lit(v)} END" for vs, ts in rules for v in vs)


def _some(values):
    return f"list_filter([{values}], lambda v: v IS NOT NULL)"


def _unique(x):
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_NAMED = _some(_list(EARLY) + ", " + ", ".join(f"CASE WHEN {S.any_of('q', ts)} THEN {S.lit(n)} END" for n, ts in TYPES))
CTE = rf"""rq AS (SELECT conv_id || '-' || turn AS intent_id, text AS query, {S.strip('text')} AS q FROM conversations WHERE role = 'user'),
 s0 AS (SELECT *, CASE WHEN contains(q, 'an') THEN 2 END::INT AS grade, {S.first_label('q', DOMAINS)} AS learning_domain, {S.first_label('q', PROFILES)} AS learner_profile,
   {_longest(STAGES)} AS stage, {_NAMED} AS named, {_some(_list(LATE))} AS late FROM rq),
 s1 AS (SELECT *, CASE WHEN len(named) > 0 THEN {_unique('named')} ELSE {_unique('late')} END AS types,
   coalesce(CASE WHEN contains(q, 'les') THEN 'les' WHEN contains(q, 'der') THEN 'der' WHEN contains(q, 'and') THEN 'and' END, learning_domain) AS subject,
   coalesce({_longest(TOPICS)}, CASE learning_domain WHEN 'french' THEN CASE WHEN contains(q, 'vi') THEN 'vision' ELSE 'french basics' END WHEN 'german' THEN 'german basics' END) AS core_topic,
   CASE WHEN contains(q, 'le') AND contains(q, 'on') THEN ['lesson', 'lessons'] ELSE []::VARCHAR[] END AS subtopics FROM s0),
 s2 AS (SELECT *, CASE WHEN list_contains(types, 'recording') THEN 'listen' WHEN list_has_any(types, ['worksheet', 'exam']) THEN 'practice' WHEN list_contains(types, 'clip') THEN 'watch'
     ELSE {S.first_label('q', GOALS, "'none'")} END AS goal, {S.first_label('q', DIFFICULTIES)} AS difficulty, {S.labels('q', FORMATS)} AS formats, {S.labels('q', SOURCES)} AS sources,
   {S.first_label('q', [(v, [v]) for v in VERSIONS])} AS version, {S.first_label('q', [(v, [v]) for v in VOLUMES])} AS volume,
   CASE WHEN regexp_matches(q, 'https?://') THEN 'exact' WHEN {S.any_of('q', FULL)} THEN 'full_coverage' ELSE 'candidate_set' END AS scope,
   {S.labels('q', COVERAGE)} AS coverage, {S.labels('q', CONSTRAINTS)} AS cons FROM s1),
 s3 AS (SELECT *, CASE WHEN {S.any_of('q', LOCAL)} THEN 'local_lookup' WHEN regexp_matches(q, 'https?://') OR {S.any_of('q', NAMED)}
     OR (list_contains(types, 'worksheet') AND version IS NOT NULL AND grade IS NOT NULL AND subject IS NOT NULL AND volume IS NOT NULL) THEN 'exact_resource'
     WHEN {S.any_of('q', BROAD)} THEN 'broad_exploration' ELSE 'topic_resource' END AS intent_type,
   grade IS NULL AS no_age, core_topic IS NULL AND learning_domain IS NULL AS no_topic,
   coalesce(core_topic IN ('french basics', 'german basics'), false) AND NOT (grade IS NOT NULL AND learning_domain IS NOT NULL AND len(types) > 0) AND NOT {S.any_of('q', NARROW)} AS wide,
   len(types) = 0 AND goal = 'none' AND {S.any_of('q', DOWNLOAD)} AS no_type,
   scope = 'full_coverage' AND {S.any_of('q', DOWNLOAD)} AND (core_topic IS NULL OR core_topic = 'french basics') AS vague FROM s2),
 s4 AS (SELECT *, {_some("CASE WHEN no_age AND NOT vague THEN 'learner_age_or_grade' END, CASE WHEN no_topic OR wide THEN 'core_topic' END, CASE WHEN no_type THEN 'resource_goal_or_type' END, CASE WHEN vague THEN 'core_topic' END, CASE WHEN vague THEN 'resource_types' END")} AS missing FROM s3),
 pi AS (SELECT *, CASE WHEN len(missing) = 0 THEN 'ready' ELSE 'needs_clarification' END AS status FROM s4)"""

_LISTS = ["subtopics", "resource_types", "format_preferences", "source_preferences", "coverage_targets", "constraints"]
QUERIES["intents"] = lambda spark, sf: parsed(spark, sf).select(
    "intent_id", "learner_age", "grade", "learner_profile", "stage", "learning_domain", "subject", "core_topic", "resource_goal", "difficulty",
    "version", "volume", "request_scope", "intent_type", *[F.array_join(c, "|").alias(c) for c in _LISTS],
)
ORACLE["intents"] = f"""WITH {CTE} SELECT intent_id, NULL::INT AS learner_age, grade, learner_profile, stage, learning_domain, subject, core_topic, goal AS resource_goal, difficulty,
 version, volume, scope AS request_scope, intent_type, array_to_string(subtopics, '|') AS subtopics, array_to_string(types, '|') AS resource_types, array_to_string(formats, '|') AS format_preferences,
 array_to_string(sources, '|') AS source_preferences, array_to_string(coverage, '|') AS coverage_targets, array_to_string(cons, '|') AS constraints FROM pi"""

QUERIES["intent_gaps"] = lambda spark, sf: parsed(spark, sf).select(
    "intent_id", "status", "confidence", F.array_join("missing_slots", "|").alias("missing"), F.size("clarifying_questions").cast("bigint").alias("questions")
)
ORACLE["intent_gaps"] = f"""WITH {CTE} SELECT intent_id, status, CASE WHEN status = 'ready' THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence, array_to_string(missing, '|') AS missing,
 CASE WHEN status = 'ready' THEN 0 WHEN vague THEN 2 ELSE least(3, no_age::INT + no_topic::INT + wide::INT + no_type::INT) END::BIGINT AS questions FROM pi"""

QUERIES["tasks"] = lambda spark, sf: N.plan_tasks(parsed(spark, sf), LEX).select(
    "intent_id", "task.task_id", "task.task_type", "task.target_skill", "task.priority", F.col("task.query").alias("words"), "task.printable",
    "task.download_policy", "age_fit_required",
)
_BASE = "concat_ws(' ', CASE WHEN grade IS NOT NULL THEN grade || '年级' END, coalesce(core_topic, learning_domain), CASE WHEN len(types) > 0 THEN array_to_string(types[1:2], ' ') END)"
_PRINT = f"({S.any_of('query', PRINT)} OR list_contains(cons, 'printable'))"
_LOC = f"({S.any_of('query', LOCAL_TASK)} OR list_contains(sources, 'local'))"
ORACLE["tasks"] = f"""WITH {CTE}, rd AS (SELECT * FROM pi WHERE status = 'ready')
SELECT intent_id, 'task_000' AS task_id, 'local_search' AS task_type, 'local-library-search' AS target_skill, 1::INT AS priority, {_BASE} || ' local' AS words, false AS printable, 'never' AS download_policy, true AS age_fit_required FROM rd WHERE {_LOC}
UNION ALL SELECT intent_id, CASE WHEN {_LOC} THEN 'task_002' ELSE 'task_001' END, 'source_search', 'web-learning-search', CASE WHEN {_LOC} THEN 2 ELSE 1 END::INT,
 {_BASE} || CASE WHEN {_PRINT} THEN ' printable' ELSE '' END || CASE WHEN list_contains(formats, 'PDF') THEN ' PDF' ELSE '' END, {_PRINT}, 'after_user_selection', true FROM rd""".replace("list_contains(cons, 'printable')", "list_bool_or(list_concat([false], list_transform(cons, lambda c: contains(c, 'print'))))")

QUERIES["intent_profile"] = lambda spark, sf: N.ranking_profile(parsed(spark, sf), LEX).select(
    "intent_id", "primary_goal", F.array_join("must_match", "|").alias("must"), F.array_join("prefer", "|").alias("prefer"), "weights.relevance", "weights.format"
)
_PREF = f"(list_contains(formats, 'PDF') OR list_bool_or(list_concat([false], list_transform(cons, lambda c: contains(c, 'print')))))"
ORACLE["intent_profile"] = f"""WITH {CTE} SELECT intent_id, '主题匹配' AS primary_goal, CASE WHEN core_topic IS NOT NULL THEN 'core_topic' ELSE '' END AS must,
 concat_ws('|', CASE WHEN {_PREF} THEN 'PDF|printable' END, CASE WHEN list_contains(sources, 'official') THEN 'official' END) AS prefer, 0.3::DOUBLE AS relevance, 0.1::DOUBLE AS format FROM pi"""


def stream_dedupe(spark, sf):
    """Events as a stream, one row per (user, type) within a delay longer than the data, run to its end."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{place}/rows"
    query = (
        dedupe_stream(stream, ["user_id", "event_type"], "ts", "400 days")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")


QUERIES["stream_dedupe"] = stream_dedupe
ORACLE["stream_dedupe"] = "SELECT DISTINCT user_id, event_type FROM events"

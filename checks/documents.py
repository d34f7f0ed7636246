"""Checks on documents as candidates: evidence, ranking, search, library and index."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.match import hits
from shelfwise.functions.text import mask_secrets
from shelfwise.operators import candidates as C
from shelfwise.operators import content as A
from shelfwise.operators import filters as X
from shelfwise.operators import library as B
from shelfwise.operators import ranking as K
from shelfwise.operators import search as H
from shelfwise.operators.grouping import numbered
from shelfwise.operators.sets import dedupe_first, source_first

from . import inputs as I
from . import sqltext as S
from .inputs import CANDIDATES_SQL as CAND
from .inputs import table

QUERIES, ORACLE = {}, {}

SECRETS = [(r'(token = ")[0-9a-fA-F]+', "$1***"), (r"(Bearer )[A-Za-z0-9._-]+", "$1***")]
QUERIES["mask_secrets"] = lambda spark, sf: table(spark, sf, "documents").select("doc_id", mask_secrets("text", SECRETS).alias("text"))
ORACLE["mask_secrets"] = r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(token = ")[0-9a-fA-F]+', '\1***', 'g'), '(Bearer )[A-Za-z0-9._-]+', '\1***', 'g') AS text FROM documents"""

QUERIES["lexicon_hits"] = lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.array_join(hits("text", I.KEYWORDS), "|").alias("hits"))
ORACLE["lexicon_hits"] = f"SELECT doc_id, array_to_string({S.hits('text', I.KEYWORDS)}, '|') AS hits FROM documents"

QUERIES["term_hits"] = lambda spark, sf: H.term_hits(
    table(spark, sf, "documents"), "doc_id", "text",
    table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct(),
)
ORACLE["term_hits"] = """WITH t AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part)
SELECT doc_id, term FROM documents, t WHERE contains(lower(text), term)"""

QUERIES["dedupe"] = lambda spark, sf: dedupe_first(
    table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "lang", "text"), ["key"], "doc_id"
).select("doc_id", "key", "lang", "text", "copies")
ORACLE["dedupe"] = """SELECT doc_id, key, lang, text, copies::BIGINT AS copies FROM (SELECT doc_id, sha256(text) AS key, lang, text, count(*) OVER (PARTITION BY text) AS copies,
 row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1"""

QUERIES["page_slice"] = lambda spark, sf: X.page_slice(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 100, 50, "doc_id")
ORACLE["page_slice"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100"

QUERIES["skip_policy"] = lambda spark, sf: I.candidates(spark, sf).select(
    "ordinal", X.should_skip(F.col("requires_auth"), F.col("source_warnings"), risk_terms=["toxic"]).alias("reason")
)
ORACLE["skip_policy"] = f"""WITH {CAND} SELECT ordinal, CASE WHEN requires_auth THEN '需要登录或授权访问' WHEN toxic = 1 THEN '候选存在风险提示' END AS reason FROM cand"""

QUERIES["drop_missing"] = lambda spark, sf: X.drop_missing(
    table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("library_file"), "lang"),
    table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("library_file")), include_missing=True,
).select("doc_id", "lang", "file_exists")
ORACLE["drop_missing"] = """SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS file_exists FROM documents"""

# ---------------------------------------------------------------- evidence and analysis
_EVID = dict(keywords=I.KEYWORDS, risk_terms=I.RISK, auth_terms=I.AUTH)


def text_evidence(spark, sf):
    return A.text_evidence(table(spark, sf, "documents"), sample=1200, **_EVID).select(
        "doc_id", "text_length", "text_sample", F.array_join("keywords", "|").alias("keywords"), "evidence_level",
        "has_content_evidence", F.array_join("evidence_warnings", "|").alias("warnings"),
    )


_WARN = f"list_concat({S.hits('whole', I.RISK, '包含风险词：')}, CASE WHEN contains(lower(whole), 'token = \"') THEN ['疑似登录、权限或付费限制页面'] ELSE [] END)"
QUERIES["text_evidence"] = text_evidence
ORACLE["text_evidence"] = f"""WITH e AS (SELECT doc_id, length(text) AS n, text AS whole, left({S.squeeze('text')}, 1200) AS sample FROM documents)
SELECT doc_id, n::BIGINT AS text_length, sample AS text_sample, array_to_string({S.hits('whole', I.KEYWORDS)}, '|') AS keywords,
 CASE WHEN n >= 500 THEN 'strong' WHEN n >= 80 THEN 'basic' ELSE 'none' END AS evidence_level, n >= 80 AS has_content_evidence,
 array_to_string({_WARN}, '|') AS warnings FROM e"""


def analysed(spark, sf, sample=None):
    return A.analyze(I.candidates(spark, sf), I.files(spark, sf), sample=sample, **_EVID)


def analysis(spark, sf):
    return analysed(spark, sf, 1200).select(
        "ordinal", "title", "format", "analysis.analysis_type", "analysis.text_length", "analysis.page_count",
        "analysis.evidence_level", "analysis.analysis_confidence", "analysis.text_sample",
        F.array_join("analysis.keywords", "|").alias("keywords"), F.array_join("analysis.warnings", "|").alias("warnings"),
    )


_AN_CTE = f"""{CAND}, a0 AS (SELECT *, true AS known, text AS body,
   CASE WHEN format = 'pdf' THEN floor(n_chars / 1000)::INT END AS pages FROM cand),
 a1 AS (SELECT *, concat_ws(' ', title, source_url, body) AS whole, length(body) AS n FROM a0),
 an AS (SELECT *, CASE WHEN n >= 500 THEN 'strong' WHEN n >= 80 OR coalesce(pages, 0) > 0 THEN 'basic' WHEN known AND n_chars >= 1024 THEN 'metadata_only' ELSE 'none' END AS evidence_level,
   CASE format WHEN 'pdf' THEN 'document' WHEN 'docx' THEN 'document' WHEN 'html' THEN 'webpage' ELSE 'audio' END AS analysis_type,
   {S.hits('whole', I.KEYWORDS)} AS keywords,
   list_distinct_ordered(list_concat(source_warnings, CASE WHEN known AND format = 'mp3' AND trim(body) = '' THEN ['未找到字幕或转写文本，内容证据不足'] ELSE [] END,
     CASE WHEN NOT known THEN ['文件不存在'] ELSE [] END, {_WARN})) AS awarn,
   CASE WHEN NOT known THEN 25 WHEN format = 'html' THEN CASE WHEN trim(body) <> '' THEN 85 ELSE 35 END WHEN format = 'docx' THEN CASE WHEN trim(body) <> '' THEN 85 ELSE 45 END
     WHEN format = 'pdf' THEN CASE WHEN trim(body) <> '' THEN 82 ELSE 65 END ELSE CASE WHEN trim(body) <> '' THEN 82 ELSE 45 END END / 100.0::DOUBLE AS aconf FROM a1)""".replace("list_distinct_ordered", "")
QUERIES["analysis"] = analysis
ORACLE["analysis"] = f"""WITH {_AN_CTE} SELECT ordinal, {S.strip('title')} AS title, format, analysis_type, n::BIGINT AS text_length, pages AS page_count, evidence_level,
 aconf AS analysis_confidence, left({S.squeeze('body')}, 1200) AS text_sample, array_to_string(keywords, '|') AS keywords, array_to_string(awarn, '|') AS warnings FROM an"""


def attach_analysis(spark, sf):
    done = analysed(spark, sf).where("analysis.has_content_evidence").select(
        "local_file", F.concat(F.lit("x-"), F.col("format")).alias("format"), "analysis"
    )
    return A.attach_analysis(I.candidates(spark, sf), done).select(
        "ordinal", "format", F.col("analysis.evidence_level").alias("evidence_level")
    )


QUERIES["attach_analysis"] = attach_analysis
ORACLE["attach_analysis"] = f"""WITH {_AN_CTE} SELECT ordinal, CASE WHEN evidence_level IN ('strong', 'basic') THEN 'x-' || format ELSE format END AS format,
 CASE WHEN evidence_level IN ('strong', 'basic') THEN evidence_level END AS evidence_level FROM an"""

# ---------------------------------------------------------------- ranking
INTENTS = [
    {
        "intent_id": "practice-en", "core_topic": "tion/and", "subject": "english", "version": "long", "stage": "en",
        "resource_goal": "practice", "resource_types": ["worksheet"], "subtopics": ["ing", "zzz"],
        "format_preferences": ["PDF"], "constraints": ["printable"], "prefer": ["pdf", "src1"], "avoid": ["license"],
    },
    {
        "intent_id": "listen-fr", "core_topic": "que", "subject": "french", "learner_age": 8, "resource_goal": "listen",
        "resource_types": ["recording", "audio"], "avoid": ["src3", "src13", "toxic"],
    },
    {
        "intent_id": "read-de", "core_topic": "missing topic words", "learning_domain": "german", "grade": "de", "stage": "de",
        "resource_types": ["article", "paper"], "format_preferences": ["html", "docx"], "volume": "ung",
    },
    {
        # the request of all other languages has no id
        "intent_id": None, "core_topic": "los", "subject": "spanish", "version": "long", "resource_types": ["worksheet", "paper"],
        "format_preferences": ["mp3"], "avoid": ["toxic"],
    },
]
ASSIGNED = {"en": "practice-en", "fr": "listen-fr", "de": "read-de"}
SCORING = dict(
    suspicious=I.RISK, trust=I.TRUST, alarms=I.ALARM, printable=("printable", "fit to print"),
    goals={"practice": "practice", "listen": "listen"},
    types={"textbook": "textbook", "practice": "worksheet", "audio": "audio", "video": "video"},
)


def scored(spark, sf):
    """Every document scored for the request of its language."""
    request = F
    for lang, intent in ASSIGNED.items():
        request = request.when(F.col("stage") == lang, intent)
    return K.score_for(analysed(spark, sf).withColumn("intent_id", request.otherwise(F.lit(None))), INTENTS, **SCORING)


def _has(term):
    return f"contains(blob, {S.lit(term.lower())})"


def _when(pairs):
    return " + ".join(f"CASE WHEN {t} THEN {v} ELSE 0 END" for t, v in pairs)


def _scores(i):
    """Score terms of one request, written out as SQL."""
    topic, subject = i["core_topic"], i.get("subject") or i.get("learning_domain")
    whole = _has(topic)
    parts = "(" + " OR ".join(_has(p) for p in topic.replace("/", " ").split()) + ")"
    types = "(" + " OR ".join(_has(x) for x in i["resource_types"]) + ")"
    subs = "(" + " OR ".join(_has(x) for x in i.get("subtopics", [])) + ")" if i.get("subtopics") else "false"
    version = _has(i["version"]) if i.get("version") else "false"
    volume = _has(i["volume"]) if i.get("volume") else "false"
    grade = _has(i["grade"]) if i.get("grade") else "false"
    stage = _has(i["stage"]) if i.get("stage") else "false"
    age = i.get("learner_age") if not i.get("grade") and not i.get("stage") else None
    has_age = f"list_contains(regexp_extract_all(lower(title), '\\d+'), '{age}')" if age else "false"
    prefs = i.get("format_preferences", [])
    fits = "(" + " OR ".join(f"contains(replace(format, '/', ''), {S.lit(p.lower())})" for p in prefs) + ")" if prefs else "false"
    goal = i.get("resource_goal", "")
    prints = "true" if "printable" in i.get("constraints", []) or "practice" in goal else _has("printable")
    audio = "true" if "listen" in goal or "audio" in i["resource_types"] else "false"
    prefer = [f"contains(ublob, {S.lit(v)})" for v in i.get("prefer", [])]
    avoid = [f"contains(ublob, {S.lit(v)})" for v in i.get("avoid", [])]
    n_pref = " + ".join(f"{p}::INT" for p in prefer) or "0"
    n_avoid = " + ".join(f"{p}::INT" for p in avoid) or "0"
    return {
        "relevance": f"least(30, {_when([(whole, 12), (f'NOT {whole} AND {parts}', 7), (_has(subject), 7), (types, 7), (subs, 4), (version, 3), (volume, 2)])})",
        "age_fit": f"least(20, 8 + {_when([(grade, 8), (stage, 4), (has_age, 8)])})",
        "authority": f"least(15, 4 + {_when([('coalesce(official, false)', 8), (S.any_of('blob', I.TRUST), 3)])})",
        "accessibility": f"least(10, {_when([('downloadable', 6), ('NOT downloadable', 3), ('requires_auth', 1), ('NOT requires_auth', 4)])})",
        "format_fit": "least(10, 3 + " + _when([(fits, 5), ("false" if prefs else "true", 4), (types, 2), (f"{prints} AND format IN ('pdf', 'docx')", 2), (f"{audio} AND format = 'mp3'", 2)]) + ")",
        "safety": "greatest(10 - 4 * n_risk, 0)",
        "metadata_quality": "meta",
        "content_evidence": "CASE WHEN evidence_level = 'strong' THEN 5 WHEN evidence_level = 'basic' THEN 3 WHEN coalesce(pages, 0) > 0 THEN 2 ELSE 0 END",
        "preference_fit": f"greatest(least(1.5 * ({n_pref}) - 3 * ({n_avoid}), 5), -8)",
    }


def _id(i):
    return S.lit(i["intent_id"]) if i["intent_id"] else "NULL::VARCHAR"


_FILLED = "(title <> '')::INT + 3 + (subject IS NOT NULL)::INT"
_RANK_CTE = f"""{_AN_CTE}, rb AS (SELECT *, lower(concat_ws(' ', {S.blank_to_null('title')}, source_name, resource_type, format, stage, subject, version, provider,
   {S.blank_to_null(S.squeeze('body'))}, {S.blank_to_null("array_to_string(keywords, ' ')")})) AS blob FROM an),
 ru AS (SELECT *, blob || ' ' || lower(source_url) AS ublob FROM rb),
 rm AS (SELECT *, {S.count_of('ublob', I.RISK)} + len(list_filter(awarn, lambda w: {S.any_of('w', I.RISK + I.ALARM)}))
     - (CASE WHEN {S.any_of('ublob', ['license'])} AND list_contains(awarn, '包含风险词：license') THEN 1 ELSE 0 END)
     - (CASE WHEN {S.any_of('ublob', ['token ='])} AND list_contains(awarn, '包含风险词：token =') THEN 1 ELSE 0 END) AS n_risk,
   greatest(coalesce(round(metadata_confidence::DECIMAL(10,6) * 500, 0), floor((({_FILLED}) * 1000 + 6) / 12)), round(aconf::DECIMAL(10,6) * 500, 0))::INT / 100.0::DOUBLE AS meta,
   CASE stage WHEN 'en' THEN 'practice-en' WHEN 'fr' THEN 'listen-fr' WHEN 'de' THEN 'read-de' END AS ask FROM ru),
 sc AS ({" UNION ALL ".join(f"SELECT *, {_id(i)} AS intent_id, " + ", ".join(f"({x})::DOUBLE AS s_{n}" for n, x in _scores(i).items()) + f" FROM rm WHERE ask IS NOT DISTINCT FROM {_id(i)}" for i in INTENTS)}),
 fs AS (SELECT *, round(least(greatest({' + '.join('s_' + n for n in K.DIMENSIONS)}, 0), 100), 2) AS final_score FROM sc),
 lv AS (SELECT *, CASE WHEN final_score >= 90 THEN 'excellent' WHEN final_score >= 75 THEN 'high' WHEN final_score >= 60 THEN 'medium' WHEN final_score >= 40 THEN 'low' ELSE 'reject' END AS quality_level FROM fs)"""

QUERIES["ranking_breakdown"] = lambda spark, sf: scored(spark, sf).select(
    "intent_id", "ordinal", "final_score", *[F.col(f"score_breakdown.{n}").alias(n) for n in K.DIMENSIONS]
)
ORACLE["ranking_breakdown"] = f"WITH {_RANK_CTE} SELECT intent_id, ordinal, final_score, {', '.join(f's_{n} AS {n}' for n in K.DIMENSIONS)} FROM lv"


def ranking(spark, sf):
    return K.rank_scored(scored(spark, sf)).select(
        "intent_id", "ordinal", F.col("rank").cast("bigint").alias("rank"), "final_score", "quality_level", "recommendation"
    )


QUERIES["ranking"] = ranking
ORACLE["ranking"] = f"""WITH {_RANK_CTE} SELECT intent_id, ordinal, CASE WHEN quality_level <> 'reject' THEN row_number() OVER (PARTITION BY intent_id, quality_level = 'reject' ORDER BY final_score DESC, ordinal) END AS rank,
 final_score, quality_level, CASE quality_level WHEN 'excellent' THEN 'strong_recommend' WHEN 'high' THEN 'recommended' WHEN 'medium' THEN 'backup' WHEN 'low' THEN 'not_preferred' ELSE 'reject' END AS recommendation FROM lv"""

QUERIES["ranking_summary"] = lambda spark, sf: K.ranking_summary(scored(spark, sf))
ORACLE["ranking_summary"] = f"""WITH {_RANK_CTE}, q AS (SELECT unnest(['excellent', 'high', 'medium', 'low', 'reject']) AS quality_level), i AS (SELECT DISTINCT intent_id FROM lv)
SELECT i.intent_id, q.quality_level, count(lv.ordinal) AS n FROM i CROSS JOIN q LEFT JOIN lv ON lv.intent_id IS NOT DISTINCT FROM i.intent_id AND lv.quality_level = q.quality_level GROUP BY ALL"""


def selection(spark, sf):
    return K.select_options(scored(spark, sf)).select(
        "intent_id", "option_id", "rank", "ordinal", "title", "source_name", "source_url", "format", "quality_level", "score",
        "downloadable", "requires_auth", "official", "summary",
    )


_SUMMARY = """CASE WHEN coalesce(official, false) THEN '官方来源，' ELSE '' END || '适配' || stage || CASE WHEN subject IS NOT NULL THEN '，学科为' || subject ELSE '' END
 || CASE WHEN version IS NOT NULL THEN '，版本为' || version ELSE '' END"""
_SEL_CTE = f"""{_RANK_CTE}, sel AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY final_score DESC, ordinal) AS pos FROM lv WHERE quality_level IN ('excellent', 'high', 'medium'))"""
QUERIES["selection"] = selection
ORACLE["selection"] = f"""WITH {_SEL_CTE} SELECT intent_id, pos::VARCHAR AS option_id, pos AS rank, ordinal, coalesce({S.blank_to_null('title')}, '未命名资源') AS title, source_name, source_url, format,
 quality_level, final_score AS score, downloadable, requires_auth, coalesce(official, false) AS official, {_SUMMARY} AS summary FROM sel WHERE pos <= 5"""

QUERIES["selection_summary"] = lambda spark, sf: K.selection_summary(scored(spark, sf))
ORACLE["selection_summary"] = f"""WITH {_RANK_CTE} SELECT intent_id, count(*) AS total_ranked, least(5, count(*) FILTER (quality_level IN ('excellent', 'high', 'medium')))::BIGINT AS shown_count,
 count(*) - least(5, count(*) FILTER (quality_level IN ('excellent', 'high', 'medium')))::BIGINT AS hidden_count,
 CASE WHEN count(*) FILTER (quality_level IN ('excellent', 'high', 'medium')) > 0 THEN 'awaiting_user_selection' ELSE 'no_suitable_options' END AS status FROM lv GROUP BY 1"""


def pick_options(spark, sf):
    picks = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("who"),
        F.element_at(F.array(*[F.lit(i["intent_id"]) for i in INTENTS]), F.col("c_nationkey") % 3 + 1).alias("intent_id"),
        F.element_at(F.array(F.lit("1, 2"), F.lit("b"), F.lit("9，a"), F.lit("ALL")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("pick"),
    )
    options = K.select_options(scored(spark, sf)).select("intent_id", "option_id", "ordinal")
    return K.pick_options(options, picks).select(
        F.concat_ws("|", "who", "intent_id").alias("key"), "picked", "option_id", "ordinal", "error"
    )


QUERIES["pick_options"] = pick_options
ORACLE["pick_options"] = f"""WITH {_SEL_CTE}, o AS (SELECT intent_id, pos::VARCHAR AS option_id, chr(64 + pos::INT) AS letter, ordinal FROM sel WHERE pos <= 5),
 p AS (SELECT c_custkey::VARCHAR || '|' || ['practice-en', 'listen-fr', 'read-de'][c_nationkey % 3 + 1] AS key, ['practice-en', 'listen-fr', 'read-de'][c_nationkey % 3 + 1] AS intent_id,
   [['1', '2'], ['B'], ['9', 'A'], ['ALL']][c_custkey % 4 + 1] AS picks FROM customer),
 s AS (SELECT key, intent_id, unnest(picks) AS picked FROM p)
SELECT key, picked, option_id, ordinal, CASE WHEN option_id IS NULL THEN '选择编号不存在' END AS error FROM s LEFT JOIN o ON o.intent_id = s.intent_id AND (o.option_id = picked OR o.letter = picked) WHERE picked <> 'ALL'
UNION ALL SELECT key, option_id, option_id, ordinal, NULL FROM s JOIN o ON o.intent_id = s.intent_id WHERE picked = 'ALL'"""

# ---------------------------------------------------------------- sources, search
def gathered(spark, sf):
    rows = I.candidates(spark, sf).select("ordinal", F.col("stage").alias("intent_id"), "source", "n_chars")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    keyed = rows.withColumn("intent_id", F.concat_ws("-", "intent_id", (F.col("ordinal") % 40).cast("string")))
    return source_first(keyed.where(number < 3), keyed.where(number.between(3, 9)), keyed.where(number > 9), 3, 8)


QUERIES["source_first"] = lambda spark, sf: gathered(spark, sf).select("intent_id", "source", F.col("source_priority").cast("bigint").alias("priority"), F.pmod("ordinal", F.lit(1 << 56)).alias("doc_id"))
ORACLE["source_first"] = """WITH k AS (SELECT doc_id, source, lang || '-' || (doc_id % 40) AS intent_id, regexp_extract(source, '(\\d+)$', 1)::INT AS s FROM documents),
 c AS (SELECT intent_id, count(*) FILTER (s < 3) AS a, count(*) FILTER (s BETWEEN 3 AND 9) AS b FROM k GROUP BY 1),
 f AS (SELECT *, a < 3 OR a < 8 AS site FROM c), g AS (SELECT *, a + CASE WHEN site THEN b ELSE 0 END < 8 AS web FROM f)
SELECT intent_id, source, CASE WHEN s < 3 THEN 0 WHEN s <= 9 THEN 1 ELSE 2 END::BIGINT AS priority, doc_id FROM k JOIN g USING (intent_id) WHERE s < 3 OR (s <= 9 AND site) OR (s > 9 AND web)"""


def library_index(spark, sf):
    """Whole documents as index records: the text is the searchable title."""
    return I.candidates(spark, sf).select(
        "ordinal", F.col("text").alias("title"), "format", "resource_type", "source_url", F.col("local_file").alias("library_file"),
        F.col("stage").alias("stage_or_age"), F.lit("未分年级").alias("grade_or_phase"), F.coalesce("subject", F.lit("综合")).alias("domain_or_subject"),
        F.col("resource_type").alias("topic_or_type"), F.col("source").alias("source_or_version"),
        (F.col("ordinal") % 100 / 100.0).alias("classification_confidence"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("needs_review"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("file_exists"),
    )


def index_search(spark, sf):
    q = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.when(F.col("item_id") % 2 == 0, F.lit("English")).alias("subject"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("pdf"), F.lit("audio"))).alias("format_preferences"),
    )
    return H.search_index(library_index(spark, sf), q, k=3, min_score=8.0).select("query_id", "ordinal", F.col("rank").cast("bigint").alias("rank"), "match_score")


_TOK = S.word_list("text")
QUERIES["index_search"] = index_search
ORACLE["index_search"] = f"""WITH {CAND}, rec AS (SELECT *, lower(concat_ws(' ', {S.blank_to_null('text')}, format, resource_type, source_url, local_file, stage, '未分年级', coalesce(subject, '综合'), resource_type, source)) AS blob FROM cand),
 q AS (SELECT item_id AS query_id, list_distinct({_TOK}) AS toks FROM benchmark), t AS (SELECT query_id, len(toks) AS n_tokens, unnest(toks) AS token FROM q),
 d AS (SELECT DISTINCT token FROM t), h AS (SELECT ordinal, token FROM rec, d WHERE contains(blob, token)),
 c AS (SELECT t.query_id, h.ordinal, count(*) AS hits FROM h JOIN t USING (token) GROUP BY ALL),
 p AS (SELECT q.query_id, rec.*, len(q.toks) AS n_tokens, coalesce(hits, 0) AS hits,
   CASE WHEN q.query_id % 2 = 0 AND subject = 'english' THEN 12 ELSE 0 END + CASE WHEN q.query_id % 3 = 0 AND format IN ('pdf', 'mp3') THEN 8 ELSE 0 END AS points
   FROM q CROSS JOIN rec LEFT JOIN c ON c.query_id = q.query_id AND c.ordinal = rec.ordinal),
 s AS (SELECT query_id, ordinal, greatest(0, ((hits * 80000 + n_tokens) // (n_tokens * 2)) + points * 1000 + round((ordinal % 100 / 100.0)::DECIMAL(9,6) * 8000, 0)::BIGINT
   + CASE WHEN coalesce(quality, 1) = 1 THEN 6000 ELSE 0 END - CASE WHEN toxic = 1 THEN 4000 ELSE 0 END) AS v FROM p WHERE hits > 0 OR points > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, ordinal) AS rank FROM s WHERE v >= 8000)
SELECT query_id, ordinal, rank, v / 1000.0::DOUBLE AS match_score FROM r WHERE rank <= 3"""


def index_candidates(spark, sf):
    rows = library_index(spark, sf).withColumns({
        "match_score": F.col("ordinal") % 50 * 1.0, "resource_key": F.concat(F.lit("k"), F.col("ordinal").cast("string")),
        "title": F.col("stage_or_age"),
    })
    return C.index_candidates(rows).select("ordinal", "resource_id", "title", "stage", "grade", "subject", "topic", "version", "provider", "metadata_confidence", "local_file")


QUERIES["index_candidates"] = index_candidates
ORACLE["index_candidates"] = f"""WITH {CAND} SELECT ordinal, 'k' || ordinal AS resource_id, stage AS title, stage, NULL::VARCHAR AS grade, subject, resource_type AS topic, source AS version, source AS provider,
 round(least(1, 0.35 + CASE WHEN ordinal % 50 >= 35 THEN 0.25 WHEN ordinal % 50 > 0 THEN 0.10 ELSE 0 END + (ordinal % 100 / 100.0)::DECIMAL(6,4) * 0.35::DECIMAL(4,2)
  + CASE WHEN coalesce(quality, 1) = 1 THEN 0.05 ELSE 0 END), 3)::DOUBLE AS metadata_confidence, local_file FROM cand"""

# ---------------------------------------------------------------- library and index
DOMAINS = [("prose", ["the", "que"]), ("essay", ["der"])]


def classified(spark, sf):
    rows = I.candidates(spark, sf).select(
        "ordinal", F.when(F.col("ordinal") % 5 > 0, F.col("title")).alias("title"), "local_file", "format", "resource_type", "sha256",
        F.when(F.col("ordinal") % 3 > 0, F.col("stage")).alias("stage"), F.when(F.col("ordinal") % 7 == 0, F.lit("g: 1/2")).alias("grade"),
        "subject", F.when(F.col("ordinal") % 4 == 0, F.lit(" . topic  one. ")).alias("topic"), "version", "source_name",
        F.when(F.col("quality") == 1, 0.5 + F.col("ordinal") % 10 / 10.0).alias("metadata_confidence"),
    )
    odd = rows.withColumn("format", F.when(F.col("ordinal") % 11 == 0, F.lit("JPEG")).otherwise(F.col("format")))
    return B.classify_library(odd, domain_rules=DOMAINS)


QUERIES["library_classes"] = lambda spark, sf: classified(spark, sf).select(
    "ordinal", "stage_or_age", "grade_or_phase", "domain_or_subject", "topic_or_type", "source_or_version", "resource_type",
    "classification_confidence", "needs_review",
)
_LIB_CTE = f"""{CAND}, l0 AS (SELECT ordinal, CASE WHEN ordinal % 5 > 0 THEN {S.blank_to_null('title')} END AS title, local_file, CASE WHEN ordinal % 11 = 0 THEN 'jpg' ELSE format END AS fmt, format AS suffix, resource_type, sha256,
   CASE WHEN ordinal % 3 > 0 THEN stage ELSE '未分学段' END AS stage_or_age, CASE WHEN ordinal % 7 = 0 THEN 'g_ 1_2' ELSE '未分年级' END AS grade_or_phase, subject,
   CASE WHEN ordinal % 4 = 0 THEN 'topic one' ELSE resource_type END AS topic_or_type, coalesce(version, source_name) AS source_or_version,
   CASE WHEN quality = 1 THEN 0.5 + ordinal % 10 / 10.0 END AS mc FROM cand),
 l1 AS (SELECT *, coalesce(title, regexp_extract(local_file, '([^/]+?)(?:\\.[^./]*)?$', 1)) AS t FROM l0),
 l2 AS (SELECT *, coalesce(subject, {S.first_label('lower(t)', DOMAINS)}, '综合') AS domain_or_subject FROM l1),
 l3 AS (SELECT *, greatest(180 + CASE WHEN stage_or_age <> '未分学段' THEN 160 ELSE 0 END + CASE WHEN grade_or_phase <> '未分年级' THEN 120 ELSE 0 END + CASE WHEN domain_or_subject <> '综合' THEN 160 ELSE 0 END
   + 140 + 100 + 80 + 60, coalesce(round(least(mc, 1.0)::DECIMAL(9,6) * 1000, 0), 0))::INT AS pts FROM l2)"""
ORACLE["library_classes"] = f"""WITH {_LIB_CTE} SELECT ordinal, stage_or_age, grade_or_phase, domain_or_subject, topic_or_type, source_or_version, resource_type,
 pts / 1000.0::DOUBLE AS classification_confidence, pts < 550 AS needs_review FROM l3"""

QUERIES["library_paths"] = lambda spark, sf: B.library_paths(
    classified(spark, sf).withColumn("sha256", F.lit("0123456789")), 0.9, "lib", block=64
).select("ordinal", "format", "needs_review", "library_file")
_SAFE = S.squeeze(r"""regexp_replace(t, '[\\/:*?"<>|\r\n\t]+', '_', 'g')""")
ORACLE["library_paths"] = f"""WITH {_LIB_CTE}, p0 AS (SELECT *, fmt <> suffix AND suffix IN ('pdf', 'html', 'mp3', 'docx') AS bad FROM l3),
 p1 AS (SELECT *, pts < 550 OR bad OR pts < 900 AS review FROM p0),
 p2 AS (SELECT *, 'lib/' || CASE WHEN review THEN '待确认/' || fmt ELSE concat_ws('/', stage_or_age, grade_or_phase, domain_or_subject, topic_or_type, source_or_version) END || '/' ||
   left(coalesce(nullif(trim({_SAFE}, ' .'), ''), '未知标题'), 70) || '_01234567' AS stem FROM p1),
 p3 AS (SELECT *, row_number() OVER (PARTITION BY stem, fmt ORDER BY ordinal) AS n FROM p2)
SELECT ordinal, fmt AS format, review AS needs_review, stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.' || fmt AS library_file FROM p3"""

QUERIES["numbered"] = lambda spark, sf: numbered(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", "n", block=37)
ORACLE["numbered"] = "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents"


def index_parts(spark, sf):
    rows = I.candidates(spark, sf).select(
        "ordinal", F.col("sha256").alias("resource_key"), "title", F.concat_ws("/", F.lit("lib"), F.concat("source", F.lit("-"), F.substring("sha256", 1, 8))).alias("library_file"),
        F.lit("").alias("original_file"), "format", "resource_type", F.col("stage").alias("stage_or_age"), F.lit("").alias("grade_or_phase"),
        F.coalesce("subject", F.lit("")).alias("domain_or_subject"), F.lit("").alias("topic_or_type"), F.col("source").alias("source_or_version"),
        "source_url", "sha256", (F.col("ordinal") % 10 / 10.0).alias("classification_confidence"), (F.col("ordinal") % 10 < 3).alias("needs_review"),
    )
    even = rows.where("ordinal % 2 = 0")
    old = dedupe_first(even, ["resource_key"]).drop("copies", "ordinal").withColumns(
        {"dedupe_confidence": F.lit("high"), "created_at": F.lit("2024-01-01"), "updated_at": F.lit("2024-01-01")}
    )
    new = rows.where("ordinal % 2 = 1").withColumns(
        {
            "title": F.when(F.col("ordinal") % 3 > 0, F.col("title")),
            "library_file": F.when(F.col("ordinal") % 13 > 0, F.col("library_file")),
        }
    ).drop("resource_key")
    return old, new


def index_upsert(spark, sf):
    old, new = index_parts(spark, sf)
    fresh, _ = B.index_upsert(old, new, "2024-02-02")
    return fresh.select("resource_key", "title", "library_file", "format", "source_url", "classification_confidence", "needs_review", "dedupe_confidence", "created_at", "updated_at")


_UP_CTE = f"""{CAND}, rws AS (SELECT *, sha256 AS resource_key, 'lib/' || source || '-' || left(sha256, 8) AS library_file, (ordinal % 10) / 10.0::DOUBLE AS cc, ordinal % 10 < 3 AS nr FROM cand),
 old AS (SELECT * FROM rws WHERE ordinal % 2 = 0 QUALIFY row_number() OVER (PARTITION BY resource_key ORDER BY ordinal) = 1),
 nw AS (SELECT * REPLACE (CASE WHEN ordinal % 3 > 0 THEN {S.blank_to_null('title')} END AS title, CASE WHEN ordinal % 13 > 0 THEN library_file END AS library_file) FROM rws WHERE ordinal % 2 = 1),
 fst AS (SELECT * FROM nw WHERE library_file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY resource_key ORDER BY ordinal) = 1),
 oc AS (SELECT nw.*, coalesce(old.library_file, fst.library_file) AS existing_file, CASE WHEN nw.library_file IS NULL THEN 'failed' WHEN nw.library_file <> coalesce(old.library_file, fst.library_file) THEN 'duplicate'
   WHEN old.resource_key IS NULL AND nw.ordinal = fst.ordinal THEN 'created' ELSE 'updated' END AS outcome
   FROM nw LEFT JOIN old USING (resource_key) LEFT JOIN fst ON fst.resource_key = nw.resource_key),
 mg AS (SELECT resource_key, max_by(title, ordinal) FILTER (title IS NOT NULL) AS title, max_by(library_file, ordinal) AS library_file, max_by(format, ordinal) AS format,
   max_by(source_url, ordinal) AS source_url, max_by(cc, ordinal) AS cc, max_by(nr, ordinal) AS nr FROM oc WHERE outcome IN ('created', 'updated') GROUP BY 1)"""
QUERIES["index_upsert"] = index_upsert
ORACLE["index_upsert"] = f"""WITH {_UP_CTE} SELECT coalesce(o.resource_key, m.resource_key) AS resource_key, coalesce(m.title, o.title, '') AS title, coalesce(m.library_file, o.library_file) AS library_file,
 coalesce(m.format, o.format) AS format, coalesce(m.source_url, o.source_url) AS source_url, coalesce(m.cc, o.cc) AS classification_confidence, coalesce(m.nr, o.nr) AS needs_review, 'high' AS dedupe_confidence,
 CASE WHEN o.resource_key IS NULL THEN '2024-02-02' ELSE '2024-01-01' END AS created_at, CASE WHEN m.resource_key IS NULL THEN '2024-01-01' ELSE '2024-02-02' END AS updated_at
FROM old o FULL OUTER JOIN mg m ON o.resource_key = m.resource_key"""


def index_duplicates(spark, sf):
    old, new = index_parts(spark, sf)
    _, found = B.index_upsert(old, new, "2024-02-02")
    return found.select("resource_key", "existing_file", "incoming_file", "title", "detected_at", "reason")


QUERIES["index_duplicates"] = index_duplicates
ORACLE["index_duplicates"] = f"""WITH {_UP_CTE} SELECT resource_key, existing_file, library_file AS incoming_file, min_by_title AS title, '2024-02-02' AS detected_at, 'sha256 相同但资料库路径不同' AS reason
 FROM (SELECT resource_key, existing_file, library_file, arg_min(title, ordinal) AS min_by_title FROM oc WHERE outcome = 'duplicate' GROUP BY ALL)"""

QUERIES["index_summary"] = lambda spark, sf: B.index_summary(B.index_outcomes(*index_parts(spark, sf)))
ORACLE["index_summary"] = f"""WITH {_UP_CTE} SELECT count(*) AS input_files, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated,
 count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'failed') AS failed,
 CASE WHEN count(*) FILTER (outcome = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (outcome <> 'failed') > 0 THEN 'partial' ELSE 'failed' END AS status FROM oc"""

QUERIES["organize_summary"] = lambda spark, sf: B.organize_summary(
    classified(spark, sf).withColumn("error", F.when(F.col("ordinal") % 17 == 0, F.lit("missing file")))
)
ORACLE["organize_summary"] = f"""WITH {_LIB_CTE} SELECT count(*) AS input_files, count(*) FILTER (ordinal % 17 > 0) AS organized, count(*) FILTER (ordinal % 17 = 0) AS failed,
 count(*) FILTER (ordinal % 17 > 0 AND pts < 550) AS needs_review, 'partial' AS status FROM l3"""


def fetch_summary(spark, sf):
    rows = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", "downloaded").when(F.col("event_type") == "click", "probed").when(F.col("event_type") == "signup", "skipped").otherwise("failed").alias("outcome")
    )
    return B.fetch_summary(rows)


QUERIES["fetch_summary"] = fetch_summary
ORACLE["fetch_summary"] = """SELECT count(*) AS requested, count(*) FILTER (event_type = 'view') AS downloaded, count(*) FILTER (event_type = 'click') AS probed, 0::BIGINT AS unreachable,
 count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type IN ('purchase', 'error')) AS failed, 'partial' AS status FROM events"""

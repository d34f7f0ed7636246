"""Operators on small built rows; expected values worked out by hand."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators import candidates as C
from shelfwise.operators import catalog as G
from shelfwise.operators import content as A
from shelfwise.operators import details as D
from shelfwise.operators import discovery as V
from shelfwise.operators import filters as X
from shelfwise.operators import grouping as W
from shelfwise.operators import intents as N
from shelfwise.operators import library as B
from shelfwise.operators import pages as P
from shelfwise.operators import ranking as K
from shelfwise.operators import rollups as R
from shelfwise.operators import search as H
from shelfwise.session import written
from shelfwise.operators import sets as Z


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


# ---------------------------------------------------------------- groups
def test_numbering_in_blocks_equals_a_window(spark):
    random.seed(1)
    data = [(i, "hot" if random.random() < 0.6 else f"g{i % 5}", random.choice([1.5, 2.0, 7.25])) for i in range(400)]
    random.shuffle(data)
    df = spark.createDataFrame(data, "ordinal bigint, g string, score double")
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("ordinal")))
    assert rows(W.numbered(df, ["g"], block=7)) == rows(plain)
    best = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "ordinal")))
    assert rows(W.ranked(df, ["g"], "score")) == rows(best)
    first = W.first_of(df, ["g"])
    assert {r["g"]: (r["ordinal"], r["copies"]) for r in first.collect()} == {
        g: (min(o for o, k, _ in data if k == g), sum(k == g for _, k, _ in data)) for g in {k for _, k, _ in data}
    }
    small = spark.createDataFrame([("hot", 1)], "g string, v int")
    assert W.with_group_value(df, small, ["g"]).where("v = 1").count() == sum(k == "hot" for _, k, _ in data)


def test_dedupe_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}") for i in range(100)], "ordinal bigint, k string")
    a = rows(Z.dedupe_first(df.repartition(13), ["k"]))
    assert a == rows(Z.dedupe_first(df.repartition(2, "k"), ["k"]))


# ---------------------------------------------------------------- requests
CASES = [
    ("给8岁孩子找一些四则运算的练习题，最好可打印", dict(status="ready", learner_age=8, stage="小学低年级", learning_domain="数学", core_topic="四则整数运算", resource_goal="练习", resource_types=["习题"], format_preferences=["PDF", "DOC"], constraints=["适合打印"])),
    ("三年级数学 人教版 上册 教材", dict(status="ready", grade=3, subject="数学", version="人教版", volume="上册", intent_type="exact_resource", resource_types=["教材"])),
    ("给5岁孩子找儿歌", dict(status="ready", learner_age=5, stage="学前", learning_domain="音乐", core_topic="儿歌", resource_goal="听赏", difficulty="启蒙", resource_types=["音频", "视频", "歌词"])),
    ("找点学习资料", dict(status="needs_clarification", missing_slots=["learner_age_or_grade", "core_topic"])),
    ("本地有没有恐龙百科的图文", dict(intent_type="local_lookup", core_topic="恐龙百科", learning_domain="百科", subtopics=["恐龙"], source_preferences=["本地资料库"])),
    ("把儿童百科全部都下载", dict(status="needs_clarification", request_scope="full_coverage", missing_slots=["core_topic", "core_topic", "resource_types"])),
    ("小学低年级 拼音", dict(stage="小学低年级", learning_domain="语文", core_topic="拼音识字")),
    ("13岁 数学", dict(learner_age=None, core_topic="数学学习")),
]


@pytest.fixture(scope="module")
def parsed(spark):
    data = [(str(i), q) for i, (q, _) in enumerate(CASES)]
    df = N.ranking_profile(N.parse_intents(spark.createDataFrame(data, "intent_id string, query string")))
    return {int(r["intent_id"]): r for r in df.collect()}, df


@pytest.mark.parametrize("i", range(len(CASES)))
def test_request_slots(parsed, i):
    got = parsed[0][i]
    for slot, want in CASES[i][1].items():
        assert got[slot] == want, slot


def test_tasks_and_profile(parsed):
    tasks = {(r["intent_id"], r["task"]["task_id"]): r["task"] for r in N.plan_tasks(parsed[1]).collect()}
    assert tasks[("0", "task_001")]["query"] == "8岁 四则整数运算 习题 可打印 PDF"
    assert ("3", "task_001") not in tasks
    got = parsed[0][0]
    assert got["prefer"] == ["PDF", "可打印"] and got["must_match"] == ["learner_age", "core_topic"]
    assert got["weights"]["relevance"] == 0.35 and got["weights"]["format"] == 0.15 and got["primary_goal"] == "练习题"
    assert len(parsed[0][5]["clarifying_questions"]) == 2


def test_filters_are_filled_from_slots(spark):
    df = spark.sql("select struct('三年级' as grade, cast(null as string) as subject) as filters, '1' as grade, '数学' as subject, 'v' as version")
    assert N.intent_filters(df, ["grade", "subject", "version"]).first().asDict() == {"grade": "三年级", "subject": "数学", "version": "v"}


# ---------------------------------------------------------------- ranking
CAND = (
    "ordinal bigint, title string, source string, source_name string, source_url string, resource_type string, format string, "
    "stage string, grade string, subject string, learning_domain string, topic string, version string, volume string, provider string, "
    "official boolean, downloadable boolean, requires_auth boolean, metadata_confidence double, detail_page string, resource_id string"
)


def candidate(n, **kw):
    base = dict(ordinal=n, title="三年级数学四则运算练习题 8岁", source="web", source_name="国家平台", source_url="https://a.edu.cn/x.pdf", resource_type="习题", format="pdf",
                stage="小学", grade="三年级", subject="数学", learning_domain="数学", topic="四则运算", version="人教版", volume="上册", provider="p",
                official=True, downloadable=True, requires_auth=False, metadata_confidence=1.0, detail_page=None, resource_id="r")
    base.update(kw)
    return tuple(base[f.split()[0]] for f in CAND.split(", "))


INTENT = dict(intent_id="a", core_topic="四则运算", subject="数学", version="人教版", volume="上册", grade="3", stage="小学", resource_goal="练习",
              resource_types=["习题"], subtopics=["加法", "运算"], format_preferences=["PDF"], prefer=["pdf"], avoid=["来源不明"])


def test_scores(spark):
    df = spark.createDataFrame([
        candidate(1),
        candidate(2, title="恐龙 18", official=None, downloadable=False, source_url="", grade=None, stage=None, subject=None, learning_domain=None, topic=None,
                  version=None, volume=None, source_name="x", resource_type="网页", format="html", metadata_confidence=None, requires_auth=True),
        candidate(3, title="破解 下载器 来源不明"),
    ], CAND)
    got = {r["ordinal"]: r for r in K.rank(df, [INTENT]).collect()}
    one = got[1]["score_breakdown"].asDict()
    # 12 topic + 7 subject + 7 type + 4 subtopic + 3 version + 2 volume = 35, capped at 30
    assert one == dict(relevance=30, age_fit=20, authority=15, accessibility=10, format_fit=10, safety=10, metadata_quality=5, content_evidence=0, preference_fit=1.5)
    assert got[1]["final_score"] == 100.0 and got[1]["quality_level"] == "excellent" and got[1]["rank"] == 1
    assert got[1]["reasons"][:2] == ["主题与四则运算匹配", "领域或学科匹配数学"] and len(got[1]["reasons"]) > 8  # none is cut
    two = got[2]["score_breakdown"].asDict()
    # filled: title, source name, type, format of six -> 3.33
    assert two == dict(relevance=0, age_fit=8, authority=4, accessibility=1, format_fit=3, safety=10, metadata_quality=3.33, content_evidence=0, preference_fit=0)
    assert got[2]["quality_level"] == "reject" and got[2]["rank"] is None
    assert "缺少可访问链接" in got[2]["warnings"] and "候选资源未明确匹配目标年级" in got[2]["warnings"]
    assert got[3]["score_breakdown"]["safety"] == 2 and got[3]["score_breakdown"]["preference_fit"] == -1.5
    assert "包含风险词：破解" in got[3]["warnings"]
    seen, rejected = K.partition_ranked(K.rank(df, [INTENT]))
    assert seen.count() + rejected.count() == 3


def test_age_is_matched_as_a_whole_number(spark):
    df = spark.createDataFrame([candidate(1, title="18岁", grade=None, stage=None), candidate(2, title="适合8岁", grade=None, stage=None)], CAND)
    got = {r["ordinal"]: r["score_breakdown"]["age_fit"] for r in K.rank(df, [dict(intent_id="a", learner_age=8)]).collect()}
    assert got == {1: 8.0, 2: 16.0}


def test_weights_are_normalized(spark):
    df = spark.createDataFrame([candidate(1)], CAND)
    got = K.rank(df, [INTENT], weights={"relevance": 2, "safety": 2}).first()["score_breakdown"]
    assert got["relevance"] == 50 and got["safety"] == 50 and got["authority"] == 0


def test_selection(spark):
    df = spark.createDataFrame([candidate(i, title="四则运算 练习" if i % 2 else "数学", official=i < 6, source=("smartedu-resources" if i == 1 else "w"),
                                          detail_page="https://page" if i == 1 else None) for i in range(10)], CAND)
    scored = K.score(K.pair(df, [INTENT]))
    got = K.select_options(scored, 5).orderBy("rank").collect()
    assert [r["option_id"] for r in got] == ["1", "2", "3", "4", "5"]
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert {r["ordinal"]: r["source_url"] for r in got}[1] == "https://page"
    total = K.selection_summary(scored, 5).first()
    assert total["total_ranked"] == 10 and total["shown_count"] + total["hidden_count"] == 10
    shown = K.mark_shown(K.rank_scored(scored), 5).where("shown").count()
    assert shown == 5
    picks = spark.createDataFrame([("a", "1,b Z")], "intent_id string, pick string")
    done = K.pick_options(K.select_options(scored, 5), picks).orderBy("pick_no").collect()
    assert [r["option_id"] for r in done] == ["1", "2", None] and done[2]["error"] == "选择编号不存在"


def test_too_many_requests_without_assignment(spark):
    df = spark.createDataFrame([candidate(1)], CAND)
    with pytest.raises(ValueError):
        K.pair(df, [dict(intent_id=str(i)) for i in range(2)])
    given = df.withColumn("intent_id", F.lit("a"))
    assert K.rank(given, K.intents_from_rows(spark, [INTENT])).first()["final_score"] == 100.0
    many = df.crossJoin(spark.createDataFrame([("a",), ("b",), (None,), ("unknown",)], "intent_id string"))
    rows = [INTENT | {"intent_id": "a"}, {"intent_id": "b", "core_topic": "none of it"}, INTENT | {"intent_id": None}]
    got = {r["intent_id"]: r["final_score"] for r in K.rank(many, rows).collect()}
    assert set(got) == {"a", "b", None, "unknown"} and got[None] == got["a"] == 100.0 and got["b"] < got["a"]


# ---------------------------------------------------------------- search
def test_search_equals_brute_force(spark):
    random.seed(3)
    words = ["数学", "练习题", "pdf", "唐诗宋词", "abc", "b", "xyz", "语文", "四则运算", "ab"]
    records = [(i, " ".join(random.sample(words, 3)), random.choice(["pdf", "mp3", "docx"]), random.choice(["习题", "音频"]), f"lib/{i}.bin",
                random.choice(["小学", "学前"]), random.choice(["数学", "语文"]), round(random.random(), 2), random.random() < 0.2, random.random() < 0.8) for i in range(60)]
    index = spark.createDataFrame(records, "ordinal bigint, title string, format string, resource_type string, library_file string, stage_or_age string, "
                                           "domain_or_subject string, classification_confidence double, needs_review boolean, file_exists boolean")
    asked = [(1, "数学练习 pdf", "小学", None, ["习题", "xyz pdf", "数学 abc"], ["PDF"]), (2, "唐诗宋词 b", None, "语文", ["b 语文", "abc b"], ["音频"]), (3, "nothing-here", None, None, None, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string, stage string, subject string, resource_types array<string>, format_preferences array<string>")
    every = H.score_index(index.crossJoin(queries)).where("match_score >= 8 and size(match_reasons) > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), "ordinal")
    want = every.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "ordinal", "rank", "match_score")
    got = H.search_index(index, queries, k=10, min_score=8.0)
    assert rows(got, "query_id", "ordinal", "rank", "match_score") == rows(want)
    told = H.explain_matches(got, index, queries).where("query_id = 1").first()
    assert told["match_reasons"][0].startswith("查询词命中：")


def test_score_of_one_record(spark):
    df = spark.sql("""select '四则运算练习' as title, 'pdf' as format, '习题' as resource_type, '小学' as stage_or_age, '数学' as domain_or_subject,
        0.5D as classification_confidence, true as needs_review, true as file_exists, '四则 zzz' as query, '数学' as subject, array('doc') as format_preferences""")
    got = H.score_index(df).first()
    # 40 * 1/2 + 12 subject + 0.5 * 8 + 6 - 4
    assert got["match_score"] == 38.0 and got["match_reasons"] == ["查询词命中：四则", "学科匹配"]
    assert got["match_warnings"] == ["格式与偏好不完全匹配", "资源分类需要复核"]


# ---------------------------------------------------------------- content
PNG = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x00" * 600
GIF = b"GIF89a" + (3).to_bytes(2, "little") + (260).to_bytes(2, "little") + b"\x00" * 20
PDF = b"%PDF-1.4 /Type /Page x /Type/Pages /Type /Page\n" + b"a" * 600
HTML = "<!DOCTYPE html><html><title>T</title><p>正文 text</p></html>".encode()


@pytest.fixture(scope="module")
def signals(spark):
    data = [("a.png", PNG, "png"), ("b.gif", GIF, "gif"), ("c.pdf", PDF, "pdf"), ("d.pdf", b"  " + HTML, "pdf"), ("e.docx", b"PK\x03\x04" + b"0" * 600, "docx"),
            ("f.srt", "1\n00:00:01,000 --> 00:00:02,000\n你好\n\n2\n00:00:03,000 --> 00:00:04,000\n再见".encode(), "srt")]
    df = spark.createDataFrame(data, "local_file string, content binary, format string")
    return df, {r["local_file"]: r for r in A.file_signals(df).collect()}


def test_file_signals(signals):
    got = signals[1]
    assert got["a.png"]["image_size"].asDict() == {"width": 640, "height": 480} and got["a.png"]["analysis_type"] == "image"
    assert got["b.gif"]["image_size"].asDict() == {"width": 3, "height": 260} and "文件过小，可能不是完整资源" in got["b.gif"]["file_warnings"]
    assert got["c.pdf"]["page_count"] == 2 and got["c.pdf"]["file_warnings"] == []
    assert got["d.pdf"]["detected_format"] == "html" and got["d.pdf"]["file_warnings"] == ["文件格式与实际内容不一致：声明为 pdf，实际像 html"]
    assert got["d.pdf"]["text"] == "T 正文 text" and got["d.pdf"]["page_title"] == "T"
    assert got["e.docx"]["detected_format"] == "docx"
    assert got["f.srt"]["text"] == "你好 再见"


def test_content_must_be_what_was_announced(signals):
    df, _ = signals
    mime = F.when(F.col("local_file") == "a.png", F.lit("text/html; charset=utf-8")).otherwise(F.lit("application/octet-stream"))
    fmt = F.when(F.col("local_file") == "c.pdf", F.lit("png")).otherwise(F.col("format"))
    got = {r[0]: r[1] for r in df.select("local_file", A.validate_content(F.col("content"), fmt, F.lit("文档"), mime)).collect()}
    assert got == {"a.png": "响应是 HTML 页面，不是预期的 png 文件", "b.gif": None, "c.pdf": "响应内容不是图片文件", "d.pdf": "响应内容不是 PDF 文件", "e.docx": None, "f.srt": None}


def test_analysis(spark, signals):
    files = A.file_signals(signals[0])
    cands = spark.createDataFrame([(1, "c.pdf", "四则练习", "pdf", "u"), (2, "zz.pdf", "登录后可看", "pdf", "u"), (3, None, "x", None, "http://h/a.htm"), (4, "d.pdf", "", "pdf", "u")],
                                  "ordinal bigint, local_file string, title string, format string, source_url string")
    got = {r["ordinal"]: r for r in A.analyze(cands, files).collect()}
    assert got[1]["analysis"]["evidence_level"] == "basic" and got[1]["analysis"]["analysis_confidence"] == 0.65 and got[1]["analysis"]["keywords"] == ["四则", "练习"]
    assert got[2]["analysis"]["warnings"] == ["文件不存在", "包含风险词：登录", "疑似登录、权限或付费限制页面"]
    assert got[3]["format"] == "html" and got[3]["analysis"]["warnings"] == ["远程抓取未启用"] and got[3]["analysis"]["analysis_confidence"] == 0.25
    assert got[4]["format"] == "html" and got[4]["title"] == "T" and got[4]["analysis"]["analysis_confidence"] == 0.85


# ---------------------------------------------------------------- details
RESOURCE = {
    "detail_id": "d1", "ordinal": 1, "id": "res1", "title": "分数", "global_title": None, "original_title": "拓展", "alias_name": None, "description": None, "catalog": "syncClassroom",
    "resource_type_code": None, "resource_type_code_name": "", "provider_list": [{"name": " 人教社 "}, {"name": ""}],
    "tag_list": [{"tag_dimension_id": "zxxnj", "tag_name": "三年级"}, {"tag_dimension_id": "zxxnj", "tag_name": "四年级"}, {"tag_dimension_id": "zxxxk", "tag_name": "数学"}],
}


def item(**kw):
    base = dict(ti_format=None, lc_ti_format=None, ti_file_flag=None, ti_storage=None, ti_storages=[], ti_size=None, identification=None, requirements=[])
    base.update(kw)
    return base


def resource_frame(spark, **extra):
    items = [
        item(ti_format="application/x-mpegURL", ti_file_flag="href-m3u8", ti_storages=["https://r1-ndr-private.ykt.cbern.com.cn/v/a b.m3u8"]),
        item(ti_format="pdf", ti_file_flag="lesson", ti_storage="cs_path:${ref-path}/p/数.pdf", requirements=[{"name": "FILESIZE", "value": "12"}]),
        item(lc_ti_format="image/jpeg", ti_storages=["https://c/x.jpeg"], ti_size="7"),
        item(ti_format="folder", ti_storages=["https://c/dir"]),
        item(ti_format="pdf"),
    ]
    kid = dict(RESOURCE, id="kid", title=None, provider_list=[], tag_list=[], ti_items=[item(ti_format="pdf", ti_storages=["https://c/k.pdf"])])
    for k in ("detail_id", "ordinal"):
        kid.pop(k)
    again = dict(kid, id="res1")
    data = dict(RESOURCE, ti_items=items, relations={"national_course_resource": [kid, again], "course_resource": None, "resources": [dict(kid, id="none", ti_items=None)], "resource": None})
    data.update(extra)
    kind = StructType.fromDDL(D.RESOURCE).simpleString()
    rel = ",".join(f"{r}:array<{kind}>" for r in D.RELATIONS)
    schema = f"detail_id string, ordinal bigint, {D.RESOURCE}, relations struct<{rel}>"
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    return spark.createDataFrame([tuple(data[n] for n in names)], schema)


def test_detail_candidates(spark):
    related = D.related_details(resource_frame(spark))
    assert rows(related, "id", "title") == [("kid", "分数"), ("res1", "分数")]
    got = C.detail_candidates(related, {"stage": "小学"})
    by = {(r["resource_id"].split(":")[0], r["item_index"]): r for r in got.collect()}
    assert {k: v["format"] for k, v in by.items()} == {("res1", 1): "m3u8", ("res1", 2): "pdf", ("res1", 3): "jpg", ("kid", 1): "pdf"}
    first, second, third = by[("res1", 1)], by[("res1", 2)], by[("res1", 3)]
    assert first["url_candidates"] == ["https://r1-ndr-private.ykt.cbern.com.cn/v/a%20b.m3u8", "https://r1-ndr.ykt.cbern.com.cn/v/a%20b.m3u8"]
    assert first["requires_auth"] and first["title"] == "分数 - 拓展 - M3U8" and first["resource_type"] == "视频"
    assert len(second["url_candidates"]) == 4 and second["url_candidates"][1].endswith("/p/%E6%95%B0.pdf")
    assert second["title"] == "分数 - 拓展 - lesson" and second["size"] == 12 and second["grade"] == "三年级" and second["subject"] == "数学" and second["stage"] == "小学"
    assert third["size"] == 7 and third["requires_auth"] is False and third["provider"] == "人教社" and third["metadata_confidence"] == 1.0
    counts = C.detail_counts(related, got).first()
    assert counts.asDict() == {"items_seen": 6, "candidates": 4, "skipped": 2}


def test_file_urls_keep_plain_ones_and_encode_others(spark):
    private = "https://r3-ndr-private.ykt.cbern.com.cn/"
    listed = ["https://h/a-b_c.~1/x:2.pdf", "https://h/a b?q=1 2", "https://h/a%2Fb+c", None, "", private + "p 1.pdf", "https://h/a-b_c.~1/x:2.pdf", "\u6570"]
    df = spark.createDataFrame([(" cs_path:${ref-path}/x y+%7e", listed), ("cs_path", None), (None, [])], "s string, u array<string>")
    got = [r[0] for r in df.select(D.storage_urls(F.col("s"), F.col("u"))).collect()]
    hosts = ["https://r1-ndr-private.ykt.cbern.com.cn", *(f"https://r{k}-ndr.ykt.cbern.com.cn" for k in (1, 2, 3))]
    assert got[0][:4] == [h + "%20/x%20y%2B~" for h in hosts]
    assert got[0][4:] == [
        "https://h/a-b_c.~1/x:2.pdf", "https://h/a%20b?q=1 2", "https://h/a/b%2Bc", private + "p%201.pdf", hosts[1] + "/p%201.pdf", "%E6%95%B0",
    ]
    assert got[1:] == [[], []]


def test_steps_of_a_file_are_generated_code(spark):
    related = D.related_details(resource_frame(spark))
    plan = C.detail_candidates(related)._jdf.queryExecution().optimizedPlan().toString()
    opened = [line for line in plan.splitlines() if "Generate inline" in line and "_item" in line]
    assert opened and not [line for line in opened if "lambda" in line]


def test_identities(spark):
    url = "https://basic.smartedu.cn/syncClassroom/classActivity?activityId=a1&subCatalog=s"
    got = spark.range(1).select(D.identity_from_url(F.lit(url)).alias("i")).first()["i"]
    assert got.asDict() == dict(resource_id="a1", tab_code="syncClassroom", catalog="syncClassroom", sub_catalog="s", content_type="national_lesson")
    page = spark.range(1).select(D.detail_page(F.lit("a b"), F.lit("x"), F.lit(None), F.lit(""))).first()[0]
    assert page == "https://basic.smartedu.cn/x/detail?contentType=resource&contentId=a%20b&catalogType=x&subCatalog="
    raw = '{"x": {"detailUrl": "https://a/d.json?x=1", "page": "https://b/p.html"}, "y": ["https://c/details/1"]}'
    assert spark.range(1).select(D.explicit_detail_urls(F.lit(raw))).first()[0] == ["https://a/d.json?x=1", "https://c/details/1"]


def items_frame(spark):
    data = [
        {"id": "1", "title": "<b>课件</b>.pptx", "catalog": "c1", "contentType": "lesson", "tags": [{"dimension_id": "zxxbb", "title": "人教版"}], "extra": {"providers": [{"name": "甲"}, {"name": "乙"}]}},
        {"resource_id": "2", "content_name": "课程", "resource_type": "elite_lesson", "gradeName": "四年级"},
    ]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(data, 1)], "ordinal bigint, body string")
    return df.withColumn("item", F.parse_json("body"))


def test_search_items(spark):
    got = {r["ordinal"]: r for r in C.item_candidates(items_frame(spark), "课", {"grade": "三年级"}).collect()}
    assert got[1]["title"] == "课件.pptx" and got[1]["format"] == "pptx" and got[1]["resource_type"] == "课件" and got[1]["version"] == "人教版"
    assert got[1]["grade"] == "三年级" and got[1]["provider"] == "甲/乙" and got[1]["topic"] == "课" and got[1]["downloadable"] is False
    assert got[2]["grade"] == "四年级" and got[2]["source_url"] == "https://basic.smartedu.cn/qualityCourse?courseId=2" and got[2]["format"] == "网页"
    known = {r["ordinal"]: r for r in C.item_identity(items_frame(spark)).collect()}
    assert (known[1]["resource_id"], known[1]["catalog"], known[1]["content_type"]) == ("1", "c1", "lesson")
    assert (known[2]["catalog"], known[2]["content_type"], known[2]["tab_code"]) == ("qualityCourse", "elite_lesson", "qualityCourse")


def test_textbook_records(spark):
    df = spark.sql("""select 'b1' as id, cast(null as string) as global_resource_id, '数学' as title, cast(null as string) as description, 'pdf' as format, 5L as size,
      array(named_struct('tag_dimension_id', 'zxxxd', 'tag_name', '小学')) as tag_list, map('Slide10', 'u10', 'Slide2', 'u2') as preview, array() as thumbnails,
      array(named_struct('name', cast(null as string))) as provider_list, cast(null as string) as resource_type_code""")
    got = D.textbook_records(df).first()
    assert got["preview_urls"] == ["u2", "u10"] and got["thumbnail"] == "u2" and got["stage"] == "小学" and got["providers"] == ["智慧中小学"]
    assert got["detail_page"].startswith("https://basic.smartedu.cn/tchMaterial/detail?contentType=assets_document&contentId=b1")
    assert C.textbook_candidates(D.textbook_records(df)).first()["metadata_confidence"] == 0.33


def test_probe_ladders(spark):
    df = spark.createDataFrame([(403, False, None, ""), (200, True, 2, ""), (200, True, 0, ""), (None, False, None, "x"), (200, False, None, "json decode failed"), (500, False, None, "x"), (200, False, None, "")],
                               "s int, d boolean, n int, e string")
    status = D.classify_probe(F.col("s"), F.col("d"), F.col("n"), F.col("e"), F.lit(False))
    assert [r[0] for r in df.select(status).collect()] == ["requires_auth", "ok_with_file_items", "ok_no_file_items", "request_failed", "invalid_json", "request_failed", "unknown"]
    assert spark.range(1).select(D.access_policy(F.lit("not_found"))).first()[0] == "unavailable_or_template_unknown"
    probe = spark.createDataFrame([(None, None, None, None, None, None)], "detail_status string, detail_access_policy string, detail_endpoint_family string, file_item_count int, parsed_candidate_count int, error string")
    got = D.probe_summary(probe).first()
    assert (got["detail_status"], got["error"], got["failed"]) == ("unknown", "unknown", True)


def test_tag_filter_keeps_a_group_it_would_empty(spark):
    df = spark.createDataFrame([(1, "a", "人教版"), (2, "a", "北师大版"), (3, "a", None), (4, "b", "苏教版")], "ordinal bigint, g string, version string")
    assert rows(X.filter_by_tags(df, "人教版", ["g"]), "ordinal") == [(1,), (3,), (4,)]


# ---------------------------------------------------------------- pages
PAGE = """<html><head><title>资源 下载</title><meta name="description" content="数学&amp;语文"></head><body><!-- <a href="no.pdf">no</a> -->
<a href="files/a.pdf">练习 <b>一</b></a><a href='/b.JPEG?x=1'></a><a href="/course/detail?id=1">详情</a><a href="?page=2">下一页</a>
<form action="/s"></form><script src="/js/app.js"></script><script>var u="/api/search/list";</script></body></html>"""


def test_page_profile(spark):
    df = spark.createDataFrame([(1, "https://h.edu.cn/d/p.html", PAGE)], "page_id bigint, url string, html string")
    got = P.site_profile(df).first()
    assert (got["title"], got["description"], got["site_type"], got["crawl_strategy"]) == ("资源 下载", "数学&语文", "static_resource_page", "generic_extract")
    assert [l["link"] for l in got["resource_links"]] == ["https://h.edu.cn/d/files/a.pdf", "https://h.edu.cn/b.JPEG?x=1"]
    assert got["api_hints"] == ["https://h.edu.cn/api/search/list"] and got["script_hints"] == ["https://h.edu.cn/js/app.js"]
    assert got["pagination_hints"] == ["https://h.edu.cn/d/p.html?page=2"] and got["detail_link_hints"] == ["https://h.edu.cn/course/detail?id=1"]
    assert (got["form_count"], got["script_count"], got["link_count"], got["score"]) == (1, 1, 4, 8.6)
    links = C.profile_links(P.site_profile(df)).withColumn("ordinal", F.col("pos").cast("bigint"))
    found = {r["source_url"]: r for r in C.link_candidates(links, {"grade": "三年级"}).collect()}
    first = found["https://h.edu.cn/d/files/a.pdf"]
    assert (first["title"], first["description"], first["resource_type"], first["official"], first["metadata_confidence"]) == ("练习 一", "来自 资源 下载", "习题", True, 1.0)
    assert found["https://h.edu.cn/b.JPEG?x=1"]["title"] == "b" and first["grade"] is None
    assert C.extraction_summary(P.site_profile(df), C.link_candidates(links)).first().asDict() == {"profiles": 1, "links_seen": 2, "candidates": 2, "skipped": 0}
    hints = P.page_profile(df).first()
    assert hints["next_actions"] == ["candidates-from-detail", "search-resources", "learning-resource-analyzer"] and hints["page_type"] == "detail_or_detail_capable_page"


def test_result_page(spark):
    html = """<a class="result__a" href="/l/?uddg=https%3A%2F%2Fa.cn%2F1">第<b>一</b></a><div class="result__snippet">摘要一</div>
    <a class="x result__a" href="https://b.cn/2">二</a><a class="result__snippet" href="#">摘要 二</a>"""
    got = rows(P.result_page_anchors(spark.createDataFrame([(1, html)], "k int, html string"), ["k"], "html"))
    assert got == [(1, 0, "https://a.cn/1", "第 一", "摘要一"), (1, 1, "https://b.cn/2", "二", "摘要 二")]


def test_discovery(spark):
    df = spark.createDataFrame([
        (1, "高速下载器", "https://x.cn/a.pdf"), (2, "教材", "https://basic.smartedu.cn/tchMaterial?x"), (3, "练习题 PDF 下载", "https://a.edu.cn/list"),
        (4, "如何学习", "https://b.cn/"), (5, "文件", "https://b.cn/x.pdf"), (6, "随便", "https://c.cn/"),
    ], "ordinal bigint, title string, source_url string")
    got = {r["ordinal"]: r for r in V.source_discovery(df).collect()}
    assert [got[i]["source_type"] for i in range(1, 7)] == ["download_risk", "known_source", "resource_site", "article_page", "resource_page", "unknown"]
    assert got[1]["accepted"] is False and got[1]["source_score"] <= 2.0 and got[2]["known_skill"] == "smartedu-resources"
    # 6.5 + 8 * .25 + (4 terms * 2 + 1 hint * 1.5) * .35 + 7 * .2 + 10 * .2, at most 10
    assert got[3]["resource_format_hints"] == ["pdf"] and got[3]["source_score"] == 10.0
    # 6.0 + .75 + (1 term * 2 + 1 hint * 1.5) * .35 + 8 * .2 + 2 = 11.575, at most 10
    assert got[5]["source_score"] == 10.0
    # 3.5 + .75 + 7 * .2 + 2 and 2.5 + .75 + 7 * .2 + 2
    assert got[4]["source_score"] == 7.65 and got[6]["source_score"] == 6.65
    assert V.discovery_summary(V.source_discovery(df)).first()["rejected"] == 1


def test_first_of_many_source_rules(spark):
    rng = random.Random(4)
    parts = [f"site{k}.example" for k in range(300)] + ["", "example", "site1"]
    folders = [f"/f{k}/" for k in range(200)] + ["", "/"]
    rules = [(k, rng.choice(parts), rng.choice(folders), f"a{k}", f"r{k}") for k in range(50_000)] + [(-1, None, "", "none", "none")]
    items = [(k, f"www.site{rng.randrange(400)}.example.org" if k % 3 else None, f"/f{rng.randrange(300)}/x" if k % 5 else "") for k in range(400)]
    items += [(1000 + k, "www.site5.example.org", "/f9/x") for k in range(2000)]
    table = spark.createDataFrame(items, "ordinal long, host string, path string")
    got = {r["ordinal"]: r["adapter"] for r in V.known_sources(table, spark.createDataFrame(rules, "rule long, host_part string, path_part string, adapter string, reason string")).collect()}
    want = {}
    for pair in {(h or "", p) for _, h, p in items}:
        want[pair] = next((a for _, h, p, a, _ in rules if h is not None and h in pair[0] and p in pair[1]), None)
    assert got == {k: want[h or "", p] for k, h, p in items}


def test_ranks_of_one_huge_group_with_distinct_scores(spark, monkeypatch):
    rng = random.Random(6)
    rows_ = [(k, "hot" if k % 10 else None, rng.getrandbits(63)) for k in range(20_000)]
    df = spark.createDataFrame(rows_, "ordinal long, intent_id string, score long").repartition(6)
    kept = []
    monkeypatch.setattr(W, "written", lambda d: kept.append(written(d)) or kept[-1])
    got = {r["ordinal"]: r["rank"] for r in W.ranked(df, ["intent_id"], "score").collect()}
    want = {}
    for name in ("hot", None):
        group = sorted((r for r in rows_ if r[1] == name), key=lambda r: (-r[2], r[0]))
        want |= {r[0]: n for n, r in enumerate(group, 1)}
    assert got == want
    # the ranges that adaptive execution may join again are cut inside the group
    parts = kept[0].groupBy("_part").count().collect()
    assert len(parts) == 1 or max(r["count"] for r in parts) < 0.5 * len(rows_)


def test_search_scores_few_pairs_and_keeps_hot_tokens(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(["hot", *rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=30)]) for _ in range(600)]
    index = spark.createDataFrame([(k, t, "pdf" if k % 2 else "doc", k % 100 / 100.0, k % 7 == 0, k % 5 > 0) for k, t in enumerate(texts)],
                                  "ordinal long, title string, format string, classification_confidence double, needs_review boolean, file_exists boolean")
    for name in ("resource_type", "source_url", "library_file", "stage_or_age", "grade_or_phase", "domain_or_subject", "topic_or_type", "source_or_version"):
        index = index.withColumn(name, F.lit("math" if name == "domain_or_subject" else "").cast("string"))
    asked = [(k, " ".join(rng.sample(texts[rng.randrange(600)].split(), 14)), ["pdf"] if k % 2 else None, "Math" if k % 3 == 0 else None) for k in range(25)]
    asked += [(90, "hot", None, None), (91, "", None, "math"), (92, "nowhere", None, None), (93, None, ["doc"], None)]
    queries = spark.createDataFrame(asked, "query_id long, query string, format_preferences array<string>, subject string")
    every = H.score_index(index.crossJoin(queries)).where("match_score >= 8.0 and size(match_reasons) > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), "ordinal")
    want = every.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("query_id", "ordinal", "rank", "match_score")
    assert rows(H.search_index(index, queries, k=3, min_score=8.0), "query_id", "ordinal", "rank", "match_score") == rows(want)
    pairs = H.search_candidates(index, queries.where("query_id < 90"), k=3, min_score=8.0)
    assert pairs.count() < 0.15 * 600 * 25


def test_search_scores_under_a_tenth_of_the_given_pairs(spark):
    from checks import documents

    sf = "/root/testdata/sf0.01"
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, F.lit("English")).alias("subject")
    )
    index = documents.library_index(spark, sf)
    pairs = H.search_candidates(index, queries, k=3, min_score=8.0).count()
    assert 3 * queries.count() <= pairs < 0.1 * index.count() * queries.count()


# ---------------------------------------------------------------- catalog
def test_tree_of_unknown_depth(spark):
    df = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "c", "D"), ("e", None, "E")], "id string, up string, name string")
    got = {r["id"]: (r["depth"], r["parent"], r["path"]) for r in G.flatten_tree(df, "id", "up", "name").collect()}
    assert got == {"a": (1, "", "A"), "b": (2, "A", "A/B"), "c": (3, "B", "A/B/C"), "d": (4, "C", "A/B/C/D"), "e": (1, "", "E")}


def test_tree_deeper_than_any_fixed_number_and_cycles(spark):
    rows = [("0", None, "t")] + [(str(i), str(i - 1), "t") for i in range(1, 6)]
    schema = "id string, up string, name string"
    assert G.flatten_tree(spark.createDataFrame(rows, schema), "id", "up", "name").count() == 6
    chain = [("n0", None, "t")] + [(f"n{i}", f"n{i - 1}", None if i % 3 else f"t{i}") for i in range(1, 5000)]
    deep = {r["id"]: r for r in G.flatten_tree(spark.createDataFrame(chain, schema), "id", "up", "name").collect()}
    assert len(deep) == 5000 and deep["n4999"]["depth"] == 5000 and deep["n4999"]["parent"] == "t4998" and deep["n4"]["path"] == "t/t3"
    wide = [("r", None, "R"), ("lost", "nowhere", "L")] + [(f"c{i}", "r", f"C{i}") for i in range(3000)] + [(f"g{i}", "c7", "G") for i in range(3000)]
    got = G.flatten_tree(spark.createDataFrame(wide, schema), "id", "up", "name")
    assert got.count() == 6001 and got.where("depth = 3 and path = 'R/C7/G'").count() == 3000
    with pytest.raises(Exception, match="cycle in the tree"):
        G.flatten_tree(spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("a", "b", "A")], schema), "id", "up", "name").collect()


def test_nothing_is_cut(spark):
    from shelfwise.operators import pages as P

    filler = "word " * 1500
    urls = "".join(f'"/api/v{i}" ' for i in range(60))
    scripts = "".join(f'<script src="/s{i}.js"></script>' for i in range(35))
    html = f"<html>{filler}{scripts}<script>{urls}</script><b>librarylist</b></html>"
    page = spark.createDataFrame([(1, "https://a.cn/", html)], "page_id bigint, url string, html string")
    row = P.page_profile(page).first()
    assert row["page_type"] == "catalog_config_page" and len(row["script_sources"]) == 35
    assert page.select(F.size(P.api_hints("html", "url"))).first()[0] >= 60
    late = spark.createDataFrame([(bytearray(b" " * 9000 + b"<!DOCTYPE html>"),)], "content binary")
    assert late.select(A.sniff_format(F.col("content"), F.lit("txt"))).first()[0] == "html"
    assert late.select(A.file_kind(F.col("content"))).first()[0] == "html"
    result = f'<a class="result__a" href="https://b.cn/">T</a>{filler}<div class="result__snippet">late</div>'
    found = P.result_page_anchors(spark.createDataFrame([(1, result)], "page_id bigint, html string"), ["page_id"], "html").first()
    assert found["snippet"] == "late"


def test_first_row_with_ties_and_without_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), (None, 1 << 60, "z"), (None, 5, "w")], "g string, ordinal bigint, v string")
    got = {r["g"]: (r["v"], r["copies"]) for r in W.first_of(df, ["g"]).collect()}
    assert got == {"a": ("x", 3), None: ("w", 2)} and W.first_of(df, ["g"]).count() == 2


def test_scan_dedupes_over_routes(spark):
    routes = spark.createDataFrame([("r1", "search_then_detail", "t1"), ("r2", "search_then_detail", "t2"), ("r3", "internal_adapter", "t3")], "route_id string, scan_strategy string, title string")
    items = spark.createDataFrame([(1, "r1", "u1", "i", None), (2, "r2", "u1", "i", None), (3, "r2", None, "i2", None), (4, "r1", "u9", "i", "boom"), (5, "r3", "u5", "i", None)],
                                  "ordinal bigint, route_id string, source_url string, resource_id string, error string")
    found, lost = G.site_scan(routes, items)
    assert rows(found, "ordinal", "copies") == [(1, 2), (3, 1)] and rows(lost, "ordinal") == [(4,)]


def test_matrix_conclusion(spark):
    base = dict(tab_code="t", resource_type="x", resource_type_name="", catalog="c", sub_catalog="", content_type="l")
    data = [dict(base, ordinal=1, resource_id="a", detail_status="requires_auth", detail_access_policy="requires_auth_context", file_item_count=0, parsed_candidate_count=0),
            dict(base, ordinal=2, resource_id="a", detail_status="not_found", detail_access_policy="p", file_item_count=1, parsed_candidate_count=0)]
    df = spark.createDataFrame([tuple(d.values()) for d in data], list(data[0]))
    got = R.probe_matrix(df).first()
    assert got["conclusion"] == "需要授权" and got["sample_resource_ids"] == ["a"] and got["file_item_count"] == 1


# ---------------------------------------------------------------- library and index
def test_classes_and_paths(spark):
    df = spark.createDataFrame([
        (1, "四则口算", "f/a.PDF", "pdf", "习题", "h1", "小学", "三年级", None, None, "人教版"),
        (2, "四则口算", "f/b.pdf", "pdf", "习题", "h1", "小学", "三年级", None, None, "人教版"),
        (3, None, "f/c.json", "mp3", None, "h2", None, None, None, None, None),
        (4, "题", "f/d.png", "pdf", "习题", "h3", "小学", "三年级", "数学", "t", "v"),
    ], "ordinal bigint, title string, local_file string, format string, resource_type string, sha256 string, stage string, grade string, subject string, topic string, version string")
    got = {r["ordinal"]: r for r in B.library_paths(B.classify_library(df), root="lib").collect()}
    assert got[1]["library_file"] == "lib/小学/三年级/数学/习题/人教版/四则口算_h1.pdf" and got[2]["library_file"].endswith("四则口算_h1_2.pdf")
    assert got[1]["classification_confidence"] == 1.0 and got[1]["needs_review"] is False
    assert got[3]["library_file"] == "lib/待确认/mp3/c_h2.mp3" and got[3]["classification_confidence"] == 0.38
    assert got[4]["needs_review"] is True and got[4]["library_file"] == "lib/待确认/pdf/题_h3.pdf"
    assert X.block_library_suffix(df, "local_file").count() == 3


def batch(spark, *data):
    return spark.createDataFrame([tuple(d) for d in data], "ordinal bigint, title string, library_file string, sha256 string, classification_confidence double, needs_review boolean")


def empty_index(spark):
    from shelfwise.sources.readers import INDEX_RECORD

    return spark.createDataFrame([], INDEX_RECORD)


def test_upsert(spark):
    t1, t2 = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    first = batch(spark, (1, "A", "l/a", "k1", 0.5, True), (2, "", "l/a", "k1", None, None), (3, "B", "l/b", "k1", 0.9, False), (4, "C", "l/c", None, 0.1, False), (5, "D", "", "k5", 0.1, False))
    assert rows(B.index_outcomes(empty_index(spark), first), "ordinal", "outcome") == [(1, "created"), (2, "updated"), (3, "duplicate"), (4, "created"), (5, "failed")]
    index, dup = B.index_upsert(empty_index(spark), first, t1)
    by = {r["resource_key"]: r for r in index.collect()}
    assert set(by) == {"k1", "path:l/c"} and by["k1"]["title"] == "A" and by["k1"]["needs_review"] is True and by["path:l/c"]["dedupe_confidence"] == "low"
    assert rows(dup, "existing_file", "incoming_file") == [("l/a", "l/b")]
    index = spark.createDataFrame(index.collect(), index.schema)
    again, dup2 = B.index_upsert(index, batch(spark, (1, "A2", "l/a", "k1", 0.7, False)), t2)
    got = {r["resource_key"]: r for r in again.collect()}["k1"]
    assert (got["title"], got["classification_confidence"], got["created_at"], got["updated_at"]) == ("A2", 0.7, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1))
    assert dup2.count() == 0
    twice = B.merge_duplicates(dup, dup)
    assert twice.count() == 1
    total = B.index_summary(B.index_outcomes(empty_index(spark), first)).first()
    assert (total["created"], total["updated"], total["duplicates"], total["failed"], total["status"]) == (2, 1, 1, 1, "partial")


def test_statuses(spark):
    cases = [("failed", None, None, 0, "post_selection_failed"), (None, None, None, 0, "post_selection_failed"), ("partial", None, None, 0, "post_selection_partial"),
             ("completed", "partial", "completed", 0, "post_selection_partial"), ("completed", None, None, 2, "post_selection_probed"), ("completed", None, None, 0, "post_selection_downloaded"),
             ("completed", "completed", "completed", 0, "post_selection_completed")]
    df = spark.createDataFrame(cases, "d string, o string, i string, p int, want string")
    assert df.where(B.post_selection_status("d", "o", "i", "p") != F.col("want")).count() == 0


def test_skip_reasons(spark):
    df = spark.createDataFrame([(True, []), (False, ["含下载器"]), (False, []), (None, ["x"])], "a boolean, w array<string>")
    assert [r[0] for r in df.select(X.should_skip(F.col("a"), F.col("w"))).collect()] == ["需要登录或授权访问", "候选存在风险提示", None, None]
    assert df.select(X.should_skip(F.col("a"), F.col("w"), allow_auth=True)).first()[0] == "需要授权上下文"
    assert df.select(X.should_skip(F.col("a"), F.col("w"), allow_auth=True, auth_context=True)).first()[0] is None


def test_later_sources_only_when_short(spark):
    def source(name, start, counts):
        return spark.createDataFrame([(start + i, q, name) for q, n in counts.items() for i in range(n)], "ordinal bigint, intent_id string, source string")

    got = Z.source_first(source("local", 0, {"a": 9, "b": 3}), source("site", 100, {"a": 9, "b": 9, "c": 2}), source("web", 200, {"a": 1, "b": 1, "c": 1, "d": 1}), 5, 8)
    assert rows(got.groupBy("intent_id", "source").count()) == [("a", "local", 9), ("b", "local", 3), ("b", "site", 9), ("c", "site", 2), ("c", "web", 1), ("d", "web", 1)]


def test_download_and_summary_rows(spark):
    df = spark.sql("select '1' as option_id, '' as title, 'f/x' as local_file, named_struct('title', 'T', 'source_url', 'u', 'format', 'pdf', 'resource_type', 'r', 'size', 3L, 'stage', 's') as candidate, 'h' as sha256")
    got = C.download_candidates(df).first()
    assert (got["title"], got["format"], got["stage"], got["local_file"], got["size"]) == ("T", "pdf", "s", "f/x", 3)
    q = spark.range(1).select(C.build_query({"learner_age": "8", "grade": "三年级", "core_topic": "四则", "resource_types": ["习题", "四则"]}, printable=True)).first()[0]
    assert q == "8岁 三年级 四则 习题 可打印"


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, "a/x.pdf"), (2, "a/x.pdf"), (3, "a/y"), (4, "a/x.pdf"), (5, "a/y")], "ordinal bigint, path string")
    assert rows(B.unique_paths(df, block=2)) == [(1, "a/x.pdf"), (2, "a/x_2.pdf"), (3, "a/y"), (4, "a/x_3.pdf"), (5, "a/y_2")]


def placed_one_by_one(items, taken=()):
    used, out = set(taken), []
    for ordinal, path in sorted(items):
        stem, tail = os.path.splitext(path)
        name, n = path, 2
        while name in used:
            name, n = f"{stem}_{n}{tail}", n + 1
        used.add(name)
        out.append((ordinal, name))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_that_no_two_items_share(spark, seed):
    rng = random.Random(seed)
    names = ["a.pdf", "a_2.pdf", "a_3.pdf", "a_2_2.pdf", "a_4.pdf", "a_2_2_2.pdf", "a_7.pdf", "b.c", "b_2.c", "d", "d_2", "a_02.pdf", "x/y_2.t", "x/y.t"]
    items = [(3 * k, rng.choice(names[: rng.randrange(2, 15)])) for k in range(120)]
    taken = rng.sample(names, 4) if seed else []
    df = spark.createDataFrame(items, "ordinal bigint, path string")
    there = spark.createDataFrame([(n,) for n in taken], "path string") if taken else None
    got = B.unique_paths(df, block=rng.choice([2, 7]), taken=there)
    assert sorted(tuple(r) for r in got.collect()) == placed_one_by_one(items, taken)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a"), (5, None)], "ordinal bigint, path string")
    assert [r[1] for r in sorted(map(tuple, B.unique_paths(first).collect()))] == ["a", "a_2", "a_2_2", "a_3", None]
    many = spark.range(30).select(F.col("id").alias("ordinal"), (F.col("id") % 2).alias("g"))
    assert D.detail_options(many).count() == 12 and D.detail_options(many, ["g"], 3).count() == 6
    assert rows(Z.gate_by_count(many.withColumnRenamed("g", "intent_id"), 15), "n", "enough") == [(15, True), (15, True)]
    urls = R.attempt_urls(F.lit("u1"), F.array(F.lit("u2"), F.lit("u1")), F.lit(None).cast("string"), F.lit("u3"))
    assert spark.range(1).select(urls).first()[0] == ["u1", "u2", "u3"]
    profiles = spark.createDataFrame([("generic_extract",), ("dedicated_source_skill",), ("reject",)], "crawl_strategy string")
    assert V.profile_summary(profiles).first().asDict() == {"profiled": 3, "dedicated_source_recommended": 1, "generic_extract_recommended": 1}
    levels = spark.createDataFrame([("high",), ("low",), ("reject",)], "quality_level string")
    assert X.visible_levels(levels).count() == 1 and X.visible_levels(levels, include_low=True).count() == 2
    assert rows(R.status_counts(levels, "quality_level"), "value", "n") == [("high", 1), ("low", 1), ("reject", 1)]


def test_index_candidates_drop_placeholders(spark):
    df = spark.sql("""select 'k' as resource_key, '' as title, 'pdf' as format, '习题' as resource_type, 'u' as source_url, 'lib/a/题.pdf' as library_file, '未分学段' as stage_or_age,
      '三年级' as grade_or_phase, '综合' as domain_or_subject, '未分主题' as topic_or_type, '人教版' as source_or_version, 0.8D as classification_confidence, 36.5D as match_score, true as file_exists""")
    got = C.index_candidates(df).first()
    assert (got["title"], got["stage"], got["grade"], got["subject"], got["topic"], got["version"]) == ("题", None, "三年级", None, None, "人教版")
    # 0.35 + 0.25 + 0.35 * 0.8 + 0.05
    assert got["metadata_confidence"] == 0.93 and got["description"].endswith("36.5")


def test_term_table_equals_literal_hits(spark):
    from shelfwise.functions.match import hits

    docs = spark.createDataFrame([(1, "The thing, ring"), (2, "数学练习题"), (3, "")], "k int, t string")
    terms = ["thing", "in", "学练", "ring", "z"]
    want = sorted((r["k"], h) for r in docs.select("k", hits(F.lower("t"), terms).alias("h")).collect() for h in r["h"])
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    assert rows(H.term_hits(docs, "k", "t", table)) == want


def test_lexicon_rows(spark):
    from shelfwise.sources.readers import load_lexicon

    df = spark.createDataFrame([("subject", 2, "语文", "拼音"), ("subject", 1, "数学", "四则"), ("subject", 3, "语文", "识字"), ("risk", 1, None, "破解")],
                               "lexicon string, ordinal int, label string, term string")
    assert load_lexicon(df) == {"subject": [("数学", ["四则"]), ("语文", ["拼音", "识字"])], "risk": [("", ["破解"])]}
    with pytest.raises(ValueError):
        load_lexicon(df, max_terms=3)


def test_null_and_blank_keys_keep_their_rows(spark):
    from pyspark.sql import functions as F

    from shelfwise.operators import catalog, details, filters, grouping

    rows = spark.createDataFrame([(1, None, 5), (2, None, 7), (3, "a", 1)], "ordinal long, intent_id string, score int")
    got = {r["ordinal"]: r["rank"] for r in grouping.ranked(rows, ["intent_id"], "score").collect()}
    assert got == {1: 2, 2: 1, 3: 1}

    items = spark.createDataFrame([(1, None, None), (2, "g", "人教版"), (3, "g", "北师大版")], "ordinal long, g string, version string")
    kept = {r["ordinal"] for r in filters.filter_by_tags(items, "人教版", ["g"]).collect()}
    assert kept == {1, 2}

    lookups = spark.createDataFrame([(1, "c", ""), (2, "c", None), (3, "c", "x")], "ordinal long, catalog string, resource_id string")
    found = spark.createDataFrame([("c", 1), ("c-x", 2)], "detail_key string, detail int")
    got = {r["ordinal"]: (r["detail"], r["lookup_status"]) for r in details.attach_details(lookups, found).collect()}
    assert got == {1: (None, "missing_resource_id"), 2: (None, "missing_resource_id"), 3: (2, "ok")}

    routes = spark.createDataFrame([("r", "search_then_detail", "t")], "route_id string, scan_strategy string, title string")
    seen = spark.createDataFrame(
        [(1, "r", None, "", "one"), (2, "r", "", None, "two"), (3, "r", None, "", "one"), (4, "r", "u", None, "four")],
        "ordinal long, route_id string, source_url string, resource_id string, title string",
    ).withColumn("error", F.lit(None).cast("string"))
    good, _ = catalog.site_scan(routes, seen)
    assert sorted(r["ordinal"] for r in good.collect()) == [1, 2, 4]

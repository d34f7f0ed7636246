"""Readers, writers, streams and whole flows on small files."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import library as B
from shelfwise.plans import flow
from shelfwise.sources import readers, writers
from shelfwise.session import qualified
from shelfwise.streaming.index_stream import stream_index


@pytest.fixture()
def place():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w" if isinstance(text, str) else "wb") as fh:
        fh.write(text)


def test_envelopes(spark, place):
    put(f"{place}/e/a.json", json.dumps({"candidates": [{"title": "A", "official": True}, {"title": "B"}]}))
    put(f"{place}/e/b.json", json.dumps({"ranked_candidates": [{"rank": 1, "candidate": {"title": "C"}}]}))
    put(f"{place}/e/c.json", json.dumps({"options": [{"title": "D"}]}))
    got = readers.load_candidates(spark, f"{place}/e").orderBy("ordinal").collect()
    assert [r["title"] for r in got] == ["A", "B", "C", "D"] and got[0]["official"] is True
    assert len({r["ordinal"] for r in got}) == 4


def test_envelopes_of_several_folders(spark, place):
    for folder, title in (("b", "2"), ("a/x", "1"), ("a", "0")):
        put(f"{place}/{folder}/one.json", json.dumps({"candidates": [{"title": title}, {"title": title + "b"}]}))
        put(f"{place}/{folder}/two.json", json.dumps({"candidates": [{"title": title + "c"}]}))
    paths = [f"{place}/{f}" for f in ("b", "a/x", "a")]
    got = readers.load_candidates(spark, paths).orderBy("ordinal").collect()
    assert [r["title"] for r in got] == ["0", "0b", "0c", "1", "1b", "1c", "2", "2b", "2c"]
    assert sorted({r["ordinal"] // readers.PATH_STEP for r in got}) == list(range(6))


def test_feed_and_files(spark, place):
    put(f"{place}/f/p0.json", json.dumps([{"id": "1"}, {"id": "2"}]))
    put(f"{place}/f/p1.json", json.dumps([{"id": "3"}]))
    got = readers.load_feed_parts(spark, [f"{place}/f/p0.json", f"{place}/f/p1.json"], "id string")
    assert sorted((r["id"], r["part_file"]) for r in got.collect()) == [("1", "p0.json"), ("2", "p0.json"), ("3", "p1.json")]
    put(f"{place}/g/x/a.PDF", b"%PDF-1.4")
    row = readers.scan_files(spark, f"{place}/g").first()
    assert (row["size"], row["format"], row["magic"]) == (8, "pdf", "255044462D312E34") and row["local_file"].endswith("/g/x/a.PDF")


def test_items_of_unknown_json(spark):
    body = {"data": {"list": [{"id": 1, "title": "A"}, {"id": 1, "title": "A"}, {"content_id": "x", "tabCode": "t", "sub": {"id": "y", "name": "n"}}, {"id": "only"}, 5]}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "not json"), (3, json.dumps([{"id": "z", "name": "top"}]))], "ordinal bigint, body string")
    got = sorted((r["ordinal"], r["item_id"], r["item_title"] or "") for r in readers.extract_items(df, "body").collect())
    assert got == [(1, "1", "A"), (1, "x", ""), (1, "y", "n"), (3, "z", "top")]
    assert readers.extract_items(df, "body", limit=1).count() == 2


def test_items_at_any_depth_and_named_by_their_page(spark):
    deep = {"id": "deep", "title": "D"}
    for level in range(9):
        deep = {"box": [deep], "n": level} if level % 2 else {"box": deep}
    page = {"title": "P", "url": "https://basic.smartedu.cn/qualityCourse?courseId=c77"}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps({"list": [page]})), (3, None), (4, "{}")], "ordinal bigint, body string")
    got = sorted((r["ordinal"], r["item_id"], r["item_title"]) for r in readers.extract_items(df, "body").collect())
    assert got == [(1, "deep", "D"), (2, "c77", "P")]


def test_writers(spark, place):
    df = spark.createDataFrame([("2", "b", ["x", "y"], 3), ("1", "a", [], 4)], "id string, title string, providers array<string>, size int")
    writers.write_csv(df, f"{place}/csv")
    back = spark.read.option("header", True).csv(f"{place}/csv")
    assert back.columns == writers.EXPORT_COLUMNS and {r["id"]: r["providers"] for r in back.collect()}["2"] == "x/y"
    writers.write_manifest(df, f"{place}/manifest")
    assert [r["id"] for r in spark.read.json(f"{place}/manifest").collect()] == ["1", "2"]
    writers.write_envelope(df, df.groupBy().count(), f"{place}/env", "tag/v1")
    assert spark.read.json(f"{place}/env/summary").first()["schema_tag"] == "tag/v1"


def test_library_layout(spark, place):
    df = spark.createDataFrame([(1, "小学", "三年级", "数学", "t", "v", "pdf", False), (2, "小学", "三年级", "数学", "t", "v", "mp3", True)],
                               "ordinal bigint, stage_or_age string, grade_or_phase string, domain_or_subject string, topic_or_type string, source_or_version string, format string, needs_review boolean")
    writers.write_library(df, place)
    assert os.path.isdir(f"{place}/library/stage_or_age=小学/grade_or_phase=三年级") or spark.read.parquet(f"{place}/library").count() == 1
    assert spark.read.parquet(f"{place}/待确认").count() == 1


def files(spark, *data):
    return spark.createDataFrame([tuple(d) for d in data], "ordinal bigint, title string, library_file string, sha256 string, classification_confidence double, needs_review boolean, ts timestamp_ntz")


def bucket_files(path, kind):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/{kind}") for f in names if f.endswith(".parquet")}


def test_index_versions(spark, place):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    path = f"{place}/index"
    assert readers.load_index(spark, path)[0].count() == 0
    rows = files(spark, (1, "A", "l/a", "k1", 0.5, False, now), (2, "B", "l/b", "k1", 0.5, False, now), (3, "N", None, "k2", 0.5, False, now))
    for day in ("2024-01-01", "2024-01-02"):
        writers.upsert_index(spark, path, rows, F.lit(day).cast("timestamp"))
    resources, duplicates = readers.load_index(spark, path)
    assert [(r["resource_key"], r["title"], r["created_at"].day, r["updated_at"].day) for r in resources.collect()] == [("k1", "A", 1, 2)]
    assert duplicates.count() == 1
    assert writers.upsert_index(spark, path, rows.where("ordinal = 3"), "2024-01-03") is None
    with pytest.raises(ValueError):
        writers.write_index(resources, duplicates, "/lib/x/index", "/lib/x")
    put(f"{path}/manifests/v99999999999999999999/part-0.parquet", "junk")
    assert readers.load_index(spark, path)[0].count() == 1
    bad = f"{place}/bad"
    spark.range(1).write.parquet(f"{bad}/resources/v1/bucket=0")
    spark.createDataFrame([(0, "v1", None)], writers.MANIFEST).write.parquet(f"{bad}/manifests/v1")
    put(f"{bad}/manifests/v1/_COMPLETE", "")
    with pytest.raises(ValueError):
        readers.load_index(spark, bad)


def test_upsert_writes_only_the_buckets_of_its_keys(spark, place):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    path = f"{place}/index"
    many = files(spark, *[(k, f"T{k}", f"l/{k}", f"k{k}", 0.5, False, now) for k in range(400)])
    writers.upsert_index(spark, path, many, "2024-01-01", buckets=32)
    before = bucket_files(path, "resources")
    held = {r["resource_key"]: r["title"] for r in readers.load_index(spark, path)[0].collect()}
    assert len(held) == 400 and len(before) >= 32
    one = files(spark, (1, "new title", "l/7", "k7", 0.5, False, now), (2, "copy", "l/elsewhere", "k7", 0.5, False, now))
    writers.upsert_index(spark, path, one, "2024-01-02")
    assert len(bucket_files(path, "resources") - before) == 1 and len(bucket_files(path, "duplicates")) == 1
    resources, duplicates = readers.load_index(spark, path)
    assert {r["resource_key"]: r["title"] for r in resources.collect()} == held | {"k7": "new title"}
    assert [r["incoming_file"] for r in duplicates.collect()] == ["l/elsewhere"]
    assert len(writers.read_manifest(spark, path)) == 32


def test_places_of_every_form(spark, place):
    put(f"{place}/i/manifests/v0/x", "")
    assert writers.current_version(spark, f"{place}/nowhere") is None and writers.current_version(spark, f"{place}/i") is None
    put(f"{place}/i/manifests/v1/_COMPLETE", "")
    put(f"{place}/i/manifests/other/_COMPLETE", "")
    for form in (f"{place}/i", f"file:{place}/i", f"file://{place}/i", os.path.relpath(f"{place}/i")):
        assert writers.current_version(spark, form) == "v1"
    assert qualified(spark, "hdfs://name/x") == "hdfs://name/x" and qualified(spark, "file:/x") == "file:///x"


def test_stream_into_index(spark, place):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    data = files(spark, (1, "A", "l/a", "k1", 0.5, False, now), (2, "A", "l/a", "k1", 0.5, False, now), (3, "C", "l/c", "k2", 0.5, False, now))
    data.write.parquet(f"{place}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{place}/in")
    stream_index(stream, f"{place}/index", f"{place}/state").awaitTermination()
    resources, _ = readers.load_index(spark, f"{place}/index")
    assert sorted(r["resource_key"] for r in resources.collect()) == ["k1", "k2"]
    # more data under the same checkpoint: only the new key's bucket is written
    before = bucket_files(f"{place}/index", "resources")
    files(spark, (4, "D", "l/d", "k3", 0.5, False, now)).write.mode("append").parquet(f"{place}/in")
    stream_index(stream, f"{place}/index", f"{place}/state").awaitTermination()
    assert sorted(r["resource_key"] for r in readers.load_index(spark, f"{place}/index")[0].collect()) == ["k1", "k2", "k3"]
    assert len(bucket_files(f"{place}/index", "resources") - before) == 1


def test_library_chain(spark):
    fetched = spark.createDataFrame([(1, "四则练习", "d/a.pdf", "pdf", "习题", "https://x/a.pdf", "小学", "h1"), (2, "恐龙", "d/b.pdf", "pdf", "百科", "https://x/b.pdf", None, "h2")],
                                    "ordinal bigint, title string, local_file string, format string, resource_type string, source_url string, stage string, sha256 string")
    from shelfwise.operators.content import file_signals

    found = file_signals(spark.createDataFrame([("d/a.pdf", b"%PDF-1.4 /Type /Page " + b"x" * 600, "pdf"), ("d/b.pdf", b"<html>t</html>", "pdf")], "local_file string, content binary, format string"))
    done = flow.library_chain(fetched, found, spark.createDataFrame([], readers.INDEX_RECORD), F.lit("2024-01-01").cast("timestamp"), root="lib")
    got = {r["ordinal"]: r for r in done["organized"].collect()}
    assert got[1]["library_file"].startswith("lib/小学/") and got[2]["library_file"] == "lib/待确认/html/恐龙_h2.html"
    assert done["index"].count() == 2 and B.index_summary(done["outcomes"]).first()["created"] == 2


def test_request_flow(spark):
    ready, tasks, unclear = flow.ready_intents(spark.createDataFrame([("q1", "8岁 四则运算 练习题"), ("q2", "资料")], "intent_id string, query string"))
    assert unclear.count() == 1 and tasks.count() == 1
    schema = "ordinal bigint, intent_id string, title string, source string, source_name string, source_url string, resource_type string, format string, official boolean, downloadable boolean, requires_auth boolean"
    local = spark.createDataFrame([(i, "q1", f"四则运算练习 8岁 {i}", "local", "教育", "https://a/x.pdf", "习题", "pdf", True, True, False) for i in range(9)], schema)
    other = spark.createDataFrame([(1, "q1", "网页", "web", "w", "https://b/", "网页", "html", False, False, False)], schema)
    options, total = flow.request_flow(ready, local, other, other, k=3)
    assert options.count() == 3 and {r["source_name"] for r in options.collect()} == {"教育"}
    assert total.first()["total_ranked"] == 9


def test_site_search_flow(spark):
    body = [json.dumps({"id": "d1", "title": "课", "catalog": "c"}), json.dumps({"id": "d2", "title": "无详情.pdf", "catalog": "c"})]
    items = spark.createDataFrame([(1, "q", body[0], None), (2, "q", body[1], None)], "ordinal bigint, query_id string, body string, version string").withColumn("item", F.parse_json("body"))
    from tests.test_operators import resource_frame

    detail = resource_frame(spark).drop("detail_id", "ordinal")
    details = detail.select(F.lit("c-d1").alias("detail_key"), F.struct(*detail.columns).alias("detail"))
    out = flow.site_search_flow(items, details, "课")
    assert sorted(r["format"] for r in out["candidates"].collect()) == ["jpg", "m3u8", "pdf", "pdf", "pdf"]
    assert sorted((r["ordinal"], r["lookup_status"]) for r in out["lookups"].collect()) == [(1, "ok"), (2, "detail_not_found_in_dir")]
    assert out["facets"].where("dimension = 'format' and value = 'pdf'").first()["n"] == 3

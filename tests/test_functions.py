"""Column helpers on small values, expected results written by hand."""

import urllib.parse

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import infer, lexicons as L, match, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def test_blank_and_space(spark):
    assert one(spark, text.blank_to_null("a"), a="  　 ") is None
    assert one(spark, text.strip("a"), a="　x y ") == "x y"
    assert one(spark, text.squeeze("a"), a=" a \n　 b ") == "a b"
    assert one(spark, text.first_value("a", "b"), a=" ", b=" z ") == "z"


def test_clean_text(spark):
    assert one(spark, text.clean_text("a"), a="<b>A&amp;B</b>\n &lt;c&gt;") == "A&B <c>"
    assert one(spark, text.clean_text("a", tags_first=False), a="A &lt;b&gt; c") == "A c"
    assert one(spark, text.unescape("a"), a="&amp;lt;") == "&lt;"


def test_tokens_have_grams_for_long_cjk_pieces(spark):
    got = one(spark, text.tokens("a"), a="数学练习, PDF Pdf 唐诗")
    assert got == ["数学练习", "数学", "学练", "练习", "数学练", "学练习", "pdf", "唐诗"]
    assert one(spark, text.tokens("a"), a="a/b|c；d") == ["a", "b", "c", "d"]


def test_grade_names(spark):
    for value, want in [("3", "三年级"), ("1年级", "一年级"), ("0", "零年级"), ("10", "十年级"), ("11", "11"), ("三年级", "三年级"), ("x", "x")]:
        assert one(spark, text.grade_to_chinese("a"), a=value) == want


def test_safe_part_and_ids(spark):
    assert one(spark, text.safe_part("a", "none"), a=' a/b:c*?"<>| \n d. ') == "a_b_c_ _ d"
    assert one(spark, text.safe_part("a", "none"), a="...") == "none"
    assert one(spark, text.safe_part("a", "none", 3), a="abcdef") == "abc"
    assert one(spark, text.stable_id("a"), a="abc") == "a9993e364706816a"


def test_secrets(spark):
    raw = "u?accessToken=s3cr&x=1 Authorization: Bearer ab.c-d end"
    assert one(spark, text.mask_secrets("a", text.SECRET_RULES), a=raw) == "u?accessToken=***&x=1 Authorization: Bearer *** end"
    heads = F.create_map(F.lit("Cookie"), F.lit("c"), F.lit("ETag"), F.lit("e"), F.lit("X-Other"), F.lit("o"))
    assert one(spark, text.safe_headers(heads)) == {"Cookie": "***", "ETag": "e"}


@pytest.mark.parametrize("ref", [
    "x.pdf", "/x.pdf", "//h2/x", "?page=2", "#top", "../up/x.pdf", "./x", "http://o/p", "a/../../b", "", "mailto:x@y", "/a/../b", "..",
])
def test_absolute_url_like_urljoin(spark, ref):
    base = "https://h.example/a/b/c.html?q=1#f"
    assert one(spark, urls.absolute_url("b", "r"), b=base, r=ref) == urllib.parse.urljoin(base, ref)


def test_url_parts(spark):
    url = "HTTP://User@Ex.COM:80/p/a.b.JPEG?x=1#y"
    assert one(spark, urls.host("u"), u=url) == "user@ex.com:80"
    assert one(spark, urls.path("u"), u=url) == "/p/a.b.JPEG"
    assert one(spark, urls.ext("u"), u=url) == "jpg"
    assert one(spark, urls.ext("u"), u="http://h/.pdf") == ""
    assert one(spark, urls.query_value("u", "b", "a"), u="http://h/?a=1%202&b=&c=3") == "1 2"
    assert one(spark, urls.unwrap_redirect("u"), u="//d/l/?uddg=https%3A%2F%2Fa%2Fb&amp;x=1") == "https://a/b"
    assert one(spark, urls.quote_path("u"), u="https://h/a b/%E6%95%B0?q=1") == "https://h/a%20b/%E6%95%B0?q=1"
    assert one(spark, urls.file_title("u", "none"), u="http://h/x/My_big-file.v1.pdf") == "My big file.v1"


def test_match(spark):
    assert one(spark, match.hits("a", ["c", "a", "a", "x"]), a="abc") == ["c", "a"]
    assert one(spark, match.contains_any("a", ["x"]), a=None) is False
    assert one(spark, match.labels("a", [("n1", ["x", "a"]), ("n2", ["b", "c"])]), a="abc") == ["n1", "n2"]
    assert one(spark, match.first_label("a", [("n1", ["x"]), ("n2", ["b"])]), a="abc") == "n2"
    assert one(spark, match.longest_label("a", [("n1", ["a"]), ("n2", ["ab", "b"]), ("n3", ["bc"])]), a="abc") == "n2"
    with pytest.raises(ValueError):
        match.hits("a", [str(i) for i in range(2000)])


def test_formats(spark):
    assert one(spark, infer.infer_format("a"), a="http://h/x.docx?d=1 text") == "docx"
    assert one(spark, infer.infer_format("a"), a="bilibili 视频") == "video"
    assert one(spark, infer.infer_format("a"), a="nothing") == "html"
    assert one(spark, infer.detail_format(F.col("a"), F.col("b")), a="application/x-mpegURL", b="") == "m3u8"
    assert one(spark, infer.detail_format(F.col("a"), F.col("b")), a="source", b="http://h/x.JPEG") == "jpg"
    assert one(spark, infer.detail_format(F.col("a"), F.col("b")), a="folder", b="http://h/x") == "folder"
    assert one(spark, infer.detail_format(F.col("a"), F.col("b")), a=None, b="http://h/x") == "unknown"
    assert one(spark, infer.item_format(F.col("a"), F.col("b"), F.col("c")), a=None, b="http://h/x", c="t.pptx") == "pptx"
    assert one(spark, infer.format_matches(F.col("a"), F.col("b")), a="DOC/DOCX", b="docx") is True
    assert one(spark, infer.format_matches(F.col("a"), F.col("b")), a="音频", b="mp4") is False
    assert one(spark, infer.library_format(F.col("a"), F.col("b")), a=" .JPEG", b="x.png") == "jpg"
    assert one(spark, infer.library_format(F.col("a"), F.col("b")), a=None, b="d/x.PNG") == "png"


def test_topic_needs_half_of_its_parts(spark):
    blob = F.lower(F.col("t"))
    assert one(spark, infer.infer_topic(F.lit("加法 减法 乘法"), blob), t="加法题") == "加法 减法 乘法"
    assert one(spark, infer.infer_topic(F.lit("a1 b1 c1 d1"), blob), t="a1") is None
    assert one(spark, infer.infer_subject(blob, L.WEB_SUBJECT_RULES)[0], t="恐龙") is None
    assert one(spark, infer.infer_subject(blob, L.WEB_SUBJECT_RULES)[1], t="恐龙") == "百科"


def test_plain_strip_and_filled(spark):
    white = text.WHITE
    values = ["", " ", white, "a", " a", "a ", "\u3000\u6570\u3000", "\u6570", "\u6570 x", "x\u2003", "\u00e9", "\x7f", "\x1fa", "\ufeff", None, "!", "\u3001", "\U0001f600 "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", text.strip("v").alias("a"), text.strip("v", plain=True).alias("b"), infer.filled("v").alias("f"), text.blank_to_null("v").alias("n")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [v and v.strip(white) for v in values]
    assert [r["f"] for r in got] == [r["n"] is not None for r in got]

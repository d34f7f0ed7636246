"""Content evidence: file type, signals, text evidence and the analysis of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import bind, let
from ..functions.match import compact, contains_any, hits
from ..functions.text import as_col, blank_to_null, squeeze
from ..functions.urls import path, suffix
from .pages import page_title, visible_text


def detect_format(declared: Column, location: Column) -> Column:
    by_name = F.regexp_replace(suffix(path(location)), "^htm$", "html")
    return F.coalesce(F.lower(blank_to_null(declared)), blank_to_null(by_name), F.lit("unknown"))


def analysis_type(fmt: Column) -> Column:
    out = F
    for kind, formats in L.KIND_FORMATS.items():
        out = out.when(fmt.isin(formats), kind)
    return out.otherwise("unknown")


def _head(content: Column, n: int) -> Column:
    return F.hex(F.substring(content, 1, n))


def _opens_with(content: Column, pattern: str) -> Column:
    """Whether the content begins so, after any number of blanks and in any case."""
    return F.regexp_like(F.decode(content, "ISO-8859-1"), F.lit(rf"(?i)^\s*+(?:{pattern})"))


def sniff_format(content: Column, declared: Column) -> Column:
    """Format by magic bytes; office files keep their declared name; unknown bytes keep it too."""
    head = _head(content, 8)
    html = _opens_with(content, "<!doctype html|<html|<head|<body")
    found = (
        F.when(F.startswith(head, F.lit("25504446")), F.lit("pdf"))
        .when(
            F.startswith(head, F.lit("504B0304")),
            F.when(declared.isin("docx", "pptx", "xlsx", "zip"), declared).otherwise("zip"),
        )
        .when(head == "89504E470D0A1A0A", F.lit("png"))
        .when(F.startswith(head, F.lit("FFD8")), F.lit("jpg"))
        .when(html, F.lit("html"))
    )
    return F.coalesce(found, declared)


def sniff_warning(sniffed: Column, declared: Column) -> Column:
    """Mismatch text, or null."""
    text = F.concat(F.lit("文件格式与实际内容不一致：声明为 "), declared, F.lit("，实际像 "), sniffed)
    return F.when((declared != "unknown") & (declared != sniffed), text)


def pdf_pages(content: Column) -> Column:
    """Page objects in a PDF, null when none is found."""
    n = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page\b"))
    return F.when(n > 0, n)


def _number(content: Column, start: int, size: int, little: bool = False) -> Column:
    parts = [F.hex(F.substring(content, start + i, 1)) for i in range(size)]
    return F.conv(F.concat(*(reversed(parts) if little else parts)), 16, 10).cast("int")


def image_size(content: Column) -> Column:
    """``struct<width,height>`` of PNG and GIF headers, else null."""
    png = (_head(content, 8) == "89504E470D0A1A0A") & (F.length(content) >= 24)
    gif = F.startswith(_head(content, 6), F.lit("474946383761")) | F.startswith(_head(content, 6), F.lit("474946383961"))
    gif = gif & (F.length(content) >= 10)
    return F.when(png, F.struct(_number(content, 17, 4).alias("width"), _number(content, 21, 4).alias("height"))).when(
        gif, F.struct(_number(content, 7, 2, True).alias("width"), _number(content, 9, 2, True).alias("height"))
    )


def subtitle_text(text: Column | str, limit: int | None = None) -> Column:
    """Subtitle text without cue numbers and time stamps."""
    plain = F.regexp_replace(
        as_col(text), r"\d{2}:\d{2}:\d{2}[,.]\d{3}\s+-->\s+\d{2}:\d{2}:\d{2}[,.]\d{3}", " "
    )
    joined = squeeze(F.regexp_replace(plain, r"(?m)^\d+$", " "))
    return joined if limit is None else F.left(joined, F.lit(limit))


def file_signals(files: DataFrame, declared: str = "format") -> DataFrame:
    """Adds detected format, kind, size, pages, image size, text and file warnings.

    ``files`` has ``content`` (bytes) and a declared format.  Text comes from
    HTML, plain text and subtitle files; PDF pages and image sizes from bytes.
    """
    fmt = F.coalesce(F.lower(blank_to_null(declared)), F.lit("unknown"))
    sniffed = let(let(files, {"_declared": fmt}), {"detected_format": sniff_format(F.col("content"), F.col("_declared"))})
    found = F.col("detected_format")
    text = F.decode("content", "UTF-8")
    plain = (
        F.when(found.isin("html", "webpage"), visible_text(text))
        .when(found == "txt", text)
        .when(found.isin("srt", "vtt", "lrc"), subtitle_text(text))
    )
    small = (F.length("content") < 512) & ~found.isin("html", "txt")
    pages = F.when(found == "pdf", pdf_pages(F.col("content")))
    return sniffed.withColumns(
        {
            "analysis_type": analysis_type(found),
            "file_size": F.length("content").cast("bigint"),
            "page_count": pages,
            "image_size": image_size(F.col("content")),
            "text": F.coalesce(plain, F.lit("")),
            "page_title": F.when(found.isin("html", "webpage"), page_title(text)),
            "file_warnings": compact(
                [
                    sniff_warning(found, F.col("_declared")),
                    F.when(small, F.lit("文件过小，可能不是完整资源")),
                    F.when((found == "pdf") & pages.isNull(), F.lit("无法解析 PDF 页数")),
                ]
            ),
        }
    ).drop("_declared")


def evidence_level(text_length: Column, file_size: Column, page_count: Column, duration: Column) -> Column:
    has_shape = (F.coalesce(page_count, F.lit(0)) > 0) | (F.coalesce(duration, F.lit(0)) > 0)
    return (
        F.when(text_length >= 500, "strong")
        .when((text_length >= 80) | has_shape, "basic")
        .when(F.coalesce(file_size, F.lit(0)) >= 1024, "metadata_only")
        .otherwise("none")
    )


def text_evidence(
    df: DataFrame,
    text: str = "text",
    *,
    sample: int | None = None,
    file_size: str | None = None,
    page_count: str | None = None,
    duration: str | None = None,
    context: Column | None = None,
    keywords: Sequence[str] = L.KEYWORDS,
    risk_terms: Sequence[str] = L.ANALYSIS_RISK_TERMS,
    auth_terms: Sequence[str] = L.AUTH_PAGE_TERMS,
) -> DataFrame:
    """Text length, sample for display, keywords, risk and auth warnings, evidence level.

    Terms are looked for in the whole text plus ``context`` (title and the
    like); ``sample`` cuts what is shown.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = F.concat_ws(" ", context, body) if context is not None else body
    based = let(df, {"_whole": whole, "text_length": F.length(body).cast("bigint"), "_flat": squeeze(body)})
    based = let(based, {"_low": F.lower("_whole")})
    length = F.col("text_length")
    none = F.lit(None).cast("long")

    def maybe(name: str | None) -> Column:
        return F.col(name) if name else none

    level = evidence_level(length, maybe(file_size), maybe(page_count), maybe(duration))
    flat = F.col("_flat")
    walled = contains_any("_low", [t.lower() for t in auth_terms])
    return let(
        based,
        {
            "text_sample": flat if sample is None else F.left(flat, F.lit(sample)),
            "keywords": hits("_whole", keywords),
            "evidence_level": level,
            "has_content_evidence": level.isin("strong", "basic"),
            "evidence_warnings": F.concat(
                F.transform(hits("_whole", risk_terms), lambda t: F.concat(F.lit("包含风险词："), t)),
                compact([F.when(walled, F.lit("疑似登录、权限或付费限制页面"))]),
            ),
        },
    ).drop("_whole", "_low", "_flat")


def analysis_confidence(kind: Column, fmt: Column, has_text: Column, has_pages: Column, has_size: Column, has_probe: Column) -> Column:
    """Confidence in hundredths by kind of file and what could be read from it."""
    return (
        F.when(fmt.isin("html", "webpage"), F.when(has_text, 85).otherwise(35))
        .when(fmt == "txt", F.when(has_text, 80).otherwise(30))
        .when(fmt.isin("docx", "pptx"), F.when(has_text, 85).otherwise(45))
        .when(fmt == "pdf", F.when(has_text, 82).when(has_pages, 65).otherwise(45))
        .when(kind == "image", F.when(has_size, 75).otherwise(50))
        .when(kind.isin("audio", "video"), F.when(has_text, 82).when(has_probe, 75).otherwise(45))
        .otherwise(35)
    )


def analyze(
    candidates: DataFrame,
    files: DataFrame | None = None,
    *,
    keywords: Sequence[str] = L.KEYWORDS,
    risk_terms: Sequence[str] = L.ANALYSIS_RISK_TERMS,
    auth_terms: Sequence[str] = L.AUTH_PAGE_TERMS,
    sample: int | None = None,
) -> DataFrame:
    """Adds the ``analysis`` struct to candidates; ranking reads its text whole unless ``sample`` cuts it.

    ``files`` (from ``file_signals``, keyed by ``local_file``) is joined on the
    left; both sides are unique per file, so no key is hot.  Candidates without
    a file path, and those whose file is missing, get their own warning.
    """
    if files is None:
        joined = candidates.withColumns(
            {
                "_found": F.lit(False),
                "_fmt": F.lit(None).cast("string"),
                "_text": F.lit(""),
                "_size": F.lit(None).cast("long"),
                "_pages": F.lit(None).cast("long"),
                "_image": F.lit(None).cast("struct<width:int,height:int>"),
                "_ptitle": F.lit(None).cast("string"),
                "_warn": F.array().cast("array<string>"),
                "_duration": F.lit(None).cast("double"),
            }
        )
    else:
        duration = F.col("duration_seconds") if "duration_seconds" in files.columns else F.lit(None)
        slim = files.select(
            F.col("local_file").alias("_file"),
            F.lit(True).alias("_found"),
            F.col("detected_format").alias("_fmt"),
            F.col("text").alias("_text"),
            F.col("file_size").alias("_size"),
            F.col("page_count").alias("_pages"),
            F.col("image_size").alias("_image"),
            F.col("page_title").alias("_ptitle"),
            F.col("file_warnings").alias("_warn"),
            duration.cast("double").alias("_duration"),
        )
        joined = candidates.join(slim, F.col("local_file") == F.col("_file"), "left").drop("_file")
    has_path = blank_to_null("local_file").isNotNull() if "local_file" in candidates.columns else F.lit(False)
    given = F.col("source_warnings") if "source_warnings" in candidates.columns else F.array().cast("array<string>")
    location = F.coalesce(F.col("source_url"), F.col("local_file")) if "local_file" in candidates.columns else F.col("source_url")
    found = F.coalesce("_found", F.lit(False))
    formatted = let(
        joined,
        {
            "_known": found,
            "_format": F.coalesce("_fmt", detect_format(F.col("format"), location)),
            "_body": F.coalesce("_text", F.lit("")),
        },
    )
    description = F.col("description") if "description" in candidates.columns else F.lit("")
    evidence = text_evidence(
        formatted,
        "_body",
        sample=sample,
        file_size="_size",
        page_count="_pages",
        duration="_duration",
        context=F.concat_ws(" ", "title", description, "source_url"),
        keywords=keywords,
        risk_terms=risk_terms,
        auth_terms=auth_terms,
    )
    fmt = F.col("_format")
    kind = analysis_type(fmt)
    known = F.col("_known")
    has_text = F.trim("_body") != ""
    points = F.when(
        known,
        analysis_confidence(
            kind, fmt, has_text, F.col("_pages").isNotNull(), F.col("_image").isNotNull(), F.col("_duration").isNotNull()
        ),
    ).otherwise(25)
    media = kind.isin("audio", "video") & ~has_text
    none = F.array().cast("array<string>")
    warnings = F.array_distinct(
        F.concat(
            F.coalesce(given, none),
            F.coalesce("_warn", none),
            compact(
                [
                    F.when(known & media, F.lit("未找到字幕或转写文本，内容证据不足")),
                    F.when(known & (kind == "unknown"), F.lit("暂不支持该格式的深度分析")),
                    F.when(has_path & ~known, F.lit("文件不存在")),
                    F.when(~has_path, F.lit("远程抓取未启用")),
                ]
            ),
            F.col("evidence_warnings"),
        )
    )
    analysis = F.struct(
        F.lit(True).alias("analyzed"),
        kind.alias("analysis_type"),
        fmt.alias("detected_format"),
        F.col("text_length"),
        F.col("_size").alias("file_size"),
        F.col("_pages").alias("page_count"),
        F.col("_duration").alias("duration_seconds"),
        F.col("_image").alias("image_size"),
        F.col("evidence_level"),
        F.col("has_content_evidence"),
        F.col("text_sample"),
        F.col("keywords"),
        warnings.alias("warnings"),
        (points / F.lit(100.0)).alias("analysis_confidence"),
    )
    out = let(
        evidence,
        {
            "analysis": analysis,
            "title": F.coalesce(blank_to_null("title"), F.col("_ptitle"), F.lit("")),
            "format": fmt,
        },
    )
    keep = [*candidates.columns, "analysis"]
    return out.select(*[c for c in keep if c in out.columns])


def attach_analysis(fetched: DataFrame, analysed: DataFrame, key: str = "local_file") -> DataFrame:
    """Left join of analyses to fetched files by path; the analysed format wins."""
    slim = analysed.select(F.col(key).alias("_key"), F.col("format").alias("_format"), "analysis")
    joined = fetched.join(slim, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn("format", F.coalesce(blank_to_null("_format"), F.col("format"))).drop("_format")


# ------------------------------------------------------------------ checks of fetched content
def content_kind(mime: Column) -> Column:
    value = F.lower(F.trim(F.regexp_extract(F.coalesce(mime, F.lit("")), r"^([^;]*)", 1)))
    return bind(value, _mime_kind)


def _mime_kind(value: Column) -> Column:
    return (
        F.when(value.isin("application/pdf", "application/x-pdf"), "pdf")
        .when(F.startswith(value, F.lit("image/")), "image")
        .when(
            F.startswith(value, F.lit("video/"))
            | value.isin("application/vnd.apple.mpegurl", "application/x-mpegurl"),
            "video",
        )
        .when(value.isin("text/html", "application/xhtml+xml"), "html")
        .when(value.isin("application/json", "text/json"), "json")
        .when(F.startswith(value, F.lit("text/")), "text")
        .otherwise("")
    )


def file_kind(content: Column) -> Column:
    head = _head(content, 16)
    webp = F.startswith(head, F.lit("52494646")) & F.contains(head, F.lit("57454250"))
    return (
        F.when(F.startswith(head, F.lit("255044462D")), "pdf")
        .when(
            F.startswith(head, F.lit("FFD8FF"))
            | F.startswith(head, F.lit("89504E470D0A1A0A"))
            | F.startswith(head, F.lit("47494638"))
            | webp,
            "image",
        )
        .when(_opens_with(content, "<!doctype html|<html|<script|<head"), "html")
        .when(_opens_with(content, r"[{\[]"), "json")
        .otherwise("")
    )


def expected_kind(fmt: Column, resource_type: Column) -> Column:
    return (
        F.when(fmt == "pdf", "pdf")
        .when(fmt.isin("jpg", "jpeg", "png", "gif", "webp"), "image")
        .when(fmt.isin("mp4", "mov", "avi", "m3u8", "ts"), "video")
        .when(fmt == "json", "json")
        .when(fmt.isin("txt", "srt"), "text")
        .when(fmt == "html", "html")
        .when(resource_type == "图片", "image")
        .when(resource_type == "视频", "video")
        .otherwise("")
    )


def validate_content(content: Column, fmt: Column, resource_type: Column, mime: Column) -> Column:
    """Error text when the content is not what was announced, else null."""
    wanted, sent, real = expected_kind(fmt, resource_type), content_kind(mime), file_kind(content)
    return (
        F.when(
            (wanted != "") & (sent == "html") & (wanted != "html"),
            F.concat(F.lit("响应是 HTML 页面，不是预期的 "), fmt, F.lit(" 文件")),
        )
        .when((wanted == "pdf") & (real != "pdf"), F.lit("响应内容不是 PDF 文件"))
        .when((wanted == "image") & (real != "") & (real != "image"), F.lit("响应内容不是图片文件"))
    )

"""Resource details: identities, URLs, tags, related resources and file items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.columns import bind, let
from ..functions.text import as_col, blank_to_null, content_key, strip, unescape
from ..functions.urls import path, query_value, quote, quote_path, unquote
from .grouping import first_of

ITEM = (
    "struct<ti_format:string,lc_ti_format:string,ti_file_flag:string,ti_storage:string,"
    "ti_storages:array<string>,ti_size:string,identification:boolean,"
    "requirements:array<struct<name:string,value:string>>>"
)
RESOURCE = (
    "id string, title string, global_title string, original_title string, alias_name string, description string, "
    "catalog string, resource_type_code string, resource_type_code_name string, "
    "provider_list array<struct<name:string>>, tag_list array<struct<tag_dimension_id:string,tag_name:string>>, "
    f"ti_items array<{ITEM}>"
)
# A URL of these characters alone is the same after its path is decoded and encoded again.
PLAIN_URL = r"^[A-Za-z0-9._~/:-]*\z"
# Part of the name of every private host.
PRIVATE = "ndr-private"
RELATIONS = ["national_course_resource", "course_resource", "resources", "resource"]


def tag_value(tags: Column, name: str, dimensions=L.TAG_DIMENSIONS) -> Column:
    """First tag of the dimension that stands for ``name``; tags are ``struct<dimension,title>``."""
    codes = [code for code, field in dimensions.items() if field == name]
    kept = F.filter(tags, lambda t: t["dimension"].isin(codes))
    return blank_to_null(F.get(kept, F.lit(0))["title"])


def tags_by_dimension(df: DataFrame, tags: str, dimensions=L.TAG_DIMENSIONS) -> DataFrame:
    return df.withColumns({name: tag_value(F.col(tags), name, dimensions) for name in dimensions.values()})


def joined_names(providers: Column | str) -> Column:
    names = F.transform(as_col(providers), lambda p: strip(p["name"], plain=True))
    return F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), "/")


def provider_name(providers: Column | str, default: str = L.SITE_NAME) -> Column:
    return F.coalesce(F.nullif(joined_names(providers), F.lit("")), F.lit(default))


def requirement_value(requirements: Column | str, name: str) -> Column:
    """Value of the first entry of that name, whatever its case."""
    kept = F.filter(as_col(requirements), lambda r: F.lower(r["name"]) == name.lower())
    return F.get(kept, F.lit(0))["value"]


def stored_path(storage: Column) -> Column:
    """Encoded path below the storage prefix; null for anything else."""
    prefix = F.lit(L.STORAGE_PREFIX)
    below = F.startswith(strip(storage, plain=True), prefix)
    return F.when(below, quote(unquote(F.replace(storage, prefix, F.lit(""))), keep="/:"))


def file_urls(stored: Column, storages: Column, private_first: bool = True) -> Column:
    """Distinct file URLs of a ``stored_path``, a plain column: the private host and then the public ones, then the listed URLs."""
    hosts = ([L.PRIVATE_HOST] if private_first else []) + L.PUBLIC_HOSTS
    from_path = F.when(stored.isNotNull(), F.array(*[F.concat(F.lit(h), stored) for h in hosts]))

    def encoded(url: Column) -> Column:
        return F.when(F.regexp_like(url, F.lit(PLAIN_URL)), url).otherwise(quote_path(url))

    def public_too(url: Column) -> Column:
        public = F.regexp_replace(url, L.PRIVATE_HOST_PATTERN, L.PUBLIC_HOSTS[0])
        return F.when(F.contains(url, F.lit(PRIVATE)), F.array(encoded(url), encoded(public))).otherwise(F.array(encoded(url)))

    both = F.flatten(F.transform(F.filter(storages, lambda u: u != ""), public_too))
    none = F.array().cast("array<string>")
    parts = [F.coalesce(from_path, none), F.coalesce(both, none)]
    return F.array_distinct(F.concat(*(parts if private_first else parts[::-1])))


def storage_urls(storage: Column, storages: Column, private_first: bool = True) -> Column:
    """Distinct file URLs: the private host and then the public ones, then the listed URLs."""
    return bind(stored_path(storage), lambda stored: file_urls(stored, storages, private_first))


def requires_auth(identification: Column, urls: Column) -> Column:
    return F.coalesce(identification, F.lit(False)) | F.contains(F.array_join(urls, "\n"), F.lit(PRIVATE))


def identity_from_url(url: Column) -> Column:
    """``struct<resource_id,tab_code,catalog,sub_catalog,content_type>`` of a page URL; nulls where unknown."""
    parts = F.array_remove(F.split(path(url), "/"), "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    given = query_value(url, "contentType", "content_type", "resourceType", "resource_type")
    content = F.coalesce(
        given,
        F.when((first == "syncClassroom") & (second == "classActivity"), F.lit("national_lesson")),
        F.when(first == "qualityCourse", F.lit("elite_lesson")),
    )
    found = F.struct(
        query_value(
            url, "contentId", "content_id", "resourceId", "resource_id", "activityId", "activity_id", "courseId",
            "course_id", "id",
        ).alias("resource_id"),
        F.coalesce(query_value(url, "tabCode", "tab_code", "catalogType", "catalog"), first).alias("tab_code"),
        F.coalesce(query_value(url, "catalogType", "catalog"), first).alias("catalog"),
        query_value(url, "subCatalog", "sub_catalog").alias("sub_catalog"),
        content.alias("content_type"),
    )
    return F.when(F.regexp_like(url, F.lit("^https?://")), found)


def detail_page(
    resource_id: Column, catalog: Column, sub_catalog: Column, content_type: Column, explicit: Column | None = None
) -> Column:
    """Page of a resource: an explicit one, one of three lesson pages, else the common form."""
    rid = quote(F.coalesce(resource_id, F.lit("")))
    kind = F.coalesce(blank_to_null(content_type), F.lit("resource"))
    cat = quote(F.coalesce(blank_to_null(catalog), F.lit("syncClassroom")))
    common = F.concat(
        F.lit(L.SITE_URL), cat, F.lit("/detail?contentType="), quote(kind), F.lit("&contentId="), rid,
        F.lit("&catalogType="), cat, F.lit("&subCatalog="), quote(F.coalesce(sub_catalog, F.lit(""))),
    )
    explicit = F.lit(None).cast("string") if explicit is None else explicit
    return (
        F.when(F.startswith(explicit, F.lit("http")), explicit)
        .when(kind == "national_lesson", F.concat(F.lit(f"{L.SITE_URL}syncClassroom/classActivity?activityId="), rid))
        .when(kind == "elite_lesson", F.concat(F.lit(f"{L.SITE_URL}qualityCourse?courseId="), rid))
        .when(kind == "prepare_lesson", F.concat(F.lit(f"{L.SITE_URL}syncClassroom/prepare/detail?resourceId="), rid))
        .otherwise(common)
    )


def detail_url_candidates(
    resource_id: Column, catalog: Column, tab_code: Column, content_type: Column, explicit: Column | None = None
) -> Column:
    """``array<struct<url,family>>``: explicit URLs, then templates over servers, each URL once."""
    catalog = F.coalesce(blank_to_null(catalog), F.lit("syncClassroom"))
    tab = F.coalesce(blank_to_null(tab_code), catalog)
    kind = F.coalesce(content_type, F.lit(""))
    rid = quote(resource_id)

    def served(folder: Column | str, family: str, test: Column, servers: Sequence[str]) -> Column:
        tail = F.lit(folder) if isinstance(folder, str) else folder
        urls = [
            F.struct(
                F.concat(F.lit(L.DETAIL_FOLDER.format(server=s)), tail, rid, F.lit(".json")).alias("url"),
                F.lit(family).alias("family"),
            )
            for s in servers
        ]
        return F.when(test, F.array(*urls)).otherwise(F.array().cast("array<struct<url:string,family:string>>"))

    lesson = (catalog == "syncClassroom") | tab.isin("syncClassroom", "classActivity") | (kind == "national_lesson")
    prepare = (
        catalog.isin("prepareLesson", "prepare_lesson")
        | tab.isin("prepareLesson", "prepare_lesson")
        | (kind == "prepare_lesson")
    )
    quality = (catalog == "qualityCourse") | (tab == "qualityCourse") | (kind == "elite_lesson")
    textbook = (catalog == L.TEXTBOOK_CATALOG) | (tab == L.TEXTBOOK_CATALOG)
    common = F.concat(F.lit("resources/"), quote(catalog), F.lit("/details/"))
    servers = L.FILE_SERVERS
    templated = F.concat(
        served("national_lesson/resources/details/", "s-file-ndrv2-national-lesson-detail", lesson, servers),
        served("prepare_sub_type/resources/details/", "s-file-ndrv2-prepare-sub-type-detail", prepare, servers),
        served("resources/", "s-file-ndrv2-quality-course-detail", quality, servers),
        served("resources/tch_material/details/", "s-file-ndrv2-tch-material-detail", textbook, servers),
        served(common, "s-file-ndrv2-details", F.lit(True), servers[:2]),
    )
    templated = F.when(blank_to_null(resource_id).isNotNull(), templated).otherwise(
        F.array().cast("array<struct<url:string,family:string>>")
    )
    if explicit is None:
        return templated
    given = F.transform(
        F.array_distinct(explicit),
        lambda u: F.struct(u.alias("url"), F.lit("search-item-detail-json").alias("family")),
    )
    seen = F.transform(given, lambda g: g["url"])
    return F.concat(given, F.filter(templated, lambda t: ~F.array_contains(seen, t["url"])))


def explicit_detail_urls(item_json: Column | str) -> Column:
    """Detail URLs spelled out anywhere in an item's JSON text: a ``.json`` URL
    under a key that names detail or json, or any URL with ``/details/``."""
    text = as_col(item_json)
    keyed = F.regexp_extract_all(
        text, F.lit(r'(?i)"[^"]*(?:detail|json)[^"]*"\s*:\s*\[?\s*"(https?://[^"]*\.json[^"]*)"'), F.lit(1)
    )
    plain = F.regexp_extract_all(text, F.lit(r'(?i)"(https?://[^"]*/details/[^"]*)"'), F.lit(1))
    return F.array_distinct(F.transform(F.concat(keyed, plain), lambda u: unescape(F.replace(u, F.lit("\\/"), F.lit("/")))))


def joined_titles(title: Column, alternate: Column) -> Column:
    """Title and an alternate title that it does not hold yet; empty without either."""
    base = F.coalesce(blank_to_null(title, plain=True), F.lit(""))
    return bind(
        F.struct(base.alias("base"), blank_to_null(alternate, plain=True).alias("other")),
        lambda t: F.when(t["other"].isNull() | F.contains(t["base"], t["other"]), t["base"])
        .when(t["base"] == "", t["other"])
        .otherwise(F.concat_ws(" - ", t["base"], t["other"])),
    )


def file_label(flag: Column, fmt: Column) -> Column:
    """The file flag where it says more than where a file lies, else the format."""
    said = blank_to_null(flag, plain=True)
    shown = F.when(~said.isin("source", "href", "href-m3u8"), said)
    return F.coalesce(shown, F.when(blank_to_null(fmt, plain=True).isNotNull() & (fmt != "unknown"), F.upper(fmt)))


def candidate_title(joined: Column, label: Column, resource_id: Column) -> Column:
    """``joined_titles``, then the ``file_label``."""
    return (
        F.when(label.isNotNull(), F.concat(joined, F.lit(" - "), label))
        .when(joined != "", joined)
        .otherwise(F.coalesce(resource_id, F.lit(L.SITE_UNTITLED)))
    )


def related_details(details: DataFrame, key: str = "detail_id", ordinal: str = "ordinal") -> DataFrame:
    """A detail and its related resources, one row each, first row per resource id.

    ``details`` has the RESOURCE fields, a ``relations`` struct of resource
    arrays, a key and a unique long ordinal.  A child's value wins over its
    parent's; provider and tags are inherited where a child has none.
    """
    resource = T.StructType.fromDDL(RESOURCE)
    fields = resource.names
    own = F.struct(*[F.col(f) for f in fields])
    none = F.array().cast(T.ArrayType(resource))
    children = [F.coalesce(F.col(f"relations.{r}"), none) for r in RELATIONS]
    kept = F.filter(F.concat(F.array(own), *children), lambda r: r["ti_items"].isNotNull())
    rows = details.select(key, ordinal, own.alias("_parent"), F.posexplode(kept).alias("place", "_r"))

    def pick(name: str) -> Column:
        child, parent = F.col(f"_r.{name}"), F.col(f"_parent.{name}")
        if name in ("provider_list", "tag_list"):
            return F.when(F.size(child) > 0, child).otherwise(parent)
        return F.coalesce(child, parent)

    picked = rows.select(key, ordinal, "place", *[pick(f).alias(f) for f in fields])
    out = let(
        picked,
        {
            "title": F.coalesce(blank_to_null("title"), blank_to_null("global_title")),
            "alternate_title": F.coalesce(blank_to_null("original_title"), blank_to_null("alias_name")),
            "_key": F.coalesce(blank_to_null("id"), content_key(F.to_json("ti_items"))),
        },
    )
    unique = first_of(out, [key, "_key"], [ordinal, "place"])
    return unique.drop("_key", "copies", "place")


def attach_details(items: DataFrame, details: DataFrame, resource_id: str = "resource_id", catalog: str = "catalog") -> DataFrame:
    """Left join of the best detail per item: ``{id}``, ``{catalog}-{id}``, then ``{catalog}/{id}``.

    ``details`` has ``detail_key`` (unique) and ``detail``.  An item looks up
    its three names at once; the best hit is chosen with a map-side combine on
    the unique item ordinal, so popular details cause no hot group.
    """
    rid, cat = F.col(resource_id), F.col(catalog)
    names = F.array(rid, F.concat_ws("-", cat, rid), F.concat_ws("/", cat, rid))
    named = items.where(blank_to_null(rid).isNotNull())  # without an id there is nothing to look up
    wanted = named.select("ordinal", F.posexplode(names).alias("_priority", "detail_key"))
    found = (
        wanted.join(details, "detail_key")
        .groupBy("ordinal")
        .agg(F.min_by(F.struct("detail_key", "detail"), "_priority").alias("_found"))
    )
    joined = items.join(found, "ordinal", "left")
    return joined.select(
        *items.columns,
        F.col("_found.detail_key").alias("detail_key"),
        F.col("_found.detail").alias("detail"),
        F.when(blank_to_null(rid).isNull(), "missing_resource_id")
        .when(F.col("_found").isNull(), "detail_not_found_in_dir")
        .otherwise("ok")
        .alias("lookup_status"),
    )


def attach_pdf_items(records: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Left join of details with only their PDF items and URLs; an error text where no detail exists."""
    pdf = F.filter("ti_items", lambda i: (i["ti_format"] == "pdf") | (i["lc_ti_format"] == "pdf"))
    slim = details.select(F.col(key).alias("_id"), pdf.alias("pdf_items"))
    joined = records.join(slim, F.col(key) == F.col("_id"), "left")
    urls = F.flatten(
        F.transform("pdf_items", lambda i: storage_urls(i["ti_storage"], i["ti_storages"], private_first=False))
    )
    return joined.withColumns(
        {"pdf_urls": urls, "pdf_error": F.when(F.col("_id").isNull(), F.lit("detail not found"))}
    ).drop("_id")


def textbook_records(raw: DataFrame) -> DataFrame:
    """Raw textbook records to flat ones: tags, ordered previews, thumbnail, page.

    ``preview`` is a map of page name to URL; a name without a trailing number
    takes the place after those before it.
    """
    entries = F.map_entries(F.coalesce("preview", F.create_map().cast("map<string,string>")))
    placed = F.transform(
        F.filter(entries, lambda e: e["value"].isNotNull()),
        lambda e, i: F.struct(
            F.coalesce(F.nullif(F.regexp_extract(e["key"], r"(\d+)$", 1), F.lit("")).try_cast("int"), i + 1).alias("place"),
            e["value"].alias("url"),
        ),
    )
    previews = F.transform(F.array_sort(placed), lambda p: p["url"])
    tags = F.transform("tag_list", lambda t: F.struct(t["tag_dimension_id"].alias("dimension"), t["tag_name"].alias("title")))
    named = F.filter(F.transform("provider_list", lambda p: p["name"]), lambda n: n.isNotNull() & (n != ""))
    base = let(raw, {"preview_urls": previews, "_tags": tags, "_names": named})
    names = F.col("_names")
    kind = F.coalesce(blank_to_null("resource_type_code"), F.lit("assets_document"))
    rid = F.coalesce("id", "global_resource_id")
    page = F.concat(
        F.lit(f"{L.SITE_URL}{L.TEXTBOOK_CATALOG}/detail?contentType="), quote(kind), F.lit("&contentId="), quote(rid),
        F.lit(f"&catalogType={L.TEXTBOOK_CATALOG}&subCatalog={L.TEXTBOOK_CATALOG}"),
    )
    passed = [c for c in ("ordinal", "version_id", "status", "update_time", "create_time") if c in raw.columns]
    return base.select(
        *passed,
        rid.alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        "format",
        "size",
        *[tag_value(F.col("_tags"), n).alias(n) for n in L.TAG_DIMENSIONS.values()],
        F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("智慧中小学"))).alias("providers"),
        F.coalesce(F.get("thumbnails", F.lit(0)), F.get("preview_urls", F.lit(0))).alias("thumbnail"),
        F.size("preview_urls").alias("preview_count"),
        "preview_urls",
        page.alias("detail_page"),
    )


# ------------------------------------------------------------------ probes
def classify_probe(status: Column, has_detail: Column, n_items: Column, error: Column, offline: Column) -> Column:
    """Outcome of one detail probe from its HTTP status, content and error."""
    return (
        F.when(offline & ~has_detail, "detail_not_found_in_dir")
        .when(has_detail & (F.coalesce(n_items, F.lit(0)) > 0), "ok_with_file_items")
        .when(has_detail, "ok_no_file_items")
        .when(status == 403, "requires_auth")
        .when(status == 404, "not_found")
        .when(status.isNull(), "request_failed")
        .when(F.contains(error, F.lit("json decode failed")), "invalid_json")
        .when(blank_to_null(error).isNotNull(), "request_failed")
        .otherwise("unknown")
    )


def access_policy(status: Column, via_browser: Column | None = None) -> Column:
    browser = F.lit(False) if via_browser is None else via_browser
    return (
        F.when(status.isin(L.PROBE_OK) & browser, "browser_session_detail")
        .when(status.isin(L.PROBE_OK), "public_detail")
        .when(status == "requires_auth", "requires_auth_context")
        .when(status.isin("detail_not_found_in_dir", "not_found"), "unavailable_or_template_unknown")
        .otherwise("runtime_validation_needed")
    )


def conclusion(counts: dict[str, Column], auth_policy: Column) -> Column:
    """One verdict per group from its status counts."""
    return (
        F.when(counts["ok_with_file_items"] > 0, "公开可取")
        .when(counts["ok_no_file_items"] > 0, "无文件项")
        .when((counts["requires_auth"] > 0) | (auth_policy > 0), "需要授权")
        .when((counts["detail_not_found_in_dir"] > 0) | (counts["not_found"] > 0), "模板未知")
        .when(counts["missing_resource_id"] > 0, "模板未知")
        .otherwise("需运行时验证")
    )


def probe_summary(probes: DataFrame) -> DataFrame:
    """Status, policy, counts and error per probe, with defaults; failures get a filled error."""
    status = F.coalesce(blank_to_null("detail_status"), F.lit("unknown"))
    probes = let(probes, {"detail_status": status})
    status = F.col("detail_status")
    failed = ~status.isin(L.PROBE_OK)
    return probes.withColumns(
        {
            "detail_status": status,
            "detail_access_policy": F.coalesce(blank_to_null("detail_access_policy"), F.lit("runtime_validation_needed")),
            "detail_endpoint_family": F.coalesce(blank_to_null("detail_endpoint_family"), F.lit("s-file-ndrv2-details")),
            "file_item_count": F.coalesce("file_item_count", F.lit(0)),
            "parsed_candidate_count": F.coalesce("parsed_candidate_count", F.lit(0)),
            "error": F.when(failed, F.coalesce(blank_to_null("error"), status)).otherwise(F.coalesce("error", F.lit(""))),
            "failed": failed,
        }
    )


def detail_options(items: DataFrame, group: Sequence[str] = (), limit: int = 12) -> DataFrame:
    """First ``limit`` items of each result, by ordinal, for the next choice.

    A whole-table call is a top-n (no single-task sort); a grouped one a group limit.
    """
    from .grouping import top_k

    if group:
        return top_k(items, group, [F.col("ordinal")], limit)
    chosen = items.orderBy("ordinal").limit(limit).withColumn("_all", F.lit(1))
    return top_k(chosen, ["_all"], [F.col("ordinal")], limit).drop("_all")



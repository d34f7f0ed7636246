"""Site catalog: nested entries to rows, routes, scans and the site index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import blank_to_null, stable_id
from ..functions.urls import quote
from ..session import written
from .grouping import first_of, top_k, with_group_value


def _joined_titles(above: Column, below: Column) -> Column:
    return F.when(above.isNull(), below).when(below.isNull(), above).otherwise(F.concat(above, F.lit("/"), below))


def flatten_tree(nodes: DataFrame, id: str, parent: str, title: str) -> DataFrame:  # noqa: A002
    """Tree rows of any depth with depth, path of titles and the nearest parent title that is not blank.

    Every row knows its line up to some ancestor; in a round it takes over what that ancestor knows, so a line's known length
    doubles and a tree of depth d takes log2(d) rounds, each one join and one written table.  Rows whose line
    reaches a root (null parent) are done and leave the rounds.  Many rows may share an ancestor: they are spread over salts when they
    meet it.  An id in several rows has a line for each; rows under an unknown parent are left out.  A line that goes on after as many
    steps as there are rows comes back to an id above it and is an error.
    """
    label = blank_to_null(title)
    lines = written(
        nodes.select(
            F.col(id).alias("id"),
            F.col(parent).alias("parent_id"),
            F.col(title).alias("title"),
            F.lit(None).cast("string").alias("parent"),
            F.lit(1).alias("depth"),
            F.col(title).alias("path"),
            F.col(parent).alias("_up"),
            label.alias("_label"),
        )
    )
    left = lines.count().bit_length() + 1
    done, pending = [lines.where("_up is null")], lines.where("_up is not null")
    while not pending.isEmpty():
        if not left:
            looped = pending.first()["id"]
            raise ValueError(f"cycle in the tree at id {looped}")
        known = reduce(DataFrame.unionByName, [*done, pending])
        wanted = pending.select(F.col("_up").alias("id")).distinct()
        above = known.join(wanted, "id", "left_semi").select(
            F.col("id").alias("_up"),
            F.col("_up").alias("_next"),
            F.col("path").alias("_path"),
            F.col("depth").alias("_depth"),
            F.col("_label").alias("_above"),
        )
        met = with_group_value(pending, above, ["_up"], "inner")
        longer = written(
            met.select(
                "id",
                "parent_id",
                "title",
                F.coalesce("parent", "_above").alias("parent"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
                _joined_titles(F.col("_path"), F.col("path")).alias("path"),
                F.col("_next").alias("_up"),
                F.coalesce("_label", "_above").alias("_label"),
            )
        )
        done.append(longer.where("_up is null"))
        pending = longer.where("_up is not null")
        left -= 1
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("id", "parent_id", "title", F.coalesce("parent", F.lit("")).alias("parent"), "depth", "path")


def catalog_rows(nodes: DataFrame) -> DataFrame:
    """Flags of catalog entries: family, adapter, external.

    ``nodes`` has id, title, catalog, type and optionally sub_catalog, h5_url, page_mode."""
    textbook = (F.col("type") == L.TEXTBOOK_CATALOG) | (F.col("catalog") == L.TEXTBOOK_CATALOG)
    textbook = F.coalesce(textbook, F.lit(False))
    external = F.lit(False)
    if "h5_url" in nodes.columns:
        external = external | blank_to_null("h5_url").isNotNull()
    if "page_mode" in nodes.columns:
        external = external | F.coalesce(F.col("page_mode") == "outer_link", F.lit(False))
    return nodes.withColumns(
        {
            "resource_family": F.when(textbook, "教材").otherwise("通用资源"),
            "known_skill": F.lit(L.SITE_SOURCE),
            "internal_adapter": F.when(textbook, L.TEXTBOOK_CATALOG).otherwise(""),
            "external": external,
        }
    )


def catalog_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("catalogs"),
        F.count_if(F.col("known_skill") == L.SITE_SOURCE).alias("resource_catalogs"),
        F.count_if(F.col("external")).alias("external_catalogs"),
        F.count_if(F.col("internal_adapter") == L.TEXTBOOK_CATALOG).alias("textbook_catalogs"),
    )


def search_tab(row_type: Column, sub_catalog: Column, catalog: Column) -> Column:
    """Tab of the first known name among type, sub-catalog and catalog, else the first that is set."""

    def known(value: Column) -> Column:
        out = F
        for name, tab in L.CATALOG_TABS.items():
            out = out.when(value == name, tab)
        return out

    values = [row_type, sub_catalog, catalog]
    return F.coalesce(*[known(v) for v in values], *[blank_to_null(v) for v in values], F.lit(L.DEFAULT_TAB))


def route_for_catalog(rows: DataFrame) -> DataFrame:
    """Route id, page, strategy, tab, commands and detail templates of catalog rows."""

    def text(name: str) -> Column:
        return F.coalesce(blank_to_null(name), F.lit("")) if name in rows.columns else F.lit("")

    given = text("catalog")
    catalog = F.coalesce(blank_to_null("catalog"), F.lit("syncClassroom"))
    sub, kind, title = text("sub_catalog"), text("type"), text("title")
    adapter = text("internal_adapter")
    inner = (adapter == L.TEXTBOOK_CATALOG) | (catalog == L.TEXTBOOK_CATALOG) | (kind == L.TEXTBOOK_CATALOG)
    page = (
        F.when(catalog == L.TEXTBOOK_CATALOG, F.lit(f"{L.SITE_URL}{L.TEXTBOOK_CATALOG}"))
        .when(sub != "", F.concat(F.lit(L.SITE_URL), quote(catalog), F.lit("?subCatalog="), quote(sub)))
        .otherwise(F.concat(F.lit(L.SITE_URL), quote(catalog)))
    )
    commands = F.when(inner, F.array(F.lit(L.TEXTBOOK_COMMAND))).otherwise(
        F.array(F.lit(L.NEXT_SEARCH), F.lit(L.NEXT_DETAILS))
    )
    templates = F.array(
        *[
            F.concat(F.lit(L.DETAIL_FOLDER.format(server=s) + "resources/"), catalog, F.lit("/details/{id}.json"))
            for s in L.FILE_SERVERS[:2]
        ]
    )
    passed = [c for c in ("ordinal", "catalog_name", "sub_catalog_name", "resource_family") if c in rows.columns]
    return rows.select(
        *passed,
        stable_id(F.concat_ws("|", catalog, sub, kind, title)).alias("route_id"),
        title.alias("title"),
        catalog.alias("catalog"),
        sub.alias("sub_catalog"),
        kind.alias("type"),
        page.alias("page_url"),
        adapter.alias("internal_adapter"),
        F.when(inner, "internal_adapter").otherwise("search_then_detail").alias("scan_strategy"),
        commands.alias("supported_commands"),
        search_tab(kind, sub, given).alias("search_tab_code"),
        F.when(inner, F.array().cast("array<string>")).otherwise(templates).alias("detail_url_templates"),
        (~inner).alias("requires_runtime_validation"),
    )


def dedupe_routes(routes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return first_of(routes, ["route_id"], ordinal)


def scan_plan(routes: DataFrame) -> DataFrame:
    return routes.select(
        "route_id", "title", "catalog", "sub_catalog", "type", "page_url", "scan_strategy", "search_tab_code",
        "supported_commands", "requires_runtime_validation",
    )


def order_tabs(
    routes: DataFrame, requests: DataFrame, fields: Sequence[str], k: int = 8, ordinal: str = "ordinal"
) -> DataFrame:
    """Tabs per request by the number of request terms in a route's text.

    ``requests`` has ``request_id`` and ``terms`` (an array).  Terms meet route
    texts by the parts of the text (``search.containment_pairs``); a tab takes
    its best route, ties go to the earlier route, tabs without a hit follow in
    order, and at most ``k`` tabs per request are kept.
    """
    from ..functions.text import words
    from .search import containment_pairs

    usable = routes.where((F.col("scan_strategy") == "search_then_detail") & blank_to_null("search_tab_code").isNotNull())
    named = usable.select(
        F.col(ordinal).alias("_at"), F.col("search_tab_code").alias("tab"), F.concat_ws(" ", *fields).alias("_text")
    )
    # equal texts of a tab count once, at their first place
    texts = named.groupBy("tab", "_text").agg(F.min("_at").alias("_at"))
    asked = requests.select("request_id", F.explode(F.array_distinct("terms")).alias("_term"))
    lowered = asked.withColumn("_low", F.lower("_term"))
    pieces = texts.select("_at", "tab", "_text", F.explode(words("_text")).alias("_piece"))
    pairs = containment_pairs(pieces, "_piece", lowered, "_low")
    met = pieces.join(pairs, "_piece").select("_at", "tab", "_text", "_low").distinct().join(lowered, "_low")
    hits = (
        met.where(F.contains("_text", F.col("_term")))
        .groupBy("request_id", "tab", "_at")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = hits.groupBy("request_id", "tab").agg(F.max(F.struct("n", (-F.col("_at")).alias("_back"))).alias("_best"))
    # tabs without a hit follow in order: the first k tabs of all hold as many of them as a request can need
    firsts = texts.groupBy("tab").agg(F.min("_at").alias("_place")).orderBy("_place", "tab").limit(k)
    listed = firsts.agg(F.collect_list(F.struct("tab", "_place"))).scalar()
    fill = requests.select("request_id", listed.alias("_tabs")).select("request_id", F.explode("_tabs").alias("_t"))
    none = fill.select("request_id", "_t.tab", F.lit(0).cast("bigint").alias("hits"), "_t._place")
    some = best.select("request_id", "tab", F.col("_best.n").alias("hits"), (-F.col("_best._back")).alias("_place"))
    each = some.unionByName(none).groupBy("request_id", "tab").agg(
        F.max("hits").alias("hits"), F.max_by("_place", "hits").alias("_place")
    )
    order = [F.desc("hits"), F.col("_place"), F.col("tab")]
    return top_k(each, ["request_id"], order, k, "place").drop("_place")


def site_scan(routes: DataFrame, items: DataFrame, key: Sequence[str] = ("source_url", "resource_id")) -> tuple[DataFrame, DataFrame]:
    """(candidates, failures): items of the routes that were scanned, first row per key.

    ``items`` has ``route_id``, an ordinal and a nullable ``error``.  Routes are
    unique, so a route that yields a third of all items is spread over salts.
    """
    wanted = routes.select("route_id", "scan_strategy", F.col("title").alias("route_title"))
    tagged = with_group_value(items, wanted, ["route_id"], "inner")
    scanned = tagged.where(F.col("scan_strategy") != "internal_adapter")
    failures = scanned.where(F.col("error").isNotNull())
    good = scanned.where(F.col("error").isNull())
    good = good.withColumn("_key", candidate_key(key, [c for c in good.columns if c != "ordinal"]))
    return first_of(good, ["_key"]).drop("_key"), failures


def candidate_key(names: Sequence[str] = ("source_url", "resource_id"), record: Sequence[str] = ()) -> Column:
    """URL, else id; rows with neither fall back to a hash of the columns of ``record``."""
    whole = F.concat(F.lit("record:"), F.sha2(F.to_json(F.struct(*record)), 256)) if record else F.lit("")
    return F.coalesce(*[blank_to_null(n) for n in names], whole)


def site_index(routes: DataFrame, candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """Route table with what a scan found on each route (zero for none)."""
    found = candidates.groupBy("route_id").agg(F.count(F.lit(1)).alias("candidates"))
    lost = failures.groupBy("route_id").agg(F.count(F.lit(1)).alias("failures"))
    return (
        scan_plan(routes)
        .join(found, "route_id", "left")
        .join(lost, "route_id", "left")
        .fillna(0, ["candidates", "failures"])
    )


def site_index_summary(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("routes"),
        F.count_if(F.col("scan_strategy") == "search_then_detail").alias("search_then_detail_routes"),
        F.count_if(F.col("scan_strategy") == "internal_adapter").alias("internal_adapter_routes"),
        F.count_if(F.col("requires_runtime_validation")).alias("runtime_validation_routes"),
        F.sum("candidates").alias("candidates"),
        F.sum("failures").alias("failures"),
    )



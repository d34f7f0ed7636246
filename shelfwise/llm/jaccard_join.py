"""N-gram Jaccard join of candidate texts, and the groups that its links form.

Sets of word shingles are compared in a global order, rarest first.  Two sets with similarity of
at least a threshold (``Rule``) share a shingle in short prefixes of that order, so only sets that meet there are candidates:

* length filter: the smaller set has at least the threshold times the size of the larger;
* positional filter: where they meet leaves room for the overlap that is needed;
* suffix filter: both sets parted by fixed ranges of the hash; the parts' smaller sizes bound the overlap.

Each surviving pair is verified once on the whole sets.  Texts with equal sets are one node of the join.

The order counts each shingle's bucket over all texts in a table of fixed size (``ORDER_BITS``);
equal counts are ordered by hash.  Any order gives the same links, rare first gives few candidates.

A crowd of near copies meets at the same shingles, and its pairs grow with the square of its
size.  So while crowded shingles would make more pairs than there are postings, and hub rounds make them fewer, such
rounds come first: at every crowded shingle each node is compared with one hub, and links merge nodes
into groups.  Then all pairs between different groups are compared: none is left out, those within a group are settled.
At crowded shingles the pairs between the largest group's nodes are not even met, and a pair counts
only at the first shingle that its prefixes share, with the number of shared ones in the positional filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bit_filter import likely
from .chunks import by_bytes, frees_memory
from .components import component_stars
from .dense_counts import ROWS, block_rows, total
from .shingles import set_key, shingle_sets
from .tables import packed, unpacked, written

ORDER_BITS = 22
BLOCKS = 64
PARTS = 128
CROWD = 16
MAX_ROUNDS = 6
SETS = "ordinal long, text_key long, n int, node long, prefix array<long>, parts array<int>"


@dataclass(frozen=True)
class Rule:
    """Words per shingle, and the similarity in per cent (below 100) from which on two sets link."""

    width: int = 3
    percent: int = 90

    @property
    def least(self) -> int:
        """A set of fewer shingles than this links with equal sets only."""
        return -(-self.percent // (100 - self.percent))


def bucket_counts(candidates: DataFrame, rule: Rule = Rule()) -> np.ndarray:
    """How many texts hold a shingle of each bucket; 2**ORDER_BITS numbers (16 MB), whatever the corpus."""

    @frees_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, dtype=np.uint32)
        shift = np.uint64(64 - ORDER_BITS)
        for batch in batches:
            for _, texts in by_bytes(batch.column("text")):
                for s in shingle_sets(texts, rule.width):
                    np.add.at(counts, (s >> shift).astype(np.int64), np.uint32(1))
        yield from block_rows(counts, BLOCKS)

    texts = candidates.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = total(texts.mapInArrow(count, ROWS), 1 << ORDER_BITS, BLOCKS)
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


def probe_length(n, percent: int = 90):
    """Prefix of a set of n shingles that meets every partner's index prefix; works on numbers and columns."""
    return n - -(-percent * n // 100) + 1


def _keyed(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        F.col("ordinal").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_key", F.xxhash64("text"))


def _sets_with_prefixes(candidates: DataFrame, counts: np.ndarray, rule: Rule) -> DataFrame:
    """Per candidate its set's size and key; the rare-first prefix, and the number of shingles in each range of the
    hash, a task gives once for each key."""
    shared = candidates.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - ORDER_BITS)
    to_part = np.uint64(64 - PARTS.bit_length() + 1)

    @frees_memory
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        order = shared.value
        for batch in batches:
            for first, texts in by_bytes(batch.column("text")):
                sizes, nodes, prefixes, parts = [], [], [], []
                for s in shingle_sets(texts, rule.width):
                    node = set_key(s)
                    sizes.append(len(s))
                    nodes.append(node if len(s) else None)
                    if len(s) < rule.least or node in seen:
                        prefixes.append(None)
                        parts.append(None)
                        continue
                    seen.add(node)
                    rare = np.argsort(order[(s >> shift).astype(np.int64)], kind="stable")  # ties: by hash, as s is sorted
                    prefixes.append(s[rare[: probe_length(len(s), rule.percent)]].view(np.int64))
                    parts.append(np.bincount((s >> to_part).astype(np.int64), minlength=PARTS).astype(np.int32))
                cut = slice(first, first + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ordinal")[cut],
                        batch.column("text_key")[cut],
                        pa.array(sizes, pa.int32()),
                        pa.array(nodes, pa.int64()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(parts, pa.list_(pa.int32())),
                    ],
                    ["ordinal", "text_key", "n", "node", "prefix", "parts"],
                )

    return _keyed(candidates).select("ordinal", "text_key", "text").mapInArrow(build, SETS)


def _needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """Smallest overlap with 100 * overlap >= percent * union."""
    return F.ceil((n_a + n_b) * percent / (100 + percent))


def _sized(n_a: Column, n_b: Column, percent: int) -> Column:
    """Length filter."""
    return (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)


def _room(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for postings of sets a and b that meet."""
    n_a, n_b, at_a, at_b = (F.col(c) for c in (f"n_{a}", f"n_{b}", f"at_{a}", f"at_{b}"))
    most = F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b)
    return _sized(n_a, n_b, percent) & (most >= _needed(n_a, n_b, percent))


def _side(postings: DataFrame, side: str) -> DataFrame:
    return postings.select(
        "token",
        F.col("node").alias(side),
        F.col("n").alias(f"n_{side}"),
        F.col("at").alias(f"at_{side}"),
        F.col("label").alias(f"label_{side}"),
    )


def _by_node(postings: DataFrame) -> DataFrame:
    """One row with all its postings for each node."""
    return postings.groupBy("node").agg(F.min("n").alias("n"), F.collect_list(F.struct("token", "at")).alias("posts"))


def _labelled(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """Postings with the group that their node belongs to so far: labels meet nodes, of which there are no more
    than texts, and not postings."""
    named = nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("star")), "node", "left")
    labels = named.select("node", "n", F.coalesce("star", "node").alias("label"), F.explode("posts").alias("post"))
    return labels.select("post.token", "node", "n", "post.at", "label")


def _parted(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings at tokens met by over CROWD nodes, which the hub rounds work on, and all others.

    How many nodes meet at a token does not depend on their groups, so this parting holds for all rounds.
    """
    busy = written(shared.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("token"), "busy")
    return written(shared.join(busy, "token", "left_semi"), "busy-postings"), shared.join(busy, "token", "left_anti")


def _crowded(postings: DataFrame) -> tuple[DataFrame, int]:
    """Of the tokens of ``_parted``, those with nodes of more than one group, each with its largest group ``top``, and the
    pairs that they would make; the other tokens hold no pair between groups."""
    groups = postings.groupBy("token", "label").agg(F.count("*").alias("k"))
    tokens = groups.groupBy("token").agg(
        F.sum("k").alias("m"),
        F.sum(F.col("k") * F.col("k")).alias("squares"),
        F.count("*").alias("n_groups"),
        F.max(F.struct("k", "label"))["label"].alias("top"),
    )
    several = tokens.where("n_groups > 1").withColumn("pairs", (F.col("m") * F.col("m") - F.col("squares")) / 2)
    several = written(several.select("token", "top", "pairs"), "crowded")
    return several.select("token", "top"), int(several.agg(F.sum("pairs").alias("s")).first().s or 0)


def _hub_pairs(postings: DataFrame, crowded: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every node at a crowded token against the token's hub of this round."""
    here = postings.join(crowded.select("token"), "token", "left_semi")
    pick = F.struct(F.xxhash64("token", "node", F.lit(turn)).alias("h"), "node", "n", "at", "label")
    hubs = here.groupBy("token").agg(F.min(pick).alias("hub")).select(
        "token",
        F.col("hub.node").alias("b"),
        F.col("hub.n").alias("n_b"),
        F.col("hub.at").alias("at_b"),
        F.col("hub.label").alias("label_b"),
    )
    met = _side(here, "a").join(hubs, "token").where((F.col("label_a") != F.col("label_b")) & _room("a", "b", percent))
    return met.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _all_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Every pair of sets of different groups that meet in their prefixes: the larger by its probe prefix, the
    smaller by its shorter index prefix."""
    index = _side(postings.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1), "b")
    met = _side(postings, "a").join(index, "token")
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    kept = met.where(larger & (F.col("label_a") != F.col("label_b")) & _room("a", "b", percent))
    return kept.select("a", "b").distinct()


def _some(sets: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """One row with the columns of each of the given nodes (``node``)."""
    rows = sets.where("prefix is not null").select("node", *columns)
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _crowd_pairs(postings: DataFrame, crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of different groups at crowded tokens that the filters leave, each at one token.

    One side holds no node of the token's largest group, so that group is met by others only.
    """
    dense = postings.join(crowded, "token")
    facts = _some(sets, dense.select("node").distinct(), "prefix", "parts")
    dense = written(dense.join(facts, "node"), "crowd-postings")

    def side(name: str) -> DataFrame:
        return dense.select("token", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "label", "prefix", "parts", "top")])

    minor = side("a").where("label_a <> top_a").drop("top_a")
    once = (F.col("label_b") == F.col("top_b")) | (F.col("node_a") < F.col("node_b"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    sized = _sized(n_a, n_b, percent)
    shared = F.array_intersect("prefix_a", "prefix_b")
    first = F.element_at(shared, 1) == F.col("token")
    last = F.element_at(shared, -1)
    left = F.least(n_a - F.array_position("prefix_a", last), n_b - F.array_position("prefix_b", last))
    near = (F.size(shared) + left >= _needed(n_a, n_b, percent)) & (_parts_overlap() >= _needed(n_a, n_b, percent))
    kept = (F.col("label_a") != F.col("label_b")) & once & sized & first & near
    return minor.join(side("b"), "token").where(kept).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _parts_overlap() -> Column:
    """Suffix filter: no more shingles are shared than the smaller side has in each range of the hash."""
    smaller = F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y))
    return F.aggregate(smaller, F.lit(0), lambda s, x: s + x)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that the suffix filter leaves, each once, with both sizes."""
    facts = written(_some(sets, _ends(pairs), "n", "parts"), "pair-parts")
    for side in "ab":
        pairs = pairs.join(facts.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in facts.columns]), side)
    return written(pairs.where(_parts_overlap() >= _needed(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b"), "near")


def _verified(near: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets overlap enough."""
    both = near.join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        whole.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(overlap >= _needed(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _whole_sets(candidates: DataFrame, sets: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node`` and ``shingles`` of the given nodes, from the text of one candidate each."""

    @frees_memory
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in by_bytes(batch.column("text")):
                shingles = [s.view(np.int64) for s in shingle_sets(texts, width)]
                node = batch.column("node")[first : first + len(texts)]
                yield pa.RecordBatch.from_arrays([node, pa.array(shingles, pa.list_(pa.int64()))], ["node", "shingles"])

    rows = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("ordinal", "text_key")).alias("row"))
    named = written(rows.select(F.col("row.ordinal").alias("_ordinal"), F.col("row.text_key").alias("_key"), "node"), "joining")
    wanted = named.select(F.col("_ordinal").alias("ordinal"), F.col("_key").alias("text_key"))
    texts = likely(_keyed(candidates), wanted, "ordinal", "text_key").join(
        named, F.col("ordinal").eqNullSafe(F.col("_ordinal")) & (F.col("text_key") == F.col("_key"))
    )
    return written(texts.select("node", "text").mapInArrow(build, "node long, shingles array<long>"), "whole-sets")


def linked_stars(candidates: DataFrame, sets: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Stars (``u``, ``v``) of the groups that links between different sets form."""
    width, percent = rule.width, rule.percent
    postings = sets.where("prefix is not null").select("node", "n", F.posexplode("prefix").alias("at", "token"))
    postings = postings.select("token", "node", "n", (F.col("at") + 1).alias("at")).repartition("token")
    # all columns are used, so that both sides of the join read one shuffle
    met = postings.groupBy("token").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.max("n").alias("n_"), F.max("at").alias("at_")
    )
    met = met.where((F.col("low") < F.col("high")) & (F.col("n_") + F.col("at_") > 0)).select("token")
    shared = postings.join(met, "token", "left_semi").dropDuplicates(["token", "node"])
    shared = written(shared, "shared-postings")
    n_shared = shared.count()
    busy, light = _parted(shared)
    stars, labelled, before, whole, nodes = None, busy.withColumn("label", F.col("node")), None, None, None
    crowded, pairs = _crowded(labelled)
    for turn in range(MAX_ROUNDS):
        if pairs <= n_shared or (before and pairs > 0.7 * before):
            break
        if whole is None:  # crowded tokens only become fewer, so these nodes serve all rounds
            crowd = written(busy.select("node").distinct(), "crowd-nodes")
            whole = _whole_sets(candidates, sets, crowd, width)
            nodes = written(_by_node(busy), "busy-nodes")
        links = _verified(_near(_hub_pairs(labelled, crowded, turn, percent), sets, percent), whole, percent)
        stars = component_stars(_with_stars(links, stars))
        labelled, before = written(_labelled(nodes, stars), "labelled"), pairs
        crowded, pairs = _crowded(labelled)
    # the other postings learn their groups once, after all rounds
    sparse = light.withColumn("label", F.col("node")) if stars is None else _labelled(_by_node(light), stars)
    plain = _all_pairs(sparse, percent)
    rest = plain.unionByName(_crowd_pairs(labelled, crowded, sets, percent))
    both = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = _near(written(both, "pairs"), sets, percent)
    missing = _ends(near) if whole is None else _ends(near).join(whole, "node", "left_anti")
    more = _whole_sets(candidates, sets, missing, width)
    whole = more if whole is None else whole.unionByName(more)
    return component_stars(_with_stars(_verified(near, whole, percent), stars))


def _with_stars(links: DataFrame, stars: DataFrame | None) -> DataFrame:
    return links if stars is None else links.unionByName(stars.select(F.col("u").alias("a"), F.col("v").alias("b")))


def jaccard_groups(candidates: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per candidate row: ``ordinal``, ``text_key`` (64-bit hash of the text), ``n_shingles``, ``node`` (key of its set) and ``component_id``.

    Reads ``ordinal`` and whole ``text``.  Candidates link when 100 * intersection >= ``rule.percent`` * union of their sets of
    distinct shingles of ``rule.width`` words (A-Z as a-z; fewer words make one shingle).  ``component_id``: the smallest ordinal reachable by links, its own included; a null
    ordinal is never the smallest unless the whole group has none.  Without words (or text) the set is
    empty and the candidate is alone.  Repeated rows come back as often as they occur.  No candidates: no rows.
    Shingles and sets are compared by 64-bit hashes.
    """
    sets = written(_sets_with_prefixes(candidates, bucket_counts(candidates, rule), rule), "sets")
    stars = linked_stars(candidates, sets, rule)
    members = sets.select("ordinal", "text_key", F.col("n").cast("long").alias("n_shingles"), "node")
    alone = members.where("node is null").withColumn("component_id", F.col("ordinal"))
    named = members.where("node is not null").join(
        stars.select(F.col("u").alias("node"), F.col("v").alias("star")), "node", "left"
    )
    named = named.withColumn("label", F.coalesce("star", "node")).drop("star")
    least = named.groupBy("label").agg(F.min("ordinal").alias("component_id"))
    return named.join(least, "label").select(*members.columns, "component_id").unionByName(alone)


def first_of_groups(candidates: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The candidates, one row of each group of ``jaccard_groups``: that with the smallest ordinal.

    All columns come back.  Of rows with that ordinal and different texts the smallest text key stays,
    of rows equal in both any one.  Rows without words are alone and all stay.
    """
    groups = jaccard_groups(candidates, rule).groupBy("ordinal", "text_key", "node", "component_id").agg(F.count("*").alias("rows"))
    pick = F.when(F.col("ordinal").eqNullSafe(F.col("component_id")), F.struct("ordinal", "text_key", "rows"))
    own = F.when(F.col("component_id").isNull(), F.col("node"))  # groups without any ordinal are told apart by their set
    kept = groups.where("node is not null").groupBy("component_id", own.alias("own")).agg(F.min(pick).alias("row")).select("row.*")
    alone = groups.where("node is null").select("ordinal", "text_key", F.lit(1).cast("long").alias("rows"))
    keep = written(kept.unionByName(alone).distinct(), "group-firsts")
    key = F.xxhash64(F.coalesce("text", F.lit("")))

    whole = packed(candidates, ordinal="ordinal", text="text")

    def those(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("ordinal").alias("_ordinal"), F.col("text_key").alias("_key"))
        same = F.col("ordinal").cast("long").eqNullSafe(F.col("_ordinal")) & (key == F.col("_key"))
        return whole.join(named, same, "left_semi")

    repeated = keep.where("rows > 1")
    found = those(keep)
    if not repeated.isEmpty():
        once = those(repeated).withColumn("_k", key).dropDuplicates(["ordinal", "_k"]).drop("_k")
        found = those(keep.where("rows = 1")).unionByName(once)
    return unpacked(found, candidates.columns, ordinal="ordinal", text="text")

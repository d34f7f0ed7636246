"""Mixing candidate sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal words.  A source needs one slot for every block of its target.  Slot i is offered to the source in
whose part of the cumulative shares of slots the golden-ratio point i * phi mod 1 falls, so every stretch of
the mix holds each source in its proportion, and is left out once that source has all its slots.  The r-th slot of a source takes
the r-th block of that source's candidates, laid end to end in a shuffled order and repeated as far as its target reaches.
A block without a slot is not in the mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.grouping import numbered

from .tables import packed, unpacked, written
from .words import first_words, word_count

WEIGHTS = (1.0, 2.0, 3.0)
BLOCK_WORDS = 256
MAX_REPEAT = 3
CELLS = 1024
BUCKETS = 4096
ROUNDS = 3
#: Fractions of the golden ratio: phi mod 1, and 2**20 * phi mod 1, so that the point of a large slot number keeps its digits.
PHI, PHI_2_20 = 0.6180339887498949, 0.607787409740351


def golden_point(slot: Column) -> Column:
    """slot * phi mod 1 in [0, 1)."""
    high, low = F.floor(slot / F.lit(1 << 20)), slot % F.lit(1 << 20)
    value = high * F.lit(PHI_2_20) + low * F.lit(PHI)
    return value - F.floor(value)


def _units(candidates: DataFrame) -> DataFrame:
    """One row per distinct (ordinal, source, text): its words, number of rows and shuffled place."""
    slim = candidates.select(
        F.col("ordinal").cast("long"),
        F.col("source").cast("string"),
        F.xxhash64("text").alias("text_key"),
        word_count(F.col("text")).alias("size"),
    )
    grouped = slim.groupBy("ordinal", "source", "text_key", "size").agg(F.count("*").alias("rows"))
    place = F.xxhash64("ordinal", "text_key", F.lit("mix"))
    return grouped.withColumns(
        {"place": place, "bucket": F.shiftrightunsigned(place, 52).cast("int"), "words": F.col("size") * F.col("rows")}
    )


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source (``source``, ``source_size``): ``source_no``, ``weight``, ``target``, ``total``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the total of all sizes; a target stops
    at ``max_repeat`` times its source's size and the excess is shared again by weight.  That ends at one level:
    target = min(level * weight, cap), found by going through the sources in the order in which they fill.  The windows here see one row per source.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.partitionBy()
    order = Window.orderBy(F.asc_nulls_last("source"))
    fill = Window.orderBy("_fills", "source_no")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    numbered_sources = sizes.withColumn("source_no", F.row_number().over(order)).withColumns(
        {
            "weight": F.element_at(turn, (F.col("source_no") - 1) % F.lit(len(weights)) + 1),
            "cap": (F.col("source_size") * F.lit(max_repeat)).cast("double"),
            "total": F.sum("source_size").over(every),
        }
    )
    levels = numbered_sources.withColumn("_fills", F.col("cap") / F.col("weight")).withColumn(
        "_level",
        (F.col("total") - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    # the level rises while sources fill below it and falls after, so the largest is the one that holds
    level = F.max("_level").over(every)
    return levels.withColumn("target", F.least(F.coalesce(level, F.lit(0.0)) * F.col("weight"), "cap")).select(
        "source", "source_no", "source_size", "weight", "target", "total"
    )


def slot_schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """``slot``, ``source_no``, ``block``: which block of which source each slot takes.

    A source has ``ceil(target / block_words)`` slots and that part of [0, 1).  Slots meet sources in an equi-join on one of ``CELLS`` equal
    parts of [0, 1), which the points fill evenly whatever the shares are, and are then numbered per source in bounded
    runs of slots; a source's first ones count.  The points come back to any part within three times its share's
    turn, so three rounds of slots serve all; more are drawn while a source is short of its slots.
    """
    spark = targets.sparkSession
    order = Window.orderBy("source_no")
    every = Window.partitionBy()
    needs = targets.select("source_no", F.ceil(F.ceil("target") / block_words).cast("long").alias("need")).where("need > 0")
    summed = needs.withColumns(
        {"upto": F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "slots": F.sum("need").over(every)}
    )
    edges = summed.withColumns({"lo": (F.col("upto") - F.col("need")) / F.col("slots"), "hi": F.col("upto") / F.col("slots")})
    first, last = (F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)) for c in ("lo", "hi"))
    parts = edges.select("source_no", "need", "lo", "hi", F.explode(F.sequence(first, last)).alias("cell"))
    total = needs.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    rounds = ROUNDS
    while True:
        points = spark.range(rounds * total).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
        placed = points.withColumn("cell", F.floor(F.col("point") * CELLS)).join(parts, "cell")
        chosen = placed.where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "source_no", "need")
        ranked = numbered(chosen, ["source_no"], ordinal="slot", name="turn", block=1 << 16).where(F.col("turn") <= F.col("need"))
        schedule = written(ranked.select("slot", "source_no", (F.col("turn").cast("long") - 1).alias("block")), "mix-schedule")
        if schedule.count() == total:
            return schedule
        rounds *= 2


def mix_pieces(
    candidates: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The mix itself, and the units it was made from.

    Pieces: ``slot`` (slots left out leave gaps), ``ordinal``, ``text_key``, ``source_no``, ``epoch``, ``words`` (how many of the unit's words
    lie in that slot).  Units: one row per distinct (``ordinal``, ``source``, text) with ``rows``, ``size``, ``source_size``, ``target``.
    """
    units = written(_units(candidates), "mix-units")
    cells = units.groupBy("source", "bucket").agg(F.sum("words").alias("cell_words"))
    targets = written(
        source_targets(cells.groupBy("source").agg(F.sum("cell_words").alias("source_size")), weights, max_repeat),
        "mix-targets",
    )
    schedule = slot_schedule(targets, block_words)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("cell_words").over(before), F.lit(0))).drop("cell_words")
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("place", "ordinal", "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = units.withColumn("_in", F.coalesce(F.sum("words").over(inside), F.lit(0))).withColumnsRenamed(
        {"source": "u_source", "bucket": "u_bucket"}
    )
    laid = laid.join(starts, F.col("u_source").eqNullSafe(F.col("source")) & (F.col("u_bucket") == F.col("bucket")))
    laid = laid.select(
        "ordinal", "text_key", "size", "rows", "words", "u_source", (F.col("_in") + F.col("cell_start")).alias("start")
    )
    placed = laid.join(targets.drop("weight", "total"), F.col("u_source").eqNullSafe(F.col("source"))).drop("u_source")
    limit = F.ceil("target").cast("long")
    epochs = (
        placed.where("words > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
        .withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start"))
        .where(F.col("from") < limit)
        .withColumn("to", F.least(F.col("from") + F.col("words"), limit))
    )
    first, last = F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words)
    cut = epochs.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("from"), F.col("block") * block_words)
    high = F.least(F.col("to"), (F.col("block") + 1) * block_words)
    pieces = cut.withColumn("taken", high - low).join(schedule, ["source_no", "block"])
    return pieces.select("slot", "ordinal", "text_key", "source_no", "epoch", F.col("taken").alias("words")), placed


def mix_sources(candidates: DataFrame, **settings) -> DataFrame:
    """Per candidate row: ``ordinal``, ``text_key``, ``size``, ``source_size``, ``target``, ``taken`` (repeats counted).

    Reads ``ordinal``, ``source`` and ``text`` (``text_key`` is its 64-bit hash); size is the number of words, zero for null.  See ``source_targets`` for the
    targets and ``mix_pieces`` for ``weights``, ``max_repeat`` and ``block_words``.  A source's taken words are its target
    rounded up, but for remainders of equal rows; no row exceeds ``max_repeat`` times its size.  Equal rows are mixed
    as one unit and share its words evenly (a remainder smaller than their number is left out).  Null source is a source of its own,
    null ordinal is an ordinary value.  The shuffle order is a hash, so
    reruns agree.  No candidates: no rows.  A hot source is laid out in 4,096 hash buckets, and its blocks
    are joined by (source, block), so no task gathers it.
    """
    pieces, units = mix_pieces(candidates, **settings)
    taken = pieces.groupBy("ordinal", "text_key", "source_no").agg(F.sum("words").alias("unit_taken"))
    keys = ["ordinal", "text_key", "source_no"]
    named = taken.withColumnsRenamed({k: f"t_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]
    joined = units.join(named, same, "left").withColumn(
        "taken", F.floor(F.coalesce("unit_taken", F.lit(0)) / F.col("rows")).cast("long")
    )
    return joined.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        "ordinal", "source", "text_key", "size", "source_size", "target", "taken"
    )


def mixed_rows(candidates: DataFrame, **settings) -> DataFrame:
    """The candidates as often as the mix takes them, whole copies first and then the words of a cut copy.

    All columns of candidates come back; only in the cut copy (one candidate per source at most in
    each mix) ``text`` is shortened to the words taken, one space between them.  Rows that are not taken, or hold no words, go.
    """
    shares = mix_sources(candidates, **settings).where("taken > 0").select(
        F.col("ordinal").alias("_o"), F.col("text_key").alias("_k"), F.col("source").alias("_s"), F.struct("size", "taken").alias("_mix")
    ).distinct()
    same = (
        F.col("ordinal").cast("long").eqNullSafe(F.col("_o"))
        & (F.xxhash64("text") == F.col("_k"))
        & F.col("source").cast("string").eqNullSafe(F.col("_s"))
    )
    keep = {"ordinal": "ordinal", "source": "source", "text": "text"}
    rows = packed(candidates, **keep).join(shares, same).drop("_o", "_k", "_s")
    whole = F.floor(F.col("_mix.taken") / F.col("_mix.size")).cast("int")
    cut = F.col("_mix.taken") % F.col("_mix.size")
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<long>"))
    )
    out = rows.withColumn("_words", F.explode(copies))
    text = F.when(F.col("_words") > 0, first_words(F.col("text"), F.col("_words"))).otherwise(F.col("text"))
    return unpacked(out.withColumn("text", text), candidates.columns, **keep)

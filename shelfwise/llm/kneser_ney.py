"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Tokens are the bytes of the UTF-8 text, n-grams are numbers (the bytes one after the other), and
each text begins after ``order - 1`` zero bytes.  The model is a set of tables over distinct
n-grams that grow with the trusted text and are joined shard by shard, never broadcast by hand:

* the highest order counts occurrences, lower orders count distinct left neighbours;
* each order has its three discounts from its counts of counts;
* p(w | context) = (count - discount) / context total + gamma(context) * p(w | shorter context),
  the shortest being uniform over 256 bytes.

Texts are not moved to the model.  A task lists the distinct n-grams of its texts (a block), the list
meets the model's shards in joins, and the block's probabilities come back as one small file that the
task which scores the block reads.  A block's list is bounded by the block's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import by_bytes, frees_memory
from .tables import new_folder, written

ORDER = 4
SCALE = 1 << 20
BINS = 10_000
FLUSH = 1 << 20


def grams_of(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams ending at each byte of each text, and the number of bytes of each text."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    pad = order - 1
    data = np.frombuffer(b"".join(b"\0" * pad + r for r in raws), dtype=np.uint8).astype(np.int64)
    if not sizes.sum():
        return np.empty(0, dtype=np.int64), sizes
    n = len(data) - pad
    value = np.zeros(n, dtype=np.int64)
    for k in range(order):
        value = (value << 8) | data[k : k + n]
    ends = np.zeros(n, dtype=bool)  # n-grams whose last byte is a text's own, not the padding of the next
    at = np.cumsum(sizes + pad) - sizes - pad
    for start, size in zip(at, sizes):
        ends[start : start + size] = True
    return value[ends], sizes


class _Distinct:
    """Sorted distinct numbers with their counts, merged run by run."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, values: np.ndarray) -> None:
        keys, counts = np.unique(values, return_counts=True)
        both, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.zeros(len(both), dtype=np.int64)
        np.add.at(sums, place, np.concatenate([self.counts, counts]))
        self.keys, self.counts = both, sums


def gram_counts(trusted: DataFrame, order: int) -> DataFrame:
    """``gram``, ``n``: occurrences in all trusted texts; each task adds up its own before the shuffle."""

    @frees_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Distinct()
        for batch in batches:
            for _, texts in by_bytes(batch.column("text")):
                held.add(grams_of(texts, order)[0])
                if len(held.keys) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys), pa.array(held.counts)], ["gram", "n"])
                    held = _Distinct()
        if len(held.keys):
            yield pa.RecordBatch.from_arrays([pa.array(held.keys), pa.array(held.counts)], ["gram", "n"])

    parts = trusted.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once, twice, three and four times.

    Where a number is missing the discount falls back to half of what it discounts at most.
    """
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n3 else 0.75
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.0
    return tuple(float(np.clip(d, 0.05, top)) for d, top in ((d1, 0.95), (d2, 1.9), (d3, 2.85)))


def _suffix(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * k)) - 1))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def fit_model(trusted: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Per order 1..n: (``gram``, ``p``) of seen n-grams and (``context``, ``gamma``), each a written table.

    Without trusted text the tables are empty and every byte gets 1/256.
    """
    counts = {order: written(gram_counts(trusted, order), "kn-counts")}
    for k in range(order - 1, 0, -1):
        shorter = counts[k + 1].groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        counts[k] = written(shorter, "kn-counts")
    model: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        row = counts[k].agg(*[F.count_if(F.col("n") == c).alias(f"n{c}") for c in (1, 2, 3, 4)]).first()
        d = discounts([row.n1, row.n2, row.n3, row.n4])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        keyed = counts[k].select("gram", "n", _context(F.col("gram")).alias("context"), cut.alias("cut"))
        contexts = keyed.groupBy("context").agg((F.sum("cut") / F.sum("n")).alias("gamma"), F.sum("n").alias("total"))
        contexts = written(contexts, "kn-contexts")
        joined = keyed.join(contexts, "context")
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            seen = joined.select("gram", (own + F.col("gamma") / 256).alias("p"))
        else:
            below = model[-1][0].select(F.col("gram").alias("below"), F.col("p").alias("p_below"))
            seen = joined.join(below, _suffix(F.col("gram"), k - 1) == F.col("below")).select(
                "gram", (own + F.col("gamma") * F.col("p_below")).alias("p")
            )
        model.append((written(seen, "kn-seen"), contexts.select("context", "gamma")))
    return model


def gram_probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``gram``, ``p`` for any n-grams of the model's order: seen or backed off, order by order."""
    out = grams.withColumn("p", F.lit(1 / 256))
    for k, (seen, contexts) in enumerate(model, 1):
        own = seen.select(F.col("gram").alias("seen"), F.col("p").alias("p_seen"))
        lead = contexts.select(F.col("context").alias("lead"), "gamma")
        suffix = _suffix(F.col("gram"), k)
        out = (
            out.join(own, suffix == F.col("seen"), "left")
            .join(lead, _context(suffix) == F.col("lead"), "left")
            .select("gram", F.coalesce("p_seen", F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
        )
    return out


def score_texts(candidates: DataFrame, model: list[tuple[DataFrame, DataFrame]], language: str) -> DataFrame:
    """Per candidate row: ``ordinal``, ``language``, ``n_tokens`` and ``nats``, the mean of -log p per byte (null without bytes).

    A block is a partition of ``candidates``, which both passes read alike when it comes from a table;
    should its texts differ after all, an n-gram is missing in the block's file and the task fails.
    """
    order = len(model)
    slim = candidates.select(
        F.col("ordinal").cast("long"), F.col(language).cast("string").alias("language"), F.coalesce("text", F.lit("")).alias("text")
    )

    @frees_memory
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Distinct()
        for batch in batches:
            for _, texts in by_bytes(batch.column("text")):
                held.add(grams_of(texts, order)[0])
        block = np.full(len(held.keys), TaskContext.get().partitionId(), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(held.keys)], ["block", "gram"])

    asked = written(slim.select("ordinal", "language", "text").mapInArrow(listed, "block int, gram long"), "kn-blocks")
    known = written(gram_probabilities(asked.select("gram").distinct(), model), "kn-probabilities")
    folder = new_folder(candidates.sparkSession, "kn-block-files")
    nats = F.round(-F.log("p") * SCALE).cast("long").alias("nats")
    asked.join(known, "gram").select("block", "gram", nats).repartition("block").write.partitionBy("block").parquet(folder)

    @frees_memory
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None
        for batch in batches:
            for first, texts in by_bytes(batch.column("text")):
                grams, sizes = grams_of(texts, order)
                if keys is None and len(grams):
                    keys, values = _block_file(folder, TaskContext.get().partitionId())
                total = np.zeros(1, dtype=np.int64)
                if len(grams):
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    if (keys[at] != grams).any():
                        raise RuntimeError("the candidates' partitions changed between two passes; write them to a table first")
                    total = np.concatenate([[0], np.cumsum(values[at])])
                ends = np.cumsum(sizes)
                mean = (total[ends] - total[ends - sizes]) / (np.maximum(sizes, 1) * float(SCALE))
                cut = slice(first, first + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ordinal")[cut], batch.column("language")[cut], pa.array(sizes), pa.array(mean, mask=sizes == 0)],
                    ["ordinal", "language", "n_tokens", "nats"],
                )

    return slim.mapInArrow(score, "ordinal long, language string, n_tokens long, nats double")


def _block_file(folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of a block and their -log p in units of 1/SCALE."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    table = ds.dataset(f"{path}/block={block}", filesystem=system, format="parquet").to_table(columns=["gram", "nats"])
    keys, values = table["gram"].to_numpy(), table["nats"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def language_limits(scores: DataFrame, quantile: float) -> DataFrame:
    """``language``, ``limit_nats``: the quantile of the scores per language, and a row with ``any`` for all.

    Scores are counted in bins of 1/10,000 and the limit is the upper end of a bin, so a hot language is a histogram before it is grouped and the quantile
    does not depend on the order of rows.
    """
    bins = scores.where("nats is not null").groupBy("language", F.ceil(F.col("nats") * BINS).cast("long").alias("bin"))
    counted = bins.agg(F.count("*").alias("n")).withColumn("any", F.lit(False))
    every = counted.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("language"), "bin", "n", F.lit(True).alias("any"))
    both = counted.unionByName(every)
    group = Window.partitionBy("any", "language")
    run = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(group)})
    return (
        ranked.where(F.col("upto") >= F.col("all") * quantile)
        .groupBy("any", "language")
        .agg((F.min("bin") / BINS).alias("limit_nats"))
    )


def held_out_scores(trusted: DataFrame, order: int) -> DataFrame:
    """``ordinal``, ``nats`` of one half of the trusted texts under a model of the other half.

    Copies of a text are in the same half, by its hash.
    """
    held = F.xxhash64(F.coalesce("text", F.lit("")), F.lit("held")) % 2 == 0
    # scored from a table, as its partitions are read twice
    rows = written(trusted.where(held).select("ordinal", "text", F.lit(None).cast("string").alias("language")), "kn-held")
    return score_texts(rows, fit_model(trusted.where(~held), order), "language").select("ordinal", "nats")


def perplexity_rules(
    candidates: DataFrame,
    trusted: DataFrame,
    *,
    order: int = ORDER,
    quantile: float = 0.99,
    language: str = "language",
) -> DataFrame:
    """Per candidate row: ``ordinal``, ``language``, ``n_tokens`` (bytes), ``perplexity``, ``limit_perplexity``, ``kept``.

    ``trusted``: candidate rows with the text to train on, all of it.  The limit is the quantile per language of
    ``held_out_scores``, as texts that a model was trained on score better than equally good ones that it has not seen.
    A language without such scores takes the limit over all of them, and without any everything with words is kept.  Catalog candidates name no language, so ``language`` says
    which column does.  Null text counts as empty: no perplexity, not kept.  Null languages are one
    language; repeated rows are judged each; other columns are not read.  No candidates: no rows.
    """
    scores = written(score_texts(candidates, fit_model(trusted, order), language), "kn-scores")
    named = scores.select("ordinal", "language").distinct()
    limits = written(language_limits(held_out_scores(trusted, order).join(named, "ordinal"), quantile), "kn-limits")
    own = limits.where("not any").select(F.col("language").alias("l"), F.col("limit_nats").alias("own"))
    every = limits.where("any").agg(F.max("limit_nats").alias("m")).first().m
    limit = F.coalesce("own", F.lit(every).cast("double"))
    judged = scores.join(own, F.col("language").eqNullSafe(F.col("l")), "left").withColumn("limit", limit)
    return judged.select(
        "ordinal",
        "language",
        "n_tokens",
        F.exp("nats").alias("perplexity"),
        F.exp("limit").alias("limit_perplexity"),
        F.coalesce((F.col("nats") <= F.col("limit")) | F.col("limit").isNull(), F.lit(False)).alias("kept"),
    )

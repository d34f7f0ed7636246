"""Quality rules: length and repetition limits, then a hashed n-gram likelihood ratio.

The target is the text of trusted candidates (``official`` ones), the raw
corpus is every candidate.  Both are multinomials over hashed n-grams of four
UTF-8 bytes, a fixed number of buckets.  A text's score is the mean over its n-grams of
log(target share / raw share): near zero for text like the trusted one, clearly
below for text that the trusted one would hardly produce.  One threshold decides
for every text alike: a low quantile of what trusted texts score when each is left out of the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_bytes, frees_memory
from .dense_counts import ROWS, block_rows, total

BITS = 16
GRAM = 4
SCALE = 1 << 16
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)
BLOCKS = 16
#: Scores are counted in bins of 1/1000 around zero; 2**BITS bins hold every score (a ratio of counts stays below e**32).
BINS = 1000
QUANTILE = 0.005


@dataclass(frozen=True)
class LikelihoodRatio:
    """log(target share / raw share) per bucket in units of 1/SCALE; 2**BITS integers, whatever the corpus.

    ``shares``: the target's counts and the logs of the raw shares that it was made from.
    """

    ratios: Broadcast
    shares: Broadcast


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts one after the other, and the number of n-grams of each text."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    grams = np.maximum(sizes - GRAM + 1, 0)
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    if len(data) < GRAM:
        return np.empty(0, dtype=np.int64), grams
    n = len(data) - GRAM + 1
    value = np.zeros(n, dtype=np.uint32)
    for k in range(GRAM):
        value |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    value = (value * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    ends = np.cumsum(sizes)
    inside = np.ones(n, dtype=bool)
    for k in range(1, GRAM):  # n-grams that would reach into the next text
        over = ends[:-1] - k
        inside[over[(over >= 0) & (over < n)]] = False
    starts = ends - sizes
    for at in np.flatnonzero(sizes < GRAM):
        inside[starts[at] : min(ends[at], n)] = False
    return value[inside].astype(np.int64), grams


@frees_memory
def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for batch in batches:
        for _, texts in by_bytes(batch.column("text")):
            counts += np.bincount(gram_buckets(texts)[0], minlength=1 << BITS)
    yield from block_rows(counts, BLOCKS)


def gram_counts(candidates: DataFrame) -> np.ndarray:
    """Occurrences of each bucket in every candidate's ``text``.

    A task adds up its own texts and sends a few packed rows.  Null text counts as empty; no candidates
    give zeros.
    """
    texts = candidates.select(F.coalesce("text", F.lit("")).alias("text"))
    return total(texts.mapInArrow(_count_grams, ROWS), 1 << BITS, BLOCKS)


def fit_ratio(candidates: DataFrame, trusted: DataFrame) -> LikelihoodRatio:
    """The likelihood ratio of ``trusted`` candidates (target) against all ``candidates`` (raw), on all their text.

    Add-one smoothing over the 2**BITS buckets.  Only the table of buckets reaches
    the driver (65,536 rows at most, half a megabyte as broadcast), never a count
    that grows with the corpus.  Without any trusted text all ratios are zero.
    """
    raw, target = gram_counts(candidates) + 1.0, gram_counts(trusted) + 1.0
    if target.sum() == len(target):
        ratio = np.zeros(1 << BITS)
    else:
        ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    scaled = np.round(ratio * SCALE).astype(np.int64)
    context = candidates.sparkSession.sparkContext
    return LikelihoodRatio(context.broadcast(scaled), context.broadcast((target, np.log(raw / raw.sum()))))


def left_out_score(buckets: np.ndarray, target: np.ndarray, log_raw: np.ndarray) -> float:
    """The mean log ratio of a trusted text's n-grams, with its own n-grams taken out of the target."""
    if not len(buckets):
        return 0.0
    own, n = np.unique(buckets, return_counts=True)
    logs = np.log(target[own] - n) - np.log(target.sum() - len(buckets)) - log_raw[own]
    return float((n * logs).sum() / len(buckets))


def trusted_threshold(
    trusted: DataFrame,
    ratio: LikelihoodRatio,
    *,
    quantile: float = QUANTILE,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> float:
    """The score that a share of at most ``quantile`` of the trusted texts lies below, rounded down to 1/BINS.

    ``trusted``: the rows that ``ratio`` was fitted to.  Each is scored as if it were not among them, so the
    threshold suits good texts that nobody labelled.  Only texts that pass the length and repetition limits count,
    as the others are not judged by score.  All trusted rows are counted in a histogram of 2**BITS bins; without any
    the threshold is minus infinity.
    """
    shares = ratio.shares

    @frees_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, log_raw = shares.value
        counts = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for _, texts in by_bytes(batch.column("text")):
                failed = _base(texts, min_words, max_repeat_percent)[2]
                buckets, grams = gram_buckets(texts)
                ends = np.cumsum(grams)
                for k in np.flatnonzero(~failed):
                    score = left_out_score(buckets[ends[k] - grams[k] : ends[k]], target, log_raw)
                    counts[int(np.floor(score * BINS)) + (1 << BITS - 1)] += 1
        yield from block_rows(counts, BLOCKS)

    texts = trusted.select(F.coalesce("text", F.lit("")).alias("text"))
    upto = np.cumsum(total(texts.mapInArrow(count, ROWS), 1 << BITS, BLOCKS))
    if not upto[-1]:
        return float("-inf")
    return float(np.searchsorted(upto, quantile * upto[-1], side="right") - (1 << BITS - 1)) / BINS


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text: words lying in a window of WINDOW words that the text holds twice or more."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    n = int(sizes.sum())
    out = np.zeros(len(words), dtype=np.int64)
    if n < WINDOW:
        return out
    ids, _ = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    text = np.repeat(np.arange(len(words), dtype=np.int64), sizes)

    def joined(a, b):  # codes of pairs: equal codes mean equal words, nothing is hashed away
        return pd.factorize((a.astype(np.int64) << 32) | b.astype(np.int64))[0]

    two = joined(ids[:-1], ids[1:])
    four = joined(two[:-2], two[2:])
    five = joined(joined(four[: n - 4], ids[4:]), text[: n - 4])
    whole = text[: n - 4] == text[4:]
    again = whole & (np.bincount(five[whole], minlength=n)[five] >= 2)
    at = np.flatnonzero(again)
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    inside = np.cumsum(marks)[:n] > 0
    return np.bincount(text[inside], minlength=len(words))


def _base(texts: list[str], min_words: int, max_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its words, its repeated words, and whether they fail the limits."""
    words = [t.encode("utf-8", "replace").split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    repeats = repeated_words(words)
    return n_words, repeats, (n_words < min_words) | (100 * repeats > max_repeat * n_words)


def _rules(ratios: np.ndarray, texts: list[str], min_words: int, max_repeat: int, threshold: float) -> list[np.ndarray]:
    n_words, repeats, failed = _base(texts, min_words, max_repeat)
    chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], dtype=np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64)
    dups = np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(SPACES)]
            dups[k] = len(lines) - len(set(lines))
    buckets, grams = gram_buckets(texts)
    total = np.concatenate([[0], np.cumsum(ratios[buckets])])
    ends = np.cumsum(grams)
    score = total[ends] - total[ends - grams]
    llr = score / (np.maximum(grams, 1) * float(SCALE))
    return [n_words, chars, symbols, dups, repeats, failed, llr, ~failed & (llr >= threshold)]


def quality_rules(
    candidates: DataFrame,
    ratio: LikelihoodRatio,
    *,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    threshold: float = -1.05,
    name: str = "quality",
) -> DataFrame:
    """Adds the struct ``name`` (see ``RESULT``) to candidates; reads ``text`` alone, row by row.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent``
    of the words in repeated windows.  ``kept``: not so, and the mean log ratio per
    n-gram is at least ``threshold``; take it from ``trusted_threshold``, the default only drops texts of foreign symbols.  Null text counts as empty (no words, so it fails); a text shorter than one
    n-gram scores zero.  Repeated rows get equal results; every other column is passed
    on unread, and an own column called ``name`` is replaced.  The score is summed in
    integers, so it does not depend on how rows are batched.
    """
    ratios = ratio.ratios

    @F.arrow_udf(RESULT)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(batches)

    @frees_memory
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = [f.strip().rsplit(" ", 1) for f in RESULT.split(",")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        for texts in batches:
            parts = [_rules(ratios.value, run, min_words, max_repeat_percent, threshold) for _, run in by_bytes(texts)]
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(len(fields))]
            yield pa.StructArray.from_arrays(
                [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields]
            )

    return candidates.withColumn(name, judge("text"))


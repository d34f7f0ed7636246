"""Alignment of two tokenizers over candidate texts: which of their tokens cover the same bytes.

The left tokenizer is a byte-level BPE file (``.json``) that reads a space and the text, the right one a sentencepiece
file (``.model``) that reads the text and puts the space itself, so both write the same bytes.  Each
side's token ends are summed up into a dictionary from end to index; the ends that both sets hold, in order, slice the two
id lists into groups, and the tokens that close a slice are linked.

A link joins two tokens that end at the same byte, so one token's bytes are a suffix of the other's.  The pairs
that can be linked at all are therefore known from the two vocabularies alone (some hundred thousand), and so is the size of
every table of counts over pairs, however large the corpus is.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_bytes, frees_memory, give_back
from .dense_counts import ROWS, block_rows, total
from .tables import written
from .token_pieces import _BYTE_LETTERS

COUNT_BLOCKS = 8
CACHE_PIECES = 80_000
CACHED_LENGTH = 64
JOINED_LENGTH = 1 << 15
#: No token of either side reaches over a space that stands alone between two characters that are not white space: the left
#: tokenizer starts a token there, and the right vocabulary has no piece with a space after another character.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
ALIGNED_TYPES = "ordinal long, n_a long, n_b long, n_groups long, groups string, links array<int>"
ALIGNED = ["ordinal", "n_a", "n_b", "n_groups", "groups", "links"]


#: The alignment of a part of a text between safe boundaries: tokens left and right, groups, their text, and the codes of the
#: linked pairs (32 bits each).  Plain tuples, which the garbage collector passes over.
Piece = tuple[int, int, int, str, bytes]


def _cut(text: str) -> list[str]:
    """A text's pieces between lone spaces; without two white spaces in a row every space inside is one."""
    plain = text[0] != " " and text[-1] != " " and not _TWO_SPACES.search(text)
    return text.split(" ") if plain else LONE_SPACE.split(text)


def align(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Where both sides of the same bytes have a token's end: how many tokens of either side lie before each, in order.

    ``a_ends`` and ``b_ends`` are the byte offsets at which the tokens end.  No token is empty, so one token of a side ends there.
    """
    a_at, b_at = dict(zip(a_ends, count(1))), dict(zip(b_ends, count(1)))
    common = sorted(a_at.keys() & b_at.keys())
    return [a_at[end] for end in common], [b_at[end] for end in common]


def possible_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pairs of which one token's bytes are a suffix of the other's, in order of the ids."""
    width, found = len(b_bytes), array("q")
    for flip, longer, shorter in ((False, a_bytes, b_bytes), (True, b_bytes, a_bytes)):
        known = defaultdict(list)
        for k, token in enumerate(shorter):
            if token:
                known[token].append(k)
        for k, token in enumerate(longer):
            for at in range(len(token)):
                found.extend(x * width + k if flip else k * width + x for x in known.get(token[at:], ()))
    return np.divmod(np.unique(np.frombuffer(found, dtype=np.int64)), width)


class Aligner:
    """Both tokenizers of a worker with their tokens' bytes; short pieces are kept, ``CACHE_PIECES`` in each of two generations."""

    def __init__(self, left: str, right: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        letters = {letter: byte for byte, letter in _BYTE_LETTERS.items()}
        added = {k: t.content.encode() for k, t in self.left.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * self.left.get_vocab_size()
        for token, k in self.left.get_vocab().items():
            self.a_bytes[k] = added.get(k) or bytes(letters.get(c, ord(c) & 0xFF) for c in token)
        pieces = [self.right.id_to_piece(k) for k in range(self.right.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.right.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]
        self.pair_a, self.pair_b = possible_pairs(self.a_bytes, self.b_bytes)
        self.a_length, self.b_length = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = ([str(k) for k in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.pair_keys = self.pair_a * len(self.b_bytes) + self.pair_b
        self.kept: dict[str, Piece | None] = {}
        self.older: dict[str, Piece | None] = {}

    def _aligned(self, parts: list[str]) -> Iterator[tuple[str, Piece | None]]:
        """Pieces with their alignment, or None where a side's bytes are not the space and the piece.

        Pieces without white space at their ends are joined by single spaces, which are safe boundaries again.
        """
        run, size = [], 0
        for part in parts:
            if part[0].isspace() or part[-1].isspace():
                yield from self._joined([part])
                continue
            run.append(part)
            size += len(part)
            if size >= JOINED_LENGTH:
                yield from self._joined(run)
                run, size = [], 0
        if run:
            yield from self._joined(run)

    def _joined(self, run: list[str]) -> Iterator[tuple[str, Piece | None]]:
        text = " ".join(run)
        a, b, whole = self.left.encode(" " + text, add_special_tokens=False).ids, self.right.encode(text), (" " + text).encode("utf-8", "replace")
        if b"".join([self.a_bytes[k] for k in a]) != whole or b"".join([self.b_bytes[k] for k in b]) != whole:
            if len(run) == 1:
                yield text, None
                return
            half = len(run) // 2
            yield from self._joined(run[:half])
            yield from self._joined(run[half:])
            return
        a_ids, b_ids = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        a_cuts, b_cuts = align(np.cumsum(self.a_length[a_ids]).tolist(), np.cumsum(self.b_length[b_ids]).tolist())
        a_upto, b_upto = np.array(a_cuts), np.array(b_cuts)
        keys = a_ids[a_upto - 1] * len(self.b_bytes) + b_ids[b_upto - 1]
        links = np.searchsorted(self.pair_keys, keys).astype(np.int32)
        shown, a_names, b_names, i, j = [], self.a_names, self.b_names, 0, 0
        for x, y in zip(a_cuts, b_cuts):
            left = a_names[a[i]] if x - i == 1 else ",".join([a_names[k] for k in a[i:x]])
            right = b_names[b[j]] if y - j == 1 else ",".join([b_names[k] for k in b[j:y]])
            shown.append(left + "|" + right)
            i, j = x, y
        # a piece ends where both sides end a token
        ends = np.cumsum([len(p.encode("utf-8", "replace")) + 1 for p in run])
        groups = (np.searchsorted(np.cumsum(self.a_length[a_ids])[a_upto - 1], ends) + 1).tolist()
        g = i = j = 0
        for part, upto in zip(run, groups):
            x, y = a_cuts[upto - 1], b_cuts[upto - 1]
            yield part, (x - i, y - j, upto - g, ";".join(shown[g:upto]), links[g:upto].tobytes())
            g, i, j = upto, x, y

    def aligned(self, texts: list[str]) -> list[list[Piece]]:
        """Every text's pieces in order; none for an empty text or one whose bytes a side does not write.

        Pieces not met before are aligned in one batch; of the short ones the latest are kept in two generations.
        """
        split = [_cut(t) if t else [] for t in texts]
        found: dict[str, Piece | None] = {}
        kept, older, fresh = self.kept, self.older, []
        for part in {p for parts in split for p in parts}:
            if part in kept:
                found[part] = kept[part]
            elif part in older:
                found[part] = kept[part] = older[part]
            else:
                fresh.append(part)
        for part, piece in self._aligned(fresh):
            found[part] = piece
            if len(part) <= CACHED_LENGTH:
                kept[part] = piece
        if len(kept) >= CACHE_PIECES:
            self.kept, self.older = {}, kept
        out = [[found[p] for p in parts] for parts in split]
        return [[] if None in pieces else pieces for pieces in out]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    """The worker's aligner for two files; what it keeps serves all tasks that the worker runs."""
    if (left, right) not in _ALIGNERS:
        _ALIGNERS[left, right] = Aligner(left, right)
    return _ALIGNERS[left, right]


def _forget() -> None:
    """Gives a worker's tokenizers and pieces back once no stage needs them."""
    if _ALIGNERS:
        _ALIGNERS.clear()
        give_back()


def _totals(links: DataFrame, size: int) -> np.ndarray:
    """How many links hold each possible pair, in the order of the aligner's pairs."""
    padded = -(-size // COUNT_BLOCKS) * COUNT_BLOCKS

    @frees_memory
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        counts = np.zeros(padded, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("links").flatten().to_numpy(), minlength=padded)
        yield from block_rows(counts, COUNT_BLOCKS)

    return total(links.select("links").mapInArrow(add, ROWS), padded, COUNT_BLOCKS)[:size]


def align_texts(candidates: DataFrame, left: str, right: str) -> DataFrame:
    """The alignment of every ``text`` as a table in the shared folder: ``ordinal``, ``n_a``, ``n_b``, ``n_groups``, ``groups``, ``links``.

    ``groups``: the ids of every group as text, ``a1,a2|b1;a3|b2,b3``.  ``links``: the codes of the linked pairs, one per occurrence.
    """

    @frees_memory
    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(left, right)
        for batch in batches:
            for first, run in by_bytes(batch.column("text")):
                rows: list[list] = [[], [], [], [], []]
                for pieces in own.aligned(run):
                    n_a, n_b, n_groups, shown, links = zip(*pieces) if pieces else ((),) * 5
                    codes = np.frombuffer(b"".join(links), dtype=np.int32)
                    for column, value in zip(rows, (sum(n_a), sum(n_b), sum(n_groups), ";".join(shown), codes)):
                        column.append(value)
                columns = [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([batch.column("ordinal").slice(first, len(run)), *columns], ALIGNED)

    slim = candidates.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(result, ALIGNED_TYPES), "token-alignment", compression="zstd")


def linked_pairs(aligned: DataFrame, left: str, right: str) -> DataFrame:
    """``a_id``, ``b_id``, ``n``: the pairs that the alignments link and how often, a translation table between the vocabularies."""
    own = aligner(left, right)
    counts = _totals(aligned, len(own.pair_a))
    held = np.flatnonzero(counts)
    table = pa.table({"a_id": own.pair_a[held].astype(np.int32), "b_id": own.pair_b[held].astype(np.int32), "n": counts[held]})
    return aligned.sparkSession.createDataFrame(table)


def align_tokens(candidates: DataFrame, left: str, right: str) -> DataFrame:
    """How the tokens of two tokenizers cover every ``text``: one row per candidate row.

    ``left`` and ``right`` are paths on the driver and the executors (``.json``, ``.model``).  ``ordinal``; ``n_a``, ``n_b`` tokens;
    ``groups`` as text (``a1,a2|b1;a3|b2,b3``) and their number ``n_groups``; ``n_links``; ``n_best``, the links whose pair is linked as often as
    any pair of its right token over all candidates; ``count_sum``, those numbers added up over the text's links.  A text that is
    null or empty, or that a tokenizer does not write byte for byte, has zeros and an empty ``groups``.  Special tokens' strings
    are plain text.  Reads ``ordinal`` (null is an ordinary value) and ``text``; repeated rows are aligned each.  Texts of any length are
    aligned whole, piece by piece.  No candidates: no rows.

    Texts are read once and the alignments written; the counts of pairs are one vector per task, its length set by the
    vocabularies, so a hot pair costs a counter and nothing is shuffled by pair or by text.
    """
    own = aligner(left, right)
    aligned = align_texts(candidates, left, right)
    counts = _totals(aligned, len(own.pair_a))
    best = np.zeros(len(own.b_bytes), dtype=np.int64)
    np.maximum.at(best, own.pair_b, counts)
    is_best = counts == best[own.pair_b]

    @F.arrow_udf("n_best long, count_sum long")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _forget()
        for links in batches:
            codes, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x[codes], dtype=np.int64)])[ends] for x in (is_best, counts)]
            yield pa.StructArray.from_arrays([pa.array(np.diff(x)) for x in sums], ["n_best", "count_sum"])

    rated = aligned.withColumn("rated", rate("links"))
    return rated.select("ordinal", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "rated.n_best", "rated.count_sum", "groups")

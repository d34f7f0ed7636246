"""Token counts of candidate texts under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_bytes

RESULT = "n_bytes long, n_tokens long"


def _encoder(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from .token_pieces import encoder

    pieces = encoder(path, drops_space=False)
    return lambda texts: [len(x) // 4 for x in pieces.encode(texts)]


def token_counts(candidates: DataFrame, tokenizer: str, *, limit: int = 1024, name: str = "tokens") -> DataFrame:
    """Adds the struct ``name`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every ``text``.

    ``tokenizer`` is the path of a byte-level ``.json`` or a sentencepiece ``.model`` file on
    the executors.  Arrow batches are cut into runs of about half a megabyte, so a run of long texts
    costs a task no more memory than one of short texts; texts are cut at
    safe boundaries (see ``token_pieces``) and only lengths come back.  Nothing is
    truncated and no special token is added.  Null text counts as empty.  Every other
    column is passed on; an own column called ``name`` is replaced.  No shuffle.
    """

    @F.arrow_udf(RESULT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths = _encoder(tokenizer)
        for texts in batches:
            tokens, sizes = [], []
            for _, run in by_bytes(texts):
                tokens.extend(lengths(run))
                sizes.extend(len(t.encode("utf-8", "replace")) for t in run)
            yield pa.StructArray.from_arrays(
                [pa.array(np.array(sizes, dtype=np.int64)), pa.array(np.array(tokens, dtype=np.int64))],
                ["n_bytes", "n_tokens"],
            )

    raw = candidates.withColumn(name, count("text"))
    return raw.withColumn(name, F.col(name).withField("over_limit", F.col(f"{name}.n_tokens") > limit))

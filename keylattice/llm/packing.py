"""Packing by power-of-two decomposition.

Every document's token sequence is cut into pieces whose lengths are powers of
two, longest first: as many pieces of ``longest`` tokens as fit, then one piece
for each one bit of what is left.  A piece belongs to the bucket of its length,
so a training batch drawn from one bucket has sequences of equal length, needs
no padding, and no sequence crosses documents.  No token is dropped and none is
added.

It is one narrow pass (no shuffle): a bucket is a column of the result, and
``write_buckets`` lays the buckets out as folders.

Defined cases: a null or empty text has no tokens and gives no piece; a row
with a null ``doc_id`` is packed, with a null id; a text of any length is packed
whole, in as many longest pieces as it needs; pieces of equal length keep the
order of the text; repeated rows are packed each on its own; other columns of
the input, whatever their names, are neither read nor passed on; an empty table
gives an empty result; an id that isn't a number fails the cast to bigint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keylattice.llm.bpe import DEFAULT_VOCABULARY, ChunkEncoder
from keylattice.llm.textkit import slices

#: Tokens in the longest piece; a power of two.
LONGEST = 8192
SCHEMA = "doc_id bigint, piece int, start int, length int, bucket int, tokens array<int>"


def decompose(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of sequences of these lengths: its sequence, number in it, start in it, and length."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    top = longest.bit_length() - 1
    lengths = lengths.astype(np.int64)
    sizes = 1 << np.arange(top, -1, -1, dtype=np.int64)
    count = (lengths[:, None] // sizes) % 2
    count[:, 0] = lengths // longest
    seq = np.repeat(np.arange(len(lengths)), count.sum(1))
    length = np.repeat(np.tile(sizes, len(lengths)), count.ravel())
    total = np.cumsum(length) - length
    firsts = np.searchsorted(seq, np.arange(len(lengths)))
    at = firsts[seq]
    return seq, np.arange(len(seq)) - at, total - total[at] if len(seq) else total, length


def pack(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, longest: int = LONGEST) -> DataFrame:
    """The pieces of every document, with their token ids."""

    def run(batches):
        encode = ChunkEncoder(vocabulary)
        for b in slices(batches):
            ids, first = encode(b.column("text"))
            seq, piece, start, length = decompose(np.diff(first), longest)
            values = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids, pa.int32())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(seq)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int32()),
                    pa.array(length, pa.int32()),
                    pa.array(np.round(np.log2(np.maximum(length, 1))), pa.int32()),
                    values,
                ],
                names=["doc_id", "piece", "start", "length", "bucket", "tokens"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)

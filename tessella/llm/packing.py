"""Packing by power-of-two decomposition (operator 3).

A document of n ids becomes floor(n / 1024) pieces of 1024 ids and one piece for each bit that is
set in the rest, longest first. Each piece is a sequence of its own: no sequence crosses documents
and, every length being a power of two, none is padded. Sequences of one length form a bucket, from
which batches of equal shape are drawn.

Defined cases: null text is empty and still has the end id, so one piece of length 1; repeated rows
are packed each on its own; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.byte_bpe import byte_bpe
from tessella.llm.common import arrow_pass, texts

MAX_LENGTH, END = 1024, 0
_END_BYTES = np.array([END], "<u4").tobytes()


def lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """The pieces' lengths for n ids: whole blocks, then the bits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(with_ids: bool, most: int):
    def make():
        bpe = byte_bpe()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packed = bpe.encode_bytes(text) + _END_BYTES
                n, at = len(packed) // 4, 0
                for size in lengths(n, most):
                    own = packed[4 * at : 4 * (at + size)]
                    doc.append(d)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype("int32"))
                    at += size
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            return pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

        return work

    return make


def pack(docs: DataFrame, with_ids: bool = True, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids
    unless with_ids is false. max_length is a power of two. sequence_id is unique per row and the
    same for a retried task, as it derives from the input partition and the place in it."""
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = arrow_pass(texts(docs, id_col, text_col), _pieces(with_ids, max_length), schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences so that each bucket of equal lengths is a folder of its own."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)

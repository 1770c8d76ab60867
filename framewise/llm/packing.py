"""Packing by power-of-two decomposition.

Every document becomes token ids and is cut into pieces whose lengths are powers of two, largest first: as many of
``max_len`` as fit, then one for each set bit of what is left. A piece is a sequence of its own, so no sequence crosses
documents and none is padded; batches are formed of equal lengths (``bucket`` is the exponent). One pass over the texts,
no shuffle, nothing kept between documents.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = "<|endoftext|>"
#: White space in a row that the fast encoder is trusted with; it fails from somewhere above five times as much.
SPACES = 100_000


@cache
def encoders(vocabulary: str, ranks: str | None):
    """(fast, reference): the reference tokenizer of ``vocabulary`` and, if ``ranks`` names the same vocabulary as byte
    ranks, a faster encoder with the same ids for texts without special tokens and endless white space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return None, reference
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), reference


def spacious(text: str) -> bool:
    """Whether more than ``SPACES`` white-space characters stand in a row."""
    return len(text) > SPACES and any(m.end() - m.start() > SPACES for m in re.finditer(r"\s+", text))


def token_ids(text: str | None, vocabulary: str, ranks: str | None = None) -> np.ndarray:
    fast, reference = encoders(vocabulary, ranks)
    if not text:
        return np.zeros(0, np.uint32)
    if fast is None or SPECIAL in text or spacious(text):
        return np.array(reference.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


def cuts(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    out, at = [], 0
    size = max_len
    while at < n:
        while size > n - at:
            size >>= 1
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, max_len: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset``.

    ``ids`` are the piece's tokens as little-endian unsigned 32-bit values; ``doc_tokens`` counts the closing ``end_id``.
    A null or empty text is the single id ``end_id``. Rows are taken one by one: repeated rows and rows with the same or
    no id give pieces of their own, other columns are ignored, an empty table gives no piece. ``sequence_id`` is unique
    and stays the same when a task is run again, as only the input's order of rows enters it.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows, start, length, ids, total = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    tokens = np.append(token_ids(text, vocabulary, ranks), np.uint32(end_id)).astype("<u4")
                    for at, size in cuts(len(tokens), max_len):
                        rows.append(i)
                        start.append(at)
                        length.append(size)
                        ids.append(tokens[at:at + size].tobytes())
                        total.append(len(tokens))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        pieces, f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return out.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"),
                      F.lit(0).cast("bigint").alias("offset"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: digests of the packed documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


QUERIES = {"op6_packing": query}
ORACLES: dict[str, str] = {}

"""Packing along a space-filling curve.

A document's token ids are hashed into a count vector, the vector is projected to three
dimensions, and the point's place on a Hilbert curve is its key. Documents are range-sorted by key,
laid end to end in that order and cut into sequences of equal length, so that neighbours on the
curve share sequences and only the last sequence of all has room left.

Texts are tokenised once and the ids stored in the shared folder. What is sorted is three numbers a
document; a document's place is its range's first token plus a running sum inside the range.

Defined results: a null text is empty and has the end id alone; repeated rows are documents of
their own; equal keys are ordered by reading order; an empty table gives no rows; clashing columns
are not read. An added token of the vocabulary inside a text is its one id, as in ``tokenizers``
with ``add_special_tokens=False``.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import ship, stage, text_or_empty, width

LENGTH = 2048
END = 1
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json as ranks: the same ids, sooner
BUCKETS, DIMENSIONS, LEVELS = 256, 3, 20
ADDED = {"<|endoftext|>": 50256}  # the added tokens of byte_bpe_50k.json, which the ranks lack
ROOM = 1 << 16  # ids are stored in 16 bits


@lru_cache(maxsize=2)
def tokenizer(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        read = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(*read.values(), *ADDED.values()) >= ROOM:
        raise ValueError("ids do not fit 16 bits")
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read, special_tokens=ADDED)


@lru_cache(maxsize=1)
def projection() -> tuple[np.ndarray, np.ndarray]:
    """Of an id the bucket, of a bucket the direction."""
    rng = np.random.default_rng(11)
    return rng.integers(0, BUCKETS, ROOM), rng.standard_normal((BUCKETS, DIMENSIONS))


def hilbert(points: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Places on the Hilbert curve of points (n, d) with coordinates under 2**levels (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (levels - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (levels - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(levels - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def keys(documents: list[np.ndarray]) -> np.ndarray:
    """The curve key of each document, from its ids."""
    bucket, way = projection()
    at = np.zeros((len(documents), DIMENSIONS))
    for k, ids in enumerate(documents):
        v = np.bincount(bucket[ids], minlength=BUCKETS)
        at[k] = v @ way / max(1.0, float(np.sqrt(v @ v)))
    cell = np.clip((at + 6) / 12, 0, 1 - 1e-9) * (1 << LEVELS)
    return hilbert(cell.astype(np.int64))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """rid, key, curve, n, ids: each document's ids (16 bits each, little-endian) with the end id, and its place on the curve."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(tokenizer(ranks).encode, allowed_special="all")
        for b in batches:
            ids = [np.array([*encode(t), END], np.uint16) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys(ids), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["rid", key, "curve", "n", "ids"])

    return docs.select(F.monotonically_increasing_id().alias("rid"), key, text_or_empty(text).alias("text")).mapInArrow(run, f"rid long, {key} {docs.schema[key].dataType.simpleString()}, curve long, n long, ids binary")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, length: int = LENGTH) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve."""
    spark = docs.sparkSession
    held = stage(tokens(docs, key, text, ranks), "packing-tokens", compression="zstd")
    ranged = stage(held.select("rid", "curve", "n").repartitionByRange(width(spark), "curve", "rid").withColumn("part", F.spark_partition_id()), "packing-order")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("first"))  # a row for each range
    places = ranged.withColumn("inside", before(Window.partitionBy("part").orderBy("curve", "rid"))).join(first, "part").select("rid", (F.col("first") + F.col("inside")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[] for _ in range(8)]
            for who, at, n, ids, curve in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, start = np.frombuffer(ids, np.uint16).astype("<u4"), 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(n - start, length - off)
                    for col, v in zip(got, (who, start, size, zlib.crc32(own[start : start + size].tobytes()), n, seq, off, curve), strict=True):
                        col.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(got[0], b.schema.types[0]), *(pa.array(c, pa.int64()) for c in got[1:])], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve"])

    whole = held.join(places, "rid").select(key, "at", "n", "ids", "curve")
    kind = docs.schema[key].dataType.simpleString()
    return whole.mapInArrow(cut, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long")

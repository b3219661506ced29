"""Token counts out of a cache of digests.

A text's normal form is digested, and the digest is looked up among stored counts of the same tokenizer version.
Only contents that are not stored are encoded, each once however often it comes, and appended to the store; then every document reads
its count there. The version is a digest of the vocabulary file, the library's version and the rule of normal forms, and
is a partition of the store, so that another vocabulary never meets these counts and a lookup reads its own alone.

Normal forms only join texts that the vocabulary cannot tell apart: runs of ASCII white space become one space and go at both
ends; a text of ASCII characters is lower-cased as well, unless it has ``<|``, which may begin a special string, and those tell
case. (Letters with marks are left alone: some have a composed form in lower case only.)

Words between white space never share a token, so a text's count is the sum over its words. A task encodes the
distinct words of a batch that it has not met before, with the library, and adds up.

Appends are atomic for a job; two jobs that append the same content store the same count twice, and readers fold them. A lost
executor costs its tasks, which encode their contents again.

Defined results: a null text is empty and has no tokens; every input row gets a row, repeated ones too; a null key is kept; an empty
table gives no rows; other columns are not read. A word of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from importlib.metadata import version

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnfold.llm.common import shared_dir, ship, stage, text_or_empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
RULE = "1"  # of normal forms and of sums over words
WORDS = 1 << 17  # words that a worker keeps counts of
LONGEST = 64  # bytes of a word that is kept
SLICE = 4 << 20  # bytes of text that are split at a time
STORED = "digest binary, n_tokens long"


def normal_form(text: Column) -> Column:
    ascii_ = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_ & ~F.contains(text, F.lit("<|")), F.lower(text)).otherwise(text)
    return F.trim(F.regexp_replace(folded, r"[\x20\x09-\x0D]+", " "))


def version_of(vocabulary: str = VOCABULARY) -> str:
    with open(vocabulary, "rb") as f:
        return hashlib.sha256(b"\n".join([hashlib.sha256(f.read()).digest(), version("tokenizers").encode(), RULE.encode()])).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> tuple[Tokenizer, dict[str, int]]:
    found = Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found, {}


def word_counts(words: list[str], vocabulary: str) -> list[int]:
    """Tokens of each word, from the worker's bounded memory or the library."""
    tok, known = tokenizer(vocabulary)
    new = [w for w in words if w not in known]
    found = dict(zip(new, (len(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False)), strict=True)) if new else {}
    out = [known[w] if w in known else found[w] for w in words]
    if len(known) + len(found) > WORDS:
        known.clear()
    known.update((w, n) for w, n in found.items() if len(w) <= LONGEST)
    return out


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Stretches of a batch with about so many bytes of text; a longer text comes alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def counts_of(texts: pa.Array, vocabulary: str = VOCABULARY) -> np.ndarray:
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words = split.flatten().dictionary_encode()
    each = np.asarray(word_counts(words.dictionary.to_pylist(), vocabulary), np.int64)
    sums = np.r_[0, np.cumsum(each[words.indices.to_numpy()])]
    at = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]
    return sums[at[1:]] - sums[at[:-1]]


def stored(spark: SparkSession, cache: str, tokens: str) -> DataFrame:
    """digest, n_tokens: what the cache has for a tokenizer version, each digest once."""
    try:
        rows = spark.read.schema(STORED).parquet(f"{cache}/version={tokens}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORED)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, text: str = "text", vocabulary: str = VOCABULARY) -> None:
    """Encodes the contents that the cache lacks and appends them."""
    spark, tokens = docs.sparkSession, version_of(vocabulary)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for x in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), pa.array(counts_of(x, vocabulary))], names=["digest", "n_tokens"])
                at += len(x)

    body = normal_form(text_or_empty(text))
    contents = docs.select(body.alias("body")).select(F.unhex(F.sha2("body", 256)).alias("digest"), "body").groupBy("digest").agg(F.first("body").alias("body"))
    contents.join(stored(spark, cache, tokens), "digest", "left_anti").mapInArrow(run, STORED).write.mode("append").parquet(f"{cache}/version={tokens}")


def counts(docs: DataFrame, cache: str | None = None, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per input row: key, n_bytes, n_tokens, over_limit. With no cache given, one of this call's own in the shared folder."""
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    fill(docs, cache, text, vocabulary)
    body = text_or_empty(text)
    rows = stage(docs.select(F.col(key).alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(normal_form(body), 256)).alias("digest")), "token-count-rows")
    found = stage(rows.select("digest").distinct().join(stored(spark, cache, version_of(vocabulary)), "digest"), "token-counts-found")  # distinct and written, so that a hot digest's rows can be split
    return rows.join(found, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

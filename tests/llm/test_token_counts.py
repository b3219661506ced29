import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarnfold.llm import token_counts
from tests.llm.helpers import awkward, empty


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(token_counts.VOCABULARY)
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


PIECES = ["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>x", "<|", "|>", " ", "\n\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "W̊", "H̱", "̊", "̈", "İ", "ΣΑΣ", "ß", "don't", "I'LL", "'", "'s", "1234", "漢字", "😀", "é", "É", "Hello", "world", "ABC", "...", "‍", "Å", "K"]


def mixtures(n):
    rng = random.Random(3)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_sums_over_words_are_the_library_counts(library):
    texts = ["", " ", *mixtures(3000), "a" * 5000, "<|endoftext|>" * 40]
    assert token_counts.counts_of(pa.array(texts)).tolist() == [library(t) for t in texts]
    assert token_counts.counts_of(pa.array([], pa.string())).tolist() == []


def test_texts_of_one_normal_form_have_one_count(spark, library):
    texts = mixtures(3000)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", token_counts.normal_form(df.text).alias("form")).collect():
        assert library(r.form) == library(r.text), r.text


def test_every_row_against_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(docs).collect()}
    want = {r.doc_id: (len((r.text or "").encode()), library(r.text)) for r in docs.collect()}
    assert got == {k: (b, n, n > 2048) for k, (b, n) in want.items()}


def test_awkward(spark, library):
    docs = awkward(spark)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(docs).collect()))
    assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), library(r.text), library(r.text) > 2048) for r in docs.collect())
    assert token_counts.counts(empty(spark)).count() == 0


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path, library):
    cache, version = f"file://{tmp_path}/cache", token_counts.version_of()
    raw = lambda: spark.read.schema(token_counts.STORED).parquet(f"{cache}/version={version}").count()
    first = spark.createDataFrame([(1, "One text"), (2, "one \n TEXT "), (3, "another"), (4, None)], "doc_id long, text string")
    token_counts.counts(first, cache).collect()
    assert raw() == 3
    more = first.unionByName(spark.createDataFrame([(5, "a new one"), (6, "A NEW one")], "doc_id long, text string"))
    rows = token_counts.counts(more, cache).collect()
    assert raw() == 4 and {r.doc_id: r.n_tokens for r in rows} == {1: 2, 2: 2, 3: 1, 4: 0, 5: 3, 6: 3}
    token_counts.counts(more, cache).collect()
    assert raw() == 4


def test_stored_counts_are_what_is_read_and_doubles_fold(spark, tmp_path):
    cache, version = f"file://{tmp_path}/cache", token_counts.version_of()
    docs = spark.createDataFrame([(1, "seen"), (2, "unseen")], "doc_id long, text string")
    token_counts.fill(docs.where("doc_id = 1"), cache)
    kept = spark.read.schema(token_counts.STORED).parquet(f"{cache}/version={version}").selectExpr("digest", "n_tokens + 900 AS n_tokens").collect()
    for _ in range(2):  # as if two jobs had appended it, with a count that only the store can have
        spark.createDataFrame(kept, token_counts.STORED).write.mode("append").parquet(f"{cache}/version={version}")
    assert {r.doc_id: r.n_tokens for r in token_counts.counts(docs, cache).collect()} == {1: 901, 2: 1}


def test_another_version_does_not_meet_these_counts(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "seen")], "doc_id long, text string")
    token_counts.fill(docs, cache)
    monkeypatch.setattr(token_counts, "RULE", "2")
    assert token_counts.stored(spark, cache, token_counts.version_of()).count() == 0
    assert token_counts.counts(docs, cache).first().n_tokens == 1

"""run() against the same decisions in plain Python."""

import re
import zlib

import corpus_pipeline
import numpy as np
from tarnfold.llm import packing, pii, toxicity
from tests.llm.helpers import awkward
from tests.llm.test_block_naming import lowered
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import brute as base_spans


def by_hand(docs, labels):
    """doc_id to the ids of its masked text, for the documents that stay."""
    machine = toxicity.learn(docs, labels)
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if machine.score(r.text) < 0.5]
    last = {}
    for i, t in rows:
        last[lowered(t)] = max(i, last.get(lowered(t), i))
    rows = [(i, t) for i, t in rows if last[lowered(t)] == i]
    groups = brute(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    encode = packing.tokenizer(packing.RANKS).encode_ordinary
    out = {}
    for i, t in rows:
        spans = pii.find(t)
        assert [s for s in spans if s[1] < 4] == base_spans(t)
        masked = pii.masked(t, spans)
        assert not re.search(r"@mail\d", masked)
        out[i] = np.array([*encode(masked), packing.END], "<u4")
    return out


def test_run_against_plain_python(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = by_hand(docs, labels)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        own = want[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact duplicates", "near duplicates", "personal data", "packing"]


def test_stages_on_awkward_rows(spark, sf):
    docs = awkward(spark)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf).count() > 0
        assert step(spark, docs.limit(0), sf).count() == 0

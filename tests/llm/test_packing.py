import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnfold.llm import packing
from tests.llm.helpers import awkward, empty


def test_hilbert_is_a_curve():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = packing.hilbert(cells, 3)
    assert sorted(order) == list(range(side**3))
    walk = cells[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pieces_against_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = {r.doc_id: np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    rows = packing.pack(docs).collect()
    fill, own = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and r.doc_tokens == len(want[r.doc_id])
        fill[r.sequence_id] = r.offset + r.length
        own.setdefault(r.doc_id, []).append((r.start, r.length))
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(own) == set(want)
    for i, parts in own.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(want[i])
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == packing.LENGTH for s in range(len(fill) - 1))


def test_neighbours_on_the_curve_are_alike():
    rng = np.random.default_rng(0)
    topics = [rng.integers(0, 50000, 400) for _ in range(4)]
    docs = [rng.choice(topics[k % 4], 300).astype(np.uint16) for k in range(80)]
    order = np.argsort(packing.keys(docs)) % 4
    assert (order[1:] == order[:-1]).mean() > 1.5 * 0.25  # by chance a quarter


def test_awkward(spark):
    docs = awkward(spark)
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id in (3, 4)) == 3
    long = [r for r in rows if r.doc_id == 7]
    assert sum(r.length for r in long) == long[0].doc_tokens
    assert packing.pack(empty(spark)).count() == 0


def test_added_tokens_inside_texts(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        assert {t["content"]: t["id"] for t in json.load(f)["added_tokens"]} == packing.ADDED
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "end<|endoftext|>\n\n", "<|endoftext |> <|endoftex", "  <|endoftext|>  it's"]
    got = {r.doc_id: r.ids for r in packing.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i], np.uint16).tolist() == [*tok.encode(t, add_special_tokens=False).ids, packing.END]

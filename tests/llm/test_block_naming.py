import hashlib
from collections import defaultdict

import pytest

from tarnfold.llm import block_naming
from tests.llm.helpers import awkward, empty, intact


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize(("block", "bits"), [(8192, 64), (4, 64), (8, 14)])
def test_against_brute_force(spark, block, bits):
    texts = ["", "a", "A", "abcd", "abcde", "ABCDabcd", "abcdabcd", "abcdabcda", "abcdabcdabcd", "É" * 9, "é" * 9, "É" * 9, None, "x" * 40, "X" * 40, "x" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[lowered(t)].append(i)
    got = {r.doc_id: r for r in block_naming.groups(docs, block=block, bits=bits).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        own = by[lowered(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256(lowered(t).encode()).hexdigest()


def test_awkward(spark):
    docs = awkward(spark)
    rows = block_naming.groups(docs).collect()
    assert len(rows) == 10
    nothing = [r for r in rows if r.doc_id in (3, 4)]
    assert all(r.keep_id == 4 and r.group_size == 3 for r in nothing) and sum(r.kept for r in nothing) == 1
    assert {r.doc_id for r in rows if r.kept} == {2, 4, None, 5, 6, 7, 8}
    kept = block_naming.deduplicate(docs)
    assert intact(kept, docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8]
    assert block_naming.groups(empty(spark)).count() == 0 and block_naming.deduplicate(empty(spark)).count() == 0


def test_names_are_places_in_one_order_and_do_not_follow_partitions(spark):
    texts = [("ab" * (k % 7) + chr(97 + k % 5)) * (1 + k % 3) for k in range(60)] + ["", "x" * 33]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    for parts in (1, 5):
        rows = block_naming.identities(docs.repartition(parts), block=4).collect()
        seen.append({r.doc_id: (r.level, r.name) for r in rows})
    assert seen[0] == seen[1] and max(level for level, _ in seen[0].values()) >= 3
    lone = {t[:4] for t in texts if len(t) <= 4}
    every = {t[k : k + 4] for t in texts for k in range(0, max(1, len(t)), 4)}
    assert {n for i, (level, n) in seen[0].items() if level == 0} <= set(range(len(every))) and len({n for level, n in seen[0].values() if level == 0}) == len(lone)


def test_most_texts_take_several_levels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    levels = [r.level for r in block_naming.identities(docs).collect()]
    assert len(levels) == docs.count() and sum(x > 0 for x in levels) > len(levels) / 2

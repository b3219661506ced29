import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tarnfold.llm import ngram_join as nj
from tests.llm.helpers import awkward, empty, intact

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return {i: (len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(rows)}


def corpus(seed, n, passages=True):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 12, 40, 60, 61, 64]))] for _ in range(max(2, n // 8))]
    out = []
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if passages and rng.random() < 0.4:
            own += passage
        out.append((i * 3, " ".join(x.upper() if rng.random() < 0.1 else x for x in own)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "common", "tile"), [(1, 48, 2048), (2, 5, 7), (3, 3, 4)])
def test_components_against_all_pairs(spark, monkeypatch, seed, common, tile):
    monkeypatch.setattr(nj, "COMMON", common)
    monkeypatch.setattr(nj, "TILE", tile)
    rows = corpus(seed, 260)
    want = brute(rows)
    got = nj.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.doc_id for r in got if r.kept} == {c for _, c in want.values()}


def test_the_table_itself(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = nj.groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_tree_loses_no_pair_and_prunes():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(5, 300)).astype(np.uint64)) for _ in range(150)]
    for k in range(150):
        own = sets[k].copy()
        own[: len(own) // 12] = rng.integers(0, 2**63, len(own) // 12).astype(np.uint64)
        sets.append(np.unique(own))
    groups = min(len(nj.vector(x)) for x in sets)
    points, sizes = np.stack([nj.folded(nj.vector(x), groups) for x in sets]), np.array([len(x) for x in sets])
    tree, looked = nj.RTree(points, sizes), 0
    for k, x in enumerate(sets):
        hit = set(tree.search(points[k], int(sizes[k])).tolist())
        assert {j for j, y in enumerate(sets) if nj.linked(x, y)} <= hit
        looked += len(hit)
    assert looked < 0.1 * len(sets) ** 2


def test_awkward(spark):
    docs = awkward(spark)
    rows = nj.groups(docs).collect()
    assert len(rows) == 10
    by = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert by[(1, 5)] == by[(2, 5)] == 1 and by[(3, 0)] == 3 and by[(4, 0)] == 4 and by[(7, 1)] == 7
    kept = nj.one_of_each(docs)
    assert intact(kept, docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 4, 5, 6, 7, 8]
    assert nj.groups(empty(spark)).count() == 0 and nj.one_of_each(empty(spark)).count() == 0


def test_groups_are_nested():
    x, y = (np.unique(np.random.default_rng(k).integers(0, 2**63, n).astype(np.uint64)) for k, n in ((1, 9000), (2, 40)))
    fine, coarse = nj.vector(x), nj.vector(y)
    assert [nj.groups_for(n) for n in (0, 32, 33, 512, 9000)] == [16, 16, 32, 256, 8192] and len(fine) == 8192 and len(coarse) == 32
    assert (nj.folded(fine, 32) == np.bincount((x & np.uint64(31)).astype(int), minlength=32)).all()
    assert nj.bound(fine, coarse) >= len(np.intersect1d(x, y)) and nj.bound(fine, fine) == 9000
    for most in (1, 15, 16, 255, 256, 70_000):
        v = np.array([most, 0, 3, most - 1] * 4)
        assert (nj.unpacked(nj.packed(v)) == v).all()
    assert (nj.unpacked(nj.packed(fine)) == fine).all()


def test_words_that_polynomials_confuse_stay_apart(spark):
    """A Thue-Morse word and its complement have the same polynomial hash modulo any power of two, for every base."""
    morse = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    rows = [(k, f"one two three four {w}") for k, w in enumerate((morse, morse.translate(str.maketrans("ab", "ba"))))]
    assert len(np.unique(np.concatenate([nj.words_of(t)[-1:] for _, t in rows]))) == 2
    assert {r.component_id for r in nj.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1}


def family(n, edits, seed=3):
    """Near copies of one text, each with edits of its own, so that a part of all pairs links."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice(edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def test_tiles_pass_on_fewer_rows_than_they_have():
    made = []
    for n in (150, 600):
        rows = family(n, (1, 2, 3, 4))
        tile = {"token": [1] * n, "i": [0] * n, "j": [0] * n, "role": [3] * n, "rid": list(range(n)), "label": list(range(n)), "n": [len(nj.shingles(t)) for _, t in rows]}
        texts = pa.RecordBatch.from_pydict(tile | {"text": [t for _, t in rows]})
        points = pa.RecordBatch.from_pydict(tile | {"points": [nj.packed(nj.vector(nj.shingles(t))) for _, t in rows]})
        links = [x for b in nj._joining(iter([texts.slice(0, 100), texts.slice(100)])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        flags = [x for b in nj._flagged(iter([points])) for x in b["rid"].to_pylist()]
        want = len({c for _, c in brute(rows).values()})
        assert len(set(links)) == len(links) == n - want < n and len(set(flags)) == len(flags) <= n
        made.append(len(links))
    assert made[1] <= 4.5 * made[0]


@pytest.mark.parametrize(("tile", "weight"), [(2048, 1 << 21), (32, 1 << 21), (2048, 3000)])
def test_a_large_group_of_near_copies(spark, monkeypatch, tile, weight):
    monkeypatch.setattr(nj, "TILE", tile)
    monkeypatch.setattr(nj, "WEIGHT", weight)
    rows = family(220, (1, 2, 3, 4, 6, 8)) + [(10**6 + i, t) for i, t in family(40, (0, 12, 14), 4)]
    got = nj.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_links_join_each_component(spark):
    rows = corpus(5, 120)
    up = {i: i for i, _ in rows}

    def top(x):
        return x if up[x] == x else top(up[x])

    for r in nj.links(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        up[max(top(r.a), top(r.b))] = min(top(r.a), top(r.b))
    texts = {}
    for i, t in rows:  # equal sets speak through one row
        texts.setdefault(nj.shingles(t).tobytes(), []).append(i)
    for same in texts.values():
        for x in same:
            up[max(top(x), top(same[0]))] = min(top(x), top(same[0]))
    assert {i: top(i) for i, _ in rows} == {i: c for i, (_, c) in brute(rows).items()}


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 16)
    rng = random.Random(9)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k in range(24):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([500, 700, 2300]))] + shared
        rows.append((2 * k, " ".join(own)))
        for _ in range(len(own) // 60):
            own[rng.randrange(len(own))] = "edit"
        rows.append((2 * k + 1, " ".join(own)))
    got = nj.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tarnfold.llm import periodic_runs
from tests.llm.helpers import awkward, empty


def brute(w, least=12):
    """Every stretch of every period, without the ones that a smaller period has."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(least, 2 * p) and not any(w[s : e - q] == w[s + q : e] for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed):
    rng = random.Random(seed)
    for _ in range(rng.randrange(1, 7)):
        n, k = rng.randrange(0, 90), rng.randrange(1, 4)
        w = [rng.randrange(k) for _ in range(n)]
        p = rng.randrange(1, 12)
        yield [w[i % p] for i in range(n)] if rng.random() < 0.4 else w


@pytest.mark.parametrize("moduli", [periodic_runs.MODULI, (7, 5), (3,)])
def test_runs_against_brute_force_with_and_without_collisions(moduli):
    for seed in range(60):
        docs = list(texts(seed))
        got = periodic_runs.runs(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]), moduli=moduli)
        assert [tuple(x) for x in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in brute(d)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def check(df, docs):
    rows = df.collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted(((d.doc_id, *expected(d.doc_id, d.text)) for d in docs), key=key)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    check(periodic_runs.digests(docs), docs.collect())
    assert docs.count() > 150


def test_awkward(spark):
    docs = awkward(spark, [(10, "a b " * 9 + "c", "en"), (11, "x\x1cy é é " * 7, "en"), (15, "one two three four five six seven eight nine ten " * 4, "en")]).where("doc_id is null or doc_id <> 7")
    check(periodic_runs.digests(docs), docs.collect())
    assert periodic_runs.digests(empty(spark)).count() == 0 and periodic_runs.collapse(empty(spark)).count() == 0


def test_collapse_leaves_one_period(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in periodic_runs.collapse(docs).collect() if r.doc_id}
    assert got[7].collapsed == "word" and (got[7].n_runs, got[7].length, got[7].period) == (1, 30000, 1)
    assert got[1].collapsed == "The Quick brown fox jumps over the lazy dog" and got[3].collapsed == got[4].collapsed == "" and got[1].start is None


def test_long_texts_in_time():
    fib, last = [0], [0, 1]
    for _ in range(20):
        fib, last = last, last + fib
    for words in ([0] * 100_000, fib, np.random.default_rng(0).integers(0, 50, 100_000)):
        began = time.time()
        periodic_runs.runs(np.asarray(words, np.int64), np.array([len(words)]))
        assert time.time() - began < 10

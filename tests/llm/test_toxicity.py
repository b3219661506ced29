import random
import zlib

import numpy as np

from tarnfold.llm import toxicity
from tests.llm.helpers import awkward, empty, intact

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ra", "su", "ti") for b in ("dor", "nel", "mis", "tan", "vor", "lek")]


def corpus(n, rng):
    """Toxic where an insult meets a group; either alone is clean."""
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(10, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["grumblesome"] * insult + ["islander"] * group
        rng.shuffle(words)
        out.append((i, " ".join(words), int(insult and group)))
    return out


def test_pairwise_interaction_is_learned():
    rng = random.Random(3)
    rows = corpus(3000, rng)
    m = toxicity.fit([(toxicity.terms(t), y) for _, t, y in rows[:2400]])
    hits = [(m.score(t) >= 0.5) == bool(y) for _, t, y in rows[2400:]]
    assert np.mean(hits) > 0.97


def test_machine_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    text = "one two three four five"
    known = np.sort(toxicity.terms(text))
    m = toxicity.Machine(0.1, known, rng.normal(size=len(known)), rng.normal(size=(len(known), 3)))
    z = 0.1 + m.linear.sum() + sum(m.factors[i] @ m.factors[j] for i in range(len(known)) for j in range(i))
    assert abs(m.score(text) - 1 / (1 + np.exp(-z))) < 1e-12


def test_query_contract_and_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.scores(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    ours = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in ours]) > 0.95 and not any(a and not b for a, b in ours)


def test_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    docs = awkward(spark)
    assert toxicity.scores(docs, labels).count() == 10
    kept = toxicity.reject(docs, labels.limit(0))
    assert intact(kept, docs) and kept.count() == 10
    assert toxicity.scores(empty(spark), labels).count() == 0


def test_the_sample_is_bounded_and_repeatable(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda rows, seed=7: seen.append(rows) or fit(rows, seed)
    try:
        first, second = (toxicity.learn(docs, labels, rows=120) for _ in range(2))
    finally:
        toxicity.fit = fit
    assert [len(x) for x in seen] == [120, 120] and first.bias == second.bias and (first.known == second.known).all()


def test_ids_that_repeat_come_to_the_driver_once(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    rows = [(k, f"text {'bad' if k % 2 else 'good'} {k}") for k in range(40)] + [(7, f"text again {k:03}") for k in range(300)]
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda rows, seed=7: seen.append(rows) or fit(rows, seed)
    try:
        toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, rows=30)
    finally:
        toxicity.fit = fit
    learned = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    assert 20 < len(seen[0]) <= min(30, len(learned))
    assert sum(t.tobytes() == np.sort(toxicity.terms("text again 000")).tobytes() for t, _ in seen[0]) <= 1


def test_terms_that_tell_only_beside_another_are_weighed():
    rng = random.Random(8)
    rows = []
    for _ in range(4000):
        insult, group = rng.random() < 0.2, rng.random() < 0.02
        toxic = insult and (group or rng.random() < 0.4) or (not insult and not group and rng.random() < 0.0)
        rows.append((toxicity.terms(" ".join(rng.choice(WORDS) for _ in range(20)) + " grumblesome" * insult + " islander" * group), int(toxic)))
    known = toxicity._telling([t for t, _ in rows], np.array([y for _, y in rows], float))
    assert set(toxicity.hashes("grumblesome")) & set(known.tolist()) and set(toxicity.hashes("islander")) & set(known.tolist())


def test_only_terms_that_tell_come_to_the_driver(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"own{rng.randrange(10**9)}" for _ in range(200)) + " grumblesome" * (k % 3 == 0)) for k in range(400)]
    rows += [(400 + k, rows[k % 4][1]) for k in range(100)] + [(500, ""), (501, None)]
    truth = [(i, int("grumblesome" in (t or ""))) for i, t in rows]
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda rows, seed=7: seen.append(rows) or fit(rows, seed)
    try:
        got = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(truth, "doc_id long, toxic int"))
    finally:
        toxicity.fit = fit
    learned = [(toxicity.terms(t), y) for (i, t), (_, y) in zip(rows, truth, strict=True) if zlib.crc32(str(i).encode()) % 5]
    want = fit(learned)
    assert len(seen[0]) == len(learned)
    assert sum(len(t) for t, _ in seen[0]) < 0.05 * sum(len(t) for t, _ in learned)
    assert set(toxicity.hashes("grumblesome")) <= set(got.known.tolist())
    assert got.bias == want.bias and (got.known == want.known).all() and (got.linear == want.linear).all() and (got.factors == want.factors).all()


def test_fit_without_terms_or_without_telling_ones(spark):
    nothing = np.zeros(0, np.uint32)
    assert toxicity.fit([]).score("a") < 1e-9 and abs(toxicity.fit([(nothing, 1), (nothing, 0)]).score("a") - 0.5) < 1e-6
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    for text in ("", "the same words"):
        docs = spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string")
        rows = [(toxicity.terms(text), k % 2) for k in range(40) if zlib.crc32(str(k).encode()) % 5]
        got, want = toxicity.learn(docs, labels), toxicity.fit(rows)
        assert got.bias == want.bias and not len(got.known) and not len(want.known)
    assert len(toxicity.learn(docs.limit(0), labels).known) == 0

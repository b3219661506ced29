import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tarnfold.llm import langid
from tests.llm.helpers import awkward, empty


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = langid.predictions(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1]))
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in rows if r.held_out]) > 0.98


def brute(rows):
    """Predictions of plain Python over rows (doc_id, text, lang), every labelled row learned from."""
    run = lambda t: [w for w in re.findall(r"[^\W\d_]+", t.lower()) if any(c.isalpha() for c in w)]
    split = lambda w: [(i, n) for i in range(len(w) + 1) for n in range(1, 6)]
    learned = {r for r in rows if None not in r and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    docs, words, grams = Counter(), {}, {}
    for r in rows:
        if None not in r and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            docs[r[2]] += 1
    for _, t, g in learned:
        for w in run(t):
            words.setdefault(w, Counter())[g] += 1
            e = "\x02" + w + "\x03" * 4
            for i, n in split(w):
                grams.setdefault(e[i : i + n], Counter())[g] += 1
    langs = sorted(docs, key=lambda g: (-docs[g], g))

    def scale(table):
        return {g: math.log(sum(c[g] for c in table.values()) + 0.05 * max(1, len(table))) for g in langs}

    by_word, by_gram = scale(words), scale(grams)
    out = []
    for i, t, _ in rows:
        total = {g: math.log(docs[g] / docs.total()) for g in langs}
        own = run(t or "")
        for w in own:
            if w in words:
                for g in langs:
                    total[g] += math.log(words[w][g] + 0.05) - by_word[g]
                continue
            e = "\x02" + w + "\x03" * 4
            known = [x for x in ([e[k : k + n] for n in range(5, 0, -1) if e[k : k + n] in grams][:1] for k in range(len(w) + 1)) if x]
            for g in langs:
                total[g] += sum(math.log(grams[x][g] + 0.05) - by_gram[g] for (x,) in known) / max(1, len(known))
        if not own or not langs:
            out.append((i, "und", 0.0))
            continue
        best = max(langs, key=lambda g: total[g])
        out.append((i, best, 1 / sum(math.exp(total[g] - total[best]) for g in langs)))
    return out


def test_against_brute_force(spark, sf):
    more = [(10**6 + k, "½ zwölf", "de") for k in range(4)] + [(10**6 + 9, "½", None), (10**6 + 10, "²", None), (10**6 + 11, "", "xx"), (10**6 + 12, "漢字", None), (10**6 + 13, "², ½", "fr"), (10**6 + 14, "², ½", "fr"), (None, "zwölf", "de"), (10**6 + 15, None, "de")]
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + more
    rows += rows[:3]
    want = brute(rows)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    order = lambda x: (x[0] is None, x[0] or 0)
    want, got = sorted(want, key=order), sorted(got, key=order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-3)
    assert {x[1] for x in got if x[0] in (10**6 + 9, 10**6 + 10, 10**6 + 13)} == {"und"}


def test_a_language_whose_rows_repeat_gets_its_share(spark, monkeypatch):
    rows = [(k, f"ein text mit wort{k}", "de") for k in range(400)] + [(1000 + k % 400, f"a text with word{k % 400}", "en") for k in range(40_000)]
    seen = []
    sample = langid._sample
    monkeypatch.setattr(langid, "_sample", lambda *a: seen.append(sample(*a)) or seen[-1])
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    assert Counter(r.lang for r in seen[0].collect()) == {"de": 100, "en": 100}


def test_a_bounded_sample_gives_each_language_its_share(spark):
    rows = [(k, f"common words number {'abcdefghij'[k % 10]} again", "en") for k in range(3000)] + [(10**5 + k, f"rara lengua {'xyz'[k % 3]}", "ast") for k in range(9)] + [(10**6, "same text", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {"en": 5000, "ast": 9}
    got = Counter(r.lang for r in langid._sample(docs, counts, 100).collect())
    assert got == {"en": 50, "ast": 9}
    m = langid.learn(docs, 100)
    assert m.languages == ["en", "ast"] and np.allclose(np.exp(m.prior), [5000 / 5009, 9 / 5009])
    assert m.predict("rara lengua")[0] == "ast" and m.predict("number again")[0] == "en"
    assert Counter(r.lang_pred for r in langid.predictions(docs, 100).collect()) == counts


def test_counts_cover_every_document(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("uno dos dos", "es"), ("one two two", "en"), ("one", "en"), ("skipped", None), (None, "es")])]
    m = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == ["en", "es"] and set(m.words) == {"dos", "one", "two", "uno"}
    es, en = m.languages.index("es"), m.languages.index("en")
    row = m.rows[m.words["dos"]]
    assert np.isclose(row[es], np.log(2.05) - np.log(3 + 0.05 * 4)) and np.isclose(row[en], np.log(0.05) - np.log(4 + 0.05 * 4))
    want = {e[i : i + n] for w in ("one", "two") for e in (langid.edged(w),) for i in range(len(w) + 1) for n in range(1, 6)}
    assert want <= set(m.grams)
    lone = m.rows[m.grams["o"]]
    assert np.isclose(np.exp(lone[en] - lone[es]), ((4.05 / (m_total(m, rows, "en"))) / (3.05 / m_total(m, rows, "es"))), rtol=1e-4)


def m_total(m, rows, lang):
    """All counted n-grams of a language that were kept, smoothed."""
    own = Counter(e[i : i + n] for _, t, g in rows if g == lang and t for w in langid.words_of(t) for e in (langid.edged(w),) for i in range(len(w) + 1) for n in range(1, 6))
    return sum(n for g, n in own.items() if g in m.grams) + 0.05 * len(m.grams)


def test_backoff_takes_the_longest_known_gram():
    rows = np.arange(10, dtype=np.float32).reshape(5, 2)
    m = langid.Model(["a", "b"], np.zeros(2), {}, {"o": 1, "\x02o": 2, "no": 3}, rows)
    assert np.allclose(m.spelled("on"), (rows[2] + rows[1]) / 2)
    assert np.allclose(m.spelled("no"), (rows[3] + rows[1]) / 2)


def test_awkward(spark):
    got = langid.predictions(awkward(spark)).collect()
    assert len(got) == 10
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.predictions(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.predictions(awkward(spark).where("lang is null or doc_id is null")).collect()} == {"und"}


def test_long_runs_teach_their_grams():
    run = "".join(chr(0x4E00 + k) for k in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array([run]), pa.array(["zh"])], names=["text", "lang"])
    got = {t for b in langid._counted(iter([batch])) for kind, t in zip(b["kind"].to_pylist(), b["term"].to_pylist(), strict=True) if kind == "g"}
    e = langid.edged(run)
    assert got == {e[i : i + n] for i in range(len(run) + 1) for n in range(1, 6)}

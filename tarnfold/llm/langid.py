"""Language identification, word first.

Known words score by their log frequency in each language. A word that was not met is spelled out:
from each of its letters the longest known character n-gram scores, five letters at first, then
four, three, two and one.

The classifier is fitted on a bounded sample of labelled rows: ``ROWS`` at most, an equal share for each
language, those with the smallest hashes of id and text (all rows of a language that has no more). So a
language of a few rows among billions is learned as well as the largest one. Every word and n-gram of
those whole texts is known, with no cut by rank or count, and executors hold them all: the model
grows with the sample, not with the corpus. How common a language is comes from all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to
learn from every text is ``und``; documents without a language or an id are not learned from; ties
go to the language with more documents, then to the first by name; rows that repeat id, language and text
are learned from once and predicted each; an empty table gives no rows; clashing columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import ship, stage, width

ROWS = 8_000  # labelled rows that a model is fitted on, at most
LONGEST = 5
SMOOTH = 0.05
MEMO = 300_000  # unseen words whose scores a worker keeps
FLUSH = 500_000  # distinct words a task holds before it passes counts on

_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; a run may hold other numerals (a superscript two), and nothing else."""
    return _RUNS.findall(text.lower())


def lettered(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def edged(word: str) -> str:
    """A word with its edges marked, so that an n-gram of full length begins at each letter."""
    return f"\x02{word}" + "\x03" * (LONGEST - 1)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by language: kind w (words with a letter) and g (n-grams of every length)."""
    words: dict[str, Counter] = defaultdict(Counter)

    def spelled(own: Counter) -> Counter:
        full: Counter = Counter()
        for w, n in own.items():
            e = edged(w)
            for i in range(len(w) + 1):
                full[e[i : i + LONGEST]] += n
        out: Counter = Counter()
        for g, n in full.items():
            for size in range(1, LONGEST + 1):
                out[g[:size]] += n
        return out

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, c in words.items():
            own = Counter({w: n for w, n in c.items() if lettered(w)})
            for kind, held in (("w", own), ("g", spelled(own))):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(held), pa.string()), pa.array(held.keys(), pa.string()), pa.array([lang] * len(held), pa.string()), pa.array(held.values(), pa.int64())], names=["kind", "term", "lang", "n"])
        words.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words[lang].update(words_of(text))
            if sum(map(len, words.values())) > FLUSH:
                yield from rows()
    yield from rows()


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    rows: np.ndarray  # log frequencies: row 0 is zero, then words, then n-grams
    _memo: dict[str, int] = field(default_factory=dict)
    _used: int = 0

    def spelled(self, word: str) -> np.ndarray:
        """The mean over the letters of an unseen word of the longest known n-gram from each."""
        e, got, known = edged(word), [], self.grams.get
        for i in range(len(word) + 1):
            for n in range(LONGEST, 0, -1):
                at = known(e[i : i + n])
                if at is not None:
                    got.append(at)
                    break
        return self.rows[got].sum(axis=0) / len(got) if got else np.zeros(len(self.languages), np.float32)

    def _place(self, word: str) -> int | np.ndarray:
        """The row of a word not met before, or where no more rows are kept, its scores; row 0 is for what has no letter."""
        if not self._used:
            self._memo.update(self.words)
            self._used = len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros((MEMO, self.rows.shape[1]), np.float32)])
        at = self._memo.get(word)
        if at is not None:
            return at
        if not lettered(word):
            return 0
        row = self.spelled(word)
        if self._used == len(self.rows) or len(word) >= 40:
            return row
        self.rows[self._used] = row
        self._memo[word] = self._used
        self._used += 1
        return self._used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages:
            return "und", 0.0
        words = words_of(text or "")
        at = list(map(self._memo.get, words))
        more = []
        for i, w in enumerate(words):
            if at[i] is None:
                got = self._place(w)
                if isinstance(got, int):
                    at[i] = got
                else:
                    at[i] = 0
                    more.append(got)
        if not any(at) and not more:
            return "und", 0.0
        z = self.rows[at].sum(axis=0, dtype=np.float64) + sum(more) + self.prior
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def _place(space: int = 1 << 40) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(space))


def _sample(given: DataFrame, counts: dict[str, int], rows: int) -> DataFrame:
    """text, lang: of each language its share of ``rows``, by the smallest hashes of id and text; equal rows once.

    A cut at 1.3 times the share first, so that few more rows than that are sorted for a language; ``counts`` tells how many unlike rows a language has, about.
    """
    share = max(1, rows // max(1, len(counts)))
    space = 1 << 40
    place = _place(space)
    cuts = given.sparkSession.createDataFrame([(g, int(space * min(1.0, (1.3 * share + 50) / n))) for g, n in counts.items()], "lang string, cut long")
    few = given.withColumn("place", place).join(F.broadcast(cuts), "lang").where("place < cut").dropDuplicates(["lang", "doc_id", "text"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))
    return few.withColumn("first", first).where(F.col("first") <= share).select("text", "lang")


def learn(docs: DataFrame, rows: int = ROWS) -> Model:
    """A model of docs (doc_id, text, lang): all rows for how common a language is, a sample of them for its words."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    facts = given.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(_place(), 0.03).alias("unlike")).collect()  # a row a language
    counts = {r.lang: r.n for r in facts}
    languages = sorted(counts, key=lambda g: (-counts[g], g))
    if not languages:
        return Model([], np.zeros(0), {}, {}, np.zeros((1, 0), np.float32))
    sample = stage(_sample(given, {r.lang: max(1, r.unlike) for r in facts}, rows), "language-sample")
    parts = sample.repartition(width(spark)).mapInArrow(_counted, "kind string, term string, lang string, n long")
    got = parts.groupBy("kind", "term", "lang").agg(F.sum("n").alias("n")).orderBy("kind", "term", "lang").toArrow()
    place = {g: i for i, g in enumerate(languages)}
    prior = np.log(np.array([counts[g] for g in languages], float) / sum(counts.values()))
    kinds, terms, n = got["kind"].to_numpy(), got["term"].to_numpy(), got["n"].to_numpy()
    of = np.array([place[g] for g in got["lang"].to_pylist()], np.int64)
    tables, found, at = [np.zeros((1, len(languages)), np.float32)], {}, 1
    for kind in "wg":
        own = kinds == kind
        names, where = np.unique(terms[own], return_inverse=True) if own.any() else (np.zeros(0, object), np.zeros(0, int))
        table = np.zeros((len(names), len(languages)))
        table[where, of[own]] = n[own]
        scale = np.log(table.sum(axis=0) + SMOOTH * max(1, len(names)))
        tables.append((np.log(table + SMOOTH) - scale).astype(np.float32))
        found[kind] = {t: at + i for i, t in enumerate(names.tolist())}
        at += len(names)
    return Model(languages, prior, found["w"], found["g"], np.concatenate(tables))


def predictions(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held_out()), rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, out)

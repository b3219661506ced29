"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: words without punctuation, and their first four and five
letters. The machine adds to the linear weights an inner product for every pair of terms, learned
through a few factors per term, so that an insult beside a group mention can weigh more than both
alone. It is fitted on a bounded sample of labelled rows (``ROWS`` at most, those with the smallest
hashes of their ids), over all terms there whose share of toxic rows, with ``PRIOR`` rows at the base rate added, differs by ``CLEAR`` standard errors from the base
rate, or from the rate among rows that hold a term of more toxic rows than that: the second test
finds what tells nothing alone and much beside an insult. Terms are told apart by 32 bits, so a chance
collision with a weighty term is a matter of one text in millions. Every text is scored whole.

Defined results: a null or empty text has no terms and gets the score of the bias; rows without an
id are never learned from and count as not held out; of rows that repeat an id the least text is
learned from; repeated rows score alike; a label above 0
counts as toxic, contradicting labels are learned as they come; with no usable label every score
is 0; an empty table gives no rows; clashing columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.common import give_back, ship, values

ROWS = 12_000  # labelled rows that a machine is fitted on, at most
FACTORS = 4
EPOCHS = 12
CLEAR = 4.0  # standard errors between a term's toxic share and the rate it is held against
PRIOR = 2.0  # rows at the base rate that every term is taken to have been seen in besides

_EDGE = re.compile(r"[\W_]+")


def hashes(word: str) -> tuple[int, ...]:
    """The hashed terms of a word in lower case."""
    bare = _EDGE.sub("", word)
    if not bare:
        return ()
    return tuple({zlib.crc32(b"w" + bare.encode()), *(zlib.crc32(b"p" + bare[:n].encode()) for n in (4, 5) if len(bare) >= n)})


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text."""
    found = {h for w in set((text or "").lower().split()) for h in hashes(w)}
    return np.fromiter(found, np.uint32, len(found))


@dataclass
class Machine:
    bias: float
    known: np.ndarray  # hashed terms, sorted
    linear: np.ndarray
    factors: np.ndarray
    _memo: dict[str, tuple[int, ...]] = field(default_factory=dict)
    _place: dict[int, int] = field(default_factory=dict)

    def places(self, text: str | None) -> list[int]:
        """The places of a text's terms among the known ones."""
        if not self._place:
            self._place.update((int(h), i) for i, h in enumerate(self.known))
        out: set[int] = set()
        memo = self._memo
        for w in set((text or "").lower().split()):
            got = memo.get(w)
            if got is None:
                got = tuple(self._place[h] for h in hashes(w) if h in self._place)
                if len(memo) < 50_000 and len(w) < 32:
                    memo[w] = got
            if got:
                out.update(got)
        return sorted(out)

    def score(self, text: str | None) -> float:
        z = self.bias
        if at := self.places(text):
            v = self.factors[at]
            total = v.sum(axis=0)
            z += float(self.linear[at].sum()) + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms whose toxic share is clearly off the base rate, among all rows or among those with a term of raised share; sorted.

    Rows are gone through one after the other, so that little is held beside them.
    """
    known = np.zeros(0, np.uint32)
    for k in range(0, len(rows), 2048):
        known = np.union1d(known, np.unique(np.concatenate(rows[k : k + 2048])))

    def off(inside: np.ndarray) -> np.ndarray:
        """Signed standard errors of each term's toxic rows among the rows inside, drawn towards 0 for rare terms."""
        if not inside.any():
            return np.zeros(len(known))
        base = float(np.clip(y[inside].mean(), 1e-3, 1 - 1e-3))
        n, t = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for k in np.flatnonzero(inside):
            at = np.searchsorted(known, rows[k])  # a row has a term once
            n[at] += 1
            if y[k] > 0:
                t[at] += 1
        return (t - n * base) / np.sqrt((n + PRIOR) * base * (1 - base))

    alone = off(np.ones(len(rows), bool))
    high = alone >= CLEAR
    raised = np.array([high[np.searchsorted(known, r)].any() for r in rows], bool)
    return known[(np.abs(alone) >= CLEAR) | (np.abs(off(raised)) >= CLEAR)]


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


_EMPTY = _digest(np.zeros(0, np.uint32))


class Cut(list):
    """(terms that tell, label) of rows, with the digests of all terms of each: rows are equal by these."""

    def __init__(self, rows: list[tuple[np.ndarray, int]], digests: list[bytes]):
        super().__init__(rows)
        self.digests = digests


def cut(rows: list[tuple[np.ndarray, int]]) -> Cut:
    """The rows with those of their terms alone that tell; equal rows count once."""
    rows = [(t if (t[1:] >= t[:-1]).all() else np.sort(t), y) for t, y in rows]
    digests = [_digest(t) for t, _ in rows]
    once = list({(d, y): t for d, (t, y) in zip(digests, rows, strict=True)}.items())
    known = _telling([t for _, t in once], np.array([y for (_, y), _ in once], float))
    return Cut([(t[np.isin(t, known, assume_unique=True)], y) for t, y in rows], digests)


def fit(rows: list[tuple[np.ndarray, int]], seed: int = 7) -> Machine:
    """Adagrad on log loss, a batch at a time. Numbers follow from the rows, their order and the seed; equal rows count once."""
    rows = rows if isinstance(rows, Cut) else cut(rows)
    once = {(d, y): t for d, (t, y) in zip(rows.digests, rows, strict=True)}
    y_all = np.array([y for _, y in once], float)
    if all(d == _EMPTY for d, _ in once):
        share = y_all.mean() if len(y_all) else 0.0
        return Machine(-30.0 if share == 0 else float(np.log(share / (1 - share + 1e-9))), np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)))
    known = np.unique(np.concatenate(list(once.values())))
    own = [np.searchsorted(known, t) for t in once.values()]
    rng, size = np.random.default_rng(seed), len(known)
    share = float(np.clip(y_all.mean(), 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(share / (1 - share))), known, np.zeros(size), rng.standard_normal((size, FACTORS)) * 0.01)
    g_bias, g_lin, g_fac = 1.0, np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(own))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            sizes = np.array([len(own[i]) for i in batch])
            ids = np.concatenate([own[i] for i in batch])
            who = np.repeat(np.arange(len(batch)), sizes)
            v = m.factors[ids]
            total = np.stack([np.bincount(who, v[:, f], len(batch)) for f in range(FACTORS)], axis=1)
            z = m.bias + np.bincount(who, m.linear[ids], len(batch)) + 0.5 * ((total * total).sum(axis=1) - np.bincount(who, (v * v).sum(axis=1), len(batch)))
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y_all[batch]
            g_bias += float(slope.sum()) ** 2
            m.bias -= 0.5 * float(slope.sum()) / np.sqrt(g_bias)
            if not len(ids):
                continue
            used, where = np.unique(ids, return_inverse=True)
            d_lin = np.bincount(where, slope[who], len(used)) + 1e-3 * m.linear[used]
            pull = slope[who, None] * (total[who] - v)
            d_fac = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(FACTORS)], axis=1) + 1e-2 * m.factors[used]
            g_lin[used] += d_lin**2
            g_fac[used] += d_fac**2
            m.linear[used] -= 0.3 * d_lin / np.sqrt(g_lin[used])
            m.factors[used] -= 0.03 * d_fac / np.sqrt(g_fac[used])
    return m


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _told(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    """terms that tell, y, digest: of the rows (terms, y) of one task."""
    own = cut([(np.frombuffer(t, np.uint32), y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
    return pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t, _ in own], pa.binary()), pa.array([y for _, y in own], pa.int32()), pa.array(own.digests, pa.binary())], names=["terms", "y", "digest"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Machine:
    """Fits on labelled rows that are not held out, at most ``rows`` of them. One task gathers their hashed terms; those that tell come to the driver."""
    ship(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).cast("int").alias("__y"))
    known, place = known.where(~held_out("__id")), F.pmod(F.xxhash64("__id"), F.lit(1 << 40))
    there = known.count()
    if there > rows:  # a cut a little above the bound first, so that no task sorts more than about that many
        known = known.where(place < F.lit(int((1 << 40) * min(1.0, 1.2 * rows / there)))).orderBy(place, "__id", "__y").limit(rows)
    pairs = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text")).join(F.broadcast(known), "__id")
    pairs = pairs.groupBy("__id", "__y").agg(F.min("__text").alias("__text")).select("__text", "__y", "__id")  # a row for each label, however often an id repeats

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(terms(t)).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1), b.column(2)], names=["terms", "y", "id"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _told(batches)
        give_back()

    gathered = pairs.mapInArrow(hashed, "terms binary, y int, id long").repartition(1).sortWithinPartitions("id", "y")  # the bounded sample
    got = gathered.mapInArrow(told, "terms binary, y int, digest binary").toArrow().to_pydict()
    return fit(Cut([(np.frombuffer(t, np.uint32), y) for t, y in zip(got["terms"], got["y"], strict=True)], got["digest"]))


def score_of(machine: Machine, text: Column, spark: SparkSession) -> Column:
    """The score of a column of texts."""
    ship(spark)
    sent = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array((m.score(t) for t in values(column)), pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    narrow = docs.select("doc_id", "text")
    scored = narrow.select("doc_id", score_of(learn(narrow, labels), F.col("text"), docs.sparkSession).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the machine, learned from these documents and labels, does not call toxic."""
    return docs.where(score_of(learn(docs, labels), docs["text"], docs.sparkSession) < 0.5)

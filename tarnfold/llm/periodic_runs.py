"""Runs of words that repeat with a period: found on a harmonic grid, extended by prefix hashes, verified word by word.

A run of period p and at least 2 p words holds two neighbouring points of the grid 0, p, 2 p, ...; over all periods these are about
n ln n pairs. Equal words at both points, and on one side of them, are needed and are looked up for all pairs of a block at once.
How far the words agree beyond a pair, forwards and backwards, is found for all remaining pairs simultaneously by
binary search over polynomial prefix hashes under two primes. A hash can only make such an extension too long, so
every stretch found is then compared word by word; where one fails, the texts are searched again under another base.
A stretch is found under multiples of its period too; the least one is kept, and the others must be its multiples.

Words are compared as places in the batch's dictionary of words, never as hashes. Nothing is shuffled: a text is one row's work, in time n log n
or so and in memory linear in the text, with pairs in blocks of a fixed size.

Defined results: a null or blank text has no words and no runs; a null key rewrites nothing; every input row gets a row, repeated rows too; an empty
table gives no rows; other columns are not read. Runs that end together or tie in length are ordered by start, then period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import ship, text_or_empty

LEAST = 12
PAIRS = 1 << 19  # pairs of a block
SLICE = 4 << 20  # bytes of text that are split at a time
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
NOTHING = hashlib.sha256(b"").hexdigest()


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): whose (0, 0, 2, 2, 2) and which of them (0, 1, 0, 1, 2)."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of counts with about so many in all."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Hashes:
    """Polynomial prefix sums of the words; the hash of a stretch is lifted to another's place by a power of the base."""

    def __init__(self, words: np.ndarray, longest: int, attempt: int, moduli: tuple[int, ...]):
        self.parts = []
        for k, m in enumerate(moduli):
            base = int(np.random.default_rng([attempt, k]).integers(2, m))
            power = np.ones(1, np.uint64)
            while len(power) < max(len(words), longest) + 1:
                power = np.r_[power, power * np.uint64(pow(base, len(power), m)) % np.uint64(m)]
            sums = np.r_[np.uint64(0), np.cumsum((words.astype(np.uint64) + np.uint64(1)) % np.uint64(m) * power[: len(words)] % np.uint64(m))]
            self.parts.append((np.uint64(m), power, sums % np.uint64(m)))

    def agree(self, at: np.ndarray, length: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether the words from ``at`` and those ``shift`` further have one hash."""
        same = np.ones(len(at), bool)
        for m, power, sums in self.parts:
            here = (sums[at + length] + m - sums[at]) % m
            there = (sums[at + shift + length] + m - sums[at + shift]) % m
            same &= here * power[shift] % m == there
        return same


def longest_agreement(hashes: Hashes, at: np.ndarray, shift: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on (way 1) or before it (way -1) equal those ``shift`` further, at most ``most``; for all pairs at once."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live] + 1) >> 1
        same = hashes.agree(at[live] if way > 0 else at[live] - middle, middle, shift[live])
        low[live] = np.where(same, middle, low[live])
        high[live] = np.where(same, high[live], middle - 1)


def _stretches(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, hashes: Hashes, least: int) -> np.ndarray | None:
    """Distinct (start, end, period, text) over the whole grid, as hashes see them; None where they contradict each other.

    A pair whose words up to the next pair agree is in one stretch with it, and the first of such pairs speaks for all.
    """
    texts = np.flatnonzero(counts >= least)
    whose, period = expand(counts[texts] // 2)
    whose, period = texts[whose], period + 1
    points = (counts[whose] - 1) // period
    found = [np.empty((0, 4), np.int64)]
    for part in blocks(points, PAIRS):
        row, k = expand(points[part])
        text, p = whose[part][row], period[part][row]
        at = starts[text] + k * p
        keep = words[at] == words[at + p]
        text, p, at = text[keep], p[keep], at[keep]
        first, end = starts[text], starts[text] + counts[text]
        right = (at + p + 1 < end) & (words[np.minimum(at + 1, len(words) - 1)] == words[np.minimum(at + p + 1, len(words) - 1)])
        left = (at > first) & (words[np.maximum(at - 1, 0)] == words[np.maximum(at + p - 1, 0)])
        keep = right | left  # a run has at least six pairs of equal words in a row
        text, p, at, first, end = text[keep], p[keep], at[keep], first[keep], end[keep]
        goes_on = np.zeros(len(at), bool)
        goes_on[1:] = (text[1:] == text[:-1]) & (p[1:] == p[:-1]) & (at[1:] == at[:-1] + p[:-1])
        later = np.flatnonzero(goes_on)
        goes_on[later] = hashes.agree(at[later - 1], p[later], p[later])
        lead, all_at = np.cumsum(~goes_on) - 1, at
        text, p, at, first, end = (x[~goes_on] for x in (text, p, at, first, end))
        forth = longest_agreement(hashes, at, p, end - at - p, 1)
        back = longest_agreement(hashes, at, p, at - first, -1)
        start, stop = at - back, at + p + forth
        if (all_at + p[lead] >= stop[lead]).any():
            return None
        keep = stop - start >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([start, stop, p, text], 1)[keep], axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _hold(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, found: np.ndarray) -> bool:
    """Whether each stretch has its period, word by word, and no neighbouring word goes on with it."""
    start, stop, p, text = found.T
    for part in blocks(stop - start - p, PAIRS):
        row, k = expand((stop - start - p)[part])
        at = start[part][row] + k
        if (words[at] != words[at + p[part][row]]).any():
            return False
    first, end = starts[text], starts[text] + counts[text]
    before, after = np.flatnonzero(start > first), np.flatnonzero(stop < end)
    return bool((words[start[before] - 1] != words[start[before] - 1 + p[before]]).all() and (words[stop[after]] != words[stop[after] - p[after]]).all())


def runs(words: np.ndarray, counts: np.ndarray, least: int = LEAST, moduli: tuple[int, ...] = MODULI) -> np.ndarray:
    """(text, start, length, period) of every run of texts laid end to end, in that order; starts count from the text's first word.

    ``least`` is at least 7. Smaller moduli than the usual ones are used for the first attempt alone (tests).
    """
    starts = np.cumsum(counts) - counts
    attempt = 0
    while True:
        found = _stretches(words, starts, counts, Hashes(words, int(counts.max(initial=0)), attempt, moduli if not attempt else MODULI), least)
        attempt += 1
        if found is None:
            continue
        lead = np.ones(len(found), bool)
        lead[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        own = found[lead]
        if not (found[:, 2] % own[np.cumsum(lead) - 1, 2]).any() and _hold(words, starts, counts, own):
            break
    start, stop, p, text = own.T
    out = np.stack([text, start - starts[text], stop - start, p], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def rewritten(words: np.ndarray, h: int) -> np.ndarray:
    """The rule of the query: one text in ten gets a periodic tail."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[np.r_[0:a, a + np.arange(n - a) % p]]


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    for part in blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False), most):
        yield part.start, texts.slice(part.start, part.stop - part.start)


def _columns(texts: pa.Array, codes: np.ndarray) -> dict[str, pa.Array]:
    trimmed = pc.ascii_trim_whitespace(texts)
    split = pc.ascii_split_whitespace(trimmed)
    counts = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy())
    encoded = pc.filter(split.flatten(), pa.array(np.repeat(counts > 0, np.maximum(counts, 1)))).dictionary_encode()
    words = encoded.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(counts)
    for k in np.flatnonzero((codes % 10 == 0) & (counts > 0)):
        words[ends[k] - counts[k] : ends[k]] = rewritten(words[ends[k] - counts[k] : ends[k]], int(codes[k]))
    found = runs(words, counts)
    text, start, length, period = found.T
    edges = np.zeros(len(words) + 1, np.int64)
    at = (ends - counts)[text] + start
    np.add.at(edges, at + period, 1)
    np.add.at(edges, at + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    left = np.r_[0, np.cumsum(kept)][np.r_[0, ends]]
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), encoded.dictionary.take(pa.array(words[kept]))), " ")
    n = np.bincount(text, minlength=len(counts))
    to = np.cumsum(n)
    said = [f"{a},{b},{c}\n" for a, b, c in found[:, 1:].tolist()]
    digests = [hashlib.sha256("".join(said[b - a : b]).encode()).hexdigest() if a else NOTHING for a, b in zip(n.tolist(), to.tolist(), strict=True)]
    best = found[np.lexsort((period, start, -length, text))]
    best = best[np.r_[True, best[1:, 0] != best[:-1, 0]]] if len(best) else best
    top = np.zeros((len(counts), 3), np.int64)
    top[best[:, 0]] = best[:, 1:]
    none = n == 0
    column = lambda x: pa.array(x, pa.int64(), mask=none)
    return {
        "n_runs": pa.array(n, pa.int64()),
        "start": column(top[:, 0]),
        "length": column(top[:, 1]),
        "period": column(top[:, 2]),
        "exponent_milli": column(1000 * top[:, 1] // np.maximum(top[:, 2], 1)),
        "runs_sha256": pa.array(digests),
        "collapsed_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in body]),
        "collapsed": body,
    }


def _detected(docs: DataFrame, key: str, text: str, rewrite: bool, names: str) -> DataFrame:
    ship(docs.sparkSession)
    wanted = [x.split()[0] for x in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(2).to_numpy()
            for at, texts in _slices(b.column(1), SLICE):
                found = _columns(texts, codes[at : at + len(texts)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *(found[x] for x in wanted)], names=[key, *wanted])

    code = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(1)) if rewrite else F.lit(1)
    return docs.select(F.col(key), text_or_empty(text).alias("body"), code.cast("long").alias("code")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {names}")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rewritten texts, per input row: key, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    return _detected(docs, key, text, True, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the texts as they are, per input row: key, n_runs, the longest run, and ``collapsed``: the text with one period left of every run."""
    return _detected(docs, key, text, False, "n_runs long, start long, length long, period long, exponent_milli long, collapsed string")

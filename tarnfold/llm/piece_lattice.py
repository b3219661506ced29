"""Encoding and decoding with a piece vocabulary, N-best.

The lattice of a text has an edge for every vocabulary piece found in it, weighted by the piece's
score. Viterbi scores from the left are the exact best scores of all prefixes, so a backward A*
search that adds them to the score of a suffix takes complete segmentations off its queue from best
to worst, and the first N are the N best.

No piece holds a word mark after another character, so a text's lattice is a chain of its words'
lattices: the search runs on a word, once for each distinct word a worker meets, and the N best of
a text combine its words' N best lists. Among the N best at most N - 1 words leave their best
segmentation, and they are among the N - 1 words whose second best costs least, which makes
the combination exact however long the text. So most words need no more than the search's first result
and the next total on its queue: the same search, asked for one result. Time and memory are linear in a
word's length, whatever N: results are told by the places where they leave the best edges.

Scores are whole numbers of ``1 / UNIT``, so that sums and ties are exact. A unigram model has log
probabilities. The scores of a BPE model are the ranks of its merges, which do not add up; a piece of
rank r gets ``-ln(r + ZIPF)``, by Zipf's law. The best segmentation is therefore the likeliest one, not the
one that merging by rank gives; the README has figures of the difference. Ids are the model's own, and
``decode`` reads either.

A space is written as the mark U+2581, one mark leads the text, and characters outside the
vocabulary (the mark itself among them) are written as byte pieces at the lowest score less ten.
Decoding gives back every text exactly.

Defined results: a null text is empty; an empty text has no pieces and one segmentation; equal
scores are ordered by piece ids read from the last to the first within a word and by position across
words; repeated rows are encoded each; an empty table gives no rows; clashing columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tarnfold.llm.common import ship, text_or_empty

MODEL = public_tokenizers.path("piece_bpe_32k.model")
N = 4
MARK = "▁"
UNIT = 1 << 20
PENALTY = 10 * UNIT
ZIPF = 50  # added to ranks, as frequencies are flatter among the first
LASTING, PASSING = 600_000, 400_000  # words a worker keeps, and words it keeps for a while
LISTS = 50_000  # words whose N best a worker keeps
LONG = 256  # characters of a word that is not kept beyond a batch
_SPLIT = re.compile(" *[^ ]+| +")

Segmentation = tuple[int, bytes]
NEVER = -(1 << 62)


class Lattice:
    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int], lowest: int, n: int = N):
        self.pieces, self.byte_ids, self.n = pieces, byte_ids, n
        self.unknown = lowest - PENALTY
        self.longest = max(map(len, pieces), default=1)
        written = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        each = [written.get(i, b"") for i in range(max(written, default=0) + 1)]
        self._bytes_of = np.frombuffer(b"".join(each), np.uint8)
        self._sizes = np.array([len(x) for x in each])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._known: dict[str, tuple] = {p[:k]: () for p in pieces for k in range(1, len(p))} | pieces  # () for the beginning of a piece
        self._lasting: dict[str, int] = {}
        self._passing: dict[str, int] = {}
        self._lists: dict[str, list[Segmentation]] = {}
        self._long: list[str] = []
        self._ids: list[bytes] = []
        self._scores, self._gaps = array("q"), array("q")

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))

    def into(self, word: str, marked: str, j: int) -> list[tuple[int, int, int]]:
        """The edges that end at ``j``: last id, start, score. No two of them have one last id. A piece for the last character alone, or its bytes, is always among them."""
        out, known = [], self._known.get
        for i in range(max(0, j - self.longest), j):
            if hit := known(marked[i:j]):
                out.append((hit[0], i, hit[1]))
        if not out or out[-1][1] < j - 1:
            out.append((self._bytes(word[j - 1])[-1], j - 1, self.unknown))
        return out

    def search(self, word: str, n: int) -> tuple[list[Segmentation], int]:
        """The n best segmentations of a word from the best on, their ids as 32-bit bytes, and how much less than the first the next total is.

        Viterbi scores of all prefixes come first, with the best edge into each place (of equal ones that with the least id) and the total of the
        next best. The search then goes backwards. With exact scores ahead of it, a partial result's best continuation is by best edges alone,
        so a complete result is told by the few places where it leaves them: its turns. Taking a result off the queue
        puts on it what leaves that result at a later place, as losses against the best total; no more of these are kept than are still asked for.
        """
        marked = word.replace(MARK, "\x00").replace(" ", MARK)
        size, known, unknown = len(marked), self._known.get, (-1, self.unknown)
        forward, next_, began, piece = [0] + [NEVER] * size, [NEVER] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        for i in range(size):
            here, hit, j = forward[i], known(marked[i]), i + 1
            own = hit or unknown  # a piece for this character alone, or its bytes
            while True:
                if own:
                    z, f = here + own[1], forward[j]
                    if z > f:
                        next_[j] = f
                        forward[j] = z
                        began[j] = i
                        piece[j] = own[0]
                    elif z >= next_[j]:
                        next_[j] = z
                        if z == f and (own[0] if own[0] >= 0 else self._bytes(word[i])[-1]) < piece[j]:
                            began[j], piece[j] = i, own[0]
                if hit is None or j == size:
                    break
                j += 1
                own = hit = known(marked[i:j])
        ids, gap, j = [], -NEVER, size
        while j:
            if forward[j] - next_[j] < gap:
                gap = forward[j] - next_[j]
            j, at = began[j], piece[j]
            if at >= 0:
                ids.append(at)
            else:
                ids += self._bytes(word[j])[::-1]
        out = [(forward[size], array("I", ids[::-1]).tobytes())]
        if n == 1 or gap == -NEVER:
            return out, gap

        def leaving(loss: int, order: tuple, turns: tuple, j: int) -> Iterator[tuple]:
            """What leaves the best edges at ``j`` or before: loss, a key that orders equal losses by ids from the end, turns, the place it goes on from."""
            while j:
                if next_[j] > NEVER and next_[j] - forward[j] >= worst - loss:
                    best = piece[j] if piece[j] >= 0 else self._bytes(word[j - 1])[-1]
                    for at, i, s in self.into(word, marked, j):
                        if at != best:
                            yield loss + forward[j] - forward[i] - s, (*order, (-1, -j, at) if at < best else (1, j, at)), (*turns, (j, i)), i
                j = began[j]

        queue: list[tuple] = []
        worst, found = NEVER, (0, (), (), size)
        while True:
            left = n - len(out)
            queue = heapq.nsmallest(left, chain(queue, leaving(*found)), key=lambda x: (x[0], (*x[1], (0,))))
            if not queue:
                return out, gap
            if len(queue) == left:
                worst = -queue[-1][0]
            found = queue.pop(0)
            out.append((forward[size] - found[0], self._spelled(word, marked, began, piece, dict(found[2]))))
            if len(out) == n:
                return out, gap

    def _spelled(self, word: str, marked: str, began: list[int], piece: list[int], turns: dict[int, int]) -> bytes:
        """The ids of the result that goes by best edges but for its turns (end to start)."""
        ids, j = [], len(word)
        while j:
            i = turns.get(j)
            if i is None:
                i, at = began[j], piece[j]
            else:
                at = self._known[marked[i:j]][0] if self._known.get(marked[i:j]) else -1
            if at >= 0:
                ids.append(at)
            else:
                ids += self._bytes(word[i])[::-1]
            j = i
        return array("I", ids[::-1]).tobytes()

    def _listed(self, word: str) -> list[Segmentation]:
        """The N best of a word, kept for words that are asked for again."""
        got = self._lists.get(word)
        if got is None:
            got = self.search(word, self.n)[0]
            if len(word) > LONG:
                return got
            if len(self._lists) >= LISTS:
                self._lists.clear()
            self._lists[word] = got
        return got

    def _number(self, word: str) -> int:
        """The place of a word among those met; words met while the lasting places are full, and long ones, keep theirs until ``forget``."""
        at = self._lasting.get(word)  # it may have come earlier in the same text
        if at is None:
            at = self._passing.get(word)
        if at is None:
            [(score, ids)], gap = self.search(word, 1)
            at = len(self._ids)
            self._ids.append(ids)
            self._scores.append(score)
            self._gaps.append(gap)
            if len(word) > LONG:
                self._long.append(word)
            (self._lasting if at < LASTING and len(word) <= LONG else self._passing)[word] = at
        return at

    def forget(self) -> None:
        """Drops long words, and the words beyond the lasting places once they are many."""
        for word in self._long:
            at = self._passing.pop(word)
            if at < LASTING:
                self._ids[at] = b""
        self._long.clear()
        if len(self._passing) > PASSING:
            self._passing.clear()
            del self._ids[LASTING:], self._scores[LASTING:], self._gaps[LASTING:]

    def encode(self, text: str) -> list[tuple[int, bytes]]:
        """The N best segmentations of a text, as scores and ids (32 bits each, little-endian)."""
        if not text:
            return [(0, b"")]
        words = _SPLIT.findall(" " + text)
        found = list(map(self._lasting.get, words))
        for i, at in enumerate(found):
            if at is None:
                found[i] = self._number(words[i])
        where = np.array(found)
        gaps = np.frombuffer(self._gaps, np.int64)[where]
        total = int(np.frombuffer(self._scores, np.int64)[where].sum())
        near = np.argsort(gaps, kind="stable")[: self.n - 1] if len(gaps) < 16 else self._smallest(gaps)
        at = sorted(i for i in near.tolist() if gaps[i] < -NEVER)
        lists = [self._listed(words[i]) for i in at]
        ways = sorted(((-sum(own[c][0] - own[0][0] for own, c in zip(lists, pick, strict=True)), pick) for pick in product(*(range(len(own)) for own in lists))))[: self.n]
        parts = list(map(self._ids.__getitem__, found))
        out = []
        for loss, pick in ways:
            for i, c, options in zip(at, pick, lists, strict=True):
                parts[i] = options[c][1]
            out.append((total - loss, b"".join(parts)))
        return out

    def _smallest(self, gaps: np.ndarray) -> np.ndarray:
        """The places of the N - 1 smallest gaps, the first of equal ones."""
        most = np.partition(gaps, self.n - 2)[self.n - 2] if self.n > 1 else NEVER
        close = np.flatnonzero(gaps <= most)
        return close[np.argsort(gaps[close], kind="stable")[: self.n - 1]]

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation, the leading mark gone: the pieces' bytes laid end to end."""
        at = np.frombuffer(ids, "<u4")
        sizes = self._sizes[at]
        ends = np.cumsum(sizes)
        raw = self._bytes_of[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._starts[at] - ends + sizes, sizes)].tobytes()
        return raw.decode("utf-8", "surrogatepass")[1:]


def scaled(scores: list[float]) -> list[int]:
    """Scores as whole numbers; whole ones up to 0 are the ranks of a BPE model's merges."""
    ranks = all(x <= 0 and x == int(x) for x in scores)
    return [round(UNIT * (-math.log(ZIPF - x) if ranks else x)) for x in scores]


@lru_cache(maxsize=2)
def lattice(model: str = MODEL, n: int = N) -> Lattice:
    m = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces, byte_ids, scores = {}, [0] * 256, []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[3:-1], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} holds a mark after another character")
            pieces[p] = i
            scores.append(m.get_score(i))
    scores = scaled(scores)
    return Lattice({p: (i, s) for (p, i), s in zip(pieces.items(), scores, strict=True)}, byte_ids, min(scores), n)


def segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, n: int = N) -> DataFrame:
    """key, rank (0 best), score, ids: the N best segmentations of each text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, n)
        for b in batches:
            own.forget()
            got = [(who, r, s / UNIT, np.frombuffer(ids, "<u4").astype(np.int32)) for who, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r, (s, ids) in enumerate(own.encode(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], b.schema.types[0]), pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.float64()), pa.array([x[3] for x in got], pa.list_(pa.int32()))], names=[key, "rank", "score", "ids"])

    return docs.select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, rank int, score double, ids array<int>")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, n: int = N) -> DataFrame:
    """Per row: pieces and digest of the best segmentation, scores of the N best and the digest of all, and of the best decoded."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, n)
        for b in batches:
            own.forget()
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                found = own.encode(t)
                back = own.decode(found[0][1])
                every = hashlib.sha256()
                for _, ids in found:
                    every.update(len(ids).to_bytes(8, "little") + ids)
                row = (len(found[0][1]) // 4, zlib.crc32(found[0][1]), len(found), [s / UNIT for s, _ in found], every.hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t)
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[key, "n_pieces", "ids_crc32", "n_segmentations", "scores", "segmentations_sha256", "decoded_sha256", "exact"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"{key} {kind}, n_pieces long, ids_crc32 long, n_segmentations long, scores array<double>, segmentations_sha256 string, decoded_sha256 string, exact boolean")

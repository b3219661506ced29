"""Jaccard join on five-word shingles, through count vectors.

Documents link when 100 * |A & B| >= 80 * |A | B| over their sets of distinct shingles (64-bit
hashes of five words, each word hashed by BLAKE2b). The join is exact:

1. Sets. Documents with equal sets fold into one representative.
2. Blocks. Under any one order of all shingles, two linked sets share a shingle among the first
   ``n - ceil(0.8 n) + 1`` of each. The order puts common shingles (counted over all documents) last,
   so passages and boilerplate rarely open a block.
3. Stars. In each block every member is paired with the block's first. Pairs survive if the sum of
   the minima of their group counts allows the overlap; survivors are verified on their texts.
4. Rest. Only blocks whose members are still in several components go on, as tiles of bounded size.
   In a tile an R-tree over the count vectors finds the rows that have a row of another component
   whose bound allows a link; the others are done. Texts are read for the rows so found alone, and
   searched and verified inside a tile; a link leaves it only if it joins two components there.

Step 4 runs twice. First every row goes to one block and one tile of it, so that a group of near
copies becomes one component at a cost in proportion to its rows. Then what is still mixed is searched
whole: in a block of many tiles, the rows outside its largest component meet all its rows, and the rows
of that component never meet each other. A tile passes on fewer rows than it has, whatever its links.

A group for one or two shingles: texts that share less than about 0.75 of their shingles rarely
pass. Groups are nested, so unlike sizes compare at the smaller one's. An R-tree over all documents
alone would answer the same question, but its boxes overlap so far that it scans nearly every document
of like size; blocks first make it a local search.

The window over rare shingles holds no hot group: a shingle that it may meet is in 2 of 10,000 rows, or
beyond the ``COMMON_MOST`` commonest ones, whose members are a few hundredths of all rows at most.

Defined results: a null text is empty; a text without words has no shingles, links with nothing and
is its own component; a text of fewer than five words is one shingle; repeated rows have equal sets
and so one component; null ids come last among the ids of a component; an empty table gives no
rows; clashing columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import BUCKETS, keep_rows, ship, stage, text_or_empty, values, width

LEAST_GROUPS = 16
COMMON = 48  # documents a shingle must be counted in (lossily) to come late in the order
COMMON_MOST = 200_000  # and how many such shingles are told to the executors, at most
TILE = 2048  # rows of one side of a tile, about
WEIGHT = 1 << 20  # and their shingles; what a worker holds of a tile is in proportion to them
FEW = 48  # rows that are compared without a tree
LEAF = 16
MEMO = 120_000  # words whose hashes a worker keeps

_random = np.random.default_rng(2024)
_MIX = _random.integers(0, 2**64, 6, np.uint64) | np.uint64(1)


class _Words(dict):
    """Hashes of words, a bounded number of them kept. Unlike words share one as seldom as 64 random bits do, chosen ones too."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = hashlib.blake2b(word, digest_size=8).digest()
        return got


_words = _Words()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a text, A-Z lowered, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, lower() takes A-Z and split() the six white spaces alone
    return np.frombuffer(b"".join(map(_words.__getitem__, words)), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    h = words_of(text)
    if not len(h):
        return h
    if len(h) < 5:
        return _scramble(np.array([np.bitwise_xor.reduce(_scramble(h * _MIX[: len(h)] + np.uint64(len(h))))], np.uint64))
    n = len(h) - 4
    total = h[:n] * _MIX[0]
    for k in range(1, 5):
        total += h[k : k + n] * _MIX[k]
    return np.unique(_scramble(total))


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def groups_for(n: int) -> int:
    groups = LEAST_GROUPS
    while 2 * groups < n:
        groups *= 2
    return groups


def vector(found: np.ndarray) -> np.ndarray:
    """Counts by group. Counts of fewer groups are sums of counts of more."""
    groups = groups_for(len(found))
    return np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(v: np.ndarray) -> bytes:
    """A vector in half bytes, bytes or words, as the largest count asks, behind a mark that says which."""
    most = v.max()
    if most < 16:
        half = v.astype(np.uint8)
        return b"h" + (half[::2] | half[1::2] << 4).tobytes()
    return b"b" + v.astype(np.uint8).tobytes() if most < 256 else b"w" + v.astype(np.uint32).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    if b[:1] != b"h":
        return np.frombuffer(b, np.uint8 if b[:1] == b"b" else np.uint32, offset=1)
    half = np.frombuffer(b, np.uint8, offset=1)
    out = np.empty(2 * len(half), np.uint8)
    out[::2], out[1::2] = half & 15, half >> 4
    return out


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    return v if len(v) == groups else v.reshape(-1, groups).sum(axis=0)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """The most shingles that two sets can share, by their group counts."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum(dtype=np.int64))


def allowed(overlap: int, n: int, m: int) -> bool:
    """100 * overlap >= 80 * (n + m - overlap)"""
    return 9 * overlap >= 4 * (n + m) > 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    return allowed(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


class RTree:
    """Bulk-loaded over points of group counts; nodes hold the largest counts and the range of sizes below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points[:, int(np.argmax(points.var(axis=0)))], sizes)) if len(points) else np.zeros(0, int)
        self.rows = order
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose summed coordinate minima with the point allow a Jaccard of 0.8."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[depth])
            near = (5 * high >= 4 * size) & (4 * low <= 5 * size)
            at, top, low = at[near], top[near], low[near]
            at = at[9 * np.minimum(top, point).sum(axis=1, dtype=np.int64) >= 4 * (np.maximum(low, -(-4 * size // 5)) + size)] if len(at) else at
            if depth and len(at):
                below = len(self.levels[depth - 1][0])
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < below]
        return self.rows[at]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents and their counts: each batch counts its own, rare ones there are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.concatenate([np.zeros(0, np.uint64), *(shingles(t.as_py()) for t in b.column(0))])
            every.sort()
            found, n = np.unique(every[2:][every[2:] == every[:-2]], return_counts=True)  # what is there three times and more, less two
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64) + 2)], names=["token", "n"])

    counts = stage(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "shingle-counts")
    grade, kept, least = F.floor(F.log2("n") * 8), 0, None
    for r in counts.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect():  # a few hundred grades at most
        if kept + r["count"] > COMMON_MOST:
            break
        kept, least = kept + r["count"], r["g"]
    got = (counts.where(grade >= least) if least is not None else counts.limit(0)).toArrow()
    token, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _sets(docs: DataFrame) -> DataFrame:
    """rid, key, sha, n, digest of the set, prefix (array of shingles), common (how many of its last are common), points (packed group counts)."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        for b in batches:
            n, digest, prefix, late, points = [], [], [], [], []
            for t in values(b.column(3)):
                own = shingles(t)
                size = prefix_size(len(own))
                n.append(len(own))
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                first, hot = own[:size], 0
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[at] == own
                    if hit[:size].any():
                        rare, many = own[~hit], own[hit][np.lexsort((own[hit], often[at[hit]]))]
                        hot = max(0, size - len(rare))
                        first = np.concatenate([rare, many])[:size]
                prefix.append(first.view(np.int64).copy())  # a view would hold the whole set
                late.append(hot)
                points.append(packed(vector(own)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(late, pa.int32()), pa.array(points, pa.binary())],
                names=["rid", "key", "sha", "n", "digest", "prefix", "common", "points"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("rid", "key", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text").mapInArrow(run, f"rid long, key {kind}, sha string, n long, digest binary, prefix array<long>, common int, points binary")


def _allowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and group counts allow a link."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("points").alias(f"p{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, pa_, pb = (b.column(c).to_pylist() for c in ("na", "nb", "pa", "pb"))
            keep = [allowed(bound(unpacked(p), unpacked(q)), n, m) for n, m, p, q in zip(na, nb, pa_, pb, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(side("a"), "a").join(side("b"), "b")
    return near.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _texts(rids: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """rid, text for the given rows. Texts are found by key and digest: row numbers hold within the staged sets only.

    Before texts travel, those of no such row are left where they are: all but the ones whose digests
    share one of ``BUCKETS`` buckets with a wanted text's.
    """
    named = stage(rids.join(sets.select("rid", F.struct("key", "sha").alias("at")), "rid"), "named-rows")
    bucket = F.pmod(F.xxhash64("at"), F.lit(BUCKETS)).alias("bucket")
    wanted = named.select(bucket).distinct()  # BUCKETS rows at most
    near = docs.select(F.struct("key", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).alias("at"), "text").withColumn("bucket", bucket)
    near = near.join(F.broadcast(wanted), "bucket", "left_semi").groupBy("at").agg(F.first("text").alias("text"))  # a row that is repeated travels once
    return named.join(near, "at").select("rid", "text")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link."""
    pairs = stage(pairs, "pairs")
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), sets, docs)
    side = lambda x: texts.select(F.col("rid").alias(x), F.col("text").alias(f"t{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            keep = []
            for a, ta, tb in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if a != last:
                    last, own = a, shingles(ta)
                keep.append(linked(own, shingles(tb)))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """rid, label: for every end of a link the smallest end it reaches. Labels spread to neighbours and jump until nothing changes."""
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stage(both.groupBy(F.col("a").alias("rid")).agg(F.min("b").alias("m")).select("rid", F.least("rid", "m").alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("rid").alias("b"), F.col("label").alias("there")), "b").groupBy(F.col("a").alias("rid")).agg(F.min("there").alias("there"))
        spread = label.join(near, "rid").select("rid", F.col("label").alias("was"), F.least("label", "there").alias("label"))
        beyond = label.select(F.col("rid").alias("label"), F.col("label").alias("jump"))
        now = stage(spread.join(beyond, "label", "left").select("rid", "was", F.least("label", "jump").alias("label")), "labels")
        label = now.select("rid", "label")
        if now.where("was <> label").isEmpty():
            return label


def _near(points: list[np.ndarray], n: np.ndarray, of: np.ndarray, to: np.ndarray, apart: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``of`` the rows of ``to`` in another component (``apart`` may change meanwhile) whose bound allows a link."""
    if len(of) * len(to) <= FEW * FEW:
        once = np.array_equal(of, to)  # then a pair is looked at from one side
        for x in of:
            y = to[(apart[to] != apart[x]) & (5 * np.minimum(n[to], n[x]) >= 4 * np.maximum(n[to], n[x])) & ((to > x) | (not once))]
            yield x, np.array([k for k in y if allowed(bound(points[x], points[k]), n[x], n[k])], np.int64)
        return
    band = np.floor(np.log(n) / np.log(1.25)).astype(np.int64)
    for own in np.unique(band[of]):
        here, there = of[band[of] == own], to[np.abs(band[to] - own) <= 1]
        groups = min(len(points[k]) for k in np.concatenate([here, there]))
        tree = RTree(np.stack([folded(points[k], groups) for k in there]), n[there])
        for x in here:
            y = there[tree.search(folded(points[x], groups), int(n[x]))]
            yield x, y[apart[y] != apart[x]]


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each tile; they come one after the other, over the end of a batch if need be."""
    held: list[dict[str, np.ndarray]] = []
    keys = ("token", "i", "j")
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if not len(now["rid"]):
            continue
        turn = np.zeros(len(now["rid"]) - 1, bool)
        for c in keys:
            turn |= now[c][1:] != now[c][:-1]
        ends = [0, *(np.flatnonzero(turn) + 1).tolist(), len(now["rid"])]
        for a, b in zip(ends, ends[1:], strict=False):
            part = {c: v[a:b] for c, v in now.items()}
            if held and any(held[-1][c][-1] != part[c][0] for c in keys):
                yield {c: np.concatenate([x[c] for x in held]) for c in part}
                held = []
            held.append(part)
    if held:
        yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}


def _sides(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(t["role"] & 1), np.flatnonzero(t["role"] & 2)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, rid: the rows of each tile that have a row of another component whose bound allows a link."""
    out: list[tuple[int, int]] = []

    def rows() -> pa.RecordBatch:
        token, rid = zip(*out, strict=True) if out else ((), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(rid, pa.int64())], names=["token", "rid"])

    for t in _by_tile(batches):
        if (t["label"] == t["label"][0]).all():
            continue
        hit = np.zeros(len(t["rid"]), bool)
        for x, y in _near([unpacked(p) for p in t["points"]], t["n"], *_sides(t), t["label"]):
            hit[y] = True
            hit[x] |= len(y) > 0
        out += zip(t["token"][hit].tolist(), t["rid"][hit].tolist(), strict=True)
        if len(out) > 10_000:
            yield rows()
    yield rows()


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: verified links of each tile, only those that join two components of it."""
    for t in _by_tile(batches):
        sets = [shingles(x) for x in t.pop("text")]
        n = np.array([len(x) for x in sets], np.int64)
        place, inside = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.split(inside, np.cumsum(n)[:-1])
        marked = np.zeros(len(place), bool)
        _, apart = np.unique(t["label"], return_inverse=True)
        a, b = [], []
        for x, y in _near([vector(s) for s in sets], n, *_sides(t), apart):
            y = y[apart[y] != apart[x]]
            if not len(y):
                continue
            marked[mine[x]] = True
            shared = np.add.reduceat(marked[np.concatenate([mine[k] for k in y])], np.cumsum(n[y]) - n[y], dtype=np.int64)
            marked[mine[x]] = False
            for k in y[9 * shared >= 4 * (n[x] + n[y])]:
                if apart[k] != apart[x]:
                    apart[apart == apart[k]] = apart[x]
                    a.append(min(t["rid"][x], t["rid"][k]))
                    b.append(max(t["rid"][x], t["rid"][k]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _parts(m: str, w: str) -> Column:
    return F.greatest(F.ceil(F.col(m) / TILE), F.ceil(F.col(w) / WEIGHT), F.lit(1)).cast("int")


def _mixed(rows: DataFrame) -> DataFrame:
    """token, m (rows at hand), most (their largest component), mw (their shingles), r and rw (rows outside that component, and theirs): blocks that hold several components.

    Blocks of the same members (the shingles of one passage) are searched once.
    """
    per = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("rid")).alias("h"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("g"))
    largest = F.struct("k", "label")
    facts = {"labels": F.count(F.lit(1)), "m": F.sum("k"), "mw": F.sum("w"), "most": F.max_by("label", largest), "r": F.sum("k") - F.max("k"), "rw": F.sum("w") - F.max_by("w", largest), "h": F.bit_xor("h"), "g": F.bit_xor("g")}
    per = per.groupBy("token").agg(*(v.alias(k) for k, v in facts.items())).where("labels > 1")
    return stage(per.groupBy("h", "g", "m").agg(F.min(F.struct("token", "mw", "most", "r", "rw")).alias("at")).select("m", "at.*"), "mixed-blocks")


def _dealt(rows: DataFrame, mixed: DataFrame, whole: bool) -> DataFrame:
    """token, i, j, role (1: searches, 2: is searched), rid, label, n: the rows of mixed blocks dealt to tiles.

    ``whole``: every row outside a block's largest component meets all rows of the block; else a row is in one tile.
    """
    rows = rows.drop("m").join(mixed, "token").withColumn("c", _parts("m", "mw")).withColumn("o", _parts("r", "rw"))
    hashed = lambda seed, n: F.pmod(F.xxhash64("rid", F.lit(seed)), F.col(n)).cast("int")
    at = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    if not whole:
        return rows.select("token", hashed(7, "c").alias("i"), hashed(7, "c").alias("j"), F.lit(3).alias("role"), "rid", "label", "n")
    i, j = hashed(8, "o"), hashed(9, "c")
    searched = F.transform(F.filter(F.sequence(F.lit(0), F.col("o") - 1), lambda k: (F.col("label") == F.col("most")) | (k != i)), lambda k: at(k, j, 2))
    searches = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.when(k == j, 3).otherwise(1).alias("role")))
    own = F.when(F.col("label") == F.col("most"), searched).otherwise(F.concat(searches, searched))
    return rows.select("token", "rid", "label", "n", F.explode(own).alias("at")).select("token", "at.i", "at.j", "at.role", "rid", "label", "n")


def _tiles(rows: DataFrame) -> DataFrame:
    keys = ["token", "i", "j"]
    return rows.repartition(width(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _flags(rows: DataFrame, mixed: DataFrame, sets: DataFrame, whole: bool) -> DataFrame:
    """The rows (token, rid, ...) that may have a link to another component in their block."""
    dealt = _dealt(rows, mixed, whole).join(sets.select("rid", "points"), "rid")
    hits = _tiles(dealt).mapInArrow(_flagged, "token long, rid long").distinct()
    return stage(rows.join(hits, ["token", "rid"]), "flagged-rows")


def _joined(rows: DataFrame, sets: DataFrame, docs: DataFrame, whole: bool) -> DataFrame:
    """Verified links between components of the blocks of ``rows``."""
    mixed = _mixed(rows)
    texts = _texts(rows.join(mixed.select("token"), "token", "left_semi").select("rid").distinct(), sets, docs)
    return stage(_tiles(_dealt(rows, mixed, whole).join(texts, "rid")).mapInArrow(_joining, "a long, b long").distinct(), "links-rest")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.drop("label").join(label, "rid", "left").withColumn("label", F.coalesce("label", "rid"))


def _rest(blocks: DataFrame, links: DataFrame, label: DataFrame, sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with those that stars have not found, and the labels that follow."""
    rows = stage(_labelled(blocks.where("m > 2"), label).join(sets.select("rid", "n"), "rid"), "block-rows")
    mixed = _mixed(rows)
    flagged = _flags(rows, mixed, sets, False)
    picked = flagged.groupBy("rid").agg(F.max_by("token", F.struct("m", "token")).alias("token"))
    found = _joined(flagged.join(picked, ["rid", "token"]), sets, docs, False)
    if not found.isEmpty():
        links = links.unionByName(found)
        label = components(links)
    large = mixed.where(_parts("m", "mw") > 1).select("token")
    left = flagged.join(large, "token", "left_anti").unionByName(rows.join(large, "token", "left_semi").select(flagged.columns))
    left = stage(_labelled(left, label), "rows-left")
    found = _joined(_flags(left, _mixed(left), sets, True), sets, docs, True)
    if not found.isEmpty():
        links = links.unionByName(found)
        label = components(links)
    return links, label


def _leads(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of each block's first and its other members whose sizes allow a link."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"))
    pairs = blocks.where("rid <> leader").select(F.col("leader").alias("a"), F.col("rid").alias("b")).distinct()
    return pairs.join(side("b"), "b").join(side("a"), "a").where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")).select("a", "b")


def _standing(sets: DataFrame, repeated: DataFrame) -> DataFrame:
    """The sets with the row that stands for each (rep). Those whose digest shares none of ``BUCKETS`` buckets with a repeated one stay where they are."""
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket")
    hit = F.broadcast(repeated.select(bucket).distinct())  # BUCKETS rows at most
    every = sets.withColumn("bucket", bucket)
    clear = every.join(hit, "bucket", "left_anti").withColumn("rep", F.col("rid"))
    looked = every.join(hit, "bucket", "left_semi").join(repeated, "digest", "left").withColumn("rep", F.coalesce("rep", "rid"))
    return clear.unionByName(looked).drop("bucket")


def _solved(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets with the row that stands for each (rep), links between such rows, and the labels of linked ones."""
    ship(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), text_or_empty(text).alias("text"))
    sets = stage(_sets(docs), "shingle-sets")
    repeated = sets.where("n > 0").groupBy("digest").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1")
    repeated = stage(repeated.select("digest", "rep"), "repeated-sets")
    split = _standing(sets, repeated).where("n > 0 and rep = rid").select("rid", F.size("prefix").alias("s"), "common", F.posexplode("prefix").alias("pos", "token"))
    rare, often = (split.where(c).select("token", "rid") for c in ("pos < s - common", "pos >= s - common"))
    every = Window.partitionBy("token")
    facts = {"leader": F.min("rid"), "m": F.count(F.lit(1))}
    small = rare.withColumns({k: v.over(every) for k, v in facts.items()}).where("m > 1")
    large = often.join(stage(often.groupBy("token").agg(*(v.alias(k) for k, v in facts.items())).where("m > 1"), "common-blocks"), "token")
    blocks = stage(small.unionByName(large), "shingle-blocks")
    links = stage(_verified(_allowed(_leads(blocks, sets), sets), sets, docs), "links-stars")
    links, label = _rest(blocks, links, components(links), sets, docs)
    rep = _standing(sets, repeated).select("rid", "key", "sha", "n", "rep")
    return rep, links, label


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key, n_shingles, component_id, kept (one row of each component: the smallest key, then the first read), sha (of the text)."""
    rep, _, label = _solved(docs, key, text)
    found = stage(rep.join(label.select(F.col("rid").alias("rep"), "label"), "rep", "left").select("rid", "key", "sha", "n", F.coalesce("label", "rep").alias("label")), "shingle-groups")
    best = stage(found.groupBy("label").agg(F.min("key").alias("component_id"), F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("rid"))).alias("best")), "shingle-best")
    return found.join(best, "label").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("best.rid") == F.col("rid")).alias("kept"), "sha")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b: keys of documents that link, enough of them to join all of each component; equal sets speak through the first row read."""
    rep, found, _ = _solved(docs, key, text)
    side = lambda x: rep.select(F.col("rid").alias(f"r{x}"), F.col("key").alias(x))
    return found.toDF("ra", "rb").join(side("a"), "ra").join(side("b"), "rb").select("a", "b")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    A row is known by its key and the digest of its text; rows that repeat both stay or go together.
    """
    return keep_rows(docs, stage(groups(docs, key, text), "near-groups"), key, F.sha2(text_or_empty(text).cast("binary"), 256))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), steps AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.b FROM reach r JOIN steps s ON s.a = r.b
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

"""Exact duplicates by deterministic block naming, in DataFrame functions alone.

Normalised texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and
numbered: a block's place in the order of all is its name. Then adjacent names are paired, the distinct
pairs are sorted and numbered in turn, and so on until every document has one name. Two documents have
the same (level, name) if and only if their texts are equal: names stand for contents, never for hashes.

Blocks travel once, and copies fold together before they do. Blocks are ordered by a 128-bit hash,
which the distinct contents have just shown to tell all of them apart; where two contents share
one, naming starts again with another seed. A collision costs time, never a wrong name. Names
follow from the texts alone, not from partitions. Every join by a name has a table of distinct names on its
other side, written before, so that a hot name's rows can be split between tasks.

Defined results: a null text is empty, and all empty texts are equal; of equal texts the row with
the largest doc_id stays (null is least), and of repeated rows with that doc_id the first one read;
every input row gets a row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import keep_rows, ranked, stage, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 512


def normalised(name: str = "text") -> Column:
    """Lower-cases A-Z alone; texts of ASCII alone take the faster function."""
    t = text_or_empty(name)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _blocks(raw: Column, block: int) -> Column:
    """The blocks of bytes; ``raw`` is held in an array of one, so that it is made once and not for every block."""
    count = lambda r: F.greatest(F.ceil(F.octet_length(r) / F.lit(block)).cast("int"), F.lit(1))
    return F.transform(F.array(raw), lambda r: F.transform(F.sequence(F.lit(0), count(r) - 1), lambda i: F.substring(r, i * block + 1, F.lit(block))))[0]


def _hash(block: Column, seed: int, bits: int) -> Column:
    """128 bits that route a block to its name; fewer only in tests."""
    one = lambda k: F.pmod(F.xxhash64(block, F.lit(seed + k)), F.lit(1 << bits)) if bits < 64 else F.xxhash64(block, F.lit(seed + k))
    return F.struct(one(0).alias("h"), one(1).alias("g"))


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, bits: int = 64, seed: int = 0) -> DataFrame:
    """Per input row: rid, key, text_sha256, level, name."""
    raw = normalised(text).cast("binary")
    contents = docs.select(F.explode(_blocks(raw, block)).alias("block")).distinct()
    hashes = stage(contents.select(_hash(F.col("block"), seed, bits).alias("hash")).select("hash.*"), "block-hashes")
    if not hashes.groupBy("h", "g").count().where("count > 1").isEmpty():
        return identities(docs, key, text, block, bits, seed + 2)
    names = ranked(hashes, "block-names")
    rows = stage(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key), F.sha2(raw, 256).alias("text_sha256"), F.transform(_blocks(raw, block), lambda b: _hash(b, seed, bits)).alias("hashes")),
        "block-rows",
    )
    level = rows.select("rid", F.size("hashes").alias("left"), F.posexplode("hashes").alias("pos", "hash")).select("rid", "left", "pos", "hash.*").join(names, ["h", "g"]).select("rid", "pos", "left", "name")
    longest = rows.agg(F.max(F.size("hashes"))).first()[0] or 0
    done, depth = [], 0
    while True:
        level = stage(level, f"block-level-{depth}") if longest > 1 else level
        done.append(level.where("left = 1").select("rid", F.lit(depth).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = (
            level.where("left > 1")
            .groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("left") / 2).cast("int").alias("left"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = stage(pairs, f"block-pairs-{depth}")
        level = pairs.join(ranked(pairs.select("a", "b").distinct(), "pair-names"), ["a", "b"]).select("rid", "pos", "left", "name")
        longest, depth = -(-longest // 2), depth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return rows.select("rid", key, "text_sha256").join(out, "rid")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """Per input row: key, keep_id, group_size, kept, text_sha256."""
    named = stage(identities(docs, key, text, block, bits), "block-identities")
    best = stage(named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(F.col(key).alias("id"), (-F.col("rid")).alias("first"))).alias("best")), "block-groups")
    return named.join(best, ["level", "name"]).select(key, F.col("best.id").alias("keep_id"), "group_size", (F.col("best.first") == -F.col("rid")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    A row is known by its key and the digest of its text; where rows repeat both, one of them stays.
    """
    sha = F.sha2(normalised(text).cast("binary"), 256)
    found = stage(groups(docs, key, text).withColumnRenamed("text_sha256", "sha"), "block-found")
    out = keep_rows(docs, found, key, sha)
    repeated = found.groupBy(key, "sha").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col(key).alias("again")).distinct()
    if repeated.isEmpty():
        return out
    rows = out.select(F.struct("*").alias("row"), F.col(key).alias("key"), sha.alias("sha"))
    again = F.col("key").eqNullSafe(F.col("again"))
    once = rows.join(repeated, again, "left_semi").groupBy("key", "sha").agg(F.first("row").alias("row"))
    return rows.join(repeated, again, "left_anti").select("row.*").unionByName(once.select("row.*"))


ORACLE_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
"""

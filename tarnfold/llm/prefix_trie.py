"""The trie of conversation prefixes, by polynomial rolling fingerprints that are verified.

Turns are sorted by range and numpy scans roll the fingerprint of every prefix: the sum of the turns'
content values, each times a power of a base for its place, under two prime moduli. A conversation
that several ranges hold has its later parts lifted by what the earlier ones add up to (one small row a range).
Every conversation is then rebuilt by arithmetic on such sums: up to three turns of the conversation that
leads its family of twenty, and its own turns behind them.

Prefixes of one depth and fingerprint are candidates for one node. They are grouped by their last turn's
role and text as well, so that a group with one content agrees with its representative (the member with the smallest
conv_id) turn by turn: its fingerprints without that turn agree too, and so on up to the root. Where a
group has two contents, the members that differ from the representative leave it from that depth on under a label
of their own content, and the groups are made and verified again until none differs. A collision costs a round, never a wrong node.

Sums over subtrees need no walk by levels. Every node is named by its smallest member, and a member that is
smallest at one depth is so at all later ones. A conversation's own nodes are thus one chain; a node's subtree
is the rest of its chain and the whole chains of its other members. Chains are summed by the same scan; the members' totals are an aggregate.

A list of members is hashed as it streams by: ids are joined to strings where they are sorted, and a task keeps one hash state.

Defined results: a null role or text is empty, a null turn comes first, turns that tie are ordered by role and
text and repeated rows all count; rows with no conv_id belong to no conversation; ``%`` keeps the sign as in SQL;
an empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import ship, stage, text_or_empty, width

MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_664_525_017)
FAMILY, LEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "print", "label"]


def powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponents under a modulus below 2 ** 31, by squaring, all at once."""
    out, square, left = np.ones(len(exponents), np.uint64), base % modulus, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(modulus), out)
        square, left = square * square % modulus, left >> np.uint64(1)
    return out % np.uint64(modulus)


def _segments(keys: np.ndarray, held: object) -> tuple[np.ndarray, bool]:
    """Where runs of equal keys begin, and whether the first goes on from the batch before."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, held is not None and keys[0] == held


def _within(values: np.ndarray, starts: np.ndarray, carry: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums inside segments, with and without a row's own value; the first segment starts from carry."""
    total = np.cumsum(values)
    before = total - values
    lengths = np.diff(np.r_[starts, len(values)])
    base = np.repeat(before[starts], lengths)
    base[: lengths[0]] -= values.dtype.type(carry)  # wraps and comes back: sums are taken modulo 2 ** 64
    return total - base, before - base


def _rolled(moduli: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, sums = None, 0, [0] * len(moduli)
        for b in batches:
            if not b.num_rows:
                continue
            keys, content = b["conv_id"].to_numpy(), b["content"].to_numpy()
            starts, goes_on = _segments(keys, held)
            at = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.r_[starts, b.num_rows]))
            if goes_on:
                at[: starts[1] if len(starts) > 1 else None] += count
            columns = {"at": at}
            for k, (p, base) in enumerate(zip(moduli, BASES, strict=False)):
                value = (content % p).astype(np.uint64) * powers(base, at, p) % np.uint64(p)
                own, before = _within(value, starts, sums[k] if goes_on else 0)
                columns[f"s{k}"], columns[f"e{k}"] = (own % np.uint64(p)).astype(np.int64), (before % np.uint64(p)).astype(np.int64)
            held, count, sums = keys[-1], int(at[-1]) + 1, [int(columns[f"s{k}"][-1]) for k in range(len(moduli))]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], *(pa.array(x) for x in columns.values()), b["role"], b["text"]], names=["conv_id", "part", *columns, "role", "text"])

    return run


def _lifts(moduli: tuple[int, ...]) -> Callable:
    """Of one conversation's parts (one row a range): what the earlier parts add."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        rows, count, sums = [], 0, [0] * len(moduli)
        for x in parts.itertuples():
            up = [pow(b, count, p) for p, b in zip(moduli, BASES, strict=False)]
            rows.append((x.conv_id, x.part, count, *(v for pair in zip(up, sums, strict=True) for v in pair)))
            sums = [(s + u * getattr(x, f"s{k}")) % p for k, (s, u, p) in enumerate(zip(sums, up, moduli, strict=True))]
            count += x.n
        return pd.DataFrame(rows, columns=["conv_id", "part", "n0", "u0", "z0", "u1", "z1"])

    return run


def _crossing(parts: DataFrame, key: str) -> DataFrame:
    """Keys that begin a range: only these can lie in several, and there is one a range."""
    return parts.groupBy("part").agg(F.min(key).alias(key)).select(key).distinct()


def scanned(conversations: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Per turn: conv_id, its place, the prefix sums with it (s0, s1) and without it (e0, e1), role, text."""
    spark = conversations.sparkSession
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    sorted_ = turns.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    rolled = sorted_.select("conv_id", F.spark_partition_id().alias("part"), F.xxhash64("role", "text").alias("content"), "role", "text").mapInArrow(
        _rolled(moduli), "conv_id long, part int, at long, s0 long, e0 long, s1 long, e1 long, role string, text string"
    )
    placed = stage(rolled, "trie-turns")
    parts = placed.join(F.broadcast(_crossing(placed, "conv_id")), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("s0", "at").alias("s0"), F.max_by("s1", "at").alias("s1"))
    lifts = parts.groupBy("conv_id").applyInPandas(_lifts(moduli), "conv_id long, part int, n0 long, u0 long, z0 long, u1 long, z1 long").where("n0 > 0")
    lifted = placed.join(F.broadcast(lifts), ["conv_id", "part"], "left")  # two rows a range at most
    up = lambda k, c: F.when(F.col("n0").isNull(), F.col(f"{c}{k}")).otherwise((F.col(f"{c}{k}") * F.col(f"u{k}") + F.col(f"z{k}")) % F.lit(moduli[k])).alias(f"{c}{k}")
    return lifted.select("conv_id", (F.col("at") + F.coalesce("n0", F.lit(0))).alias("at"), *(up(k, c) for k in (0, 1) for c in "se"), "role", "text")


def _pick(names: list[str], place: Column) -> Column:
    return F.element_at(F.array(*(F.coalesce(F.col(x), F.lit(0)) for x in names)), (place + 1).cast("int"))


def families(turns: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Per conversation: how many turns lead it (k of h), whose, its length, and what turns its own sums into those of the rebuilt one."""
    ends = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("at") == j - 1, F.col(f"s{m}"))).alias(f"p{m}_{j}") for m in (0, 1) for j in range(1, LEAD)))
    ends = stage(ends.select("*", F.lit(0).cast("long").alias("zero")), "trie-heads")
    own = ends.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lead = ends.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *(F.col(f"p{m}_{j}").alias(f"b{m}_{j}") for m in (0, 1) for j in range(1, LEAD)))
    both = own.join(lead, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    inverse = lambda m: F.element_at(F.array(*(F.lit(pow(BASES[m], -j, moduli[m])).cast("long") for j in range(LEAD))), (F.col("h") - F.col("k") + 1).cast("int"))
    past = F.least("h", "n")
    return both.select(
        "conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *(_pick(["zero", *(f"p{m}_{j}" for j in range(1, LEAD))], past).alias(f"own{m}") for m in (0, 1)),
        *(_pick(["zero", *(f"b{m}_{j}" for j in range(1, LEAD))], F.col("k")).alias(f"lead{m}") for m in (0, 1)),
        *(inverse(m).alias(f"scale{m}") for m in (0, 1)),
    )


def members(turns: DataFrame, info: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Per rebuilt conversation and depth, the root's 0 too: conv_id, depth, its fingerprint, the one above, whether it ends there, role, text."""
    joined = lambda a, b: F.col(a) * F.lit(1 << 31) + F.col(b)
    moved = lambda c, m: ((F.col(f"lead{m}") + F.pmod(F.col(f"{c}{m}") - F.col(f"own{m}"), F.lit(moduli[m])) * F.col(f"scale{m}")) % F.lit(moduli[m])).alias(f"{c}{m}")
    own = turns.join(info, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("k") + 1).alias("depth"), "length", *(moved(c, m) for c in "se" for m in (0, 1)), "role", "text")
    leading = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < LEAD - 1)).withColumnRenamed("conv_id", "base")
    lead = leading.join(info, "base").where("at < k").select("conv_id", (F.col("at") + 1).alias("depth"), "length", "s0", "s1", "e0", "e1", "role", "text")
    below = own.unionByName(lead).select("conv_id", "depth", joined("s0", "s1").alias("print"), joined("e0", "e1").alias("above"), (F.col("depth") == F.col("length")).alias("last"), "role", "text")
    root = info.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit(None).cast("long").alias("above"), (F.col("length") == 0).alias("last"), F.lit("").alias("role"), F.lit("").alias("text"))
    return below.unionByName(root)


def _labelled(rows: DataFrame, splits: DataFrame | None) -> DataFrame:
    """The labels of a member at its depth and at the one above: those of all splits up to there, in the order of rounds."""
    if splits is None:
        return rows.withColumn("label", F.lit("")).withColumn("above_label", F.lit(""))
    by = splits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("round", "since", "name"))).alias("splits"))
    text = lambda d: F.concat_ws("/", F.transform(F.filter(F.coalesce("splits", F.array()), lambda s: s["since"] <= d), lambda s: s["name"]))
    return rows.join(by, "conv_id", "left").withColumn("label", text(F.col("depth"))).withColumn("above_label", text(F.col("depth") - 1)).drop("splits")


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and after a table of nodes with one content each: the rows with their labels; splits until that holds."""
    splits, turn = None, 0
    while True:
        now = _labelled(rows, splits)
        contents = now.groupBy(*KEY, "above", "above_label", "role", "text").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"))
        nodes = stage(contents.select(*KEY, "above", "above_label", "first", "n", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "trie-nodes")
        clash = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("contents"), F.min("first").alias("first")).where("contents > 1").drop("contents")
        if clash.isEmpty():
            return nodes, now.drop("role", "text")
        clash = stage(clash, "trie-clashes")
        own = now.join(clash.withColumnRenamed("first", "conv_id"), [*KEY, "conv_id"]).select(*KEY, F.col("role").alias("own_role"), F.col("text").alias("own_text"))
        apart = now.join(own, KEY).where((F.col("role") != F.col("own_role")) | (F.col("text") != F.col("own_text")))
        digest = F.sha2(F.concat_ws("\n", F.lit(str(turn)), F.octet_length("role").cast("string"), "role", "text"), 256)
        first = apart.groupBy("conv_id").agg(F.min(F.struct("depth", digest.alias("digest"))).alias("d"))
        more = stage(first.select("conv_id", F.lit(turn).alias("round"), F.col("d.depth").alias("since"), F.concat_ws(":", F.col("d.depth").cast("string"), "d.digest").alias("name")), "trie-splits")
        splits, turn = more if splits is None else splits.unionByName(more), turn + 1


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, carry = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, weight = b["first"].to_numpy(), b["weight"].to_numpy()
        starts, goes_on = _segments(keys, held)
        own, before = _within(weight, starts, carry if goes_on else 0)
        held, carry = keys[-1], int(own[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], names=[*b.schema.names, "before"])


def _chains(nodes: DataFrame) -> DataFrame:
    """Nodes with ``before``: the weights of their chain above them."""
    spark = nodes.sparkSession
    sorted_ = nodes.repartitionByRange(width(spark), "first", "depth").sortWithinPartitions("first", "depth").withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema) + ", before long"
    placed = stage(sorted_.mapInArrow(_summed, schema), "trie-chains")
    parts = placed.join(F.broadcast(_crossing(placed, "first")), "first", "left_semi").groupBy("first", "part").agg(F.sum("weight").alias("weight"))
    earlier = parts.alias("a").join(parts.alias("b"), (F.col("a.first") == F.col("b.first")) & (F.col("b.part") < F.col("a.part"))).groupBy(F.col("a.first").alias("first"), F.col("a.part").alias("part")).agg(F.sum("b.weight").alias("lift"))
    return placed.join(F.broadcast(earlier), ["first", "part"], "left").withColumn("before", F.col("before") + F.coalesce("lift", F.lit(0))).drop("lift", "part")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and id: a joined string for each node's stretch of a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        depth, prints, ids = (b[c].to_numpy() for c in ("depth", "print", "conv_id"))
        label = b["label"]
        same = (depth[1:] == depth[:-1]) & (prints[1:] == prints[:-1]) & np.asarray(pa.compute.equal(label[1:], label[:-1]))
        starts = np.flatnonzero(np.r_[True, ~same])
        ends = np.r_[starts[1:], len(ids)]
        at = pa.array(starts)
        joined = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([b["depth"].take(at), b["print"].take(at), label.take(at), pa.array(ids[starts]), pa.array(joined, pa.string())], names=[*KEY, "least", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by node and least id: one digest a node, the state of one hash at a time."""
    schema = pa.schema([("depth", pa.int64()), ("print", pa.int64()), ("label", pa.string()), ("ends_sha256", pa.string())])
    held, state, done = None, None, []
    flush = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)
    for b in batches:
        for *key, _, ids in zip(*(b[c].to_pylist() for c in (*KEY, "least", "ids")), strict=True):
            if key == held:
                state.update(b"," + ids.encode())
                continue
            if held is not None:
                done.append((*held, state.hexdigest()))
            held, state = key, hashlib.sha256(ids.encode())
        if len(done) >= 10_000:
            yield flush()
            done = []
    if held is not None:
        done.append((*held, state.hexdigest()))
    yield flush()


def _ends(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    last = rows.where("last").select(*KEY, "conv_id")
    strings = last.repartitionByRange(width(spark), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_strings, "depth long, print long, label string, least long, ids string")
    return strings.repartition(width(spark), *KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_hashed, "depth long, print long, label string, ends_sha256 string")


def nodes(conversations: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(conversations.sparkSession)
    turns = scanned(conversations, moduli)
    info = stage(families(turns, moduli), "trie-families")
    found, rows = _verified(members(turns, info, moduli))
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("print"), F.col("above_label").alias("label")).agg(F.count(F.lit(1)).alias("n_children"))
    chains = _chains(found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("weight", (F.col("n") - 1) * F.col("words")))
    totals = stage(chains.groupBy("first").agg(F.sum("weight").alias("total"), F.max((F.col("n_children") == 0).cast("long")).alias("leaves"), F.min("depth").alias("since")), "trie-totals")
    others = rows.join(totals, F.col("conv_id") == F.col("first")).where("depth < since").groupBy(*KEY).agg(F.sum("total").alias("other_total"), F.sum("leaves").alias("other_leaves"))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("above"), F.col("label").alias("above_label"), F.col("first").alias("parent_conv_id"))
    whole = chains.join(totals, "first").join(others, KEY, "left").join(_ends(rows), KEY, "left").join(above, ["depth", "above", "above_label"], "left")
    return whole.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (F.col("leaves") + F.coalesce("other_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("total") - F.col("before") + F.coalesce("other_total", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: CRC-32 bit by bit: each byte of the decimal id enters before the first of its eight steps.
_STEP = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
_BYTES = "list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
CRC32 = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform({_BYTES}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: {_STEP}), 4294967295)"

ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % {FAMILY} AS base, {CRC32.format("c")} % {LEAD} AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT ids.c, 0 AS own, i, role, text FROM ids JOIN turns ON turns.c = base WHERE i < h
  UNION ALL SELECT ids.c, 1, i, role, text FROM ids JOIN turns ON turns.c = ids.c WHERE i >= h),
whole AS (SELECT ids.c, coalesce(list({{'r': role, 't': text}} ORDER BY own, i) FILTER (WHERE role IS NOT NULL), []) AS s FROM ids LEFT JOIN rebuilt USING (c) GROUP BY ids.c),
prefixes AS (SELECT c, len(s) AS n, d, s[:d] AS k FROM whole, unnest(range(0, len(s) + 1)) AS u(d)),
nodes AS (
  SELECT k, d, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM prefixes GROUP BY k, d),
kids AS (SELECT k[:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
sums AS (SELECT k[:e] AS k, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM full_nodes, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, p.c AS parent_conv_id, a.n_convs, a.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN sums USING (k) LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.k = a.k[:a.d - 1]
"""

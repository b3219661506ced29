"""Sharding by a hierarchical weighted hash tree.

A topology is a list of regions, each a list of racks, each a list of weighted shards. A key
descends region, rack and shard: at every level each child draws ``-ln(u) / weight`` with ``u``
hashed from the key and the child's label, and the smallest draw wins. A child's draw depends on
nothing but its own label and weight, so changing one weight moves keys only into or out of the
subtrees on the path to it, and a shard that comes as a region of its own takes keys only into itself.

Defined results: a null key hashes as the label alone; repeated rows each get a slot of their own;
a null text counts as empty; an empty table gives no rows; columns other than the key and the text
are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import stage, text_or_empty


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves carry the shard number and their own weight."""

    label: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(x.weight for x in self.children) if self.children else self.own_weight

    def shards(self) -> list[int]:
        return [n for x in self.children for n in x.shards()] if self.children else [self.shard]


def even_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> Node:
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        tuple(
            Node(f"r{a}", tuple(Node(f"r{a}/k{b}", tuple(Node(f"r{a}/k{b}/s{c}", shard=next(number)) for c in range(shards))) for b in range(racks)))
            for a in range(regions)
        ),
    )


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    n, r = max(tree.shards()) + 1, f"r{len(tree.children)}"
    return Node(tree.label, (*tree.children, Node(r, (Node(f"{r}/k0", (Node(f"{r}/k0/s0", shard=n, own_weight=weight),)),))))


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.label)), 11)
    return -F.ln((bits + F.lit(1)) / F.lit(float(2**53))) / F.lit(float(node.weight))


def place(key: Column, node: Node) -> Column:
    """The shard number that a key reaches below a node."""
    if not node.children:
        return F.lit(node.shard)
    live = [x for x in node.children if x.weight > 0]
    if len(live) == 1:
        return place(key, live[0])
    won = F.array_min(F.array(*(F.struct(_draw(key, x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(live))))["i"]
    out = place(key, live[-1])
    for i, x in list(enumerate(live))[-2::-1]:
        out = F.when(won == i, place(key, x)).otherwise(out)
    return out


def assign(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot and the shard in the grown tree.

    Slots are dealt without gathering a shard: rows are numbered inside their input partition, and
    the counts of (shard, partition) are summed up to each partition's first slot.
    """
    body = text_or_empty(text)
    rows = stage(
        docs.select(
            F.col(key),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            place(F.col(key), tree).cast("int").alias("shard"),
            place(F.col(key), grown(tree)).cast("int").alias("grown_shard"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("seq"),
        ),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("seq"))
    return (
        rows.withColumn("at", at)
        .join(first, ["shard", "part"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
    )

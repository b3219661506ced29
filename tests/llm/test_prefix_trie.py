import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tarnfold.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, first long, part int, label string"


def brute(rows):
    """Nodes by dictionaries of whole prefixes: (conv_id, depth) to the other columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    member, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            member[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    out = {}
    for k, cs in member.items():
        below = [x for x in member if x[: len(k)] == k]
        out[min(cs), len(k)] = (
            min(member[k[:-1]]) if k else None,
            len(cs),
            sum(len(x) == len(k) + 1 for x in below),
            sum(not any(y[:-1] == x and len(y) == len(x) + 1 for y in member) for x in below),
            sum((len(member[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x),
            hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def mixed():
    """Few texts, so that prefixes meet: families with and without their leader, short ones, ties, nulls, repeats."""
    rows = []
    for c in [*range(0, 47), 61, 62, 63, 64, 65, -7, -3, 100, 101, 119]:
        for t in range((c * 7) % 6 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"word {(c // 9 + t * (c % 3)) % 3} and\x0bmore"))
    rows += [(64, 0, "user", "again")] * 3 + [(64, 0, "user", "tie"), (64, None, None, None), (65, 9, "user", None), (None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("moduli", [prefix_trie.MODULI, (2, 3)])
def test_against_brute_force_with_and_without_collisions(spark, moduli):
    rows = mixed()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    assert found(prefix_trie.nodes(df, moduli)) == brute(rows)


def test_one_long_conversation_over_several_ranges(spark):
    rows = [(20, t, "user", f"w{t % 2}") for t in range(300)] + [(21, t, "user", f"w{t % 2}" if t < 250 else "other") for t in range(260)] + [(22, 0, "user", "w0")]
    got = found(prefix_trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute(rows)


def test_many_copies_end_in_one_node(spark):
    rows = [(c, 0, "user", "same") for c in range(25_000)]
    got = found(prefix_trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute(rows)


def test_empty(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crc32_in_sql():
    for n in (0, 7, -12, 123456789, 10**15):
        assert duckdb.sql(f"SELECT {prefix_trie.CRC32.format(f'CAST({n} AS BIGINT)')}").fetchall()[0][0] == zlib.crc32(str(n).encode())


def test_twin(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({prefix_trie.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in prefix_trie.nodes(spark.read.parquet(f"{sf}/conversations.parquet")).select(columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

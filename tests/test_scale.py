"""Work that costs far more than its bytes goes to many tasks, and is done once."""

import re

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import shared
from tarnfold.operators import code, edits, golang, templates
from tarnfold.plans import registry
from tarnfold.sources import edited, tree

GO = "package p\n\n// A is\nfunc A(n int) string { return b(\"}\", n) }\n"


@pytest.fixture
def files(spark):
    return spark.range(40).coalesce(1).select(F.format_string("d/%d.go", "id").alias("path"), F.lit(GO).alias("content"))


def used(df):
    """Partitions that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_files_are_dealt_before_they_are_read(spark, files):
    assert used(files) == 1
    for found in (code.chunks(files), code.answers(files)):
        assert found.count() == 40 and used(found) > 4
    other = spark.range(40).select(F.format_string("d/%d.go", "id").alias("path"))
    joined = files.repartition(shared.shares(spark), "path").join(other.hint("merge"), "path")  # here a second dealing by the path itself would be left out
    assert "xxhash64" in code.chunks(joined)._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_folder_are_dealt(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.md").write_text("x")
    found = tree.listed(spark, str(tmp_path))
    assert found.count() == 40 and used(found) > 4 and used(tree.with_content(found)) > 4


def test_rows_are_dealt_before_they_are_filled(spark):
    rows = spark.range(40).coalesce(1)
    found = templates.filled(rows, "{{.N}}", F.struct(F.col("id").alias("N")))
    assert used(found) > 4 and {(r.id, r.text) for r in found.collect()} == {(k, str(k)) for k in range(40)}


def test_an_edited_file_is_read_once(monkeypatch):
    read, seen = golang.parsed, []
    monkeypatch.setattr(golang, "parsed", lambda text: seen.append(text) or read(text))
    mod = {"seq": 1, "action": "MODIFY", "wanted": "a", "new_content": "func A() {}"}
    got = edits._fold([mod], "a.go", GO, [["a", "Function", "A", GO[GO.index("//") : -1]]])
    assert got[0][2] == "applied" and got[0][8] == "package p\n\nfunc A() {}\n"
    assert seen == ["package p\n\nfunc A() {}\n", "package _tmp\nfunc A() {}"]  # the whole, and the piece


def test_a_file_gives_chunks_and_fault_out_of_one_reading(monkeypatch):
    read, seen = golang.parsed, []
    monkeypatch.setattr(golang, "parsed", lambda text: seen.append(text) or read(text))
    found, wrong = code.taken("a.go", GO + "func b( {\n}\n")
    assert len(seen) == 1 and [c[1] for c in found] == ["A"] and (wrong.line, wrong.message) == (5, code.check("a.go", GO + "func b( {\n}\n").message)
    assert code.taken("a.md", "# x") == ([], None)


def test_parts_lie_in_many_folders_and_old_bytes_stay(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k}.md").write_text("old")
    rows = [(f"{k}.md", None if k % 2 else "new", edited.hash_of(tmp_path / f"{k}.md"), 7) for k in range(20)]
    changes = spark.createDataFrame(rows, edited.CHANGES)
    transaction = edited.stage(changes, str(tmp_path))
    assert len({edited.part_of(str(tmp_path), transaction, r[0], ".new").parent for r in rows}) > 5
    assert {r.state for r in edited.publish(changes, str(tmp_path), transaction).collect()} == {"published"}
    assert sorted(p.name for p in tmp_path.glob("*.md")) == sorted(f"{k}.md" for k in range(0, 20, 2)) and (tmp_path / "0.md").read_text() == "new"
    assert {r.state for r in edited.withdraw(changes, str(tmp_path), transaction).collect()} == {"withdrawn"}
    assert {p.read_text() for p in tmp_path.glob("*.md")} == {"old"} and len(list(tmp_path.glob("*.md"))) == 20
    edited.forget(str(tmp_path), transaction)
    assert list((tmp_path / edited.FOLDER).iterdir()) == []


def test_code_edits_reads_its_files_once(spark, sf):
    plan = registry.code_edits(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the edits; chunks are held


def test_texts_are_not_broadcast(spark):
    files = spark.createDataFrame([("a.go", GO)], "path string, content string")
    chunks = spark.createDataFrame([("a.go", 0, "x", "Function", "A", GO[GO.index("//") : -1])], "path string, ordinal int, id string, kind string, name string, body string")
    mods = spark.createDataFrame([(1, "MODIFY", "x", None, "func A() {}")], "seq int, action string, chunk_id string, file_path string, new_content string")
    found = edits.apply(mods, files, chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    by_path = r"\[path#\d+\], \[path#\d+\], LeftOuter"
    assert re.search(f"SortMergeJoin {by_path}", plan) and not re.search(f"BroadcastHashJoin {by_path}", plan)
    assert found.first().outcome == "applied"


def test_sequence_numbers_may_be_longs(spark):
    files = spark.createDataFrame([("a.go", GO)], "path string, content string")
    chunks = spark.createDataFrame([("a.go", 0, "x", "Function", "A", GO[GO.index("//") : -1])], "path string, ordinal int, id string, kind string, name string, body string")
    for kind, seq in (("long", 7_200_000_009), ("int", 9)):
        mods = spark.createDataFrame([(seq, "MODIFY", "x", None, "func A() {}"), (seq + 1, "ODD", None, "a.go", "")], f"seq {kind}, action string, chunk_id string, file_path string, new_content string")
        found = edits.apply(mods, files, chunks)
        assert dict(found.dtypes)["seq"] == {"long": "bigint"}.get(kind, kind)
        assert {(r.seq, r.outcome) for r in found.collect()} == {(seq, "applied"), (seq + 1, "conflict")}


def test_edited_trees_may_have_wide_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (3_600_000_000, 3_600_000_001, 3_600_000_002)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.engine_edits(spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(r.applied for r in got) and sum(r.same_id for r in got) == 10  # one file in three is deleted, each other one has an added chunk

import hashlib

from pyspark.sql import functions as F

from tarnfold.functions import text as tx
from tarnfold.operators import audit, edits, tools
from tarnfold.plans import registry


def test_calls_become_modifications_and_records(spark):
    t = tools.Tools()
    t.create_file("a.md", "# A\n")
    t.add_chunk("a.md", "## B\n")
    t.delete_file("none.md")
    t.modify_chunk("zzzz", "x")
    t.delete_chunk("zzzz")
    t.task_reflect("  ")
    t.task_reflect(" learned \n")
    assert t.insights == ["learned"]
    mods = t.frame(spark)
    files = spark.createDataFrame([], "path string, content string")
    chunks = spark.createDataFrame([], "path string, ordinal int, id string, kind string, name string, body string")
    results = edits.apply(mods, files, chunks)
    rows = tools.records(results, mods, 1)
    assert [(r.tool_name, r.outcome) for r in rows.orderBy("seq").collect()] == [("create_file", "applied"), ("add_chunk", "applied"), ("delete_file", "noop"), ("modify_chunk", "location"), ("delete_chunk", "location")]
    one = tools.collected(rows).first()
    assert (one.all_ok, one.any_failure, one.failed, one.calls) == (False, True, 2, 5)
    assert {r.path: r.content for r in edits.files_after(files, results).collect()} == {"a.md": "# A\n\n## B\n"}
    t.reset()
    assert t.frame(spark).count() == 0 and tools.collected(rows.where("false")).count() == 0


def test_text_helpers(spark):
    r = spark.range(1).select(
        tx.unfenced(F.lit(" ```json\n{}\n``` ")).alias("a"), tx.unfenced(F.lit("plain")).alias("b"), tx.listed(F.lit(" a, ,b\n,")).alias("c"), tx.indented(F.lit("x\n\ny"), "  ").alias("d")
    ).first()
    assert (r.a, r.b, r.c, r.d) == ("{}", "plain", ["a", "b"], "  x\n\n  y")


def test_audit(spark):
    rows = spark.createDataFrame([(1, '{"perScenario": [{"scenarioId": "a", "verdict": "PASS", "score": 90}, {"scenarioId": "b", "verdict": "PARTIAL", "score": 40, "evidence": ["x", "y"]}]}'), (2, "broken"), (3, '{"perScenario": [{"scenarioId": "a", "verdict": "??"}]}')], "run int, response string")
    m = audit.metrics(rows, "run")
    assert sorted((r.run, r.name, r.status, r.detail) for r in m.collect()) == [(1, "a", "PASS", "score=90"), (1, "b", "PARTIAL", "score=40; x"), (3, "a", "FAIL", "score=0")]
    wanted = spark.createDataFrame([("b", "PASS")], "scenario string, wanted string")
    assert {r.run: r.code for r in audit.exit_codes(m, wanted, "run").collect()} == {1: 0, 3: 1}
    assert {r.run: r.code for r in audit.exit_codes(m, wanted, "run", strict=True).collect()} == {1: 1, 3: 1}


def test_unanswered(spark):
    asked, got = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("b", 1), ("c", 2)], "path string, n int")
    assert [r.path for r in tools.unanswered(asked, got).collect()] == ["a"] and [r.path for r in tools.answered(asked, got).collect()] == ["b"]


TEXTS = {0: "a, b,\n, c " * 100 + "last", 1: "   ", 2: "x" * 500 + ", end \u2003\u3000\n", 9: "nine"}


def _whole(spark, folder, name):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return registry.queries()[name](spark, str(folder)).collect()


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_lists_over_whole_texts(spark, tmp_path):
    got = {r.doc_id: r for r in _whole(spark, tmp_path, "list_and_indent")}
    assert set(got) == set(TEXTS)
    for i, t in TEXTS.items():
        parts = [x.strip() for x in t.split(",") if x.strip()]
        assert (got[i].n_parts, got[i].parts) == (len(parts), _md5("|".join(parts)))
        assert got[i].quoted == _md5("\n".join("> " + x if x else x for x in t.split("\n")))


def test_insights_of_whole_texts(spark, tmp_path):
    got = _whole(spark, tmp_path, "insight_filter")
    assert {r.doc_id: r.insight for r in got} == {i: _md5(t.strip()) for i, t in TEXTS.items() if t.strip()} and len(got) == 3

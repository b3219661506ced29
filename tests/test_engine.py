import os
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import edits, loops, memory, selection, skills
from tarnfold.plans.engine import Engine
from tarnfold.sources import notes, tree

MODS = "seq int, action string, chunk_id string, file_path string, new_content string"


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "src"
    for name, text in {
        "main.go": "package main\n\nfunc Hello() string { return world() }\n\nfunc world() string { return \"w\" }\n",
        "lib/util.ts": "export function add(a: number) { return a; }\n",
        "README.md": "# Title\n\n## Usage\ntext\n",
        "_under.md": "# U\n",
        ".dot.md": "# D\n",
        "node_modules/x.ts": "export function no() {}\n",
        ".git/y.md": "# no\n",
        "skip.py": "x = 1\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_index_is_incremental_and_keeps_ids(spark, project, tmp_path):
    told = []
    e = Engine(spark, str(project), str(tmp_path / "store"), listener=lambda event, facts: told.append((event, facts)))
    assert e.index(1) == {"scanned": 5, "skipped": 0, "indexed": 5, "failed": 0, "deleted": 0, "chunks": 7}
    assert [t for t, _ in told] == ["index_counted", "index_committed"] and told[0][1]["chunks"] == 7 and told[1][1] == {"version": 1}
    first = {(r.path, r.name): r.id for r in e.chunks().collect()}
    assert len(set(first.values())) == 7
    assert e.index(2)["skipped"] == 5
    os.utime(project / "README.md", (time.time() + 5, time.time() + 5))
    again = e.index(3)
    assert (again["skipped"], again["indexed"]) == (5, 0)
    (project / "main.go").write_text("package main\n\nfunc Hello() string { return \"changed\" }\n\nfunc Fresh() {}\n")
    os.utime(project / "main.go", (time.time() + 9, time.time() + 9))
    (project / "_under.md").unlink()
    report = e.index(4)
    assert (report["indexed"], report["deleted"]) == (1, 1)
    now = {(r.path, r.name): r.id for r in e.chunks().collect()}
    assert now[("main.go", "Hello")] == first[("main.go", "Hello")] and ("main.go", "world") not in now and ("_under.md", "U") not in now
    assert now[("main.go", "Fresh")] not in first.values()


def test_context_document(spark, project, tmp_path):
    store = tmp_path / "store"
    e = Engine(spark, str(project), str(store))
    e.index(1)
    (store / "facts.md").write_text("Fact.\n\n")
    notes.write_session(str(store / "sessions"), "s1", 5, "done\n")
    (store / "sessions" / "bad.json").write_text("{")
    (store / "skills").mkdir()
    (store / "skills" / "one.md").write_text("Do it.\n")
    c = e.context("please change Hello")
    assert c.errors == []
    modes = {r.chunk_id: r["mode"] for r in c.decisions.collect()}
    by = {r.name: r.id for r in e.chunks().collect()}
    assert modes[by["Hello"]] == "FULL" and modes[by["world"]] == "SKELETON" and modes[by["Usage"]] == "IGNORE"
    assert '<context files="5" full="1" skeleton="1" ignored="5">' in c.user and f"[chunk {by['Usage']} IGNORED]\n" in c.user
    assert c.user.endswith("<user_task>\nplease change Hello\n</user_task>")
    assert c.system.endswith("<global_facts>\nFact.\n</global_facts>")
    assert c.user.index("<project_context>") < c.user.index('<task_skills count="1">') < c.user.index('<session_history count="1">\n<session id="s1" ts="5">\ndone\n</session>')


def test_edits(spark, project, tmp_path):
    e = Engine(spark, str(project), str(tmp_path / "store"))
    e.index(1)
    by = {r.name: r.id for r in e.chunks().collect()}
    before = (project / "lib/util.ts").read_bytes()
    rows = [
        (1, "MODIFY", by["Hello"], None, "func Hello() string { return \"new\" }"),
        (2, "DELETE_CHUNK", f" {by['world']} ", None, None),
        (3, "MODIFY", by["world"], None, "func world() {}"),
        (4, "MODIFY", by["add"], None, "export function add( {"),
        (5, "MODIFY", "zzzz", None, "x"),
        (6, "CREATE_FILE", None, "./new/a.md", "# New"),
        (7, "CREATE_FILE", None, "new/a.md", "# Again"),
        (8, "ADD_CHUNK", None, "new/a.md", "## More"),
        (9, "CREATE_FILE", None, "a.py", "x"),
        (10, "DELETE_FILE", None, "none.md", None),
        (11, "DELETE_FILE", None, ".dot.md", None),
        (12, "ADD_CHUNK", None, "none.md", "x"),
        (13, "CREATE_FILE", None, "../out.md", "x"),
        (14, "WHAT", None, None, None),
        (15, "MODIFY", by["Hello"], None, ""),
    ]
    got = e.apply(spark.createDataFrame(rows, MODS)).orderBy("seq").collect()
    assert [r["outcome"] for r in got] == ["applied", "applied", "location", "validation", "location", "applied", "conflict", "applied", "conflict", "noop", "applied", "conflict", "conflict", "conflict", "conflict"]
    assert (project / "main.go").read_text() == 'package main\n\nfunc Hello() string { return "new" }\n'
    assert (project / "lib/util.ts").read_bytes() == before
    assert (project / "new/a.md").read_text() == "# New\n\n## More\n"
    assert not (project / ".dot.md").exists() and not (tmp_path / "out.md").exists()
    assert got[3]["stage"] == "merged" and (got[3]["line"], got[3]["col"]) == (2, 1) and got[0]["affected"] == [by["Hello"]]


def test_selection_survives_failing_policies(spark):
    chunks = spark.createDataFrame([("a", i, f"c{i}", "Section", f"n{i}", "", []) for i in range(120)], "path string, ordinal int, id string, kind string, name string, body string, refs array<string>")

    def broken(prompt, rows):
        raise RuntimeError("down")

    decisions, missing, errors, failures = selection.select("n7", chunks, selection.Config(broken))
    assert errors == ["triage: down"] and missing.count() == 120 and {r["mode"] for r in decisions.collect()} == {"IGNORE"}
    decisions, missing, errors, failures = selection.select("n77", chunks, selection.Config(selection.rule_policy, broken))
    assert errors == ["expand: down"] and missing.count() == 0
    assert {r.chunk_id for r in decisions.where("mode = 'FULL'").collect()} == {"c7", "c77"}
    assert selection.shards(chunks).select("shard").distinct().count() == 3
    with pytest.raises(ValueError):
        selection.Config()


def test_every_failed_shard_is_told(spark):
    chunks = spark.createDataFrame([("a", i, f"c{i}", "Section", "n", "", []) for i in range(260)], "path string, ordinal int, id string, kind string, name string, body string, refs array<string>")

    def down(prompt, rows, sink):
        raise RuntimeError("down")

    _, missing, errors, failures = selection.select("x", chunks, selection.Config(selection.called(down), shard_size=2))
    assert failures.count() == 130 and failures.select("shard").distinct().count() == 130 and missing.count() == 260 and errors == []


def test_the_second_pass_as_a_folded_state_decides_as_one_group_does(spark):
    rows = [("a", i, f"c{i:04}", "Section", f"n{(i * 7919) % 1000:04}", "", []) for i in range(900)]
    chunks = spark.createDataFrame(rows, "path string, ordinal int, id string, kind string, name string, body string, refs array<string>").repartition(7)
    best = lambda held: sorted(held)[:5]
    folded = selection.Folded(lambda: [], lambda held, row: best([*held, (row["name"], row["id"])]), lambda a, b: best(a + b), lambda prompt, held: [(i, "FULL", prompt + n) for n, i in held])
    every = lambda prompt, rows: rows.select(F.col("id").alias("chunk_id"), F.lit("SKELETON").alias("mode"), F.lit("").alias("reason"), "shard")
    gathered = selection.called(lambda prompt, rows, sink: sink([(i, "FULL", prompt + n) for n, i in best([(r["name"], r["id"]) for r in rows])]))
    one, two = ({r.chunk_id: (r["mode"], r.reason) for r in selection.select("p", chunks, selection.Config(every, expand))[0].collect()} for expand in (folded, gathered))
    assert one == two and sum(m == "FULL" for m, _ in one.values()) == 5 and len(one) == 900
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)  # a tree of two levels
    try:
        assert {r.chunk_id for r in folded("p", chunks).collect()} == {i for i, (m, _) in one.items() if m == "FULL"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert folded("p", chunks.limit(0)).count() == 0


def test_merge_keeps_the_earlier_of_equals_and_never_lowers(spark):
    votes = spark.createDataFrame([("a", "full", "x", 2), ("a", "SKELETON", "y", 3), ("b", "SKELETON", "first", 1), ("b", "skeleton", "second", 2), ("c", "odd", "z", 1)], "chunk_id string, mode string, reason string, seq int")
    got = {r.chunk_id: (r["mode"], r.reason) for r in selection.merge(votes, "seq").collect()}
    assert got == {"a": ("FULL", "x"), "b": ("SKELETON", "first"), "c": ("IGNORE", "z")}


def test_map_import(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a.md": {"path": "a.md", "mtime": 3, "hash": "h", "chunks": [{"id": "x", "path": "a.md", "kind": "Section", "name": "n", "body": "b", "refs": ["r"], "updated_at": 1}]}}')
    files, chunks = tree.from_map_json(spark, str(tmp_path / "m.json"))
    assert files.first().mtime == 3 and chunks.first().refs == ["r"]
    assert tree.nested(files, chunks).first().chunks[0].name == "n"


def test_loops():
    calls = []

    def attempt(prompt, k):
        calls.append(prompt)
        return [("modify_chunk", "conflict" if k == 1 else "applied", "m")]

    assert loops.retried(attempt, "p")[:2] == (True, 2) and '<previous_attempt round="1">' in calls[1]
    assert loops.retried(lambda p, k: [], "p")[:2] == (True, 1)

    def failing(*_):
        raise RuntimeError("x")

    ran = []
    end = lambda **k: loops.run_task(**({"run": ran.append, "verify": lambda r: False, "description": "d"} | k)).outcome
    assert [end(verify=failing), end(verify=lambda r: True), end(cancelled=lambda: True), end(run=failing), end(between=failing), end(verify=None), end(verify=lambda r: failing() if r else False), end(verify=lambda r: r == 2), end()] == list(loops.OUTCOMES)


def test_verdict_table(spark):
    checks = spark.createDataFrame([(i, 1, p, None) for i, p in enumerate([True, False, True, False, True])], "task long, round int, passed boolean, diag string")
    metrics = spark.createDataFrame([(2, 1, 1, "a", "FAIL", ""), (3, 1, 1, "a", "PASS", None), (4, 1, 1, "a", "PASS", None), (4, 1, 2, "b", "ERROR", "d")], "task long, round int, seq long, name string, status string, detail string")
    got = {r.task: r.passed for r in loops.verdicts(checks, metrics).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False}
    blocks = {r.task: r.block for r in loops.history(checks, metrics).collect()}
    assert blocks[4] == '<round n="1">\nmetrics:\n  - a: PASS\n  - b: ERROR (d)\n</round>' and blocks[0] == '<round n="1">\n</round>'


def test_sessions(spark):
    rows = spark.createDataFrame([(f"s{i}", i, "x") for i in range(5)] + [("s1", 9, "later")], notes.SESSIONS)
    kept = memory.keep_latest(rows)
    assert [r.id for r in memory.latest_sessions(kept, 3).collect()] == ["s1", "s4", "s3"]
    assert memory.history_block(kept.where("false")).first().text == ""


SKILL = '''package skills

// AddRoute: adds a route.
type AddRoute struct {
	Path string `json:"path" jsonschema:"required"`
	Tags []string
	Opt *int
	Inner struct { A bool }
}

const AddRouteSOP = `Add {{.Path}}{{if .Tags}} tags:{{range .Tags}} {{.}}{{end}}{{else}} plain{{end}}.`

type HelperUnused struct { A string }
'''


def test_skills(tmp_path):
    (s,) = skills.parse(SKILL, "f.go")
    assert (s.name, s.description) == ("AddRoute", "adds a route.")
    assert s.schema.simpleString() == "struct<Path:string,Tags:array<string>,Opt:bigint,Inner:struct<A:boolean>>" and s.schema["Path"].metadata == {"json": "path", "jsonschema": "required"}
    call = skills.as_tool(s, lambda text: text.upper())
    assert call({"Path": "/x", "Tags": ["a", "b"]}) == "ADD /X TAGS: A B." and call({"Path": "/x"}) == "ADD /X PLAIN."
    with pytest.raises(ValueError):
        skills.as_tool(s, None)({})
    for bad in ("[3]int", "time.Time", "func()", "chan int", "interface{ X() }", "Named"):
        with pytest.raises(ValueError):
            skills.column_type(bad)
    for bad in ("lower string", "A string\nA int", "Embedded"):
        with pytest.raises(ValueError):
            skills.struct_type(bad)
    assert skills.column_type("map[string][]*int")[0].simpleString() == "map<string,array<bigint>>" and skills.column_type("[]byte")[0].simpleString() == "binary"
    (tmp_path / "a.go").write_text(SKILL)
    (tmp_path / "b_test.go").write_text("bad")
    (tmp_path / "z.go").write_text("nothing here")
    r = skills.Registry()
    with pytest.raises(ValueError):
        r.load_folder(str(tmp_path))
    assert [x.name for x in r.all()] == ["AddRoute"] and r.remove("AddRoute") and not r.remove("AddRoute")


def test_error_positions(spark):
    line, col, message = edits.error_position(F.col("t"))
    got = spark.createDataFrame([("x.go:4:7: expected ')'",), ("no position",)], "t string").select(line.alias("l"), col.alias("c"), message.alias("m")).collect()
    assert tuple(got[0]) == (3, 7, "expected ')'") and got[1].c is None and got[1].m == "no position"


def test_streaming_sections(spark, tmp_path):
    from tarnfold.streaming import reindex

    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("# A\nx\n## B\ny")
    q = reindex.sections(spark, str(root)).writeStream.format("memory").queryName("sections_seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.name for r in spark.table("sections_seen").collect()} == {"A", "B"}
    q = reindex.reindexed(e := Engine(spark, str(root), str(tmp_path / "store")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert e.chunks().count() == 2 and e.snapshots.current().version == 1


def test_new_content_is_checked_alone():
    for path, head, new in (("a.go", "package a\n\nfunc f() {\n", "}\n\nfunc g() {"), ("a.ts", "function f() {\n", "}\nfunction g() {")):
        for action in ("MODIFY", "ADD_CHUNK"):
            before = head + "x()\n}\n" if action == "MODIFY" else head
            mod = {"seq": 1, "action": action, "wanted": "abcd", "new_content": new if action == "MODIFY" else "}\n"}
            (got,) = edits._fold([mod], path, before, [["abcd", "Func", "f", "x()"]])
            assert (got[2], got[5], got[6], got[8]) == ("validation", "snippet", 1, before)


def test_the_verify_loop_tells_what_failed_and_archives_every_ending():
    prompts, ends = [], []
    verdicts = [loops.Verdict(diag=" first \n"), loops.Verdict(True, "", [("build", "PASS", ""), ("lint", "FAIL", "two")]), loops.Verdict(False, "still", []), loops.Verdict(False, "", [("build", "PASS", "")])]
    notes_made: list[str] = []

    def run(prompt):
        prompts.append(prompt)
        notes_made.append(f"insight {len(prompts)}")

    end = loops.run_task(run, lambda k: verdicts[k], "Fix it", reflections=notes_made, archive=ends.append)
    assert (end.outcome, end.passed, end.rounds) == ("verify-passed", True, 3) and ends == [end] and end.reflections == ["insight 1", "insight 2", "insight 3"]
    one, two = '<round n="1">\nmetrics:\n  - build: PASS\n  - lint: FAIL (two)\n</round>\n', '<round n="2">\ndiag:\nstill\n</round>\n'
    assert prompts == [
        "Fix it\n\n<initial_verification>\nfirst\n</initial_verification>",
        f"Fix it\n\n<previous_rounds>\n{one}</previous_rounds>",
        f"Fix it\n\n<previous_rounds>\n{one}{two}</previous_rounds>",
    ]
    who, at, text = loops.archived(end, "Fix it", "tag", datetime(2024, 5, 6, 7, 8, 9))
    assert who == "tag-20240506-070809" and at == int(datetime(2024, 5, 6, 7, 8, 9).timestamp())
    assert text == '{"description":"Fix it","last_diag":"","metrics":{"build":{"detail":"","status":"PASS"}},"outcome":"verify-passed","passed":true,"reflections":["insight 1","insight 2","insight 3"],"rounds":3,"tag":"tag"}'
    for k in ({"verify": lambda r: 1 / 0}, {"verify": lambda r: True}, {"verify": None}, {"cancelled": lambda: True}, {"between": lambda r: 1 / 0}):
        loops.run_task(**({"run": prompts.append, "verify": lambda r: False, "description": "d", "archive": ends.append} | k))
    assert len(ends) == 6 and ends[1].error


def test_the_loop_and_the_tables_write_the_same_history(spark):
    checks = spark.createDataFrame([(1, 1, False, " d\n"), (1, 2, False, None)], "task long, round int, passed boolean, diag string")
    metrics = spark.createDataFrame([(1, 1, 1, "a", "PASS", None), (1, 1, 2, "b", "ODD", "x")], "task long, round int, seq long, name string, status string, detail string")
    blocks = {r["round"]: r.block for r in loops.history(checks, metrics).collect()}
    assert blocks == {1: loops.Verdict(False, " d\n", [("a", "PASS", ""), ("b", "ODD", "x")]).block(1), 2: loops.Verdict().block(2)}
    assert loops.statuses(metrics).first().counts == {"PASS": 1, "ODD": 1}
    assert loops.retried(lambda p, k: 1 / 0, "p") == (False, 1, [])


def test_a_failing_shard_costs_its_own_votes_alone(spark):
    chunks = spark.createDataFrame([("a", i, f"c{i}", "Section", f"n{i}", "", []) for i in range(130)], "path string, ordinal int, id string, kind string, name string, body string, refs array<string>")

    def ask(prompt, rows, sink):
        first = rows[0]["ordinal"]
        if first < 50:
            raise RuntimeError("down")
        if first >= 100:
            return
        sink([(rows[0]["id"], "FULL", "early")])
        sink([(r["id"], "SKELETON", prompt) for r in rows])

    decisions, missing, errors, failures = selection.select("late", chunks, selection.Config(selection.called(ask), selection.called(lambda p, rows, sink: sink([(rows[0]["id"], "FULL", "up")]))))
    assert errors == [] and sorted(map(tuple, failures.collect())) == [("triage", 0, "down"), ("triage", 2, "no answer")] and missing.count() == 80
    got = {r.chunk_id: (r["mode"], r.reason) for r in decisions.collect()}
    assert len(got) == 130 and sum(x == ("SKELETON", "late") for x in got.values()) == 49 and sum(x == ("FULL", "up") for x in got.values()) == 1


def test_unreadable_files_are_counted_and_kept(spark, project, tmp_path):
    e = Engine(spark, str(project), str(tmp_path / "store"))
    first = e.index(1)
    before = {r.id for r in e.chunks().where("path = 'main.go'").collect()}
    (project / "main.go").unlink()
    (project / "main.go").symlink_to("/proc/self/mem")  # is there and cannot be read
    got = e.index(2)
    assert got["failed"] == 1 and got["scanned"] == first["scanned"] and got["indexed"] == 0
    assert {r.id for r in e.chunks().where("path = 'main.go'").collect()} == before

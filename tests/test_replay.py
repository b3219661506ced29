from pyspark.sql import functions as F

from tarnfold.operators import loops, replay
from tarnfold.plans.workers import ship


def make():
    """A function that goes to the workers by value: they cannot import this file."""

    def calls_of(task, round_, prompt):
        """A task's calls: none, good ones, bad ones or a failure, by its number."""
        outcomes = ("applied", "noop", "conflict", "validation")
        how = (task * 7 + round_ * 3) % 11
        if how == 0:
            raise RuntimeError(f"down {task}")
        return [] if how == 1 else [(f"tool{j}", outcomes[(task + round_ + j) % (2 if how > 7 else 4)], f"m{len(prompt)}") for j in range(how % 4 + 1)]

    return calls_of


calls_of = make()


def test_retries_of_many_tasks_are_those_of_each(spark):
    ship(spark)
    tasks = spark.range(400).select(F.col("id").alias("task"), F.concat(F.lit("do "), "id").alias("prompt"))
    ends, calls = replay.retried(tasks, replay.mapped(calls_of))
    got = {r.task: (r.success, r.rounds) for r in ends.collect()}
    made = {}
    for r in calls.collect():
        made.setdefault((r.task, r.round), []).append((r.seq, r.tool_name, r.outcome, r.message))
    assert len(got) == 400 and ends.count() == 400
    for k in range(400):
        good, rounds, seen = loops.retried(lambda prompt, n, k=k: calls_of(k, n, prompt), f"do {k}")
        assert got[k] == (good, rounds)
        for n, records in enumerate(seen, 1):
            assert sorted(made.pop((k, n), [])) == [(j, *x) for j, x in enumerate(records, 1)]
    assert not made and {r.error[:4] for r in ends.collect() if r.error} == {"down"}


def test_verify_runs_of_many_tasks_are_those_of_each(spark):
    ship(spark)
    tasks = spark.range(300).select(F.col("id").alias("task"), F.concat(F.lit("do "), "id").alias("description"))
    digit = lambda *by: (F.col("task") * by[0] + F.col("round") * by[1]) % by[2]
    run = lambda rows: rows.select("task", F.when(digit(3, 5, 13) == 0, "down").alias("error"), "prompt")
    between = lambda rows: rows.select("task", F.when(digit(5, 3, 17) == 0, "hook").alias("error"))

    def verify(rows):
        checks = rows.select("task", (digit(1, 1, 4) == 0).alias("passed"), F.concat(F.lit(" d"), "round", F.lit("\n")).alias("diag"), F.when(digit(7, 2, 19) == 0, "broken").alias("error"))
        return checks, rows.where(digit(1, 0, 3) == 0).select("task", F.lit(1).alias("seq"), F.lit("m").alias("name"), F.when(digit(1, 1, 5) == 0, "PASS").otherwise("FAIL").alias("status"), F.lit("x").alias("detail"))

    ends, told = replay.verified(tasks, run, verify, 3, between, lambda task, k: (task + k) % 23 == 0)
    got = {r.task: (r.outcome, r.passed, r.rounds) for r in ends.collect()}
    blocks = {}
    for r in told.orderBy("round").collect():
        blocks.setdefault(r.task, []).append(r.block)
    assert len(got) == 300 and ends.count() == 300
    for k in range(300):
        n = [0]

        def fail(text, bad):
            if bad:
                raise RuntimeError(text)

        def check(j, k=k):
            fail("broken", (k * 7 + j * 2) % 19 == 0)
            return loops.Verdict((k + j) % 4 == 0, f" d{j}\n", [("m", "PASS" if (k + j) % 5 == 0 else "FAIL", "x")] if k % 3 == 0 else [])

        def once(prompt, k=k):
            fail("down", (k * 3 + n[0] * 5) % 13 == 0)

        def cancelled(k=k):
            n[0] += 1
            return (k + n[0]) % 23 == 0

        want = loops.run_task(once, check, f"do {k}", 3, lambda j, k=k: fail("hook", (k * 5 + j * 3) % 17 == 0), cancelled)
        assert got[k] == (want.outcome, want.passed, want.rounds), k
        assert blocks.get(k, []) == want.history
    assert {x[0] for x in got.values()} == set(loops.OUTCOMES) - {"no-verify"}


def test_without_verification_one_round_is_run(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "b")], "task int, description string")
    ends, told = replay.verified(tasks, lambda rows: rows.select("task", F.when(F.col("task") == 2, "down").alias("error")), None)
    assert {r.task: (r.outcome, r.rounds, r.error) for r in ends.collect()} == {1: ("no-verify", 1, None), 2: ("llm-error", 1, "down")} and told.count() == 0


def test_no_tasks(spark):
    none = spark.createDataFrame([], "task int, prompt string")
    ends, calls = replay.retried(none, replay.mapped(calls_of))
    assert ends.count() == 0 and calls.count() == 0

"""The retry loop and the verify loop over many tasks at once: the state of all loops is a table, and a round is a job over the unfinished ones.

What a task does in a round is a function from a table to a table: a join with what is recorded, or a call for each row (``mapped``). A round's
answers are taken in, the state is checkpointed, and the loop ends when no task is left or the rounds are used up. Tasks are independent, so a
round's job is as wide as its tasks. ``loops.retried`` and ``loops.run_task`` say the same for one task in plain Python.

Tables: tasks (task, prompt); a state adds round, done, success, outcome, error. ``task`` tells tasks apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.shared import ensure_checkpoints
from tarnfold.operators import loops

Step = Callable[[DataFrame], DataFrame]
CALLS = "seq int, tool_name string, outcome string, message string, error string"


def mapped(call: Callable[[object, int, str], list[tuple[str, str, str]]]) -> Step:
    """A step out of a function of task, round and prompt that gives (tool_name, outcome, message) for each call; what it raises is the task's error."""

    def step(active: DataFrame) -> DataFrame:
        kind = active.schema["task"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                for task, round_, prompt in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    try:
                        rows += [(task, k, *x, None) for k, x in enumerate(call(task, round_, prompt), 1)]
                    except Exception as e:  # a model's failure ends its own task alone
                        rows.append((task, 0, None, None, None, str(e) or type(e).__name__))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                types = (b.schema.types[0], pa.int32(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["task", "seq", "tool_name", "outcome", "message", "error"])

        return active.select("task", "round", "prompt").mapInArrow(run, f"task {kind}, {CALLS}")

    return step


def retried(tasks: DataFrame, attempt: Step, most: int = loops.ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The end of every task (task, rounds, success, error, prompt of its last round), and all calls (task, round, seq, tool_name, outcome, message).

    ``attempt`` gives calls (task, seq, tool_name, outcome, message, error) of unfinished tasks (task, round, prompt). A task ends well when it calls nothing or
    all calls succeed, and badly on an error or when its rounds are used up.
    """
    ensure_checkpoints(tasks.sparkSession)
    active = tasks.select("task", "prompt")
    ended, calls = [], []
    for k in range(1, most + 1):
        now = active.withColumn("round", F.lit(k))
        made = attempt(now).select("task", F.lit(k).alias("round"), "seq", "tool_name", "outcome", "message", "error").checkpoint()
        calls.append(made.where("error is null").drop("error"))
        errors = made.where("error is not null").groupBy("task").agg(F.min("error").alias("error"))
        rolled = loops.rounds(made.where("error is null"), "task").select("task", "all_ok", "summary")
        state = now.join(rolled, "task", "left").join(errors, "task", "left")
        good = F.col("error").isNull() & F.coalesce("all_ok", F.lit(True))
        state = state.select("task", "prompt", "round", good.alias("success"), "error", "summary", (good | F.col("error").isNotNull() | F.lit(k == most)).alias("done")).checkpoint()
        ended.append(state.where("done").select("task", F.col("round").alias("rounds"), "success", "error", "prompt"))
        rest = state.where("not done")
        if k == most or rest.isEmpty():
            break
        active = rest.select("task", loops.retry_prompt(F.col("prompt"), F.col("round"), F.col("summary")).alias("prompt"))
    return _all(ended), _all(calls)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def verified(tasks: DataFrame, run: Step, verify: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None, most: int = loops.ROUNDS, between: Step | None = None, cancelled: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The end of every task (task, outcome, passed, rounds, error, diag), and what its rounds were told of each other (task, round, block).

    ``tasks`` have task and description. ``run`` and ``between`` give (task, error) of tasks (task, round, prompt); a task that they do not name went well.
    ``verify`` gives checks (task, passed, diag, error) and metrics (task, seq, name, status, detail) of tasks (task, round); metrics overrule the flag, and
    a task without a check has not passed. ``cancelled`` tells by task and round whether a round is not to begin.
    """
    spark = tasks.sparkSession
    ensure_checkpoints(spark)
    own = tasks.select("task", "description")
    ended, blocks = [], []
    nothing = own.limit(0).select("task", F.lit(None).cast("string").alias("error"))

    def close(rows: DataFrame, outcome: Column, rounds: int) -> None:
        text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
        ended.append(rows.select("task", outcome.alias("outcome"), outcome.isin("noop-initial-passed", "verify-passed").alias("passed"), F.lit(rounds).alias("rounds"), text("error").alias("error"), text("diag").alias("diag")))

    def checked(active: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Verdicts (task, good, diag, error) and history rows of a round."""
        checks, metrics = verify(active.select("task", F.lit(k).alias("round")))
        checks = active.select("task").join(checks.select("task", "passed", "diag", "error"), "task", "left").withColumn("round", F.lit(k)).checkpoint()
        metrics = metrics.withColumn("round", F.lit(k)).join(checks.where("error is null").select("task"), "task", "left_semi").checkpoint()
        verdict = loops.verdicts(checks.where("error is null"), metrics).select("task", F.coalesce("passed", F.lit(False)).alias("good"))
        told = loops.history(checks.where("error is null"), metrics)
        return checks.join(verdict, "task", "left").select("task", "good", "diag", "error"), told

    active, diags = own, own.select("task", F.lit("").alias("diag"))
    if verify is not None:
        state, _ = checked(active, 0)
        state = state.checkpoint()
        close(state.where("error is not null"), F.lit("initial-verify-error"), 0)
        close(state.where("error is null and good"), F.lit("noop-initial-passed"), 0)
        diags = state.select("task", "diag")
        active = own.join(state.where("error is null and not good").select("task"), "task", "left_semi").checkpoint()
    for k in range(1, most + 1):
        if active.isEmpty():
            break
        if cancelled is not None:
            stop = F.coalesce(cancelled(F.col("task"), F.lit(k)), F.lit(False))
            close(active.where(stop).join(diags, "task", "left"), F.lit("ctx-cancelled"), k - 1)
            active = active.where(~stop)
        told = _all(blocks) if blocks else spark.createDataFrame([], f"task {own.schema['task'].dataType.simpleString()}, round int, block string")
        now = loops.prompts(told, active.join(diags, "task", "left").withColumn("round", F.lit(k)))
        failed = run(now).where("error is not null").groupBy("task").agg(F.min("error").alias("error")).checkpoint()
        close(failed.join(diags, "task", "left"), F.lit("llm-error"), k)
        active = active.join(failed, "task", "left_anti")
        hooked = between(now.join(failed, "task", "left_anti")).where("error is not null").groupBy("task").agg(F.min("error").alias("error")).checkpoint() if between is not None else nothing
        close(hooked.join(diags, "task", "left"), F.lit("hook-error"), k)
        active = active.join(hooked, "task", "left_anti")
        if verify is None:
            close(active, F.lit("no-verify"), k)
            break
        state, block = checked(active, k)
        state = state.checkpoint()
        blocks.append(block.checkpoint())
        close(state.where("error is not null"), F.lit("verify-error"), k)
        close(state.where("error is null and good"), F.lit("verify-passed"), k)
        diags = state.select("task", "diag")
        rest = state.where("error is null and not good")
        if k == most:
            close(rest, F.lit("max-rounds-exhausted"), k)
        active = own.join(rest.select("task"), "task", "left_semi").checkpoint()
    history = _all(blocks) if blocks else spark.createDataFrame([], f"task {own.schema['task'].dataType.simpleString()}, round int, block string")
    return _all(ended), history

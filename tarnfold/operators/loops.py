"""Rollups and texts of the edit and verify loops."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import text as tx

# How a task can end, and the limits of both loops.
OUTCOMES = ("initial-verify-error", "noop-initial-passed", "ctx-cancelled", "llm-error", "hook-error", "no-verify", "verify-error", "verify-passed", "max-rounds-exhausted")
ROUNDS = 3
DONE = ("applied", "noop")
RETRY = "Some calls of the last attempt failed. Their outcomes follow: repair what failed, and leave what went well as it is."


def ok(outcome: Column) -> Column:
    return F.coalesce(outcome.isin(*DONE), F.lit(False))


def rounds(records: DataFrame, *keys: str) -> DataFrame:
    """Per round (and further keys) of tool records (round, seq, tool_name, outcome, message): all_ok, any_failure, failed, calls, summary."""
    rows = records.withColumn("ok", ok(F.col("outcome")))
    line = F.concat(F.when(F.col("ok"), "OK").otherwise("FAILED"), F.lit(" "), F.coalesce("tool_name", F.lit("")), F.lit(": outcome="), F.coalesce("outcome", F.lit("")), F.lit("; message="), F.coalesce("message", F.lit("")), F.lit("\n"))
    return rows.withColumn("line", line).groupBy(*keys, "round").agg(
        F.bool_and("ok").alias("all_ok"),
        F.bool_or(~F.col("ok")).alias("any_failure"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count(F.lit(1)).alias("calls"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["line"])), "").alias("summary"),
    )


def statuses(metrics: DataFrame) -> DataFrame:
    """task, round, counts: how many metrics of a round have each status, whatever statuses there are."""
    per = metrics.groupBy("task", "round", F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("task", "round").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))


def verdicts(checks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per check (task, round, passed): passed if all its metrics PASS, or by its own flag where it has none; counts by status."""
    per = metrics.groupBy("task", "round").agg(F.bool_and(F.coalesce(F.col("status") == "PASS", F.lit(False))).alias("all_pass"), F.count(F.lit(1)).alias("n_metrics"), *(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "FAIL", "ERROR")))
    joined = checks.join(per, ["task", "round"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("task", "round", F.coalesce("all_pass", "passed").alias("passed"), n("n_metrics"), n("n_pass"), n("n_fail"), n("n_error"))


def history(checks: DataFrame, metrics: DataFrame) -> DataFrame:
    """task, round, block: what later rounds are told of a round."""
    line = F.concat(F.lit("  - "), F.col("name"), F.lit(": "), F.col("status"), F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" ("), F.col("detail"), F.lit(")"))).otherwise(""), F.lit("\n"))
    lines = metrics.withColumn("line", line).groupBy("task", "round").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "").alias("lines"))
    diag = F.coalesce("diag", F.lit(""))
    block = F.concat(
        F.lit('<round n="'), F.col("round").cast("string"), F.lit('">\n'),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit("metrics:\n"), F.col("lines"))).otherwise(""),
        F.when(diag != "", F.concat(F.lit("diag:\n"), tx.trim_ws(diag), F.lit("\n"))).otherwise(""),
        F.lit("</round>"),
    )
    return checks.join(lines, ["task", "round"], "left").select("task", "round", block.alias("block"))


def prompts(history_rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, round, prompt: the first round sees the first diagnosis, later ones the rounds before them."""
    earlier = history_rows.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("round", "block"))).alias("all"))
    told = F.concat(F.lit("\n\n<previous_rounds>\n"), F.array_join(F.transform(F.filter("all", lambda x: x["round"] < F.col("round")), lambda x: F.concat(x["block"], F.lit("\n"))), ""), F.lit("</previous_rounds>"))
    first = F.when(F.coalesce("diag", F.lit("")) != "", F.concat(F.lit("\n\n<initial_verification>\n"), tx.trim_ws(F.col("diag")), F.lit("\n</initial_verification>"))).otherwise("")
    some = F.exists(F.coalesce("all", F.array().cast("array<struct<round:int,block:string>>")), lambda x: x["round"] < F.col("round"))
    return tasks.join(earlier, "task", "left").select("task", "round", F.concat(F.col("description"), F.when(F.col("round") == 1, first).when(some, told).otherwise("")).alias("prompt"))


def retry_prompt(prompt: Column, round_: Column, summary: Column) -> Column:
    """A prompt with what failed in the round before."""
    told = RETRY + "\n"
    return F.concat(prompt, F.lit('\n\n<previous_attempt round="'), round_.cast("string"), F.lit('">\n' + told), tx.right_trim_newlines(summary), F.lit("\n</previous_attempt>"))


def archive_id(tag: Column, ts: Column) -> Column:
    return F.concat(F.coalesce(F.when(tag != "", tag), F.lit("task")), F.lit("-"), F.date_format(ts, "yyyyMMdd-HHmmss"))


def archive_json(results: DataFrame) -> DataFrame:
    """id, ts, summary of task results; null fields are left out, fields stand by name."""
    fields = [c for c in ("description", "last_diag", "metrics", "outcome", "passed", "reflections", "rounds", "tag") if c in results.columns]
    return results.select(archive_id(F.col("tag"), F.col("ended")).alias("id"), F.unix_timestamp("ended").alias("ts"), F.to_json(F.struct(*fields)).alias("summary"))


def expected(verdict_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Audit verdicts against expectations: MATCH, MISMATCH or MISSING for each scenario wanted."""
    got = verdict_rows.select("scenario", "verdict")
    state = F.when(F.col("verdict").isNull(), "MISSING").when(F.col("verdict") == F.col("wanted"), "MATCH").otherwise("MISMATCH")
    return wanted.join(got, "scenario", "left").select("scenario", "wanted", "verdict", state.alias("state"))


@dataclass
class Verdict:
    """What a verification says: a flag, a diagnosis, and metrics (name, status, detail) that overrule the flag."""

    passed: bool = False
    diag: str = ""
    metrics: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def good(self) -> bool:
        return all(status == "PASS" for _, status, _ in self.metrics) if self.metrics else self.passed

    def block(self, round_: int) -> str:
        """What later rounds are told of this one, as ``history`` writes it."""
        lines = "".join(f"  - {name}: {status}" + (f" ({detail})" if detail else "") + "\n" for name, status, detail in self.metrics)
        return f'<round n="{round_}">\n' + ("metrics:\n" + lines if lines else "") + (f"diag:\n{self.diag.strip()}\n" if self.diag else "") + "</round>"


@dataclass
class Outcome:
    outcome: str
    passed: bool
    rounds: int
    history: list[str] = field(default_factory=list)
    reflections: list[str] = field(default_factory=list)
    last: Verdict | None = None
    error: str = ""


def archived(end: Outcome, description: str, tag: str = "", ended: datetime | None = None) -> tuple[str, int, str]:
    """Id, time and JSON text of a task's end, as ``archive_json`` writes them: fields by name, empty optional ones left out."""
    ended = ended or datetime.now()
    fields = {"description": description, "last_diag": end.last.diag if end.last else "", "outcome": end.outcome, "passed": end.passed, "rounds": end.rounds}
    optional = {"metrics": {name: {"status": status, "detail": detail} for name, status, detail in end.last.metrics} if end.last else {}, "reflections": end.reflections, "tag": tag}
    text = json.dumps(fields | {k: v for k, v in optional.items() if v}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return f"{tag or 'task'}-{ended:%Y%m%d-%H%M%S}", int(ended.timestamp()), text


def retried(attempt: Callable[[str, int], list[tuple[str, str, str]]], prompt: str, most: int = ROUNDS) -> tuple[bool, int, list[list[tuple[str, str, str]]]]:
    """Calls ``attempt`` until no tool is called, all calls succeed or the rounds are used up."""
    seen, told = [], prompt
    for k in range(1, most + 1):
        try:
            records = attempt(told, k)
        except Exception:  # a model's failure ends the loop, what was done stays on record
            return False, k, seen
        seen.append(records)
        failed = [r for r in records if r[1] not in DONE]
        if not failed:
            return True, k, seen
        lines = "".join(f"[{i}] {'OK' if o in DONE else 'FAILED'} {t}: outcome={o}; message={m}\n" for i, (t, o, m) in enumerate(records, 1))
        told = f'{told}\n\n<previous_attempt round="{k}">\n{RETRY}\n{lines}</previous_attempt>'
    return False, most, seen


def run_task(
    run: Callable[[str], None],
    verify: Callable[[int], bool | Verdict] | None,
    description: str,
    most: int = ROUNDS,
    between: Callable[[int], None] | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    reflections: list[str] | None = None,
    archive: Callable[[Outcome], None] | None = None,
) -> Outcome:
    """The verify loop: verify, and while that fails run and verify again, at most so many rounds.

    The first round is told the first diagnosis, later ones of all rounds before them. ``archive`` gets every
    ending; ``reflections`` is the list that the run's tools add to.
    """
    blocks: list[str] = []
    last: Verdict | None = None

    def end(outcome: str, rounds_: int, error: Exception | str = "") -> Outcome:
        out = Outcome(outcome, outcome in ("noop-initial-passed", "verify-passed"), rounds_, [*blocks], [*(reflections or ())], last, str(error))
        if archive is not None:
            archive(out)
        return out

    def checked(k: int) -> Verdict:
        got = verify(k)
        return got if isinstance(got, Verdict) else Verdict(bool(got))

    def told(k: int) -> str:
        if k == 1:
            first = last.diag.strip() if last else ""
            return f"{description}\n\n<initial_verification>\n{first}\n</initial_verification>" if first else description
        return f"{description}\n\n<previous_rounds>\n" + "".join(b + "\n" for b in blocks) + "</previous_rounds>" if blocks else description

    if verify is not None:
        try:
            last = checked(0)
        except Exception as e:
            return end("initial-verify-error", 0, e)
        if last.good:
            return end("noop-initial-passed", 0)
    for k in range(1, most + 1):
        if cancelled():
            return end("ctx-cancelled", k - 1)
        try:
            run(told(k))
        except Exception as e:
            return end("llm-error", k, e)
        if between is not None:
            try:
                between(k)
            except Exception as e:
                return end("hook-error", k, e)
        if verify is None:
            return end("no-verify", k)
        try:
            last = checked(k)
        except Exception as e:
            return end("verify-error", k, e)
        blocks.append(last.block(k))
        if last.good:
            return end("verify-passed", k)
    return end("max-rounds-exhausted", most)

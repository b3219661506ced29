"""Registered queries of the library's own operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import ids
from tarnfold.functions import text as tx
from tarnfold.functions.shared import ensure_checkpoints, own_folder
from tarnfold.operators import audit, catalog, code, edits, loops, markdown, memory, rendering, replay, selection, templates, tools
from tarnfold.plans import corpus, twins
from tarnfold.plans.corpus import read
from tarnfold.plans.engine import Engine
from tarnfold.plans.workers import ship
from tarnfold.sources import notes, tree

Query = Callable[[SparkSession, str], DataFrame]
PROMPT = twins.PROMPT


def corpus_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the whole corpus by top folder: how many, how many supported and visible, their characters."""
    every = corpus.conversation_files(spark, sf_dir).unionByName(corpus.document_files(spark, sf_dir).drop("doc_id")).unionByName(corpus.page_files(spark, sf_dir))
    taken = tx.supported(F.col("path")) & tx.visible(F.col("path"))
    return every.groupBy(F.split("path", "/")[0].alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.count_if(taken).alias("taken"), F.sum(F.char_length("content")).alias("chars"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return markdown.sections(corpus.conversation_files(spark, sf_dir))


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("path", "ordinal", "kind", "name", "body", F.array_join("refs", " ").alias("refs"))


def md_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.page_files(spark, sf_dir).withColumn("refs", tx.markdown_refs(F.col("content")))
    return rows.select("path", F.size("refs").alias("n_refs"), F.array_join("refs", " ").alias("refs"))


def script_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.page_files(spark, sf_dir).withColumn("refs", tx.script_refs(F.col("content")))
    return rows.select("path", F.size("refs").alias("n_refs"), F.array_join("refs", " ").alias("refs"))


def chunk_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("  // "), F.col("role"), F.lit("\n\n* "), F.col("role"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n\t "), F.col("text"))).otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.signature(body).alias("signature"), tx.qualified(F.col("conv_id").cast("string"), F.col("role")).alias("qualified"))


def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, later = corpus.snapshots(spark, sf_dir)
    return catalog.changes(later, files).select("path", "status")


def prune_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, later = corpus.snapshots(spark, sf_dir)
    return catalog.gone(files, later).select("path", "hash")


def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, later = corpus.snapshots(spark, sf_dir)
    changed = catalog.changes(later, files)
    return catalog.report(changed, catalog.gone(files, later), changed.where("status = 'PARSE'"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("ordinal"), F.col("role").alias("name"), F.lit("Section").alias("kind"))
    old = rows.withColumn("id", F.concat_ws(":", "path", "ordinal"))
    return old, rows.where("ordinal % 3 <> 1")


def stable_id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return catalog.matched(new, old).select("path", "name", "ordinal", F.col("occ").cast("long"), "old_id")


def evicted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return catalog.evicted(new, old).select("path", "name", "ordinal", "id")


def upserted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose id is even are replaced by their shorter version, the rest stays."""
    old, new = _versions(spark, sf_dir)
    again = new.where("cast(substring(path, 6) as bigint) % 2 = 0").withColumn("id", F.lit("new"))
    return catalog.upsert(old, again, again.select("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == "new").alias("n_new"))


def triage_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return selection.shards(rows, 50, "conv_id", "turn", "role").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    named = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("ref"))
    refs = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 7)).alias("key")).join(named, "key").groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.floor(F.col("p_partkey") / 50).cast("int").alias("shard"), F.col("p_type").alias("kind"), F.col("p_brand").alias("path"))
    return rows.join(refs, "id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def rule_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rule_policy(PROMPT, _parts(spark, sf_dir)).select("chunk_id", "mode", "reason")


def shard_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("signature", F.col("name"))
    return selection.listing(rows.select("shard", "id", "kind", "name", "path", "signature"), "shard")


def decision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.merge(corpus.votes(spark, sf_dir), "seq")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def coverage_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.covered(_customers(spark, sf_dir), decision_merge(spark, sf_dir))


def decision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.histogram(coverage_default(spark, sf_dir))


def expand_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons whose customer has a positive balance are raised to FULL by the second pass; nothing is lowered."""
    ensure_checkpoints(spark)
    first = coverage_default(spark, sf_dir).checkpoint()  # read twice below
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    more = selection.skeletons(rich, first).select(F.col("id").alias("chunk_id"), F.lit("FULL").alias("mode"), F.lit("expanded").alias("reason"), F.lit(2).alias("pass"))
    return selection.merge(first.withColumn("pass", F.lit(1)).unionByName(more), "pass")


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = read(spark, sf_dir, "conversations")
    chunks = t.select(F.concat(F.lit('c"'), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("ordinal"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("Section").alias("kind"), F.col("role").alias("name"), F.concat(F.lit("// x\n"), F.col("text")).alias("body"))
    mode = F.when(F.col("turn") % 3 == 0, "FULL").otherwise("SKELETON")
    return chunks, t.where("turn % 3 < 2").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), mode.alias("mode"))


def context_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.file_blocks(*_decided(spark, sf_dir))


def context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.totals(context_file_blocks(spark, sf_dir))


def apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve kinds of edits, dealt to the documents by their number, each with its outcome."""
    ship(spark)
    d = corpus.document_files(spark, sf_dir)
    files = d.select("path", "content")
    chunks = d.select("path", F.lit(0).alias("ordinal"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.lit("Preamble").alias("kind"), F.lit("preamble").alias("name"), F.col("content").alias("body"))
    k, own = F.col("doc_id") % 12, F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    pick = lambda *cases: F.element_at(F.array(*(x if not isinstance(x, str | None) else F.lit(x).cast("string") for x in cases)), (k + 1).cast("int"))
    there, new = F.col("path"), F.concat(F.lit("new/"), F.col("path"))
    mods = d.select(
        F.col("doc_id").cast("int").alias("seq"),
        pick("MODIFY", "MODIFY", "MODIFY", "DELETE_CHUNK", "DELETE_CHUNK", "ADD_CHUNK", "ADD_CHUNK", "CREATE_FILE", "CREATE_FILE", "DELETE_FILE", "DELETE_FILE", "RENAME").alias("action"),
        pick(own, own, "nowhere", own, "", None, None, None, None, None, None, None).alias("chunk_id"),
        pick(None, None, None, None, None, there, new, new, there, there, new, there).alias("file_path"),
        pick("fresh text", "", "fresh text", None, None, "## More\ntext", "text", "# New\n", "# New\n", None, None, "text").alias("new_content"),
    )
    return edits.apply(mods, files, chunks).select("seq", "outcome")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("\n"), F.substring(F.col("text"), F.lit(11), F.lit(20)), F.lit("  "))
    whole = F.concat(F.substring("text", 1, 10), F.lit("\n\n\n"), F.substring("text", 11, 20), F.lit("\n\n\n"), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", whole.alias("content"), body.alias("body"))


def splice_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, size = tx.find_body(F.col("content"), F.col("body"))
    return _bodies(spark, sf_dir).select("doc_id", at.alias("found"), F.md5(F.when(at > 0, tx.splice(F.col("content"), at, size, F.lit("<new>"))).otherwise(F.col("content"))).alias("after"))


def splice_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten characters' neighbour goes, and surplus blank lines with it."""
    size = F.greatest(F.lit(0), F.least(F.lit(20), F.char_length("content") - 13))
    return _bodies(spark, sf_dir).select("doc_id", F.md5(tx.cut(F.col("content"), F.lit(14), size)).alias("after"))


def append_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    ended = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.col("text"), F.repeat(F.lit("\n"), (F.col("doc_id") % 4).cast("int"))))
    return d.select("doc_id", F.md5(F.concat(tx.end_separated(ended), F.lit("## Added\n"))).alias("after"))


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as paths with eight extensions: language, whether supported, whether visible."""
    p = read(spark, sf_dir, "part")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".go", ".TS", ".tsx", ".js", ".jsx", ".md", ".markdown", ".py"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    folder = F.when(F.col("p_size") % 4 == 0, "vendor/").when(F.col("p_size") % 4 == 1, ".hidden/").when(F.col("p_size") % 4 == 2, "src/").otherwise("")
    path = F.concat(F.lit("./"), folder, F.replace("p_name", F.lit(" "), F.lit("_")), ext)
    rows = p.select("p_partkey", tx.normal_path(path).alias("path"))
    return rows.select("p_partkey", "path", tx.language(F.col("path")).alias("language"), tx.supported(F.col("path")).alias("supported"), tx.visible(F.col("path")).alias("visible"))


def round_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.rounds(corpus.tool_records(spark, sf_dir)).withColumn("summary", F.md5("summary"))


def retry_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = loops.rounds(corpus.tool_records(spark, sf_dir)).where("any_failure")
    return r.select("round", F.md5(loops.retry_prompt(F.lit("task"), F.col("round"), F.col("summary"))).alias("prompt"))


def verify_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.verdicts(corpus.check_rows(spark, sf_dir), corpus.metric_rows(spark, sf_dir))


def history_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.history(corpus.check_rows(spark, sf_dir), corpus.metric_rows(spark, sf_dir)).withColumn("block", F.md5("block"))


def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = corpus.check_rows(spark, sf_dir)
    tasks = checks.where("round > 0").select("task", "round", "diag", F.concat(F.lit("Task "), F.col("task").cast("string")).alias("description"))
    return loops.prompts(loops.history(checks, corpus.metric_rows(spark, sf_dir)), tasks).withColumn("prompt", F.md5("prompt"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id"), F.unix_timestamp("ts").alias("ts"), F.col("props").alias("summary"))


def session_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest_sessions(memory.keep_latest(_sessions(spark, sf_dir)))


def history_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.history_block(memory.keep_latest(_sessions(spark, sf_dir)))


def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.keep_latest(_sessions(spark, sf_dir))


def scenario_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst event of a user is its verdict; every customer is a scenario that should PASS."""
    verdict = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scenario")).agg(F.when(F.max(F.when(F.col("event_type") == "error", F.col("value"))) > 60, "FAIL").otherwise("PASS").alias("verdict"))
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario"), F.lit("PASS").alias("wanted"))
    return loops.expected(verdict, wanted)


def archive_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS")
    metrics = F.when(F.col("event_id") % 3 > 0, F.create_map(F.concat(F.lit("m"), F.col("event_id").cast("string")), F.struct(F.get_json_object("props", "$.k").alias("detail"), status.alias("status"))))
    reflections = F.when(F.col("event_id") % 5 == 0, F.array(F.concat(F.lit("saw "), "event_type"), F.lit('a "quote"')))
    rows = e.select(F.col("event_type").alias("description"), F.when(F.col("event_id") % 2 == 0, F.lit("fix")).alias("tag"), F.lit("verify-passed").alias("outcome"), (F.col("event_type") != "error").alias("passed"), F.lit(3).alias("rounds"), metrics.alias("metrics"), reflections.alias("reflections"), F.date_trunc("second", "ts").alias("ended"))
    return loops.archive_json(rows)


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    verdict = F.element_at(F.array(*(F.lit(x) for x in ("PASS", "FAIL", "PARTIAL", "INFRA_FAIL", "ODD"))), (F.col("event_id") % 5 + 1).cast("int"))
    one = F.format_string('{"perScenario": [{"scenarioId": "s%s", "verdict": "%s", "score": %s, "evidence": [%s]}], "rootCauses": [{"issue": "i%s", "suggestedFix": {"target": "t", "file": "f"}}]}', F.col("user_id").cast("string"), verdict, F.floor("value").cast("string"), F.when(F.col("event_type") == "error", F.lit('"seen"')).otherwise(""), F.col("event_id").cast("string"))
    return e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("no json")).otherwise(F.concat(F.lit(" ```json\n"), one, F.lit("\n```\n"))).alias("response"))


def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.metrics(_audits(spark, sf_dir), "event_id")


def audit_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.causes(_audits(spark, sf_dir), "event_id")


def audit_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("scenario"), F.lit("PASS").alias("wanted"))
    return audit.exit_codes(audit_metrics(spark, sf_dir), wanted, "event_id", strict=True)


def unanswered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a request, every event a result."""
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return tools.unanswered(asked, read(spark, sf_dir, "events").select(F.col("user_id").alias("path")))


def insight_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts with white space at both ends as insights, and a blank insight beside every ninth: trimmed, blank ones gone; digests."""
    d = read(spark, sf_dir, "documents")
    whole = d.select("doc_id", F.concat(F.lit(" \n"), "text", F.lit("\t ")).alias("insight"))
    blank = d.where("doc_id % 9 = 0").select("doc_id", F.lit(" \n\t ").alias("insight"))
    return tools.insights(whole.unionByName(blank)).select("doc_id", F.md5("insight").alias("insight"))


def list_and_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma parts and indented lines of whole texts, as digests."""
    d = read(spark, sf_dir, "documents").select("doc_id", tx.listed(F.col("text")).alias("parts"), tx.indented(F.col("text"), "> ").alias("quoted"))
    return d.select("doc_id", F.size("parts").alias("n_parts"), F.md5(F.array_join("parts", "|")).alias("parts"), F.md5("quoted").alias("quoted"))


def _chunks(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    return code.chunks(files).select("path", "ordinal", "kind", "name", F.md5("body").alias("body"), F.array_join(F.array_sort("refs"), " ").alias("refs"))


def go_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go file for every part: documented and grouped types, methods, a generic function, braces in strings and comments."""
    return _chunks(corpus.go_files(spark, sf_dir))


def go_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Go files of pieces that a part's key picks: embedded fields, type parameters, grouped types, literals in heads, type switches."""
    return _chunks(corpus.mixed_go_files(spark, sf_dir))


def script_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files of pieces that a part's key picks: regular expressions with quotes, nested templates, elements, decorators, types over lines, several statements in a line."""
    ship(spark)
    return code.chunks(corpus.mixed_script_files(spark, sf_dir)).select("path", "ordinal", "kind", "name", F.md5("body").alias("body"))


def script_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script file for every part: members of every kind of name, accessors, several declarators, a nameless default."""
    return _chunks(corpus.script_files(spark, sf_dir))


def code_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the Go files: whole code, code that is broken, and code that balances only in its place."""
    ship(spark)
    ensure_checkpoints(spark)
    files = corpus.go_files(spark, sf_dir)
    chunks = code.chunks(files).where("name like 'Make%'").select("path", "ordinal", F.col("name").alias("id"), "kind", "name", "body").checkpoint()  # asked for twice, read once
    key = F.regexp_extract("path", r"(\d+)", 1).cast("int")
    new = F.element_at(F.array(*(F.lit(x) for x in ("func Made() {}", "func Made( {", "}\n\nfunc Made() {"))), key % 3 + 1)
    mods = files.select(key.alias("seq"), F.lit("MODIFY").alias("action"), F.concat(F.lit("Make"), key.cast("string")).alias("chunk_id"), F.lit(None).cast("string").alias("file_path"), new.alias("new_content"))
    return edits.apply(mods, files, chunks).select("seq", "path", "outcome", F.size("affected").alias("n_affected"), F.md5("content").alias("content"))


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files that executors wrote, listed level by level and read back."""
    root = corpus.written(corpus.tree_files(spark, sf_dir), "tree")
    return tree.with_content(tree.listed(spark, root)).select("path", "ext", F.md5("content").alias("content"))


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and skills out of files; broken sessions are passed over."""
    root = corpus.written(corpus.note_files(spark, sf_dir), "notes")
    sessions = notes.session_files(spark, f"{root}/sessions").select(F.lit("session").alias("what"), F.col("id").alias("name"), "ts", F.col("summary").alias("text"))
    skills = notes.skill_files(spark, f"{root}/skills").select(F.lit("skill").alias("what"), "name", F.lit(None).cast("long").alias("ts"), F.col("content").alias("text"))
    return sessions.unionByName(skills)


def engine_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after a tree of Go files was indexed, edited twice a file or deleted, and committed: ids stay with chunks that stay."""
    engine = Engine(spark, corpus.written(corpus.go_files(spark, sf_dir), "sources"), own_folder(spark, "store"))
    engine.index(1)
    before = engine.chunks()
    key, gone = F.regexp_extract("path", r"(\d+)", 1).cast("long"), F.col("k") % 5 == 0
    made = before.where("name like 'Make%'").select(key.alias("k"), "id", "path")
    first = made.select((F.col("k") * 2).alias("seq"), F.when(gone, "DELETE_FILE").otherwise("MODIFY").alias("action"), F.when(~gone, F.col("id")).alias("chunk_id"), F.when(gone, F.col("path")).alias("file_path"), F.when(~gone, F.concat(F.lit("func Make"), "k", F.lit("() {}"))).alias("new_content"))
    second = made.where(~gone).select((F.col("k") * 2 + 1).alias("seq"), F.lit("ADD_CHUNK").alias("action"), F.lit(None).cast("string").alias("chunk_id"), F.col("path").alias("file_path"), F.concat(F.lit("func Added"), "k", F.lit("() {}")).alias("new_content"))
    results = engine.apply(first.unionByName(second), 2)
    good = results.groupBy("path").agg(F.bool_and(F.col("outcome") == "applied").alias("applied"))
    old = before.select("path", "name", F.col("id").alias("old_id"))
    now = engine.chunks().join(old, ["path", "name"], "left").select("path", "ordinal", "kind", "name", F.md5("body").alias("body"), F.coalesce(F.col("id") == F.col("old_id"), F.lit(False)).alias("same_id"))
    return now.join(good, "path", "left")


def skill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled from every part: branches, loops with indexes, variables, pipelines, trim marks, maps and structs."""
    ship(spark)
    p = read(spark, sf_dir, "part")
    words = F.split(F.when(F.col("p_partkey") % 9 == 0, F.lit(None)).otherwise(F.col("p_name")), " ")
    limits = F.create_map(F.lit("low"), F.col("p_size") - 1, F.lit("high"), F.col("p_size") + 1)
    values = F.struct(F.col("p_brand").alias("Brand"), F.col("p_size").alias("Size"), F.col("p_retailprice").alias("Price"), words.alias("Words"), limits.alias("Limits"), F.struct(F.col("p_type").alias("Type")).alias("Own"))
    return templates.filled(p.select("p_partkey", "p_brand", "p_size", "p_retailprice", "p_name", "p_type"), corpus.CARD, values).select("p_partkey", "text", "error")


def retry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retry loop of every user at once, calls as events have them."""
    script = corpus.scripted_calls(spark, sf_dir)
    tasks = script.select("task").distinct().select("task", F.concat(F.lit("Task "), "task").alias("prompt"))
    ends, calls = replay.retried(tasks, lambda active: active.join(script, ["task", "round"]).select("task", "seq", "tool_name", "outcome", "message", "error"))
    made = calls.groupBy("task").agg(F.count(F.lit(1)).alias("calls"))
    return ends.join(made, "task", "left").select("task", "rounds", "success", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.md5("prompt").alias("prompt"))


def verify_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verify loop of every customer at once: all ways that it can end, and what the rounds were told."""
    checks, metrics = corpus.check_rows(spark, sf_dir), corpus.metric_rows(spark, sf_dir)
    tasks = checks.select("task").distinct().select("task", F.concat(F.lit("Task "), "task").alias("description"))
    key = F.col("task")
    late = checks.withColumn("passed", F.col("passed") & (F.col("round") == 2)).withColumn("error", F.when((key % 13 == 0) & (F.col("round") == key % 2), "unverifiable"))
    errors = lambda rows, by: rows.select("task", F.when((key % by == 0) & (F.col("round") == 1 + key % 2), "down").alias("error"))
    ends, told = replay.verified(
        tasks, lambda rows: errors(rows, 17), lambda rows: (rows.join(late, ["task", "round"]).select("task", "passed", "diag", "error"), rows.join(metrics, ["task", "round"]).drop("round")),
        2, lambda rows: errors(rows, 19), lambda task, k: (task % 23 == 0) & (k == 1 + task % 2),
    )
    rounds = told.groupBy("task").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("round", "block"))), lambda x: x["block"]), "\n")).alias("told"))
    return ends.join(rounds, "task", "left").select("task", "outcome", "passed", "rounds", "error", "told")


def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole context document as ordered rows."""
    return rendering.document_rows(rendering.file_blocks(*_decided(spark, sf_dir))).select("number", F.md5("text").alias("text"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", ids.chunk_id(F.col("p_partkey") * 7919 % ids.ID_SPACE).alias("id"))


def skills_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills in order of their names, in one block."""
    skills = read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").alias("path"), F.concat(F.lit("Ask for "), "c_name", F.lit(".\n\n")).alias("content"))
    return memory.skills_block(skills)


def catalog_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without those of deleted files; deleting files that are not there does no harm."""
    old, _ = _versions(spark, sf_dir)
    return catalog.delete(old, old.where("ordinal = 5").select("path").unionByName(spark.range(3).select(F.concat(F.lit("none/"), "id").alias("path")))).select("path", "ordinal", "id")


def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their results."""
    requests = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("asked"))
    results = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
    return tools.answered(requests, results)


def chunk_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy sees of each chunk."""
    return selection.view(_decided(spark, sf_dir)[0].withColumn("refs", F.array("name"))).select("id", "kind", "name", "path", F.md5("signature").alias("signature"), F.array_join("refs", " ").alias("refs"))


def joined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's texts with a blank line between, empty ones left out."""
    t = read(spark, sf_dir, "conversations")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 1, "").otherwise(F.coalesce("text", F.lit(""))).alias("text")))), lambda x: x["text"])
    return t.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.md5(tx.join_sections(F.col("parts"))).alias("text"))


def error_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and message of faults as parsers write them, less the line that wraps a snippet."""
    p = read(spark, sf_dir, "part")
    said = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.when(F.col("p_partkey") % 4 == 1, "snippet.go:").otherwise(""), F.col("p_size").cast("string"), F.lit(":7: expected "), F.col("p_name")))
    line, column, message = edits.error_position(said)
    return p.select("p_partkey", line.alias("line"), column.alias("col"), message.alias("message"))


def named_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context blocks with chunks by name, as where no store knows their order."""
    return rendering.file_blocks(*_decided(spark, sf_dir), by="name").select("path", "chunks", F.md5("block").alias("block"))


def metric_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.statuses(corpus.metric_rows(spark, sf_dir)).select("task", "round", F.to_json("counts").alias("counts"))


def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as chunk kinds, some of them known."""
    kind = F.when(F.col("event_type") == "click", "Class").when(F.col("event_type") == "view", "Preamble").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").groupBy(tx.known_kind(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_QUERIES = (
    corpus_scan_report, md_sections, md_refs, script_refs, chunk_signature, incremental_status, prune_deleted, index_report, stable_id_match, evicted_ids, upserted_chunks,
    triage_shards, rule_triage, shard_listing, decision_merge, coverage_default, decision_histogram, expand_upgrade, context_file_blocks, context_totals,
    apply_outcomes, splice_modify, splice_delete, append_chunk, file_languages, round_rollup, retry_prompts, verify_verdict, history_blocks, task_prompts,
    audit_metrics, audit_causes, audit_exit_codes, unanswered_requests, insight_filter, list_and_indent, go_chunks, script_chunks, script_mixed, go_mixed, code_edits, tree_listing, note_files, engine_edits, skill_texts, retry_runs, verify_runs, context_rows, chunk_ids,
    skills_layer, catalog_delete, answered_requests, chunk_views, joined_sections, error_positions, named_blocks, metric_statuses, chunk_kinds,
    session_topk, history_layer, session_latest, scenario_expectation, archive_json,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: twins.SQL[f.__name__] for f in _QUERIES if f.__name__ in twins.SQL}

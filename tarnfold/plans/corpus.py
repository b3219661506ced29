"""Files assembled from the tables, so that file operators have a corpus to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions.shared import own_folder
from tarnfold.plans.workers import ship
from tarnfold.sources import edited


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Markdown file per conversation, with frontmatter, fences, headings of three levels and references."""
    t = read(spark, sf_dir, "conversations")
    heading = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("## "), F.col("role"), F.lit(" turn ##\n"))).otherwise(F.concat(F.lit("### "), F.col("role"), F.lit(" turn\n")))
    fenced = F.concat(F.lit("```\n## fake\n"), F.col("text"), F.lit("\n~~~\n"))
    linked = F.concat(F.col("text"), F.lit(" [a](conv/"), F.col("turn").cast("string"), F.lit(".md) [[role]] [x](#top) [u](https://e.example/)\n"))
    part = F.concat(heading, F.when(F.col("role") == "assistant", fenced).otherwise(linked))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("part")))), lambda x: x["part"]), "")
    front = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("---\ntitle: c"), F.col("conv_id").cast("string"), F.lit("\n...\n"))).otherwise("")
    top = F.when(F.col("conv_id") % 3 == 0, "# Top\n").otherwise(F.concat(F.lit("Intro of "), F.col("conv_id").cast("string"), F.lit(".\n")))
    return t.groupBy("conv_id").agg(body.alias("body")).select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(front, top, F.col("body")).alias("content"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, doc_id, content: a file per document."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "doc_id", F.col("text").alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a file per page, anchors written as links."""
    p = read(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)").alias("content"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog's files and a later snapshot of the documents: by the last digit 0 changed, 1 touched, 2 removed, 3 renamed."""
    d = document_files(spark, sf_dir)
    digit = F.col("doc_id") % 10
    files = d.select("path", F.lit(1000).cast("long").alias("mtime"), F.sha2("content", 256).alias("hash"))
    path = F.when(digit == 3, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    content = F.when(digit == 0, F.concat(F.col("content"), F.lit("!"))).otherwise(F.col("content"))
    later = d.where(digit != 2).select(path.alias("path"), F.when(digit.isin(0, 1), 1001).otherwise(1000).cast("long").alias("mtime"), F.sha2(content, 256).alias("hash"))
    return files, later


def written(files: DataFrame, name: str) -> str:
    """Files (path, content) written below a new shared folder by the executors; the folder."""
    ship(files.sparkSession)
    root = own_folder(files.sparkSession, name)
    changes = edited.spread(files.sparkSession, files.select("path", "content", F.lit(None).cast("string").alias("before"), F.lit(1).cast("long").alias("mtime"))).checkpoint()
    transaction = edited.stage(changes, root)
    edited.publish(changes, root, transaction).write.format("noop").mode("overwrite").save()
    edited.forget(root, transaction)
    return root


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: documents in folders by source and number, some of them below folders that no listing enters, or of no supported kind."""
    d, key = read(spark, sf_dir, "documents"), F.col("doc_id")
    folder = F.when(key % 10 == 0, ".git").when(key % 10 == 1, "node_modules").otherwise(F.concat(F.lit("n"), (key % 7).cast("string")))
    name = F.concat(F.when(key % 4 == 0, "_").when(key % 4 == 1, ".").otherwise(""), key.cast("string"), F.when(key % 3 == 0, ".txt").when(key % 3 == 1, ".MD").otherwise(".md"))
    return d.select(F.concat_ws("/", F.col("source"), folder, name).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a session file for every customer, a seventh of them broken, and a skill file for every nation."""
    c = read(spark, sf_dir, "customer")
    session = F.to_json(F.struct(F.col("c_name").alias("id"), F.col("c_custkey").alias("ts"), F.col("c_mktsegment").alias("summary")))
    sessions = c.select(F.concat(F.lit("sessions/"), (F.col("c_custkey") % 9).cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), F.when(F.col("c_custkey") % 7 == 0, "{").otherwise(session).alias("content"))
    n = read(spark, sf_dir, "nation")
    return sessions.unionByName(n.select(F.concat(F.lit("skills/"), "n_name", F.lit(".md")).alias("path"), F.concat(F.lit("Know "), "n_name", F.lit(".\n")).alias("content")))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, mode, reason, seq: an event is a vote on its user."""
    mode = F.when(F.col("event_type") == "purchase", "FULL").when(F.col("event_type").isin("click", "signup"), "SKELETON").otherwise("IGNORE")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), mode.alias("mode"), F.col("event_type").alias("reason"), F.col("event_id").alias("seq"))


def tool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round (a user), seq, tool_name, outcome, message: an event is a tool call."""
    outcome = F.when(F.col("event_type") == "error", "conflict").when(F.col("event_type") == "view", "noop").otherwise("applied")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("round"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool_name"), outcome.alias("outcome"), F.get_json_object("props", "$.k").alias("message"))


def scripted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task (a user), round, seq, tool_name, outcome, message, error: what a task calls in a round, an event a call."""
    rows = tool_records(spark, sf_dir).withColumnRenamed("round", "task")
    broken = (F.col("task") % 29 == 0) & (F.col("seq") % 3 == 1)
    return rows.select("task", (F.col("seq") % 3 + 1).cast("int").alias("round"), F.col("seq").cast("int").alias("seq"), "tool_name", "outcome", "message", F.when(broken, "model down").alias("error"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, round, seq, name, status, detail: an event is a metric of its user's round."""
    status = F.when(F.col("event_type") == "error", "FAIL").when((F.col("event_type") == "view") & (F.col("value") > 40), "ERROR").otherwise("PASS")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("task"), (F.col("event_id") % 3).cast("int").alias("round"), F.col("event_id").alias("seq"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("name"), status.alias("status"), F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k")).alias("detail"))


def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, round, passed, diag: three rounds for every customer; most of them have no metrics."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("round"), (F.col("c_acctbal") > 0).alias("passed"), "c_mktsegment")
    return c.select("task", "round", "passed", F.when(F.col("round") > 0, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\n"))).alias("diag"))


CARD = """{{- /* the card of a part */ -}}
{{$b := .Brand}}{{with .Words}}{{range $i, $w := .}}{{if $i}}, {{end}}{{$i}}={{$w | printf "%q"}}{{if eq $i 2}}{{break}}{{end}}{{end}}{{else}}nameless{{end}} of {{$b}}
{{- if gt .Size 30}} large{{else if and (gt .Size 10) (ne .Own.Type "x")}} middle{{else}} small{{end}} {{printf "%.2f|%04d|%-6s|" .Price .Size "to"}} {{.Limits}} {{index .Limits "low"}} {{.Limits.none}} {{len .Own.Type -}}
"""

GO_FILE = """package p

// T@ holds {
type T@ struct {
	Name string // }
}

type (
	ID@ = string
	Doer@ interface{ Do() error }
)

const limit@ = 3

func (t *T@) Run(n int) string { return helper("}{", n) }

// Make@ makes one.
func Make@() *T@ {
	return &T@{Name: `{`}
}
"""

SCRIPT_FILE = """// Box@ holds
export class Box@ {
  value = 1;
  constructor(v) { this.value = v; }
  get size() { return 1; }
  delete(k) { return drop(k); }
  get(k) { return "}"; }
  async 'odd name'() { }
  [Symbol.iterator]() { return it(); }
}

export const one@ = () => 1, two@ = async (x) => x, three@ = 3;
export default function () { return 0; }
function log@(a) { return a; }
"""


#: Pieces of script files; a file has those whose bit of its key is not set. ``~`` is the key, ``%`` the part's name.
SCRIPT_PIECES = (
    """import { helper } from "./helper~";
const quotes~ = raw.replace(/["'`]/g, "%").split(/[/"]+/);
export function first~() { return quotes~.length / 2 / 1; }""",
    """// prints
export const print~ = (x: string): string => `a ${`b ${x} }`} % `;""",
    """  export async function* indented~<T>(a: Array<Map<string, T>> = /}/ as any)
{
  yield a
}
var lone~ = 1; function second~() {}""",
    """export default class Shelf~<T extends Base> extends Rack<T> implements Store, Named {
  private readonly label?: string = "%";
  static { register() }
  @logged({ deep: [1] }) async find<K>(key: K): Promise<T | undefined> { return this.all.find(x => x < key) }
  get size(): number { return this.all.length }
  [key: string]: unknown;
}""",
    """const View~ = ({ items }: Props) => <ul title="%">don't {items.map(i => <li key={i}>{`${i} "`}</li>)}</ul>
function after~(a, b) { return a < b }""",
    """export type Shape~ =
  | { kind: "%" }
  | Other<Shape~[]>;
interface Wide~<T> extends Shape<T> { (x: T): `a${string}` }
enum Level~ { Low = 1, High = Low << 2 }""",
)


#: Pieces of Go files, picked alike; the head goes before them.
GO_HEAD = "package parts\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\n"
GO_PIECES = (
    """// Shelf~ holds
// what is {.
type Shelf~ struct {
	Name, Label string `json:"%"`
	*Rack
	sync.Mutex
	arr [2]int
}""",
    """const low~, high~ = iota, "%" + `}`

func (s *Shelf~[T]) Put~(item T, more ...func(a, b int) error) (n int, err error) {
	for i := range more { if item == (Point{1, i}) { return } }
	switch t := any(item).(type) { case []int, *Box: s.add(t); default: }
	return
}""",
    """type (
	// Kind~ is
	Kind~ = int
	List~[K comparable, V any] struct{ next *List~[K, V] }
	Doer~ interface { Do(x.Context) error; int | string }
)""",
    """var table~ = map[string][]int{"%": {1, 2}}

func Make~() *Shelf~ { return &Shelf~{Name: fmt.Sprint('{', "}") } }
func Other~() { go func() { defer done() }() }""",
)


def mixed_go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Go file for every part, of pieces that its key picks."""
    key = F.col("p_partkey")
    picked = (F.when(key.bitwiseAND(F.lit(1 << k)) == 0, F.lit(piece)) for k, piece in enumerate(GO_PIECES))
    text = F.replace(F.replace(F.concat_ws("\n\n", *picked), F.lit("~"), key.cast("string")), F.lit("%"), F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("go/m"), key.cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit(GO_HEAD), text, F.lit("\n")).alias("content"))


def mixed_script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a script file for every part, of pieces that its key picks."""
    key = F.col("p_partkey")
    picked = (F.when(key.bitwiseAND(F.lit(1 << k)) == 0, F.lit(piece)) for k, piece in enumerate(SCRIPT_PIECES))
    text = F.replace(F.replace(F.concat_ws("\n\n", *picked), F.lit("~"), key.cast("string")), F.lit("%"), F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("script/m"), key.cast("string"), F.lit(".tsx")).alias("path"), text.alias("content"))


def _coded(spark: SparkSession, sf_dir: str, name: str, file: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return read(spark, sf_dir, "part").select(F.replace(F.lit(name), F.lit("@"), key).alias("path"), F.replace(F.lit(file), F.lit("@"), key).alias("content"))


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Go file for every part."""
    return _coded(spark, sf_dir, "go/p@.go", GO_FILE)


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a script file for every part."""
    return _coded(spark, sf_dir, "script/p@.ts", SCRIPT_FILE)

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.operators import skills, templates
from tarnfold.operators.templates import Fault, Template, number
from tarnfold.plans.workers import ship


@pytest.mark.parametrize(
    ("template", "values", "want"),
    [
        ("{{if .A}}a{{else if .B}}b{{end}}", {"A": "", "B": ""}, ""),
        ("{{if .A}}a{{else if .B}}b{{else}}c{{end}}", {"A": 0, "B": 3}, "b"),
        ("x {{- .A -}} x", {"A": 1}, "x1x"),
        ("a {{- /* no */ -}} b{{/* nor this */}}", {}, "ab"),
        ("{{with .A}}<{{.}}>{{else}}none{{end}}{{with $x := .B}}{{$x}}{{end}}", {"A": "", "B": 2}, "none2"),
        ("{{range $i, $v := .L}}{{if $i}}, {{end}}{{$i}}={{$v}}{{else}}empty{{end}}", {"L": ["a", "b"]}, "0=a, 1=b"),
        ("{{range .L}}{{.}}{{else}}empty{{end}}", {"L": []}, "empty"),
        ("{{range .L}}{{if eq . 2}}{{continue}}{{end}}{{if gt . 3}}{{break}}{{end}}{{.}}{{end}}", {"L": [1, 2, 3, 4, 5]}, "13"),
        ("{{range 3}}{{.}}{{end}}", {}, "012"),
        ('{{$n := 0}}{{range .L}}{{$n = len .}}{{end}}{{$n}} {{$.L}}', {"L": ["aé"]}, "3 [aé]"),
        ('{{eq .A "x" "y"}} {{ne 1 2}} {{lt 1 2}} {{le 2 2}} {{gt "b" "a"}} {{ge 1 2}}', {"A": "y"}, "true true true true true false"),
        ("{{and .A .B}} {{or .A .B}} {{not .A}}", {"A": 0, "B": "b"}, "0 b true"),
        ('{{.A | printf "%05d|%-4s|%q" 42 "x"}} {{"a" | len}}', {"A": 'q"\n'}, '00042|x   |"q\\"\\n" 1'),
        ('{{printf "%.2f %v %t %x %d%%" 1.5 .L true 255 7}}', {"L": [1, "a"]}, "1.50 [1 a] true ff 7%"),
        ("{{index .L 1}} {{slice .S 1 3}} {{(index .L 0).X}} {{len (slice .L 1)}}", {"L": [{"X": 9}, 5], "S": "abcd"}, "5 bc 9 1"),
        ("{{.A.B.C}} {{.F}} {{.N}} {{.T}}", {"A": {"B": {"C": "deep"}}, "F": 2.0, "N": None, "T": True}, "deep 2 <no value> true"),
        ('{{html "<a b=\'c\'>"}} {{print 1 2 "x" 3}} {{println "y"}}', {}, "&lt;a b=&#39;c&#39;&gt; 1 2x3 y\n"),
        ("{{`raw \\n`}} {{'a'}} {{1e3}} {{0x10}} {{nil | not}}", {}, "raw \\n 97 1000 16 true"),
        ("{{range .L}}{{range .}}{{$.S}}{{.}}{{end}};{{end}}", {"L": [[1], [2, 3]], "S": "-"}, "-1;-2-3;"),
    ],
)
def test_templates(template, values, want):
    assert skills.render(template, values) == want


@pytest.mark.parametrize("template", ["{{if .A}}", "{{end}}", "{{.A", "{{else}}", "{{range}}x{{end}}", "{{nothing .A}}", "{{$x}}", "{{break}}", "{{.A | 3}}", "{{(.A}}", "{{if .A}}{{else}}{{else}}{{end}}", "{{template \"x\"}}", "{{}}"])
def test_templates_that_cannot_be_parsed(template):
    with pytest.raises(Fault):
        Template(template)


@pytest.mark.parametrize("template", ["{{.Nope}}", "{{index .L 5}}", "{{lt 1 \"a\"}}", "{{.A.B}}", "{{range .S}}{{end}}", "{{len 3}}", "{{eq .L .L}}", "{{.S 1}}", "{{ne 1}}", "{{eq 1 1.0}}"])
def test_rows_that_a_template_cannot_be_filled_from(template):
    with pytest.raises(Fault):
        skills.render(template, {"L": [1], "A": "x", "S": "text"})


def test_numbers_as_text():
    for x, want in ((0.1, "0.1"), (100.0, "100"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e-5, "1.5e-05"), (0.0001, "0.0001"), (-2.5, "-2.5"), (123456.789, "123456.789"), (float("inf"), "+Inf"), (5e-324, "5e-324"), (0.0, "0")):
        assert number(x) == want


def test_rows_are_filled_in_batches(spark):
    ship(spark)
    schema = "k int, Name string, Tags array<string>, Limits map<string,int>, Own struct<A:int,B:string>, text string"
    rows = spark.createDataFrame([(1, "n", ["a", "b"], {"y": 2, "x": 1}, (1, "z"), "old"), (2, None, None, None, None, "old"), (3, "m", [], {}, (5, None), None)], schema).drop("text")
    got = {r.k: (r.text, r.error) for r in templates.filled(rows, "{{.Name}}{{range .Tags}} {{.}}{{end}} {{.Limits.x}} {{.Limits}} {{with .Own}}{{.A}}{{end}}", F.struct("Name", "Tags", "Limits", "Own")).collect()}
    assert got == {1: ("n a b 1 map[x:1 y:2] 1", None), 2: (None, "nil data; no entry for key 'x'"), 3: ("m <no value> map[] 5", None)}
    by_row = templates.filled(rows, F.when(F.col("k") == 1, "{{.Name}}").when(F.col("k") == 2, "{{if}}").otherwise(None), F.struct("Name")).collect()
    assert {r.k: (r.text, r.error) for r in by_row} == {1: ("n", None), 2: (None, "missing value for command"), 3: ("", None)}
    skill = skills.Skill("S", "", T.StructType([T.StructField("Name", T.StringType())]), "Do {{.Name}}.")
    assert {r.k: r.text for r in skills.texts(rows, skill).collect()} == {1: "Do n.", 2: "Do <no value>.", 3: "Do m."}
    with pytest.raises(Fault):
        templates.filled(rows, "{{if}}", F.struct("Name"))

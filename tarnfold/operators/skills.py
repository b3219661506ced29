"""Skills: parametrised instructions with a typed schema, kept by name."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.operators import templates

# The basic types of skill fields and their column types.
BASIC = {
    "string": T.StringType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "rune": T.IntegerType(),
    "int": T.LongType(), "int64": T.LongType(), "uint8": T.ShortType(), "byte": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(),
    "uint": T.DecimalType(20, 0), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "any": T.VariantType(), "interface{}": T.VariantType(),
}


def column_type(text: str) -> tuple[T.DataType, bool]:
    """The column type of a Go type expression, and whether it may be null."""
    t = text.strip()
    if t.startswith("*"):
        return column_type(t[1:])[0], True
    if t == "[]byte":
        return T.BinaryType(), False
    if t.startswith("[]"):
        inner, null = column_type(t[2:])
        return T.ArrayType(inner, null), False
    if t.startswith("map["):
        depth, k = 1, 4
        while k < len(t) and depth:
            depth += {"[": 1, "]": -1}.get(t[k], 0)
            k += 1
        value, null = column_type(t[k:])
        return T.MapType(column_type(t[4 : k - 1])[0], value, null), False
    if t.startswith("struct"):
        return struct_type(t[t.index("{") + 1 : t.rindex("}")]), False
    t = re.sub(r"^interface\s*\{\s*\}$", "interface{}", t)
    if t not in BASIC:
        raise ValueError(f"unsupported type: {text.strip()}")
    return BASIC[t], False


def _fields(body: str) -> list[str]:
    """The lines of a struct body, nested bodies kept whole, comments gone."""
    out, depth, line = [], 0, ""
    for c in re.sub(r"//[^\n]*", "", body):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c in "\n;" and not depth:
            out.append(line)
            line = ""
        else:
            line += c
    return [x.strip() for x in [*out, line] if x.strip()]


def struct_type(body: str) -> T.StructType:
    """The columns of a struct body. Tags go to the metadata; embedded, unexported and repeated fields are errors."""
    out: list[T.StructField] = []
    for line in _fields(body):
        tag = re.search(r"`([^`]*)`\s*$", line)
        bare = line[: tag.start()].strip() if tag else line
        m = re.match(r"((?:[A-Za-z_]\w*\s*,\s*)*[A-Za-z_]\w*)\s+(.+)$", bare, re.S)
        if not m:
            raise ValueError(f"embedded field: {bare}")
        kind, null = column_type(m[2])
        for name in (x.strip() for x in m[1].split(",")):
            if not name[0].isupper():
                raise ValueError(f"unexported field: {name}")
            if any(f.name == name for f in out):
                raise ValueError(f"field appears twice: {name}")
            out.append(T.StructField(name, kind, null, dict(re.findall(r'(\w+):"([^"]*)"', tag[1])) if tag else {}))
    return T.StructType(out)


@dataclass(frozen=True)
class Skill:
    name: str
    description: str
    schema: T.StructType
    sop: str
    source: str = ""


_STRUCT = re.compile(r"((?:^//[^\n]*\n)*)^type\s+([A-Z]\w*)\s+struct\s*\{", re.M)
_SOP = re.compile(r"\bconst\s+(\w+?)SOP\s*=\s*`([^`]*)`")
_NAMED = re.compile(r'^\s*(\w+?)SOP\s*=\s*(?:`([^`]*)`|"([^"]*)")', re.M)


def parse(source: str, path: str = "") -> list[Skill]:
    """Skills of a source text: exported structs joined by name with their SOP constants; the doc comment describes."""
    sops = {m[1]: m[2] for m in _SOP.finditer(source)} | {m[1]: m[2] if m[2] is not None else m[3] for m in _NAMED.finditer(source)}
    found = []
    for m in _STRUCT.finditer(source):
        if m[2] not in sops:
            continue
        depth, k = 1, m.end()
        while k < len(source) and depth:
            depth += {"{": 1, "}": -1}.get(source[k], 0)
            k += 1
        doc = " ".join(x.removeprefix("//").strip() for x in m[1].splitlines()).strip()
        doc = re.sub(rf"^{m[2]}(?=[ \t:,。.]|$)[ \t:,。.]*", "", doc)
        found.append(Skill(m[2], doc, struct_type(source[m.end() : k - 1]), sops[m[2]], path))
    if not found:
        raise ValueError(f"no skill in {path or 'the text'}")
    return found


@dataclass
class Registry:
    """Skills by name; one added later replaces one of the same name."""

    held: dict[str, Skill] = field(default_factory=dict)

    def add(self, skill: Skill) -> None:
        self.held[skill.name] = skill

    def get(self, name: str) -> Skill | None:
        return self.held.get(name)

    def remove(self, name: str) -> bool:
        return self.held.pop(name, None) is not None

    def all(self) -> list[Skill]:
        return [self.held[n] for n in sorted(self.held)]

    def load_folder(self, root: str) -> int:
        """Adds the skills of every .go file below a folder that is no test; stops at the first bad file, keeping those before."""
        n = 0
        for p in sorted(Path(root).rglob("*.go")):
            parts = p.relative_to(root).parts
            if p.name.endswith("_test.go") or any(x.startswith(".") for x in parts) or "testdata" in parts[:-1]:
                continue
            for s in parse(p.read_text(), str(p)):
                self.add(s)
                n += 1
        return n

    def rows(self) -> list[tuple[str, str, str, str, str]]:
        """name, description, params_ddl, sop, source_path."""
        return [(s.name, s.description, s.schema.simpleString(), s.sop, s.source) for s in self.all()]


def render(template: str, values: dict[str, Any], schema: T.StructType | None = None) -> str:
    """A template (see ``templates``) filled from values; without a schema, objects inside are structs."""
    return templates.Template(template).fill(templates.valued(values, schema) if schema else _records(values))


def _records(x: Any) -> Any:
    if isinstance(x, dict):
        return templates.Record((k, _records(v)) for k, v in x.items())
    return [_records(v) for v in x] if isinstance(x, (list, tuple)) else x


def texts(rows: DataFrame, skill: Skill) -> DataFrame:
    """Parameter rows (the columns of the skill's schema, and any others) with ``text`` and ``error``: the skill's instructions for each row."""
    return templates.filled(rows, skill.sop, F.struct(*(F.col(f.name) for f in skill.schema)))


def as_tool(skill: Skill, runner: Callable[[str], str] | None) -> Callable[[dict[str, Any]], str]:
    """A skill as a call: its arguments fill the template, and the runner gets the text."""

    def call(arguments: dict[str, Any]) -> str:
        if runner is None:
            raise ValueError(f"skill {skill.name} has no runner")
        unknown = set(arguments) - set(skill.schema.fieldNames())
        if unknown:
            raise ValueError(f"unknown arguments: {sorted(unknown)}")
        return runner(render(skill.sop, {f.name: arguments.get(f.name, "") for f in skill.schema}))  # an argument left out is empty

    return call

"""Texts with actions in double braces, filled from parameter rows in Arrow batches.

The language: fields and chains, variables, pipelines, parentheses, literals, comments, trim marks, ``if`` / ``else if`` / ``else``, ``with``, ``range`` with one
or two variables and ``else``, ``break`` and ``continue``, and the functions in FUNCTIONS. A template is parsed once a worker. A parse fault
fails the query where it is planned; a fault in a row (a field that is not there, an index out of range, unlike types compared) is that row's error.
"""

from __future__ import annotations

import json
import math
import re
import urllib.parse
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions.shared import dealt


class Fault(ValueError):
    """A template that cannot be parsed, or a row that it cannot be filled from."""


class Record(dict):
    """A struct: asking for a field that it does not have is a fault, where a map gives nothing."""


_TAG = re.compile(r"\{\{(-(?=\s))?((?:\s*/\*[\s\S]*?\*/\s*)|(?:\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'|[^\"`'])*?)((?<=\s)-)?\}\}")
_TOKEN = re.compile(r"\s*(?:(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<c>'(?:[^'\\\n]|\\.)+')|(?P<d>[-+]?(?:0[xX][\da-fA-F]+|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+))|(?P<v>\$\w*)|(?P<f>\.\w+)|(?P<p>:=|[=|(),.])|(?P<n>[A-Za-z_]\w*))")
_NONE = object()


def truth(x: Any) -> bool:
    """Whether a value counts as true: not false, zero, nothing or empty; a struct always does."""
    return isinstance(x, Record) or bool(x)


def shown(x: Any, inner: bool = False) -> str:
    """A value as text: nothing is ``<no value>``, or ``<nil>`` inside another value."""
    if x is None or x is _NONE:
        return "<nil>" if inner else "<no value>"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return number(x)
    if isinstance(x, Record):
        return "{" + " ".join(shown(v, True) for v in x.values()) + "}"
    if isinstance(x, dict):
        return "map[" + " ".join(f"{shown(k, True)}:{shown(x[k], True)}" for k in sorted(x)) + "]"
    if isinstance(x, (list, tuple)):
        return "[" + " ".join(shown(v, True) for v in x) + "]"
    if isinstance(x, bytes):
        return "[" + " ".join(map(str, x)) + "]"
    return str(x)


def number(x: float) -> str:
    """The shortest digits that read back as the same number; exponents below -4 and from 21 on."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    mantissa, _, shift = repr(abs(x)).partition("e")
    whole, _, rest = mantissa.partition(".")
    rest = "" if rest == "0" else rest
    bare = (whole + rest).lstrip("0")
    exponent = len(whole) - 1 + int(shift or 0) if whole != "0" else int(shift or 0) - 1 - (len(rest) - len(rest.lstrip("0")))
    bare = bare.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if exponent < -4 or exponent >= 21:
        return f"{sign}{bare[0]}{'.' + bare[1:] if len(bare) > 1 else ''}e{'-' if exponent < 0 else '+'}{abs(exponent):02}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{bare}"
    if len(bare) <= exponent + 1:
        return sign + bare + "0" * (exponent + 1 - len(bare))
    return f"{sign}{bare[: exponent + 1]}.{bare[exponent + 1 :]}"


def _kind(x: Any) -> str:
    return "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "nil" if x is None else "other"


def _same(a: Any, b: Any) -> bool:
    if _kind(a) == "other" or _kind(b) == "other":
        raise Fault("values cannot be compared")
    if _kind(a) != _kind(b) and "nil" not in (_kind(a), _kind(b)) or _kind(a) == "number" and isinstance(a, float) != isinstance(b, float):
        raise Fault("incompatible types for comparison")
    return a == b


def _less(a: Any, b: Any) -> bool:
    if _kind(a) != _kind(b) or _kind(a) not in ("number", "string") or isinstance(a, float) != isinstance(b, float):
        raise Fault("incompatible types for comparison")
    return a < b


def _index(x: Any, *keys: Any) -> Any:
    for k in keys:
        if isinstance(x, dict) and not isinstance(x, Record):
            x = x.get(k)
        elif isinstance(x, (list, tuple, str, bytes)) and isinstance(k, int) and not isinstance(k, bool):
            if not 0 <= k < len(x):
                raise Fault(f"index out of range: {k}")
            x = x[k] if not isinstance(x, str) else x.encode()[k]
        else:
            raise Fault("value cannot be indexed")
    return x


def _length(x: Any) -> int:
    if not isinstance(x, (list, tuple, dict, str, bytes)) or isinstance(x, Record):
        raise Fault("value has no length")
    return len(x.encode()) if isinstance(x, str) else len(x)


def _slice(x: Any, *at: int) -> Any:
    if not isinstance(x, (list, tuple, str)):
        raise Fault("value cannot be sliced")
    n = _length(x)
    a, b = (at[0] if at else 0), (at[1] if len(at) > 1 else n)
    if not 0 <= a <= b <= n:
        raise Fault("slice out of range")
    return x.encode()[a:b].decode("utf-8", "replace") if isinstance(x, str) else x[a:b]


def quoted(x: str) -> str:
    """A double-quoted string: printable characters stand, others are escaped."""
    named = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", '"': '\\"', "\\": "\\\\"}
    code = lambda c: f"\\x{ord(c):02x}" if ord(c) < 0x80 else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}"
    return '"' + "".join(named.get(c) or (c if c.isprintable() else code(c)) for c in x) + '"'


_VERB = re.compile(r"%([-+# 0]*)(\d*)(?:\.(\d+))?([a-zA-Z%])")


def _printf(form: Any, *values: Any) -> str:
    if not isinstance(form, str):
        raise Fault("printf needs a format")
    left = list(values)

    def one(m: re.Match) -> str:
        flags, width, digits, verb = m.groups()
        if verb == "%":
            return "%"
        if not left:
            return f"%!{verb}(MISSING)"
        x = left.pop(0)
        whole = isinstance(x, int) and not isinstance(x, bool)
        if verb in "vs" and not (verb == "s" and (whole or isinstance(x, (bool, float)))):
            text = shown(x, True)
            text = text[: int(digits)] if digits and isinstance(x, str) else text
        elif verb == "q" and isinstance(x, str):
            text = quoted(x)
        elif verb == "t" and isinstance(x, bool):
            text = shown(x)
        elif verb in "dxXob" and whole:
            text = format(x, {"d": "d"}.get(verb, verb))
            text = "+" + text if "+" in flags and x >= 0 else text
        elif verb in "xX" and isinstance(x, str):
            text = x.encode().hex() if verb == "x" else x.encode().hex().upper()
        elif verb == "c" and whole:
            text = chr(x)
        elif verb in "feEgG" and isinstance(x, float):
            text = number(x) if verb == "g" and not digits else format(x, f"{'+' if '+' in flags else ''}.{digits or 6}{verb}")
        else:
            return f"%!{verb}({type(x).__name__}={shown(x, True)})"
        if "0" in flags and "-" not in flags and isinstance(x, (int, float)):
            return text.zfill(int(width or 0))
        return text.ljust(int(width or 0)) if "-" in flags else text.rjust(int(width or 0))

    out = _VERB.sub(one, form)
    return out + ("%!(EXTRA " + ", ".join(f"{type(x).__name__}={shown(x, True)}" for x in left) + ")" if left else "")


def _print(*values: Any) -> str:
    out = ""
    for k, x in enumerate(values):
        out += (" " if k and not isinstance(x, str) and not isinstance(values[k - 1], str) else "") + shown(x, True)
    return out


_HTML = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", "\0": "�"})
FUNCTIONS: dict[str, Callable] = {
    "eq": lambda a, *bs: any(_same(a, b) for b in bs), "ne": lambda a, b: not _same(a, b), "lt": _less, "le": lambda a, b: _less(a, b) or _same(a, b), "gt": lambda a, b: _less(b, a), "ge": lambda a, b: _less(b, a) or _same(a, b),
    "not": lambda x: not truth(x), "len": _length, "index": _index, "slice": _slice, "print": _print, "println": lambda *x: " ".join(shown(v, True) for v in x) + "\n", "printf": _printf,
    "html": lambda *x: _print(*x).translate(_HTML), "urlquery": lambda *x: urllib.parse.quote_plus(_print(*x)),
}


class Template:
    def __init__(self, text: str):
        self.parts: list[tuple[str, Any]] = []
        at, trim = 0, False
        for m in _TAG.finditer(text):
            raw = text[at : m.start()]
            raw = raw.lstrip(" \t\r\n") if trim else raw
            self.parts.append(("text", raw.rstrip(" \t\r\n") if m[1] else raw))
            if not m[2].strip().startswith("/*"):
                self.parts.append(("tag", m[2].strip()))
            at, trim = m.end(), bool(m[3])
        rest = text[at:]
        if "{{" in rest:
            raise Fault("action is not closed")
        self.parts.append(("text", rest.lstrip(" \t\r\n") if trim else rest))
        self.at, self.loops = 0, 0
        self.scope = [{"$"}]
        self.tree, end = self._list()
        if end:
            raise Fault(f"unexpected {end}")

    # Parsing

    def _list(self) -> tuple[list, str]:
        out: list = []
        self.scope.append(set())
        try:
            while self.at < len(self.parts):
                kind, value = self.parts[self.at]
                self.at += 1
                if kind == "text":
                    if value:
                        out.append(("text", value))
                    continue
                word = re.match(r"(?:if|with|range|else|end|break|continue|define|block|template)\b", value)
                if not word:
                    out.append(("show", *self._pipe(value)))
                elif word[0] == "end" or word[0] == "else":
                    return out, value
                elif word[0] in ("break", "continue"):
                    if not self.loops:
                        raise Fault(f"{word[0]} outside range")
                    out.append((word[0],))
                elif word[0] in ("define", "block", "template"):
                    raise Fault(f"{word[0]} is not known")
                else:
                    out.append(self._branch(word[0], value[word.end() :]))
            return out, ""
        finally:
            self.scope.pop()

    def _branch(self, word: str, head: str) -> tuple:
        self.scope.append(set())
        pipe = self._pipe(head, word == "range")
        self.loops += word == "range"
        body, end = self._list()
        self.loops -= word == "range"
        other: list = []
        if end.startswith("else"):
            again = re.match(r"else\s+(if|with)\b(.*)", end, re.S)
            if again and word != "range":
                other = [self._branch(again[1], again[2])]  # its end is this one's too
                end = "end"
            elif end.strip() != "else":
                raise Fault(f"unexpected {end}")
            else:
                other, end = self._list()
        if end != "end":
            raise Fault(f"{word} is not closed" if not end else f"unexpected {end}")
        self.scope.pop()
        return (word, *pipe, body, other)

    def _pipe(self, text: str, ranges: bool = False) -> tuple[list[str], str, Any]:
        """Variables that are set, how, and the pipeline."""
        tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise Fault(f"unexpected {text[at : at + 10]!r}")
            tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup) > at or not tokens))
            at = m.end()
        names, how = [], ""
        k = 0
        if tokens and tokens[0][0] == "v":
            k = 3 if ranges and len(tokens) > 3 and tokens[1][1] == "," and tokens[2][0] == "v" else 1
            if k < len(tokens) and tokens[k][1] in (":=", "="):
                names, how = [tokens[j][1] for j in range(0, k, 2)], tokens[k][1]
                tokens = tokens[k + 1 :]
        self.tokens, self.k = tokens, 0
        pipe = self._pipeline()
        if self.k < len(self.tokens):
            raise Fault(f"unexpected {self.tokens[self.k][1]!r}")
        for n in names:
            if how == "=" and not any(n in s for s in self.scope):
                raise Fault(f"undefined variable {n}")
            self.scope[-1].add(n)
        return names, how, pipe

    def _pipeline(self) -> list:
        commands = []
        while True:
            words = []
            while self.k < len(self.tokens) and self.tokens[self.k][1] not in ("|", ")") or self.k < len(self.tokens) and self.tokens[self.k][0] == "s":
                words.append(self._operand())
            if not words:
                raise Fault("missing value for command")
            if commands and words[0][0] not in ("call", "chain"):
                raise Fault("non executable command in pipeline")
            commands.append(words)
            if self.k < len(self.tokens) and self.tokens[self.k][1] == "|":
                self.k += 1
                continue
            return commands

    def _operand(self) -> tuple:
        kind, text, _ = self.tokens[self.k]
        self.k += 1
        if kind == "s":
            base: tuple = ("value", text[1:-1] if text[0] == "`" else _unquoted(text))
        elif kind == "c":
            base = ("value", ord(_unquoted('"' + text[1:-1].replace("\\'", "'").replace('"', '\\"') + '"')))
        elif kind == "d":
            base = ("value", int(text, 0) if re.fullmatch(r"[-+]?(?:0[xX][\da-fA-F]+|[1-9]\d*|0)", text) else float(text))
        elif kind == "v":
            if not any(text in s for s in self.scope):
                raise Fault(f"undefined variable {text}")
            base = ("variable", text)
        elif kind == "f":
            base = ("chain", ("dot",), text[1:])
        elif text == ".":
            return ("dot",)
        elif text == "(":
            base = ("pipe", self._pipeline())
            if self.k >= len(self.tokens) or self.tokens[self.k][1] != ")":
                raise Fault("unclosed left paren")
            self.k += 1
        elif text in ("true", "false", "nil"):
            return ("value", {"true": True, "false": False}.get(text))
        elif text in FUNCTIONS or text in ("and", "or"):
            return ("call", text)
        else:
            raise Fault(f"function {text!r} is not defined" if kind == "n" else f"unexpected {text!r}")
        while self.k < len(self.tokens) and self.tokens[self.k][0] == "f" and not self.tokens[self.k][2]:
            base = ("chain", base, self.tokens[self.k][1][1:])
            self.k += 1
        return base

    # Filling

    def fill(self, values: Any) -> str:
        out: list[str] = []
        self._run(self.tree, values, {"$": values}, out)
        return "".join(out)

    def _run(self, nodes: list, dot: Any, variables: dict, out: list[str]) -> str:
        """``break`` or ``continue`` where one was met. A list's variables end with it."""
        own = dict(variables)
        try:
            for node in nodes:
                word = node[0]
                if word == "text":
                    out.append(node[1])
                elif word in ("break", "continue"):
                    return word
                else:
                    if word in ("show", "if", "with"):
                        _, names, how, pipe, *branches = node
                        x = self._value(pipe, dot, own)
                        inside = own if word == "show" else dict(own)
                        for n in names:
                            inside[n] = x
                        if word == "show":
                            if not names:
                                out.append(shown(x))
                            met = ""
                        else:
                            hit = truth(x)
                            met = self._run(branches[0] if hit else branches[1], x if word == "with" and hit else dot, inside, out)
                            for n in own:
                                own[n] = inside[n] if n not in names or how == "=" else own[n]
                    else:
                        met = self._range(node, dot, own, out)
                    if met:
                        return met
            return ""
        finally:
            for n in variables:
                variables[n] = own[n]

    def _range(self, node: tuple, dot: Any, own: dict, out: list[str]) -> str:
        _, names, _, pipe, body, other = node
        x = self._value(pipe, dot, own)
        if isinstance(x, Record) or not isinstance(x, (list, tuple, dict, int, type(None))) or isinstance(x, bool):
            raise Fault("range can't iterate over the value")
        pairs = [(k, x[k]) for k in sorted(x)] if isinstance(x, dict) else [(k, k) for k in range(x)] if isinstance(x, int) else list(enumerate(x or ()))
        for k, v in pairs:
            inside = dict(own)
            inside.update(zip(names, (k, v) if len(names) == 2 else (v,), strict=False))
            met = self._run(body, v, inside, out)
            for n in own:
                own[n] = inside[n] if n not in names else own[n]
            if met == "break":
                break
        return "" if pairs else self._run(other, dot, own, out)

    def _value(self, pipe: list, dot: Any, own: dict) -> Any:
        last: Any = _NONE
        for words in pipe:
            more = () if last is _NONE else (last,)
            if words[0][0] == "call":
                last = self._call(words[0][1], words[1:], more, dot, own)
            elif len(words) > 1 or more:
                raise Fault("can't give argument to what is no function")
            else:
                last = self._operand_value(words[0], dot, own)
        return last

    def _call(self, name: str, words: list, more: tuple, dot: Any, own: dict) -> Any:
        if name in ("and", "or"):
            x: Any = None
            if not words and not more:
                raise Fault(f"wrong number of args for {name}")
            for w in words:
                x = self._operand_value(w, dot, own)
                if truth(x) == (name == "or"):
                    return x
            return more[0] if more else x
        values = [self._operand_value(w, dot, own) for w in words] + list(more)
        try:
            return FUNCTIONS[name](*values)
        except TypeError as e:
            raise Fault(f"wrong number or kind of args for {name}") from e

    def _operand_value(self, word: tuple, dot: Any, own: dict) -> Any:
        kind = word[0]
        if kind == "dot":
            return dot
        if kind == "value":
            return word[1]
        if kind == "variable":
            return own[word[1]]
        if kind == "pipe":
            return self._value(word[1], dot, own)
        if kind == "call":
            return self._call(word[1], [], (), dot, own)
        base = self._operand_value(word[1], dot, own)
        if isinstance(base, Record):
            if word[2] not in base:
                raise Fault(f"can't evaluate field {word[2]}")
            return base[word[2]]
        if isinstance(base, dict):
            return base.get(word[2])
        raise Fault(f"can't evaluate field {word[2]}" if base is not None else f"nil data; no entry for key {word[2]!r}")


def _unquoted(text: str) -> str:
    try:
        return json.loads(re.sub(r"\\([av'])|\\x([\da-fA-F]{2})", lambda m: {"a": "\\u0007", "v": "\\u000b", "'": "'"}[m[1]] if m[1] else f"\\u00{m[2]}", text), strict=False)
    except ValueError as e:
        raise Fault(f"unknown escape in {text}") from e


def valued(x: Any, kind: T.DataType) -> Any:
    """A column's value with structs as records and maps as maps."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return Record((f.name, valued(x[f.name], f.dataType)) for f in kind)
    if isinstance(kind, T.MapType):
        return {k: valued(v, kind.valueType) for k, v in (x.items() if isinstance(x, dict) else x)}
    if isinstance(kind, T.ArrayType):
        return [valued(v, kind.elementType) for v in x]
    return int(x) if isinstance(kind, T.DecimalType) and kind.scale == 0 else float(x) if isinstance(kind, T.DecimalType) else x


def filled(rows: DataFrame, template: str | Column, values: Column) -> DataFrame:
    """Rows with ``text`` and ``error`` more: a template (one, or a column of them) filled from a struct of each row; one of the two is null."""
    if isinstance(template, str):
        Template(template)
    whole = dealt(rows).select((F.lit(template) if isinstance(template, str) else template).alias("template"), values.alias("values"), F.struct("*").alias("row"))
    kind, own = whole.schema["values"].dataType, whole.schema["row"].dataType
    schema = T.StructType([T.StructField("row", own), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
    return whole.mapInArrow(lambda batches: _filled(batches, kind), schema).select("row.*", "text", "error")


def _filled(batches: Iterator[pa.RecordBatch], kind: T.StructType) -> Iterator[pa.RecordBatch]:
    """Text and error of (template, values) batches."""
    known: dict[str, Template] = {}
    for b in batches:
        texts, errors = [], []
        for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = error = None
            try:
                if t not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[t] = Template(t or "")
                text = known[t].fill(valued(v, kind))
            except (Fault, RecursionError) as e:
                error = str(e) or "nested too deeply"
            texts.append(text)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names[2:], "text", "error"])

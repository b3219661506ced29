"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, plus signs, digits and identifier cues.
From each anchor a deterministic local parser grows the span to its boundaries and validates it.
No text is searched by the span patterns themselves, only matched at an anchor.

Kinds, in order: email, ip, card, phone (their shapes are fixed by the contract), then url and
account, which the schemes and cues add. Spans are code points, end exclusive, and do not overlap
within a kind.

Defined results: a null or empty text has no spans; a candidate that fails its check is dropped and
not retried; repeated rows each get their own row; other columns are kept by ``mask`` and not read
by ``spans``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.llm.common import ship

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
CUES = ("token", "api_key", "apikey", "secret", "password", "iban", "account", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_VALUE = re.compile(r"[\s:=#\"']{0,6}(?:is|no\.?|number)?[\s:=#\"']{0,4}([A-Za-z0-9][A-Za-z0-9_-]{7,})")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for d in "0123456789":
        found.add_word(d, ("d", 1))
    for x in SCHEMES:
        for y in {x, x.upper(), x.capitalize()}:
            found.add_word(y, ("s", len(y)))
    for x in CUES:
        for y in {x, x.upper(), x.capitalize()}:
            found.add_word(y, ("c", len(y)))
    found.make_automaton()
    return found


_AUTOMATON = _anchors()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    if not text:
        return []
    out, past = [], [0] * len(KINDS)  # past: where each kind's last match ended
    for end, (what, n) in _AUTOMATON.iter(text):
        at = end - n + 1
        if what == "@":
            left = at
            while left > past[0] and text[left - 1] in _LOCAL:
                left -= 1
            if left < at and (m := _DOMAIN.match(text, at + 1)):
                past[0] = m.end()
                out.append((left, 0, m.end()))
        elif what == "d":
            if at >= past[1]:
                if m := _IP.match(text, at):
                    past[1] = m.end()
                    parts = [x.lstrip("0") or "0" for x in m[0].split(".")]  # int() refuses very long runs of zeros too
                    if all(len(x) <= 3 and int(x) <= 255 for x in parts):
                        out.append((at, 1, m.end()))
                else:  # later digits of this run start the same chain
                    past[1] = at + 1
                    while past[1] < len(text) and text[past[1]] in "0123456789":
                        past[1] += 1
            if at >= past[2] and (m := _CARD.match(text, at)):
                past[2] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, m.end()))
        elif what == "+":
            if at >= past[3] and (m := _PHONE.match(text, at)):
                past[3] = m.end()
                if 10 <= sum(x in "0123456789" for x in m[0]) <= 15:
                    out.append((at, 3, m.end()))
        elif what == "s":
            if at >= past[4] and not (at and text[at - 1].isalnum()) and (m := _REST.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?)]"))
                if stop > end + 1:
                    past[4] = stop
                    out.append((at, 4, stop))
        elif at >= past[5] and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and (m := _VALUE.match(text, end + 1)) and m.start(1) > end + 1 and any(x in "0123456789" for x in m[1]):
            past[5] = m.end(1)
            out.append((m.start(1), 5, m.end(1)))
    out.sort()
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span gives way to ``[KIND]``; overlapping spans go as one, under the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        base, every = [], []
        for text in batch.column(1).to_pylist():
            spans = find(text)
            own = [x for x in spans if x[1] < len(BASE)]
            for k, c in enumerate(counts):
                c.append(sum(x[1] == k for x in own))
            base.append(hashlib.sha256(written(own).encode()).hexdigest())
            every.append(written(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())], names=[batch.schema.names[0], *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of the base kinds, digest of the base spans, all spans."""
    ship(docs.sparkSession)
    return docs.select(key, docs[text].cast("string")).mapInArrow(_rows, f"{key} {docs.schema[key].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text replaced; null texts stay null."""
    ship(docs.sparkSession)

    @F.arrow_udf(T.StringType())
    def clean(column: pa.Array) -> pa.Array:
        parts = (pa.array([x if x is None else masked(x, find(x)) for x in column.slice(k, 256).to_pylist()], pa.string()) for k in range(0, len(column), 256))
        return pa.concat_arrays([pa.array([], pa.string()), *parts])

    return docs.withColumn(text, clean(docs[text].cast("string")))

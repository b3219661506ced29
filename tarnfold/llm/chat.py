"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Grammar of a formatted conversation, after an optional ``[ESC]`` header::

    user       <s>[INST] text [/INST]
    assistant  ' ' text ' </s>'
    system     <<SYS>> text <</SYS>>
    any other  <<ROLE>> length role text <</ROLE>>     (length of the role as written)

A conversation is rendered plainly, read back by the parser and compared turn by turn with its
source. Where a turn differs, its texts hold control strings that the parser took for marks: it is
rendered again with those escaped (a backslash goes inside each control string, and backslashes are
doubled) under the header, and compared again. A rendering that still differs raises an error.

Defined results: a null text is empty, a null role is the empty role; turns sort by turn (null
first), then role, then text, and repeated rows stay; a null conv_id is one conversation; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "[ESC]"
PIECES = r"(?s)<s>\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|<<ROLE>> .*? <</ROLE>>| .*? </s>"
INSIDE = r"(<|\[)(?=/?s>|</?SYS>>|</?ROLE>>|/?INST\]|ESC\])"
OPEN = {"user": "<s>[INST] ", "assistant": " ", "system": "<<SYS>> ", None: "<<ROLE>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>", None: " <</ROLE>>"}


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), INSIDE, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _piece(role: Column, text: Column) -> Column:
    other = F.concat(F.lit(OPEN[None]), F.char_length(role).cast("string"), F.lit(" "), role, F.lit(" "), text, F.lit(CLOSE[None]))
    for known in ("system", "assistant", "user"):
        other = F.when(role == known, F.concat(F.lit(OPEN[known]), text, F.lit(CLOSE[known]))).otherwise(other)
    return other


def render(turns: Column, escape: bool) -> Column:
    """A conversation's string from its turns, an array of (role, text)."""
    keep = escaped if escape else (lambda x: x)
    body = F.array_join(F.transform(turns, lambda t: _piece(keep(t["role"]), keep(t["text"]))), "")
    return F.concat(F.lit(HEADER), body) if escape else body


def _pieces(formatted: Column) -> Column:
    """(mark, start, piece): start counts code points in the formatted string, from 0."""
    first = F.when(formatted.startswith(HEADER), len(HEADER)).otherwise(0)
    found = F.regexp_extract_all(F.substring(formatted, first + 1, F.char_length(formatted)), F.lit(PIECES), F.lit(0))
    at = lambda pieces: _sums(F.transform(pieces, F.char_length))
    return _let(found, lambda pieces: F.zip_with(at(pieces), pieces, lambda n, p: F.struct((first + n).cast("int").alias("start"), p.alias("piece"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; a lambda computes anew whatever it captures, for every element."""
    return F.transform(F.array(value), body)[0]


def _sums(sizes: Column) -> Column:
    """The sum before each of n numbers, in about n ** 1.5 steps: a fold that appends copies its array, so it runs over blocks."""
    none = F.expr("cast(array() as array<bigint>)")
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def running(numbers: Column) -> Column:
        return F.aggregate(
            numbers,
            F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("got")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got")),
            lambda acc: acc["got"],
        )

    def summed(blocks: Column) -> Column:
        return F.flatten(F.zip_with(running(F.transform(blocks, total)), blocks, lambda at, block: F.transform(running(block), lambda x: x + at)))

    def cut(sizes: Column, width: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), width), lambda k: k * width < F.size(sizes))
        return F.transform(starts, lambda k: F.slice(sizes, k * width + 1, width))

    width = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
    return _let(sizes, lambda v: _let(width(v), lambda w: _let(cut(v, w), summed)))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: an array of (role, text, start, end, loss).

    start and end bound the text as written in the string, in code points; loss marks assistant texts.
    """
    back = formatted.startswith(HEADER)

    def turn(x: Column) -> Column:
        p = x["piece"]
        inner = lambda kind: F.substring(p, F.lit(len(OPEN[kind]) + 1), F.char_length(p) - len(OPEN[kind]) - len(CLOSE[kind]))
        whole = inner(None)
        digits = F.regexp_extract(whole, r"^(\d{1,9}) ", 1)
        size = F.coalesce(digits.try_cast("int"), F.lit(0))
        skip = F.char_length(digits) + 1 + size + 1
        cases = (
            (p.startswith("<s>[INST] "), F.lit("user"), inner("user"), F.lit(len(OPEN["user"]))),
            (p.startswith("<<SYS>> "), F.lit("system"), inner("system"), F.lit(len(OPEN["system"]))),
            (p.startswith("<<ROLE>> "), F.substring(whole, F.char_length(digits) + 2, size), F.substring(whole, skip + 1, F.char_length(whole)), skip + len(OPEN[None])),
        )
        role, text, lead = F.lit("assistant"), inner("assistant"), F.lit(len(OPEN["assistant"]))
        for hit, r, t, n in cases[::-1]:
            role, text, lead = F.when(hit, r).otherwise(role), F.when(hit, t).otherwise(text), F.when(hit, n).otherwise(lead)
        plain = lambda c: F.when(back, unescaped(c)).otherwise(c)
        start = x["start"] + lead
        return F.struct(plain(role).alias("role"), plain(text).alias("text"), start.alias("start"), (start + F.char_length(text)).alias("end"), (~F.rlike(p, F.lit(r"^<(s>\[INST\] |<SYS>> |<ROLE>> )"))).alias("loss"))

    return F.transform(_pieces(formatted), turn)


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (role, text)."""
    row = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, read: strings that read back as their source, and what was read from them."""
    source = lambda t: F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    tried = conversations_of(turns).withColumn("formatted", render(F.col("turns"), False))
    tried = tried.withColumn("read", parse(F.col("formatted"))).withColumn("escaped", ~source(F.col("read")).eqNullSafe(F.col("turns")))
    tried = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("formatted")))
    tried = tried.withColumn("read", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("read")))
    same = source(F.col("read")).eqNullSafe(F.col("turns"))
    return tried.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not read back"))).alias("formatted"), "escaped", "read")


def _spans(read: Column) -> Column:
    return F.transform(F.filter(read, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, spans: the string of every conversation and its loss mask, read back from it."""
    return _formatted(turns).select("conv_id", "formatted", "escaped", _spans(F.col("read")).alias("spans"))


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted strings alone: turns, their digest, the loss text and its digest."""
    out = _formatted(turns)
    loss = F.array_join(F.transform(F.filter("read", lambda x: x["loss"]), lambda x: x["text"]), "")  # what the spans cut out, without a walk from the string's head for each
    text = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_INSIDE = r"(<|\[)(/?s>|</?SYS>>|</?ROLE>>|/?INST\]|ESC\])"

ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '{_SQL_INSIDE}', '\1\\\2', 'g'), '{_SQL_INSIDE}', '\1\\\2', 'g') AS etext,
    regexp_replace(regexp_replace(replace(role, '\', '\\'), '{_SQL_INSIDE}', '\1\\\2', 'g'), '{_SQL_INSIDE}', '\1\\\2', 'g') AS erole
  FROM t
), p AS (
  SELECT *,
    CASE role WHEN 'user' THEN '<s>[INST] ' || text || ' [/INST]' WHEN 'assistant' THEN ' ' || text || ' </s>' WHEN 'system' THEN '<<SYS>> ' || text || ' <</SYS>>'
      ELSE '<<ROLE>> ' || length(role) || ' ' || role || ' ' || text || ' <</ROLE>>' END AS piece,
    CASE erole WHEN 'user' THEN '<s>[INST] ' || etext || ' [/INST]' WHEN 'assistant' THEN ' ' || etext || ' </s>' WHEN 'system' THEN '<<SYS>> ' || etext || ' <</SYS>>'
      ELSE '<<ROLE>> ' || length(erole) || ' ' || erole || ' ' || etext || ' <</ROLE>>' END AS epiece
  FROM e
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text) AS plain,
    '[ESC]' || string_agg(epiece, '' ORDER BY turn NULLS FIRST, role, text) AS esc,
    list(piece ORDER BY turn NULLS FIRST, role, text) AS pieces
  FROM p GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CASE WHEN NOT starts_with(plain, '[ESC]') AND regexp_extract_all(plain, '{PIECES}') = pieces THEN length(plain) ELSE length(esc) END AS formatted_chars
FROM g
"""

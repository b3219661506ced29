"""Column functions over text. All are built-in expressions and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds, ignored folders, chunk kinds, and words that are no reference in script code.
GO_EXTENSIONS = (".go",)
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
MARKDOWN_EXTENSIONS = (".md", ".markdown")
EXTENSIONS = GO_EXTENSIONS + SCRIPT_EXTENSIONS + MARKDOWN_EXTENSIONS
IGNORED_FOLDERS = ("node_modules", "vendor", "dist", "build")
KINDS = ("Function", "Method", "Struct", "Interface", "Class", "Type", "Section", "Frontmatter", "Preamble")
MODES = ("IGNORE", "SKELETON", "FULL")

SCRIPT_WORDS = (
    "function", "const", "let", "var", "return", "if", "else", "for", "while", "do", "switch", "case", "break", "continue",
    "class", "interface", "type", "extends", "implements", "import", "export", "from", "as", "default",
    "null", "undefined", "true", "false", "new", "this", "super", "void",
    "public", "private", "protected", "readonly", "static", "abstract",
    "try", "catch", "finally", "throw", "async", "await", "yield", "typeof", "instanceof", "in", "of", "delete",
    "string", "number", "boolean", "any", "unknown", "never", "object", "console", "log", "error", "warn",
)
# Fixed values too: what a link or image, and what an include, looks like.
LINK = r"!?\[[^\]]+\]\(([^)\t\n\f\r ]+)"
INCLUDE = r"(?:\{\{[\t\n\f\r ]*(?:include|>)[\t\n\f\r ]+|\[\[)([^}\]\t\n\f\r ]+)"

_WHITE = "\t\n\f\r "


def trim_ws(c: Column) -> Column:
    """Strips Unicode white space from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def left_trim(c: Column) -> Column:
    """Strips spaces and tabs from the left."""
    return F.regexp_replace(c, r"^[ \t]+", "")


def right_trim_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n+\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def language(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*GO_EXTENSIONS), "go").when(e.isin(*SCRIPT_EXTENSIONS), "script").when(e.isin(*MARKDOWN_EXTENSIONS), "markdown").otherwise("unknown")


def visible(path: Column, ignored: tuple[str, ...] = IGNORED_FOLDERS) -> Column:
    """No folder on the path is ignored or begins with a dot; the file's own name does not matter."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return ~F.exists(folders, lambda d: d.isin(*ignored) | d.startswith("."))


def relative(path: Column, root: str) -> Column:
    """A path below a root, scheme and root gone."""
    bare = F.regexp_replace(path, r"^file:/{0,2}(?=/)", "")
    root = root.rstrip("/") + "/"
    return F.when(bare.startswith(root), F.substring(bare, F.lit(len(root) + 1), F.char_length(bare))).otherwise(bare)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def _heading(line: Column) -> tuple[Column, Column]:
    """The marks and the title of a heading line, both empty for other lines; every step is linear in the line."""
    line = F.rtrim(line, F.lit(" \t"))
    marks = F.regexp_extract(line, r"^(#{1,6}+)(?=[\t\n\f\r ])", 1)
    rest = F.substring(line, F.char_length(marks) + 1, F.char_length(line))
    title = F.ltrim(rest, F.lit(_WHITE))
    bare = F.rtrim(F.rtrim(F.rtrim(title, F.lit(_WHITE)), F.lit("#")), F.lit(_WHITE))
    blank = F.when(F.char_length(rest) > 1, F.right(rest, F.lit(1))).otherwise("")  # a title of white space alone keeps its last character
    title = F.when(title == "", blank).when(bare == "", F.left(title, F.lit(1))).otherwise(bare)
    lone = F.when((marks == "") | F.contains(line, F.lit("\n")), "").otherwise(title)
    return F.when(lone == "", "").otherwise(marks), lone


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading, else 0."""
    return F.char_length(_heading(line)[0])


def heading_title(line: Column) -> Column:
    return _heading(line)[1]


def signature(body: Column) -> Column:
    """The first line that is code: not blank and no comment; failing that the first line that is not blank."""
    lines = F.transform(F.split(body, "\n", -1), left_trim)
    code = F.filter(lines, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("/*") & ~x.startswith("*"))
    text = F.filter(lines, lambda x: x != "")
    return F.coalesce(F.try_element_at(code, F.lit(1)), F.try_element_at(text, F.lit(1)), F.lit(""))


def qualified(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def keep_refs(refs: Column) -> Column:
    """Local references only, each once, in first-seen order."""
    return F.array_distinct(F.filter(refs, lambda r: (r != "") & ~r.rlike(r"^(https?://|mailto:|#)")))


def markdown_refs(body: Column) -> Column:
    """Targets of links and images, then of includes: {{include x}}, {{> x}} and [[x]]; each once."""
    names = F.regexp_extract_all(body, F.lit(INCLUDE), F.lit(1))
    return keep_refs(F.concat(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)), names))


def known_kind(kind: Column) -> Column:
    """A chunk kind; one that is not known is a Type."""
    return F.when(kind.isin(*KINDS), kind).otherwise("Type")


def script_refs(body: Column) -> Column:
    return F.array_except(identifiers(body), F.array(*(F.lit(w) for w in SCRIPT_WORDS)))


def identifiers(body: Column) -> Column:
    """Identifier tokens of script code, each once, two letters or more; comments count as text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(body, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)), lambda r: F.char_length(r) >= 2))


def mode_rank(mode: Column) -> Column:
    return F.when(mode == "FULL", 2).when(mode == "SKELETON", 1).otherwise(0)


def parse_mode(mode: Column) -> Column:
    """Trimmed and in capitals; anything unknown is IGNORE."""
    m = F.upper(trim_ws(mode))
    return F.when(m.isin(*MODES), m).otherwise("IGNORE")


_NAMED = {"\a": "a", "\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t", "\v": "v", '"': '"', "\\": "\\"}


def quoted(c: Column) -> Column:
    """A double-quoted string. Letters, marks, numbers, punctuation, symbols and spaces stand; other characters are escaped by name or by number."""

    def escaped(x: Column) -> Column:
        at, out = F.ascii(x), F.when(x.rlike(r'^[\p{L}\p{M}\p{N}\p{P}\p{S} ]$') & ~x.isin('"', "\\"), x)
        for raw, name in _NAMED.items():
            out = out.when(x == raw, "\\" + name)
        digits = lambda lead, n: F.concat(F.lit("\\" + lead), F.lower(F.lpad(F.hex(at), n, "0")))
        return out.when(at < 0x80, digits("x", 2)).when(at < 0x10000, digits("u", 4)).otherwise(digits("U", 8))

    plain = ~c.rlike(r'[^\x20-\x7e]|["\\]')
    return F.concat(F.lit('"'), F.when(plain | (c == ""), c).otherwise(F.array_join(F.transform(F.split(c, "", -1), escaped), "")), F.lit('"'))


def join_sections(parts: Column) -> Column:
    """Parts that are not empty, a blank line between them."""
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def end_separated(c: Column) -> Column:
    """A text ends in one blank line, an empty one stays empty."""
    return F.when(c == "", "").otherwise(F.concat(right_trim_newlines(c), F.lit("\n\n")))


def find_body(content: Column, body: Column) -> tuple[Column, Column]:
    """Start (from 1, 0: nowhere) and length of a body in a content: as it stands, else trimmed."""
    bare = trim_ws(body)
    exact, loose = F.instr(content, body), F.instr(content, bare)
    use = (exact == 0) & (bare != "") & (bare != body)
    return F.when(use, loose).otherwise(exact), F.char_length(F.when(use, bare).otherwise(body))


def splice(content: Column, start: Column, size: Column, new: Column) -> Column:
    return F.concat(F.substring(content, F.lit(1), start - 1), new, F.substring(content, start + size, F.char_length(content)))


def cut(content: Column, start: Column, size: Column) -> Column:
    """Removes a range with the surplus line ends around it, so that one separation is left.

    Before the range line ends go as long as another line end (or the text's beginning) stands before
    them, after it as long as another one (or the text's end) follows.
    """
    left = F.substring(content, F.lit(1), start - 1)
    right = F.substring(content, start + size, F.char_length(content))
    left = F.regexp_replace(left, r"(?<=\n)\n+\z|\A\n+\z", "")
    right = F.when(right.rlike(r"\A\n+\z"), "").otherwise(F.regexp_replace(right, r"\A\n+(?=\n)", ""))
    return F.concat(left, right)


def unfenced(c: Column) -> Column:
    """The inside of a text that stands in a code fence; white space around goes."""
    bare = F.regexp_replace(trim_ws(c), r"\A(```json|```)", "")
    return trim_ws(F.regexp_replace(bare, r"```\z", ""))


def listed(c: Column) -> Column:
    """The parts of a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ",", -1), trim_ws), lambda x: x != "")


def indented(c: Column, prefix: str) -> Column:
    """Every line that is not empty behind a prefix."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(prefix), x))), "\n")

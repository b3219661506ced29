"""Documents with every awkward case: nulls, empty and long texts, repeated rows, ties, clashing columns."""

#: Names that operators use inside, as a table may have them too.
NAMES = ("row", "key", "sha", "bucket", "name", "rid", "rep", "n", "label", "body", "digest", "__sha", "__bucket", "__toxicity", "__id", "__text", "a.b")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept boolean, " + ", ".join(f"`{x}` string" for x in NAMES)
OWN = [f"own {x}" for x in NAMES]


def awkward(spark, extra=()):
    rows = [
        (1, "The Quick brown fox jumps over the lazy dog", "en"),
        (2, "the quick BROWN fox jumps over the lazy dog", "en"),
        (3, None, None),
        (4, "", "de"),
        (4, "", "de"),
        (None, "a text with no id at all here", "fr"),
        (5, " \t\n ", "en"),
        (6, "Ünïcödé ÀÉ text É ß 漢字 😀 end", "de"),
        (7, "word " * 30000, "en"),
        (8, "reach me at foo.bar@mail.example.com or +1 (555) 123-4567, 4111 1111 1111 1111 from 10.0.0.1", "en"),
        *extra,
    ]
    return spark.createDataFrame([(i, t, g, "s", None, 0.5, 3, True, *OWN) for i, t, g in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def intact(kept, docs, text="text"):
    """Whether a stage's rows have the columns and the other values of its input."""
    return kept.schema.simpleString() == docs.schema.simpleString() and all(list(r)[-len(OWN) :] == OWN and r.source == "s" and r.score == 0.5 and r.shard == 3 for r in kept.collect())

"""Rows for the operators' tests: awkward cases in one small table."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, owner string, fp string, live string, hits string"

PLAIN = "The quick brown fox jumps over the lazy dog near the river bank today."


def docs(spark, rows):
    """A documents table of (doc_id, text, source), with columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, None if t is None else len(t), *["x"] * 6) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def awkward():
    """Null and empty texts, a null id, a null source, ties, repeated rows, a very long text and a very long word."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    return [
        (1, None, "a"), (2, "", "a"), (None, PLAIN, None), (3, PLAIN, "b"), (3, PLAIN, "b"), (4, PLAIN, None), (5, long_text, "c"),
        (6, "x" * 30_000, "c"), (7, "  \t\n ", "d"), (8, "Ünïcödé ﬁ ▁ 梦 \U0001f600 é", "e"), (-9, "one", "e"), (10, "one two", "f"),
    ]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

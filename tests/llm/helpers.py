"""Small tables with the awkward cases every operator has to survive."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, fp string, n_words string"


def docs(spark, texts, sources=None):
    """Documents with ids 0.. and extra columns whose names clash with results."""
    rows = [(k, t, "en", (sources[k] if sources else "s0"), len(t or ""), "x", "y", "z", "w") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Null id, null text, null source, empty text, repeated rows, a very long text."""
    rows = [
        (None, "alpha beta gamma", "en", "s0", 1, None, None, None, None),
        (1, None, None, None, None, None, None, None, None),
        (2, "", "en", "s0", 0, "x", "y", "z", "w"),
        (3, "same row of text", "en", "s1", 5, "x", "y", "z", "w"),
        (3, "same row of text", "en", "s1", 5, "x", "y", "z", "w"),
        (4, "longer " * 60000, "en", "s0", 9, "x", "y", "z", "w"),
        (5, " \t\n\x0b ", "en", None, 9, "x", "y", "z", "w"),
        (6, "éè 中文 \U0001f600 café", "fr", "s2", 9, "x", "y", "z", "w"),
    ]
    return spark.createDataFrame(rows, DOCS)

"""Small tables with the awkward rows every operator must take."""

import random


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward_rows():
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "été", "straße", "x", "42", "|", "the"]
    long = " ".join(rng.choice(words) for _ in range(6_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, long), (7, long), (7, long), (None, "no id here at all"), (9, "!!! ??? ..."), (10, "tab\tand\rcarriage\x0bvertical\x00nul")]


def with_clashes(df):
    """Extra columns whose names operators might use inside."""
    for name in ("fp", "key", "unit", "a", "b", "root", "hash", "n", "words", "ids", "score", "shard", "size", "lines", "did", "th", "value", "count"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def random_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))



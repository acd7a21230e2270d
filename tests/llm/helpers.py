"""Small tables and comparisons for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0, **extra):
    """documents from a list of texts, or of (doc_id, text), with columns whose names clash with inner ones."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    out = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows],
                                DOCS + ", node string, k1 int, _block string")
    return out


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}

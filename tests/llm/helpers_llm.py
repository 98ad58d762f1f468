"""Small fixtures for the corpus operator tests."""

import random

DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """rows: (doc_id, text[, source]); ``extra``: clashing column names to add."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(data, DOC_DDL)
    for name in extra:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def words(n, seed=0, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}

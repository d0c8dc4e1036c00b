"""Rows and brute-force versions shared by the operator tests."""
from __future__ import annotations

import math
import re
from collections import Counter

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def odd_docs(spark, extra: str = ""):
    """Nulls in every column, empty and long texts, repeated rows, equal texts, odd characters; and
    columns with the names of results."""
    prose = "the cat and the dog went to the sea. It was a fine day in the sun,\n"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, "one", "en", None),
        (5, prose * 3, "en", "a"), (5, prose * 3, "en", "a"), (6, prose * 3, "en", "b"),
        (7, "A b\nA b\n\nA b c # $ <x>|", "en", "a"), (8, "x " * 40, "fr", "a"), (9, "日本語 テキスト 😀 é ß", "ja", "c"),
        (10, "w%d " * 1 % 3 + " ".join(f"word{i} of" for i in range(30_000)), "en", "a"),
        (11, "a\x0bb\x0cc\rd\x1ce\xa0f", "en", "a"), (None, "no id at all here", "en", "a"),
        (12, " ".join(f"tok{i % 7}" for i in range(60)), "en", "c"), (13, "###$$$ " * 30, "en", "a"),
        (14, "in the sea the day was fine and it is a day of sun " + " ".join(f"q{i}" for i in range(60)), "en", "b"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    for name in ("score", "kept", "n_words", "_t", "_w", "_row", "_id", "_n", "_fp", "topic", "ids", "shard", "_x", "_p", *extra.split()):
        df = df.withColumn(name, F.lit("mine"))
    return df


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def divergence(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return sum((a * math.log2(a / c) if a > 0 else 0) + (b * math.log2(b / c) if b > 0 else 0)
               for a, b, c in zip(p, q, m, strict=True)) / 2


def same_as_oracle(spark, name, tables=("documents",), sf=SF):
    import duckdb

    import __spark_entry__ as E
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = E.queries()[name](spark, sf)
    res = con.execute(E.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(d[0] for d in res.description)
    at = {d[0]: i for i, d in enumerate(res.description)}

    def norm(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v
    want = Counter(tuple(norm(r[at[c]]) for c in cols) for r in res.fetchall())
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == want

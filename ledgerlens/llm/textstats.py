"""Whole-text statistics as native column expressions.

Words are runs of anything but the six ASCII white-space characters. All statistics are
defined for null texts (taken as empty), empty texts and texts of any length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
#: What is left of a text without these runs holds every character of the rarer classes.
PLAIN = r"[a-z\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5


def only(text: Column, dropped: str) -> Column:
    """Characters of ``text`` left when every run matching ``dropped`` is taken out."""
    return F.length(F.regexp_replace(text, dropped, ""))


def pinned(value: Column) -> Column:
    """The value, computed where it stands: because it names the partition, the optimiser does not
    copy the expression into filters below, where arrays would be built anew for each use."""
    return F.when(F.spark_partition_id() >= 0, value)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def with_words(df: DataFrame, text: str = "text", out: str = "_w") -> DataFrame:
    """Add the word array, the text with null as empty (``_t``) and what is left of it without
    lower-case letters and white space (``_r``), on which rarer characters are counted."""
    return (df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
            .withColumn(out, words_of(F.col("_t")))
            .withColumn("_r", F.regexp_replace("_t", PLAIN, "")))


def with_base(df: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to a frame that
    has ``_t``, ``_w`` and ``_r``; the helper columns it makes are dropped again.

    The windows of five words are hashed row by row inside the array of one document, so
    nothing is shuffled. Texts whose windows are all distinct (nearly all) stop there; for
    the rest the (hash, position) pairs are sorted and the covered words counted.
    """
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = (df.withColumn("n_words", F.size("_w").cast("long"))
          .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
          .withColumn("n_symbols", only(F.col("_r"), SYMBOLS).cast("long"))
          .withColumn("_lines", lines)
          .withColumn("n_dup_lines",
                      (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
          .withColumn("_win", F.when(F.size("_w") > WINDOW, F.slice(F.transform(
              "_w", lambda w, i: F.xxhash64(w, *[F.get("_w", i + k) for k in range(1, WINDOW)])),
              1, F.size("_w") - WINDOW + 1)))
          .withColumn("_sorted", F.when(
              F.size(F.array_distinct("_win")) < F.size("_win"),
              F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
          .withColumn("_n", F.size("_sorted")))
    twice = F.filter("_sorted", lambda x, k: (
        (k > 0) & (F.get("_sorted", k - 1)["h"] == x["h"])
        | (k < F.col("_n") - 1) & (F.get("_sorted", k + 1)["h"] == x["h"])))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(at, start, lambda a, p: F.struct(
        (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"])
    return (df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .drop("_lines", "_win", "_sorted", "_n"))

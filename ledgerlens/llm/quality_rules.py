"""Quality rules: distribution divergence from language references (native).

Each document gets two histograms: character classes, and the common words of its language
plus two bins: words without a letter, and all other words. The references are the
same histograms summed over all documents of a language with at least ``min_chars``
non-space characters or ``min_words`` words; a language's common words are its ``n_common``
most frequent words of letters, of any length, taken as they stand in the text. A document is
rejected by a Jensen-Shannon divergence (base 2, so 0 to 1; the square of the distance, so limits on
it are limits on the distance) above ``max_class_js`` or ``max_word_js``. Guards: texts under
``min_words`` words or ``min_chars`` characters, and languages whose reference holds under
``min_reference_words`` words, are not judged by divergence.

Only DataFrame functions are used. The corpus is scanned for the references (partial
aggregates are shuffled, never texts; each partition keeps its ``n_common`` first words of a
language before the words of all partitions are ranked) and once more to score; the joined reference
has one row per language.

Defined cases: a null text is an empty text; null is a language of its own; an empty table
gives an empty result; repeated rows are each judged alone; equal word counts in the choice
of common words go to the lexicographically smaller word; very long texts and words are read whole; columns
beyond those named are not read, whatever their names. Windows of five words are taken as equal by
their 64-bit hashes.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.textstats import PLAIN, only, pinned, with_base, with_words, words_of
from ledgerlens.session import materialize

#: Characters of each class, as the runs that are NOT of the class.
CLASS_RUNS = {"upper": r"[^A-Z]+", "digit": r"[^0-9]+", "punct": r"""[^.,;:!?'"()\-]+""",
              "symbol": r"[^#*$%&|<>=+@/\\^_~{}\[\]`]+", "wide": r"[\x00-\x7F]+"}
CLASSES = ["lower", *CLASS_RUNS]
LETTER = r"\p{L}"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "class_js", "word_js", "base_failed", "kept"]


@dataclass(frozen=True)
class Rules:
    min_n_words: int = 10
    max_repeat_pct: int = 20
    min_words: int = 50
    min_chars: int = 200
    n_common: int = 32
    min_reference_words: int = 1000
    max_class_js: float = 0.10
    max_word_js: float = 0.15


def with_classes(df: DataFrame) -> DataFrame:
    """Add ``_c``: the non-space characters of the text by class, in the order of CLASSES, from
    ``word_chars`` and ``_r`` (the text without lower-case letters and white space)."""
    rare = [only(F.col("_r"), runs).cast("long") for runs in CLASS_RUNS.values()]
    df = df.withColumn("_rare", F.array(*rare))
    listed = F.aggregate("_rare", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("_c", F.concat(F.array(F.col("word_chars") - listed), "_rare")).drop("_rare")


def with_other(shares: str) -> Column:
    """The shares and, last, what is left to one."""
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language: ``ref_c`` (class shares), ``ref_words``, ``ref_p`` (shares of the
    common words, of words without a letter and of all others), ``ref_n`` (words behind it). Classes are summed over
    texts of ``min_chars`` non-space characters or more, words over texts of ``min_words``."""
    n = len(CLASSES)
    text = docs.select("lang", F.coalesce("text", F.lit("")).alias("_t"))
    chars = text.select("lang", F.regexp_replace("_t", PLAIN, "").alias("_r"),
        pinned(F.length("_t") - only(F.col("_t"), r"[^\x20\x09-\x0D]+")).cast("long").alias("word_chars"))
    classes = (with_classes(chars.where(F.col("word_chars") >= rules.min_chars)).groupBy("lang")
               .agg(*[F.sum(F.col("_c")[i]).alias(f"c{i}") for i in range(n)]))
    total = sum((F.col(f"c{i}") for i in range(n)), F.lit(0))
    classes = classes.select("lang", F.array(*[F.col(f"c{i}") / total for i in range(n)]).alias("ref_c"))
    words = text.select("lang", pinned(words_of(F.col("_t"))).alias("_w")).where(F.size("_w") >= rules.min_words)
    counts = words.select("lang", F.explode("_w").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "word-counts")
    marks = F.when(~F.col("word").rlike(LETTER), F.col("n")).otherwise(0)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("ref_n"), F.sum(marks).alias("ref_marks"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (counts.where(F.col("word").rlike(r"^\p{L}+$")).withColumn("k", F.row_number().over(order))
           .where(F.col("k") <= rules.n_common).groupBy("lang")
           .agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top")))
    same = F.col("a.lang").eqNullSafe(F.col("b.lang"))
    both = totals.alias("a").join(top.alias("b"), same).select("a.lang", "ref_n", "ref_marks", "top")
    both = both.select("lang", "ref_n", F.transform("top", lambda x: x["word"]).alias("ref_words"),
                       F.concat(F.transform("top", lambda x: x["n"] / F.col("ref_n")),
                                F.array(F.col("ref_marks") / F.col("ref_n"))).alias("_p"))
    both = both.select("lang", "ref_n", "ref_words", with_other("_p").alias("ref_p"))
    return (both.alias("a").join(classes.alias("b"), same)
            .select("a.lang", "ref_n", "ref_words", "ref_p", "ref_c")
            .where(F.col("ref_n") >= rules.min_reference_words))


def jensen_shannon(p: str, q: str) -> Column:
    """Base-2 Jensen-Shannon divergence of two arrays of shares."""
    def half(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2


def judge(docs: DataFrame, refs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add the base statistics, ``class_js``, ``word_js`` (null where a guard holds),
    ``base_failed`` and ``kept`` to every row of ``docs`` (columns ``text`` and ``lang``).

    The row count never changes: the reference has one row per language. Existing columns
    of the names it adds are replaced."""
    docs = docs.drop(*ADDED)
    df = docs.select(F.struct("*").alias("_row"), "text", "lang")
    df = with_base(with_words(df))
    df = with_classes(df)
    refs = refs.withColumnRenamed("lang", "_ref_lang")
    df = df.join(F.broadcast(refs), F.col("lang").eqNullSafe(F.col("_ref_lang")), "left")
    judged = ((F.col("n_words") >= rules.min_words) & (F.col("word_chars") >= rules.min_chars)
              & F.col("ref_n").isNotNull())
    df = df.withColumn("_pc", F.when(judged, F.transform("_c", lambda x: x / F.col("word_chars"))))
    df = df.withColumn("_common", F.when(judged, F.filter("_w", lambda w: F.array_contains("ref_words", w))))
    hits = F.transform("ref_words", lambda k: (
        F.size("_common") - F.size(F.array_remove("_common", k))) / F.col("n_words"))
    # most words begin with a letter of ASCII, which a comparison tells without the pattern
    marks = F.size(F.filter("_w", lambda w: ~w.between("a", "z") & ~w.between("A", "Z") & ~w.rlike(LETTER))) / F.col("n_words")
    df = df.withColumn("_hits", F.when(judged, F.concat(hits, F.array(marks))))
    df = df.withColumn("_pw", with_other("_hits"))
    df = (df.withColumn("class_js", F.round(jensen_shannon("_pc", "ref_c"), 9))
          .withColumn("word_js", F.round(jensen_shannon("_pw", "ref_p"), 9)))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.min_n_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")))
    diverges = ((F.col("class_js") > rules.max_class_js) | (F.col("word_js") > rules.max_word_js))
    df = df.withColumn("kept", pinned(~F.col("base_failed") & ~F.coalesce(diverges, F.lit(False))))
    return df.select("_row.*", *ADDED)


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``judge`` against the references of the same documents."""
    return judge(docs, references(docs, rules), rules)

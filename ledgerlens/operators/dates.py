"""The format of a text date column, by vote.

Every row votes for each candidate format that parses it; the counts add up, so one pass over the column with
partial aggregates settles the format before anything is cleaned. Day-first and month-first formats part at
values over 12; where no value tells them apart the column is ambiguous: month first is taken, as is
usual where nothing is said, and the choice says so.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "[ H:mm[:ss]]"
#: Name, shape (a format is tried on texts of its shape only) and pattern; ties go to the earlier one.
CANDIDATES = [
    ("iso", r"^\s*\d{4}-\d", None),
    *[(f"{order}{sep}{years}", rf"^\d{{1,2}}{cut}\d{{1,2}}{cut}\d{{{len(years)}}}(?!\d)", f"{pattern}{sep}{years}{TIME}")
      for sep, cut in (("/", "/"), ("-", "-"), (".", r"\.")) for years in ("yyyy", "yy")
      for order, pattern in ((f"month{sep}day", f"M{sep}d"), (f"day{sep}month", f"d{sep}M"))],
    ("yyyy/month/day", r"^\d{4}/", f"yyyy/M/d{TIME}"),
    ("yyyymmdd", r"^\d{8}$", "yyyyMMdd"),
    ("day-name-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}", f"d-MMM-yyyy{TIME}"),
    ("day name yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}", f"d MMM yyyy{TIME}"),
    ("name day, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}", f"MMM d, yyyy{TIME}"),
]


@dataclass(frozen=True)
class DateChoice:
    name: str                   # of the candidate
    pattern: str | None         # None: ISO text
    values: int                 # rows with a date text
    parsed: int                 # of them, rows that the format parses
    ambiguous: bool             # another order of day and month parses as many

    @property
    def failed_share(self) -> float:
        return 1 - self.parsed / self.values if self.values else 0.0


def parse(text: Column, pattern: str | None) -> Column:
    """Text as a naive timestamp; NULL where it does not fit."""
    if pattern is None:
        return text.try_cast("timestamp_ntz")
    return F.try_to_timestamp(F.trim(text), F.lit(pattern)).cast("timestamp_ntz")


def date_votes(df: DataFrame, column: str = "date") -> DataFrame:
    """candidate, n_parsed and n_values: for each candidate the rows that it parses."""
    text = F.col(f"`{column}`").cast("string")
    counts = df.select(text.alias("t")).agg(
        F.count("t").alias("n_values"),
        *[F.count_if(F.when(F.trim("t").rlike(shape), parse(F.col("t"), pattern)).isNotNull()).alias(f"c{k}")
          for k, (_, shape, pattern) in enumerate(CANDIDATES)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(name).alias("candidate"), F.col(f"c{k}").alias("n_parsed"))
                               for k, (name, _, _) in enumerate(CANDIDATES)]))
    return counts.select(rows.alias("r"), "n_values").select("r.nth", "r.candidate", "r.n_parsed", "n_values")


def choose_date_format(df: DataFrame, column: str = "date") -> DateChoice | None:
    """The elected format of a text column; None for typed dates."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    votes = sorted(date_votes(df, column).collect(), key=lambda r: (-r["n_parsed"], r["nth"]))      # a row per candidate
    best = votes[0]
    tied = [r for r in votes if r["n_parsed"] == best["n_parsed"] and r["n_parsed"]]
    name, _, pattern = CANDIDATES[best["nth"]]
    return DateChoice(name, pattern, best["n_values"], best["n_parsed"], len(tied) > 1)

"""Mixing sources to target weights by iterative proportional fitting (native).

The documents are summed once to cells (one row for every combination of margin levels that
occurs: source, language, topic) with their tokens. Raking then works on factors, one per
margin level: each step sets the factors of one margin so that the weighted tokens of every
level meet its target share, given the factors of the other margins. Sweeps over the margins
repeat until no factor moves by more than ``tolerance`` or, where targets contradict each other,
until the margin errors have stopped shrinking; ``max_sweeps`` can bound them. Targets still missed
are reported by a warning, and ``Factors`` holds the sweeps made and the greatest error left. The
codes and tokens of up to ``LOCAL_CELLS`` cells are swept on the driver; for more cells a step is a
partial aggregate over the cells, so a level that holds most tokens costs one row a task, its factor
table is written to the checkpoint folder, and a few numbers per step reach the driver. The product
of a cell's factors, scaled so that the largest is one, is the probability with which each of its
documents is kept: the expected tokens of every margin level are then in proportion to the targets
up to the error reported. The draw is a hash of seed and id, so it is the same on every run and layout.

Default targets are the observed token shares to the power ``temper`` (below one: rare levels
are drawn relatively more often).

Defined cases: null is a level of its own; null and empty texts hold no tokens, and a document
of a cell without tokens has probability 0; a target level that no document has is left out and
a level without target (or a null or negative one) gets 0; rows that share an id and a cell are
kept or dropped together; an empty table gives an empty result; extra columns pass through,
columns named like a result are replaced.
"""
from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.textstats import only, pinned, words_of
from ledgerlens.session import materialize

ADDED = ["topic", "n_tokens", "probability", "sampled"]
#: Cells whose codes and tokens (32 bytes each) are swept on the driver.
LOCAL_CELLS = 200_000
#: Errors that shrank by less than a thousandth over a window of sweeps have stopped shrinking.
WINDOW, SHRINKING = 100, 0.999
#: Share of the tokens by which a level may miss its target without a warning.
MISSED = 1e-6


@dataclass(frozen=True)
class Mix:
    temper: float = 0.8
    tolerance: float = 1e-10
    max_sweeps: int | None = None
    rate: float = 1.0
    seed: int = 7


def text_form(text: Column, n_words: Column) -> Column:
    """A topic by form: marked-up text, lists, short notes or prose."""
    marks = only(text, r"[^#*$%&|<>=+@/\\^_~{}\[\]`]+")
    lines = F.length(text) - F.length(F.regexp_replace(text, "\n", "")) + 1
    return (F.when(marks * 20 > n_words, "markup").when(n_words < 6 * lines, "list")
            .when(n_words < 200, "note").otherwise("prose"))


class Factors(dict):
    """Factor table (level, factor, log_factor) of every margin, the sweeps made, and by how much of the
    tokens the worst level misses its target share."""

    def __init__(self, tables: dict[str, DataFrame], sweeps: int, error: float):
        super().__init__(tables)
        self.sweeps, self.error = sweeps, error


def settle(sweep: Callable[[], tuple[float, float]], mix: Mix) -> int:
    """Sweep (each gives the greatest movement and the sum of the margin errors) until settled; the
    number of sweeps."""
    done, best, before = 0, math.inf, math.inf
    while mix.max_sweeps is None or done < mix.max_sweeps:
        moved, error = sweep()
        done, best = done + 1, min(best, error)
        if moved <= mix.tolerance:
            break
        if done % WINDOW == 0:
            if best > before * SHRINKING:
                break
            before = best
    return done


def rake(cells: DataFrame, keys: list[str], targets: dict[str, DataFrame], mix: Mix = Mix()) -> Factors:
    """Factors of every margin. ``cells``: keys and ``tokens``; ``targets``: by key, (level, share).
    Shares are taken in proportion, over the levels that have tokens."""
    return (rake_local if cells.count() <= LOCAL_CELLS else rake_spread)(cells, keys, targets, mix)


def rake_local(cells: DataFrame, keys: list[str], targets: dict[str, DataFrame], mix: Mix) -> Factors:
    coded, levels, share, ids = cells, {}, {}, {}
    for k in keys:
        found = cells.select(F.col(k).alias("level")).distinct()
        levels[k] = materialize(found.select("level", F.monotonically_increasing_id().alias("_i")), f"levels-{k}")
        coded = coded.join(levels[k].select(F.col("level").alias("_l"), F.col("_i").alias(f"_i_{k}")),
                           F.col(k).eqNullSafe(F.col("_l"))).drop("_l")
        goal = targets[k].select(F.col("level").alias("_l"), "share")
        rows = levels[k].join(goal, F.col("level").eqNullSafe(F.col("_l")), "left").select("_i", "share").orderBy("_i").collect()
        ids[k] = np.array([r[0] for r in rows], np.int64)
        share[k] = np.array([max(r[1] or 0.0, 0.0) for r in rows], float)
        share[k] /= share[k].sum() or 1.0
    rows = coded.select("tokens", *[f"_i_{k}" for k in keys]).collect()
    w = np.array([r[0] for r in rows], float)
    code = {k: np.searchsorted(ids[k], np.array([r[i + 1] for r in rows], np.int64)) for i, k in enumerate(keys)}
    logs = {k: np.zeros(len(ids[k])) for k in keys}

    def errors(k: str) -> tuple[np.ndarray, np.ndarray]:
        sums = np.bincount(code[k], w, len(ids[k]))
        return sums, np.abs(sums / (sums.sum() or 1.0) - share[k])

    def sweep() -> tuple[float, float]:
        nonlocal w
        moved, error = 0.0, 0.0
        for k in keys:
            sums, missed = errors(k)
            met = (share[k] > 0) & (sums > 0)
            ratio = np.zeros(len(sums))
            ratio[met] = share[k][met] / share[k][met].sum() / sums[met]
            moved, error = max(moved, np.abs(ratio[met] - 1).max(initial=0.0)), error + missed.sum()
            with np.errstate(divide="ignore"):
                logs[k] += np.log(ratio)
            w = w * ratio[code[k]]
        return moved, error

    sweeps = settle(sweep, mix)
    tables = {}
    for k in keys:
        rows = list(zip(ids[k].tolist(), logs[k].tolist(), strict=True))
        found = cells.sparkSession.createDataFrame(rows, "_j long, log_factor double")
        tables[k] = materialize(levels[k].join(found, F.col("_i") == F.col("_j")).select(
            "level", F.exp("log_factor").alias("factor"), "log_factor"), f"rake-{k}")
    return Factors(tables, sweeps, max(float(errors(k)[1].max(initial=0.0)) for k in keys))


def rake_spread(cells: DataFrame, keys: list[str], targets: dict[str, DataFrame], mix: Mix) -> Factors:
    tables: dict[str, DataFrame] = {}

    def weighted(key: str) -> DataFrame:
        """level, weighted tokens, target share and log factor so far of a margin."""
        rows, log = cells, F.log(F.col("tokens").cast("double"))
        for k, table in tables.items():
            f = table.select(F.col("level").alias("_l"), F.col("log_factor").alias(f"_f_{k}"))
            rows, log = rows.join(f, F.col(k).eqNullSafe(F.col("_l"))).drop("_l"), log + F.col(f"_f_{k}")
        was = F.max(f"_f_{key}") if key in tables else F.lit(0.0)
        sums = rows.groupBy(F.col(key).alias("level")).agg(F.sum(F.exp(log)).alias("w"), was.alias("was"))
        goal = targets[key].select(F.col("level").alias("_l"), "share")
        return sums.join(goal, F.col("level").eqNullSafe(F.col("_l")), "left").select(
            "level", "w", "was", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("share"))

    met = (F.col("share") > 0) & (F.col("w") > 0)

    def errors(found: DataFrame) -> tuple[float, float, float, float]:
        """The sum of the shares that can be met, the greatest movement, the sum of the errors, the greatest."""
        all_w, all_s, s = (x or 0.0 for x in found.agg(F.sum("w"), F.sum("share"), F.sum(F.when(met, F.col("share")))).first())
        missed = F.abs(F.col("w") / F.lit(all_w or 1.0) - F.col("share") / F.lit(all_s or 1.0))
        change = F.when(met, F.abs(F.col("share") / F.lit(s or 1.0) / F.col("w") - 1))
        return (s or 1.0, *(x or 0.0 for x in found.agg(F.max(change), F.sum(missed), F.max(missed)).first()))

    def sweep() -> tuple[float, float]:
        moved, error = 0.0, 0.0
        for k in keys:
            found = materialize(weighted(k), f"rake-{k}")
            s, change, missed, _ = errors(found)
            moved, error = max(moved, change), error + missed
            log = F.when(met, F.col("was") + F.log(F.col("share") / F.lit(s) / F.col("w"))).otherwise(F.lit(-math.inf))
            tables[k] = found.select("level", F.exp(log).alias("factor"), log.alias("log_factor"))
        return moved, error

    sweeps = settle(sweep, mix)
    return Factors(tables, sweeps, max(errors(materialize(weighted(k), f"rake-{k}"))[3] for k in keys))


def shares(cells: DataFrame, key: str, power: float) -> DataFrame:
    """Observed token shares of a margin to a power, summing to one."""
    sums = cells.groupBy(F.col(key).alias("level")).agg(F.pow(F.sum("tokens"), power).alias("s"))
    total = sums.agg(F.sum("s")).first()[0]
    return sums.select("level", (F.col("s") / F.lit(total)).alias("share"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None,
           mix: Mix = Mix()) -> DataFrame:
    """Add ``topic``, ``n_tokens`` (words), ``probability`` and ``sampled`` to every row. ``targets``
    gives (level, share) by ``source``, ``lang`` or ``topic``; the rest takes the default."""
    docs = docs.drop(*ADDED)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), "source", "lang",
                       F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.withColumn("n_tokens", pinned(F.size(words_of(F.col("_t"))).cast("long")))
    rows = rows.withColumn("topic", topic if topic is not None else text_form(F.col("_t"), F.col("n_tokens")))
    keys = ["source", "lang", "topic"]
    cells = materialize(rows.where("n_tokens > 0").groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "cells")
    goals = {k: materialize(shares(cells, k, mix.temper), f"target-{k}") for k in keys} | (targets or {})
    factors = rake(cells, keys, goals, mix)
    if factors.error > MISSED:
        warnings.warn(f"mixing: a level misses its target share by {factors.error:.3g} of the tokens "
                      f"after {factors.sweeps} sweeps", stacklevel=2)
    ratio = cells.select(*keys, F.lit(0.0).alias("r"))
    for k, f in factors.items():
        f = f.select(F.col("level").alias("_l"), "log_factor")
        ratio = (ratio.join(f, F.col(k).eqNullSafe(F.col("_l")))
                 .select(*keys, (F.col("r") + F.col("log_factor")).alias("r")))
    ratio = materialize(ratio, "ratios")
    most = ratio.agg(F.max("r")).first()[0]
    most = most if most is not None and math.isfinite(most) else 0.0
    ratio = ratio.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.exp(F.col("r") - F.lit(most)) * mix.rate).alias("_p"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_id").cast("string")))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    # The ratios are a written table of known size: Spark broadcasts it only below its threshold.
    rows = rows.join(ratio, same[0] & same[1] & same[2], "left").withColumn(
        "probability", F.coalesce("_p", F.lit(0.0))).withColumn("sampled", pinned(draw < F.col("probability")))
    return rows.select("_row.*", *ADDED)

"""Coarsened exact matching.

Covariates are binned, a stratum is one combination of bins, and strata holding both
arms are kept. The stratum counts are one aggregate; they grow with the data, so they
are joined back and never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable
from .keys import attach


def cut_bin(col: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points at or below the value; a missing value has no bin."""
    total = F.lit(0)
    for c in sorted(cuts):
        total = total + F.when(col >= F.lit(c), 1).otherwise(0)
    return F.when(col.isNotNull(), total).cast("int")


def sturges_bin(df: DataFrame, name: str) -> Column:
    """Equal-width bins, as many as Sturges' rule gives. The range is a scalar subquery."""
    v = F.col(name)
    shape = df.agg(F.struct(
        F.min(v).cast("double").alias("low"),
        ((F.max(v) - F.min(v)) / F.ceil(F.log2(F.count(v)) + 1)).cast("double").alias("width"),
        F.ceil(F.log2(F.count(v)) + 1).cast("int").alias("bins"),
    ).alias("s")).scalar()
    at = F.floor((v - shape["low"]) / F.nullif(shape["width"], F.lit(0.0)))
    return F.when(v.isNotNull(), F.least(F.coalesce(at, F.lit(0)), shape["bins"] - 1)).cast("int")


def coarsen(df: DataFrame, cuts: Mapping[str, Sequence[float]], exact: Sequence[str] = (),
            auto: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Add a `bin_` column per covariate; returns the frame and the bin names."""
    bins = {f"bin_{c}": cut_bin(F.col(c), points) for c, points in cuts.items()}
    bins |= {f"bin_{c}": F.col(c) for c in exact}
    bins |= {f"bin_{c}": sturges_bin(df, c) for c in auto}
    return df.withColumns(bins), list(bins)


def strata(df: DataFrame, bins: Sequence[str], treatment: str) -> DataFrame:
    """Treated and control counts of each stratum."""
    t = F.col(treatment)
    return df.groupBy(*bins).agg(F.count(F.when(t == 1, 1)).alias("m_t"),
                                 F.count(F.when(t == 0, 1)).alias("m_c"))


def cem(df: DataFrame, treatment: str, cuts: Mapping[str, Sequence[float]],
        exact: Sequence[str] = (), auto: Sequence[str] = ()) -> DataFrame:
    """Add `stratum` (a label of the bin tuple), `cem_matched` and `cem_weight`.

    Weights: treated 1; a control the treated-to-control ratio of its stratum over that
    of the whole matched sample; unmatched rows 0.
    """
    binned, bins = coarsen(df, cuts, exact, auto)
    binned = stable(binned)  # read for the stratum counts, their totals and the rows
    counts = strata(binned, bins, treatment)
    both = counts.filter((F.col("m_t") > 0) & (F.col("m_c") > 0))
    ratio = both.agg((F.sum("m_c") / F.sum("m_t")).alias("r")).scalar()
    out = attach(binned, counts, bins)
    matched = (F.col("m_t") > 0) & (F.col("m_c") > 0)
    weight = (F.when(~matched, 0.0).when(F.col(treatment) == 1, 1.0)
              .when(F.col(treatment) == 0, ratio * F.col("m_t") / F.col("m_c")).otherwise(0.0))
    return out.withColumns({"stratum": F.xxhash64(*bins), "cem_matched": matched.cast("int"),
                            "cem_weight": weight}).drop("m_t", "m_c")


def imbalance_l1(df: DataFrame, treatment: str, bins: Sequence[str],
                 weight: str | None = None) -> DataFrame:
    """Half the summed distance of the two arms' (weighted) shares over the strata."""
    w = F.col(weight) if weight else F.lit(1.0)
    t = F.col(treatment)
    shares = df.groupBy(*bins).agg(F.sum(F.when(t == 1, w).otherwise(0.0)).alias("wt"),
                                   F.sum(F.when(t == 0, w).otherwise(0.0)).alias("wc"))
    totals = shares.agg(F.struct(F.sum("wt").alias("t"), F.sum("wc").alias("c")).alias("s")).scalar()
    distance = F.abs(F.col("wt") / totals["t"] - F.col("wc") / totals["c"])
    return shares.agg((F.sum(distance) / 2).alias("l1"), F.count(F.lit(1)).alias("n_strata"))

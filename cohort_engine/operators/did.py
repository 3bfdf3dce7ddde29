"""Dynamic difference-in-differences with staggered switches into treatment.

The estimator compares the change in outcome of each switcher since its last
untreated period with the mean change of the units of equal first treatment that have
not switched yet (de Chaisemartin & D'Haultfoeuille, "Difference-in-Differences
Estimators of Intertemporal Treatment Effects").

How it is laid out for Spark, for all outcomes, specifications and subgroups at once:

1. `unit_profiles`: one aggregate per unit turns the long panel into one row holding
   the first treatment, the switch period and the outcomes by period. This is the only
   shuffle of the panel.
2. `cohorts`: units of equal first treatment and switch that are seen in the same periods are
   summed into one row, in one aggregate that reduces on the map side. `unit_cells` lays these rows
   out over the (switch period, horizon) cells that they serve as switchers or controls, and
   `cell_stats` sums them per cell.
3. A unit's influence is linear in its outcomes, with coefficients that are those of its cohort. So
   standard errors need a join of units with their cohort's coefficients (which adaptive execution
   plans by measured size and splits) and one product of arrays per horizon.

No step pairs units with units: the work is the rows of the panel times the horizons, and the
cells times the cohorts. Only where outcomes are missing at random are those nearly as many as units.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.missing import truth
from ..session import stable
from .keys import attach

Z95 = 1.959963984540054
MODEL = ["outcome", "spec", "subgroup"]
CELL = ["d1", "sf", "l"]
COHORT = [*MODEL, "d1", "f", "s", "seen"]


def _models(specs: Mapping[str, Mapping[str, Any]]) -> Column:
    """The (spec, subgroup) pairs a unit belongs to."""
    entries = []
    for i, (name, spec) in enumerate(specs.items()):
        subgroup = F.col(f"__by{i}") if spec.get("by") else F.lit("all")
        entry = F.struct(F.lit(name).alias("spec"), subgroup.alias("subgroup"))
        cond = subgroup.isNotNull() if spec.get("where") is None else F.col(f"__where{i}") & subgroup.isNotNull()
        entries.append(F.when(cond, entry))
    return F.array_compact(F.array(*entries))


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("boolean")


def unit_profiles(panel: DataFrame, outcomes: Sequence[str], id: str, t: str, d: str,
                  cluster: str | None, specs: Mapping[str, Mapping[str, Any]],
                  periods: tuple[int, int]) -> DataFrame:
    """One row per unit: d1, switch period f, sign s, observations by period, models.

    Rows without an id are left out. The query fails if a unit has a period twice, so the
    collected list is bounded by the panel length, or if what `by`, `where` or `cluster`
    name varies within a unit.
    """
    lo, hi = periods

    def outcome(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)  # not a number counts as missing

    obs = F.sort_array(F.collect_list(F.struct(
        F.col(t).cast("int").alias("t"), F.col(d).cast("double").alias("d"),
        *[outcome(y).alias(f"y{i}") for i, y in enumerate(outcomes)])))
    known = panel.filter(F.col(id).isNotNull() & F.col(t).isNotNull() & F.col(d).isNotNull() & F.col(t).between(lo, hi))
    fixed = {f"__by{i}": F.col(s["by"]).cast("string") for i, s in enumerate(specs.values()) if s.get("by")}
    fixed |= {f"__where{i}": truth(s["where"]) for i, s in enumerate(specs.values()) if s.get("where") is not None}
    if cluster and cluster != id:
        fixed["__cl"] = F.col(cluster)
    rows = F.count(F.lit(1))
    units = known.withColumns(fixed).groupBy(F.col(id).alias("__id")).agg(
        obs.alias("obs"), *[F.max(c).alias(c) for c in fixed],
        *[((F.count(c) == 0) | (F.count(c) == rows) & (F.min(c) == F.max(c))).alias(f"__same{c}") for c in fixed])
    times = F.transform("obs", lambda x: x["t"])
    ok = F.when(F.size(F.array_distinct(times)) < F.size(times), _fail("a unit has a period twice"))
    for c in fixed:
        ok = ok.when(~F.col(f"__same{c}"), _fail("what by, where or cluster name varies within a unit"))
    units = units.filter(ok.otherwise(F.lit(True)))

    base = F.get("obs", F.lit(0))["d"]
    switch = F.get(F.filter("obs", lambda x: x["d"] != F.get("obs", F.lit(0))["d"]), F.lit(0))
    # bound as the element of an array, the map is built once for a unit and not once for a period
    by_t = F.array(F.map_from_entries(F.transform("obs", lambda x: F.struct(x["t"], x))))
    dense = F.get(F.transform(by_t, lambda m: F.transform(
        F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.try_element_at(m, k))), F.lit(0))
    return units.select(
        "__id", (F.col("__cl") if "__cl" in fixed else F.col("__id")).alias("__cluster"),
        base.alias("d1"), switch["t"].alias("f"), F.signum(switch["d"] - base).alias("s"),
        dense.alias("dense"), _models(specs).alias("models"))


def unit_models(profiles: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """A row per unit, outcome, specification and subgroup, with arrays by period of
    the outcome and of |d - d1|; `seen` has a 1 for each period with an outcome, else a 0."""
    def entry(i: int, name: str) -> Column:
        return F.struct(F.lit(name).alias("outcome"), F.transform("dense", lambda x: x[f"y{i}"]).alias("y"))

    entries = [entry(i, name) for i, name in enumerate(outcomes)]
    seen = F.array_join(F.transform("y", lambda v: F.when(v.isNull(), "0").otherwise("1")), "")
    gaps = F.transform("dense", lambda x: F.abs(x["d"] - F.col("d1")))
    rows = profiles.select("__id", "__cluster", "d1", "f", "s", gaps.alias("dd"), "models",
                           F.inline(F.array(*entries)))
    return rows.select("__id", "__cluster", "outcome", F.inline("models"), "d1", "f", "s", "y", "dd", seen.alias("seen"))


def cohorts(units: DataFrame, n_periods: int, keys: Sequence[str] = COHORT, n: Column | None = None) -> DataFrame:
    """Units of one model, first treatment and switch that are seen in the same periods, as one row:
    their number `n` and sums of `y` and `dd` by period. They serve the same cells in the same role and
    changes are differences, so sums over cells come out of these rows as they do out of the units. Rows may
    also hold sums over `n` units."""
    known = [F.substring("seen", i + 1, 1) == "1" for i in range(n_periods)]
    sums = units.groupBy(*keys).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"), *[
        F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}{i}") for c in ("y", "dd") for i in range(n_periods)])
    return sums.select(*keys, "n", F.array(*[F.when(k, F.col(f"y{i}")) for i, k in enumerate(known)]).alias("y"),
                       F.array(*[F.col(f"dd{i}") for i in range(n_periods)]).alias("dd"))


def with_roles(rows: DataFrame, lo: int) -> DataFrame:
    """Rows of units in cells `sf`, `l` (horizon l > 0 is an effect, l < 0 a placebo) that the unit
    serves, with its `role`, its change `dy` and its `dose`."""
    def at(array: str, period: Column) -> Column:
        return F.get(array, period - lo)

    # where the horizon starts and ends, and the period up to which a control must be untreated
    t1, t2, until = F.col("sf") - 1, F.col("sf") - 1 + F.col("l"), F.col("sf") - 1 + F.abs("l")
    # a placebo needs the switcher's effect at the same horizon to exist
    effect_too = (F.col("l") > 0) | at("y", until).isNotNull()
    switcher = truth(F.col("f") == F.col("sf")) & effect_too
    control = F.col("f").isNull() | (F.col("f") > until)
    role = F.when(switcher, F.when(F.col("s") > 0, "up").otherwise("down")).when(control, "c")
    return rows.withColumns({"role": role, "dy": at("y", t2) - at("y", t1), "dose": at("dd", t2)}).filter(
        "role IS NOT NULL AND dy IS NOT NULL")


def unit_cells(units: DataFrame, effects: int, placebo: int, periods: tuple[int, int]) -> DataFrame:
    """Each unit in each cell that lies within the periods and that it serves."""
    lo, hi = periods
    rows = units.withColumn("sf", F.explode(F.sequence(F.lit(lo + 1), F.lit(hi))))
    rows = rows.withColumn("l", F.explode(F.sequence(F.lit(-placebo), F.lit(effects)))).filter("l <> 0")
    return with_roles(rows.filter((F.col("sf") - 1 + F.col("l") >= lo) & (F.col("sf") - 1 + F.abs("l") <= hi)), lo)


def cell_stats(cells: DataFrame, model: Sequence[str] = MODEL, n: Column | None = None) -> DataFrame:
    """Usable cells (switchers with controls): counts and sums of changes, for units
    whose treatment rose (`up`) and fell (`down`) and for controls. A placebo is usable
    only where the effect at the same horizon is, so both are aggregated in one row. Rows may
    also hold sums over `n` units."""
    n = F.lit(1) if n is None else n

    def sums(effect: bool) -> list[Column]:
        side = (F.col("l") > 0) if effect else (F.col("l") < 0)
        return [F.struct(*[
            F.coalesce(F.sum(F.when(side & (F.col("role") == role), value)), F.lit(0)).cast("double").alias(f"{name}_{role}")
            for role in ("up", "down", "c") for name, value in (("n", n), ("dy", F.col("dy")), ("dose", F.col("dose")))
        ]).alias("e" if effect else "p")]

    h = F.abs("l").alias("h")
    pair = cells.groupBy(*model, "d1", "sf", h).agg(*sums(True), *sums(False))

    def usable(e: str) -> Column:
        return (F.col(f"{e}.n_up") + F.col(f"{e}.n_down") > 0) & (F.col(f"{e}.n_c") > 0)

    entries = F.array_compact(F.array(
        F.struct(F.col("h").alias("l"), F.col("e").alias("x")),
        F.when(usable("p"), F.struct((-F.col("h")).alias("l"), F.col("p").alias("x")))))
    rows = pair.filter(usable("e")).select(*model, "d1", "sf", F.inline(entries))
    return rows.select(*model, "d1", "sf", "l", "x.*")


def _estimates(stats: DataFrame, model: Sequence[str] = MODEL) -> DataFrame:
    """Total effect of the switchers by horizon, and over all effects as horizon 0."""
    change = F.col("dy_up") - F.col("dy_down")
    sign = F.col("n_up") - F.col("n_down")
    rows = stats.select(*model, F.explode(F.when(F.col("l") > 0, F.array("l", F.lit(0))).otherwise(F.array("l"))).alias("l"),
                        (change - sign * F.col("dy_c") / F.col("n_c")).alias("total"),
                        (F.col("n_up") + F.col("n_down")).alias("n_s"), "n_c", (F.col("dose_up") + F.col("dose_down")).alias("dose"))
    sums = rows.groupBy(*model, "l").agg(F.sum("total").alias("total"), F.sum("n_s").alias("n_switchers"),
                                         (F.sum("n_s") + F.sum("n_c")).alias("n_obs"), F.sum("dose").alias("dose"))
    # an effect is per switcher, the average effect per unit of treatment received
    return sums.withColumn("per", F.when(F.col("l") == 0, F.col("dose")).otherwise(F.col("n_switchers"))).withColumn(
        "estimate", F.col("total") / F.col("per"))


def cell_coefficients(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """Per model and first treatment, the cells with the coefficients that turn a unit's change
    into its influence on the estimate of the horizon (`per`) and on the average effect (`per_0`, for
    effects), scaled so that the variance is the sum of squares over clusters."""
    def scaled(n: str, dy: str, sign: Column, others: Sequence[str]) -> Column:
        """Weight of a group's members and their centre: the group's mean change, with
        its degrees of freedom; a group of one is centred on the mean of the whole cell."""
        alone = F.col(n) == 1
        count = F.when(alone, sum((F.col(f"n_{o}") for o in others), F.col(n))).otherwise(F.col(n))
        mean = F.when(alone, sum((F.col(f"dy_{o}") for o in others), F.col(dy))).otherwise(F.col(dy)) / count
        k = sign * F.sqrt(count / (count - 1))
        return F.when(F.col(n) > 0, F.struct(k.alias("k"), (k * mean).alias("shift")))

    balance = (F.col("n_up") - F.col("n_down")) / F.col("n_c")
    by_cell = stats.select(
        *MODEL, *CELL, scaled("n_up", "dy_up", F.lit(1.0), ["c"]).alias("up"),
        scaled("n_down", "dy_down", F.lit(-1.0), ["c"]).alias("down"),
        scaled("n_c", "dy_c", -balance, ["up", "down"]).alias("c"))
    average = estimates.filter("l = 0").select(*MODEL, F.col("per").alias("per_0"))
    rows = by_cell.join(estimates.select(*MODEL, "l", "per"), [*MODEL, "l"]).join(average, MODEL)
    # at most a row per switch period and horizon
    return rows.groupBy(*MODEL, "d1").agg(F.collect_list(F.struct(
        "sf", "l", "up", "down", "c", "per", F.when(F.col("l") > 0, F.col("per_0")).alias("per_0"))).alias("cells"))


def influence(units: DataFrame, groups: DataFrame, coefs: DataFrame, periods: tuple[int, int]) -> DataFrame:
    """Influence `u` of each cluster on each horizon `l`.

    Within a cohort it is one and the same linear function of the outcomes. Its coefficients are added up
    over the cells once per cohort (`groups`), and a unit's influence on a horizon is one
    product of two arrays.
    """
    lo, hi = periods
    keys = [*MODEL, "d1"]
    renamed = coefs.withColumnsRenamed({c: f"__k_{c}" for c in keys})
    served = groups.withColumn("y", F.transform("y", lambda v: v * 0)).join(renamed, [F.col(c) == F.col(f"__k_{c}") for c in keys])
    rows = with_roles(served.select(*COHORT, "y", "dd", F.inline("cells")), lo)
    w = F.when(F.col("role") == "up", F.col("up")).when(F.col("role") == "down", F.col("down")).otherwise(F.col("c"))

    def part(horizon: Column, per: Column) -> Column:
        return F.struct(horizon.alias("h"), (w["k"] / per).alias("k"), (w["shift"] / per).alias("shift"))

    both = F.array_compact(F.array(part(F.col("l"), F.col("per")), F.when(F.col("l") > 0, part(F.lit(0), F.col("per_0")))))
    rows = rows.select(*COHORT, F.col("sf").alias("sf"), F.col("l").alias("cell"), F.inline(both))
    start, end = F.col("sf") - 1 - lo, F.col("sf") - 1 + F.col("cell") - lo
    sums = rows.groupBy(*COHORT, "h").agg(F.sum("shift").alias("shift"), *[
        F.sum(F.when(end == i, F.col("k")).when(start == i, -F.col("k")).otherwise(0.0)).alias(f"k{i}") for i in range(hi - lo + 1)])
    # at most a row per horizon
    vectors = sums.groupBy(*COHORT).agg(F.collect_list(F.struct(
        F.col("h").alias("l"), "shift", F.array(*[F.col(f"k{i}") for i in range(hi - lo + 1)]).alias("k"))).alias("vectors"))
    # most units can be of one cohort; their rows are split by adaptive execution
    joined = attach(units.select(*COHORT, "__cluster", "y"), vectors, COHORT, "inner")
    rows = joined.select(*MODEL, "__cluster", "y", F.inline("vectors"))
    u = F.aggregate(F.zip_with("k", "y", lambda k, y: k * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) - F.col("shift")
    return rows.select(*MODEL, "__cluster", "l", u.alias("u")).groupBy(*MODEL, "__cluster", "l").agg(F.sum("u").alias("u"))


class DidPlan:
    """The frames of one batch. With errors, the unit rows and the sums of cells are read more
    than once, so they are checkpointed."""

    def __init__(self, panel: DataFrame, outcomes: Sequence[str], id: str, t: str, d: str,
                 effects: int, placebo: int, cluster: str | None,
                 specs: Mapping[str, Mapping[str, Any]] | None,
                 periods: tuple[int, int] | None, errors: bool = True):
        if periods is None:
            edge = panel.agg(F.min(t), F.max(t)).first()
            periods = (int(edge[0]), int(edge[1]))
        keep = stable if errors else (lambda df: df)
        profiles = unit_profiles(panel, outcomes, id, t, d, cluster, specs or {"baseline": {}}, periods)
        # the profiles are small next to the work on their cells, so their number of tasks is kept
        tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.periods = periods
        self.units = unit_models(keep(profiles.repartition(tasks, "__id")), outcomes)
        self.cohorts = keep(cohorts(self.units, periods[1] - periods[0] + 1))
        self.stats = keep(cell_stats(unit_cells(self.cohorts, effects, placebo, periods), n=F.col("n")))
        self.estimates = _estimates(self.stats)

    def influence(self) -> DataFrame:
        return influence(self.units, self.cohorts, cell_coefficients(self.stats, self.estimates), self.periods)


def did_batch(panel: DataFrame, outcomes: Sequence[str], id: str, t: str, d: str,
              effects: int = 10, placebo: int = 5, cluster: str | None = None,
              specs: Mapping[str, Mapping[str, Any]] | None = None,
              periods: tuple[int, int] | None = None, errors: bool = True) -> DataFrame:
    """All outcomes under all specifications in one job.

    `specs` is `{name: {"by": column, "where": condition}}`, either part optional; both
    may only use columns that do not vary within a unit. The result has a row per
    outcome, specification, subgroup, kind (effect, placebo, average) and horizon, with
    estimate, error, 95% interval, switchers and observations used.
    """
    plan = DidPlan(panel, outcomes, id, t, d, effects, placebo, cluster, specs, periods, errors)
    points = plan.estimates
    if errors:
        squares = (plan.influence().groupBy(*MODEL, "l").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("se")))
        points = points.join(squares, [*MODEL, "l"], "left")
    else:
        points = points.withColumn("se", F.lit(None).cast("double"))
    kind = F.when(F.col("l") > 0, "effect").when(F.col("l") < 0, "placebo").otherwise("average")
    return points.select(
        *MODEL, kind.alias("kind"), F.abs("l").alias("horizon"), "estimate", "se",
        (F.col("estimate") - Z95 * F.col("se")).alias("ci_low"),
        (F.col("estimate") + Z95 * F.col("se")).alias("ci_high"),
        F.col("n_switchers").cast("bigint").alias("n_switchers"),
        F.col("n_obs").cast("bigint").alias("n_obs"))


def did_dynamic(panel: DataFrame, y: str, id: str, t: str, d: str, effects: int = 10,
                placebo: int = 5, cluster: str | None = None, by: str | None = None,
                where: Column | None = None, periods: tuple[int, int] | None = None,
                errors: bool = True) -> DataFrame:
    """One outcome, overall or by subgroup, on all units or those meeting a condition."""
    specs = {"baseline" if not by else by: {"by": by, "where": where}}
    return did_batch(panel, [y], id, t, d, effects, placebo, cluster, specs, periods, errors)


# P(X <= k) of a Poisson variable of mean 1; what is above weighs 10.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]


def poisson_weights(cluster: str, replicates: int, seed: int) -> list[int]:
    """A cluster's weight in each replicate: Poisson of mean 1, by a hash of the cluster, so that
    reruns and lost executors change nothing."""
    draws = (int(hashlib.md5(f"{seed}:{cluster}:{b}".encode()).hexdigest()[:13], 16) / (1 << 52) for b in range(replicates))
    return [bisect.bisect_right(POISSON, u) for u in draws]


def weighted_cells(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Cells of all replicates: `replicate`, and per role the weighted sums `n`, `dy`, `dose`.

    Weights are never a column. Each task adds the weights of its units to arrays beside its sums, one
    place for a replicate, so the cells are read once for all replicates; a task gives
    a row per cell and role, whatever its number of units.
    """
    keys = [*MODEL, *CELL, "role"]
    kinds = {c: cells.schema[c].dataType.simpleString() for c in keys}

    def add(batches):
        import numpy as np
        import pyarrow as pa
        arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
        weights: dict[str, list[int]] = {}
        sums: dict[tuple, Any] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("cluster").dictionary_encode()
            weights = {c: weights[c] if c in weights else poisson_weights(c, replicates, seed) for c in names.dictionary.to_pylist()}
            w = np.array([weights[c] for c in names.dictionary.to_pylist()], float)[names.indices.to_numpy()]
            places: dict[tuple, int] = {}
            at = np.array([places.setdefault(k, len(places)) for k in zip(*(batch.column(c).to_pylist() for c in keys))])
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            for value, part in (("n", w), ("dy", w * batch.column("dy").to_numpy()[:, None]), ("dose", w * batch.column("dose").to_numpy()[:, None])):
                added = np.add.reduceat(part[order], cuts)
                for key, row in zip(places, added):
                    own = sums.setdefault(key, {})
                    own[value] = own[value] + row if value in own else row
        rows = list(sums)
        for i in range(0, len(rows), 256):
            some = rows[i:i + 256]
            columns = [pa.array(c, arrow[k]) for c, k in zip(zip(*some), kinds.values())]
            arrays = [pa.array([sums[k][v] for k in some], pa.list_(pa.float64())) for v in ("n", "dy", "dose")]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], [*keys, "n", "dy", "dose"])

    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{v} array<double>" for v in ("n", "dy", "dose"))])
    rows = cells.select(*keys, F.coalesce(F.col("__cluster").cast("string"), F.lit("")).alias("cluster"), F.col("dy").cast("double").alias("dy"),
                        F.coalesce(F.col("dose").cast("double"), F.lit(0.0)).alias("dose"))
    each = F.posexplode(F.arrays_zip("n", "dy", "dose")).alias("replicate", "x")
    return rows.mapInArrow(add, schema).select(*keys, each).groupBy(*keys, "replicate").agg(
        *[F.sum(F.col("x")[v]).alias(v) for v in ("n", "dy", "dose")])


HELD = 1 << 25  # bytes of weighted sums that a task holds at once
FEW = 20  # units for each cohort from which on the replicates are drawn of cohorts


def weighted_cohorts(units: DataFrame, n_periods: int, replicates: int, seed: int, held: int = HELD) -> DataFrame:
    """Cohorts of all replicates: `replicate`, and the weighted sums `n`, `y` and `dd` of `cohorts`.

    Sums over cells are sums over cohorts, whatever the weights, so units are weighted before they are laid out
    over the cells: each row of a unit is read once. Each task adds the weighted rows to one matrix per cohort,
    and gives out what it has when that takes more than `held` bytes.
    """
    kinds = {c: units.schema[c].dataType.simpleString() for c in COHORT}
    most = held // (8 * replicates * (2 * n_periods + 1))  # cohorts

    def add(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
        weights: dict[str, list[int]] = {}
        sums: dict[tuple, Any] = {}

        def given():
            rows = list(sums)
            for i in range(0, len(rows), 64):
                some = rows[i:i + 64]
                both = np.concatenate([sums[k] for k in some])
                columns = [pa.array([x for x in c for _ in range(replicates)], arrow[k]) for c, k in zip(zip(*some), kinds.values())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(some))), pa.array(both[:, 0]),
                     *[pa.array(list(x), pa.list_(pa.float64())) for x in (both[:, 1:1 + n_periods], both[:, 1 + n_periods:])]],
                    [*COHORT, "replicate", "n", "y", "dd"])
            sums.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("cluster").dictionary_encode()
            weights = {c: weights[c] if c in weights else poisson_weights(c, replicates, seed) for c in names.dictionary.to_pylist()}
            w = np.array([weights[c] for c in names.dictionary.to_pylist()], float)[names.indices.to_numpy()]
            y, dd = (pc.fill_null(batch.column(c).flatten(), 0.0).to_numpy().reshape(-1, n_periods) for c in ("y", "dd"))
            x = np.column_stack([np.ones(len(y)), y, dd])
            places: dict[tuple, int] = {}
            at = np.array([places.setdefault(k, len(places)) for k in zip(*(batch.column(c).to_pylist() for c in COHORT))])
            order = np.argsort(at, kind="stable")
            for key, own in zip(places, np.split(order, np.flatnonzero(np.diff(at[order])) + 1)):
                added = w[own].T @ x[own]
                sums[key] = sums[key] + added if key in sums else added
                if len(sums) > most:
                    yield from given()
        yield from given()

    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "replicate int, n double, y array<double>, dd array<double>"])
    rows = units.select(*COHORT, F.coalesce(F.col("__cluster").cast("string"), F.lit("")).alias("cluster"), "y", "dd")
    return cohorts(rows.mapInArrow(add, schema), n_periods, [*COHORT, "replicate"], F.col("n"))


def did_bootstrap(panel: DataFrame, outcomes: Sequence[str], id: str, t: str, d: str, effects: int = 10, placebo: int = 5,
                  cluster: str | None = None, specs: Mapping[str, Mapping[str, Any]] | None = None,
                  periods: tuple[int, int] | None = None, replicates: int = 200, seed: int = 1) -> DataFrame:
    """Estimates as in `did_batch` with errors from a cluster bootstrap: a row per model, kind and
    horizon with `estimate`, `se` (standard deviation over the replicates in which the
    horizon can be estimated) and `n_replicates` of these.

    A replicate weighs each cluster by an independent Poisson draw, which at scale is a draw of clusters with
    replacement. All replicates come from one pass over the units, added up by cohort before they are laid out
    over the cells. Where cohorts are nearly as many as units (outcomes missing at random), that would be more
    than the cells; there they come from one pass over the units' cells.
    """
    if periods is None:
        edge = panel.agg(F.min(t), F.max(t)).first()
        periods = (int(edge[0]), int(edge[1]))
    units = unit_models(stable(unit_profiles(panel, outcomes, id, t, d, cluster, specs or {"baseline": {}}, periods)), outcomes)
    n_periods, model = periods[1] - periods[0] + 1, [*MODEL, "replicate"]
    groups = stable(cohorts(units, n_periods))
    if groups.count() * FEW <= groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
        cells = unit_cells(weighted_cohorts(units, n_periods, replicates, seed), effects, placebo, periods)
    else:
        cells = weighted_cells(unit_cells(units, effects, placebo, periods), replicates, seed)
    draws = _estimates(cell_stats(cells, model, F.col("n")), model)
    errors = draws.groupBy(*MODEL, "l").agg(F.stddev_samp("estimate").alias("se"), F.count("estimate").alias("n_replicates"))
    points = _estimates(cell_stats(unit_cells(groups, effects, placebo, periods), n=F.col("n"))).select(*MODEL, "l", "estimate")
    kind = F.when(F.col("l") > 0, "effect").when(F.col("l") < 0, "placebo").otherwise("average")
    return points.join(errors, [*MODEL, "l"], "left").select(
        *MODEL, kind.alias("kind"), F.abs("l").alias("horizon"), "estimate", "se", F.coalesce("n_replicates", F.lit(0)).cast("bigint").alias("n_replicates"))


def _chi2_upper(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution with k degrees of freedom."""
    if x <= 0:
        return 1.0
    term = math.exp(-x / 2) if k % 2 == 0 else math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    total = 0.0 if k % 2 == 0 else math.erfc(math.sqrt(x / 2))
    i = 0 if k % 2 == 0 else 1
    while i < k:
        if i:
            total += term
        else:
            total = term
        i += 2
        term *= x / i
    return min(total, 1.0)


def did_joint_tests(panel: DataFrame, outcomes: Sequence[str], id: str, t: str, d: str,
                    effects: int = 10, placebo: int = 5, cluster: str | None = None,
                    specs: Mapping[str, Mapping[str, Any]] | None = None,
                    periods: tuple[int, int] | None = None) -> DataFrame:
    """Wald tests that all effects, and all placebos, are zero.

    The covariance of the horizons is one aggregate of products per cluster; only that
    small matrix, one per model and kind, reaches the test itself.
    """
    plan = DidPlan(panel, outcomes, id, t, d, effects, placebo, cluster, specs, periods)
    horizons = [h for h in range(-placebo, effects + 1) if h]
    pairs = [(i, j) for i in horizons for j in horizons if i <= j and i * j > 0]
    # one row per cluster with a column per horizon, then all products in one aggregate
    vectors = plan.influence().groupBy(*MODEL, "__cluster").agg(
        *[F.sum(F.when(F.col("l") == h, F.col("u")).otherwise(0.0)).alias(f"u{n}") for n, h in enumerate(horizons)])
    at = {h: F.col(f"u{n}") for n, h in enumerate(horizons)}
    sums = vectors.groupBy(*MODEL).agg(*[F.sum(at[i] * at[j]).alias(f"c{n}") for n, (i, j) in enumerate(pairs)])
    entries = [F.struct(F.lit("effect" if i > 0 else "placebo").alias("kind"), F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{n}").alias("cov"))
               for n, (i, j) in enumerate(pairs) for a, b in {(i, j), (j, i)}]
    points = plan.estimates.select(*MODEL, F.col("l").alias("i"), "estimate")
    table = (sums.select(*MODEL, F.inline(F.array(*entries))).join(points, [*MODEL, "i"])
             .join(points.select(*MODEL, F.col("i").alias("j")), [*MODEL, "j"], "left_semi"))
    schema = T.StructType([
        *[T.StructField(c, T.StringType()) for c in [*MODEL, "kind"]],
        T.StructField("df", T.IntegerType()), T.StructField("chi2", T.DoubleType()),
        T.StructField("p_value", T.DoubleType())])

    def wald(key, pdf):
        import numpy as np
        import pandas as pd
        cov = pdf.pivot(index="i", columns="j", values="cov").fillna(0.0).sort_index().sort_index(axis=1)
        b = pdf.groupby("i")["estimate"].first().sort_index().to_numpy()
        stat = float(b @ np.linalg.pinv(cov.to_numpy()) @ b)
        rank = int(np.linalg.matrix_rank(cov.to_numpy()))
        return pd.DataFrame([[*key, rank, stat, _chi2_upper(stat, rank)]], columns=schema.names)

    return table.groupBy(*MODEL, "kind").applyInPandas(wald, schema)

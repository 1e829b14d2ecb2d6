"""Forecasts for many series at once.

A fit is one row per key: ``n, method, level, trend, seasons, spread, mae, mape, rmse``.
:func:`project` turns fits into future steps. The exponential smoothers are linear recurrences,
so a long series is cut into blocks that run in parallel: each block adds a vector, a short chain
over the block vectors gives every block its start state, and a second pass reads the errors.
Holt-Winters is not linear: a state is carried along each series, all series in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.stats import round_half_up, z_for
from tablelens.operators.correlation import regression_on_index
from tablelens.operators.joins import attach_stats, equi_join
from tablelens.operators.ordering import BLOCK, block_window, bucketed_rows, series_blocks, with_row_index
from tablelens.operators.profile import columns_of
from tablelens.session import materialize

# fixed values: smoothing defaults and limits
SES_ALPHA, HOLT_ALPHA, HOLT_BETA = 0.3, 0.3, 0.1
HW_ALPHA, HW_BETA, HW_GAMMA = 0.2, 0.1, 0.1
MAX_WINDOW, MAX_LAG, SEASONAL_ACF, SEASON_MIN = 10, 52, 0.3, 10
CARRIED = 512  # points of a block that passes through the one task of its series
TREND_SLOPE, TREND_R2 = 0.01, 0.1
WIDEN = {"moving_average": 0.0, "single_smoothing": 0.0, "double_smoothing": 0.1, "triple_smoothing": 0.05}


def period_series(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), grain: str = "day") -> DataFrame:
    """One summed value per key and period, indexed in time order: ``(keys.., ts, value, idx)``."""
    day = F.date_trunc(grain, F.col(ts)).cast("date")
    rows = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    sums = rows.groupBy(*keys, day.alias("ts")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    return materialize(with_row_index(sums, ["ts"], keys))


def ordered_series(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every row as one point, in the order of ``order_by`` (unique)."""
    rows = df.select(*keys, *order_by, F.col(value).cast("double").alias("value")).dropna(subset=["value"])
    return materialize(with_row_index(rows, order_by, keys))


def _lengths(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys).agg(F.count("value").alias("n"))


def _accuracy(n: Column, e: dict[str, Column]) -> list[Column]:
    spread = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(e["rr"] - e["r"] * e["r"] / n, (n - 1).cast("double")))), F.lit(0.0))
    return [spread.alias("spread"), (e["a"] / n).alias("mae"), (e["p"] / n).alias("mape"), F.sqrt(e["rr"] / n).alias("rmse")]


def _abs_pct(err: Column, actual: Column) -> Column:
    """Absolute error in percent of the actual value; 0 where that is 0."""
    return F.coalesce(F.abs(F.try_divide(err, actual)) * 100, F.lit(0.0))


def _no_seasons() -> Column:
    return F.lit(None).cast("array<double>").alias("seasons")


def moving_average(series: DataFrame, keys: Sequence[str] = (), window: int | None = None) -> DataFrame:
    """Fit of the trailing mean over ``window`` or ``min(floor(n / 3), 10)`` points; needs three."""
    widest = window or MAX_WINDOW
    w = F.lit(window) if window else F.least(F.floor(F.col("n") / 3), F.lit(MAX_WINDOW)).cast("int")
    rows = attach_stats(series.select(*keys, "idx", "value"), _lengths(series, keys), keys).where(F.col("n") >= (window or 3))
    frame = block_window(keys, "idx").rowsBetween(-(widest - 1), 0)
    halo = bucketed_rows(rows, "idx", widest - 1, 0)
    tail = halo.withColumn("w", w).withColumn("tail", F.collect_list("value").over(frame)).where(F.col("_own") & (F.col("idx") >= F.col("w") - 1))
    mean = F.aggregate(F.slice("tail", -F.col("w"), F.col("w")), F.lit(0.0), lambda a, x: a + x) / F.col("w")
    fit = tail.withColumn("ma", mean).withColumn("r", F.col("value") - F.col("ma"))
    ape = _abs_pct(F.col("r"), F.col("value"))
    sums = fit.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max_by("ma", "idx").alias("level"),
        F.count(F.lit(1)).alias("m"),
        F.avg(F.abs("r")).alias("mae"),
        F.avg(ape).alias("mape"),
        F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"),
        F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("spread"),
    )
    return sums.select(
        *keys, "n", F.lit("moving_average").alias("method"), "level", F.lit(0.0).alias("trend"), _no_seasons(), "spread", "mae", "mape", "rmse"
    )


def _chain_starts(vectors: DataFrame, keys: Sequence[str], init: DataFrame, matrix: np.ndarray) -> DataFrame:
    """State at the start of each block of ``s' = M s + c``: ``(keys.., _block, L, T)``.

    Blocks are folded per key while there are at most ``BLOCK`` of them; longer chains are cut into
    blocks of blocks first.
    """
    m = matrix
    longest = vectors.agg(F.max("_block")).first()[0] or 0
    if longest < BLOCK:
        cells = F.array_sort(F.collect_list(F.struct(F.col("_block").alias("b"), F.col("cl"), F.col("ct"))))
        chains = attach_stats(vectors.groupBy(*keys).agg(cells.alias("cs")), init, keys)
    else:
        above = vectors.withColumns({"_up": F.floor(F.col("_block") / BLOCK).cast("long")})
        cells = F.array_sort(F.collect_list(F.struct(F.col("_block").alias("b"), F.col("cl"), F.col("ct"))))
        groups = materialize(above.groupBy(*keys, "_up").agg(cells.alias("cs")))
        zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("t"))
        total = F.aggregate("cs", zero, lambda s, c: _affine(m, s, c))
        upper = groups.select(*keys, F.col("_up").alias("_block"), total["l"].alias("cl"), total["t"].alias("ct"))
        starts = _chain_starts(upper, keys, init, np.linalg.matrix_power(m, BLOCK)).withColumnRenamed("_block", "_up")
        chains = equi_join(groups, starts, [*keys, "_up"])
    first = F.struct(F.col("L").alias("l"), F.col("T").alias("t"))
    states = F.aggregate(
        "cs", F.array(first), lambda acc, c: F.concat(acc, F.array(_affine(m, F.element_at(acc, -1), c)))
    )
    placed = F.arrays_zip(F.transform("cs", lambda c: c["b"]).alias("b"), F.slice(states, F.lit(1), F.size("cs")).alias("s"))
    return chains.select(*keys, F.explode(placed).alias("z")).select(
        *keys, F.col("z.b").alias("_block"), F.col("z.s.l").alias("L"), F.col("z.s.t").alias("T")
    )


def _affine(m: np.ndarray, s: Column, c: Column) -> Column:
    return F.struct(
        (float(m[0, 0]) * s["l"] + float(m[0, 1]) * s["t"] + c["cl"]).alias("l"),
        (float(m[1, 0]) * s["l"] + float(m[1, 1]) * s["t"] + c["ct"]).alias("t"),
    )


def _smooth(series: DataFrame, keys: Sequence[str], alpha: float, beta: float, with_trend: bool, size: int = BLOCK) -> DataFrame:
    """Level and trend recurrence; without trend it is single smoothing (beta 0, first trend 0)."""
    least = 3 if with_trend else 2
    init = materialize(
        series.groupBy(*keys).agg(
            F.count("value").alias("n"),
            F.max(F.when(F.col("idx") == 0, F.col("value"))).alias("L"),
            F.max(F.when(F.col("idx") == 1, F.col("value"))).alias("v1"),
        )
        .where(F.col("n") >= least)
        .select(*keys, "n", "L", (F.col("v1") - F.col("L") if with_trend else F.lit(0.0)).alias("T"))
    )
    steps = series.where(F.col("idx") > 0).select(*keys, (F.col("idx") - 1).alias("idx"), "value")
    blocks = series_blocks(steps, "idx", "value", keys, 0, size).select(*keys, "_block", F.transform("xs", lambda x: x["v"]).alias("vs"))
    longest = steps.agg(F.max("idx")).first()[0] or 0

    def step(l: Column, t: Column, v: Column) -> tuple[Column, Column]:
        new = alpha * v + (1 - alpha) * (l + t)
        return new, beta * (new - l) + (1 - beta) * t

    if longest < size:
        started = attach_stats(blocks, init, keys)
    else:
        # what a full block adds to a zero state; the state itself passes through M = A^size
        blocks = materialize(blocks)
        a = np.array([[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]])
        zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("t"))

        def run(s: Column, v: Column) -> Column:
            level, trend = step(s["l"], s["t"], v)
            return F.struct(level.alias("l"), trend.alias("t"))

        added = F.aggregate("vs", zero, run)
        vectors = blocks.select(*keys, "_block", added["l"].alias("cl"), added["t"].alias("ct"))
        starts = _chain_starts(vectors, keys, init.drop("n"), np.linalg.matrix_power(a, size))
        started = attach_stats(equi_join(blocks, starts, [*keys, "_block"]), init.select(*keys, "n"), keys)
    zero = F.struct(
        F.col("L").cast("double").alias("l"), F.col("T").cast("double").alias("t"),
        *[F.lit(0.0).alias(x) for x in ("r", "rr", "a", "p")],
    )

    def track(s: Column, v: Column) -> Column:
        level, trend = step(s["l"], s["t"], v)
        err = v - (level + s["t"])
        ape = _abs_pct(err, v)
        return F.struct(
            level.alias("l"), trend.alias("t"), (s["r"] + err).alias("r"), (s["rr"] + err * err).alias("rr"),
            (s["a"] + F.abs(err)).alias("a"), (s["p"] + ape).alias("p"),
        )

    done = started.select(*keys, "n", "_block", F.aggregate("vs", zero, track).alias("s"))
    sums = done.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max_by("s", "_block").alias("last"), *[F.sum(f"s.{x}").alias(x) for x in ("r", "rr", "a", "p")]
    )
    n = F.col("n")
    method = "double_smoothing" if with_trend else "single_smoothing"
    return sums.select(
        *keys, "n", F.lit(method).alias("method"), F.col("last.l").alias("level"), F.col("last.t").alias("trend"), _no_seasons(),
        *_accuracy(n, {x: F.col(x) for x in ("r", "rr", "a", "p")}),
    )


def single_smoothing(series: DataFrame, keys: Sequence[str] = (), alpha: float = SES_ALPHA, size: int = BLOCK) -> DataFrame:
    return _smooth(series, keys, alpha, 0.0, False, size)


def double_smoothing(series: DataFrame, keys: Sequence[str] = (), alpha: float = HOLT_ALPHA, beta: float = HOLT_BETA, size: int = BLOCK) -> DataFrame:
    return _smooth(series, keys, alpha, beta, True, size)


def _ratio(a: float, b: float) -> float:
    """Division as doubles define it, also by 0."""
    return a / b if b else float(np.divide(a, b))


class _SeasonalState:
    """Level, trend and seasons of one series, moved on point by point."""

    def __init__(self, level: float, trend: float, seasons: list[float], weights: tuple[float, float, float]):
        self.level, self.trend, self.seasons, self.weights = level, trend, seasons, weights
        self.seen = 0

    def advance(self, values: list[float]) -> list[float]:
        """``level + trend`` after every value. The first value of a series only starts it."""
        alpha, beta, gamma = self.weights
        level, trend, seasons, period = self.level, self.trend, self.seasons, len(self.seasons)
        out = []
        for at, v in enumerate(values, self.seen):
            s = at % period
            if at:
                new = alpha * _ratio(v, seasons[s]) + (1 - alpha) * (level + trend)
                trend = beta * (new - level) + (1 - beta) * trend
                level = new
                seasons[s] = gamma * _ratio(v, level) + (1 - gamma) * seasons[s]
            out.append(level + trend)
        self.level, self.trend, self.seen = level, trend, self.seen + len(values)
        return out


def _seasonal_start(series: DataFrame, sized: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys.., level, trend, seasons)`` before the first point: mean of each phase by the mean of all phases."""
    rows = attach_stats(series.select(*keys, "idx", "value"), sized, keys).where(F.col("period").isNotNull())
    phases = rows.groupBy(*keys, "period", (F.col("idx") % F.col("period")).alias("phase")).agg(
        F.avg("value").alias("f"),
        F.max(F.when(F.col("idx") == 0, F.col("value"))).alias("v0"),
        F.max(F.when(F.col("idx") == F.col("period"), F.col("value"))).alias("vp"),
    )
    cells = F.array_sort(F.collect_list(F.struct("phase", "f")))
    start = phases.groupBy(*keys, "period").agg(cells.alias("c"), F.avg("f").alias("mean"), F.max("v0").alias("v0"), F.max("vp").alias("vp"))
    seasons = F.transform("c", lambda x: F.try_divide(x["f"], F.col("mean")))
    start = start.withColumn("seasons", seasons).where(F.forall("seasons", lambda x: F.coalesce(x != 0, F.lit(False))))
    level = F.try_divide(F.col("v0"), F.col("seasons")[0])
    later = F.try_divide(F.col("vp"), F.col("seasons")[0])
    return start.select(*keys, level.alias("level"), F.try_divide(later - level, F.col("period").cast("double")).alias("trend"), "seasons")


def _types(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]


def _carried(series: DataFrame, start: DataFrame, keys: Sequence[str], weights: tuple[float, float, float]) -> DataFrame:
    """``(keys.., idx, vs, bases)`` per block of a series: position of its first point, values, level plus trend after
    each; and one row per series with ``idx = -1`` and its last ``level``, ``trend`` and ``seasons``.

    One exchange by key, then each task reads its series in order, block after block, and carries one state. Blocks
    are made and read again by all tasks; the one task of a series moves an array per block, not a row per point. The
    start state travels as a row before the first block; blocks of series without one are left out.
    """
    none = {"level": F.lit(None).cast("double"), "trend": F.lit(None).cast("double"), "seasons": F.lit(None).cast("array<double>")}
    blocks = series_blocks(series, "idx", "value", keys, size=CARRIED)
    first = F.get("xs", F.lit(0))["i"].cast("long")
    points = blocks.select(*keys, first.alias("idx"), F.transform("xs", lambda x: x["v"]).alias("vs")).withColumns(none)
    begin = start.select(*keys, F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("array<double>").alias("vs"), *none)
    placed = points.unionByName(begin).repartition(*keys).sortWithinPartitions(*keys, "idx")
    keys = list(keys)
    extra = ["idx", "vs", "bases", "level", "trend", "seasons"]
    lists = pa.list_(pa.float64())

    def moved(batch: pa.RecordBatch, at: list[int], bases: list[list[float]]) -> pa.RecordBatch:
        rows = batch.select([*keys, "idx", "vs"]).take(pa.array(at, pa.int64()))
        n = len(at)
        cells = [pa.array(bases, lists), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, lists)]
        return pa.RecordBatch.from_arrays([*rows.columns, *cells], names=[*keys, *extra])

    def ended(names: pa.RecordBatch, state: _SeasonalState) -> pa.RecordBatch:
        cells = [pa.array([-1], pa.int64()), pa.nulls(1, lists), pa.nulls(1, lists)]
        cells += [pa.array([x], pa.float64()) for x in (state.level, state.trend)] + [pa.array([state.seasons], lists)]
        return pa.RecordBatch.from_arrays([*names.columns, *cells], names=[*keys, *extra])

    def run(batches):
        state = names = None
        for batch in batches:
            values, at, bases = batch.column("vs"), [], []
            for row, idx in enumerate(batch.column("idx").to_pylist()):
                if names is not None and (idx < 0 or idx == 0 and state.seen):
                    yield ended(names, state)
                    state = names = None
                if idx < 0:
                    level, trend, seasons = (batch.column(c)[row].as_py() for c in ("level", "trend", "seasons"))
                    state, names = _SeasonalState(level, trend, seasons, weights), batch.slice(row, 1).select(keys)
                elif names is not None:
                    at.append(row)
                    bases.append(np.array(state.advance(values[row].values.to_numpy(zero_copy_only=False).tolist())))
            if at:
                yield moved(batch, at, bases)
        if names is not None:
            yield ended(names, state)

    columns = "idx long, vs array<double>, bases array<double>, level double, trend double, seasons array<double>"
    return placed.mapInArrow(run, ", ".join([*_types(series, keys), columns]))


def triple_smoothing(
    series: DataFrame,
    periods: DataFrame | int,
    keys: Sequence[str] = (),
    alpha: float = HW_ALPHA,
    beta: float = HW_BETA,
    gamma: float = HW_GAMMA,
) -> DataFrame:
    """Holt-Winters, multiplicative. ``periods`` is a number or ``(keys.., period)``.

    The recurrence is not linear, so a series has to be read in order: all series run side by side in the tasks of one
    job, each in Arrow batches of blocks with a state of one level, one trend and the seasons, whatever its length. The
    errors against the last seasons are column expressions over what that job wrote. Series under two periods, or with a phase
    that averages 0, have no multiplicative seasons and are not returned (use another model for them).
    """
    if not keys:
        one = F.lit(0).alias("_series")
        of = periods if isinstance(periods, int) else periods.select(one, "period")
        return triple_smoothing(series.select(one, "idx", "value"), of, ["_series"], alpha, beta, gamma).drop("_series")
    keys = list(keys)
    lengths = _lengths(series, keys)
    if isinstance(periods, int):
        sized = lengths.withColumn("period", F.lit(periods))
    else:
        sized = equi_join(lengths, periods.select(*keys, "period"), keys)
    sized = materialize(sized.where(F.col("n") >= 2 * F.col("period")).select(*keys, "n", F.col("period").cast("long").alias("period")))
    start = materialize(_seasonal_start(series, sized, keys))
    moved = materialize(_carried(series, start, keys, (alpha, beta, gamma)))
    final = moved.where(F.col("idx") < 0).select(*keys, "level", "trend", "seasons")
    cells = moved.where(F.col("idx") >= 0).select(*keys, "idx", F.posexplode(F.arrays_zip("vs", "bases")).alias("at", "x"))
    points = cells.select(*keys, (F.col("idx") + F.col("at")).alias("idx"), F.col("x.vs").alias("value"), F.col("x.bases").alias("base"))
    met = attach_stats(points, final.select(*keys, F.col("seasons").alias("_s")), keys)
    err = F.col("value") - F.col("base") * F.get("_s", (F.col("idx") % F.size("_s")).cast("int"))
    errors = met.select(*keys, "value", err.alias("e"))
    e = F.col("e")
    sums = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("r"), F.sum(e * e).alias("rr"), F.sum(F.abs(e)).alias("a"), F.sum(_abs_pct(e, F.col("value"))).alias("p")
    )
    joined = equi_join(final, sums, keys)
    return joined.select(
        *keys, "n", F.lit("triple_smoothing").alias("method"), "level", "trend", "seasons",
        *_accuracy(F.col("n"), {x: F.col(x) for x in ("r", "rr", "a", "p")}),
    )


def project(fits: DataFrame, horizon: int = 5, level: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Future steps ``(keys.., method, step, value, lower, upper)`` of any fit."""
    widen = F.create_map(*[F.lit(x) for kv in WIDEN.items() for x in kv])[F.col("method")]
    step = F.col("step")
    season = F.when(F.col("seasons").isNotNull(), F.get("seasons", ((F.col("n") + step - 1) % F.size("seasons")).cast("int"))).otherwise(F.lit(1.0))
    value = (F.col("level") + step * F.col("trend")) * season
    half = z_for(level) * F.col("spread") * F.sqrt(1 + (step - 1) * widen)
    steps = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, "method", "step", value.alias("value"), (value - half).alias("lower"), (value + half).alias("upper"))


def trends(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Direction, strength and slope per key; under three points the trend is stable."""
    fit = regression_on_index(series, "value", keys)
    enough = F.col("n") >= 3
    relative = F.try_divide(F.col("slope"), F.col("mean"))
    direction = F.when(~enough, "stable").when(relative > TREND_SLOPE, "up").when(relative < -TREND_SLOPE, "down").otherwise("stable")
    return fit.select(
        *keys, "n", direction.alias("direction"),
        F.when(enough, F.abs("r2")).otherwise(F.lit(0.0)).alias("strength"), F.when(enough, F.col("slope")).otherwise(F.lit(0.0)).alias("slope"),
    )


def autocorrelations(series: DataFrame, keys: Sequence[str] = (), max_lag: int = MAX_LAG) -> DataFrame:
    """Autocorrelation at lags 1..min(floor(n / 3), max_lag) for series of ten or more varying points.

    Each block carries the ``max_lag`` values before it, so no pair of points leaves its block. A task reads blocks as
    arrays and gives one product sum per lag.
    """
    stats = series.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    stats = stats.where((F.col("n") >= SEASON_MIN) & (F.col("var") > 0))
    blocks = attach_stats(series_blocks(series, "idx", "value", keys, max_lag), stats, keys).where(F.col("n").isNotNull())
    shaped = blocks.select(
        *keys, "n", "var", "mean",
        F.transform("xs", lambda x: x["v"]).alias("vs"),
        F.size(F.filter("xs", lambda x: ~x["own"])).alias("h"),
        F.least(F.floor(F.col("n") / 3), F.lit(max_lag)).cast("int").alias("lags"),
    )
    keys = list(keys)

    def products(batches):
        for batch in batches:
            sums = []
            for vs, *row in zip(batch.column("vs"), *(batch.column(c).to_pylist() for c in ("mean", "h", "lags"))):
                mean, head, lags = row
                c = vs.values.to_numpy(zero_copy_only=False) - mean
                starts = [(max(head, lag), lag) for lag in range(1, lags + 1)]
                sums.append([float(np.dot(c[at:], c[at - lag:len(c) - lag])) if at < len(c) else 0.0 for at, lag in starts])
            cells = [*batch.select([*keys, "n", "var"]).columns, pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cells, names=[*keys, "n", "var", "sums"])

    parts = shaped.mapInArrow(products, ", ".join([*_types(shaped, keys), "n long, var double, sums array<double>"]))
    found = parts.select(*keys, "n", "var", F.posexplode("sums").alias("at", "s")).withColumn("lag", F.col("at") + 1)
    sums = found.groupBy(*keys, "lag").agg(F.sum("s").alias("s"), F.max("n").alias("n"), F.max("var").alias("var"))
    return sums.select(*keys, "lag", (F.col("s") / (F.col("n") * F.col("var"))).alias("acf"))


def seasonality(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best lag of at least two with an autocorrelation above 0.3, the smallest on a tie; all keys kept."""
    acf = autocorrelations(series, keys).where((F.col("lag") >= 2) & (F.col("acf") > SEASONAL_ACF))
    best = acf.groupBy(*keys).agg(F.max(F.struct(F.col("acf"), (-F.col("lag")).alias("neg"))).alias("b"))
    found = best.select(*keys, (-F.col("b.neg")).cast("int").alias("period"), F.col("b.acf").alias("strength"))
    everyone = _lengths(series, keys)
    if keys:
        out = equi_join(everyone, found, list(keys), "left")
    else:
        hit = found.where(F.col("period").isNotNull()).first()
        out = everyone.withColumns({"period": F.lit(hit["period"] if hit else None).cast("int"), "strength": F.lit(hit["strength"] if hit else None).cast("double")})
    return out.select(
        *keys, "n", F.col("period").isNotNull().alias("detected"), F.coalesce("period", F.lit(0)).alias("period"), F.coalesce("strength", F.lit(0.0)).alias("strength")
    )


def choose_models(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys.., plan, period)``: triple for seasonal, double for trending, compare for the rest."""
    season = seasonality(series, keys).select(*keys, "n", "detected", "period")
    trend = trends(series, keys).select(*keys, "direction", F.col("strength").alias("t_strength"))
    plan = (
        F.when(F.col("detected") & (F.col("period") > 1) & (F.col("n") >= 2 * F.col("period")), "triple")
        .when((F.col("direction") != "stable") & (F.col("t_strength") > TREND_R2), "double")
        .otherwise("compare")
    )
    return equi_join(season, trend, list(keys)).where(F.col("n") >= 3).select(*keys, plan.alias("plan"), "period")


def auto_fit(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best fit per key: by season, by trend, else the lowest MAPE of the three simpler models.

    A key with fewer than three points has no fit: its row has only the key.
    """
    keys = list(keys)
    plans = materialize(choose_models(series, keys))
    marked = materialize(attach_stats(series.select(*keys, "idx", "value"), plans, keys))

    def part(plan: str) -> DataFrame:
        return marked.where(F.col("plan") == plan).select(*keys, "idx", "value")

    counts = {r["plan"]: r["count"] for r in plans.groupBy("plan").count().collect()}
    fits = []
    rest = part("compare") if counts.get("compare") else None
    if counts.get("triple"):
        seasonal = materialize(triple_smoothing(part("triple"), plans.where(F.col("plan") == "triple"), keys))
        fits.append(seasonal)
        if seasonal.count() < counts["triple"]:
            # no multiplicative seasons: these series join the comparison
            left = equi_join(part("triple"), seasonal.select(*keys), keys, "left_anti")
            rest = left if rest is None else rest.unionByName(left)
    if counts.get("double"):
        fits.append(double_smoothing(part("double"), keys))
    if rest is not None:
        order = ("moving_average", "single_smoothing", "double_smoothing")
        tried = moving_average(rest, keys).unionByName(single_smoothing(rest, keys)).unionByName(double_smoothing(rest, keys))
        rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
        names = [c for c in tried.columns if c not in keys]
        best = tried.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("mape", rank.alias("r"))).alias("b"))
        fits.append(best.select(*keys, "b.*"))
    out = fits[0] if fits else moving_average(series.where(F.lit(False)).select(*keys, "idx", "value"), keys)
    for more in fits[1:]:
        out = out.unionByName(more)
    short = equi_join(series.select(*keys).distinct(), plans.select(*keys), keys, "left_anti") if keys else None
    return out if short is None or short.isEmpty() else out.unionByName(short, allowMissingColumns=True)


def forecast_report(fits: DataFrame, horizon: int = 5, level: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: method, points, accuracy band and expected change from first to last step."""
    ends = project(fits, horizon, level, keys).groupBy(*keys).agg(F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"))
    band = F.when(F.col("mape") < 10, "high").when(F.col("mape") < 20, "medium").otherwise("low")
    change = F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100
    moved = F.abs(F.col("last") - F.col("first")) > 0.01 * F.abs("first")
    joined = attach_stats(fits, ends, keys)
    return joined.select(
        *keys, "method", "n", F.lit(horizon).alias("horizon"), "mae", "mape", "rmse", band.alias("accuracy"), F.when(moved, change).alias("change_pct")
    )


def daily_forecast(series: DataFrame, periods: int = 7, keys: Sequence[str] = (), history: int = 30) -> DataFrame:
    """Mean of the last seven values plus a half-to-half drift per day; the last rows come along as history."""
    sizes = _lengths(series, keys).where(F.col("n") >= 10)
    rows = attach_stats(series.select(*keys, "ts", "idx", "value"), sizes, keys).where(F.col("n").isNotNull())
    half = F.floor(F.col("n") / 2)
    stats = rows.groupBy(*keys, "n").agg(
        F.avg(F.when(F.col("idx") >= F.col("n") - 7, F.col("value"))).alias("avg7"),
        F.avg(F.when(F.col("idx") < half, F.col("value"))).alias("a"),
        F.avg(F.when(F.col("idx") >= half, F.col("value"))).alias("b"),
        F.max("ts").alias("last"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"),
    )
    trend = (F.col("b") - F.col("a")) / (F.col("n") / 2)
    step = stats.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    away = F.col("mean") - F.col("avg7")
    ahead = step.select(
        *keys, F.date_add(F.col("last").cast("date"), F.col("i")).alias("ts"), round_half_up(F.col("avg7") + trend * F.col("i"), 2).alias("value"),
        F.lit("forecast").alias("kind"), round_half_up(F.sqrt(F.col("var") + away * away), 2).alias("spread"),
    )
    past = rows.where(F.col("idx") >= F.col("n") - history).select(
        *keys, F.col("ts").cast("date").alias("ts"), "value", F.lit("history").alias("kind"), F.lit(None).cast("double").alias("spread")
    )
    return past.unionByName(ahead)


def forecast_table(df: DataFrame, order_by: Sequence[str], value: str | None = None, date: str | None = None, horizon: int = 5) -> DataFrame:
    """Automatic forecast of one table: its first numeric column along its first date column."""
    value = value or next(iter(columns_of(df, "number")), None)
    date = date or next(iter(columns_of(df, "date")), None)
    if value is None:
        raise ValueError("the table has no numeric column")
    order = [*([date] if date else []), *order_by]
    series = ordered_series(df.withColumn("_series", F.lit(value)), value, order, ["_series"])
    if len(series.take(3)) < 3:
        raise ValueError("forecasting needs at least three points")
    return project(auto_fit(series, ["_series"]), horizon, keys=["_series"]).withColumnRenamed("_series", "series")

"""Outlier detection: z-score, IQR, MAD, local window, 1-D k-means and their union.

Every method takes indexed rows ``(keys.., idx, value)`` from :func:`indexed` and returns
``(keys.., idx, value, score, method)`` for the flagged rows. A score that would be infinite
(spread zero) is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.operators.joins import attach_stats, equi_join
from tablelens.operators.ordering import (
    block_window,
    bucketed_rows,
    exact_medians,
    floor_rank,
    order_elements,
    order_stats,
    value_prefix_counts,
    with_row_index,
    with_running_sum,
)
from tablelens.operators.profile import columns_of
from tablelens.session import materialize

# fixed values: method defaults
Z_LIMIT, IQR_FACTOR, MAD_LIMIT, MAD_SCALE = 3.0, 1.5, 3.5, 1.4826
WINDOW_ROWS, CLUSTERS, SHARE, ROUNDS, MOVED = 10, 3, 0.1, 100, 1e-4
DEFAULT_METHODS = ("zscore", "iqr", "mad")
OWN_COLUMNS = 3  # fixed value: numeric columns that are analysed where none are named
DIRECTORY = 4096  # rows of a prefix-sum table that are held for lookups


def indexed(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Non-null values with their position per key; written once so that all methods share it."""
    rows = df.select(*keys, *order_by, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull())
    return materialize(with_row_index(rows, order_by, keys).select(*keys, "idx", "value"))


def _flag(rows: DataFrame, keys: Sequence[str], method: str, score: Column, condition: Column) -> DataFrame:
    return rows.where(condition).select(*keys, "idx", "value", score.cast("double").alias("score"), F.lit(method).alias("method"))


def zscore_bounds(rows: DataFrame, keys: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    stats = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    usable = (F.col("n") >= 3) & (F.col("sd") > 0)
    return stats.select(
        *keys,
        F.when(usable, F.col("m")).alias("m"),
        F.when(usable, F.col("sd")).alias("sd"),
        F.when(usable, F.col("m") - limit * F.col("sd")).alias("lower"),
        F.when(usable, F.col("m") + limit * F.col("sd")).alias("upper"),
    )


def zscore_anomalies(rows: DataFrame, keys: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """Flags |v - mean| / sd > limit; nothing under three values or without spread."""
    z = F.try_divide(F.abs(F.col("value") - F.col("m")), F.col("sd"))
    return _flag(attach_stats(rows, zscore_bounds(rows, keys, limit), keys), keys, "zscore", z, F.col("sd").isNotNull() & (z > limit))


def iqr_bounds(rows: DataFrame, keys: Sequence[str] = (), factor: float = IQR_FACTOR) -> DataFrame:
    """Fences from the elements at ranks floor(n/4) and floor(3n/4); none under four values."""
    q = order_elements(rows, "value", {"q1": (0.25, floor_rank(0.25)), "q3": (0.75, floor_rank(0.75))}, keys)
    iqr = F.when(F.col("n") >= 4, F.col("q3") - F.col("q1"))
    return q.select(*keys, iqr.alias("iqr"), (F.col("q1") - factor * iqr).alias("lower"), (F.col("q3") + factor * iqr).alias("upper"))


def iqr_anomalies(rows: DataFrame, keys: Sequence[str] = (), factor: float = IQR_FACTOR) -> DataFrame:
    past = F.greatest(F.col("lower") - F.col("value"), F.col("value") - F.col("upper"))
    score = F.try_divide(past, F.col("iqr"))
    return _flag(attach_stats(rows, iqr_bounds(rows, keys, factor), keys), keys, "iqr", score, past > 0)


def mad_bounds(rows: DataFrame, keys: Sequence[str] = (), limit: float = MAD_LIMIT) -> DataFrame:
    med = exact_medians(rows, "value", keys, "med").select(*keys, "med")
    off = attach_stats(rows, med, keys).withColumn("off", F.abs(F.col("value") - F.col("med")))
    mad = exact_medians(off, "off", keys, "mad")
    both = attach_stats(mad, med, keys)
    scaled = F.when(F.col("n") >= 3, MAD_SCALE * F.col("mad"))
    return both.select(*keys, "med", scaled.alias("mad"), (F.col("med") - limit * scaled).alias("lower"), (F.col("med") + limit * scaled).alias("upper"))


def mad_anomalies(rows: DataFrame, keys: Sequence[str] = (), limit: float = MAD_LIMIT) -> DataFrame:
    """Distance from the median in scaled MADs; without spread every other value is flagged."""
    away = F.abs(F.col("value") - F.col("med"))
    score = F.try_divide(away, F.col("mad"))
    hit = F.when(F.col("mad") > 0, score > limit).otherwise(F.col("mad").isNotNull() & (away > 0))
    return _flag(attach_stats(rows, mad_bounds(rows, keys, limit), keys), keys, "mad", score, hit)


def _window_scores(rows: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """Mean and sample sd of the neighbours of each row, itself excluded, and the series length."""
    half = window // 2
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    halo = bucketed_rows(rows, "idx", half, half)
    before = block_window(keys, "idx").rowsBetween(-half, -1)
    after = block_window(keys, "idx").rowsBetween(1, half)
    v = F.col("value")
    parts = halo.select(
        *keys, "idx", "value", "_own",
        F.count(v).over(before).alias("n1"), F.coalesce(F.avg(v).over(before), F.lit(0.0)).alias("m1"), F.coalesce(F.var_pop(v).over(before), F.lit(0.0)).alias("v1"),
        F.count(v).over(after).alias("n2"), F.coalesce(F.avg(v).over(after), F.lit(0.0)).alias("m2"), F.coalesce(F.var_pop(v).over(after), F.lit(0.0)).alias("v2"),
    ).where("_own")
    k = F.col("n1") + F.col("n2")
    mean = F.try_divide(F.col("n1") * F.col("m1") + F.col("n2") * F.col("m2"), k)
    gap = F.col("m1") - F.col("m2")
    ss = F.col("n1") * F.col("v1") + F.col("n2") * F.col("v2") + F.try_divide(gap * gap * F.col("n1") * F.col("n2"), k)
    scored = parts.select(*keys, "idx", "value", k.alias("k"), mean.alias("m"), F.when(k >= 3, F.sqrt(F.try_divide(ss, (k - 1).cast("double")))).alias("sd"))
    return attach_stats(scored, sizes, keys).where((F.col("n") >= window) & (F.col("sd") > 0))


def window_anomalies(rows: DataFrame, keys: Sequence[str] = (), window: int = WINDOW_ROWS, limit: float = Z_LIMIT) -> DataFrame:
    z = F.try_divide(F.abs(F.col("value") - F.col("m")), F.col("sd"))
    return _flag(_window_scores(rows, keys, window), keys, "window", z, z > limit)


def window_bounds(rows: DataFrame, keys: Sequence[str] = (), window: int = WINDOW_ROWS, limit: float = Z_LIMIT) -> DataFrame:
    scored = _window_scores(rows, keys, window)
    return scored.groupBy(*keys).agg(
        F.min(F.col("m") - limit * F.col("sd")).alias("lower"), F.max(F.col("m") + limit * F.col("sd")).alias("upper")
    )


class _PrefixSums:
    """Count and sum of all values up to a limit, from a table of running sums over the distinct values.

    The table is sorted by value. Some thousand of its rows, evenly spread over the counts, are held here; a lookup
    takes the last of them below the limit and reads the stretch from there on, which the files' value ranges narrow down.
    """

    def __init__(self, rows: DataFrame, held: int = DIRECTORY):
        counts = value_prefix_counts(rows, "value")
        self.table = materialize(with_running_sum(counts, "value", F.col("value") * F.col("cnt"), "sum").select("value", "cnt", "before", "total", "sum"))
        first = self.table.select("total").first()
        self.total = first["total"] if first else 0
        step = max(1, -(-self.total // held))
        upto = F.col("before") + F.col("cnt")
        crossed = F.floor(upto / step) != F.floor(F.col("before") / step)
        self.known = sorted((r["value"], r["n"], r["sum"]) for r in self.table.where(crossed).select("value", upto.alias("n"), "sum").collect())

    def upto(self, limits: Sequence[float]) -> list[tuple[int, float]]:
        """``(count, sum)`` of the values that are not above each limit, in one small job."""
        below = [next((k for k in reversed(self.known) if k[0] <= x), (-math.inf, 0, 0.0)) for x in limits]
        wanted = [(F.col("value") > k[0]) & (F.col("value") <= x) for k, x in zip(below, limits)]
        if not wanted:
            return []
        near = self.table.where(reduce(lambda a, b: a | b, wanted))
        last = near.agg(*[F.max_by(F.struct((F.col("before") + F.col("cnt")).alias("n"), "sum"), F.when(w, F.col("value"))).alias(f"l{i}") for i, w in enumerate(wanted)]).first()
        return [(last[f"l{i}"]["n"], last[f"l{i}"]["sum"]) if last[f"l{i}"] else (k[1], k[2]) for i, k in enumerate(below)]


def _clusters(rows: DataFrame, k: int, rounds: int, moved: float) -> list[tuple[float, int]]:
    """Centres with the number of values of the last assignment.

    In one dimension a cluster is a range of values, bounded by the middles between centres, so its mean follows from
    two lookups of running sums. Of equal centres the first has the values; one without values stays where it is.
    """
    sums = _PrefixSums(rows)
    starts = order_stats(sums.table.select("value", "cnt", "before", "total"), "value", {f"c{i}": (lambda q: lambda n: F.floor(n * F.lit(q)).cast("long"))((i + 0.5) / k) for i in range(k)}).first()
    centres = [starts[f"c{i}"] for i in range(k)]
    whole = sums.upto([math.inf])[0]
    sizes = [0] * k
    for _ in range(rounds):
        # by value; of equal centres the first, and a value in the middle goes to the one of smaller number
        alive = sorted({c: i for i, c in reversed(list(enumerate(centres)))}.items())
        middles = [((a + b) / 2, i < j) for (a, i), (b, j) in zip(alive, alive[1:])]
        cuts = [(0, 0.0), *sums.upto([m if lower else math.nextafter(m, -math.inf) for m, lower in middles]), whole]
        new, sizes = list(centres), [0] * k
        for (_, i), (low, high) in zip(alive, zip(cuts, cuts[1:])):
            sizes[i] = high[0] - low[0]
            if sizes[i]:
                new[i] = (high[1] - low[1]) / sizes[i]
        done = all(abs(a - b) < moved for a, b in zip(new, centres))
        centres = new
        if done:
            break
    return list(zip(centres, sizes))


def kmeans_centres(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, moved: float = MOVED) -> list[float]:
    """1-D centres: quantile starts, then rounds until all centres rest."""
    return [c for c, _ in _clusters(rows, k, rounds, moved)]


def kmeans_clusters(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, moved: float = MOVED) -> DataFrame:
    """``(cluster, centre, n)``; no row where there are fewer than two values a cluster."""
    found = _clusters(rows, k, rounds, moved) if len(rows.take(2 * k)) == 2 * k else []
    return rows.sparkSession.createDataFrame([(i, float(c), int(n)) for i, (c, n) in enumerate(found)], "cluster int, centre double, n long")


def kmeans_anomalies(rows: DataFrame, k: int = CLUSTERS, share: float = SHARE) -> DataFrame:
    """The ``ceil(n * share)`` values farthest from their centre (ties by index); score relative to the cut."""
    n = rows.count()
    if n < 2 * k:
        return _flag(rows.withColumn("score", F.lit(None)), (), "kmeans", F.col("score"), F.lit(False))
    centres = kmeans_centres(rows, k)
    gaps = [F.abs(F.col("value") - c) for c in centres]
    far = rows.select("idx", "value", (F.least(*gaps) if k > 1 else gaps[0]).alias("dist"))
    keep = math.ceil(n * share)
    # the distance at the cut splits the data: only rows at exactly that distance need an order
    prefix = value_prefix_counts(far, "dist")
    rank = n - keep
    cut_row = prefix.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("cnt"))).first()
    cut, at_cut = cut_row["dist"], cut_row["before"] + cut_row["cnt"] - rank
    tied = with_row_index(far.where(F.col("dist") == cut), ["idx"], name="_r").where(F.col("_r") < at_cut).select("idx", "value", "dist")
    flagged = far.where(F.col("dist") > cut).unionByName(tied)
    score = F.col("dist") / cut if cut > 0 else F.lit(None)
    return _flag(flagged, (), "kmeans", score, F.lit(True))


def detect_anomalies(
    rows: DataFrame,
    keys: Sequence[str] = (),
    methods: Sequence[str] = DEFAULT_METHODS,
    threshold: float = Z_LIMIT,
    min_methods: int = 1,
) -> DataFrame:
    """Union of methods: ``(keys.., idx, value, score, methods)``, score scaled to at most 1."""
    run = {
        "zscore": lambda: zscore_anomalies(rows, keys, threshold),
        "iqr": lambda: iqr_anomalies(rows, keys),
        "mad": lambda: mad_anomalies(rows, keys),
        "window": lambda: window_anomalies(rows, keys, limit=threshold),
        "kmeans": lambda: kmeans_anomalies(rows),
    }
    if keys and "kmeans" in methods:
        raise ValueError("kmeans works on one series")
    hits = None
    for name in methods:
        found = run[name]()
        hits = found if hits is None else hits.unionByName(found)
    # one row per flagged position; an infinite score (NULL here) counts as the maximum
    merged = hits.groupBy(*keys, "idx", "value").agg(
        F.max(F.coalesce("score", F.lit(float(threshold)))).alias("top"), F.sort_array(F.collect_set("method")).alias("methods")
    )
    return merged.where(F.size("methods") >= min_methods).select(
        *keys, "idx", "value", F.least(F.col("top") / threshold, F.lit(1.0)).alias("score"), "methods"
    )


def method_bounds(rows: DataFrame, keys: Sequence[str] = (), methods: Sequence[str] = DEFAULT_METHODS, threshold: float = Z_LIMIT) -> DataFrame:
    """Lower and upper bound per method."""
    run = {
        "zscore": lambda: zscore_bounds(rows, keys, threshold),
        "iqr": lambda: iqr_bounds(rows, keys),
        "mad": lambda: mad_bounds(rows, keys),
        "window": lambda: window_bounds(rows, keys, limit=threshold),
    }
    out = None
    for name in methods:
        part = run[name]().select(*keys, F.lit(name).alias("method"), "lower", "upper")
        out = part if out is None else out.unionByName(part)
    return out


def anomaly_summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counts, rate band, ranges of flagged and unflagged values, points hit by several methods."""
    marks = found.select("idx", (F.size("methods") > 1).cast("int").alias("several"), F.lit(1).alias("hit"))
    joined = equi_join(rows.select("idx", "value"), marks, ["idx"], "left")
    hit, v = F.col("hit").isNotNull(), F.col("value")
    out = joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("anomalies"),
        F.min(F.when(hit, v)).alias("anomaly_min"),
        F.max(F.when(hit, v)).alias("anomaly_max"),
        F.min(F.when(~hit, v)).alias("normal_min"),
        F.max(F.when(~hit, v)).alias("normal_max"),
        F.coalesce(F.sum("several"), F.lit(0)).alias("multi_method"),
    )
    rate = F.try_divide(100.0 * F.col("anomalies"), F.col("total").cast("double"))
    band = F.when(rate <= 5, "low").when(rate <= 10, "moderate").otherwise("high")
    return out.withColumns({"rate_pct": rate, "band": band})


def column_zscores(df: DataFrame, columns: Sequence[str] | None, keep: Sequence[str], limit: float = Z_LIMIT, min_values: int = 10) -> DataFrame:
    """Z-scores (population sd) of several columns in long form; NULL cells are skipped.

    Without ``columns``, the first ``OWN_COLUMNS`` numeric columns of the table.
    """
    columns = columns_of(df, "number")[:OWN_COLUMNS] if columns is None else columns
    if not columns:
        raise ValueError("the table has no numeric column")
    stats = df.agg(*[agg(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, agg in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).first()
    cells = []
    for c in columns:
        n, m, s = (stats[f"{c}_{x}"] for x in ("n", "m", "s"))
        if n >= min_values and s:
            value = F.col(c).cast("double")
            cells.append(F.struct(F.lit(c).alias("column"), value.alias("value"), (F.abs(value - m) / s).alias("z")))
    if not cells:
        raise ValueError(f"no column has {min_values} values and some spread")
    long = df.select(*keep, F.inline(F.array(*cells))).where(F.col("z") > limit)
    return long.withColumn("severity", F.when(F.col("z") > 1.5 * limit, "high").otherwise("medium"))


def listed_anomalies(found: DataFrame, keep: Sequence[str], rows: int = 100) -> DataFrame:
    return found.orderBy(F.desc("z"), "column", *keep).limit(rows)


def anomalies_of_table(df: DataFrame, order_by: Sequence[str], column: str | None = None, **options) -> DataFrame:
    """Ensemble on one column (the first numeric one by default); at least three values."""
    numbers = columns_of(df, "number")
    column = column or (numbers[0] if numbers else None)
    if column is None:
        raise ValueError("the table has no numeric column")
    rows = indexed(df, column, order_by)
    if len(rows.take(3)) < 3:
        raise ValueError("anomaly detection needs at least three values")
    return detect_anomalies(rows, **options)

"""Chart-ready tables: result profile, chart choice, series, slices, cells, boxes, bars.

Every function returns marks as rows; nothing is drawn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.text import strip_space
from tablelens.operators.joins import attach_stats
from tablelens.operators.ordering import floor_rank, order_elements, with_row_index
from tablelens.operators.profile import classify, column_profile
from tablelens.session import materialize

# fixed values: date formats
DATE_TEXT = (
    r"^\d{4}-\d{2}-\d{2}",
    r"^\d{2}/\d{2}/\d{4}",
    r"^\d{4}/\d{2}/\d{2}",
    r"^\d{4}年\d{1,2}月\d{1,2}日",
    r"^\d{1,2}-\w{3}-\d{4}",
    r"^\w{3}\s+\d{1,2},?\s+\d{4}",
)
# fixed values: rule number, chart, confidence
RULES = (
    (1, "line", 0.9), (2, "bar", 0.85), (3, "pie", 0.75), (4, "scatter", 0.8), (5, "heatmap", 0.7), (6, "radar", 0.65),
    (7, "funnel", 0.85), (8, "treemap", 0.8), (9, "sankey", 0.85), (10, "gauge", 0.9), (11, "candlestick", 0.95), (12, "bar", 0.5),
)
FUNNEL_WORDS = ("stage", "step", "phase", "阶段", "步骤", "环节", "转化")
FLOW_WORDS = ("source", "target", "from", "to", "源", "目标", "来源", "去向")
OHLC_WORDS = ("open", "high", "low", "close")


def looks_like_date(text: Column) -> Column:
    t = strip_space(text)
    out = t.rlike(DATE_TEXT[0])
    for pattern in DATE_TEXT[1:]:
        out = out | t.rlike(pattern)
    return out


def result_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Column profile with the chart class (text columns of dates count as dates) and series flags."""
    profile = column_profile(df, approximate=approximate)
    texts = [c for c, cls in classify(df).items() if cls == "string"]
    dated = {}
    if texts:
        row = df.agg(*[F.count_if(looks_like_date(F.col(f"`{c}`"))).alias(c) for c in texts]).first()
        dated = {c: row[c] or 0 for c in texts}
    counts = F.create_map(*[F.lit(x) for c in texts for x in (c, dated[c])]) if texts else F.create_map(F.lit(""), F.lit(0))
    hits = F.coalesce(F.try_element_at(counts, F.col("column")), F.lit(0))
    known = F.col("rows") - F.col("nulls")
    kind = F.when((F.col("class") == "string") & (hits * 2 > known), "date").otherwise(F.col("class"))
    return profile.withColumns({"kind": kind, "is_time_series": (kind == "date") | (hits > 0)}).withColumns(
        {
            "multi_series": (F.col("kind") == "string") & F.col("distinct").between(2, 10),
            "hierarchical": (F.col("kind") == "string") & F.lower("column").contains("parent"),
        }
    )


def recommend_charts(profile: DataFrame, keep: int | None = None) -> DataFrame:
    """``(chart, confidence, x, y, rule)`` from a result profile, best first.

    The profile has one row per column; the rules read it as a list.
    """
    cols = [r.asDict() for r in profile.orderBy("position").collect()]
    numbers = [c["column"] for c in cols if c["kind"] == "number"]
    texts = [c for c in cols if c["kind"] == "string"]
    dates = [c["column"] for c in cols if c["is_time_series"]]
    names = [c["column"] for c in cols]
    rows = cols[0]["rows"] if cols else 0

    def having(words: Sequence[str]) -> list[str]:
        return [n for n in names if any(w in n.lower() for w in words)]

    first = numbers[0] if numbers else None
    found: dict[int, tuple[str | None, str | None]] = {}
    if dates and numbers:
        found[1] = (dates[0], first)
    small = [c["column"] for c in texts if c["distinct"] <= 20]
    if small and numbers:
        found[2] = (small[0], first)
    slices = [c["column"] for c in texts if 2 <= c["distinct"] <= 8]
    if slices and numbers:
        found[3] = (slices[0], first)
    if len(numbers) >= 2:
        found[4] = (numbers[0], numbers[1])
    if len(texts) >= 2 and numbers:
        found[5] = (texts[0]["column"], texts[1]["column"])
    if len(numbers) >= 3:
        found[6] = (",".join(numbers), None)
    if having(FUNNEL_WORDS) and numbers:
        found[7] = (having(FUNNEL_WORDS)[0], first)
    if any(c["hierarchical"] for c in cols):
        found[8] = (texts[0]["column"], first)
    if len(having(FLOW_WORDS)) >= 2 and numbers:
        found[9] = tuple(having(FLOW_WORDS)[:2])
    if len(numbers) == 1 and rows == 1:
        found[10] = (first, None)
    if all(having((w,)) for w in OHLC_WORDS):
        found[11] = (having(("open",))[0], having(("close",))[0])
    if not found:
        found[12] = (names[0] if names else None, first or (names[1] if len(names) > 1 else None))
    by_rule = {r: (chart, conf) for r, chart, conf in RULES}
    marks = [(by_rule[r][0], by_rule[r][1], x, y, r) for r, (x, y) in found.items()]
    out = profile.sparkSession.createDataFrame(marks, "chart string, confidence double, x string, y string, rule int").orderBy(F.desc("confidence"), "rule")
    return out.limit(keep) if keep else out


def infer_chart(df: DataFrame) -> str:
    """One chart type from the first two columns and the number of rows."""
    kinds = list(classify(df).items())
    if len(kinds) < 2:
        return "bar"
    (first, cls), (_, second) = kinds[0], kinds[1]
    if cls == "date":
        return "line"
    if cls == "string":
        seen = df.agg(F.count(F.col(f"`{first}`")).alias("n"), F.count_if(looks_like_date(F.col(f"`{first}`"))).alias("d")).first()
        if 2 * (seen["d"] or 0) > seen["n"]:  # most values, as in the profile
            return "line"
    if second == "number":
        return "pie" if len(df.take(9)) <= 8 else "bar"
    return "bar"


def series_points(df: DataFrame, x: str, ys: Sequence[str], order: Sequence[Column | str], points: int | None = None) -> DataFrame:
    """All rows in order, or the first ``points``; missing values become 0."""
    rows = df.orderBy(*order)
    return (rows.limit(points) if points else rows).select(F.col(x).alias("x"), *[F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias(y) for y in ys])


def _total(df: DataFrame, value: str) -> Column:
    return F.lit(df.agg(F.sum(F.col(value).cast("double"))).first()[0] or 0.0)


def pie_slices(df: DataFrame, name: str, value: str, slices: int | None = None) -> DataFrame:
    """Slices and their percentage of the whole, largest first; all of them, or the largest ``slices``."""
    groups = df.groupBy(F.col(name).alias("name")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    total = _total(df, value)
    share = F.try_divide(F.col("value") * 100, total)
    rows = groups.select("name", "value", share.alias("pct")).orderBy(F.desc("value"), "name")
    return rows.limit(slices) if slices else rows


def scatter_points(df: DataFrame, x: str, y: str, fraction: float | None = None, seed: int = 7) -> DataFrame:
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return points.sample(fraction=fraction, seed=seed) if fraction else points


def _first_seen(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    firsts = df.groupBy(column).agg(F.min(order).alias("_o"))
    return with_row_index(firsts, ["_o", column], name=name).select(column, name)


def heatmap_cells(df: DataFrame, x: str, y: str, value: str, order: str) -> DataFrame:
    """Cells ``(x, y, x_index, y_index, value, mark)``; categories in first-seen order, extremes marked."""
    cells = df.groupBy(x, y).agg(F.sum(F.col(value).cast("double")).alias("value"))
    placed = attach_stats(attach_stats(cells, _first_seen(df, x, order, "x_index"), [x]), _first_seen(df, y, order, "y_index"), [y])
    ends = cells.agg(F.max("value").alias("top"), F.min("value").alias("low")).first()
    mark = F.when(F.col("value") == F.lit(ends["top"]), "max").when(F.col("value") == F.lit(ends["low"]), "min")
    return placed.select(F.col(x).alias("x"), F.col(y).alias("y"), "x_index", "y_index", "value", mark.alias("mark"))


def radar_axes(df: DataFrame, name: str, dimensions: Sequence[str]) -> DataFrame:
    """``(name, dimension, value, axis_max)``, the axis reaching to 1.2 times the largest value."""
    tops = df.agg(*[F.max(F.coalesce(F.col(d).cast("double"), F.lit(0.0))).alias(d) for d in dimensions]).first()
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value"), F.lit(1.2 * (tops[d] or 0.0)).alias("axis_max"))
        for i, d in enumerate(dimensions)
    ]
    return df.select(F.col(name).alias("name"), F.inline(F.array(*items)))


def radar_extremes(axes: DataFrame) -> DataFrame:
    """Strongest and weakest dimension per series; the earlier one on equal values."""
    return axes.groupBy("name").agg(
        F.max_by("dimension", F.struct("value", (-F.col("position")).alias("p"))).alias("strongest"),
        F.min_by("dimension", F.struct("value", "position")).alias("weakest"),
    )


def funnel(stages: DataFrame, stage: str, value: str, ascending: bool = False, order_by: str | None = None) -> DataFrame:
    """Stages (one row each) by value, with the rate to the previous stage and the share of the first.

    With ``order_by`` the stages stay in the order of that column instead.
    """
    by = F.col("_by").asc() if order_by else F.col("value").asc() if ascending else F.col("value").desc()
    order = [by, F.col("stage").asc()]
    rows = stages.select(F.col(stage).alias("stage"), F.col(value).alias("value"), (F.col(order_by) if order_by else F.lit(None)).alias("_by"))
    placed = materialize(with_row_index(rows, order))
    head = placed.where(F.col("idx") == 0).first()
    before = placed.select((F.col("idx") + 1).alias("idx"), F.col("value").alias("prev"))
    share = F.try_divide(F.col("value") * 100.0, F.lit(head["value"]).cast("double")) if head else F.lit(None).cast("double")
    return placed.join(before, "idx", "left").select(
        "stage", "value", (F.col("idx") + 1).cast("int").alias("step"),
        F.try_divide(F.col("value") * 100.0, F.col("prev").cast("double")).alias("rate_pct"), share.alias("share_pct"),
    )


def treemap(df: DataFrame, name: str, value: str) -> DataFrame:
    """Summed value and percentage of the whole per name."""
    groups = df.groupBy(F.col(name).alias("name")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    return groups.select("name", "value", F.try_divide(F.col("value") * 100, _total(df, value)).alias("pct"))


def treemap_summary(tiles: DataFrame, top: int = 3) -> DataFrame:
    """Total, largest tile and the share of the three largest."""
    best = tiles.orderBy(F.desc("value"), "name").limit(top)
    head = best.agg(F.sum("value").alias("t"), F.max_by("name", F.struct("value", "name")).alias("largest"), F.max("value").alias("largest_value"))
    total = _total(tiles, "value")
    return head.select(total.alias("total"), "largest", "largest_value", F.try_divide(F.col("t") * 100, total).alias("top_pct"))


def sankey_nodes(df: DataFrame, source: str, target: str) -> DataFrame:
    ends = df.select(F.explode(F.array(F.col(source).cast("string"), F.col(target).cast("string"))).alias("name"))
    return ends.where(F.col("name").isNotNull()).distinct()


def sankey_links(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    return df.groupBy(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target")).agg(F.sum(value).alias("value"))


def gauge(value: DataFrame, column: str, maximum: float = 100.0) -> DataFrame:
    """One value with its band: up to 30, 70 and 100 percent of the maximum."""
    v = F.col(column)
    band = F.when(v <= 0.3 * maximum, "low").when(v <= 0.7 * maximum, "medium").otherwise("high")
    return value.select(v.alias("value"), F.lit(maximum).alias("max"), band.alias("band"))


def box_plot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: whiskers, quartiles at floor ranks, upper median, mean, population sd, n."""
    rows = df.select(F.col(group).alias("group"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    picks = {name: (q, floor_rank(q)) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    ranks = order_elements(rows, "v", picks, ["group"])
    moments = rows.groupBy("group").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    iqr = F.col("q3") - F.col("q1")
    return attach_stats(ranks, moments, ["group"]).select(
        "group", F.greatest(F.col("low"), F.col("q1") - 1.5 * iqr).alias("lower"), "q1", "median", "q3",
        F.least(F.col("high"), F.col("q3") + 1.5 * iqr).alias("upper"), "mean", "sd", "n",
    )


def box_outliers(df: DataFrame, group: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    bounds = box_plot(df, group, value).select("group", "lower", "upper")
    rows = df.select(F.col(group).alias("group"), F.col(value).cast("double").alias("value"), *keep)
    return attach_stats(rows, bounds, ["group"]).where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).drop("lower", "upper")


def candlesticks(df: DataFrame, ts: str, price: str, tie: str, keys: Sequence[str] = (), grain: str = "day", volume: str | None = None) -> DataFrame:
    """Ticks to bars: first, last, lowest and highest price and the summed volume per period."""
    period = F.date_trunc(grain, F.col(ts)).cast("date").alias("period")
    order = F.struct(ts, tie)
    return df.where(F.col(price).isNotNull()).groupBy(*keys, period).agg(
        F.min_by(price, order).alias("open"), F.max_by(price, order).alias("close"), F.min(price).alias("low"), F.max(price).alias("high"),
        (F.sum(volume) if volume else F.count(F.lit(1))).alias("volume"),
    )

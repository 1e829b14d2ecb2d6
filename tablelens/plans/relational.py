"""Business questions over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import relational as rel
from tablelens.operators.charts import treemap
from tablelens.plans.registry import query, table

REVENUE = "l_extendedprice * (1 - l_discount)"


@query("numeric_column_values", "R1 R4", "SELECT l_orderkey, l_partkey, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem WHERE l_extendedprice IS NOT NULL")
def numeric_column_values(spark, sf):
    return rel.numeric_column(table(spark, sf, "lineitem"), "l_extendedprice", ["l_orderkey", "l_partkey"])


@query(
    "date_ordered_values",
    "R2",
    """SELECT o_orderdate AS ts, o_orderkey AS tie, o_totalprice AS value,
              row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx
       FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL""",
)
def date_ordered_values(spark, sf):
    return rel.date_value_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderkey")


@query(
    "multi_numeric_projection",
    "R3",
    """SELECT o_orderkey, try_cast(o_totalprice AS DOUBLE) AS o_totalprice, try_cast(o_orderstatus AS DOUBLE) AS o_orderstatus
       FROM orders WHERE try_cast(o_totalprice AS DOUBLE) IS NOT NULL OR try_cast(o_orderstatus AS DOUBLE) IS NOT NULL""",
)
def multi_numeric_projection(spark, sf):
    return rel.numeric_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderstatus"], ["o_orderkey"])


@query(
    "number_coercion",
    "R4",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS not_a_number FROM events""",
)
def number_coercion(spark, sf):
    raw = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return raw.select("event_id", rel.to_number("k").alias("k"), rel.to_number("event_type").alias("not_a_number"))


_ADHOC = """WITH big AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend
                         FROM orders GROUP BY o_custkey)
            SELECT c.c_mktsegment, count(*) AS customers, sum(b.n_orders) AS n_orders, round(sum(b.spend), 2) AS spend
            FROM big b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY c.c_mktsegment"""


@query("adhoc_sql", "R5", f"SELECT c_mktsegment, customers, CAST(n_orders AS BIGINT) AS n_orders, spend FROM ({_ADHOC})")
def adhoc_sql(spark, sf):
    return rel.run_sql(spark, _ADHOC, {n: table(spark, sf, n) for n in ("orders", "customer")})


@query("adhoc_sql_row_count", "R5", "SELECT count(*) AS total_rows FROM orders WHERE o_orderstatus = 'F'")
def adhoc_sql_row_count(spark, sf):
    rows = rel.run_sql(spark, "SELECT * FROM orders WHERE o_orderstatus = 'F'", {"orders": table(spark, sf, "orders")})
    return rows.agg(F.count(F.lit(1)).alias("total_rows"))


@query("adhoc_sql_page", "R5 R6", f"SELECT c_mktsegment, customers, CAST(n_orders AS BIGINT) AS n_orders, spend FROM ({_ADHOC}) ORDER BY c_mktsegment LIMIT 1000")
def adhoc_sql_page(spark, sf):
    """The first 1000 rows of an ad-hoc result; ``adhoc_sql_row_count`` counts all of them."""
    return rel.preview(adhoc_sql(spark, sf), ["c_mktsegment"])


@query("table_preview", "R6", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def table_preview(spark, sf):
    return rel.preview(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"])


@query(
    "compound_predicates",
    "R7 Q20",
    """SELECT p_partkey, p_name, p_size FROM part
       WHERE p_name LIKE '%ring%' AND p_size BETWEEN 10 AND 30 AND (p_brand = 'Brand#2' OR p_retailprice > 950)""",
)
def compound_predicates(spark, sf):
    return (
        table(spark, sf, "part")
        .where(F.col("p_name").contains("ring") & F.col("p_size").between(10, 30))
        .where((F.col("p_brand") == "Brand#2") | (F.col("p_retailprice") > 950))
        .select("p_partkey", "p_name", "p_size")
    )


def _part_revenue(spark, sf):
    per_part = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.expr(REVENUE)).alias("rev"))
    return per_part.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "p_partkey", "p_name", F.round("rev", 2).alias("revenue")
    )


_PART_REVENUE = f"""SELECT p_partkey, p_name, round(sum({REVENUE}), 2) AS revenue
                    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name"""


@query("top_parts_by_revenue", "Q1", f"{_PART_REVENUE} ORDER BY revenue DESC, p_partkey LIMIT 5")
def top_parts_by_revenue(spark, sf):
    return _part_revenue(spark, sf).orderBy(F.desc("revenue"), "p_partkey").limit(5)


@query("bottom_parts_by_revenue", "Q2", f"{_PART_REVENUE} ORDER BY revenue, p_partkey LIMIT 5")
def bottom_parts_by_revenue(spark, sf):
    return _part_revenue(spark, sf).orderBy("revenue", "p_partkey").limit(5)


@query(
    "revenue_by_region",
    "Q3",
    """SELECT r_name, round(sum(o_totalprice), 2) AS total FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY total DESC, r_name""",
)
def revenue_by_region(spark, sf):
    # one row per customer before the first join, one per nation before the next
    spend = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    nations = (
        spend.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("spend").alias("spend"))
    )
    return (
        nations.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(F.round(F.sum("spend"), 2).alias("total"))
        .orderBy(F.desc("total"), "r_name")
    )


@query(
    "brand_totals",
    "Q4",
    """SELECT p_brand, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, count(*) AS line_count,
              round(avg(l_extendedprice), 2) AS avg_price
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def brand_totals(spark, sf):
    per_part = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("p")
    )
    return (
        per_part.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(F.sum("q").alias("quantity"), F.sum("n").alias("line_count"), F.round(F.sum("p") / F.sum("n"), 2).alias("avg_price"))
    )


@query(
    "priority_share",
    "Q5",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total,
              round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS pct
       FROM orders GROUP BY o_orderpriority""",
)
def priority_share(spark, sf):
    shares = treemap(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return shares.select(F.col("name").alias("o_orderpriority"), F.round("value", 2).alias("total"), F.round("pct", 4).alias("pct"))


@query("events_per_user", "Q6", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id")
def events_per_user(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id")


@query("events_per_type", "Q7", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def events_per_type(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("users_per_type", "Q8", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def users_per_type(spark, sf):
    # count per (type, user) first: the second step then sees one row per pair
    pairs = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"))
    return pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.sum("c").alias("n"))


@query("mean_value_per_type", "Q9", "SELECT event_type, round(avg(value), 4) AS avg_value FROM events GROUP BY event_type")
def mean_value_per_type(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("avg_value"))


@query(
    "users_with_purchase",
    "Q10",
    "SELECT DISTINCT user_id FROM events e WHERE EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase')",
)
def users_with_purchase(spark, sf):
    events = table(spark, sf, "events")
    users = events.select("user_id").distinct()
    buyers = events.where(F.col("event_type") == "purchase").select("user_id").distinct()
    return users.join(buyers, "user_id", "left_semi")


@query(
    "clicked_without_purchase",
    "Q11",
    """SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events e WHERE event_type = 'click' AND NOT EXISTS
       (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE) AND p.event_type = 'purchase')""",
)
def clicked_without_purchase(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    clicked = events.where(F.col("event_type") == "click").select("user_id", "day").distinct()
    bought = events.where(F.col("event_type") == "purchase").select("user_id", "day").distinct()
    return clicked.join(bought, ["user_id", "day"], "left_anti")


@query("most_frequent_type", "Q12", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1")
def most_frequent_type(spark, sf):
    return events_per_type(spark, sf).orderBy(F.desc("n"), "event_type").limit(1)


@query(
    "profit_per_supplier",
    "Q13",
    """SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(900 * l_quantity), 2) AS expense,
              round(sum(l_extendedprice * (1 - l_discount)) - sum(900 * l_quantity), 2) AS profit
       FROM lineitem GROUP BY l_suppkey HAVING sum(l_extendedprice * (1 - l_discount)) - sum(900 * l_quantity) > 0""",
)
def profit_per_supplier(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.expr(REVENUE)).alias("r"), F.sum(900 * F.col("l_quantity")).alias("e")
    )
    return sums.where(F.col("r") - F.col("e") > 0).select(
        "l_suppkey",
        F.round("r", 2).alias("revenue"),
        F.round("e", 2).alias("expense"),
        F.round(F.col("r") - F.col("e"), 2).alias("profit"),
    )


_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"


@query("monthly_totals", "Q14", f"SELECT {_MONTH} AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1")
def monthly_totals(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    return table(spark, sf, "orders").groupBy(month).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("month")


@query(
    "monthly_totals_one_priority",
    "Q14",
    f"SELECT {_MONTH} AS month, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY 1",
)
def monthly_totals_one_priority(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.groupBy(month).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("month")


@query("weekly_counts", "Q15", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def weekly_counts(spark, sf):
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    return table(spark, sf, "events").groupBy(week).agg(F.count(F.lit(1)).alias("n")).orderBy("week")


@query(
    "orders_in_date_range",
    "Q16",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-06-30 00:00:00'""",
)
def orders_in_date_range(spark, sf):
    first, last = (F.expr(f"TIMESTAMP_NTZ '{d} 00:00:00'") for d in ("1997-01-01", "1997-06-30"))
    rows = table(spark, sf, "orders").where(F.col("o_orderdate").between(first, last))
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query(
    "flag_status_totals",
    "Q17",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum({REVENUE}), 2) AS revenue
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def flag_status_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr(REVENUE)), 2).alias("revenue")
    )


@query(
    "global_aggregates",
    "Q18",
    """SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lowest,
              max(o_totalprice) AS highest, count(*) AS n FROM orders""",
)
def global_aggregates(spark, sf):
    p = "o_totalprice"
    return table(spark, sf, "orders").agg(
        F.round(F.sum(p), 2).alias("total"),
        F.round(F.avg(p), 4).alias("mean"),
        F.min(p).alias("lowest"),
        F.max(p).alias("highest"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "orders_per_customer",
    "Q19",
    "SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
)
def orders_per_customer(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf, "customer").join(counts, "c_custkey", "left").select(
        "c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "large_urgent_orders",
    "Q20",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 AND o_orderstatus <> 'O'",
)
def large_urgent_orders(spark, sf):
    return (
        table(spark, sf, "orders")
        .where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") != "O"))
        .select("o_orderkey", "o_totalprice")
    )


@query(
    "orders_with_lines",
    "J3",
    """SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_extendedprice
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def orders_with_lines(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")

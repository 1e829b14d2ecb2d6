"""Itemsets and rules over order attributes and order baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import association as assoc
from tablelens.plans.registry import query, table

_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _line_transactions(spark, sf):
    return assoc.row_transactions(table(spark, sf, "lineitem"), _COLS)


def _text(col: str, sep: str = "|"):
    return F.array_join(col, sep).alias(col)


def itemsets_sql(source: str, min_support: float) -> str:
    """Sets of size 1 to 3 from (t, item) pairs by self-joins, items in order."""
    return f"""t AS ({source}), n AS (SELECT count(DISTINCT t) AS n FROM t),
        f1 AS (SELECT item AS a, count(*) AS freq FROM t GROUP BY item HAVING count(*) >= {min_support} * (SELECT n FROM n) - 1e-9),
        tf AS (SELECT t, item FROM t WHERE item IN (SELECT a FROM f1)),
        f2 AS (SELECT x.item AS a, y.item AS b, count(*) AS freq FROM tf x JOIN tf y ON x.t = y.t AND x.item < y.item GROUP BY ALL
               HAVING count(*) >= {min_support} * (SELECT n FROM n) - 1e-9),
        f3 AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS freq FROM tf x JOIN tf y ON x.t = y.t AND x.item < y.item
               JOIN tf z ON x.t = z.t AND y.item < z.item GROUP BY ALL HAVING count(*) >= {min_support} * (SELECT n FROM n) - 1e-9),
        sets AS (SELECT [a] AS items, 1 AS size, freq FROM f1 UNION ALL SELECT [a, b], 2, freq FROM f2 UNION ALL SELECT [a, b, c], 3, freq FROM f3)"""


_LINES = " UNION ALL ".join(
    f"SELECT rid AS t, '{c}=' || CAST({c} AS VARCHAR) AS item FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) WHERE {c} IS NOT NULL" for c in _COLS
)
_BRANDS = "SELECT DISTINCT l_orderkey AS t, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
_SETS = itemsets_sql(_LINES.replace("row_number() OVER ()", "row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber)"), 0.05)
_RULES = """r AS (SELECT s.items[1:0] AS e, x.items AS ante, y.items AS cons, s.freq / n AS support, (s.freq / n) / (x.freq / n) AS confidence,
        (s.freq / n) / (x.freq / n) / (y.freq / n) AS lift, s.freq / n - (x.freq / n) * (y.freq / n) AS leverage, y.freq / n AS sc
        FROM sets s CROSS JOIN n JOIN sets x ON x.size < s.size AND list_has_all(s.items, x.items)
        JOIN sets y ON y.size = s.size - x.size AND list_has_all(s.items, y.items) AND NOT list_has_any(x.items, y.items) WHERE s.size > 1),
    rr AS (SELECT array_to_string(ante, '|') AS antecedent, array_to_string(cons, '|') AS consequent, support, confidence, lift, leverage,
        CASE WHEN confidence < 1 THEN (1 - sc) / (1 - confidence) END AS conviction FROM r WHERE confidence >= {c} AND lift >= {l})"""
_ALL_RULES = f"WITH {_SETS}, {_RULES.format(c=0.2, l=1.0)}"


@query(
    "row_transactions",
    "A1",
    """SELECT o_orderkey, array_to_string(list_sort(['o_orderpriority=' || o_orderpriority, 'o_orderstatus=' || o_orderstatus]), '|') AS items FROM orders""",
)
def row_transactions(spark, sf):
    tx = assoc.row_transactions(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"])
    return tx.select("o_orderkey", _text("items"))


@query("brand_baskets", "A2", f"SELECT t AS l_orderkey, string_agg(item, '|' ORDER BY item) AS items FROM ({_BRANDS}) GROUP BY t")
def brand_baskets(spark, sf):
    return assoc.baskets(_order_brands(spark, sf), "l_orderkey", "p_brand").select("l_orderkey", _text("items"))


@query(
    "binned_transactions",
    "A2",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              'l_discount_bin' || CAST(floor(l_discount * 20) AS BIGINT) || '|' || 'l_tax_bin' || CAST(floor(l_tax * 20) AS BIGINT) AS items FROM lineitem""",
)
def binned_transactions(spark, sf):
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return assoc.binned_transactions(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], 20, keep).select(*keep, _text("items"))


def _order_brands(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(parts, "l_partkey")


_SHOW = "array_to_string(items, '|') AS items, size, freq, round(freq / n, 6) AS support"


@query("frequent_itemsets", "A3 J5", f"WITH {_SETS} SELECT {_SHOW} FROM sets, n")
def frequent_itemsets(spark, sf):
    sets = assoc.frequent_itemsets(_line_transactions(spark, sf), 0.05)
    return sets.select(_text("items"), "size", "freq", F.round("support", 6).alias("support"))


@query("frequent_brand_sets", "A3 J5", f"WITH {itemsets_sql(_BRANDS, 0.002)} SELECT {_SHOW} FROM sets, n")
def frequent_brand_sets(spark, sf):
    sets = assoc.frequent_itemsets_of_pairs(_order_brands(spark, sf), "l_orderkey", "p_brand", 0.002, max_size=3)
    return sets.select(_text("items"), "size", "freq", F.round("support", 6).alias("support"))


_METRICS = ("support", "confidence", "lift", "leverage", "conviction")


def _rules(spark, sf):
    sets = assoc.frequent_itemsets(_line_transactions(spark, sf), 0.05)
    return sets, assoc.association_rules(sets, 0.2, 1.0)


def _show_rules(rules):
    return rules.select(_text("antecedent"), _text("consequent"), *[F.round(m, 6).alias(m) for m in _METRICS])


_SHOW_RULES = "antecedent, consequent, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


@query("association_rules", "A4", f"{_ALL_RULES} SELECT {_SHOW_RULES} FROM rr")
def association_rules(spark, sf):
    return _show_rules(_rules(spark, sf)[1])


@query(
    "rule_statistics",
    "A5 A6",
    f"""{_ALL_RULES} SELECT (SELECT n FROM n) AS transactions, (SELECT count(*) FROM f1) AS frequent_items, (SELECT count(*) FROM sets) AS itemsets,
        count(*) AS rules, round(avg(support), 6) AS mean_support, round(avg(confidence), 6) AS mean_confidence, round(avg(lift), 6) AS mean_lift,
        count(*) FILTER (WHERE lift > 2) AS high_lift_rules, count(*) FILTER (WHERE confidence > 0.8) AS high_confidence_rules,
        CASE WHEN avg(lift) > 2 THEN 'strong' WHEN avg(lift) > 1.5 THEN 'medium' ELSE 'weak' END AS strength FROM rr""",
)
def rule_statistics(spark, sf):
    out = assoc.rule_statistics(*_rules(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_support", "mean_confidence", "mean_lift")})


@query("unique_items", "A5", f"SELECT count(DISTINCT item) AS unique_items FROM ({_LINES})")
def unique_items(spark, sf):
    return assoc.unique_items(_line_transactions(spark, sf))


@query("top_rules", "A6", f"{_ALL_RULES} SELECT {_SHOW_RULES} FROM rr ORDER BY round(lift, 9) DESC, antecedent, consequent LIMIT 10")
def top_rules(spark, sf):
    rules = _rules(spark, sf)[1].withColumn("lift", F.round("lift", 9))
    return _show_rules(assoc.top_rules(rules))


@query("top_itemsets", "A6", f"WITH {_SETS} SELECT {_SHOW} FROM sets, n ORDER BY freq DESC, size, sets.items LIMIT 20")
def top_itemsets(spark, sf):
    sets = assoc.top_itemsets(assoc.frequent_itemsets(_line_transactions(spark, sf), 0.05))
    return sets.select(_text("items"), "size", "freq", F.round("support", 6).alias("support"))


@query("top_combined_itemsets", "A6", f"WITH {_SETS} SELECT {_SHOW} FROM sets, n WHERE size > 1 ORDER BY freq DESC, size, sets.items LIMIT 3")
def top_combined_itemsets(spark, sf):
    sets = assoc.top_itemsets(assoc.frequent_itemsets(_line_transactions(spark, sf), 0.05), 3, 2)
    return sets.select(_text("items"), "size", "freq", F.round("support", 6).alias("support"))


_ORDERS = " UNION ALL ".join(f"SELECT o_orderkey AS t, '{c}=' || {c} AS item FROM orders WHERE {c} IS NOT NULL" for c in ("o_orderstatus", "o_orderpriority"))


@query("table_rules", "A7", f"WITH {itemsets_sql(_ORDERS, 0.01)}, {_RULES.format(c=0.15, l=1.0)} SELECT {_SHOW_RULES} FROM rr")
def table_rules(spark, sf):
    rules = assoc.rules_of_table(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], min_support=0.01, min_confidence=0.15)
    return _show_rules(rules)

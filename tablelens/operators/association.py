"""Transactions, frequent itemsets, association rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.operators.profile import columns_of
from tablelens.session import materialize

# fixed values: defaults and report limits
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.1, 0.5, 1.0
STRONG_LIFT, MEDIUM_LIFT = 2.0, 1.5
EPS = 1e-9
WORDS = 8  # 64-bit words of a bitmap row


def row_transactions(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One sorted set of ``col=value`` items per row; rows without any value are dropped."""
    cells = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c in columns])
    return df.select(*keep, F.array_sort(F.array_distinct(F.array_compact(cells))).alias("items")).where(F.size("items") > 0)


def binned_transactions(df: DataFrame, columns: Sequence[str], bins: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """One item ``col_bin<k>`` per numeric cell in 0..1, ``k = floor(v * bins)``."""
    cells = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_bin"), F.floor(F.col(c) * bins).cast("string"))) for c in columns
    ]
    return df.select(*keep, F.array_sort(F.array_distinct(F.array_compact(F.array(*cells)))).alias("items")).where(F.size("items") > 0)


def baskets(df: DataFrame, basket: str, item: str | Column) -> DataFrame:
    """One sorted item set per basket id from long rows; for showing, mining does not need it.

    Repeated pairs are removed first, so a basket costs as many entries as it has different items.
    """
    pairs = _pairs(df, basket, item)
    return pairs.groupBy(basket).agg(F.array_sort(F.collect_list("item")).alias("items"))


def _pairs(df: DataFrame, basket: str, item: str | Column) -> DataFrame:
    value = F.col(item) if isinstance(item, str) else item
    return df.select(F.col(basket), value.cast("string").alias("item")).dropna().distinct()


def frequent_itemsets(transactions: DataFrame, min_support: float = MIN_SUPPORT, max_size: int | None = None) -> DataFrame:
    """Itemsets with support >= ``min_support``: ``(items, size, freq, support, n)``, items sorted.

    NULL items and repeated items of a transaction count for nothing.
    """
    numbered = materialize(transactions.select("items").withColumn("tid", F.monotonically_increasing_id()))
    rows = numbered.select("tid", F.explode("items").alias("item")).dropna()
    once = numbered.select("tid", F.explode(F.array_distinct("items")).alias("item")).dropna()
    return _mine(rows, once, numbered.count(), min_support, max_size)


def frequent_itemsets_of_pairs(df: DataFrame, basket: str, item: str | Column, min_support: float = MIN_SUPPORT, max_size: int | None = None) -> DataFrame:
    """The same from long rows. A basket is never a list, so its size does not matter."""
    pairs = materialize(_pairs(df, basket, item))
    numbered = materialize(pairs.select(basket).distinct().withColumn("tid", F.monotonically_increasing_id()))
    rows = pairs.join(numbered, basket).select("tid", "item")
    return _mine(rows, pairs.select("item"), numbered.count(), min_support, max_size)


def _bits(rows: DataFrame) -> DataFrame:
    """``(block, sid, w0, w1, ..)``: which transactions of a block of ``64 * WORDS`` have the item, one bit each."""
    tid = F.col("tid")
    word, bit = F.shiftright(tid, 6) % WORDS, F.expr("shiftleft(1L, cast(tid % 64 as int))")
    words = [F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    return rows.groupBy(F.floor(tid / (64 * WORDS)).alias("block"), "sid").agg(*words)


def _mine(rows: DataFrame, once: DataFrame, n: int, min_support: float, max_size: int | None) -> DataFrame:
    """Level by level: sets that share all but their last item are joined, and the bitmaps of both give that of the
    union by AND; its ones are the transactions. ``rows(tid, item)``; ``once(item)`` has every pair once.

    Only frequent items and sets have bitmaps, and a level is as many rows as its sets stand in blocks, whatever the
    number of items in a transaction.
    """
    need = min_support * n - EPS
    counts = once.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= need)
    single = counts.select(F.array("item").alias("items"), F.col("item").alias("last"), F.lit(None).cast("long").alias("prefix"), "freq")
    sets = materialize(single.withColumn("sid", F.monotonically_increasing_id()))
    found, size = sets, 1
    bits = None
    while max_size is None or size < max_size:
        a = sets.select("sid", "prefix", "last", "items")
        b = sets.select(F.col("sid").alias("other"), F.col("prefix").alias("_p"), F.col("last").alias("next"))
        pairs = materialize(a.join(b, F.col("prefix").eqNullSafe(F.col("_p")) & (F.col("last") < F.col("next"))).select("sid", "other", "items", "next"))
        if pairs.isEmpty():
            break
        if bits is None:
            bits = materialize(_bits(rows.join(sets.select("sid", F.col("last").alias("item")), "item")))
        names = [f"w{w}" for w in range(WORDS)]
        right = bits.select("block", F.col("sid").alias("other"), *[F.col(w).alias(f"_{w}") for w in names])
        both = bits.join(pairs.select("sid", "other"), "sid").join(right, ["block", "other"])
        both = both.select("block", "sid", "other", *[F.col(w).bitwiseAND(F.col(f"_{w}")).alias(w) for w in names])
        met = both.withColumn("c", sum(F.bit_count(w) for w in names)).where("c > 0")
        size += 1
        if size != max_size:  # the next level needs the bitmaps
            met = materialize(met)
        freq = met.groupBy("sid", "other").agg(F.sum("c").alias("freq")).where(F.col("freq") >= need)
        kept = freq.join(pairs, ["sid", "other"]).withColumn("_id", F.monotonically_increasing_id())
        kept = materialize(kept.select("sid", "other", "_id", "freq", F.concat("items", F.array("next")).alias("items"), F.col("next").alias("last")))
        sets = kept.select("items", "last", F.col("sid").alias("prefix"), "freq", F.col("_id").alias("sid"))
        found = found.unionByName(sets)
        if size != max_size:
            bits = met.join(kept.select("sid", "other", "_id"), ["sid", "other"]).select("block", F.col("_id").alias("sid"), *names)
    return found.select("items", F.size("items").alias("size"), "freq", (F.col("freq") / F.lit(float(n))).alias("support"), F.lit(n).cast("long").alias("n"))


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules from every itemset and every non-empty proper subset as antecedent.

    Antecedents come from dropping one item after the other, in order of position. A smaller antecedent has
    no larger confidence, so a step goes on only from antecedents that reach ``min_confidence``. The supports
    of both sides come from the itemset table, in which every subset of a frequent set is present.
    """
    itemsets = materialize(itemsets)
    left = itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("sa"))
    right = itemsets.select(F.col("items").alias("consequent"), F.col("support").alias("sc"))
    confidence = F.col("support") / F.col("sa")
    step = itemsets.where(F.col("size") >= 2).select("items", "support", F.col("items").alias("antecedent"), F.lit(0).alias("from"))
    sides = None
    while True:
        # position of the dropped item among all items; the items dropped before stand left of it
        cut = step.where(F.size("antecedent") >= 2).select("items", "support", "antecedent", F.posexplode("items").alias("at", "item"), "from").where(F.col("at") >= F.col("from"))
        cut = cut.select("items", "support", F.array_remove("antecedent", F.col("item")).alias("antecedent"), (F.col("at") + 1).alias("from"))
        step = materialize(cut.join(left, "antecedent").where(confidence >= min_confidence))
        if step.isEmpty():
            break
        sides = step if sides is None else sides.unionByName(step)
    if sides is None:
        sides = step
    sides = sides.select("antecedent", F.array_except("items", "antecedent").alias("consequent"), "support", "sa")
    rules = sides.join(right, "consequent").select(
        "antecedent",
        "consequent",
        "support",
        confidence.alias("confidence"),
        (confidence / F.col("sc")).alias("lift"),
        (F.col("support") - F.col("sa") * F.col("sc")).alias("leverage"),
        F.when(confidence < 1, (1 - F.col("sc")) / (1 - confidence)).alias("conviction"),
    )
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).orderBy(
        F.desc("lift"), "antecedent", "consequent"
    )


def strength(lift: Column) -> Column:
    return F.when(lift > STRONG_LIFT, "strong").when(lift > MEDIUM_LIFT, "medium").otherwise("weak")


def rule_statistics(itemsets: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: transactions, single items, rules, mean metrics, strength band of the mean lift."""
    sets = itemsets.agg(F.max("n").alias("transactions"), F.count_if(F.col("size") == 1).alias("frequent_items"), F.count(F.lit(1)).alias("itemsets")).first()
    out = rules.agg(
        F.count(F.lit(1)).alias("rules"),
        F.avg("support").alias("mean_support"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("lift").alias("mean_lift"),
        F.count_if(F.col("lift") > 2).alias("high_lift_rules"),
        F.count_if(F.col("confidence") > 0.8).alias("high_confidence_rules"),
    )
    heads = {c: F.lit(sets[c] or 0).cast("long") for c in ("transactions", "frequent_items", "itemsets")}
    return out.withColumns({**heads, "strength": strength(F.col("mean_lift"))})


def unique_items(transactions: DataFrame) -> DataFrame:
    return transactions.select(F.explode("items").alias("item")).distinct().agg(F.count(F.lit(1)).alias("unique_items"))


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.orderBy(F.desc("lift"), "antecedent", "consequent").limit(n)


def top_itemsets(itemsets: DataFrame, n: int = 20, min_size: int = 1) -> DataFrame:
    return itemsets.where(F.col("size") >= min_size).orderBy(F.desc("freq"), "size", "items").limit(n)


def rules_of_table(df: DataFrame, columns: Sequence[str] | None = None, max_distinct: int = 10, **limits) -> DataFrame:
    """Rules over the string columns and the numeric columns with few distinct values."""
    if columns is None:
        texts, numbers = columns_of(df, "string"), columns_of(df, "number")
        few = []
        if numbers:
            seen = df.agg(*[F.approx_count_distinct(c).alias(c) for c in numbers]).first()
            few = [c for c in numbers if seen[c] <= max_distinct]
        columns = [*texts, *few]
    if not columns:
        raise ValueError("the table has no categorical column")
    sets = frequent_itemsets(row_transactions(df, columns), limits.pop("min_support", MIN_SUPPORT), limits.pop("max_size", None))
    return association_rules(sets, **limits)

"""Classification and retrieval metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, gold: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """A row for each gold class, a count for each predicted one, zeros included."""
    spark = df.sparkSession
    counts = df.groupBy(gold).agg(*[F.count_if(F.col(predicted) == c).alias(f"predicted_{c}") for c in classes])
    every = spark.createDataFrame([(c,) for c in classes], f"{gold} string")
    return every.join(counts, gold, "left").na.fill(0)


def per_class(df: DataFrame, gold: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; null where a rate has no base."""
    cols = [F.struct(F.lit(c).alias("class"), F.count_if((F.col(gold) == c) & (F.col(predicted) == c)).alias("tp"), F.count_if(F.col(predicted) == c).alias("p"), F.count_if(F.col(gold) == c).alias("support")) for c in classes]
    rows = df.agg(F.array(*cols).alias("rows")).select(F.inline("rows"))
    rows = rows.select("class", "support", F.try_divide("tp", "p").alias("precision"), F.try_divide("tp", "support").alias("recall"))
    return rows.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_micro(rows: DataFrame, df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Means over the classes that have a value, and the share that is right."""
    macro = rows.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    micro = df.agg(F.try_divide(F.count_if(F.col(gold) == F.col(predicted)), F.count("*")).alias("micro_f1"))
    return macro.join(micro, how="cross")  # one row by one row


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "position") -> DataFrame:
    """The first k rows of each group; Spark keeps only k a task before the exchange."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def precision_at_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], relevant: Column, k: int = 10) -> DataFrame:
    return top_k(df, group, order, k).groupBy(*group).agg(F.count("*").alias("n"), F.try_divide(F.count_if(relevant), F.count("*")).alias("precision_at_k"))


def ndcg_at_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], gain: Column, k: int = 10) -> DataFrame:
    """Discounted gain over that of the best order; null where no row has any gain."""
    df = df.withColumn("__gain", gain)
    got = top_k(df, group, order, k).groupBy(*group).agg(F.sum(F.col("__gain") / F.log2(F.col("position") + 1)).alias("dcg"))
    best = top_k(df, group, [F.col("__gain").desc()], k).groupBy(*group).agg(F.sum(F.col("__gain") / F.log2(F.col("position") + 1)).alias("ideal"))
    return got.join(best, list(group)).select(*group, F.try_divide("dcg", "ideal").alias("ndcg"))


def pairwise_order(df: DataFrame, group: Sequence[str], position: str, degree: str, degrees: int) -> DataFrame:
    """Of pairs in order of position with different degrees, the share whose earlier row has the better (lower) one.

    Counted from running counts of each degree, so no pairs are made: a group costs its rows times the degrees.
    """
    before = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    lower = sum(F.when(F.col(degree) > d, F.coalesce(F.sum((F.col(degree) == d).cast("long")).over(before), F.lit(0))).otherwise(0) for d in range(degrees))
    higher = sum(F.when(F.col(degree) < d, F.coalesce(F.sum((F.col(degree) == d).cast("long")).over(before), F.lit(0))).otherwise(0) for d in range(degrees))
    out = df.select(*group, lower.alias("right"), higher.alias("wrong")).groupBy(*group).agg(F.sum("right").alias("concordant"), F.sum(F.col("right") + F.col("wrong")).alias("pairs"))
    return out.withColumn("accuracy", F.try_divide("concordant", "pairs"))


def set_match(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 of sets, and the share of equal sets."""
    common = F.size(F.array_intersect(gold, predicted))
    out = df.agg(
        F.try_divide(F.sum(common), F.sum(F.size(predicted))).alias("precision"),
        F.try_divide(F.sum(common), F.sum(F.size(gold))).alias("recall"),
        F.try_divide(F.count_if(F.array_sort(F.array_distinct(gold)) == F.array_sort(F.array_distinct(predicted))), F.count("*")).alias("exact"),
    )
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def zero_filled(counts: DataFrame, key: str, values: Sequence[str], count: str = "n") -> DataFrame:
    """A row for each value, those without rows at zero."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(counts, key, "left").na.fill(0, [count])


def rates(df: DataFrame, shares: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row of shares: how many of the rows of the second condition meet the first too; null without such rows."""
    return df.agg(*[F.try_divide(F.count_if(hit & base), F.count_if(base)).alias(name) for name, (hit, base) in shares.items()])


def field_counters(judged: DataFrame, fields: list[str]) -> DataFrame:
    """For each field the evaluator's counters, with precision and coverage (1.0 where nothing counts).

    For each field ``judged`` has the booleans <field>_scored, _correct, _accepted, _sourced (provenance holds) and _malformed.
    """
    each = judged.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f"{f}_{k}").alias(k) for k in ("scored", "correct", "accepted", "sourced", "malformed")]) for f in fields])))
    valid = F.col("correct") & F.col("sourced") & ~F.col("malformed")
    n = lambda test, name: F.count_if(test).alias(name)
    counted = each.groupBy("field").agg(
        n(F.col("scored"), "applicable"),
        n(F.col("accepted"), "accepted"),
        n(~F.col("accepted"), "abstained"),
        n(F.col("accepted") & valid, "correct"),
        n(~F.col("accepted") & valid, "correct_abstentions"),
        n(~valid, "incorrect"),
        n(F.col("accepted") & (~F.col("correct") | ~F.col("sourced")), "unsupported"),
        n(F.col("malformed"), "malformed"),
        n(~F.col("sourced"), "provenance_failures"),
    )
    share = lambda base: F.coalesce(F.try_divide("correct", base), F.lit(1.0))
    return counted.select("*", share("accepted").alias("precision"), share("applicable").alias("coverage"))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of each column stands."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])))
    return each.groupBy("field", "value").agg(F.count("*").alias("n"))


def chosen_labels(labels: DataFrame, status: str, gold: str, official: bool = False) -> DataFrame:
    """Q10: adjudicated labels that name a class, or, where there is none and official metrics aren't asked for, drafts that do."""
    named = labels.filter(F.coalesce(F.col(gold), F.lit("")) != "")
    best = named.filter(F.col(status) == "adjudicated")
    if not best.isEmpty():
        return best
    if official:
        raise ValueError("official metrics require adjudicated labels")
    return named.filter(F.col(status) == "draft")


def with_override(predictions: DataFrame, gold: DataFrame, more: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Predictions with the gold value, for which a supplemental one stands in where there is one."""
    gold = gold.select(*keys, F.col(value).alias("__gold")).join(more.select(*keys, F.col(value).alias("__more")), keys, "left")
    return predictions.join(gold, keys).withColumn("expected", F.coalesce("__more", "__gold")).drop("__gold", "__more")

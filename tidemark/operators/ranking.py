"""Numbers, ranks and quantiles of large groups without a window that holds a whole group.

Rows are cut into slices that follow their order; slices are counted, the counts are summed in
order, and within a slice rows are numbered by a window of their own. A slice of a shuffled order
is a prefix of its hash; one of a numeric order comes from approximate quantiles of the table, and
equal values are always in one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def shuffle_slice(key: Column) -> Column:
    """The slice of a hexadecimal hash."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def _cuts(value: Column | str, slices: int) -> Column:
    """Ascending, without repeats: approximate quantiles of a column's numbers (among which a NaN would disturb the order), then NaN."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    at = F.percentile_approx(F.when(~F.isnan(v), v), F.array(*(F.lit(i / slices) for i in range(1, slices))), F.lit(10 * slices))
    return F.concat(F.coalesce(F.array_distinct(at), F.expr("array()").cast("array<double>")), F.array(F.lit(float("nan"))))


def _less(df: DataFrame, value: str, cuts: Column | str, to: str, slices: int) -> DataFrame:
    """df with the number of cuts below a value, by halving: some eight comparisons a row in generated code, each step a projection of its own."""
    df, step = df.withColumn(to, F.lit(0)), 1 << ((slices - 1).bit_length() - 1)
    while step:
        df = df.withColumn(to, F.col(to) + F.when(F.get(cuts, F.col(to) + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return df


def value_slice(df: DataFrame, value: Column | str, slices: int = SLICES) -> DataFrame:
    """df with _s, the slice of a numeric value among approximate quantiles of the table; a null is in slice -1."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    placed = _less(df.crossJoin(F.broadcast(df.agg(_cuts(v, slices).alias("_cuts")))).withColumn("_v", v), "_v", "_cuts", "_s", slices)
    return placed.withColumn("_s", F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.col("_s"))).drop("_cuts", "_v")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, slices: Column | str | None = None) -> DataFrame:
    """df with the number of each row within its group, from 1. slices: a column that ascends with the first of `order`; without it, quantiles of that one, a number."""
    sliced = df.withColumn("_s", slices if isinstance(slices, Column) else F.col(slices)) if slices is not None else value_slice(df, order[0])
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_s").alias("_s2"), "_before")
    own = sliced.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order)))
    same = F.col("_s") == F.col("_s2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return own.join(counts, same).withColumn(name, F.col("_before") + F.col("_i")).select(*df.columns, name)


def mean_ranks(df: DataFrame, by: list[str], names: dict[str, str], slices: int = SLICES) -> DataFrame:
    """df with the mean rank (from 1) of each row's value within its group, for each column of numbers in `names`, under the name given there.

    Values are cut at quantiles of the table. Rows between two cuts are ranked by a window over the slice; rows equal to a cut
    share one rank, which takes their number only, so they are dealt freely: a value that a third of the rows share isn't one
    task's, and no row is joined with its value. The counts of slices, 2 * slices a group at most, are broadcast; groups are
    few by contract. NaN is the greatest number; a row whose value is null has no rank. The cuts are found by a job of their own
    when this is called, as approximate quantiles may come out differently when they are found again, and the counts and the
    rows need the same ones.
    """
    columns = df.columns
    found = df.agg(*(_cuts(v, slices).alias(f"_cuts{i}") for i, v in enumerate(names))).first()
    out = df
    for i, v in enumerate(names):
        cuts = F.lit(found[i])
        out = _less(out.withColumn(f"_v{i}", F.col(v).cast("double")), f"_v{i}", cuts, f"_s{i}", slices)
        equal = F.coalesce(F.get(cuts, F.col(f"_s{i}")) == F.col(f"_v{i}"), F.lit(False))
        out = out.withColumn(f"_s{i}", F.when(F.col(f"_v{i}").isNull(), F.lit(-1)).otherwise(2 * F.col(f"_s{i}") + equal.cast("int")))
    sliced = out
    out = sliced
    for i, name in enumerate(names.values()):
        s, v = f"_s{i}", f"_v{i}"
        before = Window.partitionBy(*by).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
        counts = sliced.where(F.col(v).isNotNull()).groupBy(*by, s).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        counts = counts.select(*(F.col(c).alias(f"_by{j}") for j, c in enumerate(by)), F.col(s).alias("_s"), "_n", "_before")
        same = F.col(s) == F.col("_s")
        for j, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_by{j}"))
        tied = F.col(s) % 2 != 0  # equal to a cut, or null
        dealt = out.withColumn("_deal", F.when(tied, F.spark_partition_id()).otherwise(F.lit(-1)))
        within = Window.partitionBy(*by, s, "_deal").orderBy(v)
        placed = dealt.withColumn("_mean", (F.rank().over(within) + F.count(F.lit(1)).over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2)
        rank = F.col("_before") + F.when(tied, (F.col("_n") + 1) / 2).otherwise(F.col("_mean"))
        out = placed.join(F.broadcast(counts), same, "left").withColumn(name, rank).drop("_deal", "_mean", "_s", "_n", "_before", *(f"_by{j}" for j in range(len(by))))
    return out.select(*columns, *names.values())


def quantiles(df: DataFrame, value: str, shares: list[float], accuracy: int = 100_000) -> DataFrame:
    """One row q0, q1, ..: the values at these shares of the sorted rows, between two rows in proportion; null without rows.

    Exact, in two passes over the rows, however many shares: an approximation (off by one in `accuracy` ranks at most) brackets
    each rank; then values within brackets are counted one by one, those between brackets together with their least and
    greatest, as a rank can be one beside its bracket. The counts are summed in slices. Approximations found twice can differ, so
    this needs spark.sql.exchange.reuse, which is on unless it is turned off.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    slack = 4 / accuracy
    ends = F.array(*(F.lit(min(1.0, max(0.0, q + d))) for q in shares for d in (-slack, slack)))
    # One column, the count first, so that no branch of the plan needs less of it than another and all read the same broadcast.
    stats = rows.agg(F.concat(F.array(F.count(F.lit(1)).cast("double")), F.percentile_approx("x", ends, F.lit(accuracy))).alias("e"))
    inside, below = F.lit(False), F.lit(0)
    for i in range(len(shares)):
        inside = inside | F.col("x").between(F.col("e")[2 * i + 1], F.col("e")[2 * i + 2])
        below = below + (F.col("x") > F.col("e")[2 * i + 2]).cast("int")
    near = rows.crossJoin(F.broadcast(stats)).select("x", F.col("e")[0].alias("n"), F.when(inside, F.col("x")).alias("at"), below.alias("below"))
    counts = near.groupBy("at", "below").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("n").alias("n"))
    sliced = value_slice(counts, "lo")
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # of SLICES rows
    totals = sliced.groupBy("_s").agg(F.sum("c").alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    upto = F.col("_before") + F.sum("c").over(Window.partitionBy("_s").orderBy("lo"))
    summed = sliced.join(F.broadcast(totals), "_s").withColumn("upto", upto)

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.struct("upto", F.when(F.col("upto") == rank, F.col("hi")).otherwise(F.col("lo")).alias("x"))))["x"]

    out = []
    for i, q in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(float(q))
        lower, upper = at_rank(F.floor(place) + 1), at_rank(F.ceil(place) + 1)
        out.append((lower + (upper - lower) * F.max(place - F.floor(place))).alias(f"q{i}"))
    return summed.agg(*out)

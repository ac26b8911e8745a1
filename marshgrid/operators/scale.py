"""Order-dependent building blocks that stay distributed.

A global ``row_number`` or an exact percentile written directly would put a
whole group into one task.  These helpers give the same results from range
partitions, per-partition counts and narrow value brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshgrid.session import materialise


def with_scalar(df: DataFrame, one_row: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Attach the columns of a one-row DataFrame through a scalar subquery."""
    names = names or one_row.columns
    value = one_row.select(F.struct(*names).alias("v")).scalar()
    out = df.withColumn("_scalar", value)
    return out.select(*df.columns, *[F.col("_scalar")[n].alias(n) for n in names])


def global_rank(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """1-based position of every row under a total order, without one big task.

    Rows are range-partitioned on the order and sorted inside each partition; a
    row's rank is its partition's starting offset plus its place in it.  The order
    must end in a unique column, which also lets a run of equal leading values
    spread over several partitions.  The ranged rows are checkpointed so the
    offsets and the rows describe the same partitioning even after a lost
    executor.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    saved = materialise(ranged)
    # One row per partition: the window below sees at most ``parts`` rows.
    sizes = saved.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (saved.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_pos") + 1)
            .drop("_part", "_pos", "_before"))


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """1-based position inside each group, safe when one group holds most rows."""
    if not by:
        return global_rank(df, order, name)
    ranked = global_rank(df, [*[F.col(b).asc() for b in by], *order], "_global")
    first = ranked.groupBy(*by).agg(F.min("_global").alias("_first"))
    joined = ranked.alias("l").join(
        first.alias("r"), _null_safe("l", "r", by)).select("l.*", "r._first")
    return joined.withColumn(name, F.col("_global") - F.col("_first") + 1).drop("_global", "_first")


def _null_safe(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        eq = F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
        cond = eq if i == 0 else cond & eq
    return cond


def with_ordinal(df: DataFrame, value: str, name: str) -> DataFrame:
    """Append a long that orders like the double ``value``: negatives below zero, then its exponent, then its fraction.

    Equal doubles have equal longs (-0.0 is 0.0) and different ones different longs; NaN is the greatest.
    """
    x, power, part = F.col(value), F.col("_power"), F.col("_part")
    size = F.abs(x)
    # The logarithm may be off by one next to a power of two; the quotient says so.
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    small = (part < 1) & (power > -1022)
    exponent = F.when(part >= 2, power + 1).when(small, power - 1).otherwise(power)
    fraction = F.when(part >= 2, part / 2).when(small, part * 2).otherwise(part) - 1
    bits = (exponent.cast("long") + 1023) * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("long")
    key = (F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 << 52))
           .when(F.isnan(x), F.lit((2047 << 52) + 1)).otherwise(bits))
    # Step by step: a step used several times is computed once.
    return (df.withColumn("_power", guess).withColumn("_part", size * F.pow(F.lit(2.0), -power))
            .withColumn(name, key).select(*df.columns, F.when(x < 0, -F.col(name)).otherwise(F.col(name)).alias(name)))


#: Bits of an ordinal that every level of a selection reads: so many rows, as a power of two, are in a window at most.
LEVELS = (22, 21, 21)


def exact_percentiles(df: DataFrame, by: list[str], value: str, probs: list[float], names: list[str]) -> DataFrame:
    """Linear-interpolation percentiles per group, with count ``n``, ``vmin``, ``vmax`` and ``negatives``.

    ``percentile`` keeps every distinct value of a group in one task.  Here the values are tallied once,
    spread by group and value, and every wanted order statistic is found by its bits: a histogram over the
    leading bits of all values says in which bin it lies and how many values are below it, the next one reads
    that bin only, and the last one tells single values apart.  The levels read the same exchange, so the
    input is computed once; no job runs before the result is asked for.  A window holds the bins of one level,
    at most 2**22 rows, however large the group is.

    NULLs are skipped and a group without values yields no row.  Ties, one value and values of any
    magnitude, infinite ones and NaN (as the greatest) included, need no other path.
    """
    tally = (df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
             .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    keyed = with_ordinal(tally, "_v", "_k")
    shift = 64 - LEVELS[0]
    bins = (keyed.groupBy(*by, F.shiftright("_k", shift).alias("_bin"))
            .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                 F.sum(F.when(F.col("_v") < 0, F.col("_c")).otherwise(0)).alias("_neg")))
    group = Window.partitionBy(*by)
    run = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select(*by, "_bin", "_c", *[f(c).over(group).alias(n) for f, c, n in (
        (F.sum, "_c", "n"), (F.min, "_lo", "vmin"), (F.max, "_hi", "vmax"), (F.sum, "_neg", "negatives"))],
        F.sum("_c").over(run).alias("_upto"))
    # Two neighbours a percentile; both are the same rank where no interpolation is needed.
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    wanted = F.array(*[F.struct(F.lit(2 * i + j).alias("_t"), f(at[i]).cast("long").alias("_rank"))
                       for i in range(len(probs)) for j, f in enumerate((F.floor, F.ceil))])
    totals = ["n", "vmin", "vmax", "negatives"]
    hit = (ranked.select("*", F.inline(wanted))
           .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
           .select(*by, *totals, "_t", "_bin", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")))

    found = None
    for bits in LEVELS[1:]:
        # Which values are left: those of the bins found so far, once a wanted rank.  Null-safe keys bring no
        # filter of their own, which would make another exchange of the tally.
        source = keyed if found is None else left
        bin_of = F.shiftright("_k", shift)
        on = _null_safe("s", "f", [*by, "_bin"] if found is None else [*by, "_t", "_bin"])
        held = [*by, "_v", "_c", "_k"]
        left = (source.withColumn("_bin", bin_of).alias("s").join(hit.alias("f"), on)
                .select(*[F.col(f"s.{c}") for c in held], "f._t", *[f"f.{c}" for c in totals], "f._rank"))
        if found is None:
            # One exchange, which the later levels read again.
            left = left.repartition(*by, "_t", "_k")
        shift -= bits
        bins = (left.groupBy(*by, "_t", F.shiftright("_k", shift).alias("_bin"))
                .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_v"), F.first("_rank").alias("_rank"),
                     *[F.first(c).alias(c) for c in totals]))
        run = Window.partitionBy(*by, "_t").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (bins.withColumn("_upto", F.sum("_c").over(run))
                 .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))))
        hit = found.select(*by, *totals, "_t", "_bin", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
        left = left.drop("_rank", *totals)

    def stat(t):
        return F.max(F.when(F.col("_t") == t, F.col("_v")))

    wide = found.groupBy(*by, *totals).agg(*[stat(t).alias(f"_s{t}") for t in range(2 * len(probs))])
    low, high = [F.col(f"_s{2 * i}") for i in range(len(probs))], [F.col(f"_s{2 * i + 1}") for i in range(len(probs))]
    # Equal neighbours are returned as they are: an infinite one minus itself is no number.
    return wide.select(*by, *totals, *[
        F.when(low[i] == high[i], low[i]).otherwise(low[i] + (high[i] - low[i]) * (at[i] - F.floor(at[i]))).alias(names[i])
        for i in range(len(probs))])

"""Group folds for leave-stations-out evaluation (M3, M4).

Greedy "largest group to the lightest fold" is sequential, so it is done for the largest
groups only, inside one expression over an array of bounded length. All smaller groups fill
what the folds have left, by running sums over the global order. A group never spans two folds.

The global rank is exact and distributed: a range-partitioned sort, a row number
inside each partition, and per-partition offsets from a table with one row per
partition. Nothing is collected and no single task sees all groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airfill.functions import geo
from airfill.session import checkpoint


def global_rank(df: DataFrame, order: Sequence[Column], partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Add ``_rank`` (0-based, dense over rows) in ``order`` without a single-partition
    window, and with ``weight`` the sum ``_before`` of that column over all earlier rows. The sorted, partition-tagged rows are checkpointed so both uses of the
    partition ids see the same layout."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    tagged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_pid", F.spark_partition_id()))
    tagged = checkpoint(tagged)
    own = Window.partitionBy("_pid").orderBy(*order)
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    inside = own.rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(weight) if weight else F.lit(0)
    local = tagged.withColumns({"_local": F.row_number().over(own) - 1, "_local_before": F.coalesce(F.sum(value).over(inside), F.lit(0))})
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"), F.sum(value).alias("_weight"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
                           F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_offset_before"))
    # one row per partition: a broadcast of proven small size
    j = local.join(F.broadcast(offsets), "_pid").withColumn("_rank", (F.col("_offset") + F.col("_local")).cast("long"))
    if weight:
        j = j.withColumn("_before", F.col("_offset_before") + F.col("_local_before"))
    return j.drop("_pid", "_local", "_offset", "_local_before", "_offset_before")


#: Groups per ``by`` value that are placed one by one.
HEAVY = 1000


def balanced_folds(df: DataFrame, group: str, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """M3: one fold per group (e.g. station) with k = min(k, groups) per ``by`` value.

    Output: by, group, n (rows of the group), fold."""
    counts = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))
    return folds_from_counts(counts, group, "n", k, by)


def _placed(k: Column) -> Column:
    """The largest group to the lightest fold, one after the other (ties: the lower fold), over the sorted array
    ``_heavy``: the loads of the ``k`` folds and each group's fold."""
    start = F.struct(F.transform(F.sequence(F.lit(1), k), lambda _: F.lit(0).cast("long")).alias("loads"),
                     F.array().cast("array<int>").alias("folds"))

    def place(now: Column, item: Column) -> Column:
        at = (F.array_position(now["loads"], F.array_min(now["loads"])) - 1).cast("int")
        return F.struct(F.transform(now["loads"], lambda v, i: F.when(i == at, v + item["n"]).otherwise(v)).alias("loads"),
                        F.concat(now["folds"], F.array(at)).alias("folds"))

    return F.aggregate("_heavy", start, place)


def _filled(loads: Column, total: Column, before: Column) -> Column:
    """The fold of a tail group with ``before`` rows of the tail ahead of it: folds are filled one after the
    other up to the level at which the tail's ``total`` rows are used up."""
    level = F.array_min(F.transform(F.array_sort(loads), lambda _, i: (
        total + F.aggregate(F.slice(F.array_sort(loads), 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b)) / (i + 1)))
    ends = F.transform(loads, lambda _, i: F.aggregate(F.slice(loads, 1, i + 1), F.lit(0.0), lambda a, b: a + F.greatest(F.lit(0.0), level - b)))
    return F.least(F.size(F.filter(ends, lambda e: e <= before)), F.size(loads) - 1).cast("int")


def folds_from_counts(counts: DataFrame, group: str, n: str, k: int = 5, by: Sequence[str] = (), heavy: int = HEAVY) -> DataFrame:
    """Folds for a table with one row per (by, group) and its weight ``n``.

    The ``heavy`` largest groups of a ``by`` value are placed one by one, largest to lightest, which is exact where
    there are no more. The tail, whose groups are all smaller, is dealt in order of size into what is left of each
    fold, by running sums. A fold ends at most one largest tail group above the common level, or where the heavy
    groups alone have brought it."""
    by = list(by)
    if not by:
        counts, by = counts.withColumn("_all", F.lit(0)), ["_all"]
    counts = counts.select(*by, F.col(group).alias("_group"), F.col(n).cast("long").alias("n"))
    ranked = global_rank(counts, [*[F.col(b) for b in by], F.col("n").desc(), F.col("_group")], weight="n")
    # per ``by`` value: first global rank and number of groups (one row per value)
    stats = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_groups"))
    j = ranked.join(stats, by, "inner").withColumn("_rk", F.col("_rank") - F.col("_first"))
    tail = j.where(F.col("_rk") >= heavy)
    left = tail.groupBy(*by).agg(F.min("_before").alias("_start"), F.sum("n").alias("_total"))
    kk = F.least(F.lit(k), F.col("_groups")).cast("int")
    top = (j.where(F.col("_rk") < heavy).groupBy(*by, "_groups")  # at most ``heavy`` rows per value
            .agg(F.sort_array(F.collect_list(F.struct("_rk", "n", "_group"))).alias("_heavy"))
            .withColumn("_p", _placed(kk)))
    first = top.select(*by, F.explode(F.arrays_zip("_heavy", F.col("_p.folds").alias("_folds"))).alias("_x")).select(
        *by, F.col("_x._heavy._group").alias("_group"), F.col("_x._heavy.n").alias("n"), F.col("_x._folds").alias("fold"))
    rest = tail.join(left.join(top.select(*by, F.col("_p.loads").alias("_loads")), by), by).select(
        *by, "_group", "n", _filled(F.col("_loads"), F.col("_total"), F.col("_before") - F.col("_start")).alias("fold"))
    return first.unionByName(rest).withColumnsRenamed({"_group": group, "n": n}).drop("_all")


def block_key(lat: Column, lon: Column, block_deg: float) -> Column:
    """M4: spatial block id ``<floor(lat/b)>_<floor(lon/b)>``."""
    return F.concat_ws("_", geo.cell_index(lat, block_deg).cast("string"),
                       geo.cell_index(lon, block_deg).cast("string"))


def spatial_block_folds(df: DataFrame, group: str, lat: str, lon: str, block_deg: float = 1.0,
                        k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """M4: folds over spatial blocks; every group inherits its block's fold, so nearby
    stations are held out together. Output: by, group, block, fold."""
    per_group = df.groupBy(*by, group).agg(F.first(lat, ignorenulls=True).alias("_lat"),
                                           F.first(lon, ignorenulls=True).alias("_lon"),
                                           F.count(F.lit(1)).alias("_n"))
    with_block = per_group.withColumn("block", block_key(F.col("_lat"), F.col("_lon"), block_deg))
    weights = with_block.groupBy(*by, "block").agg(F.sum("_n").alias("n"))
    bf = folds_from_counts(weights, "block", "n", k, by)
    return with_block.join(bf.select(*by, "block", "fold"), [*by, "block"], "inner").select(*by, group, "block", "fold")

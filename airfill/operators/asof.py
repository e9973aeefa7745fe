"""Point-in-time (as-of) join, backward, inner.

Shape of the plan: one shuffle of left + right rows on (key, time bucket) and a single
running ``last(struct, ignorenulls)`` window inside each bucket. A hot key (one station
holding a third of all rows) is therefore spread over all of its buckets instead of
landing in one task. Matches that lie in an earlier bucket are supplied by one synthetic
"carry-in" row per (key, bucket) that holds left rows, computed from two small
per-bucket aggregates and a window over buckets.

Left rows can be told apart on the way (``once``): those that agree lie next to each other in a sorted bucket.

The right side is carried as ONE struct, so a right row with a NULL column is never
mixed with an older row (SURVEY 7.4).

``asof_lookup`` is the form for a right side with few rows in a bucket (a day of hourly weather): left rows are
not sorted by time and not joined by right rows in their sort; each finds its right row by an equi join on
(key, bucket) with the span in which that row is the latest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bucket_of(c: Column, bucket: str) -> Column:
    # a day needs no session zone, which truncating goes through twice
    return (F.to_date(c) if bucket == "day" else F.date_trunc(bucket, c)).cast(T.TimestampNTZType())


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, left_time: str,
              right_time: str, right_cols: Sequence[str] | None = None, bucket: str = "day",
              tolerance: str | None = None, how: str = "inner", left_cols: Sequence[str] | None = None,
              once: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """Attach to each ``left`` row the latest ``right`` row with the same ``on`` key and
    ``right_time <= left_time``.

    right_cols: right columns to attach (default: all but keys and time).
    bucket:     ``date_trunc`` unit that splits each key's timeline (``hour``, ``day``,
                ``month``...); finer buckets spread hot keys more, coarser buckets make
                the carry-in table smaller.
    tolerance:  optional interval text (``"6 hours"``): older matches are treated as none.
    how:        ``inner`` drops left rows with no match; ``left`` keeps them with NULLs.
    left_cols:  left columns to keep (default: all but keys).
    once:       of left rows that agree in keys, time and these columns only the one with the greatest
                ``order`` tuple stays (NULL is the least). They lie together in the sorted buckets, so that
                telling rows apart takes no shuffle or sort of its own.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if right_cols is None:
        right_cols = [c for c in right.columns if c not in keys and c != right_time]
    right_cols = list(right_cols)
    left_cols = [c for c in left.columns if c not in keys] if left_cols is None else list(left_cols)
    clash = set(left_cols) & set(right_cols)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}; rename first")

    # a time of the window's own type is its order already and not carried twice
    kept = [c for c in left_cols if c not in once and (c != left_time or left.schema[c].dataType != T.TimestampNTZType())]
    lstruct = F.struct(*[F.col(c) for c in kept] or [F.lit(True).alias("__none")])
    rstruct = F.struct(*[F.col(c) for c in right_cols], F.col(right_time).alias("__rt"))
    rlast_struct = F.struct(*[F.col(c) for c in right_cols], F.col("__rt"))
    ltype = left.select(lstruct.alias("s")).schema["s"].dataType
    rtype = right.select(rstruct.alias("s")).schema["s"].dataType

    def bucket_of(c):
        return _bucket_of(c, bucket)

    told = [f"__once{i}" for i in range(len(once))]
    rank = [f"__order{i}" for i in range(len(order))]
    lrows = left.select(*keys, F.col(left_time).cast(T.TimestampNTZType()).alias("__t"),
                        F.lit(2).alias("__side"), lstruct.alias("__l"),
                        F.lit(None).cast(rtype).alias("__r"), *[F.col(c).alias(n) for c, n in zip(once, told, strict=True)],
                        *[o.alias(n) for o, n in zip(order, rank, strict=True)])
    rrows = right.select(*keys, F.col(right_time).cast(T.TimestampNTZType()).alias("__t"),
                         F.lit(1).alias("__side"), F.lit(None).cast(ltype).alias("__l"),
                         rstruct.alias("__r"))

    # carry-in: for each (key, bucket) that holds left rows, the last right row of any
    # earlier bucket. Both inputs are per-bucket aggregates (map-side combined).
    # Column by column: numbers are aggregated by hash, a struct by a sort of all rows; each
    # column follows the same comparisons of the time, so that the columns are those of one row.
    rlast = (right.select(*keys, *right_cols, F.col(right_time).alias("__rt"), F.col(right_time).cast(T.TimestampNTZType()).alias("__t"))
                  .groupBy(*keys, bucket_of(F.col("__t")).alias("__b"))
                  .agg(*[F.max_by(c, "__t").alias(c) for c in [*right_cols, "__rt"]])
                  .select(*keys, "__b", rlast_struct.alias("__last"))
                  .withColumn("__k", F.lit(1)))
    lkeys = (lrows.select(*keys, bucket_of(F.col("__t")).alias("__b")).distinct()
                  .withColumn("__last", F.lit(None).cast(rtype))
                  .withColumn("__k", F.lit(0)))
    wb = (Window.partitionBy(*keys).orderBy("__b", "__k")
                .rowsBetween(Window.unboundedPreceding, -1))
    carry = (lkeys.unionByName(rlast)
                  .withColumn("__carry", F.last("__last", ignorenulls=True).over(wb))
                  .filter((F.col("__k") == 0) & F.col("__carry").isNotNull())
                  .select(*keys, F.col("__b").alias("__t"), F.lit(0).alias("__side"),
                          F.lit(None).cast(ltype).alias("__l"), F.col("__carry").alias("__r")))

    rows = lrows.unionByName(rrows, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    rows = rows.withColumn("__b", bucket_of(F.col("__t")))
    lined = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", *told, *[F.col(c).desc() for c in rank])
    same = ["__t", "__side", *told] if once else []
    # one projection, so that both functions go over the sorted rows together
    hit = rows.select("*", F.last("__r", ignorenulls=True).over(lined.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__hit"),
                      *[F.lag(c).over(lined).alias(f"__before{c}") for c in same])
    if once:
        # of rows told as one the first in line stays: the one whose row before is another's
        again = F.lit(True)
        for c in same:
            again = again & F.col(f"__before{c}").eqNullSafe(F.col(c))
        hit = hit.filter(~again)
    hit = hit.filter(F.col("__side") == 2)
    if tolerance is not None:
        too_old = F.col("__hit.__rt") < F.col("__t") - F.expr(f"INTERVAL {tolerance}")
        hit = hit.withColumn("__hit", F.when(too_old, F.lit(None)).otherwise(F.col("__hit")))
    if how == "inner":
        hit = hit.filter(F.col("__hit").isNotNull())
    elif how != "left":
        raise ValueError("how must be 'inner' or 'left'")
    place = {**{c: f"__l.{c}" for c in kept}, **dict(zip(once, told, strict=True))}
    return hit.select(*keys, *[F.col(place.get(c, "__t")).alias(c) for c in left_cols],
                      *[F.col(f"__hit.{c}").alias(c) for c in right_cols])


def asof_lookup(left: DataFrame, right: DataFrame, on: Sequence[str] | str, left_time: str, right_time: str,
                right_cols: Sequence[str], left_cols: Sequence[str], left_buckets: DataFrame, bucket: str = "day",
                once: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """Inner ``asof_join`` that reads ``left`` once, for a right side with few rows in a bucket: they are held as one
    array, and a left row is compared with each of them. Rows with a NULL key or time match nothing; of right rows
    of one time the one with the greatest columns counts.

    left_buckets: keys and ``left_time`` of every bucket that holds left rows, and of others at will.
    once, order:  as in ``asof_join``. The rows are sorted by a hash of what tells them apart, in whatever order
                  they come, because comparing hashes is cheap and comparing rows isn't.
    """
    keys = [on] if isinstance(on, str) else list(on)
    clash = set(left_cols) & set(right_cols)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}; rename first")
    at = F.col(left_time).cast(T.TimestampNTZType())
    rows = left.withColumn("__b", _bucket_of(at, bucket)).repartition(*keys, "__b")
    if once:
        same = [*once, left_time]
        told = Window.partitionBy(F.xxhash64(*same), *keys, "__b", *same).orderBy(*[o.desc() for o in order])
        rows = rows.withColumn("__before", F.lag(F.lit(True)).over(told)).where(F.col("__before").isNull())
    rows = rows.select(*keys, "__b", *left_cols, at.alias("__t"))

    start = F.col(right_time).cast(T.TimestampNTZType())
    seen = (right.where(F.col(right_time).isNotNull())
                 .groupBy(*keys, _bucket_of(start, bucket).alias("__b"))
                 .agg(F.array_sort(F.collect_list(F.struct(start.alias("__from"), *right_cols))).alias("__seen"))
                 .withColumn("__k", F.lit(1)))
    held = left_buckets.select(*keys, _bucket_of(at, bucket).alias("__b")).distinct().withColumn("__k", F.lit(0))
    line = Window.partitionBy(*keys).orderBy("__b", "__k")
    # of a bucket that holds left rows: the last right row of any earlier one, and its own
    earlier = F.last(F.element_at("__seen", -1), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    own = F.when(F.lead("__b").over(line) == F.col("__b"), F.lead("__seen").over(line))
    series = (held.unionByName(seen, allowMissingColumns=True)
                  .select(*keys, "__b", "__k", earlier.alias("__earlier"), own.alias("__own")).where("__k = 0")
                  .select(*keys, "__b", F.flatten(F.array_compact(F.array(
                      F.when(F.col("__earlier").isNotNull(), F.array("__earlier")), "__own"))).alias("__all")))
    spans = series.select(*keys, "__b", F.explode(F.transform("__all", lambda x, i: F.struct(
        x.alias("row"), F.get("__all", i + 1)["__from"].alias("to")))).alias("__x")).select(
        *keys, "__b", F.col("__x.row.__from").alias("__from"), F.col("__x.to").alias("__to"),
        *[F.col(f"__x.row.{c}").alias(c) for c in right_cols])
    met = rows.join(spans.hint("shuffle_hash"), [*keys, "__b"]).where(
        (F.col("__t") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("__t") < F.col("__to"))))
    return met.select(*keys, *left_cols, *right_cols)

"""TOP without one task for all rows.

Spark's limit brings up to n rows of every partition to one task. Here that holds for small n only;
for others the rows of each partition are counted, and each row is kept or not by its own place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rows may go through one task.
ONE_TASK = 10_000
#: monotonically_increasing_id() is the partition's number above so many bits of the row's place in it.
PLACE_BITS = 33
LARGEST = (1 << 63) - 1


def first(frame: DataFrame, n: int) -> DataFrame:
    """Some n rows of a DataFrame, or all if there are fewer. Of a stream it is a limit."""
    if n <= ONE_TASK or frame.isStreaming:
        return frame.limit(min(n, (1 << 31) - 1))
    most = frame._jdf.queryExecution().analyzed().maxRows()
    if most.isDefined() and most.get() <= n:
        return frame
    if not _steady(frame._jdf.queryExecution().analyzed()):
        frame = _fixed(frame)
    place, taken = "place", {c.lower() for c in frame.columns}
    while place in taken:
        place += "_"
    end = _end(frame, n).scalar()
    return frame.withColumn(place, F.monotonically_increasing_id()).where(F.col(place) < F.coalesce(end, F.lit(LARGEST))).drop(place)


def _end(frame: DataFrame, n: int) -> DataFrame:
    """One row: the id of the first row after n, NULL if there are fewer. Only counts, a row a partition, are moved."""
    wanted = F.lit(n).cast("bigint")

    def passed(so_far: Column, one: Column) -> Column:
        here = so_far["end"].isNull() & (wanted - so_far["before"] <= one["rows"])
        end = F.when(here, F.shiftleft(one["part"], PLACE_BITS) + wanted - so_far["before"]).otherwise(so_far["end"])
        return F.struct((so_far["before"] + one["rows"]).alias("before"), end.alias("end"))

    counts = frame.select(F.shiftright(F.monotonically_increasing_id(), PLACE_BITS).alias("part")).groupBy("part").agg(F.count("*").alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("end"))
    return counts.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("part", "rows"))), start, passed)["end"].alias("end"))


def _steady(plan) -> bool:
    """Whether a plan, read twice in a query, has the same rows in the same partitions: RDDs, and files without buckets, projected and filtered."""
    kind = plan.getClass().getSimpleName()
    if kind in ("Project", "Filter", "SubqueryAlias"):
        return _steady(plan.child())
    if kind == "LogicalRDD":
        return True
    return kind == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().bucketSpec().isEmpty()


def _fixed(frame: DataFrame) -> DataFrame:
    """The same rows with their partitions settled; shuffles of the frame are run now, and once."""
    spark = frame.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(frame._jdf.queryExecution().toRdd(), frame._jdf.schema(), False), spark)

"""As-of look-ups without a window over a whole key.

Time is cut into buckets and buckets into spans. Within a bucket rows are ordered together; what
a bucket does not answer comes from the first value of the next bucket in its span, and
else from the first of a later span. So the largest group is a key's bucket: a key with very many
rows is dealt over its buckets, and only one value per span is ever held for a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Seconds in a bucket, buckets in a span.
BUCKET, SPAN = 86_400, 32


def next_value(points: DataFrame, seen: DataFrame, bucket: int = BUCKET, span: int = SPAN) -> DataFrame:
    """``(k, ts, value)`` for each distinct ``(k, ts)`` of ``seen``: the value of the key's first point at or after.

    ``points`` is ``(k, ts, value)``; of points at one moment the least value counts. Rows with a null
    key or time are left out; a moment without a later point has a null value.
    """
    number = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket * 1_000_000))
    known = "k IS NOT NULL AND ts IS NOT NULL"
    a = points.filter(known).groupBy("k", "ts").agg(F.min("value").alias("value")).select("k", "ts", number.alias("b"), "value", F.lit(True).alias("is_point"))
    q = seen.filter(known).select("k", "ts").distinct().select("k", "ts", number.alias("b"), F.lit(False).alias("is_point"))
    both = stored(a.unionByName(q, allowMissingColumns=True), "asof-rows")  # read for buckets, their firsts and spans
    # within a bucket: at equal times the point comes first
    inside = Window.partitionBy("k", "b").orderBy(F.desc("ts"), F.desc("is_point")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("value", ignorenulls=True).over(inside)).filter("NOT is_point").select("k", "ts", "b", "near")
    # one row for each bucket of a key, with its first value
    firsts = both.groupBy("k", "b").agg(F.min_by("value", F.when(F.col("is_point"), F.col("ts"))).alias("value"))
    firsts = firsts.withColumn("s", F.floor(F.col("b") / span))
    after = Window.partitionBy("k", "s").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    later = firsts.withColumn("within", F.last("value", ignorenulls=True).over(after)).select("k", "b", "s", "within")
    # a key's spans are few: its whole time over the length of a span
    spans = firsts.filter("value IS NOT NULL").groupBy("k", "s").agg(F.min_by("value", "b").alias("value"))
    listed = spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", "value"))).alias("spans"))
    beyond = F.get(F.filter("spans", lambda x: x.s > F.col("s")), F.lit(0))["value"]
    reach = later.join(listed, "k", "left").select("k", "b", F.coalesce("within", beyond).alias("later"))
    return near.join(reach, ["k", "b"]).select("k", "ts", F.coalesce("near", "later").alias("value"))

"""Choice of repetitions by their distortion bound on (a sample of) documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distortion_bound(counts: DataFrame, documents: int) -> DataFrame:
    """(rep, bound) = 2 - 2 min over buckets of the mean over documents of 1 / max(1, count).

    ``counts`` (id, rep, part, cnt) leaves absent buckets out; each counts as 1. A bucket that no document has would have mean 1,
    which is no less than any other, so it may be absent for all.
    """
    means = counts.groupBy("rep", "part").agg(((F.lit(documents) - F.count("*") + F.sum(1.0 / F.greatest("cnt", F.lit(1)))) / documents).alias("mean"))
    return means.groupBy("rep").agg((F.lit(2.0) - 2.0 * F.least(F.min("mean"), F.lit(1.0))).alias("bound"))


def keep_count(repetitions: int, rate: float) -> int:
    return max(1, int(repetitions * rate))


def ranked(bounds: DataFrame, keep: int | None = None) -> DataFrame:
    """(rep, bound, rep_pos): repetitions by bound, then number; the first ``keep``. One row a repetition, so one task is enough."""
    out = bounds.withColumn("rep_pos", F.row_number().over(Window.orderBy("bound", "rep")) - 1)
    return out if keep is None else out.filter(F.col("rep_pos") < keep)


def chosen(bounds: DataFrame, keep: int) -> list[int]:
    return [r.rep for r in ranked(bounds, keep).orderBy("rep_pos").collect()]

"""Intervals that hold points, met by classes of length instead of all pairs of an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holding(points: DataFrame, spans: DataFrame) -> DataFrame:
    """owner, uid, at, span, lo, hi: every interval of a point's owner with lo <= at <= hi.

    points: owner, uid, at; spans: owner, span, lo, hi (whole numbers). An interval of length from 2 ** k to below
    2 ** (k + 1) lies in at most three of the strips of width 2 ** k; a point looks into its strip of each class that
    its owner has. What it meets there is at most three times as long as near, so the work grows with points and
    results, not with an owner's pairs. Intervals that end before they begin hold nothing.
    """
    sized = spans.filter("hi >= lo").withColumn("width", F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")))).cast("long"))
    strips = F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor(F.col("hi") / F.col("width"))))
    laid = sized.select("owner", "width", strips.alias("strip"), "span", "lo", "hi")
    widths = sized.select("owner", "width").distinct()
    looks = points.join(widths, "owner").withColumn("strip", F.floor(F.col("at") / F.col("width")))
    return looks.join(laid, ["owner", "width", "strip"]).filter("lo <= at and at <= hi").select("owner", "uid", "at", "span", "lo", "hi")

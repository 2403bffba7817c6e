"""Line images from sampled words: line width, line shifts, pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_width(edges: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Median of the distances between consecutive sync edges (the lower one of two)."""
    gap = F.lead(position).over(Window.partitionBy(*keys).orderBy(position)) - F.col(position)
    return edges.withColumn("_gap", gap).where("_gap is not null").groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _gap)").cast("long").alias("line_width"))


def best_lag(series: DataFrame, keys: Sequence[str], row: str, a: str, b: str, most: int, least_overlap: int = 10) -> DataFrame:
    """Lag in -most..most at which the differences of ``b`` correlate best with those of ``a``: lag, overlap, correlation.

    ``row`` numbers the means of both columns. Lags of fewer than ``least_overlap`` common rows don't count.
    """
    w = Window.partitionBy(*keys).orderBy(row)
    steps = series.select(*keys, row, (F.col(a) - F.lag(a).over(w)).alias("da"), (F.col(b) - F.lag(b).over(w)).alias("db")).where("da is not null and db is not null")
    left = steps.select(*keys, F.col(row).alias("_row"), "da", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    left = left.withColumn("_row", F.col("_row") + F.col("lag"))
    right = steps.select(*keys, F.col(row).alias("_row"), "db")
    every = left.join(right, [*keys, "_row"]).groupBy(*keys, "lag").agg(F.count(F.lit(1)).alias("overlap"), F.corr("da", "db").alias("correlation"))
    ok = every.where((F.col("overlap") >= least_overlap) & F.col("correlation").isNotNull())
    best = F.max(F.struct("correlation", (-F.abs("lag")).alias("near"), "lag", "overlap")).alias("x")
    return ok.groupBy(*keys).agg(best).select(*keys, F.col("x.lag").alias("lag"), F.col("x.overlap").alias("overlap"), F.col("x.correlation").alias("correlation"))


def pixels(samples: DataFrame, keys: Sequence[str], width: int, channels: Sequence[str] = ("r", "g", "b"), gain: float = 1.0, shifts: Sequence[int] = (0, 0, 0), gamma: bool = True) -> DataFrame:
    """Line, column, 8-bit channels and luminance of samples numbered ``position`` with 16-bit channels.

    Channel k is taken ``shifts[k]`` lines later; pixels that lack a channel are left out. Gain, clip, square root (``gamma``), then 0.299/0.587/0.114.
    """
    placed = samples.withColumns({"line": F.floor(F.col("position") / width), "column": F.col("position") % width})

    def shown(name: str) -> Column:
        x = F.least(F.greatest(F.col(name) * gain / 65535.0, F.lit(0.0)), F.lit(1.0))
        return F.floor((F.sqrt(x) if gamma else x) * 255 + 0.5).cast("long")

    own = F.array(*(F.struct((F.col("line") - shift).alias("line"), F.lit(name).alias("channel"), shown(name).alias("x")) for name, shift in zip(channels, shifts, strict=True)))
    tall = placed.select(*keys, "column", F.inline(own).alias("line", "_channel", "_x"))
    picked = [F.max(F.when(F.col("_channel") == name, F.col("_x"))).alias(name) for name in channels]
    out = tall.groupBy(*keys, "line", "column").agg(*picked)
    for name in channels:
        out = out.where(F.col(name).isNotNull())
    r, g, b = (F.col(c) for c in channels)
    return out.withColumn("luminance", F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("long"))

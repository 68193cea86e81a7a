"""Relational rewrites that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, pos: str, start: str, end: str, on: list[str], width: int) -> DataFrame:
    """Pairs with start <= pos <= end and equal `on`: an equi-join on bins of the given width, then the exact test.

    A span is repeated once per bin it touches, a point stands in one bin, so no pair appears twice.
    """
    bins = F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))
    left = points.withColumn("__bin", F.floor(F.col(pos) / width).cast("long"))
    return left.join(spans.withColumn("__bin", F.explode(bins)), [*on, "__bin"]).where(F.col(pos).between(F.col(start), F.col(end))).drop("__bin")


def outside(points: DataFrame, spans: DataFrame, pos: str, start: str, end: str, on: list[str], width: int, held: bool = False) -> DataFrame:
    """The points that no span holds, or with `held` those that one does: a point stands in one bin, so that bin's spans decide."""
    bins = F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))
    p = points.withColumn("__bin", F.floor(F.col(pos) / width).cast("long")).alias("p")
    s = spans.select(*on, F.col(start).alias("__start"), F.col(end).alias("__end"), F.explode(bins).alias("__bin")).alias("s")
    same = F.col(pos).between(F.col("__start"), F.col("__end"))
    for c in [*on, "__bin"]:
        same = same & (F.col(f"p.{c}") == F.col(f"s.{c}"))
    return p.join(s, same, "left_semi" if held else "left_anti").drop("__bin")


def nearest_join(points: DataFrame, spans: DataFrame, pos: str, start: str, end: str, on: list[str], most: int, point_id: list[str], span_id: str) -> DataFrame:
    """For each point the nearest span edge within `most`, smallest span_id on ties: binned, so a point meets a few bins only."""
    width = most
    left = points.withColumn("__bin", F.floor(F.col(pos) / width).cast("long"))
    edges = spans.withColumn("__bin", F.explode(F.array_distinct(F.flatten(F.transform(F.array(start, end), lambda e: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: (F.floor(e / width) + k).cast("long")))))))
    distance = F.least(F.abs(F.col(start) - F.col(pos)), F.abs(F.col(end) - F.col(pos)))
    near = left.join(edges, [*on, "__bin"]).withColumn("distance", distance).where(F.col("distance") <= most)
    best = Window.partitionBy(*point_id).orderBy("distance", span_id)
    return near.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__bin")


def windows_of(pos: Column, size: int, step: int) -> Column:
    """Numbers k of the windows [1 + k * step, k * step + size] that hold a position."""
    return F.sequence(F.greatest(F.lit(0), F.ceil((pos - size) / step)).cast("long"), F.floor((pos - 1) / step).cast("long"))


def islands(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Merges overlapping or touching [start, end] spans of each group: columns start, end and members."""
    w = Window.partitionBy(*group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("members")).drop("__island")

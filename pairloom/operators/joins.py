"""Joins by nearness, order and set overlap. Each has an equality key, so none becomes a nested loop over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def endpoint_distance(b: Column, e: Column, s: Column, t: Column) -> Column:
    """Between block [b, e) and citation [s, t), from crossed ends."""
    return F.least(F.abs(s - e), F.abs(t - b))


def interval_distance(b: Column, e: Column, s: Column, t: Column) -> Column:
    """0 if they overlap."""
    return F.greatest(b - t, s - e, F.lit(0))


def nearest(left: DataFrame, right: DataFrame, key: str, distance: Column, order: list[str], left_id: list[str], k: int = 1) -> DataFrame:
    """The ``k`` rows of ``right`` nearest to each row of ``left`` with the same ``key``; ties by ``order``.

    Adds ``distance`` and ``rank``.
    """
    both = left.join(right, key).withColumn("distance", distance)
    w = Window.partitionBy(key, *left_id).orderBy("distance", *order)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _beside(left: DataFrame, right: DataFrame, key: str, at: str, place: str, order: list[str]) -> DataFrame:
    """``l, r``: each row of ``left`` with the last row of ``right`` at or before it and the first at or after it, by two
    sorts of both; of rows at one place the first by ``order``."""
    first = right.groupBy(key, F.col(place).alias("at")).agg(F.min(F.struct(*order, F.struct(*right.columns).alias("r"))).alias("x"))
    marks = first.select(key, "at", F.col("x.r").alias("r"), F.lit(0).alias("side"))
    both = left.select(key, F.col(at).alias("at"), F.struct(*left.columns).alias("l"), F.lit(1).alias("side")).unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(key).orderBy("at", F.desc("side")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("r", F.array(F.last("r", ignorenulls=True).over(before), F.first("r", ignorenulls=True).over(after))).where("side = 1")
    return found.select("l", F.explode(F.array_distinct(F.array_compact("r"))).alias("r"))


def nearest_span(left: DataFrame, right: DataFrame, key: str, ends: tuple[str, str], spans: tuple[str, str], order: list[str], left_id: str, crossed: bool) -> DataFrame:
    """The row of ``right`` nearest to each row of ``left`` with the same ``key``, with its ``distance``; ties by ``order``.

    The distance is that of crossed ends (``endpoint_distance``), or of the intervals (``interval_distance``), for which no
    span of a key may lie inside another, and ``order`` must begin with their start. No pairs are formed: the nearest one
    is beside an end in the order of ends.
    """
    (b, e), (s, t) = ends, spans
    found = _beside(left, right, key, b, t, order)
    if crossed:
        found = found.unionByName(_beside(left, right, key, e, s, order))
    rows = found.select("l.*", *(F.col("r")[c].alias(c) for c in right.columns if c != key))
    measure = endpoint_distance if crossed else interval_distance
    rows = rows.withColumn("distance", measure(F.col(b), F.col(e), F.col(s), F.col(t)))
    w = Window.partitionBy(key, left_id).orderBy("distance", *order)
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, order: list[str]) -> DataFrame:
    """Each row of ``left`` with the ``value`` of the last row of ``right`` at or before it, by one sort of both.

    ``at`` and ``order`` are columns of both; rows of ``right`` come first where they tie.
    """
    cols = left.columns
    rows = left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)})
    marks = right.select(key, at, *order, value).withColumn("__side", F.lit(0))
    w = Window.partitionBy(key).orderBy(at, *order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__side = 1").select(*cols, value)


def with_anchor(nearest_rows: DataFrame, right: DataFrame, key: str, start: str, keep: list[str]) -> DataFrame:
    """All rows of ``right`` that start where a nearest one does: citations that one anchor names together."""
    return nearest_rows.select(key, start, *keep).distinct().join(right, [key, start])


def uncovered(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points in none of the spans [start, end) of their key, by one sort of both: a point is covered if a span that
    starts at or before it ends after it."""
    cols = points.columns
    marks = spans.where(F.col(end) > F.col(start)).select(F.col(key), F.col(start).alias("__at"), F.col(end).alias("__end"), F.lit(0).alias("__side"))
    rows = points.withColumns({"__at": F.col(at), "__end": F.lit(None).cast(marks.schema["__end"].dataType), "__side": F.lit(1)})
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = rows.unionByName(marks, allowMissingColumns=True).withColumn("__reach", F.max("__end").over(w))
    return reach.where((F.col("__side") == 1) & ~F.coalesce(F.col("__reach") > F.col("__at"), F.lit(False))).select(cols)


def containment(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, least: float = 0.75) -> DataFrame:
    """Pairs whose overlap is at least that share of the smaller set; ``tokens`` are arrays of distinct values.

    An inverted join: tokens of ``left`` that no set of ``right`` has go first, and pairs are counted, never crossed.
    """
    small_left, small_right = (d.select(F.col(i).alias(n), tokens).where(F.size(tokens) > 0) for d, i, n in ((left, left_id, "l"), (right, right_id, "r")))
    inverted_r = small_right.select("r", F.size(tokens).alias("nr"), F.explode(tokens).alias("t"))
    known = inverted_r.select("t").distinct()
    inverted_l = small_left.select("l", F.size(tokens).alias("nl"), F.explode(tokens).alias("t")).join(known, "t", "left_semi")
    hits = inverted_l.join(inverted_r, "t").groupBy("l", "r").agg(F.count("*").alias("common"), F.first("nl").alias("nl"), F.first("nr").alias("nr"))
    return hits.where(F.col("common") >= least * F.least("nl", "nr")).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "common")

"""Interval joins: overlap, containment, nearest neighbours, exact and label lookups.

Interval tables have the columns of the store: id, div, low, high (closed, low <= high) and, where used, sign, type, label, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bin by default: near the longest usual interval, so that most intervals lie in one or two bins.
BIN = 64
#: Width of a bin of universal positions.
PLACE_BIN = 1 << 20


def _bins(low: Column, high: Column, size: int) -> Column:
    """Numbers of the bins that an interval touches; an interval of any length yields one row a bin."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def bin_width(intervals: DataFrame, share: float = 0.95) -> int:
    """A bin width fit for a table: the length that a share of its intervals stays within."""
    found = intervals.agg(F.percentile_approx(F.col("high") - F.col("low") + 1, share, 1000)).first()[0]
    return max(1, int(found or 1))


def overlap_join(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("div",), size: int = BIN, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Pairs of left and right rows whose closed intervals share a position and whose columns on are equal.

    The right columns come with the prefix r_. Both sides are spread over bins of size positions and joined on bin and keys, an equi-join
    that shuffles by a fine key; a pair is taken only in the bin where its overlap begins, so none comes twice and no distinct is needed.
    how is inner or left_semi (each left row once if it overlaps anything). condition may use both sides' columns.
    Null bounds or keys match nothing.
    """
    l = left.where(F.col("low") <= F.col("high"))
    l = l.withColumn("_row", F.monotonically_increasing_id()) if how == "left_semi" else l
    l = l.withColumn("_bin", F.explode(_bins(F.col("low"), F.col("high"), size)))
    r = right.where(F.col("low") <= F.col("high")).select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    r = r.withColumn("_rbin", F.explode(_bins(F.col("r_low"), F.col("r_high"), size)))
    test = F.col("_bin") == F.col("_rbin")
    for c in on:
        test = test & (F.col(c) == F.col(f"r_{c}"))
    test = test & (F.col("low") <= F.col("r_high")) & (F.col("r_low") <= F.col("high"))
    test = test & (F.col("_bin") == F.floor(F.greatest("low", "r_low") / size))
    if condition is not None:
        test = test & condition
    if how == "left_semi":  # the bin where an overlap begins is not the same for every partner, so a left row may come in several
        return l.join(r, test, "left_semi").dropDuplicates(["_row"]).drop("_bin", "_row")
    return l.join(r, test).drop("_bin", "_rbin")


def exact_join(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("div", "low", "high", "type")) -> DataFrame:
    """Pairs with equal bounds, and equal other columns named in on."""
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    test = F.lit(True)
    for c in on:
        test = test & (F.col(c) == F.col(f"r_{c}"))
    return left.join(r, test)


def first_overlap(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("div",), order: tuple[str, ...] = ("r_low", "r_high", "r_id"), key: str = "id", size: int = BIN) -> DataFrame:
    """One overlapping right row for each left row that has any: the first by order."""
    best = F.min(F.struct(*order, *(f"r_{c}" for c in right.columns if f"r_{c}" not in order)))
    return overlap_join(left, right, on, size).groupBy(key).agg(best.alias("x")).select(key, "x.*")


def neighbours(left: DataFrame, right: DataFrame, n: int = 1, side: str = "right", on: tuple[str, ...] = ("div",), key: str = "id", ring: int = 4096) -> DataFrame:
    """For each left row the n nearest right rows strictly beyond its end (side right, by low) or before its start (left, by high).

    Columns: key, r_*, rank from 1, nearest first; ties go by the lesser r_id. The right rows are cut into rings of positions. An as-of step over
    the occupied rings tells where a search starts; it meets n + 1 rings at most by an equi-join, however far its neighbours are. For
    dense tables choose a smaller ring.
    """
    at, to = ("r_low", "high") if side == "right" else ("r_high", "low")
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    sign = 1 if side == "right" else -1
    # positions mirrored for the left side, so that one direction remains: the least place beyond `edge`
    r = r.withColumn("_place", F.col(at) * sign).withColumn("_ring", F.floor(F.col("_place") / ring))
    l = left.withColumn("_edge", F.col(to) * sign).withColumn("_from", F.floor(F.col("_edge") / ring))
    rkeys = [f"r_{c}" for c in on]
    # occupied rings are numbered; each holds a row at least, so a search needs no more than its first occupied ring and n further ones
    rings = r.select(*rkeys, "_ring").distinct().withColumn("_number", F.row_number().over(Window.partitionBy(*rkeys).orderBy("_ring")))
    r = r.join(rings, [*rkeys, "_ring"])
    starts = (
        l.select(*on, F.col("_from").alias("_at"), F.lit(None).cast("int").alias("_occupied")).distinct()
        .union(rings.select(*rkeys, F.col("_ring").alias("_at"), F.col("_number").alias("_occupied")))
    )
    # from the far end on: Spark works a frame that grows out row by row, but one that shrinks anew for each row
    ahead = Window.partitionBy(*on).orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    starts = starts.withColumn("_start", F.min("_occupied").over(ahead)).where("_occupied IS NULL AND _start IS NOT NULL").select(*on, F.col("_at").alias("_from"), "_start")
    spread = l.join(starts, [*on, "_from"]).withColumn("_visit", F.explode(F.expr(f"sequence(_start, _start + {n})")))
    test = F.col("_visit") == F.col("_number")
    for c in on:
        test = test & (F.col(c) == F.col(f"r_{c}"))
    met = spread.join(r, test & (F.col("_place") > F.col("_edge")))
    order = Window.partitionBy(key).orderBy("_place", "r_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(key, *(f"r_{c}" for c in right.columns), "rank")


def locate(positions: DataFrame, chromosomes: DataFrame, position: str = "pos") -> DataFrame:
    """Adds chrom, chrnum and chrpos to universal positions (from 1). chromosomes: chrnum, chrom, offset, length, a row per sequence.

    A position beyond the last chromosome belongs to it, as to the left neighbour; one before the first to the first. Both sides meet in bins of
    universal positions, an equi-join whatever the number of sequences.
    """
    by = Window.orderBy("offset")  # one row a sequence
    ends = chromosomes.select("chrnum", "chrom", F.col("offset").cast("long").alias("offset")).withColumn("_end", F.lead("offset").over(by)).withColumn("_first", F.row_number().over(by) == 1)
    test = ((F.col(position) > F.col("offset")) | F.col("_first")) & (F.col("_end").isNull() | (F.col(position) <= F.col("_end")))
    top = F.coalesce("_end", F.col("offset"))
    spread = ends.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("offset") + 1) / PLACE_BIN), F.floor(F.greatest(top, F.col("offset") + 1) / PLACE_BIN))))
    last = ends.agg(F.max("offset"), F.min("offset")).first()
    if last[0] is None:
        return positions.limit(0).crossJoin(chromosomes.select("chrnum", "chrom").limit(0)).withColumn("chrpos", F.col(position))
    held = F.least(F.greatest(F.col(position), F.lit(last[1] + 1)), F.lit(last[0] + 1))
    met = positions.withColumn("_pbin", F.floor(held / PLACE_BIN)).join(spread, (F.col("_bin") == F.col("_pbin")) & test).drop("_bin", "_pbin")
    return met.withColumn("chrpos", F.col(position) - F.col("offset")).drop("offset", "_end", "_first")


def endpoints(intervals: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Distinct highs of the intervals that start at low, or distinct lows of those that end at high, by div."""
    if low is not None:
        return intervals.where(F.col("low") == low).select("div", F.col("high").alias("position")).distinct()
    return intervals.where(F.col("high") == high).select("div", F.col("low").alias("position")).distinct()


def by_type(intervals: DataFrame, types: list[str]) -> DataFrame:
    """Intervals of any of the types; an unknown type matches nothing."""
    return intervals.where(F.col("type").isin(types))


def by_sign(intervals: DataFrame, sign: int) -> DataFrame:
    return intervals if sign == 0 else intervals.where(F.col("sign") == sign)


def by_value(intervals: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Intervals with a value from least to most; those without a value (null or NaN) never match."""
    if least is not None and most is not None and least > most:
        raise ValueError(f"least {least} is above most {most}")
    value, test = F.col("value"), ~F.isnan("value") & F.col("value").isNotNull()
    test = test if least is None else test & (value >= least)
    return intervals.where(test if most is None else test & (value <= most))


def intersect_ids(one: DataFrame, two: DataFrame, key: str = "id") -> DataFrame:
    """Ids in both: those of a place query and of a value query."""
    return one.select(key).intersect(two.select(key))

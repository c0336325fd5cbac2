"""Depth, tallies and change points along a coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depth_runs(intervals: DataFrame, closed: bool = False, weight: str | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(div, start, end, depth): runs of equal depth from position 1 to the last change, by div, or to the div's end where lengths (div, length) are given.

    An interval adds its weight (1) at low and takes it off at high, so that its last position does not count (nor does a point), unless
    closed. Points without a net change make no break; runs of no length are left out. Changes are summed by position before the
    window, so what a window holds is one row for each distinct end of a div.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    ends = F.explode(F.array(F.struct(F.col("low").alias("pos"), w.alias("d")), F.struct((F.col("high") + int(closed)).alias("pos"), (-w).alias("d")))).alias("x")
    changes = intervals.select("div", ends).groupBy("div", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d")).where("d <> 0")
    by = Window.partitionBy("div").orderBy("pos")
    runs = changes.select("div", F.col("pos").alias("start"), (F.lead("pos").over(by) - 1).alias("end"), F.sum("d").over(by).alias("depth"))
    if lengths is not None:  # the last run, of depth 0, to the end of the div
        runs = runs.join(lengths.select("div", "length"), "div", "left").withColumn("end", F.coalesce("end", F.when(F.col("start") <= F.col("length"), F.col("length")))).drop("length")
    lead_in = changes.groupBy("div").agg(F.min("pos").alias("first")).select("div", F.lit(1).cast("long").alias("start"), (F.col("first") - 1).alias("end"), F.lit(0).cast("long").alias("depth"))
    return runs.where("end IS NOT NULL").union(lead_in.where("end >= 1"))


def tally_rows(stores: DataFrame) -> DataFrame:
    """(id, div, position, count): a row per position of stores whose annotation has a line of counts for each position."""
    lines = stores.select("id", "div", "low", F.posexplode(F.split("annotation", "\n")).alias("at", "line"))
    return lines.select("id", "div", (F.col("low") + F.col("at")).alias("position"), line_total(F.col("line")).alias("count"))


def line_total(line) -> F.Column:
    """The sum of the whole numbers of a line."""
    return F.aggregate(F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def running_before(rows: DataFrame, order: str | tuple[str, ...] = "position", value: str = "count", by: tuple[str, ...] = ("div",)) -> DataFrame:
    """The rows with the total of those before each, as the tally listing prints it, beside the row's own value; several columns of order settle ties."""
    before = Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("running_before", F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def tally_statistics(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(div, counts, width, mean) of the positions from low to high."""
    chosen = rows.where(F.col("position").between(low, high)).groupBy("div").agg(F.sum("count").cast("long").alias("counts"))
    return chosen.withColumn("width", F.lit(high - low + 1).cast("long")).withColumn("mean", F.col("counts") / F.col("width"))


def geometric_mean(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(div, mean): exp of the mean of ln(count + 1), less 1; positions without a row count 0."""
    chosen = rows.where(F.col("position").between(low, high)).groupBy("div").agg(F.sum(F.log1p("count")).alias("s"))
    return chosen.select("div", (F.exp(F.col("s") / (high - low + 1)) - 1).alias("mean"))


def run_length_positions(runs: DataFrame) -> DataFrame:
    """(div, position, count): every position of runs whose label is their depth."""
    return runs.select("div", F.explode(F.sequence("low", "high")).alias("position"), F.col("label").cast("long").alias("count"))


def zero_fill(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Every position from low to high of each div, with 0 where rows has none."""
    spine = rows.select("div").distinct().select("div", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("position"))
    return spine.join(rows.select("div", "position", "count"), ["div", "position"], "left").select("div", "position", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def extents(intervals: DataFrame) -> DataFrame:
    """(div, n, coordinates, before): intervals of each div, the coordinate after its last, and the intervals of the divs before it by name."""
    counted = intervals.groupBy("div").agg(F.count("*").alias("n"), (F.max("high") + 1).alias("coordinates"))
    earlier = Window.orderBy("div").rowsBetween(Window.unboundedPreceding, -1)  # one row a div
    return counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long"))


def change_points(rows: DataFrame, side: str = "left", pseudo: float = 12.0, slack: float = 0.1, by: str = "div", order: str = "position", hits: str = "hits", total: str = "total") -> DataFrame:
    """(by, edge, hits, total): where each series splits into a better part and a worse one at its left (or right) end, by the Chow test.

    hits of total trials are given at each place. Counted from the far end, a part is what lies at and beyond a place and the rest is the end that is worse: its rate, smoothed
    by pseudo trials at the rate of the whole series, must be lower by more than slack. Of these splits the one of the least squared error counts,
    the first met of equal ones, if it is below that of the whole; edge is its place, and hits and total those of the worse end. Without any edge is null and
    both counts are 0. The place at the end itself is never split off.
    """
    left, w = side == "left", Window.partitionBy(by)
    so_far = w.orderBy(F.desc(order) if left else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("_x", F.sum(hits).over(w)).withColumn("_n", F.sum(total).over(w)).withColumn("_end", F.min(order).over(w))
    x = x.where(F.col(order) > F.col("_end"))  # on either side the first place stays with the end that is judged
    x = x.withColumn("_a", F.sum(hits).over(so_far)).withColumn("_m", F.sum(total).over(so_far))
    rate = F.col("_x") / F.col("_n")

    def part(a: F.Column, m: F.Column) -> tuple[F.Column, F.Column]:
        theta = (a + pseudo * rate) / (m + pseudo)
        return theta, a * (1 - theta) * (1 - theta) + (m - a) * theta * theta

    a, m = F.col("_x") - F.col("_a"), F.col("_n") - F.col("_m")
    (past, rss_past), (future, rss_future) = part(F.col("_a"), F.col("_m")), part(a, m)
    error = rss_past + rss_future
    split = (error > 0) & (future < past - slack) & (error < F.col("_x") * (F.col("_n") - F.col("_x")) / F.col("_n"))
    best = x.where(split).groupBy(by).agg(F.min(F.struct(error.alias("error"), (-F.col(order) if left else F.col(order)).alias("first"), F.col(order).alias("edge"), a.alias("hits"), m.alias("total"))).alias("b"))
    found = rows.select(by).distinct().join(best, by, "left")
    return found.select(by, F.col("b.edge").alias("edge"), F.coalesce("b.hits", F.lit(0)).alias("hits"), F.coalesce("b.total", F.lit(0)).alias("total"))


def islands(rows: DataFrame, gap: int, by: tuple[str, ...] = ("div",), position: str = "position") -> DataFrame:
    """The rows with a number for each run in which neighbours are less than gap apart, from 1 in each group."""
    w = Window.partitionBy(*by).orderBy(position)
    new = F.coalesce(F.col(position) - F.lag(position).over(w) >= gap, F.lit(True))
    return rows.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def union_length(intervals: DataFrame, by: tuple[str, ...] = ("div",)) -> DataFrame:
    """(by, covered): positions that any interval covers."""
    w = Window.partitionBy(*by).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("high") - F.greatest(F.col("low") - 1, F.coalesce(F.max("high").over(w), F.col("low") - 1))
    return intervals.withColumn("_new", F.greatest(fresh, F.lit(0))).groupBy(*by).agg(F.sum("_new").cast("long").alias("covered"))

"""Filters, pairings and summaries of alignments, regions and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BIN, overlap_join


def boundary_counts(intervals: DataFrame) -> DataFrame:
    """(div, position, starts, ends): how many intervals start and end at each position where any does."""
    ends = F.explode(F.array(F.struct(F.col("low").alias("position"), F.lit(1).alias("s")), F.struct(F.col("high").alias("position"), F.lit(0).alias("s")))).alias("x")
    rows = intervals.select("div", ends).select("div", "x.position", "x.s")
    return rows.groupBy("div", "position").agg(F.sum("s").cast("long").alias("starts"), F.sum(1 - F.col("s")).cast("long").alias("ends"))


def evidence(alignments: DataFrame, tallies: DataFrame, key: str = "id", size: int = BIN) -> DataFrame:
    """(key, support): what a tally store (div, position, count) adds up to within each alignment (key, div, low, high); 0 without any."""
    points = tallies.select("div", F.col("position").alias("low"), F.col("position").alias("high"), "count")
    found = overlap_join(alignments.select(key, "div", "low", "high"), points, size=size).groupBy(key).agg(F.sum("r_count").cast("long").alias("support"))
    return alignments.select(key).join(found, key, "left").select(key, F.coalesce("support", F.lit(0)).alias("support"))


def exception_counts(rows: DataFrame, excluded: tuple[str, ...] = (), column: str = "exception") -> DataFrame:
    """(exception, n, excluded): rows of each exception, and whether it is one that is left out."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).select(F.col(column).alias("exception"), "n", F.col(column).isin(list(excluded)).alias("excluded"))


def within(rows: DataFrame, div: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows of one chromosome, or of a range of it: those that lie in it as a whole."""
    test = F.col("div") == div
    test = test if low is None else test & (F.col("low") >= low)
    return rows.where(test if high is None else test & (F.col("high") <= high))


def passing(rows: DataFrame, least_coverage: float = 0.0, least_identity: float = 0.0) -> DataFrame:
    """Alignments whose coverage and identity (columns, shares of 1) reach both bounds; one without a figure does not pass."""
    return rows.where((F.col("coverage") >= least_coverage) & (F.col("identity") >= least_identity))


def well_covered(regions: DataFrame, least: float = 0.1, share: float = 0.25, by: str = "read") -> DataFrame:
    """Regions (read, n_covered, length) worth an alignment: none of a read if the best covers under least of its length, else those that cover more than
    share of what the best does."""
    best = F.max("n_covered").over(Window.partitionBy(by))
    return regions.withColumn("_best", best).where((F.col("_best") >= least * F.col("length")) & (F.col("n_covered") > share * F.col("_best"))).drop("_best")


def pair_matches(five: DataFrame, three: DataFrame, most: int, on: tuple[str, ...] = ("read", "chrom", "strand"), size: int | None = None) -> DataFrame:
    """Pairs (on, pos5, pos3, qpos5, qpos3, span) of matches near the two ends of a read on one strand, in the order of the query, whose span is at most most.

    On the minus strand the 3' match lies below the 5' one. A band join: both sides are spread over bins of the span and meet by an equi-join.
    """
    size = size or max(1, most)
    away = F.when(F.col("strand") == "-", -F.col("pos")).otherwise(F.col("pos"))  # places along the read's own direction
    a = five.select(*on, F.col("pos").alias("pos5"), F.col("qpos").alias("qpos5"), away.alias("_a")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_a") + most) / size))))
    b = three.select(*on, F.col("pos").alias("pos3"), F.col("qpos").alias("qpos3"), away.alias("_b")).withColumn("_bin", F.floor(F.col("_b") / size))
    span = F.col("_b") - F.col("_a")
    met = a.join(b, [*on, "_bin"]).where((span >= 0) & (span <= most) & (F.col("qpos3") >= F.col("qpos5")))
    return met.withColumn("span", span).drop("_bin", "_a", "_b")


def promiscuity_cut(pairs: DataFrame, most: int = 4, key: tuple[str, ...] = ("read", "chrom", "strand", "pos5", "qpos5"), order: tuple[str, ...] = ("span", "pos3", "qpos3")) -> DataFrame:
    """The first most pairings of each match, by span."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def pair_splice_sites(donors: DataFrame, acceptors: DataFrame, most: int, size: int | None = None) -> DataFrame:
    """(chrom, strand, donor, acceptor, length): donors with the acceptors that lie within most positions behind them, on the strand that is read."""
    size = size or max(1, most)
    away = F.when(F.col("strand") == "-", -F.col("pos")).otherwise(F.col("pos"))
    d = donors.select("chrom", "strand", F.col("pos").alias("donor"), away.alias("_d")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_d") / size), F.floor((F.col("_d") + most) / size))))
    a = acceptors.select("chrom", "strand", F.col("pos").alias("acceptor"), away.alias("_a")).withColumn("_bin", F.floor(F.col("_a") / size))
    length = F.col("_a") - F.col("_d")
    return d.join(a, ["chrom", "strand", "_bin"]).where((length > 0) & (length <= most)).withColumn("length", length).drop("_bin", "_d", "_a")


def reads_over_sites(reads: DataFrame, sites: DataFrame, size: int = BIN) -> DataFrame:
    """Reads (id, div, low, high) with a known splice site (div, position) in their range; each once."""
    points = sites.select("div", F.col("position").alias("low"), F.col("position").alias("high")).distinct()
    return overlap_join(reads, points, size=size, how="left_semi")


def cross_table(chromosomes: DataFrame, divs: DataFrame) -> DataFrame:
    """(chrnum, chrom, divno): the number of the div of another store (divno, div) that has a chromosome's name; -1 without one."""
    found = chromosomes.join(divs.select("divno", F.col("div").alias("chrom")), "chrom", "left")
    return found.select("chrnum", "chrom", F.coalesce("divno", F.lit(-1)).alias("divno"))


def gene_overlap(alignments: DataFrame, exons: DataFrame, key: str = "id", size: int = BIN) -> DataFrame:
    """(key, gene_class): none, known, or known_multiexon where the exons of one gene that an alignment overlaps are two or more. exons: gene, div, low, high."""
    met = overlap_join(alignments, exons, size=size).groupBy(key, "r_gene").agg(F.count_distinct("r_low", "r_high").alias("n"))
    best = met.groupBy(key).agg(F.max("n").alias("n"))
    return alignments.select(key).join(best, key, "left").select(key, F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "known_multiexon").otherwise("known").alias("gene_class"))


def merged_positions(*lists: DataFrame) -> DataFrame:
    """(kmer, position) of any of the lists, equal places once: a reference and a variant index, or the lists of each substitution."""
    out = lists[0].select("kmer", "position")
    for other in lists[1:]:
        out = out.union(other.select("kmer", "position"))
    return out.distinct()


def monotone_bounds(regions: DataFrame, by: tuple[str, ...], order: str, low: str = "low", high: str = "high") -> DataFrame:
    """Adds floor and ceiling: the greatest low of a region up to each, and the least high from each on, along the order of the query."""
    w = Window.partitionBy(*by).orderBy(order)
    floor = F.max(low).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return regions.withColumn("floor", floor).withColumn("ceiling", F.min(high).over(w.rowsBetween(0, Window.unboundedFollowing)))


def segment_counts(exons: DataFrame, by: str = "transcript") -> DataFrame:
    """(by, segments): exons of each, with those that touch or overlap counted as one."""
    w = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(w) + 1, F.lit(True))
    return exons.withColumn("_new", new.cast("long")).groupBy(by).agg(F.sum("_new").alias("segments"))


def trim_bounds(seq: Column, noise: str = "N") -> Column:
    """A struct (trim_start from 0, trim_end): what is left of a sequence without a run of unknown bases at either end."""
    kept = F.regexp_replace(seq, f"^[{noise}{noise.lower()}]+", "")
    start = F.length(seq) - F.length(kept)
    return F.struct(start.alias("trim_start"), (start + F.length(F.regexp_replace(kept, f"[{noise}{noise.lower()}]+$", ""))).alias("trim_end"))


def clip_overlap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """A struct (overlap, clip1, clip2) of two mates that face each other: the positions both cover, shared out to be clipped from their inner ends."""
    both = F.greatest(F.least(high1, high2) - F.greatest(low1, low2) + 1, F.lit(0))
    return F.struct(both.alias("overlap"), F.floor(both / 2).alias("clip1"), (both - F.floor(both / 2)).alias("clip2"))


def fai_lines(chromosomes: DataFrame) -> DataFrame:
    """(chrnum, line): name and length of each sequence, tab-separated."""
    return chromosomes.select("chrnum", F.concat_ws("\t", "chrom", F.col("length").cast("string")).alias("line"))

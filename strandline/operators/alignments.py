"""Ranking, mapping quality, typing, sorting and duplicate marking of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import FLAGS, has_flag, leading_softclip, reference_length, trailing_softclip


def mapping_quality(hits: DataFrame, by: str = "read", matches: str = "matches", mism: str = "mism") -> DataFrame:
    """Adds absmq, mapq and xq: a softmax over the scores of a read's hits.

    The score is matches - 10 mismatches. mapq is 40 where the chance of another hit is below 1e-4, else -10 log10 of
    it, rounded; xq is the score less the best one plus 40, at least 0.
    """
    w = Window.partitionBy(by)
    score = (F.col(matches) - 10 * F.col(mism)).cast("double")
    x = hits.withColumn("absmq", score).withColumn("_best", F.max("absmq").over(w))
    x = x.withColumn("_p", F.exp(F.col("absmq") - F.col("_best")))  # scores are taken from the best one, so that nothing underflows
    q = 1 - F.col("_p") / F.sum("_p").over(w)
    mapq = F.when(q < 1e-4, 40).otherwise(F.round(-10 * F.log10(q)).cast("int"))
    return x.withColumn("mapq", mapq).withColumn("xq", F.greatest(F.col("absmq") - F.col("_best") + 40, F.lit(0.0)).cast("int")).drop("_best", "_p")


def score_band(hits: DataFrame, band: float, by: str = "read", score: str = "score", lower_is_better: bool = True) -> DataFrame:
    """Hits whose score lies within band of their read's best."""
    w = Window.partitionBy(by)
    if lower_is_better:
        return hits.withColumn("_b", F.min(score).over(w)).where(F.col(score) <= F.col("_b") + band).drop("_b")
    return hits.withColumn("_b", F.max(score).over(w)).where(F.col(score) >= F.col("_b") - band).drop("_b")


def ranked(hits: DataFrame, order: list[Column], by: str = "read", n: int | None = None) -> DataFrame:
    """Adds rank (from 1); keeps the first n. Spark limits each task to n rows a group before the shuffle."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if n is None else out.where(F.col("rank") <= n)


def path_order() -> list[Column]:
    """The order of the paths of a long query."""
    return [F.col("chimera_right"), F.col("chimera_left"), F.desc("goodness"), F.desc("npairs"), F.desc("matches"), F.col("strain"), F.col("genomic_length"), F.col("chrnum"), F.col("start")]


def shuffled_ties(seed: int, *keys: str) -> Column:
    """A sort key that breaks ties as if by chance, the same on every run."""
    return F.xxhash64(*keys, F.lit(seed))


def suppress_excess(hits: DataFrame, most: int, quiet: bool = True, by: str = "read") -> DataFrame:
    """Reads with more hits than most: no hit of theirs if quiet, else the first most; excess marks them."""
    w = Window.partitionBy(by)
    out = hits.withColumn("excess", F.count("*").over(w) > most)
    return out.where(~F.col("excess")) if quiet else out.withColumn("_r", F.row_number().over(w.orderBy("rank"))).where(F.col("_r") <= most).drop("_r")


def result_type(n1: Column, n2: Column, pair: Column, translocation: Column) -> Column:
    """One of the result types of a pair of reads, from its numbers of hits, its pair type (null if unpaired) and whether a hit joins chromosomes."""
    return (
        F.when(pair == "concordant", F.when(translocation, "concordant_transloc").when(F.greatest(n1, n2) > 1, "concordant_mult").otherwise("concordant_uniq"))
        .when(pair.isin("inversion", "scramble", "toolong"), F.when(F.greatest(n1, n2) > 1, F.lit("paired_mult")).otherwise(F.concat(F.lit("paired_uniq_"), pair)))
        .when((n1 == 0) & (n2 == 0), "nomapping")
        .when((n1 == 0) | (n2 == 0), F.when(F.greatest(n1, n2) > 1, "halfmapping_mult").when(translocation, "halfmapping_transloc").otherwise("halfmapping_uniq"))
        .when((n1 == 1) & (n2 == 1), F.when(translocation, "unpaired_transloc").otherwise("unpaired_uniq"))
        .otherwise("unpaired_mult")
    )


def single_result_type(n: Column, translocation: Column) -> Column:
    return F.when(n == 0, "nomapping").when(n > 1, "single_mult").when(translocation, "single_transloc").otherwise("single_uniq")


# The two-letter codes of the output files.
CODES = {
    "nomapping": "NM", "concordant_uniq": "CU", "concordant_transloc": "CT", "concordant_mult": "CM", "paired_uniq_inversion": "PI", "paired_uniq_scramble": "PS",
    "paired_uniq_toolong": "PL", "paired_mult": "PM", "halfmapping_uniq": "HU", "halfmapping_transloc": "HT", "halfmapping_mult": "HM", "unpaired_uniq": "UU",
    "unpaired_transloc": "UT", "unpaired_mult": "UM", "single_uniq": "UU", "single_transloc": "UT", "single_mult": "UM",
}


def output_code(kind: Column, excess: Column | None = None) -> Column:
    """The output code of a result type; reads with too many hits have the code's first letter and X."""
    table = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    code = F.try_element_at(table, kind)
    return code if excess is None else F.when(excess, F.concat(F.substring(code, 1, 1), F.lit("X"))).otherwise(code)


def pair_type(chrom1: Column, chrom2: Column, low1: Column, high1: Column, plus1: Column, low2: Column, high2: Column, plus2: Column, most: int = 1000) -> Column:
    """concordant, inversion, scramble, toolong or null: how two mates lie to each other.

    On one chromosome: mates that face each other with an insert of 1 to most are concordant, with a longer one toolong; mates
    whose order is the other way round are a scramble; on the same strand, an inversion. Null on different chromosomes.
    """
    insert = F.when(plus1, high2 - low1 + 1).otherwise(high1 - low2 + 1)
    return (
        F.when(chrom1.isNull() | chrom2.isNull() | (chrom1 != chrom2), F.lit(None).cast("string"))
        .when(plus1 == plus2, "inversion")
        .when(insert <= 0, "scramble")
        .when(insert > most, "toolong")
        .otherwise("concordant")
    )


def sort_sam(sam: DataFrame, chromosomes: DataFrame, secondary: str = "orig") -> DataFrame:
    """SAM rows by universal position, unmapped ones last; then by orig (input order), accession, mate-fwd or mate-rev (mate's position).

    chromosomes (chrom, offset) is a row per sequence and is joined by name; rows of unknown sequences count as unmapped.
    """
    placed = _placed(sam, chromosomes)
    second = {"orig": [F.col("ord")], "accession": [F.col("qname"), F.col("ord")], "mate-fwd": [F.col("mate_gpos"), F.col("ord")], "mate-rev": [F.desc("mate_gpos"), F.col("ord")]}[secondary]
    return placed.orderBy(F.col("gpos") == 0, "gpos", *second)


def _placed(sam: DataFrame, chromosomes: DataFrame) -> DataFrame:
    c = chromosomes.select("chrom", "offset")
    own = sam.join(c.select(F.col("chrom").alias("rname"), F.col("offset").alias("_o")), "rname", "left")
    mate = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    both = own.withColumn("_mate", mate).join(c.select(F.col("chrom").alias("_mate"), F.col("offset").alias("_mo")), "_mate", "left")
    gpos = F.when(has_flag(F.col("flag"), "unmapped") | F.col("_o").isNull() | (F.col("pos") == 0), F.lit(0).cast("long")).otherwise(F.col("_o") + F.col("pos"))
    return both.withColumn("gpos", gpos).withColumn("mate_gpos", F.coalesce(F.col("_mo") + F.col("pnext"), F.lit(0)).cast("long")).drop("_o", "_mo", "_mate")


def extended_position(sam: DataFrame) -> DataFrame:
    """Adds ext_pos: where the read would begin without its soft clip; on the reverse strand where it would end."""
    reverse = has_flag(F.col("flag"), "reverse")
    low = F.col("gpos") - leading_softclip(F.col("cigar"))
    high = F.col("gpos") + reference_length(F.col("cigar")) - 1 + trailing_softclip(F.col("cigar"))
    return sam.withColumn("ext_pos", F.when(F.col("gpos") == 0, F.lit(0).cast("long")).when(reverse, high).otherwise(low))


def mark_duplicates(sam: DataFrame, chromosomes: DataFrame, mark_first: bool = False) -> DataFrame:
    """The rows with duplicate, and the duplicate bit in flag. sam: ord, qname, flag, rname, pos, cigar, rnext, pnext, seq.

    Reads are equal if their primary ends begin at the same extended places on the same strands and their sequences agree, in the order of the
    places; reads without a mapped end, if their sequences do. Of equal reads the one that comes first in the input is no
    duplicate, unless mark_first. A read is all rows of one qname. Rows are grouped by read, so that a place that very many reads share is
    resolved from one row each, by two hashes of the key that shuffle no sequence.
    """
    primary = (F.col("flag").bitwiseAND(F.lit(FLAGS["secondary"])) == 0)
    placed = extended_position(_placed(sam, chromosomes))
    end = F.struct("ext_pos", has_flag(F.col("flag"), "reverse").alias("reverse"), F.xxhash64("seq").alias("seq"), F.xxhash64(F.lit(1), "seq").alias("seq2"))
    reads = placed.where(primary).groupBy("qname").agg(F.min("ord").alias("first"), F.sort_array(F.collect_list(end)).alias("ends"))
    mapped = F.exists("ends", lambda x: x["ext_pos"] > 0)
    what = F.when(mapped, F.col("ends")).otherwise(F.array_sort(F.transform("ends", lambda x: F.struct(F.lit(0).cast("long").alias("ext_pos"), F.lit(False).alias("reverse"), x["seq"].alias("seq"), x["seq2"].alias("seq2")))))
    # two hashes of different seeds: 128 bits tell the keys of any number of reads apart
    reads = reads.withColumn("_key", F.struct(mapped.alias("mapped"), F.xxhash64(what).alias("one"), F.xxhash64(F.lit(2), what).alias("two")))
    groups = reads.groupBy("_key").agg(F.min("first").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = reads.join(groups, "_key").where(F.lit(True) if mark_first else F.col("first") > F.col("_first")).select("qname", F.lit(True).alias("duplicate"))
    out = sam.join(again, "qname", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    return out.withColumn("flag", F.when(F.col("duplicate"), F.col("flag").bitwiseOR(F.lit(FLAGS["duplicate"]))).otherwise(F.col("flag"))).select(*sam.columns, "duplicate")


def read_indexes(rows: DataFrame, order: str = "ord", name: str = "qname") -> DataFrame:
    """Adds read: the place of the first row of each name, so that all rows of a name share one index wherever they stand."""
    return rows.withColumn("read", F.min(order).over(Window.partitionBy(name)))


def mates(sam: DataFrame) -> DataFrame:
    """Each primary row of end 1 with its mate's row (columns m_*), null without one."""
    primary = sam.where(~has_flag(F.col("flag"), "secondary"))
    second = primary.where(has_flag(F.col("flag"), "second")).select(*(F.col(c).alias(f"m_{c}") for c in sam.columns))
    return primary.where(~has_flag(F.col("flag"), "second")).join(second, F.col("qname") == F.col("m_qname"), "left")

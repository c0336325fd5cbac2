"""Building a reference: sequence tables, chunks of sequence, range fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coordinates import chromosome_key
from ..functions.sequence import reverse_complement

#: Characters of a chunk of sequence.
CHUNK = 1 << 16


def chromosome_table(lengths: DataFrame, order: str = "input") -> DataFrame:
    """(chrnum from 1, chrom, offset, length, circular) from rows (ord, chrom, length and, if there, circular): one row per sequence.

    order is input (by ord), alpha, numeric_alpha (numbers first) or chrom (numbers, X and Y, M, others). A circular sequence takes up
    twice its length.
    """
    rows = lengths if "circular" in lengths.columns else lengths.withColumn("circular", F.lit(False))
    key = chromosome_key(F.col("chrom"))
    by = {"input": [F.col("ord")], "alpha": [F.col("chrom")], "numeric_alpha": [F.when(key["number"] > 0, 0).otherwise(1), key["number"], F.col("chrom")], "chrom": [key]}[order]
    w = Window.orderBy(*by)  # one row a sequence
    span = F.col("length") * F.when(F.col("circular"), 2).otherwise(1)
    before = F.coalesce(F.sum(span).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.select(F.row_number().over(w).alias("chrnum"), "chrom", before.alias("offset"), F.col("length").cast("long").alias("length"), "circular")


def assign_contigs(contigs: DataFrame) -> DataFrame:
    """(contig, chrom, start, end) for FASTA records (ord, acc, rest, length): where each lies.

    The place comes from the header where it names one (chr:a..b, chromosome N, chr=N); contigs without a range follow
    each other in input order on their chromosome; one without a chromosome is its own. Of repeated names the first counts.
    """
    first = Window.partitionBy("acc").orderBy("ord")
    rows = contigs.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    header = F.coalesce("rest", F.lit(""))
    spot = [F.regexp_extract(header, r"(?:^|\s)(?:chr=)?([\w.]+):(\d+)\.\.(\d+)", i) for i in (1, 2, 3)]
    named = F.coalesce(F.nullif(F.regexp_extract(header, r"(?i)chromosome\s+([\w.]+)", 1), F.lit("")), F.nullif(F.regexp_extract(header, r"chr=([\w.]+)(?!\S*:)", 1), F.lit("")))
    chrom = F.when(spot[0] != "", spot[0]).otherwise(F.coalesce(named, F.col("acc")))
    rows = rows.withColumn("chrom", chrom).withColumn("_a", F.nullif(spot[1], F.lit("")).cast("long")).withColumn("_b", F.nullif(spot[2], F.lit("")).cast("long"))
    before = Window.partitionBy("chrom").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(F.when(F.col("_a").isNull(), F.col("length"))).over(before), F.lit(0)) + 1
    start = F.coalesce("_a", running).cast("long")
    return rows.select(F.col("acc").alias("contig"), "chrom", start.alias("start"), F.coalesce(F.col("_b"), start + F.col("length") - 1).cast("long").alias("end"))


def chunks(sequences: DataFrame, size: int = CHUNK, key: str = "chrom") -> DataFrame:
    """(chrom, chunk, seq): pieces of size characters, so that no row grows with a chromosome once they are written."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / size).cast("int")), lambda i: F.struct(i.alias("chunk"), F.substring("seq", i * size + 1, F.lit(size)).alias("part")))
    return sequences.select(F.col(key).alias("chrom"), F.explode(parts).alias("x")).select("chrom", "x.chunk", F.col("x.part").alias("seq"))


def fetch(ranges: DataFrame, pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """Ranges (id, chrom, low, high, sign) with their sequence seq; reverse ranges (sign -1) are reverse-complemented. Unknown places give null."""
    wanted = ranges.select("id", "chrom", "low", "high", "sign", F.explode(F.sequence(F.floor((F.col("low") - 1) / size).cast("int"), F.floor((F.col("high") - 1) / size).cast("int"))).alias("chunk"))
    got = wanted.join(pieces.withColumnRenamed("seq", "_part"), ["chrom", "chunk"])
    joined = got.groupBy("id", "chrom", "low", "high", "sign").agg(F.sort_array(F.collect_list(F.struct("chunk", "_part"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["_part"]), "")
    piece = F.substring(whole, F.col("low") - F.element_at("p", 1)["chunk"] * size, F.col("high") - F.col("low") + 1)
    seq = joined.select("id", F.when(F.length(piece) == F.col("high") - F.col("low") + 1, F.when(F.col("sign") < 0, reverse_complement(piece)).otherwise(piece)).alias("seq"))
    return ranges.join(seq, "id", "left")


def spliced(exons: DataFrame, pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """(transcript, seq): the joined exons of each transcript, reverse-complemented as a whole on the minus strand. exons: transcript, chrom, strand, start, end."""
    ranges = exons.select(F.concat_ws(":", "transcript", F.col("start").cast("string")).alias("id"), "transcript", "strand", "chrom", F.col("start").alias("low"), F.col("end").alias("high"), F.lit(1).alias("sign"))
    got = fetch(ranges, pieces, size).groupBy("transcript", "strand").agg(F.sort_array(F.collect_list(F.struct("low", "seq"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda e: e["seq"]), "")
    return got.select("transcript", F.when(F.col("strand") == "-", reverse_complement(whole)).otherwise(whole).alias("seq"))

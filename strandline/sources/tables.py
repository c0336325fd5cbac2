"""Annotation tables: GFF3, GTF, gene predictions, variants, and the maps made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_GFF = ["seqid", "source", "feature", "start", "end", "score", "strand", "phase", "attributes"]


def _tabbed(spark: SparkSession, path: str | list[str], names: list[str], least: int) -> DataFrame:
    """Tab-separated lines without comments and blank ones; rows of fewer than least columns are passed over, missing last ones are null."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = lines.select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("p")).where(F.size("p") >= least)
    return parts.select(*(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), '^"|"$', "")


def read_gff3(spark: SparkSession, path: str | list[str], label: str = "ID") -> DataFrame:
    """(label, div, low, high, sign, type, annotation, attributes): a row per feature.

    sign is -1 on the minus strand. A row without the label's attribute is named by gff. and its line's hash. The annotation is
    the row itself.
    """
    rows = _tabbed(spark, path, _GFF, 8)
    pairs = F.filter(F.split(F.coalesce("attributes", F.lit("")), ";"), lambda x: F.instr(x, "=") > 0)
    attrs = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("key"), _plain(F.split(x, "=", 2)[1]).alias("value")))))
    line = F.concat_ws("\t", *_GFF)
    return rows.select(
        F.coalesce(F.try_element_at(attrs, F.lit(label)), F.concat(F.lit("gff."), F.hex(F.xxhash64(line)))).alias("label"), F.col("seqid").alias("div"), F.col("start").cast("long").alias("low"), F.col("end").cast("long").alias("high"),
        F.when(F.col("strand") == "-", -1).when(F.col("start") == F.col("end"), 0).otherwise(1).alias("sign"), F.col("feature").alias("type"), line.alias("annotation"), attrs.alias("attributes"),
    )


def gff3_exons(features: DataFrame) -> DataFrame:
    """(transcript, gene, chrom, strand, start, end) of a read_gff3() table: exons by parent, with the parent's gene."""
    a = F.col("attributes")
    parents = features.where(F.col("type").isin("mRNA", "transcript")).select(F.col("label").alias("transcript"), F.try_element_at(a, F.lit("Parent")).alias("gene"))
    exons = features.where(F.col("type") == "exon").select(F.explode(F.split(F.try_element_at(a, F.lit("Parent")), ",")).alias("transcript"), F.col("div").alias("chrom"), F.when(F.col("sign") < 0, "-").otherwise("+").alias("strand"), F.col("low").alias("start"), F.col("high").alias("end"))
    return exons.join(parents, "transcript", "left").select("transcript", F.coalesce("gene", "transcript").alias("gene"), "chrom", "strand", "start", "end")


def read_gtf_exons(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(transcript, gene, chrom, strand, start, end) of the exon rows of GTF files."""
    rows = _tabbed(spark, path, _GFF, 9).where(F.col("feature") == "exon")
    named = [F.regexp_extract("attributes", rf'{k} "([^"]*)"', 1).alias(n) for k, n in (("transcript_id", "transcript"), ("gene_id", "gene"))]
    return rows.select(*named, F.col("seqid").alias("chrom"), "strand", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def read_gene_predictions(spark: SparkSession, path: str | list[str], skip: int = 0) -> DataFrame:
    """(transcript, gene, chrom, strand, start, end) of genePred tables: starts count from 0; rows whose lists disagree with their exon count are passed over."""
    names = ["name", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "n", "starts", "ends", "score", "gene"]
    rows = _tabbed(spark, path, [f"skipped{i}" for i in range(skip)] + names, skip + 10)
    starts, ends = (F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: x.cast("long")) for c in ("starts", "ends"))
    rows = rows.withColumn("s", starts).withColumn("e", ends).where((F.size("s") == F.col("n").cast("int")) & (F.size("e") == F.size("s")))
    return rows.select("name", "gene", "chrom", "strand", F.explode(F.arrays_zip("s", "e")).alias("x")).select(F.col("name").alias("transcript"), F.coalesce("gene", "name").alias("gene"), "chrom", "strand", (F.col("x.s") + 1).alias("start"), F.col("x.e").alias("end"))


def splice_sites(exons: DataFrame) -> DataFrame:
    """(label, chrom, pos1, pos2, kind, dist): a donor and an acceptor row for each intron; the two positions lie to either side of the border.

    dist is the intron's length. Columns as the splice-site map has them: pos1 is the side that is read first.
    """
    return _site_rows(introns(exons))


def introns(exons: DataFrame) -> DataFrame:
    """(label, transcript, chrom, strand, number, n, donor, acceptor, length): gaps between a transcript's exons, numbered as they are read."""
    w = Window.partitionBy("transcript").orderBy("start")  # the exons of a transcript
    x = exons.withColumn("next", F.lead("start").over(w)).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("transcript")) - 1)
    x = x.where(F.col("next") > F.col("end") + 1)
    minus = F.col("strand") == "-"
    number = F.when(minus, F.col("n") - F.col("i") + 1).otherwise(F.col("i"))
    return x.select(
        F.concat("transcript", F.lit(".intron"), number.cast("string"), F.lit("/"), F.col("n").cast("string")).alias("label"), "transcript", "chrom", "strand", number.cast("int").alias("number"), F.col("n").cast("int").alias("n"),
        F.when(minus, F.col("next")).otherwise(F.col("end")).alias("donor"), F.when(minus, F.col("end")).otherwise(F.col("next")).alias("acceptor"), (F.col("next") - F.col("end") - 1).alias("length"),
    )


def _site_rows(gaps: DataFrame) -> DataFrame:
    step = F.when(F.col("strand") == "-", -1).otherwise(1)
    sites = F.explode(F.array(
        F.struct(F.lit("donor").alias("kind"), F.col("donor").alias("pos1"), (F.col("donor") + step).alias("pos2"), F.col("number").alias("exon")),
        F.struct(F.lit("acceptor").alias("kind"), (F.col("acceptor") - step).alias("pos1"), F.col("acceptor").alias("pos2"), (F.col("number") + 1).alias("exon")),
    )).alias("s")
    rows = gaps.select("transcript", "chrom", "n", "length", sites)
    return rows.select(F.concat("transcript", F.lit(".exon"), F.col("s.exon").cast("string"), F.lit("/"), (F.col("n") + 1).cast("string")).alias("label"), "chrom", "s.pos1", "s.pos2", "s.kind", F.col("length").alias("dist"))


def read_vcf_snps(spark: SparkSession, path: str | list[str], most_build: int | None = None) -> DataFrame:
    """(rsid, chrom, pos, alleles): rows of one base against another.

    A row of a later dbSNP build than most_build goes; validated rows (VLD) and those of a submitter's own study (SLO) stay; of the rest, those with
    genotypes not observed (GNO) go. alleles are in alphabetical order.
    """
    rows = _tabbed(spark, path, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"], 5)
    return vcf_rules(rows, most_build)


def vcf_rules(rows: DataFrame, most_build: int | None = None) -> DataFrame:
    info = F.concat(F.lit(";"), F.coalesce("info", F.lit("")), F.lit(";"))
    build = F.regexp_extract(info, r";dbSNPBuildID=(\d+)", 1).try_cast("int")
    has = {k: F.instr(info, f";{k};") > 0 for k in ("VLD", "SLO", "GNO")}
    keep = F.when(build > most_build if most_build is not None else F.lit(False), False).when(has["VLD"] | has["SLO"], True).when(has["GNO"], False).otherwise(True)
    one = F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & (F.col("ref") != F.col("alt"))
    return rows.where(one & keep).select(F.col("id").alias("rsid"), "chrom", F.col("pos").cast("long").alias("pos"), F.concat(F.least("ref", "alt"), F.greatest("ref", "alt")).alias("alleles"))


def read_gvf_snps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rsid, chrom, pos, alleles) of the SNV rows on the plus or no strand that name an rsid in Dbxref."""
    rows = _tabbed(spark, path, _GFF, 9).where((F.col("feature") == "SNV") & F.col("strand").isin("+", "="))
    rsid, ref, alt = (F.regexp_extract("attributes", p, 1) for p in (r"Dbxref=[^;]*?(rs\d+)", r"Reference_seq=([ACGT])(?:;|$)", r"Variant_seq=(?:[ACGT],)?([ACGT])(?:,[ACGT])?(?:;|$)"))
    found = rows.select(rsid.alias("rsid"), F.col("seqid").alias("chrom"), F.col("start").cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt")).where("rsid <> '' AND ref <> '' AND alt <> '' AND ref <> alt")
    return found.select("rsid", "chrom", "pos", F.concat(F.least("ref", "alt"), F.greatest("ref", "alt")).alias("alleles"))


def dbsnp_rules(rows: DataFrame, exceptions: DataFrame | None = None, weight: int = 1, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Single-base rows (rsid, chrom, pos, observed, class, weight) of at most that weight, without those whose exception is excluded."""
    kept = rows.where((F.col("class") == "single") & (F.col("weight") <= weight))
    if exceptions is not None:
        bad = exceptions.where(F.col("exception").isin(list(excluded))) if excluded else exceptions
        kept = kept.join(bad.select("rsid").distinct(), "rsid", "left_anti")
    alleles = F.split("observed", "/")
    return kept.where(F.size(alleles) == 2).select("rsid", "chrom", "pos", F.array_join(F.array_sort(alleles), "").alias("alleles"))


def gene_map(exons: DataFrame) -> DataFrame:
    """(transcript, record): the text record of a transcript: its range, gene and a line per exon; the minus strand reads from its end."""
    minus = F.col("strand") == "-"
    pair = F.struct(F.when(minus, F.col("end")).otherwise(F.col("start")).alias("a"), F.when(minus, F.col("start")).otherwise(F.col("end")).alias("b"))
    x = exons.groupBy("transcript", "gene", "chrom", "strand").agg(F.sort_array(F.collect_list(pair)).alias("e"))
    x = x.withColumn("e", F.when(minus, F.reverse("e")).otherwise(F.col("e")))
    lines = F.array_join(F.transform("e", lambda p: F.concat(p["a"].cast("string"), F.lit(" "), p["b"].cast("string"))), "\n")
    place = F.concat(F.lit(">"), "transcript", F.lit(" "), "chrom", F.lit(":"), F.element_at("e", 1)["a"].cast("string"), F.lit(".."), F.element_at("e", -1)["b"].cast("string"))
    return x.select("transcript", F.concat_ws("\n", place, "gene", lines).alias("record"))

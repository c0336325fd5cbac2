"""Readers and writers on small files made here."""

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F
from strandline.sources import sam, tables, text

INTERVALS = """>A 10000..20000 FWD
first annotation
>B chr1:30,000..20,000 REV /value=2.5
note one
note two
>C 30000..40000
"""


def put(path, data):
    path.write_text(data)
    return str(path)


def test_intervals_round_trip(spark, tmp_path):
    rows = text.read_intervals(spark, put(tmp_path / "a.txt", INTERVALS)).orderBy("label").collect()
    assert [(r.label, r.div, r.low, r.high, r.sign, r.type, r.value) for r in rows] == [("A", "", 10000, 20000, 1, "FWD", None), ("B", "chr1", 20000, 30000, -1, "REV", 2.5), ("C", "", 30000, 40000, 1, None, None)]
    assert [r.annotation for r in rows] == ["first annotation", "note one\nnote two", ""]
    store = text.read_intervals(spark, str(tmp_path / "a.txt"))
    at = store.where("low <= 20000 AND high >= 20000").orderBy("label")
    assert [r.label for r in at.collect()] == ["A", "B"]
    text.read_intervals(spark, str(tmp_path / "a.txt")).select(text.interval_text().alias("value")).coalesce(1).write.text(str(tmp_path / "out"))
    again = text.read_intervals(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, store.collect()), key=repr)
    named = text.read_intervals(spark, str(tmp_path / "a.txt"), ["one", "two"]).where("label = 'B'").first()
    assert named.fields == {"one": "note one", "two": "note two"}


def test_store(spark, tmp_path):
    store = text.read_intervals(spark, put(tmp_path / "a.txt", INTERVALS))
    text.write_store(store, str(tmp_path / "store"))
    assert text.read_store(spark, str(tmp_path / "store")).count() == 3
    one = text.read_store(spark, str(tmp_path / "store"), "chr1")
    assert [r.label for r in one.collect()] == ["B"] and "PartitionFilters: [isnotnull(div" in one._jdf.queryExecution().toString()


def test_spaced_intervals(spark, tmp_path):
    r = text.read_spaced_intervals(spark, put(tmp_path / "s", ">x 9 3 chr1 T\nnote\n>y 4 8\n")).orderBy("label").collect()
    assert [(x.label, x.div, x.low, x.high, x.sign, x.type, x.annotation) for x in r] == [("x", "chr1", 3, 9, -1, "T", "note"), ("y", "", 4, 8, 1, None, "")]


def test_fasta_and_compression(spark, tmp_path):
    body = ">one first record\nACGT\nAC GT\n\n>two\nTT1TT\n>three\n"
    put(tmp_path / "a.fa", body)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "c.fa.bz2").write_bytes(bz2.compress(body.encode()))
    for name in ("a.fa", "b.fa.gz", "c.fa.bz2"):
        got = {r.acc: (r.rest, r.seq) for r in text.read_fasta(spark, str(tmp_path / name)).collect()}
        assert got == {"one": ("first record", "ACGTACGT"), "two": (None, "TTTT"), "three": (None, "")}
    lines = text.read_fasta(spark, str(tmp_path / "a.fa")).select(text.fasta_text(F.col("acc"), F.col("seq"), F.col("rest"), 5).alias("v")).collect()
    assert sorted(r.v for r in lines) == [">one first record\nACGTA\nCGT", ">three", ">two\nTTTT"]


def test_read_fasta(spark, tmp_path):
    got = {r.acc: (r.seq1, r.seq2, r.qual1, r.qual2) for r in text.read_read_fasta(spark, put(tmp_path / "r", ">a\nACGT\n>b x\nAC\nGT\n>c\nAC\nGT\n+\nII\nJJ\n>d\nA\n+\nI\n")).collect()}
    assert got == {"a": ("ACGT", None, None, None), "b": ("AC", "GT", None, None), "c": ("AC", "GT", "II", "JJ"), "d": ("A", None, "I", None)}


@pytest.mark.parametrize("block", [137, 1_000, 10_000_000])
def test_fastq_in_blocks(spark, tmp_path, block):
    rng = random.Random(5)
    reads = []
    for i in range(120):
        n = rng.randrange(1, 40)
        reads.append((f"r{i}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+I!5", k=n)), i % 7 == 0))
    for end in (1, 2):
        put(tmp_path / f"{end}.fq", "".join(f"@{a}/{end} {end}:{'Y' if f else 'N'}:0:X\n{s}\n+\n{q}\n" for a, s, q, f in reads))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        one, two = (text.read_fastq(spark, str(tmp_path / f"{end}.fq")) for end in (1, 2))
        assert [(r.ordinal, r.acc, r.seq, r.qual, r.filtered) for r in one.orderBy("ordinal").collect()] == [(i, *r) for i, r in enumerate(reads)]
        pairs = text.pair_fastq(one, two)
        assert pairs.count() == 120 and text.chastity_filter(pairs, "either").count() == 120 - 18 and text.part(one, 1, 4).count() == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_paired_names_must_agree(spark, tmp_path):
    a, b = (text.read_fastq(spark, put(tmp_path / n, f"@{n}\nA\n+\nI\n")) for n in ("x", "y"))
    with pytest.raises(Exception, match="names differ"):
        text.pair_fastq(a, b).collect()
    assert text.pair_fastq(a, b, allow_name_mismatch=True).count() == 1


GFF = "##gff-version 3\nc1\tx\tmRNA\t101\t500\t.\t-\t.\tID=t1;Parent=g1\nc1\tx\texon\t101\t200\t.\t-\t.\tParent=t1\nc1\tx\texon\t401\t500\t.\t-\t.\tParent=t1\n\nc1\tx\tgene\t7\t7\t.\t+\t.\nbad\tline\n"
GTF = 'c1\tx\texon\t401\t500\t.\t-\t.\tgene_id "g1"; transcript_id "t1";\nc1\tx\texon\t101\t200\t.\t-\t.\tgene_id "g1"; transcript_id "t1";\nc1\tx\tCDS\t101\t150\t.\t-\t.\tgene_id "g1"; transcript_id "t1";\n'
PSL = "1\tt1\tc1\t-\t100\t500\t100\t500\t2\t100,400,\t200,500,\t0\tg1\n1\tbad\tc1\t-\t0\t9\t0\t9\t3\t0,\t9,\t0\tg\n"
EXONS = {("t1", "g1", "c1", "-", 101, 200), ("t1", "g1", "c1", "-", 401, 500)}


def test_gene_models(spark, tmp_path):
    features = tables.read_gff3(spark, put(tmp_path / "a.gff3", GFF))
    assert features.count() == 4 and features.where("label LIKE 'gff.%'").count() == 3
    assert [(r.low, r.high, r.sign, r.type) for r in features.where("label = 't1'").collect()] == [(101, 500, -1, "mRNA")]
    made = [tables.gff3_exons(features), tables.read_gtf_exons(spark, put(tmp_path / "a.gtf", GTF)), tables.read_gene_predictions(spark, put(tmp_path / "a.psl", PSL), 1)]
    for exons in made:
        assert {tuple(r) for r in exons.collect()} == EXONS
    gaps = tables.introns(made[0]).collect()
    assert [(r.label, r.donor, r.acceptor, r.length) for r in gaps] == [("t1.intron1/1", 401, 200, 200)]
    sites = {(r.label, r.pos1, r.pos2, r.kind, r.dist) for r in tables.splice_sites(made[1]).collect()}
    assert sites == {("t1.exon1/2", 401, 400, "donor", 200), ("t1.exon2/2", 201, 200, "acceptor", 200)}
    assert [r.record for r in tables.gene_map(made[2]).collect()] == [">t1 c1:500..101\ng1\n500 401\n200 101"]


def test_variants(spark, tmp_path):
    head = "##fileformat\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    rows = [("1", 5, "a", "G", "A", "VLD;GNO"), ("1", 6, "b", "A", "T", "GNO"), ("1", 7, "c", "A", "T", "X"), ("1", 8, "d", "AT", "T", "VLD"), ("1", 9, "e", "A", "C", "SLO;dbSNPBuildID=140"), ("1", 10, "f", "C", "C", "VLD")]
    path = put(tmp_path / "a.vcf", head + "".join(f"{c}\t{p}\t{i}\t{r}\t{a}\t.\t.\t{n}\n" for c, p, i, r, a, n in rows))
    assert {(r.rsid, r.alleles) for r in tables.read_vcf_snps(spark, path).collect()} == {("a", "AG"), ("c", "AT"), ("e", "AC")}
    assert {r.rsid for r in tables.read_vcf_snps(spark, path, 135).collect()} == {"a", "c"}
    gvf = put(tmp_path / "a.gvf", "c1\tx\tSNV\t5\t5\t.\t+\t.\tDbxref=dbSNP:rs7;Reference_seq=T;Variant_seq=C\nc1\tx\tSNV\t6\t6\t.\t-\t.\tDbxref=dbSNP:rs8;Reference_seq=T;Variant_seq=C\nc1\tx\tindel\t7\t7\t.\t+\t.\tDbxref=dbSNP:rs9\n")
    assert [tuple(r) for r in tables.read_gvf_snps(spark, gvf).collect()] == [("rs7", "c1", 5, "CT")]
    db = spark.createDataFrame([("r1", "c", 1, "T/A", "single", 1), ("r2", "c", 2, "A/C", "single", 3), ("r3", "c", 3, "A/C", "in-del", 1), ("r4", "c", 4, "A/G", "single", 1)], "rsid string, chrom string, pos long, observed string, class string, weight int")
    bad = spark.createDataFrame([("r4", "MultipleAlignments")], "rsid string, exception string")
    assert [tuple(r) for r in tables.dbsnp_rules(db, bad, 1, ("MultipleAlignments",)).collect()] == [("r1", "c", 1, "AT")]
    assert tables.dbsnp_rules(db, bad, 3, ("Other",)).count() == 3


def test_sam(spark, tmp_path):
    body = "@HD\tVN:1.0\n@SQ\tSN:c1\tLN:9\nr1\t0\tc1\t5\t40\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tXO:Z:UU\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tXO:Z:NM\n"
    rows = sam.read_sam(spark, put(tmp_path / "a.sam", body))
    got = rows.orderBy("ord").collect()
    assert [(r.qname, r.flag, r.pos, r.tags["XO"]) for r in got] == [("r1", 0, 5, "UU"), ("r2", 4, 0, "NM")] and sam.read_sam_header(spark, str(tmp_path / "a.sam")).count() == 2
    assert [r.v for r in rows.orderBy("ord").select(sam.sam_line().alias("v")).collect()] == body.splitlines()[2:]
    sam.write_split(rows.withColumn("xo", F.col("tags")["XO"]), str(tmp_path / "split"))
    assert spark.read.text(str(tmp_path / "split/xo=NM")).count() == 1
    failed = rows.selectExpr("tags['XO'] AS xo", "qname AS acc", "seq", "qual")
    assert [r.value for r in sam.failed_reads(failed).collect()] == ["@r2\nAC\n+\nII"]
    chroms = spark.createDataFrame([(1, "c1", 9, True)], "chrnum int, chrom string, length long, circular boolean")
    assert sam.sam_header(chroms, "coordinate", {"ID": "g"}) == ["@HD\tVN:1.0\tSO:coordinate", "@SQ\tSN:c1\tLN:9\ttp:circular", "@RG\tID:g"]


def test_other_formats(spark):
    row = spark.sql("SELECT 'q' acc, 'c1' chrom, 0.975D identity, 40L length, 1L mism, 1L qstart, 40L qend, 5L gstart, 44L gend, 1e-9D evalue, 60.25D bits, 39L matches, '+' strand, 50L qlength, 900L clength, array(named_struct('qstart', 0L, 'gstart', 4L, 'length', 20L), named_struct('qstart', 20L, 'gstart', 124L, 'length', 20L)) blocks, 't' transcript, 'g' gene, array(named_struct('start', 5L, 'end', 24L), named_struct('start', 125L, 'end', 144L)) exons")
    m8, psl, gff = row.select(sam.m8_line(), sam.psl_line(), sam.gff3_lines()).first()
    assert m8.split("\t")[2] == "97.5" and len(m8.split("\t")) == 12
    assert psl.split("\t") == "39 1 0 0 0 0 1 100 + q 50 0 40 c1 900 4 144 2 20,20, 0,20, 4,124,".split()
    assert [x.split("\t")[2] for x in gff.splitlines()[:-1]] == ["gene", "mRNA", "exon", "exon"] and gff.endswith("###")
    pairs = spark.createDataFrame([("q", 1, 10, "A-CG", "ATC-")], "acc string, qstart int, gstart int, query string, genome string")
    assert [tuple(r) for r in sam.coordinate_rows(pairs).collect()] == [("q", 1, "A", 10, "A"), ("q", None, "-", 11, "T"), ("q", 2, "C", 12, "C"), ("q", 3, "G", None, "-")]

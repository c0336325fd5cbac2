"""Column functions on values that are easy to check by hand."""

import random

import pytest
from pyspark.sql import functions as F
from strandline.functions import alignment as al
from strandline.functions import coordinates as co
from strandline.functions import sequence as sq


@pytest.fixture(scope="module")
def value(spark):
    """Evaluate a column over literals."""

    def run(column, **literals):
        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items())) if literals else spark.range(1)
        return row.select(column.alias("x")).first().x

    return run


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("ACGTNRYacgtn", k=rng.randrange(0, 30))),) for _ in range(50)] + [(None,), ("",)]
    for r in spark.createDataFrame(rows, "s string").select("s", sq.reverse_complement(sq.reverse_complement(F.col("s"))).alias("t")).collect():
        assert r.s == r.t


def test_sequences(value):
    s = F.col("s")
    assert value(sq.reverse_complement(s), s="ACGTRn") == "nYACGT"
    assert value(sq.normalise(s), s="acgu") == "ACGT"
    assert value(sq.subsequence(s, F.lit(1), F.lit(3), False), s="AACGG") == "CGT"
    assert value(sq.subsequence(s, F.lit(3), F.lit(3)), s="AACGG") is None
    assert value(sq.kmer_code(s), s="ACGT") == 27 and value(sq.kmer_code(s), s="ACNT") is None
    assert value(sq.kmer_text(F.lit(27), 4)) == "ACGT"
    assert [tuple(x) for x in value(sq.kmers(s, 3), s="ACGNTTT")] == [(0, "ACG"), (4, "TTT")]
    assert value(sq.kmers(s, 3), s="AC") is None
    assert value(sq.reduce_bases(s, "cmet"), s="ACGT") == "ATGT" and value(sq.reduce_bases(s, "cmet", False), s="ACGT") == "ACAT"
    assert value(sq.bad_characters(s), s="ACNX") == 2
    assert value(sq.wrap(s, 2), s="ACGTA") == "AC\nGT\nA"


def test_proteins(value):
    s = F.col("s")
    assert [value(sq.amino_acid(s), s=c) for c in ("ATG", "TAA", "CTN", "aug", "TTY", "NNN", "AT")] == ["M", "*", "L", "M", "F", "X", "X"]
    assert value(sq.translate(s), s="ATGAAATAGC") == "MK*" and value(sq.translate(s, 1), s="AATGA") == "M" and value(sq.translate(s), s="AT") == ""
    assert tuple(value(sq.longest_orf(s, True), s="CCATGAAACCCTAGATG")) == (2, 2, "MKP*")
    assert value(sq.longest_orf(s, True), s="CCC") is None


def test_mismatches(value):
    a, b = F.col("a"), F.col("b")
    assert value(sq.mismatch_positions(a, b), a="ACGT", b="AGGA") == [1, 3]
    assert value(sq.mismatches(a, b, "cmet"), a="ATGT", b="ACGT") == 0
    assert value(sq.mark_mismatches(a, b), a="ACGT", b="AGGA") == "AcGt"
    assert [value(sq.intron_class(a, b), a=x, b=y) for x, y in (("GT", "AG"), ("CT", "AC"), ("AT", "AC"), ("GT", "AT"), ("GG", "AG"))] == ["GT-AG_fwd", "GT-AG_rev", "AT-AC_fwd", "AT-AC_rev", "none"]


def test_ranges(value):
    read = lambda t: value(co.parse_range(F.col("t")), t=t)
    assert tuple(read("chr1:1,000..2,000")) == ("chr1", 1000, 2000, 1) and tuple(read("2000..1000")) == ("", 1000, 2000, -1)
    assert tuple(read("X:5+10")) == ("X", 5, 14, 1) and tuple(read("X:50+-10")) == ("X", 41, 50, -1) and tuple(read("7")) == ("", 7, 7, 0) and tuple(read("3--9")) == ("", 3, 9, 1)
    assert read("label") is None and read(None) is None
    assert value(co.fold_circular(F.lit(101), F.lit(100))) == 1 and value(co.fold_circular(F.lit(0), F.lit(100))) == 100


def test_chromosome_order(spark):
    names = ["chr2", "chr10", "X", "chrM", "1q", "NT_01", "MT", "Y", "012"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(co.chromosome_key(F.col("n"))).collect()]
    assert got == ["chr2", "chr10", "X", "Y", "chrM", "MT", "1q", "012", "NT_01"]


def test_cigars(value):
    c = F.col("c")
    assert value(al.cigar_length(c), c="5H3S10M2I4D1N6M") == 26 and value(al.reference_length(c), c="3S10M2I4D100N6M") == 120
    assert value(al.leading_softclip(c), c="5H3S10M") == 3 and value(al.trailing_softclip(c), c="10M4S2H") == 4 and value(al.leading_softclip(c), c="10M") == 0
    ops = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(o).alias("op")) for n, o in ((3, "M"), (0, "I"), (4, "M"), (2, "D"))))
    assert value(al.cigar_of(ops)) == "7M2D"
    a, b = F.col("a"), F.col("b")
    assert value(al.md_string(a, b), a="ACGTACGT", b="ACCTACGT") == "2C5" and value(al.md_string(a, b), a="AC--GT", b="ACTTGA") == "2^TT1A0" and value(al.md_string(a, b), a="ACGG", b="AC-G") == "3"
    assert value(al.cigar_check(c, F.lit(9), "drop"), c="10M") is None
    with pytest.raises(Exception, match="CIGAR"):
        value(al.cigar_check(c, F.lit(9), "abort"), c="10M")


def test_flags_and_scores(value):
    assert value(al.sam_flag(paired=F.lit(True), reverse=F.lit(True), secondary=F.lit(None).cast("boolean"))) == 17
    assert value(al.log_likelihood(F.array(F.lit(40), F.lit(60)))) == pytest.approx(2 * -10.30895, abs=1e-4)
    assert value(al.shift_quality(F.col("q"), 31), q="!I") == "@h"
    assert value(al.identity(F.lit(0), F.lit(0), F.lit(0))) == 1.0
    assert value(al.bit_score(F.lit(50), F.lit(2))) == pytest.approx((1.58 * 46 + 2.302585) / 0.693147, abs=1e-3)
    assert [value(al.sufficient_splice_probability(F.lit(n), F.lit(1))) for n in (16, 17, 23, 29)] == [0.95, 0.90, 0.85, 0.70]

"""Plans whose cost must follow the input."""

import pytest
from pyspark.sql import functions as F
from strandline.functions import sequence as sq
from strandline.operators import kmers
from strandline.plans import library

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return library.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("name", ["iv_flank_right", "iv_flank_left", "iv_flank_signed"])
def test_flanks_have_no_shrinking_frame(spark, name):
    """A frame up to the last row is worked out anew for each row, a cost of the square of a partition."""
    assert "unboundedfollowing" not in plan(spark, name).replace(" ", "")


def test_orf_is_one_pass(spark):
    """Every frame part was looked for in its protein, and a codon was compared with each entry of a literal map."""
    assert "arrowevalpython" in plan(spark, "orf") and "regexp_extract_all" not in plan(spark, "orf").split("arrowevalpython")[0]


def test_orf_letters(spark):
    """Either case, U, codes of several bases, ties, and no sequence."""
    rows = [("augaaYtag",), ("ATGNNNRAYATG",), ("TAGATGAAATAGATGCCCTAG",), ("éATGAAA",), (None,), ("",), ("CC",)]
    got = [tuple(r.x) if r.x else None for r in spark.createDataFrame(rows, "s string").select(sq.longest_orf(F.col("s")).alias("x")).collect()]
    assert got == [(0, 0, "MN*"), (0, 0, "MXXM"), (2, 2, "DEIDAL"), (0, 0, "XE"), None, None, None]


def test_no_window_is_shuffled(spark):
    assert "kmer" not in plan(spark, "kmer_repeated")


def test_repeat_counts(spark):
    """As repeated_kmers(), also for a key of several sequences, no key, other letters and nothing to count."""
    rows = [(1, "ACGTACGTAC"), (1, "GTACNACG"), (2, "AC"), (3, None), (None, "AAAAA"), (4, "ACGTT")]
    frame = spark.createDataFrame(rows, "id long, seq string")
    got = {r.id: (r.repeated, r.total) for r in kmers.repeat_counts(frame, 3).collect()}
    assert got == {1: (11, 11), None: (3, 3), 4: (0, 3)}

"""CIGAR and MD strings, SAM flags, qualities and alignment scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import reverse_complement

_OPERATION = r"(\d+)([MIDNSHP=X])"


def cigar_operations(cigar: Column) -> Column:
    """An array of structs (n, op)."""
    n, op = (F.regexp_extract_all(cigar, F.lit(_OPERATION), F.lit(i)) for i in (1, 2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("op")))


def cigar_length(cigar: Column, counted: str = "SMIH=X") -> Column:
    """The sum over the operations counted: by default the length of the read, with what was clipped."""
    chosen = F.filter(cigar_operations(cigar), lambda x: F.instr(F.lit(counted), x["op"]) > 0)
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda s, x: s + x["n"])


def reference_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MDN=X")


def leading_softclip(cigar: Column) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1).try_cast("long"), F.lit(0).cast("long"))


def trailing_softclip(cigar: Column) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1).try_cast("long"), F.lit(0).cast("long"))


def cigar_check(cigar: Column, query_length: Column, action: str = "ignore") -> Column:
    """The CIGAR string; where it does not cover the query: as it is (ignore), null (drop), or an error (abort)."""
    right = (cigar == "*") | (cigar_length(cigar) == query_length)
    if action == "abort":
        return F.when(right, cigar).otherwise(F.raise_error(F.concat(F.lit("CIGAR does not cover the query: "), cigar)))
    return F.when(right, cigar) if action == "drop" else cigar


def cigar_of(operations: Column) -> Column:
    """CIGAR text of an array of structs (n, op): neighbours with one operation are joined, empty ones left out."""
    kind = "array<struct<n:bigint,op:string>>"
    steps = F.filter(operations, lambda x: x["n"] > 0)

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct((last["n"] + x["n"]).alias("n"), x["op"].alias("op"))))
        return F.when((F.size(out) > 0) & (last["op"] == x["op"]), joined).otherwise(F.concat(out, F.array(F.struct(x["n"].cast("long").alias("n"), x["op"].alias("op")))))

    folded = F.aggregate(steps, F.array().cast(kind), lambda out, x: add(out, x).cast(kind))
    return F.array_join(F.transform(folded, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def md_string(query: Column, genome: Column) -> Column:
    """The MD text of two aligned sequences of one length; a gap in the query (-) is a deletion, one in the genome an insertion."""
    pairs = F.filter(F.zip_with(F.split(query, ""), F.split(genome, ""), lambda a, b: F.struct(a.alias("q"), b.alias("g"))), lambda x: x["g"] != "-")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("run"), F.lit(False).alias("deleted"))

    def step(s: Column, x: Column) -> Column:
        gap, same = x["q"] == "-", x["q"] == x["g"]
        flush = F.concat(s["out"], s["run"].cast("string"))
        out = (
            F.when(gap & s["deleted"], F.concat(s["out"], x["g"])).when(gap, F.concat(flush, F.lit("^"), x["g"])).when(same, s["out"]).otherwise(F.concat(flush, x["g"]))
        )
        return F.struct(out.alias("out"), F.when(same & ~gap, s["run"] + 1).otherwise(0).alias("run"), gap.alias("deleted"))

    return F.aggregate(pairs, start, step, lambda s: F.concat(s["out"], s["run"].cast("string")))


# The SAM flag bits.
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024}


def sam_flag(**bits: Column) -> Column:
    """The sum of the bits whose condition holds; a null condition counts as false."""
    out = F.lit(0)
    for name, condition in bits.items():
        out = out + F.when(F.coalesce(condition, F.lit(False)), FLAGS[name]).otherwise(0)
    return out


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAGS[name])) != 0


def quality_values(text: Column, offset: int = 33) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset)


def mismatch_log_probability(quality: Column) -> Column:
    """Natural log of a third of 10^(-Q/10), with Q from 0 to 40."""
    return F.ln(F.pow(F.lit(10.0), -F.least(F.greatest(quality, F.lit(0)), F.lit(40)) / 10) / 3)


def log_likelihood(qualities: Column) -> Column:
    """Sum over the qualities at mismatches; an exact hit has 0."""
    return F.aggregate(qualities, F.lit(0.0), lambda s, q: s + mismatch_log_probability(q))


def shift_quality(text: Column, by: int) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c == "", c).otherwise(F.char(F.ascii(c) + by))), "")


def strip_barcode(seq: Column, n: int) -> Column:
    """A struct (barcode, rest)."""
    return F.struct(F.substring(seq, 1, n).alias("barcode"), F.substring(seq, F.lit(n + 1), F.length(seq)).alias("rest"))


def orient(seq: Column, quality: Column, end: int, orientation: str = "FR") -> Column:
    """A struct (seq, quality) of one end of a pair, turned so that both ends lie as in FR."""
    turned = {"FR": (), "RF": (1, 2), "FF": (2,)}[orientation]
    return F.struct(*((reverse_complement(seq).alias("seq"), F.reverse(quality).alias("quality")) if end in turned else (seq.alias("seq"), quality.alias("quality"))))


def identity(matches: Column, mism: Column, indels: Column) -> Column:
    """Share of matches; 1 where there is nothing to compare."""
    total = matches + mism + indels
    return F.when(total == 0, 1.0).otherwise(matches / total)


def goodness(matches: Column, mism: Column, qopen: Column, qindel: Column, topen: Column, tindel: Column, introns: Column) -> Column:
    """A match counts 1, a mismatch and an opened gap -3, a gap's base -1, a canonical intron 1."""
    return matches - 3 * mism - 3 * qopen - qindel - 3 * topen - tindel + introns


def e_value(length: Column, mism: Column, genome_length: Column) -> Column:
    return 0.1 * length * genome_length * F.exp(-1.58 * (length - 2 * mism))


def bit_score(length: Column, mism: Column) -> Column:
    return (1.58 * (length - 2 * mism) - F.ln(F.lit(0.1))) / F.ln(F.lit(2.0))


def sufficient_splice_probability(support: Column, mism: Column) -> Column:
    """The least splice probability accepted for a support of so many bases, each mismatch taking three off."""
    effective = support - 3 * mism
    return F.when(effective < 14, 0.95).when(effective < 20, 0.90).when(effective < 26, 0.85).otherwise(0.70)

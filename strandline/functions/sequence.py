"""Nucleotide and protein strings as column expressions."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes with their complements and bases, and the standard genetic code in TCAG order.
IUPAC = "ACGTURYSWKMBDHVNX"
COMPLEMENT = "TGCAAYRSWMKVHDBNX"
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "Y": "CT", "R": "AG", "H": "ACT", "N": "ACGT"}
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: Base changes that a mode does not count: (on the plus strand, on the minus strand) as pairs of bases.
MODES = {"standard": ("", ""), "cmet": ("CT", "GA"), "atoi": ("AG", "TC"), "ttoc": ("TC", "AG")}


def reverse_complement(seq: Column) -> Column:
    """Case is kept, and so is any character without a complement."""
    return F.translate(F.reverse(seq), IUPAC + IUPAC.lower(), COMPLEMENT + COMPLEMENT.lower())


def normalise(seq: Column) -> Column:
    """Upper case, with T for U."""
    return F.translate(F.upper(seq), "U", "T")


def subsequence(seq: Column, left: Column, length: Column, plus: Column | bool = True) -> Column:
    """length characters from offset left (from 0), reverse-complemented where plus is false; null beyond the ends."""
    piece = F.substring(seq, left + 1, length)
    turned = F.when(plus if isinstance(plus, Column) else F.lit(plus), piece).otherwise(reverse_complement(piece))
    return F.when((left >= 0) & (length >= 0) & (left + length <= F.length(seq)), turned)


def bad_characters(seq: Column) -> Column:
    """How many characters are no plain base."""
    return F.length(F.translate(seq, "ACGTacgt", ""))


def composition(seq: Column) -> Column:
    """A struct of the counts of a, c, g and t, in either case."""
    up = F.upper(seq)
    return F.struct(*((F.length(seq) - F.length(F.replace(up, F.lit(b), F.lit("")))).cast("long").alias(f"n_{b.lower()}") for b in "ACGT"))


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, A C G T as 0 to 3, the last base lowest; null with any other character. For up to 31 bases."""
    digits = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")
    return F.when(F.length(F.translate(kmer, "ACGT", "")) == 0, digits)


def kmer_text(code: Column, k: int) -> Column:
    """The k bases of a kmer_code()."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def kmers(seq: Column, k: int, interval: int = 1) -> Column:
    """An array of structs (pos from 0, kmer) at every interval-th place; k-mers with other letters than ACGT are left out."""
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k, F.lit(interval)))
    found = F.transform(places, lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))
    return F.filter(found, lambda x: F.length(F.translate(x["kmer"], "ACGT", "")) == 0)


def reduce_bases(seq: Column, mode: str, plus: bool = True) -> Column:
    """The sequence with a mode's uncounted base change carried out: cmet turns C into T, on the minus strand G into A."""
    pair = MODES[mode][0 if plus else 1]
    return F.translate(seq, pair[:1], pair[1:]) if pair else seq


def _codons() -> dict[str, str]:
    plain = {a + b + c: aa for (a, b, c), aa in zip(product("TCAG", repeat=3), GENETIC_CODE, strict=True)}
    found = {}
    for codon in map("".join, product(BASES, repeat=3)):
        means = {plain["".join(x)] for x in product(*(BASES[c] for c in codon))}
        if len(means) == 1:
            found[codon] = means.pop()
    return found


CODONS = _codons()


def amino_acid(codon: Column) -> Column:
    """One letter for a codon, * for a stop; X where the codon is short, unknown, or stands for several amino acids."""
    table = F.create_map(*(F.lit(x) for pair in CODONS.items() for x in pair))
    bases = normalise(codon)
    digit = lambda i: F.position(F.substring(bases, i, 1), F.lit("TCAG")) - 1
    plain = F.substring(F.lit(GENETIC_CODE), 16 * digit(1) + 4 * digit(2) + digit(3) + 1, F.lit(1))
    return F.when(bases.rlike("^[TCAG]{3}$"), plain).otherwise(F.coalesce(F.try_element_at(table, bases), F.lit("X")))


def translate(seq: Column, frame: int | Column = 0) -> Column:
    """The protein of whole codons from offset frame on."""
    first = frame if isinstance(frame, Column) else F.lit(frame)
    codons = F.regexp_extract_all(F.substring(seq, first + 1, F.length(seq)), F.lit("(?s)(...)"), F.lit(1))  # one pass, however long the sequence is
    return F.coalesce(F.array_join(F.transform(codons, amino_acid), ""), F.lit(""))


def _codon_letters() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, and the amino acid of each three numbers."""
    digits = np.full(256, len(BASES), np.intp)
    for i, base in enumerate(BASES):
        digits[[ord(base), ord(base.lower())]] = i
    digits[list(b"Uu")] = digits[ord("T")]
    letters = np.full((len(BASES) + 1,) * 3, ord("X"), np.uint8)
    for codon, aa in CODONS.items():
        letters[tuple(digits[list(codon.encode())])] = ord(aa)
    return digits, letters


DIGITS, LETTERS = _codon_letters()
_FRAME = "struct<frame: int, start: int, protein: string>"


def _orf_of(seq: str, first: re.Pattern) -> dict | None:
    best = None
    digits = DIGITS[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    for f in range(3):
        d = digits[f : f + max(len(digits) - f, 0) // 3 * 3].reshape(-1, 3)
        protein = LETTERS[d[:, 0], d[:, 1], d[:, 2]].tobytes().decode()
        for x in first.finditer(protein):
            if best is None or x.end() - x.start() > len(best["protein"]):  # an equal one of a later frame or start does not count
                best = {"frame": f, "start": f + x.start() * 3, "protein": x[0]}
    return best


def _orfs(pattern: str):
    first = re.compile(pattern)
    kind = pa.struct([("frame", pa.int32()), ("start", pa.int32()), ("protein", pa.string())])

    def run(seqs: pa.Array) -> pa.Array:
        return pa.array([_orf_of(s.as_py() or "", first) for s in seqs], kind)

    run.__annotations__ = {"seqs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _FRAME)


def longest_orf(seq: Column, full_length: bool = False) -> Column:
    """A struct (frame, start, protein): the longest open reading frame of the three forward frames; its stop counts.

    The first frame part may begin without M unless full_length is asked for; later ones begin at M. Ties keep the lower frame
    and the earlier start. start is the offset of its first base; null if there is none. One pass over each frame, in Arrow batches.
    """
    return _orfs(r"M[^*]*\*?" if full_length else r"^[^*]+\*?|M[^*]*\*?")(seq)


def mark_mismatches(query: Column, genome: Column) -> Column:
    """The query with the bases that differ from the genome in lower case."""
    pairs = F.zip_with(F.split(query, ""), F.split(genome, ""), lambda a, b: F.when(a.eqNullSafe(b), a).otherwise(F.lower(a)))
    return F.array_join(pairs, "")


def mismatch_positions(query: Column, genome: Column, mode: str = "standard", plus: bool = True) -> Column:
    """Offsets (from 0) at which two sequences of one length differ, after the base change of a mode."""
    a, b = (F.split(reduce_bases(x, mode, plus), "") for x in (query, genome))
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.filter(F.transform(pairs, lambda same, i: F.when(~same, i)), lambda i: i.isNotNull())


def mismatches(query: Column, genome: Column, mode: str = "standard", plus: bool = True) -> Column:
    return F.size(mismatch_positions(query, genome, mode, plus))


#: Dinucleotides at the two ends of an intron, on the strand that is read.
INTRONS = {"GT-AG": ("GT", "AG"), "GC-AG": ("GC", "AG"), "AT-AC": ("AT", "AC")}


def intron_class(donor: Column, acceptor: Column) -> Column:
    """GT-AG, GC-AG, AT-AC, each with _fwd or _rev, or none, from the first and last two bases of an intron."""
    out = F
    for strand in ("fwd", "rev"):
        for name, (a, b) in INTRONS.items():
            if strand == "rev":
                a, b = (x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in (b, a))
            out = out.when((F.upper(donor) == a) & (F.upper(acceptor) == b), f"{name}_{strand}")
    return out.otherwise("none")


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of width characters."""
    return F.array_join(F.regexp_extract_all(seq, F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")


def _degenerate() -> dict[str, str]:
    """amino acid -> the IUPAC codon that covers all its codons."""
    letters = {"".join(sorted(bases)): code for code, bases in (BASES | {"S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "V": "ACG"}).items()}
    found: dict[str, list[set[str]]] = {}
    for codon, aa in zip(product("TCAG", repeat=3), GENETIC_CODE, strict=True):
        for seen, base in zip(found.setdefault(aa, [set(), set(), set()]), codon, strict=True):
            seen.add(base)
    return {aa: "".join(letters["".join(sorted(s))] for s in sets) for aa, sets in found.items()}


DEGENERATE = _degenerate()


def back_translate(protein: Column) -> Column:
    """Three IUPAC letters for each amino acid (in either case), NNN for any other letter."""
    table = F.create_map(*(F.lit(x) for pair in DEGENERATE.items() for x in pair))
    return F.array_join(F.transform(F.regexp_extract_all(F.upper(protein), F.lit("(?s)(.)"), F.lit(1)), lambda a: F.coalesce(F.try_element_at(table, a), F.lit("NNN"))), "")


def amino_changes(reference: Column, changed: Column) -> Column:
    """The places (from 1) where two proteins differ, as A12V, joined by commas; a place that only one has shows - for the other."""
    a, b = (F.regexp_extract_all(x, F.lit("(?s)(.)"), F.lit(1)) for x in (reference, changed))
    both = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, F.lit("-")).alias("a"), F.coalesce(y, F.lit("-")).alias("b")))
    texts = F.transform(both, lambda p, i: F.when(p["a"] != p["b"], F.concat(p["a"], (i + 1).cast("string"), p["b"])))
    return F.array_join(F.filter(texts, lambda x: x.isNotNull()), ",")


def tolerant_mismatches(query: Column, genome: Column, alternate: Column) -> Column:
    """A struct (mism, known) of sequences of one length: places that differ from both alleles, and those that show the alternate one only."""
    q, g, a = (F.split(x, "") for x in (query, genome, alternate))
    pairs = F.zip_with(F.zip_with(q, g, lambda x, y: F.struct(x.alias("q"), y.alias("g"))), a, lambda p, z: F.struct(p["q"].alias("q"), p["g"].alias("g"), z.alias("a")))
    count = lambda test: F.size(F.filter(pairs, test))
    return F.struct(count(lambda p: (p["q"] != p["g"]) & (p["q"] != p["a"])).alias("mism"), count(lambda p: (p["q"] != p["g"]) & (p["q"] == p["a"])).alias("known"))


def pair_counters(query: Column, genome: Column) -> Column:
    """A struct over the columns of an alignment (- is a gap, N an unknown base): matches, mismatches, unknowns, and openings and bases of gaps in either."""
    pairs = F.zip_with(F.split(query, ""), F.split(genome, ""), lambda a, b: F.struct(a.alias("q"), b.alias("g")))
    count = lambda test: F.size(F.filter(pairs, test))
    both = lambda p: (p["q"] != "-") & (p["g"] != "-")
    known = lambda p: both(p) & (p["q"] != "N") & (p["g"] != "N")
    opened = lambda text: F.size(F.regexp_extract_all(text, F.lit("(-+)"), F.lit(1)))
    return F.struct(
        count(lambda p: known(p) & (p["q"] == p["g"])).alias("matches"), count(lambda p: known(p) & (p["q"] != p["g"])).alias("mismatches"), count(lambda p: both(p) & ~known(p)).alias("unknowns"),
        opened(query).alias("qopens"), count(lambda p: p["q"] == "-").alias("qindels"), opened(genome).alias("topens"), count(lambda p: p["g"] == "-").alias("tindels"),
    )

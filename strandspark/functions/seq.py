"""Scalar functions on sequences, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC symbols, their complements, and the set of bases each one stands for.
IUPAC = "ACGTURYKMSWBDHVN"
COMPLEMENT = "TGCAAYRMKSWVHDBN"
IUPAC_MASK = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "K": 12, "M": 3, "S": 6, "W": 9,
    "B": 14, "D": 13, "H": 11, "V": 7, "N": 15,
}
#: Gap-open shares of homopolymer gaps, for run lengths 1 to 10; longer runs are as the last.
HOMOPOLYMER_SHARES = (1.0, 0.5, 0.33, 0.25, 0.2, 0.17, 0.14, 0.13, 0.11, 0.10)


def base_index(base: Column) -> Column:
    """A, C, G, T give 0..3, all else 4; case counts."""
    at = F.instr(F.lit("ACGT"), base)
    return F.when((at > 0) & (F.length(base) == 1), at - 1).otherwise(F.lit(4)).cast("int")


def complement(seq: Column) -> Column:
    """IUPAC complement in the same case; gaps stay, unknown letters become N."""
    known = F.regexp_replace(seq, f"[^{IUPAC}{IUPAC.lower()}-]", "N")
    return F.translate(known, IUPAC + IUPAC.lower(), COMPLEMENT + COMPLEMENT.lower())


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def mirror_position(pos: Column, length: Column) -> Column:
    """The place of ``pos`` on the other strand of a circular or linear reference."""
    return length - F.pmod(pos, length) - 1


def wrap(seq: Column, extra: int) -> Column:
    """The sequence with its first ``extra`` bases again at the end."""
    return F.concat(seq, F.substring(seq, 1, extra))


def kmer_code(kmer: Column) -> Column:
    """Two bits for each base (A 0, C 1, G 2, T 3, any case), or null if another letter occurs."""
    valid = (F.translate(kmer, "ACGTacgt", "") == "") & (kmer != "")
    return F.when(valid, F.conv(F.translate(kmer, "ACGTacgt", "01230123"), 4, 10).cast("bigint"))


def kmers(seq: Column, k: int) -> Column:
    """All runs of k letters, in order; none if the sequence is shorter.

    A lookahead finds overlapping runs in one pass; cutting each out by its place would start
    at the front of the sequence every time.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def iupac_mask(base: Column) -> Column:
    """The bases that a symbol stands for, as bits A 1, C 2, G 4, T 8; 0 for others."""
    table = F.create_map(*[x for k, v in IUPAC_MASK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, F.upper(base)), F.lit(0))


def compatible(a: Column, b: Column) -> Column:
    """Whether two IUPAC symbols share a base."""
    return iupac_mask(a).bitwiseAND(iupac_mask(b)) != 0


def is_transversion(a: Column, b: Column) -> Column:
    """Whether b is not the transition partner of a; false unless both are bases."""
    partner = F.translate(F.upper(a), "ACGTU", "GTACC")
    valid = F.upper(a).rlike("^[ACGTU]$") & F.upper(b).rlike("^[ACGTU]$")
    return valid & (partner != F.translate(F.upper(b), "U", "T"))


def consistent(x: Column, y: Column, ancient: bool = False) -> Column:
    """Whether a read base y can come from x; with ``ancient`` G may read as R and C as Y."""
    damaged = F.when(F.upper(x) == "G", F.lit("R")).when(F.upper(x) == "C", F.lit("Y")).otherwise(x) if ancient else x
    return (x == "-") | (y == "-") | compatible(damaged, y)


def qual_sum(qual: Column, offset: int = 33) -> Column:
    """Sum of the quality values of a string of characters."""
    return F.aggregate(F.filter(F.split(qual, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c) - offset)


def matrix_class(before: Column, length: Column, depth: int = 15) -> Column:
    """The position class of a base with ``before`` read bases ahead of it in a read of ``length``."""
    after = length - before - 1
    return F.when(before <= depth, before).when(after < depth, 2 * depth - after).otherwise(F.lit(depth)).cast("int")


def row_class(row: Column, length: Column, depth: int = 15) -> Column:
    """The matrix of row ``row`` of an alignment of a read of ``length``."""
    after = length - row - 1
    return F.when(row < depth, row).when(after < depth, 2 * depth - after).otherwise(F.lit(depth)).cast("int")


def alignable_length(read_length: Column, ref_part: Column, floor: int = 15) -> Column:
    """Length of a read less the N of the reference under it, at least ``floor``."""
    n = F.length(ref_part) - F.length(F.replace(ref_part, F.lit("N"), F.lit("")))
    return F.greatest(read_length - n, F.lit(floor))


def homopolymer_penalty(gap: Column, run: Column, gap_open: int = 1000, gap_extend: int = 200) -> Column:
    """Penalty of a gap within a homopolymer of ``run`` bases, cut to an integer."""
    share = F.element_at(F.array(*[F.lit(s) for s in HOMOPOLYMER_SHARES]), F.least(F.greatest(run, F.lit(1)), F.lit(len(HOMOPOLYMER_SHARES))).cast("int"))
    return (gap * gap_extend + F.floor(share * gap_open + F.lit(1e-9))).cast("int")


def plain_name(name: Column) -> Column:
    """The id without the suffix of a half, and without a comma before it."""
    return F.when(F.length(name) > 3, F.regexp_replace(name, ",?_[fb]$", "")).otherwise(name)


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start <= high) & (end >= low)


def covers(start: Column, end: Column, pos: Column) -> Column:
    return (start <= pos) & (pos <= end)


def covers_gap(start: Column, end: Column, pos: Column) -> Column:
    """Whether a read has a say about the gap before ``pos``: one that begins there has none."""
    return (start < pos) & (pos <= end)


def is_sequence(seq: Column) -> Column:
    return seq.rlike("^[ACGTBDHVMKYRSWUNacgtbdhvmkyrswun]+$")


def dna(text: Column) -> Column:
    """A sequence made from the Latin letters of a text, for tests on text tables."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")

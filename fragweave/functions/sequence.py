"""Nucleotide string functions as Spark columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# IUPAC codes and their complements, position by position.
IUPAC_CODES = "ACGTRYSWKMBDHVN"
IUPAC_COMPLEMENTS = "TGCAYRSWMKVHDBN"
# The bases each IUPAC code stands for.
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# Contig names that do not carry their number.
NAMED_CONTIGS = {"X": 23, "Y": 24, "M": 25, "MT": 25}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: Column | str) -> Column:
    """Base-wise IUPAC complement, upper-cased, not reversed."""
    return F.translate(F.upper(_c(seq)), IUPAC_CODES, IUPAC_COMPLEMENTS)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def letters(seq: Column | str) -> Column:
    """Array of single letters; constant-time access, unlike ``substring`` on long texts."""
    return F.split(_c(seq), "")


def base_digits(seq: Column | str, width: int) -> Column:
    """A1 T2 C3 G4, anything else 5, padded with 0 to ``width``."""
    digits = F.regexp_replace(F.translate(F.upper(_c(seq)), "ATCG", "1234"), "[^1234]", "5")
    return F.rpad(digits, width, "0")


def base_index(base: Column | str) -> Column:
    """A0 C1 G2 T3, other letters -1."""
    b = F.upper(_c(base))
    return F.when(b.isin("A", "C", "G", "T"), F.instr(F.lit("ACGT"), b) - 1).otherwise(F.lit(-1))


def is_regular_base(base: Column | str) -> Column:
    return F.upper(_c(base)).isin("A", "C", "G", "T")


def all_kmers(k: int) -> list[str]:
    return ["".join(p) for p in product("ACGT", repeat=k)]


def kmer_universe(max_k: int) -> list[str]:
    """All k-mers for k = 2 .. ``max_k``."""
    return [m for k in range(2, max_k + 1) for m in all_kmers(k)]


def kmers(seq: Column | str, k: int) -> Column:
    """Overlapping k-mers made of A, C, G and T only, found in one pass over the text."""
    return F.regexp_extract_all(F.upper(_c(seq)), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def kmer_windows(seq: Column | str, k: int) -> Column:
    """Number of windows of length k, those with other letters included."""
    return F.greatest(F.length(_c(seq)) - (k - 1), F.lit(0))


def pattern_frequency(seq: Column | str, pattern: str) -> Column:
    """Share of windows that equal ``pattern`` (windows may overlap); null for too short a sequence."""
    hits = pattern_count(seq, pattern)
    windows = kmer_windows(seq, len(pattern))
    return F.when(windows > 0, hits / windows)


def pattern_count(seq: Column | str, pattern: str) -> Column:
    """Number of occurrences of ``pattern``, overlapping ones included."""
    if len(pattern) == 1:
        return F.length(_c(seq)) - F.length(F.replace(F.upper(_c(seq)), F.lit(pattern.upper()), F.lit("")))
    return F.size(F.regexp_extract_all(F.upper(_c(seq)), F.lit(f"(?={pattern.upper()})"), F.lit(0)))


def gc_percent(seq: Column | str) -> Column:
    s = F.upper(_c(seq))
    gc = F.length(s) - F.length(F.translate(s, "GC", ""))
    return F.when(F.length(s) > 0, 100.0 * gc / F.length(s))


def iupac_mask(code: Column | str) -> Column:
    """Bit set over A1 C2 G4 T8 of the bases a code stands for; 0 for unknown letters."""
    weights = {"A": 1, "C": 2, "G": 4, "T": 8}
    pairs = F.create_map(*[F.lit(v) for code_, bases in IUPAC_BASES.items() for v in (code_, sum(weights[b] for b in bases))])
    return F.coalesce(F.try_element_at(pairs, F.upper(_c(code))), F.lit(0))


def iupac_match(code: Column | str, base: Column | str) -> Column:
    """True when ``base`` is one of the bases ``code`` stands for."""
    m, b = iupac_mask(code), iupac_mask(base)
    return (b > 0) & (m.bitwiseAND(b) == b)


def iupac_overlap(a: Column | str, b: Column | str) -> Column:
    """True when two codes have a base in common."""
    return iupac_mask(a).bitwiseAND(iupac_mask(b)) > 0


def iupac_combine(a: Column | str, b: Column | str) -> Column:
    """The code that stands for the bases of both codes."""
    mask = iupac_mask(a).bitwiseOR(iupac_mask(b))
    weights = {"A": 1, "C": 2, "G": 4, "T": 8}
    codes = F.create_map(*[F.lit(v) for code_, bases in IUPAC_BASES.items() for v in (sum(weights[x] for x in bases), code_)])
    return F.try_element_at(codes, mask)


def iupac_pattern(pattern: str) -> str:
    """Regular expression of an IUPAC pattern."""
    return "".join(b if len(b := IUPAC_BASES[c]) == 1 else f"[{b}]" for c in pattern.upper())


def iupac_search(seq: Column | str, pattern: str) -> Column:
    """Number of places where the IUPAC pattern matches, overlapping ones included."""
    return F.size(F.regexp_extract_all(F.upper(_c(seq)), F.lit(f"(?={iupac_pattern(pattern)})"), F.lit(0)))


def contig_id(name: Column | str) -> Column:
    """Numeric contig id: 1..22, X 23, Y 24, MT 25; null for other names."""
    bare = F.upper(F.regexp_replace(_c(name), "^[Cc][Hh][Rr]", ""))
    out = F.expr("try_cast(null as int)")
    for key, value in NAMED_CONTIGS.items():
        out = F.when(bare == key, F.lit(value)).otherwise(out)
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")).otherwise(out)


def strip_chr(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), "^chr", "")


def b37_name(name: Column | str) -> Column:
    """``chrM`` becomes ``MT``, then a leading ``chr`` goes."""
    return strip_chr(F.regexp_replace(_c(name), "^chrM", "MT"))


def add_chr(name: Column | str) -> Column:
    return F.concat(F.lit("chr"), _c(name))


def flank(chunk: Column | str, at: Column, k: int, negative: Column | None = None) -> Column:
    """``2k + 1`` bases centred on 1-based position ``at`` of ``chunk``; reverse complement on the minus strand."""
    out = F.substring(_c(chunk), at - k, F.lit(2 * k + 1))
    return out if negative is None else F.when(negative, reverse_complement(out)).otherwise(out)


def one_hot(base: Column, negative: Column) -> Column:
    """Base vector in the order A T C G, of the complement on the minus strand; unknown bases 0.25 each."""
    b = F.when(negative, complement(base)).otherwise(F.upper(base))
    known = b.isin("A", "T", "C", "G")
    return F.array(*[F.when(~known, F.lit(0.25)).otherwise((b == x).cast("double")) for x in "ATCG"])


def genome_windows(chunks: DataFrame, seq: str, size: int, pieces: list[str]) -> DataFrame:
    """Cut long sequences into consecutive pieces of ``size`` bases (the last one shorter)."""
    cut = F.posexplode(F.regexp_extract_all(F.col(seq), F.lit(f".{{1,{size}}}"), F.lit(0))).alias("piece", "bases")
    return chunks.select(*pieces, cut)

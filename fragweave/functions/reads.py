"""Aligned-read logic as Spark columns: flags, geometry, methylation calls, conversion filter.

Reads of one library are short, so per-base work uses arrays of letters and higher-order
functions inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fragweave.functions import sequence as S

# Bits of the SAM flag field.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSE, MATE_REVERSE, FIRST, SECOND = 0x10, 0x20, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def passes_flags(flag: Column, mapq: Column, min_mapq: int, *, skip_second: bool = False) -> Column:
    """Mapped, primary, unique, of good quality and properly paired; optionally first ends only."""
    ok = (
        ~has(flag, UNMAPPED) & ~has(flag, SECONDARY) & (mapq >= min_mapq) & ~has(flag, QC_FAIL) & ~has(flag, DUPLICATE)
        & has(flag, PAIRED) & has(flag, PROPER)
    )
    return ok & ~has(flag, SECOND) if skip_second else ok


def passes_flags_loose(flag: Column) -> Column:
    """As used by the coverage and fragment programs: a read must be both of failed quality and a
    duplicate to be dropped on those grounds, and unpaired reads are kept."""
    return (
        ~has(flag, UNMAPPED) & ~has(flag, SECONDARY) & ~(has(flag, QC_FAIL) & has(flag, DUPLICATE))
        & ~(has(flag, PAIRED) & ~has(flag, PROPER))
    )


def not_proper_pair(flag: Column) -> Column:
    return ~has(flag, PROPER)


def inverted_duplicate(flag: Column, pos: Column, mate_pos: Column) -> Column:
    """Second end that starts where its mate does, on the same strand."""
    return has(flag, PAIRED) & has(flag, SECOND) & (pos == mate_pos) & (has(flag, REVERSE) == has(flag, MATE_REVERSE))


def source_negative(negative: Column, second: Column) -> Column:
    """Strand of the original molecule: flipped for the second end of a pair."""
    return negative != second


def pair_is_facing(neg1: Column, second1: Column, s1: Column, e1: Column, neg2: Column, second2: Column, s2: Column,
                   e2: Column) -> Column:
    """Both mates at hand: opposite strands and ends, ordered, neither running past the other."""
    ordered = (e1 >= s1) & (e1 <= e2) & (s2 >= s1) & (s2 <= e2)
    return ordered & (second1 != second2) & (neg1 != neg2)


def read_is_facing(neg: Column, mate_neg: Column, second: Column, start: Column, end: Column, mate_start: Column,
                   read_len: Column) -> Column:
    """One record at hand: the mate is taken to span ``read_len`` positions from its start.

    The leftmost mate must be forward and the rightmost reverse.
    """
    mate_first = start >= mate_start
    s1, e1 = F.when(mate_first, mate_start).otherwise(start), F.when(mate_first, mate_start + read_len).otherwise(end)
    s2, e2 = F.when(mate_first, start).otherwise(mate_start), F.when(mate_first, end).otherwise(mate_start + read_len)
    left_neg = F.when(mate_first, mate_neg).otherwise(neg)
    right_neg = F.when(mate_first, neg).otherwise(mate_neg)
    return (e1 >= s1) & (e1 <= e2) & (s2 >= s1) & (s2 <= e2) & ~left_neg & right_neg & second.isNotNull()


def fragment_offset(start: Column, mate_start: Column, insert_size: Column, read_len: Column, read_offset: Column) -> Column:
    """Offset in the fragment of an offset in the read."""
    return F.when(start < mate_start, read_offset).otherwise(F.abs(insert_size) - (read_len - read_offset))


def distance_to_end(start: Column, mate_start: Column, read_len: Column, read_offset: Column) -> Column:
    """Distance of an offset in the read to the nearer outer end of its fragment."""
    return F.when(start < mate_start, read_offset).otherwise(read_len - read_offset)


def v2_offset(site_end: Column, start: Column, mate_start: Column, frag_len: Column, negative: Column) -> Column:
    """Offset from the leftmost mate start, counted from the other end on the minus strand."""
    off = site_end - F.least(start, mate_start)
    return F.when(negative, frag_len - off).otherwise(off)


def methyl_call(negative: Column, ref: Column, base: Column) -> Column:
    """``m`` or ``u`` of a base over a cytosine of the molecule's strand; null for anything else."""
    r, b = F.upper(ref), F.upper(base)
    plus = F.when((r == "C") & (b == "C"), "m").when((r == "C") & (b == "T"), "u")
    minus = F.when((r == "G") & (b == "G"), "m").when((r == "G") & (b == "A"), "u")
    return F.when(negative, minus).otherwise(plus)


def bisulfite_match(ref: Column, base: Column, negative: Column) -> Column:
    """Equal, or equal up to the C to T (minus strand: G to A) conversion."""
    r, b = F.upper(ref), F.upper(base)
    return (r == b) | (~negative & (r == "C") & (b == "T")) | (negative & (r == "G") & (b == "A"))


def bisulfite_mismatch(ref: Column, base: Column, negative: Column) -> Column:
    return ~bisulfite_match(ref, base, negative)


def phred_weight(q: Column) -> Column:
    """1 - 10 ^ -(q div 10), with the whole-number division of the original scale."""
    return 1 - F.pow(F.lit(10.0), -F.floor(q / 10))


def base_table(ref: Column, bases: Column, quals: Column | None = None) -> Column:
    """Array with one struct per base: r, the letters after and before it, b and q.

    Zipping once lets the lambdas below work on elements; looking letters up by index inside a
    lambda would split the string again for every base. Select it as a column when several of the
    ``..._of`` functions use it.
    """
    r = S.letters(F.upper(ref))
    after = F.concat(F.slice(r, F.lit(2), F.size(r)), F.array(F.lit("")))
    before = F.slice(F.concat(F.array(F.lit("")), r), F.lit(1), F.size(r))
    cols = [r.alias("r"), after.alias("after"), before.alias("before"), S.letters(F.upper(bases)).alias("b")]
    return F.arrays_zip(*cols, *([quals.alias("q")] if quals is not None else []))


def _state(x: Column, negative: Column, *, cpg: bool) -> Column:
    """1 methylated, 0 not, null no call, for a cytosine inside (``cpg``) or outside CpG."""
    after, before = x["after"] == "G", x["before"] == "C"
    if not cpg:
        # The outermost base has no neighbour to tell its context.
        after, before = ~after & (x["after"] != ""), ~before & (x["before"] != "")
    plus = F.when((x["r"] == "C") & after, F.when(x["b"] == "C", 1).when(x["b"] == "T", 0))
    minus = F.when((x["r"] == "G") & before, F.when(x["b"] == "G", 1).when(x["b"] == "A", 0))
    return F.when(negative, minus).otherwise(plus)


def base_states(ref: Column, bases: Column, quals: Column | None, negative: Column, *, min_base_q: int = 0, cpg: bool = True) -> Column:
    """State of every base of a read, null where there is no call. ``negative`` is the strand of the
    molecule; on the minus strand the G is inspected."""

    def call(x: Column) -> Column:
        state = _state(x, negative, cpg=cpg)
        return state if quals is None else F.when(x["q"] >= min_base_q, state)

    return F.transform(base_table(ref, bases, quals), call)


def cpg_calls(ref: Column, bases: Column, quals: Column | None, negative: Column, *, min_base_q: int = 0, start: int = 0,
              shift_negative: bool = True) -> Column:
    """Array of (offset, state) for every CpG of a read whose base calls it; state 1 = methylated.

    ``start`` leaves out bases at the converted end: the first ones, or the last ones on the minus
    strand. With ``shift_negative`` a minus strand call is reported at the offset of its C.
    """
    return cpg_calls_of(base_table(ref, bases, quals), negative, None if quals is None else min_base_q, start=start,
                        length=F.length(ref), shift_negative=shift_negative)


def cpg_calls_of(table: Column, negative: Column, min_base_q: int | None, *, start: int = 0, length: Column | None = None,
                 shift_negative: bool = True) -> Column:
    """``cpg_calls`` over a ``base_table`` column; qualities are ignored without ``min_base_q``."""

    def at_cytosine(x: Column) -> Column:
        plus = (x["x"]["r"] == "C") & (x["x"]["after"] == "G")
        minus = (x["x"]["r"] == "G") & (x["x"]["before"] == "C")
        keep = F.when(negative, minus).otherwise(plus)
        return keep if min_base_q is None else keep & (x["x"]["q"] >= min_base_q)

    # Few bases are cytosines of a CpG; the rest is dropped before anything is built for them.
    found = F.filter(F.transform(table, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), at_cytosine)
    if start:
        last = length - start
        found = F.filter(found, lambda c: F.when(negative, c["i"] < last).otherwise(c["i"] >= start))

    def call(c: Column) -> Column:
        at = F.when(negative, c["i"] - 1).otherwise(c["i"]) if shift_negative else c["i"]
        q = c["x"]["q"] if min_base_q is not None else F.lit(None)
        return F.struct(at.cast("int").alias("offset"), _state(c["x"], negative, cpg=True).alias("state"), q.cast("int").alias("q"))

    return F.filter(F.transform(found, call), lambda c: c["state"].isNotNull())


def count_states(calls: Column, state: int) -> Column:
    return F.size(F.filter(calls, lambda c: c["state"] == state))


def ch_counts(ref: Column, bases: Column, quals: Column | None, negative: Column, *, min_base_q: int = 0) -> Column:
    """Struct (m, u) of cytosines outside CpG."""
    return ch_counts_of(base_table(ref, bases, quals), negative, None if quals is None else min_base_q)


def ch_counts_of(table: Column, negative: Column, min_base_q: int | None) -> Column:
    """``ch_counts`` over a ``base_table`` column."""

    def call(x: Column) -> Column:
        state = _state(x, negative, cpg=False)
        return state if min_base_q is None else F.when(x["q"] >= min_base_q, state)

    states = F.filter(F.transform(table, call), lambda s: s.isNotNull())
    m = F.size(F.filter(states, lambda s: s == 1))
    return F.struct(m.alias("m"), (F.size(states) - m).alias("u"))


def cpg_location_vector(ref: Column, negative: Column, width: int, *, start: int = 0) -> Column:
    """CpG positions around the middle of a fragment: 1 CpG, 0 other, -1 outside the fragment."""
    n = F.length(ref)
    middle = F.floor(n / 2).cast("int")
    last = n - start

    def mark(x: Column, i: Column) -> Column:
        plus = (x["r"] == "C") & (x["after"] == "G") & (i >= start)
        minus = (x["r"] == "G") & (x["before"] == "C") & (i < last)
        return F.when(F.when(negative, minus).otherwise(plus), 1).otherwise(0)

    marks = F.transform(base_table(ref, ref), mark)
    half = width // 2
    first = F.greatest(F.lit(1), middle - half)
    left = F.greatest(F.lit(0), F.lit(half + 1) - middle)
    count = F.least(2 * middle - first, F.lit(width) - left)
    return F.concat(F.array_repeat(F.lit(-1), left), F.slice(marks, first + 1, F.greatest(count, F.lit(0))),
                    F.array_repeat(F.lit(-1), F.lit(width) - left - F.greatest(count, F.lit(0))))


def state_vector(ref: Column, bases: Column, quals: Column, negative: Column, anchor: Column, extend: int,
                 min_base_q: int) -> Column:
    """Methylation at each step away from ``anchor`` (0-based offset), null where there is no call.

    The minus strand walks towards the start of the fragment.
    """
    called = base_states(ref, bases, quals, negative, min_base_q=min_base_q)
    states = F.concat(called, F.array_repeat(F.lit(None).cast("int"), F.greatest(anchor + 1 - F.length(ref), F.lit(0))))
    ahead = F.slice(states, anchor + 1, F.lit(extend))
    low = F.greatest(anchor - (extend - 1), F.lit(0))
    behind = F.reverse(F.slice(states, low + 1, F.greatest(anchor - low + 1, F.lit(0))))
    walked = F.when(negative, behind).otherwise(ahead)
    padded = F.concat(walked, F.array_repeat(F.lit(None).cast("int"), F.lit(extend) - F.size(walked)))
    return F.transform(padded, lambda v: v.cast("double"))


def conversion_filter(ref: Column, bases: Column, negative: Column, *, max_ch_rate: float = 0.4, check_mismatch: bool = False,
                      max_mismatch: float = 0.1) -> Column:
    """-1 for reads whose conversion is incomplete, 0 for the others.

    A read is rejected when it shows at least ``max_ch_rate`` as many CH patterns as its
    reference (both compared on the molecule's strand), and on request when more than
    ``max_mismatch`` of its bases differ beyond conversion.
    """
    rr = F.when(negative, S.reverse_complement(ref)).otherwise(F.upper(ref))
    bb = F.when(negative, S.reverse_complement(bases)).otherwise(F.upper(bases))
    in_ref, in_read = S.iupac_search(rr, "CH"), S.iupac_search(bb, "CH")
    bad = F.when(in_ref > 0, in_read / in_ref >= max_ch_rate).otherwise(in_read > 0)
    if check_mismatch:
        wrong = F.zip_with(S.letters(rr), S.letters(bb), lambda r, b: bisulfite_mismatch(r, b, F.lit(False)))
        bad = bad | (F.size(F.filter(wrong, lambda w: w)) > max_mismatch * F.length(bases))
    return F.when(bad, F.lit(-1)).otherwise(F.lit(0))


def mate_end(cigar: Column, mate_start: Column) -> Column:
    """Last position of a mate from its CIGAR: matches and insertions advance, deletions do not."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MI]"), F.lit(1))
    return mate_start + F.aggregate(runs, F.lit(0), lambda a, x: a + x.cast("int")) - 1


def aligned_end(cigar: Column, start: Column) -> Column:
    """Last reference position covered by an alignment."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return start + F.aggregate(runs, F.lit(0), lambda a, x: a + x.cast("int")) - 1


def _runs(cigar: Column) -> Column:
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2))
    sizes = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1))
    return F.arrays_zip(ops.alias("op"), F.transform(sizes, lambda s: s.cast("int")).alias("len"))


def aligned_bases(cigar: Column, bases: Column) -> Column:
    """Read bases laid out along the reference: insertions and soft clips cut, deletions as ``N``."""
    laid = F.aggregate(
        _runs(cigar),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.when(x["op"].isin("M", "=", "X", "I", "S"), a["at"] + x["len"]).otherwise(a["at"]).alias("at"),
            F.when(x["op"].isin("M", "=", "X"), F.concat(a["out"], F.substring(bases, a["at"], x["len"])))
            .when(x["op"].isin("D", "N"), F.concat(a["out"], F.rpad(F.lit(""), x["len"], F.lit("N"))))
            .otherwise(a["out"]).alias("out"),
        ),
    )
    return laid["out"]


def read_position(cigar: Column, start: Column, ref_pos: Column) -> Column:
    """0-based read offset at a reference position; null in deletions and outside the read."""
    walk = F.aggregate(
        _runs(cigar),
        F.struct(F.lit(0).alias("q"), start.cast("int").alias("r"), F.lit(None).cast("int").alias("hit")),
        lambda a, x: F.struct(
            F.when(x["op"].isin("M", "=", "X", "I", "S"), a["q"] + x["len"]).otherwise(a["q"]).alias("q"),
            F.when(x["op"].isin("M", "=", "X", "D", "N"), a["r"] + x["len"]).otherwise(a["r"]).alias("r"),
            F.when(
                a["hit"].isNull() & x["op"].isin("M", "=", "X") & (ref_pos >= a["r"]) & (ref_pos < a["r"] + x["len"]),
                (a["q"] + (ref_pos - a["r"])).cast("int"),
            ).otherwise(a["hit"]).alias("hit"),
        ),
    )
    return walk["hit"]


def reference_from_md(bases: Column, cigar: Column, md: Column) -> Column:
    """Reference bases under the aligned part of a read, rebuilt from its MD tag.

    The result covers matches and mismatches in read order; inserted bases are kept from the
    read so that the string lines up with it, and deleted reference bases are left out. Soft
    clips are cut.
    """
    clipped = F.substring(bases, F.coalesce(F.regexp_extract(cigar, "^(?:[0-9]+H)?([0-9]+)S", 1).try_cast("int"), F.lit(0)) + 1,
                          F.length(bases))
    # Read bases without insertions, with a mark where each insertion was taken out.
    split = F.aggregate(
        F.filter(_runs(cigar), lambda x: x["op"].isin("M", "=", "X", "I")),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("match"), F.array().cast("array<struct<pos:int,ins:string>>").alias("cuts")),
        lambda a, x: F.struct(
            (a["at"] + x["len"]).alias("at"),
            F.when(x["op"] == "I", a["match"]).otherwise(F.concat(a["match"], F.substring(clipped, a["at"], x["len"]))).alias("match"),
            F.when(x["op"] == "I", F.array_append(a["cuts"], F.struct(
                F.length(a["match"]).alias("pos"), F.substring(clipped, a["at"], x["len"]).alias("ins"))))
            .otherwise(a["cuts"]).alias("cuts"),
        ),
    )
    tokens = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))
    ref = F.aggregate(
        tokens,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(
            x.rlike("^[0-9]+$"),
            F.struct((a["at"] + x.try_cast("int")).alias("at"),
                     F.concat(a["out"], F.substring(split["match"], a["at"], x.try_cast("int"))).alias("out")),
        ).when(x.startswith("^"), F.struct(a["at"].alias("at"), a["out"].alias("out")))
        .otherwise(F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], x).alias("out"))),
    )["out"]
    woven = F.aggregate(
        split["cuts"],
        F.struct(F.lit(0).alias("done"), F.lit("").alias("out")),
        lambda a, c: F.struct(
            c["pos"].alias("done"),
            F.concat(a["out"], F.substring(ref, a["done"] + 1, c["pos"] - a["done"]), c["ins"]).alias("out"),
        ),
    )
    return F.upper(F.concat(woven["out"], F.substring(ref, woven["done"] + 1, F.length(ref))))


def clip(seq: Column, cut_left: Column, cut_right: Column) -> Column:
    """Sequence without ``cut_left`` leading and ``cut_right`` trailing bases."""
    return F.substring(seq, cut_left + 1, F.greatest(F.length(seq) - cut_left - cut_right, F.lit(0)))


def clip_quals(quals: Column, cut_left: Column, cut_right: Column) -> Column:
    return F.slice(quals, cut_left + 1, F.greatest(F.size(quals) - cut_left - cut_right, F.lit(0)))


def inside_trim(offset: Column, read_len: Column, negative: Column, second: Column, trim5: int, trim3: int, *,
                second_only: bool = False) -> Column:
    """True for offsets outside the trimmed ends; the ends swap on the minus strand."""
    kept = F.when(negative, offset.between(F.lit(trim3), read_len - trim5)).otherwise(
        offset.between(F.lit(trim5), read_len - trim3))
    return ~second | kept if second_only else kept


def merged_fragment(start1: Column, ref1: Column, bases1: Column, quals1: Column, start2: Column, ref2: Column, bases2: Column,
                    quals2: Column, first_is_left: Column, *, gap_extra: int = 2) -> Column:
    """Merge two ungapped mates (left one first) into one (ref, bases, quals) struct.

    Where they disagree the better quality wins, on ties the first end of the pair. Mates that do
    not meet are joined by ``N``; the gap is ``gap_extra`` longer than the stretch between them.
    """
    n1, n2 = F.length(bases1), F.length(bases2)
    shift = start2 - start1
    gap = F.when(shift > n1 - 1, shift - n1 + gap_extra).otherwise(F.lit(0))

    def mate(ref: Column, bases: Column, quals: Column) -> Column:
        return F.arrays_zip(S.letters(ref).alias("r"), S.letters(bases).alias("b"), quals.alias("q"))

    one, two = mate(ref1, bases1, quals1), mate(ref2, bases2, quals2)
    # The right mate moved into the frame of the left one; positions it does not cover are null.
    empty = F.lit(None).cast("struct<r:string,b:string,q:int>")
    moved = F.concat(F.array_repeat(empty, F.least(shift, n1)), F.slice(two, F.lit(1), F.greatest(F.least(n1 - shift, n2), F.lit(0))))

    def pick(x: Column, y: Column) -> Column:
        better = F.when(first_is_left, x["q"] < y["q"]).otherwise(x["q"] <= y["q"])
        return F.when(y.isNotNull() & (F.upper(x["b"]) != F.upper(y["b"])) & better, y).otherwise(x)

    left = F.filter(F.zip_with(one, moved, pick), lambda x: x.isNotNull())
    filler = F.array_repeat(F.struct(F.lit("N").alias("r"), F.lit("N").alias("b"), F.lit(0).alias("q")), gap.cast("int"))
    tail = F.slice(two, F.greatest(n1 - shift, F.lit(0)) + 1, n2)
    whole = F.concat(left, filler, tail)
    return F.struct(F.array_join(whole["r"], "").alias("ref"), F.array_join(whole["b"], "").alias("bases"), whole["q"].alias("quals"))

"""Summaries of whole fragments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.functions import basekernel as K
from fragweave.functions import reads as R
from fragweave.functions import sequence as S
from fragweave.functions.numeric import pearson_from_sums
from fragweave.operators import skew
from fragweave.operators.intervals import Span, overlap_semi


def mate_pairs(reads: DataFrame, name: str, second: str, start: str, *, tolerate_single: bool = False) -> DataFrame:
    """Both mates of every fragment as structs ``left`` and ``right``, the leftmost first.

    A name must have exactly two records; others raise, or are dropped with ``tolerate_single``.
    Only three numbers and two records are kept per name, so a name with many copies stays small.
    """
    rec = F.struct(F.col(start).alias("_at"), F.col(second).alias("_second"), *reads.columns)
    t = reads.groupBy(name).agg(F.count(F.lit(1)).alias("_k"), F.min(rec).alias("left"), F.max(rec).alias("right"))
    if tolerate_single:
        t = t.where(F.col("_k") == 2)
    else:
        message = F.concat(F.lit("fragment without exactly two records: "), F.col(name).cast("string"))
        t = t.where(F.when(F.col("_k") == 2, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return t.drop("_k")


def fragment_summary(reads: DataFrame, name: str, frag_len: str, order: list[str], counts: dict[str, Column]) -> DataFrame:
    """Calls of both mates added up per fragment; the length is that of the first record."""
    first = F.min(F.struct(*order, F.abs(frag_len).alias("_len")))
    t = reads.groupBy(name).agg(first.alias("_f"), *[F.sum(c).cast("long").alias(k) for k, c in counts.items()])
    return t.select(name, F.col("_f._len").cast("int").alias("frag_len"), *counts)


def keep_summaries(summary: DataFrame, *, max_len: int = 500, max_ch_methylation: float = 0.1, need_cpg: bool = False) -> DataFrame:
    """Drop long fragments and those with methylated CH above the limit; no CH at all passes."""
    ch = F.try_divide(F.col("m_ch"), F.col("m_ch") + F.col("u_ch"))
    out = summary.where((F.col("frag_len") <= max_len) & (ch.isNull() | (ch <= max_ch_methylation)))
    return out.where(F.col("m_cg") + F.col("u_cg") > 0) if need_cpg else out


def cpg_fraction() -> Column:
    return F.try_divide(F.col("m_cg"), F.col("m_cg") + F.col("u_cg"))


def methylation_by_length(summary: DataFrame) -> DataFrame:
    """Mean, deviation, median and number of fragment methylation percentages per fragment length."""
    x = 100.0 * cpg_fraction()
    t = summary.where(x.isNotNull()).groupBy("frag_len")
    return t.agg(F.avg(x).alias("methy_mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("methy_sd"),
                 F.percentile(x, F.lit(0.5)).alias("methy_median"), F.count(F.lit(1)).alias("n"))


def length_by_methylation(summary: DataFrame) -> DataFrame:
    """Mean, deviation, median and number of fragment lengths per tenth of methylation (0, 10 .. 100)."""
    tenth = F.floor(10 * cpg_fraction()).cast("int") * 10
    t = summary.where(cpg_fraction().isNotNull()).groupBy(tenth.alias("methy_tenth"))
    return t.agg(F.avg("frag_len").alias("len_mean"), F.coalesce(F.stddev_samp("frag_len"), F.lit(0.0)).alias("len_sd"),
                 F.percentile("frag_len", F.lit(0.5)).alias("len_median"), F.count(F.lit(1)).alias("n"))


def methyl_density(methylated: Column, frag_len: Column, len1: Column, len2: Column) -> Column:
    """Methylated CpG per 100 sequenced positions of the fragment."""
    return 100.0 * methylated / F.least(frag_len, len1 + len2)


def cpg_density(matrix: DataFrame, *, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Add the number of matrix rows of a fragment divided by its (last seen) length.

    Counting combines before it shuffles, and the result is attached without gathering a fragment.
    """
    t = matrix.groupBy("read_name").agg(
        F.count(F.lit(1)).alias("n_cpg"),
        F.max(F.struct("chr", "start_", "end_", "frag_len")).alias("_last"))
    hot = skew.hot_keys(t, ["read_name"], hot_rows, weight="n_cpg")
    dim = t.select("read_name", "n_cpg", (F.col("n_cpg") / F.col("_last.frag_len")).alias("cpg_density"))
    return skew.attach(matrix, dim, ["read_name"], "left", hot_rows, hot)


def _types(df: DataFrame, cols: list[str]) -> list[str]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{c}` {types[c]}" for c in cols]


def kmer_frequencies(seqs: DataFrame, key: list[str], seq: str, k: int, *, long: bool = False) -> DataFrame:
    """Percentage of every k-mer among the windows of each sequence, zeros included.

    ``key`` tells the sequences apart. With ``long`` only k-mers that occur are returned, one row each; otherwise one
    column per k-mer. Sequences are counted where they stand, slice by slice; nothing is shuffled.
    """
    if long:
        return fragment_kmers(seqs, key, seq, k, k)
    source, n_key, names = seqs.select(*key, F.col(seq).alias("_seq")), len(key), S.all_kmers(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, n_key):
                texts = K.flat(batch.column(n_key))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_key], *map(pa.array, K.kmer_percentages(texts, k).T)], names=[*key, *names])

    return source.mapInArrow(run, ", ".join(_types(source, key) + [f"{m} double" for m in names]))


def positional_correlation(calls: DataFrame, name: list[str], pos: str, value: str) -> DataFrame:
    """Correlation of the methylation at position 0 with that at every position, over fragments
    that have both. ``calls`` must be unique on (name, pos)."""
    zero = calls.where(F.col(pos) == 0).select(*name, F.col(value).cast("double").alias("_x"))
    both = skew.attach(calls, zero, name, "inner")
    y = F.col(value).cast("double")
    t = both.groupBy(pos).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum(y).alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(F.col("_x") * y).alias("sxy"))
    return t.select(pos, "n", pearson_from_sums(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("r"))


def reference_methylation(calls: DataFrame, track: DataFrame, *, min_cpg: int = 1, only_complete: bool = False,
                          tracks: list[str] | None = None) -> DataFrame:
    """Reference methylation of the CpGs of each fragment in every track.

    ``calls``: read_name, chr, pos, state (unique per read and position). ``track``: track, chr,
    pos, methylated, coverage (unique per track and position). Both values are cut to whole
    numbers before they are summed. Fragments with fewer than ``min_cpg`` CpGs are dropped, and
    with ``only_complete`` those without coverage in some track.
    """
    own = calls.groupBy("read_name").agg(F.count(F.lit(1)).alias("n_cpg"), F.avg("state").alias("methy_obs")).where(
        F.col("n_cpg") >= min_cpg)
    values = track.select("track", "chr", "pos", F.expr("cast(methylated as int)").alias("m"), F.expr("cast(coverage as int)").alias("c"))
    names = tracks or sorted(r[0] for r in track.select("track").distinct().collect())
    wide = values.groupBy("chr", "pos").agg(
        *[F.max(F.when(F.col("track") == n, F.col(v))).alias(f"{v}_{n}") for n in names for v in ("m", "c")])
    hits = skew.attach(calls.select("read_name", "chr", "pos"), wide, ["chr", "pos"], "left")
    sums = hits.groupBy("read_name").agg(
        *[F.coalesce(F.sum(f"{v}_{n}"), F.lit(0)).alias(f"{v}_{n}") for n in names for v in ("m", "c")])
    out = own.join(sums, "read_name")
    if only_complete:
        for n in names:
            out = out.where(F.col(f"c_{n}") >= 1)
    cols = [c for n in names for c in (F.try_divide(F.col(f"m_{n}"), F.col(f"c_{n}")).alias(f"ref_{n}"), F.col(f"c_{n}").alias(f"cov_{n}"))]
    return out.select("read_name", "n_cpg", "methy_obs", *cols)


def fragments_near_sites(fragments: DataFrame, sites: DataFrame, key: str, mates: list[Span], sspan: Span) -> DataFrame:
    """Fragments with at least one mate that overlaps a site; a missing mate counts for nothing."""
    ends = F.array(*[F.struct(F.col(m.chrom).alias("_c"), F.col(m.lo).alias("_lo"), F.col(m.hi).alias("_hi")) for m in mates])
    spans = fragments.select(key, F.inline(ends)).where(F.col("_lo").isNotNull())
    hit = overlap_semi(spans, sites, Span("_c", "_lo", "_hi"), sspan).select(key).distinct()
    return skew.attach(fragments, hit, [key], "left_semi")


def _read_batches(batches: Iterator[pa.RecordBatch], n_keep: int, min_base_q: int) -> Iterator[tuple[list[pa.Array], list[K.Flat], np.ndarray, np.ndarray, np.ndarray]]:
    """Kept columns, reference and bases, state of every base, strand, and which reads lack a part (empty) of every slice."""
    for whole in batches:
        for batch in K.slices(whole, n_keep):
            own = batch.columns[n_keep:]
            skip = np.any([np.asarray(c.is_null()) for c in own], axis=0)
            ref, bases, quals = (K.without(c, skip) for c in own[:3])
            minus = own[3].fill_null(False).to_numpy(zero_copy_only=False)
            texts = [K.flat(ref), K.flat(bases)]
            yield batch.columns[:n_keep], texts, K.states(*texts, K.flat_numbers(quals), minus, min_base_q), minus, skip


def _called_reads(reads: DataFrame, keep: list[str]) -> DataFrame:
    return reads.select(*keep, "ref", "bases", F.col("quals").cast("array<int>").alias("quals"), F.col("molecule").alias("_minus"))


def fragment_digits(reads: DataFrame, keep: list[str], width: int, *, min_base_q: int = 0) -> DataFrame:
    """Base strings and methylation vector of every read (ref, bases, quals, molecule: whether on the minus strand) as digit
    strings of ``width``: longer reads are cut, shorter ones padded with 0.

    Base digits: A1 T2 C3 G4, anything else 5. Methylation digits: 1 no call in a CpG of ``min_base_q`` at least, 2 methylated, 3
    unmethylated. A read with any part missing gives nulls. Reads are called where they stand.
    """
    source, n_keep, names = _called_reads(reads, keep), len(keep), ["ref_digits", "base_digits", "methy_digits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, texts, state, _, skip in _read_batches(batches, n_keep, min_base_q):
            digits = [K.base_digits(t) for t in texts] + [np.frombuffer(b"123", np.uint8)[np.where(state < 0, 0, 2 - state)]]
            zero, one, n = np.zeros(len(skip), np.int64), np.ones(len(skip), np.int64), np.full(len(skip), width)
            rows = [K.around(d, texts[0], zero, one, width, ord("0")) for d in digits]
            yield pa.RecordBatch.from_arrays([*kept, *[K.without(K.strings(r.ravel(), n), skip) for r in rows]], names=[*keep, *names])

    return source.mapInArrow(run, ", ".join([*_types(source, keep), *[f"{c} string" for c in names]]))


def cpg_vectors(reads: DataFrame, keep: list[str], width: int, anchor: int, extend: int, *, min_base_q: int = 0) -> DataFrame:
    """Two lists for every read (ref, bases, quals, molecule: whether on the minus strand), as ``reads.cpg_location_vector``
    and ``reads.state_vector`` give them: ``locations``, ``width`` marks around the middle (1 CpG, 0 other, -1 outside the read),
    and ``states``, the ``extend`` calls of ``min_base_q`` at least from offset ``anchor`` on, towards the start on the minus strand, null
    where there is none. A read with any part missing gives nulls. Reads are called where they stand.
    """
    source, n_keep, half = _called_reads(reads, keep), len(keep), width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, (ref, _), state, minus, skip in _read_batches(batches, n_keep, min_base_q):
            n, middle = len(skip), ref.length // 2
            marks = K.around(K.cpg_marks(ref, minus).astype(np.int8), ref, middle - half, np.ones(n, np.int64), width, -1)
            # The middle stands at place ``half``; as many bases count before it as after it, itself included.
            marks[np.abs(np.arange(width) - half)[None, :] >= middle[:, None]] = -1
            walked = K.around(state, ref, np.full(n, anchor), np.where(minus, -1, 1), extend, -1).ravel()
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), v)
                     for w, v in ((width, pa.array(marks.ravel())), (extend, pa.array(walked, mask=walked < 0)))]
            yield pa.RecordBatch.from_arrays([*kept, *[K.without(v, skip) for v in lists]], names=[*keep, "locations", "states"])

    return source.mapInArrow(run, ", ".join([*_types(source, keep), "locations array<tinyint>", "states array<tinyint>"]))


def fragment_extents(reads: DataFrame, name: list[str]) -> DataFrame:
    """First and last reference position of every fragment and the number of its records.

    Both mates and what each record says of its mate count: the mate's start, and its end by the MC
    tag (matches and insertions advance), or as long as the read itself where the tag is missing. A
    mate without a place does not count. Four numbers a fragment are combined before they shuffle.
    """
    placed = F.col("mate_pos") > 0
    mate_end = F.coalesce(R.mate_end(F.col("mc"), F.col("mate_pos")), F.length("bases") + F.col("mate_pos") - 1)
    lo = F.when(placed, F.least("pos", "mate_pos")).otherwise(F.col("pos"))
    hi = F.when(placed, F.greatest("end_pos", mate_end)).otherwise(F.col("end_pos"))
    return reads.groupBy(*name).agg(F.min(lo).cast("int").alias("lo"), F.max(hi).cast("int").alias("hi"), F.count(F.lit(1)).alias("n_records"))


def fragment_kmers(seqs: DataFrame, key: list[str], seq: str, first: int, last: int, *, reverse: str | None = None) -> DataFrame:
    """K-mers of each sequence in long form: key, kmer, n, freq (percentage of the windows of that length).

    ``reverse`` names a boolean column: such rows are read as reverse complements. Windows over other
    letters than A, C, G, T count as windows and are no k-mer. A null or short sequence has no rows.
    Sequences are counted where they stand; nothing is shuffled.
    """
    turned = F.coalesce(F.col(reverse), F.lit(False)) if reverse else F.lit(False)
    source = seqs.select(*key, F.col(seq).alias("_seq"), turned.alias("_turn"))
    n_key = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, n_key):
                for found in K.kmer_counts(K.flat(batch.column(n_key)), np.asarray(batch.column(n_key + 1)), first, last):
                    row = pa.array(found.row)
                    freq = 100.0 * found.n / np.maximum(found.windows, 1)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(row) for c in batch.columns[:n_key]], found.kmer, pa.array(found.n.astype(np.int64)), pa.array(freq)], names=names)

    names = [*key, "kmer", "n", "freq"]
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in key) + ", kmer string, n bigint, freq double")


def fragment_kmer_maps(seqs: DataFrame, key: list[str], seq: str, first: int, last: int, *, reverse: str | None = None,
                       selected: list[str] | None = None) -> DataFrame:
    """One row a key with ``frag_kmers``, the percentages of its k-mers by name; with ``selected`` a column for each of those, 0.0 where absent."""
    found = fragment_kmers(seqs, key, seq, first, last, reverse=reverse)
    if selected is not None:
        found = found.where(F.col("kmer").isin(*selected)) if selected else found.where(F.lit(False))
    maps = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "freq"))).alias("frag_kmers"))  # at most 4^last entries
    if selected is None:
        return maps
    return maps.select(*key, *[F.coalesce(F.try_element_at("frag_kmers", F.lit(k)), F.lit(0.0)).alias(f"frag_{k}") for k in selected])


def call_counts(reads: DataFrame, keep: list[str], *, min_base_q: int, start: int) -> DataFrame:
    """Methylated and unmethylated calls of every read (ref, bases, quals, molecule: whether on the minus strand).

    ``m`` and ``u`` count calls in CpG of any quality, ``.._good`` those of ``min_base_q`` at least, ``.._inner`` those
    of them not among the ``start`` bases of the converted end, ``.._ch`` good calls outside CpG. ``calls`` lists the
    inner ones as offset:state; a minus strand call is at the offset of its C. Reads are called where they stand.
    """
    source = reads.select(*keep, "ref", "bases", F.col("quals").cast("array<int>").alias("quals"), F.col("molecule").alias("_minus"))
    n_keep = len(keep)
    counts = ("m", "u", "m_good", "u_good", "m_inner", "u_inner", "m_ch", "u_ch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                ref, bases, quals, minus = batch.columns[n_keep:]
                ref, minus = K.flat(ref), minus.to_numpy(zero_copy_only=False)
                x = K.read_calls(ref, K.flat(bases), K.flat_numbers(quals), minus)
                good = x.qual >= min_base_q
                inner = good & x.cpg & np.where(minus[x.row], x.offset < ref.length[x.row] - start, x.offset >= start)
                sums = [np.bincount(x.row[pick & (x.methylated == state)], minlength=batch.num_rows).astype(np.int32)
                        for pick in (x.cpg, x.cpg & good, inner, good & ~x.cpg) for state in (True, False)]
                at, row = np.flatnonzero(inner), x.row[inner]
                states = x.methylated[at].astype(np.int8)
                texts = pa.array([f"{o}:{s}" for o, s in zip((x.offset[at] - minus[row]).tolist(), states.tolist(), strict=True)], pa.string())
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
                calls = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends), texts), ",")
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *map(pa.array, sums), calls], names=[*keep, *counts, "calls"])

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{c} int" for c in counts]) + ", calls string")


def _plain_mates(pairs: DataFrame, keep: list[str]) -> DataFrame:
    parts = [F.col(f"{c}{k}").cast("array<int>" if c == "quals" else "string").alias(f"_{c}{k}") for k in (1, 2) for c in ("ref", "bases", "quals")]
    return pairs.select(*keep, *parts, F.col("start2").cast("bigint").alias("_shift"), F.col("first_is_left").alias("_left"))


def _merged_batches(batches: Iterator[pa.RecordBatch], n_keep: int, gap_extra: int) -> Iterator[tuple[list[pa.Array], K.Merged, np.ndarray]]:
    """Kept columns, merged mates and which pairs lack a part (merged as empty) of every slice."""
    for whole in batches:
        for batch in K.slices(whole, n_keep):
            own = batch.columns[n_keep:]
            skip = np.any([np.asarray(c.is_null()) for c in own], axis=0)
            ref, bases, quals = ([K.without(own[j], skip), K.without(own[j + 3], skip)] for j in range(3))
            shift = np.where(skip, 0, own[6].fill_null(0).to_numpy(zero_copy_only=False))
            yield batch.columns[:n_keep], K.merge_plain(tuple(map(K.flat, ref)), tuple(map(K.flat, bases)), tuple(map(K.flat_numbers, quals)), shift,
                                                        own[7].fill_null(True).to_numpy(zero_copy_only=False), gap_extra), skip


def merge_mates(pairs: DataFrame, keep: list[str], *, gap_extra: int = 2) -> DataFrame:
    """Merge the ungapped mates of every pair: ``keep``, ref, bases and quals.

    ``pairs`` has ref1, bases1, quals1 of the mate that begins first, the same with 2 for the other, start2 (its start
    behind the first one's) and first_is_left. The better quality wins, on ties the first end; mates that do not meet are
    joined by N, ``gap_extra`` more than lie between them. A pair with any part missing gives nulls.
    """
    source, n_keep = _plain_mates(pairs, keep), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, m, skip in _merged_batches(batches, n_keep, gap_extra):
            ends = pa.array(np.concatenate([[0], np.cumsum(m.length)]).astype(np.int32))
            quals = pa.ListArray.from_arrays(ends, pa.array(m.quals.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*kept, K.strings(m.ref, m.length, skip), K.strings(m.bases, m.length, skip), K.without(quals, skip)],
                                             names=[*keep, "ref", "bases", "quals"])

    return source.mapInArrow(run, ", ".join([*_types(source, keep), "ref string", "bases string", "quals array<int>"]))


def merged_metrics(pairs: DataFrame, keep: list[str], k: int, *, min_base_q: int = 0, gap_extra: int = 2) -> DataFrame:
    """Of every pair merged as by ``merge_mates``: methylated (m) and other (u) calls in CpG of ``min_base_q`` at least on the
    plus strand, gc_perc, and the percentage of every k-mer of the reference. Fragments are merged and measured where they stand."""
    source, n_keep, names = _plain_mates(pairs, keep), len(keep), S.all_kmers(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, m, skip in _merged_batches(batches, n_keep, gap_extra):
            ref, n = m.flat(m.ref), len(skip)
            state, row = K.states(ref, m.flat(m.bases), m.quals, np.zeros(n, bool), min_base_q), ref.row
            calls = [pa.array(np.bincount(row[state == s], minlength=n).astype(np.int32), mask=skip) for s in (1, 0)]
            gc = np.bincount(row[np.isin(m.ref, np.frombuffer(b"GCgc", np.uint8))], minlength=n)
            gc = pa.array(100.0 * gc / np.maximum(m.length, 1), mask=skip | (m.length == 0))
            shares = [pa.array(c, mask=skip) for c in K.kmer_percentages(ref, k).T]
            yield pa.RecordBatch.from_arrays([*kept, *calls, gc, *shares], names=[*keep, "m", "u", "gc_perc", *names])

    return source.mapInArrow(run, ", ".join([*_types(source, keep), "m int", "u int", "gc_perc double", *[f"{m} double" for m in names]]))


MATE_COLUMNS = ("start", "cigar", "ref", "bases", "quals")


def merge_gapped_mates(pairs: DataFrame, keep: list[str], *, gap_extra: int = 2) -> DataFrame:
    """Consensus of both mates of every pair, laid out by reference position.

    ``pairs`` has start1, cigar1, ref1, bases1, quals1 of the mate that begins first, the same with 2
    for the other, and first_is_left. ``ref`` holds a letter for every read base (a dash under an
    inserted one, 0 under a clipped one). Returns ``keep``, ref, bases and quals; a pair with any part
    missing gives nulls.
    """
    parts = [f"{c}{k}" for k in (1, 2) for c in MATE_COLUMNS]
    cast = [F.col(c).cast("bigint") if c.startswith("start") else F.col(c).cast("array<int>") if c.startswith("quals") else F.col(c) for c in parts]
    source = pairs.select(*keep, *[x.alias(f"_{c}") for x, c in zip(cast, parts, strict=True)], F.col("first_is_left").alias("_left"))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                own = batch.columns[n_keep:]
                skip = np.any([np.asarray(c.is_null()) for c in own], axis=0)
                starts = [np.where(skip, 0, c.fill_null(0).to_numpy(zero_copy_only=False)) for c in (own[0], own[5])]
                left = K.mate(starts[0], *own[1:5], skip)
                right = K.mate(starts[1], *own[6:10], skip)
                merged = K.merge_mates(left, right, starts[1], own[10].fill_null(True).to_numpy(zero_copy_only=False), gap_extra)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *[K.without(c, skip) for c in merged]], names=[*keep, "ref", "bases", "quals"])

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ref string, bases string, quals array<int>")


def cut_sequences(seqs: DataFrame, chrom: str, seq: str, size: int, overlap: int = 0) -> DataFrame:
    """Sequences as a genome table: chr, chunk_start, bases of ``size`` bases, each with the ``overlap`` bases that follow it."""
    source = seqs.select(F.col(chrom).alias("chr"), F.col(seq).alias("_seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, 1):
                row, at, bases = K.pieces(K.flat(batch.column(1)), size, overlap)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at), bases], names=["chr", "chunk_start", "bases"])

    return source.mapInArrow(run, ", ".join([*_types(source, ["chr"]), "chunk_start bigint", "bases string"]))


def pattern_sites(seqs: DataFrame, keep: list[str], seq: str, pattern: str) -> DataFrame:
    """Every occurrence of ``pattern`` in each sequence, overlapping ones included: ``keep``, pos0 and its number k from 0 on."""
    source, n_keep = seqs.select(*keep, F.col(seq).alias("_seq")), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, n_keep):
                texts = K.flat(batch.column(n_keep))
                at = K.pattern_starts(texts, pattern.upper().encode())
                row = np.searchsorted(texts.offsets, at, "right") - 1
                k = np.arange(len(at)) - np.searchsorted(at, texts.offsets)[row]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns[:n_keep]], pa.array(at - texts.offsets[row]), pa.array(k)],
                                                 names=[*keep, "pos0", "k"])

    return source.mapInArrow(run, ", ".join([*_types(source, keep), "pos0 bigint", "k bigint"]))


def cytosine_sites(seqs: DataFrame, keep: list[str], seq: str, *, edge: int = 0) -> DataFrame:
    """Both cytosines of every CpG: ``keep``, end_ and strand; the G stands for the one of the minus strand. With ``edge``
    also every C and G of the first and last ``edge`` bases, whose surroundings reach past the sequence."""
    source, n_keep = seqs.select(*keep, F.col(seq).alias("_seq")), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, n_keep):
                texts = K.flat(batch.column(n_keep))
                rest = np.minimum(texts.length, edge)
                ends = np.concatenate([K.spans(texts.offsets[:-1], rest), K.spans(texts.offsets[1:] - rest, rest)])
                ends = ends[np.isin(texts.data[ends], np.frombuffer(b"CGcg", np.uint8))]
                first = K.pattern_starts(texts, b"CG")
                at = np.unique(np.concatenate([first, first + 1, ends]))
                row = np.searchsorted(texts.offsets, at, "right") - 1
                minus = pa.array(np.isin(texts.data[at], np.frombuffer(b"Gg", np.uint8)))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(row)) for c in batch.columns[:n_keep]], pa.array((at - texts.offsets[row] + 1).astype(np.int32)),
                     pa.compute.if_else(minus, "-", "+")], names=[*keep, "end_", "strand"])

    return source.mapInArrow(run, ", ".join([*_types(source, keep), "end_ int", "strand string"]))


def pair_reasons(reads: DataFrame, name: list[str], *, good: Column, max_len: int = 500) -> DataFrame:
    """Why each fragment is left out, or ``kept``: records, flags, orientation, too_long, lengths_differ, in this order.

    ``good`` tells whether a record passes its own filters. Only the ends, strands and lengths of the
    two records are combined, before any read is shuffled, so fragments that fail never meet.
    """
    f = F.col("flag")
    end = F.struct(F.col("pos").alias("s"), R.has(f, R.SECOND).alias("second"), F.col("end_pos").alias("e"), R.has(f, R.REVERSE).alias("neg"))
    size = F.abs("insert_size")
    t = reads.groupBy(*name).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"), F.min(end).alias("_a"), F.max(end).alias("_b"),
        F.min(size).alias("_least"), F.max(size).alias("_most"))
    a, b = F.col("_a"), F.col("_b")
    facing = R.pair_is_facing(a["neg"], a["second"], a["s"], a["e"], b["neg"], b["second"], b["s"], b["e"])
    reason = (F.when(F.col("_n") != 2, "records").when(~F.col("_good"), "flags").when(~F.coalesce(facing, F.lit(False)), "orientation")
              .when(F.col("_most") > max_len, "too_long").when(F.col("_least") != F.col("_most"), "lengths_differ").otherwise("kept"))
    return t.select(*name, reason.alias("reason"))


def strand_context(rows: DataFrame, genome: DataFrame, k: int, name: str = "context", *, strand: str = "strand", turn: bool = True,
                   chunk: int = 1 << 16, overlap: int = 0, distinct: bool = False) -> DataFrame:
    """Add the 2k + 2 reference bases around each site (chr, end_): k before the CpG, the CpG, k after it.

    A site on the minus strand is the G, so its window begins one base earlier; it is read as the
    reverse complement unless ``turn`` is off. One look-up by chunk serves both strands. Bases
    outside the contig are missing. ``overlap`` and ``distinct`` are those of ``genome_lookup``.
    """
    from fragweave.sources.text import genome_lookup

    minus = F.col(strand) == "-"
    out = genome_lookup(rows, genome, "chr", F.col("end_") - 1 - k - minus.cast("int"), 2 * k + 2, name, chunk=chunk, overlap=overlap, distinct=distinct)
    return out.withColumn(name, F.when(minus, S.reverse_complement(name)).otherwise(F.upper(name)) if turn else F.upper(name))

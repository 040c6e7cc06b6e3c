"""DuckDB statements for the queries of ``queries_sequence``."""

from __future__ import annotations

from fragweave.functions.sequence import IUPAC_BASES, IUPAC_CODES, IUPAC_COMPLEMENTS, all_kmers
from fragweave.plans.bindings import ctes, letter_codes_sql

SEQ = "with " + ctes("sequences")
READS = "with " + ctes("sequences", "reads")
MATES = "with " + ctes("sequences", "mates")
ALN = "with " + ctes("alignments")
_W = {"A": 1, "C": 2, "G": 4, "T": 8}


def mask(x: str) -> str:
    return "case " + x + " " + " ".join(f"when '{c}' then {sum(_W[b] for b in bs)}" for c, bs in IUPAC_BASES.items()) + " else 0 end"


def code(x: str) -> str:
    return "case " + x + " " + " ".join(f"when {sum(_W[b] for b in bs)} then '{c}'" for c, bs in IUPAC_BASES.items()) + " end"


def revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


# Positions (1-based) of a read with the letters around them; one row per base.
BASES = """, pos as (select doc_id, i, k, molecule, length(ref) as n, unnest(range(1, length(ref) + 1)) as p, ref, bases from reads),
let as (select doc_id, i, molecule, n, p, (( (p - 1) * 7 + k) % 41) as q, substr(ref, p, 1) as r, substr(ref, p + 1, 1) as r1, case when p > 1 then substr(ref, p - 1, 1) else '' end as r0,
  substr(bases, p, 1) as b from pos),
call as (select *, case when molecule then case when r = 'G' and r0 = 'C' then case b when 'G' then 1 when 'A' then 0 end end
   else case when r = 'C' and r1 = 'G' then case b when 'C' then 1 when 'T' then 0 end end end as cg,
  case when molecule then case when r = 'G' and r0 <> 'C' and p > 1 then case b when 'G' then 1 when 'A' then 0 end end
   else case when r = 'C' and r1 <> 'G' and p < n then case b when 'C' then 1 when 'T' then 0 end end end as ch from let)"""
# Merged mates position by position; 0-based offset ``o`` in the merged string.
MERGED = """, ov as (select *, length(ref1) as n1, length(ref2) as n2 from mates),
lf as (select doc_id, i, k, o, o - start2 as j, n1, n2, start2, first_is_left, ref1, ref2, bases1, bases2 from (select *, unnest(range(0, n1)) as o from ov)),
lq as (select *, (o * 7 + k) % 41 as q1, case when j >= 0 and j < n2 then (j * 11 + k + 3) % 41 end as q2, substr(bases1, cast(o + 1 as int), 1) as b1,
  case when j >= 0 and j < n2 then substr(bases2, cast(j + 1 as int), 1) end as b2 from lf),
lc as (select *, coalesce(b1 <> b2 and case when first_is_left then q1 < q2 else q1 <= q2 end, false) as use2 from lq),
parts as (select doc_id, i, o, case when use2 then substr(ref2, cast(j + 1 as int), 1) else substr(ref1, cast(o + 1 as int), 1) end as r, case when use2 then b2 else b1 end as b, case when use2 then q2 else q1 end as q from lc
  union all select doc_id, i, n1 + g, 'N', 'N', 0 from (select doc_id, i, n1, unnest(range(0, start2 - n1 + 2)) as g from ov where start2 >= n1)
  union all select doc_id, i, 1000 + j, substr(ref2, cast(j + 1 as int), 1), substr(bases2, cast(j + 1 as int), 1), (j * 11 + k + 3) % 41 from (select doc_id, i, k, ref2, bases2, unnest(range(greatest(n1 - start2, 0), n2)) as j from ov)),
merged as (select doc_id, i, string_agg(r, '' order by o) as ref, string_agg(b, '' order by o) as bases, cast(sum(q) as bigint) as qual_sum from parts group by all)"""

ORACLE = {
    "kmer_freq": SEQ + """, k as (select doc_id, length(seq) - 1 as w, unnest(range(1, length(seq))) as p, seq from sequences),
  c as (select doc_id, any_value(w) as w, """ + ", ".join(f"count(*) filter (where substr(seq, p, 2) = '{m}') as {m}" for m in all_kmers(2))
    + """ from k group by doc_id)
  select doc_id, """ + ", ".join(f"round(coalesce(100.0::double * c.{m} / c.w, 0), 8) as {m}" for m in all_kmers(2)) + " from sequences left join c using (doc_id)",
    "kmer_freq_sparse": SEQ + """, k as (select doc_id, length(seq) - 3 as w, substr(seq, unnest(range(1, length(seq) - 2)), 4) as kmer from sequences)
  select doc_id, kmer, count(*) as n, round(100.0::double * count(*) / w, 8) as freq from k where not contains(kmer, 'N') group by doc_id, kmer, w""",
    "gc_content": SEQ + """, l as (select doc_id, string_split(seq, '') as s, length(seq) as n from sequences)
  select doc_id, cast(n as int) as n, round(100.0::double * len(list_filter(s, lambda x: x in ('G', 'C'))) / nullif(n, 0), 8) as gc,
  round(case when n > 1 then len(list_filter(range(1, n), lambda p: s[p] = 'C' and s[p + 1] = 'G')) / (n - 1) end, 8) as cg_freq,
  cast(len(list_filter(range(1, n - 1), lambda p: s[p] = 'A' and s[p + 1] = 'C' and s[p + 2] = 'A')) as int) as n_aca,
  cast(len(list_filter(range(1, n), lambda p: s[p] = 'C' and s[p + 1] in ('A', 'C', 'T'))) as int) as n_ch,
  cast(len(list_filter(range(1, n - 2), lambda p: s[p] in ('A', 'T') and s[p + 1] = 'C' and s[p + 2] = 'G' and s[p + 3] in ('A', 'T'))) as int) as n_wcgw from l""",
    "revcomp": SEQ + " select doc_id, translate(seq, 'ACGT', 'TGCA') as complement, " + revcomp("seq") + " as reverse_complement from sequences",
    "seq_encode": READS + """ select doc_id, cast(i as int) as i, rpad(translate(ref, 'ATCGN', '12345'), 120, '0') as ref_digits, rpad(translate(bases, 'ATCGN', '12345'), 120, '0') as base_digits from reads""",
    "iupac_table": f"""with c as (select {letter_codes_sql('text', (IUPAC_CODES * 2)[:26])} as s from documents),
  p as (select substr(s, unnest(range(1, length(s))), 2) as pair from c), g as (select pair, count(*) as n, substr(pair, 1, 1) as a, substr(pair, 2, 1) as b from p group by pair),
  m as (select *, {mask('a')} as x, {mask('b')} as y from g)
  select pair, n, y > 0 and (x & y) = y as matches, (x & y) > 0 as overlaps, {code('(x | y)')} as combined, a in ('A', 'C', 'G', 'T') as regular,
  cast(case when a in ('A', 'C', 'G', 'T') then instr('ACGT', a) - 1 else -1 end as int) as base_index, translate(a, '{IUPAC_CODES}', '{IUPAC_COMPLEMENTS}') as complement from m""",
    "flank_sequence": SEQ + f""", p as (select doc_id, seq, unnest(list_filter(range(1, length(seq)), lambda p: substr(seq, p, 2) = 'CG')) as p from sequences),
  q as (select *, row_number() over (partition by doc_id order by p) - 1 as k from p)
  select doc_id as chr, p - 1 as pos0, k % 2 = 1 as neg, case when k % 2 = 1 then {revcomp('substr(seq, greatest(p - 5, 1), 11 + least(p - 6, 0))')} else substr(seq, greatest(p - 5, 1), 11 + least(p - 6, 0)) end as flank from q""",
    "methyl_call": ALN + """, m as (select *, ((flag & 16) <> 0) <> ((flag & 128) <> 0) as molecule from alignments)
  select read_name, line, partkey, ref, base, molecule, case when molecule then case when ref = 'G' and base = 'G' then 'm' when ref = 'G' and base = 'A' then 'u' end
   else case when ref = 'C' and base = 'C' then 'm' when ref = 'C' and base = 'T' then 'u' end end as state,
  ref = base or (not molecule and ref = 'C' and base = 'T') or (molecule and ref = 'G' and base = 'A') as compatible, 1 - pow(10.0, -(qual // 10)) as weight from m""",
    "read_filters": ALN + """ select read_name, line, partkey, flag, (flag & 4) = 0 and (flag & 256) = 0 and mapq >= 30 and (flag & 512) = 0 and (flag & 1024) = 0 and (flag & 1) <> 0 and (flag & 2) <> 0 as strict,
  (flag & (4 | 256 | 512 | 1024 | 128)) = 0 and mapq >= 30 and (flag & 3) = 3 as first_only,
  (flag & (4 | 256)) = 0 and (flag & 1536) <> 1536 and not ((flag & 1) <> 0 and (flag & 2) = 0) as loose, (flag & 2) = 0 as not_proper,
  (flag & 129) = 129 and pos = mate_pos and ((flag & 16) <> 0) = ((flag & 32) <> 0) as inverted from alignments""",
    "read_geometry": ALN + """, g as (select *, (flag & 16) <> 0 as neg, (flag & 32) <> 0 as mneg, (flag & 128) <> 0 as second, pos + read_len - 1 as e, mate_pos + read_len - 1 as me from alignments)
  select read_name, line, partkey,
  case when pos >= mate_pos then not mneg and neg and mate_pos + read_len <= e and pos <= e else not neg and mneg and e <= mate_pos + read_len and mate_pos <= mate_pos + read_len end as facing,
  e <= me and mate_pos >= pos and mate_pos <= me and neg <> mneg as pair_facing,
  cast(case when pos < mate_pos then read_offset else insert_size - (read_len - read_offset) end as int) as offset_,
  cast(case when pos < mate_pos then read_offset else read_len - read_offset end as int) as dist_end,
  cast(case when neg then insert_size - (pos + read_offset - least(pos, mate_pos)) else pos + read_offset - least(pos, mate_pos) end as int) as v2_offset,
  case when neg then read_offset >= 10 and read_offset <= read_len - 5 else read_offset >= 5 and read_offset <= read_len - 10 end as kept,
  cast(substr(chr, 4) as int) as contig from g""",
    "cigar_geometry": ALN + """, g as (select *, line as s, mapq as m1, line % 3 + 1 as ins, partkey % 20 + 1 as m2, cast(regexp_extract(cigar, '([0-9]+)D', 1) as int) as del from alignments)
  select read_name, line, partkey, cast(pos + m1 + ins + m2 + 10 - 1 as int) as mate_end, cast(pos + m1 + m2 + del + 10 - 1 as int) as aligned_end,
  cast(case when 5 < m1 then s + 5 when 5 < m1 + m2 then s + ins + 5 when 5 < m1 + m2 + del then null when 5 < m1 + m2 + del + 10 then s + ins + 5 - del end as int) as offset_at_5 from g""",
    "conversion_filter": READS + f""", o as (select doc_id, i, case when molecule then {revcomp('ref')} else ref end as r, case when molecule then {revcomp('bases')} else bases end as b from reads),
  c as (select *, len(list_filter(range(1, length(r)), lambda p: substr(r, p, 1) = 'C' and substr(r, p + 1, 1) in ('A', 'C', 'T'))) as nr,
   len(list_filter(range(1, length(b)), lambda p: substr(b, p, 1) = 'C' and substr(b, p + 1, 1) in ('A', 'C', 'T'))) as nb,
   len(list_filter(range(1, length(b) + 1), lambda p: substr(b, p, 1) <> substr(r, p, 1) and not (substr(r, p, 1) = 'C' and substr(b, p, 1) = 'T'))) as bad from o)
  select doc_id, cast(i as int) as i, case when case when nr > 0 then nb / nr >= 0.4 else nb > 0 end then -1 else 0 end as lenient,
  case when case when nr > 0 then nb / nr >= 0.1 else nb > 0 end or bad > 0.1 * length(b) then -1 else 0 end as strict from c""",
    "cpg_counts": READS + BASES + """ select doc_id, cast(i as int) as i, cast(count(*) filter (where cg = 1) as int) as m, cast(count(*) filter (where cg = 0) as int) as u,
  cast(count(*) filter (where cg = 1 and q >= 10) as int) as m_good, cast(count(*) filter (where cg = 0 and q >= 10) as int) as u_good,
  cast(count(*) filter (where cg = 1 and q >= 10 and inner_) as int) as m_inner, cast(count(*) filter (where cg = 0 and q >= 10 and inner_) as int) as u_inner,
  cast(count(*) filter (where ch = 1 and q >= 10) as int) as m_ch, cast(count(*) filter (where ch = 0 and q >= 10) as int) as u_ch,
  coalesce(string_agg(concat(case when molecule then p - 2 else p - 1 end, ':', cg), ',' order by p) filter (where cg is not null and q >= 10 and inner_), '') as calls
  from (select *, case when molecule then p <= n - 20 else p > 20 end as inner_ from call) group by doc_id, i""",
    "cpg_locations": READS + BASES + """, slot as (select doc_id, i, molecule, length(ref) as n, length(ref) // 2 as mid, unnest(range(-60, 60)) as j from reads),
  loc as (select s.doc_id, s.i, string_agg(case when abs(j) >= mid then '-1' when (case when s.molecule then c.r = 'G' and c.r0 = 'C' else c.r = 'C' and c.r1 = 'G' end) then '1' else '0' end, ',' order by j) as locations
   from slot s left join let c on c.doc_id = s.doc_id and c.i = s.i and c.p = j + mid + 1 group by all),
  st as (select r.doc_id, r.i, unnest(range(0, 30)) as t, molecule from reads r),
  sv as (select st.doc_id, st.i, string_agg(coalesce(cast(case when q >= 5 then cg end as varchar), '.'), '' order by t) as states
   from st left join call c on c.doc_id = st.doc_id and c.i = st.i and c.p = case when st.molecule then 41 - t else 41 + t end group by all)
  select doc_id, cast(i as int) as i, locations, states from loc join sv using (doc_id, i)""",
    "merged_fragments": MATES + MERGED + " select doc_id, cast(i as int) as i, ref, bases, cast(qual_sum as int) as qual_sum from merged",
    "fragment_metrics": MATES + MERGED + """, l as (select *, lead(r) over (partition by doc_id, i order by o) as r1 from parts),
  c as (select doc_id, i, count(*) filter (where r = 'C' and r1 = 'G' and b = 'C' and q >= 5) as m, count(*) filter (where r = 'C' and r1 = 'G' and b = 'T' and q >= 5) as u,
   count(*) filter (where r in ('G', 'C')) as n_gc, count(*) as n, """ + ", ".join(f"count(*) filter (where r || r1 = '{m}') as {m}" for m in ("AA", "CG", "GC", "TT")) + """ from l group by all)
  select c.doc_id, cast(c.i as int) as i, cast(m as int) as m, cast(u as int) as u, round(100.0::double * m / nullif(m + u, 0), 7) as methy_frac,
  round(100.0::double * m / least(start2 + n2, n1 + n2), 7) as density, round(100.0::double * n_gc / n, 7) as gc_perc, """
    + ", ".join(f"round(coalesce(100.0::double * c.{m} / nullif(n - 1, 0), 0), 7) as {m}" for m in ("AA", "CG", "GC", "TT")) + " from c join ov on ov.doc_id = c.doc_id and ov.i = c.i",
    "fragment_digits": READS + BASES + """ select doc_id, cast(i as int) as i, rpad(string_agg(case r when 'A' then '1' when 'T' then '2' when 'C' then '3' when 'G' then '4' else '5' end, '' order by p), 110, '0') as ref_digits,
  rpad(string_agg(case when q < 5 or cg is null then '1' when cg = 1 then '2' else '3' end, '' order by p), 110, '0') as methy_digits from call group by doc_id, i""",
    "mate_pairs": ALN + """, a as (select read_name, line, pos, mapq, (flag & 128) <> 0 as second, partkey from alignments),
  g as (select *, count(*) over (partition by read_name) as c, row_number() over (partition by read_name order by pos, second, line, mapq, partkey) as rn from a)
  select read_name, max(pos) filter (where rn = 1) as left_pos, max(pos) filter (where rn = 2) as right_pos, max(line) filter (where rn = 1) as left_line, max(line) filter (where rn = 2) as right_line
  from g where c = 2 group by read_name""",
    "stat_merge": """with l as (select l_suppkey, 'l_quantity' as feature, l_quantity as v from lineitem union all select l_suppkey, 'l_extendedprice', l_extendedprice from lineitem
   union all select l_suppkey, 'l_discount', l_discount from lineitem union all select l_suppkey, 'l_tax', l_tax from lineitem),
  p as (select l_suppkey, feature, count(*) as n, min(v) as lo, max(v) as hi, avg(v) as a, stddev_samp(v) as s from l group by all)
  select feature, cast(sum(n) as bigint) as n, min(lo) as minimum, max(hi) as maximum, round(sum(a * n) / sum(n), 5) as mean, round(sqrt(sum(s * s * n) / sum(n)), 5) as sd from p group by feature""",
    "genotype_merge": "with " + ctes("genotypes") + """, s as (select variant, patient, gt, sum(dp) as dp, sum(gq) as gq, sum(ad[1]) as a1, sum(ad[2]) as a2, sum(pl[1]) as p1, sum(pl[2]) as p2, sum(pl[3]) as p3, 0 as seed
   from genotypes where called group by all
   union all select variant, patient, gt, dp, gq, ad[1], ad[2], pl[1], pl[2], pl[3], 1 from (select * from genotypes qualify row_number() over (partition by variant, patient order by library) = 1)),
  b as (select * from s qualify row_number() over (partition by variant, patient order by gq desc, dp, seed desc, gt desc, a1 desc, a2 desc) = 1)
  select variant, patient, gt, concat(a1, ',', a2) as ad, concat(p1, ',', p2, ',', p3) as pl, cast(dp as bigint) as dp, cast(gq as bigint) as gq from b""",
    "patient_libraries": """select distinct cast(o_custkey as varchar) as patient, cast(o_orderkey as varchar) as lib from orders
  where o_custkey % 10 <> 0 and o_orderstatus <> 'P' and o_orderkey in (select l_orderkey from lineitem)""",
    "union_parts": "with " + ctes("matrix") + " select chr, start_, read_name, strand from matrix",
}

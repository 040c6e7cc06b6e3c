"""DuckDB statements for the queries of ``queries_fragment``."""

from __future__ import annotations

from fragweave.plans.bindings import ctes
from fragweave.plans.oracle_sequence import revcomp

SEQ = "with " + ctes("sequences")
MATES = "with " + ctes("sequences", "mates")
ALN = "with " + ctes("alignments")


def bases_of(k: int, at: int, kind: str, start: str, q: str) -> str:
    """Every base of a gapped mate: its place p in the read (from 0), reference position, letters and quality."""
    ref, seq = f"ref{k}", f"bases{k}"
    return f"""g{k} as (select doc_id, i, k, {ref} as ref, {seq} as seq, {start} as start, length({ref}) as n, case when length({ref}) < {at + 10} then 0 else {kind} end as kind from mates),
u{k} as (select *, unnest(range(0, n + case kind when 1 then -3 when 2 then 2 when 3 then 2 else 0 end)) as p from g{k}),
s{k} as (select *, case kind when 1 then case when p < {at} then p else p + 3 end when 2 then case when p < {at} then p when p < {at + 2} then null else p - 2 end
  when 3 then case when p < 2 then null else p - 2 end else p end as ofs from u{k}),
b{k} as (select doc_id, i, p, start + ofs as pos, ({q}) % 41 as q, coalesce(substr(ref, cast(ofs + 1 as int), 1), case kind when 2 then '-' else '0' end) as r,
  coalesce(substr(seq, cast(ofs + 1 as int), 1), case when kind = 2 then substr('AC', cast(p - {at} + 1 as int), 1) else 'G' end) as b from s{k})"""


ORACLE = {
    "gapped_merges": MATES + ", " + bases_of(1, 20, "k % 4", "0", "p * 7 + k") + ", " + bases_of(2, 15, "(k // 4) % 4", "start2", "p * 11 + k + 3") + """,
  lead as (select b1.*, 1 as side, true as first_left from b1 join mates m using (doc_id, i) where m.first_is_left
    union all select b2.*, 2, false from b2 join mates m using (doc_id, i) where not m.first_is_left),
  rest as (select b2.* from b2 join mates m using (doc_id, i) where m.first_is_left union all select b1.* from b1 join mates m using (doc_id, i) where not m.first_is_left),
  met as (select l.*, o.p as op, o.q as oq, o.r as orr, o.b as ob from lead l left join rest o on o.doc_id = l.doc_id and o.i = l.i and o.pos = l.pos),
  span as (select doc_id, i, first_left, min(op) as lo, max(op) as hi from met group by all),
  ends as (select doc_id, i, max(pos) as e1 from b1 group by all),
  gaps as (select s.doc_id, s.i, s.first_left, greatest(m.start2 - e.e1 + 1, 0) as n from span s join ends e using (doc_id, i) join mates m using (doc_id, i) where s.lo is null),
  parts as (select doc_id, i, 2 as part, p, case when ob is not null and b <> ob and q < oq then orr else r end as r, case when ob is not null and b <> ob and q < oq then ob else b end as b,
      case when ob is not null and b <> ob and q < oq then oq else q end as q from met
    union all select doc_id, i, case when first_left then 3 else 1 end, g, 'N', 'N', 0 from (select *, unnest(range(0, n)) as g from gaps)
    union all select o.doc_id, o.i, case when first_left then 4 else 0 end, o.p, o.r, o.b, o.q from rest o join span s using (doc_id, i)
      where case when first_left then o.p > coalesce(hi, -1) else o.p < coalesce(lo, 1000000) end)
  select doc_id, cast(i as int) as i, string_agg(r, '' order by part, p) as ref, string_agg(b, '' order by part, p) as bases, cast(sum(q) as int) as qual_sum from parts group by doc_id, i""",
    "fragment_extent": ALN + """, g as (select *, pos + mapq + partkey % 20 + 1 + cast(regexp_extract(cigar, '([0-9]+)D', 1) as int) + 10 - 1 as e,
    case when partkey % 5 <> 0 then mate_pos + partkey % 40 + 10 + line % 4 + 1 + 20 - 1 else read_len + mate_pos - 1 end as me from alignments)
  select chr, read_name, cast(min(case when mate_pos > 0 then least(pos, mate_pos) else pos end) as int) as lo,
    cast(max(case when mate_pos > 0 then greatest(e, me) else e end) as int) as hi, count(*) as n_records from g group by chr, read_name""",
    "fragment_kmers": MATES + f""", f as (select doc_id, i, case when k % 2 = 1 then {revcomp('tile')} else tile end as s from mates),
  w as (select doc_id, i, length(s) - 1 as w, substr(s, unnest(range(1, length(s))), 2) as kmer from f union all
    select doc_id, i, length(s) - 2, substr(s, unnest(range(1, length(s) - 1)), 3) from f)
  select doc_id, cast(i as int) as i, kmer, count(*) as n, round(100.0::double * count(*) / w, 8) as freq from w where not contains(kmer, 'N') group by doc_id, i, kmer, w""",
    "strand_context": SEQ + f""", p as (select doc_id, seq, unnest(range(1, length(seq) + 1)) as p from sequences),
  s as (select doc_id, seq, p, case substr(seq, p, 1) when 'C' then '+' else '-' end as strand from p where substr(seq, p, 1) in ('C', 'G')),
  c as (select doc_id, p, strand, case when strand = '+' then substr(seq, greatest(p - 3, 1), 8 + least(p - 4, 0)) else {revcomp('substr(seq, greatest(p - 4, 1), 8 + least(p - 5, 0))')} end as context from s)
  select doc_id, cast(p as int) as end_, strand, context from c where substr(context, 4, 2) = 'CG' or (strand = '-' and p < 5) or p < 4""",
    "mate_consistency": ALN + """, a as (select *, pos + read_len - 1 as e, (flag & 16) <> 0 as neg, (flag & 128) <> 0 as second,
    (flag & (4 | 256)) = 0 and (flag & 1536) <> 1536 and not ((flag & 1) <> 0 and (flag & 2) = 0) as good,
    case when partkey % 3 = 0 then insert_size else 180 + read_name % 50 end as size from alignments where line <= 2 or partkey % 7 = 0),
  r as (select *, row_number() over (partition by read_name order by pos, second, e, neg) as rn, count(*) over (partition by read_name) as c from a),
  g as (select read_name, any_value(c) as c, bool_and(good) as good, max(size) as most, min(size) as least_, max(e) filter (where rn = 1) as e1, max(pos) filter (where rn = c) as s2,
    max(e) filter (where rn = c) as e2, bool_or(neg) filter (where rn = 1) as n1, bool_or(neg) filter (where rn = c) as n2, bool_or(second) filter (where rn = 1) as f1, bool_or(second) filter (where rn = c) as f2,
    max(pos) filter (where rn = 1) as s1 from r group by read_name),
  x as (select *, case when c <> 2 then 'records' when not good then 'flags' when not (e1 >= s1 and e1 <= e2 and s2 >= s1 and s2 <= e2 and f1 <> f2 and n1 <> n2) then 'orientation' when most > 220 then 'too_long' when least_ <> most then 'lengths_differ' else 'kept' end as reason from g)
  select reason, count(*) as n, cast(sum(read_name) as bigint) as names from x group by reason""",
}

"""DuckDB statements for the queries of ``queries_matrix``, written independently of the operators."""

from __future__ import annotations

from fragweave.plans.bindings import ctes

VALID = """valid as (select * from matrix where frag_len > 30 and frag_len < 500 and base_q > 5 and offset_ >= 0 and prior is not null)"""
STATS = """st as (select avg(frag_len) lm, stddev_samp(frag_len) ls, avg(norm_cov) cm, stddev_samp(norm_cov) cs,
  avg(frag_len / 2.0 - dist_end + 0.5) dm, stddev_samp(frag_len / 2.0 - dist_end + 0.5) ds from valid)"""
SCORED = """scored as (select v.*, (case when prior = 100 then prior - 0.01 when prior = 0 then prior + 0.01 else prior end) / 100 as p,
  (frag_len - lm) / ls as z_len, (norm_cov - cm) / cs as z_cov, (frag_len / 2.0 - dist_end + 0.5 - dm) / ds as z_dist from valid v, st)"""
FIRST = """firsts as (select * from scored qualify row_number() over (partition by read_name, offset_
  order by chr, start_, end_, frag_len, strand, methy_stat, norm_cov, base_q, dist_end, prior) = 1)"""
GAPS = """gaps as (select *, offset_ - coalesce(lag(offset_) over w, 0) as gap, row_number() over w as rn,
  case when methy_stat = 'u' then 0 else 1 end as obs, lag(case when methy_stat = 'u' then 0 else 1 end) over w as prev
  from firsts window w as (partition by read_name order by offset_))"""
OKREADS = """okreads as (select read_name from gaps group by read_name having max(gap) <= 500 and count(*) between {lo} and {hi})"""
BASE = "with " + ctes("matrix") + ", " + VALID
FRAG = BASE + ", " + STATS + ", " + SCORED + ", " + FIRST + ", " + GAPS
SITES = """sites as (select *, substring('CGA', start_ % 3 + 1, 1) as base, case start_ % 2 when 0 then '+' else '.' end as strand from
  (select distinct concat('chr', cast(p_partkey % 22 + 1 as varchar)) as chr, cast((p_partkey * 37) % 20000 as int) as start_,
   cast((p_partkey * 37) % 20000 + 1 as int) as end_ from part))"""
SPOTS = "spots as (select r_chr, r_lo, cast(r_lo + r_size // 10 as int) as r_hi, r_strand, r_id from regions)"
ROW = "chr, start_, end_, read_name, offset_, frag_len"


def p_value(r: str, n: str) -> str:
    """Two-sided p-value of Pearson r for whole degrees of freedom, from the finite series of Student's t."""
    even = (f"abs({r}) * list_sum(list_transform(range(0, cast(({n} - 2) // 2 as bigint)), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * pow(1 - {r} * {r}, k)))")
    odd = (f"2 / pi() * (asin(least(abs({r}), 1)) + case when {n} > 3 then abs({r}) * list_sum(list_transform(range(0, cast(({n} - 3) // 2 as bigint)), "
           f"lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(greatest(1 - {r} * {r}, 0), k + 0.5))) else 0 end)")
    return f"case when {r} is null or {n} < 3 then null when abs({r}) >= 1 then 0 when {n} % 2 = 0 then 1 - {even} else 1 - {odd} end"


def distance(a_lo: str, a_hi: str, strand: str, b_lo: str, b_hi: str) -> str:
    gaps = [f"({b_lo} - {a_lo})", f"({b_lo} - {a_hi})", f"({b_hi} - {a_lo})", f"({b_hi} - {a_hi})"]
    least = "least(" + ", ".join(f"abs{g}" for g in gaps) + ")"
    pick = "case " + " ".join(f"when abs{g} = {least} then {g}" for g in gaps) + " end"
    return (f"case when ({b_lo} between {a_lo} and {a_hi}) or ({b_hi} between {a_lo} and {a_hi}) then 0 "
            f"when {strand} = '-' then -({pick}) when {strand} = '+' then {pick} else {least} end")


def legacy_percentile(p: int) -> str:
    """Percentile at position p (n + 1) over the sorted list ``l`` of length ``n``."""
    pos = f"({p} / 100.0 * (n + 1))"
    return (f"round(case when {pos} < 1 then l[1] when {pos} >= n then l[n] else l[cast(floor({pos}) as bigint)] + ({pos} - floor({pos})) * "
            f"(l[cast(floor({pos}) as bigint) + 1] - l[cast(floor({pos}) as bigint)]) end, 5) as p{p}")


def pearson(n, sx, sy, sxx, syy, sxy) -> str:
    return (f"case when {n} >= 2 and {n} * {sxx} - {sx} * {sx} > 0 and {n} * {syy} - {sy} * {sy} > 0 then "
            f"({n} * {sxy} - {sx} * {sy}) / (sqrt({n} * {sxx} - {sx} * {sx}) * sqrt({n} * {syy} - {sy} * {sy})) end")


#: Position vectors of the tensor queries, worked out once a position.
TENSOR = "with " + ctes("matrix", "regions") + """, p as (select distinct r_chr as chr, unnest(range(r_lo + 1, r_lo + r_size + 1)) as pos from regions),
  f as (select chr, start_ + dist_end as fs, start_ + dist_end + frag_len as fe, max(strand) as strand from matrix where frag_len <= 400 group by all),
  d as (select p.chr, pos, count(*) filter (where strand = '+') as np, count(*) filter (where strand = '-') as nm from p join f on f.chr = p.chr and fs + 1 <= pos and fe >= pos group by all),
  c as (select chr, end_ as pos, max(prior) as methy from matrix group by all),
  t as (select p.chr, p.pos, substring('ACGTN', p.pos * 7 % 5 + 1, 1) as base, coalesce(methy, 0) as methy, cast(least(coalesce(np, 0), 12) as int) as a,
   cast(least(coalesce(nm, 0), 12 - least(coalesce(np, 0), 12)) as int) as b from p left join d on d.chr = p.chr and d.pos = p.pos left join c on c.chr = p.chr and c.pos = p.pos),
  v as (select *, case base when 'A' then '1.00,0.00,0.00,0.00' when 'T' then '0.00,1.00,0.00,0.00' when 'C' then '0.00,0.00,1.00,0.00' when 'G' then '0.00,0.00,0.00,1.00' else '0.25,0.25,0.25,0.25' end as fw,
   case base when 'T' then '1.00,0.00,0.00,0.00' when 'A' then '0.00,1.00,0.00,0.00' when 'G' then '0.00,0.00,1.00,0.00' when 'C' then '0.00,0.00,0.00,1.00' else '0.25,0.25,0.25,0.25' end as rv from t)"""

ORACLE = {
    "locus_methylation": BASE + """ select chr, start_, end_, count(*) filter (where methy_stat = 'm') as n_m, count(*) as n,
  100.0::double * count(*) filter (where methy_stat = 'm') / count(*) as methy_perc from valid group by all""",
    "matrix_moments": BASE + ", " + STATS + """ select (select count(*) from valid) as n, round(lm, 6) as len_mean, round(ls, 6) as len_sd,
  round(cm, 6) as cov_mean, round(cs, 6) as cov_sd, round(dm, 6) as dist_mean, round(ds, 6) as dist_sd from st""",
    "zscore_outlier_filter": BASE + ", " + STATS + ", " + SCORED + f""" select {ROW}, round(z_len, 6) as z_len, round(z_cov, 6) as z_cov,
  round(z_dist, 6) as z_dist from scored where z_len <= 1.5 and z_cov <= 1.5 and z_dist <= 1.5""",
    "prior_clip": BASE + ", " + STATS + ", " + SCORED + " select read_name, offset_, prior, round(p, 8) as p from scored",
    "first_per_offset": BASE + ", " + STATS + ", " + SCORED + ", " + FIRST + f""" select {ROW}, strand, methy_stat, norm_cov, base_q, dist_end, prior from firsts""",
    "fragment_gaps": FRAG + ' select read_name, offset_ as "offset", gap from gaps',
    "fragment_reject": FRAG + """ select read_name, cast(count(*) as int) as n, max(offset_) as last_offset,
  max(gap) <= 500 and count(*) between 2 and 6 as accepted from gaps group by read_name""",
    "initial_state_table": FRAG + ", " + OKREADS.format(lo=1, hi=1000) + """ select gap as dist, count(*) filter (where obs = 0) as n_u,
  count(*) filter (where obs = 1) as n_m, count(*) filter (where obs = 0) / count(*) as p_u, count(*) filter (where obs = 1) / count(*) as p_m
  from gaps join okreads using (read_name) where rn = 1 group by gap""",
    "transition_table": FRAG + ", " + OKREADS.format(lo=1, hi=1000) + """ select dist, n_uu, n_um, n_mu, n_mm, n_uu / nullif(n_uu + n_um, 0) as p_uu,
  n_um / nullif(n_uu + n_um, 0) as p_um, n_mu / nullif(n_mu + n_mm, 0) as p_mu, n_mm / nullif(n_mu + n_mm, 0) as p_mm from
  (select gap as dist, count(*) filter (where prev = 0 and obs = 0) as n_uu, count(*) filter (where prev = 0 and obs = 1) as n_um,
   count(*) filter (where prev = 1 and obs = 0) as n_mu, count(*) filter (where prev = 1 and obs = 1) as n_mm
   from gaps join okreads using (read_name) where rn > 1 group by gap)""",
    "region_semi": "with " + ctes("matrix", "regions") + f""" select {ROW} from matrix where exists
  (select 1 from regions where r_chr = chr and r_lo <= end_ and r_hi >= start_)""",
    "region_anti": "with " + ctes("matrix", "regions") + ", " + SPOTS + f""" select {ROW} from matrix where not exists
  (select 1 from spots where r_chr = chr and r_lo <= end_ and r_hi >= start_)""",
    "interval_inner_join": "with " + ctes("matrix", "regions") + """ select chr, start_, end_, read_name, offset_, r_id, r_lo, r_hi
  from matrix join regions on r_chr = chr and r_lo <= end_ and r_hi >= start_""",
    "overlap_flag": "with " + ctes("matrix", "regions") + f""", s as (select distinct chr, start_, end_ from matrix),
  f as (select chr, start_, end_, max(cast(r_strand = '+' as int)) as p, max(cast(r_strand = '-' as int)) as m, max(cast(r_strand = '.' as int)) as o
   from s join regions on r_chr = chr and r_lo <= end_ and r_hi >= start_ group by all)
  select {ROW}, coalesce(p, 0) as in_plus, coalesce(m, 0) as in_minus, coalesce(o, 0) as in_none from matrix left join f using (chr, start_, end_)""",
    "track_mean": "with " + ctes("matrix", "signal") + f""", s as (select distinct chr, start_, end_ from matrix),
  a as (select chr, start_, end_, avg(s_value) as v from s join signal on s_chr = chr and s_pos between greatest(start_ - 100, 1) and end_ + 100 group by all),
  b as (select chr, start_, end_, sum(s_value) / 1001 as v from s join signal on s_chr = chr and s_pos between greatest(start_ - 500, 1) and end_ + 500 group by all)
  select {ROW}, round(a.v, 5) as mean_100, round(b.v, 5) as mean0_500 from matrix left join a using (chr, start_, end_) left join b using (chr, start_, end_)""",
    "track_record_mean": "with " + ctes("matrix", "regions") + f""", s as (select distinct chr, start_, end_ from matrix),
  a as (select chr, start_, end_, avg(r_value) as x from s join regions on r_chr = chr and r_hi >= greatest(start_ - 50, 1) and r_lo <= end_ + 50 group by all)
  select {ROW}, round(a.x + 1e-8, 5) as v from matrix left join a using (chr, start_, end_)""",
    "track_base_mean": "with " + ctes("matrix", "regions") + f""", s as (select distinct chr, start_, end_ from matrix),
  o as (select chr, start_, end_, r_value, least(r_hi, end_ + 50) - greatest(r_lo, start_ - 50, 1) + 1 as w
   from s join regions on r_chr = chr and r_hi >= greatest(start_ - 50, 1) and r_lo <= end_ + 50),
  a as (select chr, start_, end_, sum(r_value * w) / sum(w) as x, sum(r_value * w) / 101 as y from o group by all)
  select {ROW}, round(a.x + 1e-8, 5) as v, round(a.y + 1e-8, 5) as v0 from matrix left join a using (chr, start_, end_)""",
    "nearest_feature": "with " + ctes("matrix", "regions") + ", " + SPOTS + f""",
  f as (select r_chr, r_lo, r_hi, min(r_strand) as r_strand from spots group by all),
  s as (select distinct chr, start_, end_ from matrix),
  up as (select chr, start_, end_, max((r_lo, r_hi, r_strand)) as f from s join f on r_chr = chr and (r_lo < start_ or (r_lo = start_ and r_hi <= end_)) group by all),
  dn as (select chr, start_, end_, min((r_lo, r_hi, r_strand)) as f from s join f on r_chr = chr and (r_lo > start_ or (r_lo = start_ and r_hi >= end_)) group by all),
  d as (select s.*, case when up.f is not null then {distance("up.f[1]", "up.f[2]", "up.f[3]", "s.start_", "s.end_")} end as u,
    case when dn.f is not null then {distance("dn.f[1]", "dn.f[2]", "dn.f[3]", "s.start_", "s.end_")} end as v
    from s left join up using (chr, start_, end_) left join dn using (chr, start_, end_))
  select {ROW}, cast(coalesce(case when v is null or abs(u) < abs(v) then u else v end, 2147483647) as int) as distance from matrix join d using (chr, start_, end_)""",
    "nearest_other_site": "with " + SITES + f""",
  q as (select *, case base when 'C' then 1 else 2 end as b, case base when 'C' then 2 else 1 end as a from sites where base in ('C', 'G')),
  up as (select q.chr, q.start_, max((s.start_, s.end_, s.strand)) as f from q join sites s on s.chr = q.chr and s.start_ <= q.start_ - q.b group by all),
  dn as (select q.chr, q.start_, min((s.start_, s.end_, s.strand)) as f from q join sites s on s.chr = q.chr and s.start_ >= q.start_ + q.a group by all),
  d as (select q.*, case when up.f is not null then {distance("up.f[1]", "up.f[2]", "up.f[3]", "q.start_", "q.end_")} end as u,
    case when dn.f is not null then {distance("dn.f[1]", "dn.f[2]", "dn.f[3]", "q.start_", "q.end_")} end as v
    from q left join up using (chr, start_) left join dn using (chr, start_))
  select chr, start_, base, cast(case when v is null or abs(u) < abs(v) then u else v end as int) as nearest from d""",
    "annotated_sites": "with " + SITES + ", " + ctes("regions", "signal") + ", " + SPOTS + f""",
  q as (select *, case base when 'C' then 1 else 2 end as b, case base when 'C' then 2 else 1 end as a from sites where base in ('C', 'G')),
  s as (select chr, start_, end_ from q),
  up0 as (select q.chr, q.start_, max((s.start_, s.end_, s.strand)) as f from q join sites s on s.chr = q.chr and s.start_ <= q.start_ - q.b group by all),
  dn0 as (select q.chr, q.start_, min((s.start_, s.end_, s.strand)) as f from q join sites s on s.chr = q.chr and s.start_ >= q.start_ + q.a group by all),
  d0 as (select q.chr, q.start_, case when up0.f is not null then {distance("up0.f[1]", "up0.f[2]", "up0.f[3]", "q.start_", "q.end_")} end as u,
    case when dn0.f is not null then {distance("dn0.f[1]", "dn0.f[2]", "dn0.f[3]", "q.start_", "q.end_")} end as v from q left join up0 using (chr, start_) left join dn0 using (chr, start_)),
  fl as (select chr, start_, max(cast(r_strand = '+' as int)) as p, max(cast(r_strand = '-' as int)) as m from s join regions on r_chr = chr and r_lo <= end_ and r_hi >= start_ group by all),
  f as (select r_chr, r_lo, r_hi, min(r_strand) as r_strand from spots group by all),
  up as (select chr, start_, end_, max((r_lo, r_hi, r_strand)) as f from s join f on r_chr = chr and (r_lo < start_ or (r_lo = start_ and r_hi <= end_)) group by all),
  dn as (select chr, start_, end_, min((r_lo, r_hi, r_strand)) as f from s join f on r_chr = chr and (r_lo > start_ or (r_lo = start_ and r_hi >= end_)) group by all),
  d as (select s.*, case when up.f is not null then {distance("up.f[1]", "up.f[2]", "up.f[3]", "s.start_", "s.end_")} end as u,
    case when dn.f is not null then {distance("dn.f[1]", "dn.f[2]", "dn.f[3]", "s.start_", "s.end_")} end as v
    from s left join up using (chr, start_, end_) left join dn using (chr, start_, end_)),
  a as (select chr, start_, avg(s_value) filter (where s_pos between greatest(start_ - 100, 1) and end_ + 100) as x, avg(s_value) filter (where s_pos between greatest(start_ - 20, 1) and end_ + 20) as z,
    sum(s_value) / 1001 as y from s join signal on s_chr = chr and s_pos between greatest(start_ - 500, 1) and end_ + 500 group by all),
  o as (select chr, start_, r_value, least(r_hi, end_ + 50) - greatest(r_lo, start_ - 50, 1) + 1 as w from s join regions on r_chr = chr and r_hi >= greatest(start_ - 50, 1) and r_lo <= end_ + 50),
  bm as (select chr, start_, sum(r_value * w) / sum(w) as v from o group by all)
  select s.chr, s.start_, s.end_, cast(case when d0.v is null or abs(d0.u) < abs(d0.v) then d0.u else d0.v end as int) as nearest_cpg, coalesce(p, 0) as in_plus, coalesce(m, 0) as in_minus,
    cast(coalesce(case when d.v is null or abs(d.u) < abs(d.v) then d.u else d.v end, 2147483647) as int) as distance, round(a.z, 4) as prior, round(a.x, 4) as mean_100, round(a.y, 4) as mean0_500, round(bm.v, 4) as v
  from s left join d0 using (chr, start_) left join fl using (chr, start_) left join d using (chr, start_) left join a using (chr, start_) left join bm using (chr, start_)""",
    "nearest_by_rank": "with " + SITES + """,
  l as (select *, lag(start_, 1) over w as m1, lag(start_, 2) over w as m2, lead(start_, 1) over w as q1, lead(start_, 2) over w as q2
   from sites window w as (partition by chr order by start_, end_)),
  g as (select *, case base when 'C' then m1 when 'G' then m2 end as m, case base when 'C' then q2 when 'G' then q1 end as q from l)
  select chr, start_, base, cast(least(least(abs(start_ - m), abs(start_ - m - 1)), least(abs(start_ - q), abs(start_ + 1 - q))) as int) as nearest from g""",
    "interval_distance": "with " + ctes("alignments", "regions") + f""", t as (select *, pos as start_, pos + read_len as end_ from alignments join regions on r_id = partkey)
  select read_name, line, start_, r_lo, r_hi, r_strand, cast({distance("r_lo", "r_hi", "r_strand", "start_", "end_")} as int) as distance,
  cast(case when chr <> r_chr then 2147483647 when r_lo = end_ + 1 or start_ = r_hi + 1 then 0
    else case when r_strand = '-' then -1 else 1 end * list_reduce([start_ - r_lo, start_ - r_hi, end_ - r_lo, end_ - r_hi], lambda a, x: case when abs(x) < abs(a) then x else a end) end as int) as located_distance
  from t""",
    "window_corr_dist": "with " + ctes("matrix", "sizes") + f""",
  one as (select * from matrix qualify row_number() over (partition by chr, start_, end_ order by read_name desc, offset_ desc, dist_end desc, frag_len desc, methy_stat desc) = 1),
  w as (select chr, unnest(range(0, length - 1000, 500)) as w_start from sizes where chr in (select chr from matrix)),
  s as (select w.chr, w_start, count(start_) as n, cast(sum(case when methy_stat = 'u' then 0 else 1 end) as double) as sx, cast(sum(dist_end) as double) as sy,
    cast(sum(case when methy_stat = 'u' then 0 else 1 end) as double) as sxx, cast(sum(dist_end * dist_end) as double) as syy,
    cast(sum(case when methy_stat = 'u' then 0 else dist_end end) as double) as sxy
    from w left join one on one.chr = w.chr and start_ <= w_start + 1000 and end_ >= w_start group by all),
  r as (select *, case when n >= 3 then {pearson("n", "sx", "sy", "sxx", "syy", "sxy")} end as r from s),
  p as (select *, {p_value("r", "n")} as p from r)
  select chr, w_start, w_start + 1000 as w_end, concat(chr, ':', w_start, '-', w_start + 1000) as name,
  case when p < 0.05 then case when r > 0 then 1 else 2 end else 0 end as score, round(r, 6) as cor, round(p, 6) as pvalue, n from p""",
    "window_corr_cov": "with " + ctes("matrix", "sizes") + f""",
  lev as (select *, prior / 100 as fraction, base_q + 1 as n_reads from matrix),
  one as (select *, cast(trunc(fraction * n_reads) as bigint) as ones from lev qualify row_number() over (partition by chr, start_, end_
   order by read_name desc, offset_ desc, dist_end desc, frag_len desc, n_reads desc, fraction desc, norm_cov desc) = 1),
  w as (select chr, unnest(range(0, length - 1000, 1000)) as w_start from sizes),
  x as (select w.chr, w_start, n_reads, ones, norm_cov from w join one on one.chr = w.chr and start_ <= w_start + 1000 and end_ >= w_start),
  e as (select chr, w_start, unnest(list_concat(list_transform(range(0, ones), lambda i: 1), list_transform(range(0, n_reads - ones), lambda i: 0))) as m, norm_cov as c from x),
  s as (select chr, w_start, count(*) as n, corr(m, c) as r, stddev_samp(m) as sm, stddev_samp(c) as sc from e group by all)
  select concat(chr, ':', w_start, '-', w_start + 1000) as name, round(r, 6) as cor, round({p_value("r", "n")}, 6) as pvalue, n from s where n >= 3 and sm > 0 and sc > 0""",
    "window_fraglen_stats": "with " + ctes("matrix", "regions") + """, w as (select distinct r_chr as chr, r_lo as w_lo, r_hi as w_hi from regions),
  o as (select w.chr, w_lo, w_hi, read_name, min(frag_len) as l from w join matrix m on m.chr = w.chr and start_ <= w_hi and end_ >= w_lo group by all),
  t as (select chr, w_lo, w_hi, count(*) as n, avg(l) as a, coalesce(stddev_samp(l), 0) as s, median(l) as d from o group by all)
  select w.chr, w.w_lo, w.w_hi, coalesce(n, 0) as num_frag, round(a, 5) as len_mean, round(s, 5) as len_sd, d as len_median
  from w left join t on t.chr = w.chr and t.w_lo = w.w_lo and t.w_hi = w.w_hi""",
    "window_value_stats": "with " + ctes("signal", "regions") + """, w as (select distinct r_chr as chr, r_lo as w_lo, r_hi as w_hi from regions),
  t as (select w.chr, w_lo, w_hi, count(*) as n, avg(s_value) as a, coalesce(stddev_samp(s_value), 0) as s, median(s_value) as d
   from w join signal on s_chr = w.chr and s_pos between w_lo and w_hi group by all)
  select w.chr, w.w_lo, w.w_hi, coalesce(n, 0) as n, round(a, 5) as value_mean, round(s, 5) as value_sd, round(d, 5) as value_median
  from w left join t on t.chr = w.chr and t.w_lo = w.w_lo and t.w_hi = w.w_hi""",
    "norm_coverage": BASE + """ select chr, start_, end_, count(*) as n_reads, count(*) / ((select count(*) from valid) / 1e6) as norm_cov
  from valid group by chr, start_, end_ having count(*) < 8""",
    "mate_dedup": "with " + ctes("alignments") + """, a as (select chr, cast(partkey % 50 as int) as start_, read_name % 40 as read_name, base, qual, (flag & 128) <> 0 as second, line, partkey from alignments),
  g as (select *, min(base) over w = max(base) over w as same from a window w as (partition by chr, start_, read_name))
  select chr, start_, read_name, base, qual, second, line, partkey from g qualify row_number() over (partition by chr, start_, read_name
   order by case when same then 0 else -qual end, case when same then false else second end, line, partkey, base, qual, second) = 1""",
    "feature_rows": "with " + ctes("alignments") + """, a as (select *, cast(partkey % 50 as int) as start_, cast(partkey % 50 + 1 as int) as end_, (flag & 16) <> 0 as neg, (flag & 128) <> 0 as second from alignments),
  d as (select chr, start_, end_, count(*) / ((select count(*) from a) / 1e6) as norm_cov from a group by all having count(*) < 75),
  g as (select *, min(base) over w = max(base) over w as same from a window w as (partition by chr, start_, end_, ref, read_name)),
  b as (select * from g qualify row_number() over (partition by chr, start_, end_, ref, read_name order by case when same then 0 else -qual end,
   case when same then false else second end, pos, mate_pos, insert_size, read_len, read_offset, neg, base, qual, second) = 1),
  f as (select *, neg <> second as mol, case when neg <> second then case when ref = 'G' and base = 'G' then 'm' when ref = 'G' and base = 'A' then 'u' end
    else case when ref = 'C' and base = 'C' then 'm' when ref = 'C' and base = 'T' then 'u' end end as methy_stat from b)
  select f.chr, f.start_, f.end_, read_name, insert_size as frag_len, case when mol then '-' else '+' end as strand, methy_stat, qual as base_q,
  cast(case when pos < mate_pos then read_offset else insert_size - (read_len - read_offset) end as int) as offset_,
  cast(case when pos < mate_pos then read_offset else read_len - read_offset end as int) as dist_end, round(norm_cov, 6) as norm_cov
  from f join d using (chr, start_, end_) where qual > 5 and methy_stat is not null and insert_size > 0 and insert_size <= 1000""",
    "reads_at_sites": "with " + ctes("alignments") + ", " + SITES + """ select a.chr as a_chr, read_name, line, partkey, pos, start_ + 1 as c_lo, s.base as c_base
  from alignments a join sites s on s.chr = a.chr and pos <= end_ and pos + read_len - 1 >= start_ + 1""",
    "bed_fragment_matrix": "with " + ctes("matrix") + ", " + SITES + """,
  f as (select chr, start_ + dist_end as fs, start_ + dist_end + frag_len as fe, concat(read_name, '/', offset_) as nm, base_q * 10 as mq, strand from matrix),
  g as (select * from f where mq >= 30 and fe - fs <= 500),
  s as (select chr, start_, end_, case when strand = '.' then '-' else strand end as strand, cast(start_ % 101 as double) as prior from sites),
  p as (select s.*, fs, fe, nm, g.strand as fstrand, count(*) over (partition by s.chr, s.start_, s.end_) as n from s join g on g.chr = s.chr and fs + 1 <= end_ and fe >= start_ + 1)
  select chr, start_, end_, nm as read_name, cast(fe - fs + 1 as int) as frag_len, fstrand as strand, 'm' as methy_stat,
  round(n / ((select count(*) from g) / 1e6), 6) as norm_cov, 40 as base_q, cast(case when fstrand = '-' then fe - end_ + 1 else end_ - fs + 1 end as int) as offset_,
  cast(least(end_ - fs + 1, fe - end_ + 1) as int) as dist_end, prior from p where n <= 40 and strand = fstrand""",
    "site_bedgraph": "with " + ctes("matrix") + ", " + SITES + """ select s.chr, s.start_, s.end_, count(*) filter (where methy_stat = 'm') / count(*) as fraction, count(*) as depth
  from sites s join matrix m on m.chr = s.chr and m.start_ + 1 <= s.end_ and m.end_ + 99 >= s.start_ + 1 group by s.chr, s.start_, s.end_""",
    "site_distribution": BASE + """, v as (select chr, cast(floor(start_ / 1000) as int) as start_, frag_len, offset_, base_q from valid),
  long as (select chr, start_, 'frag_len' as metric, cast(frag_len as double) as x from v union all select chr, start_, 'offset', offset_ from v
   union all select chr, start_, 'offset_ratio', offset_ / frag_len from v union all select chr, start_, 'base_q', base_q from v),
  g as (select chr, start_, metric, count(*) as n, avg(x) as a, stddev_samp(x) as s, list(x order by x) as l from long group by all)
  select chr, start_, metric, n, round(a, 5) as mean, round(s, 5) as sd, """ + ", ".join(legacy_percentile(p) for p in range(10, 101, 10)) + " from g",
    "site_methylation": BASE + """ select chr, start_, end_, count(*) filter (where methy_stat = 'm') as n_m, count(*) filter (where methy_stat = 'u') as n_u, count(*) as n_used,
  100.0::double * count(*) filter (where methy_stat = 'm') / count(*) as methy_perc, 100.0::double * count(*) filter (where strand = '-') / count(*) as minus_perc from valid group by chr, start_, end_""",
    "pair_concordance": BASE + """, v as (select *, (dist_end % 3) * 90 as d, row_number() over () as id, count(*) over (partition by chr, start_, end_) as k from valid),
  p as (select a.methy_stat as x, b.methy_stat as y from v a join v b on a.chr = b.chr and a.start_ = b.start_ and a.end_ = b.end_ and a.strand = b.strand and a.id < b.id
   and a.read_name <> b.read_name and abs(a.offset_ - b.offset_) = 90 and abs(a.d - b.d) = 90 and a.k >= 3)
  select count(*) as n_pairs, count(*) filter (where x = y) as n_concordant, count(*) filter (where x = 'm' and y = 'm') as n_methylated,
  count(*) filter (where x = 'u' and y = 'u') as n_unmethylated, 100.0::double * count(*) filter (where x = y) / count(*) as concordance_perc from p""",
    "fragment_summary": "with " + ctes("matrix") + """, SUMMARY select * from kept""",
    "methylation_by_length": "with " + ctes("matrix") + """, SUMMARY, x as (select frag_len, 100.0::double * (m_cg / nullif(m_cg + u_cg, 0)) as v from kept where m_cg + u_cg > 0)
  select frag_len, round(avg(v), 5) as methy_mean, round(coalesce(stddev_samp(v), 0), 5) as methy_sd, round(median(v), 5) as methy_median, count(*) as n from x group by frag_len""",
    "length_by_methylation": "with " + ctes("matrix") + """, SUMMARY, x as (select frag_len, cast(floor(10 * (m_cg / (m_cg + u_cg))) as int) * 10 as t from kept where m_cg + u_cg > 0)
  select t as methy_tenth, round(avg(frag_len), 5) as len_mean, round(coalesce(stddev_samp(frag_len), 0), 5) as len_sd, round(median(frag_len), 5) as len_median, count(*) as n from x group by t""",
    "cpg_density": "with " + ctes("matrix") + f""", g as (select read_name, count(*) as n_cpg, max((chr, start_, end_, frag_len))[4] as last_len from matrix group by read_name)
  select {ROW}, n_cpg, n_cpg / last_len as cpg_density from matrix join g using (read_name)""",
    "position_corr": FRAG + """, c as (select read_name, cast(offset_ // 90 - 1 as int) as pos, cast(obs as double) as v from gaps),
  p as (select b.pos, a.v as x, b.v as y from c a join c b using (read_name) where a.pos = 0)
  select pos, count(*) as n, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) as r from p group by pos""",
    "ref_methylation_by_track": FRAG + ", " + ctes("signal") + """, c as (select read_name, chr, start_ + offset_ as pos, obs as state from gaps),
  t as (select s_type as track, s_chr as chr, cast(s_pos % 20000 as int) as pos, cast(trunc(round(avg(s_value) * 2, 3)) as int) as m, cast(trunc(round(max(s_value) * 3 + 1, 3)) as int) as k from signal group by all),
  own as (select read_name, count(*) as n_cpg, round(avg(state), 8) as methy_obs from c group by read_name having count(*) >= 2),
  h as (select read_name, track, sum(m) as m, sum(k) as k from c join t using (chr, pos) group by all),
  w as (select read_name, """ + ", ".join(
        f"cast(coalesce(sum(m) filter (where track = '{n}'), 0) as bigint) as m_{n}, cast(coalesce(sum(k) filter (where track = '{n}'), 0) as bigint) as k_{n}"
        for n in ("click", "error", "purchase", "signup", "view")) + """ from own left join h using (read_name) group by read_name)
  select read_name, n_cpg, methy_obs, """ + ", ".join(f"m_{n} / nullif(k_{n}, 0) as ref_{n}, k_{n} as cov_{n}" for n in ("click", "error", "purchase", "signup", "view"))
    + " from own join w using (read_name)",
    "fragments_near_sites": "with " + ctes("alignments") + ", " + SITES + """ select concat(read_name, '/', line, '/', partkey) as id, chr, pos, pos + 3 as pos_end, mate_pos, mate_pos + 3 as mate_end
  from alignments a where exists (select 1 from sites s where s.chr = a.chr and ((pos <= s.end_ and pos + 3 >= s.start_ + 1) or (mate_pos <= s.end_ and mate_pos + 3 >= s.start_ + 1)))""",
    "position_tensor": TENSOR + """  select chr, cast(pos as int) as pos, base, methy, a as n_plus, b as n_minus,
   rtrim(repeat(fw || ',', a) || repeat(rv || ',', b) || repeat('0.00,0.00,0.00,0.00,', 12 - a - b), ',') as vectors from v""",
    "window_tensor": TENSOR + """, u as (select distinct r_chr as chr, r_lo as s, r_lo + r_size as e from regions),
  o as (select *, row_number() over (order by chr, s, e) - 1 as w, coalesce(sum(e - s) over (order by chr, s, e rows between unbounded preceding and 1 preceding), 0) as first_row from u),
  x as (select *, unnest(range(s + 1, e + 1)) as spot from o)
  select cast(first_row + spot - s - 1 as bigint) as row, w as window, chr, cast(pos as int) as pos, base, methy, a as n_plus, b as n_minus,
   rtrim(repeat(fw || ',', a) || repeat(rv || ',', b) || repeat('0.00,0.00,0.00,0.00,', 12 - a - b), ',') as vectors from x join v using (chr) where pos = spot""",
    "bedgraph_project": BASE + """, l as (select case when chr = 'chr22' then 'MT' else regexp_replace(chr, '^chr', '') end as chr, start_, end_, 100.0::double * count(*) filter (where methy_stat = 'm') / count(*) as methy,
   count(*) filter (where methy_stat = 'm') as m, count(*) as n from valid group by all)
  select 'methy' as track, chr, start_, end_, methy as value from l union all select 'methy_count', chr, start_, end_, cast(m as double) from l union all select 'cov', chr, start_, end_, cast(n as double) from l""",
}
_SUMMARY = """s as (select read_name, arg_min(frag_len, (offset_, frag_len)) as frag_len,
  cast(sum(case when methy_stat = 'm' then base_q else 0 end) as bigint) as m_cg, cast(sum(case when methy_stat = 'u' then base_q else 0 end) as bigint) as u_cg,
  cast(sum(case when methy_stat = 'm' and base_q > 7 then 1 else 0 end) as bigint) as m_ch,
  cast(sum(case when methy_stat = 'u' or base_q < 6 then offset_ // 9 else 0 end) as bigint) as u_ch from matrix group by read_name),
  kept as (select * from s where frag_len <= 500 and (m_ch + u_ch = 0 or m_ch / (m_ch + u_ch) <= 0.1))"""
ORACLE = {k: v.replace("SUMMARY", _SUMMARY) for k, v in ORACLE.items()}
ORACLE["region_anti_shuffled"] = ORACLE["region_anti"]

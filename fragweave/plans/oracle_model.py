"""DuckDB statements for the queries of ``queries_model``.

The recursions run as recursive statements, one step per point of a fragment; the fixed model is
stated in closed form.
"""

from __future__ import annotations

from fragweave.plans.oracle_matrix import BASE, FRAG, OKREADS, SCORED, STATS, p_value


def pdf(x: str, mu: float, var: float) -> str:
    return f"exp(-0.5 * pow({x} - ({mu}), 2) / {var}) / sqrt(2 * pi() * {var})"


S_U = "exp(" + " * ".join((pdf("z_len", -0.5, 1.0), pdf("z_cov", 0.2, 1.5), pdf("z_dist", -0.6, 0.8))) + ")"
S_M = "exp(" + " * ".join((pdf("z_len", 0.4, 1.2), pdf("z_cov", -0.1, 1.0), pdf("z_dist", 0.7, 0.9))) + ")"
POST_M = "(sm * (0.05 + p * 0.9)) / (sm * (0.05 + p * 0.9) + su * (0.95 - p * 0.9))"


def seq(lo: int) -> str:
    """Points of accepted fragments with scores and the tables at their distance."""
    return FRAG + ", " + OKREADS.format(lo=lo, hi=1000) + f""",
  sc as (select g.*, {S_U} as su, {S_M} as sm, 0.3 + 0.4 * gap / 500 as pim, 0.9 - 0.5 * gap / 500 as auu, 0.85 - 0.4 * gap / 500 as amm,
   count(*) over (partition by read_name) as len from gaps g join okreads using (read_name)),
  pt as (select *, {POST_M} as post_m from sc)"""


def _prefer(du: str, dm: str, threshold: str) -> str:
    return f"(exp(-({dm})) / (exp(-({du})) + exp(-({dm}))) > exp(-({du})) / (exp(-({du})) + exp(-({dm}))) + {threshold})"


def decoded(thresholds: str = "0.0") -> str:
    """Recursive decode: ``d`` carries both scores and the two best paths so far as strings."""
    du_u = "w.du + ln(w.su) - ln(1 - w.post_m) - ln(b.auu)"
    dm_u = "w.dm + ln(w.sm) - ln(w.post_m) - ln(1 - b.amm)"
    du_m = "w.du + ln(w.su) - ln(1 - w.post_m) - ln(1 - b.auu)"
    dm_m = "w.dm + ln(w.sm) - ln(w.post_m) - ln(b.amm)"
    to_u, to_m = _prefer(du_u, dm_u, "w.th"), _prefer(du_m, dm_m, "w.th")
    return f""", th as (select unnest([{thresholds}]) as th),
  w as (select th, read_name, rn, len, su, sm, post_m, -ln(1 - pim) - ln(su) as du, -ln(pim) - ln(sm) as dm, '' as pu, '' as pm from pt, th where rn = 1
   union all
   select w.th, b.read_name, b.rn, b.len, b.su, b.sm, b.post_m,
    case when {to_u} then w.dm - ln(1 - b.amm) else w.du - ln(b.auu) end - ln(b.su), case when {to_m} then w.dm - ln(b.amm) else w.du - ln(1 - b.auu) end - ln(b.sm),
    case when {to_u} then w.pm || '1' else w.pu || '0' end, case when {to_m} then w.pm || '1' else w.pu || '0' end
   from w join pt b on b.read_name = w.read_name and b.rn = w.rn + 1),
  fin as (select th, read_name, len, case when {_prefer('du', 'dm', 'th')} then pm || '1' else pu || '0' end as path, case when {_prefer('du', 'dm', 'th')} then -dm else -du end as lnp from w where rn = len),
  dec as (select th, pt.read_name, offset_, chr, start_, end_, obs, p, cast(substr(path, cast(rn as int), 1) as int) as state from pt join fin using (read_name))"""


def recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


POINTS = recursive(seq(1) + decoded())
PRED = POINTS + """, pr as (select chr, start_, end_, 100.0::double * count(*) filter (where state = 1) / count(*) as methy_perc_predict, count(*) filter (where state = 1) as methy_count_predict,
  count(*) as total_count_predict, 100.0::double * count(*) filter (where obs = 1) / count(*) as methy_perc_obs, count(*) filter (where obs = 1) as methy_count_obs, count(*) as total_count_obs from dec group by chr, start_, end_)"""
#: Forward and backward passes, and the expected transitions of every step.
PASSES = """,
  fw as (select read_name, rn, len, gap, auu, amm, su, sm, (1 - pim) * su as xu, pim * sm as xm from pt where rn = 1
   union all select b.read_name, b.rn, b.len, b.gap, b.auu, b.amm, b.su, b.sm, (w.xu * b.auu + w.xm * (1 - b.amm)) / (w.xu + w.xm) * b.su, (w.xu * (1 - b.auu) + w.xm * b.amm) / (w.xu + w.xm) * b.sm
   from fw w join pt b on b.read_name = w.read_name and b.rn = w.rn + 1),
  al as (select *, xu + xm as c, xu / (xu + xm) as fu, xm / (xu + xm) as fm from fw),
  bw as (select read_name, rn, 1 / c as bu, 1 / c as bm from al where rn = len
   union all select a.read_name, a.rn, (n.auu * n.su * w.bu + (1 - n.auu) * n.sm * w.bm) / a.c, ((1 - n.amm) * n.su * w.bu + n.amm * n.sm * w.bm) / a.c
   from bw w join al a on a.read_name = w.read_name and a.rn = w.rn - 1 join al n on n.read_name = w.read_name and n.rn = w.rn),
  x as (select n.read_name, n.rn, n.len, n.gap, a.gap as gap0, a.fu * n.auu * n.su * b.bu as uu, a.fu * (1 - n.auu) * n.sm * b.bm as um, a.fm * (1 - n.amm) * n.su * b.bu as mu, a.fm * n.amm * n.sm * b.bm as mm
   from al n join al a on a.read_name = n.read_name and a.rn = n.rn - 1 join bw b on b.read_name = n.read_name and b.rn = n.rn),"""


def mixture(x: str, mu: float, var: float) -> tuple[str, str]:
    """Both weighted normals of ``_two_component_model`` for one feature."""
    return f"0.6 * {pdf(x, mu - 0.5, var)}", f"0.4 * {pdf(x, mu + 0.4, var * 1.5)}"


FEATURE = {"z_len": ((-0.5, 1.0), (0.4, 1.2)), "z_cov": ((0.2, 1.5), (-0.1, 1.0)), "z_dist": ((-0.6, 0.8), (0.7, 0.9))}
MIX_U, MIX_M = ("exp(" + " * ".join("(" + " + ".join(mixture(x, *p[i])) + ")" for x, p in FEATURE.items()) + ")" for i in (0, 1))


def mixture_moments() -> str:
    """Weights, first and second moments about the old means of every component, from the state weights of every point."""
    parts = []
    for f, (x, p) in enumerate(FEATURE.items()):
        for i in (0, 1):
            both = mixture(x, *p[i])
            for c in (0, 1):
                mu = p[i][0] + (-0.5, 0.4)[c]
                w = f"g{i} * ({both[c]}) / ({both[0]} + {both[1]})"
                parts.append(f"select {f} as f, {i} as i, {c} as c, sum({w}) as w, sum({w} * ({x} - ({mu}))) as s1, sum({w} * pow({x} - ({mu}), 2)) as s2, {mu}::double as mu, sum(g{i}) as g from gp")
    return " union all ".join(parts)


VEC = """with v as (select vec_id, unnest(range(64)) as sample, unnest(embedding) as e from embeddings),
  c as (select vec_id, sample, abs(e::double) * (((vec_id * 7 + sample * 3) % 101) / 1000.0::double) as methylated, ((vec_id * 7 + sample * 3) % 101) / 1000.0::double as coverage from v),
  l as (select vec_id, sample, case when coverage * 1000 >= 10 then methylated / coverage end as level from c)"""

ORACLE = {
    "emission_score": BASE + ", " + STATS + ", " + SCORED + f""", s as (select *, {S_U} as su, {S_M} as sm from scored)
  select read_name, offset_, prior, round(su, 7) as s_u, round(sm, 7) as s_m, round({POST_M}, 7) as posterior_m from s""",
    "viterbi_decode": POINTS + " select read_name, offset_, chr, start_, end_, obs, state from dec",
    "predictions": PRED + " select * from pr",
    "prediction_correlation": PRED + f""", c as (select count(*) as n, corr(methy_perc_predict, methy_perc_obs) as r from pr)
  select n, round(r, 7) as r, round(greatest({p_value('r', 'n')}, 0), 7) as p from c""",
    "confusion": POINTS + """, c as (select count(*) as n, count(*) filter (where obs = state) as n_correct, count(*) filter (where obs = 1) as n_m, count(*) filter (where obs = 1 and state = 1) as n_m_correct,
   count(*) filter (where obs = 0) as n_u, count(*) filter (where obs = 0 and state = 0) as n_u_correct from dec)
  select *, 100.0::double * n_correct / n as n_accuracy, 100.0::double * n_m_correct / n_m as n_m_accuracy, 100.0::double * n_u_correct / n_u as n_u_accuracy from c""",
    "sequence_likelihood": POINTS + " select round(sum(lnp / len), 3) as likelihood, count(*) as n_fragments from fin",
    # The thresholds of the receiver operating characteristic.
    "roc_sweep": recursive(seq(1) + decoded("-1, -0.999, -0.99, -0.95, -0.9, -0.8, -0.7, -0.5, -0.1, 0.0::double, 0.1, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999, 1.0")) + """ select cast(th as double) as threshold, count(*) filter (where obs = 1) as n_m, count(*) filter (where obs = 0) as n_u,
  count(*) filter (where obs = 0 and state = 1) / count(*) filter (where obs = 0) as fpr, count(*) filter (where obs = 1 and state = 1) / count(*) filter (where obs = 1) as tpr from dec group by th""",
    "expectation_step": recursive(seq(2)) + """""" + PASSES + """
  o as (select 'xi' as kind, gap as dist, 0 as i, 0 as j, sum(uu) as v from x group by gap union all select 'xi', gap, 0, 1, sum(um) from x group by gap
   union all select 'xi', gap, 1, 0, sum(mu) from x group by gap union all select 'xi', gap, 1, 1, sum(mm) from x group by gap
   union all select 'pi', gap0, 0, 0, sum(uu + um) from x where rn = 2 group by gap0 union all select 'pi', gap0, 1, 0, sum(mu + mm) from x where rn = 2 group by gap0
   union all select 'gamma', 0, 0, 0, sum(uu + um) + sum(case when rn = len then uu + mu else 0 end) from x union all select 'gamma', 0, 1, 0, sum(mu + mm) + sum(case when rn = len then um + mm else 0 end) from x)
  select kind, cast(dist as int) as dist, i, j, round(v, 4) as value from o""",
    "mixture_step": recursive(seq(2)).replace(S_U, MIX_U).replace(S_M, MIX_M) + PASSES + """
  gx as (select read_name, rn, uu + mu as g0, um + mm as g1 from x union all select read_name, 1, uu + um, mu + mm from x where rn = 2),
  gp as (select pt.z_len, pt.z_cov, pt.z_dist, g0, g1 from pt join gx using (read_name, rn)),
  mo as (""" + mixture_moments() + """),
  pr as (select *, w / g as share, sum(w / g) over (partition by f, i) as total from mo)
  select 'mean' as kind, f as r, i, c as j, round(mu + s1 / w, 6) as value from pr union all select 'var', f, i, c, round(s2 / w, 6) from pr union all select 'prop', f, i, c, round(share / total, 6) from pr""",
    "gmm_halves": seq(2) + """, h as (select z_len as a, z_cov as b, z_dist as c, case when row_number() over (order by (z_len + z_cov + z_dist) / 3) <= count(*) over () // 2 then 0 else 1 end as half from pt),
  g as (select half, avg(a) as ma, avg(b) as mb, avg(c) as mc, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(a, c) as ac, covar_samp(b, b) as bb, covar_samp(b, c) as bc, covar_samp(c, c) as cc from h group by half)
  select half, unnest([0, 1, 2, 0, 0, 0, 1, 1, 1, 2, 2, 2]) as f, unnest([-1, -1, -1, 0, 1, 2, 0, 1, 2, 0, 1, 2]) as g, round(unnest([ma, mb, mc, aa, ab, ac, ab, bb, bc, ac, bc, cc]), 5) as value from g""",
    "init_observed": seq(2) + """, f as (select obs, unnest(['0', '1', '2']) as f, unnest([z_len, z_cov, z_dist]) as z from pt), m as (select obs, f, avg(z) as m, var_pop(z) as v from f group by all),
  p as (select gap, count(*) filter (where obs = 0) / count(*) as u, count(*) filter (where obs = 1) / count(*) as m from pt where rn = 1 group by gap),
  t as (select gap, count(*) filter (where prev = 0) as nu, count(*) filter (where prev = 1) as nm, count(*) filter (where prev = 0 and obs = 0) as uu, count(*) filter (where prev = 1 and obs = 0) as mu
   from pt where rn > 1 group by gap having nu > 0 and nm > 0)
  select 'mean' as kind, cast(f as int) as r, obs as i, 0 as j, round(m, 6) as value from m union all select 'var', cast(f as int), obs, 0, round(v, 6) from m
  union all select 'prop', cast(f as int), obs, 0, 1.0::double from m
  union all select 'pi', gap, 0, 0, round(u, 6) from p union all select 'pi', gap, 1, 0, round(m, 6) from p
  union all select 'a', gap, 0, 0, round(uu / nu, 6) from t union all select 'a', gap, 0, 1, round(1 - uu / nu, 6) from t
  union all select 'a', gap, 1, 0, round(mu / nm, 6) from t union all select 'a', gap, 1, 1, round(1 - mu / nm, 6) from t""",
    "init_gmm": seq(2) + """, hf as (select z_len as a, z_cov as b, z_dist as c, case when row_number() over (order by (z_len + z_cov + z_dist) / 3) <= count(*) over () // 2 then 0 else 1 end as half from pt),
  hs as (select half, avg(a) as ma, avg(b) as mb, avg(c) as mc, covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(a, c) as ac, covar_samp(b, b) as bb, covar_samp(b, c) as bc, covar_samp(c, c) as cc from hf group by half),
  hd as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from hs),
  hi as (select half, ma, mb, mc, det, (bb * cc - bc * bc) / det as i11, (ac * bc - ab * cc) / det as i12, (ab * bc - ac * bb) / det as i13, (aa * cc - ac * ac) / det as i22, (ab * ac - aa * bc) / det as i23,
   (aa * bb - ab * ab) / det as i33 from hd),
  hl as (select read_name, rn, gap, z_len, z_cov, z_dist, half, -0.5 * ln(det) - 0.5 * (i11 * pow(z_len - ma, 2) + i22 * pow(z_cov - mb, 2) + i33 * pow(z_dist - mc, 2)
   + 2 * (i12 * (z_len - ma) * (z_cov - mb) + i13 * (z_len - ma) * (z_dist - mc) + i23 * (z_cov - mb) * (z_dist - mc))) as l from pt, hi),
  hr as (select read_name, rn, gap, z_len, z_cov, z_dist, 1 / (1 + exp(greatest(least(max(l) filter (where half = 0) - max(l) filter (where half = 1), 700), -700))) as g1 from hl group by all),
  hg as (select *, 1 - g1 as g0 from hr),
  ht as (select n.gap, sum(p.g0 * n.g0) as uu, sum(p.g0 * n.g1) as um, sum(p.g1 * n.g0) as mu, sum(p.g1 * n.g1) as mm from hg n join hg p on p.read_name = n.read_name and p.rn = n.rn - 1 group by n.gap),
  hp as (select gap, sum(g0) as u, sum(g1) as m from hg where rn = 1 group by gap),
  hb as (select cast(unnest(range(0, 501)) as int) as r),
  hz as (select unnest([0, 1, 2]) as f, unnest([z_len, z_cov, z_dist]) as x, g0, g1 from hg),
  he as (select f, 0 as i, sum(g0 * x) / sum(g0) as mu, sum(g0 * x * x) / sum(g0) - pow(sum(g0 * x) / sum(g0), 2) as va from hz group by f union all
   select f, 1, sum(g1 * x) / sum(g1), sum(g1 * x * x) / sum(g1) - pow(sum(g1 * x) / sum(g1), 2) from hz group by f),
  ha as (select r, coalesce(u / (u + m), 0.5) as pu, coalesce(m / (u + m), 0.5) as pm, coalesce(uu / (uu + um), 0.5) as uu, coalesce(um / (uu + um), 0.5) as um, coalesce(mu / (mu + mm), 0.5) as mu, coalesce(mm / (mu + mm), 0.5) as mm
   from hb left join hp on hp.gap = r left join ht on ht.gap = r)
  select 'pi' as kind, r, unnest([0, 1]) as i, 0 as j, round(unnest([pu, pm]), 6) as value from ha union all select 'a', r, unnest([0, 0, 1, 1]), unnest([0, 1, 0, 1]), round(unnest([uu, um, mu, mm]), 6) from ha
  union all select 'mean', f, i, 0, round(mu, 6) from he union all select 'var', f, i, 0, round(va, 6) from he union all select 'prop', f, i, 0, 1.0::double from he
  union all select 'bayes_factor', 0, 0, 0, 0.9::double
  union all select 'methylated', 0, 0, 0, cast(max(mu) filter (where i = 1) >= max(mu) filter (where i = 0) as double) from he where f = 2""",
    "window_levels": VEC + " select vec_id, cast(sample as int) as sample, round(level, 7) as level, case when level >= 0.1 then 1.0::double else 0.0::double end as binary from l",
    "most_variable_windows": VEC + """, s as (select vec_id, stddev_samp(level) as sd, count(level) as n_level, count(*) as n_sample from l group by vec_id)
  select vec_id, round(sd, 7) as sd, n_level, n_sample, coalesce(sd > (select quantile_cont(sd, 0.99) from s), false) as variable from s""",
    "gram_matrix": """with v as (select vec_id, unnest(range(64)) as k, cast(unnest(embedding) as double) as e from embeddings)
  select cast(a.k as int) as i, cast(b.k as int) as j, round(sum(a.e * b.e), 5) as value from v a join v b using (vec_id) group by all""",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}

"""The feature matrix: one row per CpG site and fragment.

Columns: chr, start_, end_, read_name, frag_len, strand, methy_stat, norm_cov, base_q, offset_,
dist_end, prior. Further track columns pass through the filters untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = [
    "chr", "start_", "end_", "read_name", "frag_len", "strand", "methy_stat", "norm_cov", "base_q", "offset_",
    "dist_end", "prior",
]
# A total order that stands in for "first line of the file wins".
LINE_ORDER = ["chr", "start_", "end_", "frag_len", "strand", "methy_stat", "norm_cov", "base_q", "dist_end", "prior"]
MIN_BASE_Q = 5


@dataclass(frozen=True)
class Moments:
    """Mean and sample deviation of fragment length, coverage and distance to the centre."""

    len_mean: float
    len_sd: float
    cov_mean: float
    cov_sd: float
    dist_mean: float
    dist_sd: float


def dist_to_center() -> Column:
    return F.col("frag_len") / 2 - F.col("dist_end") + 0.5


def valid_rows(matrix: DataFrame, *, min_len: int = 30, max_len: int = 500) -> DataFrame:
    """Rows fit for the model: length strictly inside the bounds, base quality above 5, an offset
    inside the fragment and a known prior."""
    return matrix.where(
        (F.col("frag_len") > min_len) & (F.col("frag_len") < max_len) & (F.col("base_q") > MIN_BASE_Q)
        & (F.col("offset_") >= 0) & F.col("prior").isNotNull() & ~F.isnan("prior")
    )


def clipped_prior(prior: Column) -> Column:
    """Prior percentage as a probability, moved off exactly 0 and 100."""
    return F.when(prior == 100.0, prior - 0.01).when(prior == 0.0, prior + 0.01).otherwise(prior) / 100


def moment_columns() -> list[Column]:
    return [
        F.avg("frag_len").alias("len_mean"), F.stddev_samp("frag_len").alias("len_sd"),
        F.avg("norm_cov").alias("cov_mean"), F.stddev_samp("norm_cov").alias("cov_sd"),
        F.avg(dist_to_center()).alias("dist_mean"), F.stddev_samp(dist_to_center()).alias("dist_sd"),
    ]


def moments(valid: DataFrame) -> Moments:
    """Six scalars; taken before outliers and copies are removed."""
    return Moments(*valid.agg(*moment_columns()).first())


def standardise(valid: DataFrame, m: Moments, *, outlier: float = -1.0, low_coverage: bool = False) -> DataFrame:
    """Add the clipped prior ``p`` and z-scores ``z_len``, ``z_cov``, ``z_dist``.

    A positive ``outlier`` drops rows with any score above it; low scores stay. With
    ``low_coverage`` the coverage score is left out of the features (column dropped at the end).
    """
    out = valid.withColumns({
        "p": clipped_prior(F.col("prior")),
        "z_len": (F.col("frag_len") - m.len_mean) / F.lit(m.len_sd),
        "z_cov": (F.col("norm_cov") - m.cov_mean) / F.lit(m.cov_sd),
        "z_dist": (dist_to_center() - m.dist_mean) / F.lit(m.dist_sd),
    })
    if outlier > 0:
        out = out.where((F.col("z_cov") <= outlier) & (F.col("z_len") <= outlier) & (F.col("z_dist") <= outlier))
    return out.drop("z_cov") if low_coverage else out


def first_per_offset(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per (read_name, offset_): the first in ``order``.

    Written as an aggregation so that copies of one point are combined before the shuffle.
    """
    order = order or [c for c in LINE_ORDER if c in rows.columns]
    rest = [c for c in rows.columns if c not in ("read_name", "offset_", *order)]
    best = F.min(F.struct(*order, *rest)).alias("_row")
    return rows.groupBy("read_name", "offset_").agg(best).select("read_name", "offset_", "_row.*")


def observed_state(stat: Column) -> Column:
    s = F.lower(stat)
    return F.when(s == "u", 0).when(s == "m", 1)


def fragments(points: DataFrame, features: list[str], *, max_cpg_dist: int = 500, bin_bp: int = 1, min_points: int = 1,
              max_points: int = 1000, keep_rejected: bool = False) -> DataFrame:
    """Ordered observation sequence of every fragment; ``points`` must be unique on (read_name, offset_).

    Output arrays, in offset order: ``offset``, ``dist`` (the first entry is the first offset, then
    gaps, in bins of ``bin_bp``), ``prior``, one array per feature, ``obs``, ``locus``. A fragment is
    rejected when its first offset or a gap exceeds ``max_cpg_dist`` or when it has too few or too
    many points. No valid fragment reaches past ``max_points * max_cpg_dist``, so points beyond
    that are not collected and an array never outgrows a constant; ``n`` and, with ``keep_rejected``,
    ``last_offset`` are those of all points.
    """
    reach = max_points * max_cpg_dist
    point = F.struct(
        F.col("offset_").alias("offset"), F.col("p").alias("prior"), *[F.col(f) for f in features],
        observed_state(F.col("methy_stat")).alias("obs"),
        F.struct("chr", "start_", "end_").alias("locus"),
    )
    seqs = points.groupBy("read_name").agg(
        F.max("offset_").alias("_far"), F.count("offset_").cast("int").alias("_n"), F.collect_list(F.when(F.col("offset_") <= reach, point)).alias("_pts")
    )
    seqs = seqs.withColumn("_pts", F.array_sort("_pts"))
    pts = F.col("_pts")
    gaps = F.transform(pts, lambda x, i: x["offset"] - F.when(i > 0, F.get(pts, i - 1)["offset"]).otherwise(F.lit(0)))
    seqs = seqs.withColumn("_gaps", gaps).withColumn(
        "dist", F.transform("_gaps", lambda g: F.floor(g / bin_bp).cast("int"))
    )
    bad_gap = (F.get("_gaps", F.lit(0)) > max_cpg_dist) | F.exists("dist", lambda d: d * bin_bp > max_cpg_dist)
    size = F.col("_n")
    good = (F.col("_far") <= reach) & ~bad_gap & size.between(min_points, max_points)
    if keep_rejected:
        seqs = seqs.withColumn("accepted", F.coalesce(good, F.lit(False)))
    else:
        seqs = seqs.where(good)
    cols = ["read_name", size.alias("n"), "dist"]
    cols += [F.col(f"_pts.{name}").alias(name) for name in ("offset", "prior", *features, "obs", "locus")]
    return seqs.select(*cols, *([F.col("_far").alias("last_offset"), "accepted"] if keep_rejected else []))


def transitions(seqs: DataFrame) -> DataFrame:
    """One row per point of a fragment: idx, dist, previous and own observed state."""
    step = F.transform(
        F.col("obs"),
        lambda o, i: F.struct(i.alias("idx"), F.get("dist", i).alias("dist"), F.when(i > 0, F.get("obs", i - 1)).alias("prev"),
                              o.alias("cur")),
    )
    return seqs.select("read_name", F.inline(step))


def initial_state_table(seqs: DataFrame) -> DataFrame:
    """Observed states of first points per first distance, as counts and proportions."""
    first = seqs.select(F.get("dist", F.lit(0)).alias("dist"), F.get("obs", F.lit(0)).alias("cur")).where(F.col("cur").isNotNull())
    t = first.groupBy("dist").agg(F.count_if(F.col("cur") == 0).alias("n_u"), F.count_if(F.col("cur") == 1).alias("n_m"))
    total = F.col("n_u") + F.col("n_m")
    return t.select("dist", "n_u", "n_m", (F.col("n_u") / total).alias("p_u"), (F.col("n_m") / total).alias("p_m"))


def transition_table(seqs: DataFrame) -> DataFrame:
    """Observed state changes per distance, as counts and row proportions."""
    step = transitions(seqs).where((F.col("idx") > 0) & F.col("prev").isNotNull() & F.col("cur").isNotNull())
    names = {(0, 0): "n_uu", (0, 1): "n_um", (1, 0): "n_mu", (1, 1): "n_mm"}
    t = step.groupBy("dist").agg(
        *[F.count_if((F.col("prev") == a) & (F.col("cur") == b)).alias(n) for (a, b), n in names.items()]
    )
    row_u, row_m = F.col("n_uu") + F.col("n_um"), F.col("n_mu") + F.col("n_mm")
    return t.select(
        "dist", *names.values(),
        F.try_divide("n_uu", row_u).alias("p_uu"), F.try_divide("n_um", row_u).alias("p_um"),
        F.try_divide("n_mu", row_m).alias("p_mu"), F.try_divide("n_mm", row_m).alias("p_mm"),
    )


def locus_methylation(rows: DataFrame) -> DataFrame:
    """Methylated and total calls per locus."""
    t = rows.groupBy("chr", "start_", "end_").agg(
        F.count_if(F.lower("methy_stat") == "m").alias("n_m"), F.count(F.lit(1)).alias("n")
    )
    return t.select("chr", "start_", "end_", "n_m", "n", (100.0 * F.col("n_m") / F.col("n")).alias("methy_perc"))

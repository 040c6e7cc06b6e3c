"""Queries over the distance-dependent model and the tissue mixture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.operators import hmm as H
from fragweave.operators import matrix as M
from fragweave.operators import tissue as TI
from fragweave.plans import bindings as B
from fragweave.plans.queries_matrix import scored, sequences_of
from fragweave.session import durable

BINS = 501
KL_MIN = 3


def _fixed_model() -> H.Model:
    """A model with closed-form tables, so that SQL can state it too."""
    r = np.arange(BINS)
    pi_m = 0.3 + 0.4 * r / 500
    stay_u, stay_m = 0.9 - 0.5 * r / 500, 0.85 - 0.4 * r / 500
    a = np.stack([np.stack([stay_u, 1 - stay_u], 1), np.stack([1 - stay_m, stay_m], 1)], 1)
    one = ((1.0,),) * 3
    emit = (H.Emission(((-0.5,), (0.2,), (-0.6,)), ((1.0,), (1.5,), (0.8,)), one),
            H.Emission(((0.4,), (-0.1,), (0.7,)), ((1.2,), (1.0,), (0.9,)), one))
    return H.Model(np.stack([1 - pi_m, pi_m], 1), a, emit)


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    return H.decode(sequences_of(spark, sf), _fixed_model())


def emission_score(spark, sf):
    m = _fixed_model()
    t = scored(spark, sf).select("read_name", "offset_", "prior", "p", "z_len", "z_cov", "z_dist",
                                 H.score_column(m.emit[0], H.FEATURES).alias("s_u"), H.score_column(m.emit[1], H.FEATURES).alias("s_m"))
    post = H.posterior(m, F.col("s_m"), F.col("s_u"), F.col("p"))
    return t.select("read_name", "offset_", "prior", F.round("s_u", 7).alias("s_u"), F.round("s_m", 7).alias("s_m"), F.round(post, 7).alias("posterior_m"))


def viterbi_decode(spark, sf):
    t = H.decoded_points(_decoded(spark, sf))
    return t.select("read_name", F.col("offset").alias("offset_"), "chr", "start_", "end_", "obs", "state")


def predictions(spark, sf):
    return H.predictions(H.decoded_points(_decoded(spark, sf)), _fixed_model())


def prediction_correlation(spark, sf):
    t = H.prediction_correlation(predictions(spark, sf))
    return t.select("n", F.round("r", 7).alias("r"), F.round("p", 7).alias("p"))


def confusion(spark, sf):
    return H.confusion(H.decoded_points(_decoded(spark, sf)), _fixed_model())


def sequence_likelihood(spark, sf):
    t = H.likelihood_per_point(_decoded(spark, sf))
    return t.select(F.round("likelihood", 3).alias("likelihood"), "n_fragments")


def roc_sweep(spark, sf):
    return H.roc(sequences_of(spark, sf), _fixed_model())


def roc_random_prior(spark, sf):
    return H.roc(sequences_of(spark, sf), _fixed_model(), random_prior=True)


def expectation_step(spark, sf):
    """Expected transitions, initial states and state weights under the fixed model, from one scan."""
    m = _fixed_model()
    st = H.e_step(sequences_of(spark, sf, 2), m, H.FEATURES)
    rows = [("xi", int(r), i, j, float(st["num"][r, i, j])) for r in np.flatnonzero(st["den"].sum(axis=1)) for i in (0, 1) for j in (0, 1)]
    rows += [("pi", int(r), i, 0, float(st["pi"][r, i])) for r in np.flatnonzero(st["pi"].sum(axis=1)) for i in (0, 1)]
    rows += [("gamma", 0, i, 0, float(st["gamma"][i])) for i in (0, 1)]
    return spark.createDataFrame([(k, r, i, j, round(v, 4)) for k, r, i, j, v in rows], "kind string, dist int, i int, j int, value double")


def gmm_halves(spark, sf):
    """Mean and covariance of the two halves the mixture start is built from."""
    pts = H._points(durable(sequences_of(spark, sf, 2), "train"), H.FEATURES)
    rows = []
    for h, (mu, cov) in enumerate(H.gaussian_halves(pts, H.FEATURES)):
        rows += [(h, f, -1, round(float(mu[f]), 5)) for f in range(3)]
        rows += [(h, f, g, round(float(cov[f, g]), 5)) for f in range(3) for g in range(3)]
    return spark.createDataFrame(rows, "half int, f int, g int, value double")


def _model_rows(spark, m: H.Model) -> DataFrame:
    return spark.createDataFrame([(k, r, i, j, round(v, 6)) for k, r, i, j, v in m.to_rows()], "kind string, r int, i int, j int, value double")


def init_observed(spark, sf):
    """Emissions and counted tables of the start from observed states (bins without data, which are drawn, left out)."""
    seqs = durable(sequences_of(spark, sf, 2), "train")
    first = M.initial_state_table(seqs).select(F.lit("pi").alias("kind"), F.col("dist").alias("r"))
    step = M.transition_table(seqs).where("p_uu is not null and p_mu is not null").select(F.lit("a").alias("kind"), F.col("dist").alias("r"))
    rows = _model_rows(spark, H.init_observed(seqs))
    counted = rows.join(first.unionByName(step), ["kind", "r"], "left_semi")
    return rows.where(F.col("kind").isin("mean", "var", "prop")).unionByName(counted)


def _two_component_model() -> H.Model:
    """The fixed model with two normals a feature, around the single ones and unequally weighted."""
    m = _fixed_model()
    emit = tuple(H.Emission(
        tuple((mu[0] - 0.5, mu[0] + 0.4) for mu in e.mean), tuple((v[0], v[0] * 1.5) for v in e.var), ((0.6, 0.4),) * 3) for e in m.emit)
    return H.replace(m, emit=emit)


def mixture_step(spark, sf):
    """Emissions of two components a feature after one training step."""
    m = _two_component_model()
    new = H.m_step(m, H.e_step(sequences_of(spark, sf, 2), m, H.FEATURES))
    return _model_rows(spark, new).where(F.col("kind").isin("mean", "var", "prop"))


def init_gmm(spark, sf):
    return _model_rows(spark, H.init_gmm(durable(sequences_of(spark, sf, 2), "train")))


def init_random(spark, sf):
    return _model_rows(spark, H.init_random(sequences_of(spark, sf, 2)))


def em_train(spark, sf):
    """Train from the mixture start; the driver tables only have short fragments, hence the low length bound."""
    seqs = durable(sequences_of(spark, sf, 2), "train")
    t = H.train(seqs, H.init_gmm(seqs), kl_min_len=KL_MIN, keep=False)
    return _model_rows(spark, t.model)


def train_and_predict(spark, sf):
    seqs = durable(sequences_of(spark, sf, 2), "train")
    m = H.train(seqs, H.init_observed(seqs), kl_min_len=KL_MIN, keep=False).model
    return H.predictions(H.decoded_points(H.decode(sequences_of(spark, sf), m)), m)


def _vectors(spark, sf):
    """Windows by sample from embeddings: 64 samples with a methylated count and a coverage."""
    t = B.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("sample", "e"))
    cov = ((F.col("vec_id") * 7 + F.col("sample") * 3) % 101) / 1000.0
    return t.select("vec_id", "sample", (F.abs(F.col("e").cast("double")) * cov).alias("methylated"), cov.alias("coverage"))


def window_levels(spark, sf):
    t = TI.window_levels(_vectors(spark, sf), ["vec_id"], "sample", "methylated", "coverage")
    return t.select("vec_id", "sample", F.round("level", 7).alias("level"), TI.binary(F.col("level")).alias("binary"))


def most_variable_windows(spark, sf):
    """Every window with its deviation; ``variable`` marks those above the 0.99 quantile."""
    t = TI.window_variability(TI.window_levels(_vectors(spark, sf), ["vec_id"], "sample", "methylated", "coverage"), ["vec_id"])
    return t.select("vec_id", F.round("sd", 7).alias("sd"), "n_level", "n_sample", "variable")


def gram_matrix(spark, sf):
    t = B.table(spark, sf, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return TI.cross_products(t, "x", "x").select("i", "j", F.round("value", 5).alias("value"))


def tissue_fractions(spark, sf):
    """Samples 0-9 as reference tissues, the others as mixtures to be explained.

    The fit takes the most variable windows of the reference that have a level in every tissue and mixture.
    Each coverage is raised by 0.02: as derived, it leaves no window with a level in all mixtures.
    """
    tissues, samples = list(range(10)), list(range(10, 64))
    levels = TI.window_levels(_vectors(spark, sf).withColumn("coverage", F.col("coverage") + 0.02), ["vec_id"], "sample", "methylated", "coverage")
    panel = levels.where(F.col("sample").isin(tissues))
    chosen = TI.most_variable(panel, ["vec_id"]).select("vec_id").join(TI.complete_windows(levels, ["vec_id"]), "vec_id")
    levels = levels.join(chosen, "vec_id", "left_semi").withColumn("level", TI.binary(F.col("level")))
    ref = TI.wide_matrix(levels, ["vec_id"], "sample", tissues, "x")
    cf = TI.wide_matrix(levels, ["vec_id"], "sample", samples, "y")
    t = TI.tissue_fractions(ref, cf, ["vec_id"], tissues, samples)
    return t.select("sample", "tissue", F.round("fraction", 6).alias("fraction"))

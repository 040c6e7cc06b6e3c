"""Two-state hidden Markov model whose transitions depend on the distance between sites.

Spark owns the data: fragments are partitioned rows, every pass is one scan that returns partial
sums per task, combined by a shuffle on the parameter slot. The driver only holds parameters,
whose number depends on the distance range and not on the data. Inside a task the recursions run
over Arrow batches, all fragments of a batch in step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.functions.numeric import pearson_from_sums, pearson_p, values_at_ranks
from fragweave.operators import matrix as M
from fragweave.session import durable

FEATURES = ["z_len", "z_cov", "z_dist"]
FEATURES_LOW_COVERAGE = ["z_len", "z_dist"]
U, METH = 0, 1
# Thresholds of the receiver operating characteristic.
ROC_THRESHOLDS = [-1.0, -0.999, -0.99, -0.95, -0.9, -0.8, -0.7, -0.5, -0.1, 0.0, 0.1, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999, 1.0]
SLOTS = "slot int, value double"


class NotFinite(ValueError):
    """A pass over the data gave infinite or undefined sums: the model has run away from it."""


@dataclass(frozen=True)
class Emission:
    """Per feature a mixture of normals: ``mean[f][c]``, ``var[f][c]``, ``prop[f][c]``."""

    mean: tuple[tuple[float, ...], ...]
    var: tuple[tuple[float, ...], ...]
    prop: tuple[tuple[float, ...], ...]

    def densities(self, x: np.ndarray) -> list[np.ndarray]:
        """Per feature the weighted component densities, shape (components, points)."""
        out = []
        for f in range(x.shape[0]):
            mu, var, w = (np.asarray(v[f])[:, None] for v in (self.mean, self.var, self.prop))
            out.append(w * np.exp(-0.5 * (x[f] - mu) ** 2 / var) / np.sqrt(2 * math.pi * var))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """exp of the product of the feature densities: not a density, never below 1."""
        return np.exp(np.prod([d.sum(axis=0) for d in self.densities(x)], axis=0))


@dataclass(frozen=True)
class Model:
    """pi[r, i] and a[r, i, j] per distance bin r, one emission per state."""

    pi: np.ndarray
    a: np.ndarray
    emit: tuple[Emission, Emission]
    methylated: int = METH
    bayes_factor: float = 0.9

    @property
    def bins(self) -> int:
        return self.pi.shape[0]

    def to_rows(self) -> list[tuple[str, int, int, int, float]]:
        rows = [("pi", r, i, 0, float(self.pi[r, i])) for r in range(self.bins) for i in (0, 1)]
        rows += [("a", r, i, j, float(self.a[r, i, j])) for r in range(self.bins) for i in (0, 1) for j in (0, 1)]
        for i, e in enumerate(self.emit):
            for kind in ("mean", "var", "prop"):
                rows += [(kind, f, i, c, v) for f, vals in enumerate(getattr(e, kind)) for c, v in enumerate(vals)]
        return rows + [("methylated", 0, 0, 0, float(self.methylated)), ("bayes_factor", 0, 0, 0, self.bayes_factor)]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.to_rows(), "kind string, r int, i int, j int, value double").coalesce(1).write.parquet(path)

    @staticmethod
    def from_rows(rows) -> Model:
        t: dict = {}
        for kind, r, i, j, v in rows:
            t.setdefault(kind, {})[(r, i, j)] = v
        n = 1 + max(r for r, _, _ in t["pi"])
        pi, a = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for (r, i, _), v in t["pi"].items():
            pi[r, i] = v
        for (r, i, j), v in t["a"].items():
            a[r, i, j] = v
        nf = 1 + max(f for f, _, _ in t["mean"])

        def nested(kind: str, i: int):
            return tuple(
                tuple(v for (_, _, _), v in sorted((k, v) for k, v in t[kind].items() if k[0] == f and k[1] == i))
                for f in range(nf)
            )

        emit = tuple(Emission(nested("mean", i), nested("var", i), nested("prop", i)) for i in (0, 1))
        return Model(pi, a, emit, int(t["methylated"][(0, 0, 0)]), t["bayes_factor"][(0, 0, 0)])

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """Read a saved model; its row count depends on the distance range only."""
        return Model.from_rows([tuple(r) for r in spark.read.parquet(path).select("kind", "r", "i", "j", "value").collect()])


def score_column(emission: Emission, features: list[str]) -> Column:
    """The emission score as a Spark expression over plain columns."""
    product = None
    for f, name in enumerate(features):
        total = None
        for mu, var, w in zip(emission.mean[f], emission.var[f], emission.prop[f]):
            d = F.lit(w) * F.exp(-0.5 * F.pow(F.col(name) - mu, 2) / var) / math.sqrt(2 * math.pi * var)
            total = d if total is None else total + d
        product = total if product is None else product * total
    return F.exp(product)


def posterior(model: Model, like_m: Column, like_u: Column, prior: Column) -> Column:
    """Posterior of the methylated state: scaled likelihoods, prior squeezed around one half."""
    f = model.bayes_factor
    pm = like_m * (0.5 - f / 2 + prior * f)
    pu = like_u * (0.5 + f / 2 - prior * f)
    return pm / (pm + pu)


# --- batches ---------------------------------------------------------------------------------


class Batch:
    """Fragments of one Arrow batch as flat arrays, longest first."""

    def __init__(self, batch: pa.RecordBatch, features: list[str]):
        lists = {name: batch.column(name) for name in ("dist", "prior", *features)}
        offsets = np.asarray(lists["dist"].offsets)
        length = np.diff(offsets)
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        self.start = offsets[:-1][self.order] - offsets[0]
        self.dist = lists["dist"].flatten().to_numpy(zero_copy_only=False)
        self.prior = lists["prior"].flatten().to_numpy(zero_copy_only=False)
        self.x = np.stack([lists[f].flatten().to_numpy(zero_copy_only=False) for f in features])
        self.max_len = int(self.length[0]) if len(self.length) else 0

    def step(self, t: int) -> np.ndarray:
        """Flat positions of point t of every fragment that has one."""
        live = int(np.searchsorted(-self.length, -t, side="left"))
        return self.start[:live] + t


def forward(b: Batch, model: Model, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and scale factors; an all-zero column becomes one half each, factor 1."""
    n = len(b.dist)
    alpha, scale = np.empty((n, 2)), np.empty(n)
    for t in range(b.max_len):
        at = b.step(t)
        if t == 0:
            v = model.pi[b.dist[at]] * score[at]
        else:
            v = np.einsum("ni,nij->nj", alpha[at - 1], model.a[b.dist[at]]) * score[at]
        total = v.sum(axis=1)
        dead = total == 0.0
        scale[at] = np.where(dead, 1.0, total)
        alpha[at] = np.where(dead[:, None], 0.5, v / scale[at][:, None])
    return alpha, scale


def backward(b: Batch, model: Model, score: np.ndarray, scale: np.ndarray) -> np.ndarray:
    beta = np.empty((len(b.dist), 2))
    last = b.start + b.length - 1
    beta[last] = 1.0 / scale[last][:, None]
    for t in range(b.max_len - 2, -1, -1):
        nxt = b.step(t + 1)
        v = np.einsum("nij,nj->ni", model.a[b.dist[nxt]], score[nxt] * beta[nxt])
        beta[nxt - 1] = v / scale[nxt - 1][:, None]
    return beta


def log_likelihood(b: Batch, scale: np.ndarray) -> np.ndarray:
    total = np.zeros(len(b.length))
    with np.errstate(divide="ignore"):
        logs = np.log(scale)
    for t in range(b.max_len):
        at = b.step(t)
        total[: len(at)] += logs[at]
    return total


def expected_states(b: Batch, model: Model, score: np.ndarray, alpha: np.ndarray, beta: np.ndarray):
    """xi for every point after the first (flat, in the row of that point) and gamma for every point."""
    n = len(b.dist)
    xi, gamma = np.zeros((n, 2, 2)), np.zeros((n, 2))
    inner = np.ones(n, bool)
    inner[b.start] = False
    at = np.flatnonzero(inner)
    xi[at] = alpha[at - 1][:, :, None] * model.a[b.dist[at]] * (score[at] * beta[at])[:, None, :]
    gamma[at - 1] = xi[at].sum(axis=2)
    last = (b.start + b.length - 1)[b.length > 1]
    gamma[last] = xi[last].sum(axis=1)
    return xi, gamma, at


# --- partial sums -----------------------------------------------------------------------------


class Layout:
    """Slot numbers of the sufficient statistics."""

    def __init__(self, bins: int, comps: list[int]):
        self.bins, self.comps = bins, comps
        self.shapes = {"num": (bins, 2, 2), "den": (bins, 2), "pi": (bins, 2), "gamma": (2,), "misc": (5,)}
        for f, k in enumerate(comps):
            self.shapes[f"emit{f}"] = (2, k, 3)
        self.offset, at = {}, 0
        for name, shape in self.shapes.items():
            self.offset[name] = at
            at += int(np.prod(shape))
        self.size = at

    def empty(self) -> dict[str, np.ndarray]:
        return {name: np.zeros(shape) for name, shape in self.shapes.items()}

    def pack(self, stats: dict[str, np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate([stats[name].ravel() for name in self.shapes])
        keep = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(flat[keep])], names=["slot", "value"])

    def unpack(self, rows) -> dict[str, np.ndarray]:
        flat = np.zeros(self.size)
        for slot, value in rows:
            flat[slot] = value
        return {
            name: flat[self.offset[name]: self.offset[name] + int(np.prod(shape))].reshape(shape)
            for name, shape in self.shapes.items()
        }


def _emission_sums(stats: dict, model: Model, x: np.ndarray, w: np.ndarray) -> None:
    """Weighted counts, first and second moments about the current component means."""
    for i in (0, 1):
        e = model.emit[i]
        for f, dens in enumerate(e.densities(x)):
            total = dens.sum(axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                share = np.nan_to_num(dens / total) if len(e.mean[f]) > 1 else np.ones_like(dens)
            weight = share * w[:, i]
            off = x[f] - np.asarray(e.mean[f])[:, None]
            stats[f"emit{f}"][i, :, 0] += weight.sum(axis=1)
            stats[f"emit{f}"][i, :, 1] += (weight * off).sum(axis=1)
            stats[f"emit{f}"][i, :, 2] += (weight * off * off).sum(axis=1)


def _refit(model: Model, stats: dict, features: int) -> tuple[Emission, Emission]:
    """New mixtures. One component: mean and biased variance. More: one reweighting step, variance
    about the old mean, empty components kept alive with a weight of 1e-4."""
    out = []
    for i in (0, 1):
        old, mean, var, prop = model.emit[i], [], [], []
        total = stats["gamma"][i]
        for f in range(features):
            s = stats[f"emit{f}"][i]
            mu = np.asarray(old.mean[f])
            if len(mu) == 1:
                shift = s[0, 1] / total
                mean.append((float(mu[0] + shift),))
                var.append((float(s[0, 2] / total - shift * shift),))
                prop.append((1.0,))
            else:
                weight = s[:, 0] / total
                weight = np.where(weight == 0.0, 1e-4, weight)
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean.append(tuple((mu + s[:, 1] / s[:, 0]).tolist()))
                    var.append(tuple((s[:, 2] / s[:, 0]).tolist()))
                prop.append(tuple((weight / weight.sum()).tolist()))
        out.append(Emission(tuple(mean), tuple(var), tuple(prop)))
    return tuple(out)


def _sum_slots(seqs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: list[str],
               layout: Layout) -> dict[str, np.ndarray]:
    parts = seqs.select(*columns).mapInArrow(work, SLOTS)
    rows = parts.groupBy("slot").agg(F.sum("value").alias("value")).collect()  # at most layout.size rows
    stats = layout.unpack(rows)
    for name, v in stats.items():
        if not np.isfinite(v).all():
            raise NotFinite(f"model pass produced non-finite sums in {name!r}")
    return stats


def e_step(seqs: DataFrame, model: Model, features: list[str], previous: Model | None = None, kl_min_len: int = 10) -> dict[str, np.ndarray]:
    """One scan: expected transitions, initial states and emission moments under ``model``.

    With ``previous`` the same scan also returns the summed per-point log-likelihood change from
    ``previous`` to ``model`` over fragments of at least ``kl_min_len`` points. ``misc`` holds
    [change, its fragments, fragments, log-likelihood per point summed, points].
    """
    layout = Layout(model.bins, [len(m) for m in model.emit[0].mean])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = layout.empty()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            b = Batch(rb, features)
            score = np.stack([model.emit[i].score(b.x) for i in (0, 1)], axis=1)
            alpha, scale = forward(b, model, score)
            beta = backward(b, model, score, scale)
            xi, gamma, at = expected_states(b, model, score, alpha, beta)
            np.add.at(stats["num"], b.dist[at], xi[at])
            np.add.at(stats["den"], b.dist[at], gamma[at - 1])
            np.add.at(stats["pi"], b.dist[b.start], gamma[b.start])
            stats["gamma"] += gamma.sum(axis=0)
            _emission_sums(stats, model, b.x, gamma)
            lnp = log_likelihood(b, scale)
            fine = np.isfinite(lnp)
            stats["misc"][2] += len(b.length)
            stats["misc"][3] += (lnp[fine] / b.length[fine]).sum()
            stats["misc"][4] += len(b.dist)
            if previous is not None:
                long_ = b.length >= kl_min_len
                if long_.any():
                    old = np.stack([previous.emit[i].score(b.x) for i in (0, 1)], axis=1)
                    _, old_scale = forward(b, previous, old)
                    change = (log_likelihood(b, old_scale) - lnp) / b.length
                    stats["misc"][0] += change[long_].sum()
                    stats["misc"][1] += long_.sum()
        yield layout.pack(stats)

    return _sum_slots(seqs, work, ["dist", "prior", *features], layout)


def m_step(model: Model, stats: dict[str, np.ndarray], *, reset_all_pi: bool = False) -> Model:
    """New parameters from summed statistics.

    Distances never seen take the pooled transitions; rows without weight keep the old ones. The
    initial probabilities of the first and the last distance bin are added to the old values
    before scaling unless ``reset_all_pi``; bins without weight become one half.
    """
    a = model.a.copy()
    num, den = stats["num"], stats["den"]
    pooled_num, pooled_den = num.sum(axis=0), den.sum(axis=0)
    seen = den.sum(axis=1) > 0
    for i in (0, 1):
        ok = seen & (den[:, i] != 0)
        a[ok, i] = num[ok, i] / den[ok, i][:, None]
        if pooled_den[i] != 0:
            a[~seen, i] = pooled_num[i] / pooled_den[i]
    pi = stats["pi"] / stats["misc"][2]
    if not reset_all_pi:
        for r in (0, model.bins - 1):
            pi[r] += model.pi[r]
    total = pi.sum(axis=1, keepdims=True)
    pi = np.where(total == 0, 0.5, pi / np.where(total == 0, 1.0, total))
    return replace(model, pi=pi, a=a, emit=_refit(model, stats, len(model.emit[0].mean)))


def methylated_state(model: Model) -> int:
    """The state whose fragments lie further from the fragment centre (the last feature)."""
    m = [sum(w * mu for w, mu in zip(e.prop[-1], e.mean[-1])) for e in model.emit]
    return METH if m[METH] >= m[U] else U


@dataclass(frozen=True)
class Training:
    model: Model
    distances: list[float]
    log_likelihood: list[float]
    restarts: int = 0


@dataclass
class Progress:
    """Where a training stands: everything the next step needs."""

    model: Model
    previous: Model | None = None
    step: int = 0
    restarts: int = 0
    before: float | None = None
    distances: list[float] = field(default_factory=list)
    likes: list[float] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        """One committed folder a step; a step that was cut off leaves none."""
        rows = [(f"now.{k}", r, i, j, v) for k, r, i, j, v in self.model.to_rows()]
        rows += [(f"before.{k}", r, i, j, v) for k, r, i, j, v in self.previous.to_rows()] if self.previous else []
        rows += [(name, k, 0, 0, v) for name, values in (("distance", self.distances), ("like", self.likes)) for k, v in enumerate(values)]
        rows += [("restarts", 0, 0, 0, float(self.restarts))] + ([("last", 0, 0, 0, self.before)] if self.before is not None else [])
        spark.createDataFrame(rows, "kind string, r int, i int, j int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={self.step}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Progress | None:
        """The furthest step written below ``path``; None if there is none."""
        try:
            steps = spark.read.parquet(path)
        except AnalysisException:
            return None
        step = steps.agg(F.max("step")).first()[0]
        rows = [tuple(r) for r in steps.where(F.col("step") == step).select("kind", "r", "i", "j", "value").collect()]  # bounded by the distance range
        part = lambda head: [(k.removeprefix(head), *rest) for k, *rest in rows if k.startswith(head)]
        series = lambda name: [v for _, v in sorted((r, v) for k, r, _, _, v in rows if k == name)]
        before = part("before.")
        return Progress(Model.from_rows(part("now.")), Model.from_rows(before) if before else None, int(step), int(series("restarts")[0]),
                        next(iter(series("last")), None), series("distance"), series("like"))


def train(seqs: DataFrame, init: Model, features: list[str] = FEATURES, *, max_iter: int = 50, tol: float = 1e-4, decay: float = 0.01,
          kl_min_len: int = 10, share_a: bool = True, reset_all_pi: bool = False, keep: bool = True,
          restart: Callable[[int], Model] | None = None, state_path: str | None = None) -> Training:
    """Expectation-maximisation; stops when the distance between successive models settles.

    The distance of step k is measured in the scan of step k + 1, so each step reads the data
    once. With ``share_a`` both models are compared under the new transitions, so that only
    emissions and initial states count. ``seqs`` needs at least two points per fragment.

    When sums or the distance are not finite, ``restart(1)``, ``restart(2)`` ... give the models to go
    on with (a seeded start each, so that reruns agree); steps spent so far stay spent. Without it
    that is an error. With ``state_path`` each step is written there, and a training begun there goes on
    from its last step, whatever became of its driver.
    """
    data = durable(seqs.select("dist", "prior", *features), "fragments") if keep else seqs
    spark = data.sparkSession
    at = (Progress.load(spark, state_path) if state_path else None) or Progress(init)
    while True:
        try:
            stats = e_step(data, at.model, features, at.previous, kl_min_len)
            if stats["misc"][2] == 0:
                raise ValueError("no fragment is long enough to train on")
            if at.previous is not None and stats["misc"][1] == 0:
                raise ValueError(f"no fragment has {kl_min_len} points, so model distances are undefined")
            settled = at.previous is not None and _settles(at, stats, tol, decay)
            at.likes.append(float(stats["misc"][3]))
            if settled or at.step >= max_iter:
                break
            new = m_step(at.model, stats, reset_all_pi=reset_all_pi)
            at.previous, at.model = replace(at.model, a=new.a) if share_a else at.model, new
        except NotFinite:
            if restart is None:
                raise
            if at.step >= max_iter:
                break
            at.restarts += 1
            at.model, at.previous, at.before = restart(at.restarts), None, None
        at.step += 1
        if state_path:
            at.save(spark, state_path)
    return Training(replace(at.model, methylated=methylated_state(at.model)), at.distances, at.likes, at.restarts)


def _settles(at: Progress, stats: dict[str, np.ndarray], tol: float, decay: float) -> bool:
    """Note the distance between the last two models; whether it is small, or hardly differs from the one before."""
    d = float(stats["misc"][0] / stats["misc"][1])
    if not math.isfinite(d):
        raise NotFinite("the distance between successive models is not finite")
    at.distances.append(d)
    rel = abs((abs(d) - abs(at.before)) / at.before) if at.before else math.inf  # the first distance has none to be compared with
    at.before = d
    return rel < decay or abs(d) < tol


# --- initial models ---------------------------------------------------------------------------


def default_emission(comps: list[int]) -> Emission:
    """Component means spread evenly over (0, 1), unit variance, equal weights."""
    mean = tuple(tuple((1 + 2 * j) / (2 * m) for j in range(m)) for m in comps)
    return Emission(mean, tuple(tuple(1.0 for _ in m) for m in mean), tuple(tuple(1.0 / len(m) for _ in m) for m in mean))


def _points(seqs: DataFrame, features: list[str]) -> DataFrame:
    return seqs.select("read_name", F.inline(F.arrays_zip("offset", *features, "obs")))


def _fit_pool(points: DataFrame, weight: list[Column], features: list[str], comps: list[int]) -> tuple[Emission, Emission]:
    """Weighted fit of both states in one aggregation over plain columns."""
    base = default_emission(comps)
    aggs, names = [], []
    for i in (0, 1):
        for f, name in enumerate(features):
            dens = [F.lit(w) * F.exp(-0.5 * F.pow(F.col(name) - mu, 2) / v) / math.sqrt(2 * math.pi * v)
                    for mu, v, w in zip(base.mean[f], base.var[f], base.prop[f])]
            total = sum(dens[1:], dens[0])
            for c in range(comps[f]):
                w = weight[i] if comps[f] == 1 else weight[i] * F.coalesce(F.try_divide(dens[c], total), F.lit(0.0))
                off = F.col(name) - base.mean[f][c]
                for k, term in enumerate((w, w * off, w * off * off)):
                    key = f"s_{i}_{f}_{c}_{k}"
                    aggs.append(F.sum(term).alias(key))
                    names.append((key, i, f, c, k))
        aggs.append(F.sum(weight[i]).alias(f"g_{i}"))
    row = points.agg(*aggs).first()
    stats = {"gamma": np.array([row["g_0"], row["g_1"]])}
    stats |= {f"emit{f}": np.zeros((2, k, 3)) for f, k in enumerate(comps)}
    for key, i, f, c, k in names:
        stats[f"emit{f}"][i, c, k] = row[key] or 0.0
    shell = Model(np.zeros((1, 2)), np.zeros((1, 2, 2)), (base, base))
    return _refit(shell, stats, len(features))


def _random_rows(rng: np.random.Generator, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Initial probabilities leaning to the methylated state, transitions leaning to staying."""
    p, q = rng.random(bins) * 0.5, rng.random((bins, 2)) * 0.5
    pi = np.stack([p, 1 - p], axis=1)
    a = np.empty((bins, 2, 2))
    for i in (0, 1):
        a[:, i, i], a[:, i, 1 - i] = 1 - q[:, i], q[:, i]
    return pi, a


def init_observed(seqs: DataFrame, features: list[str] = FEATURES, *, bins: int = 501, comps: list[int] | None = None, seed: int = 2017) -> Model:
    """From observed states: pooled emissions, counted tables, seeded random rows where unseen."""
    comps = comps or [1] * len(features)
    pi, a = _random_rows(np.random.default_rng(seed), bins)
    for r in M.initial_state_table(seqs).collect():  # one row per distance bin
        pi[r["dist"]] = (r["p_u"], r["p_m"])
    for r in M.transition_table(seqs).collect():
        if None not in (r["p_uu"], r["p_mu"]):
            a[r["dist"]] = [[r["p_uu"], r["p_um"]], [r["p_mu"], r["p_mm"]]]
    pool = [(F.col("obs") == i).cast("double") for i in (0, 1)]
    return Model(pi, a, _fit_pool(_points(seqs, features), pool, features, comps))


def init_random(seqs: DataFrame, features: list[str] = FEATURES, *, bins: int = 501, comps: list[int] | None = None, seed: int = 2017) -> Model:
    """Points split into two halves by a seeded hash, random tables. Repeatable for one seed."""
    comps = comps or [1] * len(features)
    pi, a = _random_rows(np.random.default_rng(seed), bins)
    coin = F.pmod(F.xxhash64(F.lit(seed), "read_name", "offset"), F.lit(2))
    pool = [(coin == i).cast("double") for i in (0, 1)]
    return Model(pi, a, _fit_pool(_points(seqs, features), pool, features, comps))


def split_by_row_mean(points: DataFrame, features: list[str]) -> DataFrame:
    """Add ``half``: 0 for the lower half of the points by feature mean, 1 for the upper half.

    The cut is an exact rank found by counting; ties at the cut are ordered by a hash of the
    point's key. No global sort takes place.
    """
    mean = sum((F.col(f) for f in features[1:]), F.col(features[0])) / len(features)
    data = points.withColumn("_mean", mean)
    n = data.count()
    low = n // 2
    if low == 0:
        return data.withColumn("half", F.lit(1)).drop("_mean")
    cut = values_at_ranks(data, "_mean", [low])[low]
    below, at = data.agg(F.count_if(F.col("_mean") < cut), F.count_if(F.col("_mean") == cut)).first()
    tie = F.xxhash64("read_name", "offset").cast("double")
    need = low - below
    if need == at:
        is_low = F.col("_mean") <= cut
    else:
        edge = values_at_ranks(data.where(F.col("_mean") == cut).withColumn("_tie", tie), "_tie", [need])[need]
        is_low = (F.col("_mean") < cut) | ((F.col("_mean") == cut) & (tie <= edge))
    return data.withColumn("half", F.when(is_low, 0).otherwise(1)).drop("_mean")


def gaussian_halves(points: DataFrame, features: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean vector and sample covariance of the two halves."""
    halves = split_by_row_mean(points, features)
    aggs = [F.avg(f).alias(f"m_{f}") for f in features]
    aggs += [F.covar_samp(f, g).alias(f"c_{f}_{g}") for f in features for g in features]
    rows = {r["half"]: r for r in halves.groupBy("half").agg(*aggs).collect()}
    return [
        (np.array([rows[h][f"m_{f}"] for f in features]),
         np.array([[rows[h][f"c_{f}_{g}"] for g in features] for f in features]))
        for h in (0, 1)
    ]


def init_gmm(seqs: DataFrame, features: list[str] = FEATURES, *, bins: int = 501, comps: list[int] | None = None) -> Model:
    """From two multivariate normals fitted to the halves by feature mean.

    Every point gets responsibilities d_j / (d_0 + d_1), without mixing weights; the tables and
    emissions are their weighted counts and moments. Several passes: give it a written table.
    """
    comps = comps or [1] * len(features)
    halves = gaussian_halves(_points(seqs, features), features)
    inv = [(mu, np.linalg.inv(cov), -0.5 * np.linalg.slogdet(cov)[1]) for mu, cov in halves]
    base = default_emission(comps)
    shell = Model(np.full((bins, 2), 0.5), np.full((bins, 2, 2), 0.5), (base, base))
    layout = Layout(bins, comps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = layout.empty()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            b = Batch(rb, features)
            logs = []
            for mu, prec, ld in inv:
                off = b.x - mu[:, None]
                logs.append(ld - 0.5 * np.einsum("fn,fg,gn->n", off, prec, off))
            resp1 = 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
            g = np.stack([1.0 - resp1, resp1], axis=1)
            inner = np.ones(len(b.dist), bool)
            inner[b.start] = False
            at = np.flatnonzero(inner)
            np.add.at(stats["num"], b.dist[at], g[at - 1][:, :, None] * g[at][:, None, :])
            np.add.at(stats["pi"], b.dist[b.start], g[b.start])
            stats["gamma"] += g.sum(axis=0)
            stats["misc"][2] += len(b.length)
            _emission_sums(stats, shell, b.x, g)
        yield layout.pack(stats)

    stats = _sum_slots(seqs, work, ["dist", "prior", *features], layout)
    rows = stats["num"].sum(axis=2, keepdims=True)
    a = np.where(rows == 0, 0.5, stats["num"] / np.where(rows == 0, 1.0, rows))
    total = stats["pi"].sum(axis=1, keepdims=True)
    pi = np.where(total == 0, 0.5, stats["pi"] / np.where(total == 0, 1.0, total))
    model = Model(pi, a, _refit(shell, stats, len(features)))
    return replace(model, methylated=methylated_state(model))


# --- decoding ---------------------------------------------------------------------------------


def viterbi(b: Batch, model: Model, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """State of every point and log-probability of every fragment's path.

    Predecessors are chosen by prior-corrected scores, but the path keeps the uncorrected ones. A
    state is methylated when its share exceeds the other's by more than ``threshold``; ties and
    undefined shares are unmethylated.
    """
    m = model.methylated
    u = 1 - m
    n = len(b.dist)
    score = np.stack([model.emit[i].score(b.x) for i in (0, 1)], axis=1)
    f = model.bayes_factor
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ln_score = np.log(score)
        ln_a = np.log(model.a)
        total = score.sum(axis=1)
        pm = score[:, m] / total * (0.5 - f / 2 + b.prior * f)
        pu = score[:, u] / total * (0.5 + f / 2 - b.prior * f)
        ln_post = np.empty((n, 2))
        ln_post[:, m], ln_post[:, u] = np.log(pm / (pm + pu)), np.log(pu / (pm + pu))
        delta = np.empty((n, 2))
        back = np.zeros((n, 2), np.int8)

        def prefer_m(du: np.ndarray, dm: np.ndarray) -> np.ndarray:
            eu, em = np.exp(-du), np.exp(-dm)
            return em / (eu + em) > eu / (eu + em) + threshold

        first = b.step(0)
        delta[first] = -np.log(model.pi[b.dist[first]]) - ln_score[first]
        for t in range(1, b.max_len):
            at = b.step(t)
            prev = at - 1
            arc = ln_a[b.dist[at]]
            fix = ln_score[prev] - ln_post[prev]
            for j in (0, 1):
                pick_m = prefer_m(delta[prev, u] + fix[:, u] - arc[:, u, j], delta[prev, m] + fix[:, m] - arc[:, m, j])
                src = np.where(pick_m, m, u)
                back[at, j] = src
                delta[at, j] = np.where(pick_m, delta[prev, m] - arc[:, m, j], delta[prev, u] - arc[:, u, j]) - ln_score[at, j]
        last = b.start + b.length - 1
        end_m = prefer_m(delta[last, u], delta[last, m])
    states = np.empty(n, np.int32)
    states[last] = np.where(end_m, m, u)
    lnp = -delta[last, states[last]]
    for t in range(b.max_len - 2, -1, -1):
        nxt = b.step(t + 1)
        states[nxt - 1] = back[nxt, states[nxt]]
    return states, lnp


def decode(seqs: DataFrame, model: Model, features: list[str] = FEATURES, threshold: float = 0.0) -> DataFrame:
    """Add ``states`` (per point) and ``ln_prob`` to every fragment; narrow, no shuffle."""
    carried = [f for f in seqs.schema.fields if f.name not in ("states", "ln_prob")]
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    schema = StructType([*carried, StructField("states", ArrayType(IntegerType())), StructField("ln_prob", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows == 0:
                continue
            b = Batch(rb, features)
            states, lnp = viterbi(b, model, threshold)
            in_order = np.empty(len(lnp))
            in_order[b.order] = lnp
            offsets = rb.column("dist").offsets
            offsets = pa.array(np.asarray(offsets) - offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*rb.columns, pa.ListArray.from_arrays(offsets, pa.array(states)), pa.array(in_order)],
                names=[*rb.schema.names, "states", "ln_prob"],
            )

    return seqs.mapInArrow(work, schema)


def decoded_points(decoded: DataFrame) -> DataFrame:
    """One row per decoded point."""
    return decoded.select("read_name", F.inline(F.arrays_zip("locus", "offset", "prior", "obs", F.col("states").alias("state")))).select(
        "read_name", "locus.*", "offset", "prior", "obs", "state"
    )


def predictions(points: DataFrame, model: Model) -> DataFrame:
    """Predicted and observed methylation per locus."""
    t = points.groupBy("chr", "start_", "end_").agg(
        F.count_if(F.col("state") == model.methylated).alias("methy_count_predict"),
        F.count(F.lit(1)).alias("total_count_predict"),
        F.sum("obs").cast("long").alias("methy_count_obs"),
        F.count("obs").alias("total_count_obs"),
    )
    return t.select(
        "chr", "start_", "end_",
        (100.0 * F.col("methy_count_predict") / F.col("total_count_predict")).alias("methy_perc_predict"),
        "methy_count_predict", "total_count_predict",
        F.try_divide(100.0 * F.col("methy_count_obs"), F.col("total_count_obs")).alias("methy_perc_obs"),
        "methy_count_obs", "total_count_obs",
    )


def prediction_correlation(pred: DataFrame) -> DataFrame:
    """Pearson r and p-value of predicted against observed percentages."""
    x, y = F.col("methy_perc_predict"), F.col("methy_perc_obs")
    s = pred.where(y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    r = pearson_from_sums(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return s.select("n", r.alias("r")).withColumn("p", pearson_p(F.col("r"), F.col("n")))


def confusion(points: DataFrame, model: Model) -> DataFrame:
    """Counts and accuracy over all, methylated and unmethylated observations."""
    is_m, pred_m = F.col("obs") == 1, F.col("state") == model.methylated
    t = points.where(F.col("obs").isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_m == pred_m).alias("n_correct"),
        F.count_if(is_m).alias("n_m"), F.count_if(is_m & pred_m).alias("n_m_correct"),
        F.count_if(~is_m).alias("n_u"), F.count_if(~is_m & ~pred_m).alias("n_u_correct"),
    )
    pct = {n: F.try_divide(100.0 * F.col(f"{n}_correct"), F.col(n)).alias(f"{n}_accuracy") for n in ("n", "n_m", "n_u")}
    return t.select("*", *pct.values())


def likelihood_per_point(decoded: DataFrame) -> DataFrame:
    """Sum over fragments of path log-probability per point, undefined ones left out."""
    ok = F.col("ln_prob").isNotNull() & ~F.isnan("ln_prob") & (F.abs("ln_prob") < float("inf"))
    return decoded.where(ok).agg(F.sum(F.col("ln_prob") / F.col("n")).alias("likelihood"), F.count(F.lit(1)).alias("n_fragments"))


def roc(seqs: DataFrame, model: Model, features: list[str] = FEATURES, thresholds: list[float] = ROC_THRESHOLDS, *,
        random_prior: bool = False, seed: int = 2017) -> DataFrame:
    """False and true positive rate per threshold, from one scan.

    Every task decodes its batches at each threshold and emits four counts per threshold. With
    ``random_prior`` states are drawn at random with the prior plus the threshold as probability,
    seeded by the point.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(thresholds), 4), np.int64)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            b = Batch(rb, features)
            obs = rb.column("obs").flatten().to_numpy(zero_copy_only=False).astype(float)
            draw = rb.column("draw").flatten().to_numpy(zero_copy_only=False) if random_prior else None
            for k, p in enumerate(thresholds):
                state = (draw < b.prior + p).astype(int) if random_prior else viterbi(b, model, p)[0]
                is_m, hit = obs == 1, state == obs
                counts[k] += [is_m.sum(), (is_m & hit).sum(), (obs == 0).sum(), ((obs == 0) & hit).sum()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(thresholds), *[pa.array(counts[:, c]) for c in range(4)]], names=["threshold", "n_m", "m_hit", "n_u", "u_hit"]
        )

    cols = ["dist", "prior", *features, "obs"]
    data = seqs.select(*cols, *(["read_name", "offset"] if random_prior else []))
    if random_prior:
        unit = F.transform("offset", lambda o: F.pmod(F.xxhash64(F.lit(seed), F.col("read_name"), o), F.lit(1 << 40)) / float(1 << 40))
        data = data.withColumn("draw", unit).drop("read_name", "offset")
    parts = data.mapInArrow(work, "threshold double, n_m long, m_hit long, n_u long, u_hit long")
    t = parts.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("n_m", "m_hit", "n_u", "u_hit")])
    return t.select(
        "threshold", "n_m", "n_u", F.try_divide(F.col("n_u") - F.col("u_hit"), F.col("n_u")).alias("fpr"),
        F.try_divide("m_hit", "n_m").alias("tpr"),
    )

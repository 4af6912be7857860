"""Toxicity by non-negative positive-unlabelled learning (operator 8).

Confirmed toxic documents are the positives; documents without a label are the unlabelled ones. A
linear model over word features is fitted in numpy to the class-prior-corrected risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

whose second part is stepped back when it falls below zero, which keeps the model from fitting the
unlabelled set as if it were clean. The prior is the toxic share among labelled rows.

Features are the distinct words of a text and, hashed with how many of its words (one, two, three) have
them, the first 4 and 5 letters of longer ones. Those are kept that positives have more often by a
log-likelihood ratio that less than one of all tested features would reach by chance, so the bar grows
with the logarithm of their number and not with the table; and whose frequency among positives over
that among unlabelled texts is, at the lower end of its confidence interval, at least MIN_LIFT of what
it can be (at most MAX_FEATURES, the surest; each is a number that the driver holds).

Bounds: the fit takes at most MAX_POSITIVES confirmed and MAX_UNLABELLED unlabelled documents, those
with the least hash of the id; only these ids and the kept features' hits reach the driver. Scores
cover every whole text.

Labels are read from rows with crc32(doc_id as text) % 5 != 0 only; the others are held out.

Defined cases: null text is empty; a text without known features scores the model's base rate; with
no positives or nothing unlabelled every score is the prior (0 if there is no label); a document
labelled twice counts as toxic if any label says so; null ids in either table are scored but never
learnt from; repeated rows are scored each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_pass, drop_table, materialize, texts

FOLDS = 5
MAX_POSITIVES, MAX_UNLABELLED = 4_000, 12_000
BUCKETS = 1 << 20
PREFIXES, COUNTS = (4, 5), (2, 3)
MAX_FEATURES, MIN_HITS, SURE, MIN_LIFT = 8_192, 3, 1.64, 0.35
STEPS, RATE, L2, BETA = 1000, 0.05, 1e-5, 0.02
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_features(word: str) -> tuple[int, tuple[int, ...]]:
    """The word's own feature, and those of its beginnings."""
    named = lambda x: zlib.crc32(x.encode()) % BUCKETS
    return named("w" + word), tuple(named("p" + word[:k]) for k in PREFIXES if len(word) > k)


def counted(feature: int, n: int) -> int:
    """The feature of n words with the same beginning."""
    return zlib.crc32(b"%d words of %d" % (n, feature)) % BUCKETS


def text_features(text: str) -> list[int]:
    found, starts = set(), Counter()
    for w in set(WORD.findall(text.lower())):
        own, beginnings = word_features(w)
        found.add(own)
        starts.update(beginnings)
    found.update(starts)
    found.update(counted(f, n) for n in COUNTS for f, k in starts.items() if k >= n)
    return sorted(found)


@dataclass
class Model:
    """score = sigmoid(bias + the sum of the weights of the features in a text)"""

    prior: float = 0.0
    bias: float | None = None  # None: nothing could be learnt
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        kept: dict[str, tuple] = {}
        weights = self.weights
        # Beginnings of which some count has a weight, with the weight from each count on.
        counts: dict[int, list] = {}

        def weighed(feature: int) -> bool:
            if feature not in counts:
                counts[feature] = [(n, weights[x]) for n in (1, *COUNTS) if (x := counted(feature, n) if n > 1 else feature) in weights]
            return bool(counts[feature])

        def hits(word: str) -> tuple:
            own, beginnings = word_features(word)
            got = (own if own in weights else None, tuple(f for f in beginnings if weighed(f)))
            if len(kept) >= 400_000:
                kept.clear()
                counts.clear()
                got = (got[0], tuple(f for f in beginnings if weighed(f)))
            kept[word] = got = got if got[0] is not None or got[1] else ()
            return got

        def score(text: str) -> float:
            if self.bias is None:
                return self.prior
            found: dict[int, float] = {}
            starts: dict[int, int] = {}
            for w in set(WORD.findall(text.lower())):
                got = kept.get(w)
                if got is None:
                    got = hits(w)
                if got:
                    if got[0] is not None:
                        found[got[0]] = weights[got[0]]
                    for f in got[1]:
                        starts[f] = starts.get(f, 0) + 1
            for f, k in starts.items():
                weighed(f)
                for n, w in counts[f]:
                    if k >= n:
                        found[counted(f, n) if n > 1 else f] = w
            total = self.bias + sum(found[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))

        return score


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Risk:
    """The two parts of the risk and their gradients over a sample; rows and columns are the
    coordinates of the features present. The last weight is the bias."""

    def __init__(self, p_rows, p_cols, n_p: int, u_rows, u_cols, n_u: int, n_features: int, prior: float) -> None:
        self.p, self.u, self.n_features, self.prior = (p_rows, p_cols, n_p), (u_rows, u_cols, n_u), n_features, prior

    def _scores(self, rows, cols, n, w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, w[cols], n) + w[-1]

    def _back(self, rows, cols, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, g[rows], self.n_features), g.sum())

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """Positive part and its gradient; negative part, not yet cut at 0, and its gradient."""
        zp, zu = self._scores(*self.p, w), self._scores(*self.u, w)
        softplus = lambda z: np.logaddexp(0, z)
        positive = self.prior * softplus(-zp).mean()
        g_positive = self.prior * self._back(*self.p[:2], -_sigmoid(-zp) / self.p[2])
        negative = softplus(zu).mean() - self.prior * softplus(zp).mean()
        g_negative = self._back(*self.u[:2], _sigmoid(zu) / self.u[2]) - self.prior * self._back(*self.p[:2], _sigmoid(zp) / self.p[2])
        return positive, g_positive, negative, g_negative


def fit_nnpu(p_rows: np.ndarray, p_cols: np.ndarray, n_p: int, u_rows: np.ndarray, u_cols: np.ndarray, n_u: int, n_features: int, prior: float) -> tuple[float, np.ndarray]:
    """Adam over the whole sample: bias and weights."""
    risk = Risk(p_rows, p_cols, n_p, u_rows, u_cols, n_u, n_features, prior)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        _, g_positive, negative, g_negative = risk(w)
        g = -g_negative if negative < -BETA else g_positive + g_negative
        g[:-1] += L2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(w[-1]), w[:-1]


def _hits(keep: set[int] | None):
    """(role, row, feature) of the sample's texts."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            role, row, feature = [], [], []
            for r, i, t in zip(*(batch.column(x).to_pylist() for x in ("positive", "row", "text")), strict=True):
                own = text_features(t)
                own = own if keep is None else [f for f in own if f in keep]
                feature += own
                role += [r] * len(own)
                row += [i] * len(own)
            return pa.record_batch([pa.array(role, pa.bool_()), pa.array(row, pa.int64()), pa.array(feature, pa.int64())], names=["positive", "row", "feature"])

        return work

    return make


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = known.where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    share = learn.agg(F.avg(F.col("toxic").cast("double")).alias("share")).first().share or 0.0
    plain = texts(docs, id_col, text_col).where("doc_id is not null")
    positive = learn.where("toxic = 1").select("doc_id").join(plain.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(MAX_POSITIVES)
    unlabelled = plain.select("doc_id").distinct().where(~held_out(F.col("doc_id"))).join(known.select("doc_id"), "doc_id", "left_anti").orderBy(order, "doc_id").limit(MAX_UNLABELLED)
    # Ids of the sample: at most MAX_POSITIVES + MAX_UNLABELLED longs, so the broadcast is bounded.
    ids = [(r.doc_id, p, k) for p, frame in ((True, positive), (False, unlabelled)) for k, r in enumerate(frame.collect())]
    n_p, n_u = sum(p for _, p, _ in ids), sum(not p for _, p, _ in ids)
    if not n_p or not n_u or share >= 1:
        return Model(share)
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, positive boolean, row long"))
    sample = plain.join(chosen, "doc_id").select("positive", "row", "text")

    seen = arrow_pass(sample, _hits(None), "positive boolean, row long, feature long").distinct()
    counts = seen.groupBy("feature").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    counts = materialize(counts.where(F.col("p") >= MIN_HITS), "features")
    # A feature that toxic texts alone have is 1 / prior times as frequent among positives; what can't
    # be told from a weaker one goes, or long clean texts would add such features up.
    p, u = F.col("p") + 0.5, F.col("u") + 0.5
    lift = F.log(p / n_p) - F.log(u / n_u) - SURE * F.sqrt(1 / p + 1 / u)
    both, n = F.col("p") + F.col("u"), n_p + n_u
    part = lambda seen, share_of, size: F.when(seen > 0, seen * F.log(seen * n / (share_of * size))).otherwise(0.0)
    ratio = 2 * (part(F.col("p"), both, n_p) + part(F.col("u"), both, n_u) + part(n_p - F.col("p"), n - both, n_p) + part(n_u - F.col("u"), n - both, n_u))
    bar = 2 * float(np.log(max(counts.count(), 1)))
    least = float(np.log(MIN_LIFT / max(share, 0.01)))
    told = (F.col("p") * n_u > F.col("u") * n_p) & (ratio >= bar)
    kept = [r.feature for r in counts.where(told).withColumn("lift", lift).where(F.col("lift") >= least).orderBy(F.desc("lift"), "feature").limit(MAX_FEATURES).collect()]
    drop_table(counts)
    if not kept:
        return Model(share)
    place = {f: k for k, f in enumerate(sorted(kept))}
    hits = arrow_pass(sample, _hits(set(kept)), "positive boolean, row long, feature long").distinct().toArrow()
    role, row, feature = (hits.column(x).to_numpy() for x in ("positive", "row", "feature"))
    role, col = role.astype(bool), np.array([place[f] for f in feature.tolist()], int)
    at = np.lexsort((col, row, ~role))  # the sums don't depend on the order in which tasks end
    role, row, col = role[at], row[at], col[at]
    bias, w = fit_nnpu(row[role], col[role], n_p, row[~role], col[~role], n_u, len(place), min(max(share, 1e-4), 0.9))
    return Model(share, bias, {f: float(w[k]) for f, k in place.items()})


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row, and `keep`: other columns to carry along."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*keep, F.lit(True).alias("_row")).alias("_kept"))

    def make():
        of = model.scorer()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([of(t or "") for t in batch.column("text").to_pylist()], pa.float64())
            return pa.record_batch([*(batch.column(x) for x in ("doc_id", *kept)), found], names=["doc_id", *kept, "score"])

        kept = ("text", "_kept") if keep else ()
        return work

    schema = "doc_id long" + (f", text string, _kept {plain.schema['_kept'].dataType.simpleString()}" if keep else "") + ", score double"
    scored = arrow_pass(plain if keep else plain.drop("_kept"), make, schema)
    scored = scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return scored.select("doc_id", "held_out", "score", "predicted", *(["text", *(F.col(f"_kept.`{x}`").alias(x) for x in keep)] if keep else []))

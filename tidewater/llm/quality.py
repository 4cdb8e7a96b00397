"""Quality by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import extended, map_batches, remainder, table

#: The classifier is fitted on about so many trusted positives and so many unlabelled documents, picked by a hash of the id.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 20_000, 20_000
THRESHOLD = 0.3
BINS = 8
SEED = 7
FEATURES = 20
_CLASSES = np.zeros((8, 256))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[0, _b] = _b < 128 and _c.isupper()
    _CLASSES[1, _b] = _b < 128 and _c.isalpha()
    _CLASSES[2, _b] = _b < 128 and _c.isdigit()
    _CLASSES[3, _b] = _c in ".,;:?'\"()-"
    _CLASSES[4, _b] = _c in "$%#&*@^~=<>\\/{}[]_+`"
    _CLASSES[5, _b] = _c == "!"
    _CLASSES[6, _b] = _c == "|"
    _CLASSES[7, _b] = _c in "aeiouAEIOU"


def features(text: str | None) -> list[float]:
    """Shape of the whole text: lengths, shares of character classes, repetition of words, phrases and lines. Null is as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    shares = (_CLASSES @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)).tolist()
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    ends = sum(w[-1] in ".,;:?" for w in counts) / max(1, len(counts))
    marked = sum(c for w, c in counts.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(sum(map(len, words)) / k),
        shares[0] / max(1.0, shares[1]), shares[1] / n, shares[2] / n, shares[3] / n, shares[4] / n, shares[5] / n, shares[6] / n,
        shares[7] / max(1.0, shares[1]), len(counts) / k, max(counts.values(), default=0) / k,
        sum(c for w, c in counts.items() if len(w) <= 3) / k, ends, marked / k,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(k / max(1, len(lines))),
        1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 0.0,
        len(zlib.compress(raw, 1)) / n,
    ]


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    docs = docs.drop("_features")
    schema = extended(docs, "_features array<double>").fields
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        for pdf in batches:
            yield pdf[rest].assign(_features=[features(t) for t in pdf[text_col]])

    return map_batches(docs, run, type(docs.schema)([f for f in schema if f.name != text_col]))


class Model:
    """A logistic model over standardised features and their quantile bins."""

    def __init__(self, sample: np.ndarray):
        self.mean, self.scale = sample.mean(axis=0), sample.std(axis=0) + 1e-9
        self.edges = np.quantile(sample, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        self.weights = np.zeros(1 + FEATURES * (1 + BINS))
        self.constant: float | None = None

    def inputs(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -4, 4)]
        for j in range(FEATURES):
            parts.append(np.eye(BINS)[np.searchsorted(self.edges[:, j], x[:, j], side="right")])
        return np.concatenate(parts, axis=1).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def descend(model: Model, xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> None:
    """Adam on max(0, R_u(-) - prior R_p(-)) + prior R_p(+), logistic loss. Where the unlabelled part turns negative, only that
    part is followed, upwards, as the non-negative estimator prescribes."""
    w = np.zeros(xp.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        gp, gu = xp @ w, xu @ w
        up, uu = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative = uu @ xu / len(xu) - prior * (up @ xp) / len(xp)
        grad = -d_negative if negative < 0 else d_negative + prior * ((up - 1) @ xp) / len(xp)
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights = w


def class_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """Share of positives among the unlabelled: the smallest ratio, over score thresholds, of the share of unlabelled to that of
    positives above it, with a margin for the size of the samples. Scores come from positives against unlabelled, fitted on one half and
    read on the other, in turn: on what it was fitted to, a model tells positives from unlabelled ones that are no different."""
    found = []
    for half in (0, 1):
        (fp, rp), (fu, ru) = (xp[half::2], xp[1 - half :: 2]), (xu[half::2], xu[1 - half :: 2])
        if not min(map(len, (fp, rp, fu, ru))):
            continue
        x, y = np.concatenate([fp, fu]), np.concatenate([np.ones(len(fp)), np.zeros(len(fu))])
        weight = np.where(y == 1, 0.5 / len(fp), 0.5 / len(fu))
        w = np.zeros(x.shape[1])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 151):
            grad = (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) @ x + 1e-3 * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        sp, su = np.sort(rp @ w), np.sort(ru @ w)
        cuts = np.quantile(sp, np.linspace(0, 0.9, 181))
        qp = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
        qu = 1 - np.searchsorted(su, cuts, side="left") / len(su)
        margin = math.sqrt(math.log(4 / 0.1) / 2) * (1 / math.sqrt(len(sp)) + 1 / math.sqrt(len(su)))
        best = int(np.argmin((qu + margin) / qp))
        found.append(qu[best] / qp[best])
    return float(np.clip(np.mean(found), 0.05, 0.98)) if found else 0.5


def share(total: int, wanted: int, key, salt: str):
    """Whether a row's hash falls in the share of rows that is wanted."""
    return F.pmod(F.xxhash64(F.lit(salt), key.cast("string")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / max(1, total)))


def train(
    docs: DataFrame, labels: DataFrame, learnable, id_col: str = "doc_id", text_col: str = "text",
    sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED,
) -> Model:
    """Fit on documents for which ``learnable(id)`` holds: those labelled 1 are the positives, any others stand for web text.

    Labels 0 are not used. Nothing to learn from (no positive or no unlabelled document): every score is 0.5.
    """
    trusted = (
        labels.select(F.col(id_col).alias("_id"), "quality").where(learnable(F.col("_id")) & F.col("quality").isNotNull())
        .groupBy("_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("_id")
    )
    trusted = trusted.where(share(trusted.count(), sample_positive, F.col("_id"), "positive"))
    ids = [r["_id"] for r in trusted.limit(2 * sample_positive).collect()]
    positives = docs.sparkSession.createDataFrame([(i,) for i in ids], "_id long").withColumn("_positive", F.lit(True))
    sample = (
        docs.select(F.col(id_col).alias("_id"), text_col).where(learnable(F.col("_id")))
        .withColumn("_unlabelled", share(docs.count(), sample_unlabelled, F.col("_id"), "unlabelled"))
        .join(F.broadcast(positives), "_id", "left").where("_positive or _unlabelled")
    )
    rows = with_features(sample.select("_positive", "_unlabelled", text_col), text_col).toPandas()
    x = np.array(rows["_features"].tolist(), dtype=float).reshape(len(rows), FEATURES)
    is_p, is_u = rows["_positive"].eq(True).to_numpy(bool), rows["_unlabelled"].to_numpy(bool)
    if not is_p.any() or not is_u.any():
        model = Model(np.zeros((1, FEATURES)))
        model.constant = 0.5
        return model
    model = Model(x[is_u])
    xp, xu = model.inputs(x[is_p]), model.inputs(x[is_u])
    model.prior = class_prior(xp, xu)
    descend(model, xp, xu, model.prior)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on) to every row; null text is scored as empty text.

    Repeated rows are scored alike; an empty table gives an empty result; input columns of the two names are replaced.
    """
    docs = docs.drop("score", "predicted")

    def run(batches):
        for pdf in batches:
            x = np.array([features(t) for t in pdf[text_col]], dtype=float).reshape(len(pdf), FEATURES)
            s = model.scores(x)
            yield pdf.assign(score=s, predicted=(s >= threshold).astype("int32"))

    return map_batches(docs, run, extended(docs, "score double, predicted int"))


def learnable(key):
    """Rows whose labels may be learned: crc32 of the id mod 5 is not 0."""
    return F.coalesce(remainder(key, 5) != 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learnable)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.withColumn("held_out", held), model).drop("text")

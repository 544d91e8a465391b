"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts without labels (U) train a numpy classifier. Its risk is that of a classifier of
toxic against clean text: the clean part of U is what is left when the toxic share, the class prior, is taken out; as
that difference can't be negative for any classifier, training steps back where it is on the sample.

Features are the presence of words and of 5-byte grams inside words, hashed; the most telling ones are chosen on the
training sample, under the same correction for the prior.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.store import free_names, in_training_folds, materialise


@dataclass(frozen=True)
class Settings:
    """positives and unlabelled: texts of the training sample at most; those with the smallest hash of doc_id and text
    are taken. prior: share of toxic text, None to take that of the labelled rows of the training folds."""

    positives: int = 5000
    unlabelled: int = 10000
    slots_log2: int = 20
    features: int = 1024
    gram: int = 5
    least: float = 3.5
    prior: float | None = None
    epochs: int = 300
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 5


def slots_of(text: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of a chunk's words and grams, and the text that each is of."""
    low = K.LOWER[text]
    starts, ends = K.word_bounds(low, offsets, K.ALNUM[low])
    words, at = K.word_hashes(text, offsets, K.ALNUM)
    grams, where = K.gram_hashes(low, starts, ends, s.gram)
    shift = K.U64(64 - s.slots_log2)
    slots = np.concatenate((words >> shift, grams >> shift)).astype(np.int64)
    doc = np.concatenate((np.repeat(np.arange(len(at) - 1), np.diff(at)), np.searchsorted(offsets, where, "right") - 1))
    return slots, doc


def presence(text: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the chosen features that occur, each pair once. chosen: slot to feature, or -1."""
    slots, doc = slots_of(text, offsets, s)
    feature = chosen[slots]
    hit = feature >= 0
    pairs = np.unique(doc[hit] * (1 << 32) + feature[hit])
    return pairs >> 32, pairs & 0xFFFFFFFF


def select_features(df_p: np.ndarray, n_p: int, df_u: np.ndarray, n_u: int, prior: float, k: int, least: float) -> np.ndarray:
    """Slots whose share in P is most above that in the clean part of U, in standard errors: least of them or more.

    Only such evidence counts; what P merely lacks says more of length and language than of toxicity."""
    p, u = df_p / max(1, n_p), df_u / max(1, n_u)
    clean = np.clip((u - prior * p) / (1 - prior), 0, 1)
    error = np.sqrt((p * (1 - p) + 1 / max(1, n_p)) / max(1, n_p) + (clean * (1 - clean) + 1 / max(1, n_u)) / max(1, n_u))
    z = (p - clean) / error
    top = np.argsort(-z, kind="stable")[:k]
    return top[z[top] >= least]


def prior_seen(df_p: np.ndarray, n_p: int, df_u: np.ndarray, n_u: int, prior: float, features: int = 20, least_rows: int = 20) -> float:
    """The prior, or less where the sample shows that it must be less.

    A feature of toxic text alone is in U as often as in P times the toxic share of U; of features that other text
    has too it is more often. So no more of U is toxic than the ratio of the most particular common features says.
    """
    top = select_features(df_p, n_p, df_u, n_u, prior, 4 * features, 3.5)
    top = top[df_p[top] >= least_rows][:features]
    if not len(top) or not n_u:
        return prior
    ratio = (df_u[top] / n_u) / (df_p[top] / n_p)
    return float(np.clip(min(prior, np.median(ratio)), 1e-3, 0.9))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def nonnegative_pu_fit(xp: np.ndarray, xu: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk after each epoch of a linear classifier under the logistic loss.

    Risk: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)). Where the second term is below 0, the step goes up its
    gradient instead, as the estimator's authors do.
    """
    r = np.random.default_rng(s.seed)
    d = xp.shape[1]
    w, b = r.normal(0, 1e-3, d), float(np.log(prior / (1 - prior)))
    m, v, risks = np.zeros(d + 1), np.zeros(d + 1), []

    def gradient(x, slope):
        return np.append(slope.astype(np.float32) @ x, slope.sum()) / max(1, len(x))

    for t in range(1, s.epochs + 1):
        w32 = w.astype(np.float32)
        zp, zu = (xp @ w32).astype(float) + b, (xu @ w32).astype(float) + b
        pp, pu = sigmoid(zp), sigmoid(zu)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risks.append(float(prior * np.logaddexp(0, -zp).mean() + max(0.0, clean)))
        g_clean = gradient(xu, pu) - prior * gradient(xp, pp)
        g = prior * gradient(xp, pp - 1) + g_clean if clean >= 0 else -g_clean
        g[:d] += s.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:d], b - float(step[d])
    return w, b, risks


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict:
    """The model: slots, weights, bias and prior. Only rows outside fold 0 are read, and of labels only toxic.

    Without confirmed toxic texts the model has no features and scores every text by the prior. Of several labels of
    one document the toxic one counts; texts of one id are texts of their own, and repeats of one count once.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(in_training_folds(F.col("doc_id")))
    known = known.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    n, toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = s.prior if s.prior is not None else toxic / n if n else 0.01
    prior = min(max(prior, 1e-3), 0.9)
    if not toxic:
        return {"slots": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log(prior / (1 - prior))), "prior": prior, "settings": s}
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").where(in_training_folds(F.col("doc_id")))
    key = ["doc_id", "h"]
    narrow = own.select("doc_id", F.xxhash64("text").alias("h"))
    # P and U: the least of a hash, without the repeats of a text under one id; each task keeps as many as are wanted
    least = lambda df, many, label: df.distinct().orderBy(F.xxhash64(*key), *key).limit(many).withColumn("label", F.lit(label))
    p = least(narrow.join(known.where("toxic = 1").select("doc_id"), "doc_id"), s.positives, 1)
    u = least(narrow, s.unlabelled, 0)
    sample = F.broadcast(materialise(p.unionByName(u), "toxicity-sample"))  # at most positives + unlabelled keys
    rows = own.withColumn("h", F.xxhash64("text")).join(sample, key).dropDuplicates([*key, "label"]).select("label", "text")
    rows = materialise(rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "toxicity-texts")

    def frequencies(batches):
        df, seen = np.zeros((2, 1 << s.slots_log2), np.int32), [0, 0]
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False)
            for first, end, text, offsets in K.chunks(K.text_column(b)):
                slots, doc = slots_of(text, offsets, s)
                pairs = np.unique(doc << s.slots_log2 | slots)
                side = label[first:end][pairs >> s.slots_log2]
                for y in (0, 1):
                    df[y] += np.bincount(pairs[side == y] & (1 << s.slots_log2) - 1, minlength=1 << s.slots_log2).astype(np.int32)
            seen[1] += int(label.sum())
            seen[0] += int((1 - label).sum())
        at = np.flatnonzero(df.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[1][at], seen[1]).astype(np.int64)), pa.array(np.append(df[0][at], seen[0]).astype(np.int64))], ["slot", "p", "u"])

    # at most a row for each slot that P has; slot -1 counts texts
    counted = rows.mapInArrow(frequencies, "slot long, p long, u long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p > 0 OR slot = -1").toPandas()
    total = counted[counted["slot"] == -1].iloc[0]
    counted, n = counted[counted["slot"] >= 0], [int(total["u"]), int(total["p"])]
    df = np.zeros((2, 1 << s.slots_log2), np.int64)
    df[1][counted["slot"]], df[0][counted["slot"]] = counted["p"], counted["u"]
    share = prior if s.prior is not None else prior_seen(df[1], n[1], df[0], n[0], prior)
    top = select_features(df[1], n[1], df[0], n[0], share, s.features, s.least)
    sent = docs.sparkSession.sparkContext.broadcast(top)

    def features(batches):
        chosen = np.full(1 << s.slots_log2, -1, np.int64)
        chosen[sent.value] = np.arange(len(sent.value))
        for b in batches:
            for first, end, text, offsets in K.chunks(K.text_column(b)):
                doc, feature = presence(text, offsets, chosen, s)
                x = np.zeros((end - first, len(sent.value)), bool)
                x[doc, feature] = True
                yield pa.RecordBatch.from_arrays([b.column("label").slice(first, end - first), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["label", "x"])

    def fit(batches):
        x = [[], []]
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False)
            bits = np.array([np.unpackbits(np.frombuffer(r, np.uint8), count=len(sent.value)) for r in b.column("x").to_pylist()]).reshape(b.num_rows, len(sent.value))
            for y in (0, 1):
                x[y].append(bits[label == y])
        # sorted, so that the order of rows, which is Spark's, doesn't matter
        x = [np.concatenate(part) if part else np.zeros((0, len(sent.value)), np.uint8) for part in x]
        x = [part[np.lexsort(part.T[::-1])].astype(np.float32) if part.shape[1] else part.astype(np.float32) for part in x]
        w, b, _ = nonnegative_pu_fit(x[1], x[0], share, s)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps({"slots": top, "weights": w, "bias": b, "prior": share, "settings": s})], pa.binary())], ["model"])

    # texts are read by all tasks; one task then holds the features' bits, at most positives + unlabelled rows of them
    held = rows.mapInArrow(features, "label int, x binary")
    return pickle.loads(bytes(held.repartition(1).mapInArrow(fit, "model binary").first()["model"]))


def scored(docs: DataFrame, model: dict) -> tuple[DataFrame, str]:
    """docs with a further column, and its name: the score, by a pass over the rows and without a join. Only text is
    read for it; a null or empty text has no features and gets the score of the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    read, name = free_names(["read", "score"], docs)

    def apply(batches):
        m = sent.value
        s = m["settings"]
        chosen = np.full(1 << s.slots_log2, -1, np.int64)
        chosen[m["slots"]] = np.arange(len(m["slots"]))
        for batch in batches:
            out = np.full(batch.num_rows, m["bias"])
            if len(m["slots"]):
                for first, end, text, offsets in K.chunks(K.text_column(batch, read)):
                    doc, feature = presence(text, offsets, chosen, s)
                    out[first:end] += np.bincount(doc, m["weights"][feature], end - first)
            yield K.extended(batch, [read], {name: pa.array(sigmoid(out))})

    return docs.withColumn(read, F.col("text").cast("string")).mapInArrow(apply, K.schema_with(docs, f"`{name}` double")), name


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; repeated rows each get their row."""
    out, name = scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", (~in_training_folds(F.col("doc_id"))).alias("held_out"), F.col(name).alias("score"), F.when(F.col(name) >= 0.5, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; the columns of docs, in which all other names are free.
    Only text decides, so that rows of one doc_id or without one each go or stay by their own. Without toxic labels
    none goes."""
    out, name = scored(docs, train(docs, labels, s))
    return out.where(F.col(name) < 0.5).select(*docs.columns)

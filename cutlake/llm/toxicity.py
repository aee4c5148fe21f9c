"""Toxic documents by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.llm import store, words
from cutlake.llm.carry import carried, restored

#: The most labelled rows of each class that are learnt from, and the most features kept.
TOXIC_ROWS, CLEAN_ROWS, FEATURES = 2000, 4000, 2000
PREFIXES = (4, 5, 6, 7)
LEAST_SHARE, LEAST_ODDS = 0.004, 3.0
ROUNDS, RATE, DECAY, START = 400, 0.1, 2e-4, -6.0
THRESHOLD = 0.7
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".!?\n"]] = True
_U = np.uint64


def fold(id: Column, folds: int) -> Column:
    """CRC-32 of an id as text modulo ``folds``."""
    return F.pmod(F.crc32(F.encode(id.cast("string"), "UTF-8")), F.lit(folds))


def instances(part: words.Texts) -> tuple[np.ndarray, list[np.ndarray], words.Words]:
    """Per word its sentence and its features: the word itself and its first bytes of several lengths (0: too short).

    A sentence ends with ``.``, ``!``, ``?``, a line or the text; sentences are
    numbered through the slice. The third value are the words.
    """
    found = part.words(words.LETTERS)
    marks = ENDS[part.data]
    heads = part.bounds[1:-1]
    cut = np.zeros(len(part.data) + 1, dtype=np.int64)
    np.cumsum(marks, out=cut[1:])
    cut[: len(part.data)] += np.searchsorted(heads, np.arange(len(part.data)), side="right")
    sentence = cut[found.starts]
    features = [found.hashes(), *map(found.head_hashes, PREFIXES)]
    return sentence, features, found


@dataclass
class Model:
    """Feature hashes (ascending), their weights, and the score of a sentence without any of them."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, part: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, words.Words]:
        """Log-odds per sentence that has words, its first word, and each word's sentence rank."""
        sentence, features, found = instances(part)
        value = np.zeros(len(found))
        for h in features:
            value += _lookup(self.features, self.weights, h)
        new = np.ones(len(found), dtype=bool)
        new[1:] = sentence[1:] != sentence[:-1]
        first = np.flatnonzero(new)
        z = np.add.reduceat(value, first) + self.bias if len(first) else np.zeros(0)
        return z, first, np.cumsum(new) - 1, found


def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0.0)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, training: Column, toxic_rows: int, clean_rows: int) -> DataFrame:
    """At most ``toxic_rows`` and ``clean_rows`` labelled rows of the training fold, chosen by a hash of the id; equal texts once."""
    known = labels.select(F.col(id).alias("_lid"), F.col(label).cast("int").alias("_y")).where(F.col("_lid").isNotNull() & F.col("_y").isin(0, 1))
    known = known.withColumnRenamed("_lid", id).where(training).withColumnRenamed(id, "_lid")
    order = [F.xxhash64("_lid"), F.col("_lid")]
    chosen = known.where("_y = 1").orderBy(*order).limit(toxic_rows).unionByName(known.where("_y = 0").orderBy(*order).limit(clean_rows))
    rows = docs.select(F.col(id).alias("_did"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = rows.join(F.broadcast(chosen), F.col("_did") == F.col("_lid")).select("text", F.col("_y").alias("y"))
    return store.keep(sample.dropDuplicates(["text", "y"]), "labelled")


def train(sample: DataFrame, features: int = FEATURES, rounds: int = ROUNDS) -> Model:
    """Fit sentence weights to the document labels of ``sample(text, y)``, a bounded table.

    Spark counts in how many documents of each class a feature stands; the features
    that are much more common in toxic ones are kept. The driver then fits
    ``P(toxic) = 1 - prod(1 - sigmoid(bias + sum of weights))`` over the sentences
    by gradient steps. Without labels of both classes no sentence is suspect.
    """
    def presence(batches):
        for batch in batches:
            y, seen = np.asarray(batch.column(1)), ([], [])
            for part in words.slices(batch.column(0), lower=True):
                _, every, found = instances(part)
                for i in range(len(part)):
                    a, b = found.first[i], found.first[i + 1]
                    seen[int(y[part.at + i])].append(np.unique(np.concatenate([h[a:b] for h in every])))
            for toxic in (0, 1):
                keys, n = np.unique(np.concatenate(seen[toxic] or [np.zeros(0, _U)]), return_counts=True)
                for at in range(0, len(keys), 100_000):
                    own, count = keys[at : at + 100_000].view(np.int64), n[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count * toxic), pa.array(count * (1 - toxic))], names=["feature", "toxic", "clean"])

    rows = sample.select("text", F.col("y").cast("int").alias("y"))
    none = Model(np.zeros(0, _U), np.zeros(0), 2 * START)
    sizes = dict(rows.groupBy("y").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return none
    counts = rows.mapInArrow(presence, "feature long, toxic long, clean long").where("feature <> 0").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = (F.col("a") + 0.5) / (n_toxic + 1) / ((F.col("b") + 0.5) / (n_clean + 1))
    good = counts.where((F.col("a") >= max(2, LEAST_SHARE * n_toxic)) & (odds >= LEAST_ODDS))
    best = good.orderBy((F.col("a") * F.log(odds)).desc(), "feature").limit(features).select("feature").collect()
    keys = np.sort(np.array([r.feature for r in best], dtype=np.int64).view(_U))
    if not len(keys):
        return none

    def bags(batches):
        for batch in batches:
            out, y = [], np.asarray(batch.column(1))
            for part in words.slices(batch.column(0), lower=True):
                sentence, every, found = instances(part)
                hits = [(h_at, np.searchsorted(keys, h[h_at])) for h in every for h_at in [np.flatnonzero(np.isin(h, keys))]]
                word = np.concatenate([w for w, _ in hits])
                which = np.concatenate([f for _, f in hits])
                text = np.searchsorted(found.first, word, side="right") - 1
                for i in range(len(part)):
                    a, b = found.first[i], found.first[i + 1]
                    own = text == i
                    pairs = np.unique(np.stack([sentence[word[own]], which[own]]), axis=1) if own.any() else np.zeros((2, 0), np.int64)
                    out.append((int(len(np.unique(sentence[a:b]))), pairs.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([n for n, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], names=["y", "sentences", "pairs"])

    bag = rows.mapInArrow(bags, "y int, sentences long, pairs binary").collect()
    return _fit(keys, bag, rounds)


def _fit(keys: np.ndarray, bag: list, rounds: int) -> Model:
    """Adam on the noisy-or likelihood; the two classes weigh the same."""
    y = np.array([r.y for r in bag], dtype=float)
    doc, row, col, plain, n = [], [], [], np.zeros(len(bag)), 0
    for i, r in enumerate(bag):
        sentence, which = np.frombuffer(r.pairs, np.int64).reshape(2, -1)
        own, at = np.unique(sentence, return_inverse=True)
        doc += [i] * len(own)
        row.append(at + n)
        col.append(which)
        n += len(own)
        plain[i] = r.sentences - len(own)
    doc, row, col = np.array(doc, dtype=np.int64), np.concatenate(row), np.concatenate(col)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(len(keys) + 1)
    theta[-1] = START
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(row, theta[col], minlength=n) + theta[-1]
        total = np.bincount(doc, _softplus(z), minlength=len(y)) + plain * _softplus(theta[-1])
        total = np.maximum(total, 1e-12)
        slope = weight * np.where(y == 1, -np.exp(-total) / -np.expm1(-total), 1.0)
        dz = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(col, dz[row], minlength=len(keys)), dz.sum() + (slope * plain).sum() / (1 + np.exp(-theta[-1])))
        grad[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(keys, theta[:-1], float(theta[-1]))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", suspect: float = 0.5) -> DataFrame:
    """``id, score, sentences`` of every whole text.

    ``score`` is the noisy-or of the sentences that score at least ``suspect``;
    ``sentences`` are their byte ranges and scores. The noisy-or of all sentences
    stands in where it is higher, up to ``suspect``: weak sentences order texts,
    but never pass it by their number. A text without words has no sentence and
    gets the score of one without features. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL("score double, sentences array<struct<start:long,end:long,score:double>>").fields]

    def run(batches):
        fitted = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, spans = np.empty(batch.num_rows), []
            for part in words.slices(batch.column(1), lower=True):
                z, first, _, found = fitted.sentences(part)
                soft, limit = _softplus(z), np.log(suspect) - np.log1p(-suspect)
                sums = np.concatenate(([0.0], np.cumsum(soft)))
                start = np.searchsorted(first, found.first)
                total = sums[start[1:]] - sums[start[:-1]] + np.where(start[1:] == start[:-1], _softplus(np.float64(fitted.bias)), 0.0)
                strong = np.concatenate(([0.0], np.cumsum(np.where(z >= limit, soft, 0.0))))
                total = np.maximum(strong[start[1:]] - strong[start[:-1]], np.minimum(total, -np.log1p(-suspect)))
                scores[part.at : part.at + len(part)] = np.clip(-np.expm1(-total), 0.0, 1.0)
                ends = np.append(first[1:], len(found)) - 1
                hot = np.flatnonzero(z >= limit)
                owner = np.searchsorted(start, hot, side="right") - 1
                listed = [[] for _ in range(len(part))]
                for s, i in zip(hot.tolist(), owner.tolist()):
                    base = int(part.bounds[i])
                    listed[i].append({"start": int(found.starts[first[s]]) - base, "end": int(found.ends[ends[s]]) - base, "score": float(1 / (1 + np.exp(-z[s])))})
                spans += listed
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, kind)], names=["id", "score", "sentences"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", training: Column | None = None, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """A model of the labelled rows for which ``training`` (a condition on ``id``) holds.

    Null labels and ids and labels other than 0 and 1 are left out.
    """
    own = F.lit(True) if training is None else training
    return train(labelled_sample(docs, labels, id, text, label, own, toxic_rows, clean_rows))


def drop_toxic(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    return restored(score(carried(docs, id, text), model, "_all", "_text").where(F.col("score") < threshold))

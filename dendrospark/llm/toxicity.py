"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is a bag of sentences.  A sentence's probability is logistic in the features of its
words (the word and its beginnings, so that inflected and composed forms share weight); the
document's is the noisy-or of its sentences, 1 - prod(1 - p).  Weights come from gradient steps
on the document loss alone, so sentences need no labels; afterwards the sentences with a high
probability say where the offence is.

Fitting takes a bounded sample: at most ``MOST_TRAINING`` labelled documents, those with the
smallest hash of their id, and the ``FEATURES`` features that tell the labels apart best in it.
Scoring covers all texts in full.  The fitted shift of the final score puts the cut that agrees
best with the training labels (on folds left out of the fit) at THRESHOLD.

Defined cases: null and empty texts have no sentence and get the lowest score of the scale;
labels that are null, or that contradict each other for one id, are not learned from; without
any labelled document, or with labels of one kind only, every score is the share of toxic labels (0
without any).  Of several texts under one id the least is learned from, and each is scored; repeated
rows are scored each; features that tie go by name, documents that tie by id; texts of any length are
scored whole; an empty table gives no rows.  Columns named ``score``, ``predicted``, ``spans`` or starting
with ``_`` cannot be kept (ValueError).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialise, own_names, rows_of

MOST_TRAINING = 12_000
FEATURES = 4096
THRESHOLD = 0.7
CACHED = 300_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]+")
BREAKS = frozenset(".!?\n")


def word_features(word: str) -> list[str]:
    """The word and its beginnings of three letters and more."""
    return [f"={word}", *(word[:n] for n in range(3, min(len(word), 8) + 1))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


class Model:
    """Feature weights, the bias of a sentence, and the affine map from log-odds to a score."""

    def __init__(self, weights: dict[str, float], bias: float, scale: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift
        self.known: dict[str, float | None] = dict.fromkeys(BREAKS)

    def __getstate__(self) -> tuple:
        return self.weights, self.bias, self.scale, self.shift

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def weigh(self, word: str) -> float:
        if len(self.known) > CACHED:
            self.known = dict.fromkeys(BREAKS)
        value = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return value

    def sentences(self, text: str) -> list[float]:
        """Log-odds of each sentence that has a word."""
        known, out, total, empty = self.known, [], self.bias, True
        for token in TOKEN.findall(text.lower()):
            value = known.get(token, 0)
            if value is None:
                if not empty:
                    out.append(total)
                total, empty = self.bias, True
                known = self.known
                continue
            if value == 0 and token not in known:
                value = self.weigh(token)
                known = self.known
            total += value
            empty = False
        if not empty:
            out.append(total)
        return out

    def raw(self, text: str) -> float:
        """Log-odds of the noisy-or of the text's sentences."""
        z = np.array(self.sentences(text))
        return noisy_or(z) if len(z) else -30.0

    def score(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30))))


def noisy_or(z: np.ndarray) -> float:
    """Log-odds of 1 - prod(1 - sigmoid(z))."""
    none = -np.logaddexp(0, z).sum()  # log of prod(1 - p)
    return float(np.clip(np.log(-np.expm1(min(none, -1e-12))) - none, -30, 30))


def hits(text: str, index: dict[str, int], cache: dict[str, list[int]]) -> tuple[int, list[int], list[int]]:
    """A document's number of sentences, and sentence and feature of each hit of a chosen feature."""
    n, rows, cols = 0, [], []
    for sentence in SENTENCE.findall(text.lower()):
        words = [w for w in TOKEN.findall(sentence) if w not in BREAKS]
        for w in words:
            if (own := cache.get(w)) is None:
                if len(cache) > CACHED:
                    cache.clear()
                own = cache[w] = [index[f] for f in word_features(w) if f in index]
            rows += [n] * len(own)
            cols += own
        n += bool(words)
    return n, rows, cols


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, clean, toxic): how many documents of each label have a feature."""

    def explode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.string()), ("toxic", pa.int32())])
        for batch in source:

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for text, toxic in rows_of(batch, "_text", "toxic"):
                    for f in {f for w in set(TOKEN.findall(text.lower())) - BREAKS for f in word_features(w)}:
                        yield f, toxic

            yield from batches(rows(), schema, 4 << 20)

    flat = sample.select("_text", "toxic").mapInArrow(explode, "feature string, toxic int")
    return flat.groupBy("feature").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def choose_features(sample: DataFrame, clean: int, toxic: int, most: int = FEATURES) -> list[str]:
    """The features whose document counts differ most between the labels, by chi-square; toxic ones first."""
    n = clean + toxic
    total = F.col("clean") + F.col("toxic")
    expected = total * toxic / n
    gain = F.pow(F.col("toxic") - expected, F.lit(2.0)) / F.greatest(expected * (1 - total * 0.999 / n), F.lit(1e-9))
    gain = F.when(F.col("toxic") / toxic < F.col("clean") / clean, gain * 0.1).otherwise(gain)
    best = feature_counts(sample).where(total >= 3).orderBy(gain.desc(), "feature").limit(most).select("feature")
    return [r["feature"] for r in best.collect()]


def bags(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence and feature of each hit, document of each sentence, label of each document; by id."""
    shared = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("n", pa.int64()), ("rows", pa.list_(pa.int32())), ("cols", pa.list_(pa.int32()))])
        for batch in source:
            made = ((i, y, *hits(t, shared.value, cache)) for i, t, y in rows_of(batch, "doc_id", "_text", "toxic"))
            yield from batches(made, schema, most=2000)

    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "_text", "toxic").mapInArrow(find, "doc_id long, toxic int, n long, rows array<int>, cols array<int>")
    table = found.orderBy("doc_id").toArrow()
    n = table.column("n").to_numpy()
    start = np.cumsum(n) - n
    rows, cols = (table.column(c).combine_chunks() for c in ("rows", "cols"))
    lengths = np.diff(rows.offsets.to_numpy())
    return rows.flatten().to_numpy().astype(np.int64) + np.repeat(start, lengths), cols.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n), table.column("toxic").to_numpy().astype(np.int64)


def fit_weights(rows: np.ndarray, cols: np.ndarray, docs: np.ndarray, labels: np.ndarray, features: int, steps: int = 250, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss of the noisy-or of the bags."""
    w, n = np.zeros(features + 1), len(labels)
    w[-1] = -4.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    own = labels[docs]
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, w[cols], len(docs))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(docs, -np.logaddexp(0, z), n)
        whole = np.maximum(-np.expm1(none), 1e-9)
        slope = np.where(own == 1, p * (1 - 1 / whole[docs]), p) / n
        grad = np.append(np.bincount(cols, slope[rows], features), slope.sum())
        grad[:-1] += decay * w[:-1] / max(1, features) ** 0.5
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def best_cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """The log-odds at which the labels are told apart with the best F1."""
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + labels.sum())
    at = int(f1.argmax())
    below = raw[order[at + 1]] if at + 1 < len(raw) else raw[order[at]] - 1
    return float((raw[order[at]] + below) / 2)


def fit(names: list[str], rows: np.ndarray, cols: np.ndarray, docs: np.ndarray, labels: np.ndarray, folds: int = 3) -> Model:
    """Weights from all bags; the shift from scores of bags left out of their fit."""
    raw = np.zeros(len(labels))
    fold = np.arange(len(labels)) % folds
    if len(labels) >= 10 * folds:
        for k in range(folds):
            use = fold != k
            kept = use[docs]
            hit = kept[rows]
            w, b = fit_weights((np.cumsum(kept) - 1)[rows[hit]], cols[hit], (np.cumsum(use) - 1)[docs[kept]], labels[use], len(names))
            z = b + np.bincount(rows, w[cols], len(docs))
            none = np.minimum(np.bincount(docs, -np.logaddexp(0, z), len(labels)), -1e-12)
            raw[~use] = np.clip(np.log(-np.expm1(none)) - none, -30, 30)[~use]
    w, b = fit_weights(rows, cols, docs, labels, len(names))
    cut = best_cut(raw, labels) if raw.any() else 0.0
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, b, 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut)


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model:
    """A model from the labelled rows whose id is not held out; a bounded sample of them.

    Features are counted and sentences are searched for them on the executors; the driver gets
    the chosen features and their hits, whose number the sample bounds.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most")
    chosen = known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    sample = materialise(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("_text").alias("_text"), F.first("toxic").alias("toxic")), "sample")
    counts = sample.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not counts["clean"] or not counts["toxic"]:
        share = counts["toxic"] / max(1, counts["clean"] + counts["toxic"])
        return Model({}, -30.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    names = choose_features(sample, counts["clean"], counts["toxic"])
    return fit(names, *bags(sample, names))


def score(df: DataFrame, text: str, keep: list[str], model: Model, locate: bool = True) -> DataFrame:
    """``keep`` columns, ``score``, ``predicted`` and, in texts that are predicted toxic, the offending
    sentences as ``spans`` (start, end, p): those with p of at least one half, else the likeliest."""
    own_names(keep, "score", "predicted", "spans")
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    out_type = T.StructType([*(df.schema[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def spans(model: Model, text: str) -> list[dict]:
        found = []
        for m in SENTENCE.finditer(text):
            for z in model.sentences(m[0]):
                found.append({"start": m.start(), "end": m.end(), "p": float(1 / (1 + np.exp(-np.clip(z, -30, 30))))})
        return [s for s in found if s["p"] >= 0.5] or sorted(found, key=lambda s: -s["p"])[:1]

    def apply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in source:
            schema = pa.schema([*(pa.field(k, batch.schema.field(i + 1).type) for i, k in enumerate(keep)), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", kind)])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for at in range(0, batch.num_rows, 256):
                    for body, *rest in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        value = own.score(own.raw(body))
                        toxic = value >= THRESHOLD
                        yield (*rest, value, int(toxic), spans(own, body) if toxic and locate else [])

            yield from batches(rows(), schema)

    return df.select(F.coalesce(df[text].cast("string"), F.lit("")).alias("_text"), *keep).mapInArrow(apply, out_type)

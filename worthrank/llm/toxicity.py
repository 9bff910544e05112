"""A counterfactually regularised classifier of toxic texts.

A logistic model over words and their beginnings and endings is fitted on a bounded sample of labelled
rows. For every labelled sentence that names a group, the name is swapped for each other of its set, and
the squared change of the score joins the loss, so that the names themselves carry little weight and
neutral mentions are not taken for insults. Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow, materialise, text_batches

_WORD = re.compile(r"[^\W\d_]+")

#: Sets of names of groups; within a set they can stand for each other.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("men", "women", "boys", "girls"), ("man", "woman", "boy", "girl"), ("male", "female", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"), ("black", "white", "asian", "latino", "hispanic"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "migrants", "foreigners"), ("mexican", "african", "american", "european", "chinese", "indian", "arab"),
    ("deaf", "blind", "disabled"), ("old", "young", "elderly"),
    ("männer", "frauen", "jungen", "mädchen"), ("muslime", "christen", "juden"), ("schwule", "lesben"),
    ("hombres", "mujeres", "niños", "niñas"), ("musulmanes", "cristianos", "judíos"), ("hommes", "femmes", "garçons", "filles"),
    ("musulmans", "chrétiens", "juifs"),
)


def word_features(word: str) -> list[str]:
    """A word, its beginnings and its endings."""
    found = ["=" + word]
    found += ["<" + word[:k] for k in range(3, min(8, len(word)) + 1)]
    found += [">" + word[-k:] for k in range(3, min(6, len(word)) + 1)]
    return found


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class ToxicModel:
    """Weights by feature; a text's score is the logistic function of the sum over the features it has."""

    weights: dict[str, float]
    bias: float

    def scorer(self, cache_words: int = 150_000):
        """A function from a text to its score; remembers the features of a bounded number of words."""
        index = {f: k for k, f in enumerate(self.weights)}
        values = np.array(list(self.weights.values()) or [0.0])
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for word in text_words(text):
                own = known.get(word)
                if own is None:
                    own = tuple(index[f] for f in word_features(word) if f in index)
                    if len(known) >= cache_words:
                        known.clear()
                    known[word] = own
                if own:
                    hit.update(own)
            z = self.bias + float(values[sorted(hit)].sum()) if hit else self.bias
            return float(1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def sample_labels(labels: DataFrame, per_class: int, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame, dict[int, float]]:
    """(doc_id and label of ``per_class`` rows of either class at most, those of the lowest hashes; how many
    rows of the class a sampled one stands for). Ids labelled twice count as toxic if one label says so."""
    held = materialise(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
                       .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")), "labels")
    counts = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    parts = [held.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    return materialise(parts[0].unionByName(parts[1]), "sampled-labels"), {c: max(1.0, counts.get(c, 0) / per_class) for c in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000, max_features: int = 6000, min_texts: int = 5, pair_weight: float = 1.0,
        penalty: float = 0.5, steps: int = 300, id_col: str = "doc_id", text_col: str = "text",
        identity_sets: tuple[tuple[str, ...], ...] = IDENTITY_SETS) -> ToxicModel:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks.

    The model is fitted on a bounded sample: ``per_class`` labelled rows of either class at most, weighted to the
    shares of all labelled rows. Spark counts, over that sample, the texts of either class that have each feature,
    and keeps the ``max_features`` with the clearest difference among those in ``min_texts`` texts; the driver
    gets the sample's indices into them and runs ``steps`` of gradient descent. Texts are used whole. Without
    rows of both classes the model gives the share of toxic rows (0.5 smoothed) to every text."""
    sample, stands_for = sample_labels(labels, per_class)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # at most 2 * per_class rows of two columns are broadcast
    texts = materialise(rows.join(F.broadcast(sample), "doc_id"), "labelled-texts")
    classes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = classes.get(0, 0), classes.get(1, 0)
    if not n0 or not n1:
        return ToxicModel({}, float(np.log((n1 + 0.5) / (n0 + 0.5))))

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 512):
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in text_words(text) for f in word_features(w)}:
                    counts.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array((c[0] for c in counts.values()), pa.int64()),
                                              pa.array((c[1] for c in counts.values()), pa.int64())], names=["feature", "c0", "c1"])

    counted = map_arrow(texts.select("text", "label"), count_features, "feature string, c0 long, c1 long").groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    p0, p1 = (F.col("c0") + 0.5) / (n0 + 1.0), (F.col("c1") + 0.5) / (n1 + 1.0)
    clear = F.abs(F.log(p1 / p0)) / F.sqrt(1 / (F.col("c0") + 0.5) + 1 / (F.col("c1") + 0.5))
    chosen = [r["feature"] for r in counted.where(F.col("c0") + F.col("c1") >= min_texts).orderBy(clear.desc(), "feature").limit(max_features).select("feature").collect()]
    index = {f: k for k, f in enumerate(chosen)}
    swaps = {w: [x for x in own if x != w] for own in identity_sets for w in own}

    def ids(words: set[str]) -> set[int]:
        return {index[f] for w in words for f in word_features(w) if f in index}

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 512):
            has = [sorted(ids(text_words(text))) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(has, pa.list_(pa.int32()))], names=["label", "has"])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 512):
            counts: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()
            for text in batch.column(0).to_pylist():
                for sentence in re.split(r"[.!?\n]", text or ""):
                    words = text_words(sentence)
                    for name in words & swaps.keys():
                        a = ids(words)
                        for other in swaps[name]:
                            b = ids(words - {name} | {other})
                            counts[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], ints), pa.array([k[1] for k in counts], ints), pa.array(counts.values(), pa.int64())],
                                             names=["lost", "gained", "n"])

    rows_ = [(r["label"], r["has"]) for r in map_arrow(texts.select("text", "label"), vectorise, "label int, has array<int>").toLocalIterator()]
    # Swaps that change the same features are one pair with a count: few, whatever the number of mentions.
    swapped = map_arrow(texts.select("text"), swap, "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n"))
    pairs = [(r["lost"], r["gained"], float(r["n"])) for r in swapped.toLocalIterator()]
    # a name by itself is a neutral mention: it is compared with the others of its set and with none
    for own in identity_sets:
        alone = [ids({w}) for w in own]
        pairs += [(sorted(a - b), sorted(b - a), 1.0) for a, b in combinations(alone, 2)] + [(sorted(a), [], 1.0) for a in alone]
    objective = Objective(rows_, [p for p in pairs if p[0] or p[1]], len(chosen), stands_for, pair_weight, penalty)
    weights, bias = objective.descend(steps)
    return ToxicModel({f: float(weights[k]) for f, k in index.items() if weights[k]}, bias)


class Objective:
    """The weighted logistic loss + penalty * |w|^2 / 2 + pair_weight * the sum of squared score changes, each as often as its
    swap is met. ``rows``: (label, features); ``pairs``: (features lost, features gained, count)."""

    def __init__(self, rows: list, pairs: list, size: int, stands_for: dict[int, float], pair_weight: float, penalty: float):
        rows, pairs = sorted(rows), sorted(pairs)  # the order in which tasks end must not matter
        self.size, self.pair_weight, self.penalty = size, pair_weight, penalty
        self.y = np.array([r[0] for r in rows], float)
        self.weight = np.where(self.y == 1, stands_for[1], stands_for[0])
        self.weight *= len(rows) / self.weight.sum()
        self.at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        self.of = np.concatenate([np.array(r[1], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.times = np.array([p[2] for p in pairs])
        self.p_at = np.repeat(np.arange(len(pairs)), [len(p[0]) + len(p[1]) for p in pairs])
        self.p_of = np.concatenate([np.array([*p[0], *p[1]], np.int64) for p in pairs]) if pairs else np.zeros(0, np.int64)
        self.p_sign = np.concatenate([np.array([1.0] * len(p[0]) + [-1.0] * len(p[1])) for p in pairs]) if pairs else np.zeros(0)

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """The value, and its slopes along the weights and the bias."""
        z = np.bincount(self.at, w[self.of], len(self.y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = self.weight * (p - self.y)
        value = float((self.weight * (np.logaddexp(0, z) - self.y * z)).sum() + self.penalty * (w @ w) / 2)
        gradient = np.bincount(self.of, error[self.at], self.size) + self.penalty * w
        if len(self.times):
            change = np.bincount(self.p_at, w[self.p_of] * self.p_sign, len(self.times))
            value += float(self.pair_weight * (self.times * change * change).sum())
            gradient += 2 * self.pair_weight * np.bincount(self.p_of, (self.times * change)[self.p_at] * self.p_sign, self.size)
        return value, gradient, float(error.sum())

    def descend(self, steps: int) -> tuple[np.ndarray, float]:
        """The weights and the bias after accelerated gradient descent with a step that is halved when the loss grows."""
        weight, y = self.weight, self.y
        # each feature's step is scaled by a bound on the loss's curvature along it
        curve = np.bincount(self.of, (weight / 4)[self.at], self.size) + self.penalty
        if len(self.times):
            curve += 2 * self.pair_weight * np.bincount(self.p_of, self.times[self.p_at], minlength=self.size)
        w, b = np.zeros(self.size), float(np.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5)))
        v, c, rate, last = w.copy(), b, 0.1, self.loss(w, b)[0]
        for k in range(steps):
            _, g, gb = self.loss(v, c)
            new, nb = v - rate * g / curve, c - rate * gb / (weight.sum() / 4)
            value = self.loss(new, nb)[0]
            if value > last:
                rate, v, c = rate / 2, w.copy(), b
                continue
            momentum = k / (k + 3)
            v, c, w, b, last = new + momentum * (new - w), nb + momentum * (nb - b), new, nb, value
            rate *= 1.05
        return w, b


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1, higher: more likely toxic) to every row of ``docs``, in place of a column of that
    name; the other columns pass unchanged. Whole texts are scored; a null or empty text, or one without
    letters, gets the model's score of no feature."""
    docs = docs.drop("score")
    at = docs.columns.index(text_col)
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in text_batches(batches):
            scores = [of(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])

    return map_arrow(docs, run, schema)

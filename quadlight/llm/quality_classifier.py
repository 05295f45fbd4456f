"""Quality classifier by co-training on two views of a document.

The text view sees hashed words and the style of the text; the metadata view sees source, language and stated length.
Both are logistic regressions in numpy. Over a few rounds each labels the rows of an unlabelled pool that it is surest
of, for the other to learn from. Each view is then calibrated on labelled rows that were held back, the calibrated log
odds are weighed against each other on the same rows, and all documents are scored.

The models are fitted on the driver on a bounded sample: at most ``most_labelled`` labelled and ``most_pool`` other
rows, the first by the hash of their id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import trimmed, word_chunks

WORDS = 1 << 14
STYLE = 9
BINS = 8
TEXT = WORDS + STYLE * BINS
META = 1 << 10
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Upper ends of the bins of each style feature.
EDGES = np.array([[0.002, 0.01, 0.03, 0.1, 0.2, 0.4, 0.8], [0.005, 0.01, 0.03, 0.06, 0.15, 0.4, 0.8], [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8], [2, 3, 3.6, 4.4, 5.2, 7, 10], [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9], [0.001, 0.01, 0.05, 0.1, 0.2, 0.4, 0.7], [3, 4, 5, 6, 7, 8, 10], [0.002, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4], [0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8]])


def text_features(text: bytes | None) -> np.ndarray:
    """The features (sorted, distinct) of a whole text: every word's hash, and a bin for each style feature."""
    text = text or b""
    n, distinct, chars = 0, set(), 0
    for words in word_chunks(text):
        n += len(words)
        chars += sum(map(len, words))
        distinct.update(words)
    crc = zlib.crc32
    found = {crc(w.lower()) % WORDS for w in distinct}
    gone = lambda what: len(text) - len(text.translate(None, what))
    lines = [x for x in text.split(b"\n") if x.strip()]
    many, size = max(n, 1), max(chars, 1)
    values = (gone(b"#*$%&<>") / many, gone(UPPER) / size, gone(b"!?") / many, chars / many, 1 - len(distinct) / many, 1 - len(set(lines)) / max(len(lines), 1), math.log2(n + 1), gone(b"|") / many, gone(b".,;:") / many)
    bins = (np.array(values)[:, None] >= EDGES).sum(axis=1)
    return np.concatenate((np.sort(np.fromiter(found, np.int64, len(found))), WORDS + np.arange(STYLE) * BINS + bins))


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = "none" if n_chars is None else str(max(n_chars, 0).bit_length())
    return np.array(sorted({zlib.crc32(x.encode()) % META for x in (f"s {source}", f"l {lang}", f"n {size}", f"l {lang} n {size}")}), np.int64)


@dataclass
class View:
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / math.sqrt(max(len(r), 1)) for r in rows]) + self.bias if rows else np.zeros(0)

    def calibrated(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.scale * self.odds(rows) + self.shift


def regress(rows: list[np.ndarray], labels: np.ndarray, size: int, epochs: int = 15, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> View:
    """Logistic regression on binary features, each row scaled by the root of their number."""
    rng, view = np.random.default_rng(seed), View(np.zeros(size))
    squares, bias_square = np.full(size, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            here = [rows[i] for i in pick]
            sizes = np.array([len(r) for r in here])
            ids = np.concatenate(here)
            x = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
            error = 1 / (1 + np.exp(-np.clip(view.odds(here), -30, 30))) - labels[pick]
            grad = np.bincount(ids, x * np.repeat(error, sizes), minlength=size) / len(pick) + decay * view.weights
            squares += grad * grad
            view.weights -= rate * grad / np.sqrt(squares)
            g = error.mean()
            bias_square += g * g
            view.bias -= rate * g / math.sqrt(bias_square)
    return view


def platt(odds: np.ndarray, labels: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression of labels on the columns of ``odds``, by Newton's method."""
    x = np.column_stack((odds, np.ones(len(labels))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-1] * (x.shape[1] - 1) + [1e-3])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray

    def score(self, text_rows: list[np.ndarray], meta_rows: list[np.ndarray]) -> np.ndarray:
        both = np.column_stack((self.text.calibrated(text_rows), self.meta.calibrated(meta_rows), np.ones(len(text_rows))))
        return 1 / (1 + np.exp(-np.clip(both @ self.mix, -40, 40)))


def co_train(text: list[np.ndarray], meta: list[np.ndarray], labels: np.ndarray, rounds: int = 4, share: float = 0.05) -> Model:
    """``labels``: 1, 0, or -1 for the unlabelled pool. Without both labels every row scores the one that is there, or 0.5."""
    known = np.flatnonzero(labels >= 0)
    if not len(known) or labels[known].min() == labels[known].max():
        level = 0.0 if not len(known) else (4.0 if labels[known][0] else -4.0)
        return Model(View(np.zeros(TEXT)), View(np.zeros(META)), np.array([0.0, 0.0, level]))
    held = np.array([i % 5 == 0 for i in range(len(known))])
    fitted, test = (known[~held], known[held]) if min(labels[known[held]].sum(), (1 - labels[known[held]]).sum()) else (known, known)
    rows = {"text": text, "meta": meta}
    sizes = {"text": TEXT, "meta": META}
    taught: dict[str, dict[int, int]] = {"text": {}, "meta": {}}
    pool = set(np.flatnonzero(labels < 0).tolist())
    good = labels[fitted].mean()
    views: dict[str, View] = {}
    for k in range(rounds + 1):
        for name, own in rows.items():
            at = [*fitted.tolist(), *taught[name]]
            y = np.array([*labels[fitted].tolist(), *taught[name].values()], float)
            views[name] = regress([own[i] for i in at], y, sizes[name])
        if k == rounds:
            break
        for name, other in (("text", "meta"), ("meta", "text")):
            left = np.array(sorted(pool), np.int64)
            # Only what a view is sure of is passed on, in the proportion of the labels.
            p = 1 / (1 + np.exp(-np.clip(views[name].odds([rows[name][i] for i in left]), -30, 30)))
            order = np.argsort(p, kind="stable")
            n = int(share * len(left))
            n_bad = min(int(n * (1 - good)) + 1, len(left))
            picks = [(i, 0) for i in order[:n_bad] if p[i] < 0.05] + [(i, 1) for i in order[::-1][: n - n_bad + 1] if p[i] > 0.95]
            for i, y in picks:
                taught[other][int(left[i])] = y
                pool.discard(int(left[i]))
    for name, view in views.items():
        view.scale, view.shift = platt(view.odds([rows[name][i] for i in test])[:, None], labels[test])
    mixed = platt(np.column_stack([views[n].calibrated([rows[n][i] for i in test]) for n in rows]), labels[test])
    return Model(views["text"], views["meta"], mixed)


def _features(batch: pa.RecordBatch, at: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    text = [text_features(t) for t in batch.column(at).to_pylist()]
    return text, [meta_features(*r) for r in zip(*(batch.column(at + k).to_pylist() for k in (1, 2, 3)), strict=True)]


def _columns(text_col: str) -> list[Column]:
    return [F.col(text_col).cast("binary").alias("_text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]


def fit_sample(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = 4000, most_pool: int = 4000) -> Model:
    """Co-trains on labelled rows where ``allowed`` and on rows without a label, the first by the hash of their id.

    Ids are of any type with an order and a text; ties of the hash go by the id. A label other than 0 and 1 counts as none,
    of several labels of an id the least holds, of several rows one. Null ids are not learnt from, null texts are empty,
    null metadata is a value of its own. Without labels every row scores 0.5, with one label alone that one. Extra columns
    are ignored.
    """
    docs = docs.select(id_col, text_col, "source", "lang", "n_chars")
    order = [F.xxhash64(id_col), F.col(id_col)]
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    known = one.where(allowed).orderBy(*order).limit(most_labelled)
    pool = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(one, id_col, "left_anti").orderBy(*order).limit(most_pool)
    picked = F.broadcast(known.union(pool.select(id_col, F.lit(-1))))  # most_labelled + most_pool rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _features(batch, 2)
            blob = lambda rows: pa.array([r.astype("<i4").tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blob(text), blob(meta)], ["id", "label", "text", "meta"])

    # Of repeated ids one row is kept before anything is collected.
    whole = F.struct(F.col("_label").cast("int").alias("_label"), *_columns(text_col))
    rows = docs.join(picked, id_col).select(F.col(id_col).cast("string").alias("_key"), whole.alias("_r")).groupBy("_key").agg(F.min("_r").alias("_r")).select("_key", "_r.*")
    taken = sorted(tuple(r) for r in rows.mapInArrow(trimmed(run), "id string, label int, text binary, meta binary").collect())
    read = lambda k: [np.frombuffer(r[k], "<i4").astype(np.int64) for r in taken]
    return co_train(read(2), read(3), np.array([r[1] for r in taken], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, score: probability of good quality, kept: whether it reaches ``least``) for each row, whole texts.

    Null texts count as empty, null metadata as a value of its own. Repeated rows score alike; an empty table gives an
    empty result; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = sent.value.score(*_features(batch, 1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), *_columns(text_col)).mapInArrow(trimmed(run), f"`{id_col}` {kind}, score double").withColumn("kept", F.col("score") >= least)

"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first four characters. Filters of width 1,
2 and 3 run over all words of a text, each filter's largest value over the text is kept (max pooling), and a linear
layer gives the log odds. All of this up to the pooling is linear in the word vectors, so for scoring every word is
turned into its filter outputs once and cached; a text of any length is read in parts.

The classifier is fitted on the driver on a bounded sample of labelled rows (``most_toxic`` and ``most_clean`` rows of
at most ``most_words`` words, the first by the hash of their id). One dimension of the embeddings starts as the evidence
of a row for the label (the signed root of the G-test of its document frequencies), without which a few dozen toxic rows
are learnt by heart. A threshold for each language, which is guessed from the text's own words, is calibrated on rows
that are not trained on: a fifth of a large sample, every third in turn of a small one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import trimmed, word_chunks

#: Frequent words that tell languages apart.
STOP_WORDS = {
    "en": "the and of to is that for was with this",
    "de": "der die und das zu den von mit ist ein",
    "fr": "le les et des une est dans pour qui du",
    "es": "el los y que en las por con se del",
}
WORD_ROWS, PREFIX_ROWS = 1 << 16, 1 << 14
WIDTHS = (1, 2, 3)
EDGE = b".,;:!?()[]{}\"'*%$&#|<>-_"
#: Labelled rows below which every row is calibrated on, by models that were not trained on it.
SMALL = 2000
PARTS = [(k, j) for k in WIDTHS for j in range(k)]


def word_rows(word: bytes) -> tuple[int, int]:
    """The two rows of the embedding table that a word adds up."""
    word = word.strip(EDGE) or word
    word = word.decode("utf-8", "replace").lower()
    return zlib.crc32(word.encode()) % WORD_ROWS, WORD_ROWS + zlib.crc32(word[:4].encode()) % PREFIX_ROWS


@dataclass
class Model:
    table: np.ndarray  # (rows, parts * filters): filter outputs of every embedding row
    bias: np.ndarray  # (widths * filters)
    out: np.ndarray  # (widths * filters + 1)
    thresholds: dict[str, float]  # log odds from which a text of a language counts as toxic
    cut: float = 0.3  # the score at the threshold

    def score(self, log_odds: np.ndarray, languages: np.ndarray) -> np.ndarray:
        at = np.array([self.thresholds[k] for k in STOP_WORDS] + [self.thresholds[""]])[languages]
        return 1 / (1 + np.exp(-np.clip(log_odds - at + np.log(self.cut / (1 - self.cut)), -40, 40)))


class Scorer:
    """Scores texts by a model; keeps the filter outputs of words it has met."""

    #: Words that stay once met, mostly the frequent ones; others only until the next flush.
    KEEP, FLUSH = 80_000, 60_000

    def __init__(self, model: Model):
        self.model, self.filters = model, len(model.bias) // len(WIDTHS)
        self.languages = {w.encode(): i for i, words in enumerate(STOP_WORDS.values()) for w in words.split()}
        self.index: dict[bytes, int] = {}
        self.extra: dict[bytes, int] = {}
        self.rows = np.zeros((self.KEEP + 1, self.model.table.shape[1]), np.float32)  # row 0: what stands around a text
        self.kind = np.full(self.KEEP + 1, len(STOP_WORDS), np.int8)

    def _add(self, word: bytes) -> int:
        if word in self.extra:
            return self.extra[word]
        keep = len(self.index) < self.KEEP
        at = len(self.index) + 1 if keep else self.KEEP + 1 + len(self.extra)
        if at >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((1 << 14, self.rows.shape[1]), np.float32)))
            self.kind = np.concatenate((self.kind, np.zeros(1 << 14, np.int8)))
        a, b = word_rows(word)
        self.rows[at] = self.model.table[a] + self.model.table[b]
        self.kind[at] = self.languages.get(word.strip(EDGE).lower(), len(STOP_WORDS))
        (self.index if keep else self.extra)[word] = at
        return at

    def _forget(self, tail: list[int]) -> list[int]:
        """Drops the words that do not stay, but for the two that the text goes on from."""
        rows, kinds = self.rows[tail], self.kind[tail]
        self.extra = {b"\0%d" % i: self.KEEP + 1 + i for i in range(len(tail))}
        at = list(self.extra.values())
        while at[-1] >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((1 << 14, self.rows.shape[1]), np.float32)))
            self.kind = np.concatenate((self.kind, np.zeros(1 << 14, np.int8)))
        self.rows[at], self.kind[at] = rows, kinds
        return [x and y for x, y in zip(tail, at, strict=True)]

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        pooled = np.full((len(texts), len(WIDTHS) * self.filters), -np.inf, np.float32)
        counts = np.zeros((len(texts), len(STOP_WORDS) + 1), np.int64)
        ids: list[int] = [0, 0]
        owner: list[tuple[int, int]] = []  # text, words in a row
        for i, text in enumerate(texts):
            tail: list[int] = [0, 0]
            for words in word_chunks(text or b"", 1 << 18):
                get, add = self.index.get, self._add
                here = [get(w) or add(w) for w in words]
                counts[i] += np.bincount(self.kind[here], minlength=len(STOP_WORDS) + 1)
                ids += here
                owner.append((i, len(here)))
                tail = [*tail, *here][-2:]
                if len(ids) > self.FLUSH:
                    self._pool(ids, owner, pooled)
                    tail = self._forget(tail)
                    # The text may go on: its last words stand before the next part again.
                    ids, owner = [0, 0, *tail], [(i, len(tail))]
            ids += [0, 0]
            owner.append((i, 2))
        self._pool(ids, owner, pooled)
        self._forget([0, 0])
        z = np.maximum(pooled + self.model.bias, 0)
        odds = z @ self.model.out[:-1] + self.model.out[-1]
        known = counts[:, :-1]
        language = np.where(known.max(axis=1) > 0, known.argmax(axis=1), len(STOP_WORDS))
        return self.model.score(odds.astype(np.float64), language)

    def _pool(self, ids: list[int], owner: list[tuple[int, int]], pooled: np.ndarray) -> None:
        at = np.array(ids, np.int64)
        n = len(at) - 2
        if n <= 0:
            return
        x, f = self.rows[at], self.filters
        out = np.empty((n, len(WIDTHS) * f), np.float32)
        part = 0
        for w, k in enumerate(WIDTHS):  # a filter of width k ends at each word; pads stand before a text
            sums = x[3 - k : 3 - k + n, part * f : (part + 1) * f].copy()
            for j in range(1, k):
                sums += x[3 - k + j : 3 - k + j + n, (part + j) * f : (part + j + 1) * f]
            out[:, w * f : (w + 1) * f] = sums
            part += k
        text, size = np.array(owner).T
        text, size = text[size > 0], size[size > 0]
        best = np.maximum.reduceat(out, np.cumsum(size) - size, axis=0)
        np.maximum.at(pooled, text, best)


def evidence(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each row of the embedding table, the signed root of the G-test between it and the label, over documents."""
    n = np.zeros((2, WORD_ROWS + PREFIX_ROWS))
    for d, label in zip(docs, labels, strict=True):
        n[int(label), np.unique(d)] += 1
    total = np.bincount(labels.astype(np.int64), minlength=2)[:, None].astype(float)
    expected = n.sum(axis=0) * total / total.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        there, not_there = np.where(n > 0, n * np.log(n / expected), 0), np.where(total > n, (total - n) * np.log((total - n) / (total - expected)), 0)
    return (np.sign(n[1] - expected[1]) * np.sqrt(np.maximum(2 * (there + not_there).sum(axis=0), 0))).astype(np.float32)


def train(docs: list[np.ndarray], labels: np.ndarray, filters: int = 8, width: int = 12, least_epochs: int = 5, least_steps: int = 300, batch: int = 32, rate: float = 0.01, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fits embeddings, filters and output on documents given as (words, 2) rows of the embedding table."""
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.01, (WORD_ROWS + PREFIX_ROWS, width)).astype(np.float32),
        "w": rng.normal(0, 0.5 / np.sqrt(width), (width, len(PARTS) * filters)).astype(np.float32),
        "b": np.zeros(len(WIDTHS) * filters, np.float32),
        "o": np.concatenate((rng.normal(0, 0.3, len(WIDTHS) * filters), [0.0])).astype(np.float32),
    }
    p["e"][:, 0] += evidence(docs, labels) / 4
    p["w"][0, ::2] = np.abs(p["w"][0, ::2]) + 0.2
    epochs = max(least_epochs, -(-least_steps * batch // len(docs)))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0

    def adam(name: str, grad: np.ndarray, at=slice(None)) -> None:
        m, v = state[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        p[name][at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-4)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            size = np.array([len(docs[i]) + 2 for i in pick])
            n = int(size.sum())
            ids = np.zeros((n + 2, 2), np.int64)
            real = np.zeros(n + 2, bool)
            at = 2
            for i in pick:
                ids[at : at + len(docs[i])] = docs[i]
                real[at : at + len(docs[i])] = True
                at += len(docs[i]) + 2
            x = (p["e"][ids[:, 0]] + p["e"][ids[:, 1]]) * real[:, None]
            y = x @ p["w"]
            out = np.empty((n, len(WIDTHS) * filters), np.float32)
            part = 0
            for w, k in enumerate(WIDTHS):
                out[:, w * filters : (w + 1) * filters] = sum(y[3 - k + j : 3 - k + j + n, (part + j) * filters : (part + j + 1) * filters] for j in range(k))
                part += k
            starts = np.cumsum(size) - size
            best = np.array([out[a : a + s].argmax(axis=0) + a for a, s in zip(starts, size, strict=True)])
            z = np.take_along_axis(out, best, axis=0) + p["b"]
            a = np.maximum(z, 0)
            odds = a @ p["o"][:-1] + p["o"][-1]
            d = (1 / (1 + np.exp(-odds)) - labels[pick]) / len(pick)
            dz = (d[:, None] * p["o"][None, :-1]) * (z > 0)
            step += 1
            grad_w = np.zeros_like(p["w"])
            rows, grads, part = [], [], 0
            for w, k in enumerate(WIDTHS):
                g = dz[:, w * filters : (w + 1) * filters]
                for j in range(k):
                    where = best[:, w * filters : (w + 1) * filters] + 3 - k + j
                    cols = slice((part + j) * filters, (part + j + 1) * filters)
                    grad_w[:, cols] = np.einsum("bfw,bf->wf", x[where], g)
                    used = real[where] & (g != 0)
                    gx = (g[:, :, None] * p["w"][:, cols].T[None])[used]
                    rows.append(ids[where[used]])
                    grads.append(gx)
                part += k
            rows_all, grads_all = np.concatenate(rows), np.concatenate(grads)
            both = np.concatenate((rows_all[:, 0], rows_all[:, 1]))
            uniq, inv = np.unique(both, return_inverse=True)
            ge = np.zeros((len(uniq), width), np.float32)
            np.add.at(ge, inv, np.concatenate((grads_all, grads_all)))
            grad_o = np.concatenate((a.T @ d, [d.sum()])) + 1e-4 * p["o"]
            adam("e", ge, uniq)
            adam("w", grad_w)
            adam("b", dz.sum(axis=0))
            adam("o", grad_o)
    return p["e"], p["w"], p["b"], p["o"]


def best_threshold(odds: np.ndarray, labels: np.ndarray) -> float | None:
    """The log odds that part the labels best by F1, halfway to the next lower ones; None without both labels."""
    if not labels.any() or labels.all():
        return None
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    top = int(np.argmax(f1))
    lower = odds[order[top + 1]] if top + 1 < len(order) else odds[order[top]] - 1
    return float((odds[order[top]] + lower) / 2)


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, most_words: int = 30_000) -> Model:
    """Trains on all rows of ``labelled``, which must be bounded. Without both labels, every text gets a low score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keep = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = (text or b"").split()
                if len(words) <= most_words:
                    rows.append(np.array([word_rows(w) for w in words], "<i4").reshape(-1, 2).tobytes())
                    keep.append(i)
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(rows, pa.binary())], ["id", "label", "rows"])

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    taken = labelled.select(key.alias("_key"), F.col(label_col).cast("int"), F.col(text_col).cast("binary")).mapInArrow(trimmed(run), "id string, label int, rows binary").collect()
    taken = sorted((r[0], r[1], bytes(r[2])) for r in taken)
    docs = [np.frombuffer(r[2], "<i4").reshape(-1, 2).astype(np.int64) for r in taken]
    labels = np.array([r[1] for r in taken], np.int64)
    filters = 8
    if not labels.any() or labels.all():
        table = np.zeros((WORD_ROWS + PREFIX_ROWS, len(PARTS) * filters), np.float32)
        return Model(table, np.zeros(len(WIDTHS) * filters, np.float32), np.zeros(len(WIDTHS) * filters + 1, np.float32), dict.fromkeys([*STOP_WORDS, ""], 4.0))
    folds = np.array([zlib.crc32(f"fold{r[0]}".encode()) for r in taken])

    def trained(at: np.ndarray) -> Model:
        e, w, b, o = train([docs[i] for i in at], labels[at].astype(np.float32), filters)
        return Model((e @ w).astype(np.float32), b, o, dict.fromkeys([*STOP_WORDS, ""], 0.0))

    both = lambda at: 0 < labels[at].sum() < len(at)
    odds = np.zeros(len(docs))
    if len(docs) < SMALL and all(both(np.flatnonzero(folds % 3 != k)) for k in range(3)):
        test, model = np.arange(len(docs)), trained(np.arange(len(docs)))
        for k in range(3):
            part = trained(np.flatnonzero(folds % 3 != k))
            for i in np.flatnonzero(folds % 3 == k):
                odds[i] = _log_odds(part, docs[i], filters)
    else:
        fitted = np.flatnonzero(folds % 5 != 0)
        fitted = fitted if both(fitted) else np.arange(len(docs))
        test, model = np.setdiff1d(np.arange(len(docs)), fitted), trained(fitted)
        test = test if len(test) else np.arange(len(docs))
        for i in test:
            odds[i] = _log_odds(model, docs[i], filters)
    odds = odds[test]
    stop = np.array([[word_rows(x.encode())[0] for x in words.split()] for words in STOP_WORDS.values()])
    language = np.zeros(len(test), np.int64)
    for k, i in enumerate(test):
        seen = [np.isin(docs[i][:, 0], s).sum() for s in stop]
        language[k] = int(np.argmax(seen)) if max(seen) else len(STOP_WORDS)
    overall = best_threshold(odds, labels[test]) or 0.0
    for i, name in enumerate(STOP_WORDS):
        here = language == i
        own = best_threshold(odds[here], labels[test][here]) if labels[test][here].sum() >= 5 else None
        model.thresholds[name] = overall if own is None else own
    model.thresholds[""] = overall
    return model


def _log_odds(model: Model, rows: np.ndarray, filters: int) -> float:
    y = np.zeros((len(rows) + 4, model.table.shape[1]), np.float32)
    y[2:-2] = model.table[rows[:, 0]] + model.table[rows[:, 1]]
    n, part, z = len(rows) + 2, 0, []
    for k in WIDTHS:
        z.append(sum(y[3 - k + j : 3 - k + j + n, (part + j) * filters : (part + j + 1) * filters] for j in range(k)).max(axis=0))
        part += k
    return float(np.maximum(np.concatenate(z) + model.bias, 0) @ model.out[:-1] + model.out[-1])


def fit_sample(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 2500, most_clean: int = 4500) -> Model:
    """Fits on at most ``most_toxic`` and ``most_clean`` labelled rows where ``allowed``, the first by their id's hash.

    Ids are of any type with an order and a text; ties of the hash go by the id. A label other than 0 and 1 counts as none,
    of several labels of an id the largest holds, of several texts the least. Null ids are not learnt from, null texts are
    empty. Empty tables, or only one label, give a model by which every text scores low. Extra columns are ignored.
    """
    docs = docs.select(id_col, text_col)
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")).where(allowed)
    order = [F.xxhash64(id_col), F.col(id_col)]
    toxic = one.where("_label = 1").orderBy(*order).limit(most_toxic)
    clean = one.where("_label = 0").orderBy(*order).limit(most_clean)
    picked = F.broadcast(toxic.union(clean))  # most_toxic + most_clean rows at most
    rows = docs.join(picked, id_col).groupBy(id_col).agg(F.min(text_col).alias("_text"), F.min("_label").alias("_label"))
    return fit(rows, id_col, "_text", "_label")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col, the columns ``keep``, score) for each row, whole texts. Null and empty texts get the score of no words.

    Repeated rows score alike; an empty table gives an empty result; extra columns are ignored, but for those of ``keep``,
    none of which may be called score.
    """
    if "score" in {id_col, *(keep or [])}:
        raise ValueError("a column that is kept may not be called score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            values = scorer(batch.column(len(names)).cast(pa.binary()).to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(values, pa.float64())], [*names, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(trimmed(run), f"{kinds}, score double")

"""Language-model scoring: an interpolated modified Kneser-Ney trigram model.

Words are counted in Spark and numbered by the order of their 64-bit hashes; trigrams are counted as triples of numbers.
The model is stored in the shared folder as sorted hash arrays (``arrays.pack_table``), and workers map these files into
memory to score. Counts travel as compressed sorted runs, already summed by the task that made them. Trigrams u v w are
dealt out by v, and those of very frequent v by v and w, so that no file belongs to one word; the number of files grows
with the tokens, so that none outgrows a task.

    p(w | u v) = (c(u v w) - D(c(u v w))) / c(u v) + l(u v) * p2(w | v)
    p2(w | v)  = (n(v w) - D2(n(v w))) / n(v) + l2(v) * p1(w)
    p1(w)      = (a(w) - E(a(w))) / A + g / (V + 1)

D, D2 and E are the discounts of modified Kneser-Ney for counts 1, 2 and from 3 on; n(v w) is the number of words that
precede v w, n(v) its sum over w; a(w) the number of words that precede w, A its sum; l, l2 and g give the discounted mass
away. A text begins after two starts and ends with its end. An unknown word has a(w) = 0; after words that never stood
together only p2 counts, after an unknown word only p1.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlight.llm.arrays import ArrayStore, Table, expand, mix, pack_table, squeeze, summed
from quadlight.llm.common import scratch_path, shuffle_partitions, staged, trimmed, word_chunks

END = b""
#: Distinct words, or tokens, that a task holds before it passes them on.
MOST_WORDS, MOST_TOKENS = 300_000, 3_000_000
#: Tokens that a file of the model stands for, at most about.
FILE_TOKENS = 4_000_000
SHIFT, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, n)


@dataclass
class Shape:
    """What a worker must know to read the model's files."""

    uri: str
    word_files: int
    firsts: list[int]  # the number of the first word of each vocabulary file, and their sum
    files: int = 1
    tokens: int = 0
    texts: int = 0
    hot: int = 0  # middle words met more often are dealt out with the word after them
    span: int = 1  # words in each file of word statistics

    @property
    def size(self) -> int:
        return self.firsts[-1]


class Words:
    """Numbers words by the sorted hash arrays. The number ``size`` stands for the start of a text, -1 for unknown.

    Words get a place in a table: the first met, so mostly the frequent ones, for good, others for one call. ``columns``
    gives further rows of the table for new numbers."""

    MOST = 600_000

    def __init__(self, shape: Shape, columns: Callable[[np.ndarray], np.ndarray] | None = None, rows: int = 0):
        self.shape, self.store, self.columns = shape, ArrayStore(shape.uri), columns
        self.seen: dict[bytes | None, int] = {}
        self.number, self.table = np.zeros(1 << 12, np.int64), np.zeros((rows, 1 << 12))
        self._put(np.array([shape.size]))
        self.seen[None] = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        files = (hashes % np.uint64(self.shape.word_files)).astype(np.int64)
        for k in np.unique(files):
            at = np.flatnonzero(files == k)
            keys = self._file(k)[0]
            if len(keys):
                place = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
                out[at] = np.where(keys[place] == hashes[at], place + self.shape.firsts[k], -1)
        return out

    def _file(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.shape.firsts[k + 1] - self.shape.firsts[k]
        data = self.store.map(f"words-{k}") if n else np.zeros(0, np.uint8)
        return data[: 8 * n].view("<u8"), data[8 * n :].view("<u8")

    def _put(self, numbers: np.ndarray) -> None:
        at, end = len(self.seen), len(self.seen) + len(numbers)
        if end > len(self.number):
            more = max(end, 2 * len(self.number)) - len(self.number)
            self.number = np.concatenate((self.number, np.zeros(more, np.int64)))
            self.table = np.concatenate((self.table, np.zeros((len(self.table), more))), axis=1)
        self.number[at:end] = numbers
        if self.columns is not None:
            self.table[:, at:end] = self.columns(numbers)

    def places(self, words: list[bytes | None]) -> np.ndarray:
        """The places of words in the table; None is the start."""
        out = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        if len(at := np.flatnonzero(out < 0)):
            missing = list(map(words.__getitem__, at.tolist()))
            new = {w: k for k, w in enumerate(dict.fromkeys(missing))}
            back = list(map(new.__getitem__, missing))
            self._put(self.find(_hashes(new, len(new))))
            first = len(self.seen)
            out[at] = first + np.array(back)
            room = max(0, self.MOST - first)
            self.seen.update(zip(list(new)[:room], range(first, first + room), strict=False))
        return out

    def lines(self, texts: list[bytes], block: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts as (text, u, v, w): each word's text, and the places of the two words before it and of itself. Comes in
        blocks of about ``block`` words, and places hold for one block."""
        words: list[bytes | None] = []
        owner: list[tuple[int, int]] = []

        def block_of() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            here = self.places(words)
            text = np.repeat(*np.array(owner).T)
            real = np.flatnonzero(here[2:])
            return text[2:][real], here[:-2][real], here[1:-1][real], here[2:][real]

        for i, text in enumerate(texts):
            words += (None, None)
            owner.append((i, 2))
            for chunk in word_chunks(text):
                words += chunk
                owner.append((i, len(chunk)))
                if len(words) > block:
                    yield block_of()
                    words, owner = words[-2:], [(i, 2)]
            words.append(END)
            owner.append((i, 1))
        if len(words) > 2:
            yield block_of()

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often known words occur; the start of a text occurs once a text."""
        firsts = np.array(self.shape.firsts)
        out = np.zeros(len(numbers), np.int64)
        files = np.searchsorted(firsts, numbers, "right") - 1
        out[numbers == self.shape.size] = self.shape.texts
        for k in np.unique(files[(numbers >= 0) & (numbers < self.shape.size)]):
            at = np.flatnonzero((files == k) & (numbers >= 0) & (numbers < self.shape.size))
            out[at] = self._file(k)[1][numbers[at] - firsts[k]]
        return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << SHIFT) | b.astype(np.uint64)


def _triple_hash(hashed_pairs: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix(hashed_pairs + mix(u.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)))


def _file_of(pairs: np.ndarray, hot: np.ndarray, files: int) -> np.ndarray:
    """The file of trigrams by the pair of their middle and last word."""
    return (mix(np.where(hot, pairs, pairs >> SHIFT)) % np.uint64(files)).astype(np.uint32)


def _runs(file: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(file, from, to) of rows that are sorted by file."""
    cuts = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1], [True]))) if len(file) else np.zeros(1, np.int64)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield int(file[a]), a, b


def _by_file(file: np.ndarray) -> np.ndarray:
    """Rows in the order of their file."""
    return np.argsort(file.astype(np.uint16) if len(file) and file.max() < 1 << 16 else file, kind="stable")


def _summed_triples(pairs: np.ndarray, u: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, u) with the sums of their counts, sorted: (distinct pairs, index of the pair, u, count)."""
    distinct, back = np.unique(pairs, return_inverse=True)
    keys, *sums = summed((back.astype(np.uint64) << SHIFT) | u.astype(np.uint64), *([] if counts is None else [counts]))
    return distinct, (keys >> SHIFT).astype(np.int64), keys & LOW, sums[0]


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or b"").lower() for t in batch.column(column).to_pylist()]


def _count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            hashes = _hashes(seen, len(seen))
            out = pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in _texts(batch, 0):
                for words in word_chunks(text):
                    seen.update(words)
                    if len(seen) > MOST_WORDS:
                        yield flush()
                seen[END] += 1
        if seen:
            yield flush()

    return docs.mapInArrow(trimmed(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _store_words(counted: DataFrame, uri: str, files: int) -> DataFrame:
    """Writes the vocabulary files; gives (file, words, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        h, c = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
        order = np.argsort(h)
        h, c = h[order], c[order]
        file = (h % np.uint64(files)).astype(np.int64)
        rows = []
        for k in np.unique(file):
            at = file == k
            ArrayStore(uri).write(f"words-{k}", h[at].astype("<u8").tobytes() + c[at].astype("<u8").tobytes())
            rows.append((int(k), int(at.sum()), int(c[at].sum())))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["file", "words", "tokens"])

    # Unsigned remainder of the hash, so that file and partition agree.
    file = F.pmod(F.pmod(F.col("h"), F.lit(files)) + F.when(F.col("h") < 0, F.lit((1 << 64) % files)).otherwise(F.lit(0)), F.lit(files))
    return counted.repartition(files, file).mapInArrow(trimmed(run), "file long, words long, tokens long")


def _count_triples(docs: DataFrame, shape: Shape) -> DataFrame:
    """Sorted runs of trigrams with counts (file, run), summed over what a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shape)
        words.columns, words.table = (lambda numbers: words.counts(numbers)[None]), np.zeros((1, len(words.number)))
        words.table[0, 0] = shape.texts
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs, u, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            flags = dict(zip(*np.unique(pairs[hot] >> SHIFT, return_index=True), strict=True))
            distinct, at, u, counts = _summed_triples(pairs, u)
            file = _file_of(distinct, np.isin(distinct >> SHIFT, np.array(list(flags), np.uint64)), shape.files)[at]
            order = _by_file(file)
            pairs, u, counts, file = distinct[at[order]], u[order], counts[order], file[order]
            found = [(k, squeeze(pairs[a:b], u[a:b], counts[a:b])) for k, a, b in _runs(file)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["file", "run"])

        for batch in batches:
            for _, u, v, w in words.lines(_texts(batch, 0)):
                number = words.number
                held.append((_pairs(number[v], number[w]), number[u].astype(np.uint32), words.table[0][v] > shape.hot))
                size += len(w)
                if size > MOST_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(trimmed(run), "file int, run binary")


#: Kinds of runs that the trigram files give: followers of a word, words before a word, sizes and counts of counts, and
#: contexts of very frequent words, which several files have a part of.
FOLLOWERS, BEFORE, ABOUT, CONTEXTS = range(4)


def _write_contexts(store: ArrayStore, k: int, name: str, keys: np.ndarray, total: np.ndarray, few: list[np.ndarray]) -> list[int]:
    """Contexts met once need no numbers. Gives the sizes of both tables."""
    once = total == 1
    if once.any():
        store.write(f"{name}-once-{k}", pack_table(mix(keys[once])))
    if not once.all():
        store.write(f"{name}-{k}", pack_table(mix(keys[~once]), total[~once], *(f[~once] for f in few)))
    return [int(once.sum()), int((~once).sum())]


def _store_triples(runs: DataFrame, shape: Shape) -> DataFrame:
    """Writes the files of trigrams, of pairs and of contexts. Gives runs (kind, file, run)."""

    def store(k: int, parts: list[bytes], words: Words) -> list[tuple[int, int, bytes]]:
        columns = [expand(p, 3) for p in parts]
        pairs, at, u, counts = _summed_triples(*(np.concatenate([c[i] for c in columns]) for i in range(3)))
        del columns
        store = ArrayStore(shape.uri)
        hashed = mix(pairs)
        store.write(f"triples-{k}", pack_table(_triple_hash(hashed[at], u), counts))
        n = np.bincount(at, minlength=len(pairs))
        store.write(f"pairs-{k}", pack_table(hashed, n))
        # Contexts u v: what follows them, by how often it does.
        v = pairs >> SHIFT
        which = [(counts == 1).astype(np.uint64), (counts == 2).astype(np.uint64), (counts >= 3).astype(np.uint64)]
        contexts, total, *few = summed(_pairs(u, v[at]), counts, *which)
        middle = np.unique(v)
        hot = np.isin(contexts & LOW, middle[words.counts(middle.astype(np.int64)) > shape.hot])
        sizes = _write_contexts(store, k, "contexts", contexts[~hot], total[~hot], [f[~hot] for f in few]) if not hot.all() else [0, 0]
        many = [np.bincount(np.minimum(x, 5).astype(np.int64), minlength=6)[1:5].tolist() for x in (counts, n)]
        out = [(ABOUT, k, json.dumps([sizes, *many]).encode())]
        if hot.any():
            here = contexts[hot]
            order = _by_file(file := (mix(here) % np.uint64(shape.files)).astype(np.uint32))
            order = order[np.lexsort((here[order], file[order]))]
            rest = [x[hot][order] for x in (total, *few)]
            out += [(CONTEXTS, f, squeeze(here[order][a:b], *(x[a:b] for x in rest))) for f, a, b in _runs(file[order])]
        ones = [(n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n >= 3).astype(np.uint64), n.astype(np.uint64)]
        for kind, stats in ((FOLLOWERS, summed(v, *ones)), (BEFORE, summed(pairs & LOW))):
            out += [(kind, f, squeeze(*(s[a:b] for s in stats))) for f, a, b in _runs(stats[0] // np.uint64(shape.span))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, words = None, [], Words(shape)

        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "file", "run"])

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last and parts:
                    yield rows(store(last, parts, words))
                    parts = []
                last = k
                parts.append(data)
        if parts:
            yield rows(store(last, parts, words))

    return runs.repartition(shape.files, "file").sortWithinPartitions("file").mapInArrow(trimmed(run), "kind int, file int, run binary")


def _store_statistics(stats: DataFrame, shape: Shape) -> DataFrame:
    """Writes, for each range of words, the counts of their followers and a(w), and the contexts of very frequent words.
    Gives (file, sizes of the contexts' tables, counts of counts of a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        contexts: dict[int, list] = {}
        for batch in batches:
            for kind, k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == CONTEXTS:
                    contexts.setdefault(k, []).append(expand(data, 5))
                    continue
                table = tables.setdefault(k, np.zeros((5, shape.span), np.uint64))
                columns = expand(data, 5 if kind == FOLLOWERS else 2)
                at = (columns[0] - np.uint64(k * shape.span)).astype(np.int64)
                if kind == FOLLOWERS:
                    table[:4, at] += np.array(columns[1:])
                else:
                    table[4, at] += columns[1]
        rows = []
        for k in sorted({*tables, *contexts}):
            sizes = [0, 0]
            if k in contexts:
                keys, total, *few = summed(*(np.concatenate([c[i] for c in contexts[k]]) for i in range(5)))
                sizes = _write_contexts(ArrayStore(shape.uri), k, "hot", keys, total, few)
            few = [0] * 6
            if k in tables:
                ArrayStore(shape.uri).write(f"stats-{k}", tables[k].astype("<u8").tobytes())
                a = tables[k][4]
                few = [*np.bincount(np.minimum(a, 5).astype(np.int64), minlength=6)[1:5].tolist(), int(a.sum()), int((a > 0).sum())]
            rows.append([k, *sizes, int(k in tables), *few])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["file", "once", "more", "stats", "n1", "n2", "n3", "n4", "total", "some"])

    return stats.where(F.col("kind") != ABOUT).repartition(shape.files, "file").mapInArrow(trimmed(run), "file long, once long, more long, stats long, n1 long, n2 long, n3 long, n4 long, total long, some long")


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things met once to four times."""
    n1, n2, n3, n4 = n
    if not n1:
        return (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
    return tuple(min(max(d, 0.05), k - 0.05) if d == d else 0.5 for k, d in zip((1, 2, 3), raw, strict=True))


@dataclass
class KneserNey:
    """A fitted model: its shape, the files that there are with the sizes of their context tables, and the constants."""

    shape: Shape
    sizes: dict[int, list[int]]
    hot_sizes: dict[int, list[int]]
    stats: set[int]
    d: tuple
    d2: tuple
    e: tuple
    total: int
    spread: float

    def p1(self, a: np.ndarray) -> np.ndarray:
        return (a - _taken(a, self.e)) / max(self.total, 1) + self.spread / (self.shape.size + 1)


def _taken(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def fit(docs: DataFrame, text_col: str = "text", owner: str = "") -> KneserNey:
    """Counts every row of ``docs``. Its files stay in the shared folder until that owner's scratch is released. Null texts
    are empty; repeated rows count as often as they occur; of an empty table nothing is known; extra columns are ignored.
    More than 2^32 distinct words are an error."""
    spark = docs.sparkSession
    word_files, uri = shuffle_partitions(spark), scratch_path(spark, "lm", owner)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    told = {r[0]: (r[1], r[2]) for r in _store_words(_count_words(texts), uri, word_files).collect()}  # a row for each file
    firsts = np.cumsum([0, *(told.get(k, (0, 0))[0] for k in range(word_files))]).tolist()
    shape = Shape(uri, word_files, firsts, tokens=sum(t for _, t in told.values()))
    if shape.size >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    shape.files = max(word_files, shape.tokens // FILE_TOKENS + 1)
    shape.hot = max(1000, shape.tokens // (4 * shape.files))
    shape.span = shape.size // shape.files + 1
    none = (0.0,) * 3
    if not shape.tokens:
        return KneserNey(shape, {}, {}, set(), none, none, none, 0, 1.0)
    end = Words(shape)
    shape.texts = int(end.counts(end.find(_hashes([END], 1)))[0])
    end.store.forget()
    stats = staged(_store_triples(_count_triples(texts, shape), shape), "lm-stats", owner)
    about = {r[0]: json.loads(r[1]) for r in stats.where(F.col("kind") == ABOUT).select("file", "run").collect()}  # a row for each file
    d, d2 = (discounts([sum(x[k][i] for x in about.values()) for i in range(4)]) for k in (1, 2))
    below = _store_statistics(stats, shape).collect()  # a row for each file
    n, total, some = [sum(r[i] for r in below) for i in range(4, 8)], sum(r[8] for r in below), sum(r[9] for r in below)
    e = discounts(n)
    spread = (e[0] * n[0] + e[1] * n[1] + e[2] * (some - n[0] - n[1])) / max(total, 1)
    return KneserNey(shape, {k: x[0] for k, x in about.items()}, {r[0]: [r[1], r[2]] for r in below if r[1] + r[2]}, {r[0] for r in below if r[3]}, d, d2, e, total, spread)


class Scorer:
    #: Rows of the words' table: count, p1, n(v), l2(v), and whether the word is very frequent.
    COUNT, P1, FOLLOW, LEFT, HOT = range(5)

    def __init__(self, model: KneserNey):
        self.model, self.shape, self.store = model, model.shape, ArrayStore(model.shape.uri)
        self.tables: dict[str, Table] = {}
        self.words = Words(model.shape)
        self.words.table, self.words.columns = np.zeros((5, len(self.words.number))), self._columns
        self.words.table[:, :1] = self._columns(self.words.number[:1])

    def _table(self, name: str) -> Table:
        data = self.store.map(name)
        if name not in self.tables or self.tables[name].data is not data:
            self.tables[name] = Table(data)
            self.tables[name].data = data
        return self.tables[name]

    def _columns(self, numbers: np.ndarray) -> np.ndarray:
        stats = np.zeros((5, len(numbers)))
        file = numbers // self.shape.span
        for k in np.unique(file[numbers >= 0]):
            if k in self.model.stats:
                at = np.flatnonzero((file == k) & (numbers >= 0))
                stats[:, at] = self.store.map(f"stats-{k}").view("<u8").reshape(5, self.shape.span)[:, numbers[at] - k * self.shape.span]
        counts, d2 = self.words.counts(numbers), self.model.d2
        left = (d2[0] * stats[0] + d2[1] * stats[1] + d2[2] * stats[2]) / np.maximum(stats[3], 1)
        return np.stack((counts, self.model.p1(stats[4]), stats[3], np.where(stats[3] > 0, left, 1.0), counts > self.shape.hot))

    def _contexts(self, name: str, sizes: list[int], k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(u v) and the mass that is freed, for hashed contexts; zeros for those never met."""
        d, total, freed = self.model.d, np.zeros(len(keys)), np.zeros(len(keys))
        if sizes[1]:
            table = self._table(f"{name}-{k}")
            at = table.find(keys)
            total = table.values(at, 0).astype(float)
            freed = sum(x * table.values(at, i + 1) for i, x in enumerate(d))
        if sizes[0]:
            missing = np.flatnonzero(total == 0)
            once = missing[self._table(f"{name}-once-{k}").find(keys[missing]) >= 0]
            total[once], freed[once] = 1.0, d[0]
        return total, freed

    def __call__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of p(w | u v) for places of the words' table, and the counts of ``w``."""
        number, table, files = self.words.number, self.words.table, self.shape.files
        p = table[self.P1][w]
        counts = table[self.COUNT][w]
        follow = table[self.FOLLOW][v]
        at = np.flatnonzero((number[v] >= 0) & (follow > 0))  # all else is p1 alone
        u, v, w, follow = u[at], v[at], w[at], follow[at]
        hot = table[self.HOT][v] > 0
        pairs = _pairs(number[v], np.maximum(number[w], 0))
        file = _file_of(pairs, hot, files)
        order = _by_file(file)
        u, v, w, at, hot, pairs, file, follow = (x[order] for x in (u, v, w, at, hot, pairs, file, follow))
        before, known, hashed = number[u], number[w] >= 0, mix(pairs)
        triples = _triple_hash(hashed, np.maximum(before, 0))
        contexts = mix(_pairs(np.maximum(before, 0), number[v]))
        n, c, total, freed = (np.zeros(len(at)) for _ in range(4))
        for k, a, b in _runs(file):
            if k not in self.model.sizes:
                continue
            here = slice(a, b)
            n[here] = (found := self._table(f"pairs-{k}")).values(found.find(hashed[here]), 0)
            some = a + np.flatnonzero(known[here] & (before[here] >= 0) & (n[here] > 0))
            c[some] = (found := self._table(f"triples-{k}")).values(found.find(triples[some]), 0)
            some = a + np.flatnonzero(~hot[here] & (before[here] >= 0))
            total[some], freed[some] = self._contexts("contexts", self.model.sizes[k], k, contexts[some])
        n[~known] = 0
        if len(some := np.flatnonzero(hot & (before >= 0))):
            where = (contexts[some] % np.uint64(files)).astype(np.uint32)
            by = _by_file(where)
            some, where = some[by], where[by]
            for k, a, b in _runs(where):
                if k in self.model.hot_sizes:
                    total[some[a:b]], freed[some[a:b]] = self._contexts("hot", self.model.hot_sizes[k], k, contexts[some[a:b]])
        p2 = (n - _taken(n, self.model.d2)) / follow + table[self.LEFT][v] * p[at]
        seen = total > 0
        p[at] = np.where(seen, (c - _taken(c, self.model.d)) / np.maximum(total, 1) + freed / np.maximum(total, 1) * p2, p2)
        return np.log10(np.maximum(p, 1e-300)), counts


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for each row, whole texts.

    ``score`` is the model's log10 probability of the words and the end; ``base_score`` that of a unigram model with
    0.1 added to each count. Null and empty texts have the end alone. Repeated rows score alike; an empty table gives
    an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, shape = Scorer(model), model.shape
        whole = shape.tokens + 0.1 * (shape.size + 1)
        for batch in batches:
            totals = np.zeros((4, batch.num_rows))
            for text, u, v, w in scorer.words.lines(_texts(batch, 1), 400_000):
                logs, counts = scorer(u, v, w)
                for i, values in enumerate((None, counts > 0, np.log10((counts + 0.1) / whole), logs)):
                    totals[i] += np.bincount(text, values, minlength=batch.num_rows)
            n = totals[:2].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n[0]), pa.array(n[1]), pa.array(np.full(batch.num_rows, shape.tokens, np.int64)), pa.array(totals[2]), pa.array(totals[3])],
                [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(trimmed(run), f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

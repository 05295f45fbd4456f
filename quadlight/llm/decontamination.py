"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the normalised words of the benchmark. Their document frequencies are counted over all documents. A term
   that is in over a tenth of these is as common as it is in the other items, if that is less: words that copies of a
   leak have made frequent keep their weight. No term weighs nothing.
2. A randomised SVD of the TF-IDF matrix of passages gives every term a latent vector. The matrix holds all benchmark
   items and the passages of all documents, which are read once and written as numbers of terms; its products with the
   test matrix are computed and summed by term on the executors.
3. Every document is read whole. Windows of 40 words slide over it in steps of 16, and for items of fewer than 12 words
   windows of 24 in steps of 8; a window whose cosine with an item reaches ``least_cosine`` is a candidate.
4. Candidates are checked exactly on the words around the window: the longest common subsequence of words, and the same
   for the answer, the item's last sentence. Much of the text in order is a leak in itself; half of it, with the answer,
   is a paraphrase. Only where too few of the item's words are there for either is the subsequence not computed.

The benchmark is the query set. It is read in slices of at most ``slice_bytes`` of text, so what is sent to the workers
is bounded; every slice is matched against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import remove, scratch_path, staged, trimmed

BLOCK = 8
#: A window's blocks, and the blocks to the next window.
WINDOW, STEP = 5, 2
#: The same for items of fewer words than ``SHORT``: each then lies in some window as a whole.
SHORT, SHORT_WINDOW, SHORT_STEP = 12, 3, 1
#: Terms in more than this share of the documents may be copies of a leak: the benchmark says how common they are.
COMMON = 0.1
#: Terms up to which a set of them is a whole number.
MOST_BITS = 1 << 14

_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PLAIN = _PLAIN.translate(_LOWER)


def words(text: bytes | None) -> list[bytes]:
    """Normalised words: lower case, cut at white space and ASCII punctuation."""
    text = text or b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(PLAIN).split()


def term_numbers(text: bytes | None, numbers: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; -1 for words that the benchmark does not have."""
    found = words(text)
    return np.fromiter(map(numbers.get, found, repeat(-1)), np.int32, len(found))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        if m := where.get(x, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Index:
    """A slice of the benchmark, ready to be searched for."""

    items: list[int]
    texts: list[list[int]]  # term numbers
    answers: list[list[int]]
    numbers: dict[bytes, int]
    weights: np.ndarray  # by term: inverse document frequency
    latent: np.ndarray  # (terms, dimensions), weighted
    vectors: np.ndarray  # (items, dimensions), of length 1
    least_cosine: float
    least_lcs: float = 0.5
    sure_lcs: float = 0.8
    least_answer: float = 0.5

    def __post_init__(self):
        self.terms = [frozenset(t) for t in self.texts]
        # Of a small vocabulary sets of terms are whole numbers, a bit for each term.
        small = len(self.numbers) <= MOST_BITS
        self.masks = [sum(1 << t for t in terms) for terms in self.terms] if small else None
        self.spare = [len(t) - math.ceil(self.least_lcs * len(t) - 1e-9) for t in self.texts]
        self.sizes = np.array([len(t) for t in self.terms])
        self.flat = np.concatenate([np.fromiter(t, np.int64, len(t)) for t in self.terms])

    def present(self, region: np.ndarray) -> int | set[int]:
        """The terms of a region, for ``holds``."""
        if self.masks is None:
            return set(region.tolist())
        flags = np.zeros(len(self.numbers) + 1, bool)
        flags[region] = True  # -1, for other words, is the last
        flags[-1] = False
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def holds(self, item: int, there: int | set[int]) -> bool:
        """Whether enough of the item's words are there for a longest common subsequence of ``least_lcs``."""
        missing = len(self.terms[item] - there) if self.masks is None else (self.masks[item] & ~there).bit_count()
        return missing <= self.spare[item]

    def held(self, text: np.ndarray, first: np.ndarray, after: np.ndarray, window: np.ndarray, items: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """``holds`` for pairs of an item and a window, whose words go from ``first`` to ``after`` in ``text``.
        Pairs are in the order of their windows, which are taken as many at a time as stay near ``most`` cells."""
        width, sizes, spare = len(self.numbers) + 1, self.sizes[items], np.array(self.spare)[items]
        begin = (np.cumsum(self.sizes) - self.sizes)[items]
        pairs = np.searchsorted(window, np.arange(len(first) + 1))
        cells = np.cumsum(after - first + width + np.bincount(window, sizes, len(first)).astype(np.int64))
        cuts = [*np.flatnonzero(np.diff(cells // most, prepend=-1)).tolist(), len(first)]
        out = np.empty(len(items), bool)
        for a, b in zip(cuts, cuts[1:], strict=False):
            flags = np.zeros((b - a, width), bool)
            length = after[a:b] - first[a:b]
            flags[np.repeat(np.arange(b - a), length), text[_ranges(first[a:b], length)]] = True  # -1, for other words, is the last
            these = slice(pairs[a], pairs[b])
            size = sizes[these]
            there = flags[np.repeat(window[these] - a, size), self.flat[_ranges(begin[these], size)]]
            out[these] = size - np.add.reduceat(there, np.cumsum(size) - size, dtype=np.int64) <= spare[these]
        return out

    def size(self, item: int) -> int:
        return len(self.texts[item])

    def half(self, item: int) -> int:
        """Words to either side of a place that are searched for the item."""
        return int(0.75 * len(self.texts[item])) + BLOCK

    def reach(self, item: int) -> int:
        """Words beyond a window that the item may reach to."""
        return len(self.texts[item]) // 2 + self.half(item)

    def check(self, item: int, region: np.ndarray) -> tuple[float, float] | None:
        """(longest common subsequence, answer's) as shares of the item, if they make a leak."""
        text, answer = self.texts[item], self.answers[item]
        there = region[region >= 0].tolist()
        if not self.holds(item, self.present(region)):
            return None
        share = lcs(text, there) / len(text)
        if share < self.least_lcs:
            return None
        answered = lcs(answer, there) / len(answer) if answer else 1.0
        return (share, answered) if share >= self.sure_lcs or answered >= self.least_answer else None


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` numbers from each ``start`` on."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def candidates(index: Index, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, first word, word after the last, item, cosine) of windows near items that may hold them."""
    sizes = np.array([-(-len(d) // BLOCK) for d in docs], np.int64)
    gap = WINDOW
    first = np.cumsum(sizes + gap) - (sizes + gap)
    if not len(docs) or not sizes.any():
        return
    cells = np.full((int(first[-1] + sizes[-1]) + gap, BLOCK), -1, np.int32)
    for f, d in zip(first, docs, strict=True):
        cells.reshape(-1)[f * BLOCK : f * BLOCK + len(d)] = d
    sums = np.zeros((len(cells), index.latent.shape[1]), np.float32)
    rows = np.concatenate((index.latent, np.zeros((1, index.latent.shape[1]), np.float32)))  # the last for -1
    for lo in range(0, len(cells), 1 << 10):
        for k in range(BLOCK):
            sums[lo : lo + (1 << 10)] += rows[cells[lo : lo + (1 << 10), k]]
    owner = np.repeat(np.arange(len(docs)), sizes)
    place = np.concatenate([f + np.arange(s) for f, s in zip(first, sizes, strict=True)])
    short = np.array([len(t) < SHORT for t in index.texts])
    for width, step, own in ((WINDOW, STEP, np.flatnonzero(~short)), (SHORT_WINDOW, SHORT_STEP, np.flatnonzero(short))):
        if len(own):
            use = (place - first[owner]) % step == 0
            yield from _near(index, docs, first, cells, sums, place[use], owner[use], width, own)


def _near(index: Index, docs: list[np.ndarray], first: np.ndarray, cells: np.ndarray, sums: np.ndarray, at: np.ndarray, doc: np.ndarray, width: int, own: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """The candidates among the items ``own`` in windows of ``width`` blocks that begin at the blocks ``at``."""
    vectors, reaches = index.vectors[own].T, np.array([index.reach(k) for k in range(len(index.texts))])
    sizes = np.array([len(d) for d in docs])
    for lo in range(0, len(at), 1 << 13):
        here, mine = at[lo : lo + (1 << 13)], doc[lo : lo + (1 << 13)]
        w = sums[here]
        for j in range(1, width):
            w = w + sums[here + j]
        some = np.flatnonzero(w.any(axis=1))
        near = _unit(w[some]) @ vectors
        window, items = np.nonzero(near >= index.least_cosine)
        if not len(window):
            continue
        cosines, items = near[window, items], own[items]
        cuts = np.flatnonzero(np.diff(window, prepend=-1))  # the items near a window
        where = some[window[cuts]]
        d = mine[where]
        start = (here[where] - first[d]) * BLOCK
        end = np.minimum(start + width * BLOCK, sizes[d])
        reach, begin = np.maximum.reduceat(reaches[items], cuts), first[d] * BLOCK
        number = np.repeat(np.arange(len(cuts)), np.diff(cuts, append=len(window)))
        held = np.flatnonzero(index.held(cells.reshape(-1), begin + np.maximum(0, start - reach), begin + np.minimum(end + reach, sizes[d]), number, items))
        n = number[held]
        yield from zip(d[n].tolist(), start[n].tolist(), end[n].tolist(), items[held].tolist(), cosines[held].tolist(), strict=True)


def leaks(index: Index, docs: list[np.ndarray]) -> list[tuple[int, int, float, float, float]]:
    """The best leak of each document: (document, item, cosine, lcs, answer)."""
    best: dict[int, tuple] = {}
    tried: set[tuple[int, int, int]] = set()
    for d, start, end, item, cosine in candidates(index, docs):
        size, half, reach = index.size(item), index.half(item), index.reach(item)
        middle = (start + end) // 2
        if not index.holds(item, index.present(docs[d][max(0, start - reach) : end + reach])):
            continue
        # The window may hold only a part of the item, which then reaches to either side.
        for at in {middle, max(start, middle - size // 2), min(end, middle + size // 2)}:
            if (key := (d, item, at // 4)) in tried:
                continue
            tried.add(key)
            if found := index.check(item, docs[d][max(0, at - half) : at + half]):
                rank = (found[0], found[1], cosine, -item)
                if d not in best or rank > best[d][0]:
                    best[d] = (rank, item, cosine, *found)
    return [(d, *b[1:]) for d, b in best.items()]


def _passages(docs: DataFrame, text_col: str, numbers: dict[bytes, int]) -> DataFrame:
    """For each document, the term numbers of its words that the benchmark has, and how many of them are in each of its
    passages."""
    sent, passage = docs.sparkSession.sparkContext.broadcast(numbers), BLOCK * WINDOW
    kind = _kind(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sizes = [], []
            for text in batch.column(0).to_pylist():
                ids = term_numbers(text, sent.value)
                parts = max(1, len(ids) // passage)
                here = np.flatnonzero(ids >= 0)
                ends = np.arange(1, parts + 1) * len(ids) // parts
                terms.append(ids[here].astype(kind).tobytes())
                sizes.append(np.diff(np.searchsorted(here, ends), prepend=0).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(sizes, pa.binary())], ["terms", "sizes"])

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(trimmed(run), "terms binary, sizes binary")


def _kind(numbers: dict[bytes, int]) -> str:
    return "<u2" if len(numbers) <= 1 << 16 else "<u4"


def _frequencies(passages: DataFrame, numbers: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each term is, over all of them, and their number."""
    kind, width = _kind(numbers), len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            terms = [np.frombuffer(t, kind) for t in batch.column(0).to_pylist()]
            if terms:
                owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
                total[:-1] += np.bincount(np.unique(owner * width + np.concatenate(terms)) % width, minlength=width)
                total[-1] += len(terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])

    counted = passages.select("terms").mapInArrow(trimmed(run), "term long, n long").groupBy("term").agg(F.sum("n"))
    out = np.zeros(width + 1, np.int64)
    for term, n in counted.collect():  # a row for each term of the slice
        out[term] = n
    return out[:-1], int(out[-1])


def _run_sums(rows: np.ndarray, at: np.ndarray, sizes: np.ndarray, most: int = 32, block: int = 1 << 10) -> np.ndarray:
    """The sums of the rows ``at`` over runs of ``sizes``, all above zero, one after another. Runs are cut into pieces of
    at most ``most``, and pieces are summed side by side, then the pieces of a run: faster than reduceat."""
    pieces, ends = -(-sizes // most), np.cumsum(sizes)
    first = np.cumsum(pieces) - pieces
    start = np.repeat(ends - sizes, pieces) + most * _ranges(np.zeros_like(pieces), pieces)
    length = np.minimum(most, np.repeat(ends, pieces) - start)
    order = np.argsort(-length, kind="stable")
    out = np.empty((len(start), rows.shape[1]), rows.dtype)
    for lo in range(0, len(order), block):
        here = order[lo : lo + block]
        begin, size = start[here], length[here]
        sums = rows[at[begin]]
        for k in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -k))
            sums[:n] += rows[at[begin[:n] + k]]
        out[here] = sums
    return out if len(out) == len(sizes) else _run_sums(out, np.arange(len(out)), pieces)


def _product(terms: np.ndarray, sizes: np.ndarray, weights: np.ndarray, q: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """A' (A q) for passages of ``sizes`` terms, one after another, each a row of A of length 1."""
    out, weighted = np.zeros(q.shape), (q * weights[:, None]).astype(np.float32)
    sizes = sizes[sizes > 0].astype(np.int64)
    ends = np.cumsum(sizes)
    for lo in range(0, len(sizes), block):
        size = sizes[lo : lo + block]
        here = terms[ends[lo] - size[0] : ends[lo] - size[0] + size.sum()]
        owner = np.repeat(np.arange(len(size)), size)
        pairs, n = np.unique(owner * len(weights) + here, return_counts=True)
        square = np.bincount(pairs // len(weights), (n * weights[pairs % len(weights)]) ** 2, len(size))
        # The length of a row divides both factors, A' and A.
        y = _run_sums(weighted, here, size) / square[:, None].astype(np.float32)
        n = np.bincount(here, minlength=len(weights))
        used = np.flatnonzero(n)
        out[used] += _run_sums(y, owner[np.argsort(here, kind="stable")], n[used])
    return out * weights[:, None]


def _latent(passages: DataFrame, rows: int, items: list[list[int]], numbers: dict[bytes, int], weights: np.ndarray, dimensions: int, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms, dimensions) of the TF-IDF matrix of the passages of all ``rows`` documents, by
    randomised subspace iteration."""
    context, kind = passages.sparkSession.sparkContext, _kind(numbers)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(len(numbers), dimensions)))[0].astype(np.float32)
    own, own_sizes = np.concatenate([np.array(t, np.int64) for t in items]), np.array([len(t) for t in items])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[term] = sums.get(term, 0) + np.frombuffer(row, "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([r.astype("<f4").tobytes() for r in sums.values()], pa.binary())], ["term", "row"])

    for _ in range(rounds):
        q = context.broadcast((basis, weights))

        def product(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            basis, weights = q.value
            out = np.zeros(basis.shape)
            for batch in batches:
                terms, sizes = (np.frombuffer(b"".join(batch.column(c).to_pylist()), k) for c, k in ((0, kind), (1, "<u2")))
                out += _product(terms, sizes, weights, basis)
            used = np.flatnonzero(np.abs(out).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([r.astype("<f4").tobytes() for r in out[used]], pa.binary())], ["term", "row"])

        # Summed in one order, so that another run gives the same vectors.
        parts = passages.select("terms", "sizes").mapInArrow(trimmed(product), "term long, row binary").select("term", F.spark_partition_id().alias("part"), "row")
        sums = parts.repartition("term").sortWithinPartitions("term", "part").mapInArrow(trimmed(summed), "term long, row binary")
        # Items count as much as all documents: what they have to themselves must not drown.
        total = _product(own, own_sizes, weights, basis) * max(1.0, rows / len(items))
        for term, row in sums.collect():  # a row for each term of the slice
            total[term] += np.frombuffer(row, "<f4")
        basis = np.linalg.qr(total)[0].astype(np.float32)
    return basis


def _answer(text: str) -> str:
    """The last sentence of an item."""
    import re

    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p]
    return parts[-1] if parts else ""


def term_weights(frequency: np.ndarray, n: int, texts: list[list[int]]) -> np.ndarray:
    """Inverse document frequencies, all above zero. A share of the documents above ``COMMON`` counts as no more than
    the share of the other items that have the term, or ``COMMON``."""
    others = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=len(frequency)) - 1
    share = (frequency + 1) / (n + 1)
    return -np.log(np.minimum(share, np.maximum(others / len(texts), COMMON))) + 0.01


def build_index(docs: DataFrame, items: list[tuple[int, str]], text_col: str, dimensions: int, least_cosine: float, owner: str = "") -> Index | None:
    """The items with vectors by all of ``docs``. The passages, which each slice has of its own, are deleted at the end."""
    texts = [words(t.encode()) for _, t in items]
    kept = [item for item, ws in zip(items, texts, strict=True) if ws]
    numbers = {w: k for k, w in enumerate(sorted({w for ws in texts for w in ws}))}
    if not kept:
        return None
    texts = [[numbers[w] for w in ws] for ws in texts if ws]
    answers = [[numbers[w] for w in words(_answer(t).encode())] for _, t in kept]
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "passages", owner)
    _passages(docs, text_col, numbers).write.parquet(path)
    passages = spark.read.schema("terms binary, sizes binary").parquet(path)
    frequency, n = _frequencies(passages, numbers)
    weights = term_weights(frequency, n, texts)
    basis = _latent(passages, n, texts, numbers, weights, min(dimensions, len(numbers)))
    remove(spark, path)
    latent = (basis * weights[:, None]).astype(np.float32)
    vectors = _unit(np.array([latent[t].sum(axis=0) for t in texts])).astype(np.float32)
    return Index([i for i, _ in kept], texts, answers, numbers, weights, latent, vectors, least_cosine)


def search(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (id_col and the columns ``keep``) with the best leak of each row, or nulls."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    keep = keep or []
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            out = [[None] * batch.num_rows for _ in range(4)]
            held: list[np.ndarray] = []
            rows: list[int] = []

            def settle(out=out, held=held, rows=rows) -> None:
                for d, item, *values in leaks(index, held):
                    for column, value in zip(out, (index.items[item], *values), strict=True):
                        column[rows[d]] = value
                held.clear()
                rows.clear()

            for i, text in enumerate(batch.column(len(names)).cast(pa.binary()).to_pylist()):
                held.append(term_numbers(text, index.numbers))
                rows.append(i)
                if sum(map(len, held)) > 60_000:
                    settle()
            settle()
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*names, "item_id", "cosine", "lcs", "answer"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(trimmed(run), f"{kinds}, item_id long, cosine double, lcs double, answer double")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    dimensions: int = 128,
    least_cosine: float = 0.5,
    slice_bytes: int = 4 << 20,
    owner: str = "",
) -> DataFrame:
    """Each row of ``docs`` (id_col and the columns ``keep``) with contaminated, item_id, cosine, lcs and answer.

    The best leak by longest common subsequence; all but ``contaminated`` are null without one. Null, empty and
    wordless texts have none, nor do such items match anything; null item ids are reported as null. Repeated rows are
    judged alike; of items with one text the smallest id is reported; an empty table or benchmark gives no leaks; extra
    columns are ignored, but for those of ``keep``, none of which may be called like a column of the result. With a
    benchmark of several slices, a row keeps its best item over all of them.
    """
    if clash := {id_col, *(keep or [])} & {"contaminated", "item_id", "cosine", "lcs", "answer", "_item_id", "_cosine", "_lcs", "_answer", "_text"}:
        raise ValueError(f"columns that are kept may not be called {', '.join(sorted(clash))}")
    items = benchmark.where(F.col(item_text_col).isNotNull()).groupBy(F.col(item_text_col).alias("_item")).agg(F.min(item_col).alias("_id"))
    items = staged(items.select("_id", "_item"), "items", owner)
    size = items.agg(F.sum(F.octet_length("_item"))).first()[0] or 0
    slices = -(-size // slice_bytes) or 1
    found, carried = docs, list(keep or [])
    names = ["item_id", "cosine", "lcs", "answer"]
    state = [f"_{c}" for c in names]
    for k in range(slices):
        part = sorted((r[0] if r[0] is not None else -1, r[1]) for r in items.where(F.pmod(F.xxhash64("_item"), F.lit(slices)) == k).collect())  # about slice_bytes
        index = build_index(docs, part, text_col, dimensions, least_cosine, owner)
        if index is None:
            continue
        text = [text_col] if text_col not in carried and k < slices - 1 else []
        before = [c for c in state if c in found.columns]
        found = search(found, index, id_col, text_col, [*carried, *text, *before])
        if before:
            better = F.coalesce(F.col("lcs") > F.col("_lcs"), F.col("lcs").isNotNull())
            found = found.withColumns({s: F.when(better, F.col(c)).otherwise(F.col(s)) for c, s in zip(names, state, strict=True)}).drop(*names)
        else:
            found = found.withColumnsRenamed(dict(zip(names, state, strict=True)))
    if "_lcs" not in found.columns:
        found = found.select("*", *[F.lit(None).cast("long" if s == "_item_id" else "double").alias(s) for s in state])
    return found.select(id_col, *carried, F.col("_lcs").isNotNull().alias("contaminated"), *[F.col(s).alias(c) for c, s in zip(names, state, strict=True)])

"""Best-fit packing of token sequences, bulk-synchronously.

Documents are tokenized once; what is longer than a sequence is cut so that only its first piece is short. Pieces and
gaps are whole numbers of tokens up to the capacity, so both are held as rows of runs: the ranks of a length's pieces
that are not placed yet, and the numbers of sequences with the same gap. There are about as many as the capacity,
whatever the input. The pieces of one class of lengths after another, the longest first, are placed in two rounds:

1. Runs are range-sorted by size into blocks. Each block's task sweeps it from the longest piece down; a length's pieces
   take the smallest gaps of the block that hold them (their successors), the k-th piece by rank the k-th gap. Gaps
   shrink, and what is left of pieces and gaps goes on.
2. One sweep over all that is left; pieces that find no gap now open sequences.

A piece can only fit a gap of its own block or a higher one, so what a block matches is what best-fit decreasing would
choose among the gaps that are there when the round begins. The rounds are a fixed number of small jobs. Placements are
intervals of ranks; ranks, and the join of pieces with their intervals, are distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadlight.llm.common import shuffle_partitions, staged, trimmed

_encoders: dict[str, object] = {}
#: Intervals (48 bytes each) that are broadcast.
MOST_INTERVALS = 1 << 20


def _encoder(path: str):
    """A function of texts that gives their ids by the tokenizer of the file, once a worker.

    For a plain byte-level BPE file whose rank file lies beside it, the ranks are read by the faster of two libraries. Both
    cut a text at the added tokens first, and then by the same pattern; the ids are equal for every code point and for
    strings of added tokens, as the tests hold. Any other file is read as it is.
    """
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks, added = f"{path.removesuffix('.json')}.tiktoken", _plain_added(path)
        if os.path.exists(ranks) and added is not None:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens=added)
            _encoders[path] = lambda texts: [own.encode_to_numpy(t, allowed_special="all") for t in texts]
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            _encoders[path] = lambda texts: [np.array(e.ids, np.uint32) for e in slow.encode_batch(texts, add_special_tokens=False)]
    return _encoders[path]


def _plain_added(path: str) -> dict[str, int] | None:
    """The added tokens of a plain byte-level BPE file (no normalizer, nothing added to the text, added tokens found as they
    are written); None for any other file."""
    if not path.endswith(".json"):
        return None
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
    if not plain or any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        return None
    return {t["content"]: t["id"] for t in added}


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(id_col, ids: little-endian unsigned 32-bit ids as binary) for each row; ``end_id`` ends every document.

    A null text counts as empty. Strings of special tokens inside a text are these tokens, as the tokenizer has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [x.astype("<u4").tobytes() + end for x in encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, ids binary")


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, made: int | None = None) -> tuple[list[tuple], list[tuple], list[tuple], int | None]:
    """One sweep over runs of pieces (length, lo, hi: ranks) and of gaps (gap, first, end: sequences).

    Gives placements (length, lo, hi, per, first, offset): the pieces with ranks lo..hi-1 go to sequences
    first + (rank - lo) // per, at offset + length * ((rank - lo) % per); the runs of pieces and of gaps that are left; and
    ``made``, the number of sequences. Where ``made`` is None, pieces without a gap are left, else they open sequences.
    """
    plan: list[tuple] = []
    left_over: list[tuple] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, number of sequences)

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            runs.setdefault(gap, []).append((first, n))

    for gap, first, end in sorted(gaps, key=lambda g: (g[0], -g[1])):
        put(gap, first, end - first)
    for length, rank, end in sorted(docs, key=lambda d: (-d[0], d[1])):
        left = end - rank
        for gap in sorted(g for g in runs if g >= length):
            if not left:
                break
            per, waiting = gap // length, runs.pop(gap)
            while waiting and left:
                first, n = waiting.pop()
                whole = min(n, left // per)
                if whole:
                    plan.append((length, rank, rank + whole * per, per, first, capacity - gap))
                    rank, left = rank + whole * per, left - whole * per
                    put(gap - per * length, first, whole)
                if whole < n:
                    first, n = first + whole, n - whole
                    if left:  # fewer than fill one more gap
                        plan.append((length, rank, rank + left, left, first, capacity - gap))
                        put(gap - left * length, first, 1)
                        rank, left, first, n = rank + left, 0, first + 1, n - 1
                    if n:
                        waiting.append((first, n))
            for first, n in waiting:
                put(gap, first, n)
        if left and made is None:
            left_over.append((length, rank, rank + left))
        elif left:
            per = capacity // length
            whole, over = divmod(left, per)
            if whole:
                plan.append((length, rank, rank + whole * per, per, made, 0))
                put(capacity - per * length, made, whole)
            if over:
                plan.append((length, rank + whole * per, rank + left, over, made + whole, 0))
                put(capacity - over * length, made + whole, 1)
            made += whole + (over > 0)
    return plan, left_over, [(g, first, first + n) for g, here in runs.items() for first, n in here], made


#: What a row of the rounds is: pieces (size, lo, hi), gaps (size, first, end), a placement, or the number of sequences (lo).
PIECES, GAP, PLACED, MADE = range(4)
STATE = "kind int, size int, lo long, hi long, per long, first long, at long"


def _rows(plan: list[tuple], pieces: list[tuple], gaps: list[tuple], made: int | None) -> pa.RecordBatch:
    rows = [(PLACED, *p) for p in plan] + [(k, *r, 0, 0, 0) for k, runs in ((PIECES, pieces), (GAP, gaps)) for r in runs]
    rows += [] if made is None else [(MADE, 0, made, 0, 0, 0, 0)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in STATE.split(", ")])


def _sweep_task(capacity: int, low: int, opens: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sweeps the rows of a block: its pieces of at least ``low`` tokens, and its gaps. Shorter pieces pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        pick = lambda kind: [r[1:4] for r in rows if r[0] == kind]
        made = sum(r[2] for r in rows if r[0] == MADE) if opens else None
        now, later = [d for d in pick(PIECES) if d[0] >= low], [d for d in pick(PIECES) if d[0] < low]
        plan, left, gaps, made = sweep(now, pick(GAP), capacity, made)
        yield _rows(plan, left + later, gaps, made)
        if not opens:
            yield _rows([], [], [], sum(r[2] for r in rows if r[0] == MADE) or None)

    return run


def placements(counts: DataFrame, capacity: int, blocks: int = 4, owner: str = "") -> list[DataFrame]:
    """Intervals (size, lo, hi, per, first, at) of the pieces counted by (length, n), in tables of one round each."""
    n = F.lit(0).cast("long")
    state = counts.select(F.lit(PIECES).alias("kind"), F.col("length").cast("int").alias("size"), n.alias("lo"), F.col("n").alias("hi"), n.alias("per"), n.alias("first"), n.alias("at"))
    done = []
    #: Lengths of a class cannot share a sequence in more ways than a few; the last class is all that is short.
    for k, share in enumerate((2, 3, 4, 8, 32, capacity + 1)):
        low = capacity // share + 1
        for opens in (False, True):
            if not opens and k == 0:  # there are no gaps yet
                continue
            dealt = state.coalesce(1) if opens else state.repartitionByRange(blocks, F.col("size").desc())
            state = staged(dealt.mapInArrow(trimmed(_sweep_task(capacity, low, opens)), STATE), "sweep", owner)
            done.append(state.where(F.col("kind") == PLACED))
            state = state.where(F.col("kind") != PLACED)
    return done


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    carry: Callable[[Column], dict[str, Column]] = lambda ids: {"ids": ids},
    owner: str = "",
) -> DataFrame:
    """Packs every document into as few sequences of at most ``capacity`` tokens as best-fit decreasing finds.

    Returns a row per piece: (id_col, piece, start, length, sequence_id, offset, and the columns of ``carry``, which are
    made from a piece's ids before pieces are moved; by default the ids themselves). Only documents over ``capacity``
    are cut. Null and empty texts are one piece, the end id. Rows with repeated or null ids are packed one by one; an
    empty table gives an empty result; extra columns are ignored. Sequence ids are unique numbers without a meaning.
    """
    spark = docs.sparkSession
    tokens = encode(docs, tokenizer, id_col, text_col, end_id).select(id_col, "ids", (F.octet_length("ids") / 4).cast("long").alias("_n"))
    short = (F.col("_n") - 1) % capacity + 1  # of the first piece
    cuts = F.sequence(F.lit(0), ((F.col("_n") - short) / capacity).cast("int"))
    pieces = tokens.select(id_col, "ids", short.alias("_short"), F.explode(cuts).alias("piece"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("_short") + (F.col("piece") - 1) * capacity).cast("long")
    length = F.when(F.col("piece") == 0, F.col("_short")).otherwise(F.lit(capacity)).cast("long")
    pieces = pieces.select(id_col, "piece", start.alias("start"), length.alias("length"), "ids")
    part = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    carried = carry(part)
    # Equal lengths are dealt over many salts, so that no length is one task's work.
    salts = 4 * shuffle_partitions(spark)
    salt = F.pmod(F.xxhash64(id_col, "piece", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    pieces = staged(pieces.select(id_col, "piece", "start", "length", *[c.alias(k) for k, c in carried.items()], salt.alias("_salt")), "pieces", owner)

    by_salt = pieces.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = staged(by_salt.select("length", "_salt", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")), "salts", owner)
    counts = by_salt.groupBy("length").agg(F.sum("count").alias("n"))
    plan = reduce(DataFrame.union, placements(counts, capacity, owner=owner))
    plan = staged(plan.select(F.col("size").cast("long").alias("_length"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("per").alias("_per"), F.col("first").alias("_first"), F.col("at").alias("_at")).coalesce(1), "plan", owner)
    if plan.count() <= MOST_INTERVALS:
        plan = F.broadcast(plan)

    within = Window.partitionBy("length", "_salt").orderBy(id_col, "piece")
    ranked = pieces.withColumn("_k", F.row_number().over(within) - 1).join(by_salt.drop("count"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_k"))
    inside = (ranked["length"] == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    step = F.col("_rank") - F.col("_lo")
    sequence = (F.col("_first") + F.floor(step / F.col("_per"))).cast("long")
    offset = F.col("_at") + ranked["length"] * (step % F.col("_per"))
    return ranked.join(plan, inside).select(id_col, F.col("piece").cast("int").alias("piece"), "start", ranked["length"], *carried, sequence.alias("sequence_id"), offset.alias("offset"))

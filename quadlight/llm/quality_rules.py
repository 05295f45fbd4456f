"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Documents are counted by their pattern of votes; expectation
maximisation on those counts (3 ** rules at most, whatever the input) estimates how often each rule votes rightly in
fact, and the posterior probability of good quality, from a sum of log odds, is one column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import SPACE_PATTERN, WORD_PATTERN, staged, under_old_names, under_own_names

SYMBOLS = r"[^#*$%&|<>]+"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id_col, the columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lower, n_marks) for each row.

    A word is a run without ASCII white space; null texts count as empty. Repeats are found by sorting the hashes of
    the three-word windows of a text, so very long texts cost no more than a sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACE_PATTERN, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    names = list(dict.fromkeys([id_col, *keep]))
    first = docs.select(
        *names,
        words.alias("_w"),
        lines.alias("_l"),
        kept(SYMBOLS).alias("n_symbols"),
        kept(r"[^\p{Lu}]+").alias("n_upper"),
        kept(r"[^\p{Ll}]+").alias("n_lower"),
        kept(r"[^!?|]+").alias("n_marks"),
    )
    window = F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2)))
    second = first.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, window).alias("_h"),
        "n_upper",
        "n_lower",
        "n_marks",
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.withColumn("_o", F.when(repeats, ordered)).drop("_h")
    same = lambda j, x: F.coalesce(F.get("_o", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_o", lambda x, j: same(j - 1, x) | same(j + 1, x))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    # Windows start at sorted places: each adds the words that the one before it did not hold.
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return third.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper", "n_lower", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``statistics``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    vote = lambda bad, good=F.lit(False): F.when(bad, -1).when(good, 1).otherwise(0)
    mean, plain = F.col("word_chars") / n, F.col("n_lower") / chars
    return {
        "short": vote(F.col("n_words") < 30),
        "word_length": vote((mean < 2.5) | (mean > 12)),
        "symbols": vote(F.col("n_symbols") > 0.1 * n),
        "many_symbols": vote(F.col("n_symbols") > 0.3 * n),
        "shouting": vote(F.col("n_upper") > 0.3 * (F.col("n_upper") + F.col("n_lower"))),
        "marks": vote(F.col("n_marks") > 0.2 * n),
        "repeats": vote(F.col("n_repeat_words") > 0.3 * n),
        "same_lines": vote(F.col("n_dup_lines") > 0.02 * n),
        "prose": vote(plain < 0.75, (plain >= 0.85) & (F.col("n_symbols") <= 0.05 * n)),
    }


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[float]]:
    """EM for two classes and independent voters that may abstain.

    ``patterns``: (votes, documents). Returns the log odds of good quality before any vote, and for each rule the log
    odds that a vote of its is right (0 for a rule no better than chance, less for a worse one). Starts from rules that
    are right four times in five, which also says which class is the good one. Five votes more for each rule, and five
    documents more, four of them right and good, stand for what is believed before; nothing else bounds the estimates.
    """
    if not patterns:
        return 0.0, []
    rules = range(len(patterns[0][0]))
    total = sum(n for _, n in patterns)
    weight, prior = [math.log(4.0)] * len(rules), math.log(4.0)
    for _ in range(rounds):
        right, voted, mass = [4.0] * len(rules), [5.0] * len(rules), 0.0
        for pattern, n in patterns:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, prior + sum(weight[r] * pattern[r] for r in rules)))))
            mass += p * n
            for r in rules:
                if pattern[r]:
                    voted[r] += n
                    right[r] += n * (p if pattern[r] > 0 else 1 - p)
        weight = [math.log(a / (b - a)) for a, b in zip(right, voted, strict=True)]
        prior = math.log((mass + 4) / (total - mass + 1))
    return prior, weight


def _marked(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[c.alias(f"_{k}") for k, c in votes().items()])


def fit_rules(stats: DataFrame) -> tuple[float, list[float]]:
    """EM on the documents of ``stats`` that pass the base, counted by their votes (3 ** rules patterns at most)."""
    counted = _marked(stats.where(~base_failed())).groupBy(*[f"_{k}" for k in votes()]).count().collect()
    return fit(sorted((tuple(r[:-1]), r[-1]) for r in counted))


def apply_rules(stats: DataFrame, fitted: tuple[float, list[float]], least: float = 0.5) -> DataFrame:
    """``stats`` with base_failed, quality and kept."""
    prior, weights = fitted
    odds = F.lit(prior)
    for k, weight in zip(votes(), weights, strict=False):
        odds = odds + F.lit(weight) * F.col(f"_{k}")
    out = _marked(stats).withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop(*[f"_{k}" for k in votes()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, owner: str = "") -> DataFrame:
    """The statistics of each row, with base_failed, quality (posterior probability of good) and kept.

    ``kept`` is false where ``base_failed``, else whether ``quality`` reaches ``least``. Null and empty texts have no
    words and fail the base. Repeated rows are judged alike; an empty table gives an empty result; extra columns are
    ignored.
    """
    stats = staged(statistics(docs, id_col, text_col), "quality", owner)
    return apply_rules(stats, fit_rules(stats), least)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, owner: str = "") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows are written once with their statistics: a filter on these would else be pushed below them, and every text
    statistic computed again for each rule that reads it.
    """
    inner, names = under_own_names(docs)
    own = {c: k for k, c in names.items()}
    stats = staged(statistics(inner, own[id_col], own[text_col], inner.columns), "quality", owner)
    return under_old_names(apply_rules(stats, fit_rules(stats), least).where("kept"), names)

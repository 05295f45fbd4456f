"""Rows that earlier versions of the training-data operators left out."""

import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadlight.llm import chat, decontamination, licenses, near_copies, queries


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 50_000, n)]


def edited(rng, words, k):
    words = list(words)
    for at in rng.choice(len(words), k, replace=False):
        words[at] = f"new{rng.integers(0, 1 << 40)}"
    return words


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


# Near copies


def test_near_copies_at_0_8(spark, tmp_path, capsys):
    rng = np.random.default_rng(12)
    texts, planted = [], []
    for _ in range(150):
        first = prose(rng, 200)
        copy = edited(rng, first, int(rng.integers(2, 8)))
        planted.append((len(texts), len(texts) + 1, jaccard(first, copy)))
        texts += [first, copy]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r[0] for r in corpus_pipeline.no_near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect()}
    close = [b for _, b, s in planted if s >= 0.8]
    assert len(close) > 60 and {b for _, b, s in planted if s < 0.8} <= left
    assert sum(b not in left for b in close) >= 0.97 * len(close)
    with capsys.disabled():
        print(f"\nnear copies: {sum(b not in left for b in close)} of {len(close)} at 0.8 or more found")


def test_near_copies_in_a_large_group(spark):
    rng = np.random.default_rng(13)
    base = prose(rng, 150)
    texts = [edited(rng, base, int(rng.integers(0, 9))) for _ in range(120)] + [["one"], ["One"], [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(124, None)]
    got = {r[0]: r[1] for r in near_copies.near_copy_components(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    sets = [shingles(t) for t in texts[:120]]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(120)
    for _ in range(120):
        label = np.array([label[row].min() for row in near])
    assert [got[i] for i in range(120)] == label.tolist()
    assert (got[120], got[121], got[122], got[123], got[124]) == (120, 120, 122, 122, 122)
    assert near_copies.near_copy_components(spark.createDataFrame([], "k long, text string"), "k").count() == 0


# Decontamination


def test_leak_in_a_large_group_of_copies(spark):
    rng = np.random.default_rng(14)
    items = [(i, " ".join(prose(rng, 12)) + ". " + " ".join(prose(rng, 10))) for i in range(8)]
    rows = []
    for i in range(300):
        words = prose(rng, 100)
        if i % 3 == 0:  # a third of the rows carry item 0 but for one word
            leak = items[0][1].replace(".", "").split()
            leak[4] = "other"
            words[30:30] = leak
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), dimensions=16).collect()
    assert {r["doc_id"]: r["item_id"] for r in got if r["contaminated"]} == {i: 0 for i in range(0, 300, 3)}


def brute_leaks(texts, items):
    """Documents with a region whose longest common subsequence with an item, and with its answer, makes a leak: every
    region of every document against every item."""
    found = {}
    for i, text in texts.items():
        words = decontamination.words((text or "").encode())
        for item, whole in items:
            of, answer = decontamination.words(whole.encode()), decontamination.words(decontamination._answer(whole).encode())
            half = int(0.75 * len(of)) + decontamination.BLOCK
            for at in range(0, len(words) + 1, 2):
                region = words[max(0, at - half) : at + half]
                share = decontamination.lcs(of, region) / len(of)
                if share >= 0.8 or share >= 0.5 and decontamination.lcs(answer, region) / len(answer) >= 0.5:
                    found.setdefault(i, set()).add(item)
    return found


def test_sets_of_terms_as_numbers(monkeypatch):
    rng = np.random.default_rng(36)
    texts = [rng.integers(0, 60, int(rng.integers(3, 30))).tolist() for _ in range(20)]
    numbers = {b"w%d" % i: i for i in range(60)}

    def index():
        return decontamination.Index(list(range(20)), texts, texts, numbers, np.ones(60), np.zeros((60, 2)), np.zeros((20, 2)), 0.5)

    small = index()
    monkeypatch.setattr(decontamination, "MOST_BITS", 0)
    large = index()
    for _ in range(200):
        region = rng.integers(-1, 60, int(rng.integers(0, 50)))
        a, b = small.present(region), large.present(region)
        assert isinstance(a, int) and isinstance(b, set)
        assert [small.holds(i, a) for i in range(20)] == [large.holds(i, b) for i in range(20)]


def test_windows_that_hold_items():
    """The windows and items that ``holds`` allows one at a time, however many are looked at together."""
    rng = np.random.default_rng(37)
    texts = [rng.integers(0, 60, int(rng.integers(1, 30))).tolist() for _ in range(20)]
    index = decontamination.Index(list(range(20)), texts, texts, {b"w%d" % i: i for i in range(60)}, np.ones(60), np.zeros((60, 2)), np.zeros((20, 2)), 0.5)
    text = rng.integers(-1, 60, 500)
    first = rng.integers(0, 450, 80)
    after = first + rng.integers(0, 50, 80)
    window, items = np.nonzero(rng.random((80, 20)) < 0.4)
    want = [index.holds(i, index.present(text[first[w] : after[w]])) for w, i in zip(window, items.tolist(), strict=True)]
    assert 0 < sum(want) < len(want)
    for most in (1, 700, 1 << 20):
        assert index.held(text, first, after, window, items, most).tolist() == want


def test_leaks_by_brute_force(spark, capsys):
    """Verbatim items, items with words exchanged, left out and put in, and items cut at the end of a document; items of
    5 to 60 words. Recall against brute force, and nothing beyond it."""
    rng = np.random.default_rng(33)
    items = [(i, " ".join(prose(rng, int(rng.integers(3, 40)))) + ". " + " ".join(prose(rng, int(rng.integers(2, 20)))) + ".") for i in range(24)]
    texts, kinds = {}, {}
    for i in range(144):
        words = prose(rng, int(rng.integers(40, 160)))
        kind = ("verbatim", "exchanged", "left out", "put in", "at the end", "none")[i % 6]
        leak = items[i // 6][1].replace(".", "").split()
        if kind == "exchanged":
            leak = edited(rng, leak, len(leak) // 4)
        elif kind == "left out":
            leak = [w for k, w in enumerate(leak) if k % 4]
        elif kind == "put in":
            leak = [x for w in leak for x in ([w, *prose(rng, 1)] if rng.random() < 0.2 else [w])]
        at = len(words) if kind == "at the end" else int(rng.integers(0, len(words)))
        texts[i], kinds[i] = " ".join(words if kind == "none" else [*words[:at], *leak, *words[at:]]), kind
    want = brute_leaks(texts, items)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect() if r["contaminated"]}
    assert all(item in want.get(i, ()) for i, item in got.items())
    share = {k: (sum(i in got for i in want if kinds[i] == k), sum(kinds[i] == k for i in want)) for k in dict.fromkeys(kinds.values())}
    with capsys.disabled():
        print(f"\nleaks found of those that brute force finds: {share}")
    assert sum(i in got for i in want) >= 0.9 * len(want) and len(want) > 100


def test_leaks_of_repeated_items_long_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(34)
    item = " ".join(prose(rng, 30))
    long = prose(rng, 60_000)
    long[50_000:50_000] = item.split()
    docs = spark.createDataFrame([(1, " ".join(long), 5, "x"), (2, "nothing here", 5, "x")], "doc_id long, text string, item_id int, lcs string")
    benchmark = spark.createDataFrame([(7, item), (3, item), (9, item)], "item_id long, text string")
    got = decontamination.decontaminate(docs, benchmark, dimensions=8, slice_bytes=100).collect()
    assert sorted((r["doc_id"], r["contaminated"], r["item_id"]) for r in got) == [(1, True, 3), (2, False, None)]
    with pytest.raises(ValueError, match="item_id"):
        decontamination.decontaminate(docs, benchmark, keep=["item_id"])


# The pipeline's stages with names that they use themselves


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rng = np.random.default_rng(35)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [" ".join(word() for _ in range(90)) for _ in range(8)] + [None, "", " ".join(word() for _ in range(30_000))]
    names = "score string, _label int, item_id string, lcs double, _row string, _number string, component_id string, quality int, kept int, _c0 string, contaminated string, answer int, _text string, n_words string"
    rows = [(i, t, "en", "s", len(t or ""), "s", 1, "i", 0.5, f"row {i}", "n", "c", 3, 4, "c0", "no", 5, "t", "w") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some item of the benchmark that no text holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = str(tmp_path / f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted(r["_row"] for r in docs.collect()) == sorted(f"row {i}" for i in [*range(8), 10]), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    packed = corpus_pipeline.packed(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {*range(8), 10}
    assert corpus_pipeline.packed(spark, docs.where("false"), str(tmp_path)).count() == 0


# Classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(41)
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, 40)
        if i % 5 == 0:
            words[3:3] = ["vile", "scum"]
        if i % 3 == 0:
            words += ["%%%"] * 12
        rows.append((f"id{i}", " ".join(words), f"s{i % 2}", "en", 200))
        labels.append((f"id{i}", int(i % 5 == 0), int(i % 3 != 0)))
    rows += [("id0", rows[0][1], "s0", "en", 1)] * 200 + [(None, "null", None, None, None), ("id999", None, None, None, None), ("id998", "w " * 40_000, "s", "en", 1)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string, lang string, n_chars long"), spark.createDataFrame(labels, "doc_id string, toxic int, quality int")


def test_toxicity_by_brute_force(labelled):
    """The scores of frames against the network written out word by word."""
    from quadlight.llm import toxicity

    docs, labels = labelled
    model = toxicity.fit_sample(docs, labels, F.lit(True))
    names = [*toxicity.STOP_WORDS, ""]
    filters = len(model.bias) // 3

    def plain(text):
        words = (text or "").encode().split()
        rows = [np.zeros(model.table.shape[1])] * 2 + [model.table[list(toxicity.word_rows(w))].sum(axis=0) for w in words] + [np.zeros(model.table.shape[1])] * 2
        best, part = [], 0
        for k in toxicity.WIDTHS:
            ends = [sum(rows[e - k + 1 + j][(part + j) * filters : (part + j + 1) * filters] for j in range(k)) for e in range(2, len(rows))]
            best.append(np.max(ends, axis=0))
            part += k
        odds = np.maximum(np.concatenate(best) + model.bias, 0) @ model.out[:-1] + model.out[-1]
        known = [sum(w.strip(toxicity.EDGE).lower().decode("utf-8", "replace") in stop.split() for w in words) for stop in toxicity.STOP_WORDS.values()]
        at = model.thresholds[names[int(np.argmax(known))] if max(known) else ""]
        return 1 / (1 + np.exp(-np.clip(odds - at + np.log(0.3 / 0.7), -40, 40)))

    got = toxicity.score(docs, model, keep=["text"]).distinct().collect()
    assert len(got) > 300 and all(abs(r["score"] - plain(r["text"])) < 1e-4 for r in got)
    want = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert np.mean([(r["score"] >= 0.3) == want[r["doc_id"]] for r in got if r["doc_id"] in want]) > 0.97
    with pytest.raises(ValueError, match="score"):
        toxicity.score(docs.withColumn("score", F.lit(1)), model, keep=["score"])


def test_co_training_by_brute_force(labelled):
    """The scores of frames against both views summed feature by feature."""
    import math

    from quadlight.llm import quality_classifier as q

    docs, labels = labelled
    model = q.fit_sample(docs, labels, F.lit(True))

    def view(v, features):
        return v.scale * (sum(float(v.weights[f]) for f in features) / math.sqrt(max(len(features), 1)) + v.bias) + v.shift

    by_id = {r["doc_id"]: r for r in docs.collect()}
    rows = q.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        d = by_id[r["doc_id"]]
        text = view(model.text, q.text_features(None if d["text"] is None else d["text"].encode()).tolist())
        meta = view(model.meta, q.meta_features(d["source"], d["lang"], d["n_chars"]).tolist())
        odds = text * model.mix[0] + meta * model.mix[1] + model.mix[2]
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-40, min(40, odds))))) < 1e-9 or d["doc_id"] == "id0"
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([r["kept"] == want[r["doc_id"]] for r in rows if r["doc_id"] in want]) > 0.95


# Chats


def test_large_conversations_keep_their_turns(spark, tmp_path):
    made = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.expr("repeat('<a', 10500000)").alias("text"))
    made.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op8_chat_format(spark, str(tmp_path)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[-7]["n_turns"]) == (1, 21_000_000, 2)
    with pytest.raises(Exception, match="too large"):
        chat.format_chats(chat.conversations_as_records(made)).select("layout").collect()
    broken = spark.range(1).select(F.expr("repeat('{', 17000000)").alias("record"))
    assert [r[0] for r in chat.format_chats(broken).select("layout").collect()] == [None]


def test_conversations_with_other_columns_and_ties(spark):
    rows = [(1, 0, "user", "a", "x", 1), (1, 0, "user", "a", "x", 1), (1, 0, "assistant", None, "x", 2), (2, None, None, "b", "x", 3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, record string, turns int")
    done = chat.format_turns(chat.struct_turns(chat.conversations_as_structs(frame)))
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("assistant", ""), ("user", "a"), ("user", "a")], 2: [("", "b")]}
    assert {r["layout"] for r in done.collect()} == {"messages"}
    assert chat.struct_turns(chat.conversations_as_structs(frame.where("false"))).count() == 0
    other = spark.createDataFrame([(("p", "r", "more"),), (("p", None, "more"),)], "record struct<prompt: string, response: string, id: string>")
    assert [[tuple(t) for t in r["turns"]] for r in chat.struct_turns(other).collect()] == [[("user", "p"), ("assistant", "r")], [("user", "p"), ("assistant", "")]]


# Licences


def test_licence_sentences_with_cuts_inside_and_wrapped(spark):
    full = licenses.SENTENCES
    texts = [full[k] for k in full]
    wrap = lambda *keys: "\n\n".join("\n".join(textwrap.wrap(full[k], 60, initial_indent=" * ", subsequent_indent=" * ")) for k in keys)
    texts += [textwrap.fill(t, 25) for t in texts]
    notices = [("mit-title", "mit-grant", "mit-keep"), ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), ("gpl-grant", "gpl-hope"), ("apache-notice-full", "apache-copy")]
    rows = list(enumerate([*texts, *(wrap(*n) for n in notices)]))
    got = [r for r in sorted(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())]
    assert [r["sentence_ids"] for r in got] == [*full, *full, *(" ".join(n) for n in notices)]
    assert [r["licenses"] for r in got[-4:]] == ["MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0"]


def test_licence_sql_agrees_on_wrapped_and_odd_texts(spark):
    import duckdb

    full = licenses.SENTENCES
    texts = [*full.values(), *(textwrap.fill(t, 25) for t in full.values()), f"// {full['mit-keep']}", full["bsd-name"], "All-rights-reserved.", f"{full['reserved']}{full['reserved']}", f"{full['reserved']} {full['reserved']}\r\n{full['cc0-name']}", "ALL RIGHTS RESERVED", "All rights. reserved", "x All rights reserved.", None, "", " \n", "|", "all rights reserved|all rights reserved", "All righKs reserved"]
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert {r[0]: r[1:] for r in c.execute(licenses.scan_sql()).fetchall()} == got
    at = 2 * len(full)
    assert [got[at + k][0] for k in range(3)] == ["mit-keep", "bsd-name", "reserved"]


def test_licences_of_an_empty_table_long_texts_and_other_columns(spark):
    frame = spark.createDataFrame([(1, "x y. " * 200_000 + "All rights reserved.", "clash", 3)], "doc_id long, text string, sentence_ids string, _names int")
    assert [tuple(r) for r in licenses.scan(frame).collect()] == [(1, "reserved", "all-rights-reserved", 1)]
    assert licenses.scan(frame.where("false")).count() == 0


# URLs


def test_urls_of_empty_tables_hot_urls_and_nulls(spark):
    from quadlight.llm import url_filter

    rows = [(i, "HTTP://www.hot.org/a/?utm_source=x", "clash", 1) for i in range(300)] + [(300, None, None, None), (300, "no scheme", "", 2), (301, "https://cold.org/b", "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, listed int")
    listed = spark.createDataFrame([("http://m.hot.org/a",), (None,), ("http://m.hot.org/a",)], "url string")
    got = url_filter.judge(pages, listed, {})
    assert got.columns == ["page_id", "url", "canonical_url", "listed", "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == sorted([(i, "block") for i in range(300)] + [(300, "allow"), (300, "allow"), (301, "allow")])
    urls = pages.select("page_id", url_filter.canonical(F.col("url")).alias("c"))
    salted = url_filter.in_list(urls, "c", listed.select(url_filter.canonical(F.col("url")).alias("u")), "u", most_broadcast=0)
    assert sorted((r["page_id"], r["listed"]) for r in salted.collect()) == sorted([(i, True) for i in range(300)] + [(300, False), (300, False), (301, False)])
    assert url_filter.judge(pages.where("false"), listed, {"a/": "block"}).count() == 0
    assert url_filter.judge(pages, listed.where("false"), {}).where("verdict = 'block'").count() == 0


# Quality rules


def test_quality_rules_by_brute_force(spark):
    """Every base column and the verdict, computed word by word in Python."""
    import collections
    import math
    import re

    from quadlight.llm import quality_rules

    rng = np.random.default_rng(21)
    texts = {}
    for i in range(160):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(20, 200)))]
        if i % 3 == 0:
            words = [w + str(rng.choice(["###", "%%", "&!", "|", ""])) for w in words]
        if i % 4 == 0:
            words[5:5] = words[:8] * int(rng.integers(1, 9))
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        texts[i] = "\n".join(lines * (1 + (i % 5 == 0)) + ["", "  "] * (i % 2))
    texts[160], texts[161], texts[162] = None, "", "WORD " * 60_000
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, kept int")).collect()}
    stats, votes = {}, {}
    for i, t in texts.items():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for j in range(len(w) - 2):
            if seen[tuple(w[j : j + 3])] > 1:
                covered |= {j, j + 1, j + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        symbols, dups = sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
        stats[i] = (len(w), sum(map(len, w)), symbols, dups, len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == stats[i]
        n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
        upper, lower, marks = sum(c.isupper() for c in t), sum(c.islower() for c in t), sum(c in "!?|" for c in t)
        vote = lambda bad, good=False: -1 if bad else 1 if good else 0
        votes[i] = (vote(len(w) < 30), vote(not 2.5 <= chars * (len(w) > 0) / n <= 12), vote(symbols > 0.1 * n), vote(symbols > 0.3 * n), vote(upper > 0.3 * (upper + lower)), vote(marks > 0.2 * n), vote(len(covered) > 0.3 * n), vote(dups > 0.02 * n), vote(lower / chars < 0.75, lower / chars >= 0.85 and symbols <= 0.05 * n))
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stats.items()}
    patterns = collections.Counter(votes[i] for i in texts if not failed[i])
    prior, weights = math.log(4), [math.log(4)] * 9
    for _ in range(100):
        right, voted, mass = [4.0] * 9, [5.0] * 9, 0.0
        for v, k in patterns.items():
            good = 1 / (1 + math.exp(-(prior + sum(a * b for a, b in zip(weights, v, strict=True)))))
            mass += good * k
            for r in range(9):
                if v[r]:
                    voted[r] += k
                    right[r] += k * (good if v[r] > 0 else 1 - good)
        weights, prior = [math.log(a / (b - a)) for a, b in zip(right, voted, strict=True)], math.log((mass + 4) / (sum(patterns.values()) - mass + 1))
    for i in texts:
        odds = prior + sum(a * b for a, b in zip(weights, votes[i], strict=True))
        assert got[i]["base_failed"] == failed[i] and got[i]["kept"] == (not failed[i] and odds >= 0), (i, odds)
        assert abs(got[i]["quality"] - 1 / (1 + math.exp(-odds))) < 1e-9
    assert {got[i]["kept"] for i in texts if not failed[i]} == {True, False}

"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlight.llm import chat, components, decontamination, language_model, licenses, packing, quality_classifier, quality_rules, queries, simhash, toxicity, url_filter
from quadlight.llm.common import word_chunks

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    out = {i: prose(rng, int(rng.integers(5, 120))) for i in range(30)}
    out[30], out[31], out[32], out[33] = None, "", " \t\n", "one"
    out[34] = out[5]  # an exact copy
    long = prose(rng, 3000).split()
    out[35] = " ".join(long)
    out[36] = " ".join([*long[:-1], "other"])  # a near copy
    out[37] = "x" * 50_000
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in texts.items()] + [(None, "a null id of its own", None, None, None, None, None), (None, None, None, None, None, None, None), (3, texts[3], "en", "s", 1, "", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length string, h int")


def empty(docs):
    return docs.where("false")


# SimHash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(values, radius):
    """The smallest index that each value reaches."""
    label = list(range(len(values)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(values))]


def test_fingerprints(texts):
    got = simhash.many_fingerprints([t.encode() if t is not None else None for t in texts.values()])
    assert got.tolist() == [plain_fingerprint(t) for t in texts.values()]
    long = ("Word " * 400_000).encode()
    assert simhash.many_fingerprints([long, None]).tolist() == [plain_fingerprint("word word word word"), 0]


def test_simhash_components(docs, texts):
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == docs.count()
    ids = list(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = {i: ids[r] for i, r in zip(ids, reach(prints, 3), strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == want
    nulls = [r["component_id"] for r in rows if r["doc_id"] is None]
    assert sorted(nulls, key=str) == [30, None]  # a null text joins the other empty ones
    assert simhash.simhash_components(empty(docs)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_links_and_tiles(spark, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres[:6]:
        for _ in range(60):
            v = int(c)
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    want = reach(values, radius)
    for tile in (4096, 16):
        links = simhash.near_links(nodes, radius, tile=tile).collect()
        at = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
        a, b = (np.array([at[r[k]] for r in links], np.int64) for k in (0, 1))
        assert simhash.forest(len(values), a, b).tolist() == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 7), (100, 100), (7, 100), (200, 201)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_chunks():
    text = b"  one two\tthree\n" * 1000
    assert [w for c in word_chunks(text, 64) for w in c] == text.split()


# Packing


def test_sweeps_place_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(30):
        capacity = int(rng.integers(4, 40))
        counts = {int(k): int(rng.integers(1, 60)) for k in rng.integers(1, capacity + 1, 6)}
        fill, seen = collections.defaultdict(list), collections.Counter()
        plan, left, gaps, made = packing.sweep([(k, 0, n) for k, n in counts.items()], [], capacity, 0)
        assert not left and made == len({first + (r - lo) // per for _, lo, hi, per, first, _ in plan for r in range(lo, hi)})
        for length, lo, hi, per, first, at in plan:
            for r in range(lo, hi):
                fill[first + (r - lo) // per].append((at + length * ((r - lo) % per), length))
                seen[length] += 1
        assert dict(seen) == counts
        for pieces in fill.values():
            end = 0
            for at, length in sorted(pieces):
                assert at == end
                end += length
            assert end <= capacity
        # As good as plain best-fit decreasing.
        gaps = []
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fits = [g for g in gaps if g >= length]
            if fits:
                g = min(fits)
                gaps.remove(g)
                gaps.append(g - length)
            else:
                gaps.append(capacity - length)
        assert len(fill) <= len(gaps)


def test_rounds_place_every_piece_once(spark):
    """The rounds of frames against best-fit decreasing, piece by piece on the driver."""
    rng = np.random.default_rng(4)
    for capacity, lengths in ((64, rng.integers(1, 65, 3000)), (64, rng.integers(20, 40, 2000)), (50, np.array([50] * 9)), (2048, rng.integers(1, 700, 4000))):
        counts = collections.Counter(lengths.tolist())
        frame = spark.createDataFrame(list(counts.items()), "length int, n long")
        fill, seen = collections.defaultdict(list), collections.Counter()
        for part in packing.placements(frame, capacity):
            for r in part.collect():
                for k in range(r["lo"], r["hi"]):
                    fill[r["first"] + (k - r["lo"]) // r["per"]].append((r["at"] + r["size"] * ((k - r["lo"]) % r["per"]), r["size"]))
                    seen[r["size"]] += 1
        assert seen == counts
        for pieces in fill.values():
            end = 0
            for at, length in sorted(pieces):
                assert at == end
                end += length
            assert end <= capacity
        gaps: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            k = min((i for i, g in enumerate(gaps) if g >= length), key=lambda i: gaps[i], default=None)
            if k is None:
                gaps.append(capacity - length)
            else:
                gaps[k] -= length
        assert len(fill) <= max(len(gaps) + 1, 1.002 * len(gaps))
    assert packing.placements(spark.createDataFrame([], "length int, n long"), 8)[-1].count() == 0


def test_encoders_agree():
    """The faster library gives what the tokenizer of the contract gives: added tokens, spaces, emoji, any code point."""
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(queries.vocabulary()), packing._encoder(queries.vocabulary())
    odd = ["<|endoftext|> x", " <|endoftext|><|endoftext|>", "a<|endoftext|>\n", "<|endoftext", "  a   b  ", "\u00a0\u2003 x\u3000", "\t\n \r\x0b\x0c", "a\r\nb", "\U0001F600\u200d\U0001F9D1 \U0001F3FD", "e\u0301 é ﬁ Å", "I'm we'll they'Ve", "12 345\u0663\u0bf2", "\x00\x1f\x7f\x85", "", " ", "\ufeffx", "\u202e x \ue000 \U0010ffff"]
    odd += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} ,{chr(c)},  {chr(c)}x\n{chr(c)}'s" for c in [*range(0x20, 0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    for text, ids in zip(odd, fast(odd), strict=True):
        assert ids.tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_is_exact(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    rows = packing.pack(docs.where("doc_id is not null and h = 1"), queries.vocabulary(), capacity=64).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist() == ids
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and all(r["length"] == 64 for r in pieces[1:])
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist()
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 64
    assert len(by_sequence) <= math.ceil(sum(r["length"] for r in rows) / 64) + 1
    assert packing.pack(docs, queries.vocabulary()).count() >= docs.count()
    assert packing.pack(empty(docs), queries.vocabulary()).count() == 0


# Toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        words = prose(rng, 40).split()
        if toxic:
            words[int(rng.integers(0, 40))] = str(rng.choice(["Nasty!", "nasty", "vile", "vilest,"]))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 100 + 800 * (i % 7 == 0)))
        labels.append((i, int(toxic), int(i % 7 != 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_rows(marked, docs):
    rows, labels = marked
    model = toxicity.fit_sample(rows, labels, F.col("doc_id") % 4 != 2)
    got = toxicity.score(rows, model).join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    right = sum((r["score"] >= 0.3) == (r["toxic"] == 1) for r in got)
    assert right >= 0.97 * len(got)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty(docs), model).count() == 0
    none = toxicity.fit_sample(rows, labels.where("false"), F.lit(True))
    assert {round(r["score"], 6) for r in toxicity.score(rows.limit(3), none).collect()} <= {round(1 / (1 + math.exp(4 - math.log(3 / 7))), 6)}


def test_toxicity_reads_long_texts_whole(marked):
    rows, labels = marked
    model = toxicity.fit_sample(rows, labels, F.lit(True))
    scorer = toxicity.Scorer(model)
    clean = (" ".join(WORDS) + " ") * 8000
    late, early = (clean + "nasty").encode(), ("nasty " + clean).encode()
    small = toxicity.Scorer(model)
    small.KEEP, small.FLUSH = 5, 50
    for s in (scorer, small):
        a, b, c = s([clean.encode(), late, early])
        assert a < 0.3 < b and abs(b - c) < 1e-6
    assert np.allclose(scorer([b"alpha1 nasty", b"", None]), small([b"alpha1 nasty", b"", None]))


# Licences


def test_licences(spark):
    full = licenses.SENTENCES
    rows = [(1, f"Text. {full['mit-grant']}\n{full['mit-keep']} More."), (2, "ALL RIGHTS reserved!\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "a licence about nothing"), (6, f"{full['bsd-grant']} {full['bsd-source']} {full['bsd-binary']} {full['bsd-name']}"), (7, f"{full['bsd-grant']} {full['bsd-source']} {full['bsd-binary']}"), (7, "x")]
    got = sorted((r["doc_id"], r["licenses"], r["n_licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 1), (2, "all-rights-reserved CC-BY-NC-4.0", 2), (3, "", 0), (4, "", 0), (5, "", 0), (6, "BSD-3-Clause", 1), (7, "", 0), (7, "BSD-2-Clause", 1)]


# URLs


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7?x#y", "https://com/en/", "ftp://xcom/en/1", "no scheme", None, "http://h?q", "http://h#f://g/", "a://b.example.net/de/8/9", "a://net", "x://sub.org/es/\nz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, pages.where("false"), queries.URL_RULES).collect()}
    assert got == {0: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("com", "/en/", "com/en/", "block"), 2: ("xcom", "/en/1", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("h", "", None, "allow"), 6: ("h", "", None, "allow"), 7: ("b.example.net", "/de/8/9", "example.net/de/8", "block"), 8: ("net", "", None, "allow"), 9: ("sub.org", "/es/\nz", "org/es/", "block")}


def test_listed_urls_are_exact(spark):
    urls = [(i, f"http://www.site{i % 300}.org/a/{i}/?utm_source=x&b=1") for i in range(2000)] + [(2000, None), (2000, "http://site1.org/a/1?b=1")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    listed = pages.where("page_id % 3 = 1").union(pages.limit(1))
    for bound in (64 << 20, 0):
        names = listed.select(url_filter.canonical(F.col("url")).alias("u"))
        got = url_filter.in_list(pages.withColumn("c", url_filter.canonical(F.col("url"))), "c", names, "u", bits_per_url=2, most_broadcast=bound).collect()
        assert len(got) == 2002
        assert all(r["listed"] == (r["url"] is not None and (r["page_id"] % 3 == 1 or r["page_id"] in (0, 2000))) for r in got)


# Quality


def test_quality_statistics(docs, texts):
    for r in quality_rules.judge(docs.where("doc_id is not null and h = 1")).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for j in range(len(w) - 2):
            if c[tuple(w[j : j + 3])] > 1:
                covered |= {j, j + 1, j + 2}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty(docs)).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and kept.where("doc_id = 3").count() == (2 if 3 in good else 0)


def test_voting_model():
    rng = np.random.default_rng(2)
    counts = collections.Counter()
    truth = collections.defaultdict(list)
    for _ in range(4000):
        good = rng.random() < 0.85
        votes = tuple(int(0 if rng.random() < 0.3 else (1 if (rng.random() < 0.85) == good else -1)) for _ in range(5))
        counts[votes] += 1
        truth[votes].append(good)
    prior, weights = quality_rules.fit(sorted(counts.items()))
    said = {v: prior + sum(a * b for a, b in zip(weights, v, strict=True)) > 0 for v in counts}
    assert abs(1 / (1 + math.exp(-prior)) - 0.85) < 0.05 and all(abs(1 / (1 + math.exp(-w)) - 0.85) < 0.05 for w in weights)
    assert sum(said[v] == g for v, gs in truth.items() for g in gs) > 0.93 * 4000
    assert quality_rules.fit([]) == (0.0, [])


def test_co_training(marked, docs):
    rows, labels = marked
    bad = F.concat("text", F.lit(" %%% ### $$$ *** &&& %%% ### $$$"))
    rows = rows.join(labels, "doc_id").withColumn("text", F.when(F.col("quality") == 0, bad).otherwise(F.col("text"))).drop("toxic", "quality")
    model = quality_classifier.fit_sample(rows, labels.where("doc_id < 300"), F.col("doc_id") % 4 != 2)
    got = quality_classifier.score(rows, model).join(labels, "doc_id").where("doc_id >= 300").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) > 0.95 * len(got)
    assert quality_classifier.score(docs, model).count() == docs.count()
    assert quality_classifier.score(empty(docs), model).count() == 0
    none = quality_classifier.fit_sample(rows, labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality_classifier.score(rows.limit(2), none).collect()} == {0.5}


# Chats


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 2, "assistant", "second"), (1, 0, "user", hard), (1, 1, "assistant", hard), (2, 0, None, None), (2, None, "assistant", "\\l\\b<>\n</turn>\n<turn user>\n"), (None, 0, "a>b", "é"), (1, 2, "assistant", "second")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = chat.format_chats(chat.conversations_as_records(turns))
    got = {r["conv_id"]: r for r in done.select("conv_id", "layout", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [("user", hard), ("assistant", hard), ("assistant", "second"), ("assistant", "second")]
    assert got[1]["loss"] == hard + "second" * 2 and got[1]["layout"] == "messages"
    assert [(t["role"], t["text"]) for t in got[2]["t"]] == [("assistant", "\\l\\b<>\n</turn>\n<turn user>\n"), ("", "")]
    assert [(t["role"], t["text"]) for t in got[None]["t"]] == [("a>b", "é")]
    assert chat.format_chats(chat.conversations_as_records(turns.where("false"))).count() == 0


def test_chat_layouts(spark):
    records = ['{"prompt":"p","response":"r"}', '{"instruction":"i","input":"x","output":"o"}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":null}]}', '{"output":"o","instruction":null}', '{"other":1}', "not json", None, '{"messages":[]}']
    got = chat.format_chats(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r["layout"] for r in got] == ["prompt_response", "instruction_input", "conversations", "instruction", None, None, None, "messages"]
    assert [[tuple(t) for t in r["turns"]] for r in got[:4]] == [[("user", "p"), ("assistant", "r")], [("user", "i"), ("user", "x"), ("assistant", "o")], [("user", "h"), ("assistant", "")], [("user", ""), ("assistant", "o")]]
    assert [r["formatted"] for r in got[4:7]] == [None] * 3 and got[7]["formatted"] == ""
    assert [r["extra"] for r in got] == [None] * 4 + ['{"other":1}', "not json", None, None]


def test_chat_records_with_more_fields(spark):
    """What a layout does not read is kept beside the turns, and no turn is lost for it."""
    records = ['{"messages":[{"role":"user","content":"a","name":"n"},{"role":"assistant","content":"b"}],"id":7}', '{"id":"x","prompt":"p","response":"r","system":"s"}', '{"instruction":"i","output":"o","input":"x","system":"s","tags":["t"]}', '{"messages":[{"content":"only"}]}', '{"question":"q","answer":null,"prompt":"p"}']
    got = chat.format_chats(spark.createDataFrame([(r, 1) for r in records], "record string, turns int")).collect()
    assert [r["layout"] for r in got] == ["messages", "system_prompt_response", "system_instruction_input", None, "question_answer"]
    assert [tuple(t) for t in got[0]["turns"]] == [("user", "a"), ("assistant", "b")] and [t["role"] for t in got[2]["turns"]] == ["system", "user", "user", "assistant"]
    extras = [json.loads(r["extra"]) for r in got]
    assert extras[0]["id"] == "7" and json.loads(extras[0]["messages"]) == [{"name": "n"}, {}] and extras[1] == {"id": "x"}
    assert json.loads(extras[2]["tags"]) == ["t"] and extras[3] == {"messages": [{"content": "only"}]} and extras[4] == {"prompt": "p"}


# Language model


def plain_kneser_ney(train):
    """p(w | u v) of the trigram model over lists of words that end with the end, from dictionaries."""
    triples = collections.Counter(t for x in train for t in zip([None, None, *x], [None, *x], x, strict=False))
    follow = collections.defaultdict(list)
    for (u, v, _), c in triples.items():
        follow[u, v].append(c)
    pair = collections.Counter((v, w) for _, v, w in triples)
    after = collections.defaultdict(list)
    for (v, _), n in pair.items():
        after[v].append(n)
    ahead = collections.Counter(w for _, w in pair)
    vocabulary = len({w for x in train for w in x})
    d, d2, e = (language_model.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]) for counts in (triples, pair, ahead))
    off = lambda c, d: d[min(c, 3) - 1] if c else 0
    total = sum(ahead.values())
    spread = sum(off(x, e) for x in ahead.values()) / total
    p1 = lambda w: (ahead[w] - off(ahead[w], e)) / total + spread / (vocabulary + 1)

    def p2(w, v):
        if v not in after:
            return p1(w)
        return (pair[v, w] - off(pair[v, w], d2)) / sum(after[v]) + sum(off(n, d2) for n in after[v]) / sum(after[v]) * p1(w)

    def p3(w, u, v):
        if (u, v) not in follow:
            return p2(w, v)
        whole = sum(follow[u, v])
        return (triples[u, v, w] - off(triples[u, v, w], d)) / whole + sum(off(c, d) for c in follow[u, v]) / whole * p2(w, v)

    return p1, p2, p3


def words_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b""]


@pytest.mark.parametrize("hot", [None, 2])
def test_kneser_ney_by_hand(docs, texts, hot, monkeypatch):
    if hot is not None:  # every word that occurs three times is dealt out as a very frequent one
        monkeypatch.setattr(language_model, "max", lambda *x: hot if x[0] == 1000 else max(*x), raising=False)
        monkeypatch.setattr(language_model, "MOST_TOKENS", 500)
    texts = {**texts, 33: "one two one two one three " * 300}  # counts beyond a byte
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 33, texts[33]).otherwise(F.col("text")))
    model = language_model.fit(docs.where("h = 1"))
    assert hot is None or model.shape.hot == hot and model.hot_sizes
    train = [words_of(t) for t in texts.values()]
    p1, p2, p3 = plain_kneser_ney(train)
    c1 = collections.Counter(w for x in train for w in x)
    n, v = sum(c1.values()), len(c1)
    unknown = b"?unknown"
    assert abs(sum(p1(w) for w in c1) + p1(unknown) - 1) < 1e-9
    assert abs(sum(p2(w, b"one") for w in c1) + p2(unknown, b"one") - 1) < 1e-9
    assert abs(sum(p3(w, b"two", b"one") for w in c1) + p3(unknown, b"two", b"one") - 1) < 1e-9
    other = docs.sparkSession.createDataFrame([(100, "one two unheard three one"), (101, f"{texts[0]} {texts[1]}")], "doc_id long, text string")
    texts |= {100: "one two unheard three one", 101: f"{texts[0]} {texts[1]}"}
    for r in [*language_model.score(docs, model).collect(), *language_model.score(other, model).collect()]:
        if r["doc_id"] is None:
            continue
        t = words_of(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c1 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p3(w, a, b)) for a, b, w in zip([None, None, *t], [None, *t], t, strict=False)), rel_tol=1e-9)
    assert language_model.score(empty(docs), model).count() == 0
    nothing = language_model.fit(empty(docs))
    assert {(r["n_known"], r["score"]) for r in language_model.score(docs, nothing).collect()} == {(0, 0.0)}


def test_lines_cross_blocks(docs):
    shape = language_model.fit(docs.where("h = 1")).shape
    texts = [b"alpha1 beta2 gamma3 alpha1", b"", b"delta4"]
    words = language_model.Words(shape)

    def numbers(block):
        return [np.concatenate(x).tolist() for x in zip(*((t, *(words.number[i] for i in ids)) for t, *ids in words.lines(texts, block)), strict=True)]

    assert numbers(1000) == numbers(1) and numbers(1000)[0] == [0, 0, 0, 0, 0, 1, 2, 2]
    words.MOST = 1
    assert numbers(1000) == numbers(1)


def test_sorted_hash_arrays():
    from quadlight.llm.arrays import Table, mix, pack_table

    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 4000):
        keys, other = mix(np.arange(n)), mix(np.arange(n, 2 * n + 3))
        a, b = rng.integers(0, 300, n), rng.integers(0, 1 << 40, n)
        table = Table(np.frombuffer(pack_table(keys, a, b), np.uint8))
        at = table.find(keys)
        assert (table.values(at, 0) == a).all() and (table.values(at, 1) == b).all()
        assert (table.find(other) == -1).all() and (table.values(table.find(other), 1) == 0).all()


# Decontamination


def test_lcs():
    assert decontamination.lcs([1, 2, 3, 4], [9, 1, 3, 4, 2]) == 3 and decontamination.lcs([1], []) == 0


def test_leaks(spark):
    rng = np.random.default_rng(5)
    items = [(i, ". ".join([prose(rng, 12), prose(rng, 10)])) for i in range(12)]
    rows, want = [], {}
    for i in range(120):
        words = prose(rng, 150).split()
        if i % 6 == 0:
            item, text = items[i // 6 % 12]
            leak = text.split()
            if i % 12 == 0:  # a paraphrase: some words of it are others
                leak = [w if k % 5 else "other" for k, w in enumerate(leak)]
            words[40:40] = leak
            want[i] = item
        rows.append((i, " ".join(words), 1))
    rows += [(200, None, 1), (201, "", 1), (202, items[0][1] * 1, 1), (0, rows[0][1], 2), (None, items[1][1], 1)]
    want[202] = 0
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, " . ")], "item_id long, text string")
    for size in (1 << 20, 900):
        got = decontamination.decontaminate(docs, benchmark, dimensions=16, slice_bytes=size)
        assert got.columns == ["doc_id", "contaminated", "item_id", "cosine", "lcs", "answer"]
        found = got.collect()
        assert len(found) == len(rows)
        assert {r["doc_id"]: r["item_id"] for r in found if r["contaminated"] and r["doc_id"] is not None} == want
        assert [r["item_id"] for r in found if r["doc_id"] is None] == [1]
    assert decontamination.decontaminate(docs, benchmark.where("false")).where("contaminated").count() == 0
    assert decontamination.decontaminate(empty(docs), benchmark, dimensions=4).count() == 0


def test_ids_of_remainders(spark):
    from quadlight.llm.common import id_remainder

    df = spark.createDataFrame([(7,), (123,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(id_remainder(F.col("doc_id"), 4)).collect()] == [zlib.crc32(b"7") % 4, zlib.crc32(b"123") % 4, 0]

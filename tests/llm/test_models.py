"""Language, toxicity, near-duplicates, MPEG columns, the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import SF
from cuewright.llm import common, language, mpeg, near_dedup, toxicity

SF01 = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = language.op1_language_id(spark, SF01).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_backoff():
    words = {"the": [50, 0], "der": [0, 50]}
    grams = {}
    for word, j in (("thing", 0), ("schnell", 1), ("with", 0), ("schein", 1)):
        for n in range(1, 6):
            for g in language.grams_of(word, n):
                grams.setdefault(g, [0, 0])[j] += 5
    m = language.Model(["de", "en"], {k: v[::-1] for k, v in words.items()}, {k: v[::-1] for k, v in grams.items()})
    got = [x for x, _ in m.predict(["the", "der", "things", "schei"])]
    assert got == ["en", "de", "en", "de"]
    assert m.predict([None, "", "123 !?", "½ ²"]) == [("und", 0.0)] * 4
    assert m.predict(["Ω"])[0][0] == "de"  # a letter that nothing is known of: the first language
    assert language.Model([], {}, {}).predict(["word", None]) == [("und", 0.0)] * 2 and m.predict([]) == []


def brute_language(train, text):
    """Word-first backoff by plain loops over the training rows."""
    langs = sorted({lang for _, lang in train})
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    seen = {lang: [w for t, x in train if x == lang for w in split(t)] for lang in langs}
    cut = lambda w, n: [w] if n == 0 else list(w) if n == 1 else [("\x02" + w + "\x03")[i : i + n] for i in range(len(w) + 3 - n)]
    tables = {n: {lang: Counter(g for w in seen[lang] for g in cut(w, n)) for lang in langs} for n in range(6)}
    kinds = {n: len(set().union(*tables[n].values())) for n in range(6)}

    def score(word):
        for n in (0, 5, 4, 3, 2, 1):
            known = [g for g in cut(word, n) if any(tables[n][x][g] for x in langs)]
            if known:
                return [sum(math.log(tables[n][x][g] + 0.5) - math.log(sum(tables[n][x].values()) + 0.5 * (kinds[n] + 1)) for g in known) / len(known) for x in langs]

    scores = [x for w in split(text or "") if (x := score(w))]
    if not scores:
        return "und" if not any(map(str.isalpha, text or "")) else langs[0]
    mean = [sum(x) / len(scores) for x in zip(*scores)]
    return langs[mean.index(max(mean))]


def test_language_brute(spark):
    """Every row as plain loops say, over a toy corpus with words unseen and seen once."""
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "bcdef", "cc": "cdefgé"}
    word = lambda lang: "".join(rng.choices(letters[lang], k=rng.randint(1, 7)))
    train = [(" ".join(word(lang) for _ in range(rng.randint(1, 12))), lang) for lang in letters for _ in range(12)]
    tests = [" ".join(word(rng.choice(list(letters))) for _ in range(rng.randint(0, 5))) for _ in range(80)] + [None, "", "...", "Ω", "zzz a", train[0][0].upper()]
    model = language.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert [got[i] for i in range(len(tests))] == [brute_language(train, t) for t in tests]


def test_language_odd_tables(spark, docs):
    empty = docs().limit(0)
    assert language.predict(empty, language.fit(empty)).count() == 0
    rows = docs((1, "a b"), (None, "c"), (2, None), (3, "x " * 50_000))
    got = {r["doc_id"]: r for r in language.predict(rows, language.fit(rows)).collect()}
    assert got[2]["lang_pred"] == "und" and got[None]["held_out"] is None and got[3]["lang_pred"] == "en"


def test_language_of_few_rows_is_learned(spark):
    """In a lopsided table a small language keeps its rows in the sample, and all its words are known."""
    rng = random.Random(3)
    large = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    small = ["".join(rng.choices("opqrstuv", k=5)) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(large, k=60)), "aa") for i in range(2000)] + [(2000 + i, " ".join(rng.choices(small, k=12)), "zz") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, train_docs=150)
    assert model.langs == ["aa", "zz"]
    assert {w for _, t, x in rows if x == "zz" for w in t.split()} <= set(model.words) and model.scores.shape == (len(model.words) + len(model.grams), 2)
    assert [x for x, _ in model.predict([" ".join(small), " ".join(large)])] == ["zz", "aa"]
    taken = {r["lang"]: r["count"] for r in language.sampled(df, 150).groupBy("lang").count().collect()}
    assert taken["zz"] == 12 and 100 < taken["aa"] < 180


def test_language_shares():
    assert language.share([], 10) == float("inf") and language.share([4, 6], 10) == float("inf")
    assert language.share([10_000, 10], 1010) == 1000 and language.share([500, 500, 5000], 1500) == 500
    assert language.share([1000] * 50, 100) == language.LEAST_DOCS


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = toxicity.op5_toxicity(spark, SF01).join(labels, "doc_id").collect()
    held = [(r["score"], r["toxic"]) for r in got if r["held_out"]]
    assert auc(held) > 0.75
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_planted(spark, docs):
    rng = random.Random(0)
    plain = ["amber", "river", "stone", "quiet", "morning", "letter", "window", "garden"]
    rows, marks = [], []
    for i in range(240):
        words = rng.choices(plain, k=rng.randint(20, 120))
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "idiotic", "moronish"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    df = docs(*rows)
    model = toxicity.fit(df.filter(common.fold() != 0), labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(got[i]["predicted"] == y for i, y in marks)
    left = toxicity.ordinary_only(df, model)
    assert left.columns == df.columns and left.count() == 180


def test_toxicity_odd_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = docs((1, "a"), (None, None), (2, ""), (3, "x " * 30_000))
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, one)).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, both)).count() == 4
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), none)).count() == 0


def brute_likelihoods(rows, mass=toxicity.BACKOFF):
    """{word: (P ordinary, P toxic)}, and the probability left to words that neither class holds, by the formulas alone."""
    n = [Counter(w for t, y in rows if y == k for w in set(t.split())) for k in (0, 1)]
    both = n[0] + n[1]
    shared = {w: c / (sum(both.values()) + len(both)) for w, c in both.items()}
    out = []
    for k in (0, 1):
        low, high = 0.0, float(max(n[k].values()))
        for _ in range(200):  # the discount that frees the wanted mass
            d = (low + high) / 2
            low, high = (d, high) if sum(min(d, c) for c in n[k].values()) < mass * sum(n[k].values()) else (low, d)
        out.append({w: max(n[k][w] - d, 0) / sum(n[k].values()) + mass * shared[w] for w in both})
    return {w: (out[0][w], out[1][w]) for w in both}, mass * (1 - sum(shared.values()))


def test_kneser_ney_brute(spark):
    """Both likelihoods sum to one, and their log ratios are those of the fitted table, on a small alphabet."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choices("abcdefghij"[: 10 - 3 * y], k=rng.randint(1, 6))) + (" zz" if y else ""), y) for y in (0, 1) for _ in range(30)]
    p, unknown = brute_likelihoods(rows)
    for k in (0, 1):
        assert sum(x[k] for x in p.values()) + unknown == pytest.approx(1.0)
    counts = Counter((w, 2 * y) for t, y in rows for w in set(t.split()))
    table = spark.createDataFrame([(w, *(counts[w, j] for j in range(4))) for w in p], "word string, n0 long, n1 long, n2 long, n3 long")
    got = toxicity.log_ratios(table, (0, 1))
    assert got["zz"] > 0
    for w, (o, t) in p.items():
        assert got.get(w, 0.0) == pytest.approx(math.log(t / o), abs=1e-9)
    text = " ".join(rng.choices([*p, "unseen"], k=40))
    x = [math.log(p[w][1] / p[w][0]) if w in p else 0.0 for w in text.split()]
    assert toxicity.measures(got, text) == pytest.approx((max(x), max(sum(x[i : i + 5]) / 5 for i in range(36)), sum(x) / 40), abs=1e-9)
    assert toxicity.measures(got, "zz")[1] == pytest.approx(got["zz"] / 5) and toxicity.measures(got, "") == toxicity.measures(got, None) == (0.0, 0.0, 0.0)


def test_discount():
    assert toxicity.discount({}) == 0.0 and toxicity.discount({0: 9, 2: 1}, 0.5) == 1.0
    assert toxicity.discount({1: 4, 4: 1}, 0.5) == pytest.approx(0.8) and toxicity.discount({1: 4, 4: 1}, 0.75) == pytest.approx(2.0)


def brute_classes(texts, threshold=near_dedup.THRESHOLD):
    shingle = near_dedup.Shingler()
    sets = [shingle(t) for t in texts]
    c = near_dedup.Components(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= threshold:
                c.join(i, j)
    return [c.find(i) for i in range(len(texts))]


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 6, 30, 200, 400]))))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_brute(spark, docs, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 3)
    texts = corpus(seed)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(*enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    if seed == 0:
        left = near_dedup.one_of_each(docs(*enumerate(texts)))
        assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(brute_classes(texts)))


def test_near_dedup_odd_rows(docs):
    long = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, "..."), (None, long), (5, long), (6, long.upper()), (6, long.upper()), (7, "a b"), (8, "a b"), (9, "a c"), (10, "y " * 40_000), (11, "y " * 40_000)]
    df = docs(*rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, None: None, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 10}
    left = near_dedup.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 2, 3, 5, 7, 9, 10]
    twice = docs((1, long), (1, long), (1, "quite another text"))
    assert near_dedup.one_of_each(twice).count() == 2  # an unlike text stays, whatever its id
    assert near_dedup.classes(df.limit(0)).count() == 0 and near_dedup.one_of_each(df.limit(0)).count() == 0


def test_near_dedup_of_ids_that_unlike_texts_share(docs):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = docs((1, a), (1, b), (2, a), (3, b), (4, "x y z"))
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.classes(df).collect())
    assert got == [(1, 2), (1, 3), (2, 2), (3, 3), (4, 4)]
    left = near_dedup.one_of_each(df)
    assert left.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(2, a), (3, b), (4, "x y z")]
    assert all(r["h1"] == r["size"] == r["class_id"] for r in left.collect())


def test_near_dedup_by_spread_joins(docs, monkeypatch):
    """The way of large tables: nothing is sent whole, hot nodes are split, buckets are cut in blocks."""
    monkeypatch.setattr(common, "is_small", lambda df, rows=0: False)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 2)
    texts = corpus(7, 30)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(*enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_number_of_darts():
    """About k ln k (1,419), or half the elements; not the weight of single elements."""
    rng = np.random.default_rng(2)
    k = near_dedup.COORDINATES
    for n, weight in ((1, 1), (1, 2_000_000), (300, 1), (2000, 1), (20_000, 1), (50, 5000)):
        thrown = []
        near_dedup.signature(rng.integers(0, 2**63, n).astype(np.uint64), np.full(n, weight), thrown=thrown)
        assert thrown[0] < 4 * k * np.log(k) + 0.6 * n * min(weight, near_dedup.UNITS)


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    for kind in (np.int64, np.float64):
        e = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = rng.integers(1, 5, 300).astype(kind), rng.integers(1, 5, 300).astype(kind)
        if kind is np.float64:
            a, b = a - rng.random(300), b - rng.random(300)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        near = np.mean(near_dedup.signature(e, a, 2048) == near_dedup.signature(e, b, 2048))
        assert near == pytest.approx(true, abs=0.05)
        a, b = a * np.where(e % 7 == 0, 50, 1).astype(kind), b * np.where(e % 5 == 0, 30, 1).astype(kind)  # heavy ones, in layers of their own
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert np.mean(near_dedup.signature(e, a, 2048) == near_dedup.signature(e, b, 2048)) == pytest.approx(true, abs=0.05)
    for n in (1, 3, 20_000):
        assert len(np.unique(near_dedup.signature(rng.integers(0, 2**63, n).astype(np.uint64), np.ones(n, dtype=np.int64)))) > 1


def test_texts_are_signed_together(monkeypatch):
    """Darts are thrown strip by strip at many texts, not text by text, and give each text its own signature."""
    rng, calls, throw = np.random.default_rng(4), [], near_dedup._throw
    monkeypatch.setattr(near_dedup, "_throw", lambda *a: calls.append(1) or throw(*a))
    texts = [" ".join(rng.choice(["a", "bc", "déf", "g_1", "Hi"], n)) for n in rng.integers(1, 300, 200)] + ["one two", None, "", "same words " * 3000, " ".join(map(str, range(40_000)))]
    shingle = near_dedup.Shingler()
    sets = shingle.many(texts)
    assert all((a == b).all() for one, text in zip(sets, texts) for a, b in zip(one, shingle(text)))
    sets = [x for x in sets if len(x[0])]
    got = near_dedup.signatures(sets)
    assert len(sets) == 203 and len(calls) < 203
    assert (got == np.array([near_dedup.signature(*x) for x in sets])).all()
    assert (near_dedup.bands_of(got) == np.array([near_dedup.bands_of(x) for x in got])).all()


@pytest.mark.parametrize("text", [None, "", "a", "x" * 576, "x" * 577, "é" * 1000, "\xff\xfb" * 900, "ID3TAG" * 500])
def test_mpeg_round_trip(text):
    raw = (text or "").encode()
    payload, n = mpeg.payload_of(text)
    assert n == len(raw) and len(payload) % 576 == 0 and payload and payload.startswith(raw) and set(payload[n:]) <= {255}
    data = mpeg.carry(payload, n)
    found = mpeg.parse(data)
    assert mpeg.carried(data, found) == (payload, n, True)
    assert (found["frames"], found["crc_bad"], found["resyncs"], found["skipped"]) == (len(payload) // 576, 0, 0, 0)
    assert found["duration"][0] / found["duration"][1] == pytest.approx(len(payload) / 16000)
    assert found["table"]["frames"] == found["frames"] and found["table"]["bytes"] == len(data) - data.index(b"\xff\xf2")
    assert (found["version"], found["layer"], found["rate"]) == ("2", 3, 16000)


@pytest.mark.parametrize("text", ["a" * 505 + "TAG" + "a" * 68, "b" * 5760 + "a" * 505 + "TAG" + "a" * 68, "a" * 505 + "TAG"])
def test_mpeg_payload_that_looks_like_a_tag_at_the_end(text):
    payload, n = mpeg.payload_of(text)
    data = mpeg.carry(payload, n)
    for tag, title in ((b"", None), (b"TAG" + b"name".ljust(125, b"\0"), "name")):
        found = mpeg.parse(data + tag)
        assert mpeg.carried(data + tag, found) == (payload, n, True)
        assert (found["frames"], found["crc_bad"], found["resyncs"], found["skipped"]) == (len(payload) // 576, 0, 0, 0)
        assert found["tags"].get("id3v1:title") == title
    lost = bytearray(data)
    lost[found["offsets"][0] - mpeg.FRAME] = 0  # the first frame: the last is found again
    assert mpeg.parse(bytes(lost))["offsets"][-1] == found["offsets"][-1]
    cut = mpeg.parse(data[:-200] + b"TAG" + b"name".ljust(125, b"\0"))  # a last frame that isn't whole, then a tag
    assert cut["frames"] == found["frames"] - 1 and cut["tags"]["id3v1:title"] == "name"


def test_mpeg_small_frames_over_the_place_of_a_tag():
    frames = bytearray(frame(3, 3, 1, 0) * 5)
    frames[-128:-125] = b"TAG"
    assert mpeg.parse(bytes(frames))["frames"] == 5


def test_mpeg_damage_and_junk():
    payload, n = mpeg.payload_of("hello " * 1000)
    data = mpeg.carry(payload, n)
    whole = mpeg.parse(data)
    cut = whole["offsets"][3]
    broken = data[:cut] + b"\xff\x00junk" + data[cut:] + b"TAG" + b"name".ljust(125, b"\0")
    found = mpeg.parse(broken)
    assert (found["resyncs"], found["skipped"], found["frames"]) == (1, 6, whole["frames"])
    assert found["tags"]["id3v1:title"] == "name"
    bad = bytearray(data)
    bad[whole["offsets"][2] + 8] ^= 1  # side information
    assert mpeg.parse(bytes(bad))["crc_bad"] == 1
    flipped = bytearray(data)
    flipped[whole["offsets"][2] + 100] ^= 1  # payload
    assert mpeg.carried(bytes(flipped), mpeg.parse(bytes(flipped)))[2] is False
    lost = bytearray(data)
    lost[whole["offsets"][2]] = 0
    assert mpeg.parse(bytes(lost))["frames"] == whole["frames"] - 1
    assert mpeg.parse(data[:-10])["frames"] == whole["frames"] - 1
    for junk in (b"", b"\xff" * 5000, bytes(range(256)) * 9):
        assert mpeg.parse(junk)["frames"] == 0


def frame(version, layer, bits, rate, mode=0, crc=False):
    head = bytes([255, 0xE0 | version << 3 | (4 - layer) << 1 | (not crc), bits << 4 | rate << 2, mode << 6])
    return head + bytes(mpeg.Header.of(head).size - 4)


def test_mpeg_variable_rates_and_layers():
    frames = [frame(3, 3, b, 0) for b in (9, 5, 14, 9, 1)]
    xing = bytearray(frame(3, 3, 9, 0))
    xing[36:40] = b"Xing"
    xing[40:44] = (1).to_bytes(4, "big")
    xing[44:48] = (5).to_bytes(4, "big")
    found = mpeg.parse(bytes(xing) + b"".join(frames))
    assert found["bitrates"] == {128: 2, 64: 1, 320: 1, 32: 1} and found["table"]["frames"] == 5
    assert found["sizes"] == [417, 208, 1044, 417, 104] and found["duration"] == [5 * 1152 // 180, 44100 // 180]
    vbri = bytearray(frame(3, 3, 9, 0))
    vbri[36:40] = b"VBRI"
    vbri[46:62] = (100).to_bytes(4, "big") + (5).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    vbri[62:66] = bytes([0, 7, 0, 9])
    assert mpeg.parse(bytes(vbri) + frames[0])["table"] == {"kind": "VBRI", "frames": 5, "bytes": 100, "toc": [7, 9], "at": 0}
    for version, layer, samples in ((3, 1, 384), (3, 2, 1152), (2, 2, 1152), (2, 3, 576), (0, 3, 576)):
        got = mpeg.parse(frame(version, layer, 5, 1) * 3)
        assert got["samples"] == 3 * samples and got["layer"] == layer


# (version, layer, bit rate's index, rate's index, mode, mode extension, body's first byte, bits covered): counted by hand from the standard's tables
COVERED = [
    (3, 1, 5, 0, 3, 0, 0, 128), (3, 1, 5, 0, 0, 0, 9, 256), (3, 1, 5, 0, 1, 1, 9, 160), (2, 1, 5, 0, 2, 0, 0, 256),
    (3, 2, 8, 0, 0, 0, 0, 176), (3, 2, 8, 0, 1, 0, 0, 104), (3, 2, 8, 0, 3, 0, 0, 94), (3, 2, 8, 1, 3, 0, 0, 88), (3, 2, 1, 0, 3, 0, 0, 26), (3, 2, 1, 2, 3, 0, 0, 38),
    (2, 2, 5, 0, 3, 0, 0, 75), (2, 2, 5, 0, 3, 0, 0x11, 79), (2, 2, 5, 0, 0, 0, 0x11, 154), (0, 2, 5, 0, 1, 0, 0, 91), (2, 3, 5, 0, 3, 0, 0, 72),
]


@pytest.mark.parametrize("version, layer, bits, rate, mode, extension, body, covered", COVERED)
def test_mpeg_checksums_of_all_layers(version, layer, bits, rate, mode, extension, body, covered):
    one = bytearray(frame(version, layer, bits, rate, mode, True))
    one[3] |= extension << 4
    one[6] = body
    text = "".join(f"{x:08b}" for x in one[2:4] + one[6:])[: 16 + covered]
    crc = 0xFFFF
    for bit in text:  # long division, bit by bit
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) != int(bit) else 0)) & 0xFFFF
    one[4:6] = crc.to_bytes(2, "big")
    found = mpeg.parse(bytes(one) * 3)
    assert (found["frames"], found["crc_ok"], found["crc_bad"], found["layer"]) == (3, 3, 0, layer)
    bad = bytearray(one)
    bad[5] ^= 1
    last, after = bytearray(one), bytearray(one)
    after[6 + covered // 8] ^= 128 >> covered % 8  # the first bit that isn't covered
    last[6 + (covered - 1) // 8] ^= 128 >> (covered - 1) % 8
    for other, n in ((bad, 1), (last, 1), (after, 0)):
        found = mpeg.parse(bytes(one + other + one))
        assert (found["frames"], found["crc_ok"], found["crc_bad"]) == (3, 3 - n, n)


def test_mpeg_bytes_by_hand():
    """A stream put together by hand: two frames of silence with known bytes, and what a table of them should say."""
    head = bytes([0xFF, 0xF3, 0x94, 0xC0])  # MPEG-2, layer III, no checksum, 80 kbit/s, 24 kHz, mono
    size = 72 * 80_000 // 24_000
    one = head + bytes(size - 4)
    found = mpeg.parse(one * 3)
    assert (found["offsets"], found["rate"], found["samples"], found["duration"]) == ([0, size, 2 * size], 24_000, 3 * 576, [9, 125])
    table = bytearray(one)
    table[13:17], table[17:21] = b"Info", (7).to_bytes(4, "big")
    table[21:25], table[25:29] = (2).to_bytes(4, "big"), (3 * size).to_bytes(4, "big")
    table[29:129] = bytes(min(255, 256 * (1 + k * 2 // 100) // 3) for k in range(100))
    found = mpeg.parse(bytes(table) + one * 2)
    assert found["frames"] == 2 and found["table_check"] == {"frames_ok": True, "bytes_ok": True, "toc_miss": 2}
    assert [mpeg.seek(found, x) for x in (0, 0.49, 0.5, 1)] == [size, size, 2 * size, 2 * size]
    table[24] = 9
    table[29:129] = bytes(100)
    wrong = mpeg.parse(bytes(table) + one * 2)["table_check"]
    assert wrong == {"frames_ok": False, "bytes_ok": True, "toc_miss": 2 * size}
    assert mpeg.parse(bytes([0xFF, 0xF3, 0x04, 0xC0]) * 300)["frames"] == 0  # free format is not followed


def test_crc16():
    assert mpeg.crc16(b"123456789", 0) == 0xFEE8  # CRC-16/UMTS


def test_op2(spark, duck):
    got = mpeg.op2_mpeg_audio(spark, SF).toPandas().set_index("doc_id")
    for key, text in duck.execute("select doc_id, text from documents").fetchall():
        payload, n = mpeg.payload_of(text)
        r = got.loc[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        data = mpeg.carry(payload, n)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_mpeg_reads_stored_media(spark):
    files = mpeg.op2_mpeg_audio(spark, SF).inputFiles()
    assert files and all("/media-" in f for f in files)
    kept = spark.read.parquet(*{f.rpartition("/")[0] for f in files})
    assert kept.columns == ["doc_id", "media"] and kept.filter("length(media) >= 1296").count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_mpeg_columns_of_odd_rows(spark, docs):
    got = {r["doc_id"]: r for r in mpeg.probe(mpeg.encode(docs((1, None), (2, ""), (None, "x"), (3, "z" * 3_000_000), (4, "x"), (4, "x")))).collect()}
    assert got[1]["feature"] == got[2]["feature"] and got[1]["n_bytes"] == 0 and got[3]["n_bytes"] == 3_000_000
    assert got[None]["media_sha256"] == got[4]["media_sha256"]
    assert mpeg.probe(mpeg.encode(docs().limit(0))).count() == 0
    odd = mpeg.probe(spark.createDataFrame([(1, None), (2, bytearray(b"no media"))], "doc_id long, media binary")).collect()
    assert {r["payload_bytes"] for r in odd} == {0}

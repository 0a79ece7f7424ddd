"""Tokens, shards and packing against the tokenizers library and brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import SF
from cuewright.llm import packing, rans, tokens

TEXTS = ["", None, "a", "x  y", " lead", "tail ", "\n\n a \n b", "tab\there  now\t x", "a b  c", "naïve été – “q”", "<|endoftext|> in <|endoftext|> text", "a\x1c b \x85c", "w " * 5000, "日本語 テキスト 🙂 ok"]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.default_path())


def ids_of(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(enc):
    got = enc.encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(enc, t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \t\n.,'s1é  |<>—")), max_size=40))
def test_encoder_equals_library_on_any_text(text):
    enc = tokens.encoder(tokens.default_path())
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids_of(enc, text)


def test_encoder_with_a_full_memo(enc):
    small = tokens.Encoder(tokens.default_path(), 2)
    for _ in range(2):
        assert small.encode(["one two three four", "five six two"]) == enc.encode(["one two three four", "five six two"])


class Counting:
    """A tokenizer that counts how often it is given a word."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)

    def times(self, word):
        return sum(x.count(word) for x in self.texts)


def test_encoder_gives_the_library_each_stem_once(enc):
    new, text = tokens.Encoder(tokens.default_path()), "river stone,\nriver, stone. river! stone\nriver.\nstone (river) stone..."
    new.tokenizer = counting = Counting(new.tokenizer)
    assert np.frombuffer(new.encode([text, text])[0], "<u4").tolist() == ids_of(enc, text)
    # behind a space and behind a line feed; in brackets it is another part
    assert counting.times("stone") == 2 and counting.times("river") == 3


def test_full_memo_costs_a_stem_once_a_slice(enc):
    """Where the memo has no room, all texts of 2 MB share what the library is asked for."""
    batch = pa.record_batch({"doc_id": [1, 2, 3], "text": ["river, stone. " * 40_000, None, "stone river " * 80_000]})
    new = tokens.Encoder(tokens.default_path(), 1)
    new.encode(["full"])
    new.tokenizer = counting = Counting(new.tokenizer)
    got = [x for _, texts in tokens.slices(batch) for x in new.encode(texts)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(enc, x) for x in batch.column("text").to_pylist()]
    assert counting.times("stone") <= 2 and counting.times("river") <= 2


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK - 5])
def test_shard_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, size=n), 50_000).astype("<u4")
    parts = [ids[: n // 3], ids[n // 3 : n // 3], ids[n // 3 :]]
    data = rans.encode_shard([5, None, 7], [p.tobytes() for p in parts])
    keys, lengths, back = rans.decode_shard(data)
    assert keys == [5, None, 7] and lengths.tolist() == [len(p) for p in parts] and (back == ids).all()


def test_shard_shrinks_and_detects_damage():
    ids = np.minimum(np.random.default_rng(1).zipf(1.5, size=60_000), 50_000).astype("<u4")
    data = rans.encode_shard([1], [ids.tobytes()])
    assert len(data) < ids.nbytes / 3
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_shard(bytes(bad))


def test_one_symbol_and_many_symbols():
    for ids in (np.zeros(100, "<u4"), np.arange(60_000, dtype="<u4")):
        assert (rans.decode_shard(rans.encode_shard([1], [ids.tobytes()]))[2] == ids).all()
    freq = rans.quantised(np.array([1e9] + [1.0] * 1000))
    assert freq.sum() == 1 << rans.SCALE and freq.min() == 1


def test_op3(spark, duck, enc):
    got = rans.op3_rans_tokens(spark, SF).toPandas().sort_values("doc_id")
    want, start = [], 0
    for key, text in duck.execute("select doc_id, text from documents order by doc_id").fetchall():
        ids = np.array([*ids_of(enc, text), 0], dtype="<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_shards_of_odd_rows(spark, docs, tmp_path, enc):
    rows = [(3, "three"), (None, None), (1, ""), (2, "long " * 3000), (2, "b"), (2, "b")]
    rans.write_shards(docs(*rows), str(tmp_path / "s"), shard_ids=50)
    got = sorted(map(tuple, rans.read_shards(spark, str(tmp_path / "s")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 2, 2, 3]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    rans.write_shards(docs().limit(0), str(tmp_path / "e"))
    assert rans.read_shards(spark, str(tmp_path / "e")).count() == 0


def brute_first_fit(lengths, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, used in enumerate(bins):
            if used + lengths[i] <= capacity:
                break
        else:
            b = len(bins)
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_first_fit_decreasing(lengths):
    assert packing.first_fit_decreasing(lengths, 20) == brute_first_fit(lengths, 20)


def check_packed(rows, docs_ids, capacity=packing.CAPACITY):
    """Pieces cover each document once, sequences have no gap or overflow."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    left = {}
    for r in rows:
        left.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    want = {}
    for key, ids in docs_ids:
        raw = np.array([*ids, 1], dtype="<u4")
        want.setdefault((key, len(raw)), []).extend((a, min(capacity, len(raw) - a), zlib.crc32(raw[a : a + capacity].tobytes())) for a in range(0, len(raw), capacity))
    assert {k: sorted(v) for k, v in left.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_seq)


def test_op9(spark, duck, enc):
    rows = packing.op9_packing(spark, SF).collect()
    source = [(k, ids_of(enc, t)) for k, t in duck.execute("select doc_id, text from documents").fetchall()]
    n = check_packed(rows, source)
    assert sum(len(i) + 1 for _, i in source) / (n * packing.CAPACITY) > 0.98


def test_packing_odd_rows(spark, docs, enc):
    rows = [(1, ""), (None, None), (2, "word " * 9000), (3, "same"), (3, "same"), (3, "other"), (2**60 + 1, "big id")]
    got = packing.pack(docs(*rows)).collect()
    check_packed(got, [(k, ids_of(enc, t)) for k, t in rows])
    assert packing.pack(docs().limit(0)).count() == 0

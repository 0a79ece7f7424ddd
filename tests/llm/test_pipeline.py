"""The corpus pipeline, stage by stage and as a whole."""

import corpus_pipeline as cp
import pytest
from helpers import SF
from test_models import brute_classes


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    out, docs = [spark.read.parquet(f"{SF}/documents.parquet")], None
    for name, stage in cp.STAGES:
        docs = stage(spark, out[-1], SF)
        path = str(tmp_path_factory.mktemp(name) / "t")
        docs.write.parquet(path)
        out.append(spark.read.parquet(path))
    return [x.toPandas() for x in out]


def test_columns(stages):
    for after in stages[1:-1]:
        assert list(after.columns) == list(stages[0].columns)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_toxicity_keeps_rows_unchanged(stages):
    before, after = stages[0].set_index("doc_id"), stages[1].set_index("doc_id")
    assert 0 < len(after) < len(before) and (before.loc[after.index].text == after.text).all()


def test_lines_brute(stages):
    before, after = stages[1], stages[2].set_index("doc_id")
    strip = " \t\n\x0b\f\r"
    key = lambda s: s.strip(strip).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, text in zip(before.doc_id, before.text):
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= 5}
    for i, text in zip(before.doc_id, before.text):
        want = "\n".join(x for x in text.split("\n") if common.get(key(x), i) == i)
        assert after.text[i] == want and after.n_chars[i] == (len(want) if want != text else after.n_chars[i])


def test_near_dedup_brute(stages):
    before, after = stages[2].sort_values("doc_id"), stages[3]
    ids = before.doc_id.tolist()
    keep = {ids[c] for c in brute_classes(before.text.tolist())}
    assert sorted(after.doc_id) == sorted(keep)


def test_mixing_repeats_rows(stages):
    before, after = stages[3].set_index("doc_id"), stages[4]
    copies = after.doc_id.value_counts()
    assert set(copies.index) <= set(before.index) and copies.max() <= 3
    assert (before.loc[after.doc_id].text.values == after.text.values).all()


def test_packing_takes_all(stages):
    docs, packed = stages[4], stages[5]
    whole = packed[packed.start == 0]
    assert len(whole) == len(docs) and packed.length.sum() == whole.doc_tokens.sum()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_run(spark, stages):
    got = cp.run(spark, SF).toPandas()
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, stages[5][cols].values))


def test_odd_rows(spark, docs):
    """Nulls, empty and repeated rows go through every stage."""
    df = docs((1, None, None), (1, None, None), (None, "a b c d e f", "x"), (2, ""), (3, "word " * 30_000), (4, "one two three four five"), (5, "one two three four five"))
    for _, stage in cp.STAGES[1:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert stage(spark, df.limit(0), SF).count() == 0
        df = out
    assert cp.STAGES[-1][1](spark, df, SF).count() > 0

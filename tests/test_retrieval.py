"""Retrieval and classification on small libraries."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import classify, library, retrieval
from cuewright.operators.retrieval import SearchParams

LIB = "path string, audio_emb array<double>, text_emb array<double>, catid string"


def lib(spark, rows):
    return spark.createDataFrame(rows, LIB)


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, query string, category string, query_emb array<double>")


def test_rerank_and_confidence(spark):
    rows = [("/l/forest_birds_1.wav", "AMBForst", 0.40, 3), ("/l/Birds (dawn).wav", "UNKNOWN", 0.44, 2), ("/l/city.wav", "AMBUrbn", 0.45, 1)]
    df = spark.createDataFrame([(1, "Forest birds", "AMB-FOREST", *r) for r in rows], "query_id long, query string, category string, path string, catid string, score double, rank int")
    got = {r["path"]: r["score"] for r in retrieval.rerank(df).collect()}
    assert got == pytest.approx({"/l/forest_birds_1.wav": 0.48, "/l/Birds (dawn).wav": 0.46, "/l/city.wav": 0.33})
    bands = spark.createDataFrame([(0.48,), (0.45,), (0.3,), (None,)], "s double").select(retrieval.confidence(F.col("s")).alias("c")).collect()
    assert [b["c"] for b in bands] == ["high", "medium", "low", "low"]


def test_zero_vectors_are_not_ranked_and_missing_text_is_scaled(spark):
    rows = [("/a", [1.0, 0.0], None, None), ("/b", [0.0, 1.0], [1.0, 0.0], None), ("/c", None, None, None)]
    got = {r["path"]: r["score"] for r in retrieval.search(queries(spark, (1, "", None, [2.0, 0.0])), lib(spark, rows)).collect()}
    assert got == pytest.approx({"/a": 0.6, "/b": 0.4})
    assert retrieval.search(queries(spark, (1, "", None, [0.0, 0.0])), lib(spark, rows)).count() == 0


def test_negatives(spark):
    rows = [("/a", [1.0, 0.0], None, None), ("/b", [0.6, 0.8], None, None)]
    neg = queries(spark, (9, "", None, [1.0, 0.0]))
    q = queries(spark, (1, "", None, [1.0, 0.2]))
    plain = retrieval.search(q, lib(spark, rows), SearchParams(text_weight=0.0), neg)
    assert {r["path"]: r["neg_sim"] for r in plain.collect()} == {"/a": 0.0, "/b": 0.0}
    hit = retrieval.search(q, lib(spark, rows), SearchParams(text_weight=0.0, neg_alpha=0.9), neg).orderBy("rank").collect()
    assert [r["path"] for r in hit] == ["/b", "/a"]


@pytest.mark.parametrize("inside, expected", [(4, 10), (5, 5)])
def test_scope_needs_five_rows(spark, inside, expected):
    rows = [(f"/{i}", [1.0, i / 10], None, "AMBForst" if i < inside else "WATRSurf") for i in range(10)]
    q = queries(spark, (1, "", "AMB-FOREST", [1.0, 0.0]))
    assert retrieval.search(q, lib(spark, rows), SearchParams(top_k=50), scoped=True).count() == expected
    q = queries(spark, (1, "", "AMB-NAUTICAL", [1.0, 0.0]))
    assert retrieval.search(q, lib(spark, rows), SearchParams(top_k=50), scoped=True).count() == 10


def test_blocks_of_queries_equal_brute_force(spark):
    rows = [(f"/{i:02d}", [1.0, i % 7 / 10], [i % 3 / 10, 1.0] if i % 4 else None, None) for i in range(40)]
    q = [(k, "", None, [1.0, k / 5]) for k in range(7)]
    want = []
    for k, _, _, v in q:
        unit = np.array(v) / np.linalg.norm(v)
        scored = sorted((-round(0.6 * float(np.dot(a, unit)) + (0.4 * float(np.dot(t, unit)) if t else 0.0), 6), p) for p, a, t, _ in rows)
        want += [(k, r, p, -s) for r, (s, p) in enumerate(scored[:4], 1)]
    for block in (2, 100):
        got = retrieval.search(queries(spark, *q), lib(spark, rows).repartition(3), SearchParams(top_k=4, query_block=block)).collect()
        assert sorted((r["query_id"], r["rank"], r["path"], r["score"]) for r in got) == want
    assert retrieval.search(queries(spark, *q).limit(0), lib(spark, rows)).count() == 0


def test_nested_results_keep_order(spark):
    hits = spark.createDataFrame([(1, 2, "/b", 0.1), (1, 1, "/a", 0.2)], "query_id long, rank int, path string, score double")
    assert [h["path"] for h in retrieval.nested(hits).first()["results"]] == ["/a", "/b"]


def test_cascade_order(spark):
    anchors = spark.createDataFrame([(0, "X", [1.0, 0.0]), (1, "Y", [1.0, 0.0])], "ord int, catid string, emb array<double>")
    rows = [("/Car Park/a.wav", "", "META", [1.0, 0.0]), ("/b.wav", "", "META", [1.0, 0.0]), ("/c.wav", "", None, [1.0, 0.1]), ("/river.wav", "creek by the city", None, [0.0, 1.0]), ("/d.wav", "", None, None)]
    files = spark.createDataFrame(rows, "path string, embedded string, metadata_catid string, emb array<double>")
    got = {r["path"]: r["catid"] for r in classify.cascade(files, anchors).collect()}
    assert got == {"/Car Park/a.wav": "AMBUndr", "/b.wav": "META", "/c.wav": "X", "/river.wav": "WATRFlow", "/d.wav": "UNKNOWN"}


def test_select_model(spark):
    rows = [("/m", "/m/a-3B-q4_k.gguf", 10, False), ("/m", "/m/mmproj.gguf", 1, True), ("/n", "/n/b-9B.gguf", 10, False), ("/n", "/n/mmproj.gguf", 1, True), ("/o", "/o/c-70B.gguf", 9, False)]
    ranked = classify.rank_models(spark.createDataFrame(rows, "folder string, path string, size long, is_projector boolean"))
    pick = lambda c: classify.select_model(ranked, c).first()["base"]
    assert (pick(None), pick("2"), pick("A-3b"), ranked.count()) == ("/n/b-9B.gguf", "/m/a-3B-q4_k.gguf", "/m/a-3B-q4_k.gguf", 2)


def test_index_guard_and_counts(spark):
    index = spark.createDataFrame([("/a", "natural")], "path string, preset string")
    library.guard_preset(index, "natural")
    with pytest.raises(ValueError):
        library.guard_preset(index, "music")
    found = spark.createDataFrame([("/a", 20.0), ("/b", 5.0), ("/c", None), ("/d", 10.0)], "path string, duration double")
    assert tuple(library.counts(found, index).first()) == (4, 3, 2, 1)
    assert [r["path"] for r in library.long_enough(library.new_files(found, index)).collect()] == ["/d"]
    assert library.long_enough(found, 0).count() == 4


def test_rows_that_are_no_vectors_take_no_place(spark):
    """With NaN, zero and null rows, all k good rows are found; a text vector that is none counts as absent."""
    good = [(f"/good{i}", [1.0, i / 10], [1.0, 0.0]) for i in range(6)]
    bad = [("/nan", [float("nan"), 1.0], None), ("/inf", [1.0, float("inf")], None), ("/zero", [0.0, 0.0], None), ("/null", None, None), ("/hole", [None, 1.0], None), (None, [1.0, 0.0], None)]
    odd = [("/text", [1.0, 0.05], [float("nan"), 1.0])]
    lib = spark.createDataFrame(good + bad * 3 + odd, "path string, audio_emb array<double>, text_emb array<double>").withColumn("catid", F.lit("x"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], "query_id long, query_emb array<double>")
    hits = retrieval.search(q, lib, retrieval.SearchParams(top_k=7)).collect()
    assert {r["query_id"] for r in hits} == {1} and {r["path"] for r in hits} == {p for p, *_ in good + odd}
    assert [r["text_sim"] for r in hits if r["path"] == "/text"] == [0.0]


def test_one_scan_for_any_number_of_blocks(spark):
    """The plan reads the library once, and no query is collected or sent to all tasks."""
    from cuewright.plans import inputs
    from helpers import SF

    lib, q = inputs.library(spark, SF), inputs.queries(spark, SF)
    plans = [retrieval.search(q, lib, retrieval.SearchParams(query_block=n))._jdf.queryExecution().optimizedPlan().toString() for n in (512, 20)]
    assert plans[0].count("MapInArrow") == plans[1].count("MapInArrow") == 1
    assert plans[0].count("Relation") == plans[1].count("Relation")


def test_small_query_blocks_do_not_multiply_the_library(spark):
    """Each row is dealt to as few tasks as keep the cores busy, however few queries are multiplied at once."""
    q = queries(spark, *[(k, "", None, [1.0, k / 50]) for k in range(200)])
    rows = lib(spark, [(f"/{i:02d}", [1.0, i % 7 / 10], None, None) for i in range(40)])
    plan = retrieval.search(q, rows, SearchParams(query_block=1))._jdf.queryExecution().optimizedPlan()
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan.toString())]
    assert dealt and max(dealt) <= 2 * spark.sparkContext.defaultParallelism, plan.toString()
    from cuewright.operators import blocks

    for size in (100_000, 600_000, 4_000_000):  # what is dealt to a task is bounded, and all tasks are
        b, c = blocks.dealt_to(size, size, 12, retrieval.TASK_QUERIES, retrieval.TASK_ROWS, 3)
        assert size / b <= retrieval.TASK_QUERIES and size / c <= retrieval.TASK_ROWS and b * c >= 12 and b * size < 16 * size * max(1, size / 1_000_000)


def test_search_of_many_steps_equals_brute_force(spark, monkeypatch):
    """Copies, ties, scopes and far larger rows over several steps of rows, with floors that rise."""
    rng = np.random.default_rng(5)
    a, t = rng.normal(size=(900, 8)), rng.normal(size=(900, 8))
    a[100:200], t[100:200] = a[7], t[7]  # copies
    a[300:310] *= 1e6
    a[310:312] = 1e200
    names = ["AMBForst", "WATRSurf", "AMBUrbn"]
    rows = [(f"/{i * 7919 % 900:03d}", a[i].tolist(), t[i].tolist() if i % 3 else None, names[i % 3]) for i in range(900)]
    asked = rng.normal(size=(40, 8))
    unit = asked / np.sqrt((asked * asked).sum(axis=1))[:, None]
    t[np.arange(900) % 3 == 0] = 0
    monkeypatch.setattr(retrieval, "ROW_STEP", 64)
    import pyarrow as pa

    from cuewright import rules

    allowed = [None if k % 2 else [*rules.SCOPE["AMB-FOREST"]] for k in range(40)]
    for alpha, least in ((0.0, None), (0.3, 0.2)):
        s = retrieval._Search(SearchParams(top_k=6, query_block=16, neg_alpha=alpha, min_score=least))
        s.add_queries(pa.StructArray.from_arrays([pa.array(range(40)), pa.array(unit.tolist()), pa.array(allowed, pa.list_(pa.string()))], ["query_id", "v", "allowed"]))
        neg = rng.normal(size=900)
        order = sorted(range(900), key=lambda i: rows[i][0])
        columns = [[rows[i][0] for i in order], [rows[i][3] for i in order], [rows[i][1] for i in order], [rows[i][2] for i in order], [neg[i] for i in order]]
        s.add_rows(pa.StructArray.from_arrays([pa.array(x) for x in columns], ["path", "catid", "audio_emb", "text_emb", "neg_sim"]))
        found = s.result().to_pylist()
        score = np.round(unit @ a.T * 0.6 + unit @ t.T * 0.4 - alpha * neg, 6)
        for k in range(40):
            fit = [(-score[k, i], rows[i][0]) for i in range(900) if (allowed[k] is None or rows[i][3] in allowed[k]) and (least is None or score[k, i] >= least)]
            got = sorted((-r["score"], r["path"]) for r in found if r["query_id"] == k)
            want = sorted(fit)[:6]
            assert [p for _, p in got] == [p for _, p in want] and np.allclose([x for x, _ in got], [x for x, _ in want])


BOUNDED = ["hybrid_topk", "vector_topk", "scoped_topk_escape", "min_score_topk", "scoped_topk", "unusable_vectors_topk"]


@pytest.mark.parametrize("name", BOUNDED)
def test_hits_are_ranked_by_as_many_tasks_as_they_need(spark, name, monkeypatch):
    """A search's task sorts no hits: they are dealt out by query first, to more tasks if there are more hits."""
    import __spark_entry__
    from helpers import SF

    dealt = []
    for merged in (retrieval.MERGED, 100):
        monkeypatch.setattr(retrieval, "MERGED", merged)
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        before, _, after = plan.partition("MapInArrow")
        assert after and "WindowGroupLimit" in before and "Exchange" in before
        assert not re.search("Window|Sort", before[before.rindex("Exchange") :]), plan
        dealt.append(int(re.findall(r"Exchange hashpartitioning\(query_id#\d+L, (\d+)\)", before)[-1]))
    assert dealt[0] == spark.sparkContext.defaultParallelism and dealt[1] >= 500 * 3 / 100, dealt


def test_vectors_are_tested_and_scaled_once_a_row(spark):
    """Neither the test for numbers nor the norm is part of what is computed for each element."""
    from cuewright.functions import vector as vx

    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), ([1.0, float("inf")],), ([float("nan"), 1.0],), ([],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>").select(vx.normalised(vx.usable(F.col("v"))).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8]] + [None] * 6
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("isnan") == plan.lower().count("aggregate(") == 1, plan


def test_hits_of_a_task_come_in_bounded_batches():
    import pyarrow as pa

    from cuewright.operators import blocks

    class Found:
        def result(self):
            return pa.RecordBatch.from_pydict({"x": list(range(blocks.OUT_STEP * 2 + 5))})

    got = list(blocks.in_steps(Found()))
    assert [b.num_rows for b in got] == [blocks.OUT_STEP] * 2 + [5] and pa.Table.from_batches(got).column("x").to_pylist() == list(range(blocks.OUT_STEP * 2 + 5))
    assert list(blocks.in_steps(None)) == []

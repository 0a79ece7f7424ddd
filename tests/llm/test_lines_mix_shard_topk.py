"""Line dedup, mixing, sharding and top-k: SQL on the test tables, odd rows, brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF, same_rows
from cuewright.llm import line_dedup, mixing, registry, sharding, topk

LINE = "This is one common line of more than forty characters."


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df())


def kept(df):
    out = line_dedup.drop_common_lines(df)
    assert out.columns == ["row", "lines", "kept"] and out.select("row.*").columns == df.columns
    return {r["doc_id"]: (r["n"], r["t"]) for r in out.select("row.doc_id", F.size("lines").alias("n"), F.array_join("kept", "\n").alias("t")).collect()}


def test_lines(docs):
    rows = [(k, f" \t{LINE.upper() if k % 2 else LINE} \r\nown {k}\n{LINE}") for k in range(5)]
    got = kept(docs(*rows, (9, None), (10, "")))
    assert got[0] == (3, "own 0") and got[3] == (3, "own 3")
    assert got[4] == (3, rows[4][1])  # the largest doc_id keeps all its lines
    assert got[9] == (1, "") and got[10] == (1, "")


def test_lines_below_the_threshold_stay(docs):
    rows = [(k, f"{LINE}\nshort line") for k in range(4)] + [(3, LINE)]
    assert kept(docs(*rows))[0] == (2, f"{LINE}\nshort line")
    assert kept(docs().limit(0)) == {}
    thin = [(k, "é" * 39 + "\nx") for k in range(6)]
    assert kept(docs(*thin))[0][1] == "é" * 39 + "\nx"


def test_lines_null_ids_count_as_one_document(docs):
    rows = [(None, LINE), (None, LINE), (1, LINE), (2, LINE), (3, LINE)]
    assert kept(docs(*rows))[1][1] == LINE
    got = kept(docs(*rows, (4, LINE)))
    assert [got[k][1] for k in (None, 1, 2, 3, 4)] == ["", "", "", "", LINE]


def test_lines_of_repeated_rows_and_long_texts(docs):
    """Unlike texts of one doc_id lose their own lines; a very long text is put together in order."""
    long = "\n".join(f"line {i}" if i % 50 else LINE for i in range(60_000))
    out = line_dedup.drop_common_lines(docs((1, f"{LINE}\na"), (1, f"b\n{LINE}\nc"), (2, LINE), (3, LINE), (4, long), (5, LINE), (5, LINE))).select("row.doc_id", "kept")
    got = sorted((r["doc_id"], "\n".join(r["kept"])) for r in out.collect())
    assert got[:2] == [(1, "a"), (1, "b\nc")] and got[5:] == [(5, LINE), (5, LINE)]
    assert got[4] == (4, "\n".join(f"line {i}" for i in range(60_000) if i % 50))


def test_line_keys(spark):
    rows = [(" \t\x0b\x0c\rAbc É\u00a0 ",), ("ABC xyz",), ("",), ("İI",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(line_dedup.line_key(F.col("x"))).collect()]
    assert got == ["abc É\u00a0", "abc xyz", "", "İi"]


def test_lines_by_a_spread_join(spark, docs, monkeypatch):
    """A table of common lines too large to be sent gives the same rows."""
    from cuewright.llm import common

    rows = [(k, f"{LINE}\nown {k}\n{LINE}s") for k in range(40)] + [(None, LINE)]
    want = kept(docs(*rows))
    monkeypatch.setattr(common, "is_small", lambda df, rows=0: False)
    assert kept(docs(*rows)) == want


def water_fill(sizes, weights, cap):
    """Targets by resharing the excess again and again."""
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= cap * sizes[s]}
        if not over:
            target |= {s: level * weights[s] for s in free}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(docs, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 3, 40]), rng.choice(["a", "b", "c", "d", None, "é"][: 2 + seed])) for i in range(60)]
    df = docs(*rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = water_fill(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    assert got == pytest.approx(want)


def test_mix_follows_the_ranking(spark, docs):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, rng.randint(1, 60), rng.randint(1, 2000) if i % 40 == 0 else 5]), f"s{i % 3}") for i in range(600)]
    df = docs(*rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = {r["source"]: r for r in mixing.plan(df).collect()}
    ranked = mixing._ranked(df, mixing.plan(df), 10).collect()
    want = {}
    for source, p in plan.items():
        order = sorted((r["q"], r["doc_id"], r["size"]) for r in ranked if r["source"] == source and r["size"] > 0)
        gap, begin, chosen = p["wanted"], 0, set()
        for _ in range(mixing.ROUNDS if p["p"] > 0 else 0):
            most = gap
            for at in range(begin, len(order)):
                if order[at][2] > most:
                    continue
                if order[at][2] > gap:
                    break
                gap -= order[at][2]
                chosen.add(order[at][1])
            else:
                break
            begin = at + 1
        left = [(abs(gap - size), q, i) for q, i, size in order if i not in chosen and abs(gap - size) < gap] if p["p"] > 0 else []
        chosen |= {min(left)[2]} if left else set()
        want |= {r["doc_id"]: p["copies"] + (r["doc_id"] in chosen) for r in ranked if r["source"] == source}
    got = mixing.mix(df).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == want
    for in_order in (4096, 10):
        steps = mixing.thresholds(df, mixing.plan(df), in_order=in_order).collect()
        assert sorted(map(str, steps)) == sorted(map(str, mixing.thresholds(df, mixing.plan(df)).collect()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect()))
    for source, p in plan.items():
        taken = sum(r["copies"] * r["size"] for r in got if r["source"] == source)
        assert abs(taken - p["target"]) <= 10
    assert max(r["copies"] for r in got) <= 3


def test_mix_fills_a_small_source_with_one_long_document(docs):
    rng = random.Random(8)
    texts = [(i, "w " * rng.randint(50, 800), "a") for i in range(60)] + [(60, "w " * 12_000, "a")] + [(100 + i, "w " * 400, "b") for i in range(60)]
    df = docs(*texts).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    for seed in range(3):
        got = mixing.mix(df, seed=seed).collect()
        for source in "ab":
            taken, target = sum(r["copies"] * r["size"] for r in got if r["source"] == source), next(r["target"] for r in got if r["source"] == source)
            assert abs(taken - target) < 0.02 * target


def test_mix_keeps_other_columns(docs):
    df = docs((1, "a b", "x"), (2, "c", "y"))
    out = mixing.mix(df.drop("size").withColumn("size", mixing.word_count(F.col("text"))))
    added = {"source_size", "target", "copies"}
    assert set(df.columns) | added == set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert all(r["wanted"] == r["doc_id"] - 1 and r["p"] == r["doc_id"] - 1 for r in out.collect())


def test_mix_odd_rows(docs):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", None), (2, None, None), (3, "", "empty"), (4, "d " * 5000, "x"), (5, " \t\n\x0b ", "y")]
    df = docs(*rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(df).collect()
    assert len(got) == 7 and all(0 <= r["copies"] <= 3 for r in got)
    assert {r["source"]: r["target"] for r in got}["empty"] == 0
    assert len({r["copies"] for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_inclusion_is_as_planned(docs):
    """Over many seeds a document is taken about as often as its probability says."""
    rows = [(i, "w w", "a") for i in range(20)] + [(100 + i, "w w", "b") for i in range(20)]
    df = docs(*rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")).cache()
    p = {r["source"]: r["p"] for r in mixing.plan(df).collect()}
    n = 12
    copies = [r["copies"] for seed in range(n) for r in mixing.mix(df, seed=seed).collect() if r["source"] == "a"]
    assert sum(copies) / len(copies) == pytest.approx(p["a"], abs=0.06)


def test_lookup_table():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names)
    counts = np.bincount(table, minlength=20)
    assert counts.max() - counts.min() <= 1 and len(table) == 2003
    fewer = sharding.lookup_table(names[:-1], len(table))
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.05 * len(table)
    heavy = np.bincount(sharding.lookup_table(["a", "b"], 101, [3, 1]))
    assert abs(heavy[0] - 3 * heavy[1]) <= 4
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_lookup_table_brute():
    """Turn by turn, each shard walks its own permutation to the first free slot."""
    import hashlib

    names, slots = ["x", "y", "z"], 13
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    walks = [[(number(f"offset {n}") % slots + i * (1 + number(f"skip {n}") % (slots - 1))) % slots for i in range(slots)] for n in names]
    assert all(sorted(w) == list(range(slots)) for w in walks)
    table = {}
    while len(table) < slots:
        for k, walk in enumerate(walks):
            if len(table) < slots:
                table[next(x for x in walk if x not in table)] = k
    assert sharding.lookup_table(names, slots) == [table[x] for x in range(slots)]


def test_placement(spark, docs, tmp_path):
    df = docs((1, "a"), (1, "b"), (None, "a"), (None, "b"), (None, None), (2, "x" * 100_000))
    got = sharding.place(df, sharding.NAMES).collect()
    assert len(got) == 6 and all(0 <= r["shard"] < 64 for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.place(df.limit(0), sharding.NAMES).count() == 0
    sharding.write_sharded(df.select("doc_id", "text"), str(tmp_path / "s"), sharding.NAMES)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
    assert max(len(list(x.glob("*.parquet"))) for x in (tmp_path / "s").glob("shard=*")) == 1


def test_sharding_is_native(spark):
    plan = sharding.op7_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


VEC = "vec_id long, embedding array<float>, label int"


def brute_topk(rows, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in sorted(whole):
        if q % 50 == 0:
            a = min(whole[q])
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, vs in whole.items() if i != q for b in vs)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)]
    return out


def test_topk_brute(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, -0.5, 0.25, rng.random()]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (301, [float("nan")] * 6), (302, [float("inf")] * 6), (None, [1.0] * 6), (400, []), (51, rows[51][1]), (50, rows[3][1]), (450, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC).repartition(3)
    whole = topk.quantised(df)
    for block in (2048, 2):
        got = topk.top_k(whole.filter("vec_id % 50 = 0"), whole, block=block).collect()
        assert sorted(map(tuple, got)) == brute_topk([(i, None if v is None else [None if x is None else np.float32(x).item() for x in v]) for i, v in rows])


def test_topk_few_and_none(spark):
    df = topk.quantised(spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 0), (2, [1.0], 0)], VEC))
    assert sorted(map(tuple, topk.top_k(df.filter("vec_id = 0"), df).collect())) == [(0, 1, 1, 65536), (0, 2, 2, 65536)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_long_vectors_and_large_weights(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() * 2**44 for _ in range(3000)]) for i in range(0, 12)]
    df = topk.quantised(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, topk.top_k(df.filter("vec_id = 0"), df).select("query_id", "rank", "vec_id").collect())) == [x[:3] for x in sorted_hits(rows)]


def sorted_hits(rows, k=5):
    dot = {i: sum(int(x * 256 // 1) * int(y * 256 // 1) for x, y in zip(rows[0][1], v)) for i, v in rows[1:]}
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63  # noqa: E731  scores are 64-bit numbers
    return [(0, r, i, s) for r, (s, i) in enumerate(sorted(((-wrap(s), i) for i, s in dot.items()))[:k], 1)]


def test_postings_scatter():
    rng = np.random.default_rng(0)
    rows, queries = rng.integers(-3, 3, (40, 7)), rng.integers(-2, 2, (9, 7))
    assert (topk.Postings(rows).scores(queries) == queries @ rows.T).all()
    big = rows * 2**40
    assert (topk.Postings(big).scores(queries) == queries @ big.T).all()


def test_work_needs_a_shared_folder():
    """A cluster without ``spark.checkpoint.dir`` is an error, not a folder of each machine."""
    from types import SimpleNamespace

    from cuewright import workspace
    from cuewright.llm import common

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: other), sparkContext=SimpleNamespace(master=master, applicationId="app"))
        for folder in (common.work_dir, workspace.folder):
            with pytest.raises(ValueError):
                folder(bare, "x")


def test_spread(spark):
    from cuewright.llm import common

    one = spark.range(100).coalesce(1)
    assert common.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 9)
    assert common.spread(many) is many

import re

from loomwright.llm import mixing


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, s, 9) for d, t, s in rows], "doc_id long, text string, source string, target int").repartition(3)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = capped | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s: 3 * sizes[s] for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def check(spark, rows):
    out = mixing.mix(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = brute_targets(sizes)
    source = {d: s for d, _, s in rows}
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - goal[s]) <= 0.5 + 1e-6
    return sorted(map(tuple, out), key=repr)


def test_targets_and_repetitions(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 7 if i % 3 else 0}") for i in range(300)]
    rows += [(1000 + i, "x y z", None) for i in range(5)] + [(2000, "alone " * 3, "tiny")]
    assert check(spark, rows) == check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, "\t\n", "b"), (5, "long " * 100_000, "c"), (6, "é\u00a0x y", "b")])
    check(spark, [(1, None, "a"), (2, "  ", None)])
    assert mixing.mix(docs_of(spark, [])).count() == 0
    twice = mixing.mix(docs_of(spark, [(7, "a b", "s"), (7, "a b", "s"), (None, "c", "s")])).collect()
    assert len(twice) == 3 and sum(r["taken"] for r in twice) == 5


def test_only_dataframe_operations(spark):
    plan = mixing.op4_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

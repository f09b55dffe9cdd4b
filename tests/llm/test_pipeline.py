"""Each stage on its own input against what it promises, and the whole run."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:-1])


def test_toxicity(spark, stages):
    from loomwright.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = dict(zip(stages[0]["doc_id"], model.scorer()(list(stages[0]["text"])), strict=True))
    assert set(stages[1]["doc_id"]) == {d for d, s in scores.items() if s < toxicity.THRESHOLD}


def test_lines(stages):
    from test_line_dedup import brute

    texts = dict(zip(stages[1]["doc_id"], stages[1]["text"], strict=True))
    want = {d: t for d, t in brute(list(texts.items())).items() if t == texts[d] or t.strip()}
    assert dict(zip(stages[2]["doc_id"], stages[2]["text"], strict=True)) == want
    assert (stages[2]["n_chars"] == stages[2]["text"].str.len()).all()


def test_near_copies(stages):
    from test_minhash import brute

    label = brute(list(zip(stages[2]["doc_id"], stages[2]["text"], strict=True)))
    assert set(stages[3]["doc_id"]) == {d for d, c in label.items() if c == d}


def targets(size):
    """Weights 1, 2, 3 over the sources by name; a source stops at 3 times its size and the others share the rest."""
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size))}
    goal, left = {}, sum(size.values())
    while open_ := [s for s in size if s not in goal]:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        goal |= {s: 3 * size[s] for s in over} if over else share
        left -= sum(goal[s] for s in over)
    return goal


def test_mixing_and_packing(stages):
    words = lambda t: t["text"].str.count(r"[^ \t-\r]+")
    size = words(stages[3]).groupby(stages[3]["source"]).sum()
    mixed = words(stages[4]).groupby(stages[4]["source"]).sum()
    longest = words(stages[3]).max()
    for s, goal in targets(size.to_dict()).items():
        assert abs(mixed.get(s, 0) - goal) <= longest / 2 + 1
    assert stages[4]["doc_id"].value_counts().max() <= 3
    last = stages[5]
    assert set(last["doc_id"]) == set(stages[4]["doc_id"])
    assert last.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run(spark, stages):
    out = pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, out[["doc_id", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(map(tuple, stages[5][["doc_id", "start", "length", "ids_crc32"]].to_numpy().tolist()))


ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "same line here\nb", "en", "a", 16), (3, "same line here\nc", None, None, 16), (4, "x y z", "de", "b", 5), (4, "x y z", "de", "b", 5),
    (None, "no id " * 3, "en", "a", 18), (5, "long words go on " * 20_000, "en", "a", 340_000), (6, None, None, None, None), (7, "X y Z", "de", "b", 5),
]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_tables(spark, name):
    """Nulls, empty and long texts, ties, repeated rows, clashing names; and no rows at all."""
    stage = dict(pipeline.STAGES)[name]
    extra = ["of", "times", "copy", "_of", "_places", "_0", "n_lines", "n_removed", "key", "kept", "class_id", "y", "score", "length"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in ODD], schema).repartition(3)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in ODD}
    else:
        assert out.columns == docs.columns and all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in rows)
        got = sorted((str(r["doc_id"]), r["text"] or "", r["n_chars"] or 0) for r in rows)
        every = sorted((str(d), t or "", n or 0) for d, t, _, _, n in ODD)
        if name == "toxicity":
            assert got == every
        elif name == "line_dedup":
            assert [(d, n) for d, _, n in got] == [("1", 0), ("2", 0), ("3", 1), ("3", 16), ("4", 5), ("4", 5), ("5", 340_000), ("6", 0), ("None", 18)]
        elif name == "near_dedup":
            assert got == [r for k, r in enumerate(every) if r[0] != "7" and every.index(r) == k]
        else:
            assert {d for d, _, _ in got} <= {"3", "4", "5", "7", "None"} and "5" in {d for d, _, _ in got}
    assert stage(spark, docs.limit(0), SF).count() == 0

import random

from loomwright.llm import line_dedup as ld


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_lines string").repartition(3)


def close(a, b):
    """Within one word changed, added or left out."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def brute(rows):
    fold = lambda line: " ".join(line.lower().replace("\t", " ").replace("\r", " ").split())
    order = sorted((d, k, fold(line)) for d, t in rows if d is not None and t is not None for k, line in enumerate(t.split("\n")))
    first = {}
    for d, k, line in order:
        if line and line not in first:
            first[line] = (d, k)
    words = {line: line.split(" ") for line in first}
    near = {a for a in first for b in first if first[b] < first[a] and min(len(words[a]), len(words[b])) >= ld.MIN_WORDS and close(words[a], words[b])}
    out = {}
    for d, t in rows:
        if t is None or d is None:
            out[d] = t
            continue
        keep = [line for k, line in enumerate(t.split("\n")) if not fold(line) or (fold(line) not in near and first[fold(line)] == (d, k))]
        out[d] = "\n".join(keep)
    return out


def found(spark, rows):
    return {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs_of(spark, rows)).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(6)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([2, 4, 5, 6, 8, 9, 12, 20, 33]))] for _ in range(60)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                what = rng.random()
                if what < 0.4:
                    w[at] = rng.choice("xyz")
                elif what < 0.7:
                    w.insert(at, rng.choice("xyz"))
                elif len(w) > 1:
                    del w[at]
            lines.append((" " if rng.random() < 0.8 else "  ").join(w if rng.random() < 0.9 else [x.upper() for x in w]))
        rows.append((d, "\n".join(lines)))
    assert found(spark, rows) == brute(rows)


def test_repeats_of_words(spark):
    rows = [(1, "a a a a a a a a a"), (2, "a a a a a a a a"), (3, "a a a a a a"), (8, "a a a a"), (4, "a a a a a a a a a a a"), (5, "b " * 3000 + "c"), (6, "b " * 3000 + "d"), (7, "b " * 2999 + "d")]
    assert found(spark, rows) == brute(rows)


def test_shuffle_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0)
    rows = [(1, "one two three four five six seven eight"), (2, "one two three four five six seven nine\nlast")]
    assert found(spark, rows) == {1: rows[0][1], 2: "last"}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x\n\nx\n y"), (None, "x\nx"), (5, "z\n" * 20_000)]
    got = found(spark, rows)
    assert got == {1: None, 2: "", 3: "\n\n", 4: "x\n\n y", None: "x\nx", 5: "z\n"}
    out = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in ld.dedup_lines(docs_of(spark, rows)).collect()}
    assert out == {1: (0, 0), 2: (1, 0), 3: (3, 0), 4: (4, 1), None: (2, 0), 5: (20_001, 19_999)}
    assert found(spark, []) == {}
    assert ld.dedup_lines(docs_of(spark, [(1, "a\na"), (1, "a\na")])).select("text").distinct().collect() == [("a",)]


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    rows = [(1, "x"), (3, "A\nx"), (3, "x\nkept only here"), (3, "x\nkept only here")]
    got = sorted(r["text"] for r in ld.dedup_lines(docs_of(spark, rows)).collect())
    assert got == ["A", "kept only here", "kept only here", "x"]


def test_clashing_names(spark):
    names = ["_0", "key", "places", "_of", "text_key", "line", "first", "n_removed"]
    docs = spark.createDataFrame([(*range(8), 1, "a\na"), (*range(8), 2, "b")], ", ".join(f"{n} long" for n in names) + ", doc_id long, text string")
    out = ld.dedup_lines(docs).orderBy("doc_id").collect()
    assert [(r["text"], r["n_removed"], r["places"], r["_0"], r["line"]) for r in out] == [("a", 1, 2, 0, 5), ("b", 0, 2, 0, 5)]


def test_hot_variant_can_be_split(spark):
    """A template line with one changing word: every line shares a variant, and the joins on it are split."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000, numPartitions=4).selectExpr("id AS doc_id", "concat('one two three four five ', id, ' seven eight nine ten') AS text")
        assert ld.dedup_lines(rows).where("text <> ''").count() == 1
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_only_dataframe_operations(spark):
    plan = ld.op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

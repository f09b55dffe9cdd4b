import math
import random
import zlib

import numpy as np
import pytest

from loomwright.llm import toxicity as tox


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for d in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = d % 6 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                body.insert(rng.randrange(len(body)), rng.choice(["vileness", "nastyish", "nastily", "horrid"]))
        docs.append((d, " ".join(body)))
        labels.append((d, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark, labelled):
    docs, labels, truth = labelled
    model = tox.fit(docs, labels)
    rows = tox.score(docs, model).withColumn("held", tox.held_out()).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    for group in (True, False):
        hits = [(r["score"] >= tox.THRESHOLD, truth[r["doc_id"]]) for r in rows if r["held"] == group]
        assert sum(p == bool(t) for p, t in hits) / len(hits) > 0.97
        assert not any(p and not t for p, t in hits)
    kept = {r["doc_id"] for r in tox.keep_clean(docs, model).collect()}
    assert kept == {r["doc_id"] for r in rows if r["score"] < tox.THRESHOLD}
    assert len(model.index) < 400


def test_held_out_labels_are_not_used(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["x"]).expr("CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END"))
    a, b = tox.fit(docs, labels), tox.fit(docs, flipped)
    assert np.array_equal(a.index, b.index) and np.allclose(a.weight, b.weight)


def test_training_sample_is_bounded(spark, labelled):
    docs, labels, _ = labelled
    rows = tox.training_rows(docs, labels, train_rows=100).collect()
    assert 50 < len(rows) < 160 and not any(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_model_is_that_of_one_pass_after_another(spark, labelled):
    """FTRL-proximal computed anew, a coordinate at a time, from the same sample in the same order."""
    docs, labels, _ = labelled
    model = tox.fit(docs, labels, train_rows=150)
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in tox.training_rows(docs, labels, 150).collect())
    z, n = {}, {}
    bias = 1 << tox.BITS

    def weight(i):
        zi, cut = z.get(i, 0.0), 0.0 if i == bias else 6.0
        return 0.0 if abs(zi) <= cut else (math.copysign(cut, zi) - zi) / (1.0 + math.sqrt(n.get(i, 0.0)))

    sets = [sorted(set(tox._features([t], tox.WordHash())[1].tolist())) for _, _, t in rows]
    order = np.random.default_rng(7)
    for _ in range(5):
        for k in order.permutation(len(rows)):
            w = {i: weight(i) for i in (*sets[k], bias)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][1]
            for i in w:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) * w[i]
                n[i] = was + g * g
    want = {i: weight(i) for i in z if i != bias and weight(i) != 0}
    assert len(want) > 3 and set(model.index.tolist()) == set(want) and abs(model.bias - weight(bias)) < 1e-9
    assert all(abs(w - want[i]) < 1e-9 for i, w in zip(model.index.tolist(), model.weight.tolist(), strict=True))


def test_odd_rows(spark, labelled):
    docs, labels, _ = labelled
    model = tox.fit(docs, labels)
    rows = [(1, None), (2, ""), (None, "horrid horrid"), (3, "word1 " * 50_000), (3, "word1"), (3, "word1")]
    odd = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    out = tox.score(odd, model).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    assert tox.keep_clean(odd, model).columns == odd.columns
    assert tox.score(odd.limit(0), model).count() == 0
    empty = tox.fit(docs.limit(0), labels)
    assert {r["score"] for r in tox.score(odd, empty).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert isinstance(tox.fit(docs, nulls), tox.Model)

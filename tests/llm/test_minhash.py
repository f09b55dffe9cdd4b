import itertools
import random
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import minhash
from loomwright.llm._text import mix

SCHEMA = "doc_id long, text string, class_id string, kept int"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, threshold=0.8):
    """Least doc_id of each connected group of texts by exact weighted Jaccard similarity."""
    label = {d: d for d, t in rows if d is not None}
    bags = {d: (t.lower().split(), bag(t)) for d, t in rows if d is not None and t is not None}
    links = []
    for a, b in itertools.combinations(bags, 2):
        x, y = bags[a][1], bags[b][1]
        both = sum((x & y).values())
        if bags[a][0] == bags[b][0] or both and both >= threshold * (sum(x.values()) + sum(y.values()) - both):
            links.append((a, b))
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def found(spark, rows, **options):
    return {r["doc_id"]: r["class_id"] for r in minhash.near_dups(docs_of(spark, rows), **options).collect()}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for seed in range(4):
        a = rng.integers(0, 9, 250)
        b = np.where(rng.random(250) < 0.6, a, rng.integers(0, 9, 250))
        names = mix(np.arange(250, dtype=np.uint64) + np.uint64(1000 * seed))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = minhash.bag_minhash(doc, np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=4 * np.sqrt(true * (1 - true) / 4096))


def test_groups_match_brute_force(spark):
    """Chains of copies: many texts near one base but further from each other, and unrelated ones."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(35):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    for _ in range(30):
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))))
        k += 1
    rows.append((k, rows[0][1].upper()))
    assert found(spark, rows) == brute(rows)


def test_large_component_in_small_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 2, 4, 6])):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(minhash, "BLOCK", (4, 8))
    monkeypatch.setattr(minhash._meet, "__defaults__", ((4, 8), (3000, 4000)))
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(5, None), (6, None), (7, ""), (8, "  \n"), (9, "one"), (10, "One"), (11, "one two"), (12, long), (13, long + " more"), (14, "a a a a a a"), (15, "a a a a a")]
    assert found(spark, rows) == {5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9, 11: 11, 12: 12, 13: 12, 14: 14, 15: 15}
    out = minhash.near_dups(docs_of(spark, [(None, "x"), (3, "y"), (3, "y")])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"], r["kept"]) for r in out) == [(-1, None, True), (3, 3, True), (3, 3, True)]
    assert minhash.near_dups(docs_of(spark, [])).count() == 0


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (5, long), (5, "a unique text of its own that nothing else comes near"), (7, long + " more"), (7, long + " other"), (9, "x"), (9, "x")]
    out = minhash.near_dups(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["kept"]) for r in out) == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 1, False), (7, 1, False), (9, 9, True), (9, 9, True)]
    kept = minhash.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "class_id", "kept"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, long), (5, rows[2][1]), (9, "x")]
    twins = [(3, long + " a"), (3, long + " b"), (None, "x"), (None, "x"), (4, None), (4, None)]
    assert sorted(str(r["doc_id"]) for r in minhash.keep_one(docs_of(spark, twins)).collect()) == ["3", "4", "4", "None", "None"]


def test_clashing_names(spark):
    names = ["key", "_0", "text_key", "n", "rep", "id"]
    docs = spark.createDataFrame([(*range(6), 1, "a b c"), (*range(6), 2, "A b c")], ", ".join(f"{n} long" for n in names) + ", doc_id long, text string")
    assert [tuple(r) for r in minhash.keep_one(docs).collect()] == [(0, 1, 2, 3, 4, 5, 1, "a b c")]


def test_shingles_are_told_apart_by_64_bits(spark):
    bags = [r["bag"] for r in minhash.bags(spark.createDataFrame([(1, "a b c d e f"), (2, "a a a a a a")], "id long, text string")).collect()]
    assert [len(b) for b in bags] == [16, 16] and len({b[k : k + 8] for b in bags for k in (0, 8)}) == 4

import zlib

import numpy as np
from pyspark.sql import functions as F

from loomwright.llm import packing
from loomwright.llm.tokens import WordBpe, tokenizer_path


def test_differencing_splits_evenly():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 400)
    for windows in (1, 2, 7, 50):
        at = packing.differencing(sizes, windows)
        sums = np.bincount(at, sizes, windows)
        assert sums.max() - sums.min() <= (8 if windows <= 7 else 60)
    # The textbook case: largest differencing of 4 5 6 7 8 leaves a difference of 2.
    assert sorted(np.bincount(packing.differencing(np.array([4, 5, 6, 7, 8]), 2), [4, 5, 6, 7, 8], 2)) == [14, 16]


def test_windows_rise_until_all_fit():
    sizes = np.array([1100] * 10)
    at, windows = packing.pack_group(sizes, 2048)
    assert windows == 10 and sorted(at) == list(range(10))
    assert packing.pack_group(np.array([], np.int64), 2048)[1] == 1


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, length int").repartition(3)
    out = packing.pack(docs).toPandas()
    bpe = WordBpe(tokenizer_path(packing.VOCABULARY))
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(np.frombuffer(bpe.encode(t), "<u4").tolist() + [packing.END_ID])
    assert out["length"].sum() == sum(len(x) for v in want.values() for x in v)
    for d, own in out.groupby("doc_id"):
        ids = want[d][0]
        assert (own["doc_tokens"] == len(ids)).all() and own["length"].sum() == len(ids) * len(want[d])
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        if len(want[d]) == 1:
            own = own.sort_values("start")
            assert (own["start"] == own["length"].cumsum() - own["length"]).all()
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= packing.CAPACITY
    return out


def test_pieces_cover_all_ids(spark):
    out = check(spark, [(i, "some word here and there " * (i * 13 % 700)) for i in range(200)])
    assert out["length"].sum() / (out["sequence_id"].nunique() * packing.CAPACITY) > 0.97


def test_dealing_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 150, "some words " * (i % 150 * 17 % 400)) for i in range(300)] + [(None, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(str, packing.pack(docs.orderBy(*order).coalesce(n), group_docs=50).collect())) for order, n in ((["doc_id"], 1), ([F.desc("text"), "doc_id"], 3)))
    assert a == b


def test_many_equal_rows_are_packed_in_runs(spark):
    docs = spark.range(5000).selectExpr("cast(1 as bigint) AS doc_id", "'one two three' AS text")
    out = packing.pack(docs, group_docs=16).toPandas()
    assert len(out) == 5000 and out.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all()


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "x"), (3, "x"), (4, "long text " * 20_000), (5, "<|endoftext|> Σ 日本")])
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()["doc_id"] is None

"""Graph queries over whole tables against brute force, apart from their SQL twins."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from test_graph import brute_pagerank

from loomwright.plans.registry import PAGERANK_ITERATIONS, QUERIES

SF = "/root/testdata/sf0.001"


def brute_components(pairs):
    root = {v: v for e in pairs for v in e}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def lines_of(sf_dir):
    t = pq.read_table(f"{sf_dir}/lineitem.parquet", columns=["l_suppkey", "l_partkey"])
    return [(s, p + 1_000_000) for s, p in zip(t["l_suppkey"].to_pylist(), t["l_partkey"].to_pylist(), strict=True)]


def made_lines(folder):
    """A hot supplier, a long chain, and small components."""
    pairs = [(1, p) for p in range(1, 4001)] + [(s, p) for s in range(2, 302) for p in (5000 + s, 5001 + s)] + [(s, 9000 + s) for s in range(400, 500)]
    columns = {"l_suppkey": [s for s, _ in pairs], "l_partkey": [p for _, p in pairs]}
    pq.write_table(pa.table(columns), folder / "lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("made", [False, True])
def test_components_of_all_lines(spark, tmp_path, made):
    sf_dir = made_lines(tmp_path) if made else SF
    want = brute_components(lines_of(sf_dir))
    got = QUERIES["connected_components_all"](spark, sf_dir).collect()
    assert len(got) == len(want) and {r["id"]: r["component"] for r in got} == want


def trade_of(sf_dir):
    orders = pq.read_table(f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_custkey"])
    customer = dict(zip(orders["o_orderkey"].to_pylist(), orders["o_custkey"].to_pylist(), strict=True))
    t = pq.read_table(f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_suppkey"])
    pairs = {(customer[o], 1_000_000_000 + s) for o, s in zip(t["l_orderkey"].to_pylist(), t["l_suppkey"].to_pylist(), strict=True) if o in customer}
    return sorted(pairs | {(b, a) for a, b in pairs})


@pytest.mark.parametrize("name", ["adjacency_edges_all", "edge_list_all"])
def test_edges_of_all_lines(spark, name):
    assert sorted((r["src"], r["dst"]) for r in QUERIES[name](spark, SF).collect()) == trade_of(SF)


@pytest.mark.parametrize("name", ["pagerank_10_all", "pagerank_reset_all"])
def test_ranks_of_all_lines(spark, name):
    got = {r["id"]: r["rank"] for r in QUERIES[name](spark, SF).collect()}
    assert got == pytest.approx(brute_pagerank(trade_of(SF), PAGERANK_ITERATIONS, name == "pagerank_reset_all"), abs=2e-6)


def test_ranks_read_lines_once_and_move_no_links(spark):
    """All ten iterations together shuffle fewer records than there are lines, orders and links once."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    no = store.stageList(None, False, False, none, None)
    seen = {no.apply(k).stageId() for k in range(no.size())}
    links = trade_of(SF)
    assert QUERIES["pagerank_reset_all"](spark, SF).count() == len({v for e in links for v in e})
    now = store.stageList(None, False, False, none, None)
    moved = sum(s.shuffleWriteRecords() for k in range(now.size()) if (s := now.apply(k)).stageId() not in seen)
    once = pq.read_metadata(f"{SF}/lineitem.parquet").num_rows + pq.read_metadata(f"{SF}/orders.parquet").num_rows + len(links)
    assert 0 < moved < once

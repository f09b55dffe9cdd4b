import itertools
import zlib

import numpy as np
import xxhash

from loomwright.llm import sharding


def test_hilbert_steps_are_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    index = sharding.hilbert_index([grid[:, i] for i in range(3)], bits=3)
    assert sorted(index) == list(range(512))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, s, l, 5) for d, t, s, l in rows], "doc_id long, text string, source string, lang string, size int").repartition(3)
    out = sharding.shard(docs).collect()
    assert len(out) == len(rows)
    want = sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == want
    by = {}
    for r in out:
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return out, {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_shards_are_even(spark):
    rows = [(i, f"{i}" + "é" * (i * 37 % 200), f"s{i % 5 if i % 3 else 0}", ("en", "de", None)[i % 3]) for i in range(3000)]
    _, sizes = run(spark, rows)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(sizes.values()) - mean <= 410 and mean - min(sizes.values()) <= 410


def test_one_hot_group(spark):
    _, sizes = run(spark, [(i, "same text", "s", "en") for i in range(2000)])
    assert max(sizes.values()) - min(sizes.values()) <= 17


def brute(rows, shards=sharding.SHARDS):
    """(shard, slot) of each (doc_id, text, source, lang), by hand: groups in order, cut by their middle bytes."""
    key = {d: (xxhash.xxh64(t.encode(), seed=42).intdigest(), zlib.crc32(t.encode()), len(t.encode()) + 8) for d, t, _, _ in rows}
    key = {d: (h - (1 << 64) if h >> 63 else h, c, n) for d, (h, c, n) in key.items()}
    ranks = []
    for column in (2, 3):
        names = sorted({r[column] for r in rows if r[column] is not None}) + [None]
        names = [x for x in names if any(r[column] == x for r in rows)]
        ranks.append({x: i * 256 // max(len(names), 256) for i, x in enumerate(names)})
    groups = {}
    for d, _, source, lang in rows:
        groups.setdefault(key[d], []).append((d, ranks[0][source], ranks[1][lang]))
    order = []
    for k, own in groups.items():
        e = k[2].bit_length() - 1
        step = min(255, (e - 3) * 8 + (k[2] >> (e - 3) & 7))
        least = min((a, b) for _, a, b in own)
        curve = int(sharding.hilbert_index([np.array([x]) for x in (*least, step)])[0])
        order.append((curve, *k, sorted(d for d, _, _ in own)))
    total, before, out, count = sum(k[2] for k in key.values()), 0, {}, {}
    for _, _, _, size, own in sorted(order):
        whole = size * len(own) * sharding.WHOLE * shards <= total
        for i, d in enumerate(own):
            start, unit = (before, size * len(own)) if whole else (before + i * size, size)
            at = min(shards - 1, (2 * start + unit) * shards // (2 * total))
            out[d] = (at, count.get(at, 0))
            count[at] = count.get(at, 0) + 1
        before += size * len(own)
    return out


def test_matches_brute_force(spark):
    rows = [(i, ("copy " * (i % 40)) if i % 3 else f"text {i} " * (i * 7 % 50), f"s{i * 31 % 7}" if i % 11 else None, ("en", "de", None, "fr")[i * 13 % 4]) for i in range(1500)]
    rows += [(2000 + i, "a large group of copies " * 3, "s1", "en") for i in range(700)]
    out, _ = run(spark, rows)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == brute(rows)


def test_small_groups_stay_together(spark):
    rows = [(i, f"group {i % 900} " * (1 + i % 900 % 5), f"s{i % 5}", ("en", "de")[i % 2]) for i in range(2700)]
    out, _ = run(spark, rows)
    homes = {}
    for r in out:
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert len(homes) == 900 and all(len(x) == 1 for x in homes.values())


def test_order_prunes(spark):
    rows = [(i, f"{i:04d}" + "x" * (i % 1000), f"s{i % 8}", ("en", "de")[i % 2]) for i in range(4000)]
    out, _ = run(spark, rows)
    source = {i: s for i, _, s, _ in rows}
    spread = [len({source[r["doc_id"]] for r in out if r["shard"] == k}) for k in range(24)]
    assert sum(spread) / 24 <= 4


def test_odd_rows(spark):
    run(spark, [(1, None, None, None), (2, "", "a", "en"), (2, "", "a", "en"), (None, "x", "a", "en"), (3, "long " * 100_000, "b", "de")])
    assert run(spark, [])[0] == []

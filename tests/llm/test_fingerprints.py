import hashlib

import numpy as np

from loomwright.llm import fingerprints as fp


def plain(text, k=fp.K, keep=fp.KEEP, sketches=fp.SKETCHES):
    """The fingerprint written out: all hashes of all numbered k-mers, sorted."""
    h = fp.numbered(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    out = []
    for s in range(1, sketches + 1):
        factor = np.uint32(fp.mix(np.array([s], np.uint64) * fp.GOLD)[0] >> np.uint64(32)) | np.uint32(1)
        values = [int(v >> np.uint64(32)) * int(factor) % 2**32 for v in h]
        pick = sorted(sorted(range(len(h)), key=lambda i: (values[i], i))[:keep])
        state = np.array([s - 1], np.uint64)
        for i in pick:
            state = fp.mix(state * fp.GOLD + h[i])
        out.append(int(state[0] >> np.uint64(32)) if len(h) else 0)
    return out


def test_matches_plain_form():
    for text in ("", "a", "short", "exactly8", "abc" * 40, "The quick brown fox jumps over the lazy dog. " * 3, "é日" * 30):
        assert fp.order_minhash(text).tolist() == plain(text)


def test_occurrences_and_order_matter():
    a, b = "one two three four. ", "five six seven eight. "
    assert fp.numbered(np.frombuffer(("abcdefgh" * 3).encode("utf-32-le"), np.uint32)).size == len(set(fp.numbered(np.frombuffer(("abcdefgh" * 3).encode("utf-32-le"), np.uint32)).tolist()))
    same = (fp.order_minhash(a * 20 + b * 20) == fp.order_minhash(b * 20 + a * 20)).mean()
    assert same < 0.8 and (fp.order_minhash(a * 20) == fp.order_minhash(a * 20)).all()


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghij "), 3000))
    shares = []
    for edits in (0, 5, 50, 500):
        chars = list(text)
        for i in rng.choice(len(chars), edits, replace=False):
            chars[i] = "z"
        shares.append((fp.order_minhash(text) == fp.order_minhash("".join(chars))).mean())
    assert shares[0] == 1 and shares == sorted(shares, reverse=True) and shares[1] > 0.6 and shares[3] < 0.2


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    out = fp.fingerprint_pairs(docs).collect()
    assert len(out) == len(rows)
    order = sorted(((-(2**63) if d is None else d, t or "") for d, t in rows))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        new = fp.edited(t, after)
        a, b, c = (fp.order_minhash(x) for x in (t, new, after))
        want.append((None if d == -(2**63) else d, len(t), hashlib.sha256(new.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_next_documents(spark):
    rng = np.random.default_rng(2)
    check(spark, [(int(i) * 3, "".join(rng.choice(list("abcd é"), int(n)))) for i, n in enumerate(rng.integers(0, 300, 57))])


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "x"), (4, "long text " * 20_000), (None, "n")])
    check(spark, [(5, "alone in the table")])
    check(spark, [(1, "b"), (1, "a"), (1, "a"), (2, "c")])
    assert fp.fingerprint_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0

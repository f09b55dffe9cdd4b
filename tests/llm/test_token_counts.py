import random

import pytest

from loomwright.llm import token_counts as tc
from loomwright.llm.tokens import WordBpe, tokenizer_path


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(tokenizer_path(tc.VOCABULARY))


def test_edits_match_counting_anew(counter):
    rng = random.Random(3)
    alphabet = "ab 's1  \n\n\t.!'treé 日"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        counted = tc.CountedText(text, counter)
        for _ in range(3):
            a = rng.randint(0, len(counted.text))
            b = rng.randint(a, min(len(counted.text), a + 12))
            counted.edit(a, b, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))))
            assert counted.counts.sum() == len(counter.encoding.encode_ordinary(counted.text))
            counted = tc.CountedText(counted.text, counter)
            assert counted.tokens == counted.counts.sum()


def test_segment_tree():
    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        values = [rng.randint(0, 9) for _ in range(rng.randint(0, 50))]
        tree = tc.SegmentTree(np.array(values, np.int64), width=4)
        a = rng.randint(0, len(values))
        b = rng.randint(a, len(values))
        new = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        tree.replace(a, b, np.array(new, np.int64))
        assert tree.total == sum(values[:a] + new + values[b:])


def test_only_touched_pieces_are_encoded_again(counter):
    text = "some words here " * 5000
    counted = tc.CountedText(text, counter)
    again = counted.edit(40_000, 40_004, "other")
    assert counted.tokens == len(counter.encoding.encode_ordinary(counted.text)) and again < 40


def test_query_and_odd_rows(spark, counter):
    rows = [(1, "Hello there, world"), (1, "Hello there, world"), (2, None), (3, ""), (None, "x"), (4, "long text " * 30_000)]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_tokens int")
    out = sorted((tuple(r) for r in tc.count_tokens(docs).collect()), key=repr)
    assert len(out) == len(rows)
    for d, t in rows:
        a, b, new = tc.middle_edit(t or "")
        changed = (t or "")[:a] + new + (t or "")[b:]
        want = (d, len(counter.encoding.encode_ordinary(t or "")), len(counter.encoding.encode_ordinary(changed)))
        assert want in [(o[0], o[1], o[3]) for o in out]
    assert tc.count_tokens(docs.limit(0)).count() == 0


def test_word_vocabulary_matches_the_tokenizer():
    import numpy as np

    bpe = WordBpe(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x180)] + list("–…İΣσ日<|'s't") + ["<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet if rng.random() < 0.5 else "abc 's1. ") for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_many_edits_of_a_long_text(counter):
    rng = random.Random(8)
    alphabet = "ab 's1  \n\n\t.!'treé 日"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for length in (0, 300, 3000):
        counted = tc.CountedText(make(length), counter)
        for k in range(250):
            a = rng.randint(0, len(counted.text))
            b = rng.randint(a, min(len(counted.text), a + rng.choice([0, 3, 12, 900 if k % 20 == 0 else 5])))
            counted.edit(a, b, make(rng.choice([0, 2, 9, 700 if k % 25 == 0 else 20])))
            assert counted.tokens == len(counter.encoding.encode_ordinary(counted.text))


def test_segment_tree_after_many_edits():
    import numpy as np

    rng = random.Random(9)
    for _ in range(60):
        values = [rng.randint(0, 9) for _ in range(rng.randint(0, 50))]
        tree = tc.SegmentTree(np.array(values, np.int64), width=4)
        for _ in range(40):
            a = rng.randint(0, len(values))
            b = rng.randint(a, len(values))
            b = b if rng.random() < 0.2 else min(b, a + 3)
            new = [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 2, 5, 30]))]
            tree.replace(a, b, np.array(new, np.int64))
            values[a:b] = new
            assert tree.total == sum(values)
            assert np.concatenate(tree.blocks).tolist() == values


def test_leaf_behind_a_block_that_grew():
    import numpy as np

    tree = tc.SegmentTree(np.arange(200), width=64)
    tree.replace(0, 0, np.array([7]))
    tree.replace(64, 65, np.array([1000]))
    assert tree.total == sum(range(200)) + 7 - 63 + 1000


def test_leaves_are_found_by_characters():
    import numpy as np

    rng = random.Random(11)
    for _ in range(40):
        pieces = ["x" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))]
        array = lambda p: (np.array([len(x) * 10 for x in p], np.int64), np.array([len(x) for x in p], np.int64), "".join(p))
        counts, lengths, text = array(pieces)
        tree = tc.SegmentTree(counts, 4, lengths, text)
        for _ in range(20):
            a = rng.randint(0, len(pieces))
            b = rng.randint(a, min(len(pieces), a + rng.choice([0, 2, 40])))
            new = [rng.choice("yz") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 30]))]
            tree.replace(a, b, *array(new))
            pieces[a:b] = new
            text = "".join(pieces)
            assert ("".join(tree.texts), tree.chars, len(tree), tree.total) == (text, len(text), len(pieces), 10 * len(text))
            i = rng.randint(0, len(text))
            assert tree.slice(i, i + 9) == text[i : i + 9]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(int).tolist()
            leaf = max(k for k, at in enumerate(starts) if at <= i)
            assert tree.leaf_at(i) == (leaf, starts[leaf]) and all(tree.start_of(k) == at for k, at in enumerate(starts[:-1]))


def test_edits_read_only_their_surroundings(counter, monkeypatch):
    """An edit of a long text asks for a few hundred characters and never for the whole text."""
    counted = tc.CountedText("some words here, and others " * 20_000, counter)
    read, whole = [], tc.SegmentTree.slice
    monkeypatch.setattr(tc.SegmentTree, "slice", lambda tree, a, b: read.append(b - a) or whole(tree, a, b))
    monkeypatch.setattr(tc.CountedText, "text", property(lambda self: 1 / 0))
    rng = random.Random(4)
    for _ in range(200):
        a = rng.randint(0, 500_000)
        counted.edit(a, a + rng.randint(0, 9), "new words"[: rng.randint(0, 9)])
    assert max(read) < 500
    monkeypatch.undo()
    assert counted.tokens == len(counter.encoding.encode_ordinary(counted.text))


def test_without_the_inner_entry(monkeypatch):
    monkeypatch.setattr(tc, "piece_encoder", lambda encoding: None)
    plain = tc.Counter(tokenizer_path(tc.VOCABULARY))
    text = "Some words,  and\n\n others 123 日本 'tis "
    assert tc.CountedText(text, plain).tokens == len(plain.encoding.encode_ordinary(text))

"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

Leaves hold the token counts of pre-tokens, inner nodes sums. An edit re-splits only the text it
touches, from the pre-token before it until the new split meets an old boundary again, encodes the
pre-tokens found there and updates the sums above them; everything else keeps its counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import piece_encoder, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters looked at on each side of a split region, so that no pre-token there ends early.
CONTEXT = 64


class Counter(dict):
    """pre-token -> number of its tokens in a byte-level vocabulary."""

    def __init__(self, path: str, limit: int = 400_000):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.spans = regex.compile(public_tokenizers.PATTERN).finditer
        self.encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = piece_encoder(self.encoding) or (lambda piece: self.encoding.encode_ordinary(piece.decode()))
        self.limit = limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = len(self.encode(piece.encode("utf-8", "replace")))
        if len(piece) < 64:
            self[piece] = value
        return value


class SegmentTree:
    """Sums over pre-tokens that lets ranges of them be replaced, again and again.

    The leaves lie in blocks of at most ``2 * width``, with their token counts, lengths and text; a binary
    tree over the blocks carries the numbers of leaves, tokens and characters, by which a leaf or a
    character is found where it lies now. A replacement reads and writes the blocks that it meets and the
    sums above them. Where a block would outgrow its bound it is cut, and the sums over the blocks (not
    the leaves) are built anew, as they are when most blocks have run empty.
    """

    LEAVES, TOKENS, CHARS = range(3)

    def __init__(self, counts: np.ndarray, width: int = 64, lengths: np.ndarray | None = None, text: str = ""):
        self.width = width
        self._build(*self._cut(counts, np.zeros(len(counts), np.int64) if lengths is None else lengths, text))

    def _cut(self, counts: np.ndarray, lengths: np.ndarray, text: str) -> tuple[list, list, list, np.ndarray]:
        """Blocks of ``width`` leaves: their counts, lengths, texts and sums."""
        if not len(counts):
            return [counts], [lengths], [text], np.zeros((1, 3), np.int64)
        at = np.append(np.arange(0, len(counts), self.width), len(counts))
        chars = np.concatenate([[0], np.cumsum(lengths)])[at]
        sums = np.stack([np.diff(at), np.add.reduceat(counts, at[:-1]), np.diff(chars)], 1)
        at, chars = at.tolist(), chars.tolist()
        spans = list(zip(at, at[1:], strict=False))
        return [counts[i:j] for i, j in spans], [lengths[i:j] for i, j in spans], [text[i:j] for i, j in zip(chars, chars[1:], strict=False)], sums

    def _build(self, blocks: list, lengths: list, texts: list, sums: np.ndarray) -> None:
        self.blocks, self.lengths, self.texts = blocks, lengths, texts
        self.size = 1 << (len(blocks) - 1).bit_length()
        self.nodes = np.zeros((2 * self.size, 3), np.int64)
        self.nodes[self.size : self.size + len(blocks)] = sums
        half = self.size // 2
        while half:
            self.nodes[half : 2 * half] = self.nodes[2 * half : 4 * half].reshape(half, 2, 3).sum(1)
            half //= 2

    @property
    def total(self) -> int:
        return int(self.nodes[1, self.TOKENS])

    @property
    def chars(self) -> int:
        return int(self.nodes[1, self.CHARS])

    def __len__(self) -> int:
        return int(self.nodes[1, self.LEAVES])

    def _find(self, at: int, by: int) -> tuple[int, np.ndarray]:
        """The block of the leaf or character ``at`` and the sums before it; past all of them, the last block."""
        if at >= self.nodes[1, by]:
            block = len(self.blocks) - 1
            return block, self.nodes[1] - self.nodes[self.size + block]
        node, before = 1, np.zeros(3, np.int64)
        while node < self.size:
            node *= 2
            if at >= before[by] + self.nodes[node, by]:
                before += self.nodes[node]
                node += 1
        return node - self.size, before

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins; past the text, the number of leaves and the text's end."""
        if char >= self.chars:
            return len(self), self.chars
        block, before = self._find(char, self.CHARS)
        ends = np.cumsum(self.lengths[block])
        k = int(np.searchsorted(ends, char - before[self.CHARS], side="right"))
        return int(before[self.LEAVES]) + k, int(before[self.CHARS]) + (int(ends[k - 1]) if k else 0)

    def start_of(self, leaf: int) -> int:
        block, before = self._find(leaf, self.LEAVES)
        return int(before[self.CHARS] + self.lengths[block][: leaf - int(before[self.LEAVES])].sum())

    def slice(self, start: int, stop: int) -> str:
        """The characters from start to stop."""
        block, before = self._find(start, self.CHARS)
        at, out = int(before[self.CHARS]), []
        while at < stop and block < len(self.texts):
            out.append(self.texts[block][max(0, start - at) : stop - at])
            at += len(self.texts[block])
            block += 1
        return "".join(out)

    def _put(self, block: int, counts: np.ndarray, lengths: np.ndarray, text: str) -> None:
        self.blocks[block], self.lengths[block], self.texts[block] = counts, lengths, text
        node = self.size + block
        delta = np.array([len(counts), counts.sum(), lengths.sum()]) - self.nodes[node]
        while node:
            self.nodes[node] += delta
            node >>= 1

    def replace(self, start: int, stop: int, counts: np.ndarray, lengths: np.ndarray | None = None, text: str = "") -> None:
        """Put new leaves in place of the present ones from start to stop."""
        lengths = np.zeros(len(counts), np.int64) if lengths is None else lengths
        first, before = self._find(start, self.LEAVES)
        begin = start - int(before[self.LEAVES])
        last, end = first, begin
        if stop > start:
            last, before = self._find(stop - 1, self.LEAVES)
            end = stop - int(before[self.LEAVES])
        text = self.texts[first][: int(self.lengths[first][:begin].sum())] + text + self.texts[last][int(self.lengths[last][:end].sum()) :]
        counts = np.concatenate([self.blocks[first][:begin], counts, self.blocks[last][end:]])
        lengths = np.concatenate([self.lengths[first][:begin], lengths, self.lengths[last][end:]])
        sums = self.nodes[self.size : self.size + len(self.blocks)]
        if len(counts) > 2 * self.width:
            *parts, inner = self._cut(counts, lengths, text)
            joined = [old[:first] + part + old[last + 1 :] for old, part in zip((self.blocks, self.lengths, self.texts), parts, strict=True)]
            self._build(*joined, np.concatenate([sums[:first], inner, sums[last + 1 :]]))
            return
        self._put(first, counts, lengths, text)
        for b in range(first + 1, last + 1):
            self._put(b, counts[:0], lengths[:0], "")
        if len(self) * 4 < len(self.blocks) * self.width and len(self.blocks) > 1:
            full = [b for b in range(len(self.blocks)) if len(self.blocks[b])] or [0]
            if len(full) * 2 <= len(self.blocks):
                self._build(*[[old[b] for b in full] for old in (self.blocks, self.lengths, self.texts)], sums[full])


class CountedText:
    """A text as a tree of its pre-tokens; edits leave all but their surroundings as it is."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.tree = self._leaves(counter.pieces(text), text, SegmentTree)

    def _leaves(self, pieces: list[str], text: str, put):
        counts = np.fromiter(map(self.counter.__getitem__, pieces), np.int64, len(pieces))
        return put(counts, lengths=np.fromiter(map(len, pieces), np.int64, len(pieces)), text=text)

    @property
    def tokens(self) -> int:
        return self.tree.total

    @property
    def text(self) -> str:
        """The whole text as it is now, joined anew."""
        return "".join(self.tree.texts)

    @property
    def counts(self) -> np.ndarray:
        """The token counts of all pre-tokens, joined anew."""
        return np.concatenate(self.tree.blocks)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace the characters from start to stop; returns the number of pre-tokens encoded again.

        Reads the text from two pre-tokens before the edit, as the pattern looks one character ahead, to
        where the new split meets an old boundary, so that the cost follows the edit, not the text.
        """
        tree, size = self.tree, self.tree.chars
        first, begin = tree.leaf_at(start - 1) if start else (0, 0)
        if first:
            first -= 1
            begin = tree.start_of(first)
        head, shift, reach = tree.slice(begin, start) + new, len(new) - (stop - start), CONTEXT
        while True:
            upto = min(size, stop + reach)
            window = head + tree.slice(stop, upto)
            found, last = [], None
            for m in self.counter.spans(window):
                if m.end() >= len(window) and upto < size:
                    break
                found.append(m.group())
                # After the edit, a common boundary behind which the same text follows ends the search.
                if m.end() > len(head):
                    old = begin + m.end() - shift
                    leaf, at = tree.leaf_at(old)
                    if at == old:
                        last = leaf
                        break
            if last is not None or upto == size:
                break
            reach *= 4
        last = len(tree) if last is None else last
        self._leaves(found, "".join(found), lambda counts, **new: tree.replace(first, last, counts, **new))
        return len(found)


def middle_edit(text: str) -> tuple[int, int, str]:
    """The edit that the query applies: the middle tenth of the text, at most 200 characters, reversed."""
    n = len(text)
    width = min(200, n // 10)
    start = (n - width) // 2
    return start, start + width, text[start : start + width][::-1] + "~"


COUNTED = "doc_id long, n_tokens long, n_pieces long, edited_tokens long, encoded_again long"


def count_tokens(docs: DataFrame, edit=middle_edit, path: str | None = None) -> DataFrame:
    """Token counts of every whole text before and after an edit, the latter by the segment tree.

    ``edit`` gives (start, stop, new text) for a text. A null text counts as an empty one; repeated
    rows are counted each for themselves; an empty table gives no rows; further columns are ignored.
    """
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py() or ""
                counted = CountedText(text, counter)
                before, pieces = counted.tokens, len(counted.tree)
                again = counted.edit(*edit(text))
                rows.append((doc_id, before, pieces, counted.tokens, again))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [f.split()[0] for f in COUNTED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

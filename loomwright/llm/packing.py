"""Packing: Karmarkar-Karp multiway differencing into windows of near-equal length.

Documents become token ids plus an end id. Whole windows are cut off first; the rest is cut into
pieces of at most ``max_piece`` ids. Groups of about ``group_docs`` documents, dealt by a hash of id and
text so that a task that is computed again deals alike, are then packed on their own: partial partitions
with the widest spread are merged largest against smallest until one remains, and the window count rises
while a window exceeds the capacity. A group that many equal rows fill is packed in runs of bounded size.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix
from .tokens import WordBpe, tokenizer_path

CAPACITY = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
GROUP_DOCS = 1024
#: Longest piece of a document's last, partial window. Shorter pieces pack tighter but cut more.
MAX_PIECE = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by multiway largest differencing."""
    n = len(sizes)
    if n == 0 or windows == 1:
        return np.zeros(n, np.int64)
    leaf = np.zeros(windows, np.int64)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for k, s in enumerate(sizes):
        sums[k] = leaf.copy()
        sums[k][-1] = s
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = total = total[order]
        heapq.heappush(heap, (-int(total[-1] - total[0]), node))
    places = {n + len(merges) - 1: np.arange(windows)}
    out = np.zeros(n, np.int64)
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        here = places.pop(node)
        at = np.empty(windows, np.int64)
        at[order] = here
        for child, there in ((a, at), (b, at[::-1])):
            if child < n:
                out[child] = there[-1]
            else:
                places[child] = there
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows for the sizes, none above ``capacity``; the fewest that differencing manages."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        out = differencing(sizes, windows)
        if np.bincount(out, sizes, windows).max(initial=0) <= capacity:
            return out, windows
        windows += max(1, windows // 200)


def tokenize(docs: DataFrame, groups: int, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, path: str | None = None) -> DataFrame:
    """Every piece of every document, with the group that packs it."""
    path = path or tokenizer_path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            rows = []
            dealt = mix(batch.column("hash").to_numpy().view(np.uint64)) % np.uint64(groups)
            for doc_id, text, group in zip(batch.column("doc_id").to_pylist(), batch.column("text"), dealt.tolist(), strict=True):
                ids = bpe.encode(text.as_py()) + end
                n, start = len(ids) // 4, 0
                while start < n:
                    length = capacity if n - start >= capacity else min(max_piece, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n, group))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("hash")).mapInArrow(run, f"{PIECES}, pack_group long")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, max_piece: int = MAX_PIECE, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its place there.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each
    for itself; an empty table gives no rows; further columns are ignored. Sequences hold at most
    ``capacity`` ids and are padded to it.
    """
    groups = max(1, -(-docs.count() // group_docs))
    most = 16 * group_docs

    def finish(table: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        """The rows of one group with sequence and offset, windows numbered from ``first``; and the next number."""
        sizes = table["length"].to_numpy()
        window = np.empty(len(sizes), np.int64)
        whole = sizes == capacity
        window[~whole], count = pack_group(sizes[~whole], capacity)
        window[whole] = count + np.arange(whole.sum())
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order]) - sizes[order]
        fresh = np.flatnonzero(np.diff(window[order], prepend=-1))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - np.repeat(ends[fresh], np.diff(fresh, append=len(sizes)))
        sequence = (table["pack_group"].to_numpy() << 32) + first + window
        columns = [*table.drop_columns("pack_group").combine_chunks().to_batches()[0].columns, pa.array(sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PACKED.split(", ")]), first + int(window.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, group, first = None, None, 0
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            of = rest["pack_group"].to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist()]
            if len(of) - bounds[-1] >= most:
                bounds.append(len(of))
            for a, b in zip(bounds, bounds[1:], strict=False):
                first = first if of[a] == group else 0
                group = of[a]
                out, first = finish(rest.slice(a, b - a), first)
                yield out
            rest = rest.slice(bounds[-1])
        if rest is not None and len(rest):
            yield finish(rest, first if rest["pack_group"][0].as_py() == group else 0)[0]

    pieces = tokenize(docs, groups, capacity, max_piece, path)
    return pieces.repartition("pack_group").sortWithinPartitions("pack_group", "doc_id", "start", "ids_crc32", "doc_tokens").mapInArrow(run, PACKED)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

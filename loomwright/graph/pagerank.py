"""PageRank in two readings: over linked vertices only, and over all ends of edges.

Links are dealt once to the owner of their source and kept there as places in arrays. What moves in an iteration is a
packed array of sums for each chunk of links and owner of targets, whose order both sides know.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_folder

#: Links in a packed row, in which parallel ones are folded.
PACKED_LINKS = 500_000
#: Links that a task holds at a time, about 100 bytes each with what is made of them.
CHUNK_LINKS = 2_000_000
#: Links for each owner, on average.
LINKS_PER_OWNER = 1_500_000
#: Stands for a null id, which can be linked to but passes nothing on.
NULL_ID = -(2**63)


def adjacency_pagerank(edges: DataFrame, iterations: int = 10, vertices: DataFrame | None = None) -> DataFrame:
    """(id, rank) after ``rank = 0.15 + 0.85 * sum of rank / degree over in-links``.

    Ranks begin at 1 for each vertex with a row of links. A vertex without in-links has no rank after an
    iteration and passes nothing on; parallel edges count each. Ranks are not normalised.
    """
    return _ranked(edges, iterations, 0.15, False, vertices)


def static_pagerank(edges: DataFrame, iterations: int = 10, reset: float = 0.15) -> DataFrame:
    """(id, rank) of all ends of edges, from rank 1; ``rank = reset + (1 - reset) * sum of rank / degree``.

    A vertex without in-links gets ``reset``.
    """
    return _ranked(edges, iterations, reset, True, None)


def _ranked(edges: DataFrame, iterations: int, reset: float, keep_all: bool, vertices: DataFrame | None) -> DataFrame:
    spark = edges.sparkSession
    shared_folder(spark)
    schema = "links long, src binary, dst binary, n binary"
    packed = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).mapInArrow(_pack, schema)
    if vertices is not None:
        packed = packed.union(vertices.select(F.col("id").cast("long").alias("src")).mapInArrow(_pack, schema))
    packed = cut(packed)
    owners = 1 + (packed.agg(F.sum("links")).first()[0] or 0) // LINKS_PER_OWNER

    # A chunk's links arrive in any order, so chunks live in a checkpoint: made anew, their places would be others.
    chunks = packed.rdd.mapPartitions(partial(_deal, owners=owners)).partitionBy(owners, _same).mapPartitions(partial(_chunks, owners=owners), True)
    chunks.persist(StorageLevel.DISK_ONLY)
    chunks.checkpoint()
    chunks.count()
    chunks.unpersist()
    needs = chunks.mapPartitions(_needs).partitionBy(owners, _same)
    state = needs.union(chunks).mapPartitions(_placed, True).persist(StorageLevel.DISK_ONLY)
    try:
        passed = state
        for k in range(iterations):
            step = partial(_pass_on, first=k == 0, reset=reset, keep_all=keep_all, given=vertices is not None)
            passed = passed.mapPartitions(step).partitionBy(owners, _same).union(state)
        last = partial(_ranks, first=iterations == 0, reset=reset, keep_all=keep_all, given=vertices is not None)
        ranks = spark.createDataFrame(passed.mapPartitions(last), "ids binary, ranks binary", verifySchema=False)
        return cut(ranks.mapInArrow(_unpack, "id long, rank double"))
    finally:
        state.unpersist()


def _same(owner: int) -> int:
    return owner


def _owner(ids: np.ndarray, owners: int) -> np.ndarray:
    z = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(29))) % np.uint64(owners)).astype(np.int64)


def _longs(column: pa.Array) -> np.ndarray:
    if not column.null_count:
        return column.to_numpy()
    if (column.drop_null().to_numpy() == NULL_ID).any():
        raise ValueError(f"id {NULL_ID} cannot be told from null")
    return column.fill_null(NULL_ID).to_numpy()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many links, with their numbers if some are parallel; of vertices, where batches have no targets."""

    def row(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        at = np.flatnonzero(new)
        n = np.diff(at, append=len(order))
        packed = [c[at].tobytes() for c in columns] + [None] * (2 - len(columns)) + [n.tobytes() if (n > 1).any() else None]
        links = len(at) if len(columns) == 2 else 0
        return pa.RecordBatch.from_arrays([pa.array([links]), *(pa.array([c], pa.binary()) for c in packed)], ["links", "src", "dst", "n"])

    held, size = [], 0
    for batch in batches:
        held.append([_longs(c) for c in batch.columns])
        size += batch.num_rows
        if size >= PACKED_LINKS:
            yield row(held)
            held, size = [], 0
    if size:
        yield row(held)


def _deal(rows: Iterator, owners: int) -> Iterator[tuple]:
    """Pieces of packed rows for the owners of their sources."""
    for r in rows:
        src = np.frombuffer(r.src, np.int64)
        owner = _owner(src, owners)
        order = np.argsort(owner, kind="stable")
        columns = [src[order], *(np.frombuffer(c, np.int64)[order] if c is not None else None for c in (r.dst, r.n))]
        bounds = np.searchsorted(owner[order], np.arange(owners + 1))
        for q in np.flatnonzero(np.diff(bounds)).tolist():
            yield q, tuple(c[bounds[q] : bounds[q + 1]] if c is not None else None for c in columns)


def _chunks(pieces: Iterator[tuple], owners: int) -> Iterator[tuple]:
    """Links of one owner as places among the chunk's sources and its targets, which are in order of owner and id."""

    def chunk(p: int, k: int, parts: list) -> tuple:
        src, dst = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        n = np.concatenate([np.ones(len(x[0]), np.int64) if x[2] is None else x[2] for x in parts]) if any(x[2] is not None for x in parts) else None
        sources, at = np.unique(src, return_inverse=True)
        targets, to = np.unique(dst, return_inverse=True)
        owner = _owner(targets, owners)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return p, ("chunk", (p, k), sources, np.bincount(at, n, len(sources)), at.astype(np.int32), targets[order], place[to], n, np.searchsorted(owner[order], np.arange(owners + 1)))

    held, size, k, p = [], 0, 0, 0
    for p, piece in pieces:
        if piece[1] is None:
            yield p, ("given", piece[0])
            continue
        held.append(piece)
        size += len(piece[0])
        if size >= CHUNK_LINKS:
            yield chunk(p, k, held)
            held, size, k = [], 0, k + 1
    if size:
        yield chunk(p, k, held)


def _needs(chunks: Iterator[tuple]) -> Iterator[tuple]:
    """What an owner has to know before its chunks: its sources with degrees, given vertices, and targets by chunk."""
    for p, record in chunks:
        if record[0] == "given":
            yield p, ("given", record[1])
            continue
        _, key, sources, degrees, _, targets, _, _, bounds = record
        yield p, ("sources", sources, degrees)
        for q in np.flatnonzero(np.diff(bounds)).tolist():
            yield q, ("targets", key, targets[bounds[q] : bounds[q + 1]])


def _placed(records: Iterator[tuple]) -> Iterator[tuple]:
    """An owner's vertices and where each chunk's sums go, then its chunks with places among the vertices."""
    given, sources, targets, ids = [], [], [], None

    def head() -> tuple:
        everything = [x[0] for x in sources] + [x for _, x in targets] + given
        ids = np.unique(np.concatenate(everything)) if everything else np.empty(0, np.int64)
        degree = np.zeros(len(ids))
        for s, d in sources:
            degree[np.searchsorted(ids, s)] += d
        start = np.isin(ids, np.concatenate(given)) if given else np.zeros(len(ids), bool)
        # In one order, so that sums of floats are the same in every run.
        return ids, ("head", ids, degree, start, {key: np.searchsorted(ids, x).astype(np.int32) for key, x in sorted(targets, key=lambda x: x[0])})

    for p, record in records:
        if record[0] == "sources":
            sources.append(record[1:])
        elif record[0] == "targets":
            targets.append(record[1:])
        elif record[0] == "given":
            given.append(record[1])
        else:
            if ids is None:
                ids, first = head()
                yield p, first
            _, key, chunk_sources, _, at, _, to, n, bounds = record
            yield p, ("chunk", key, np.searchsorted(ids, chunk_sources).astype(np.int32)[at], to, n, bounds)
    if ids is None and (sources or targets or given):
        yield p, head()[1]


def _rank(head: tuple, sums: dict, first: bool, reset: float, keep_all: bool, given: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of an owner's vertices and which of them have one."""
    _, ids, degree, start, inbox = head
    if first:
        on = np.ones(len(ids), bool) if keep_all else start if given else degree > 0
        return np.where(on, 1.0, 0.0), on
    total = np.zeros(len(ids))
    for key, places in inbox.items():
        total[places] += sums[key]
    if keep_all:
        # No edge is looked up by a null id.
        total[ids == NULL_ID] = 0.0
        return reset + (1 - reset) * total, np.ones(len(ids), bool)
    on = total > 0
    return np.where(on, reset + (1 - reset) * total, 0.0), on


def _pass_on(records: Iterator[tuple], **how) -> Iterator[tuple]:
    """The sums of an owner's chunks for the owners of their targets, after the sums that it got."""
    sums, share = {}, None
    for _, record in records:
        if record[0] == "sums":
            sums[record[1]] = record[2]
        elif record[0] == "head":
            ranks, _ = _rank(record, sums, **how)
            ids, degree, sums = record[1], record[2], {}
            share = np.divide(ranks, degree, out=np.zeros(len(ids)), where=(degree > 0) & (ids != NULL_ID))
        else:
            _, key, at, to, n, bounds = record
            parts = share[at] if n is None else share[at] * n
            parts = np.bincount(to, parts, bounds[-1])
            for q in np.flatnonzero(np.diff(bounds)).tolist():
                yield q, ("sums", key, parts[bounds[q] : bounds[q + 1]])


def _ranks(records: Iterator[tuple], **how) -> Iterator[tuple]:
    sums = {}
    for _, record in records:
        if record[0] == "sums":
            sums[record[1]] = record[2]
        elif record[0] == "head":
            ranks, on = _rank(record, sums, **how)
            sums = {}
            yield bytearray(record[1][on].tobytes()), bytearray(ranks[on].tobytes())


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, ranks in zip(batch.column("ids"), batch.column("ranks"), strict=True):
            ids, ranks = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(ranks.as_buffer(), np.float64)
            for k in range(0, len(ids), 10_000):
                part = ids[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, mask=part == NULL_ID), pa.array(ranks[k : k + 10_000])], ["id", "rank"])

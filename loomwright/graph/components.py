"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Most links that one task solves in memory (about 100 MB); more are contracted in rounds before.
LOCAL_LINKS = 1_000_000
#: Links for each partition: a small table does not need a cluster's worth of partitions.
LINKS_PER_PARTITION = 500_000


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 100, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, component): the smallest vertex id of each weakly connected component.

    ``edges`` has (src, dst); ``vertices``, if given, has (id) and adds isolated ones. While more than
    ``local_links`` links are left, every vertex takes the root that its least neighbours lead to, and links
    between roots are all that stays: two rounds halve the vertices at least. One task solves the rest, and the
    rounds are read back. Before each count every task replaces its links by a forest with the same components,
    so what is shuffled and kept follows the vertices. Tables live in checkpoints; only counts reach the driver.
    """
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    # An end without the other one is kept as a link to itself, as are links to oneself.
    links, n = _kept(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a IS NOT NULL"), local_links)
    rounds: list[DataFrame] = []
    while n > local_links:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = _roots(links)
        rounds.append(roots)
        at_a = links.join(roots.select(F.col("id").alias("a"), F.col("root").alias("x")), "a")
        both = at_a.join(roots.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
        links, n = _kept(both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), local_links)
    labels = links.coalesce(1).mapInArrow(_solve, "id long, component long")
    for roots in reversed(rounds):
        further = labels.select(F.col("id").alias("root"), F.col("component").alias("further"))
        labels = roots.join(further, "root", "left").select("id", F.coalesce("further", "root").alias("component"))
    labels = cut(labels)
    if vertices is not None:
        alone = vertices.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct().join(labels, "id", "left_anti")
        labels = labels.union(alone.select("id", F.col("id").alias("component")))
    return labels


def _kept(links: DataFrame, most: int = LOCAL_LINKS) -> tuple[DataFrame, int]:
    """Links with the components and ends of ``links`` in a checkpoint, distinct, and their number."""
    links = cut(links.mapInArrow(partial(_forest, most=most), "a long, b long").distinct())
    n = links.count()
    return links.coalesce(1 + n // LINKS_PER_PARTITION), n


def _roots(links: DataFrame) -> DataFrame:
    """(id, root) of every end of ``links``: where the steps to the least neighbour, as long as it is smaller, end."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near"))))
    roots = cut(links.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.min("e.near").alias("near")).select("id", F.least("id", "near").alias("root")))
    while True:
        further = roots.select(F.col("id").alias("root"), F.col("root").alias("further"))
        roots = cut(roots.join(further, "root").select("id", F.col("further").alias("root"), (F.col("root") != F.col("further")).alias("moved")))
        if roots.where("moved").limit(1).count() == 0:
            return roots.select("id", "root")
        roots = roots.select("id", "root")


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A link from every end of a task's links to the least of its component, a loop for one alone.

    About ``most`` links are held; a forest of more than half as many is passed on, a smaller one takes in further links.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= most:
            held = [_stars(held)]
            if (n := len(held[0][0])) > most // 2:
                yield from _rows(*held[0], ["a", "b"])
                held, n = [], 0
    if n:
        yield from _rows(*_stars(held), ["a", "b"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labels of all links of a task."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if parts:
        ids, root = _labelled(parts)
        yield from _rows(ids, ids[root], ["id", "component"])


def _stars(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, root = _labelled(parts)
    # The least of a component is an end of the others' links already.
    on = (root != np.arange(len(ids))) | (np.bincount(root, minlength=len(ids)) == 1)
    return ids[root[on]], ids[on]


def _labelled(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links in order, and the place of the least of each one's component."""
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        on = root[a] != root[b]
        a, b = a[on], b[on]
    return ids, root


def _rows(first: np.ndarray, second: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(first), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(first[k : k + 10_000]), pa.array(second[k : k + 10_000])], names)

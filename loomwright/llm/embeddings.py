"""Embedding near-dedup by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; a pair of centroids is a cell of the product
grid, and every vector is filed in its nearest cell. A query visits cells in the order of the summed
distances of the two halves (the multi-sequence order) up to an excess over its own cell that, on
sampled vectors with made neighbours at the threshold, reaches the target recall. Of two vectors the one
in the lower cell visits the other, so only cells from the own one on are visited. Vectors met in a
visited cell are verified by their cosine in double precision.

Every length of vectors has codebooks of its own, of a size that follows their number, or a single cell
where there are few. Only the codebooks come from a sample; all vectors are filed and all are queries.
Cells are cut into blocks of bounded size, and a block emits sums of links and a spanning forest, not its
pairs. Blocks are planned on codes alone; vectors are joined and shuffled once, to the blocks they need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph.components import connected_components
from ..session import cut
from ._blocks import by_key

THRESHOLD = 0.98
#: Vectors that the codebooks are fitted on, at most about.
SAMPLE = 4096
#: Most centroids of a half; there are as many as give cells of about ``BLOCK`` vectors, a power of two.
CENTROIDS = 128
#: Most vectors of a length that are filed in a single cell, where every pair meets.
FEW = 1024
TARGET_RECALL = 0.9995
#: Filed vectors, and queries, of a block, about; a hash deals them.
BLOCK = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _distances(x, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=len(centers))
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (centers * centers).sum(1)[None, :] - 2 * x @ centers.T


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves and the excess up to which a query visits cells."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    @property
    def dims(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def excess(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much further than the nearest centroid each centroid is, for both halves."""
        half = self.first.shape[1]
        a, b = _distances(unit[:, :half], self.first), _distances(unit[:, half:], self.second)
        return a - a.min(1)[:, None], b - b.min(1)[:, None]

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells within reach of each row from its own one on, nearest first."""
        a, b = self.excess(unit)
        own = a.argmin(1) * len(self.second) + b.argmin(1)
        # Only centroids that fit on their own can be part of a visited pair.
        row, i = np.nonzero(a <= self.reach)
        fits = a[row, i][:, None] + b[row] <= self.reach
        k, j = np.nonzero(fits)
        row, i = row[k], i[k]
        order = np.lexsort((a[row, i] + b[row, j], row))
        row, cell = row[order], (i * len(self.second) + j)[order]
        ahead = cell >= own[row]
        return row[ahead], cell[ahead]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.excess(unit)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def fit(sample: np.ndarray, threshold: float = THRESHOLD, centroids: int = CENTROIDS, recall: float = TARGET_RECALL, made: int = 12, seed: int = 5) -> MultiIndex:
    """Codebooks from sampled vectors, and the excess that covers made neighbours at ``threshold``."""
    unit = _unit(sample.astype(np.float64))
    half = unit.shape[1] // 2
    index = MultiIndex(_kmeans(unit[:, :half], centroids), _kmeans(unit[:, half:], centroids, seed=4), 0.0)
    rng = np.random.default_rng(seed)
    near = np.repeat(unit, made, axis=0)
    noise = rng.normal(size=near.shape)
    noise -= (noise * near).sum(1)[:, None] * near
    cells = index.cells(threshold * near + np.sqrt(1 - threshold**2) * _unit(noise))
    a, b = index.excess(unit)
    rows = np.repeat(np.arange(len(unit)), made)
    needed = a[rows, cells // len(index.second)] + b[rows, cells % len(index.second)]
    return MultiIndex(index.first, index.second, float(np.quantile(needed, recall)) + 1e-9)


def single_cell(dims: int) -> MultiIndex:
    """An index of one cell that holds, and shows every query, all vectors."""
    return MultiIndex(np.zeros((1, dims // 2)), np.zeros((1, dims - dims // 2)), 0.0)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def centroids_for(n: int) -> int:
    """Centroids of a half for ``n`` vectors."""
    wanted = max(2, math.isqrt(max(0, n - 1) // BLOCK) + 1)
    return min(CENTROIDS, 1 << (wanted - 1).bit_length())


def _block(threshold: float, ids: np.ndarray, weight: np.ndarray, filed: np.ndarray, own: np.ndarray, x: np.ndarray):
    """(id, links, root) of the linked vectors of one block of filed vectors and queries.

    A query of the cell itself (``own``) is met from both sides; for others the block counts both ends.
    """
    m, p = np.flatnonzero(filed), np.flatnonzero(~filed)
    if not len(m) or not len(p):
        return None
    links = x[p] @ x[m].T >= threshold
    links &= ids[p][:, None] != ids[m][None, :]
    rows, cols = links.any(1), links.any(0)
    if not rows.any():
        return None
    links = links[np.ix_(rows, cols)]
    p, m = p[rows], m[cols]
    names = np.unique(np.concatenate([ids[p], ids[m]]))
    at_p, at_m = np.searchsorted(names, ids[p]), np.searchsorted(names, ids[m])
    count = np.zeros(len(names), np.int64)
    np.add.at(count, at_p, links @ weight[m])
    np.add.at(count, at_m, (links & ~own[p][:, None]).T @ weight[p])
    root = np.arange(len(names))
    while True:
        before = root.copy()
        np.minimum.at(root, at_p, np.where(links, root[at_m][None, :], len(names)).min(1))
        np.minimum.at(root, at_m, np.where(links, root[at_p][:, None], len(names)).min(0))
        root = root[root]
        if (root == before).all():
            return names, count, names[root]


def _usable() -> str:
    fine = "forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND exists(embedding, v -> v <> 0)"
    return f"label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce({fine}, false)"


def near_dups(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors link when their labels are equal and the cosine is at least ``threshold``. A vector that is
    null, zero or holds null or non-finite components, or whose label is null, links with nothing; vectors
    of different lengths do not link. Rows that repeat a vec_id count as one vector (the smallest of
    them); a null vec_id gives one row with a null component. An empty table gives no rows; further
    columns are ignored. Equal vectors of a label (told by 128 bits of hash) are compared once, with their
    number as weight.
    """
    rows = vectors.select("vec_id", F.struct("label", "embedding").alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.*")
    # From a checkpoint, so that the vectors are shuffled once for all that reads them below.
    rows = cut(rows.select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2"), F.expr(_usable()).alias("usable")))
    good = rows.where("usable")
    lengths = good.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not lengths:
        return plain
    indexes = {}
    for dims, n in lengths:
        if n <= FEW or dims < 2:
            continue
        share = min(1.0, sample / n)
        some = good.where((F.size("embedding") == dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) <= int(share * 1_000_003)))
        picked = some.select("vec_id", "embedding").toArrow().sort_by("vec_id")
        if picked.num_rows:
            indexes[dims] = fit(_matrix(picked["embedding"].combine_chunks(), dims), threshold, centroids_for(n))
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)
    classes = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    # The least vector of a class brings the components, so that they are not carried through the sums.
    classes = cut(good.select("vec_id", "embedding").join(classes, F.col("vec_id") == F.col("rep")).drop("vec_id"))
    kind = dict(classes.dtypes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 2000):
                mixed = big.slice(start, 2000)
                sizes = mixed.column("embedding").value_lengths().to_numpy()
                for dims in np.unique(sizes).tolist():
                    batch = mixed.take(pa.array(np.flatnonzero(sizes == dims)))
                    index = shared.value.get(dims) or single_cell(dims)
                    x = _unit(_matrix(batch.column("embedding"), dims))
                    row, cell = index.visits(x)
                    home = index.cells(x)
                    take = np.concatenate([np.arange(len(x)), row])
                    cells = np.concatenate([home, cell])
                    picked = batch.select(["label", "rep"]).take(pa.array(take))
                    columns = [np.full(len(take), dims, np.int32), cells.astype(np.int32), np.arange(len(take)) < len(x), cells == home[take]]
                    yield pa.RecordBatch.from_arrays([*picked.columns, *map(pa.array, columns)], ["label", "rep", "dims", "cell", "filed", "own"])

    codes = cut(classes.select("label", "embedding", "rep").mapInArrow(code, f"label {kind['label']}, rep {kind['rep']}, dims int, cell int, filed boolean, own boolean"))
    sizes = codes.groupBy("label", "dims", "cell").agg(F.count_if("filed").alias("filed_rows"), F.count_if(~F.col("filed")).alias("queries"))
    # From a checkpoint, so that both sides of the join are shuffled for it and a hot cell can be split.
    sizes = cut(sizes.where("filed_rows > 0 AND filed_rows + queries > 2").select(
        F.col("label").alias("l"), F.col("dims").alias("d"), F.col("cell").alias("c"), F.ceil(F.col("filed_rows") / block).cast("int").alias("parts"), F.ceil(F.col("queries") / block).cast("int").alias("turns")
    ))
    own_part = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = codes.join(sizes, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d")) & (F.col("cell") == F.col("c"))).select(
        F.col("rep").alias("of"), "dims", "cell", "filed", "own",
        F.when(F.col("filed"), own_part("parts")).otherwise(every("parts")).alias("parts"),
        F.when(F.col("filed"), every("turns")).otherwise(own_part("turns")).alias("turns"),
    )
    dealt = dealt.withColumn("part", F.explode("parts")).withColumn("turn", F.explode("turns")).drop("parts", "turns")
    key = ["label", "dims", "cell", "part", "turn"]
    filled = dealt.join(classes, F.col("of") == F.col("rep")).select(*key, "filed", "own", "rep", "weight", "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, key):
            dims = group.column("dims")[0].as_py()
            flags = [group.column(c).to_numpy(zero_copy_only=False) for c in ("filed", "own")]
            found = _block(threshold, group.column("rep").to_numpy(), group.column("weight").to_numpy(), *flags, _unit(_matrix(group.column("embedding"), dims)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "links", "root"])

    found = cut(filled.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    known_classes = classes.join(counts, classes["rep"] == counts["id"], "left").drop("id")
    known_classes = known_classes.join(components, known_classes["rep"] == components["id"], "left").drop("id")
    known_classes = known_classes.select(F.col("label").alias("l"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("embedding").join(known_classes, (F.col("label") == F.col("l")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("usable"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS s, b.vec_id AS t FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(s, t) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.s, l.t FROM reach r JOIN links l ON r.t = l.s),
counts AS (SELECT s, count(*) AS n FROM links GROUP BY s),
least_of AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts ON counts.s = vec_id JOIN least_of ON least_of.s = vec_id
"""

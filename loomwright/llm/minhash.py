"""MinHash near-dedup: BagMinHash signatures of word shingles, bands, and verified multiset overlap.

A text's elements are its shingles of five words with their counts as weights. BagMinHash keeps, for
each of ``COMPONENTS`` parts, the least point of Poisson processes over the unit steps of the weights:
steps are joined in dyadic ranges (0, 1], (1, 2], (2, 4], ..., each with one process for all parts at a
rate of its width, whose points carry a part and a level; points above the weight do not count, and a
process stops once it is past the largest part. Parts of two texts then agree with the probability of
their weighted Jaccard similarity.

Equal texts form one class first. Classes that share a band are candidates. Inside a bucket no pairs
are built: all members are verified against a hub, then against the member nearest to the hub. Members
that are not in their hub's component after that are compared with all members of the buckets of that
component, in blocks of about a given number of rows and of bytes that emit links only. Shingles are
held and verified as 64-bit hashes (55 bits of them where pairs are counted together).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph.components import connected_components
from ..session import cut
from ._blocks import by_key, spanning
from ._text import GOLD, WordHash, grams, mix, text_slices

SHINGLE = 5
THRESHOLD = 0.8
COMPONENTS = 64
BANDS = 16
#: Most rows of three integers that are broadcast to pick texts (about 40 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Sides of a block in which members outside a component meet those around it: rows, and bytes of their bags.
#: Squares repeat the fewest bags for as many rows a block.
BLOCK = (640, 640)
BLOCK_BYTES = (20 << 20, 20 << 20)

_U = np.uint64


def shingles(texts: list[str | None], words: WordHash, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of every shingle; a text of fewer words has one of all its words."""
    lists = [t.lower().split() if t else [] for t in texts]
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    doc = np.repeat(np.arange(len(lists)), length)
    h = words.array([w for x in lists for w in x])
    inside = doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]
    out_doc, out = doc[: len(inside)][inside], mix(grams(h, n)[inside])
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        ends = np.cumsum(length)
        extra = np.array([mix(grams(h[ends[i] - length[i] : ends[i]], int(length[i])) + _U(length[i]))[0] for i in short], np.uint64)
        out_doc, out = np.concatenate([out_doc, short]), np.concatenate([out, extra])
    return out_doc, out


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, components: int = COMPONENTS) -> np.ndarray:
    """Signatures, one row per document; rows without elements stay infinite.

    ``weight`` is the whole weight of each distinct element of a document.
    """
    sig = np.full(docs * components, np.inf)
    ranges = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(element)), ranges)
    level = np.arange(len(at)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    width = np.maximum(low, 1)
    doc, limit = doc[at], weight[at].astype(np.float64)
    seed = mix(element[at] + GOLD * level.astype(np.uint64))
    time, step = np.zeros(len(at)), 0
    while len(doc):
        step += 1
        draw = mix(seed + _U(int(GOLD) * step & (1 << 64) - 1))
        time -= np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        place = mix(draw ^ GOLD)
        part = ((place >> _U(32)) * _U(components) >> _U(32)).astype(np.int64)
        reached = low + width * ((place & _U(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32 <= limit
        np.minimum.at(sig, (doc * components + part)[reached], time[reached])
        if len(doc) * 4 < docs:
            some, back = np.unique(doc, return_inverse=True)
            highest = sig.reshape(docs, components)[some].max(1)[back]
        else:
            highest = sig.reshape(docs, components).max(1)[doc]
        on = time < highest
        doc, seed, time, low, width, limit = doc[on], seed[on], time[on], low[on], width[on], limit[on]
    return sig.reshape(docs, components)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    bits = sig.view(np.uint64)
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        state = np.full(len(sig), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            state = mix(state * GOLD + bits[:, r])
        out[:, b] = state
    return out.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text); the key tells rows of one doc_id with different texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def text_key() -> Column:
    return F.xxhash64("text")


def signatures(docs: DataFrame, components: int = COMPONENTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, text_key, d1, d2, keys): a 128-bit digest of the words and the band keys of each text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch, texts in text_slices(batches):
            n = len(texts)
            doc, h = shingles(texts, words)
            packed, count = np.unique((doc.astype(np.uint64) << _U(48)) | (h >> _U(16)), return_counts=True)
            of = (packed >> _U(48)).astype(np.int64)
            sig = bag_minhash(of, mix(packed & _U((1 << 48) - 1)), count, n, components)
            has = np.isfinite(sig[:, 0])
            digest = np.array([(d & (1 << 64) - 1, d >> 64) for d in (xxhash.xxh3_128_intdigest(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")) for t in texts)], np.uint64).reshape(n, 2).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_keys(sig, bands)[has].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), keys], ["doc_id", "text_key", "d1", "d2", "keys"])

    return _rows(docs).mapInArrow(run, "doc_id long, text_key long, d1 long, d2 long, keys array<long>")


def bags(texts: DataFrame) -> DataFrame:
    """(id, bag) from (id, text): the 64-bit hashes of a text's shingles, numbered by occurrence, as bytes.

    The overlap of two bags as sets is the overlap of the shingle multisets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch, texts in text_slices(batches):
            doc, h = shingles(texts, words)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            index = np.arange(len(h))
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(h)]
            number = index - np.maximum.accumulate(np.where(fresh, index, 0)) if len(h) else index
            code = mix(h + GOLD * number.astype(np.uint64)).astype("<u8")
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([code[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["id", "bag"])

    return texts.select("id", "text").mapInArrow(run, "id long, bag binary")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted Jaccard similarity of each pair of bags."""
    for big in batches:
        for start in range(0, big.num_rows, 500):
            batch = big.slice(start, 500)
            n = batch.num_rows
            parts, sizes = [], []
            for name in ("bag_a", "bag_b"):
                arrays = [np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(name)]
                size = np.fromiter(map(len, arrays), np.int64, n)
                parts.append((np.repeat(np.arange(n, dtype=np.uint64), size) << _U(55)) | (np.concatenate(arrays) >> _U(9)))
                sizes.append(size)
            code = np.sort(np.concatenate(parts))
            both = np.bincount((code[1:][code[1:] == code[:-1]] >> _U(55)).astype(np.int64), minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both / np.maximum(sizes[0] + sizes[1] - both, 1))], ["a", "b", "j"])


def verify(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """(a, b, j) for pairs (a, b) of class ids, from (id, bag)."""
    first = pairs.join(contents.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    both = first.join(contents.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(_overlap, "a long, b long, j double")


def near_rows(docs: DataFrame, threshold: float = THRESHOLD, components: int = COMPONENTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, text_key, class_id, kept) of every row; see ``near_dups``.

    ``text_key`` is null for rows whose doc_id or text is null.
    """
    signed = cut(signatures(docs, components, bands))
    classes = signed.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key", "keys")).alias("least"))
    classes = cut(classes.select("d1", "d2", F.monotonically_increasing_id().alias("rep"), "least.*"))
    filed = classes.select("rep", F.explode("keys").alias("bucket"))
    # Sums that are joined back come from checkpoints: both sides are then shuffled for the join, and a hot key can be split.
    sizes = cut(filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).where("n > 1"))
    members = cut(filed.join(sizes, "bucket"))
    wanted = members.select("rep").distinct().join(classes, "rep").select(F.col("rep").alias("id"), F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))
    wanted = cut(wanted)
    few = wanted.count() <= BROADCAST_ROWS
    texts = _rows(docs).join(F.broadcast(wanted) if few else wanted, (F.col("doc_id") == F.col("of_doc")) & (F.col("text_key") == F.col("of_text")))
    # Rows that repeat a document give its bag again.
    contents = cut(bags(texts).dropDuplicates(["id"]))

    # Skewed joins leave far more partitions than there are configured; each read and each shuffle of them would start as many tasks.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_hub = cut(verify(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), contents)).coalesce(parts)
    nearest = cut(members.where("n > 2").join(by_hub, (F.col("hub") == F.col("a")) & (F.col("rep") == F.col("b"))).groupBy("bucket").agg(F.max(F.struct("j", F.negate("rep").alias("rep"))).alias("best")).select("bucket", F.negate("best.rep").alias("next")))
    second = members.join(nearest, "bucket").where("rep <> next AND rep <> hub").select(F.col("next").alias("a"), F.col("rep").alias("b")).distinct()
    by_next = cut(verify(second.join(by_hub, ["a", "b"], "left_anti"), contents)).coalesce(parts)
    linked = by_hub.where(F.col("j") >= threshold).union(by_next.where(F.col("j") >= threshold)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(linked)

    # What is still apart from its bucket's hub meets all members around the hub's component.
    named = members.where("n > 2").join(found, F.col("rep") == F.col("id"), "left").select("bucket", "rep", F.col("rep") == F.col("hub"), F.coalesce("component", "rep").alias("component"))
    named = named.toDF("bucket", "rep", "is_hub", "component")
    homes = named.where("is_hub").select(F.col("bucket").alias("of"), F.col("component").alias("home"))
    around = cut(named.join(homes, F.col("bucket") == F.col("of")).groupBy("home", "rep").agg(F.max(F.col("component") != F.col("home")).alias("apart")))
    last = cut(_meet(around, contents, threshold))
    known = found.where("id <> component").select(F.col("id").alias("src"), F.col("component").alias("dst"))
    found = connected_components(known.union(last.coalesce(parts))) if last.limit(1).count() else found

    # A class that is in no component stands for itself; the others take the least document of their component.
    heads = classes.join(found, F.col("rep") == F.col("id")).groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("head"))
    heads = found.join(heads, "component").select("id", "head")
    classes = classes.join(heads, F.col("rep") == F.col("id"), "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("head", F.struct("doc_id", "text_key")).alias("head"))
    named = signed.join(classes, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")))
    named = named.select("doc_id", "text_key", F.col("head.doc_id").alias("class_id"), (F.struct("doc_id", "text_key") == F.col("head")).alias("kept"))
    lone = docs.where("doc_id IS NULL OR text IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    return named.union(lone.select("doc_id", F.lit(None).cast("long"), "doc_id", F.lit(True)))


def near_dups(docs: DataFrame, threshold: float = THRESHOLD, components: int = COMPONENTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, kept) of every row; class_id is the least doc_id of its group of near-duplicates.

    Texts are compared by their words in lower case. Texts without words are equal to each other. A null
    text is in no group (class_id is its doc_id); a null doc_id has a null class_id and is kept. Rows of
    one doc_id with different texts are documents of their own, of which a group keeps one; rows that
    repeat a doc_id with an equal text are the same document and are kept alike. An empty table gives
    no rows; further columns are ignored.
    """
    return near_rows(docs, threshold, components, bands).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of each group stays.

    That is a row of the group's least (doc_id, text key). Rows with a null doc_id or text stay. Column
    names may be any.
    """
    rows = near_rows(docs.select("doc_id", "text"), threshold).where("text_key IS NOT NULL")
    fate = cut(rows.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT kept"))
    inner = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    text = F.col(inner["text"])
    marked = docs.toDF(*inner.values()).withColumn("key", F.xxhash64(text))
    same = (F.col(inner["doc_id"]).cast("long") == F.col("doc_id")) & (F.col("key") == F.col("text_key")) & text.isNotNull()
    stay = marked.join(fate, same, "left_anti")
    repeated = fate.where("kept")
    if repeated.limit(1).count():
        stay = stay.union(marked.join(repeated, same, "left_semi").dropDuplicates([inner["doc_id"], "key"]))
    return stay.select(*inner.values()).toDF(*inner)


def _meet(around: DataFrame, contents: DataFrame, threshold: float, block: tuple[int, int] = BLOCK, block_bytes: tuple[int, int] = BLOCK_BYTES) -> DataFrame:
    """Links (src, dst) between members apart from a home component and all members around it.

    A home is cut into so many blocks that their sides hold about ``block`` members and ``block_bytes`` of
    bags; members are dealt to them by a hash.
    """
    weighed = around.join(contents.select(F.col("id"), F.octet_length("bag").alias("bytes")), F.col("rep") == F.col("id"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count(F.when(F.col("apart"), 1)).alias("apart_n"), F.sum(F.when(F.col("apart"), F.col("bytes")).otherwise(0)).alias("apart_bytes")]
    sizes = cut(weighed.groupBy("home").agg(*sums).where("apart_n > 0 AND n > 2"))
    parts = lambda n, at, size: F.greatest(F.ceil(F.col(n) / block[at]), F.ceil(F.col(size) / block_bytes[at]), F.lit(1)).cast("int")
    sizes = sizes.select(F.col("home").alias("h"), parts("apart_n", 0, "apart_bytes").alias("rows"), parts("n", 1, "bytes").alias("cols"))
    own = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = around.join(sizes, F.col("home") == F.col("h"))
    sides = placed.where("apart").select("home", "rep", F.lit(True).alias("is_row"), own("rows").alias("r"), every("cols").alias("c"))
    sides = sides.union(placed.select("home", "rep", F.lit(False), every("rows"), own("cols")))
    filled = sides.join(contents, F.col("rep") == F.col("id")).withColumn("r", F.explode("r")).withColumn("c", F.explode("c"))
    key = ["home", "r", "c"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, key):
            found = _links(group, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["src", "dst"])

    return filled.select(*key, "is_row", "rep", "bag").repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "src long, dst long")


def _links(group: pa.RecordBatch, threshold: float, width: int = 2048) -> tuple[np.ndarray, np.ndarray] | None:
    """A spanning forest of the links between row and column members whose bags overlap by ``threshold``."""
    is_row = group.column("is_row").to_numpy(zero_copy_only=False)
    ids = group.column("rep").to_numpy()
    bags_ = [np.frombuffer(v.as_buffer(), "<u8") for v in group.column("bag")]
    rows, cols = np.flatnonzero(is_row), np.flatnonzero(~is_row)
    if not len(rows) or not len(cols):
        return None
    size = np.fromiter(map(len, bags_), np.int64, len(bags_))
    code = np.concatenate(bags_)
    owner = np.repeat(np.arange(len(bags_)), size)
    # Elements of a single text cannot overlap; a text may be both a row and a column.
    names, slot = np.unique(code, return_inverse=True)
    texts = np.unique(slot.astype(np.uint64) << _U(32) | np.unique(ids, return_inverse=True)[1][owner].astype(np.uint64))
    shared = np.bincount((texts >> _U(32)).astype(np.int64), minlength=len(names)) > 1
    slot_of = np.cumsum(shared) - 1
    on = shared[slot]
    slot, owner = slot_of[slot[on]], owner[on]
    both = np.zeros((len(rows), len(cols)), np.float32)
    line = np.full(len(bags_), -1)
    line[rows], line[cols] = np.arange(len(rows)), np.arange(len(cols))
    order = np.argsort(slot, kind="stable")
    slot, owner = slot[order], owner[order]
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(slot, [a, a + width])
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        o, s = owner[lo:hi], slot[lo:hi] - a
        left[line[o[is_row[o]]], s[is_row[o]]] = 1
        right[line[o[~is_row[o]]], s[~is_row[o]]] = 1
        both += left @ right.T
    near = both >= threshold * (size[rows][:, None] + size[cols][None, :] - both)
    near &= ids[rows][:, None] != ids[cols][None, :]
    r, c = near.any(1), near.any(0)
    return spanning(ids[rows[r]], ids[cols[c]], near[np.ix_(r, c)]) if r.any() else None


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Every link by exact overlap, a pair of texts for every shingle that they share: for small tables only.
OP1_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS folded
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
classes AS (SELECT folded, min(doc_id) AS rep, string_split(folded, ' ') AS words FROM texts GROUP BY folded),
shingles AS (
  SELECT rep, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT rep, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM classes WHERE folded <> '')),
elements AS (SELECT rep, shingle, row_number() OVER (PARTITION BY rep, shingle) AS k FROM shingles),
sizes AS (SELECT rep, count(*) AS n FROM shingles GROUP BY rep),
shared AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS n
  FROM elements a JOIN elements b ON a.shingle = b.shingle AND a.k = b.k AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (
  SELECT a, b FROM shared o JOIN sizes x ON x.rep = o.a JOIN sizes y ON y.rep = o.b
  WHERE 5 * o.n >= 4 * (x.n + y.n - o.n)),
edges AS (SELECT a AS src, b AS dst FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT rep AS node, rep AS label FROM classes
  UNION
  SELECT e.dst, r.label FROM reached r JOIN edges e ON e.src = r.node WHERE r.label < e.dst),
labels_of AS (SELECT node, min(label) AS class_id FROM reached GROUP BY node)
SELECT t.doc_id, l.class_id, t.doc_id = l.class_id AS kept
FROM texts t JOIN classes c ON c.folded = t.folded JOIN labels_of l ON l.node = c.rep
UNION ALL SELECT doc_id, doc_id, true FROM documents WHERE doc_id IS NULL OR text IS NULL
"""

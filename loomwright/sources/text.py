"""Text sources: lines, edge lists, adjacency lists, baskets, byte counts and key listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, partitions: int | None = None, recursive: bool = False) -> DataFrame:
    """(value) per line; ``partitions`` deals the lines anew, ``recursive`` looks into nested folders."""
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    return lines.repartition(partitions) if partitions else lines


def tokens(line: Column, sep: str = r"\s+") -> Column:
    return F.split(line, sep)


def edge_list(lines: DataFrame, sep: str = r"\s+") -> DataFrame:
    """(src, dst) of two-column lines; blank lines and those that begin with # are skipped."""
    rows = lines.where("trim(value) <> '' AND NOT startswith(value, '#')").select(tokens(F.trim("value"), sep).alias("t"))
    return rows.select(F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"))


def adjacency(lines: DataFrame, sep: str = r"\s+") -> DataFrame:
    """(src, dsts) of lines ``src n1 n2 ...``; a token that is no number fails the query. Rows without neighbours stay."""
    rows = lines.where("trim(value) <> ''").select(F.transform(tokens(F.trim("value"), sep), lambda x: x.cast("long")).alias("t"))
    return rows.select(F.col("t")[0].alias("src"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("dsts"))


def adjacency_edges(rows: DataFrame) -> DataFrame:
    """One (src, dst) for each neighbour; a row without neighbours gives none."""
    return rows.select("src", F.explode("dsts").alias("dst"))


def load_graph(spark: SparkSession, path: str, kind: str, partitions: int | None = None) -> DataFrame:
    """Edges of an edge list (``edges``) or an adjacency list (``adjLists``)."""
    lines = read_lines(spark, path, partitions)
    if kind == "edges":
        return edge_list(lines)
    if kind == "adjLists":
        return adjacency_edges(adjacency(lines))
    raise ValueError(f"unknown graph kind: {kind}")


def baskets(lines: DataFrame, sep: str = r"\s+") -> DataFrame:
    """(tid, items): the distinct whole numbers of each line, ascending; other tokens are dropped.

    A blank line is an empty basket, which counts in the number of baskets.
    """
    numbers = F.filter(F.transform(tokens(F.col("value"), sep), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return lines.select(F.monotonically_increasing_id().alias("tid"), F.sort_array(F.array_distinct(numbers)).alias("items"))


def bad_tokens(lines: DataFrame, sep: str = r"\s+") -> Column | DataFrame:
    """The number of tokens that are no whole number, over all lines (empty ones from leading blanks too)."""
    parts = tokens(F.col("value"), sep)
    return lines.select(F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + F.when(x.try_cast("int").isNull(), 1).otherwise(0)).alias("bad")).agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def byte_counts(lines: DataFrame) -> DataFrame:
    """(key, bytes) of lines ``k1 [k2 ...] bytes``; the key's tokens are joined without a separator."""
    rows = lines.where("trim(value) <> ''").select(tokens(F.trim("value")).alias("t"))
    return rows.select(F.array_join(F.slice("t", F.lit(1), F.size("t") - 1), "").alias("key"), F.element_at("t", -1).cast("long").alias("bytes"))


def file_sizes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length) of the files that a pattern matches, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", "length")


def _in_tree(path: Column) -> list[Column]:
    parts = F.split(path, "/")
    return [F.element_at(parts, k).alias(name) for k, name in ((-4, "app"), (-3, "stage"), (-2, "dependency"))]


def key_files(spark: SparkSession, root: str) -> DataFrame:
    """(app, stage, dependency, key) of a tree ``root/app/stage/dependency/part`` with a key on each line."""
    return spark.read.option("recursiveFileLookup", True).text(root).select(*_in_tree(F.col("_metadata.file_path")), F.col("value").alias("key"))


def key_file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(app, stage, dependency, bytes) of each file of such a tree."""
    return file_sizes(spark, root).select(*_in_tree(F.col("path")), F.col("length").alias("bytes"))


def register_views(spark: SparkSession, folder: str, names: list[str] | None = None, fmt: str = "parquet") -> list[str]:
    """Temporary views over the tables of a folder, all of them unless named; returns their names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [f.getPath().getName() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    tables = {n.removesuffix(f".{fmt}"): n for n in sorted(found) if not n.startswith(("_", "."))}
    for name in names or tables:
        spark.read.format(fmt).load(f"{folder}/{tables[name]}").createOrReplaceTempView(name)
    return list(names or tables)

"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..graph.components import connected_components as components_of
from ..graph.pagerank import adjacency_pagerank, static_pagerank
from ..mining import itemsets
from ..operators import profile as keys
from ..session import cut, table
from ..sources import text
from ..tuner import profile as tasks
from . import log_queries, workloads

#: Share of baskets that an itemset must exceed.
MIN_SUPPORT = 0.0015
PAGERANK_ITERATIONS = 10


def _visits(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_suppkey").alias("sourceIP"), F.col("l_partkey").alias("destURL"), F.col("l_shipdate").alias("visitDate"), F.col("l_extendedprice").cast("decimal(18,2)").alias("adRevenue"))


def aggregation_revenue(spark: SparkSession, d: str) -> DataFrame:
    return workloads.revenue_by_source(_visits(spark, d)).select("sourceIP", F.col("sumAdRevenue").cast("double").alias("sumAdRevenue"))


def join_rankings_visits(spark: SparkSession, d: str) -> DataFrame:
    rankings = table(spark, d, "part").select(F.col("p_partkey").alias("pageURL"), F.col("p_size").alias("pageRank"))
    out = workloads.ranked_visits(rankings, _visits(spark, d))
    return out.select("sourceIP", F.round("avgPageRank", 6).alias("avgPageRank"), F.col("totalRevenue").cast("double").alias("totalRevenue"))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("item"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("tid")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _named(sets: DataFrame) -> DataFrame:
    return sets.select(F.array_join(F.sort_array("items"), ",").alias("items"), F.col("support").cast("long").alias("support"))


def item_frequency(spark: SparkSession, d: str) -> DataFrame:
    baskets = cut(_baskets(spark, d))
    return itemsets.item_frequencies(baskets, itemsets.min_count(baskets, MIN_SUPPORT)[1])


def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _named(itemsets.levelwise(_baskets(spark, d), MIN_SUPPORT))


def fpgrowth_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _named(itemsets.fp_growth(_baskets(spark, d), MIN_SUPPORT))


def projected_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _named(itemsets.projected(_baskets(spark, d), MIN_SUPPORT))


def parsed_baskets(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.translate("p_brand", "#", " ").alias("value"), "p_size", "p_partkey")
    lines = lines.select(F.concat_ws(" ", "value", F.col("p_size").cast("string"), F.lit("x"), F.col("p_size").cast("string")).alias("value"))
    return text.baskets(lines).groupBy(F.array_join("items", ",").alias("items")).agg(F.count(F.lit(1)).alias("n"))


def bad_token_count(spark: SparkSession, d: str) -> DataFrame:
    return text.bad_tokens(table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("value")), " ")


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """From the customer's to the supplier's nation, an edge for each line, parallel ones too."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders, customer, supplier = (table(spark, d, t) for t in ("orders", "customer", "supplier"))
    rows = (
        line.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return rows.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))


def _trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links both ways between customers and the suppliers (1,000,000,000 + key) of all their lines."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("customer"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("customer", (F.col("l_suppkey").cast("long") + 1_000_000_000).alias("supplier")).distinct()
    return rows.select(F.explode(F.array(F.struct(F.col("customer").alias("src"), F.col("supplier").alias("dst")), F.struct(F.col("supplier").alias("src"), F.col("customer").alias("dst")))).alias("e")).select("e.*")


def pagerank_10(spark: SparkSession, d: str) -> DataFrame:
    return adjacency_pagerank(_nation_edges(spark, d), PAGERANK_ITERATIONS).select("id", F.round("rank", 6).alias("rank"))


def pagerank_reset(spark: SparkSession, d: str) -> DataFrame:
    return static_pagerank(_nation_edges(spark, d), PAGERANK_ITERATIONS, 0.15).select("id", F.round("rank", 6).alias("rank"))


def pagerank_10_all(spark: SparkSession, d: str) -> DataFrame:
    return adjacency_pagerank(_trade_edges(spark, d), PAGERANK_ITERATIONS).select("id", F.round("rank", 6).alias("rank"))


def pagerank_reset_all(spark: SparkSession, d: str) -> DataFrame:
    return static_pagerank(_trade_edges(spark, d), PAGERANK_ITERATIONS, 0.15).select("id", F.round("rank", 6).alias("rank"))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Many components: each customer with all their orders (1,000,000,000 + key)."""
    return components_of(table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey").cast("long") + 1_000_000_000).alias("dst")))


def connected_components_all(spark: SparkSession, d: str) -> DataFrame:
    """A giant component: suppliers and parts (1,000,000 + key) over every row of lineitem."""
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))
    return components_of(edges)


def _through_adjacency(edges: DataFrame) -> DataFrame:
    rows = edges.groupBy("src").agg(F.collect_list("dst").alias("dsts"))
    lines = rows.select(F.concat_ws(" ", F.col("src").cast("string"), F.array_join(F.col("dsts").cast("array<string>"), " ")).alias("value"))
    return text.adjacency_edges(text.adjacency(lines))


def adjacency_edges(spark: SparkSession, d: str) -> DataFrame:
    return _through_adjacency(_nation_edges(spark, d))


def adjacency_edges_all(spark: SparkSession, d: str) -> DataFrame:
    return _through_adjacency(_trade_edges(spark, d))


def _through_edge_list(edges: DataFrame) -> DataFrame:
    return text.edge_list(edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")))


def edge_list(spark: SparkSession, d: str) -> DataFrame:
    return _through_edge_list(_nation_edges(spark, d))


def edge_list_all(spark: SparkSession, d: str) -> DataFrame:
    return _through_edge_list(_trade_edges(spark, d))


def byte_count_per_key(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = docs.select(F.concat_ws(" ", "source", "lang", F.col("n_chars").cast("string")).alias("value"))
    return keys.byte_count_per_key(text.byte_counts(lines), F.col("key"), F.col("bytes"))


def key_frequency_sorted(spark: SparkSession, d: str) -> DataFrame:
    return keys.key_frequencies(table(spark, d, "events").select(F.col("user_id").cast("string").alias("user")), "user")


def records_per_key_cdf(spark: SparkSession, d: str) -> DataFrame:
    freq = keys.key_frequencies(table(spark, d, "orders"), "o_custkey")
    return keys.cumulative_shares(freq).select("n", "keys", F.round("cdf", 9).alias("cdf"), F.round("ccdf", 9).alias("ccdf"))


def dedup_by_total(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "events").select(F.col("event_type").alias("app"), (F.col("user_id") % 50).alias("dependency"), F.lit(1).cast("long").alias("bytes"))
    return keys.first_by_total(sizes)


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return keys.sample(table(spark, d, "events"), 0.1, 42)


def tasks_of(spark: SparkSession, d: str) -> DataFrame:
    """Task metrics made from lineitem: a stage for each supplier, a task for each line."""
    whole = lambda c: F.floor(c).cast("long")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("stage_id"), (F.col("l_partkey") % 4).cast("string").alias("executor_id"),
        whole(F.col("l_extendedprice") * F.when(F.col("l_quantity") >= 49, 40).otherwise(1)).alias("run_time"), whole(F.col("l_extendedprice") / 64 * (1 + 63 * (F.col("l_tax") >= 0.08).cast("int"))).alias("gc_time"),
        F.when(F.col("l_quantity") <= 2, 0).otherwise(whole(F.col("l_quantity"))).cast("long").alias("input_records"), (whole(F.col("l_quantity")) * 100).alias("input_bytes"),
        F.when(F.col("l_discount") >= 0.08, whole(F.col("l_extendedprice"))).otherwise(0).cast("long").alias("mem_spilled"), F.lit(0).cast("long").alias("disk_spilled"),
        F.lit(0).cast("long").alias("sr_records"), whole(F.col("l_extendedprice")).alias("sr_bytes"), F.lit(0).cast("long").alias("fetch_wait"),
        whole(F.col("l_quantity")).alias("sw_records"), whole(F.col("l_extendedprice") / 2).alias("sw_bytes"),
    )


_TASKS = """tasks AS (SELECT l_suppkey AS stage_id, CAST(l_partkey % 4 AS VARCHAR) AS executor_id,
  CAST(floor(l_extendedprice * CASE WHEN l_quantity >= 49 THEN 40 ELSE 1 END) AS BIGINT) AS run_time,
  CAST(floor(l_extendedprice / 64 * (1 + 63 * CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END)) AS BIGINT) AS gc_time,
  CASE WHEN l_quantity <= 2 THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS input_records, CAST(floor(l_quantity) AS BIGINT) * 100 AS input_bytes,
  CASE WHEN l_discount >= 0.08 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END AS mem_spilled, 0 AS disk_spilled, 0 AS sr_records,
  CAST(floor(l_extendedprice) AS BIGINT) AS sr_bytes, 0 AS fetch_wait, CAST(floor(l_quantity) AS BIGINT) AS sw_records, CAST(floor(l_extendedprice / 2) AS BIGINT) AS sw_bytes
  FROM lineitem)"""


def task_stats_skew(spark: SparkSession, d: str) -> DataFrame:
    return tasks_of(spark, d).groupBy("stage_id").agg(F.round(stats.sample_skewness(F.col("run_time")), 4).alias("skew"), F.round(stats.max_over_mean(F.col("run_time")), 4).alias("max_over_mean"))


def task_stats_corr(spark: SparkSession, d: str) -> DataFrame:
    return tasks_of(spark, d).groupBy("stage_id").agg(
        F.round(stats.guarded_correlation(F.col("run_time"), F.col("sr_bytes")), 4).alias("corr_bytes"), F.round(stats.guarded_correlation(F.col("run_time"), F.col("sr_records")), 4).alias("corr_records")
    )


def task_stats_percentile(spark: SparkSession, d: str) -> DataFrame:
    return tasks_of(spark, d).groupBy("stage_id").agg(*[F.round(stats.legacy_percentile(F.col("run_time"), q / 4), 4).alias(f"q{q}") for q in (1, 2, 3)])


def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tasks.rollup(tasks_of(spark, d))


def executor_gc(spark: SparkSession, d: str) -> DataFrame:
    return tasks.executor_gc(tasks_of(spark, d)).withColumn("gc_overhead", F.round("gc_overhead", 6))


def empty_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.empty_partitions(tasks.profile(tasks_of(spark, d)))


def spill_partitions(spark: SparkSession, d: str) -> DataFrame:
    return tasks.spill_partitions(tasks.profile(tasks_of(spark, d)))


def gc_partitions(spark: SparkSession, d: str) -> DataFrame:
    return tasks.gc_partitions(tasks.profile(tasks_of(spark, d)))


def imbalance_source(spark: SparkSession, d: str) -> DataFrame:
    return tasks.imbalance(tasks.profile(tasks_of(spark, d)))


def iterative_regular_class(spark: SparkSession, d: str) -> DataFrame:
    """Event types as points, hours as instances: iterative if seen in several, regular if each reads about as much as the one before."""
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("point"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("records"))
    before = F.lag("records").over(Window.partitionBy("point").orderBy("hour"))
    near = F.least("records", before) / F.greatest("records", before) >= 0.9
    return runs.withColumn("near", F.coalesce(near, F.lit(True))).groupBy("point").agg((F.count(F.lit(1)) > 1).alias("iterative"), F.bool_and("near").alias("regular"))


QUERIES = {
    f.__name__: f
    for f in (
        aggregation_revenue, join_rankings_visits, item_frequency, frequent_itemsets, fpgrowth_itemsets, projected_itemsets, parsed_baskets, bad_token_count,
        pagerank_10, pagerank_10_all, pagerank_reset, pagerank_reset_all, connected_components, connected_components_all, adjacency_edges, adjacency_edges_all, edge_list, edge_list_all, byte_count_per_key, key_frequency_sorted, records_per_key_cdf, dedup_by_total,
        sample_rows, task_stats_skew, task_stats_corr, task_stats_percentile, stage_rollup, executor_gc, empty_tasks, spill_partitions, gc_partitions, imbalance_source, iterative_regular_class,
    )
} | log_queries.QUERIES

_BASKETS = f"""b AS (SELECT DISTINCT l_orderkey AS tid, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT CAST(floor({MIN_SUPPORT} * count(DISTINCT tid)) AS BIGINT) AS min_count FROM b),
f1 AS (SELECT item, count(*) AS support FROM b GROUP BY item HAVING count(*) > (SELECT min_count FROM m)),
t AS (SELECT b.tid, b.item FROM b JOIN f1 USING (item))"""


def _itemset_sql(largest: int = 6) -> str:
    parts = ["SELECT CAST(item AS VARCHAR) AS items, support FROM f1"]
    for k in range(2, largest + 1):
        names = " || ',' || ".join(f"CAST(t{i}.item AS VARCHAR)" for i in range(k))
        joins = " ".join(f"JOIN t t{i} ON t{i}.tid = t0.tid AND t{i - 1}.item < t{i}.item" for i in range(1, k))
        parts.append(f"SELECT {names} AS items, count(*) AS support FROM t t0 {joins} GROUP BY ALL HAVING count(*) > (SELECT min_count FROM m)")
    return f"WITH {_BASKETS}\n" + "\nUNION ALL ".join(parts)


_NATIONS = """e AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT src, count(*) AS degree FROM e GROUP BY src)"""
_TRADE = """t AS MATERIALIZED (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) + 1000000000 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS MATERIALIZED (SELECT a AS src, b AS dst FROM t UNION ALL SELECT b, a FROM t),
g AS (SELECT src, count(*) AS degree FROM e GROUP BY src)"""


def _pagerank_sql(edges: str, keep_all: bool) -> str:
    if keep_all:
        steps = ["r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM (SELECT src AS id FROM e UNION SELECT dst FROM e))"]
        step = "r{1} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.rank / g.degree), 0) AS rank FROM r0 v LEFT JOIN e ON e.dst = v.id LEFT JOIN r{0} r ON r.id = e.src LEFT JOIN g ON g.src = e.src GROUP BY v.id)"
    else:
        steps = ["r0 AS (SELECT src AS id, 1.0::DOUBLE AS rank FROM g)"]
        step = "r{1} AS MATERIALIZED (SELECT e.dst AS id, 0.15 + 0.85 * sum(r.rank / g.degree) AS rank FROM e JOIN r{0} r ON r.id = e.src JOIN g ON g.src = e.src GROUP BY e.dst)"
    steps += [step.format(k, k + 1) for k in range(PAGERANK_ITERATIONS)]
    return f"WITH {edges},\n" + ",\n".join(steps) + f"\nSELECT id, round(rank, 6) AS rank FROM r{PAGERANK_ITERATIONS}"


def _components_sql(edges: str, rounds: int = 12) -> str:
    """Least labels passed along the edges of ``e`` (a, b), for graphs in which no path needs more than ``rounds`` steps."""
    steps = ["u AS MATERIALIZED (SELECT a AS s, b AS t FROM e UNION SELECT b, a FROM e)", "c0 AS MATERIALIZED (SELECT DISTINCT s AS id, s AS component FROM u)"]
    step = "c{1} AS MATERIALIZED (SELECT id, min(component) AS component FROM (SELECT id, component FROM c{0} UNION ALL SELECT u.s, c.component FROM u JOIN c{0} c ON c.id = u.t) GROUP BY id)"
    steps += [step.format(k, k + 1) for k in range(rounds)]
    return f"WITH e AS MATERIALIZED ({edges}),\n" + ",\n".join(steps) + f"\nSELECT id, component FROM c{rounds}"


_PROFILE = f"""{_TASKS},
x AS (SELECT *, CASE WHEN run_time <> 0 THEN CAST(gc_time AS DOUBLE) / run_time END AS gc FROM tasks)"""


def _percentile(column: str, q: int) -> str:
    v, n = f"list_sort(list({column}::DOUBLE))", f"count({column})"
    pos = f"({q / 4} * ({n} + 1))"
    low = f"CAST(floor({pos}) AS BIGINT)"
    return f"CASE WHEN {pos} < 1 THEN {v}[1] WHEN {pos} >= {n} THEN {v}[{n}] ELSE {v}[{low}] + ({pos} - {low}) * ({v}[{low} + 1] - {v}[{low}]) END"


def _corr(y: str) -> str:
    return f"CASE WHEN sum(run_time) = 0 OR sum({y}) = 0 THEN 0.0 WHEN min(run_time) = max(run_time) OR min({y}) = max({y}) OR count(*) < 2 THEN 1.0 ELSE corr(run_time, {y}) END"


_SUMS = ("run_time", "gc_time", "input_records", "input_bytes", "mem_spilled", "disk_spilled", "sr_records", "sr_bytes", "fetch_wait", "sw_records", "sw_bytes")
_ITEMSETS = _itemset_sql()

ORACLE_SQL = {
    "aggregation_revenue": "SELECT l_suppkey AS sourceIP, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sumAdRevenue FROM lineitem GROUP BY l_suppkey",
    "join_rankings_visits": """SELECT l_suppkey AS sourceIP, round(avg(p_size), 6) AS avgPageRank, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS totalRevenue
        FROM part JOIN lineitem ON p_partkey = l_partkey
        WHERE date_diff('day', DATE '1999-01-01', CAST(l_shipdate AS DATE)) >= 0 AND date_diff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)) <= 0
        GROUP BY l_suppkey ORDER BY totalRevenue DESC""",
    "item_frequency": f"WITH {_BASKETS} SELECT item, support FROM f1",
    "frequent_itemsets": _ITEMSETS,
    "fpgrowth_itemsets": _ITEMSETS,
    "projected_itemsets": _ITEMSETS,
    "parsed_baskets": """SELECT CASE WHEN a = b THEN a::VARCHAR ELSE least(a, b) || ',' || greatest(a, b) END AS items, count(*) AS n
        FROM (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS a, p_size AS b FROM part) GROUP BY 1""",
    "bad_token_count": "SELECT count(*) AS bad FROM (SELECT unnest(string_split(p_name || ' ' || p_size, ' ')) AS t FROM part) WHERE TRY_CAST(t AS INTEGER) IS NULL",
    "pagerank_10": _pagerank_sql(_NATIONS, False),
    "pagerank_10_all": _pagerank_sql(_TRADE, False),
    "pagerank_reset": _pagerank_sql(_NATIONS, True),
    "pagerank_reset_all": _pagerank_sql(_TRADE, True),
    "connected_components": _components_sql("SELECT CAST(o_custkey AS BIGINT) AS a, CAST(o_orderkey AS BIGINT) + 1000000000 AS b FROM orders"),
    "connected_components_all": _components_sql("SELECT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem"),
    "adjacency_edges": f"WITH {_NATIONS} SELECT src, dst FROM e",
    "adjacency_edges_all": f"WITH {_TRADE} SELECT src, dst FROM e",
    "edge_list": f"WITH {_NATIONS} SELECT src, dst FROM e",
    "edge_list_all": f"WITH {_TRADE} SELECT src, dst FROM e",
    "byte_count_per_key": "SELECT source || lang AS key, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "key_frequency_sorted": "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY 1",
    "records_per_key_cdf": """WITH f AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT n, count(*) AS keys FROM f GROUP BY n)
        SELECT n, keys, round(sum(n * keys) OVER (ORDER BY n) / sum(n * keys) OVER (), 9) AS cdf, round(1 - sum(n * keys) OVER (ORDER BY n) / sum(n * keys) OVER (), 9) AS ccdf FROM k""",
    "dedup_by_total": """WITH t AS (SELECT event_type AS app, user_id % 50 AS dependency, count(*) AS total FROM events GROUP BY ALL)
        SELECT app, total, dependency FROM (SELECT *, row_number() OVER (PARTITION BY app, total ORDER BY dependency) AS k FROM t) WHERE k = 1""",
    "task_stats_skew": f"WITH {_TASKS} SELECT stage_id, round(skewness(run_time), 4) AS skew, round(CASE WHEN avg(run_time) = 0 THEN 1.0 ELSE max(run_time) / avg(run_time) END, 4) AS max_over_mean FROM tasks GROUP BY stage_id",
    "task_stats_corr": f"WITH {_TASKS} SELECT stage_id, round({_corr('sr_bytes')}, 4) AS corr_bytes, round({_corr('sr_records')}, 4) AS corr_records FROM tasks GROUP BY stage_id",
    "task_stats_percentile": f"WITH {_TASKS} SELECT stage_id, {', '.join(f'round({_percentile("run_time", q)}, 4) AS q{q}' for q in (1, 2, 3))} FROM tasks GROUP BY stage_id",
    "stage_rollup": f"""WITH {_TASKS} SELECT stage_id, count(*) AS num_tasks, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)},
        CAST(sum(input_records + sr_records) AS BIGINT) AS records_read, CAST(sum(input_bytes + sr_bytes) AS BIGINT) AS records_read_bytes, CAST(sum(mem_spilled + disk_spilled) AS BIGINT) AS bytes_spilled FROM tasks GROUP BY stage_id""",
    "executor_gc": f"WITH {_TASKS} SELECT stage_id, executor_id, CAST(sum(gc_time) AS BIGINT) AS gc_time, round(CASE WHEN sum(run_time) <> 0 THEN CAST(sum(gc_time) AS DOUBLE) / CAST(sum(run_time) AS DOUBLE) END, 6) AS gc_overhead FROM tasks GROUP BY ALL",
    "empty_tasks": f"WITH {_TASKS} SELECT stage_id, greatest(1, count(*) - count(*) FILTER (WHERE input_records + sr_records = 0)) AS partitions FROM tasks GROUP BY stage_id HAVING count(*) FILTER (WHERE input_records + sr_records = 0) > 0",
    "spill_partitions": f"WITH {_TASKS} SELECT stage_id, CAST(count(*) + ceil(CAST(sum(mem_spilled + disk_spilled) AS DOUBLE) / CAST(sum(sw_bytes) AS DOUBLE) * count(*)) AS BIGINT) AS partitions FROM tasks GROUP BY stage_id HAVING sum(sw_bytes) > 0 AND sum(mem_spilled + disk_spilled) > 0",
    "gc_partitions": f"""WITH {_PROFILE},
        p AS (SELECT stage_id, CASE WHEN count(gc) = count(*) THEN skewness(gc) END AS skew, {_percentile('gc', 2)} AS q2, {_percentile('gc', 3)} AS q3 FROM x GROUP BY stage_id),
        t AS (SELECT stage_id, least(CASE WHEN q2 > 0 THEN q2 END, CASE WHEN q3 > 0 THEN q3 END) AS target FROM p WHERE skew > 1.5)
        SELECT stage_id, CAST(sum(greatest(1, ceil(gc / target))) AS BIGINT) AS partitions FROM x JOIN t USING (stage_id) WHERE target IS NOT NULL GROUP BY stage_id""",
    "imbalance_source": f"""WITH {_TASKS}, p AS (SELECT stage_id, skewness(run_time) AS skew, {_corr('sr_bytes')} AS cb, {_corr('sr_records')} AS cr FROM tasks GROUP BY stage_id)
        SELECT stage_id, CASE WHEN cb >= 0.8 AND cr >= 0.8 THEN 'key' WHEN cb < 0.8 AND cr < 0.8 THEN 'inherent' ELSE 'variable' END AS source FROM p WHERE skew > 1.5""",
    "iterative_regular_class": """WITH r AS (SELECT event_type AS point, date_trunc('hour', ts) AS hour, count(*) AS records FROM events GROUP BY ALL),
        n AS (SELECT point, coalesce(least(records, p) / greatest(records, p) >= 0.9, true) AS near FROM (SELECT *, lag(records) OVER (PARTITION BY point ORDER BY hour) AS p FROM r))
        SELECT point, count(*) > 1 AS iterative, bool_and(near) AS regular FROM n GROUP BY point""",
} | log_queries.ORACLE_SQL

"""Command line: mining, graphs, key profiles and tuning plans over files.

    python -m loomwright.cli itemsets --input FILE [--miner levelwise] [--min-support 0.5] [--sep REGEX] [--output DIR]
    python -m loomwright.cli pagerank --input FILE [--kind edges] [--iterations 10] [--static] [--reset 0.15]
    python -m loomwright.cli components --input FILE [--kind edges]
    python -m loomwright.cli keys --input DIR [--output DIR]
    python -m loomwright.cli query --input DIR --name NAME --sql FILE [--iterations 3]
    python -m loomwright.cli bytes --input GLOB --output DIR
    python -m loomwright.cli sample --input FILE --fraction 0.1 [--seed 42]
    python -m loomwright.cli plan --log EVENT_LOG [--policies default|legacy] [--output FILE]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple[str, dict]) -> None:
        s = sub.add_parser(name)
        for flag, more in options:
            s.add_argument(flag, **more)

    source, out = ("--input", {"required": True}), ("--output", {})
    kind = ("--kind", {"default": "edges", "choices": ["edges", "adjLists"]})
    parts = ("--partitions", {"type": int, "nargs": "*"})
    add("itemsets", source, out, ("--miner", {"default": "levelwise", "choices": ["levelwise", "projected", "fpgrowth"]}), ("--min-support", {"type": float, "default": 0.5}), ("--sep", {"default": r"\s+"}), ("--rho", {"type": int, "default": 2}), ("--mu", {"type": int, "default": 0}), parts)
    add("pagerank", source, out, kind, ("--iterations", {"type": int, "default": 10}), ("--static", {"action": "store_true"}), ("--reset", {"type": float, "default": 0.15}))
    add("components", source, out, kind)
    add("keys", source, out)
    add("query", source, ("--name", {"required": True}), ("--sql", {"required": True}), ("--iterations", {"type": int, "default": 3}))
    add("bytes", source, ("--output", {"required": True}))
    add("sample", source, ("--fraction", {"type": float, "required": True}), ("--seed", {"type": int, "default": 42}))
    add("plan", ("--log", {"required": True}), out, ("--policies", {"default": "default", "choices": ["default", "legacy"]}), ("--only-adaptive", {"action": "store_true"}))
    return p


def _show(df: DataFrame, path: str | None) -> None:
    if path:
        df.write.parquet(path)
    else:
        df.show(50, truncate=False)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    from .graph.components import connected_components
    from .graph.pagerank import adjacency_pagerank, static_pagerank
    from .mining import itemsets
    from .plans import workloads
    from .operators import profile
    from .sinks import text as sinks
    from .sources import text
    from .tuner import actions, planner
    from .tuner.apply import analyze

    if a.command == "itemsets":
        baskets = text.baskets(text.read_lines(spark, a.input, a.partitions[0] if a.partitions else None), a.sep)
        if a.miner == "levelwise":
            found = itemsets.levelwise(baskets, a.min_support, a.partitions)
        elif a.miner == "projected":
            found = itemsets.projected(baskets, a.min_support, a.rho, a.mu, a.partitions[-1] if a.partitions else None)
        else:
            found = itemsets.fp_growth(baskets, a.min_support, a.partitions[-1] if a.partitions else None)
        if a.output:
            sinks.write_itemsets(found, a.output)
        else:
            _show(found.orderBy(F.size("items"), "items"), None)
    elif a.command == "pagerank":
        edges = text.load_graph(spark, a.input, a.kind)
        ranks = static_pagerank(edges, a.iterations, a.reset) if a.static else adjacency_pagerank(edges, a.iterations)
        _show(ranks if a.output else ranks.orderBy(F.desc("rank")), a.output)
    elif a.command == "components":
        found = connected_components(text.load_graph(spark, a.input, a.kind))
        print(json.dumps({"vertices": found.count(), "components": found.select("component").distinct().count()}))
        _show(found, a.output)
    elif a.command == "keys":
        found = profile.keys_by_dependency(text.key_files(spark, a.input), text.key_file_sizes(spark, a.input))
        sinks.write_key_tree(found, a.output or a.input.rstrip("/").replace("keydist", "keydist-aggregated"))
    elif a.command == "query":
        text.register_views(spark, a.input)
        with open(a.sql) as lines:
            print(json.dumps(workloads.run_benchmark(spark, a.name, {a.name: lines.read()}, a.iterations)))
    elif a.command == "bytes":
        rows = text.byte_counts(text.read_lines(spark, a.input))
        sinks.write_byte_counts(profile.byte_count_per_key(rows, F.col("key"), F.col("bytes")), a.output)
    elif a.command == "sample":
        print(sinks.write_sample(text.read_lines(spark, a.input), a.input, a.fraction, a.seed))
    else:
        plan = analyze(spark, a.log, planner.LEGACY if a.policies == "legacy" else planner.DEFAULT, a.only_adaptive)
        if a.output:
            actions.save(plan, a.output)
        for point, steps in plan.items():
            print(point, *(f"{s.kind}:{s.num_partitions or s.partitioner or s.message or s.policy}" for s in steps))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName(f"loomwright-{args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()

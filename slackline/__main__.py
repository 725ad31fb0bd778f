"""Command line: ``python -m slackline COMMAND ...``; graphs are text files or folders of them."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from slackline.operators import graph, metrics, paths
from slackline.plans.phases import Phases
from slackline.sources import graph_text


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="slackline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, say: str, *rest: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=say)
        made.add_argument("graph")
        for x in rest:
            made.add_argument(x)
        made.add_argument("--default-weight", type=float, default=0.0)
        made.add_argument("--ignore-weights", action="store_true")
        return made

    for name, say in (("costs", "the cheapest paths' costs"), ("paths", "the cheapest paths"), ("nodes", "the first path nodes and their parents")):
        top = add(name, say, "out")
        top.add_argument("--k", type=metrics.parse_k_list, default=[10], help="numbers between commas; a folder for each")
        top.add_argument("--max-deviations", type=int)
        top.add_argument("--times", help="a table to add seconds by phase to")
    compare = add("compare", "costs against a written list", "golden")
    compare.add_argument("--k", type=metrics.parse_k_list, default=[10])
    add("stats", "vertices, edges, average degree, diameter")
    add("levels", "topological levels and their sizes", "out")
    add("dumps", "every dump of edges, levels and suffix distances", "out")
    add("edge-list", "edges, with weights", "out")
    add("csr", "a compressed sparse matrix", "out")
    dense = add("densify", "edges added up to a degree", "out")
    dense.add_argument("--degree", type=float, required=True)
    dense.add_argument("--seed", type=int, default=1)
    weigh = add("weigh", "new weights", "out")
    weigh.add_argument("--unit", action="store_true")
    weigh.add_argument("--seed", type=int, default=1)
    size = add("size-up", "disjoint copies", "out")
    size.add_argument("--times", type=int, required=True)
    add("from-adjacency", "a graph from lists of neighbours", "out")
    add("from-timing", "a graph from timing edges", "out")
    return parser


def _write_levels(index: paths.PathIndex, out: str) -> None:
    levels = index.tree.select("id", "level")
    graph_text.write_dump(levels, f"{out}/levels")
    graph_text.write_dump(graph.level_pointers(levels), f"{out}/level_sizes")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """What there is to show, if anything; the rest is written."""
    command = args.command
    if command == "from-adjacency":
        edges = graph.with_weights(graph_text.read_dimacs(spark, args.graph), unit=round(args.default_weight * graph_text.SCALE))
        n = edges.agg({"dst": "max"}).first()[0]
        return graph_text.write_graph(spark.range((n or 0) + 1), edges, args.out)
    if command == "from-timing":
        vertices, edges = graph_text.read_timing_edges(spark, args.graph)
        return graph_text.write_graph(vertices, edges, args.out)
    vertices, edges = graph_text.read_graph(spark, args.graph, args.default_weight, args.ignore_weights)
    edges = graph.collapse_parallel(edges)
    index, phases = paths.PathIndex.build(edges, vertices), Phases()
    if command in ("costs", "paths", "nodes"):
        for k in args.k:
            with phases.of(f"{command} {k}"):
                if command == "costs":
                    graph_text.write_costs(paths.topk_costs(index, k, args.max_deviations), f"{args.out}/{k}")
                elif command == "paths":
                    paths.topk_paths(index, k, args.max_deviations).orderBy("rank").write.mode("overwrite").csv(f"{args.out}/{k}", header=True)
                else:
                    paths.path_nodes(index, k, args.max_deviations).orderBy("node_id").write.mode("overwrite").csv(f"{args.out}/{k}", header=True)
        if args.times:
            graph_text.append_results(index.phases.table(spark).unionByName(phases.table(spark)), args.times)
        return None
    if command == "compare":
        k = max(args.k)
        return metrics.compare_prefix(graph_text.read_costs(spark, args.golden), paths.topk_costs(index, k), k)
    if command == "stats":
        return graph.graph_stats(edges, index.tree.select("id", "level"))
    if command == "levels":
        return _write_levels(index, args.out)
    if command == "dumps":
        return graph_text.write_dumps(index.edges, index.tree, args.out)
    if command == "edge-list":
        return graph_text.write_dump(graph_text.dumps(index.edges, index.tree)["edge_list_weighted"], args.out)
    if command == "csr":
        return graph_text.write_csr(edges, vertices, args.out)
    if command == "densify":
        edges = graph.densified(index.edges, index.tree.select("id", "level"), args.degree, args.seed)
    elif command == "weigh":
        edges = graph.with_weights(edges, args.seed, graph_text.SCALE if args.unit else None)
    else:
        n = vertices.count()
        vertices, edges = spark.range(n * args.times), graph.sized_up(edges, args.times, n)
    return graph_text.write_graph(vertices, edges, args.out)


def main(argv: list[str] | None = None) -> None:
    args = _arguments().parse_args(argv)
    shown = run(SparkSession.builder.appName("slackline").getOrCreate(), args)
    if shown is not None:
        shown.show(truncate=False)


if __name__ == "__main__":
    main()

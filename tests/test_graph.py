"""Suffix trees and top-K paths against enumeration of every path, and the text forms."""

import random

import pytest

from slackline.operators import bitsets, graph, metrics, paths, selection
from slackline.operators.components import connected_components
from slackline.operators.suffix import CycleError, deviations, suffix_tree, violated
from slackline.plans.scratch import Scratch
from slackline.sources import graph_text

FIVE = [(0, 1, 1000), (0, 2, 2000), (1, 3, 1000), (2, 3, 500), (3, 4, 1000)]
#: The twelve-vertex example of a published paper, in its order.
TWELVE = """12
"0";
"1";
"2";
"3";
"4";
"5";
"6";
"7";
"8";
"9";
"10";
"11";
"0" -> "3", 4.0;
"0" -> "4", 1.0;
"1" -> "4", 2.0;
"2" -> "4", 4.0;
"2" -> "5", 3.0;
"3" -> "6", 3.0;
"4" -> "7", 4.0;
"5" -> "10", 5.0;
"5" -> "8", 6.0;
"6" -> "9", 2.0;
"6" -> "10", 3.0;
"7" -> "6", 1.0;
"7" -> "10", 2.0;
"8" -> "11", 1.0;
"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w long")


def every_path(rows, vertices):
    out, heads = {}, {d for _, d, _ in rows}
    for s, d, w in rows:
        out.setdefault(s, []).append((d, w))
    found = []

    def walk(v, cost, way):
        if v not in out:
            found.append((cost, "-".join(map(str, way))))
        for d, w in out.get(v, []):
            walk(d, cost + w, [*way, d])

    for v in vertices:
        if v not in heads:
            walk(v, 0, [v])
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_against_enumeration(spark, seed):
    draw = random.Random(seed)
    n = draw.randint(5, 9)
    rows = [(a, b, draw.randint(0, 9) * 5000) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.45]
    every = every_path(rows, range(n + 1))  # vertex n is isolated: a source and a sink
    index = paths.PathIndex.build(frame(spark, rows), spark.range(n + 1))
    for k in (4, 1000):
        assert [(r["cost"], r["path"]) for r in paths.topk_paths(index, k).orderBy("rank").collect()] == every[:k]
    last = every[min(3, len(every) - 1)][0]
    assert sorted(map(tuple, paths.topk_with_ties(index, 4).collect())) == [p for p in every if p[0] <= last]
    assert violated(index.edges, index.tree).isEmpty()


def test_twelve_vertices_from_text(spark, tmp_path):
    (tmp_path / "g.txt").write_text(TWELVE)
    vertices, edges = graph_text.read_graph(spark, str(tmp_path / "g.txt"))
    tree = {r["id"]: (r["level"], r["dist"], r["succ"]) for r in suffix_tree(edges, vertices).collect()}
    assert [tree[v][0] for v in range(12)] == [4, 4, 4, 2, 3, 2, 1, 2, 1, 0, 0, 0]
    assert [tree[v][1] for v in range(12)] == [70000, 80000, 80000, 50000, 60000, 50000, 20000, 20000, 10000, 0, 0, 0]
    assert [tree[v][2] for v in range(12)] == [4, 4, 5, 6, 7, 10, 9, 10, 11, None, None, None]
    bfs = {r["id"]: r["level"] for r in graph.bfs_levels(edges, vertices).collect()}
    assert [bfs[v] for v in range(12)] == [3, 3, 2, 2, 2, 1, 1, 1, 1, 0, 0, 0]
    graph_text.write_graph(vertices, edges, str(tmp_path / "out"))
    again = graph_text.read_graph(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, edges.collect()))


def test_text_errors(spark, tmp_path):
    for text in ('2\n"0";\n"1";\n"0" -> "5";\n', '2\n"0";\nrubbish\n', '3\n"0";\n"1";\n"0" -> "1";\n', '"0";\n', '2\n"0"\n"1"\nrubbish\n'):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(graph_text.GraphFormatError):
            graph_text.read_graph(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "w.txt").write_text('2\n"0";\n"1";\n"0" -> "1";\n"0" -> "1", 2.3;\n')
    assert [r["w"] for r in graph_text.read_graph(spark, str(tmp_path / "w.txt"), default_weight=1.0)[1].collect()] == [10000, 23000]
    # Vertex lines without a semicolon, edges without spaces or semicolon.
    (tmp_path / "loose.txt").write_text('5\n"0"\n"1"\n"2"\n"3" ;\n"4"\n"0"->"1",0.10\n"0" -> "2" , 0.2;\n "1" -> "3"\n')
    vertices, edges = graph_text.read_graph(spark, str(tmp_path / "loose.txt"))
    assert vertices.count() == 5 and sorted(map(tuple, edges.collect())) == [(0, 1, 1000), (0, 2, 2000), (1, 3, 0)]


def test_adjacency_lists(spark, tmp_path):
    f = tmp_path / "a.graph"
    for text in ("% remark\n4 3\n2 3\n1\n1 4\n3\n", "4 3 001\n2 9 3 9\n1 9\n1 9 4 9\n3 9\n", "4 3 11 2\n7 7 2 9 3 9\n7 7 1 9\n7 7 1 9 4 9\n7 7 3 9\n", "4 3 110\n5 7 2 3\n5 7 1\n5 7 1 4\n5 7 3\n"):
        f.write_text(text)
        assert sorted(map(tuple, graph_text.read_dimacs(spark, str(f)).collect())) == [(0, 1), (0, 2), (2, 3)], text
    f.write_text("3 1\n\n3\n2\n")
    assert [tuple(r) for r in graph_text.read_dimacs(spark, str(f)).collect()] == [(1, 2)]
    for text in ("4 1\n5\n", "4\n1\n", "2 1\n2\n1\n1\n", "2 1\nx\n1\n"):
        f.write_text(text)
        with pytest.raises(graph_text.GraphFormatError):
            graph_text.read_dimacs(spark, str(f))


def test_command_line(spark, tmp_path, capsys):
    from slackline import __main__ as cli

    (tmp_path / "g.txt").write_text(TWELVE)
    g, out = str(tmp_path / "g.txt"), str(tmp_path / "out")
    for args in (["costs", g, out + "/c", "--k", "3,5", "--times", out + "/t"], ["paths", g, out + "/p", "--k", "4"], ["nodes", g, out + "/n", "--k", "4"], ["compare", g, out + "/c/5", "--k", "5"], ["stats", g],
                 ["levels", g, out + "/l"], ["dumps", g, out + "/d"], ["edge-list", g, out + "/e"], ["csr", g, out + "/csr"], ["densify", g, out + "/dense", "--degree", "1.5"],
                 ["weigh", g, out + "/w", "--unit"], ["size-up", g, out + "/s", "--times", "3"]):
        cli.main(args)
    told = capsys.readouterr().out
    assert "true" in told and "1.1667" in told
    assert [r["cost"] for r in graph_text.read_costs(spark, out + "/c/3").orderBy("rank").collect()] == [70000, 80000, 80000]
    assert {"edges", "tree", "costs 3", "costs 5"} <= {r["phase"] for r in spark.read.csv(out + "/t", header=True).collect()}
    assert graph_text.read_graph(spark, out + "/s")[1].count() == 42 and 14 < graph_text.read_graph(spark, out + "/dense")[1].count() <= 18
    assert {r["w"] for r in graph_text.read_graph(spark, out + "/w")[1].collect()} == {10000}
    assert graph_text.read_csr(spark, out + "/csr")[1].count() == 14
    (tmp_path / "a.graph").write_text("4 3\n2 3\n1\n1 4\n3\n")
    cli.main(["from-adjacency", str(tmp_path / "a.graph"), out + "/fa", "--default-weight", "2"])
    assert {r["w"] for r in graph_text.read_graph(spark, out + "/fa")[1].collect()} == {20000}
    with pytest.raises(Exception, match="not mapped"):
        graph.relabel(frame(spark, FIVE), spark.createDataFrame([(0, 1)], "id long, new_id long")).collect()


def test_unreached_and_large_groups(spark):
    loop = frame(spark, [(0, 1, 1), (2, 3, 1), (3, 2, 1)])
    assert {r["id"]: r["level"] for r in graph.bfs_levels(loop).collect()} == {0: 1, 1: 0, 2: -1, 3: -1}
    assert metrics.unvisited(graph.bfs_levels(loop).withColumnRenamed("level", "depth")).first()["n"] == 2
    draw = random.Random(2)
    parents = [(k, k % 2, draw.choice((draw.randint(0, 30), draw.randint(-(10**12), 10**12)))) for k in range(300)]
    families = [(k, k % 3, k, draw.randint(0, 40)) for k in range(120)]
    p, f = spark.createDataFrame(parents, "parent_id long, src long, cost long"), spark.createDataFrame(families, "family_id long, src long, dst long, delta long")
    order = {r["parent_id"]: r["k"] for r in selection.in_source_order(p).collect()}
    assert order == {i: sorted((c, j) for j, t, c in parents if t == s).index((c, i)) + 1 for i, s, c in parents}
    for split, final in ((20, 60), (20, None), (60, 20)):
        want = []
        for i, s, _, delta in families:
            costs = [c + delta for _, t, c in parents if t == s]
            short = sum(c <= split for c in costs)
            long = sum(split < c <= (2**62 if final is None else final) for c in costs)
            want += [(i, short, long, len(costs) - short - long, len(costs))] * bool(costs)
        assert sorted(map(tuple, selection.family_counts(p, f, split, final).collect())) == want


def test_timing_edges(spark, tmp_path):
    f = tmp_path / "t.edges"
    f.write_text("# remark\ninsert_edge b a 1 2 3 n/a 5 6 7 0.45\nother x\ninsert_edge a c n/a n/a n/a n/a n/a n/a n/a 8.2\ninsert_edge b a 9 9 9 9 9 9 9 0.22\n")
    vertices, edges = graph_text.read_timing_edges(spark, str(f))
    assert sorted(map(tuple, vertices.collect())) == [(0, "b"), (1, "a"), (2, "c")]
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 2200), (1, 2, 82000)]
    f.write_text("insert_edge b a n/a n/a n/a n/a n/a n/a n/a n/a\n")
    with pytest.raises(graph_text.GraphFormatError):
        graph_text.read_timing_edges(spark, str(f))


def test_cycle_and_empty(spark):
    with pytest.raises(CycleError):
        suffix_tree(frame(spark, [(0, 1, 1), (1, 2, 1), (2, 1, 1)]))
    assert suffix_tree(frame(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        metrics.parse_k_list("1000,0")
    assert metrics.parse_k_list("1000, 10000,50000") == [1000, 10000, 50000]


def test_cache_counts(spark):
    cache = paths.StaticCache()
    for _ in range(2):
        index = cache.get(("five",), lambda: paths.PathIndex.build(frame(spark, FIVE)))
        assert [r["cost"] for r in paths.topk_costs(index, 2).orderBy("rank").collect()] == [3000, 3500]
    assert (cache.hits, cache.misses) == (1, 1)
    devs = deviations(index.edges, index.tree).collect()
    assert [(r["src"], r["dst"], r["delta"]) for r in devs] == [(0, 2, 500)]


def test_bit_slices(spark):
    edges = frame(spark, [(0, 1, 0), (0, 9, 0), (1, 8, 0), (2, 0, 0), (2, 9, 0), (4, 2, 0)])
    slices = bitsets.build(edges)
    assert tuple(bitsets.summary(slices).first()) == (6, 6, 0.125)
    assert bitsets.mismatches(slices, edges).isEmpty()
    nine = spark.createDataFrame([(9,)], "id long")
    assert sorted(r["id"] for r in bitsets.pull_step(slices, nine, nine).collect()) == [0, 2]
    devs = bitsets.build(frame(spark, [(0, 1, 0), (2, 9, 0)]), row="dst", column="src")
    assert sorted(map(tuple, bitsets.discover(devs, spark.range(3)).collect())) == [(0, 1), (2, 9)]


def test_ranks_and_offsets_by_range(spark):
    rows = [(v, v % 3) for v in range(0, 90, 2)]
    got = {r["id"]: r["k"] for r in graph.ranked(spark.createDataFrame(rows, "id long, level int"), "level", width=8).collect()}
    assert got == {v: sum(u < v for u, g in rows if g == level) for v, level in rows}
    edges = frame(spark, [(0, 1, 0), (0, 30, 0), (9, 30, 0), (17, 30, 0)])
    got = {r["id"]: (r["first"], r["n"]) for r in graph.row_offsets(edges, spark.range(31), width=4).collect()}
    assert got == {v: (2 * (v > 0) + (v > 9) + (v > 17), {0: 2, 9: 1, 17: 1}.get(v, 0)) for v in range(31)}
    assert graph.row_offsets(frame(spark, [])).isEmpty()


def test_densified(spark):
    vertices, edges = spark.range(60), frame(spark, [(v + 20, v, 5) for v in range(40)])
    levels = suffix_tree(edges, vertices).select("id", "level")
    made = graph.densified(edges, levels, 1.5).collect()
    assert len(made) == len({(r["src"], r["dst"]) for r in made}) == 90
    assert all(r["src"] // 20 - r["dst"] // 20 == 1 for r in made)
    assert sorted(map(tuple, made)) == sorted(map(tuple, graph.densified(edges.repartition(3), levels, 1.5).collect()))
    assert graph.densified(edges, levels, 0.1).count() == 40


def test_gates(spark):
    edges = frame(spark, FIVE)
    tree = suffix_tree(edges)
    assert tuple(metrics.gate(edges, tree).first()) == (5, 0, 5, 0, 0, 0)
    worse = tree.selectExpr("id", "level", "if(id = 0, dist + 1, dist) AS dist", "succ")
    assert tuple(metrics.gate(edges, worse).first()) == (5, 0, 5, 0, 1, 1)
    at = lambda xs: spark.createDataFrame(list(enumerate(xs)), "k long, at long")
    to = spark.createDataFrame([(0,), (1,), (7,)], "id long")
    assert sorted(map(tuple, metrics.csr_violations(at([0, 2, 1, 3]), to).collect())) == [("falling", 1), ("out_of_range", 1)]
    assert metrics.csr_violations(at([0, 1, 2, 3]), to.where("id < 7").union(spark.range(1))).isEmpty()


def test_selection_literals(spark):
    parents = spark.createDataFrame([(k, 0, c) for k, c in enumerate((5000, 7500, 10000, 12500, 20000, 35000))], "parent_id long, src long, cost long")
    families = spark.createDataFrame([(0, 0, 1, 2500)], "family_id long, src long, dst long, delta long")
    assert tuple(selection.family_counts(parents, families, 12500, 22500).first()) == (0, 3, 2, 1, 6)
    made = selection.candidates(parents, families)
    assert tuple(selection.pile_summary(made, 12500).first()) == (7500, 3, 3)
    assert selection.first_n_with_ties(made.union(made), 1).count() == 2
    tiles = selection.tile_stats(spark.createDataFrame([(0, 40, 20)], "src long, parents long, families long")).first()
    assert (tiles["full_16x16"], tiles["partial_16x16"], tiles["capacity_16x16"], tiles["dense_16x16"]) == (2, 4, 1536, 640)


def test_components(spark):
    draw = random.Random(3)
    pairs = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert set(got) == set(parent)
    assert len(set(got.values())) == len({find(x) for x in parent})
    assert all(got[a] == got[b] for a, b in pairs)

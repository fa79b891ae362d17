"""Queries over whole tables, held against their SQL or brute force."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import traverse, walks
from graphloom.plans import graph_queries
from graphloom.schema import EdgeType, NodeType, Registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def rows_of(rows):
    return sorted(repr([list(x) if isinstance(x, (list, tuple)) else x for x in r]) for r in rows)


def by_sql(name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return rows_of(con.execute(graph_queries.SQL[name]).fetchall())


@pytest.mark.parametrize("name", sorted(n for n in graph_queries.SQL if n.startswith(("varlen", "paths", "trail", "all_", "delete", "create", "complex", "update", "constraints", "distinct", "union"))))
def test_queries_match_their_sql(spark, name):
    assert rows_of(graph_queries.QUERIES[name](spark, FOLDER).collect()) == by_sql(name)


def test_collection_of_whole_texts(spark):
    got = graph_queries.QUERIES["project_collection"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert max(len(t or "") for t in texts.values()) > 60
    assert all(r["n"] == len(texts[r["doc_id"]].split(" ")) for r in got if texts[r["doc_id"]] is not None)


def brute_shortest(edges):
    """By (source, endpoint) the edge ids of every shortest path."""
    out, found = {}, {}
    for eid, a, b in edges:
        out.setdefault(a, []).append((eid, b))
    for s in {a for _, a, _ in edges}:
        seen, level = {s}, {s: [()]}
        while level:
            after = {}
            for at, paths in level.items():
                for eid, b in out.get(at, []):
                    if b not in seen:
                        after.setdefault(b, []).extend((*p, eid) for p in paths)
            seen |= set(after)
            found |= {(s, d): paths for d, paths in after.items()}
            level = after
    return found


def test_shortest_paths_of_any_depth_from_every_customer(spark):
    people = graph_queries.load_graph(spark, FOLDER).nodes("Customer")
    edges = [tuple(r) for r in people.path_segments("REFERS", "Customer").select(lambda s: {"eid": s.relationship["_eid"], "a": s.start.c_custkey, "b": s.end.c_custkey}).to_df().collect()]
    segment = {r["c_custkey"]: r["c_mktsegment"] for r in people.to_df().collect()}
    want = brute_shortest(edges)
    assert max(len(p[0]) for p in want.values()) > 6
    run = lambda name: sorted(tuple(r) for r in graph_queries.QUERIES[name](spark, FOLDER).collect())
    assert run("shortest") == sorted((s, d, len(p[0])) for (s, d), p in want.items())
    assert run("shortest_predicate") == sorted((s, d, len(p[0])) for (s, d), p in want.items() if segment[d] == "BUILDING")
    every = sorted((s, d, len(es), es) for (s, d), p in want.items() for es in p)
    shape = lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey, "n": p.depth, "es": p.edge_ids, "at": F.transform(p.segments, lambda x: x["end"])}
    ends = {}
    for keep in (None, lambda n: n.c_custkey < 10):
        got = people.all_shortest_paths("REFERS", "Customer", keep).select(shape).to_df().collect()
        assert sorted((r["s"], r["d"], r["n"], tuple(r["es"])) for r in got) == [x for x in every if keep is None or x[1] < 10]
        for r in got:
            assert ends.setdefault(tuple(r["es"]), tuple(r["at"])) == tuple(r["at"])
    back = people.all_shortest_paths("REFERS", "Customer", lambda n: n.c_custkey < 10, "both").select(lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey, "g": p.segments}).to_df().collect()
    ways = {eid: (a, b) for eid, a, b in edges}
    for r in back:  # found from the endpoints: each step still begins where the last one ended
        at = r["s"]
        for g in r["g"]:
            a, b = ways[g["eid"]] if g["direction"] == "out" else ways[g["eid"]][::-1]
            assert a == at
            at = b
        assert at == r["d"]


@pytest.fixture
def written(monkeypatch):
    """How many rows each lineage cut of a traversal writes."""
    rows, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (out := cut(df), rows.append(out.count()))[0])
    return rows


def test_paths_whose_types_end_write_no_level_of_all_sources(spark, written):
    got = graph_queries.QUERIES["all_shortest"](spark, FOLDER)
    assert max(written, default=0) < 100
    assert rows_of(got.collect()) == by_sql("all_shortest")


@pytest.mark.parametrize("target_first", [False, True])
def test_paths_whose_types_end_keep_only_the_shortest(spark, target_first):
    """A type that stands in two levels: what the first has found, the second does not find again."""
    reg = Registry().add(NodeType("A"), NodeType("B"), NodeType("C"), EdgeType("AB", "A", "B"), EdgeType("AC", "A", "C"), EdgeType("BC", "B", "C"))
    nodes = {n: spark.createDataFrame([(i, [n]) for i in ids], "_nid long, _labels array<string>") for n, ids in (("A", [1, 2]), ("B", [11]), ("C", [21, 22, 23]))}
    edges = {"AB": [(1, 1, 11), (2, 2, 11)], "AC": [(1, 1, 21), (2, 1, 21)], "BC": [(1, 11, 21), (2, 11, 22), (3, 11, 99)]}
    edges = {n: spark.createDataFrame([(e, n, a, b) for e, a, b in rows], "_eid long, _type string, _src long, _dst long") for n, rows in edges.items()}
    people = PropertyGraph(spark, reg, nodes, edges).nodes("A")
    keep = (lambda n: n["_nid"] == 21) if target_first else None
    shape = lambda p: {"s": p.start["_nid"], "d": p.end["_nid"], "n": p.depth, "es": p.edge_ids, "g": p.segments}
    want = {(1, 21, 1, (1,)), (1, 21, 1, (2,)), (1, 22, 2, (1, 2)), (2, 21, 2, (2, 1)), (2, 22, 2, (2, 2))}
    want = {x for x in want if not target_first or x[1] == 21}
    got = people.all_shortest_paths(None, "C", keep).select(shape).to_df().collect()
    assert sorted((r["s"], r["d"], r["n"], tuple(r["es"])) for r in got) == sorted(want)
    assert all((r["g"][0]["start"], r["g"][-1]["end"]) == (r["s"], r["d"]) for r in got)
    got = people.shortest_path(None, "C", keep).select(shape).to_df().collect()
    assert sorted((r["s"], r["d"], r["n"], tuple(r["es"])) for r in got) == sorted(want - {(1, 21, 1, (2,))})


def test_shortest_paths_write_no_level(spark, written):
    assert graph_queries.QUERIES["shortest"](spark, FOLDER).count() > 1000
    assert len(written) == 1  # the relationships


def test_shortest_paths_to_some_endpoints_write_these_and_the_relationships_only(spark, written):
    people = graph_queries.load_graph(spark, FOLDER).nodes("Customer")
    segment = {r["c_custkey"]: r["c_mktsegment"] for r in people.to_df().collect()}
    got = graph_queries.QUERIES["shortest_predicate"](spark, FOLDER)
    assert len(written) == 2
    assert {segment[r["d"]] for r in got.collect()} == {"BUILDING"}


@pytest.mark.parametrize("direction", ["out", "both"])
@pytest.mark.parametrize("keep", [None, lambda n: n.c_custkey < 10], ids=["all", "some"])
def test_shortest_paths_of_workers_are_those_of_joins(spark, monkeypatch, keep, direction):
    monkeypatch.setattr(walks, "CELLS", 1000)  # several rounds of sources
    people = graph_queries.load_graph(spark, FOLDER).nodes("Customer").where(lambda n: n.c_custkey < 40)
    shape = lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey, "n": p.depth, "es": p.edge_ids, "g": p.segments}
    run = lambda: rows_of(people.shortest_path("REFERS", "Customer", keep, direction, max_depth=4).select(shape).to_df().collect())
    got = run()
    monkeypatch.setattr(walks, "HELD", -1)
    assert got == run() != []


def test_a_join_by_few_keys_is_shared_by_all_tasks(spark):
    got = graph_queries.QUERIES["join_rel_payload"](spark, FOLDER)
    tasks = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(tasks) > spark.sparkContext.defaultParallelism and max(tasks) < sum(tasks) / 4
    assert rows_of(got.collect()) == by_sql("join_rel_payload")


def test_a_join_by_few_keys_is_small_by_the_columns_it_asks_for(spark, monkeypatch):
    wide = graph_queries.load_graph(spark, FOLDER).nodes("Customer").df
    monkeypatch.setattr(traverse, "SMALL", int(wide._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) - 1)
    test_a_join_by_few_keys_is_shared_by_all_tasks(spark)


def test_a_join_by_few_keys_repeats_few_rows_at_a_time(spark):
    """Any thousand rows that follow one another hold few inner rows, which columnar files keep in few bytes."""
    reg = Registry().add(NodeType("A"), EdgeType("R", "A", "A"))
    nodes = spark.range(102).select(F.col("id").alias("_nid"), F.array(F.lit("A")).alias("_labels"), F.when(F.col("id") < 100, F.col("id") % 2).alias("k"))
    edges = spark.range(5000).select(F.col("id").alias("_eid"), F.lit("R").alias("_type"), F.lit(0).cast("long").alias("_src"), F.lit(0).cast("long").alias("_dst"), F.when(F.col("id") % 5 > 0, F.col("id") % 5 - 1).alias("k"))
    g = PropertyGraph(spark, reg, {"A": nodes}, {"R": edges})
    got = g.nodes("A").join(g.relationships("R"), lambda a: a.k, lambda r: r.k, lambda a, r: {"a": a["_nid"], "r": r["_eid"]}).to_df().toArrow().to_pylist()
    assert sorted((x["a"], x["r"]) for x in got) == sorted((a, r) for a in range(100) for r in range(5000) if r % 5 == a % 2 + 1)
    assert max(len({x["r"] for x in got[i : i + 1000]}) for i in range(0, len(got), 1000)) < 200


@pytest.fixture
def wide(spark, monkeypatch):
    """No table is small by its bytes, for us or for Spark."""
    monkeypatch.setattr(traverse, "SMALL", 0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def above_the_search(df):
    """What the plan does with what workers have found."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow search" in plan
    return plan.partition("MapInArrow search")[0]


def test_shortest_paths_between_wide_nodes_are_not_shuffled(spark, wide):
    got = graph_queries.QUERIES["shortest"](spark, FOLDER)
    assert above_the_search(got).count("BroadcastHashJoin") == 2 and "Exchange" not in above_the_search(got)
    edges = [tuple(r) for r in graph_queries.load_graph(spark, FOLDER).relationships("REFERS").select(lambda r: {"eid": r["_eid"], "a": r["_src"], "b": r["_dst"]}).to_df().collect()]
    shift = graph_queries.load_graph(spark, FOLDER).nodes("Customer").select(lambda n: n["_nid"] - n.c_custkey).to_df().first()[0]
    assert sorted(tuple(r) for r in got.collect()) == sorted((s - shift, d - shift, len(p[0])) for (s, d), p in brute_shortest(edges).items())


def test_shortest_paths_to_some_wide_endpoints_are_not_shuffled(spark, wide):
    got = graph_queries.QUERIES["shortest_predicate"](spark, FOLDER)
    assert above_the_search(got).count("BroadcastHashJoin") == 2 and "Exchange" not in above_the_search(got)
    people = graph_queries.load_graph(spark, FOLDER).nodes("Customer")
    building = {r["c_custkey"] for r in people.to_df().collect() if r["c_mktsegment"] == "BUILDING"}
    every = [tuple(r) for r in graph_queries.QUERIES["shortest"](spark, FOLDER).collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(x for x in every if x[1] in building)


def ring_graph(spark, n):
    """Two rings of n nodes, in turns: i refers to i + 2."""
    reg = Registry().add(NodeType("A"), EdgeType("R", "A", "A"))
    nodes = spark.range(2 * n).select(F.col("id").alias("_nid"), F.array(F.lit("A")).alias("_labels"))
    edges = spark.range(2 * n).select(F.col("id").alias("_eid"), F.lit("R").alias("_type"), F.col("id").alias("_src"), ((F.col("id") + 2) % (2 * n)).alias("_dst"))
    return PropertyGraph(spark, reg, {"A": nodes}, {"R": edges})


@pytest.mark.parametrize("keep", [None, lambda n: n["_nid"] < 600], ids=["all", "some"])
def test_shortest_paths_repeat_few_nodes_at_a_time(spark, keep):
    """Any thousand rows that follow one another hold few of the found nodes and few of the sources, which columnar files keep in few bytes."""
    n = 400
    q = ring_graph(spark, n).nodes("A").shortest_path("R", "A", keep)
    got = q.select(lambda p: {"s": p.start["_nid"], "d": p.end["_nid"], "n": p.depth}).to_df().toArrow().to_pylist()
    want = [(a, (a + 2 * i) % (2 * n), i) for a in range(2 * n) for i in range(1, n)]
    assert sorted((x["s"], x["d"], x["n"]) for x in got) == sorted(x for x in want if keep is None or x[1] < 600)
    found, source = ("d", "s") if keep is None else ("s", "d")
    some = [got[i : i + 1000] for i in range(0, len(got), 1000)]
    assert sorted(len({x[found] for x in rows}) for rows in some)[len(some) // 2] < 20 and max(len({x[source] for x in rows}) for rows in some) <= 2 * walks.SHARE


def test_the_search_of_shortest_paths_sends_no_names_of_relationships(spark, monkeypatch):
    """Executors keep what is sent to them on disk: 25 bytes a relationship at most here, where it was 35; names are sent apart and stay with the driver if no path is asked for."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or send(self, x))
    n = 5000
    ring_graph(spark, n).nodes("A").shortest_path("R", "A").select(lambda p: {"n": p.depth}).to_df()
    size = [sum(x.nbytes for x in held if hasattr(x, "nbytes")) for held in sent]
    assert len(sent) == 2 and max(size) < 25 * 2 * n


def test_sources_are_searched_some_at_a_time_in_cells_of_their_own(spark, monkeypatch):
    edges = [(i, i * 5 % 60, (i * i * 7 + 1) % 60 // 10 * 10 + i * 5 % 10) for i in range(90)] + [(100 + i, 70 + i, 70 + (i + 1) % 9) for i in range(9)] + [(200, 90, 90), (201, 95, 91)]
    held = spark.createDataFrame([(a, b, e, "R", "out") for e, a, b in edges], "__from long, __to long, _eid long, _type string, __dir string")
    g, names = walks.links(held)
    assert len(g.bounds) > 4
    monkeypatch.setattr(walks, "CELLS", 100)
    monkeypatch.setattr(walks, "TOGETHER", 7)
    sources, known = walks._places(g, np.array(sorted({x for e in edges for x in e[1:]} | {1_000})))
    assert known.sum() == len(known) - 1
    sources = np.sort(sources[known])
    rounds = list(walks._rounds(g, sources))
    assert np.concatenate(rounds).tolist() == sources.tolist() and len(rounds) > 3
    got = {}
    for some in rounds:
        ends, base = walks._cells(g, some)
        assert len(some) <= 7 and (ends[-1] <= 100 or len(some) == 1)
        by = np.full(ends[-1], -1, np.int32)
        for depth, b, v in walks.levels(g, some, None, by):
            for x, y, z in zip(some[b], v, by[base[b] + v], strict=True):
                got[int(g.ids[x]), int(g.ids[y])] = (depth, int(names.eid[z]))
    assert got == {k: (len(p[0]), min(p)[-1]) for k, p in brute_shortest(edges).items()}

"""The engine on a small hand-written graph: loops, parallel edges, a cycle, subtypes, nulls."""

import pytest
from pyspark.sql import functions as F

from graphloom.errors import CardinalityError, ConstraintError, EmptyResultError, GraphQueryError
from graphloom.functions import scalar as X
from graphloom.graph import PropertyGraph
from graphloom.schema import EdgeType, NodeType, Property, Registry
from graphloom.store import GraphStore

NAMES = ["Alice", "Bob", "Carol", "Dan", "Eve", "Frank"]


@pytest.fixture(scope="module")
def graph(spark):
    reg = Registry().add(
        NodeType("Person", properties=(Property("name", key=True, min_length=2), Property("email", unique=True), Property("dept", search=False))),
        NodeType("Manager", parent="Person"), NodeType("Company"),
        EdgeType("KNOWS", "Person", "Person"), EdgeType("KNOWS_WELL", "Person", "Person", parent="KNOWS"), EdgeType("WORKS_AT", "Person", "Company"),
    )
    schema = "_nid long, _labels array<string>, name string, age int, dept string, bio string, tags array<string>, email string"
    ages, depts = [30, 40, 25, 35, None, 50], ["Sales", "Sales", "Eng", "Eng", "Eng", "Mktg"]
    people = [(i, ["Person"], n, ages[i], depts[i], f"{n} writes Code", ["x", None] if i == 0 else ["y"], None) for i, n in enumerate(NAMES) if n != "Bob"]
    bob = [(1, ["Person", "Manager"], "Bob", 40, "Sales", "leads, and codes", [], "b@x")]
    edges = [(1, "KNOWS", 0, 1, 5), (2, "KNOWS", 0, 2, 3), (3, "KNOWS", 1, 2, 9), (4, "KNOWS", 2, 0, 1), (5, "KNOWS", 1, 3, 7), (6, "KNOWS", 3, 4, 2), (7, "KNOWS", 0, 0, 4), (8, "KNOWS", 0, 1, 8)]
    e = "_eid long, _type string, _src long, _dst long, since int"
    return PropertyGraph(
        spark, reg,
        {"Person": spark.createDataFrame(people, schema), "Manager": spark.createDataFrame(bob, schema), "Company": spark.createDataFrame([(100, ["Company"], "Acme")], "_nid long, _labels array<string>, title string")},
        {"KNOWS": spark.createDataFrame(edges, e), "KNOWS_WELL": spark.createDataFrame([(9, "KNOWS_WELL", 2, 3, 6)], e), "WORKS_AT": spark.createDataFrame([(10, "WORKS_AT", 0, 100), (11, "WORKS_AT", 1, 100)], "_eid long, _type string, _src long, _dst long")},
    )


def names(q):
    return sorted(r["name"] for r in q.to_df().collect())


def test_scans_and_labels(graph):
    people = graph.nodes("Person")
    assert names(people) == NAMES and names(graph.nodes("Manager")) == ["Bob"]
    assert names(people.of_labels("all", ["Person", "Manager"])) == ["Bob"]
    assert names(people.of_labels("any", [])) == NAMES
    assert graph.relationships("KNOWS").count() == 9 and graph.relationships("KNOWS_WELL").count() == 1
    assert graph.dynamic_nodes().count() == 7 and graph.dynamic_relationships().count() == 11


def test_filters(graph):
    people = graph.nodes("Person")
    assert names(people.where(lambda n: n.age > 30).where(lambda n: n.dept == "Sales")) == ["Bob"]
    assert names(people.where(lambda n: X.member(n.tags, None))) == ["Alice"]
    assert names(people.where_has_relationship("WORKS_AT")) == ["Alice", "Bob"]
    assert names(people.where_has_relationship("KNOWS", "both", lambda r: r.since == 2)) == ["Dan", "Eve"]
    assert names(people.order_by(lambda n: n.name).take(3).where(lambda n: n.dept == "Eng")) == ["Carol"]


def test_degree_counts_loop_once(graph):
    q = graph.nodes("Person").select(lambda n: {"name": n.name, "o": n.count_relationships("KNOWS"), "i": n.count_relationships("KNOWS", "in"), "b": n.count_relationships("KNOWS", "both")})
    got = {r["name"]: (r["o"], r["i"], r["b"]) for r in q.to_list()}
    assert got["Alice"] == (4, 2, 5) and got["Frank"] == (0, 0, 0) and got["Carol"] == (2, 2, 4)


def test_hops(graph):
    alice = graph.nodes("Person").where(lambda n: n.name == "Alice")
    assert names(alice.traverse("KNOWS", "Person")) == ["Alice", "Bob", "Bob", "Carol"]
    assert names(alice.traverse("KNOWS", "Person", direction="both")) == ["Alice", "Bob", "Bob", "Carol", "Carol"]
    assert names(alice.traverse("KNOWS", "Manager")) == ["Bob", "Bob"]
    assert names(alice.traverse("KNOWS", "Person").traverse("KNOWS", "Person").distinct()) == ["Alice", "Bob", "Carol", "Dan"]


def brute_trails(low, high, start=0):
    edges = [(1, 0, 1), (2, 0, 2), (3, 1, 2), (4, 2, 0), (5, 1, 3), (6, 3, 4), (7, 0, 0), (8, 0, 1), (9, 2, 3)]
    found, frontier = [], [(start, ())]
    for depth in range(1, high + 1):
        frontier = [(d, p + (e,)) for at, p in frontier for e, s, d in edges if s == at and e not in p]
        if depth >= low:
            found += frontier
    return sorted(p for _, p in found)


def test_trails(graph):
    alice = graph.nodes("Person").where(lambda n: n.name == "Alice")
    for low, high in ((1, 3), (2, 5)):
        q = alice.traverse_paths("KNOWS", "Person", low, high).select(lambda p: {"es": p.edge_ids, "n": p.depth})
        assert sorted(tuple(r["es"]) for r in q.to_list()) == brute_trails(low, high)
    assert len(alice.traverse("KNOWS", "Person", 1, 3).to_list()) == len(brute_trails(1, 3))


def test_shortest(graph):
    alice = graph.nodes("Person").where(lambda n: n.name == "Alice")
    got = {r["d"]: r["n"] for r in alice.shortest_path("KNOWS", "Person").select(lambda p: {"d": p.end.name, "n": p.depth}).to_list()}
    assert got == {"Bob": 1, "Carol": 1, "Dan": 2, "Eve": 3}
    every = alice.all_shortest_paths("KNOWS", "Person", lambda n: n.name == "Eve").select(lambda p: {"es": p.edge_ids}).to_list()
    assert sorted(tuple(r["es"]) for r in every) == [(1, 5, 6), (2, 9, 6), (8, 5, 6)]


def test_optional(graph):
    q = graph.nodes("Person").optional_traverse("WORKS_AT", "Company").select(lambda p, c: {"name": p.name, "at": c.title})
    assert {r["name"]: r["at"] for r in q.to_list()} == {n: "Acme" if n in ("Alice", "Bob") else None for n in NAMES}
    with pytest.raises(GraphQueryError):
        graph.nodes("Person").optional_traverse("WORKS_AT", "Company").where(lambda s: s.start.age > 1)


def test_grouping(graph):
    q = graph.nodes("Person").group_by(lambda n: n.dept).select(lambda g: {"d": g.key, "n": g.count(), "s": g.sum(lambda n: n.age), "a": g.average(lambda n: n.age)})
    assert {r["d"]: (r["n"], r["s"], r["a"]) for r in q.to_list()} == {"Sales": (2, 70, 35.0), "Eng": (3, 60, 30.0), "Mktg": (1, 50, 50.0)}
    q = graph.nodes("Person").path_segments("KNOWS", "Person").group_by(lambda s: s.start).select(lambda g: {
        "name": g.key.name, "n": g.count(lambda s: s.end.dept == "Sales"), "l": g.list(lambda s: s.end.name, where=lambda s: s.relationship.since > 4, order_by=lambda s: s.end.name),
        "by": g.group_by(lambda s: s.end.dept, lambda h: {"k": h.key, "c": h.count()}),
    })
    got = {r["name"]: r for r in q.to_list()}
    assert got["Alice"]["n"] == 3 and got["Alice"]["l"] == ["Bob", "Bob"] and [tuple(x) for x in got["Alice"]["by"]] == [("Eng", 1), ("Sales", 3)]
    assert got["Dan"]["l"] == [] and set(got) == {"Alice", "Bob", "Carol", "Dan"}


def test_terminals(graph):
    people = graph.nodes("Person")
    empty = people.where(lambda n: n.age > 99)
    assert empty.sum(lambda n: n.age) == 0 and empty.all(lambda n: n.age < 0) and not empty.any()
    assert not people.all(lambda n: n.age > 0) and people.select(lambda n: n.age).contains(None)
    for f in (empty.average, empty.min):
        with pytest.raises(EmptyResultError):
            f(lambda n: n.age)
    assert empty.average(lambda n: n.age, nullable=True) is None and people.average(lambda n: n.age) == 36.0
    assert people.order_by(lambda n: n.age).first()["name"] == "Eve" and people.order_by(lambda n: n.age).last()["name"] == "Frank"
    assert people.order_by(lambda n: n.name).element_at(2)["name"] == "Carol" and people.order_by(lambda n: n.name).skip(4).take(1).element_at_or_default(9) is None
    assert people.single(lambda n: n.name == "Dan")["age"] == 35 and people.single_or_default(lambda n: n.name == "Zoe") is None
    with pytest.raises(CardinalityError):
        people.single()
    with pytest.raises(EmptyResultError):
        empty.first()
    assert people.order_by(lambda n: n.name).skip(1).take(2).sum(lambda n: n.age) == 65
    assert people.to_dictionary(lambda r: r["name"], lambda r: r["age"])["Bob"] == 40
    assert len(people.to_lookup(lambda r: r["dept"])["Eng"]) == 3
    with pytest.raises(CardinalityError):
        people.to_dictionary(lambda r: r["dept"])
    assert sum(1 for _ in people) == 6 and people.to_dynamic_df().count() == 6


def test_ordering_and_paging(graph):
    people = graph.nodes("Person").order_by(lambda n: n.name)
    assert [r["name"] for r in people.take(4).skip(1).take(2).to_list()] == ["Bob", "Carol"]
    assert people.take(-1).count() == 0
    assert [r for r in graph.nodes("Person").order_by_descending(lambda n: n.age).select(lambda n: n.name).to_list()][-1] == "Eve"
    assert sorted(people.take(3).select(lambda n: n.dept).distinct().to_list()) == ["Eng", "Sales"]


def test_sets_and_joins(graph):
    p = graph.nodes("Person")
    a, b = p.where(lambda n: n.age < 36), p.where(lambda n: n.dept == "Eng")
    assert names(a.union(b)) == ["Alice", "Carol", "Dan", "Eve"] and len(a.concat(b).to_list()) == 6
    j = p.join(graph.nodes("Person"), lambda x: x.age, lambda y: y.age - 5, lambda x, y: {"x": x.name, "y": y.name})
    assert sorted((r["x"], r["y"]) for r in j.to_list()) == [("Alice", "Dan"), ("Carol", "Alice"), ("Dan", "Bob")]
    for bad in (lambda: a.union(b).concat(a), lambda: a.union(b).where(lambda n: n.age > 1), lambda: p.join(a, lambda x: x.age, lambda y: y.age, lambda x, y: x), lambda: a.union(p.select(lambda n: n.age))):
        with pytest.raises(GraphQueryError):
            bad()


def test_search(graph):
    assert names(graph.nodes("Person").search("CODE alice")) == ["Alice"] and names(graph.nodes("Person").search("cod")) == []
    assert names(graph.search_nodes("Sales", "Person")) == [] and graph.search_nodes("acme").count() == 1
    assert graph.search("code").to_df().count() == 5 and graph.search(" ").to_df().count() == 0
    with pytest.raises(GraphQueryError):
        graph.search("code").traverse("KNOWS", "Person")


def test_rejected_shapes(graph):
    p = graph.nodes("Person")
    path = p.traverse_paths("KNOWS", "Person", 1, 2)
    for bad in (
        lambda: p.last(), lambda: p.element_at(-1), lambda: p.traverse("KNOWS", "Person", 0, 2), lambda: p.traverse("KNOWS", "Person", 3, 2), lambda: p.order_by(lambda n: n),
        lambda: p.take(2).count(lambda n: n.age > 1), lambda: p.take(3).where(lambda n: n.age > 1).take(2).where(lambda n: n.age > 2), lambda: p.take(1).of_label("Person"),
        lambda: p.select(lambda n: n.age).where_has_relationship("KNOWS"), lambda: path.order_by(lambda x: x.depth), lambda: path.distinct(), lambda: path.take(1).where(lambda x: x.depth > 1),
        lambda: p.group_by(lambda n: n), lambda: p.group_by(lambda n: n.dept).group_by(lambda n: n.age), lambda: p.group_by(lambda n: n.dept).take(1), lambda: p.select_many(lambda n: n.tags),
        lambda: p.traverse("KNOWS", "Person").group_by(lambda n: n.dept), lambda: p.where(lambda n: n.nothing == 1), lambda: p.then_by(lambda n: n.age), lambda: graph.nodes("Nobody"),
        lambda: p.traverse("KNOWS", "Person").optional_traverse("WORKS_AT", "Company"), lambda: Property("tags", key=True, collection=True), lambda: X.contains(F.lit("a"), "a", "ignore_case"),
    ):
        with pytest.raises(GraphQueryError):
            bad()


def test_mutations(graph):
    store = GraphStore(graph)
    store.create_node("Person", {"name": "Gina", "age": 20, "email": "g@x"})
    assert store.graph.nodes("Person").count() == 7
    for bad in ({"name": "Gina"}, {"name": "Hal", "email": "g@x"}, {"name": "H"}, {"age": 3}):
        with pytest.raises(ConstraintError):
            store.create_node("Person", bad)
    store.create_relationship(lambda g: g.nodes("Person").where(lambda n: n.name == "Gina"), ("KNOWS", {"since": 1}), lambda g: g.nodes("Person").where(lambda n: n.name == "Frank"))
    assert names(store.graph.nodes("Person").where(lambda n: n.name == "Gina").traverse("KNOWS", "Person")) == ["Frank"]
    with pytest.raises(CardinalityError):
        store.create_relationship(lambda g: g.nodes("Person"), ("KNOWS", {}), ("Person", {"name": "Ida"}))
    store.create_self_loop(lambda g: g.nodes("Person").where(lambda n: n.name == "Frank"), ("KNOWS", {"since": 2}))
    assert store.update(lambda g: g.nodes("Person").where(lambda n: n.dept == "Sales"), {"age": lambda n: n.age + 1, "dept": "S"}) == 2
    assert sorted(store.graph.nodes("Person").where(lambda n: n.dept == "S").select(lambda n: n.age).to_list()) == [31, 41]
    with pytest.raises(ConstraintError):
        store.update(lambda g: g.nodes("Person"), {"name": "Same"})
    with pytest.raises(ConstraintError):
        store.delete(lambda g: g.nodes("Person").where(lambda n: n.name == "Frank"))
    assert store.delete(lambda g: g.nodes("Person").where(lambda n: n.name == "Frank"), cascade=True) == 1
    assert store.delete(lambda g: g.relationships("KNOWS").where(lambda r: r.since == 5)) == 1
    assert graph.nodes("Person").count() == 6 and store.graph.nodes("Person").count() == 6


def test_transactions(graph):
    store = GraphStore(graph)
    with store.begin() as tx:
        tx.create(("Person", {"name": "Jo"}), ("WORKS_AT", {}), ("Company", {"title": "New"}))
        assert tx.graph.nodes("Company").count() == 2 and store.graph.nodes("Company").count() == 1
        tx.commit()
    assert store.graph.nodes("Company").count() == 2
    with store.begin() as tx:
        tx.create_node("Company", {"title": "Never"})
    assert store.graph.nodes("Company").count() == 2
    with pytest.raises(GraphQueryError):
        tx.create_node("Company", {"title": "Late"})


def test_functions(spark):
    row = spark.sql("SELECT 'John' AS f, 'Software Engineer' AS b, 30 AS a, CAST(NULL AS STRING) AS z, timestamp_ntz'2024-02-29 13:14:15.678' AS t")
    f, b, a, z, t = (F.col(c) for c in "fbazt")
    got = row.select(
        X.to_upper(f), X.substring(b, 0, 8), X.replace(f, "o", "0"), X.length(b), X.abs_(a - 25), X.ceiling(a / 7), X.floor(a / 7), X.round_(F.lit(2.5)), X.power(2, 3), X.concat(f, z), X.join("-", f, z, b),
        X.trim(F.lit("\t x\n ")), X.pad_left(f, 3), X.pad_left(f, 6, "*"), X.last_index_of(b, "e"), X.index_of(b, "q"), X.div(F.lit(-7), 2), X.millisecond(t), X.day_of_week(t), X.time_of_day(t),
        X.add_years(t, 1).cast("string"), X.add_milliseconds(t, 500).cast("string"), X.is_null_or_white_space(F.lit(" \t")), X.compare_to(f, "Z"), X.min_(a, 3), X.divide(F.lit(1), 0),
    ).first()
    assert list(got) == [
        "JOHN", "Software", "J0hn", 17, 5, 5.0, 4.0, 2.0, 8.0, "John", "John--Software Engineer", "x", "John", "**John", 15, -1, -3, 678, 4, 47655678000,
        "2025-02-28 13:14:15.678", "2024-02-29 13:14:16.178", True, -1, 3, float("inf"),
    ]

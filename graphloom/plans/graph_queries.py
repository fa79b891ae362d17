"""One query for each operator of the graph surface over the whole tables, with equal SQL where its recursion ends in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintError
from ..functions import scalar as X
from ..graph import PropertyGraph
from ..sources.tables import load_graph
from ..store import GraphStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

REFERS = """refers AS (
  SELECT k * 10 AS eid, k AS src, (k * 7 + 3) % n AS dst, (k * 13) % 100 AS weight FROM cust
  UNION ALL SELECT k * 10 + 1, k, (k * 11 + 5) % n, (k * 17 + 1) % 100 FROM cust WHERE k % 2 = 0
  UNION ALL SELECT k * 10 + 2, k, (k * 7 + 3) % n, (k * 19 + 2) % 100 FROM cust WHERE k % 10 = 0
  UNION ALL SELECT k * 10 + 3, k, k, (k * 23 + 3) % 100 FROM cust WHERE k % 50 = 0)"""
CUST = "cust AS (SELECT c_custkey AS k, (SELECT count(*) FROM customer) AS n FROM customer)"
BOTH = """both_ways AS (SELECT eid, src AS a, dst AS b, weight FROM refers
  UNION ALL SELECT eid, dst, src, weight FROM refers WHERE src <> dst)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the graph that returns a DataFrame."""
    def add(f: Callable[[PropertyGraph], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(load_graph(spark, folder))
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def dbl(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# scans

@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_nodes(g):
    return g.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "c_name": n.c_name, "c_acctbal": n.c_acctbal}).to_df()


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 8000")
def scan_subtype(g):
    return g.nodes("VipCustomer").select(lambda n: {"c_custkey": n.c_custkey, "c_acctbal": n.c_acctbal}).to_df()


@query("SELECT l_quantity AS quantity, l_discount AS discount FROM lineitem")
def scan_edges(g):
    return g.relationships("CONTAINS").select(lambda r: {"quantity": r.quantity, "discount": r.discount}).to_df()


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'PLACED_URGENT' ELSE 'PLACED' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def scan_edges_derived(g):
    return g.relationships("PLACED").group_by(lambda r: r.type).select(lambda x: {"kind": x.key, "n": x.count()}).to_df()


@query("""SELECT label, n FROM (SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region
UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part
UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Page', count(*) FROM pages
UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Turn', count(*) FROM conversations) t""")
def dyn_nodes(g):
    return g.dynamic_nodes().group_by(lambda n: F.element_at(n.labels, 1)).select(lambda x: {"label": x.key, "n": x.count()}).to_df()


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey >= 2")
def dyn_node_properties(g):
    q = g.dynamic_nodes().where(lambda n: X.has_label(n.labels, "Nation") & (X.get_property(n.props, "n_regionkey", "int") >= 2))
    return q.select(lambda n: {"name": X.get_property(n.props, "n_name"), "region": X.get_property(n.props, "n_regionkey", "int")}).to_df()


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'PLACED_URGENT' ELSE 'PLACED' END AS kind FROM orders
UNION ALL SELECT 'CONTAINS' FROM lineitem UNION ALL SELECT 'SUPPLIED_BY' FROM lineitem UNION ALL SELECT 'LIVES_IN' FROM customer
UNION ALL SELECT 'BASED_IN' FROM supplier UNION ALL SELECT 'PART_OF' FROM nation
UNION ALL SELECT 'NEXT_TURN' FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)
UNION ALL SELECT 'NEXT_EVENT' FROM (SELECT lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events) WHERE x IS NOT NULL
UNION ALL SELECT 'REFERS' FROM customer UNION ALL SELECT 'REFERS' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'REFERS' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'REFERS' FROM customer WHERE c_custkey % 50 = 0) t GROUP BY kind""")
def dyn_edges(g):
    return g.dynamic_relationships().group_by(lambda r: r.type).select(lambda x: {"kind": x.key, "n": x.count()}).to_df()


# filters

@query("SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR NOT (c_acctbal >= 0)")
def where_and_or(g):
    return g.nodes("Customer").where(lambda n: ((n.c_acctbal > 5000) & (n.c_mktsegment == "BUILDING")) | ~(n.c_acctbal >= 0)).select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_acctbal < 4000 AND c_nationkey <> 3 AND c_nationkey <= 20")
def where_chain(g):
    q = g.nodes("Customer").where(lambda n: n.c_acctbal > 1000).where(lambda n: n.c_acctbal < 4000).where(lambda n: (n.c_nationkey != 3) & (n.c_nationkey <= 20))
    return q.select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def where_in(g):
    return g.nodes("Customer").where(lambda n: n.c_mktsegment.isin("BUILDING", "MACHINERY")).select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 5) IS NULL OR nullif(c_nationkey, 7) = 8")
def where_null(g):
    q = g.nodes("Customer").where(lambda n: F.nullif(n.c_nationkey, F.lit(5)).isNull() | (F.nullif(n.c_nationkey, F.lit(7)) == 8))
    return q.select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT c_acctbal * 2 AS value FROM customer WHERE c_acctbal * 2 > 9000")
def where_after_select(g):
    return g.nodes("Customer").select(lambda n: n.c_acctbal * 2).where(lambda v: v > 9000).to_df()


@query("SELECT c_custkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 200) t WHERE c_mktsegment = 'BUILDING'")
def where_after_take(g):
    q = g.nodes("Customer").order_by_descending(lambda n: n.c_acctbal).then_by(lambda n: n.c_custkey).take(200)
    return q.where(lambda n: n.c_mktsegment == "BUILDING").select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 8000")
def of_label_any(g):
    return g.nodes("Customer").of_labels("any", ["VipCustomer", "Region"]).select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def of_label_all(g):
    return g.nodes("Order").of_labels("all", ["Order", "UrgentOrder"]).select(lambda n: {"o_orderkey": n.o_orderkey}).to_df()


@query("SELECT doc_id, len(x) AS n, has_null FROM (SELECT doc_id, [lang, nullif(source, 'src0')] AS x, source = 'src0' AS has_null FROM documents) t")
def array_contains_null(g):
    def shape(n):
        tags = F.array(n.lang, F.nullif(n.source, F.lit("src0")))
        return {"doc_id": n.doc_id, "n": X.count_of(tags).cast("long"), "has_null": X.member(tags, None)}

    return g.nodes("Document").select(shape).to_df()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def has_rel_out(g):
    return g.nodes("Customer").where_has_relationship("PLACED_URGENT").select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def has_rel_in(g):
    return g.nodes("Part").where_has_relationship("CONTAINS", "in", lambda r: r.quantity > 49).select(lambda n: {"p_partkey": n.p_partkey}).to_df()


@query(f"WITH {CUST}, {REFERS} SELECT k AS c_custkey FROM cust WHERE k IN (SELECT src FROM refers WHERE weight > 90) OR k IN (SELECT dst FROM refers WHERE weight > 90)")
def has_rel_both(g):
    return g.nodes("Customer").where_has_relationship("REFERS", "both", lambda r: r.weight > 90).select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def has_rel_node(g):
    return g.nodes("Customer").where_has_relationship("PLACED", "out", node="UrgentOrder").select(lambda n: {"c_custkey": n.c_custkey}).to_df()


# projections

@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' ELSE 'none' END AS class FROM customer")
def project_case(g):
    return g.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "class": F.when(n.c_acctbal > 5000, "high").when(n.c_acctbal > 0, "low").otherwise("none")}).to_df()


@query("SELECT p_size * 2 + 1 AS value FROM part WHERE p_size * 2 + 1 > 40")
def project_chained(g):
    return g.nodes("Part").select(lambda n: n.p_size * 2).select(lambda v: v + 1).where(lambda v: v > 40).to_df()


@query("SELECT DISTINCT len(c_mktsegment) AS value FROM customer")
def project_scalar_distinct(g):
    return g.nodes("Customer").select(lambda n: X.length(n.c_mktsegment).cast("long")).distinct().to_df()


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS seg FROM customer")
def project_coalesce(g):
    return g.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "seg": F.coalesce(F.nullif(n.c_mktsegment, F.lit("BUILDING")), F.lit("-"))}).to_df()


@query("SELECT c_custkey, o_orderkey, 'out' AS dir FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000")
def project_segment(g):
    q = g.nodes("Customer").path_segments("PLACED", "Order").where(lambda s: s.end.o_totalprice > 400000)
    return q.select(lambda s: {"c_custkey": s.start.c_custkey, "o_orderkey": s.end.o_orderkey, "dir": s.direction}).to_df()


@query("""SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: len(x) > 4)) AS n_long, list_contains(w, 'the') AS has_the,
len(list_filter(w, lambda x: len(x) >= 1)) = len(w) AS all_some, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS total,
coalesce(w[1], '') AS first_word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) t""")
def project_collection(g):
    def shape(n):
        w = F.split(n.text, " ")
        return {
            "doc_id": n.doc_id, "n": X.count_of(w).cast("long"), "n_long": X.count_of(w, lambda x: F.length(x) > 4).cast("long"), "has_the": X.any_of(w, lambda x: x == "the"),
            "all_some": X.all_of(w, lambda x: F.length(x) >= 1), "total": X.sum_of(X.select_of(w, lambda x: F.length(x)), "long"), "first_word": F.get(w, 0),
        }

    return g.nodes("Document").select(shape).to_df()


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS n FROM customer")
def degree_out(g):
    return g.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "n": n.count_relationships("PLACED_URGENT")}).to_df()


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
def degree_in(g):
    return g.nodes("Nation").select(lambda n: {"n_nationkey": n.n_nationkey, "n": n.count_relationships("LIVES_IN", "in")}).to_df()


@query(f"WITH {CUST}, {REFERS}, {BOTH} SELECT k AS c_custkey, count(eid) AS n FROM cust LEFT JOIN both_ways ON a = k GROUP BY k")
def degree_both(g):
    return g.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "n": n.count_relationships("REFERS", "both")}).to_df()


# scalar functions

@query("""SELECT c_custkey, len(c_name) AS n, contains(c_name, '00') AS has, starts_with(c_name, 'Cust') AS st, ends_with(c_name, '7') AS en,
lower(c_name) AS lo, upper(c_name) AS up, replace(c_name, '#', '-') AS re, substr(c_name, 4, 5) AS su, strpos(c_name, '#') - 1 AS ix,
CASE WHEN strpos(reverse(c_name), '0') = 0 THEN -1 ELSE len(c_name) - strpos(reverse(c_name), '0') END AS li FROM customer""")
def fn_string_basic(g):
    def shape(n):
        s = n.c_name
        return {
            "c_custkey": n.c_custkey, "n": X.length(s).cast("long"), "has": X.contains(s, "00"), "st": X.starts_with(s, "Cust"), "en": X.ends_with(s, "7"), "lo": X.to_lower(s), "up": X.to_upper(s),
            "re": X.replace(s, "#", "-"), "su": X.substring(s, 3, 5), "ix": X.index_of(s, "#").cast("long"), "li": X.last_index_of(s, "0").cast("long"),
        }

    return g.nodes("Customer").select(shape).to_df()


@query("""SELECT p_partkey, lpad(p_name, CAST(greatest(len(p_name), 14) AS INTEGER), '*') AS pl, rpad(p_name, CAST(greatest(len(p_name), 14) AS INTEGER), '.') AS pr,
trim('  ' || p_name || ' ') AS tr, CASE WHEN p_name < 'm' THEN -1 WHEN p_name > 'm' THEN 1 ELSE 0 END AS cm, CAST(p_size AS VARCHAR) AS ts,
nullif(p_brand, 'Brand#2') IS NULL OR nullif(p_brand, 'Brand#2') = '' AS ne, p_name || coalesce(nullif(p_brand, 'Brand#2'), '') AS co,
p_name || '|' || coalesce(nullif(p_brand, 'Brand#2'), '') || '|' || p_type AS jo FROM part""")
def fn_string_more(g):
    def shape(n):
        brand = F.nullif(n.p_brand, F.lit("Brand#2"))
        return {
            "p_partkey": n.p_partkey, "pl": X.pad_left(n.p_name, 14, "*"), "pr": X.pad_right(n.p_name, 14, "."), "tr": X.trim(X.concat("  ", n.p_name, " ")), "cm": X.compare_to(n.p_name, "m"),
            "ts": X.to_string(n.p_size), "ne": X.is_null_or_empty(brand), "co": X.concat(n.p_name, brand), "jo": X.join("|", n.p_name, brand, n.p_type),
        }

    return g.nodes("Part").select(shape).to_df()


@query("""SELECT p_partkey, abs(p_size - 25) AS ab, floor(p_retailprice / 7) AS fl, ceil(p_retailprice / 7) AS ce, round_even(p_size / 2.0, 0) AS ro,
least(p_size, 10) AS mi, greatest(p_size, 10) AS ma, sqrt(p_size) AS sq, CAST(sign(p_size - 25) AS INTEGER) AS sg, p_size // 7 AS dv, p_size % 7 AS md, -p_size AS ng FROM part""")
def fn_math_basic(g):
    def shape(n):
        s = n.p_size
        return {
            "p_partkey": n.p_partkey, "ab": X.abs_(s - 25), "fl": X.floor(n.p_retailprice / 7), "ce": X.ceiling(n.p_retailprice / 7), "ro": X.round_(s / 2), "mi": X.min_(s, 10), "ma": X.max_(s, 10),
            "sq": X.sqrt(s), "sg": X.sign(s - 25), "dv": X.div(s, 7).cast("int"), "md": s % 7, "ng": -s,
        }

    return g.nodes("Part").select(shape).to_df()


@query("""SELECT p_partkey, round(exp(p_size / 50.0), 8) AS ex, round(pow(p_size, 2), 6) AS po, round(sin(p_size), 8) AS si, round(cos(p_size), 8) AS co, round(tan(p_size), 6) AS ta,
round(asin(p_size / 100.0), 8) AS asn, round(acos(p_size / 100.0), 8) AS acs, round(atan(p_size), 8) AS atn, round(atan2(p_size, 3), 8) AS at2, round(ln(p_size), 8) AS lg, round(log10(p_size), 8) AS lt FROM part WHERE p_size > 0""")
def fn_math_trig(g):
    def shape(n):
        s = n.p_size
        r = {
            "ex": X.exp(s / 50), "po": X.power(s, 2), "si": X.sin(s), "co": X.cos(s), "ta": X.tan(s), "asn": X.asin(s / 100), "acs": X.acos(s / 100),
            "atn": X.atan(s), "at2": X.atan2(s, 3), "lg": X.log(s), "lt": X.log10(s),
        }
        return {"p_partkey": n.p_partkey} | {k: F.round(v, 6 if k in ("po", "ta") else 8) for k, v in r.items()}

    return g.nodes("Part").where(lambda n: n.p_size > 0).select(shape).to_df()


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi,
CAST(floor(second(ts)) AS INTEGER) AS s, CAST(dayofweek(ts) AS INTEGER) AS dw, CAST(dayofyear(ts) AS INTEGER) AS dy, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt,
CAST((millisecond(ts) % 1000) AS INTEGER) AS ms FROM events""")
def fn_temporal_parts(g):
    def shape(n):
        t = n.ts
        return {
            "event_id": n.event_id, "y": X.year(t), "mo": X.month(t), "d": X.day(t), "h": X.hour(t), "mi": X.minute(t), "s": X.second(t), "dw": X.day_of_week(t), "dy": X.day_of_year(t),
            "dt": X.date(t).cast("string"), "ms": X.millisecond(t),
        }

    return g.nodes("Event").select(shape).to_df()


@query("""SELECT event_id, strftime(ts + INTERVAL 1 YEAR, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts + INTERVAL 2 MONTH, '%Y-%m-%d %H:%M:%S') AS b, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS c,
strftime(ts + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS d, strftime(ts + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS e, strftime(ts + INTERVAL 6 SECOND, '%Y-%m-%d %H:%M:%S') AS f FROM events""")
def fn_temporal_add(g):
    def shape(n):
        t, show = n.ts, lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return {"event_id": n.event_id, "a": show(X.add_years(t, 1)), "b": show(X.add_months(t, 2)), "c": show(X.add_days(t, 3)), "d": show(X.add_hours(t, 4)), "e": show(X.add_minutes(t, 5)), "f": show(X.add_seconds(t, 6))}

    return g.nodes("Event").select(shape).to_df()


@query("""SELECT event_id, CAST(m // 86400000000 AS INTEGER) AS d, CAST(m // 3600000000 % 24 AS INTEGER) AS h, CAST(m // 60000000 % 60 AS INTEGER) AS mi,
CAST(m // 1000000 % 60 AS INTEGER) AS s, CAST(m // 1000 % 1000 AS INTEGER) AS ms, m / 3600000000 AS th FROM (SELECT event_id, event_id * 98765432 AS m FROM events) t""")
def fn_timespan(g):
    def shape(n):
        m = n.event_id * 98765432
        return {"event_id": n.event_id, "d": X.span_part(m, "days"), "h": X.span_part(m, "hours"), "mi": X.span_part(m, "minutes"), "s": X.span_part(m, "seconds"), "ms": X.span_part(m, "milliseconds"), "th": X.span_total(m, "hours")}

    return g.nodes("Event").select(shape).to_df()


@query("SELECT event_id, TRY_CAST(event_type AS INTEGER) AS a, CAST(value AS VARCHAR) <> '' AS b, CAST(trunc(value) AS BIGINT) AS c FROM events")
def fn_convert(g):
    return g.nodes("Event").select(lambda n: {"event_id": n.event_id, "a": X.try_convert(n.event_type, "int"), "b": X.to_string(n.value) != "", "c": X.convert(n.value, "long")}).to_df()


# ordering, paging, distinct

@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def order_multi(g):
    q = g.nodes("Customer").order_by(lambda n: n.c_mktsegment).then_by_descending(lambda n: n.c_acctbal).then_by(lambda n: n.c_custkey)
    return q.select(lambda n: {"c_custkey": n.c_custkey, "c_mktsegment": n.c_mktsegment}).take(50).to_df()


@query("SELECT c_custkey FROM customer ORDER BY nullif(c_nationkey, 3) NULLS FIRST, c_custkey LIMIT 40")
def order_nulls_first(g):
    return g.nodes("Customer").order_by(lambda n: F.nullif(n.c_nationkey, F.lit(3))).then_by(lambda n: n.c_custkey).take(40).select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30 OFFSET 20")
def skip_take(g):
    return g.nodes("Order").order_by(lambda n: n.o_totalprice).then_by(lambda n: n.o_orderkey).skip(15).skip(5).take(60).take(30).select(lambda n: {"o_orderkey": n.o_orderkey}).to_df()


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30) t ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def take_then_order(g):
    q = g.nodes("Order").order_by(lambda n: n.o_totalprice).then_by(lambda n: n.o_orderkey).take(30)
    return q.order_by_descending(lambda n: n.o_orderdate).then_by(lambda n: n.o_orderkey).select(lambda n: {"o_orderkey": n.o_orderkey}).to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 10")
def take_then_skip(g):
    return g.nodes("Order").order_by(lambda n: n.o_totalprice).then_by(lambda n: n.o_orderkey).take(30).skip(10).select(lambda n: {"o_orderkey": n.o_orderkey}).to_df()


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def distinct_scalar(g):
    return g.nodes("Customer").select(lambda n: n.c_mktsegment).distinct().to_df()


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)")
def distinct_entity(g):
    return g.nodes("Customer").where(lambda n: n.c_acctbal > 0).traverse("LIVES_IN", "Nation").distinct().select(lambda n: {"n_nationkey": n.n_nationkey}).to_df()


@query("SELECT DISTINCT c_mktsegment AS value FROM (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7) t")
def distinct_after_take(g):
    return g.nodes("Customer").order_by(lambda n: n.c_acctbal).then_by(lambda n: n.c_custkey).take(7).select(lambda n: n.c_mktsegment).distinct().to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first(g):
    return g.nodes("Order").order_by_descending(lambda n: n.o_totalprice).then_by(lambda n: n.o_orderkey).select(lambda n: {"o_orderkey": n.o_orderkey}).first_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def last(g):
    return g.nodes("Order").order_by(lambda n: n.o_orderdate).then_by(lambda n: n.o_orderkey).select(lambda n: {"o_orderkey": n.o_orderkey}).last_df()


@query("SELECT c_name FROM customer WHERE c_custkey = 7")
def single(g):
    return g.nodes("Customer").where(lambda n: n.c_custkey == 7).select(lambda n: {"c_name": n.c_name}).single_df()


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 1 OFFSET 5")
def element_at(g):
    return g.nodes("Part").order_by(lambda n: n.p_retailprice).then_by(lambda n: n.p_partkey).select(lambda n: {"p_partkey": n.p_partkey}).element_at_df(5)


# terminals

@query("SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'F'")
def count(g):
    return g.nodes("Order").count_df(lambda n: n.o_orderstatus == "F")


@query("SELECT CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS value FROM customer WHERE c_acctbal > 1e9")
def sum_empty(g):
    return dbl(g.nodes("Customer").where(lambda n: n.c_acctbal > 1e9).sum_df(lambda n: money(n.c_acctbal)), "value")


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders")
def sum_money(g):
    return dbl(g.nodes("Order").sum_df(lambda n: money(n.o_totalprice)), "value")


@query("SELECT sum(p_size) / count(*) AS value FROM part")
def avg_int(g):
    return g.nodes("Part").average_df(lambda n: n.p_size)


@query("SELECT sum(nullif(p_size, 10)) / count(nullif(p_size, 10)) AS value FROM part")
def avg_nullable(g):
    return g.nodes("Part").average_df(lambda n: F.nullif(n.p_size, F.lit(10)))


@query("SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first_name, max(c_name) AS last_name FROM customer")
def min_max(g):
    q = g.nodes("Customer")
    out = q.min_df(lambda n: n.c_acctbal, "lo")
    for df in (q.max_df(lambda n: n.c_acctbal, "hi"), q.min_df(lambda n: n.c_name, "first_name"), q.max_df(lambda n: n.c_name, "last_name")):
        out = out.join(df)
    return out


@query("SELECT EXISTS (SELECT 1 FROM part WHERE p_size = 50) AS value")
def any_predicate(g):
    return g.nodes("Part").any_df(lambda n: n.p_size == 50)


@query("SELECT true AS value")
def all_vacuous(g):
    return g.nodes("Part").where(lambda n: n.p_size > 1000).all_df(lambda n: n.p_size < 0)


@query("SELECT count(*) FILTER (p_size > 0) = count(*) AS value FROM (SELECT nullif(p_size, 10) AS p_size FROM part) t")
def all_null_is_false(g):
    return g.nodes("Part").all_df(lambda n: F.nullif(n.p_size, F.lit(10)) > 0)


@query("SELECT count(*) FILTER (x IS NULL) > 0 AS value FROM (SELECT nullif(p_size, 10) AS x FROM part) t")
def contains_null(g):
    return g.nodes("Part").select(lambda n: F.nullif(n.p_size, F.lit(10))).contains_df(None)


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 10) t")
def window_then_agg(g):
    q = g.nodes("Order").order_by(lambda n: n.o_orderdate).then_by(lambda n: n.o_orderkey).skip(10).take(100)
    return dbl(q.sum_df(lambda n: money(n.o_totalprice)), "value")


# joins and set operations

@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000")
def join_nodes(g):
    q = g.nodes("Customer").where(lambda n: n.c_acctbal > 9000)
    return q.join(g.nodes("Supplier"), lambda c: c.c_nationkey, lambda s: s.s_nationkey, lambda c, s: {"c_custkey": c.c_custkey, "s_suppkey": s.s_suppkey}).to_df()


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON nullif(s_nationkey, 3) = n_nationkey AND s_suppkey % 5 = n_regionkey")
def join_composite_null(g):
    q = g.nodes("Supplier")
    key = lambda s: (F.nullif(s.s_nationkey, F.lit(3)), s.s_suppkey % 5)
    return q.join(g.nodes("Nation"), key, lambda n: (n.n_nationkey, n.n_regionkey), lambda s, n: {"s_suppkey": s.s_suppkey, "n_name": n.n_name}).to_df()


@query(f"WITH {CUST}, {REFERS} SELECT c_custkey, eid FROM customer JOIN refers ON c_nationkey = weight")
def join_rel_payload(g):
    return g.nodes("Customer").join(g.relationships("REFERS"), lambda c: c.c_nationkey.cast("long"), lambda r: r.weight, lambda c, r: {"c_custkey": c.c_custkey, "eid": r["_eid"]}).to_df()


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 7000 OR c_nationkey = 4")
def union(g):
    q = g.nodes("Customer")
    return q.where(lambda n: n.c_acctbal > 7000).union(q.where(lambda n: n.c_nationkey == 4)).to_df().select("c_custkey")


@query("SELECT c_mktsegment AS value FROM customer WHERE c_acctbal > 7000 UNION ALL SELECT c_mktsegment FROM customer WHERE c_nationkey = 4")
def concat(g):
    q = g.nodes("Customer")
    return q.where(lambda n: n.c_acctbal > 7000).select(lambda n: n.c_mktsegment).concat(q.where(lambda n: n.c_nationkey == 4).select(lambda n: n.c_mktsegment)).to_df()


@query("SELECT c_nationkey AS value FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def union_chain(g):
    a = g.nodes("Customer").where(lambda n: n.c_acctbal > 9000).select(lambda n: n.c_nationkey)
    b = g.nodes("Supplier").select(lambda n: n.s_nationkey)
    return a.union(b).union(g.nodes("Nation").where(lambda n: n.n_regionkey == 1).select(lambda n: n.n_nationkey)).to_df()


# traversals

@query("SELECT o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def hop_out(g):
    return g.nodes("Customer").where(lambda n: n.c_mktsegment == "BUILDING").traverse("PLACED", "Order").select(lambda n: {"o_orderkey": n.o_orderkey}).to_df()


@query("SELECT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000")
def hop_in(g):
    return g.nodes("Order").where(lambda n: n.o_totalprice > 450000).reverse_traverse("PLACED", "Customer").select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query(f"WITH {CUST}, {REFERS}, {BOTH} SELECT a, b FROM both_ways WHERE weight < 20")
def hop_both(g):
    q = g.nodes("Customer").path_segments("REFERS", "Customer", "both", lambda r: r.weight < 20)
    return q.select(lambda s: {"a": s.start.c_custkey, "b": s.end.c_custkey}).to_df()


@query("SELECT o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal > 8000")
def hop_subtype(g):
    return g.nodes("VipCustomer").traverse("PLACED", "UrgentOrder").select(lambda n: {"o_orderkey": n.o_orderkey}).to_df()


@query("SELECT r_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def hop_chain(g):
    return g.nodes("Customer").traverse("LIVES_IN", "Nation").traverse("PART_OF", "Region").to_df().groupBy(F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS o, p_partkey AS p, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 480000 AND l_quantity > 40")
def hop_edge_property(g):
    q = g.nodes("Order").where(lambda n: n.o_totalprice > 480000).path_segments("CONTAINS", "Part", where=lambda r: r.quantity > 40)
    return q.select(lambda s: {"o": s.start.o_orderkey, "p": s.end.p_partkey, "q": s.relationship.quantity}).to_df()


@query(f"WITH {CUST}, {REFERS} SELECT eid, weight FROM refers")
def hop_relationships(g):
    q = g.nodes("Customer").traverse_relationships("REFERS", "Customer")
    return q.select(lambda r: {"eid": r["_eid"], "weight": r.weight}).to_df()


TRAILS = f"""WITH RECURSIVE {CUST}, {REFERS}, {BOTH}, p AS (
  SELECT {{a}} AS s, {{b}} AS d, 1 AS len, [eid] AS es FROM {{t}} WHERE true {{w}}
  UNION ALL SELECT p.s, r.{{b}}, len + 1, list_append(es, r.eid) FROM p JOIN {{t}} r ON r.{{a}} = p.d
  WHERE len < {{n}} AND NOT list_contains(es, r.eid) {{w}})"""


@query(TRAILS.format(a="src", b="dst", t="refers", n=3, w="") + " SELECT s, d FROM p")
def varlen_1_3(g):
    q = g.nodes("Customer").traverse_paths("REFERS", "Customer", 1, 3)
    return q.select(lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey}).to_df()


@query(TRAILS.format(a="src", b="dst", t="refers", n=4, w="AND weight > 30") + " SELECT d FROM p WHERE len >= 2")
def varlen_pred(g):
    q = g.nodes("Customer").traverse("REFERS", "Customer", 2, 4, where=lambda r: r.weight > 30)
    return q.select(lambda n: {"d": n.c_custkey}).to_df()


@query(TRAILS.format(a="a", b="b", t="both_ways", n=2, w="") + " SELECT s, d, len FROM p")
def varlen_both(g):
    q = g.nodes("Customer").traverse_paths("REFERS", "Customer", 1, 2, "both")
    return q.select(lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey, "len": p.depth}).to_df()


@query(TRAILS.format(a="src", b="dst", t="refers", n=5, w="") + " SELECT s, d, len, es FROM p WHERE len >= 3")
def paths_depth(g):
    q = g.nodes("Customer").traverse_paths("REFERS", "Customer", 3, 5)
    return q.select(lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey, "len": p.depth, "es": p.edge_ids}).to_df()


@query("""SELECT s_suppkey, r_name, 2 AS len FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def trail_any_type(g):
    q = g.nodes("Supplier").traverse_paths(None, "Region", 2, 2)
    return q.select(lambda p: {"s_suppkey": p.start.s_suppkey, "r_name": p.end.r_name, "len": p.depth}).to_df()


@query("""SELECT r_name AS name, kind, count(*) AS n FROM (SELECT n_regionkey AS r, 'PART_OF' AS kind FROM nation
UNION ALL SELECT n_regionkey, 'LIVES_IN' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, 'BASED_IN' FROM supplier JOIN nation ON s_nationkey = n_nationkey) t JOIN region ON r = r_regionkey GROUP BY 1, 2""")
def paths_any_type_in(g):
    q = g.nodes("Region").traverse_paths(None, None, 1, 2, "in").select(lambda p: {"name": p.start.r_name, "kind": F.element_at(p.segments, -1)["type"]})
    return q.to_df().groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS k FROM conversations), e AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON b.k = a.k + 1 AND b.k % 1000 > 0),
p AS (SELECT a AS s, b AS d, 1 AS n FROM e UNION ALL SELECT p.s, e.b, n + 1 FROM p JOIN e ON e.a = p.d WHERE n < 7)
SELECT s // 1000 AS conv_id, s % 1000 AS turn, max(n) AS depth FROM p GROUP BY s""")
def paths_turns(g):
    q = g.nodes("Turn").traverse_paths("NEXT_TURN", "Turn", 1, 7).select(lambda p: {"conv_id": p.start.conv_id, "turn": p.start.turn, "d": p.depth})
    return q.to_df().groupBy("conv_id", "turn").agg(F.max("d").alias("depth"))


# from every customer to any depth; no SQL for the first two, as its recursion lists all simple paths. A test holds them against breadth-first search

@query()
def shortest(g):
    q = g.nodes("Customer").shortest_path("REFERS", "Customer")
    return q.select(lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey, "len": p.depth}).to_df()


@query()
def shortest_predicate(g):
    q = g.nodes("Customer").shortest_path("REFERS", "Customer", lambda n: n.c_mktsegment == "BUILDING")
    return q.select(lambda p: {"s": p.start.c_custkey, "d": p.end.c_custkey, "len": p.depth}).to_df()


# all of them over REFERS are exponentially many; these are as many as there are line items
@query("""SELECT o_orderkey AS s, r_name AS d, 3 AS len, CAST(s_suppkey AS BIGINT) AS based_in FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def all_shortest(g):
    q = g.nodes("Order").all_shortest_paths(None, "Region")
    return q.select(lambda p: {"s": p.start.o_orderkey, "d": p.end.r_name, "len": p.depth, "based_in": F.get(p.edge_ids, 1)}).to_df()


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey")
def optional(g):
    return g.nodes("Customer").optional_traverse("PLACED_URGENT", "Order").select(lambda c, o: {"c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey}).to_df()


# grouping

@query("SELECT c_mktsegment AS seg, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, sum(c_nationkey) / count(*) AS mean FROM customer GROUP BY 1")
def group_scalar(g):
    q = g.nodes("Customer").group_by(lambda n: n.c_mktsegment)
    out = q.select(lambda x: {"seg": x.key, "n": x.count(), "lo": x.min(lambda n: n.c_acctbal), "hi": x.max(lambda n: n.c_acctbal), "total": x.sum(lambda n: money(n.c_acctbal)), "mean": x.average(lambda n: n.c_nationkey)})
    return dbl(out.to_df(), "total")


@query("SELECT DISTINCT o_orderstatus AS value FROM orders")
def group_key_only(g):
    return g.nodes("Order").group_by(lambda n: n.o_orderstatus).select(lambda x: x.key).to_df()


@query("SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey % 4 END AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def group_computed_key(g):
    q = g.nodes("Customer").where(lambda n: n.c_acctbal > 0).group_by(lambda n: F.when(n.c_nationkey != 3, n.c_nationkey % 4), lambda k, x: {"k": k, "n": x.count()})
    return q.to_df()


@query("""SELECT c_name AS name, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey, c_name""")
def group_corr_agg(g):
    q = g.nodes("Customer").where(lambda n: n.c_mktsegment == "BUILDING").path_segments("PLACED", "Order").group_by(lambda s: s.start)
    out = q.select(lambda x: {
        "name": x.key.c_name, "n": x.count(), "n_f": x.count(lambda s: s.end.o_orderstatus == "F"), "total": x.sum(lambda s: money(s.end.o_totalprice)),
        "lo": x.min(lambda s: s.end.o_totalprice), "hi": x.max(lambda s: s.end.o_totalprice),
    })
    return dbl(out.to_df(), "total")


@query("""SELECT c_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS by_price, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), []) AS f,
count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def group_corr_lists(g):
    q = g.nodes("Customer").path_segments("PLACED", "Order").group_by(lambda s: s.start)
    return q.select(lambda x: {
        "c_custkey": x.key.c_custkey, "by_price": x.list(lambda s: s.end.o_orderkey, order_by=lambda s: s.end.o_totalprice, descending=True),
        "f": x.list(lambda s: s.end.o_orderkey, where=lambda s: s.end.o_orderstatus == "F", order_by=lambda s: s.end.o_orderkey), "n": x.count(),
    }).to_df()


@query("""SELECT c_custkey, list(k || ':' || n ORDER BY k) AS by_status FROM (SELECT c_custkey, o_orderstatus AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) t GROUP BY 1""")
def group_corr_nested(g):
    q = g.nodes("Customer").path_segments("PLACED", "Order").group_by(lambda s: s.start)
    q = q.select(lambda x: {"c_custkey": x.key.c_custkey, "by_status": x.group_by(lambda s: s.end.o_orderstatus, lambda y: {"k": y.key, "n": y.count()})})
    return q.select(lambda r: {"c_custkey": r.c_custkey, "by_status": F.transform(r.by_status, lambda e: F.concat(e["k"], F.lit(":"), e["n"].cast("string")))}).to_df()


# search

TOKENS = "list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), '{}')"


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(TOKENS.format(t) for t in ("license", "mit")))
def search_and(g):
    return g.search_nodes("MIT, license!", "Document").select(lambda n: {"doc_id": n.doc_id}).to_df()


@query("SELECT doc_id FROM documents WHERE false")
def search_empty(g):
    return g.nodes("Document").search(" ,. ").select(lambda n: {"doc_id": n.doc_id}).to_df()


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_mktsegment) = 'machinery' AND n_regionkey = 2")
def search_then_hop(g):
    q = g.nodes("Customer").search("Machinery").path_segments("LIVES_IN", "Nation").where(lambda s: s.end.n_regionkey == 2)
    return q.select(lambda s: {"c_custkey": s.start.c_custkey, "n_name": s.end.n_name}).to_df()


@query("SELECT p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50 AND list_contains(string_split_regex(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+'), 'economy')")
def search_after_hop(g):
    return g.nodes("Order").traverse("CONTAINS", "Part", where=lambda r: r.quantity == 50).search("economy").select(lambda n: {"p_partkey": n.p_partkey}).to_df()


@query("SELECT 'node' AS kind, 'Region' AS label FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'node', 'Document' FROM documents WHERE " + TOKENS.format("asia") + " UNION ALL SELECT 'node', 'Turn' FROM conversations WHERE " + TOKENS.format("asia"))
def search_mixed(g):
    return g.search("asia").to_df().select("kind", F.element_at("_labels", 1).alias("label"))


# mutations

@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_computed(g):
    store = GraphStore(g)
    store.update(lambda g: g.nodes("Customer").where(lambda n: n.c_mktsegment == "BUILDING"), {"c_acctbal": lambda n: n.c_acctbal + 1000, "c_mktsegment": "B"})
    return store.graph.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "c_acctbal": n.c_acctbal, "c_mktsegment": n.c_mktsegment}).to_df()


#: All relationships by type, each with a test of whether it stays.
KINDS = """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'PLACED_URGENT' ELSE 'PLACED' END AS kind, {placed} AS keep FROM orders
UNION ALL SELECT 'CONTAINS', {contains} FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', true FROM lineitem UNION ALL SELECT 'LIVES_IN', {lives} FROM customer
UNION ALL SELECT 'BASED_IN', {based} FROM supplier UNION ALL SELECT 'PART_OF', {part} FROM nation
UNION ALL SELECT 'NEXT_TURN', true FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)
UNION ALL SELECT 'NEXT_EVENT', true FROM (SELECT lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events) WHERE x IS NOT NULL
UNION ALL SELECT 'REFERS', true FROM customer UNION ALL SELECT 'REFERS', true FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'REFERS', true FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'REFERS', true FROM customer WHERE c_custkey % 50 = 0"""


def kinds_sql(placed="true", contains="true", lives="true", based="true", part="true") -> str:
    rows = KINDS.format(placed=placed, contains=contains, lives=lives, based=based, part=part)
    return f"SELECT kind, count(*) AS n FROM ({rows}) t WHERE keep GROUP BY kind"


def kinds(g: PropertyGraph) -> DataFrame:
    return g.dynamic_relationships().group_by(lambda r: r.type).select(lambda x: {"kind": x.key, "n": x.count()}).to_df()


@query(kinds_sql())
def distinct_relationships(g):
    q = g.dynamic_relationships().distinct().select(lambda r: {"kind": r.type})
    return q.to_df().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'CONTAINS' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'LIVES_IN', count(*) FROM customer")
def union_relationships(g):
    q = g.dynamic_relationships()
    out = q.where(lambda r: r.type.isin("CONTAINS", "LIVES_IN")).union(q.where(lambda r: r.type == "LIVES_IN"))
    return out.to_df().groupBy(F.col("_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(kinds_sql(contains="l_quantity <= 45"))
def delete_relationships(g):
    store = GraphStore(g)
    store.delete(lambda g: g.relationships("CONTAINS").where(lambda r: r.quantity > 45))
    return kinds(store.graph)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END AS n FROM supplier")
def delete_relationships_after_hop(g):
    store = GraphStore(g)
    store.delete(lambda g: g.nodes("Supplier").where(lambda n: n.s_acctbal < 0).traverse_relationships("BASED_IN", "Nation"))
    return store.graph.nodes("Supplier").select(lambda n: {"s_suppkey": n.s_suppkey, "n": n.count_relationships("BASED_IN").cast("int")}).to_df()


IN_REGION = "{} NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"


@query(kinds_sql(lives=IN_REGION.format("c_nationkey"), based=IN_REGION.format("s_nationkey"), part="n_regionkey <> 1") + " UNION ALL SELECT 'nations', count(*) FROM nation WHERE n_regionkey <> 1")
def delete_cascade(g):
    store = GraphStore(g)
    store.delete(lambda g: g.nodes("Nation").where(lambda n: n.n_regionkey == 1), cascade=True)
    return kinds(store.graph).unionByName(store.graph.nodes("Nation").count_df(name="n").select(F.lit("nations").alias("kind"), "n"))


@query("SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region UNION ALL SELECT 'ATLANTIS', 1")
def create_in_transaction(g):
    store = GraphStore(g)
    with store.begin() as tx:
        tx.create(("Nation", {"n_nationkey": 99, "n_name": "NEW", "n_regionkey": 9}), ("PART_OF", {}), ("Region", {"r_regionkey": 9, "r_name": "ATLANTIS"}))
        tx.commit()
    with store.begin() as tx:
        tx.create_node("Region", {"r_regionkey": 10, "r_name": "NEVER"})
    return store.graph.nodes("Region").select(lambda n: {"r_name": n.r_name, "n": n.count_relationships("PART_OF", "in")}).to_df()


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT 1000000000, 'new' UNION ALL SELECT 1000000001 + s_suppkey, s_name FROM supplier WHERE s_acctbal > 9000")
def create_nodes(g):
    store = GraphStore(g)
    store.create_node("Customer", {"c_custkey": 1000000000, "c_name": "new"})
    more = g.node_tables["Supplier"].where("s_acctbal > 9000").select((F.col("s_suppkey") + 1000000001).alias("c_custkey"), F.col("s_name").alias("c_name"))
    store.create_nodes("Customer", more)
    return store.graph.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "c_name": n.c_name}).to_df()


@query("SELECT 'NATION_1' AS a, 'NATION_2' AS b UNION ALL SELECT 'NATION_1', 'FAR' UNION ALL SELECT 'FAR', 'NATION_2'")
def create_relationships(g):
    store = GraphStore(g)
    one = lambda name: lambda g: g.nodes("Nation").where(lambda n: n.n_name == name)
    store.create_relationship(one("NATION_1"), ("BORDERS", {}), one("NATION_2"))
    store.create_relationship(one("NATION_1"), ("BORDERS", {}), ("Nation", {"n_nationkey": 99, "n_name": "FAR"}))
    store.create_relationship(one("NATION_2"), ("BORDERS", {}), one("FAR"), direction="in")
    q = store.graph.nodes("Nation").path_segments("BORDERS", "Nation")
    return q.select(lambda s: {"a": s.start.n_name, "b": s.end.n_name}).to_df()


@query(f"WITH {CUST}, {REFERS} SELECT k AS c_custkey, (SELECT count(*) FROM refers WHERE src = k) + CASE WHEN k = 7 THEN 1 ELSE 0 END AS n FROM cust")
def create_self_loop(g):
    store = GraphStore(g)
    store.create_self_loop(lambda g: g.nodes("Customer").where(lambda n: n.c_custkey == 7), ("REFERS", {"weight": 1}))
    return store.graph.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "n": n.count_relationships("REFERS")}).to_df()


@query("""SELECT * FROM (VALUES ('duplicate key', 'c_custkey is not unique'), ('no name', 'property c_name is required'), ('renamed to null', 'property c_name is required'),
('same keys', 'c_custkey is not unique'), ('with relationships', 'nodes with relationships are only deleted by cascade')) t(given, error)""")
def constraints(g):
    store, out = GraphStore(g), []
    vip = lambda g: g.nodes("VipCustomer")
    for given, command in (
        ("duplicate key", lambda: store.create_node("Customer", {"c_custkey": 1, "c_name": "again"})), ("no name", lambda: store.create_node("Customer", {"c_custkey": -1})),
        ("renamed to null", lambda: store.update(vip, {"c_name": None})), ("same keys", lambda: store.update(vip, {"c_custkey": 5})), ("with relationships", lambda: store.delete(vip)),
    ):
        try:
            command()
            out.append((given, "none"))
        except ConstraintError as e:
            out.append((given, str(e)))
    return g.spark.createDataFrame(out, "given string, error string")


# complex properties

def with_home(g: PropertyGraph) -> PropertyGraph:
    """Customers with a property that is a structure, and null for those in debt."""
    home = F.struct(F.struct(F.col("c_nationkey").alias("code"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("seen")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    table = g.node_tables["Customer"]
    return g.replaced(nodes={"Customer": table.withColumn("home", F.when(F.col("c_acctbal") >= 0, home))})


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def complex_is_null(g):
    return with_home(g).nodes("Customer").where(lambda n: n.home.isNull()).select(lambda n: {"c_custkey": n.c_custkey}).to_df()


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS code FROM customer WHERE (c_acctbal >= 0 AND c_nationkey > 20) OR c_mktsegment = 'BUILDING'")
def complex_nested(g):
    q = with_home(g).nodes("Customer").where(lambda n: (n.home["nation"]["code"] > 20) | (n.c_mktsegment == "BUILDING"))
    return q.select(lambda n: {"c_custkey": n.c_custkey, "code": n.home["nation"]["code"]}).to_df()


@query("SELECT c_custkey, c_acctbal < 0 OR c_nationkey = 3 AS unseen, CASE WHEN c_acctbal >= 0 AND c_nationkey <> 3 THEN c_nationkey + 1 END AS next FROM customer")
def null_propagation(g):
    q = with_home(g).nodes("Customer")
    return q.select(lambda n: {"c_custkey": n.c_custkey, "unseen": n.home["nation"]["seen"].isNull(), "next": n.home["nation"]["seen"] + 1}).to_df()


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 7 WHEN c_acctbal >= 0 THEN c_nationkey END AS code,
CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer""")
def update_complex(g):
    store = GraphStore(with_home(g))
    of = lambda segment: lambda g: g.nodes("Customer").where(lambda n: n.c_mktsegment == segment)
    store.update(of("BUILDING"), {"home": {"nation": {"code": 7, "seen": None}, "segment": "B"}})
    store.update(of("MACHINERY"), {"home": None})
    return store.graph.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "code": n.home["nation"]["code"], "segment": n.home["segment"]}).to_df()


# more of the surface

@query("SELECT o_orderkey AS eid, 'PLACED_URGENT' AS kind FROM orders WHERE o_orderpriority = '1-URGENT'")
def search_relationships(g):
    return g.search_relationships("urgent 1", "PLACED").select(lambda r: {"eid": r["_eid"], "kind": r.type}).to_df()


@query("SELECT 'PLACED_URGENT' AS kind, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def search_any_relationship(g):
    return g.search_relationships("Urgent").to_df().groupBy(F.col("_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN c_acctbal > 8000 THEN 'VipCustomer' ELSE 'Customer' END AS label, count(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY 1")
def widen_base(g):
    q = g.nodes("Customer").where(lambda n: n.c_nationkey < 10).group_by(lambda n: F.element_at(n.labels, -1))
    return q.select(lambda x: {"label": x.key, "n": x.count()}).to_df()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_degree(g):
    q = g.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "n": n.count_relationships("PLACED_URGENT")}).where(lambda r: r.n == 0)
    return q.select(lambda r: {"c_custkey": r.c_custkey}).to_df()


@query("SELECT o_orderstatus AS k, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def group_result_selector(g):
    return g.nodes("Order").group_by(lambda n: n.o_orderstatus, lambda k, x: {"k": k, "n": x.count(), "hi": x.max(lambda n: n.o_totalprice)}).to_df()


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer ORDER BY twice DESC, c_custkey LIMIT 25")
def order_after_select(g):
    q = g.nodes("Customer").select(lambda n: {"c_custkey": n.c_custkey, "twice": n.c_acctbal * 2})
    return q.order_by_descending(lambda r: r.twice).then_by(lambda r: r.c_custkey).take(25).to_df()


@query("SELECT event_id, ts < now() AS past, CAST(ts AS DATE) <= current_date AS by_today, year(current_date) >= 2024 AS late FROM events")
def fn_now(g):
    return g.nodes("Event").select(lambda n: {"event_id": n.event_id, "past": n.ts < X.now(), "by_today": X.date(n.ts) <= X.today(), "late": X.year(X.today()) >= 2024}).to_df()


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(dayofweek(ts) AS INTEGER) AS dw, CAST(dayofyear(ts) AS INTEGER) AS dy,
strftime(CAST(ts AS DATE) + INTERVAL 2 MONTH, '%Y-%m-%d') AS later FROM events""")
def fn_date_only(g):
    def shape(n):
        d = X.date(n.ts)
        return {"event_id": n.event_id, "y": X.year(d), "mo": X.month(d), "d": X.day(d), "dw": X.day_of_week(d), "dy": X.day_of_year(d), "later": F.date_format(X.add_months(d, 2), "yyyy-MM-dd")}

    return g.nodes("Event").select(shape).to_df()


@query("""SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(floor(second(ts)) AS INTEGER) AS s, CAST(millisecond(ts) % 1000 AS INTEGER) AS ms,
CAST(epoch_us(ts) % 86400000000 AS BIGINT) AS day_us FROM events""")
def fn_time_only(g):
    def shape(n):
        t = X.time_of_day(n.ts)
        return {"event_id": n.event_id, "h": X.time_part(t, "hours"), "mi": X.time_part(t, "minutes"), "s": X.time_part(t, "seconds"), "ms": X.time_part(t, "milliseconds"), "day_us": t}

    return g.nodes("Event").select(shape).to_df()


@query("SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS loc FROM events")
def fn_time_zone(g):
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return g.nodes("Event").select(lambda n: {"event_id": n.event_id, "utc": show(X.to_universal_time(n.ts, "+03:00")), "loc": show(X.to_local_time(n.ts, "+03:00"))}).to_df()


@query("SELECT o_orderkey, o_orderstatus = 'F' AS is_f, o_orderstatus <> 'O' AS not_o, o_orderstatus IN ('O', 'P') AS one_of FROM orders")
def fn_enum(g):
    return g.nodes("Order").select(lambda n: {"o_orderkey": n.o_orderkey, "is_f": n.o_orderstatus == "F", "not_o": n.o_orderstatus != "O", "one_of": n.o_orderstatus.isin("O", "P")}).to_df()


@query("""SELECT n_name AS name, true AS has, false AS has_not, 'n_name,n_nationkey,n_regionkey' AS props, false AS region FROM nation
UNION ALL SELECT r_name, false, false, 'r_name,r_regionkey', true FROM region""")
def fn_dynamic(g):
    q = g.dynamic_nodes().where(lambda n: X.has_any_label(n.labels, "Nation", "Region"))
    return q.select(lambda n: {
        "name": F.coalesce(X.get_property(n.props, "n_name"), X.get_property(n.props, "r_name")), "has": X.has_property(n.props, "n_name"), "has_not": X.has_property(n.props, "p_name"),
        "props": F.array_join(X.property_names(n.props), ","), "region": X.has_all_labels(n.labels, "Region"),
    }).to_df()


@query("""SELECT c_custkey, len(x) AS n, CAST(list_sum(x) AS BIGINT) AS total, list_avg(x) AS mean, CAST(list_min(x) AS BIGINT) AS lo, CAST(list_max(x) AS BIGINT) AS hi
FROM (SELECT c_custkey, [c_custkey + 9007199254740992, c_nationkey, 4] AS x FROM customer) t""")
def fn_array_aggregates(g):
    def shape(n):
        x = F.array(n.c_custkey + 9007199254740992, n.c_nationkey.cast("long"), F.lit(4).cast("long"))
        return {"c_custkey": n.c_custkey, "n": X.count_of(x).cast("long"), "total": X.sum_of(x, "long"), "mean": X.average_of(x), "lo": X.min_of(x), "hi": X.max_of(x)}

    return g.nodes("Customer").select(shape).to_df()


FLAGSHIP = "flagship"


@query("""SELECT c_name AS name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey, c_name""")
def flagship(g):
    q = g.nodes("Customer").where(lambda n: n.c_mktsegment == "BUILDING").path_segments("PLACED", "Order").group_by(lambda s: s.start)
    return dbl(q.select(lambda x: {"name": x.key.c_name, "n": x.count(), "total": x.sum(lambda s: money(s.end.o_totalprice))}).to_df(), "total")

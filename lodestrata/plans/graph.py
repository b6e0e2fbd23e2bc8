"""Queries of graph analytics (H): parts are symbols, shipments calls, suppliers' parts routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import graph as H
from lodestrata.plans.registry import query, table
from lodestrata.sources.shared import by_shuffle, store


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a symbol of 1 to 50 lines that starts at ten lines from the next, in one of 25 files of equal paths in each
    of two snapshots (odd and even numbers). Every ninth is a class, and every second of these has the next but one as constructor."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    f = F.floor(k / 2) % 25
    lead = F.when(f % 5 == 0, "test/").when(f % 7 == 0, "scripts/").otherwise("src/")
    start = (F.floor(k / 50) * 10 + 1).cast("int")
    made = k % 18 == 2
    return p.select(k.alias("symbol_id"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("snapshot_id"), F.concat(lead, F.lit("f"), f.cast("string"), F.lit(".ts")).alias("path"), F.when(k % 9 == 0, "class").otherwise("function").alias("kind"), F.when(made, "constructor").otherwise(F.concat(F.lit("n"), (k % 97).cast("string"))).alias("name"), F.when(made, k - 2).alias("parent_id"), start.alias("start_line"), (start + F.col("p_size") - 1).cast("int").alias("end_line"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shipment is a call from the part after its order's number to its own part, on a line of the caller's file, where both are of one snapshot."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    l = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select((F.col("l_orderkey") % F.col("n") + 1).alias("a"), F.col("l_partkey").alias("to_symbol_id"), "l_linenumber").filter("a % 2 = to_symbol_id % 2")
    s = symbols(spark, sf_dir).select(F.col("symbol_id").alias("a"), "snapshot_id", "path", F.col("start_line").alias("s"))
    at = l.join(by_shuffle(s), "a").select(F.when(F.col("a") % 4 != 0, F.col("a")).alias("from_symbol_id"), "to_symbol_id", "snapshot_id", "path", (F.col("s") + F.col("l_linenumber") - 1).alias("line"))
    name = F.when(F.col("to_symbol_id") % 7 == 0, "r.get").otherwise(F.concat(F.lit("c"), F.col("to_symbol_id").cast("string")))
    return at.withColumns({"callee_text": name, "resolved": F.col("to_symbol_id") % 3 != 0}).distinct()


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a route at its part's lines; every third has its handler inline."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    at = s.select(k.alias("route_id"), k.alias("symbol_id"), F.when(k % 3 != 0, k).alias("handler_symbol_id"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "s_nationkey", F.lit("/"), k.cast("string")).alias("url_path"))
    return at.join(symbols(spark, sf_dir).select("symbol_id", "snapshot_id", "path", "start_line", "end_line"), "symbol_id").drop("symbol_id")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).filter("symbol_id % 20 = 0").select("symbol_id")


_G = """sy AS (SELECT *, CASE WHEN f % 5 = 0 THEN 'test/' WHEN f % 7 = 0 THEN 'scripts/' ELSE 'src/' END || 'f' || f || '.ts' AS path, CASE WHEN f % 5 = 0 THEN 'test' WHEN f % 7 = 0 THEN 'tooling' ELSE 'source' END AS role
 FROM (SELECT p_partkey AS symbol_id, 's' || p_partkey % 2 AS snap, p_partkey // 2 % 25 AS f, CASE WHEN p_partkey % 9 = 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN p_partkey % 18 = 2 THEN 'constructor' ELSE 'n' || p_partkey % 97 END AS name, CASE WHEN p_partkey % 18 = 2 THEN p_partkey - 2 END AS parent, (p_partkey // 50) * 10 + 1 AS s, (p_partkey // 50) * 10 + p_size AS e FROM part)),
na AS (SELECT sy.symbol_id, sy.snap, sy.path, CASE WHEN sy.kind = 'class' THEN m.s ELSE sy.s END AS lo, CASE WHEN sy.kind = 'class' THEN m.e ELSE sy.e END AS hi FROM sy LEFT JOIN sy m ON m.parent = sy.symbol_id AND m.name = 'constructor'),
ca AS (SELECT DISTINCT CASE WHEN sy.symbol_id % 4 <> 0 THEN sy.symbol_id END AS a, l_partkey AS b, CASE WHEN l_partkey % 7 = 0 THEN 'r.get' ELSE 'c' || l_partkey END AS t, snap, path, role, s + l_linenumber - 1 AS line, l_partkey % 3 <> 0 AS resolved FROM lineitem JOIN sy ON sy.symbol_id = l_orderkey % (SELECT count(*) FROM part) + 1 WHERE sy.symbol_id % 2 = l_partkey % 2),
ro AS (SELECT s_suppkey AS route_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS handler, CASE WHEN s_suppkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || s_nationkey || '/' || s_suppkey AS url_path, snap, path, role, s, e FROM supplier JOIN sy ON symbol_id = s_suppkey),
ta AS (SELECT symbol_id FROM sy WHERE symbol_id % 20 = 0)"""


@query("h1_symbol_at", f"WITH {_G}, p AS (SELECT DISTINCT snap, path, line FROM ca) SELECT p.snap AS snapshot_id, p.path, line, arg_min(symbol_id, (e - s, symbol_id)) AS symbol_id FROM p LEFT JOIN sy ON sy.snap = p.snap AND sy.path = p.path AND line BETWEEN s AND e GROUP BY ALL")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = calls(spark, sf_dir).select("snapshot_id", "path", "line").distinct().withColumn("point_id", F.concat_ws(":", "snapshot_id", "path", "line"))
    return H.symbol_at(p, symbols(spark, sf_dir)).select("snapshot_id", "path", "line", "symbol_id")


@query("h2_callers", f"""WITH {_G}, c AS (SELECT ta.symbol_id, a, ca.path, line, arg_min(route_id, (e - s, route_id)) AS route_id FROM ta JOIN ca ON b = ta.symbol_id AND resolved LEFT JOIN ro ON a IS NULL AND ro.snap = ca.snap AND ro.path = ca.path AND line BETWEEN s AND e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY path, line, a NULLS FIRST) AS rank, count(*) OVER (PARTITION BY symbol_id) > 50 AS truncated FROM c) SELECT symbol_id, a AS from_symbol_id, path, line, route_id, rank, truncated FROM r WHERE rank <= 50""")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.callers(targets(spark, sf_dir), calls(spark, sf_dir), routes(spark, sf_dir))


@query("h3_callees", f"""WITH {_G}, c AS (SELECT na.symbol_id, line, t, min(b) AS b FROM ta JOIN na USING (symbol_id) JOIN ca ON ca.snap = na.snap AND ca.path = na.path AND line BETWEEN lo AND hi GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY line, t) AS rank, count(*) OVER (PARTITION BY symbol_id) > 50 AS truncated FROM c) SELECT symbol_id, line, t AS callee_text, b AS to_symbol_id, rank, truncated FROM r WHERE rank <= 50""")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.callees(targets(spark, sf_dir), symbols(spark, sf_dir), calls(spark, sf_dir))


@query("h4_routes_of", f"WITH {_G} SELECT ta.symbol_id, route_id, method, url_path FROM ta JOIN ro ON handler = symbol_id")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.routes_of(targets(spark, sf_dir), routes(spark, sf_dir))


def _trace_sql() -> str:
    """The rounds of the trace, written out: calls of each depth's nodes, the nodes that they lead to, and all nodes so far."""
    out = [f"WITH {_G}, li AS (SELECT snap, path, line, t, min(b) AS b FROM ca GROUP BY ALL)", "f0 AS (SELECT route_id, handler AS x, 0 AS depth, 1::BIGINT AS place, NULL::BIGINT AS parent FROM ro)", "s0 AS (SELECT * FROM f0)"]
    registration = ", ".join(f"'{n}'" for n in H.REGISTRATION)
    for d in range(5):
        at = f"SELECT route_id, x, depth, place, snap, path, lo, hi, false AS inl FROM f{d} JOIN na ON symbol_id = x"
        if d == 0:
            at += " UNION ALL SELECT route_id, NULL, 0, 1, snap, path, s, e, true FROM ro WHERE handler IS NULL"
        out.append(f"a{d} AS ({at})")
        out.append(f"c{d} AS (SELECT * FROM (SELECT route_id, x, depth, place, line, t, b, row_number() OVER (PARTITION BY route_id, x ORDER BY line, t) AS n, count(*) OVER (PARTITION BY route_id, x) > 30 AS truncated FROM a{d} JOIN li ON li.snap = a{d}.snap AND li.path = a{d}.path AND line BETWEEN lo AND hi WHERE NOT (inl AND line = lo AND lower(string_split(t, '.')[-1]) IN ({registration}))) WHERE n <= 30)")
        if d < 4:
            out.append(f"n{d} AS (SELECT route_id, b, min((place, n, x)) AS o FROM c{d} WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s{d} WHERE s{d}.route_id = c{d}.route_id AND s{d}.x = c{d}.b) GROUP BY ALL)")
            out.append(f"f{d + 1} AS (SELECT route_id, x, {d + 1} AS depth, k AS place, parent FROM (SELECT n{d}.route_id, b AS x, o[3] AS parent, row_number() OVER (PARTITION BY n{d}.route_id ORDER BY o[1], o[2], b) + h AS k FROM n{d} JOIN (SELECT route_id, count(*) AS h FROM s{d} GROUP BY 1) q ON q.route_id = n{d}.route_id) WHERE k <= 40)")
            out.append(f"s{d + 1} AS (SELECT * FROM s{d} UNION ALL SELECT * FROM f{d + 1})")
    return ", ".join(out)


_TRACE = _trace_sql()
_TRACE_CALLS = " UNION ALL ".join(f"SELECT * FROM c{d}" for d in range(5))


@query("h5_trace_routes", f"{_TRACE} SELECT route_id, x AS symbol_id, depth, place, parent AS parent_id FROM s4")
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trace_routes(routes(spark, sf_dir), symbols(spark, sf_dir), calls(spark, sf_dir))[0]


@query("h5_trace_calls", f"{_TRACE} SELECT route_id, x AS symbol_id, depth, place, line, t AS callee_text, b AS to_symbol_id, n, truncated FROM ({_TRACE_CALLS})")
def h5_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trace_routes(routes(spark, sf_dir), symbols(spark, sf_dir), calls(spark, sf_dir))[1]


@query("h6_trace_tree", f"{_TRACE}, cs AS ({_TRACE_CALLS}), fi AS (SELECT route_id, x, b, min(n) AS n FROM cs WHERE b IS NOT NULL GROUP BY ALL) SELECT s4.route_id, s4.x AS symbol_id, s4.place, n FROM s4 JOIN fi ON fi.route_id = s4.route_id AND fi.x IS NOT DISTINCT FROM s4.parent AND fi.b = s4.x WHERE depth > 0")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trace_tree(*H.trace_routes(routes(spark, sf_dir), symbols(spark, sf_dir), calls(spark, sf_dir)))


def _of(operator: Callable[..., DataFrame], spark: SparkSession, sf_dir: str, *more: DataFrame) -> DataFrame:
    t = targets(spark, sf_dir).select(F.col("symbol_id").alias("target_id"))
    return operator(t, symbols(spark, sf_dir), calls(spark, sf_dir), routes(spark, sf_dir), *more)


_I = f"""{_G}, lk AS (SELECT DISTINCT a, b FROM ca WHERE resolved AND a IS NOT NULL AND role <> 'test'),
st AS (SELECT symbol_id AS target_id, symbol_id FROM ta UNION SELECT ta.symbol_id, m.symbol_id FROM ta JOIN sy c ON c.symbol_id = ta.symbol_id AND c.kind = 'class' JOIN sy m ON m.parent = c.symbol_id),
im(target_id, symbol_id, depth) AS (SELECT target_id, symbol_id, 0 FROM st UNION SELECT target_id, lk.a, depth + 1 FROM im JOIN lk ON lk.b = im.symbol_id WHERE depth < 12),
re AS (SELECT target_id, symbol_id, min(depth) AS depth FROM im GROUP BY ALL),
ir AS (SELECT ca.snap, ca.path, line, arg_min(route_id, (e - s, route_id)) AS route_id FROM (SELECT DISTINCT snap, path, line FROM ca WHERE a IS NULL) ca JOIN ro ON handler IS NULL AND ro.snap = ca.snap AND ro.path = ca.path AND line BETWEEN s AND e GROUP BY ALL),
ev AS (SELECT target_id, CASE WHEN role = 'test' THEN 'test' WHEN route_id IS NOT NULL THEN 'route' ELSE 'module' END AS kind, CASE WHEN role <> 'test' THEN route_id END AS route_id, CASE WHEN role = 'test' OR route_id IS NULL THEN ca.path END AS path, depth + 1 AS depth, ca.line
 FROM re JOIN ca ON b = re.symbol_id AND resolved LEFT JOIN ir ON a IS NULL AND ir.snap = ca.snap AND ir.path = ca.path AND ir.line = ca.line WHERE role = 'test' OR a IS NULL),
eo AS (SELECT target_id, kind, route_id, path, min(depth) AS depth FROM ev GROUP BY ALL)"""


@query("h7_impact", f"WITH RECURSIVE {_I} SELECT target_id, 'symbol' AS kind, symbol_id, NULL AS route_id, NULL AS path, depth FROM re UNION ALL SELECT target_id, kind, NULL, route_id, path, depth FROM eo")
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(H.impact, spark, sf_dir).drop("parent_id", "line")


@query("h8_impact_chains", f"WITH RECURSIVE {_I} SELECT target_id, re.symbol_id, depth + 1 AS length FROM re JOIN (SELECT DISTINCT handler FROM ro) r ON handler = re.symbol_id")
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = routes(spark, sf_dir).select(F.col("handler_symbol_id").alias("symbol_id"))
    return _of(H.impact_chains_of, spark, sf_dir, starts).select("target_id", "symbol_id", F.size("chain").alias("length"))


@query("h9_impact_lists", f"""WITH RECURSIVE {_I},
a AS (SELECT target_id, 'routes' AS list, route_id::VARCHAR AS item, depth, row_number() OVER (PARTITION BY target_id ORDER BY depth, url_path, method, route_id) AS rank FROM (SELECT target_id, ro.route_id, depth, url_path, method FROM re JOIN ro ON handler = symbol_id UNION ALL SELECT target_id, ro.route_id, depth, url_path, method FROM eo JOIN ro ON kind = 'route' AND ro.route_id = eo.route_id)),
c AS (SELECT target_id, 'tests' AS list, path AS item, depth, row_number() OVER (PARTITION BY target_id ORDER BY depth, path) AS rank FROM eo WHERE kind = 'test'),
d AS (SELECT target_id, sy.path, depth FROM re JOIN sy USING (symbol_id) WHERE depth > 0 UNION ALL SELECT target_id, path, depth FROM eo WHERE kind = 'module' UNION ALL SELECT target_id, ro.path, depth FROM eo JOIN ro ON kind = 'route' AND ro.route_id = eo.route_id),
b AS (SELECT target_id, 'dependents' AS list, path AS item, depth, row_number() OVER (PARTITION BY target_id ORDER BY depth, path) AS rank FROM d)
SELECT target_id, list, item, depth, rank FROM a WHERE rank <= 100 UNION ALL SELECT target_id, list, item, depth, rank FROM b WHERE rank <= 200 UNION ALL SELECT target_id, list, item, depth, rank FROM c""")
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _of(H.impact_lists_of, spark, sf_dir)
    return got.select("target_id", "list", F.when(F.col("list") == "routes", F.col("item")).otherwise(F.col("path")).alias("item"), "depth", "rank")


@query("h10_impact_by_file", f"WITH RECURSIVE {_I} SELECT target_id, snap AS snapshot_id, path, count(*) AS n FROM re JOIN sy ON sy.symbol_id = re.symbol_id WHERE depth > 0 GROUP BY ALL")
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(H.impact_by_file_of, spark, sf_dir).drop("symbols")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes in blocks of a hundred: each points to another of its block, every third also to an earlier one."""
    a = F.col("p_partkey")
    o = table(spark, sf_dir, "part").select(a.alias("a"), (a - (a - 1) % 100 - 1).alias("o"), ((a - 1) % 100).alias("i"))
    n = o.select("a")
    both = o.select("a", (F.col("o") + (F.col("i") * 7 + 3) % 100 + 1).alias("b")).union(o.filter("a % 3 = 0").select("a", (F.col("o") + F.floor(F.col("i") / 2) + 1).cast("long")))
    return both.join(n.toDF("b").hint("merge"), "b", "left_semi").select("a", "b")


_CYCLES = """WITH RECURSIVE ed AS (SELECT a, b FROM (SELECT p_partkey AS a, p_partkey - (p_partkey - 1) % 100 + ((p_partkey - 1) % 100 * 7 + 3) % 100 AS b FROM part UNION SELECT p_partkey, p_partkey - (p_partkey - 1) % 100 + ((p_partkey - 1) % 100) // 2 FROM part WHERE p_partkey % 3 = 0) WHERE a <> b AND b IN (SELECT p_partkey FROM part)),
r(x, y) AS (SELECT a, b FROM ed UNION SELECT r.x, ed.b FROM r JOIN ed ON ed.a = r.y) SELECT r.x AS node, least(r.x, min(r.y)) AS component FROM r JOIN r q ON r.x = q.y AND r.y = q.x WHERE r.x <> r.y GROUP BY r.x"""
_ED, _CLOSED = _CYCLES[: _CYCLES.index(" SELECT r.x AS node")], _CYCLES[_CYCLES.index("SELECT r.x AS node") :]


@query("h11_import_cycles", _CYCLES)
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.import_cycles(edges(spark, sf_dir)).select("node", "component")


_LOOPS = f"""{_ED}, co AS ({_CLOSED}), tk AS (SELECT component FROM co GROUP BY component ORDER BY count(*) DESC, component LIMIT 12),
ie AS (SELECT x.component, a, b FROM ed JOIN co x ON x.node = a JOIN co y ON y.node = b WHERE x.component = y.component AND x.component IN (SELECT component FROM tk)),
bf(component, x, d) AS (SELECT component, b, 1 FROM ie WHERE a = component UNION SELECT bf.component, ie.b, d + 1 FROM bf JOIN ie ON ie.component = bf.component AND ie.a = bf.x WHERE bf.x <> bf.component AND d < 100)
SELECT component, min(d) AS length FROM bf WHERE x = component GROUP BY component"""


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, loop, length)."""
    e = store(edges(spark, sf_dir), "edges")
    return H.cycle_loops(H.import_cycles(e), e).withColumn("length", (F.size("loop") - 1).cast("long"))


@query("h12_cycle_loops", f"SELECT *, component AS starts, component AS ends, length AS edges FROM ({_LOOPS})")
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each loop's length, its ends, and how many of its steps are edges."""
    at = loops(spark, sf_dir)
    steps = at.select("component", F.explode(F.arrays_zip(F.slice("loop", F.lit(1), F.size("loop") - 1).alias("a"), F.slice("loop", F.lit(2), F.size("loop") - 1).alias("b"))).alias("s")).select("component", "s.a", "s.b")
    real = steps.join(edges(spark, sf_dir).distinct().hint("merge"), ["a", "b"], "left_semi").groupBy("component").agg(F.count("*").alias("edges"))
    return at.join(real, "component", "left").select("component", "length", F.get("loop", F.lit(0)).alias("starts"), F.element_at("loop", -1).alias("ends"), "edges")


@query("h13_most_called", f"WITH {_G}, c AS (SELECT b, count(*) AS calls FROM ca WHERE resolved AND role = 'source' GROUP BY b) SELECT snap AS snapshot_id, symbol_id, name, calls, rank FROM (SELECT snap, symbol_id, name, calls, row_number() OVER (PARTITION BY snap ORDER BY calls DESC, name, symbol_id) AS rank FROM sy JOIN c ON b = symbol_id WHERE role = 'source') WHERE rank <= 8")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.most_called(symbols(spark, sf_dir), calls(spark, sf_dir))


@query("h14_longest_functions", f"WITH {_G} SELECT snap AS snapshot_id, symbol_id, n AS lines, rank FROM (SELECT snap, symbol_id, (e - s + 1)::INT AS n, row_number() OVER (PARTITION BY snap ORDER BY e - s DESC, symbol_id) AS rank FROM sy WHERE role = 'source' AND kind = 'function') WHERE rank <= 8")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.longest_functions(symbols(spark, sf_dir))


@query("h15_largest_files", "WITH f AS (SELECT source, doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT snapshot_id, path, line_count, rank FROM (SELECT source AS snapshot_id, 'src/d' || doc_id || '.ts' AS path, n::INT AS line_count, row_number() OVER (PARTITION BY source ORDER BY n DESC, 'src/d' || doc_id || '.ts') AS rank FROM f) WHERE rank <= 8")
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.largest_files(documents(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("snapshot_id"), F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.lit("CODE").alias("kind"), F.size(F.split("text", "\n")).alias("line_count"))


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers are files, a shipment an import of its part's file by its supplier's, both ways round, in two snapshots."""
    name = lambda k: F.concat(F.when(k % 5 == 0, "test/").when(k % 7 == 0, "scripts/").otherwise("src/"), F.lit("f"), k.cast("string"), F.lit(".ts"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 2).cast("string")).alias("snapshot_id"), name(F.floor(F.col("p_partkey") / 2)).alias("path"))
    l = table(spark, sf_dir, "lineitem").filter("l_suppkey % 2 = l_partkey % 2").select((F.col("l_suppkey") % 2).alias("g"), F.floor(F.col("l_suppkey") / 2).alias("i"), F.floor(F.col("l_partkey") / 2).alias("j")).distinct()
    return p, l.select(F.concat(F.lit("s"), F.col("g").cast("string")).alias("snapshot_id"), name(F.col("i")).alias("from_path"), name(F.col("j")).alias("to_path"))


_M = """fn AS (SELECT 's' || p_partkey % 2 AS snap, p_partkey // 2 AS k, CASE WHEN p_partkey // 2 % 5 = 0 THEN 'test' WHEN p_partkey // 2 % 7 = 0 THEN 'tooling' ELSE 'source' END AS role, CASE WHEN p_partkey // 2 % 5 = 0 THEN 'test/' WHEN p_partkey // 2 % 7 = 0 THEN 'scripts/' ELSE 'src/' END || 'f' || p_partkey // 2 || '.ts' AS path FROM part),
ie AS (SELECT DISTINCT a.snap, a.path AS f, a.role AS fr, b.path AS t, b.role AS tr FROM lineitem JOIN fn a ON a.k = l_suppkey // 2 AND a.snap = 's' || l_suppkey % 2 JOIN fn b ON b.k = l_partkey // 2 AND b.snap = 's' || l_partkey % 2 WHERE a.snap = b.snap),
te AS (SELECT snap, t AS path, count(*) AS tests, array_to_string(list(f ORDER BY f)[1:5], ',') AS examples FROM ie WHERE fr = 'test' AND tr = 'source' GROUP BY snap, t)"""


@query("h16_test_reach", f"WITH {_M} SELECT snap AS snapshot_id, path, tests, examples FROM te")
def h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.test_reach(*imports(spark, sf_dir)).select("snapshot_id", "path", "tests", F.array_join("examples", ",").alias("examples"))


@query("h17_untested_hubs", f"WITH {_M} SELECT snap AS snapshot_id, path, importers, rank FROM (SELECT snap, t AS path, count(DISTINCT f) AS importers, row_number() OVER (PARTITION BY snap ORDER BY count(DISTINCT f) DESC, t) AS rank FROM ie WHERE fr = 'source' AND tr = 'source' AND f <> t AND (snap, t) NOT IN (SELECT (snap, path) FROM te) GROUP BY snap, t) WHERE rank <= 8")
def h17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.untested_hubs(*imports(spark, sf_dir))

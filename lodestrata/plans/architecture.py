"""Queries of architecture and onboarding roll-ups (I) and of the catalog (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import architecture as I
from lodestrata.operators import catalog as J
from lodestrata.operators import catalogs
from lodestrata.operators import graph as H
from lodestrata.plans import graph as G
from lodestrata.plans.registry import SQL, query, table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of a snapshot each of five, in directories of nation and segment."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = F.concat(F.lit("src/n"), "c_nationkey", F.lit("/"), F.lower(F.substring("c_mktsegment", 1, 3)), F.lit("/c"), k.cast("string"), F.lit(".ts"))
    return c.select(k.alias("id"), (k % 5).alias("snapshot_id"), path.alias("path"))


_F = "fi AS (SELECT c_custkey AS id, c_custkey % 5 AS snapshot_id, 'n' || c_nationkey AS nation, lower(substr(c_mktsegment, 1, 3)) AS seg, 'src/n' || c_nationkey || '/' || lower(substr(c_mktsegment, 1, 3)) || '/c' || c_custkey || '.ts' AS path FROM customer)"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("id", "snapshot_id", "path", F.substring_index("path", "/", 2).alias("component"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an import from its customer's file to the one a thousand numbers on, in the same snapshot."""
    f = files(spark, sf_dir)
    n = f.agg((F.floor(F.count("*") / 5) * 5).alias("n"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") + F.col("o_orderkey") % 7 * 5) % F.col("n") + 5).alias("b")).distinct()
    a = f.select(F.col("id").alias("a"), F.col("snapshot_id"), F.col("path").alias("from_path"))
    b = f.select(F.col("id").alias("b"), F.col("snapshot_id").alias("s2"), F.col("path").alias("to_path"))
    return o.join(a, "a").join(b, "b").filter("snapshot_id = s2").select("snapshot_id", "from_path", "to_path")


_E = f"""{_F}, oe AS (SELECT DISTINCT o_custkey AS a, (o_custkey + o_orderkey % 7 * 5) % (SELECT count(*) // 5 * 5 FROM fi) + 5 AS b FROM orders),
im AS (SELECT x.snapshot_id, x.path AS f, y.path AS t, 'src/' || x.nation AS cf, 'src/' || y.nation AS ct FROM oe JOIN fi x ON x.id = a JOIN fi y ON y.id = b WHERE x.snapshot_id = y.snapshot_id)"""


@query("i1_group_components")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.group_components(files(spark, sf_dir))
    return got.groupBy("snapshot_id", "component").agg(F.count("*").alias("files"))


@query("i2_component_deps", f"WITH {_E} SELECT snapshot_id, cf AS from_component, ct AS to_component, count(*) AS imports, array_to_string(list(f || ' → ' || t ORDER BY f, t)[1:5], ';') AS examples FROM im WHERE cf <> ct GROUP BY ALL")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.component_deps(components(spark, sf_dir), imports(spark, sf_dir))
    return got.withColumn("examples", F.array_join("examples", ";"))


def _things(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus").join(files(spark, sf_dir), "id")


@query("i3_component_stats", f"WITH {_F}, o AS (SELECT o_custkey AS id, count(*) AS s, count(*) FILTER (o_orderstatus = 'F') AS r FROM orders GROUP BY 1) SELECT snapshot_id, 'src/' || nation AS component, count(*) AS files, coalesce(sum(s), 0)::BIGINT AS symbols, coalesce(sum(r), 0)::BIGINT AS routes FROM fi LEFT JOIN o USING (id) GROUP BY ALL")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _things(spark, sf_dir)
    return I.component_stats(components(spark, sf_dir), t, t.filter("o_orderstatus = 'F'"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogued packages: the first word of each part's type, with its last word as the kind."""
    p = table(spark, sf_dir, "part").select(F.lower(F.substring_index("p_type", " ", 1)).alias("package"), F.lower(F.substring_index("p_type", " ", -1)).alias("kind"))
    return p.groupBy("package").agg(F.min("kind").alias("kind")).filter("package <> 'promo'").withColumn("name", F.initcap("package"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is an external import of its part's package by its supplier's file."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("line"), "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.substring_index("p_type", " ", 1)).alias("package"))
    return l.join(p, "p_partkey").select((F.col("s") % 3).alias("snapshot_id"), F.concat(F.lit("src/s"), F.col("s").cast("string"), F.lit(".ts")).alias("path"), "package", (F.col("line") * 10 + F.col("l_linenumber")).alias("line"))


_U = """ct AS (SELECT lower(split_part(p_type, ' ', 1)) AS package, min(lower(string_split(p_type, ' ')[-1])) AS kind FROM part WHERE lower(split_part(p_type, ' ', 1)) <> 'promo' GROUP BY 1),
us AS (SELECT l_suppkey % 3 AS snapshot_id, 'src/s' || l_suppkey || '.ts' AS path, l_suppkey % 10 AS g, lower(split_part(p_type, ' ', 1)) AS package, l_orderkey * 10 + l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uses(spark, sf_dir).filter("line % 7 = 0").select("snapshot_id", "path", "package").distinct()


@query("i4_detect_integrations", f"WITH {_U} SELECT snapshot_id, upper(substr(package, 1, 1)) || substr(package, 2) AS name, kind, count(*)::BIGINT AS sites FROM us JOIN ct USING (package) GROUP BY ALL")
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.detect_integrations(uses(spark, sf_dir), _declared(spark, sf_dir), catalog(spark, sf_dir)).drop("packages")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("c"), (F.regexp_extract("path", "([0-9]+)", 1).cast("int") % 10).cast("string"))
    return uses(spark, sf_dir).select("snapshot_id", "path").distinct().withColumn("component", group)


@query("i5_integration_usage", f"WITH {_U} SELECT snapshot_id, 'c' || g AS component, upper(substr(package, 1, 1)) || substr(package, 2) AS name, count(*) AS imports, array_to_string(list_sort(list(path || ':' || line ORDER BY path, line)[1:5]), ',') AS examples FROM us JOIN ct USING (package) GROUP BY ALL")
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.integration_usage(uses(spark, sf_dir), _places(spark, sf_dir), catalog(spark, sf_dir))
    return got.withColumn("examples", F.array_join("examples", ","))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as code: some read environment variables, some declare models."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    up = F.upper("event_type")
    text = F.when(i % 4 == 0, F.concat(F.lit("const a = process.env."), up, F.lit(" + process.env['X_"), up, F.lit("'];"))).when(i % 4 == 1, F.concat(F.lit("let b = import.meta.env."), up, F.lit(";"))).when(i % 4 == 2, F.concat(F.lit("\nmongoose.model('M"), (i % 50).cast("string"), F.lit("', s)"))).otherwise(F.concat(F.lit("x.define('T"), (i % 50).cast("string"), F.lit("', {})"), F.when(i % 8 == 3, "\nrequire('sequelize')").otherwise("")))
    return e.select("event_id", (F.col("user_id") % 4).alias("snapshot_id"), F.concat(F.lit("src/e"), i.cast("string"), F.lit(".ts")).alias("path"), text.alias("content"))


@query("i6_detect_env_vars", """WITH v AS (SELECT user_id % 4 AS snapshot_id, 'src/e' || event_id || '.ts' AS path, upper(event_type) AS name FROM events WHERE event_id % 4 IN (0, 1) UNION ALL SELECT user_id % 4, 'src/e' || event_id || '.ts', 'X_' || upper(event_type) FROM events WHERE event_id % 4 = 0)
SELECT snapshot_id, name, count(*) AS count, array_to_string(list(path ORDER BY path)[1:5], ',') AS usages FROM v GROUP BY ALL""")
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = I.detect_env_vars(_code(spark, sf_dir).select("snapshot_id", "path", F.lit(1).alias("line_no"), F.col("content").alias("line")))
    return got.withColumn("usages", F.array_join(F.transform("usages", lambda u: u["path"]), ","))


@query("i7_detect_data_models", "SELECT 'src/e' || event_id || '.ts' AS path, CASE WHEN event_id % 4 = 2 THEN 'mongoose' ELSE 'sequelize' END AS source, CASE WHEN event_id % 4 = 2 THEN 'M' ELSE 'T' END || event_id % 50 AS name, CASE WHEN event_id % 4 = 2 THEN 2 ELSE 1 END AS line FROM events WHERE event_id % 4 = 2 OR event_id % 8 = 3")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.detect_data_models(_code(spark, sf_dir)).drop("snapshot_id")


def _rows(text: str) -> str:
    return ", ".join(f"('{p}', '{n.strip()}', '{k.strip()}')" for k, n, ps in (x.split("|") for x in text.strip().splitlines()) for p in ps.split())


_PACKAGES = [p for x in catalogs.STACK.strip().splitlines() for p in x.split("|")[2].split()]
_NAMES = ["tsconfig.json", "Dockerfile", "compose.yaml", "docker-compose.dev.yml", "vercel.json", "lib/a.js", "netlify.toml", "render.yml", "fly.toml", "b.cjs", "README.md"]


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a manifest of one of fifty snapshots, at the root or in a folder, that depends on packages by its numbers."""
    k = F.col("c_custkey")
    name = lambda n: F.element_at(F.array(*map(F.lit, _PACKAGES)), (n % len(_PACKAGES) + 1).cast("int"))
    text = F.concat(F.lit('{"description": " '), "c_name", F.lit(' ", "dependencies": {"'), name(k), F.lit('": "1", "own-'), k.cast("string"), F.lit('": "2"}, "devDependencies": {"'), name(k * 7 + F.col("c_nationkey")), F.lit('": "*"}}'))
    path = F.when(k <= 50, "package.json").otherwise(F.concat(F.lit("n"), "c_nationkey", F.lit("/p"), k.cast("string"), F.lit("/package.json")))
    return table(spark, sf_dir, "customer").select((k % 50).cast("string").alias("snapshot_id"), path.alias("path"), text.alias("content"))


def stack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k * 3 % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select((k % 50).cast("string").alias("snapshot_id"), F.when(k % 4 == 0, F.concat(F.lit(".github/workflows/w"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("d/e"), k.cast("string"), F.lit("/"), name)).otherwise(name).alias("path"))


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.declared_dependencies(manifests(spark, sf_dir), "dependencies", "devDependencies", "peerDependencies")
    return I.detect_stack(d, catalogs.stack_catalog(spark), stack_files(spark, sf_dir))


_RULES = ", ".join(f"('{p}', '{n}', '{c}')" for p, n, c in catalogs.STACK_FILES)
_STACK = f"""WITH cs(package, name, category) AS (VALUES {_rows(catalogs.STACK)}), fr(p, name, category) AS (VALUES {_RULES}),
pk AS (SELECT {_PACKAGES!r} AS ps, {_NAMES!r} AS ns),
ma AS (SELECT (c_custkey % 50)::VARCHAR AS sid, CASE WHEN c_custkey <= 50 THEN 'package.json' ELSE 'n' || c_nationkey || '/p' || c_custkey || '/package.json' END AS path, unnest([ps[c_custkey % len(ps) + 1], ps[(c_custkey * 7 + c_nationkey) % len(ps) + 1]]) AS package FROM customer, pk),
sf AS (SELECT (s_suppkey % 50)::VARCHAR AS sid, CASE WHEN s_suppkey % 4 = 0 THEN '.github/workflows/w' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'd/e' || s_suppkey || '/' || ns[s_suppkey * 3 % len(ns) + 1] ELSE ns[s_suppkey * 3 % len(ns) + 1] END AS path FROM supplier, pk),
ev AS (SELECT sid, name, category, 0 AS o, path FROM ma JOIN cs USING (package) UNION ALL SELECT sid, name, category, 1, path FROM sf, fr WHERE regexp_matches(path, p)),
ea AS (SELECT * FROM ev UNION ALL SELECT sid, 'JavaScript', 'language', 2, path FROM sf WHERE regexp_matches(path, '\\.[cm]?js$') AND sid NOT IN (SELECT sid FROM ev WHERE name = 'TypeScript')),
be AS (SELECT sid, name, arg_min(category, (o, len(string_split(path, '/')), path)) AS category, arg_min(path, (o, len(string_split(path, '/')), path)) AS evidence FROM ea GROUP BY ALL)
SELECT sid AS snapshot_id, name, category, evidence, row_number() OVER (PARTITION BY sid ORDER BY list_position({catalogs.CATEGORIES!r}, category), name) AS position FROM be"""


@query("i8_detect_stack", _STACK)
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(spark, sf_dir)


@query("i9_declared_entries", "SELECT DISTINCT c_custkey % 5 AS snapshot_id, e AS entry FROM (SELECT c_custkey, unnest(['n' || c_nationkey || '/m' || c_custkey % 9 || '.js'] || CASE WHEN c_custkey % 2 = 0 THEN ['n' || c_nationkey || '/b.js'] ELSE ['n' || c_nationkey || '/x.js', 'n' || c_nationkey || '/y.js'] END) AS e FROM customer)")
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"main": "./m'), (k % 9).cast("string"), F.lit('.js", "bin": '), F.when(k % 2 == 0, '"b.js"').otherwise('{"p": "./x.js", "q": "y.js"}'), F.lit("}"))
    m = table(spark, sf_dir, "customer").select((k % 5).alias("snapshot_id"), F.concat(F.lit("n"), "c_nationkey", F.lit("/package.json")).alias("path"), text.alias("content"))
    return I.declared_entries(m)


@query("i10_rank_start_files", f"""WITH {_E}, b AS (SELECT snapshot_id, t AS path, count(DISTINCT f) AS i FROM im WHERE f <> t GROUP BY ALL), r AS (SELECT o_custkey AS id, count(*) AS r FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
s AS (SELECT fi.snapshot_id, fi.path, CASE WHEN id % 50 = 0 THEN 12 ELSE 0 END + CASE WHEN coalesce(i, 0) >= 2 THEN least(i, 12) ELSE 0 END + CASE WHEN coalesce(r, 0) > 0 THEN least(r + 2, 8) ELSE 0 END AS score FROM fi LEFT JOIN b ON b.path = fi.path LEFT JOIN r USING (id))
SELECT snapshot_id, path, score::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, path) AS rank FROM s WHERE score > 0) WHERE rank <= 8""")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    r = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id")).join(f, "id")
    d = f.filter("id % 50 = 0").select("snapshot_id", F.col("path").alias("entry"))
    return I.rank_start_files(f, imports(spark, sf_dir), r, d).drop("reasons")


@query("i11_route_weight", f"WITH {G._G} SELECT route_id, count(line) AS weight FROM ro LEFT JOIN ca ON ca.snap = ro.snap AND ca.path = ro.path AND line BETWEEN s AND e AND resolved GROUP BY route_id")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.route_weight(G.routes(spark, sf_dir), G.calls(spark, sf_dir)).select("route_id", "weight")


def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.key_routes(I.route_weight(G.routes(spark, sf_dir), G.calls(spark, sf_dir)))


@query("i12_key_routes", f"""WITH {G._G}, w AS (SELECT route_id, any_value(method) AS method, any_value(url_path) AS u, count(line) AS weight, any_value(ro.path) AS path, any_value(ro.snap) AS snap FROM ro LEFT JOIN ca ON ca.snap = ro.snap AND ca.path = ro.path AND line BETWEEN s AND e AND resolved GROUP BY route_id),
k AS (SELECT *, split_part(u, '/', 2) AS resource FROM w WHERE path LIKE 'src/%'), n AS (SELECT *, count(*) OVER (PARTITION BY snap, resource) AS size, row_number() OVER (PARTITION BY snap, resource ORDER BY weight * 10 + (method = 'POST')::INT DESC, u, method, route_id) AS n FROM k)
SELECT snap AS snapshot_id, route_id, resource, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY size DESC, resource) AS rank FROM n WHERE n = 1) WHERE rank <= 5""")
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(spark, sf_dir).select("snapshot_id", "route_id", "resource", "weight", "rank")


def _sid(df: DataFrame) -> DataFrame:
    """The stand-ins number their snapshots each in its own way; s1 and 1 are one."""
    return df.withColumn("snapshot_id", F.regexp_replace(F.col("snapshot_id").cast("string"), "^s", ""))


def _sections(doc: DataFrame, *names: str) -> DataFrame:
    """Rows and a digest of each section of a document."""
    out = ["snapshot_id"]
    for n in names:
        fields = doc.schema[n].dataType.elementType.fieldNames()
        row = lambda x: F.concat_ws("|", *(x[f].cast("string") for f in fields))  # noqa: B023, E731
        out += [F.size(n).cast("long").alias(n), F.md5(F.array_join(F.array_sort(F.transform(n, row)), ";")).alias(f"{n}_md5")]
    return doc.select(*out)


def _sections_sql(**parts: tuple[str, str]) -> str:
    """The same of (SQL, columns) for each section."""
    ctes, ids, cols, joins = [], [], [], []
    for n, (sql, columns) in parts.items():
        row = "concat_ws('|', " + ", ".join(f"({c})::VARCHAR" for c in columns.split()) + ")"
        ctes.append(f"d_{n} AS (SELECT regexp_replace(snapshot_id::VARCHAR, '^s', '') AS sid, count(*) AS n, md5(string_agg({row}, ';' ORDER BY {row})) AS h FROM ({sql}) GROUP BY 1)")
        ids.append(f"SELECT sid FROM d_{n}")
        cols.append(f"coalesce(d_{n}.n, 0) AS {n}, coalesce(d_{n}.h, md5('')) AS {n}_md5")
        joins.append(f"LEFT JOIN d_{n} ON d_{n}.sid = ids.sid")
    return f"WITH {', '.join(ctes)}, ids AS ({' UNION '.join(ids)}) SELECT ids.sid AS snapshot_id, {', '.join(cols)} FROM ids {' '.join(joins)}"


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sid(I.detect_data_models(_code(spark, sf_dir)))


def _env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sid(I.detect_env_vars(_code(spark, sf_dir).select("snapshot_id", "path", F.lit(1).alias("line_no"), F.col("content").alias("line"))))


_MODELS = "SELECT user_id % 4 AS snapshot_id, CASE WHEN event_id % 4 = 2 THEN 'mongoose' ELSE 'sequelize' END AS source, 'src/e' || event_id || '.ts' AS path, CASE WHEN event_id % 4 = 2 THEN 'M' ELSE 'T' END || event_id % 50 AS name, CASE WHEN event_id % 4 = 2 THEN 2 ELSE 1 END AS line FROM events WHERE event_id % 4 = 2 OR event_id % 8 = 3"
_ENV = "WITH v AS (SELECT user_id % 4 AS snapshot_id, 'src/e' || event_id || '.ts' AS path, upper(event_type) AS name FROM events WHERE event_id % 4 IN (0, 1) UNION ALL SELECT user_id % 4, 'src/e' || event_id || '.ts', 'X_' || upper(event_type) FROM events WHERE event_id % 4 = 0) SELECT snapshot_id, name, min(path) AS path, 1 AS line_no, count(*) AS n FROM v GROUP BY snapshot_id, name"
_TOPS = f"WITH {_E}, st AS (SELECT snapshot_id, 'src/' || nation AS component, count(*) AS files FROM fi GROUP BY ALL), rt AS (SELECT snapshot_id, 'src/' || nation AS component, count(*) AS routes FROM orders JOIN fi ON id = o_custkey WHERE o_orderstatus = 'F' GROUP BY ALL), de AS (SELECT snapshot_id, cf, ct, count(*) AS n FROM im WHERE cf <> ct GROUP BY ALL), dr AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, cf ORDER BY n DESC, ct) AS k FROM de), da AS (SELECT snapshot_id, cf AS component, string_agg(ct, ',' ORDER BY k) AS f FROM dr WHERE k <= 12 GROUP BY ALL) SELECT * FROM (SELECT snapshot_id, component, files, coalesce(routes, 0) AS routes, coalesce(f, '') AS imports_from, row_number() OVER (PARTITION BY snapshot_id ORDER BY files DESC, component) AS rank FROM st LEFT JOIN rt USING (snapshot_id, component) LEFT JOIN da USING (snapshot_id, component)) WHERE rank <= 8"


@query(
    "i13_guide_document",
    _sections_sql(
        description=("SELECT c_custkey % 50 AS snapshot_id, trim(c_name) AS description FROM customer WHERE c_custkey <= 50", "description"),
        stack=(_STACK, "name category evidence position"),
        start_files=(SQL["i10_rank_start_files"], "path score rank"),
        flows=(SQL["i12_key_routes"], "route_id resource weight rank"),
        components=(_TOPS, "component files routes imports_from rank"),
        integrations=(f"WITH {_U} SELECT DISTINCT snapshot_id, upper(substr(package, 1, 1)) || substr(package, 2) AS name, kind FROM us JOIN ct USING (package)", "name kind"),
        models=(_MODELS, "path source name line"),
        env_vars=(_ENV, "name path line_no"),
    ),
)
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    r = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id")).join(f, "id")
    start = I.rank_start_files(f, imports(spark, sf_dir), r, f.filter("id % 50 = 0").select("snapshot_id", F.col("path").alias("entry")))
    c, t = components(spark, sf_dir), _things(spark, sf_dir)
    tops = I.top_components(I.component_stats(c, t, t.filter("o_orderstatus = 'F'")), I.component_deps(c, imports(spark, sf_dir)))
    doc = I.build_guide(
        I.package_description(manifests(spark, sf_dir)), _stack(spark, sf_dir), _sid(start.select("snapshot_id", "path", "score", "rank")), _sid(_key(spark, sf_dir).select("snapshot_id", "route_id", "resource", "weight", "rank")),
        _sid(tops.withColumn("imports_from", F.array_join("imports_from", ","))), _sid(uses(spark, sf_dir).join(catalog(spark, sf_dir), "package")), _models(spark, sf_dir), _env(spark, sf_dir),
    )
    return _sections(doc, "description", "stack", "start_files", "flows", "components", "integrations", "models", "env_vars")


@query(
    "i14_architecture_document",
    _sections_sql(components=(SQL["i3_component_stats"], "component files symbols routes"), deps=(SQL["i2_component_deps"], "from_component to_component imports examples"), integrations=(SQL["i4_detect_integrations"], "name kind sites"), usage=(SQL["i5_integration_usage"], "component name imports examples"), models=(_MODELS, "path source name line"), env_vars=(_ENV, "name n")),
)
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = components(spark, sf_dir), _things(spark, sf_dir)
    used = I.integration_usage(uses(spark, sf_dir), _places(spark, sf_dir), catalog(spark, sf_dir)).withColumn("examples", F.array_join("examples", ","))
    doc = I.build_architecture(
        _sid(I.component_stats(c, t, t.filter("o_orderstatus = 'F'"))), _sid(I.component_deps(c, imports(spark, sf_dir)).withColumn("examples", F.array_join("examples", ";"))),
        _sid(I.detect_integrations(uses(spark, sf_dir), _declared(spark, sf_dir), catalog(spark, sf_dir)).drop("packages")), _sid(used), _models(spark, sf_dir), _env(spark, sf_dir).select("snapshot_id", "name", "count"),
    )
    return _sections(doc, "components", "deps", "integrations", "usage", "models", "env_vars")


@query(
    "i15_insights_document",
    _sections_sql(most_called=(SQL["h13_most_called"], "symbol_id name calls rank"), longest=(SQL["h14_longest_functions"], "symbol_id lines rank"), largest=(SQL["h15_largest_files"], "path line_count rank"), cycles=(f"SELECT component % 2 AS snapshot_id, component, length FROM ({G._LOOPS})", "component length"), tested=(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY tests DESC, path) AS rank FROM ({SQL['h16_test_reach']})) WHERE rank <= 8", "path tests examples rank"), untested=(SQL["h17_untested_hubs"], "path importers rank")),
)
def i15(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = G.symbols(spark, sf_dir), G.calls(spark, sf_dir)
    loops = G.loops(spark, sf_dir).select((F.col("component") % 2).alias("snapshot_id"), "component", "length")
    reach = H._top(H.test_reach(*G.imports(spark, sf_dir)), F.desc("tests"), F.col("path")).withColumn("examples", F.array_join("examples", ","))
    doc = I.build_insights(_sid(H.most_called(s, c)), _sid(H.longest_functions(s)), _sid(H.largest_files(G.documents(spark, sf_dir))), _sid(loops), _sid(reach), _sid(H.untested_hubs(*G.imports(spark, sf_dir))))
    return _sections(doc, "most_called", "longest", "largest", "cycles", "tested", "untested")


@query("i16_map_graph", f"""WITH {_E}, us AS (SELECT c_custkey % 5 AS snapshot_id, 'src/n' || c_nationkey AS component, CASE WHEN o_orderkey % 3 = 0 THEN 'Redis' WHEN o_orderkey % 3 = 1 THEN 'Stripe' ELSE 'PostgreSQL' END AS name FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT snapshot_id, 'import' AS kind, cf AS source, ct AS target, count(*) AS n FROM im WHERE cf <> ct AND cf <> 'src/n3' AND ct <> 'src/n3' GROUP BY ALL UNION ALL SELECT snapshot_id, CASE WHEN name = 'Stripe' THEN 'uses' ELSE 'stores' END, component, name, count(*) FROM us WHERE component <> 'src/n3' GROUP BY ALL""")
def i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a use of one of three services by its customer's component."""
    c = components(spark, sf_dir)
    o = F.col("o_orderkey") % 3
    used = _things_of(spark, sf_dir).withColumn("name", F.when(o == 0, "Redis").when(o == 1, "Stripe").otherwise("PostgreSQL")).groupBy("snapshot_id", "component", "name").agg(F.count("*").alias("imports"))
    return I.map_graph(I.component_deps(c, imports(spark, sf_dir)), used, c.filter("component = 'src/n3'"), ["Redis", "PostgreSQL"])


def _things_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey").join(components(spark, sf_dir), "id")


@query("i17_folder_tree", f"WITH {_F} SELECT snapshot_id, 'src' AS folder, count(*) AS files, count(DISTINCT nation) AS children FROM fi GROUP BY ALL UNION ALL SELECT snapshot_id, 'src/' || nation, count(*), count(DISTINCT seg) FROM fi GROUP BY ALL UNION ALL SELECT snapshot_id, 'src/' || nation || '/' || seg, count(*), count(*) FROM fi GROUP BY ALL")
def i17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.folder_tree(files(spark, sf_dir))


# Catalog: customers are repositories, their orders snapshots, nations' users track customers.


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(k % 7 == 0, "FAILED").when(k % 5 == 0, "QUEUED").otherwise("READY")
    return o.select(F.col("o_custkey").alias("repo"), k.alias("snapshot_id"), (k % 11).alias("commit"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


_S = "sn AS (SELECT o_custkey AS repo, o_orderkey AS snapshot_id, o_orderkey % 11 AS commit, CASE WHEN o_orderkey % 7 = 0 THEN 'FAILED' WHEN o_orderkey % 5 = 0 THEN 'QUEUED' ELSE 'READY' END AS status, o_orderdate AS created_at FROM orders)"


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).groupBy("repo", "commit").agg(F.min("status").alias("status"))


_X = f"{_S}, ex AS (SELECT repo, commit, min(status) AS status FROM sn GROUP BY ALL), rq AS (SELECT event_id AS request_id, user_id AS \"user\", ts, event_id % 200 + 1 AS repo, event_id % 11 AS commit FROM events)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("request_id"), F.col("user_id").alias("user"), "ts", (i % 200 + 1).alias("repo"), (i % 11).alias("commit"))


@query("j1_register_snapshots", f"WITH {_X}, a AS (SELECT DISTINCT repo, commit, 1 AS asked FROM rq) SELECT repo, commit, CASE WHEN status IS NULL OR (asked = 1 AND status = 'FAILED') THEN 'QUEUED' ELSE status END AS status FROM ex FULL JOIN a USING (repo, commit)")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.register_snapshots(_requests(spark, sf_dir), _existing(spark, sf_dir))


@query("j2_admit_requests", f"WITH {_X}, c AS (SELECT rq.*, coalesce(status, 'FAILED') = 'FAILED' AS costs FROM rq LEFT JOIN ex USING (repo, commit)) SELECT request_id, costs, NOT costs OR sum(costs::INT) OVER (PARTITION BY \"user\", ts::DATE ORDER BY ts, request_id) <= 2 AS admitted FROM c")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.admit_requests(_requests(spark, sf_dir), _existing(spark, sf_dir), 2).select("request_id", "costs", "admitted")


@query("j3_tracked_repositories", f"WITH {_S}, l AS (SELECT repo, arg_max(snapshot_id, (created_at, snapshot_id)) AS snapshot_id, arg_max(status, (created_at, snapshot_id)) AS status FROM sn GROUP BY repo) SELECT c_nationkey AS \"user\", c_custkey AS repo, snapshot_id, status FROM customer LEFT JOIN l ON repo = c_custkey WHERE c_custkey % 3 = 0")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("user"), F.col("c_custkey").alias("repo"))
    return J.tracked_repositories(t, snapshots(spark, sf_dir))


@query("j4_public_repositories", f"WITH {_S}, l AS (SELECT repo, arg_max(snapshot_id, (created_at, snapshot_id)) AS snapshot_id FROM sn WHERE status = 'READY' GROUP BY repo) SELECT repo, c_name AS name, snapshot_id FROM customer JOIN l ON repo = c_custkey WHERE c_custkey % 4 = 0")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("name"))
    return J.public_repositories(c.filter("repo % 4 = 0").select(F.upper("name").alias("name")), c, snapshots(spark, sf_dir))


@query("j5_visible_snapshots", f"WITH {_S}, a AS (SELECT DISTINCT user_id % 25 AS viewer, event_id AS snapshot_id FROM events) SELECT viewer, a.snapshot_id FROM a JOIN sn USING (snapshot_id) JOIN customer ON c_custkey = repo WHERE c_custkey % 10 = 0 OR (c_custkey % 3 = 0 AND c_nationkey = viewer)")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a user of a nation who asks for the snapshot of its number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user"), F.col("c_custkey").alias("repo"))
    asked = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("viewer"), F.col("event_id").alias("snapshot_id"))
    return J.visible_snapshots(asked, snapshots(spark, sf_dir), c.filter("repo % 3 = 0"), c.filter("repo % 10 = 0"))


@query("j6_list_routes", f"WITH {G._G} SELECT route_id, name AS handler, row_number() OVER (PARTITION BY ro.snap ORDER BY url_path, method, route_id) AS position FROM ro LEFT JOIN sy ON symbol_id = handler")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.list_routes(G.routes(spark, sf_dir), G.symbols(spark, sf_dir)).select("route_id", "handler", "position")


@query("j7_list_files", f"WITH {_F} SELECT snapshot_id, path, row_number() OVER (PARTITION BY snapshot_id ORDER BY path) AS position FROM fi")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.list_files(files(spark, sf_dir)).select("snapshot_id", "path", "position")


@query("j7_outline", f"WITH {G._G} SELECT snap AS snapshot_id, path, md5(string_agg(s || name || kind, ',' ORDER BY s, name, kind)) AS h FROM sy GROUP BY snap, path")
def j7_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform("symbols", lambda x: F.concat(x["start_line"].cast("string"), x["name"], x["kind"]))
    return J.outline(G.symbols(spark, sf_dir)).select("snapshot_id", "path", F.md5(F.array_join(each, ",")).alias("h"))


@query("j8_cached", "SELECT o_orderkey AS snapshot_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'stored' ELSE 'new' END AS result FROM orders")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir).select("snapshot_id")
    old = s.filter("snapshot_id % 2 = 0").select("snapshot_id", F.lit("guide").alias("kind"), F.when(F.col("snapshot_id") % 3 == 0, 2).otherwise(1).alias("version"), F.lit("stored").alias("result"))
    return J.cached(old, s, "guide", 2, lambda m: m.withColumn("result", F.lit("new"))).select("snapshot_id", "result")

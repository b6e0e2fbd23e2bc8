"""Queries of code facts (B) and name resolution (C): every part is a source file of one of five forms, numbered by its key.

The expected facts of each form are stated beside it, read off the rules and not off the operators' results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import facts as B
from lodestrata.operators import resolve as C
from lodestrata.plans.registry import query, table
from lodestrata.sources.shared import by_shuffle, spread, store

#: %k is the file's number, %p and %q those of the last and last but one file of its form, %s one of seven packages.
FORMS = [
    # declarations, a class, strings and comments with braces, a named re-export
    r"""import { n%p as prev } from './f%p';
import ext from 'pkg%s/sub';
export function n%k(a) {
  if (a) { prev(a); } // } not a brace
  return helper("}", a);
}
function helper(x) { return x; }
/** Runs
 * twice. */
export class C%k {
  run(y) {
    this.stop();
    ext(y);
  }
  stop() {
  }
}
export { n%q as h%k } from './f%q';
const r = require('lib%s');
exports.e%k = 1;
app.get('/x/%k', n%k);
export { helper as h };
""",
    # an anonymous default, types, a signature over lines, one statement twice, an arrow field
    r"""import { a%k } from 'lib%s';
import { a%k } from 'lib%s';
export default async function () {
  return "{" + a%k(1);
}
export interface I%k { id: string }
type S%k = 'ok' | 'bad';
export enum E%k { A, B }
export async function get%k(
  id: string,
): Promise<void> {
  /* } unbalanced { { */ await this.db.find(id);
}
export const v%k = make%k();
export class P%k extends Base {
  private on = async (e: Event) => {};
  static make(a: number) {
    return new P%k(a);
  }
}
const re%k = /["{]/;
export function w%k(a) {
  return `${z%k({})} }` + a / 2 / 3;
}
interface J%k {
  load(id: string): Promise<void>;
}
""",
    # CommonJS: exports.x, prototype members, an object of exports
    r"""const lib = require('lib%s');
const { x%k, y: z%k } = require('./f%p');
exports.j%k = function json(obj) { return x%k(obj); };
exports.helper = helper;
function helper() { lib.use(1); }
module.exports.version = '1.0';
function R%k() {}
R%k.prototype.handle = function (req, res) { this.next(); };
R%k.prototype.next = function next() {};
module.exports = {
  R%k,
  create: make%k,
  ping() {},
};
function make%k() { z%k(); }
""",
    # routes: named, inline, wrapped, chained, one of them twice; clients, lookups and middleware are none
    r"""import { list%k } from './f%p';
app.get('/a/%k', list%k);
app.del('/a/%k', (req, res) => res.send(1));
app.get('/a/%k', list%k);
router.all('*', wrap(ctl.run));
router.route('/b/%k').get(show%k).post(auth, save%k);
axios.get('/c/%k', config);
app.get('/d/%k', options);
app.use('/e', list%k);
this.http.post('/f', list%k);
function show%k(q) {}
app.get('/t/%k', h.go); app.get('/u/%k', show%k);
router.post('/p/%k',
  auth,
  wrap(async (q) => { t%k(q); }),
);
app
  .get('/m/%k', show%k);
""",
    # namespaces, a star re-export, static and this calls, a call inside its own class
    r"""import * as ns from './f%p';
import D%k from './f%p';
export * from './f%q';
export default class K%k {
  static of() { return new K%k(); }
  go() { this.of(); ns.t%p(); }
}
export function t%k() {
  K%k.of();
  D%k.of();
  K%k(1);
}
""",
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") + 2
    text = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    for mark, value in (("%k", k), ("%p", F.greatest(k - 5, F.lit(0))), ("%q", F.greatest(k - 10, F.lit(0))), ("%s", k % 7)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    each = spread(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/f"), k.cast("string"), F.lit(".ts")).alias("path")), "path")
    return each.select(k.alias("k"), F.lit("s").alias("snapshot_id"), "path", text.alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.code_lines(files(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str, ls: DataFrame | None = None) -> DataFrame:
    """Top-level symbols, members and CommonJS definitions with ids, as resolution takes them."""
    ls = store(lines(spark, sf_dir), "lines") if ls is None else ls
    top = store(B.mark_exports(B.extract_symbols(ls), files(spark, sf_dir), B.cjs_exports(ls)), "top-symbols")
    id_of = lambda *c: F.concat_ws(":", "path", *c)
    none = F.lit(None).cast("string")
    a = top.select("snapshot_id", "path", id_of("name").alias("symbol_id"), "kind", "name", F.col("name").alias("qualified_name"), "start_line", "end_line", "exported", "exported_as", none.alias("parent_id"), none.alias("container"))
    m = B.extract_members(ls, top).select("snapshot_id", "path", id_of("qualified_name"), "kind", "name", "qualified_name", "start_line", "end_line", "exported", none, id_of(F.substring_index("qualified_name", ".", 1)), none)
    full = F.concat_ws(".", "container", "name")
    c = B.extract_cjs(ls).select("snapshot_id", "path", id_of(full), "kind", "name", full, "start_line", "end_line", "exported", F.when(F.col("is_default"), "default").when(F.col("exported"), F.col("name")), none, "container")
    return store(a.union(m).union(c), "symbols")


_P = "p AS (SELECT p_partkey + 2 AS k, (p_partkey + 2) % 5 AS form, 'src/f' || p_partkey + 2 || '.ts' AS path FROM part)"


def _numbered(text: str) -> str:
    for mark, value in (("%k", "k"), ("%p", "greatest(k - 5, 0)"), ("%q", "greatest(k - 10, 0)"), ("%s", "k % 7")):
        text = f"replace({text}, '{mark}', ({value})::VARCHAR)"
    return text


def expected(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of the facts of each form: columns that hold text are numbered by the file."""
    cols = columns.split()
    shown = [f"{_numbered(c) if any(isinstance(r[i + 1], str) for r in rows) else c} AS {c}" for i, c in enumerate(cols)]
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name} AS (SELECT path, k, p.form, {', '.join(shown)} FROM p JOIN (VALUES {values}) v(form, {', '.join(cols)}) ON v.form = p.form)"


SYMBOLS = [
    (0, "function", "n%k", 3, 6, True, "n%k", "export function n%k(a)"), (0, "function", "helper", 7, 7, False, "h", "function helper(x)"), (0, "class", "C%k", 10, 17, True, "C%k", "export class C%k"),
    (1, "function", "default", 3, 5, True, "default", "export default async function ()"), (1, "interface", "I%k", 6, 6, True, "I%k", "export interface I%k"), (1, "type", "S%k", 7, 7, False, None, "type S%k = 'ok' | 'bad';"),
    (1, "enum", "E%k", 8, 8, True, "E%k", "export enum E%k"), (1, "function", "get%k", 9, 13, True, "get%k", "export async function get%k( id: string, ): Promise<void>"), (1, "variable", "v%k", 14, 14, True, "v%k", "export const v%k = make%k();"),
    (1, "class", "P%k", 15, 20, True, "P%k", "export class P%k extends Base"), (1, "function", "w%k", 22, 24, True, "w%k", "export function w%k(a)"), (1, "interface", "J%k", 25, 27, False, None, "interface J%k"),
    (2, "function", "helper", 5, 5, False, "helper", "function helper()"), (2, "function", "R%k", 7, 7, False, "R%k", "function R%k()"), (2, "function", "make%k", 15, 15, False, "create", "function make%k()"),
    (3, "function", "show%k", 11, 11, False, None, "function show%k(q)"),
    (4, "class", "K%k", 4, 7, True, "default", "export default class K%k"), (4, "function", "t%k", 8, 12, True, "t%k", "export function t%k()"),
]
_SYMBOLS = f"{_P}, {expected('sy', 'kind name s e exported alias signature', SYMBOLS)}"
MEMBERS = [(0, "C%k.run", 11, 14), (0, "C%k.stop", 15, 16), (1, "P%k.on", 16, 16), (1, "P%k.make", 17, 19), (4, "K%k.of", 5, 5), (4, "K%k.go", 6, 6)]
_MEMBERS = f"{_P}, {expected('me', 'name s e', MEMBERS)}"


@query("b1_extract_symbols", f"WITH {_SYMBOLS} SELECT path, kind, name, s AS start_line, e AS end_line, exported FROM sy")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extract_symbols(lines(spark, sf_dir)).drop("snapshot_id", "is_default")


@query("b2_extract_members", f"WITH {_MEMBERS} SELECT path, name AS qualified_name, s AS start_line, e AS end_line FROM me")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = store(lines(spark, sf_dir), "lines")
    return B.extract_members(ls, B.extract_symbols(ls)).select("path", "qualified_name", "start_line", "end_line")


CJS = [(0, "variable", None, "e%k", 20, True), (2, "function", None, "j%k", 3, True), (2, "variable", None, "version", 6, True), (2, "method", "R%k", "handle", 8, False), (2, "method", "R%k", "next", 9, False), (2, "function", None, "ping", 13, True)]


@query("b3_extract_cjs", f"WITH {_P}, {expected('cj', 'kind container name line exported', CJS)} SELECT path, kind, container, name, line AS start_line, line AS end_line, exported, false AS is_default FROM cj")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extract_cjs(lines(spark, sf_dir)).drop("snapshot_id")


@query("b4_mark_exports", f"WITH {_SYMBOLS} SELECT path, name, alias IS NOT NULL AS exported, alias AS exported_as FROM sy")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = store(lines(spark, sf_dir), "lines")
    return B.mark_exports(B.extract_symbols(ls), files(spark, sf_dir), B.cjs_exports(ls)).select("path", "name", "exported", "exported_as")


def _shown(df: DataFrame) -> DataFrame:
    bound = F.array_join(F.transform("bindings", lambda b: F.concat(b["imported"], F.lit(":"), b["local"])), ",")
    return df.select("path", "specifier", bound.alias("bindings"), "line")


IMPORTS = [(0, "./f%p", "n%p:prev", 1), (0, "pkg%s/sub", "default:ext", 2), (1, "lib%s", "a%k:a%k", 1), (1, "lib%s", "a%k:a%k", 2), (3, "./f%p", "list%k:list%k", 1), (4, "./f%p", "*:ns", 1), (4, "./f%p", "default:D%k", 2)]
REEXPORTS = [(0, "./f%q", "n%q:h%k", 18), (4, "./f%q", "*:*", 3)]
REQUIRES = [(0, "lib%s", "*:r", 19), (2, "lib%s", "*:lib", 1), (2, "./f%p", "x%k:x%k,y:z%k", 2)]


@query("b5_extract_imports", f"WITH {_P}, {expected('im', 'specifier bindings line', IMPORTS)} SELECT path, specifier, bindings, line FROM im")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.extract_imports(files(spark, sf_dir)))


@query("b6_extract_reexports", f"WITH {_P}, {expected('im', 'specifier bindings line', REEXPORTS)} SELECT path, specifier, bindings, line FROM im")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.extract_reexports(files(spark, sf_dir)))


@query("b7_extract_requires", f"WITH {_P}, {expected('im', 'specifier bindings line', REQUIRES)} SELECT path, specifier, bindings, line FROM im")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(B.extract_requires(files(spark, sf_dir)))


#: Form, line, text, the symbol around it, the symbol called (null: none), the rule, and whether that needs the last file of the form.
CALLS = [
    (0, 4, "prev", "n%k", "f%p.ts:n%p", 1, True), (0, 5, "helper", "n%k", "f%k.ts:helper", 2, False), (0, 12, "this.stop", "C%k.run", "f%k.ts:C%k.stop", 4, False), (0, 13, "ext", "C%k.run", None, None, False), (0, 21, "app.get", None, None, None, False),
    (1, 4, "a%k", "default", None, None, False), (1, 12, "this.db.find", "get%k", None, None, False), (1, 14, "make%k", "v%k", None, None, False), (1, 18, "P%k", "P%k.make", "f%k.ts:P%k", 2, False), (1, 23, "z%k", "w%k", None, None, False),
    *((3, n, t, None, None, None, False) for n, t in ((12, "app.get"), (12, "app.get"), (13, "router.post"), (15, "wrap"), (15, "t%k"), (18, "().get"))),
    (2, 3, "x%k", "j%k", None, None, False), (2, 5, "lib.use", "helper", None, None, False), (2, 8, "this.next", "R%k.handle", "f%k.ts:R%k.next", 3, False), (2, 15, "z%k", "make%k", None, None, False),
    (3, 2, "app.get", None, None, None, False), (3, 3, "app.del", None, None, None, False), (3, 3, "res.send", None, None, None, False), (3, 4, "app.get", None, None, None, False), (3, 5, "router.all", None, None, None, False), (3, 5, "wrap", None, None, None, False),
    (3, 6, "router.route", None, None, None, False), (3, 6, "().get", None, None, None, False), (3, 6, "().post", None, None, None, False), (3, 7, "axios.get", None, None, None, False), (3, 8, "app.get", None, None, None, False), (3, 9, "app.use", None, None, None, False), (3, 10, "this.http.post", None, None, None, False),
    (4, 5, "K%k", "K%k.of", "f%k.ts:K%k", 2, False), (4, 6, "this.of", "K%k.go", "f%k.ts:K%k.of", 4, False), (4, 6, "ns.t%p", "K%k.go", "f%p.ts:t%p", 5, True), (4, 9, "K%k.of", "t%k", "f%k.ts:K%k.of", 7, False), (4, 10, "D%k.of", "t%k", None, None, False), (4, 11, "K%k", "t%k", "f%k.ts:K%k", 2, False),
]
_CALLS = f"{_P}, {expected('ca', 'line t around target rule far', CALLS)}"


@query("b8_extract_calls", f"WITH {_CALLS} SELECT path, line, t AS callee_text FROM ca")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extract_calls(lines(spark, sf_dir)).select("path", "line", "callee_text")


def calls(ls: DataFrame, syms: DataFrame) -> DataFrame:
    at = B.enclosing_symbol(B.extract_calls(ls), syms)
    return at.withColumn("call_id", F.concat_ws(":", "path", "line", "position"))


@query("b9_enclosing_symbol", f"WITH {_CALLS} SELECT path, line, t AS callee_text, path || ':' || around AS from_symbol_id FROM ca")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = store(lines(spark, sf_dir), "lines")
    return calls(ls, symbols(spark, sf_dir, ls)).select("path", "line", "callee_text", "from_symbol_id")


@query("b10_signatures", f"WITH {_SYMBOLS} SELECT path, name, signature, CASE WHEN form = 0 AND s = 10 THEN 'Runs' || chr(10) || 'twice.' END AS doc_comment FROM sy")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = store(lines(spark, sf_dir), "lines")
    return B.signatures(B.extract_symbols(ls), ls).select("path", "name", "signature", "doc_comment")


#: Form, method, path, handler, line, and the name of the symbol that it resolves to.
ROUTES = [
    (3, "GET", "/t/%k", "h.go", 12, None), (3, "GET", "/u/%k", "show%k", 12, "show%k"), (3, "POST", "/p/%k", "async(q)=>{t%k(q);}", 13, None), (3, "GET", "/m/%k", "show%k", 17, "show%k"),
    (0, "GET", "/x/%k", "n%k", 21, "n%k"), (3, "GET", "/a/%k", "list%k", 2, None), (3, "DELETE", "/a/%k", None, 3, None), (3, "GET", "/a/%k", "list%k", 4, None), (3, "ANY", "*", "ctl.run", 5, None), (3, "GET", "/b/%k", "show%k", 6, "show%k"), (3, "POST", "/b/%k", "save%k", 6, None)]
_ROUTES = f"{_P}, {expected('ro', 'method url handler line target', ROUTES)}"


@query("b11_extract_routes", f"WITH {_ROUTES} SELECT path, method, url AS url_path, handler, line FROM ro")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extract_routes(files(spark, sf_dir)).drop("snapshot_id")


@query("b12_convention_routes", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'POST' ELSE 'ANY' END AS method, CASE WHEN p_partkey % 2 = 0 THEN '/r' || p_partkey || '/y' ELSE '/api/r' || p_partkey END AS url_path FROM part")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    key = k.cast("string")
    f = table(spark, sf_dir, "part").select(F.lit("s").alias("snapshot_id"), F.when(k % 2 == 0, F.concat(F.lit("src/app/(g)/r"), key, F.lit("/@slot/y/route.ts"))).otherwise(F.concat(F.lit("pages/api/r"), key, F.lit(".ts"))).alias("path"), F.when(k % 2 == 0, "export async function POST(q) {\n}\nexport function helper() {\n}").otherwise("export default function go(q) {\n}").alias("content"))
    return B.convention_routes(f, B.extract_symbols(B.code_lines(f))).select("method", "url_path")


@query("b13_parse_health", "SELECT p_partkey + 2 AS k, (p_partkey + 2) % 3 = 0 AS has_errors FROM part")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("content", F.when(F.col("k") % 3 == 0, F.concat("content", F.lit("if (x) {"))).otherwise(F.col("content")))
    return B.parse_health(B.code_lines(f)).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("k"), "has_errors")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return B.extract_imports(f).union(B.extract_requires(f)).withColumn("import_id", F.concat_ws(":", "path", "line"))


@query("c1_resolve_relative", f"WITH {_P}, {expected('im', 'specifier line', [(r[0], r[1], r[3]) for r in IMPORTS + REQUIRES])} SELECT path, line, 'src/f' || k - 5 || '.ts' AS to_path FROM im WHERE starts_with(specifier, '.') AND k - 5 IN (SELECT k FROM p)")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.resolve_relative(store(_imports(spark, sf_dir), "imports"), files(spark, sf_dir))
    return got.select(F.substring_index("import_id", ":", 1).alias("path"), F.substring_index("import_id", ":", -1).cast("int").alias("line"), "to_path")


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config for each part that extends that of half its number; the first states a base, the first three aliases."""
    k = F.col("p_partkey") + 1
    key = k.cast("string")
    up = F.when(k > 1, F.array(F.concat(F.lit("../c"), F.floor(k / 2).cast("string"), F.lit("/tsconfig")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(F.lit("s").alias("snapshot_id"), F.concat(F.lit("c"), key, F.lit("/tsconfig.json")).alias("path"), F.when(k == 1, "../src").alias("base_url"), F.when(k <= 3, F.create_map(F.lit("@/*"), F.array(F.lit("../src/f*")))).alias("aliases"), up.alias("extends"))


_CHAIN = "g AS (SELECT p_partkey + 1 AS k FROM part)"


@query("c3_effective_configs", f"WITH {_CHAIN} SELECT 'c' || k || '/tsconfig.json' AS path, CASE WHEN k < 64 THEN 'src' END AS base, k < 128 AS aliased FROM g")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.effective_configs(_configs(spark, sf_dir))
    return got.select("path", "base", F.col("aliases").isNotNull().alias("aliased"))


@query("c2_resolve_alias", f"WITH {_P} SELECT k, path AS to_path FROM p WHERE k < 128 AND k <= (SELECT count(*) FROM part)")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    i = files(spark, sf_dir).select(k.alias("import_id"), "snapshot_id", F.concat(F.lit("c"), k.cast("string"), F.lit("/deep/a.ts")).alias("path"), F.when((k % 2 == 0) & (k < 64), F.concat(F.lit("f"), k.cast("string"))).otherwise(F.concat(F.lit("@/"), k.cast("string"))).alias("specifier"))
    return C.resolve_alias(i, C.effective_configs(_configs(spark, sf_dir)), files(spark, sf_dir)).withColumnRenamed("import_id", "k")


@query("c4_resolve_workspace", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'w' || p_partkey || '/lib/main.ts' ELSE 'w' || p_partkey || '/src/sub.ts' END AS to_path FROM part")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    key, p = k.cast("string"), table(spark, sf_dir, "part")
    f = p.select(F.lit("s").alias("snapshot_id"), F.concat(F.lit("w"), key, F.when(k % 2 == 0, "/lib/main.ts").otherwise("/src/sub.ts")).alias("path"))
    m = p.select(F.lit("s").alias("snapshot_id"), F.concat(F.lit("w"), key, F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "@o/w'), key, F.lit('", "main": "./lib/main.js"}')).alias("content"))
    i = p.select(k.alias("import_id"), F.lit("s").alias("snapshot_id"), F.lit("a.ts").alias("path"), F.concat(F.lit("@o/w"), key, F.when(k % 2 == 0, "").otherwise("/sub")).alias("specifier"))
    return C.resolve_workspace(i, m, f).withColumnRenamed("import_id", "k")


def _edges(spark: SparkSession, sf_dir: str, imports: DataFrame) -> DataFrame:
    f = files(spark, sf_dir).select("snapshot_id", "path", "content")
    return C.build_import_edges(imports, f, C.effective_configs(_configs(spark, sf_dir)), f.limit(0))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, store(_imports(spark, sf_dir), "imports"))


_EDGES = f"{_P}, {expected('im', 'specifier bindings line', IMPORTS + REQUIRES)}, ed AS (SELECT *, starts_with(specifier, '.') AS near, CASE WHEN starts_with(specifier, '.') AND k - 5 IN (SELECT k FROM p) THEN 'src/f' || k - 5 || '.ts' END AS to_path FROM im)"


@query("c6_build_import_edges", f"WITH {_EDGES} SELECT path, line, to_path, NOT near AS external, CASE WHEN NOT near THEN split_part(specifier, '/', 1) END AS package_name FROM ed")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("path", "line", "to_path", "external", "package_name")


def _reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = store(B.extract_reexports(files(spark, sf_dir)).withColumn("import_id", F.concat_ws(":", "path", "line")), "reexports")
    at = r.join(by_shuffle(C.resolve_relative(r, files(spark, sf_dir))), "import_id")
    each = at.select("snapshot_id", "path", "to_path", "line", F.posexplode("bindings").alias("i", "b"))
    return store(each.select("snapshot_id", "path", (F.col("i") + F.col("line") * 100).alias("n"), "b.imported", F.col("b.local").alias("exported"), "to_path"), "reexport-rows")


@query("c7_resolve_exports", f"WITH {_P} SELECT k, CASE WHEN form = 0 AND k > 12 THEN 'src/f' || k - 10 || '.ts:n' || k - 10 WHEN form = 4 AND k > 12 THEN 'src/f' || k - 10 || '.ts:t' || k - 10 WHEN form = 2 THEN path || ':make' || k END AS symbol_id FROM p")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for: a named re-export, one through a star, and an alias of CommonJS; the other forms have no export of the name."""
    k = F.col("k")
    name = F.when(k % 5 == 2, "create").when(k % 5 == 4, F.concat(F.lit("t"), F.greatest(k - 10, F.lit(0)).cast("string"))).otherwise(F.concat(F.lit("h"), k.cast("string")))
    asked = files(spark, sf_dir).select("snapshot_id", "path", name.alias("name"))
    got = C.resolve_exports(asked, symbols(spark, sf_dir), _reexports(spark, sf_dir))
    return got.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("k"), "symbol_id")


BINDINGS = [(0, "prev", "n%p"), (0, "ext", "default"), (0, "r", "*"), (1, "a%k", "a%k"), (2, "lib", "*"), (2, "x%k", "x%k"), (2, "z%k", "y"), (3, "list%k", "list%k"), (4, "ns", "*"), (4, "D%k", "default")]


@query("c8_bindings", f"WITH {_P}, {expected('bi', 'local imported', BINDINGS)} SELECT path, local, imported FROM bi")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bindings(edges(spark, sf_dir)).select("path", "local", "imported")


def _resolved(spark: SparkSession, sf_dir: str, ls: DataFrame | None = None, imported: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(calls, bindings, symbols, exports). Lines, symbols, bindings and calls are stored, so that each text is read once a fact."""
    ls = store(lines(spark, sf_dir), "lines") if ls is None else ls
    syms = symbols(spark, sf_dir, ls)
    binds = store(C.bindings(edges(spark, sf_dir) if imported is None else imported), "bindings")
    made = store(calls(ls, syms), "calls")
    inner = binds.filter("to_path is not null")
    named = inner.select("snapshot_id", F.col("to_path").alias("path"), F.when(F.col("imported") == "*", "default").otherwise(F.col("imported")).alias("name"))
    space = inner.filter("imported = '*'").join(by_shuffle(made.select("snapshot_id", "path", F.col("receiver").alias("local"), "callee_name")), ["snapshot_id", "path", "local"]).select("snapshot_id", F.col("to_path").alias("path"), F.col("callee_name").alias("name"))
    return made, binds, syms, store(C.resolve_exports(named.union(space), syms, _reexports(spark, sf_dir)), "exports")


@query("c9_resolve_calls", f"WITH {_CALLS}, x AS (SELECT *, target IS NOT NULL AND (NOT far OR k - 5 IN (SELECT k FROM p)) AS hit FROM ca) SELECT path, line, t AS callee_text, CASE WHEN hit THEN 'src/' || target END AS to_symbol_id, CASE WHEN hit THEN rule END AS rule FROM x")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve_calls(*_resolved(spark, sf_dir)).select("path", "line", "callee_text", "to_symbol_id", "rule")


@query("c10_methods_of", f"WITH {_MEMBERS} SELECT path || ':' || split_part(name, '.', 1) AS parent_id, split_part(name, '.', 2) AS name, path || ':' || name AS symbol_id FROM me")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.methods_of(symbols(spark, sf_dir))


@query("c11_resolve_handlers", f"WITH {_ROUTES} SELECT path, url AS url_path, line, path || ':' || target AS handler_symbol_id FROM ro")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, binds, syms, exports = _resolved(spark, sf_dir)
    routes = B.extract_routes(files(spark, sf_dir)).withColumn("route_id", F.concat_ws(":", "path", "line", "method", "url_path"))
    return C.resolve_handlers(store(routes, "routes"), binds, syms, exports).select("path", "url_path", "line", "handler_symbol_id")


@query(
    "c12_index_stats",
    f"""WITH {_EDGES}, {expected("sy", "name", [(r[0], r[2]) for r in SYMBOLS] + [r[:2] for r in MEMBERS] + [(r[0], r[3]) for r in CJS])}, {expected("ca", "target far", [(r[0], r[4], r[6]) for r in CALLS])}, {expected("ro", "method", [r[:2] for r in ROUTES])}
SELECT (SELECT count(*) FROM p) AS files, (SELECT count(*) FROM sy) AS symbols, (SELECT count(*) FROM ed) AS imports, (SELECT count(to_path) FROM ed) AS imports_internal, (SELECT count(*) FROM ed WHERE NOT near) AS imports_external, (SELECT count(*) FROM ed WHERE near AND to_path IS NULL) AS imports_unresolved,
(SELECT count(*) FROM ca) AS calls, (SELECT count(*) FROM ca WHERE target IS NOT NULL AND (NOT far OR k - 5 IN (SELECT k FROM p))) AS calls_resolved, (SELECT count(*) FROM ro) AS routes, 0 AS parse_errors""",
)
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = store(lines(spark, sf_dir), "lines")
    f = files(spark, sf_dir).withColumn("kind", F.lit("CODE")).join(by_shuffle(B.parse_health(ls)), ["snapshot_id", "path"])
    imported = store(edges(spark, sf_dir), "edges")
    made, binds, syms, exports = _resolved(spark, sf_dir, ls, imported)
    got = C.index_stats(f, syms, imported, C.resolve_calls(made, binds, syms, exports), B.extract_routes(files(spark, sf_dir)))
    return got.select("files", "symbols", "imports", "imports_internal", "imports_external", "imports_unresolved", "calls", "calls_resolved", "routes", "parse_errors")

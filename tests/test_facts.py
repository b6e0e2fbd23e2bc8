from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import facts as B


def files(spark, *texts):
    return spark.createDataFrame([("s", f"f{i}.ts", t) for i, t in enumerate(texts)], "snapshot_id string, path string, content string")


def symbols(spark, text):
    lines = B.code_lines(files(spark, text))
    top = B.mark_exports(B.extract_symbols(lines), files(spark, text), B.cjs_exports(lines))
    return lines, sorted((r.start_line, r.kind, r.name, r.end_line, r.exported, r.exported_as) for r in top.collect())


def test_literals_of_ten_megabytes(spark):
    """A string of ten megabytes, quotes and backslashes in it, breaks no expression; the code after it is read."""
    big = "x\\\"y'" * 2_000_000
    text = f'export const data = "{big}";\n// "{big[:50]}\nfunction f() {{ return g("{{"); }}\n/* {big} */ h();\n'
    df = files(spark, text)
    lines = B.code_lines(df).cache()
    assert [(r.name, r.start_line, r.end_line) for r in B.extract_symbols(lines).orderBy("start_line").collect()] == [("data", 1, 1), ("f", 3, 3)]
    assert [(r.callee_text, r.line) for r in B.extract_calls(lines).orderBy("line").collect()] == [("g", 3), ("h", 4)]
    assert not B.parse_health(lines).first().has_errors and B.extract_members(lines, B.extract_symbols(lines)).count() == 0
    for facts in (B.extract_imports, B.extract_reexports, B.extract_requires, B.extract_routes):
        assert facts(df).count() == 0
    assert B.extract_cjs(lines).count() == 0 and B.cjs_exports(lines).count() == 0
    assert B.signatures(B.extract_symbols(lines), lines).count() == 2
    doc = '{"a": "' + big.replace("'", "\\\\") + '", /* x */ "b": [1, 2,], // y\n}'
    got = spark.createDataFrame([(doc,)], "t string").select(F.get_json_object(T.clean_jsonc(F.col("t")), "$.b").alias("b")).first()
    assert got.b == "[1,2]"
    many = "[" + ", ".join(map(str, range(1, 20_001))) + "]"
    cited = spark.createDataFrame([(many,)], "t string").select(F.size(T.markers(F.col("t"))).alias("n")).first()
    assert cited.n == 20_000


def test_default_exports(spark):
    text = "export default class {\n  m() {}\n}\n"
    assert symbols(spark, text)[1] == [(1, "class", "default", 3, True, "default")]
    assert symbols(spark, "export default () => {\n  a();\n};\n")[1] == [(1, "function", "default", 3, True, "default")]
    assert symbols(spark, "export default x => x;\n")[1] == [(1, "function", "default", 1, True, "default")]
    assert symbols(spark, "export default function named(a) {\n}\n")[1] == [(1, "function", "named", 2, True, "default")]
    assert symbols(spark, "class Kept {}\nfunction own() {}\nexport default Kept\n")[1] == [(1, "class", "Kept", 1, True, "default"), (2, "function", "own", 2, False, None)]


def test_values_types_and_spans(spark):
    text = "export const Shape = class {\n};\nconst later = async (\n  a,\n) => {\n  return [1,\n    2];\n};\nconst plain = 3;\nexport let port = 80, host;\nconst t = `of ${a} and` + `}} {`;\nexport type Id = string;\n"
    lines, got = symbols(spark, text)
    assert (1, "class", "Shape", 2, True, "Shape") in got and (10, "variable", "port", 10, True, "port") in got and (12, "type", "Id", 12, True, "Id") in got
    assert not any(name == "plain" for _, _, name, *_ in got)


def test_commonjs(spark):
    text = """var app = exports = module.exports = {};
app.start = function start() { this.stop(); };
app.stop = function () {};
this.lost = function () {};
exports.count = 1 + 1;
other.value = 42;
Kind.prototype.run = async (x) => {
  return x;
};
"""
    lines, _ = symbols(spark, text)
    got = sorted((r.start_line, r.kind, r.container, r.name, r.end_line, r.exported) for r in B.extract_cjs(lines).collect())
    assert got == [(2, "method", "app", "start", 2, True), (3, "method", "app", "stop", 3, True), (5, "variable", None, "count", 5, True), (7, "method", "Kind", "run", 9, False)]
    late = B.code_lines(files(spark, "var res = make();\nmodule.exports = res;\nres.send = function send(b) {};\n"))
    assert [(r.name, r.exported) for r in B.extract_cjs(late).collect()] == [("send", True)]
    assert [(r.name, r.exported_as) for r in B.cjs_exports(late).collect()] == [("res", "default")]
    one = B.code_lines(files(spark, "module.exports = { a, make: build, go() {}, n: 1, f: function () {} };\n"))
    assert sorted((r.kind, r.name) for r in B.extract_cjs(one).collect()) == [("function", "f"), ("function", "go"), ("variable", "n")]
    assert sorted((r.name, r.exported_as) for r in B.cjs_exports(one).collect()) == [("a", "a"), ("build", "make")]
    whole = B.code_lines(files(spark, "module.exports = function () {\n};\n"))
    assert [(r.kind, r.name, r.end_line, r.is_default) for r in B.extract_cjs(whole).collect()] == [("function", "default", 2, True)]


def test_repeated_statements_have_their_own_lines(spark):
    text = "// import a from 'no';\nimport a from 'x';\n/* import b from 'no';\n */\nimport a from 'x';\nconst s = \"import c from 'y'\";\nrequire('z');\nrequire('z');\nexport * from './q';\nexport * from './q';\n"
    df = files(spark, text)
    assert sorted(r.line for r in B.extract_imports(df).filter("specifier = 'x'").collect()) == [2, 5]
    assert sorted(r.line for r in B.extract_requires(df).collect()) == [7, 8]
    assert sorted((r.line, r.bindings[0].imported) for r in B.extract_reexports(df).collect()) == [(9, "*"), (10, "*")]
    assert B.extract_imports(df).filter("specifier = 'no'").count() == 0


def test_route_tables(spark):
    text = """app.get('/p', one);
app.get('/p', one);
app.del('/p', two);
r.all('/q', auth, ctl.show);
r.use('/p', one);
superagent.get('/p', cb);
client.get('/mine', own);
api.post('/mine', own);
this.httpClient.get('/p', cb);
app.get('relative', one);
app.get('/p', params);
app.patch(
  '/wide', handler);
"""
    got = sorted((r.line, r.method, r.url_path, r.handler) for r in B.extract_routes(files(spark, text)).collect())
    assert got == [(1, "GET", "/p", "one"), (2, "GET", "/p", "one"), (3, "DELETE", "/p", "two"), (4, "ANY", "/q", "ctl.show"), (7, "GET", "/mine", "own"), (8, "POST", "/mine", "own"), (12, "PATCH", "/wide", "handler")]


def test_nothing_nulls_and_empty_files(spark):
    df = spark.createDataFrame([("s", "a.ts", None), ("s", "b.ts", ""), ("s", "c.ts", "\n\n")], "snapshot_id string, path string, content string")
    for f in (df, df.limit(0)):
        lines = B.code_lines(f)
        assert B.extract_symbols(lines).count() == 0 and B.extract_calls(lines).count() == 0 and B.extract_imports(f).count() == 0 and B.extract_routes(f).count() == 0


def routes(spark, text):
    return sorted((r.line, r.method, r.url_path, r.handler) for r in B.extract_routes(files(spark, text)).collect())


def test_routes_over_lines_and_two_on_one(spark):
    text = """app.get('/t', h.go); app.get('/u', k);
router.post('/p',
  auth, // then
  save,
);
app
  .get('/m', /* last */ list);
r.route('/b')
  .get(show)
  .post(auth, (req, res) => {
    if (a) { b([1, { c: ")" }]); }
  });
app.put('/w', wrap(async (q) => { f({ a: [q] }); }));
app.get('/v', lib.wrap(auth, ctl.run));
app.get<Params>(`/x`, { schema: { a: 1 } }, async () => ({ ok: true }));
express().get('/y', guard());
cache.get('/users');
map.get(key, fallback);
app.get('/z' + id, h);
app.get('/z', { a });
app.get('/z', new Handler());
app.get(`/z/${id}`, h);
"""
    assert routes(spark, text) == [(1, "GET", "/t", "h.go"), (1, "GET", "/u", "k"), (2, "POST", "/p", "save"), (6, "GET", "/m", "list"), (8, "GET", "/b", "show"), (8, "POST", "/b", None), (13, "PUT", "/w", "async(q)=>{f({a:[q]});}"), (14, "GET", "/v", "ctl.run"), (15, "GET", "/x", None), (16, "GET", "/y", "guard()")]
    deep = "(" * 200 + "x" + ")" * 200
    assert routes(spark, f"app.get('/d', () => {deep});\napp.get('/e', own);\n") == [(1, "GET", "/d", None), (2, "GET", "/e", "own")]


def test_regular_expressions_and_templates(spark):
    """Quotes and braces in regular expressions, division, templates in values of templates, texts with braces over lines."""
    text = """const re = /["{]/;
export function a() { return s.replace(/[/'"]\\/{/g, f(1)); }
const n = x / y / z; function b() { return q / 2; }
const t = `${g({})} } ${h(`<${u({ v: "}" })}>`)}`;
const css = `
  p {
  call(1) \\${ no }
`;
if (a) { k(m / 2, /`/.test(w)); }
function c() {}
"""
    lines, got = symbols(spark, text)
    assert [(n, k) for n, _, k, *_ in got] == [(2, "a"), (10, "c")]
    calls = sorted((r.line, r.callee_text) for r in B.extract_calls(lines).collect())
    assert calls == [(2, "f"), (2, "s.replace"), (4, "g"), (4, "h"), (9, "().test"), (9, "k")]
    assert not B.parse_health(lines).first().has_errors


def test_declarations_are_no_calls(spark):
    text = "interface I {\n  load(id: string): Promise<void>;\n  on(cb: (x: number) => void): void;\n}\nabstract class C {\n  abstract z(): void;\n  go(): void {\n    run(1);\n    const v = ok ? a(1) : b(2);\n  }\n}\n"
    lines = B.code_lines(files(spark, text))
    assert sorted(r.callee_text for r in B.extract_calls(lines).collect()) == ["a", "b", "run"]


def test_signatures_over_lines(spark):
    text = "export async function get(\n  id: string,\n  { a, b = { c: 1 } }: Opts = {},\n): Promise<void> {\n  x();\n}\nfunction one({ a }) {}\nconst f = async (\n  y,\n) => y;\nclass K extends B {\n}\n"
    lines = B.code_lines(files(spark, text))
    got = {r.name: r.signature for r in B.signatures(B.extract_symbols(lines), lines).collect()}
    assert got == {"get": "export async function get( id: string, { a, b = { c: 1 } }: Opts = {}, ): Promise<void>", "one": "function one({ a })", "f": "const f = async ( y, )", "K": "class K extends B"}

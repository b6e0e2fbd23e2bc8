"""Name resolution: the joins that turn facts into import edges, bindings and resolved calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import directories, package_name, strings
from lodestrata.sources.shared import by_shuffle, store

KEY = "snapshot_id"
#: Extensions that are tried in order, and what a written extension may stand for.
TRIED = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
SWAPS = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
ENTRY_FIELDS = ["exports", "source", "module", "main", "types"]
MAX_EXTENDS, MAX_MODULES = 5, 7


def normal(path: Column) -> Column:
    """The path without . and .. segments; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    step = lambda acc, s: F.when(acc.isNull(), acc).when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def candidates(base: Column) -> Column:
    """Paths that a module path may stand for, best first: itself, swapped extensions, added ones, and an index file."""
    stem = F.regexp_replace(base, r"\.[cm]?jsx?$", "")
    swaps = F.array().cast("array<string>")
    for ext, to in reversed(SWAPS.items()):
        swaps = F.when(base.endswith(ext), F.array(*(F.concat(stem, F.lit(t)) for t in to))).otherwise(swaps)
    add = F.transform(strings(TRIED), lambda e: F.concat(base, e))
    lead = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
    index = F.transform(strings(TRIED), lambda e: F.concat(lead, F.lit("index"), e))
    return F.concat(F.array(base), swaps, add, index)


def _probe(at: DataFrame, files: DataFrame, id: str, tried: Column) -> DataFrame:
    """(id, to_path): the first of tried that is a file of the snapshot."""
    each = at.select(id, KEY, F.posexplode(tried).alias("n", "to_path"))
    return each.join(by_shuffle(files.select(KEY, F.col("path").alias("to_path"))), [KEY, "to_path"]).groupBy(id).agg(F.min_by("to_path", "n").alias("to_path"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, to_path) of specifiers that start with a dot; each different (folder, specifier) is looked up once."""
    rel = imports.filter(F.col("specifier").rlike(r"^\.\.?(/|$)")).withColumn("folder", F.array_join(directories(F.col("path")), "/"))
    asked = rel.select(KEY, "folder", "specifier").distinct().withColumn("k", F.concat_ws("\u0001", KEY, "folder", "specifier"))
    base = normal(F.concat_ws("/", "folder", "specifier"))
    hit = _probe(asked.withColumn("base", base).filter("base is not null"), files, "k", candidates(F.col("base")))
    return rel.withColumn("k", F.concat_ws("\u0001", KEY, "folder", "specifier")).join(by_shuffle(hit), "k").select("import_id", "to_path")


def effective_configs(configs: DataFrame) -> DataFrame:
    """(snapshot_id, path, folder, base_url, aliases) with what is inherited over relative extends, MAX_EXTENDS levels.

    configs: (snapshot_id, path, base_url, aliases map<string,array<string>>, extends array<string>). Nearer values win,
    and of several parents the later; base_url and aliases are relative to the folder of the file that states them.
    """
    folder = F.array_join(directories(F.col("path")), "/")
    own = configs.withColumn("folder", folder)
    at = own.select(KEY, F.col("path").alias("root"), "path", "folder", "base_url", "aliases", "extends", F.lit(0).alias("level"), F.lit("").alias("place"))
    every = at
    for level in range(1, MAX_EXTENDS + 1):
        up = at.select(KEY, "root", "folder", "place", F.posexplode("extends").alias("n", "e")).filter(F.col("e").startswith(".")).select(KEY, "root", F.concat("place", F.format_string("%04d", 9999 - F.col("n"))).alias("place"), normal(F.concat_ws("/", "folder", F.when(F.col("e").endswith(".json"), F.col("e")).otherwise(F.concat("e", F.lit(".json"))))).alias("path"))
        at = up.join(by_shuffle(own.select(KEY, "path", "folder", "base_url", "aliases", "extends")), [KEY, "path"]).select(KEY, "root", "path", "folder", "base_url", "aliases", "extends", F.lit(level).alias("level"), "place")
        every = every.union(at)
    order = F.struct("level", "place")
    based = F.when(F.col("base_url").isNotNull(), F.struct(F.col("base_url").alias("base_url"), F.col("folder").alias("base_folder")))
    aliased = F.when(F.col("aliases").isNotNull(), F.struct(F.col("aliases").alias("aliases"), F.coalesce(F.concat_ws("/", "folder", "base_url"), "folder").alias("alias_folder")))
    got = every.groupBy(KEY, "root").agg(F.min_by(based, F.when(based.isNotNull(), order)).alias("b"), F.min_by(aliased, F.when(aliased.isNotNull(), order)).alias("a"))
    return got.select(KEY, F.col("root").alias("path"), F.array_join(directories(F.col("root")), "/").alias("folder"), F.when(F.col("b").isNotNull(), normal(F.concat_ws("/", "b.base_folder", "b.base_url"))).alias("base"), "a.aliases", "a.alias_folder")


def resolve_alias(imports: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, to_path) by the nearest config above the file (of several in a folder tsconfig.json, else the last by name):
    alias patterns in order, * captured, then the base folder."""
    bare = imports.filter(~F.col("specifier").rlike(r"^[./]"))
    up = bare.select("import_id", KEY, "specifier", directories(F.col("path")).alias("d")).select("*", F.explode(F.sequence(F.lit(0), F.size("d"))).alias("depth")).withColumn("folder", F.array_join(F.slice("d", F.lit(1), F.col("depth")), "/"))
    near = up.join(by_shuffle(configs), [KEY, "folder"]).groupBy("import_id", KEY, "specifier").agg(F.max_by(F.struct("base", "aliases", "alias_folder"), F.struct("depth", F.col("path") == F.when(F.col("folder") == "", "tsconfig.json").otherwise(F.concat("folder", F.lit("/tsconfig.json"))), "path")).alias("c"))

    def of(pattern: Column, targets: Column) -> Column:
        lead, tail = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
        star = pattern.contains("*")
        fits = F.when(star, F.col("specifier").startswith(lead) & F.col("specifier").endswith(tail) & (F.length("specifier") >= F.length(lead) + F.length(tail))).otherwise(F.col("specifier") == pattern)
        caught = F.when(star, F.substring(F.col("specifier"), F.length(lead) + 1, F.length("specifier") - F.length(lead) - F.length(tail))).otherwise("")
        return F.when(fits, F.transform(targets, lambda t: F.concat_ws("/", F.col("c.alias_folder"), F.replace(t, F.lit("*"), caught)))).otherwise(F.array().cast("array<string>"))

    named = F.flatten(F.transform(F.map_entries("c.aliases"), lambda e: of(e["key"], e["value"])))
    bases = F.concat(F.coalesce(named, F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("c.base").isNotNull(), F.concat_ws("/", "c.base", "specifier")))))
    tried = F.flatten(F.transform(F.filter(F.transform(bases, lambda b: normal(b)), lambda b: b.isNotNull()), candidates))
    return _probe(near, files, "import_id", tried)


def resolve_workspace(imports: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, to_path) by package name of the repository's own manifests (not its root's): entry fields in order, src/index, index; a subpath under the package and then under src."""
    m = manifests.filter("path <> 'package.json'").select(KEY, F.array_join(directories(F.col("path")), "/").alias("dir"), F.get_json_object("content", "$.name").alias("package"), F.array_compact(F.array(F.coalesce(F.get_json_object("content", "$.exports['.'].import"), F.get_json_object("content", "$.exports['.']"), F.get_json_object("content", "$.exports")), *(F.get_json_object("content", f"$.{f}") for f in ENTRY_FIELDS[1:]))).alias("entries"))
    at = imports.withColumn("package", package_name(F.col("specifier"))).join(by_shuffle(m), [KEY, "package"])
    rest = F.substring(F.col("specifier"), F.length("package") + 2, F.length("specifier"))
    bases = F.when(rest == "", F.concat("entries", F.array(F.lit("src/index"), F.lit("index")))).otherwise(F.array(rest, F.concat(F.lit("src/"), rest)))
    tried = F.flatten(F.transform(F.filter(F.transform(bases, lambda b: normal(F.concat_ws("/", F.col("dir"), b))), lambda b: b.isNotNull()), candidates))
    return _probe(at.select("import_id", KEY, tried.alias("tried")), files, "import_id", F.col("tried"))


def build_import_edges(imports: DataFrame, files: DataFrame, configs: DataFrame, manifests: DataFrame) -> DataFrame:
    """imports with to_path, external and package_name: relative, absolute (nowhere), workspace, alias, else external."""
    steps = {"_r": resolve_relative(imports, files), "_w": resolve_workspace(imports, manifests, files), "_a": resolve_alias(imports, configs, files)}
    at = imports
    for name, hit in steps.items():
        at = at.join(by_shuffle(hit.withColumnRenamed("to_path", name)), "import_id", "left")
    inside = F.col("specifier").rlike(r"^[./]")
    at = at.withColumn("to_path", F.when(F.col("specifier").rlike(r"^\."), F.col("_r")).when(~F.col("specifier").startswith("/"), F.coalesce("_w", "_a"))).withColumn("external", F.col("to_path").isNull() & ~inside)
    return at.withColumn("package_name", F.when(F.col("external"), package_name(F.col("specifier")))).drop(*steps)


def bindings(edges: DataFrame) -> DataFrame:
    """(snapshot_id, path, local, to_path, imported): of several imports of a name the last."""
    each = edges.select(KEY, "path", "to_path", "line", F.explode("bindings").alias("b")).select(KEY, "path", "to_path", "line", "b.local", "b.imported")
    last = each.groupBy(KEY, "path", "local").agg(F.max_by(F.struct("to_path", "imported"), F.struct("line", "to_path", "imported")).alias("x"))
    return last.select(KEY, "path", "local", "x.to_path", "x.imported")


def resolve_exports(asked: DataFrame, symbols: DataFrame, reexports: DataFrame) -> DataFrame:
    """asked (snapshot_id, path, name) with symbol_id: an exported top-level symbol of the file, or one found through its
    re-exports in their order. The search keeps a set of visited (file, name) pairs and visits at most MAX_MODULES.

    reexports: (snapshot_id, path, n, imported, exported, to_path); exported "*" passes any name but default.
    """
    own = symbols.filter("exported and parent_id is null").select(KEY, "path", F.col("exported_as").alias("name"), "symbol_id").groupBy(KEY, "path", "name").agg(F.min("symbol_id").alias("symbol_id"))
    start = asked.select(KEY, "path", "name").distinct()
    at = start.select(KEY, F.col("path").alias("root"), F.col("name").alias("wanted"), "path", "name", F.array().cast("array<int>").alias("order"))
    frontier, seen, found = at, at.select(KEY, "root", "wanted", "path", "name", "order"), None
    for _ in range(MAX_MODULES):
        hit = frontier.join(by_shuffle(own), [KEY, "path", "name"]).select(KEY, "root", "wanted", "order", "symbol_id")
        found = hit if found is None else found.union(hit)
        r = reexports.select(KEY, "path", "n", F.col("imported").alias("_i"), "exported", "to_path")
        nxt = frontier.join(by_shuffle(r), [KEY, "path"]).filter((F.col("exported") == F.col("name")) | ((F.col("exported") == "*") & (F.col("name") != "default")))
        nxt = nxt.select(KEY, "root", "wanted", F.col("to_path").alias("path"), F.when(F.col("exported") == "*", F.col("name")).otherwise(F.col("_i")).alias("name"), F.concat("order", F.array(F.col("n").cast("int"))).alias("order"))
        first = nxt.groupBy(KEY, "root", "wanted", "path", "name").agg(F.min("order").alias("order")).join(by_shuffle(seen.drop("order")), [KEY, "root", "wanted", "path", "name"], "left_anti")
        frontier = store(first, "export-frontier")
        if frontier.isEmpty():
            break
        seen = store(seen.unionByName(frontier), "export-seen")
    best = found.groupBy(KEY, "root", "wanted").agg(F.min_by("symbol_id", "order").alias("symbol_id"))
    return start.join(by_shuffle(best.select(KEY, F.col("root").alias("path"), F.col("wanted").alias("name"), "symbol_id")), [KEY, "path", "name"], "left")


def methods_of(symbols: DataFrame) -> DataFrame:
    """(parent_id, name, symbol_id): the first method of each name."""
    return symbols.filter("parent_id is not null").groupBy("parent_id", "name").agg(F.min_by("symbol_id", F.struct("start_line", "symbol_id")).alias("symbol_id"))


def resolve_calls(calls: DataFrame, binds: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """calls with to_symbol_id, resolved and rule, by the first rule that finds a symbol.

    Without receiver: the import of that name (a namespace stands for its default export), else a top-level symbol of
    the file. this: a sibling in the container, else a method of the class around. An identifier: an export of the
    namespace, else a member of that container in the file, else a static method of that class.
    exports: resolve_exports() of the bindings' (to_path, imported) and of namespaces' (to_path, callee).
    """
    top = by_shuffle(symbols.filter("parent_id is null and container is null").groupBy(KEY, "path", "name").agg(F.min("symbol_id").alias("id")))
    held = by_shuffle(symbols.filter("container is not null").groupBy(KEY, "path", "container", "name").agg(F.min("symbol_id").alias("id")))
    methods = by_shuffle(methods_of(symbols))
    exp = by_shuffle(exports.select(KEY, F.col("path").alias("to_path"), F.col("name").alias("_n"), F.col("symbol_id").alias("id")))
    around = by_shuffle(symbols.select(F.col("symbol_id").alias("from_symbol_id"), F.col("parent_id").alias("_p"), F.col("container").alias("_c")))
    b = by_shuffle(binds.select(KEY, "path", F.col("local").alias("_l"), "to_path", "imported"))
    plain = calls.filter("receiver is null")
    r1 = plain.join(b, [KEY, "path"]).filter("_l = callee_name").withColumn("_n", F.when(F.col("imported") == "*", "default").otherwise(F.col("imported"))).join(exp, [KEY, "to_path", "_n"]).select("call_id", "id", F.lit(1).alias("rule"))
    r2 = plain.join(b.select(KEY, "path", F.col("_l").alias("callee_name")), [KEY, "path", "callee_name"], "left_anti").join(top.withColumnRenamed("name", "callee_name"), [KEY, "path", "callee_name"]).select("call_id", "id", F.lit(2).alias("rule"))
    # calls of no symbol, of which there are many, have no key here
    this = calls.filter("receiver = 'this'").join(around, "from_symbol_id")
    r3 = this.join(held.toDF(KEY, "path", "_c", "callee_name", "id"), [KEY, "path", "_c", "callee_name"]).select("call_id", "id", F.lit(3).alias("rule"))
    r4 = this.join(methods.toDF("_p", "callee_name", "id"), ["_p", "callee_name"]).select("call_id", "id", F.lit(4).alias("rule"))
    named = calls.filter(r"receiver is not null and receiver <> 'this' and receiver rlike '^[A-Za-z_$][A-Za-z0-9_$]*$'")
    r5 = named.join(b.filter("imported = '*'"), [KEY, "path"]).filter("_l = receiver").join(exp.withColumnRenamed("_n", "callee_name"), [KEY, "to_path", "callee_name"]).select("call_id", "id", F.lit(5).alias("rule"))
    r6 = named.join(held.toDF(KEY, "path", "receiver", "callee_name", "id"), [KEY, "path", "receiver", "callee_name"]).select("call_id", "id", F.lit(6).alias("rule"))
    owners = named.join(top.toDF(KEY, "path", "receiver", "_o"), [KEY, "path", "receiver"])
    r7 = owners.join(methods.toDF("_o", "callee_name", "id"), ["_o", "callee_name"]).select("call_id", "id", F.lit(7).alias("rule"))
    hits = r1.union(r2).union(r3).union(r4).union(r5).union(r6).union(r7).filter("id is not null").groupBy("call_id").agg(F.min(F.struct("rule", "id")).alias("x"))
    return calls.join(by_shuffle(hits), "call_id", "left").select(*calls.columns, F.col("x.id").alias("to_symbol_id"), F.col("x").isNotNull().alias("resolved"), F.col("x.rule").alias("rule"))


def resolve_handlers(routes: DataFrame, binds: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """routes with handler_symbol_id: the handler's text as a call, split at its last dot."""
    dotted = F.instr("handler", ".") > 0
    at = routes.withColumns({"call_id": F.col("route_id"), "receiver": F.when(dotted, F.regexp_extract("handler", r"^(.*)\.[^.]*$", 1)), "callee_name": F.substring_index("handler", ".", -1), "from_symbol_id": F.lit(None).cast(symbols.schema["symbol_id"].dataType)})
    got = resolve_calls(at, binds, symbols, exports)
    return got.withColumnRenamed("to_symbol_id", "handler_symbol_id").drop("call_id", "receiver", "callee_name", "from_symbol_id", "resolved", "rule")


def index_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per snapshot: files by kind, parse errors, symbols, imports and calls by outcome, routes."""
    out = files.groupBy(KEY).agg(F.count("*").alias("files"), *(F.count_if(F.col("kind") == k).alias(f"files_{k.lower()}") for k in ("CODE", "DOC", "CONFIG")), F.count_if("has_errors").alias("parse_errors"))
    parts = [
        symbols.groupBy(KEY).agg(F.count("*").alias("symbols")),
        edges.groupBy(KEY).agg(F.count("*").alias("imports"), F.count_if(F.col("to_path").isNotNull()).alias("imports_internal"), F.count_if("external").alias("imports_external"), F.count_if(F.col("to_path").isNull() & ~F.col("external")).alias("imports_unresolved")),
        calls.groupBy(KEY).agg(F.count("*").alias("calls"), F.count_if("resolved").alias("calls_resolved")),
        routes.groupBy(KEY).agg(F.count("*").alias("routes")),
    ]
    for p in parts:
        out = out.join(p, KEY, "left")
    return out.fillna(0)

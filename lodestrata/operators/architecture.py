"""Architecture and onboarding roll-ups over files, imports, routes and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.text import classify_role, directories, file_name
from lodestrata.operators.catalogs import CATEGORIES, STACK_FILES
from lodestrata.operators.facts import match_lines
from lodestrata.sources.shared import store

MAX_COMPONENTS, SPLIT_FILES, SPLIT_SHARE, EXAMPLES, TOP = 12, 8, 0.35, 5, 8
#: Patterns of reading environment variables and of declaring data models.
ENV_PATTERNS = [r"process\.env\.([A-Z_][A-Z0-9_]*)", r"process\.env\[\s*['\"`]([A-Z_][A-Z0-9_]*)['\"`]\s*\]", r"import\.meta\.env\.([A-Z_][A-Z0-9_]*)"]
MODEL_PATTERNS = {
    "mongoose": r"\bmongoose\.model\(\s*['\"`]([\w$]+)['\"`]",
    "typeorm": r"@Entity\([^)]*\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)",
    "drizzle": r"\b(?:pgTable|mysqlTable|sqliteTable)\(\s*['\"`]([\w$]+)['\"`]",
    "sequelize": r"\.define\(\s*['\"`]([\w$]+)['\"`]",
}
SEQUELIZE_IMPORT = r"from\s+['\"]sequelize['\"]|require\(\s*['\"]sequelize['\"]\s*\)"
PRISMA_MODEL = r"(?m)^[ \t]*model\s+([\w$]+)\s*\{"
ENTRY_NAME = r"^(index|main|server|app|cli)\.[cm]?[jt]sx?$"
FRAMEWORK_ENTRY = r"^(src/)?(app/(layout|page)\.[jt]sx?|pages/_app\.[jt]sx?|middleware\.[jt]s)$"


def _prefixes(files: DataFrame) -> DataFrame:
    """(snapshot_id, path, depth, dir): each directory above a file, "" at depth 0."""
    dirs = directories(F.col("path"))
    n = F.size(dirs)
    return files.select("snapshot_id", "path", F.explode(F.sequence(F.lit(0), n)).alias("depth"), dirs.alias("d")).select("snapshot_id", "path", "depth", F.array_join(F.slice("d", F.lit(1), F.col("depth")), "/").alias("dir"))


def group_components(files: DataFrame, rounds: int = 64) -> DataFrame:
    """(snapshot_id, path, component): files of other roles by role; source files by directory below their shared prefix.

    While a group is larger than max(SPLIT_FILES, SPLIT_SHARE of the source files) and the groups would stay within
    MAX_COMPONENTS, the largest (ties by name) is split by its next directory. The loop runs on the table of directory
    counts, for all snapshots at once; files are looked up once at the end.
    """
    at = files.select("snapshot_id", "path", classify_role(F.col("path")).alias("role"))
    source = at.filter("role = 'source'")
    dirs = store(_prefixes(source).groupBy("snapshot_id", "depth", "dir").agg(F.count("*").alias("n"), F.count_if(F.size(directories(F.col("path"))) == F.col("depth")).alias("own")), "directories")
    total = dirs.filter("depth = 0").select("snapshot_id", F.col("n").alias("all"))
    shared = dirs.join(total, "snapshot_id").filter("n = all").groupBy("snapshot_id").agg(F.max("depth").alias("root"), F.first("all").alias("all"))
    parent = F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))), "/")
    tree = dirs.withColumn("parent", parent)
    groups = dirs.join(shared, "snapshot_id").filter("depth = root").select("snapshot_id", "depth", "dir", "n", "own", "all", F.lit(True).alias("open"))
    first = True
    for _ in range(rounds):
        w = W.partitionBy("snapshot_id")
        size = F.max(F.when(F.col("open"), F.col("n"))).over(w)
        g = groups.withColumn("k", F.count("*").over(w)).withColumn("pick", F.col("open") & (F.col("n") == size) & (F.lit(first) | (F.col("n") > F.greatest(F.lit(float(SPLIT_FILES)), F.col("all") * SPLIT_SHARE))))
        g = g.withColumn("pick", F.col("pick") & (F.row_number().over(W.partitionBy("snapshot_id", "pick").orderBy("dir")) == 1))
        below = tree.filter("depth > 0").select("snapshot_id", F.col("parent").alias("dir"), (F.col("depth") - 1).alias("depth"), F.col("dir").alias("sub"), F.col("n").alias("sub_n"), F.col("own").alias("sub_own"))
        parts = g.filter("pick").join(below, ["snapshot_id", "dir", "depth"])
        fits = parts.groupBy("snapshot_id").agg((F.count("*") + F.max((F.col("own") > 0).cast("int")) + F.max("k") - 1).alias("would")).filter(F.col("would") <= MAX_COMPONENTS)
        fit = store(parts.join(fits.select("snapshot_id"), "snapshot_id", "left_semi"), "component-parts")
        split = fit.select("snapshot_id").distinct().withColumn("split", F.lit(True))
        kept = g.join(split, "snapshot_id", "left").withColumn("split", F.coalesce("split", F.lit(False)))
        rest = kept.filter("not (pick and split) or own > 0").select("snapshot_id", "depth", "dir", F.when(F.col("pick") & F.col("split"), F.col("own")).otherwise(F.col("n")).alias("n"), "own", "all", (F.col("open") & ~F.col("pick")).alias("open"))
        more = fit.select("snapshot_id", (F.col("depth") + 1).alias("depth"), F.col("sub").alias("dir"), F.col("sub_n").alias("n"), F.col("sub_own").alias("own"), "all", F.lit(True).alias("open"))
        groups = store(rest.union(more), "components")
        first = False
        if g.filter("pick").isEmpty():
            break
    named = _prefixes(source).join(groups.select("snapshot_id", "depth", "dir"), ["snapshot_id", "depth", "dir"])
    longest = named.groupBy("snapshot_id", "path").agg(F.max_by("dir", "depth").alias("component"))
    return longest.select("snapshot_id", "path", F.when(F.col("component") == "", "(root)").otherwise(F.col("component")).alias("component")).union(at.filter("role <> 'source'").select("snapshot_id", "path", F.concat(F.lit("("), "role", F.lit(")"))))


def component_deps(components: DataFrame, imports: DataFrame) -> DataFrame:
    """(snapshot_id, from_component, to_component, imports, examples): resolved imports between components."""
    c = components.select("snapshot_id", "path", "component")
    at = imports.filter("to_path is not null").join(c.withColumnsRenamed({"path": "from_path", "component": "from_component"}), ["snapshot_id", "from_path"]).join(c.withColumnsRenamed({"path": "to_path", "component": "to_component"}), ["snapshot_id", "to_path"]).filter("from_component <> to_component")
    example = F.concat("from_path", F.lit(" → "), "to_path")
    ranked = at.withColumn("_n", F.row_number().over(W.partitionBy("snapshot_id", "from_component", "to_component").orderBy("from_path", "to_path")))
    return ranked.groupBy("snapshot_id", "from_component", "to_component").agg(F.count("*").alias("imports"), F.array_compact(F.array_sort(F.collect_list(F.when(F.col("_n") <= EXAMPLES, example)))).alias("examples"))


def component_stats(components: DataFrame, symbols: DataFrame, routes: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("snapshot_id", "path").agg(F.count("*").alias(name))
    at = components.join(count(symbols, "s"), ["snapshot_id", "path"], "left").join(count(routes, "r"), ["snapshot_id", "path"], "left")
    return at.groupBy("snapshot_id", "component").agg(F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("r"), F.lit(0)).alias("routes"))


def detect_integrations(imports: DataFrame, declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(snapshot_id, name, kind, sites, packages) of catalogued packages that are imported or declared."""
    used = imports.select("snapshot_id", "package", F.lit(1).alias("site")).union(declared.select("snapshot_id", "package", F.lit(0)))
    return used.join(catalog, "package").groupBy("snapshot_id", "name", "kind").agg(F.sum("site").alias("sites"), F.array_sort(F.collect_set("package")).alias("packages"))


def integration_usage(imports: DataFrame, components: DataFrame, catalog: DataFrame) -> DataFrame:
    at = imports.join(catalog, "package").join(components, ["snapshot_id", "path"])
    at = at.withColumn("_n", F.row_number().over(W.partitionBy("snapshot_id", "component", "name").orderBy("path", "line")))
    example = F.when(F.col("_n") <= EXAMPLES, F.concat_ws(":", "path", F.col("line").cast("string")))
    return at.groupBy("snapshot_id", "component", "name").agg(F.count("*").alias("imports"), F.array_sort(F.collect_list(example)).alias("examples"))


def detect_env_vars(lines: DataFrame) -> DataFrame:
    """(snapshot_id, name, count, usages): variables read in the lines, with the first five places."""
    found = F.concat(*(F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in ENV_PATTERNS))
    at = lines.select("snapshot_id", "path", "line_no", F.explode(found).alias("name"))
    at = at.withColumn("_n", F.row_number().over(W.partitionBy("snapshot_id", "name").orderBy("path", "line_no")))
    return at.groupBy("snapshot_id", "name").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.struct("path", "line_no")))).alias("usages"))


def detect_data_models(files: DataFrame) -> DataFrame:
    """(snapshot_id, path, source, name, line): models of schema files, and of the ORM patterns elsewhere."""
    prisma = F.col("path").endswith(".prisma")
    found = lambda source, pattern: F.transform(match_lines(F.col("content"), pattern), lambda x: F.struct(F.lit(source).alias("source"), F.regexp_extract(x["m"], pattern, 1).alias("name"), x["line"].alias("line")))
    each = [F.when(prisma, found("prisma", PRISMA_MODEL))]
    for source, pattern in MODEL_PATTERNS.items():
        guard = F.col("content").rlike(SEQUELIZE_IMPORT) if source == "sequelize" else F.lit(True)
        each.append(F.when(~prisma & guard, found(source, pattern)))
    none = F.array().cast("array<struct<source:string,name:string,line:int>>")
    at = files.select("snapshot_id", "path", F.explode(F.concat(*(F.coalesce(e, none) for e in each))).alias("m"))
    return at.select("snapshot_id", "path", "m.source", "m.name", "m.line")


def declared_dependencies(manifests: DataFrame, *fields: str) -> DataFrame:
    """(snapshot_id, path, package) of the dependency fields of manifests."""
    names = F.flatten(F.array(*(F.coalesce(F.json_object_keys(F.get_json_object("content", f"$.{f}")), F.array().cast("array<string>")) for f in fields)))
    return manifests.select("snapshot_id", "path", F.explode(names).alias("package"))


def detect_stack(declared: DataFrame, catalog: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, name, category, evidence, position): one row per name, in the order of categories and names.

    Manifests come before the file-name rules, and the shallowest of either before deeper ones, ties by path. Where
    nothing shows TypeScript, a JavaScript file shows JavaScript.
    """
    depth = lambda c: F.size(F.split(c, "/"))
    at = declared.join(F.broadcast(catalog), "package").select("snapshot_id", "name", "category", F.lit(0).alias("by"), "path")
    if files is not None:
        rules = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(n).alias("name"), F.lit(c).alias("category")) for p, n, c in STACK_FILES))
        shown = files.select("snapshot_id", "path", F.explode(F.filter(rules, lambda r: F.regexp(F.col("path"), r["p"]))).alias("r")).select("snapshot_id", "r.name", "r.category", F.lit(1).alias("by"), "path")
        script = files.filter(F.col("path").rlike(r"\.[cm]?js$")).select("snapshot_id", F.lit("JavaScript").alias("name"), F.lit("language").alias("category"), F.lit(2).alias("by"), "path")
        typed = at.union(shown).filter("name = 'TypeScript'").select("snapshot_id").distinct()
        at = at.union(shown).union(script.join(typed, "snapshot_id", "left_anti"))
    best = at.groupBy("snapshot_id", "name").agg(F.min(F.struct("by", depth(F.col("path")).alias("depth"), "path", "category")).alias("b"))
    best = best.select("snapshot_id", "name", "b.category", F.col("b.path").alias("evidence"))
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return best.withColumn("position", F.row_number().over(W.partitionBy("snapshot_id").orderBy(order, "category", "name")))


def declared_entries(manifests: DataFrame) -> DataFrame:
    """(snapshot_id, entry): main, module and bin (text or map) of manifests, relative to the root."""
    folder = F.array_join(directories(F.col("path")), "/")
    bins = F.from_json(F.get_json_object("content", "$.bin"), "map<string,string>")
    text = F.when(F.coalesce(F.size(bins), F.lit(-1)) < 0, F.get_json_object("content", "$.bin"))
    names = F.concat(F.array_compact(F.array(F.get_json_object("content", "$.main"), F.get_json_object("content", "$.module"), text)), F.coalesce(F.map_values(bins), F.array().cast("array<string>")))
    at = manifests.select("snapshot_id", folder.alias("f"), F.explode(names).alias("e"))
    clean = F.regexp_replace("e", r"^(\./)+", "")
    return at.select("snapshot_id", F.when(F.col("f") == "", clean).otherwise(F.concat_ws("/", "f", clean)).alias("entry")).distinct()


def rank_start_files(files: DataFrame, imports: DataFrame, routes: DataFrame, declared: DataFrame) -> DataFrame:
    """(snapshot_id, path, score, reasons, rank): where a newcomer starts; source files only, TOP a snapshot."""
    s = files.filter(classify_role(F.col("path")) == "source").select("snapshot_id", "path")
    by = imports.filter((F.col("from_path") != F.col("to_path")) & (classify_role(F.col("from_path")) == "source")).groupBy("snapshot_id", F.col("to_path").alias("path")).agg(F.countDistinct("from_path").alias("i"))
    r = routes.groupBy("snapshot_id", "path").agg(F.count("*").alias("r"))
    d = declared.select("snapshot_id", F.col("entry").alias("path"), F.lit(True).alias("d")).distinct()
    at = s.join(by, ["snapshot_id", "path"], "left").join(r, ["snapshot_id", "path"], "left").join(d, ["snapshot_id", "path"], "left").fillna(0, ["i", "r"]).fillna(False, ["d"])
    framework = F.col("path").rlike(FRAMEWORK_ENTRY)
    named = file_name(F.col("path")).rlike(ENTRY_NAME) & (F.size(F.split("path", "/")) <= 2)
    entry = F.when(F.col("d"), 12).when(framework | named, 8).otherwise(0)
    score = entry + F.when(F.col("i") >= 2, F.least("i", F.lit(12))).otherwise(0) + F.when(F.col("r") > 0, F.least(F.col("r") + 2, F.lit(8))).otherwise(0)
    why = F.array_compact(F.array(F.when(F.col("d"), "declared entry point").when(framework, "framework entry point").when(named, "entry point"), F.when(F.col("i") >= 2, F.concat(F.lit("imported by "), F.col("i").cast("string"), F.lit(" files"))), F.when(F.col("r") > 0, F.concat(F.lit("routes: "), F.col("r").cast("string")))))
    at = at.select("snapshot_id", "path", score.cast("long").alias("score"), why.alias("reasons")).filter("score > 0")
    return at.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("score"), "path"))).filter(F.col("rank") <= TOP)


def route_weight(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """routes with weight: resolved calls in the handler's lines."""
    c = calls.filter("resolved").select("snapshot_id", "path", F.col("line").alias("_l"))
    n = routes.select("route_id", "snapshot_id", "path", "start_line", "end_line").join(c, ["snapshot_id", "path"]).filter(F.col("_l").between(F.col("start_line"), F.col("end_line"))).groupBy("route_id").agg(F.count("*").alias("weight"))
    return routes.join(n, "route_id", "left").fillna(0, ["weight"])


def key_routes(weighted: DataFrame, most: int = 5) -> DataFrame:
    """One route per first segment that is no parameter: the weightiest; the resources with most routes first."""
    parts = F.filter(F.split("url_path", "/"), lambda s: (s != "") & ~s.startswith(":") & ~s.startswith("["))
    at = weighted.filter(classify_role(F.col("path")) == "source").withColumn("resource", F.coalesce(F.get(parts, F.lit(0)), F.lit("/")))
    value = F.col("weight") * 10 + F.col("method").isin("POST", "PUT", "PATCH", "DELETE").cast("int")
    w = W.partitionBy("snapshot_id", "resource")
    at = at.withColumn("size", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(value), "url_path", "method", "route_id"))).filter("_n = 1")
    return at.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("size"), "resource"))).filter(F.col("rank") <= most).drop("_n")


def folder_tree(files: DataFrame) -> DataFrame:
    """(snapshot_id, folder, files, children): every folder above a file, with its own children and all files below."""
    at = _prefixes(files).filter("depth > 0")
    child = F.get(F.split("path", "/"), F.col("depth"))
    return at.groupBy("snapshot_id", F.col("dir").alias("folder")).agg(F.count("*").alias("files"), F.countDistinct(child).alias("children"))


def package_description(manifests: DataFrame) -> DataFrame:
    """(snapshot_id, description): that of the root manifest, trimmed, if it has any."""
    text = F.trim(F.get_json_object("content", "$.description"))
    return manifests.filter("path = 'package.json'").select("snapshot_id", text.alias("description")).filter("description <> ''")


def top_components(stats: DataFrame, deps: DataFrame, most: int = TOP) -> DataFrame:
    """(snapshot_id, component, files, routes, imports_from, rank): the largest components with those they import, at most MAX_COMPONENTS of these."""
    ranked = stats.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("files"), "component"))).filter(F.col("rank") <= most)
    w = W.partitionBy("snapshot_id", "from_component").orderBy(F.desc("imports"), "to_component")
    of = deps.join(stats.select("snapshot_id", F.col("component").alias("to_component")), ["snapshot_id", "to_component"], "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= MAX_COMPONENTS)
    of = of.groupBy("snapshot_id", F.col("from_component").alias("component")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "to_component"))), lambda x: x["to_component"]).alias("imports_from"))
    none = F.array().cast("array<string>")
    return ranked.join(of, ["snapshot_id", "component"], "left").select("snapshot_id", "component", "files", "routes", F.coalesce("imports_from", none).alias("imports_from"), "rank")


def document(key: str, **tables: DataFrame) -> DataFrame:
    """One row per snapshot with an array of structs per table, each sorted; a table without rows gives an empty one.

    Meant for tables that bound their own lists (top lists, catalogs, one row for each name), as those below do.
    """
    out = None
    for t in tables.values():
        ids = t.select(key).distinct()
        out = ids if out is None else out.union(ids).distinct()
    for name, t in tables.items():
        cols = [c for c in t.columns if c != key]
        each = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(each, key, "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))
    return out


def build_guide(description: DataFrame, stack: DataFrame, start_files: DataFrame, flows: DataFrame, components: DataFrame, integrations: DataFrame, models: DataFrame, env_vars: DataFrame) -> DataFrame:
    """The guide of each snapshot: what it says of itself, its stack, where to start, key routes, largest components,
    integrations that source components use, models, and each environment variable with its first place."""
    used = integrations.select("snapshot_id", "name", "kind").distinct()
    first = env_vars.select("snapshot_id", "name", F.get("usages", F.lit(0))["path"].alias("path"), F.get("usages", F.lit(0))["line_no"].alias("line_no"))
    return document("snapshot_id", description=description, stack=stack, start_files=start_files, flows=flows, components=components, integrations=used, models=models, env_vars=first)


def build_architecture(components: DataFrame, deps: DataFrame, integrations: DataFrame, usage: DataFrame, models: DataFrame, env_vars: DataFrame) -> DataFrame:
    """The architecture of each snapshot: components with totals, imports between them, integrations and who uses them, models, variables."""
    return document("snapshot_id", components=components, deps=deps, integrations=integrations, usage=usage, models=models, env_vars=env_vars)


def build_insights(most_called: DataFrame, longest: DataFrame, largest: DataFrame, cycles: DataFrame, tested: DataFrame, untested: DataFrame) -> DataFrame:
    """The insights of each snapshot: hotspots, import cycles with their loops, most tested files, and hubs without tests."""
    return document("snapshot_id", most_called=most_called, longest=longest, largest=largest, cycles=cycles, tested=tested, untested=untested)


def map_graph(deps: DataFrame, usage: DataFrame, hidden: DataFrame, stores: list[str]) -> DataFrame:
    """(snapshot_id, kind, source, target, n): import edges between visible components, and what these use or store in."""
    gone = hidden.select("snapshot_id", "component").distinct()
    seen = lambda df, c: df.join(gone.withColumnRenamed("component", c), ["snapshot_id", c], "left_anti")
    a = seen(seen(deps, "from_component"), "to_component").select("snapshot_id", F.lit("import").alias("kind"), F.col("from_component").alias("source"), F.col("to_component").alias("target"), F.col("imports").alias("n"))
    b = seen(usage, "component").select("snapshot_id", F.when(F.col("name").isin(stores), "stores").otherwise("uses").alias("kind"), F.col("component").alias("source"), F.col("name").alias("target"), F.col("imports").alias("n"))
    return a.union(b)

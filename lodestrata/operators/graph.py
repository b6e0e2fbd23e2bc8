"""Graph analytics over symbols, calls, routes and imports. Whatever is joined on a path is joined on its snapshot too.

Loops write each round to the shared folder, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.text import classify_role, is_test_file
from lodestrata.operators import reach
from lodestrata.sources.shared import by_shuffle, store

TOP, LISTED = 8, 50
TRACE_DEPTH, TRACE_NODES, TRACE_CALLS = 4, 40, 30
PLACE = ["snapshot_id", "path"]
#: Lines of a stretch: spans and lines meet by stretch and not by file, so that a file of any length is shared out.
STRETCH = 32
NEAR = [*PLACE, "stretch"]
#: Rows of two ids that are broadcast at most.
FEW = 200_000
#: Names of calls that register a route.
REGISTRATION = ["get", "post", "put", "patch", "delete", "all", "route", "use", "head", "options"]


def _stretch(line: str) -> Column:
    return F.floor(F.col(line) / STRETCH)


def _stretches(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """A row for each stretch that a span touches. A line is in one stretch, so it meets a span once."""
    return spans.filter(F.col(lo) <= F.col(hi)).withColumn("stretch", F.explode(F.sequence(_stretch(lo), _stretch(hi))))


def symbol_at(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points(point_id, snapshot_id, path, line) with symbol_id, the tightest span around the line, or null; ties by id."""
    s = symbols.select(*PLACE, "symbol_id", "start_line", "end_line")
    at = points.withColumn("stretch", _stretch("line")).join(_stretches(s, "start_line", "end_line"), NEAR).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = at.groupBy("point_id").agg(F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("symbol_id"))).alias("symbol_id"))
    return points.join(best, "point_id", "left")


def _first(df: DataFrame, by: str | list[str], n: int, *order) -> DataFrame:
    """The first n rows of each by, with truncated: whether there were more."""
    by = [by] if isinstance(by, str) else by
    w = W.partitionBy(*by).orderBy(*order)
    at = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n + 1)
    return at.withColumn("truncated", F.max("rank").over(W.partitionBy(*by)) > n).filter(F.col("rank") <= n)


def _inline_routes(calls: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """calls with route_id: of the routes around the line of a call at module scope the tightest, ties by id."""
    r = routes.select(F.col("snapshot_id").alias("r_snapshot"), F.col("path").alias("r_path"), "route_id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    r = _stretches(r, "r_start", "r_end").withColumnRenamed("stretch", "r_stretch")
    around = F.col("from_symbol_id").isNull() & (F.col("snapshot_id") == F.col("r_snapshot")) & (F.col("path") == F.col("r_path")) & (_stretch("line") == F.col("r_stretch")) & F.col("line").between(F.col("r_start"), F.col("r_end"))
    return calls.join(r, around, "left").groupBy(*key).agg(F.min_by("route_id", F.struct(F.col("r_end") - F.col("r_start"), F.col("route_id"))).alias("route_id"))


def callers(targets: DataFrame, calls: DataFrame, routes: DataFrame, most: int = LISTED) -> DataFrame:
    """Resolved calls of each target by path and line; calls at module scope take the route around their line, if any."""
    c = targets.join(calls.filter("resolved"), F.col("symbol_id") == F.col("to_symbol_id"))
    each = _inline_routes(c, routes, ["symbol_id", "from_symbol_id", "snapshot_id", "path", "line"])
    return _first(each, "symbol_id", most, F.col("path"), F.col("line"), F.col("from_symbol_id")).drop("snapshot_id")


def _narrowed(symbols: DataFrame) -> DataFrame:
    """(symbol_id, snapshot_id, path, lo, hi): each symbol's lines; of a class those of its constructor, or none without one."""
    made = symbols.filter("name = 'constructor'").groupBy(F.col("parent_id").alias("symbol_id")).agg(F.min(F.struct("start_line", "end_line")).alias("m"))
    of = lambda own, inner: F.when(F.col("kind") == "class", F.col(inner)).otherwise(F.col(own))
    return symbols.join(made, "symbol_id", "left").select("symbol_id", *PLACE, of("start_line", "m.start_line").alias("lo"), of("end_line", "m.end_line").alias("hi"))


def callees(targets: DataFrame, symbols: DataFrame, calls: DataFrame, most: int = LISTED) -> DataFrame:
    """Different (line, text) calls in each target's lines; of a class those of its constructor, or none without one."""
    at = targets.join(_narrowed(symbols), "symbol_id")
    c = calls.select(*PLACE, "line", "callee_text", "to_symbol_id")
    c = c.withColumn("stretch", _stretch("line"))
    each = _stretches(at, "lo", "hi").join(c, NEAR).filter(F.col("line").between(F.col("lo"), F.col("hi"))).groupBy("symbol_id", "line", "callee_text").agg(F.min("to_symbol_id").alias("to_symbol_id"))
    return _first(each, "symbol_id", most, F.col("line"), F.col("callee_text"))


def routes_of(targets: DataFrame, routes: DataFrame) -> DataFrame:
    return targets.join(routes, F.col("symbol_id") == F.col("handler_symbol_id")).select("symbol_id", "route_id", "method", "url_path")


def trace_routes(routes: DataFrame, symbols: DataFrame, calls: DataFrame, depth: int = TRACE_DEPTH, nodes: int = TRACE_NODES, per_node: int = TRACE_CALLS) -> tuple[DataFrame, DataFrame]:
    """(nodes, calls) of each route's request: breadth first from its handler over the calls in each node's lines.

    A route without a handler symbol starts at its own lines (symbol_id null), less the call on the first of them that
    registers it. A class is narrowed to its constructor. A node keeps its first per_node calls by line and text, those
    that nothing resolves included. New nodes are taken in order of their parent's place, line and text, up to `nodes` a
    route. Nodes at the last depth list their calls and are not followed. truncated: the node has more calls, or a call
    of it leads to a node beyond the limit.
    """
    spans, known = store(_narrowed(symbols), "trace-spans"), store(symbols.select(F.col("symbol_id").alias("next")), "trace-known")
    listed = store(calls.groupBy(*PLACE, "line", "callee_text").agg(F.min("to_symbol_id").alias("to_symbol_id")).withColumn("stretch", _stretch("line")), "trace-listed")
    start = routes.select("route_id", F.col("handler_symbol_id").alias("symbol_id"))
    seen = store(start.select("*", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place"), F.lit(None).cast(symbols.schema["symbol_id"].dataType).alias("parent_id")), "trace")
    own = routes.filter("handler_symbol_id is null").select("route_id", F.col("handler_symbol_id").alias("symbol_id"), *PLACE, F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    name = F.lower(F.substring_index("callee_text", ".", -1))
    made, frontier, rounds = None, seen, [seen]
    for d in range(depth + 1):
        held = frontier.join(spans, "symbol_id")
        at = held.select("route_id", "symbol_id", "depth", "place", *PLACE, "lo", "hi", F.lit(False).alias("inline"))
        if d == 0:
            at = at.union(own.select("route_id", "symbol_id", F.lit(0), F.lit(1).cast("long"), *PLACE, "lo", "hi", F.lit(True)))
        at = _stretches(at, "lo", "hi").join(listed, NEAR).filter(F.col("line").between(F.col("lo"), F.col("hi")) & ~(F.col("inline") & (F.col("line") == F.col("lo")) & name.isin(REGISTRATION)))
        out = _first(at, ["route_id", "symbol_id"], per_node, F.col("line"), F.col("callee_text"))
        out = store(out.select("route_id", "symbol_id", "depth", "place", "line", "callee_text", "to_symbol_id", F.col("rank").alias("n"), "truncated"), "trace-calls")
        made = out if made is None else made.union(out)
        if d == depth:
            break
        every = rounds[0] if len(rounds) == 1 else reduce(DataFrame.union, rounds)
        new = out.filter("to_symbol_id is not null").groupBy("route_id", F.col("to_symbol_id").alias("next")).agg(F.min(F.struct("place", "n", F.col("symbol_id").alias("parent_id"))).alias("o"))
        new = new.join(every.select("route_id", F.col("symbol_id").alias("next")), ["route_id", "next"], "left_anti").join(known, "next", "left_semi")
        held = every.groupBy("route_id").agg(F.count("*").alias("held"))
        new = new.join(held, "route_id").withColumn("k", F.row_number().over(W.partitionBy("route_id").orderBy("o.place", "o.n", "next")) + F.col("held")).filter(F.col("k") <= nodes)
        frontier = store(new.select("route_id", F.col("next").alias("symbol_id"), F.lit(d + 1).alias("depth"), F.col("k").cast("long").alias("place"), F.col("o.parent_id").alias("parent_id")), "trace-frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return reduce(DataFrame.union, rounds), made


def trace_tree(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id, symbol_id, place, n): the call of the parent that each node hangs on, the first to it."""
    c = calls.select("route_id", F.col("symbol_id").alias("_p"), F.col("to_symbol_id").alias("_s"), "n")
    first = c.filter("_s is not null").groupBy(F.col("route_id").alias("_r"), "_p", "_s").agg(F.min("n").alias("n"))
    at = nodes.filter("depth > 0").join(first, (F.col("route_id") == F.col("_r")) & F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("symbol_id") == F.col("_s")))
    return at.select("route_id", "symbol_id", "place", "n")


def impact(targets: DataFrame, symbols: DataFrame, calls: DataFrame, routes: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(target_id, kind, symbol_id, route_id, path, depth, parent_id, line): who reaches a target over resolved calls.

    kind symbol: a caller, at its least depth; a class stands for its methods too (depth 0). kind test: a test file with
    a call; these are recorded and not followed. Calls at module scope are of the inline route around them (kind route)
    or of their file (kind module). parent_id: the symbol one step nearer that is called on line; of several the one
    found first, then by path and line. Symbols alone are followed; what the calls of the rest lead to is taken at the end.

    Tasks that hold all links follow them (reach.py); where they are too many for that, rounds of joins do, with equal rows.
    """
    inner, outer, first = _impact_links(targets, symbols, calls, routes)
    id, route = (df.schema[c].dataType.simpleString() for df, c in ((symbols, "symbol_id"), (routes, "route_id")))
    if reach.fits(inner, outer, id, route):
        target = first.schema["target_id"].dataType.simpleString()
        return reach.follow(first, {"inner": inner, "outer": outer}, reach.everything, _IMPACT.format(target=target, id=id, route=route))
    return _impact_rounds(first, inner, outer, rounds)


_IMPACT = "target_id {target}, kind string, symbol_id {id}, route_id {route}, path string, depth int, parent_id {id}, line int"


def _impact_links(targets: DataFrame, symbols: DataFrame, calls: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inner, outer, starts): (callee, symbol_id, n, line), the callers of each symbol in order; (callee, kind, of, at, line), its
    calls in tests and at module scope; (target_id, symbol_id, place), what each target stands for."""
    route_type = routes.schema["route_id"].dataType
    links = calls.filter("resolved and to_symbol_id is not null").select(*PLACE, "line", "from_symbol_id", F.col("to_symbol_id").alias("callee"), is_test_file(F.col("path")).alias("is_test"))
    inline = _inline_routes(links.filter("from_symbol_id is null and not is_test"), routes.filter("handler_symbol_id is null"), [*PLACE, "line", "from_symbol_id", "callee", "is_test"])
    links = store(links.filter("from_symbol_id is not null or is_test").withColumn("route_id", F.lit(None).cast(route_type)).unionByName(inline), "links")
    known = by_shuffle(symbols.select("symbol_id"))
    first_call = F.min(F.struct("path", "line")).alias("o")
    inner = links.filter("not is_test and from_symbol_id is not null").withColumnRenamed("from_symbol_id", "symbol_id").join(known, "symbol_id", "left_semi").groupBy("callee", "symbol_id").agg(first_call)
    n = F.row_number().over(W.partitionBy("callee").orderBy("o.path", "o.line", "symbol_id")).cast("long")
    inner = store(inner.select("callee", "symbol_id", n.alias("n"), F.col("o.line").cast("int").alias("line")), "impact-inner")
    outer = links.filter("is_test or from_symbol_id is null").withColumn("kind", F.when(F.col("is_test"), "test").when(F.col("route_id").isNotNull(), "route").otherwise("module"))
    outer = outer.groupBy("callee", "kind", F.when(F.col("kind") == "route", F.col("route_id")).alias("of"), F.when(F.col("kind") != "route", F.col("path")).alias("at")).agg(first_call)
    outer = store(outer.select("callee", "kind", "of", "at", F.col("o.line").cast("int").alias("line")), "impact-outer")
    first = targets.select("target_id", F.col("target_id").alias("symbol_id")).join(known, "symbol_id", "left_semi")
    first = first.select("target_id", "symbol_id")
    held = first.join(by_shuffle(symbols.filter("kind = 'class'").select("symbol_id")), "symbol_id", "left_semi").join(by_shuffle(symbols.select(F.col("parent_id").alias("symbol_id"), F.col("symbol_id").alias("m"))), "symbol_id").select("target_id", F.col("m").alias("symbol_id"))
    place = F.row_number().over(W.partitionBy("target_id").orderBy("symbol_id")).cast("long")
    return inner, outer, store(first.union(held).distinct().select("target_id", "symbol_id", place.alias("place")), "impact-starts")


def _impact_rounds(starts: DataFrame, inner: DataFrame, outer: DataFrame, rounds: int) -> DataFrame:
    """impact by joins. A symbol is found by number: its caller's place in the last round (31 bits) and the call's place among
    those of its callee (32 bits) in one long, so that a round is a join and a hash aggregate. Parents and lines are looked up at
    the end."""
    kind, route_type = starts.schema["symbol_id"].dataType, outer.schema["of"].dataType
    frontier = starts.select("target_id", "symbol_id", "place", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("key"))
    seen = [frontier]
    for d in range(1, rounds + 1):
        new = frontier.select("target_id", F.col("symbol_id").alias("callee"), "place").join(inner.select("callee", "symbol_id", "n"), "callee")
        new = new.groupBy("target_id", "symbol_id").agg(F.min(F.shiftleft("place", 32).bitwiseOR(F.col("n"))).alias("key"))
        new, old = store(new, "impact-met"), reduce(DataFrame.union, seen).select("target_id", "symbol_id")
        if new.count() <= FEW:  # then what was seen stays where it is
            old = old.join(F.broadcast(new.select("target_id", "symbol_id")), ["target_id", "symbol_id"], "left_semi")
        new = new.join(old, ["target_id", "symbol_id"], "left_anti")
        order = F.row_number().over(W.partitionBy("target_id").orderBy("key")).cast("long")
        frontier = store(new.select("target_id", "symbol_id", order.alias("place"), F.lit(d).alias("depth"), "key"), "impact")
        if frontier.isEmpty():
            break
        seen.append(frontier)
        if len(seen) > 16:  # one table again, so that a long chain does not make a wide plan
            seen = [store(reduce(DataFrame.union, seen), "impact")]
    else:
        raise RuntimeError(f"impact: not settled after {rounds} rounds")
    every = reduce(DataFrame.union, seen)
    up = every.select("target_id", (F.col("depth") + 1).alias("depth"), F.col("place").alias("up"), F.col("symbol_id").alias("parent_id"))
    found = every.withColumns({"up": F.shiftright("key", 32), "n": F.col("key").bitwiseAND(F.lit((1 << 32) - 1))}).join(up, ["target_id", "depth", "up"], "left")
    found = found.join(inner.select(F.col("callee").alias("parent_id"), "n", "line"), ["parent_id", "n"], "left")
    found = found.select("target_id", F.lit("symbol").alias("kind"), "symbol_id", F.lit(None).cast(route_type).alias("route_id"), F.lit(None).cast("string").alias("path"), "depth", "parent_id", "line")
    # the nearest callee of each: least depth (23 bits), then least place (40 bits)
    rest = every.withColumnRenamed("symbol_id", "callee").join(outer.drop("line"), "callee").groupBy("target_id", "kind", "of", "at").agg(F.min(F.shiftleft(F.col("depth").cast("long"), 40).bitwiseOR(F.col("place"))).alias("key"))
    rest = rest.withColumns({"depth": F.shiftright("key", 40).cast("int"), "place": F.col("key").bitwiseAND(F.lit((1 << 40) - 1))}).drop("key")
    rest = rest.join(every.select("target_id", "depth", "place", F.col("symbol_id").alias("callee")), ["target_id", "depth", "place"])
    o = outer.select("callee", F.col("kind").alias("_k"), F.col("of").alias("_o"), F.col("at").alias("_a"), "line")
    rest = rest.join(o, "callee").filter((F.col("kind") == F.col("_k")) & F.col("of").eqNullSafe(F.col("_o")) & F.col("at").eqNullSafe(F.col("_a")))
    return found.union(rest.select("target_id", "kind", F.lit(None).cast(kind), "of", "at", F.col("depth") + 1, "callee", "line"))


def impact_chains(reached: DataFrame, starts: DataFrame, depth: int = 100_000) -> DataFrame:
    """(target_id, symbol_id, chain): symbols from each start (a route's handler) down to the target along parents."""
    symbols = reached.filter("kind = 'symbol'")
    step = symbols.select("target_id", F.col("symbol_id").alias("at"), F.col("parent_id").alias("next"))
    rows = symbols.join(starts.select("symbol_id").distinct(), "symbol_id", "left_semi").select("target_id", "symbol_id", F.col("symbol_id").alias("at"), F.array("symbol_id").alias("chain"))
    done = []
    for _ in range(depth):
        rows = store(rows.join(step, ["target_id", "at"]), "chains")
        done.append(rows.filter("next is null").select("target_id", "symbol_id", "chain"))
        rows = rows.filter("next is not null").select("target_id", "symbol_id", F.col("next").alias("at"), F.concat("chain", F.array("next")).alias("chain"))
        if rows.isEmpty():
            return reduce(DataFrame.union, done)
        if len(done) > 16:
            done = [store(reduce(DataFrame.union, done), "chains-done")]
    raise RuntimeError(f"impact_chains: longer than {depth}")


def impact_chains_of(targets: DataFrame, symbols: DataFrame, calls: DataFrame, routes: DataFrame, starts: DataFrame) -> DataFrame:
    """impact_chains of impact, by the tasks that follow the links."""
    inner, outer, first = _impact_links(targets, symbols, calls, routes)
    id = symbols.schema["symbol_id"].dataType.simpleString()
    if not reach.fits(inner, outer, id):
        return impact_chains(store(_impact_rounds(first, inner, outer, 100_000), "impact-all"), starts)
    chosen = starts.select("symbol_id").filter("symbol_id is not null").distinct()
    return reach.follow(first, {"inner": inner, "chosen": chosen}, reach.chains, f"target_id {first.schema['target_id'].dataType.simpleString()}, symbol_id {id}, chain array<{id}>")


def impact_lists_of(targets: DataFrame, symbols: DataFrame, calls: DataFrame, routes: DataFrame, n_routes: int = 100, n_dependents: int = 200) -> DataFrame:
    """impact_lists of impact; of the tasks that follow the links come only rows that can be on a list."""
    inner, outer, first = _impact_links(targets, symbols, calls, routes)
    id, route = (df.schema[c].dataType.simpleString() for df, c in ((symbols, "symbol_id"), (routes, "route_id")))
    if not reach.fits(inner, outer, id, route):
        return impact_lists(store(_impact_rounds(first, inner, outer, 100_000), "impact-all"), symbols, routes, n_routes, n_dependents)
    s = symbols.select("symbol_id", "path", "start_line", F.col("symbol_id").cast("string").alias("item"))
    r = routes.select("route_id", F.col("handler_symbol_id").alias("handler"), "url_path", "method", "path", "start_line", F.concat(F.lit("route "), F.col("route_id").cast("string")).alias("item"))
    got = reach.follow(first, {"inner": inner, "outer": outer, "symbols": s, "routes": r}, reach.nearest(n_routes, n_dependents), _IMPACT.format(target=first.schema["target_id"].dataType.simpleString(), id=id, route=route))
    return impact_lists(store(got, "impact-nearest"), symbols, routes, n_routes, n_dependents)


def impact_by_file_of(targets: DataFrame, symbols: DataFrame, calls: DataFrame, routes: DataFrame) -> DataFrame:
    """impact_by_file of impact, counted by the tasks that follow the links."""
    inner, outer, first = _impact_links(targets, symbols, calls, routes)
    id = symbols.schema["symbol_id"].dataType.simpleString()
    if not reach.fits(inner, outer, id):
        return impact_by_file(_impact_rounds(first, inner, outer, 100_000), symbols)
    return reach.follow(first, {"inner": inner, "symbols": symbols.select("symbol_id", *PLACE)}, reach.by_file(LISTED), f"target_id {first.schema['target_id'].dataType.simpleString()}, snapshot_id string, path string, n bigint, symbols array<{id}>")


def impact_lists(reached: DataFrame, symbols: DataFrame, routes: DataFrame, n_routes: int = 100, n_dependents: int = 200) -> DataFrame:
    """(target_id, list, item, path, depth, rank, truncated): routes, dependents (symbols, inline routes, files) and tests of each target."""
    r = routes.select("route_id", F.col("handler_symbol_id").alias("_h"), "url_path", "method", F.col("path").alias("r_path"), F.col("start_line").alias("r_start"))
    met = reached.filter("kind = 'symbol'").drop("route_id").join(r, F.col("symbol_id") == F.col("_h"))
    inline = reached.filter("kind = 'route'").join(r, "route_id")
    text = lambda c: F.col(c).cast("string")
    hit = met.select("target_id", "route_id", "depth", "url_path", "method").union(inline.select("target_id", "route_id", "depth", "url_path", "method")).withColumns({"item": text("route_id"), "path": F.lit(None).cast("string")})
    a = _first(hit, "target_id", n_routes, F.col("depth"), F.col("url_path"), F.col("method"), F.col("route_id")).withColumn("list", F.lit("routes"))
    s = reached.filter("kind = 'symbol' and depth > 0").drop("path").join(symbols.select("symbol_id", "path", "start_line"), "symbol_id").select("target_id", text("symbol_id").alias("item"), "path", "depth", "start_line")
    m = reached.filter("kind = 'module'").select("target_id", F.lit("top-level code").alias("item"), "path", "depth", F.col("line").alias("start_line"))
    i = inline.select("target_id", F.concat(F.lit("route "), text("route_id")).alias("item"), F.col("r_path").alias("path"), "depth", F.col("r_start").alias("start_line"))
    b = _first(s.union(m).union(i), "target_id", n_dependents, F.col("depth"), F.col("path"), F.col("start_line"), F.col("item")).withColumn("list", F.lit("dependents"))
    c = reached.filter("kind = 'test'").select("target_id", F.lit(None).cast("string").alias("item"), "path", "depth")
    c = c.withColumns({"rank": F.row_number().over(W.partitionBy("target_id").orderBy("depth", "path")), "truncated": F.lit(False), "list": F.lit("tests")})
    cols = ["target_id", "list", "item", "path", "depth", "rank", "truncated"]
    return a.select(*cols).union(b.select(*cols)).union(c.select(*cols))


def impact_by_file(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target_id, snapshot_id, path, n, symbols): dependents by file with the first LISTED of them."""
    at = reached.filter("kind = 'symbol' and depth > 0").drop("path").join(symbols.select("symbol_id", *PLACE), "symbol_id")
    ranked = at.withColumn("_n", F.row_number().over(W.partitionBy("target_id", *PLACE).orderBy("symbol_id")))
    return ranked.groupBy("target_id", *PLACE).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_n") <= LISTED, F.col("symbol_id")))).alias("symbols"))


def import_cycles(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more; component is their least node.

    Nodes without in- or out-edges go, and nodes of one in- and one out-edge are bridged, about a third of a chain at a
    time, so that a chain of n nodes takes a number of rounds that grows with log n. In what stays the least label is
    spread both ways; nodes that got the same label both ways are a component, and edges between nodes of different
    labels go. Bridged nodes come back in reverse order: one is in its neighbours' component if both are in the same.
    """
    e = store(edges.toDF("a", "b").filter("a <> b").distinct(), "cycle-edges")
    found, bridged = None, []
    for r in range(rounds):
        e = _bridge(e, bridged)
        if e.isEmpty():
            break
        ahead, back = _least_reach(e, "a", "b"), _least_reach(e, "b", "a")
        mark = store(ahead.join(by_shuffle(back.withColumnRenamed("label", "back")), "node"), "cycle-labels")
        both = mark.filter("label = back").select("node", F.col("label").alias("component"))
        found = both if found is None else store(found.union(both), "cycle-found")
        one = mark.select(F.col("node").alias("a"), F.struct("label", "back").alias("ma"), (F.col("label") == F.col("back")).alias("done"))
        two = mark.select(F.col("node").alias("b"), F.struct("label", "back").alias("mb"))
        e = store(e.join(by_shuffle(one), "a").join(by_shuffle(two), "b").filter("ma = mb and not done").select("a", "b"), "cycle-edges")
    else:
        raise RuntimeError(f"import_cycles: not settled after {rounds} rounds")
    if found is None:
        found = edges.sparkSession.createDataFrame([], "node long, component long")
    for out in reversed(bridged):
        u, w = found.select(F.col("node").alias("u"), F.col("component").alias("cu")), found.select(F.col("node").alias("w"), F.col("component").alias("cw"))
        at = out.join(by_shuffle(u), "u", "left").join(by_shuffle(w), "w", "left").filter("u = w or cu = cw").withColumn("component", F.coalesce("cu", "u"))
        found = store(found.union(at.select(F.col("v").alias("node"), "component")).union(at.filter("cu is null").select(F.col("u").alias("node"), "component")).distinct(), "cycle-found")
    names = found.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return found.join(by_shuffle(names), "component").select("node", F.col("least").alias("component"))


def _bridge(e: DataFrame, bridged: list[DataFrame]) -> DataFrame:
    """e without ends and with its one-in, one-out nodes bridged until few are left; bridged gets (v, u, w) of each round."""
    for r in range(200):
        ends = e.select(F.col("a").alias("v"), F.lit(None).cast("long").alias("u"), F.col("b").alias("w")).union(e.select("b", "a", F.lit(None).cast("long"))).groupBy("v").agg(F.count("u").alias("i"), F.count("w").alias("o"), F.min("u").alias("u"), F.min("w").alias("w"))
        ends = store(ends.withColumn("h", F.when((F.col("i") == 1) & (F.col("o") == 1), F.xxhash64(F.lit(r), "v"))), "cycle-ends")
        h = ends.filter("h is not null").select(F.col("v").alias("x"), F.col("h").alias("hx"))
        free = ends.filter("h is not null").join(by_shuffle(h.toDF("u", "hu")), "u", "left").join(by_shuffle(h.toDF("w", "hw")), "w", "left").filter("(hu is null or h > hu) and (hw is null or h > hw)").select("v", "u", "w")
        free, dead = store(free, "cycle-bridged"), ends.filter("i = 0 or o = 0").select("v")
        if free.isEmpty() and dead.isEmpty():
            return e
        bridged.append(free)
        gone = store(free.select("v").union(dead), "cycle-gone")
        kept = e.join(by_shuffle(gone.toDF("a")), "a", "left_anti").join(by_shuffle(gone.toDF("b")), "b", "left_anti").select("a", "b")
        e = store(kept.union(free.filter("u <> w").select("u", "w").join(by_shuffle(dead.toDF("u")), "u", "left_anti").join(by_shuffle(dead.toDF("w")), "w", "left_anti").select("u", "w")).distinct(), "cycle-edges")
    return e


def _least_reach(e: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node that reaches each node along a -> b, itself included; jumps double each round."""
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    label = store(nodes.withColumn("label", F.col("node")), "reach")
    for _ in range(10_000):
        # a node takes the least label of its predecessors, and the label that its label's node has
        step = e.select(F.col(a).alias("node"), F.col(b).alias("to")).join(by_shuffle(label), "node").select(F.col("to").alias("node"), "label")
        jump = label.select("node", F.col("label").alias("l")).join(by_shuffle(label.select(F.col("node").alias("l"), "label")), "l").select("node", "label")
        new = store(label.union(step).union(jump).groupBy("node").agg(F.min("label").alias("label")), "reach")
        if new.join(by_shuffle(label.withColumnRenamed("label", "was")), "node").filter("label <> was").isEmpty():
            return new
        label = new
    raise RuntimeError("reach: not settled")


def cycle_loops(components: DataFrame, edges: DataFrame, most: int = 12, longest: int = 200) -> DataFrame:
    """(component, loop): of the largest components the shortest way from the least member back to itself, least in order."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    taken = sizes.orderBy(F.desc("n"), "component").limit(most)
    members = components.join(taken.select("component"), "component", "left_semi")
    inner = edges.toDF("a", "b").distinct().join(by_shuffle(members.select(F.col("node").alias("a"), "component")), "a").join(by_shuffle(members.select(F.col("node").alias("b"), F.col("component").alias("cb"))), "b").filter("component = cb and a <> b").select("component", "a", "b")
    inner = store(inner, "loop-edges")
    paths = store(taken.select("component", F.array("component").alias("path"), F.col("component").alias("at")), "loop-paths")
    seen, done = paths.select("component", "at"), None
    for _ in range(longest):
        new = paths.join(by_shuffle(inner.withColumnRenamed("a", "at")), ["component", "at"]).groupBy("component", "b").agg(F.min("path").alias("path")).select("component", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"))
        new = store(new, "loop-new")
        ended = new.filter("at = component").select("component", F.col("path").alias("loop"))
        done = ended if done is None else store(done.union(ended.join(done.select("component"), "component", "left_anti")), "loops")
        paths = store(new.filter("at <> component").join(by_shuffle(seen), ["component", "at"], "left_anti").join(done.select("component"), "component", "left_anti"), "loop-paths")
        if paths.isEmpty():
            return done
        seen = store(seen.union(paths.select("component", "at")), "loop-seen")
    raise RuntimeError(f"cycle_loops: longer than {longest}")


def _top(df: DataFrame, *order, n: int = TOP, by: str = "snapshot_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def most_called(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions, methods and classes of source files by resolved calls from source files."""
    s = symbols.filter(F.col("kind").isin("function", "method", "class") & (classify_role(F.col("path")) == "source"))
    c = calls.filter("resolved").filter(classify_role(F.col("path")) == "source").groupBy(F.col("to_symbol_id").alias("symbol_id")).agg(F.count("*").alias("calls"))
    return _top(s.join(c, "symbol_id").select("snapshot_id", "symbol_id", "name", "calls"), F.desc("calls"), F.col("name"), F.col("symbol_id"))


def longest_functions(symbols: DataFrame) -> DataFrame:
    s = symbols.filter(F.col("kind").isin("function", "method") & (classify_role(F.col("path")) == "source"))
    return _top(s.select("snapshot_id", "symbol_id", (F.col("end_line") - F.col("start_line") + 1).alias("lines")), F.desc("lines"), F.col("symbol_id"))


def largest_files(files: DataFrame) -> DataFrame:
    s = files.filter((F.col("kind") == "CODE") & (classify_role(F.col("path")) == "source"))
    return _top(s.select("snapshot_id", "path", "line_count"), F.desc("line_count"), F.col("path"))


def test_reach(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(snapshot_id, path, tests, examples): source files that test files import directly, with up to five of these."""
    source = files.filter(classify_role(F.col("path")) == "source").select("snapshot_id", "path")
    hit = imports.filter(is_test_file(F.col("from_path"))).select("snapshot_id", F.col("to_path").alias("path"), "from_path").distinct().join(source, ["snapshot_id", "path"], "left_semi")
    ranked = hit.withColumn("_n", F.row_number().over(W.partitionBy("snapshot_id", "path").orderBy("from_path")))
    return ranked.groupBy("snapshot_id", "path").agg(F.count("*").alias("tests"), F.sort_array(F.collect_list(F.when(F.col("_n") <= 5, F.col("from_path")))).alias("examples"))


def untested_hubs(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Source files that no test file imports, by the number of source files that do."""
    tested = test_reach(files, imports).select("snapshot_id", "path")
    by = imports.filter((classify_role(F.col("from_path")) == "source") & (classify_role(F.col("to_path")) == "source") & (F.col("from_path") != F.col("to_path"))).groupBy("snapshot_id", F.col("to_path").alias("path")).agg(F.countDistinct("from_path").alias("importers"))
    return _top(by.join(files.select("snapshot_id", "path"), ["snapshot_id", "path"], "left_semi").join(tested, ["snapshot_id", "path"], "left_anti"), F.desc("importers"), F.col("path"))

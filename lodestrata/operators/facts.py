"""Lexical code facts: symbols, imports, calls and routes from lines and text, without a grammar.

Comments and the contents of literals are blanked first, so that braces inside them do not count. What a grammar would see
differently is listed in the README. The output tables may as well be loaded from any parser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.text import file_name, let
from lodestrata.operators.brackets import argument_text, arguments, bracket_rows
from lodestrata.sources.shared import by_shuffle

NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
KEY = ("snapshot_id", "path")
#: HTTP methods of routes and what they are called; receivers that are clients and not servers; names that
#: are no handlers.
METHODS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "del": "DELETE", "options": "OPTIONS", "head": "HEAD", "all": "ANY"}
CLIENTS = ["axios", "http", "https", "got", "ky", "superagent", "request", "fetch", "$http", "httpClient", "this.http", "this.httpClient"]
NO_HANDLERS = r"(?i)^(config|options|opts|params|headers|body|data|payload)$"
#: Words before a bracket that are no calls.
NO_CALLS = ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "require", "import", "super", "constructor", "async"]
_TYPED = r"(?::[^=]+)?"
_FUNCTION = rf"(?:async\s*\([^)]*$|(?:async\s*)?(?:function\b|\([^)]*\)\s*{_TYPED}=>|[A-Za-z_$][\w$]*\s*=>))"
#: Declarations at any depth: pattern of the name, and the kind. A name that is not there is "default".
DECLARATIONS = [
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}", "function"),
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?!extends\b|implements\b){NAME}", "class"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+{NAME}", "interface"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{NAME}\s*[=<]", "type"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{NAME}", "enum"),
    (rf"^\s*(?:export\s+)?(?:const|let|var)\s+{NAME}\s*{_TYPED}=\s*{_FUNCTION}", "function"),
    (rf"^\s*(?:export\s+)?(?:const|let|var)\s+{NAME}\s*{_TYPED}=\s*class\b", "class"),
    (rf"^\s*export\s+(?:const|let|var)\s+{NAME}", "variable"),
]
UNNAMED = [
    (rf"^\s*export\s+default\s+(?:async\s+)?(?:function\s*\*?\s*\(|\([^)]*\)\s*{_TYPED}=>|[A-Za-z_$][\w$]*\s*=>)", "function"),
    (r"^\s*export\s+default\s+(?:abstract\s+)?class\s*(?:\{|extends\b|implements\b)", "class"),
]
#: What every declaration starts with.
DECLARES = r"^\s*+(?:export|default|async|function|abstract|class|declare|interface|type|const|enum|let|var)\b"
#: Strings, regular expressions (where a value may start) and template literals, whose values may hold templates again, three
#: deep. Quantified groups are possessive: the others cost the JVM a stack frame a turn.
STRING = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\[\s\S][^\'\\\n]*+)*+\''
_WHERE = r"(?:[(,=:\[!&|?{;+*%~^\n-]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|await|yield|do|else))[ \t]{0,20}"
_CLASS = r"\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\]"
REGEX = rf"/(?<={_WHERE}/|\A\s{{0,20}}/)(?![*/])[^/\\\[\n]*+(?:(?:\\[^\n]|{_CLASS})[^/\\\[\n]*+)*+/[a-z]*+"
_FLAT = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"


def _value(inner: str) -> str:
    """A pattern of a template's value: code with paired braces, strings and templates."""
    code = rf"[^`\"'{{}}]++|{STRING}|{inner}|[\"']"
    return rf"\$\{{(?:{code}|\{{(?:{code}|\{{(?:{code}|\{{[^`{{}}]*+\}})*+\}})*+\}})*+\}}"


def _template(deep: int) -> str:
    return _FLAT if deep == 0 else rf"(?:`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|{_value(_template(deep - 1))})*+`|{_FLAT})"


TEMPLATE = _template(2)
LITERAL = rf"{STRING}|{TEMPLATE}|{REGEX}"
#: What a text falls into: literals, single brackets and commas, and the runs between them.
PIECE = rf"{LITERAL}|[(){{}}\[\],]|[^(){{}}\[\],\"'`/]++|[\s\S]"


#: A run of text without comments, and a comment: a piece of a block comment is followed by the line break it ends at, at which
#: the next piece starts. Only such a piece, or the start of the text, ends where a line break follows.
_CODE = rf"(?:[^\"'`/]++|{LITERAL}|[\"'`]|/(?![/*]))++"
_IN_COMMENT = r"(?:[^\n*]++|\*(?!/))*+(?:\*/(\n*+))?"
_COMMENT = rf"(?!\A)\G(\n){_IN_COMMENT}|({_CODE})|//[^\n]*+(\n*+)|/\*{_IN_COMMENT}"


def uncommented(text: Column) -> Column:
    """Text with comments gone and literals as they are; line breaks stay."""
    plain = F.translate(text, "\u0001\u0002", "")
    return F.when(plain.contains("//") | plain.contains("/*"), F.regexp_replace(plain, _COMMENT, "$1$2$3$4$5")).otherwise(plain)


def blanked(text: Column) -> Column:
    """Text with comments gone and the contents of literals emptied; the values of templates and line breaks stay."""
    return let(uncommented(text), _emptied)


#: What a literal starts with, looked at before its patterns are.
_QUOTE = r"(?=[\"'`/])"


def _emptied(code: Column) -> Column:
    """Code without comments with the contents of its literals emptied."""
    # each literal is followed by two marks, with the template between them
    marked = F.regexp_replace(code, rf"{_QUOTE}(?:{STRING}|{REGEX}|({TEMPLATE}))", '\u0001$1\u0002""')
    values = lambda p: F.regexp_replace(F.regexp_replace(p, rf"\\[^\n]|({_value(_template(1))})|[^\n$\\]++|[^\n]", "$1"), rf"{STRING}|{REGEX}|`[^`\\\n]*+(?:\\[^\n][^`\\\n]*+)*+`", '""')
    kept = F.array_join(F.transform(F.split(marked, "[\u0001\u0002]"), lambda p, i: F.when((i % 2 == 0) | (p == ""), p).otherwise(values(p))), "")
    return F.when(F.instr(code, "`") > 0, kept).otherwise(F.regexp_replace(code, rf"(?=[\"'/])(?:{STRING}|{REGEX})", '""'))


def _net(bare: Column) -> Column:
    """Brackets of any kind that a line opens less those it closes."""
    return F.length(F.regexp_replace(bare, r"[^{(\[]++", "")) - F.length(F.regexp_replace(bare, r"[^})\]]++", ""))


def code_lines(files: DataFrame) -> DataFrame:
    """(key, line_no, line, bare, net, depth, after, close_0, close_1): bare lines, the brackets each opens less those it closes, the
    depth before and after each, and the next line from each on that closes a block of depth 0 or 1. Files that are dealt out
    by their path stay where they are."""
    at = files.select(*KEY, F.posexplode(F.arrays_zip(F.split("content", "\n").alias("line"), F.split(blanked(F.col("content")), "\n").alias("bare"))).alias("n", "z"))
    at = at.select(*KEY, (F.col("n") + 1).alias("line_no"), "z.line", F.coalesce("z.bare", F.lit("")).alias("bare"))
    at = at.withColumn("net", _net(F.col("bare")))
    file = W.partitionBy(*KEY)
    at = at.withColumn("after", F.sum("net").over(file.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))).withColumn("depth", F.col("after") - F.col("net"))
    closes = F.col("bare").contains("}") & F.col("bare").rlike(r"[};]\s*\)*[;,]?\s*$")
    back = file.orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)
    return at.withColumns({f"close_{d}": F.min(F.when(closes & (F.col("after") <= d), F.col("line_no"))).over(back) for d in (0, 1)})


def parse_health(lines: DataFrame) -> DataFrame:
    """(key, has_errors): whether the brackets of a file do not close."""
    return lines.groupBy(*KEY).agg((F.sum("net") != 0).alias("has_errors"))


def _end(depth: int) -> Column:
    """The line that a declaration at depth ends on: that which closes it if its line leaves a bracket open, else its own."""
    return F.when(F.col("after") > F.col("depth"), F.coalesce(f"close_{depth}", "line_no")).otherwise(F.col("line_no"))


def _first_group(column: str, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(column, p, 1), F.lit("")) for p in patterns))


def extract_symbols(lines: DataFrame) -> DataFrame:
    """(key, kind, name, start_line, end_line, exported, is_default) of top-level declarations; anonymous defaults are named "default"."""
    bare, every = F.col("bare"), DECLARATIONS + UNNAMED
    name = F.coalesce(_first_group("bare", *(p for p, _ in DECLARATIONS)), F.when(reduce(lambda a, b: a | b, (bare.rlike(p) for p, _ in UNNAMED)), "default"))
    kind = reduce(lambda w, d: w.when(bare.rlike(d[0]), d[1]), every[1:], F.when(bare.rlike(every[0][0]), every[0][1]))
    at = lines.filter("depth = 0").filter(bare.rlike(DECLARES)).withColumns({"name": name, "kind": kind}).filter("name is not null and kind is not null")
    return at.select(*KEY, "kind", "name", F.col("line_no").alias("start_line"), _end(0).alias("end_line"), bare.rlike(r"^\s*export\b").alias("exported"), bare.rlike(r"^\s*export\s+default\b").alias("is_default"))


def extract_members(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, kind, name, qualified_name, start_line, end_line, exported) of methods and arrow fields of classes."""
    lead = r"^\s*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*+"
    method = rf"{lead}[*#]?{NAME}\s*(?:<[^>]*>)?\((?:[^;]*\{{\s*(?:\}}|.*)?|[^;)]*)$"
    field = rf"{lead}#?{NAME}\s*{_TYPED}=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*{_TYPED}=>|[A-Za-z_$][\w$]*\s*=>)"
    at = lines.filter("depth = 1").withColumn("name", _first_group("bare", method, field)).filter(F.col("name").isNotNull() & ~F.col("name").isin([n for n in NO_CALLS if n != "constructor"]))
    owner = symbols.filter("kind = 'class'").select(*KEY, F.col("name").alias("owner"), F.col("start_line").alias("_s"), F.col("end_line").alias("_x"), "exported")
    at = at.join(by_shuffle(owner), list(KEY)).filter((F.col("line_no") > F.col("_s")) & (F.col("line_no") <= F.col("_x")))
    return at.select(*KEY, F.lit("method").alias("kind"), "name", F.concat_ws(".", "owner", "name").alias("qualified_name"), F.col("line_no").alias("start_line"), _end(1).alias("end_line"), "exported")


_WHOLE = r"^\s*(?:(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*)?(?:exports\s*=\s*)?(?:module\.exports|exports)\s*=\s*(?:(?:module\.)?exports\s*=\s*)?"


def _cjs_entries(lines: DataFrame) -> DataFrame:
    """(key, line_no, end_line, entry): what stands between the commas of an object that is module.exports, on one line or many."""
    start = lines.filter("depth = 0").filter(F.col("bare").contains("exports")).filter(F.col("bare").rlike(_WHOLE + r"\{"))
    one = start.filter("after = 0").select(*KEY, "line_no", F.col("line_no").alias("end_line"), F.explode(F.split(F.regexp_extract("bare", r"\{(.*)\}[^}]*$", 1), r",(?![^({\[]*[)}\]])")).alias("entry"))
    spans = start.filter("after > 0").select(*KEY, F.col("line_no").alias("_s"), F.coalesce("close_0", "line_no").alias("_x"))
    inner = lines.filter("depth = 1").join(by_shuffle(spans), list(KEY)).filter((F.col("line_no") > F.col("_s")) & (F.col("line_no") < F.col("_x")))
    many = inner.select(*KEY, "line_no", _end(1).alias("end_line"), F.explode(F.split("bare", r",(?![^({\[]*[)}\]])")).alias("entry"))
    return one.union(many).withColumn("entry", F.trim("entry")).filter("entry <> ''")


def extract_cjs(lines: DataFrame) -> DataFrame:
    """(key, kind, container, name, start_line, end_line, exported, is_default) of CommonJS and prototype definitions:
    module.exports = and members of such an object, exports.x =, object.m = function, F.prototype.m =. Those of a module
    object (`var app = module.exports = {}`, or one that module.exports is set to) are exported."""
    at, bare = lines.filter("depth = 0").filter(F.col("bare").contains("=")), F.col("bare")
    out = at.filter(bare.contains("exports"))
    none = F.lit(None).cast("string")
    cols = lambda kind, container, name, exported, default: [*KEY, kind.alias("kind"), container.alias("container"), name.alias("name"), F.col("line_no").alias("start_line"), _end(0).alias("end_line"), F.lit(exported).alias("exported"), F.lit(default).alias("is_default")]
    value = lambda c: F.when(c.rlike(rf"^{_FUNCTION}"), "function").when(c.rlike(r"^class\b"), "class")
    rest = F.regexp_extract("bare", _WHOLE + r"(\S.*)$", 1)
    named = F.coalesce(F.nullif(F.regexp_extract(rest, rf"^(?:async\s+)?(?:function\s*\*?|class)\s+(?!extends\b){NAME}", 1), F.lit("")), F.lit("default"))
    whole = out.filter(bare.rlike(_WHOLE)).filter(value(rest).isNotNull()).select(*cols(value(rest), none, named, True, True))
    member = rf"^\s*(?:module\.)?exports\.{NAME}\s*=\s*(?!=)"
    said = F.regexp_extract("bare", rf"^\s*(?:module\.)?exports\.[A-Za-z_$][\w$]*\s*=\s*(\S.*)$", 1)
    own = out.filter(bare.rlike(member) & ~said.rlike(rf"^{NAME}\s*;?\s*$")).select(*cols(F.coalesce(value(said), F.lit("variable")), none, F.regexp_extract("bare", member, 1), True, False))
    entry = F.col("entry")
    pair = F.regexp_extract(entry, rf"^{NAME}\s*:\s*(\S.*)$", 2)
    of = F.coalesce(F.nullif(F.regexp_extract(entry, rf"^{NAME}\s*:", 1), F.lit("")), F.nullif(F.regexp_extract(entry, rf"^(?:async\s+)?\*?{NAME}\s*\(", 1), F.lit("")))
    kind = F.when(entry.rlike(rf"^(?:async\s+)?\*?{NAME}\s*\("), "function").otherwise(F.coalesce(value(pair), F.lit("variable")))
    listed = _cjs_entries(lines).filter(of.isNotNull() & ~pair.rlike(rf"^{NAME}$")).select(*KEY, kind.alias("kind"), none.alias("container"), of.alias("name"), F.col("line_no").alias("start_line"), "end_line", F.lit(True).alias("exported"), F.lit(False).alias("is_default"))
    proto, plain = rf"^\s*{NAME}\.prototype\.{NAME}\s*=\s*{_FUNCTION}", rf"^\s*{NAME}\.{NAME}\s*=\s*{_FUNCTION}"
    held = at.withColumns({"_c": _first_group("bare", proto, plain), "_n": F.coalesce(*(F.nullif(F.regexp_extract("bare", p, 2), F.lit("")) for p in (proto, plain)))})
    held = held.filter(F.col("_c").isNotNull() & ~F.col("_c").isin("module", "exports", "this"))
    objects = out.select(*KEY, _first_group("bare", rf"^\s*(?:const|let|var)\s+{NAME}\s*=\s*(?:exports\s*=\s*)?module\.exports\s*=", rf"^\s*(?:const|let|var)\s+{NAME}\s*=\s*exports\s*=", rf"{_WHOLE}{NAME}\s*;?\s*$").alias("_c"), F.lit(True).alias("_m")).filter("_c is not null").distinct()
    held = held.join(by_shuffle(objects), [*KEY, "_c"], "left").select(*cols(F.lit("method"), F.col("_c"), F.col("_n"), False, False), "_m").withColumn("exported", F.coalesce("_m", F.lit(False))).drop("_m")
    return whole.union(own).union(listed).union(held)


def cjs_exports(lines: DataFrame) -> DataFrame:
    """(key, name, exported_as) of local names that CommonJS exports: module.exports = name (default), exports.x = name, { a, x: b }."""
    at = lines.filter("depth = 0").filter(F.col("bare").contains("exports"))
    default = at.select(*KEY, _first_group("bare", rf"{_WHOLE}{NAME}\s*;?\s*$").alias("name"), F.lit("default").alias("exported_as"))
    pattern = rf"^\s*(?:module\.)?exports\.{NAME}\s*=\s*{NAME}\s*;?\s*$"
    named = at.select(*KEY, F.nullif(F.regexp_extract("bare", pattern, 2), F.lit("")).alias("name"), F.regexp_extract("bare", pattern, 1).alias("exported_as"))
    pair = rf"^{NAME}\s*:\s*{NAME}$"
    listed = _cjs_entries(lines).select(*KEY, _first_group("entry", rf"^{NAME}$").alias("_s"), F.nullif(F.regexp_extract("entry", pair, 2), F.lit("")).alias("_v"), F.regexp_extract("entry", pair, 1).alias("_k"))
    listed = listed.select(*KEY, F.coalesce("_s", "_v").alias("name"), F.when(F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("_k")).alias("exported_as"))
    return default.union(named).union(listed).filter("name is not null")


def mark_exports(symbols: DataFrame, files: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """symbols with exported and exported_as where a later `export { a as b }` or `export default a`, or more (key, name,
    exported_as), names them."""
    lists = lambda t: F.filter(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"export\s*\{([^}]*)\}(?!\s*from)"), F.lit(1)), lambda g: F.split(g, ","))), lambda x: F.trim(x) != "")
    named = lambda x: F.struct(F.regexp_extract(x, NAME, 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract(x, rf"\bas\s+{NAME}", 1), F.lit("")), F.regexp_extract(x, NAME, 1)).alias("_as"))
    default = lambda t: F.transform(F.regexp_extract_all(t, F.lit(rf"export\s+default\s+{NAME}\s*(?:;|\n|\z)"), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit("default").alias("_as")))
    # a text that exports nothing need not be blanked
    code = files.filter(F.col("content").rlike(r"export\s*(?:\{|default\b|/[/*])"))
    every = code.select(*KEY, F.explode(let(blanked(F.col("content")), lambda t: F.concat(F.transform(lists(t), named), default(t)))).alias("x")).select(*KEY, "x.name", "x._as")
    if more is not None:
        every = every.union(more.select(*KEY, "name", "exported_as"))
    every = every.groupBy(*KEY, "name").agg(F.min("_as").alias("_as"))
    at = symbols.join(by_shuffle(every), [*KEY, "name"], "left")
    return at.withColumn("exported", F.col("exported") | F.col("_as").isNotNull()).withColumn("exported_as", F.coalesce("_as", F.when(F.col("is_default"), "default"), F.when(F.col("exported"), F.col("name")))).drop("_as")


def match_lines(text: Column, pattern: str, *holds: str) -> Column:
    """array<struct<m, line>>: the matches of a pattern in a text, in order, each with the line it starts on. holds: every match
    has one of these in it; texts without are passed over."""
    # line breaks before a match: those of all pieces up to it and of all matches before it
    placed = lambda x: let(
        F.transform(F.arrays_zip(x["p"].alias("p"), x["m"].alias("m")), lambda z: F.struct(_breaks(z["p"]).alias("p"), (_breaks(z["p"]) + F.coalesce(_breaks(z["m"]), F.lit(0))).alias("both"))),
        lambda n: F.transform(x["m"], lambda m, i: F.struct(m.alias("m"), (F.get(n, i)["p"] + 1 + F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda s, y: s + y["both"])).alias("line"))),
    )
    # a text without matches is not split
    pieces = lambda t, m: F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(t, pattern).alias("p")), placed))
    every = lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: pieces(t, m))
    return let(text, lambda t: F.when(reduce(lambda a, b: a | b, (t.contains(x) for x in holds)), every(t)) if holds else every(t))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _bindings(clause: Column) -> Column:
    """array<struct<imported, local>> of an import clause; names as they are, * for a namespace, default for a bare name."""
    inner = F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ",")
    named = F.transform(F.filter(F.transform(inner, lambda x: F.trim(F.regexp_replace(x, r"\s*type\s+", ""))), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, NAME, 1).alias("imported"), F.coalesce(F.nullif(F.regexp_extract(x, rf"(?:\bas\s+|:\s*){NAME}", 1), F.lit("")), F.regexp_extract(x, NAME, 1)).alias("local")))
    space = F.regexp_extract(clause, rf"\*\s*as\s+{NAME}", 1)
    bare = F.regexp_extract(clause, rf"^\s*{NAME}\s*(?:,|$)", 1)
    one = lambda name, value: F.filter(F.array(F.struct(F.lit(name).alias("imported"), value.alias("local"))), lambda s: s["local"] != "")
    return F.concat(one("default", bare), one("*", space), named)


def _statements(files: DataFrame, pattern: str, clause: int, specifier: int, kind: str, *holds: str) -> DataFrame:
    """One row per match of pattern in the text without comments, with its bindings, specifier and line."""
    at = files.select(*KEY, F.explode(match_lines(uncommented(F.col("content")), pattern, *holds)).alias("x")).select(*KEY, "x.m", "x.line")
    at = at.withColumns({"specifier": F.regexp_extract("m", pattern, specifier), "clause": F.regexp_extract("m", pattern, clause) if clause else F.lit("")})
    return at.select(*KEY, F.lit(kind).alias("kind"), "specifier", _bindings(F.col("clause")).alias("bindings"), "line")


def extract_imports(files: DataFrame) -> DataFrame:
    """(key, kind, specifier, bindings, line) of import statements; side-effect imports bind nothing."""
    bound = _statements(files, r"import\s+(?:type\s+)?([^'\"();]+?)\s+from\s*['\"]([^'\"\n]+)['\"]", 1, 2, "import", "import")
    return bound.union(_statements(files, r"import\s*['\"]([^'\"\n]+)['\"]", 0, 1, "import", "import"))


def extract_reexports(files: DataFrame) -> DataFrame:
    """The same of `export ... from`: named ones, * as a name, and * as "*"."""
    pattern = r"export\s+(?:type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['\"]([^'\"\n]+)['\"]"
    got = _statements(files, pattern, 1, 2, "reexport", "export")
    every = F.array(F.struct(F.lit("*").alias("imported"), F.lit("*").alias("local")))
    return got.withColumn("bindings", F.when(F.size("bindings") == 0, every).otherwise(F.col("bindings")))


def extract_requires(files: DataFrame) -> DataFrame:
    """The same of require() and import() with one static string; a name binds the whole module ("*"), destructured names theirs."""
    pattern = r"(?:(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*(?:await\s+)?)?\b(?:require|import)\(\s*['\"]([^'\"\n]+)['\"]\s*\)"
    got = _statements(files, pattern, 1, 2, "require", "require(", "import(")
    return got.withColumn("bindings", F.transform("bindings", lambda b: F.struct(F.when(b["imported"] == "default", "*").otherwise(b["imported"]).alias("imported"), b["local"].alias("local"))))


def extract_calls(lines: DataFrame) -> DataFrame:
    """(key, line, position, receiver, callee_name, callee_text, is_new) of calls; keywords, require, import and super are none."""
    pattern = r"(?<![\w$.])(\.?(?:new\s+)?(?:[A-Za-z_$][\w$]*+\s*+\??\.\s*+)*+[A-Za-z_$][\w$]*+)\s*(?:<[^<>()]*>)?\("
    code = F.regexp_replace("bare", rf"\bfunction\s*\*?\s*{NAME}\s*\(", "function (")
    defines = rf"^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*+\*?{NAME}\s*\([^;]*\)\s*(?::[^{{]+)?\{{"
    declares = rf"^\s*(?:(?:(?:public|private|protected|static|readonly|declare)\s+)*+{NAME}\??\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*:[^?{{}}]+;|(?:(?:public|protected)\s+)?abstract\s[^;{{]*\([^;{{]*;)\s*$"
    at = lines.filter(F.col("bare").contains("(")).select(*KEY, F.col("line_no").alias("line"), ((F.col("bare").rlike(defines) & ~F.regexp_extract("bare", defines, 1).isin(NO_CALLS[:6])) | ((F.col("depth") > 0) & F.col("bare").rlike(declares))).alias("defines"), F.posexplode(F.regexp_extract_all(code, F.lit(pattern), F.lit(1))).alias("position", "m"))
    # what a call's result is asked for has that call as its receiver
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("m", r"^new\s+", ""), r"[\s?]", ""), r"^\.", "().")
    name = F.substring_index(plain, ".", -1)
    receiver = F.when(F.instr(plain, ".") > 0, F.substring(F.regexp_extract(plain, r"^(.*)\.[^.]*$", 1), 1, 80))
    # a member's definition, or its declaration without a body, looks like a call of its name
    at = at.filter(~((F.col("position") == 0) & F.col("defines")))
    out = at.select(*KEY, "line", "position", receiver.alias("receiver"), name.alias("callee_name"), F.substring(plain, 1, 120).alias("callee_text"), F.col("m").rlike(r"^new\s").alias("is_new"))
    return out.filter(~(F.col("callee_name").isin(NO_CALLS) & F.col("receiver").isNull()))


def enclosing_symbol(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with from_symbol_id: the tightest symbol around the line, ties by id; null at module scope."""
    s = symbols.select(*KEY, F.col("symbol_id").alias("_id"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    hit = calls.join(by_shuffle(s), list(KEY)).filter(F.col("line").between(F.col("_s"), F.col("_e"))).groupBy(*KEY, "line").agg(F.min_by("_id", F.struct(F.col("_e") - F.col("_s"), F.col("_id"))).alias("from_symbol_id"))
    return calls.join(by_shuffle(hit), [*KEY, "line"], "left")


#: Lines of parameters that a signature is read over, at most; parentheses in pairs, four deep.
HEADER = 60
_PAIRED = reduce(lambda inner, _: rf"\((?:[^()]++|{inner})*+\)", range(3), r"\([^()]*+\)")


def signatures(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """symbols with signature (up to the body, white space collapsed, 300 characters) and the adjacent doc comment (1,000)."""
    w = W.partitionBy(*KEY).orderBy("line_no")
    opened = F.last(F.when(F.col("line").rlike(r"^\s*/\*\*"), F.col("line_no")), ignorenulls=True).over(w)
    ends = lines.withColumn("_from", opened).filter(F.col("line").rlike(r"\*/\s*$")).select(*KEY, (F.col("line_no") + 1).alias("start_line"), "_from", F.col("line_no").alias("_to"))
    text = lines.select(*KEY, "line_no", F.regexp_replace("line", r"^\s*/?\*+/?\s?|\s*\*/\s*$", "").alias("x"))
    docs = ends.join(text, list(KEY)).filter(F.col("line_no").between(F.col("_from"), F.col("_to"))).groupBy(*KEY, "start_line").agg(F.array_sort(F.collect_list(F.struct("line_no", "x"))).alias("d"))
    doc = F.substring(F.trim(F.array_join(F.transform("d", lambda x: x["x"]), "\n")), 1, 1000)
    # a declaration whose parameters go on is read up to HEADER lines further
    open_here = lambda c: F.length(F.regexp_replace(c, r"[^(]", "")) > F.length(F.regexp_replace(c, r"[^)]", ""))
    starts = lines.join(symbols.select(*KEY, F.col("start_line").alias("line_no")).distinct(), [*KEY, "line_no"], "left_semi")
    wanted = starts.select(*KEY, F.col("line_no").alias("start_line"), F.explode(F.sequence(F.col("line_no"), F.col("line_no") + F.when(open_here("bare"), HEADER).otherwise(0))).alias("line_no"))
    rows = wanted.join(lines.select(*KEY, "line_no", "line"), [*KEY, "line_no"]).groupBy(*KEY, "start_line").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("r"))
    header = F.regexp_extract(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), rf"^((?:{_PAIRED}|[^({{=]|=(?!>)|\()*+)", 1)
    first = rows.select(*KEY, "start_line", F.substring(F.trim(F.regexp_replace(header, r"\s+", " ")), 1, 300).alias("signature"))
    return symbols.join(first, [*KEY, "start_line"], "left").join(docs.select(*KEY, "start_line", doc.alias("doc_comment")), [*KEY, "start_line"], "left")


def extract_routes(files: DataFrame) -> DataFrame:
    """(key, method, url_path, handler, line) of calls like app.get('/x', handler) and .route('/x').get(handler).post(other).

    The last argument must be a function (its handler is null), a name, a member or a call; a call stands for its own last
    argument. Arguments come from bracket pairs, so they may go over lines and nest at will. line is where the call starts,
    that of a chain where the chain starts.
    """
    methods = "|".join(METHODS)
    member = r"([A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*+)"
    asked = rf"\.\s*({methods})\s*(?:<[^<>()]*>\s*)?$"
    named = rf"(?<![\w$.])((?:[A-Za-z_$][\w$]*\s*\??\.\s*)*?[A-Za-z_$][\w$]*)\s*\??{asked}"
    routed = r"\.\s*route\s*$"
    code = files.filter(F.col("content").rlike(rf"\.\s*(?:{methods})\s*(?:<[^<>()]*>\s*)?\(")).select(*KEY, uncommented(F.col("content")).alias("code"))
    rows = arguments(bracket_rows(code, F.regexp_extract_all("code", F.lit(PIECE), F.lit(0)))).filter(F.col("piece").isin("(", ","))
    # a call of a call's result continues its chain; a chain's calls follow one another on their level
    level = W.partitionBy(*KEY, "level").orderBy("at")
    opens = F.col("piece") == "("
    goes_on = opens & F.col("after_close") & F.col("head").rlike(r"^\s*\??\.\s*[A-Za-z_$][\w$]*\s*$")
    rows = rows.withColumn("chain", F.sum(F.when(opens & ~goes_on, 1).otherwise(0)).over(level.rowsBetween(W.unboundedPreceding, 0)))
    chain = W.partitionBy(*KEY, "level", "chain").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    lead = F.regexp_extract("head", rf"^([\s\S]*?){member}[^A-Za-z_$]*$", 1)
    rows = rows.withColumns({"start": F.first(F.col("head_line") + _breaks(lead)).over(chain), "root": F.last(F.when(opens & F.col("head").rlike(routed), F.col("opened")), ignorenulls=True).over(chain)})
    receiver = F.regexp_replace(F.regexp_extract("head", named, 1), r"[\s?]", "")
    calls = rows.filter(opens & F.col("head").rlike(asked) & (goes_on | F.col("head").rlike(named)) & ~receiver.isin(CLIENTS))
    calls = calls.select(*KEY, "opened", "end", "root", F.col("start").alias("line"), F.regexp_extract("head", asked, 1).alias("method"))
    told = rows.filter("last is not null").join(by_shuffle(code), list(KEY)).select(*KEY, "opened", "end", F.col("at"), argument_text(F.col("code")).alias("text")).filter("text <> ''")
    each = told.groupBy(*KEY, "opened").agg(F.first("end").alias("end"), F.min_by("text", "at").alias("one"), F.max_by("text", "at").alias("handler"), F.max_by("at", "at").alias("handler_at"), F.count("*").alias("n"))
    static = F.regexp_extract("one", r"^(?:'([^'\n]*)'|\"([^\"\n]*)\"|`([^`$]*)`)$", 0)
    paths = each.select(*KEY, F.col("opened").alias("root"), F.substring(static, F.lit(2), F.length(static) - 2).alias("url_path")).filter(F.col("url_path").rlike(r"^(?:/|\*$)"))
    at = calls.join(by_shuffle(each.drop("end")), [*KEY, "opened"]).filter("root is not null or n > 1").withColumn("root", F.coalesce("root", "opened")).join(by_shuffle(paths), [*KEY, "root"])
    inner = told.groupBy(*KEY, "end").agg(F.max_by("text", "at").alias("inner")).withColumnRenamed("end", "handler_end")
    # a call that is the handler ends where the argument ends
    ends = rows.select(*KEY, F.col("at").alias("handler_at"), "last").join(by_shuffle(code), list(KEY)).select(*KEY, "handler_at", (F.col("last") - 1 - F.length(F.regexp_extract(F.substring(F.col("code"), F.col("handler_at") + 2, F.col("last") - F.col("handler_at") - 1), r"(\s*)$", 1))).alias("handler_end"))
    at = at.join(by_shuffle(ends), [*KEY, "handler_at"], "left").join(by_shuffle(inner), [*KEY, "handler_end"], "left")
    inline = F.col("handler").rlike(r"^(?:async\b\s*)?(?:function\b|[A-Za-z_$][\w$]*\s*=>|(?:<[^>]*>\s*)?\([\s\S]*=>)")
    name = F.col("handler").rlike(rf"^{member}$") & ~F.col("handler").rlike(NO_HANDLERS) & ~F.col("handler").rlike("^(?:null|undefined|true|false|this)$")
    call = ~inline & F.col("handler").rlike(r"^(?!new\b|await\b)[A-Za-z_$][\s\S]*\)$")
    shown = F.substring(F.regexp_replace(F.when(call, F.coalesce("inner", "handler")).otherwise(F.col("handler")), r"\s+", ""), 1, 120)
    verb = F.create_map(*(F.lit(x) for m in METHODS.items() for x in m))
    return at.filter(inline | name | call).select(*KEY, verb[F.col("method")].alias("method"), "url_path", F.when(~inline, shown).alias("handler"), F.col("line").cast("int").alias("line"))


def convention_routes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, method, url_path, name) of app/**/route.* (one per exported method function) and pages/api/** (default export)."""
    app = F.regexp_extract("path", r"(?:^|/)app/(.*/)?route\.[cm]?[jt]sx?$", 1)
    page = F.regexp_extract("path", r"(?:^|/)pages/(api/.*)\.[cm]?[jt]sx?$", 1)
    clean = lambda p: F.concat(F.lit("/"), F.array_join(F.filter(F.split(p, "/"), lambda s: ~s.rlike(r"^(\(.*\)|@.*|index)?$")), "/"))
    s = symbols.filter("exported").select(*KEY, "name", "is_default")
    at = files.select(*KEY).join(s, list(KEY))
    a = at.filter(F.col("path").rlike(r"(?:^|/)app/(.*/)?route\.[cm]?[jt]sx?$") & F.col("name").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")).select(*KEY, F.col("name").alias("method"), clean(app).alias("url_path"), "name")
    b = at.filter((page != "") & F.col("is_default")).select(*KEY, F.lit("ANY").alias("method"), clean(page).alias("url_path"), "name")
    return a.union(b).withColumn("file", file_name(F.col("path"))).drop("file")

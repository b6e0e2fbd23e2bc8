"""Column expressions on identifiers, paths, queries and citations. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query's terms leave out.
STOP_WORDS = (
    "a an and are as at be but by can do does for from get how i if in into is it its me my of on or should so that the "
    "their them then there these this to use used uses using was we what when where which who why will with work works "
    "you your code function functions project repo repository happen happens"
).split(" ")
#: Terms of a query, at most.
MAX_TERMS = 24
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"

#: Directories that tell a file's role, and names that do.
TEST_DIRS = "test tests __tests__ __mocks__ __fixtures__ fixtures e2e spec specs cypress playwright".split()
EXAMPLE_DIRS = "example examples sandbox demo demos samples".split()
TOOLING_DIRS = "scripts benchmark benchmarks .github .husky .vitepress".split()
TEST_FILE = r"(?i)\.(test|spec|e2e)\.[cm]?[jt]sx?$"
TOOLING_FILE = r"(?i)^[\w.-]+\.(config|conf)\.[cm]?[jt]s$|^(gulpfile|gruntfile|jakefile)\.[cm]?[jt]s$|^\.[\w-]+rc\.[cm]?[jt]s$"
TEST_HELPER = r"(?i)mock|fixture|helper|setup|support|stub|fake"
SUPPORTING_DIRS = r"(?i)(^|/)(tests?|__tests__|spec|e2e|fixtures?|__mocks__|examples?|samples?|benchmarks?)/"
CONVENTION_ROUTE = r"(^|/)(app/.*/route|pages/api/.*)\.[cm]?[jt]sx?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    return F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)


def split_identifier(name: Column) -> Column:
    """camelCase, acronym, _ $ - and space boundaries; parts of more than one character, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(spaced, r"[\s_$-]+"), lambda p: F.length(p) > 1), lambda p: F.lower(p))


def search_text(path: Column, label: Column, content: Column) -> Column:
    """Path, label, content, then the different parts of their identifiers of several parts, each on a line."""
    parts = lambda s: F.flatten(F.filter(F.transform(F.regexp_extract_all(s, F.lit(f"({IDENTIFIER})"), F.lit(1)), split_identifier), lambda p: F.size(p) > 1))
    label = F.coalesce(label, F.lit(""))
    words = F.array_distinct(F.concat(parts(path), parts(label), parts(content)))
    return F.concat_ws("\n", path, label, content, F.array_join(words, " "))


def query_terms(text: Column) -> Column:
    """Different lower-cased words, numbers and identifier parts without stop words, in order, MAX_TERMS at most."""
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^a-z0-9_]", "")
    of = lambda w: F.concat(F.filter(F.array(plain(w)), lambda t: (F.length(t) > 1) & ~F.array_contains(strings(STOP_WORDS), t)), F.transform(F.filter(split_identifier(w), lambda t: ~F.array_contains(strings(STOP_WORDS), t)), lambda t: F.regexp_replace(t, r"[^a-z0-9_]", "")))
    words = F.regexp_extract_all(text, F.lit(rf"({IDENTIFIER}|[0-9]+)"), F.lit(1))
    return F.slice(F.filter(F.array_distinct(F.flatten(F.transform(words, of))), lambda t: t != ""), 1, MAX_TERMS)


def query_identifiers(text: Column) -> Column:
    """Different lower-cased identifiers of more than two characters that are no stop words."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(strings(STOP_WORDS), w)))


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of identifier characters, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_$]+)"), F.lit(1)), lambda t: F.lower(t))


def is_boring(line: Column) -> Column:
    """Blank lines, comments, imports, re-exports, lone closers and directives."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (t == "") | t.rlike(r"^(//|/\*|\*|\*/)") | t.rlike(r"^import\b") | t.rlike(r"^export\s+(\*|\{[^}]*\})\s+from\b") | t.rlike(r"^[})\];,]*$") | t.rlike(r"^(['\"]use (strict|client|server)['\"];?)$")


def package_name(specifier: Column) -> Column:
    """node: names as they are, the first two parts of scoped names, else the first part."""
    return F.when(specifier.startswith("node:"), specifier).when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def classify_role(path: Column) -> Column:
    """test, example, tooling or source, by directory and file name."""
    dirs, name = directories(path), file_name(path)
    return (
        F.when(name.rlike(TEST_FILE) | F.arrays_overlap(dirs, strings(TEST_DIRS)), "test")
        .when(F.arrays_overlap(dirs, strings(EXAMPLE_DIRS)), "example")
        .when(F.arrays_overlap(dirs, strings(TOOLING_DIRS)) | name.rlike(TOOLING_FILE), "tooling")
        .otherwise("source")
    )


def is_test_file(path: Column) -> Column:
    return (classify_role(path) == "test") & ~file_name(path).rlike(TEST_HELPER)


def is_supporting(path: Column) -> Column:
    return ~path.rlike(CONVENTION_ROUTE) & (path.rlike(SUPPORTING_DIRS) | path.rlike(r"(?i)\.(test|spec)\.[cm]?[jt]sx?$"))


def snippet(content: Column, lines: int = 4, most: int = 300) -> Column:
    """First non-blank lines without trailing blanks and common indent, cut with an ellipsis."""
    kept = F.slice(F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != ""), 1, lines)
    indent = lambda a: F.coalesce(F.array_min(F.transform(a, lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", "")))), F.lit(0))
    joined = let(kept, lambda a: let(indent(a), lambda n: F.array_join(F.transform(a, lambda x: F.substring(x, n + 1, F.length(x))), "\n")))
    return let(joined, lambda s: F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s))


def parse_repo_ref(value: Column, host: str = "github.com") -> Column:
    """struct(owner, repo, ref) of a URL or owner/repo; null on another host, with a port or user, or of another shape."""
    v = F.trim(value)
    v = F.when(v.rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit(f"https://{host}/"), v)).when(v.rlike(r"(?i)^[a-z]+://"), v).otherwise(F.concat(F.lit("https://"), v))
    path = F.regexp_extract(v, rf"(?i)^https?://(?:www\.)?{host.replace('.', '[.]')}/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")

    def of(p: Column) -> Column:
        owner, repo, kind = F.get(p, F.lit(0)), F.regexp_replace(F.get(p, F.lit(1)), r"\.git$", ""), F.get(p, F.lit(2))
        rest = F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0)))
        good = owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$") & repo.rlike(r"^[A-Za-z0-9._-]{1,100}$") & ~repo.isin(".", "..")
        ref = F.when(kind.isin("tree", "commit") & (F.size(rest) > 0), F.try_url_decode(F.array_join(rest, "/")))
        return F.when(good & (kind.isNull() | ref.isNotNull()), F.struct(owner.alias("owner"), repo.alias("repo"), ref.alias("ref")))

    return let(parts, of)


def clean_jsonc(text: Column) -> Column:
    """JSON without comments and trailing commas (outside strings), or null if it does not parse."""
    string = r'("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+")'  # possessive, as any other form costs the JVM a stack frame a character
    bare = F.regexp_replace(text, string + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    bare = F.regexp_replace(bare, string + r"|,(?=\s*[}\]])", "$1")
    return F.when(F.try_parse_json(bare).isNotNull(), bare)


def markers(text: Column) -> Column:
    """Numbers of citation groups like [3] or [1, 2], in order, repeats included."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*+)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).try_cast("long"))))


def check_citations(text: Column, sources: Column) -> Column:
    """struct(valid, invalid, cleaned, flagged): markers within 1..sources, those outside, and the text without these."""
    good = lambda n: n.isNotNull() & (n >= 1) & (n <= sources)

    def of(found: Column) -> Column:
        valid, invalid = F.array_distinct(F.filter(found, good)), F.array_distinct(F.filter(found, lambda n: ~good(n)))
        # pieces alternate: what precedes a group, then the group's numbers
        pieces = F.split(F.regexp_replace(text, r"\[([0-9]+(?:\s*,\s*[0-9]+)*+)\]", "\u0001$1\u0002"), "\u0001")

        def piece(p: Column, i: Column) -> Column:
            kept = F.filter(F.transform(F.split(F.substring_index(p, "\u0002", 1), ","), lambda n: F.trim(n).try_cast("long")), good)
            group = F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(F.transform(kept, lambda n: n.cast("string")), ", "), F.lit("]"))).otherwise("")
            return F.when(i == 0, p).otherwise(F.concat(group, F.substring_index(p, "\u0002", -1)))

        cleaned = F.array_join(F.transform(pieces, piece), "")
        mended = F.regexp_replace(F.regexp_replace(cleaned, r"[ \t]+([.,;:!?])", "$1"), r"[ \t]{2,}", " ")
        return F.struct(valid.alias("valid"), invalid.alias("invalid"), F.when(F.size(invalid) > 0, mended).otherwise(cleaned).alias("cleaned"), (F.size(invalid) > 0).alias("flagged"))

    return let(markers(text), of)

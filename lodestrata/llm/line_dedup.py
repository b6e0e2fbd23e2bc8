"""Boilerplate lines by site-relative frequency: a line that a large share of a host's pages hold is dropped.

The ratio is the pages that hold the line, over all pages of the host; it means the same for a host of a hundred pages
and for one of a million. A line on fewer than PAGES pages is never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import free, look_up, small, store

#: Share of a host's pages beyond which a line is boilerplate, and pages that hold it, at least.
RATIO, PAGES = 0.1, 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed(line: Column) -> Column:
    """Lines count as equal without the spaces and tabs around them."""
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """(host, lines array<long>): hashes of the lines that more than ratio of the host's pages, and at least least, hold.

    The pages of a host that hold a line are counted once each, whatever their repeats. Blank lines never count. A host
    of many pages has fewer than (mean lines per page) / ratio such lines, so the arrays are bounded.
    Each page's lines are made distinct in its row, so counting needs one shuffle of partial counts.
    """
    lines = F.array_distinct(F.transform(F.filter(F.transform(lines_of(F.col(text)), trimmed), lambda x: x != ""), lambda x: F.xxhash64(x)))
    totals = store(pages.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= least), "hosts")
    counts = pages.select(F.col(host).alias("host"), F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    over = counts.join(small(totals), F.col("host").eqNullSafe(F.col("h"))).filter((F.col("n") >= least) & (F.col("n") / F.col("pages") > ratio))
    return store(over.groupBy("host").agg(F.collect_list("line").alias("lines")), "boilerplate")


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """pages with boilerplate lines gone from text, plus n_lines and n_dropped (long) instead of any columns of these names.

    Null texts stay null (0 lines); a null host is a host like any other; hosts of fewer than least pages lose nothing;
    lines equal but for surrounding blanks are one line; lines at exactly the ratio stay; an empty table stays empty.
    Line order and the kept lines themselves do not change.
    """
    _host, _lines, _kept = (free(pages, c) for c in ("_host", "_lines", "_kept"))
    drop = boilerplate(pages, host, text, ratio, least).select(F.col("host").alias(_host), F.col("lines").alias(_lines))
    at = look_up(pages.drop("n_lines", "n_dropped"), F.col(host), drop, _host)
    kept = F.filter(lines_of(F.col(text)), lambda x: (trimmed(x) == "") | ~F.array_contains(_lines, F.xxhash64(trimmed(x))))
    at = at.withColumn(_kept, F.when(F.col(_lines).isNull(), lines_of(F.col(text))).otherwise(kept))
    n = F.coalesce(F.size(lines_of(F.col(text))), F.lit(0))
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(n).cast("long")
    left = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_kept))
    return at.withColumns({"n_lines": n, "n_dropped": n - left}).withColumn(text, F.when(F.col(_lines).isNull(), F.col(text)).otherwise(F.array_join(_kept, "\n"))).drop(_host, _lines, _kept)

"""Site-relative line deduplication.

A line is boilerplate of its host where the pages of the host that contain it are at least MIN_PAGES and, over all pages of
the host, exceed RATIO. Such lines are dropped from every page of that host. Blank lines are never counted nor dropped.
MIN_PAGES is 2: a line that one page has does not repeat over the site, or a host of a few pages would lose its texts. With
keep_whole a page that consists of nothing but boilerplate (a copied page, not a page of furniture) is left as it is.

Lines meet as two 64-bit hashes; each is counted once for a page, before the shuffle where a task has seen it already. The
boilerplate lines, one array for each host, are sent to every task only if all of them together are under BROADCAST_LINES.
Beyond that the lines of the pages meet them in a join by host and line, and what is found goes back to the pages by the
page's own key, so no task gets a host's pages together. Either way a page looks its lines up by hash.

Null text stays null with no lines; a null host is a host of its own; rows with one id are pages each; all columns of the
pages keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruletide.llm.places import placed, whole
from ruletide.session import ensure_checkpoint_dir

#: On the sf0.1 documents ordinary lines stand on 4.8 % of a source's pages at most, the furniture line on 8.6 % or more.
RATIO = 0.065
MIN_PAGES = 2
BROADCAST_LINES = 200_000  # of 24 bytes: 5 MB


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _mark(line: Column) -> Column:
    """128 bits of a line as two longs."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(7), line).alias("y"))


def _marks(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(_lines(text), _solid), _mark))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, x, y, pages, total): every boilerplate line of every host."""
    host = F.col(host_col).alias("host")
    totals = pages.groupBy(host).agg(F.count("*").alias("total")).withColumnRenamed("host", "of")
    seen = pages.select(host, F.explode(_marks(F.col(text_col))).alias("m")).groupBy("host", F.col("m.x").alias("x"), F.col("m.y").alias("y")).agg(F.count("*").alias("pages"))
    often = seen.where(F.col("pages") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("of")))
    return often.where(F.col("pages") > F.col("total") * F.lit(ratio)).select("host", "x", "y", "pages", "total")


def _marked(rows: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """rows with marks: the boilerplate lines of the row's host, or (of many) those that the row has; null for none."""
    held = F.collect_list(F.struct("x", "y")).alias("marks")
    if few:
        by_host = found.groupBy(F.col("host").alias("of")).agg(held)
        return rows.join(F.broadcast(by_host), rows["host"].eqNullSafe(by_host["of"]), "left")
    known = found.select(F.col("host").alias("of"), "x", "y")
    lines = rows.select("place", "host", F.explode(_marks(F.col("text"))).alias("m"))
    hits = lines.join(known, F.col("host").eqNullSafe(F.col("of")) & (F.col("m.x") == F.col("x")) & (F.col("m.y") == F.col("y")), "left_semi")
    return rows.join(hits.select("place", "m.x", "m.y").groupBy("place").agg(held), "place", "left")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False, counts: tuple[str, str] | None = None, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """pages with the text replaced. counts: names of two columns to add, the lines with a word and those of them dropped; they
    replace columns of these names."""
    ensure_checkpoint_dir(pages.sparkSession)
    found = boilerplate(pages, host_col, text_col, ratio, min_pages).checkpoint()
    few = found.count() <= broadcast_lines
    docs, *place = (pages,) if few else placed(pages)
    rows = docs.select(whole(pages).alias("row"), F.col(host_col).alias("host"), F.col(text_col).alias("text"), *([F.struct(F.xxhash64(place[0]).alias("part"), place[1].alias("at")).alias("place")] if place else []))
    lines, marks = _lines(F.col("text")), F.col("marks")
    xs = lambda m: F.transform(m, lambda e: e["x"])
    joined = _marked(rows, found, few)
    hit = F.array_intersect(xs(marks), F.transform(lines, lambda x: F.xxhash64(x)))  # a look-up by hash; the page's own few are then compared in full
    joined = joined.withColumn("own", F.when(marks.isNotNull() & F.col("text").isNotNull() & (F.size(hit) > 0), F.filter(marks, lambda m: F.array_contains(hit, m["x"]))))
    kept = F.filter(lines, lambda x: ~(_solid(x) & F.array_contains(F.col("own"), _mark(x))))
    count = lambda x: F.coalesce(F.size(F.filter(x, _solid)), F.lit(0)).cast("long")
    cut = joined.withColumn("kept", F.when(F.col("own").isNotNull(), kept))
    if keep_whole:
        cut = cut.withColumn("kept", F.when(count(F.col("kept")) > 0, F.col("kept")))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    row = F.col("row").withField(f"`{text_col}`", text).alias("row")
    if counts is None:
        return cut.select(row).select("row.*")
    n = count(lines)
    out = cut.select(row, n.alias("n"), F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(n - count(F.col("kept"))).alias("gone"))
    others = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in counts]
    return out.select(*others, F.col("n").alias(counts[0]), F.col("gone").alias(counts[1]))

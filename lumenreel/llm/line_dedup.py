"""Line dedup by site-relative frequency: lines that more than a share of a host's pages have are dropped from them.

Method, in DataFrame functions only. Each page's distinct lines are exploded as (host, hash of the line) and counted
with a partial count before the shuffle; the count is divided by the host's page total, and a line is boilerplate if it is
on at least `min_pages` pages and on more than `ratio` of all. A host's boilerplate has at most (lines of an average page)
/ ratio members, as each takes up that share of the pages' lines, so it is held as one array for each host and joined
to the pages by host; no join has a row for each line. Lines are compared by a 64-bit hash within one host.

With `copies` off, pages of a host with equal texts count as one, in a line's count and in the host's total. That is for
tables that still hold copies of documents: a page that more than `ratio` of a host's pages repeat would otherwise pass
for boilerplate as a whole and vanish, the last copy too.

Blank lines stay. Nulls: a null text stays null and counts as a page without lines; a null host is a host of its own.
Repeated rows are pages of their own with `copies` on, else copies of a page. A page whose lines all go has an empty text.
Very long texts are taken whole; an empty table gives no rows. Extra columns are kept; one that has the name of an output
(n_lines, n_removed) keeps its values under that name with _input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, own, unwrapped, wrapped

#: The share of a host's pages above which a line is boilerplate, and the fewest pages it must be on: what only two pages
#: share tells nothing about a site.
RATIO, MIN_PAGES = 0.07, 3


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """A line's hash without surrounding blanks; blank: null."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(scratch: Scratch, pages: DataFrame, ratio: float, min_pages: int, copies: bool) -> DataFrame:
    """(site, often) of each host with boilerplate, from pages (host, text).

    What is joined by host is a table of its own: Spark splits a host of very many rows in a join of two exchanges, not
    below an aggregate.
    """
    total = F.count(F.lit(1))
    one = pages.select("host", F.md5(F.encode(F.col("text"), "utf-8")).alias("page"), F.array_distinct(F.transform(lines(F.col("text")), line_hash)).alias("lines"))
    if not copies:
        one = one.dropDuplicates(["host", "page"])
    hosts = scratch.keep(one.groupBy("host").agg(total.alias("pages")), "hosts")
    found = one.select("host", F.explode_outer("lines").alias("line"))
    counts = found.filter("line is not null").groupBy("host", "line").agg(total.alias("n")).filter(F.col("n") >= min_pages)
    counts = counts.withColumnRenamed("host", "site")
    often = counts.join(hosts, F.col("site").eqNullSafe(F.col("host"))).filter(F.col("n") > F.col("pages") * F.lit(ratio))
    return scratch.keep(often.groupBy("site").agg(F.collect_list("line").alias("often")), "often")


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """pages with `text` less its boilerplate lines, and n_lines and n_removed (blank lines don't count)."""
    held = wrapped(pages, (text,), host=own(host), text=own(text).cast("string"))
    often = boilerplate(Scratch(pages.sparkSession), held.select("host", "text"), ratio, min_pages, copies)
    both = held.join(often, F.col("host").eqNullSafe(F.col("site")), "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))
    stays = F.filter(lines(F.col("text")), lambda x: ~F.coalesce(F.array_contains(F.col("often"), line_hash(x)), F.lit(False)))

    def filled(body: Column) -> Column:
        return F.size(F.filter(F.coalesce(lines(body), F.array().cast("array<string>")), lambda x: line_hash(x).isNotNull())).cast("long")

    # most pages have none of their host's lines: look before rebuilding
    hit = F.arrays_overlap(F.transform(lines(F.col("text")), line_hash), F.col("often"))
    kept = F.when(F.coalesce((F.size("often") > 0) & hit, F.lit(False)), F.array_join(stays, "\n")).otherwise(F.col("text"))
    out = both.withColumn("n_lines", filled(F.col("text"))).withColumn("kept", kept)
    out = out.withColumn("n_removed", F.col("n_lines") - filled(F.col("kept")))
    return unwrapped(out, pages.columns, {"n_lines": F.col("n_lines"), "n_removed": F.col("n_removed")}, {text: F.col("kept")})


ORACLE_SQL = r"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
hosts AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (
  SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM pages),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS b FROM lines),
often AS (
  SELECT c.source, c.b FROM (SELECT source, b, count(DISTINCT page) AS n FROM bare WHERE b <> '' GROUP BY source, b) c
  JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n >= 3 AND c.n > h.pages * 0.07::DOUBLE),
marked AS (SELECT bare.*, often.b IS NOT NULL AS gone FROM bare LEFT JOIN often ON bare.source IS NOT DISTINCT FROM often.source AND bare.b = often.b),
kept AS (
  SELECT page, count(*) FILTER (WHERE b <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY page)
SELECT p.doc_id, p.source, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text
FROM pages p LEFT JOIN kept k USING (page)
"""

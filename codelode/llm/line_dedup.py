"""Site-relative line deduplication, in DataFrame operations only.

Documents are grouped by host.  A line's ratio is the number of the host's pages
that contain it over the number of the host's pages; lines whose ratio exceeds
the limit are boilerplate and are dropped from every page of that host.  A line on
one page only is not repeated and stays, whatever the ratio (on a host of one page
every line would exceed it).

Defined results: a page counts once for a line however often it repeats it;
blank lines (ASCII white space only) are neither counted nor dropped; a null host is
a host of its own; a null text stays null and has no lines; repeated rows are pages
of their own; an empty table gives an empty table; other columns pass through, but
for __n_lines and __n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

#: A line on more than so many percent of its host's pages, and on so many pages at least, is boilerplate.
PERCENT, MIN_PAGES = 10, 2
#: Boilerplate lines that may be sent to every executor (16 bytes each); beyond, the tables are joined by host and one of SALTS parts of its pages.
BROADCAST_LINES, SALTS = 200_000, 64
BLANK = " \t\n\x0b\f\r"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _blank(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(BLANK))) == 0


def _marks(lines: Column) -> Column:
    """Distinct fingerprints of the lines that are not blank."""
    full = F.filter(lines, lambda x: ~_blank(x))
    return F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per boilerplate line: __host, __mark (its fingerprint), pages, host_pages."""
    rows = docs.select(F.col(host).alias("__host"), F.col(text).alias("__text"))
    totals = rows.groupBy("__host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = (
        rows.select("__host", F.explode(_marks(_lines("__text"))).alias("__mark"))
        .groupBy("__host", "__mark")
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )
    same = counts["__host"].eqNullSafe(totals["__host"])
    return counts.join(totals, same).select(counts["__host"], "__mark", "pages", "host_pages").filter(F.col("pages") * 100 > F.col("host_pages") * percent)


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of `text`; adds __n_lines and __n_dropped."""
    found = materialise(boilerplate(docs, host, text, percent, min_pages))
    per_host = found.groupBy(F.col("__host").alias("of")).agg(F.collect_set("__mark").alias("frequent"))
    # the document stays in one struct, so its columns may have any names
    columns = [c for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("d"))
    if found.count() <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(per_host), F.col("d")[host].eqNullSafe(F.col("of")), "left")
    else:  # a host may hold a third of all pages; its lines are few (each is on a share of its pages)
        per_host = per_host.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("own", F.pmod(F.xxhash64(F.col("d")[text]), F.lit(SALTS)).cast("int"))
        rows = rows.join(per_host, F.col("d")[host].eqNullSafe(F.col("of")) & (F.col("own") == F.col("part")), "left")
    rows = rows.withColumn("lines", F.split(F.col("d")[text], "\n"))
    rows = rows.withColumn("hit", F.when(F.col("frequent").isNotNull(), F.array_intersect(_marks(F.col("lines")), F.col("frequent"))))
    gone = F.coalesce(F.size("hit") > 0, F.lit(False))
    kept = F.when(gone, F.filter("lines", lambda x: ~F.array_contains(F.col("hit"), F.xxhash64(x)) | _blank(x)))
    rows = rows.withColumn("kept", kept)
    clean = F.when(gone, F.array_join("kept", "\n")).otherwise(F.col("d")[text])
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(gone, F.size("lines") - F.size("kept")).otherwise(0).cast("long")
    out = [clean.alias(c) if c == text else F.col("d")[c].alias(c) for c in columns]
    return rows.select(*out, n_lines.alias("__n_lines"), n_dropped.alias("__n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, source, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS is_full
  FROM (SELECT doc_id, source, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
frequent AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.is_full GROUP BY l.source, l.line, t.host_pages
  HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) * 100 > t.host_pages * {PERCENT}
), marked AS (
  SELECT l.*, f.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN frequent f ON l.is_full AND l.line = f.line AND l.source IS NOT DISTINCT FROM f.source
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE done.text END AS text
FROM documents d LEFT JOIN done USING (doc_id)
"""

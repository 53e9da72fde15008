"""URL filter by dated lists: an as-of join of captures with list entries. DataFrame functions only.

A list entry says from when on a domain (with its subdomains), a host or a path below a host is to
be blocked or allowed, or that its entry is lifted. The entries of one subject become validity
intervals, each open until the next one starts. A capture is joined with the intervals of every
domain above its host, of its host and of every path above its own, that hold its fetch time; the
most specific one decides: longer paths, then hosts, then longer domains.

The intervals are written as a table. Where its size is below Spark's broadcast threshold the join
is a broadcast; beyond it both sides are dealt by subject, and a partition of a subject that very
many captures share (a host with a third of them, a domain above all hosts) is split by the adaptive
skew join, as both sides are plain exchanges.

Shapes of input with a defined result: a null, empty or unreadable URL has no host and is not
blocked; a URL of any length is read whole, with a subject for each label and each path segment; a
null fetch time meets no entry; captures that are repeated are given back as often, null ids too;
entries with a null field or an unknown verdict are left out, repeated ones count once, and of two
at the same time for one subject block goes before allow and allow before lift; no captures give no
rows, and without entries nothing is blocked; other columns are ignored, whatever their names are.
Subjects compare in lower case.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import written
from ._rows import quoted

#: What an entry may say, weakest first.
VERDICTS = ["lift", "allow", "block"]


def url_host(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and final dot; empty if there is none."""
    whole = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, "^.*@", ""), ":[0-9]*$", ""), "[.]$", "")


def url_path(url: Column) -> Column:
    """The path of an absolute URL in lower case, from its first slash to a question mark or hash."""
    return F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """`kind, subject, verdict, since, until` from entries `(kind, subject, verdict, since)`; lifted times are left out."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    one = entries.select("kind", F.lower("subject").alias("subject"), rank.alias("rank"), "since").where("kind is not null and subject is not null and rank > 0 and since is not null")
    one = one.groupBy("kind", "subject", "since").agg(F.max("rank").alias("rank"))
    until = F.lead("since").over(W.partitionBy("kind", "subject").orderBy("since"))
    return one.select("kind", "subject", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("rank").cast("int")).alias("verdict"), "since", until.alias("until")).where("verdict <> 'lift'")


def _subjects() -> Column:
    """Every (kind, subject, how specific) that may speak about a capture with columns host and path."""
    labels, parts = F.split("host", "[.]"), F.filter(F.split("path", "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("subject"), (F.size(labels) - i).alias("depth")))
    host = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("subject"), F.lit(1 << 20).alias("depth")))
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda j: F.struct(F.lit("path").alias("kind"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(parts, 1, j), "/")).alias("subject"), ((1 << 21) + j).alias("depth"))))
    return F.when(F.col("host") != "", F.concat(domains, host, F.coalesce(paths, F.array()))).otherwise(F.array())


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: `id_col, url, host, fetched_at, blocked, rule_kind, rule_subject, rule_since`; null rules if none speaks."""
    spans = written(validity(entries), "spans")
    read = captures.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(time_col)).alias("time")).withColumn("host", F.coalesce(url_host(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(url_path(F.col("url")), F.lit("")))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("subject"), F.lit(-1).alias("depth"))
    asked = read.select("id", "url", "time", "host", F.explode(F.concat(F.array(none), _subjects())).alias("s")).select("id", "url", "time", "host", "s.*")
    when = (F.col("time") >= F.col("since")) & (F.col("until").isNull() | (F.col("time") < F.col("until")))
    met = asked.join(spans, [asked["kind"] == spans["kind"], asked["subject"] == spans["subject"], when], "left")
    met = met.select("id", "url", "time", "host", "depth", spans["kind"], spans["subject"], "verdict", "since")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct("depth", "since", "kind", "subject", "verdict")))
    out = met.groupBy("id", "url", "time", "host").agg(F.sum(F.when(F.col("depth") < 0, 1).otherwise(0)).alias("n"), best.alias("best"))
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return out.select(F.col("id").alias(id_col), "url", "host", F.col("time").alias("fetched_at"), F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"), F.col("best.kind").alias("rule_kind"), F.col("best.subject").alias("rule_subject"), F.col("best.since").alias("rule_since"))


def made_list(pages: DataFrame) -> DataFrame:
    """`kind, subject, verdict, since`: a list made up for the query, as no table has one; it grows with the pages.

    Every host, every domain above a host with two labels or more, and every page's path is a
    subject with two entries, at days and with verdicts by a digest of the subject.
    """
    read = pages.select(url_host(F.col("url")).alias("host"), F.regexp_replace(url_path(F.col("url")), "/+$", "").alias("path")).where("host <> ''")
    subjects = read.select(F.lit("host").alias("kind"), F.col("host").alias("subject"))
    subjects = subjects.union(read.select(F.lit("domain"), F.regexp_replace("host", "^[^.]*[.]", "")))
    subjects = subjects.union(read.where("path <> ''").select(F.lit("path"), F.regexp_replace(F.concat("host", "path"), "/+", "/")))
    digest = F.md5(F.concat("kind", F.lit(" "), "subject"))
    byte = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")
    said = lambda k: F.element_at(F.array(F.lit("lift"), F.lit("block"), F.lit("allow"), F.lit("lift")), byte(k) % 4 + 1)
    first = F.date_add(F.lit("2024-01-01").cast("date"), byte(0))
    both = F.array(F.struct(said(1).alias("verdict"), first.alias("since")), F.struct(said(2).alias("verdict"), F.date_add(first, byte(3) + 1).alias("since")))
    return subjects.distinct().select("kind", "subject", F.explode(both).alias("e")).select("kind", "subject", "e.*")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """The pages' URLs against `made_list`; pages have no fetch time, so one day of 2024 is derived from each id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 7, 366) as int))"))
    return url_filter(captures, made_list(pages))


_BYTE = "CAST('0x' || substr(md5(kind || ' ' || subject), {}, 2) AS INTEGER)"
_SAID = "CASE {} % 4 WHEN 1 THEN 'block' WHEN 2 THEN 'allow' ELSE 'lift' END"
OP5_SQL = f"""
WITH captures AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7) % 366 AS INTEGER) AS fetched_at,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') AS host,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path FROM pages),
subjects AS (SELECT 'host' AS kind, host AS subject FROM captures WHERE host <> '' UNION SELECT 'domain', regexp_replace(host, '^[^.]*[.]', '') FROM captures WHERE host <> ''
    UNION SELECT 'path', host || rtrim(path, '/') FROM captures WHERE host <> '' AND rtrim(path, '/') <> ''),
days AS (SELECT kind, subject, DATE '2024-01-01' + {_BYTE.format(1)} AS since, {_SAID.format(_BYTE.format(3))} AS v1, {_SAID.format(_BYTE.format(5))} AS v2, {_BYTE.format(7)} + 1 AS later FROM subjects),
spans AS (SELECT kind, subject, v1 AS verdict, since, since + later AS until FROM days UNION ALL SELECT kind, subject, v2, since + later, NULL FROM days),
met AS (SELECT c.*, s.kind, s.subject, s.since, s.verdict,
    CASE s.kind WHEN 'domain' THEN len(string_split(s.subject, '.')) WHEN 'host' THEN 1000000 ELSE 2000000 + len(s.subject) END AS depth
    FROM captures c LEFT JOIN spans s ON c.fetched_at >= s.since AND (s.until IS NULL OR c.fetched_at < s.until) AND s.verdict <> 'lift' AND (
        (s.kind = 'host' AND c.host = s.subject) OR (s.kind = 'domain' AND (c.host = s.subject OR ends_with(c.host, '.' || s.subject)))
        OR (s.kind = 'path' AND starts_with(c.host || c.path || '/', s.subject || '/'))))
SELECT page_id, url, host, fetched_at, coalesce(verdict = 'block', false) AS blocked, kind AS rule_kind, subject AS rule_subject, since AS rule_since
FROM met QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY depth DESC NULLS LAST, since DESC) = 1"""

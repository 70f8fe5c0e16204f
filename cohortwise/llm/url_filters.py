"""Operator 1 (native): URL filter lists with dates, as a temporal list join.

List entries carry dates: on a day an entry is added to a list or removed from
it. They become validity intervals, and an as-of join evaluates every capture
against the entries that were active on the day it was fetched.

The verdict hangs on URL and day alone, so it is found once for each distinct
pair. A pair has a key for every entry that could match it; the as-of join
runs on distinct (key, day), which a host with any share of all captures
reduces to a row for each day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import table

#: Kinds of entries, the most specific last: a domain with all below it, a host's path with all below it, one URL.
KINDS = ("domain", "path", "url")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a dot at its end; empty where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))


def _steps(text: Column) -> Column:
    return F.filter(F.split(text, "/"), lambda s: s != "")


def intervals(events: DataFrame) -> DataFrame:
    """(list, verdict, kind, value, valid_from, valid_to): when each entry was active.

    ``events`` holds list, verdict ('block' or 'allow'), kind, value, day and
    action ('add' or 'remove'). An entry is active from the day it is added to
    the day before its next event (valid_to is that event's day, null if there
    is none). Of an entry's events on one day an 'add' outweighs a 'remove';
    events with a null in any column, or an unknown kind or action, count for
    nothing. Values are compared as they are; domains in lower case.
    """
    known = events.select("list", "verdict", "kind", F.when(F.col("kind") == "domain", F.lower("value")).otherwise(F.col("value")).alias("value"), F.col("day").cast("date").alias("day"), "action")
    known = known.dropna().filter(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove"))
    per_day = known.groupBy("list", "verdict", "kind", "value", "day").agg(F.bool_or(F.col("action") == "add").alias("added"))
    following = Window.partitionBy("list", "verdict", "kind", "value").orderBy("day")
    return (per_day.withColumn("valid_to", F.lead("day").over(following)).filter("added")
            .select("list", "verdict", "kind", "value", F.col("day").alias("valid_from"), "valid_to"))


def _keys(url: Column, labels: int, steps: int) -> Column:
    """All (kind, value) that entries of at most ``labels`` labels and ``steps`` path steps could have for a URL."""
    host = host_of(url)
    names = F.split(host, r"\.")
    count = F.least(F.size(names), F.lit(labels))
    domains = F.when((host != "") & (count > 0), F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(names, -n, n), ".").alias("value"))))
    path = _steps(F.regexp_extract(url, _PATH, 1))
    depth = F.least(F.size(path), F.lit(steps))
    paths = F.when((host != "") & (F.lit(steps) >= 0), F.transform(F.sequence(F.lit(0), F.greatest(depth, F.lit(0))), lambda n: F.struct(
        F.lit("path").alias("kind"), F.array_join(F.concat(F.array(host), F.slice(path, F.lit(1), n)), "/").alias("value"))))
    whole = F.array(F.struct(F.lit("url").alias("kind"), url.alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.array_distinct(F.concat(F.coalesce(domains, none), F.coalesce(paths, none), whole))


def temporal_filter(captures: DataFrame, events: DataFrame, url_col: str, day_col: str) -> DataFrame:
    """``captures`` with the verdict of the entry that decides, and what it is.

    Adds verdict ('block', 'allow', or 'none' if no entry is active), list,
    kind, value, valid_from, valid_to of the deciding entry and n_active, the
    number of entries active for the capture; columns of these names are
    replaced. The most specific entry decides (url, then the longest path,
    then the longest domain); among equals 'allow', then the latest start,
    then the list's name. A path entry is "host/step/step" and matches whole
    steps below it. Captures whose URL or day is null have no active entry;
    repeated captures are kept, each with its verdict. Without entries every
    verdict is 'none'; without captures there are no rows.
    """
    added = ("verdict", "list", "kind", "value", "valid_from", "valid_to", "n_active")
    captures = captures.drop(*added)
    active = intervals(events)
    size = active.agg(F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))), F.max(F.when(F.col("kind") == "path", F.size(_steps(F.col("value"))) - 1))).first()
    labels, steps = size[0] or 0, -1 if size[1] is None else size[1]
    url, day = F.col(url_col).cast("string"), F.col(day_col).cast("date")
    pairs = captures.select(url.alias("__url"), day.alias("__day")).filter("__url is not null and __day is not null").distinct()
    keyed = pairs.select("__url", "__day", F.inline(_keys(F.col("__url"), labels, steps)))
    asked = keyed.select("kind", "value", "__day").distinct()
    hits = asked.join(active, ["kind", "value"]).filter((F.col("__day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to"))))
    order = F.struct(
        F.when(F.col("kind") == "url", 2).when(F.col("kind") == "path", 1).otherwise(0), F.length("value"), F.col("verdict") == "allow", "valid_from",
        # the smallest list name last: names in descending order have ascending negated characters
        F.transform(F.split("list", ""), lambda c: -F.ascii(c)))
    per_key = hits.groupBy("kind", "value", "__day").agg(
        F.max_by(F.struct("verdict", "list", "kind", "value", "valid_from", "valid_to"), order).alias("best"), F.max(order).alias("order"), F.count(F.lit(1)).alias("n"))
    decided = keyed.join(per_key, ["kind", "value", "__day"]).groupBy("__url", "__day").agg(F.max_by("best", "order").alias("best"), F.sum("n").alias("n_active"))
    decided = decided.withColumnsRenamed({"__url": "__u", "__day": "__d", "best": "__best", "n_active": "__n"})
    out = captures.join(decided, (url == F.col("__u")) & (day == F.col("__d")), "left")
    return out.select(*captures.columns, F.coalesce("__best.verdict", F.lit("none")).alias("verdict"), *[F.col(f"__best.{c}").alias(c) for c in added[1:6]], F.coalesce("__n", F.lit(0)).cast("bigint").alias("n_active"))


# ---- the query: captures and dated entries derived from pages ------------------------------------

_FIRST_DAY = "2023-01-01"


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with the day each was fetched: spread over two years by its id."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"date_add(date'{_FIRST_DAY}', cast(pmod(page_id * 7919, 730) as int))").alias("fetched_on"))


def host_events(captures: DataFrame) -> DataFrame:
    """Dated list events for the hosts of the captures, drawn by a digest of the host."""
    hosts = captures.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("n", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    day = f"date_add(date'{_FIRST_DAY}', cast(%s as int))"

    def event(where: str, name: str, verdict: str, kind: str, value: str, at: str, action: str) -> DataFrame:
        return hosts.filter(where).selectExpr(f"'{name}' as list", f"'{verdict}' as verdict", f"'{kind}' as kind", f"{value} as value", f"{day % at} as day", f"'{action}' as action")

    parent, under = r"regexp_replace(host, '^[^.]+[.]', '')", "concat(host, '/en')"
    parts = [event("n % 4 = 0", "harmful", "block", "domain", "host", "n % 500", "add"),
             event("n % 4 = 0", "harmful", "block", "domain", "host", "n % 500 + 1 + n % 97", "remove"),
             event("n % 4 = 0", "harmful", "block", "domain", "host", "n % 500 + 200", "add"),
             event("n % 6 = 1", "parked", "block", "domain", parent, "n % 300", "add"),
             event("n % 12 = 1", "parked", "block", "domain", parent, "n % 300 + 40", "remove"),
             event("n % 5 = 2", "reviewed", "allow", "path", under, "n % 600", "add"),
             event("n % 10 = 2", "reviewed", "allow", "path", under, "n % 600 + 90", "remove")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` against the entries active on the day of each."""
    captures = page_captures(spark, sf_dir)
    return temporal_filter(captures, host_events(captures), "url", "fetched_on")


ORACLE_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2023-01-01' + ((page_id * 7919) % 730)::INTEGER AS fetched_on,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps
  FROM pages
), h AS (
  SELECT host, ('0x' || substr(md5(host), 1, 6))::INTEGER AS n FROM (SELECT DISTINCT host FROM c WHERE host <> '')
), ev AS (
  SELECT 'harmful' AS list, 'block' AS verdict, 'domain' AS kind, host AS value, n % 500 AS days, true AS added FROM h WHERE n % 4 = 0
  UNION ALL SELECT 'harmful', 'block', 'domain', host, n % 500 + 1 + n % 97, false FROM h WHERE n % 4 = 0
  UNION ALL SELECT 'harmful', 'block', 'domain', host, n % 500 + 200, true FROM h WHERE n % 4 = 0
  UNION ALL SELECT 'parked', 'block', 'domain', regexp_replace(host, '^[^.]+[.]', ''), n % 300, true FROM h WHERE n % 6 = 1
  UNION ALL SELECT 'parked', 'block', 'domain', regexp_replace(host, '^[^.]+[.]', ''), n % 300 + 40, false FROM h WHERE n % 12 = 1
  UNION ALL SELECT 'reviewed', 'allow', 'path', host || '/en', n % 600, true FROM h WHERE n % 5 = 2
  UNION ALL SELECT 'reviewed', 'allow', 'path', host || '/en', n % 600 + 90, false FROM h WHERE n % 10 = 2
), d AS (
  SELECT list, verdict, kind, value, DATE '2023-01-01' + days AS day, bool_or(added) AS added FROM ev GROUP BY ALL
), i AS (
  SELECT list, verdict, kind, value, day AS valid_from, valid_to
  FROM (SELECT *, lead(day) OVER (PARTITION BY list, verdict, kind, value ORDER BY day) AS valid_to FROM d) WHERE added
), m AS (
  SELECT DISTINCT c.url, c.fetched_on, i.* FROM c JOIN i
  ON i.valid_from <= c.fetched_on AND (i.valid_to IS NULL OR c.fetched_on < i.valid_to)
  AND ((i.kind = 'domain' AND (c.host = i.value OR ends_with(c.host, '.' || i.value)))
    OR (i.kind = 'path' AND starts_with(c.host || '/' || array_to_string(c.steps, '/') || '/', i.value || '/')))
), b AS (
  SELECT *, count(*) OVER (PARTITION BY url, fetched_on) AS n_active,
    row_number() OVER (PARTITION BY url, fetched_on ORDER BY kind = 'path' DESC, length(value) DESC, verdict, valid_from DESC, list) AS r
  FROM m
)
SELECT c.page_id, c.url, c.fetched_on, coalesce(b.verdict, 'none') AS verdict, b.list, b.kind, b.value, b.valid_from, b.valid_to, coalesce(b.n_active, 0)::BIGINT AS n_active
FROM c LEFT JOIN b ON c.url = b.url AND c.fetched_on = b.fetched_on AND b.r = 1
"""

QUERIES = {"op1_url_filters": (op1_url_filters, ORACLE_SQL)}

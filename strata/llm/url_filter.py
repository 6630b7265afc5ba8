"""URL filters by an as-of join with a dated list, in DataFrame operations alone.

Every (kind, key) of the list has dated entries that add or remove it; they become validity
intervals [from, until) that do not overlap.  A capture is blocked if, at its fetch time, an
interval that adds one of its keys is active: its host or a parent domain (kind ``domain``), or a
word of its host (kind ``word``).

The answer depends on host and fetch time alone, so these are made distinct first; each has a few
keys, and the interval join is an equi-join on the key with the range as a condition.  List and
answers are broadcast only when a count shows them small; otherwise the joins are plain ones whose
hot keys adaptive execution splits.

Defined results: a null or unparsable url has the host '' and is not blocked; a null fetch time
meets no interval; of entries for one key at one time, a removal wins; entries with a null kind,
key, action or time are left out; an empty list blocks nothing; repeated captures get equal
results; other columns pass through (new names avoid theirs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import beside, cut, fresh, table

#: The pages table has no fetch time: page n counts as fetched n modulo 730 days after this day.
FIRST_DAY, DAYS = "2023-01-01", 730
#: Words on the list, dated: (kind, key, action, day).  Hosts come from ``host_list``.
ENTRIES: tuple[tuple[str, str, str, str], ...] = (
    ("word", "casino", "add", "2023-05-05"),
    ("word", "casino", "remove", "2023-08-15"),
    ("word", "bets", "add", "2024-01-01"),
    ("word", "pills", "add", "2023-09-09"),
    ("word", "adult", "add", "2022-01-01"),
    ("word", "blog", "add", "2024-06-01"),
    ("word", "blog", "remove", "2024-06-08"),
)


def entries(spark: SparkSession, rows=ENTRIES) -> DataFrame:
    """A list (kind, key, action, day) of literal rows."""
    text = lambda v: F.lit(v).cast("string")
    made = [F.struct(text(k).alias("kind"), text(v).alias("key"), text(a).alias("action"), F.to_date(text(d)).alias("day")) for k, v, a, d in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A list kept as a Parquet table of kind, key, action and day."""
    return spark.read.parquet(path).select("kind", "key", "action", F.to_date("day").alias("day"))


def host_list(urls: DataFrame, url: str = "url") -> DataFrame:
    """A dated list for the hosts of urls, as large as their number: the host's MD5 says whether it is listed (3 of 16), when, for
    how long, and if again.  It stands for a feed where there is none."""
    hosts = urls.select(host_of(F.col(f"`{url}`")).alias("key")).where("key <> ''").distinct().withColumn("m", F.md5("key"))

    def number(at: int, n: int) -> Column:
        return F.conv(F.substring("m", at, n), 16, 10).cast("int")

    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod(number(2, 4), F.lit(DAYS)).cast("int"))
    start, length, back = day, number(6, 2) + 1, number(8, 2) + 1
    dated = [
        (F.lit(True), "add", start),
        (number(10, 1) < 12, "remove", F.date_add(start, length)),
        (number(10, 1) < 4, "add", F.date_add(start, length + back)),
    ]
    rows = F.array(*[F.when(c, F.struct(F.lit("domain").alias("kind"), F.col("key"), F.lit(a).alias("action"), d.alias("day"))) for c, a, d in dated])
    return hosts.where(number(1, 1) < 3).select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def intervals(listed: DataFrame) -> DataFrame:
    """(kind, key, start, until) of the times at which a key is on the list; until is null for ever."""
    clean = listed.where(F.col("kind").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    once = clean.groupBy("kind", F.lower("key").alias("key"), "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(W.partitionBy("kind", "key").orderBy("day"))
    return once.select("kind", "key", F.col("day").alias("start"), until.alias("until"), "action").where(F.col("action") == "add").drop("action")


def host_of(url: Column) -> Column:
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1))


def keys_of(host: Column) -> Column:
    """array<struct<kind, key>>: the host and its parents as domains, its alphanumeric runs as words."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    words = F.array_distinct(F.filter(F.split(host, "[^a-z0-9]+"), lambda w: w != ""))
    named = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    return F.concat(named("domain", F.array_distinct(domains)), named("word", words))


def screen(captures: DataFrame, listed: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures plus ``host``, ``blocked`` and ``rule`` (the first active ``kind:key``, or null)."""
    host = fresh(captures, "host")
    rows = captures.withColumn(host, host_of(F.col(f"`{url}`")))
    asked = rows.select(F.col(host).alias("h"), F.col(f"`{fetched}`").alias("t")).where("h <> '' AND t IS NOT NULL").distinct()
    keys = asked.select("h", "t", F.explode(keys_of(F.col("h"))).alias("k")).select("h", "t", "k.kind", "k.key")
    active = beside(keys, cut(intervals(listed)), ["kind", "key"]).where("start <= t AND (until IS NULL OR t < until)")
    answers = cut(active.groupBy("h", "t").agg(F.min(F.concat_ws(":", "kind", "key")).alias("rule")))
    rule, blocked, h, t = (fresh(rows, x) for x in ("rule", "blocked", "__h", "__t"))
    answers = answers.select(F.col("h").alias(h), F.col("t").alias(t), F.col("rule").alias(rule))
    joined = beside(rows, answers, (rows[host] == F.col(h)) & (rows[fetched] == F.col(t)), "left")
    return joined.drop(h, t).withColumn(blocked, F.col(rule).isNotNull())


def query(spark, sf_dir):
    """op3: the whole of pages against the list of words and of the pages' own hosts."""
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod("page_id", F.lit(DAYS)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    listed = entries(spark).unionByName(host_list(pages))
    return screen(pages, listed).select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "host", "blocked", "rule")


def oracle_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}', '{a}', DATE '{d}')" for k, v, a, d in ENTRIES)
    return f"""
WITH h AS (
  SELECT *, md5(key) AS m FROM (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS key FROM pages) WHERE key <> ''
), l AS (
  SELECT key, CAST('0x' || m[10] AS INTEGER) AS again, CAST('0x' || m[6:7] AS INTEGER) + 1 AS days, CAST('0x' || m[8:9] AS INTEGER) + 1 AS back,
    DATE '{FIRST_DAY}' + CAST('0x' || m[2:5] AS INTEGER) % {DAYS} AS day FROM h WHERE CAST('0x' || m[1] AS INTEGER) < 3
), e(kind, key, action, day) AS (
  VALUES {rows} UNION ALL SELECT 'domain', key, 'add', day FROM l UNION ALL SELECT 'domain', key, 'remove', day + days FROM l WHERE again < 12
  UNION ALL SELECT 'domain', key, 'add', day + days + back FROM l WHERE again < 4
), i AS (SELECT kind, key, action, day AS start, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS until FROM e),
p AS (
  SELECT row_number() OVER () AS rid, page_id, url, CAST(DATE '{FIRST_DAY}' + CAST(page_id % {DAYS} AS INTEGER) AS DATE) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages
), m AS (
  SELECT p.rid, min(i.kind || ':' || i.key) AS rule FROM p JOIN i ON i.action = 'add' AND i.start <= p.fetched AND (i.until IS NULL OR p.fetched < i.until)
    AND CASE i.kind WHEN 'domain' THEN p.host = i.key OR p.host LIKE '%.' || i.key
      ELSE list_contains(regexp_split_to_array(p.host, '[^a-z0-9]+'), i.key) END
  GROUP BY p.rid
)
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, host, rule IS NOT NULL AS blocked, rule FROM p LEFT JOIN m USING (rid)
"""

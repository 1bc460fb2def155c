"""URL filters with lists that change in time.

A list is a log of dated entries that add or remove a pattern: a domain (with all below it)
or a host with a path prefix.  Entries become validity intervals, each up to the next entry
for the same pattern, and every capture is held against those that contain its fetch time.
Only DataFrame functions are used.  Patterns are looked up by equality: a capture gives one
key for every depth (labels of a domain, segments of a path) that occurs in the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcastable, materialise, read_table

#: Intervals that are broadcast; more are joined by a shuffle, whose hot keys Spark splits.
MOST_INTERVALS = 200_000
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Host in lower case without user, port and last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)), r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def intervals(entries: DataFrame) -> DataFrame:
    """list, verdict, pattern, valid_from, valid_to from dated entries (list, verdict, pattern,
    at, op).  An entry `add` holds until the next entry of the same list and pattern, or for ever;
    of entries at one time the removal counts last.  Null times or patterns are left out."""
    pattern = F.regexp_replace(F.lower("pattern"), "/+$", "")
    known = entries.where("pattern is not null and at is not null").select("list", "verdict", pattern.alias("pattern"), "at", "op").where("pattern <> ''").distinct()
    log = Window.partitionBy("list", "pattern").orderBy("at", "op", "verdict")
    return known.withColumn("valid_to", F.lead("at").over(log)).where("op = 'add' and (valid_to is null or valid_to > at)").select("list", "verdict", "pattern", F.col("at").alias("valid_from"), "valid_to")


def _count(column: str, what: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit(what), F.lit("")))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", most_intervals: int = MOST_INTERVALS) -> DataFrame:
    """One row per row of captures: id_col, host, fetched, n_active, lists, decided_by, blocked.

    n_active counts the intervals that match, lists names them, and the longest pattern decides;
    of equal ones `block` wins.  Paths are compared in lower case.  A null or unusable URL, or a
    null time, matches nothing and is not blocked.  Repeated rows have a row each; other columns
    of captures are not read."""
    spans = materialise(intervals(entries), "intervals")
    is_path = F.instr("pattern", "/") > 0
    # one row per depth, not per pattern
    depths = spans.select(is_path.alias("is_path"), F.when(is_path, _count("pattern", "/")).otherwise(_count("pattern", ".") + 1).alias("depth")).distinct().toLocalIterator()
    by_host, by_path = [], []
    for row in depths:
        (by_path if row.is_path else by_host).append(row.depth)
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("fetched"))
    rows = rows.select("id", "fetched", F.xxhash64("url").alias("tie"), host(F.col("url")).alias("host"), F.lower(path(F.col("url"))).alias("path")).withColumn("whole", F.concat("host", "path"))
    keys = [F.when(_count("host", ".") + 1 >= d, F.substring_index("host", ".", -d)) for d in sorted(by_host)]
    keys += [F.when(_count("whole", "/") >= d, F.substring_index("whole", "/", d + 1)) for d in sorted(by_path)]
    keyed = rows.withColumn("keys", F.when(F.col("host") != "", F.filter(F.array_distinct(F.array(*keys)), lambda k: k.isNotNull())) if keys else F.lit(None).cast("array<string>"))
    # captures without a key stay out of the join, and each has a number by which its matches come back
    numbered = materialise(keyed.withColumn("n", F.monotonically_increasing_id()), "captures")
    exploded = numbered.select("n", "fetched", F.explode("keys").alias("key"))
    side = F.broadcast(spans) if broadcastable(spans, most_intervals) else spans
    met = exploded.join(side, _active(F.col("fetched"), F.col("key")))
    found = met.groupBy(F.col("n").alias("_n")).agg(F.collect_list(F.struct(*_FIELDS)).alias("found"))  # no more than the intervals that hold for one capture
    return _decided(numbered.join(found, F.col("n") == F.col("_n"), "left").select("id", "fetched", "host", "found"), id_col)


_FIELDS = ["list", "verdict", "pattern"]


def _active(fetched: Column, key: Column) -> Column:
    return (key == F.col("pattern")) & (fetched >= F.col("valid_from")) & (F.col("valid_to").isNull() | (fetched < F.col("valid_to")))


def _decided(captures: DataFrame, id_col: str) -> DataFrame:
    """The result of captures (id, fetched, host, found): found is what holds for each."""
    best = F.array_max(F.transform("found", lambda x: F.struct(F.length(x["pattern"]).alias("size"), (x["verdict"] == "block").alias("block"), x["pattern"].alias("pattern"))))
    n = F.when(F.col("found").isNull(), 0).otherwise(F.size("found"))
    lists = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["list"]))), ",")
    return captures.withColumn("_best", best).select(F.col("id").alias(id_col), "host", "fetched", n.cast("long").alias("n_active"), F.coalesce(lists, F.lit("")).alias("lists"), F.col("_best.pattern").alias("decided_by"), F.coalesce("_best.block", F.lit(False)).alias("blocked"))


DAY = "2024-01-01"


def example_lists(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts of `pages`, whose smallest page_id m settles all else:
    hosts that are listed, taken off and listed again, sections of hosts, whole parent domains,
    and sections that are trusted."""
    hosts = materialise(pages.groupBy(host(F.col("url")).alias("host")).agg(F.min("page_id").alias("m")).where("host <> '' and m is not null"), "hosts")

    def entry(name: str, verdict: str, pattern: str, day: str, op: str, where: str) -> DataFrame:
        return hosts.where(where).select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.expr(pattern).alias("pattern"), F.expr(f"date_add(DATE '{DAY}', cast({day} as int))").alias("at"), F.lit(op).alias("op"))

    parts = [entry(*x) for x in ENTRIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


ENTRIES = [
    ("abuse", "block", "host", "m % 200", "add", "m % 4 = 0"),
    ("abuse", "block", "host", "m % 200 + 90", "remove", "m % 12 = 0"),
    ("abuse", "block", "host", "m % 200 + 150", "add", "m % 60 = 0"),
    ("sections", "block", "concat(host, '/en')", "m % 100", "add", "m % 5 = 1"),
    ("parents", "block", "substring_index(host, '.', -2)", "m % 300", "add", "m % 11 = 3"),
    ("trusted", "allow", "concat(host, '/de/')", "m % 50", "add", "m % 3 = 0"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(f"date_add(DATE '{DAY}', cast(page_id % 365 as int))"))
    return filter_urls(captures, example_lists(pages)).withColumn("fetched", F.col("fetched").cast("string"))


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)), '\.$', '')"
_PATH = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2))"
_PARENT = "array_to_string(string_split(host, '.')[-2:], '.')"
SQL = f"""
WITH c AS (SELECT page_id, {_HOST} AS host, {_HOST} || {_PATH} AS whole, DATE '{DAY}' + CAST(page_id % 365 AS INT) AS fetched FROM pages),
h AS (SELECT host, min(page_id) AS m FROM c WHERE host <> '' GROUP BY host),
e AS ({" UNION ".join(f"SELECT '{n}' AS list, '{v}' AS verdict, {_PARENT if 'substring_index' in p else p} AS pattern, DATE '{DAY}' + CAST({d} AS INT) AS day, '{o}' AS op FROM h WHERE {w}" for n, v, p, d, o, w in ENTRIES)}),
k AS (SELECT DISTINCT list, verdict, regexp_replace(lower(pattern), '/+$', '') AS pattern, day, op FROM e),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day, op, verdict) AS valid_to FROM k),
s AS (SELECT * FROM i WHERE op = 'add' AND (valid_to IS NULL OR valid_to > day)),
j AS (SELECT page_id, list, verdict, pattern FROM c JOIN s ON fetched >= day AND (valid_to IS NULL OR fetched < valid_to)
      AND (host = pattern OR ends_with(host, '.' || pattern) OR (contains(pattern, '/') AND (whole = pattern OR starts_with(whole, pattern || '/'))))),
g AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
             arg_max(pattern, (length(pattern), verdict = 'block', pattern)) AS decided_by,
             arg_max(verdict = 'block', (length(pattern), verdict = 'block', pattern)) AS blocked FROM j GROUP BY page_id)
SELECT c.page_id, host, CAST(fetched AS VARCHAR) AS fetched, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, decided_by, coalesce(blocked, false) AS blocked
FROM c LEFT JOIN g USING (page_id)
"""

"""URL filters by a temporal list join.

A list is a dated log: on a day, an entry is added to a list or removed from it. The days of one entry
on one list become validity intervals [from, until), and an as-of join evaluates every capture against
the entries active at its fetch time. An entry is a host, a domain (with all hosts under it) or a path
prefix of whole segments under a host.

A capture asks for few keys: its host, each parent domain, and each prefix of its path, as deep as the
deepest entry of the log. A capture meets intervals by an equi-join on the key with a range condition
on time. The list is as large as it is: nothing is broadcast by hand. The join is plain, so adaptive
execution splits the partition of a host that holds a third of all captures, however many rows it has.

Everything is made of DataFrame functions. A capture with a null url or no host matches nothing and is
allowed; one without a fetch time, too. Rows of a log without key, kind or day, or with an unknown
action, are ignored; on one day the last action wins, `remove` before `add`. A result row stands for a
capture's id: repeated captures are evaluated once, and rows that share an id but not url or time count
each entry that any of them meets once. Repeated log rows count once. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def url_parts(url):
    """(host, path) as columns: host in lower case without user, port and final dot; path without query and fragment."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    bare = F.regexp_extract(rest, r"^([^?#]*)", 1)
    authority = F.regexp_extract(bare, r"^([^/]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return host, F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1)


def keys(captures: DataFrame, depth: int | None = None) -> DataFrame:
    """(capture, fetched, kind, key) of everything that an entry may name; depth: segments of a prefix at most."""
    host, path = url_parts(F.col("url"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1)) if depth is None else F.greatest(F.least(F.size(segments), F.lit(depth)), F.lit(1))), lambda i: (i <= F.size(segments)) & (F.lit(depth is None) | (i <= (depth or 0)))),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("key")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")))
    split = captures.select("capture", "fetched", host.alias("host"), path.alias("path")).where(F.col("host").isNotNull() & (F.col("host") != ""))
    return split.select("capture", "fetched", F.explode(F.concat(own, parents, prefixes)).alias("k")).select("capture", "fetched", "k.kind", "k.key")


def intervals(log: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_until): until is null for an entry that is still on its list."""
    known = log.where(F.col("action").isin("add", "remove") & F.col("kind").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("list").isNotNull())
    daily = known.groupBy("list", "kind", "key", "day").agg(F.min("action").alias("action"))
    order = Window.partitionBy("list", "kind", "key").orderBy("day")
    turns = daily.withColumn("was", F.lag("action").over(order)).where(F.coalesce(F.col("was"), F.lit("remove")) != F.col("action"))
    return turns.withColumn("valid_until", F.lead("day").over(order)).where("action = 'add'").select("list", "kind", "key", F.col("day").alias("valid_from"), "valid_until")


def evaluate(captures: DataFrame, log: DataFrame) -> DataFrame:
    """captures (capture, url, fetched) -> (capture, blocked, n_active, lists, reason) by the entries active at fetch time.

    reason is the smallest of 'list:kind:key'.
    """
    deepest = log.where("kind = 'prefix'").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    asked = keys(captures, deepest)
    hit = asked.join(intervals(log), ["kind", "key"]).where((F.col("valid_from") <= F.col("fetched")) & (F.col("valid_until").isNull() | (F.col("fetched") < F.col("valid_until"))))
    # each entry once, whatever is repeated; a capture has few keys. Grouping by the capture alone leaves the join free to be split
    found = hit.groupBy("capture").agg(F.collect_set(F.struct("list", "kind", "key")).alias("entries"))
    found = found.select(
        "capture",
        F.size("entries").cast("bigint").alias("n_active"),
        F.array_sort(F.array_distinct(F.col("entries.list"))).alias("lists"),
        F.array_min(F.transform("entries", lambda e: F.concat_ws(":", e["list"], e["kind"], e["key"]))).alias("reason"),
    )
    out = captures.select("capture").distinct().join(found, "capture", "left")
    return out.select("capture", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), F.array_join("lists", ",").alias("lists"), "reason")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the fetch day follows from the id, as the table has none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    return pages.select(F.col("page_id").alias("capture"), "url", day.alias("fetched"))


def page_log(captures: DataFrame) -> DataFrame:
    """A dated log for the query: hosts, domains and prefixes of the pages themselves, chosen by a digest of the key."""
    digest = F.conv(F.substring(F.sha1(F.concat_ws(":", "kind", "key").cast("binary")), 1, 6), 16, 10).cast("int")
    known = keys(captures).select("kind", "key").distinct().withColumn("digest", digest).where("digest % 5 = 0")
    start = F.lit("2024-01-01").cast("date")
    first = F.date_add(start, (F.col("digest") % 211).cast("int"))
    day = lambda n: F.date_add(first, n)
    # added, for some removed after 60 days, for some of these added again after 150
    steps = F.filter(
        F.array(
            F.struct(F.lit("add").alias("action"), first.alias("day"), F.lit(True).alias("holds")),
            F.struct(F.lit("remove").alias("action"), day(60).alias("day"), (F.col("digest") % 2 == 0).alias("holds")),
            F.struct(F.lit("add").alias("action"), day(150).alias("day"), (F.col("digest") % 4 == 0).alias("holds")),
        ),
        lambda s: s["holds"],
    )
    named = known.withColumn("list", F.when(F.col("digest") % 3 == 0, "adult").when(F.col("digest") % 3 == 1, "spam").otherwise("malware"))
    return named.select("list", "kind", "key", F.explode(steps).alias("s")).select("list", "kind", "key", "s.action", "s.day")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = page_captures(common.read(spark, sf_dir, "pages"))
    log = common.scratch(page_log(captures), "log")
    out = evaluate(captures, log)
    return out.withColumnRenamed("capture", "page_id")


#: The same by the last log row at or before each fetch.
OP6_SQL = r"""
with p as (
  select distinct page_id as capture, url, date '2024-01-01' + cast(((page_id % 365) + 365) % 365 as int) as fetched from pages
), b as (
  select *, regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '^([^?#]*)', 1) as bare from p
), h as (
  select capture, fetched,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.$', '') as host,
    list_filter(string_split(regexp_extract(bare, '^[^/]*(/.*)?$', 1), '/'), lambda s: s <> '') as seg
  from b where url is not null
), k as (
  select capture, fetched, 'host' as kind, host as key from h where host <> ''
  union all select capture, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.') from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from h where host <> '')
  union all select capture, fetched, 'prefix', host || '/' || array_to_string(seg[1:i], '/') from (select *, unnest(range(1, len(seg) + 1)) as i from h where host <> '')
), n as (
  select kind, key, cast('0x' || substr(sha1(kind || ':' || key), 1, 6) as int) as n from (select distinct kind, key from k)
), e as (
  select kind, key, n, case n % 3 when 0 then 'adult' when 1 then 'spam' else 'malware' end as list, date '2024-01-01' + n % 211 as first from n where n % 5 = 0
), log as (
  select list, kind, key, 'add' as action, first as day from e
  union all select list, kind, key, 'remove', first + 60 from e where n % 2 = 0
  union all select list, kind, key, 'add', first + 150 from e where n % 4 = 0
), a as (
  select capture, fetched, list, kind, key, arg_max(action, day) as action from k join log using (kind, key) where day <= fetched group by all
), f as (
  select capture, count(*) as n_active, array_to_string(list_sort(list(distinct list)), ',') as lists, min(list || ':' || kind || ':' || key) as reason
  from (select distinct capture, list, kind, key from a where action = 'add') group by capture
)
select distinct p.capture as page_id, f.capture is not null as blocked, coalesce(n_active, 0) as n_active, lists, reason from p left join f on f.capture = p.capture
"""

QUERIES = {"op6_url_filters": op6_url_filters}
ORACLES = {"op6_url_filters": OP6_SQL}

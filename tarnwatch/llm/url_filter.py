"""URL filters over dated lists: a temporal list join, by DataFrame operations alone.

A list is a table of dated entries: `entry` (a domain, which covers its subdomains, or a host with a path, which
covers what lies below it), `action` (add or remove) and `at`. Entries become validity intervals: each add holds
until the next change of the same entry. A capture, a URL with the time it was fetched, has as keys its host, all
parent domains and all beginnings of its path; an as-of join on the key finds the intervals open at fetch time,
and the most specific of them, then the latest, decides.

Captures are joined as (row, key, time), without their other columns, and matches are aggregated per row before
they meet the captures again. Intervals are broadcast only while their checked count is small; beyond that each
is laid out over `salts` keys, so that a host of a third of all captures meets many tasks.

Defined results: null or malformed URLs have no host and are not blocked; null fetch times match no interval;
entries with a null entry, action or time are left out; of changes at the same time a removal comes last, so it
wins; repeated captures get the same result each; empty lists block nothing; an empty table gives an empty result;
very long URLs count whole; further columns of captures are not touched and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import row_key, written

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def keys_of(host: Column, path: Column, labels: int, depth: int) -> Column:
    """All that list entries of so many domain labels and path steps at most may say of a URL: domains from the host
    up, and the host with each beginning of the path."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - F.lit(labels - 1))
    domains = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.least(F.size(steps), F.lit(depth))
    paths = F.when(
        last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, since, until): until is null while an entry holds."""
    known = entries.where("entry IS NOT NULL AND action IN ('add', 'remove') AND at IS NOT NULL")
    clean = F.regexp_replace(F.lower("entry"), r"[./]+$", "")
    order = Window.partitionBy("entry").orderBy("at", "action")
    then = known.select(clean.alias("entry"), "action", "at").withColumn("until", F.lead("at").over(order))
    open_ = then.where("action = 'add' AND (until IS NULL OR until > at)")
    return open_.select("entry", F.col("at").alias("since"), "until")


def filter_urls(
    captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at",
    broadcast_rows: int = 50_000, salts: int = 64,
) -> DataFrame:
    """Per capture: id, url, fetch time, host, blocked, entry and since (of what decided, else null)."""
    own = captures.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(at_col).alias("__at"))
    own = own.withColumn("__key", row_key("__id", F.coalesce(F.col("__url"), F.lit("")), F.coalesce(F.col("__at").cast("string"), F.lit(""))))
    own = own.withColumn("host", host_of(F.col("__url"))).withColumn("__path", F.regexp_extract("__url", PATH, 1))
    spans = written(intervals(entries), "list-intervals")
    # Keys deeper than any entry can't match; a URL of very many steps has no more keys than that.
    deepest = spans.agg(F.max(F.size(F.split("entry", r"\."))), F.max(F.size(F.split("entry", "/")) - 1)).first()
    labels, depth = (int(d or 1) for d in deepest)
    keyed = own.where("host IS NOT NULL").select("__key", "__at", F.explode(keys_of(F.col("host"), F.col("__path"), labels, depth)).alias("entry"))
    held = (F.col("__at") >= F.col("since")) & (F.col("until").isNull() | (F.col("__at") < F.col("until")))
    if spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = keyed.join(F.broadcast(spans), "entry").where(held)
    else:
        laid = spans.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = keyed.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(salts)).cast("int"))
        met = spread.join(laid, ["entry", "__salt"]).where(held)
    best = met.groupBy("__key").agg(F.max(F.struct(F.length("entry").alias("n"), "since", "entry")).alias("best"))
    best = best.select("__key", F.col("best.entry").alias("entry"), F.col("best.since").alias("since"))
    return own.join(best, "__key", "left").select(
        F.col("__id").alias(id_col),
        F.col("__url").alias(url_col),
        F.col("__at").alias(at_col),
        "host",
        F.col("entry").isNotNull().alias("blocked"),
        "entry",
        "since",
    )

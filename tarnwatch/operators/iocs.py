"""Indicator joins: equality, prefix, hash, time range and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.sources.scratch import written


def sized(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A broadcast of df if it has few rows, else df."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def by_name(packages: DataFrame, iocs: DataFrame) -> DataFrame:
    """Package and version against names; an indicator without versions means all of them."""
    j = packages.join(sized(iocs.where("type = 'packageName'")), F.col("package") == F.col("value"))
    return j.where((F.size("malicious_versions") == 0) | F.array_contains("malicious_versions", F.col("version")))


def by_scope(packages: DataFrame, iocs: DataFrame) -> DataFrame:
    """The scope of a package's name is the join key of a prefix match."""
    scoped = packages.withColumn("__scope", F.regexp_extract("package", r"^(@[^/]+)/", 1))
    scopes = iocs.where("type = 'packageScope'").withColumn("__scope", F.regexp_extract("value", r"^(@[^/]+)/?", 1))
    return scoped.join(sized(scopes), "__scope").where("__scope <> ''").drop("__scope")


def by_integrity(packages: DataFrame, iocs: DataFrame) -> DataFrame:
    """Packages whose name and integrity are listed together."""
    return packages.join(sized(iocs.select("package", "integrity").distinct()), ["package", "integrity"], "left_semi")


def by_hash(files: DataFrame, hashes: DataFrame, content: str, key: str = "sha256") -> DataFrame:
    """Files whose SHA-256 is listed."""
    return files.withColumn(key, F.sha2(F.col(content), 256)).join(sized(hashes.select(key).distinct()), key, "left_semi")


def by_time(events: DataFrame, windows: DataFrame, key: str, ts: str) -> DataFrame:
    """Events of a listed account inside its window, whose end may be open."""
    j = events.join(sized(windows), key)
    return j.where((F.col(ts) >= F.col("from")) & (F.col("until").isNull() | (F.col(ts) <= F.col("until"))))


#: Runs of words that needles are met by: the longest a needle has of its own, without its first and last word, which
#: may be parts of words in a text.
RUNS = (5, 3, 2, 1)
BITS = 1 << 16


def contains_any(docs: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str) -> DataFrame:
    """Documents that contain a needle, by an equi-join on hashed runs of words; each meeting is then tested whole.

    A needle of seven words or more is met by its second to sixth word, shorter ones by three, two or one word between
    their first and last. Needles with no such word (one or two words, or none) are met by four characters from their
    middle, the shortest by what they have. Before runs leave a text they are looked up in a table of BITS bits of the
    needles' hashes, so that with few needles hardly any do. Texts are read twice: for their runs, all widths at once, and,
    those met, for the test."""
    words = lambda c: F.split(c, "[^A-Za-z0-9]+")  # noqa: E731  an empty word may stand at either end, never between
    run = lambda w, i, r: F.xxhash64(F.lit(r), *[F.get(w, i + k) for k in range(r)])
    n = needles.select(needle_key, F.col(needle).alias("__n")).where("__n IS NOT NULL AND __n <> ''").withColumn("__w", F.filter(words(F.col("__n")), lambda w: w != ""))
    inner = F.size("__w") - 2
    chars = F.least(F.length("__n"), F.lit(4))
    middle = F.substring(F.col("__n"), ((F.length("__n") - chars) / 2).cast("int") + 1, chars)
    width = F.coalesce(*[F.when(inner >= r, F.lit(r)) for r in RUNS], -chars)
    hashed = F.coalesce(*[F.when(inner >= r, run(F.col("__w"), F.lit(1), r)) for r in RUNS], F.xxhash64(-chars, middle))
    n = n.select(needle_key, "__n", width.alias("__r"), hashed.alias("__k"))
    kinds = sorted(r["__r"] for r in n.select("__r").distinct().collect())  # eight at most
    d = docs.select(key, F.col(text).alias("__t")).where("__t IS NOT NULL AND __t <> ''")
    if not kinds:
        return d.select(key).join(n.select(needle_key), F.lit(False))

    def runs(r: int) -> Column:
        last = (F.size("__w") if r > 0 else F.length("__t")) - abs(r)
        one = (lambda i: run(F.col("__w"), i, r)) if r > 0 else (lambda i: F.xxhash64(F.lit(r), F.substring(F.col("__t"), i + 1, F.lit(-r))))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))

    n = written(n, "needles")
    set_ = bytearray(BITS)
    for row in n.select(F.pmod("__k", F.lit(BITS)).cast("int").alias("b")).distinct().collect():  # BITS rows at most
        set_[row["b"]] = 1
    known = lambda k: F.substring(F.lit(bytes(set_)), (F.pmod(k, F.lit(BITS)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    d_words = d.withColumn("__w", words(F.col("__t"))) if max(kinds) > 0 else d
    keyed = d_words.select(key, F.explode(F.array_distinct(F.concat(*[F.filter(runs(r), known) for r in kinds]))).alias("__k"))
    met = keyed.join(sized(n.select(needle_key, "__n", "__k")), "__k").select(key, needle_key, "__n").distinct()
    return d.join(sized(written(met, "needle-runs")), key).where(F.contains(F.col("__t"), F.col("__n"))).select(key, needle_key).distinct()

"""Look-alike names: similarity joins on keys that every pair in reach shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.operators.iocs import sized


def deletions(name: Column, most: int = 2) -> Column:
    """The name with up to two characters left out, in all ways. Names within edit distance d share one of those
    with up to d left out, so the join on them is complete."""
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    once = F.when(F.length(name) > 0, drop(name)).otherwise(F.array().cast("array<string>"))
    out = F.concat(F.array(name), once)
    if most > 1:
        out = F.concat(out, F.flatten(F.transform(once, lambda s: F.when(F.length(s) > 0, drop(s)).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(out)


#: From this length on targets are met by segments: their deletions would be too many.
LONG = 12


def segments(text: Column, of: Column, most: int, shifts: range) -> Column:
    """Hashed parts of text where a target of length `of` has its most + 1 segments, moved by each of the shifts."""
    keys = []
    for i in range(most + 1):
        begin, end = F.floor(of * i / (most + 1)).cast("int"), F.floor(of * (i + 1) / (most + 1)).cast("int")
        for k in shifts:
            inside = (begin + k >= 0) & (end + k <= F.length(text))
            keys.append(F.when(inside, F.xxhash64(of, F.lit(i), F.substring(text, begin + k + 1, end - begin))))
    return F.array_compact(F.array(*keys))


def near_names(names: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """names (name) x targets (target, ordinal) within `most` edits, not equal: name, target, ordinal, distance.

    Short targets are met by deletions. Of a long one cut into most + 1 segments, one stays whole under so many edits and
    moves by no more places, so that a name has a fixed number of keys, however long it is. Names more than `most` characters
    longer or shorter than every target get no keys. Only counted targets are broadcast, never the names: what Spark
    expects of their size doesn't know how many keys a name has."""
    hashed = lambda c: F.transform(deletions(F.col(c), most), lambda s: F.xxhash64(F.lit(0), s))
    none = F.array().cast("array<bigint>")
    near = F.flatten(F.array(*[
        F.when(F.length("name") + d >= LONG, segments(F.col("name"), (F.length("name") + d).cast("int"), most, range(-most, most + 1))).otherwise(none) for d in range(-most, most + 1)]))
    own = F.concat(F.when(F.length("name") < LONG + most, hashed("name")).otherwise(none), near)
    theirs = F.when(F.length("target") < LONG, hashed("target")).otherwise(segments(F.col("target"), F.length("target"), most, range(1)))
    lengths = targets.select(F.explode(F.sequence(F.length("target") - most, F.length("target") + most)).alias("__l")).distinct()
    within = names.select("name").distinct().join(sized(lengths), F.length("name") == F.col("__l"), "left_semi")
    left = within.select("name", F.explode(F.array_distinct(own)).alias("__k"))
    right = targets.select("target", "ordinal", F.explode(F.array_distinct(theirs)).alias("__k"))
    met = left.hint("merge").join(sized(right), "__k").select("name", "target", "ordinal").distinct()
    met = met.withColumn("distance", F.levenshtein("name", "target", most))
    return met.where((F.col("distance") >= 1) & (F.col("distance") <= most))


def best_target(pairs: DataFrame) -> DataFrame:
    """Of a name's targets the nearest, then the first listed; scored 75 at one edit and 45 at two."""
    b = pairs.groupBy("name").agg(F.min(F.struct("distance", "ordinal", "target")).alias("b")).select("name", "b.target", "b.distance")
    return b.withColumn("score", F.when(F.col("distance") == 1, 75).otherwise(45))


def first_target(pairs: DataFrame) -> DataFrame:
    """The first listed target within reach, however near the others are."""
    return pairs.groupBy("name").agg(F.min_by("target", "ordinal").alias("target"))


# Names that are copied, in the order in which they are tried, and spellings of six of them.
TOP_NAMES = [
    "lodash", "react", "express", "axios", "chalk", "vue", "typescript", "moment", "uuid", "commander", "debug", "semver", "underscore", "request", "async", "cheerio", "bluebird", "jest", "mocha", "dotenv", "glob", "minimist",
    "body-parser", "cors", "helmet", "jsonwebtoken", "socket.io", "redis", "mongoose", "sequelize", "pg", "passport", "nodemailer", "multer", "bcrypt", "winston", "luxon", "dayjs", "rxjs", "redux",
]
SPELLINGS = ["lodash|lodahs|lodash-js|lodashexe", "axios|axio|ax10s|ax1os", "react|reakt|reackt|r3act", "express|expres|expresjs|exress", "vue|vu3|vujs|vuejs", "webpack|webpak|webpackjs"]


def lookalike_dependencies(dependencies: DataFrame, top: list[str] = TOP_NAMES, shortest: int = 4) -> DataFrame:
    """dependencies (package, dependency) to those within two edits of a top name, but not equal to it: package, dependency,
    target (the first listed), distance, severity. Names of fewer than `shortest` characters are left alone."""
    own = dependencies.where(F.length("dependency") >= shortest)
    targets = own.sparkSession.createDataFrame(list(enumerate(top)), "ordinal int, target string")
    pairs = near_names(own.select(F.col("dependency").alias("name")), targets)
    first = pairs.groupBy("name").agg(F.min_by(F.struct("target", "distance"), "ordinal").alias("t")).select("name", "t.*")
    return own.distinct().join(first, F.col("dependency") == F.col("name")).select("package", "dependency", "target", "distance", F.lit("low").alias("severity"))


def lockfile_lookalikes(packages: DataFrame) -> DataFrame:
    """Entries of lockfiles (path, name) that are spelt like, or are, one of six copied names: path, name, spelling,
    severity. The names themselves count too."""
    hits = F.array_compact(F.array(*[F.when(F.lower("name").rlike(f"^({p})$"), F.lit(p.split("|")[0])) for p in SPELLINGS]))
    return packages.select("path", "name", F.explode(hits).alias("spelling"), F.lit("high").alias("severity"))


# Characters that look like others.
SWAPS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "@": "a"}


def skeleton(name: Column) -> Column:
    return F.translate(name, "".join(SWAPS), "".join(SWAPS.values()))


def homoglyphs(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Names that differ from a target of their length in look-alike characters only: 1 - swaps / length."""
    theirs = targets.select("target", skeleton(F.col("target")).alias("__s"))
    j = names.select("name", skeleton(F.col("name")).alias("__s")).hint("merge").join(sized(theirs), "__s")
    j = j.where("name <> target AND length(name) = length(target)")
    swaps = F.size(F.filter(F.zip_with(F.split("name", ""), F.split("target", ""), lambda a, b: a != b), lambda x: x))
    return j.select("name", "target", F.round(1 - swaps / F.length("name"), 4).alias("score"))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with up to four characters of common beginning at 0.1 each."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(matched, [c for c, t in zip(b, taken, strict=True) if t], strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def jaro_winkler_best(names: DataFrame, targets: DataFrame, least: float = 0.82, most_targets: int = 10_000) -> DataFrame:
    """Per name the best of a short fixed list of targets, at `least` or more; equal but for case is left out.

    The list goes to every task, so its size is checked."""
    known = [r["target"] for r in targets.select("target").distinct().orderBy("target").limit(most_targets + 1).collect()]
    if len(known) > most_targets:
        raise ValueError("too many targets for a list that goes to every task")

    def counts(name: str) -> np.ndarray:
        return np.bincount([ord(c) % 64 for c in name.lower()], minlength=64)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.array([counts(t) for t in known]).reshape(len(known), 64)
        length = table.sum(axis=1)
        for pdf in batches:
            out = []
            for n in pdf["name"]:
                # No more characters can match than the two have in common, so most targets fall away at once.
                own = counts(n)
                common = np.minimum(table, own).sum(axis=1)
                jaro = (common / np.maximum(length, 1) + common / max(len(n), 1) + 1) / 3
                near = np.flatnonzero(jaro + 0.4 * (1 - jaro) >= least - 1e-6)
                best = max(((round(jaro_winkler(n.lower(), known[k].lower()), 6), known[k]) for k in near.tolist() if known[k].lower() != n.lower()), key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=None)
                if best and best[0] >= least:
                    out.append((n, best[1], best[0]))
            yield pd.DataFrame(out, columns=["name", "target", "score"])

    return names.select("name").distinct().mapInPandas(work, "name string, target string, score double")


def token_simhash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """32-bit simhash of lower-cased white-space tokens by the djb2 hash, bit by bit as an aggregate."""
    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c))
    hashed = F.aggregate(codes(F.col("token")), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = docs.select(key, F.explode(F.split(F.lower(F.trim(text)), r"\s+")).alias("token")).where("token <> ''")
    counted = tokens.groupBy(key, "token").agg(F.count("*").alias("n")).withColumn("h", hashed)
    bits = [F.sum(F.col("n") * (F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1)).alias(f"b{b}") for b in range(32)]
    g = counted.groupBy(key).agg(*bits)
    out = sum((F.when(F.col(f"b{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(32)), F.lit(0).cast("long"))
    return g.select(key, out.alias("simhash"))


def simhash_neighbours(hashes: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """Pairs of documents at `least` similarity (1 - bits / 32), each with the class of its first (`class_id`: the
    smallest key of its hash) and the class's size (`copies`), and one row per document with its class and links.

    `kind` tells them apart. "pair": two classes, by their smallest keys, that agree on two of five blocks of bits: three
    differing bits leave two blocks whole, so each hash is filed under ten patterns of some 13 bits. "member": `other` is the document's class, at 1.0, and
    `links` how many classes that class is paired with. Rows grow with documents and linked classes, not with a
    class's square: documents of one class are all alike, and those of paired classes as their hashes are."""
    assert (1 - least) * 32 < 4
    reps = hashes.groupBy("simhash").agg(F.min(key).alias(key), F.count("*").alias("copies"))
    parts = [0x7F, 0x7F << 7, 0x3F << 14, 0x3F << 20, 0x3F << 26]
    masks = [parts[i] | parts[j] for i in range(5) for j in range(i)]
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), F.col("simhash").bitwiseAND(F.lit(m).cast("long")).alias("v")) for b, m in enumerate(masks)])
    filed = reps.select("simhash", key, "copies", F.explode(blocks).alias("f")).select("simhash", key, "copies", "f.b", "f.v")
    o = filed.select(F.col("simhash").alias("other_hash"), F.col(key).alias("other"), "b", "v")
    bits = F.bit_count(F.col("simhash").bitwiseXOR(F.col("other_hash")))
    p = filed.join(o, ["b", "v"]).where((F.col("simhash") < F.col("other_hash")) & (1 - bits / 32 >= least))
    p = p.select("simhash", "other_hash", key, "other", "copies", F.round(1 - bits / 32, 4).alias("similarity")).distinct()
    ends = p.select(F.explode(F.array("simhash", "other_hash")).alias("simhash")).groupBy("simhash").agg(F.count("*").alias("links"))
    classes = reps.join(ends, "simhash", "left").select("simhash", F.col(key).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    members = hashes.select(key, "simhash").join(classes, "simhash")
    pairs = p.select(key, "other", "similarity", F.lit("pair").alias("kind"), F.col(key).alias("class_id"), "copies", F.lit(None).cast("long").alias("links"))
    own = members.select(key, F.col("class_id").alias("other"), F.lit(1.0).alias("similarity"), F.lit("member").alias("kind"), "class_id", "copies", "links")
    return pairs.unionByName(own)

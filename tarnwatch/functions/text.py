"""Column functions over file contents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(content: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text, null for null. Arrow batches of texts, each counted by
    a sort of its code points in numpy: built-in functions would make a string of every character."""

    def of(texts: pd.Series) -> pd.Series:
        import numpy as np

        def bits(text: str | None) -> float | None:
            if text is None:
                return None
            n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1] / max(len(text), 1)
            return float(-(n * np.log2(n)).sum()) + 0.0

        return texts.map(bits).astype("float64")

    return F.pandas_udf(of, "double")(content)


def entropy_of_short(content: Column) -> Column:
    """As entropy(), of short strings inside other column functions (elements of arrays)."""
    n = F.length(content)
    share = lambda c: (n - F.length(F.replace(content, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(content, "")), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))).otherwise(0.0)


def is_minified(content: Column) -> Column:
    """100 characters or more, and long lines, or ten names or more that are short on average."""
    names = F.regexp_extract_all(content, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))
    letters = F.aggregate(names, F.lit(0), lambda a, x: a + F.length(x))
    lines = F.length(content) - F.length(F.regexp_replace(content, "\n", "")) + 1
    long_lines = (lines <= 3) & (F.length(content) > 1000)
    short_names = (F.size(names) >= 10) & (letters < F.size(names) * 3)
    return (F.length(content) >= 100) & (long_lines | short_names)


def line_of(content: Column, pattern: str) -> Column:
    """The line of a pattern's first match, from 1; 0 without one."""
    at = F.regexp_instr(content, F.lit(pattern))
    before = F.substring(content, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.regexp_replace(before, "\n", "")) + 1).otherwise(0)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"https?://([^/:?#\s\"'<>]+)", 1))


# Suffixes, names and ranges that only resolve inside a network.
INTERNAL_SUFFIX = r"(?i)\.(internal|local|corp|intra|priv|lan)([.:/]|$)"
CORPORATE = r"(?i)github-ent|jira-ent|github\.enterprise|internal-gitlab|gitlab\.internal|jenkins\.internal|confluence\.internal"
PRIVATE_RANGE = r"^(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})"


def is_internal_host(h: Column) -> Column:
    return h.rlike(INTERNAL_SUFFIX) | h.rlike(CORPORATE) | h.rlike(PRIVATE_RANGE)


def repo_url(url: Column) -> Column:
    """Repository addresses in one form."""
    u = F.lower(F.trim(url))
    u = F.regexp_replace(u, r"^git\+", "")
    u = F.regexp_replace(u, r"^(ssh://)?git@([^:/]+)[:/]", "https://$2/")
    u = F.regexp_replace(u, r"^git://", "https://")
    return F.regexp_replace(F.regexp_replace(u, r"\.git$", ""), r"/+$", "")


def semver_part(version: Column, i: int) -> Column:
    """A number of a strict three-part version; null for anything else."""
    return F.when(version.rlike(r"^v?\d+\.\d+\.\d+$"), F.regexp_replace(F.split_part(version, F.lit("."), F.lit(i)), "^v", "").cast("long"))


def version_score(version: Column) -> Column:
    return semver_part(version, 1) * 10000 + semver_part(version, 2) * 100 + semver_part(version, 3)


def magic(content: Column) -> Column:
    """The kind of executable that the first bytes of a binary column tell."""
    head = F.substring(F.hex(content), 1, 8)
    # The magic numbers of the formats.
    return (
        F.when(head == "7F454C46", "elf").when(F.substring(head, 1, 4) == "4D5A", "pe").when(head == "0061736D", "wasm")
        .when(head.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"), "mach-o").when(head == "CAFEBABE", "fat")
    )


def glob(pattern: str) -> str:
    """A path glob as an anchored regular expression: * stays in one segment, ** does not."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + (pattern[i] if pattern[i].isalnum() or pattern[i] in "/_-" else "\\" + pattern[i]), i + 1
    return out + "$"


# Paths of build output and of tests, and the hosts that packages are commonly served from.
DIST_BUILD = r"/dist/|/build/|/bundle|/min/|\.min\.js$|\.bundled?\.js$"
TEST_FIXTURE = r"/test/|/tests/|/__tests__/|/spec/|\.test\.js$|\.spec\.js$|fixtures?"
SAFE_DOMAINS = [
    "registry.npmjs.org", "cdn.jsdelivr.net", "unpkg.com", "cdn.skypack.dev", "esm.sh", "deno.land", "raw.githubusercontent.com", "github.com", "npmjs.com",
    "nodejs.org", "v8.dev", "typescriptlang.org",
]
IDENTIFIER = r"\b[a-zA-Z_$][\w$]*\b"


def is_dist_build(path: Column) -> Column:
    return path.rlike(DIST_BUILD)


def is_test_fixture(path: Column) -> Column:
    return path.rlike(TEST_FIXTURE)


def first_host(content: Column) -> Column:
    """The host of the first address in a text, port and account included; null without one."""
    return F.nullif(F.regexp_extract(content, r"https?://([^/'\"\s]+)", 1), F.lit(""))


def is_safe_domain(domain: Column) -> Column:
    """A listed host or one below it; false for null."""
    return F.coalesce(domain.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in SAFE_DOMAINS) + ")$"), F.lit(False))


def domain_matches(domain: Column, pattern: Column) -> Column:
    """A pattern whose * stands for anything; its dots match any character, as they always did."""
    return F.regexp_like(domain, F.concat(F.lit("^"), F.replace(pattern, F.lit("*"), F.lit(".*")), F.lit("$")))


def _mean_identifier(content: Column) -> Column:
    """Mean length of the names in a text; null without any."""
    names = F.regexp_extract_all(content, F.lit(IDENTIFIER), F.lit(0))
    return F.when(F.size(names) > 0, F.aggregate(names, F.lit(0), lambda a, x: a + F.length(x)) / F.size(names))


def is_dense(content: Column) -> Column:
    """Short names on average, or an entropy above 5.5."""
    return F.coalesce(_mean_identifier(content) < 3, F.lit(False)) | (entropy(content) > 5.5)


def is_obfuscated(content: Column) -> Column:
    """One run without spaces that is a call or has short names, hex escapes, a long base64 literal, or high entropy."""
    one_run = ~F.trim(content).rlike(r"\s")
    call = F.trim(content).rlike(r"^[a-zA-Z_$][\w$]*\([^)]*\)$")
    return (F.length(content) > 0) & (
        (one_run & (F.coalesce(_mean_identifier(content) < 3, F.lit(False)) | call))
        | content.rlike(r"0x[0-9a-fA-F]{2,}|\\x[0-9a-fA-F]{2}") | content.rlike(r"['\"`][A-Za-z0-9+/]{20,}={0,2}['\"`]") | (entropy(content) > 5.5)
    )


# How a payload is encoded, by the first sign that matches.
ENCODINGS = [
    ("hex", r"Buffer\.from\(['\"][0-9a-fA-F]+['\"],\s*['\"]hex['\"]\)"), ("base64", r"atob\("), ("base64", r"btoa\("),
    ("base64", r"Buffer\.from\([A-Za-z0-9+/=]{10,}"), ("charcode", r"String\.fromCharCode\("),
]


def encoding_type(content: Column) -> Column:
    return F.coalesce(*[F.when(content.rlike(p), F.lit(n)) for n, p in ENCODINGS], F.lit("unknown"))


def decode_preview(content: Column) -> Column:
    """The first 80 characters of the first literal that atob or a hex buffer would decode; null without one."""
    def shown(raw: Column) -> Column:
        return F.when(F.length(raw) > 80, F.concat(F.left(raw, F.lit(80)), F.lit("..."))).otherwise(raw)

    b64 = lambda call: F.try_to_binary(F.nullif(F.regexp_extract(content, call + r"\(['\"]([A-Za-z0-9+/=]{10,})['\"]\)", 1), F.lit("")), F.lit("base64"))
    hexed = F.unhex(F.nullif(F.regexp_extract(content, r"Buffer\.from\(['\"]((?:[0-9a-fA-F]{2})++)['\"],\s*['\"]hex['\"]\)", 1), F.lit("")))
    return F.coalesce(*[shown(x.cast("string")) for x in (b64("atob"), hexed, b64("btoa"))])


def zero_width(content: Column) -> Column:
    """Positions, from 0, of characters without width (U+200B to U+200D, U+FEFF)."""
    chars = F.split(content, "")
    at = F.transform(chars, lambda c, i: F.when(c.isin("\u200b", "\u200c", "\u200d", "\ufeff"), i))
    return F.when(content.rlike("[\u200b-\u200d\ufeff]"), F.array_compact(at)).otherwise(F.array().cast("array<int>"))


def lenient_part(version: Column, i: int) -> Column:
    """A number of a version that may begin with ~ or ^ and end in other characters; null unless three parts are numbers."""
    parts = [F.regexp_extract(F.split_part(F.regexp_replace(version, r"^[~^]", ""), F.lit("."), F.lit(k)), r"^\s*([+-]?\d+)", 1) for k in (1, 2, 3)]
    known = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(known, parts[i - 1].try_cast("long"))


def inflation(current: Column, previous: Column, age_days: Column) -> Column:
    """Which part of a version jumped (major by more than 10, minor 20, patch 50); null if none, or within a week of age."""
    jump = lambda i: lenient_part(current, i) - lenient_part(previous, i)
    kind = F.when(jump(1) > 10, "major").when(jump(2) > 20, "minor").when(jump(3) > 50, "patch")
    return F.when(age_days.isNull() | (age_days >= 7), kind)


def release(version: Column) -> Column:
    """A Python version's first three numbers as a struct that compares; what is missing is 0; null if none."""
    nums = F.regexp_extract_all(F.regexp_extract(version, r"^\s*v?(\d+(?:\.\d+)*+)", 1), F.lit(r"(\d+)"), F.lit(1))
    part = lambda i: F.coalesce(F.try_element_at(nums, F.lit(i)).cast("long"), F.lit(0).cast("long"))
    return F.when(F.size(nums) > 0, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("micro")))


def normal_path(path: Column) -> Column:
    """A path without empty and . parts, with .. resolved as far as there is a folder above."""
    none = F.array().cast("array<string>")
    fold = F.aggregate(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), none,
        lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x))),
    )
    return F.array_join(fold, "/")

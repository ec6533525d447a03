"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm import byte_bpe, centroids, exact_dedup, language_id, mixing, packing, pii, prefix_trie, progressive_jpeg, quality, simhash, toxicity, url_filter
from tarnwatch.llm.common import crc_mod
from tarnwatch.sources.tables import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def captures(pages: DataFrame) -> DataFrame:
    """pages have no fetch time; a day of 2024 by the page's id stands in for it."""
    return pages.withColumn("fetched_at", F.timestamp_add("DAY", (F.col("page_id") % 365).cast("int"), F.lit("2024-01-01").cast("timestamp")))


def url_lists(pages: DataFrame) -> DataFrame:
    """No list comes with the tables: hosts of some lengths are listed and taken off again, one domain is listed for
    a month, and one path of every fourth host throughout."""
    host = url_filter.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host IS NOT NULL").distinct().withColumn("n", F.length("host"))
    day = lambda d: F.timestamp_add("DAY", d.cast("int"), F.lit("2024-01-01").cast("timestamp"))
    some, off = hosts.where("n % 5 = 0"), hosts.where("n % 10 = 0")
    one = hosts.sparkSession.range(1)
    return (
        some.select(F.col("host").alias("entry"), F.lit("add").alias("action"), day(F.col("n") * 7 % 200).alias("at"))
        .unionByName(off.select(F.col("host").alias("entry"), F.lit("remove").alias("action"), day(F.col("n") * 7 % 200 + 90).alias("at")))
        .unionByName(hosts.where("n % 4 = 1").select(F.concat("host", F.lit("/en")).alias("entry"), F.lit("add").alias("action"), day(F.lit(30)).alias("at")))
        .unionByName(one.select(F.lit("example.org").alias("entry"), F.lit("add").alias("action"), day(F.lit(250)).alias("at")))
        .unionByName(one.select(F.lit("example.org").alias("entry"), F.lit("remove").alias("action"), day(F.lit(280)).alias("at")))
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(captures(pages), url_lists(pages))


def tokenizer() -> tuple[str, str]:
    """Where the public ranks are, and the pattern that goes with them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_plan(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2)
    found = language_id.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = progressive_jpeg.media_column(table(spark, sf_dir, "documents"), tensors=False)
    payload = F.col("payload")
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_mix": op7_mix,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_progressive_jpeg": op10_progressive_jpeg,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
}

#: CRC-32 of a number's digits, bit by bit: a byte enters with the first of its eight steps.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda s: [ord(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"""

_TRIE = f"""WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS points, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.token, t.points, t.i FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, t.token, t.points, t.i FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
m AS (
  SELECT conv_id AS conv, row_number() OVER w AS d, sha256(string_agg(token, '') OVER w) AS key, points FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (SELECT d, key, min(conv) AS conv_id, count(*) AS n, max(points) AS points FROM m GROUP BY d, key),
up AS (SELECT n.d, n.key, p.key AS parent FROM node n JOIN m p ON p.conv = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM up GROUP BY ALL),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n - 1) * points AS saved FROM node LEFT JOIN kids USING (d, key)),
below AS (
  SELECT a.d, a.key, sum((o.n_children = 0)::INT)::BIGINT AS n_leaves, sum(o.saved)::BIGINT AS saved_tokens
  FROM own o JOIN m a ON a.conv = o.conv_id AND a.d <= o.d GROUP BY a.d, a.key),
ends AS (
  SELECT d, key, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) AS ids
  FROM (SELECT conv, max(d) AS d, arg_max(key, d) AS key FROM m GROUP BY conv) GROUP BY d, key)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own o JOIN below USING (d, key) LEFT JOIN ends USING (d, key) LEFT JOIN up ON up.d = o.d AND up.key = o.key
LEFT JOIN node p ON p.d = o.d - 1 AND p.key = up.parent"""


def _centroid_sql(k: int = 16, rounds: int = 3) -> str:
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: isfinite(e) AND abs(e) < 2097152))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), vec_id, x) - 1 AS c, x FROM kept QUALIFY c < {k})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS (SELECT v.r, v.vec_id, any_value(v.x) AS x, arg_min(c.c, {near} * {k} + c.c) AS c, min({near})::BIGINT AS distance FROM kept v, c{n} c GROUP BY v.r, v.vec_id)")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY c, i),
c{n + 1} AS (SELECT c, coalesce(m.x, c{n}.x) AS x FROM c{n} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{n} GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"

ORACLE = {
    "op11_prefix_trie": _TRIE,
    "op12_centroids": _centroid_sql(),
    "op3_url_filter": f"""WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 365 AS INT)) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.+$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '{_PATH}', 1), '/'), lambda s: s <> '') AS steps FROM pages),
h AS (SELECT DISTINCT host, length(host) AS n FROM c WHERE host IS NOT NULL),
changes AS (
  SELECT host AS entry, 'add' AS action, n * 7 % 200 AS d FROM h WHERE n % 5 = 0
  UNION ALL SELECT host, 'remove', n * 7 % 200 + 90 FROM h WHERE n % 10 = 0
  UNION ALL SELECT host || '/en', 'add', 30 FROM h WHERE n % 4 = 1
  UNION ALL SELECT 'example.org', 'add', 250 UNION ALL SELECT 'example.org', 'remove', 280),
spans AS (
  SELECT entry, since, until FROM (
    SELECT entry, action, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT)) AS since,
      lead(TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT))) OVER (PARTITION BY entry ORDER BY d, action) AS until FROM changes)
  WHERE action = 'add'),
met AS (
  SELECT c.page_id, arg_max(s.entry, (length(s.entry), s.since)) AS entry, max((length(s.entry), s.since)) AS k
  FROM c JOIN spans s ON (c.host = s.entry OR ends_with(c.host, '.' || s.entry)
      OR starts_with(c.host || '/' || array_to_string(c.steps, '/') || '/', s.entry || '/') AND contains(s.entry, '/'))
    AND c.fetched_at >= s.since AND (s.until IS NULL OR c.fetched_at < s.until)
  GROUP BY c.page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host, m.entry IS NOT NULL AS blocked, m.entry, m.k[2] AS since
FROM c LEFT JOIN met m USING (page_id)""",
    "op1_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}

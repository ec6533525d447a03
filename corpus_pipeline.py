"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and
read again as the docs of the next. All but the last return the columns of docs. Ids may repeat after mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwatch.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from tarnwatch.llm.common import crc_mod, text_or_empty, written
from tarnwatch.llm.queries import tokenizer
from tarnwatch.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    # Columns of docs get reserved names meanwhile, so none can clash with those of the operator.
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    keep = [n for c, n in names.items() if c != "doc_id"]
    scored = toxicity.score(own, model, names["doc_id"], names["text"], keep=keep)
    return scored.where("predicted = 0").select(*[scored[n].alias(c) for c, n in names.items()])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the bytes they decode to checked against the text."""
    coded = byte_bpe.round_trip(docs.withColumn("__whole", text_or_empty("text")), *tokenizer(), text_col="__whole", keep=("lang", "source", "text"))
    same = coded["decoded"] == text_or_empty("text").cast("binary")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Models, hash links and token merges: no SQL for all stages together. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Every registered query outside the llm subpackage that has SQL, held against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tarnwatch.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(df: pd.DataFrame) -> list[tuple]:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        else:
            out[c] = out[c].map(lambda x: "null" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
    return sorted(map(tuple, out.astype(str).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_words_of_prompt_injection_turns(spark, tmp_path):
    """Letters beyond ASCII and marks end a word; capitals that lower to ASCII count."""
    beside = ["", " ", "_", "7", "x", "X", "-", "\u00f1", "\u00c9", "\u0301", "\u0130", "\u212a", "\u200b", "\u00df", "\u4e2d", "\U0001f600", "\U0001d4d0", "\u0660", "\u203f", "\n"]
    texts = [a + w + b for w in ("sudo", "BASH", "the", "Of") for a in beside for b in beside]
    texts += [None, "", "\u0130GNORE all \u0130nstruct\u0130ons", "D\u0130sregard", "d\u0131sregard", "i\u0307gnore all instructions", "disregard\u0301", "e\u0301of", "sudoe\u0301 x"]
    pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "role": "user", "text": texts}).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    got, want = catalog.QUERIES["prompt_injection_turns"](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLE["prompt_injection_turns"]).df()
    assert canonical(got) == canonical(want)


def test_oracle_names_are_queries():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

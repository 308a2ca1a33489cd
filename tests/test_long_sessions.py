"""Queries of sessions whose lists outgrow their limit give the rows that the SQL gives."""

import duckdb
from pyspark.sql import functions as F
from test_oracle import SQL, canonical

import __spark_entry__


def test_what_a_full_list_pushed_out_is_gone(spark, tmp_path):
    """Twenty users of two hundred events each, with carts of over twenty products of which some are removed."""
    drawn = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("signup", "signup", "signup", "error", "error", "view", "purchase")]), (drawn(1, 7) + 1).cast("int"))
    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") % 20).alias("user_id"), kinds.alias("event_type"),
        drawn(2, 100).cast("double").alias("value"), F.concat(F.lit('{"k": '), drawn(3, 100).cast("string"), F.lit("}")).alias("props"),
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["session_state"])
    names = [c[0] for c in want.description]
    got = __spark_entry__.queries()["session_state"](spark, str(tmp_path)).collect()
    assert len(got) == 20
    assert canonical([tuple(r) for r in got], got[0].__fields__) == canonical(want.fetchall(), names)

"""Queries against their SQL over small tables with the keys of large ones."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__


def against_sql(spark, folder, name):
    """(rows of the query, rows of its SQL), sorted."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    return sorted(found, key=str), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)


def orders(spark, folder, keys):
    rows = [(k, k % 7, "FOP"[k % 3], k / 4, dt.datetime(1996, 3, 1 + k % 28), f"{1 + k % 5}-X") for k in keys]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, names).write.parquet(str(folder / "orders.parquet"))


def test_migrated_with_keys_over_a_million(spark, tmp_path):
    orders(spark, tmp_path, [0, 5, 10, 11, 1000005, 1000010, 2000010])
    found, expected = against_sql(spark, tmp_path, "migrated")
    assert found == expected and {r[3] for r in found} == {13}


def test_missing_sources_of_orders_that_share_six_digits(spark, tmp_path):
    orders(spark, tmp_path, [28, 29, 2800028, 2800029, 2800030, 2800031])  # the last four have the same id in part
    found, expected = against_sql(spark, tmp_path, "missing_sources")
    assert found == expected and len(found) == 3


def test_pairs_of_a_key_are_no_rows(spark):
    from corpusmill.operators import neardup

    rng = random.Random(5)
    codes = {rng.getrandbits(40) << 24: i for i in range(3000) for _ in [0]}  # all agree on the lowest bands, few are near
    df = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for c, i in codes.items()], "id long, code long")
    pairs = neardup.near_pairs(df, "id", "code", 5)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("Join") <= 2  # the keys' sizes; codes meet as arrays
    value = list(codes)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, j) for i in range(3000) for j in range(i + 1, 3000) if (value[i] ^ value[j]).bit_count() <= 5}


def test_parts_of_a_fold_in_order(spark, monkeypatch):
    from corpusmill.operators import neardup

    monkeypatch.setattr(neardup, "PART", 8)  # eight parts
    rng = random.Random(3)
    codes = [rng.getrandbits(12) << 3 for _ in range(600)]
    rows = [(i, c, i % 2) for i, c in enumerate(codes)]
    kept = {0: [], 1: []}
    for i, c, g in rows:
        if all((c ^ codes[k]).bit_count() > 2 for k in kept[g]):
            kept[g].append(i)
    asked = []
    monkeypatch.setattr(neardup, "first_of_each", lambda pairs, by, real=neardup.first_of_each: asked.append(pairs.count()) or real(pairs, by))
    got = neardup.keep_greedy(spark.createDataFrame(rows, "id long, code long, g int"), "g", "id", "code", 2).collect()
    assert {(r["g"], r["id"]) for r in got} == {(g, i) for g in kept for i in kept[g]}
    assert len(asked) == 8 and sum(asked) < neardup.near_pairs(spark.createDataFrame(rows, "id long, code long, g int"), "id", "code", 2, by=["g"]).count() / 5


def test_word_codes_deal_a_row_a_text(spark):
    import hashlib

    from corpusmill.operators import neardup

    texts = ["Aa bb\tÉté x\x0bbb  cc\n", "", None, "one", " \n", "bb " * 70000 + "aa"]
    df = spark.createDataFrame([*enumerate(texts), (3, "two three")], "id long, text string")  # words of rows with one key count together
    got = {r["id"]: r["code"] & (2**64 - 1) for r in neardup.token_hash(df, "id", "text").collect()}

    def code(words):
        seen = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in seen) > len(seen))

    assert got == {0: code(["aa", "bb", "été x", "bb", "cc"]), 3: code(["one", "two", "three"]), 5: code(["bb", "bb", "aa"])}
    plan = neardup.token_hash(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def batch_bytes(spark, df, column):
    """The most characters that Python is given at once."""
    sizes = df.select(column).mapInPandas(lambda it: (p.assign(n=p[column].str.len().sum())[["n"]][:1] for p in it), "n long")
    return sizes.agg({"n": "max"}).first()[0]


def test_pages_go_to_python_in_batches_of_bytes(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    page = F.concat(F.lit("<p>one</p><script>"), F.repeat(F.lit("x"), 100_000), F.lit("</script><p>two</p>"))
    spark.range(300).select(F.col("id").alias("page_id"), page.alias("html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = __spark_entry__.queries()["page_texts"](spark, str(tmp_path))
    assert found.filter("n = 7").count() == 300
    assert batch_bytes(spark, spark.read.parquet(str(tmp_path / "pages.parquet")), "html") < 8_000_000


def test_texts_go_to_python_in_batches_of_bytes(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("ab"), 50_000))
    spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(3).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "labels.parquet"))
    found = __spark_entry__.queries()["ocr_gate"](spark, str(tmp_path))
    assert found.first()["total"] == 300
    assert batch_bytes(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "text") < 8_000_000


def test_few_keys_come_in_slices_of_time(spark, tmp_path, monkeypatch):
    from corpusmill.plans import stream_queries

    rng = random.Random(9)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(200_000)), rng.randrange(60), "ab"[i % 2], 1.0, '{"k": 1}') for i in range(2000)]
    names = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stream_queries, "SLICE", 600)
    seen = []
    stream = stream_queries.in_order(spark, str(tmp_path))
    each = lambda df, _: seen.append(tuple(df.agg(F.count("*"), F.min("created_at"), F.max("created_at")).first()))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    assert len(seen) == 4 and sum(n for n, _, _ in seen) == 2000 and max(n for n, _, _ in seen) <= 600
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
    for name in ("stream_new_events", "stream_throttled"):
        found, expected = ([sorted(map(str, r)) for r in rows] for rows in against_sql(spark, tmp_path, name))  # columns come in another order
        assert sorted(found) == sorted(expected) and found


def test_render_lists_in_parts_of_rows(spark, tmp_path, monkeypatch):
    from corpusmill.plans import record_queries

    rng = random.Random(2)
    orders(spark, tmp_path, range(900))
    items = [(rng.randrange(1000), float(rng.randrange(60)), rng.choice("RNA")) for _ in range(2000)]
    spark.createDataFrame(items, "l_orderkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(record_queries, "PART", 100)
    found, expected = against_sql(spark, tmp_path, "render_lists")
    assert found == expected and {r[0] for r in found} >= {"backfill", "figures"}
    plan = __spark_entry__.queries()["render_lists"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    parts = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert parts and all(", 20), REPARTITION_BY_NUM" in line for line in parts)


def test_text_metrics_round_halves_as_their_sql(spark, tmp_path):
    halves = [(41, 640), (323, 640), (333, 1280), (201, 3200), (803, 3200), (1, 128), (5, 640), (2000, 16000)]
    rows = [(i, "é" * k + "".join(chr(33 + j % 15) for j in range(n - k))) for i, (k, n) in enumerate(halves)]  # k letters of n characters
    rows += [(101, ""), (102, None), (None, "text"), (103, "b b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found, expected = against_sql(spark, tmp_path, "text_metrics")
    assert list(map(repr, found)) == list(map(repr, expected))  # nan is no equal of itself
    assert {r[0] for r in found} == {*range(8), 101, 103} and (1, 640, 0.504687, 0.504687) in found

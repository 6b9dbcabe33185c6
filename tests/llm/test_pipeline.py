from __future__ import annotations

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        now = [r[0] for r in out.select("doc_id").collect()]
        assert set(now) <= ids and len(now) == len(set(now)), name
        if name != "tokens":
            assert out.columns == columns, name
        if name in ("lines", "mix", "tokens"):
            assert set(now) == ids, name
        docs, ids = out, set(now)
    assert ids


def test_result_shows_the_schedule(spark):
    rows = [(i, f"text {i}", "en", "a" if i < 400 else "b", 8) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.mix(spark, docs.repartition(7), SF)
    got = sorted(corpus_pipeline.tokens(spark, docs, SF).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(500))
    assert {r["doc_id"] for r in got} == set(range(500))
    placed, slots = {"a": 0, "b": 0}, []
    for r in got:  # weights are 20 and 10, until the seven blocks of b are placed
        if r["slot"] not in slots:
            slots.append(r["slot"])
            placed[r["source"]] += 1
            assert placed["b"] == 7 or abs(placed["a"] - len(slots) * 2 / 3) < 1
    assert slots == list(range(25 + 7))


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, an extra column, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, slots string"
    rows = [
        (1, "a plain line of text that is long enough to be a line\nand one more of them", "en", "a", 70, "x"),
        (1, "a plain line of text that is long enough to be a line\nand one more of them", "en", "a", 70, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "x"),
        (4, "word " * 5000, "en", "b", 25000, "x"),
        (None, "nobody's text", "en", "b", 13, "x"),
    ]
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            if name != "quality":
                assert docs.count() == (len(kept) if given else 0), name
            else:
                docs = spark.createDataFrame(given, schema)  # the others take all rows, whatever it rejects
                kept = given
            path = str(tmp_path / f"{name}-{len(given)}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        assert "piece_ids" in docs.columns and "slots" in docs.columns
    with pytest.raises(ValueError):
        corpus_pipeline.mix(spark, docs.withColumn("__row", docs.doc_id), sf)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_runs_own_their_scratch(spark, tmp_path):
    def folders():
        return set(os.listdir(root)) if os.path.isdir(root) else set()

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = folders()
    first = corpus_pipeline.run(spark, SF)
    kept = folders() - before
    with corpus_pipeline.pipeline_run(spark, SF) as second:
        n = second.count()
        assert first.count() == n > 0  # interleaved: neither deletes what the other reads
        third = corpus_pipeline.run(spark, SF)
        assert second.count() == n
    assert first.count() == third.count() == n
    # a run keeps what its last stage reads alone
    assert kept and not any(name in f for f in kept for name in ("quality", "lines", "near_copies", "census", "signatures", "places"))
    assert all(os.path.isdir(f"{root}/{f}") for f in kept)
    assert len(folders() - before) == 2 * len(kept)

"""Operators on hand-made rows that carry their edge rules."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import catalog, neardup, quality, reconcile, search, usage, workset
from corpusmill.sources import io


def at(text):
    return dt.datetime.fromisoformat(text)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


NOW = "2024-06-10 12:00:00"


@pytest.fixture
def now(spark):
    return F.lit(NOW).cast("timestamp")


# catalogue -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def papers(spark):
    rows = [
        (1, "Deep networks", at("2024-01-05"), True, "pass"), (2, "Graph theory", at("2024-02-29T23:59:59"), False, "pass"), (3, "Failed", at("2024-02-01"), True, "fail"),
        (4, "Undated networks", None, None, "pass"), (5, "Old deep networks", at("2020-01-01"), True, "pass"), (6, "Twin", at("2024-01-05"), False, "pass"),
    ]
    return spark.createDataFrame(rows, "id long, title string, date timestamp, has_figures boolean, qa_status string")


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([(1, "AI"), (1, "CS"), (2, "Math"), (3, "AI"), (5, "AI"), (4, "CS")], "paper_id long, subject string")


@pytest.fixture(scope="module")
def taxonomy(spark):
    rows = [("comp", 1, True, 1, "AI"), ("comp", 1, True, 2, "CS"), ("math", 2, False, 3, "Math"), ("bio", 3, False, 4, "Bio")]
    return spark.createDataFrame(rows, "category_id string, category_order int, pinned boolean, position int, subject string")


def test_filters(papers, subjects, taxonomy):
    ask = lambda **k: sorted(ids(catalog.query_papers(papers, subjects, taxonomy, **k)))
    assert ask() == [1, 2, 4, 5, 6]
    assert ask(category="comp") == [1, 4, 5]
    assert ask(category="none") == []
    assert ask(category="comp", wanted=["Math"]) == [2]
    assert ask(date_from="2024", date_to="2024-02") == [1, 2, 6]
    assert ask(date_from="nonsense", date_to=" ") == [1, 2, 4, 5, 6]
    assert ask(has_figures=True) == [1, 5]
    assert ask(search="  ") == [1, 2, 4, 5, 6]
    assert ask(search="network deep") == [1, 5]


def test_pages_put_undated_first_and_clamp(papers):
    passed = papers.filter("qa_status = 'pass'")
    assert ids(catalog.page_of(passed, 0, 3)) == [4, 2, 1]
    assert ids(catalog.page_of(passed, 2, 3)) == [6, 5]
    assert tuple(catalog.page_counts(passed, 2).first()) == (5, 3)
    assert ids(catalog.paper(papers, 3)) == []


def test_facets_count_double(papers, subjects, taxonomy):
    counts = catalog.subject_counts(papers, subjects)
    assert dict(map(tuple, counts.collect())) == {"AI": 2, "CS": 2, "Math": 1}
    totals = catalog.category_totals(counts, taxonomy)
    assert {r["category_id"]: r["total"] for r in totals.collect()} == {"comp": 4, "math": 1, "bio": 0}
    assert dict(map(tuple, catalog.category_papers(papers, subjects, taxonomy).collect())) == {"comp": 3, "math": 1}
    assert {r["category_id"]: [s["subject"] for s in r["subjects"]] for r in catalog.facets(counts, taxonomy).collect()} == {"comp": ["AI", "CS"], "math": ["Math"]}
    assert sorted(ids(catalog.top_categories(totals, 3), "category_id")) == ["comp", "math"]


def test_display_and_reports(spark):
    df = spark.createDataFrame([(1, '[{"number":"1","url":"u"}]', '["A"]'), (2, "oops", "Solo"), (3, None, None)], "id int, figure_urls string, creators string")
    got = {r["id"]: (len(r["figures"]), r["authors"]) for r in catalog.display_rows(df).collect()}
    assert got == {1: (1, ["A"]), 2: (0, ["Solo"]), 3: (0, [])}
    reports = spark.createDataFrame([("figure", "long enough text", ("u",)), ("figure", "short", ("u",)), ("x", "long enough text", ("u",)), ("other", "long enough text", (None,))], "type string, description string, context struct<url: string>")
    assert ids(catalog.report_error(reports), "error") == [None, "description too short", "unknown type", "missing url"]


def test_candidates_and_images(spark):
    df = spark.createDataFrame([("a", ["x"] * 3), ("b", ["x"] * 30), ("c", [])], "id string, paragraphs array<string>")
    assert ids(catalog.candidates(df, 5)) == ["b", "a"]
    images = spark.createDataFrame([(1, 100, 10, 10), (2, 50_000, 10, 200), (3, 9_000_000, 200, 200), (4, 50_000, 200, 200)], "id int, bytes long, width int, height int")
    assert ids(catalog.image_verdict(images), "reason") == ["too_small", "too_few_pixels", "too_large", None]


# quality -------------------------------------------------------------------------------------------------------


def test_qa_verdicts(spark):
    body = "A sentence that is long enough to count. " * 20
    rows = [
        ("clean", "Good title", "a" * 60, ["A B"], body), ("script", "Good title", "a" * 60, ["A"], body + "中" * 20), ("mark", "Good title", "a" * 60, ["A"], body + "X a n i h C"),
        ("short", "Good title", "a" * 60, ["A"], "tiny"), ("many", "x", "y", ["<PARA>"], "tiny"), ("null", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, title string, abstract string, creators array<string>, body string")
    got = {r["id"]: r for r in quality.complete_status(quality.qa_verdict(df)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"clean": "pass", "script": "flag_script", "mark": "flag_content", "short": "flag_formatting", "many": "flag_content", "null": "flag_content"}
    assert got["script"]["flagged"] == ["body"] and not got["script"]["display"] and not got["mark"]["display"] and got["short"]["display"]
    assert got["many"]["flagged"] == ["body", "title", "abstract", "creators"] and got["many"]["score"] == pytest.approx(0.5)
    gate = quality.translation_gate(quality.complete_status(quality.qa_verdict(df)), most_flagged=2).first()
    assert (gate["total"], gate["passed"], gate["flagged"], gate["pass"]) == (6, 1, 5, False)
    assert gate["reasons"] == ["too_many_flagged", "flagged_ratio_above_threshold"]
    assert {r["status"]: r["n"] for r in quality.qa_histogram(df.limit(0).withColumn("status", F.lit("x"))).collect()} == dict.fromkeys(("pass", "flag_script", "flag_formatting", "flag_content"), 0)


def test_ocr_gate(spark):
    rows = [("a", True, True, 100, 1000, 0.9, 0.1), ("b", True, False, 0, 0, 0.9, 0.1), ("c", True, True, 100, 200, 0.9, 0.1), ("d", False, None, 5000, 5000, None, None), ("e", True, True, 0, 900, 0.9, None)]
    df = spark.createDataFrame(rows, "paper_id string, need_ocr boolean, ran_ocr boolean, pre_ocr_chars int, post_ocr_chars int, post_alpha_ratio double, post_most_common_ratio double")
    r = quality.ocr_gate(quality.ocr_flags(df)).first()
    assert (r["needed"], r["improved"], r["missing_execution"], r["unimproved"], r["low_quality"]) == (4, 1, ["b"], ["c"], ["e"])
    assert not quality.ocr_gate(quality.ocr_flags(df.limit(0))).first()["pass"]


def test_record_checks(spark):
    good = ("d-202401.00001", "A title", "x" * 60, ["A"], ["S"], "2024-01-01", "http://s", "http://p")
    rows = [good, (None, *good[1:]), ("bad", "abc", "short", [" "], [], None, "ftp://s", None), good]
    df = spark.createDataFrame([(i, *r, True) for i, r in enumerate(rows)], "seq int, id string, title string, abstract string, creators array<string>, subjects array<string>, date string, source_url string, pdf_url string, pdf_ok boolean")
    pattern = r"^d-\d{6}\.\d{5}$"
    checked = quality.duplicate_flags(quality.record_errors(df, pattern), "id", "seq").orderBy("seq")
    errors = ids(checked, "errors")
    assert errors[0] == errors[3] == [] and errors[1] == ["missing_id", "id_format"]
    assert set(errors[2]) == {"missing_date", "missing_pdf_url", "id_format", "title_short", "abstract_short", "creators_blank", "subjects_empty", "pdf_url", "source_url"}
    assert ids(checked, "is_duplicate") == [False, False, False, True]
    gate = quality.harvest_gate(checked).first()
    assert (gate["total"], gate["schema_pass"], gate["dup_ids"], gate["schema_rate"], gate["pdf_rate"]) == (4, 2, 1, 50.0, 200.0)
    assert ids(quality.record_errors(df, pattern, strict=False).orderBy("seq"), "errors")[1] == ["missing_id"]
    audit = quality.harvest_audit(checked).first()
    assert (audit["valid"], audit["duplicates"], audit["recommendations"]) == (2, 1, ["fix schema failures", "remove duplicate ids"])


def test_small_gates(spark):
    smoke = quality.smoke_gate(spark.createDataFrame([(10, 7, 1), (0, 0, 0)], "total int, translated int, flagged int")).collect()
    assert [(r["fail_rate"], r["failed"]) for r in smoke] == [(pytest.approx(30), 2), (100, 0)]
    runs = quality.run_severity(spark.createDataFrame([(0, 0), (5, 0), (5, 5), (5, 2)], "total int, failed int"))
    assert ids(runs, "severity") == ["info", "success", "error", "warning"]
    bad = quality.check_violations(spark.createDataFrame([("pass",), ("odd",), (None,)], "qa string"), {"qa": ["pass", "fail"]})
    assert [tuple(r) for r in bad.collect()] == [("qa", 1)]
    metrics = {r["k"]: tuple(r)[1:] for r in quality.text_metrics(spark.createDataFrame([(1, "aab1"), (2, ""), (3, None)], "k int, t string"), "k", "t").collect()}
    assert metrics == {1: (4, 0.75, 0.5), 2: (0, 0.0, 1.0), 3: (0, 0.0, 1.0)}


# reconciliation ------------------------------------------------------------------------------------------------


def test_backfill_keeps_failed_and_upgrades(spark):
    rows = [(1, "pending", "failed"), (2, "failed", "failed"), (3, "pending", "pending"), (4, "complete", "complete")]
    df = spark.createDataFrame(rows, "id int, processing_status string, text_status string")
    out = reconcile.status_backfill(df, {"text": spark.createDataFrame([(3,), (3,)], "x int")})
    assert {r["id"]: (r["new_text_status"], r["new_status"]) for r in out.collect()} == {1: ("failed", "failed"), 2: ("failed", "failed"), 3: ("complete", "complete"), 4: ("complete", "complete")}
    assert tuple(reconcile.change_counts(out).first()) == (1, 1, 1)


def test_upserts_and_children(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int"), spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    pairs = lambda df: sorted((r["id"], r["v"]) for r in df.collect())
    assert pairs(reconcile.upsert(old, new, "id", "seq")) == [(1, "a"), (2, "d"), (3, "e")]
    assert pairs(reconcile.upsert(old, new, "id", "seq", "first")) == [(1, "a"), (2, "b"), (3, "e")]
    child, put = spark.createDataFrame([(1, "x"), (2, "y")], "p int, s string"), spark.createDataFrame([(2, "z"), (2, "z")], "p int, s string")
    assert sorted(map(tuple, reconcile.replace_children(child, put, "p").collect())) == [(1, "x"), (2, "z")]


def test_staged_sync_and_flags(spark, now):
    t = spark.createDataFrame([(1, "pending", None), (2, "complete", at("2020-01-01")), (3, "pending", at("2021-01-01")), (4, "pending", None)], "id int, status string, completed_at timestamp")
    out = reconcile.apply_staged(t, spark.createDataFrame([(1, "complete"), (2, "complete"), (3, "complete")], "id int, status string"), now)
    assert {r["id"]: r["completed_at"] and r["completed_at"].year for r in out.collect()} == {1: 2024, 2: 2020, 3: 2021, 4: None}
    synced = reconcile.sync_column(spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "id int, u string"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, u string"), "u")
    assert {r["id"]: (r["u"], r["changed"]) for r in synced.collect()} == {1: ("a", True), 2: ("b", False), 3: ("c", False)}
    full = reconcile.full_text_sync(spark.createDataFrame([(1, True, ""), (2, None, "x" * 501), (3, False, "x")], "id int, flag boolean, body string"))
    assert ids(full, "has_full_text") == [True, True, False]


def test_qa_reconcile_and_moves(spark):
    df = spark.createDataFrame([(1, "complete", "pending", "t", "a"), (2, "complete", None, "t", ""), (3, "pending", "pending", "t", "a")], "id int, text_status string, qa_status string, title string, abstract string")
    assert {r["id"]: (r["qa_status"], r["changed"]) for r in reconcile.reconcile_qa(df).collect()} == {1: ("pass", True), 2: (None, False), 3: ("pending", False)}
    moved = reconcile.move_to_source(df.withColumns({"source_title": F.lit(None).cast("string"), "source_abstract": F.lit(None).cast("string")})).collect()
    assert {r["id"]: (r["title"], r["source_title"]) for r in moved} == {1: ("t", None), 2: ("t", None), 3: (None, "t")}
    one = spark.range(1)
    status = lambda v: one.select(reconcile.qa_status(F.lit(v).cast("string")).alias("s")).first()["s"]
    assert [status(v) for v in ("pass", "fail", "odd", None)] == ["pass", "fail", "pending", "pass"]


def test_inputs_and_titles(spark):
    p = spark.createDataFrame([(1, "S", None, "T", "A", "complete", None), (2, None, None, "T", "A", "pending", ["k"]), (3, None, None, "T", "A", "complete", None)], "id long, source_title string, source_abstract string, title string, abstract string, text_status string, subjects array<string>")
    subjects = spark.createDataFrame([(1, "b"), (1, "a")], "paper_id long, subject string")
    got = {r["id"]: (r["title"], r["abstract"], r["subjects"]) for r in reconcile.translation_input(p, subjects).collect()}
    assert got == {1: ("S", "", ["a", "b"]), 2: ("T", "A", ["k"])}
    titles = spark.createDataFrame([(1, "x" * 400), (2, "<PARA>fine</PARA>"), (3, "ok title")], "id int, title string")
    report = reconcile.clamp_report(reconcile.title_fallback(titles, spark.createDataFrame([(1, "An English one")], "id int, title string")))
    assert sorted((r["id"], r["new_length"], r["had_tags"]) for r in report.collect()) == [(1, 14, False), (2, 4, True)]


def test_sets_and_matches(spark):
    m, f = spark.createDataFrame([(1, "1"), (1, "2")], "paper_id int, number string"), spark.createDataFrame([(1, "2"), (1, "3"), (2, "1")], "paper_id int, number string")
    assert sorted(map(tuple, reconcile.marker_sets(m, f).collect())) == [(1, ["2"], ["1"], ["3"]), (2, [], [], ["1"])]
    found = spark.createDataFrame([(1, "xx ABC yy"), (1, "abd")], "doc_id int, candidate string")
    best = reconcile.best_matches(spark.createDataFrame([(1, "abc"), (1, "zzz"), (2, "lone"), (1, "a b dx")], "doc_id int, text string"), found)
    got = {r["text"]: (r["best"], r["score"], r["matched"]) for r in best.collect()}
    assert got["abc"] == ("xx ABC yy", 0.95, True) and got["lone"] == (None, 0.0, False) and got["a b dx"] == ("abd", round(6 / 9, 4), False)
    best = best.filter("text IN ('abc', 'zzz')")
    assert tuple(reconcile.match_rates(best).first()) == (1, 0.5, False)
    lost = spark.range(1).select(reconcile.lost_markers(F.lit("a [FIGURE:1] [TABLE:2]"), F.lit("[TABLE:2]")).alias("l")).first()["l"]
    assert lost == ["[FIGURE:1]"]
    valid = lambda v, p=None: spark.range(1).select(reconcile.id_valid(F.lit(v), p).alias("l")).first()["l"]
    assert valid("a-b") and not valid("a-") and not valid("a-b-c") and valid("d-1", r"^d-\d$")


def test_render_and_download_lists(spark, now):
    p = spark.createDataFrame([(1, at("2024-06-10T12:00:00"), "u"), (2, at("2020-01-01"), ""), (3, at("2024-06-11"), None)], "id int, modified timestamp, pdf_url string")
    have = spark.createDataFrame([(2, False), (3, True)], "id int, has_figures boolean")
    assert ids(reconcile.render_list(p, have, "backfill")) == [1]
    assert sorted(ids(reconcile.render_list(p, have, "incremental", now))) == [1, 3]
    assert ids(reconcile.render_list(p, have, "figures", with_figures=p.select("id"))) == [2]
    assert ids(reconcile.to_download(p, have)) == [1]
    assert ids(reconcile.prune_list(p, now)) == [2]


# work sets -----------------------------------------------------------------------------------------------------


def test_work_queue_edges(spark, now):
    rows = [
        (1, "pending", None, "pending"), (2, "complete", None, "complete"), (3, "processing", at("2024-06-10T09:00:00"), "pending"), (4, "processing", at("2024-06-10T07:00:00"), "pending"),
        (5, "processing", None, "pending"), (6, "failed", at("2024-06-08"), "pending"), (7, "failed", at("2024-06-01"), "pending"), (8, "processing", at("2024-06-10T08:00:00"), "pending"),
    ]
    df = spark.createDataFrame(rows, "id int, processing_status string, processing_started_at timestamp, text_status string").withColumn("figures_status", F.lit(None).cast("string"))
    assert sorted(ids(workset.work_queue(df, now))) == [1, 4, 7]
    assert sorted(ids(workset.work_queue(df, now, include_failed=True))) == [1, 4, 6, 7]
    assert sorted(ids(workset.work_queue(df, now, "figures_only"))) == [2]
    assert sorted(ids(workset.claimable(df, now))) == [1, 4, 6, 7]


def test_compaction_keeps_rows_without_times(spark):
    rows = [(1, "completed", None), (2, "completed", at("2024-01-01")), (3, "completed", at("2024-01-02")), (4, "pending", None), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, status string, completed_at timestamp")
    for c in ("updated_at", "started_at", "created_at"):
        df = df.withColumn(c, F.lit(None).cast("timestamp"))
    kept, archived = workset.compact(df, 2)
    assert sorted(ids(kept)) + sorted(ids(archived)) == [1, 3, 4, 2] or sorted(ids(kept)) == [1, 3, 4, 5]


def test_gaps_and_probes(spark):
    df = spark.createDataFrame([("202401", 1), ("202401", 4)], "month string, number int")
    assert sorted(map(tuple, workset.missing_numbers(df).collect())) == [("202401", 2), ("202401", 3)]
    probes = spark.createDataFrame([("m", n, n in (1, 4, 9)) for n in range(1, 12)], "month string, number int, hit boolean")
    assert ids(workset.until_misses(probes, 3).orderBy("number"), "number") == [1, 2, 3, 4, 5, 6]
    months = workset.month_list(spark.sql("SELECT DATE'2023-12-31' AS a, DATE'2024-02-01' AS b"), "a", "b")
    assert sorted(ids(months, "month")) == ["202312", "202401", "202402"]
    assert workset.first_missing(workset.harvest_progress(df, months)).first()["month"] == "202312"


# usage ---------------------------------------------------------------------------------------------------------


def test_times_after_a_cutoff(spark):
    rows = [(1, "2024-06-10T12:00:00"), (2, "2024-06-10T12:00:01"), (3, "2024-06-10T14:00:00+05:00"), (4, "2024-06-10T20:00:00+05:00"), (5, "bad"), (6, None), (7, "2024-06-11")]
    df = spark.createDataFrame(rows, "id int, t string")
    cut = F.lit(NOW).cast("timestamp")
    assert ids(usage.newer_than(df, "t", cut)) == [2, 4, 7]
    assert ids(usage.newer_than(df, "t", cut, True)) == [2, 4, 5, 6, 7]


def test_transfers(spark):
    rows = [("h1", "ETH", 5, "0xME", True, False), ("h2", "USDC", 5, "0xme", True, None), ("h3", "ETH", 0, "0xme", True, False), ("h4", "ETH", 5, "0xme", False, False), ("h5", "ETH", 5, "0xme", True, True)]
    df = spark.createDataFrame(rows, "id string, symbol string, raw_value int, to string, confirmed boolean, is_error boolean")
    assert ids(usage.confirmed_transfers(df, "0xMe")) == ["h1"]
    assert ids(usage.confirmed_transfers(df, "0xMe", [])) == ["h1", "h2"]
    assert ids(usage.confirmed_transfers(df, "0xMe", ["USDC"])) == ["h2"]


def test_spacing_restarts_at_accepted_events(spark):
    rows = [(i, "p", at(f"2024-01-01T00:{m:02d}:{s:02d}")) for i, (m, s) in enumerate([(0, 0), (0, 59), (1, 0), (1, 30), (2, 1)])] + [(9, "q", at("2024-01-01T00:00:30"))]
    df = spark.createDataFrame(rows, "event_id int, key string, created_at timestamp")
    assert sorted(ids(usage.accept_spaced(df, ["key"], 60), "event_id")) == [0, 2, 4, 9]
    burst = spark.createDataFrame([(i, "a", at("2024-01-01T00:00:00") + dt.timedelta(minutes=10 * i)) for i in range(9)], "event_id int, key string, created_at timestamp")
    assert sorted(ids(usage.limit_rate(burst, ["key"], 3600, 5), "event_id")) == [0, 1, 2, 3, 4, 7, 8]


def test_streaks_reset_on_class_switch(spark):
    kinds = ["persistent", "transient", "persistent", "persistent", "ok", *["transient"] * 5, "persistent"]
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "source string, seq int, kind string")
    assert sorted(ids(usage.failure_streaks(df), "seq")) == [3, 9]


def test_history_filters_after_the_running_total(spark):
    df = spark.createDataFrame([(at("2024-01-01"), 1), (at("2024-01-02"), 2), (at("2024-01-03"), 4)], "completed_at timestamp, n int")
    assert [(str(r["day"]), r["total_n"]) for r in usage.daily_history(df, ["n"], 2).orderBy("day").collect()] == [("2024-01-02", 3), ("2024-01-03", 7)]


def test_costs_licences_and_inventory(spark):
    prices = spark.createDataFrame([("m", 0.1, 0.2)], "model string, input_price double, output_price double")
    df = spark.createDataFrame([("m", 10, 5), ("x", 10, 5)], "model string, input_tokens int, output_tokens int")
    assert sorted(ids(usage.with_cost(df, prices), "cost")) == [0.0, 2.0]
    meaning = spark.createDataFrame([("CC BY", True, "b")], "label string, derivatives_allowed boolean, badge string")
    rows = usage.with_license(spark.createDataFrame([(1, "cc by"), (2, "?")], "id int, license_raw string"), meaning).orderBy("id").collect()
    assert [r["derivatives_allowed"] for r in rows] == [True, None]
    counts = spark.createDataFrame([("202401", "text", 5, 1), ("202401", "text", 7, 2), ("202401", "pdf", 1, 1)], "month string, stage string, n int, updated_at int")
    assert tuple(usage.inventory(counts).first()) == ("202401", 0, 7, 0, 1)
    files = spark.createDataFrame([("b/figures/p1/translated/1.png",), ("figures/p1/translated/2.png",), ("figures/p2/raw/1.png",)], "path string")
    assert usage.translated_figures(files).first()["papers"] == 1


# near duplicates -----------------------------------------------------------------------------------------------


def test_banded_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(1)
    codes = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(60):
        c = rng.choice(codes)
        for b in rng.sample(range(64), rng.randrange(0, 8)):
            c ^= 1 << b
        codes.append(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "id int, code long")
    got = {tuple(r) for r in neardup.near_pairs(df, "id", "code", 5).collect()}
    least = {c: codes.index(c) for c in codes}
    assert got == {(i, j, d) for i in least.values() for j in least.values() if i < j and (d := bin(codes[i] ^ codes[j]).count("1")) <= 5}
    classes = dict(map(tuple, neardup.code_classes(df, "id", "code").collect()))
    assert classes == {i: least[c] for i, c in enumerate(codes)}
    assert "CartesianProduct" not in neardup.near_pairs(df, "id", "code", 5)._jdf.queryExecution().toString()


def folded(codes, most):
    kept = []
    for i, c in codes:
        if all(bin((c ^ k) & (2**64 - 1)).count("1") > most for _, k in kept):
            kept.append((i, c))
    return kept


def test_greedy_keep_of_chains(spark):
    import random

    rng = random.Random(8)
    codes = [rng.getrandbits(63) for _ in range(30)]
    for at in range(0, 30, 3):  # chains in which each is near the next alone, and bushes round one code
        for _ in range(6):
            code = codes[-1] if at % 2 else codes[at]
            for bit in rng.sample(range(63), 4):
                code ^= 1 << bit
            codes.append(code)
    codes += codes[:5]
    order = list(range(len(codes)))
    rng.shuffle(order)
    rows = sorted(zip(order, codes, strict=True))
    df = spark.createDataFrame([*((i, c, i % 2) for i, c in rows), (999, None, 0)], "id long, code long, g int")
    got = sorted(r["id"] for r in neardup.keep_greedy(df, None, "id", "code", 5).collect())
    assert got == [i for i, _ in folded(rows, 5)] + [999]
    got = sorted((r["g"], r["id"]) for r in neardup.keep_greedy(df.filter("id < 999"), "g", "id", "code", 7, agree=2).collect())
    assert got == sorted((g, i) for g in (0, 1) for i, _ in folded([r for r in rows if r[0] % 2 == g], 7))


def test_index_answers_by_stems(spark, tmp_path):
    rows = [(1, "Connected networks", "of learning"), (2, "Connections", "networking learned"), (3, "network", None), (4, "the", "and")]
    docs = spark.createDataFrame(rows, "id long, title string, abstract string")
    search.write_index(search.postings(docs, "id", ["title", "abstract"]), "id", str(tmp_path / "i"))
    find = lambda q: sorted(r["id"] for r in search.find(spark, str(tmp_path / "i"), q).collect())
    assert find("the connecting NETWORK") == [1, 2] and find("networks") == [1, 2, 3] and find("connection missing") == [] and find("and the") == []
    plan = search.find(spark, str(tmp_path / "i"), "networks")._jdf.queryExecution().toString()
    assert "EqualTo(stem,network)" in plan and "PartitionFilters: []" not in plan


def test_whole_rankings_have_no_gaps(spark):
    import random

    rng = random.Random(6)
    rows = [(i, rng.randrange(5)) for i in range(300)]
    got = usage.ranked_requests(spark.createDataFrame(rows, "paper_id long, n long").repartition(7)).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["paper_id"], r["n"]) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 301))
    assert usage.ranked_requests(spark.createDataFrame([], "paper_id long, n long")).collect() == []


def test_crowded_keys_are_dealt_to_blocks(spark, monkeypatch):
    import random

    rng = random.Random(9)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    codes = sorted({rng.getrandbits(6) for _ in range(60)})  # all agree on most bands
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = sorted((r["a"], r["b"]) for r in neardup.near_pairs(df, "id", "code", 2).collect())
    assert got == [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin(codes[i] ^ codes[j]).count("1") <= 2]


def test_greedy_keep(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0b111), (1, 3, 0b111111111), (2, 1, 0)], "g int, ord int, code long")
    assert sorted((r["g"], r["ord"]) for r in neardup.keep_greedy(df, "g", "ord", "code", 5).collect()) == [(1, 1), (1, 3), (2, 1)]
    bits = spark.createDataFrame([([1.0, -1.0, 2.0],)], "v array<double>").select(neardup.sign_hash("v").alias("c"), neardup.hash_hex(F.lit(255)).alias("h")).first()
    assert tuple(bits) == (5, "00000000000000ff")


# sources and sinks ---------------------------------------------------------------------------------------------


def test_json_sources(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text(json.dumps([{"id": "1", "creators": ["x"]}, {"id": "2"}]))
    (tmp_path / "r/b.json").write_text("[{")
    assert sorted(ids(io.read_records(spark, str(tmp_path / "r")))) == ["1", "2"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/d-1.json").write_text(json.dumps({"id": "d-1", "title_en": "T"}))
    (tmp_path / "t/d-2.json").write_text("{oops")
    assert {r["key"]: r["unreadable"] for r in io.read_documents(spark, str(tmp_path / "t")).collect()} == {"d-1": False, "d-2": True}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    good, bad = io.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int")
    assert sorted(ids(good, "a")) == [1, 2] and ids(bad, "line") == ["bad"]


def test_xml_source(spark, tmp_path):
    (tmp_path / "o.xml").write_text(
        "<r><record><header><identifier>oai:x:d-1</identifier><datestamp>2024-01-02T00:00:00Z</datestamp><setSpec>s</setSpec></header><metadata><dc><title>T</title><title>U</title>"
        "<creator>A</creator><identifier>http://x/1</identifier><identifier>http://x/1.pdf</identifier></dc></metadata></record>"
        '<record><header status="deleted"><identifier>oai:x:d-2</identifier><datestamp>2024</datestamp></header></record></r>'
    )
    r = io.read_oai(spark, str(tmp_path / "o.xml")).collect()
    assert [(x["id"], x["title"], x["date"], x["pdf_url"], x["creators"]) for x in r] == [("d-1", "T", "2024-01-02", "http://x/1.pdf", ["A"])]


def test_pages(spark):
    html = '<h1>A <b>title</b></h1><a href="/author/1">Ann</a><a href="/subject/2">Maths</a><p>Abstract: Some text</p><p>Submitted: 2024-03</p><a href="http://x/1.pdf">PDF</a><script>no</script>'
    good, rejects = io.page_records(spark.createDataFrame([(1, "u", html), (2, "u", "<h1>Only a title</h1>"), (3, "u", "<p>x</p>"), (4, "u", None)], "page_id int, url string, html string"))
    r = good.first()
    assert (r["title"], r["creators"], r["subjects"], r["abstract"], r["date"], r["pdf_url"]) == ("A title", ["Ann"], ["Maths"], "Some text", "2024-03-01", "http://x/1.pdf")
    assert dict(map(lambda x: (x["page_id"], x["reason"]), rejects.collect()))[2] == "no_pdf"


def test_files_sinks_and_manifests(spark, tmp_path):
    (tmp_path / "f/figures/d-1").mkdir(parents=True)
    (tmp_path / "f/figures/d-1/d-1.pdf").write_bytes(b"%PDF")
    (tmp_path / "f/figures/d-1/n.txt").write_bytes(b"x")
    assert [(r["id"], r["size"]) for r in io.list_files(spark, str(tmp_path / "f"), id_prefix="d-").collect()] == [("d-1", 4)]
    rows = spark.createDataFrame([(at("2024-01-01"), 1.0), (at("2024-01-03"), 2.0)], "at timestamp, cost double")
    io.append_costs(rows, str(tmp_path / "c"))
    io.append_costs(rows.limit(1), str(tmp_path / "c"))
    assert io.read_days(spark, str(tmp_path / "c"), "2024-01-02").count() == 1
    io.write_id_list(spark.createDataFrame([("b", 2), ("a", 1)], "paper_id string, rank int"), str(tmp_path / "ids"))
    assert ids(io.read_ids(spark, str(tmp_path / "ids"))) == ["a", "b"]
    manifest = spark.createDataFrame([("p", "1", "u"), ("q", "1", "v")], "paper_id string, number string, url string")
    put = io.put_figures(manifest, spark.createDataFrame([("p", "2", "w"), ("p", "1", "x")], "paper_id string, number string, url string"))
    assert {r["paper_id"]: r["figure_count"] for r in io.manifest_map(put).collect()} == {"p": 2, "q": 1}
    io.write_report(manifest, manifest.limit(1), str(tmp_path / "rep"))
    assert os.path.isdir(tmp_path / "rep/detail")
    other = io.other_source(spark.createDataFrame([("x", "T", None, "A", '["s"]', "2019-01-01"), ("y", "T", None, "A", "s", None)], "identifier string, title string, description string, creator string, subject string, date string"), least_year=2000)
    assert [(r["id"], r["creators"], r["subjects"]) for r in other.collect()] == [("ia-x", ["A"], ["s"])]

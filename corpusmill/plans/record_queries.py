"""Queries of single records and small decisions over the driver tables: name -> (query, DuckDB oracle).

Columns that the tables lack (titles, bodies, addresses, statuses) are made of their keys, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import catalog, quality, reconcile, usage, workset
from corpusmill.plans.views import table
from corpusmill.sources import io
from corpusmill.sources.scratch import new_folder


def _paper_ids(spark, sf):
    number = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    return table(spark, sf, "orders").withColumn("id", F.concat(F.lit("arch-"), F.date_format("o_orderdate", "yyyyMM"), F.lit("."), number))


_ID = "'arch-' || strftime(o_orderdate, '%Y%m') || '.' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0')"


def month_ids(spark, sf):
    return catalog.by_month(_paper_ids(spark, sf).select("id"), "arch", "199501")


def batch_ids(spark, sf):
    wanted = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("id"))
    return workset.batch(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), wanted)


def _translations(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "").when(k % 3 == 2, F.col("o_orderpriority")).alias("title"), F.when(k % 2 == 0, F.lit("")).otherwise("an abstract").alias("abstract"),
        F.when(k % 5 == 1, F.array().cast("array<string>")).when(k % 5 == 2, F.array(F.lit("p"))).alias("body"),
    )


def empty_translation_ids(spark, sf):
    return reconcile.empty_translations(_translations(spark, sf)).select("id")


def id_forms(spark, sf):
    rows = _paper_ids(spark, sf).withColumn("id", F.when(F.col("o_orderkey") % 4 == 0, F.replace("id", F.lit("-"), F.lit(""))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.col("id"), F.lit("-x"))).otherwise(F.col("id")))
    return rows.select("o_orderkey", "id", reconcile.id_valid(F.col("id"), r"^arch-\d{6}\.\d{6}$").alias("strict"), reconcile.id_valid(F.col("id")).alias("loose"))


def image_verdicts(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") * 20).alias("bytes"), (F.col("o_custkey") % 400).alias("width"), (F.col("o_orderkey") % 700).alias("height"),
    )
    return catalog.image_verdict(rows).select("id", "reason")


def report_errors(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, (*catalog.REPORT_TYPES, "else"))), (F.col("doc_id") % 6 + 1).cast("int"))
    url = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("/paper/"), F.col("doc_id").cast("string")))
    rows = table(spark, sf, "documents").select("doc_id", kind.alias("type"), F.col("text").alias("description"), F.struct(url.alias("url")).alias("context"))
    return catalog.report_error(rows).select("doc_id", "error", "valid")


def display_columns(spark, sf):
    k = F.col("o_orderkey")
    figures = F.when(k % 4 == 0, F.concat(F.lit('[{"number": "1", "url": "/f/'), k.cast("string"), F.lit('"}]'))).when(k % 4 == 1, "not json").when(k % 4 == 2, "[]")
    creators = F.when(k % 3 == 0, '["Ada", "Bo"]').when(k % 3 == 1, "Solo Author").otherwise("")
    out = catalog.display_rows(table(spark, sf, "orders").select(k.alias("id"), figures.alias("figure_urls"), creators.alias("creators")))
    return out.select("id", F.array_join(F.transform("figures", lambda f: f["url"]), ",").alias("urls"), F.array_join("authors", "|").alias("authors"), "has_figures", "has_authors")


def search_columns(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b>  "), F.col("p_brand"))).otherwise("").alias("title"), F.col("p_type").alias("source_title"),
        F.when(k % 2 == 0, F.concat(F.lit("An <i>abstract</i> of "), F.col("p_name"))).alias("abstract"), F.lit("its <p>source</p>").alias("source_abstract"),
    )
    return catalog.search_rows(rows)


def _source_papers(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("source "), k.cast("string"))).alias("source_title"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("title"),
        F.when(k % 3 == 0, "pending").otherwise("complete").alias("text_status"), F.when(k % 7 == 0, F.lit("source abstract")).alias("source_abstract"), F.lit("an abstract").alias("abstract"),
        F.when(k % 2 == 0, F.array(F.lit("own"))).alias("subjects"), F.col("o_orderdate").alias("modified"),
    )


_SP = """sp AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'source ' || o_orderkey END AS source_title, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'complete' END AS text_status, CASE WHEN o_orderkey % 7 = 0 THEN 'source abstract' END AS source_abstract, 'an abstract' AS abstract,
  CASE WHEN o_orderkey % 2 = 0 THEN 'own' END AS own, o_orderdate AS modified FROM orders)"""


def translation_inputs(spark, sf):
    kinds = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("subject"))
    return reconcile.translation_input(_source_papers(spark, sf), kinds).withColumn("subjects", F.array_join("subjects", ","))


def moved_to_source(spark, sf):
    return reconcile.move_to_source(_source_papers(spark, sf)).select("id", "source_title", "title", "source_abstract", "abstract")


PART = 1_000_000  # rows of a join's part in render_lists, about


def render_lists(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity", "l_returnflag")
    # a part for so many rows: left alone, AQE joins parts by compressed bytes, and sorted keys compress so well that a task gets millions
    parts = max(spark.sparkContext.defaultParallelism, -(-items.count() // PART))
    items = items.repartition(parts, "id")
    papers = _source_papers(spark, sf).select("id", "modified").repartition(parts, "id")
    files = items.groupBy("id").agg((F.max("l_quantity") > 40).alias("has_figures"))
    figures = items.filter("l_returnflag = 'R'").select("id")
    cutoff = F.lit("1998-01-01").cast("timestamp")
    modes = ("backfill", "incremental", "figures")
    lists = [reconcile.render_list(papers, files, m, cutoff, figures).select(F.lit(m).alias("mode"), "id") for m in modes]
    return lists[0].union(lists[1]).union(lists[2])


def reconciled_qa(spark, sf):
    rows = _source_papers(spark, sf).withColumn("qa_status", F.when(F.col("id") % 6 == 0, "pass").when(F.col("id") % 6 == 1, "fail"))
    return reconcile.reconcile_qa(rows).select("id", "qa_status", "changed")


def ocr_needs(spark, sf):
    return quality.needs_ocr(table(spark, sf, "documents")).select("doc_id", "need_ocr")


def transfers(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").alias("confirmed"), F.when(F.col("l_suppkey") % 2 == 0, "0xAB").otherwise("0xcd").alias("to"),
        F.when(F.col("l_partkey") % 9 == 0, F.lit(True)).alias("is_error"), (F.col("l_quantity") - 5).alias("raw_value"), F.when(F.col("l_linenumber") % 2 == 0, "ETH").otherwise("DAI").alias("symbol"),
    )
    return usage.confirmed_transfers(rows, "0xab", ["DAI", "USDC"]).select("l_orderkey", "l_linenumber", "raw_value")


def pruned_files(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("modified"))
    return reconcile.prune_list(rows, F.lit("1996-01-01").cast("timestamp")).groupBy("modified").agg(F.count("*").alias("removed"))


def missing_sources(spark, sf):
    papers = _paper_ids(spark, sf).withColumn("source_title", F.when(F.col("o_orderkey") % 2 == 0, "t"))
    # by the order's key: ids hold six digits of it, which orders beyond the millionth share
    return reconcile.missing_source(_paper_ids(spark, sf).select("id", "o_orderkey", "o_totalprice"), papers, "199603", "o_orderkey").drop("o_orderkey")


def downloads(spark, sf):
    url = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/pdf/"), F.col("o_orderkey").cast("string")))
    records = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), url.alias("pdf_url"))
    return reconcile.to_download(records, table(spark, sf, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("id")))


def translations_with_source(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    records = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"))
    return reconcile.with_source(done, records)


def _per_nation(spark, sf):
    done = F.count_if(F.col("c_acctbal") > 0).alias("translated")
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), done, F.count_if(F.col("c_acctbal") > 9000).alias("flagged"))


_PN = "pn AS (SELECT c_nationkey, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS translated, count(*) FILTER (c_acctbal > 9000) AS flagged FROM customer GROUP BY c_nationkey)"


def batch_figures(spark, sf):
    rows = _per_nation(spark, sf).select("total", F.col("translated").alias("succeeded"), (F.col("total") - F.col("translated")).alias("failed"))
    return reconcile.batch_totals(rows).withColumn("success_rate", F.round("success_rate", 9))


def smoke_gates(spark, sf):
    return quality.smoke_gate(_per_nation(spark, sf)).select("c_nationkey", F.round("fail_rate", 6).alias("fail_rate"), "failed", "pass")


def run_severities(spark, sf):
    rows = _per_nation(spark, sf).select("c_nationkey", "total", F.when(F.col("c_nationkey") % 3 == 0, 0).when(F.col("c_nationkey") % 3 == 1, F.col("total")).otherwise(F.col("flagged")).alias("failed"))
    return quality.run_severity(rows).select("c_nationkey", "severity", F.round("success_rate", 1).alias("success_rate"))


def merged_summaries(spark, sf):
    runs = _per_nation(spark, sf).withColumn("run_id", F.col("c_nationkey"))
    merged = reconcile.merge_summaries(runs.select("run_id", "total"), runs.filter("c_nationkey % 2 = 0").select("run_id", "translated"), runs.filter("c_nationkey % 3 = 0").select("run_id", "flagged"))
    return merged.select("run_id", "harvest.total", "translation.translated", "ocr.flagged")


def storage_prefixes(spark, sf):
    return usage.prefix_stats(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("prefix"), F.col("l_shipdate").alias("modified")))


def translated_figure_papers(spark, sf):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "translated").otherwise("original")
    path = F.concat(F.lit("store/figures/"), F.col("l_orderkey").cast("string"), F.lit("/"), kind, F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(".png"))
    return usage.translated_figures(table(spark, sf, "lineitem").select(path.alias("path")))


def newest_log_lines(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 40).alias("file"), F.col("event_id").alias("line_no"), (F.lit(1000) - F.col("user_id") % 40).alias("modified"))
    return usage.last_lines(rows)


def extreme_files(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("modified"), F.col("o_totalprice").alias("size"))
    parts = [workset.extreme_file(rows, by).withColumn("by", F.lit(by)) for by in ("name", "modified", "size")]
    return parts[0].union(parts[1]).union(parts[2])


def joined_records(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return reconcile.all_records(a, b)


def lost_marker_lists(spark, sf):
    k = F.col("o_orderkey").cast("string")
    source = F.concat(F.lit("a [FIGURE:"), k, F.lit("] b [TABLE:1] c [FIGURE:x]"))
    target = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("[FIGURE:"), k, F.lit("] kept"))).otherwise("[TABLE:1]")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.array_sort(reconcile.lost_markers(source, target)), " ").alias("lost"))


def enum_violations(spark, sf):
    return quality.check_violations(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})


def saved_translations(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit(" <PARA a=1>Title "), F.col("doc_id").cast("string"), F.lit(" </PARA>")).alias("title"), F.lit(None).cast("string").alias("source_title"),
        F.lit("<para>short</para>").alias("abstract"), F.array(F.lit("<PARA>"), F.lit("Ada")).alias("creators"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("body"),
        F.when(F.col("doc_id") % 2 == 0, "odd").alias("qa"), F.lit("2024-01-01").cast("timestamp").alias("as_of"),
    )
    out = reconcile.saved_translation(rows)
    return out.select("id", "title", "abstract", F.array_join("creators", ",").alias("creators"), F.md5("body").alias("body_md5"), "has_full_text", "qa_status", "text_status", "text_completed_at")


def full_texts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1).alias("flag"), F.col("text").alias("body"))
    return reconcile.full_text_sync(rows).select("doc_id", "has_full_text", F.md5("body").alias("body_md5"))


def name_parts(spark, sf):
    rows = _paper_ids(spark, sf).withColumn("oai", F.concat(F.lit("oai:example.org:"), F.col("id"), F.lit("/v1 a")))
    return rows.select("o_orderkey", X.last_part("oai").alias("last"), X.month_of_id("id").alias("month"), X.safe_filename("oai").alias("file"), X.day_before("o_orderdate", 2).alias("day"))


def title_cased(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.title_case(F.concat(F.col("p_name"), F.lit("-"), F.col("p_type"))).alias("title"))


def address_hashes(spark, sf):
    address = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 50).cast("string"), F.lit(" , 10.9.9.9"))
    return table(spark, sf, "events").select(X.address_hash(address).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))


def api_errors(spark, sf):
    status = F.element_at(F.array(*[F.lit(x) for x in (401, 402, 404, 429, 503, 200, 200, 200)]), (F.col("event_id") % 8 + 1).cast("int"))
    message = F.when(F.col("event_id") % 3 == 0, "Rate LIMIT hit").when(F.col("event_id") % 3 == 1, "connection reset")
    return table(spark, sf, "events").select("event_id", X.api_error_class(status, message).alias("kind"))


def latex_paragraphs(spark, sf):
    body = F.concat(F.lit("\\title{x}\n\\begin{document}\n  % note\n"), F.col("p_name"), F.lit("\n \n"), F.col("p_type"), F.lit("\n\\end{document}\nrest"))
    source = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name"), F.lit("\n\nx\n\n"), F.col("p_brand"))).otherwise(body)
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.blank_line_paragraphs(X.latex_body(source)), "|").alias("paragraphs"))


def translation_checks(spark, sf):
    k = F.col("p_partkey")
    source = F.concat(F.col("p_name"), F.lit(" [1] \\alpha"))
    target = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(source, F.lit(" ⟪M_1⟫"))).when(k % 5 == 2, F.col("p_name")).when(k % 5 == 3, F.repeat(source, 4)).otherwise(source)
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.translation_issues(source, target), ",").alias("issues"), X.strip_tokens(target).alias("plain"))


def full_bodies(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(False)).alias("flag"), F.split("text", "\n").alias("paragraphs"))
    return rows.select("doc_id", X.has_full_body("flag", "paragraphs").alias("full"))


def pdf_urls(spark, sf):
    k = F.col("o_orderkey").cast("string")
    urls = F.array(F.lit("ftp://x/a.pdf"), F.concat(F.lit("https://x/"), k, F.when(F.col("o_orderkey") % 2 == 0, ".PDF").otherwise(".html")), F.concat(F.lit("http://y/"), k, F.lit(".pdf")))
    return table(spark, sf, "orders").select("o_orderkey", X.first_url(urls, ".pdf").alias("url"))


def received_amounts(spark, sf):
    outputs = F.collect_list(F.struct(F.col("l_returnflag").alias("to"), (F.col("l_quantity") * 1000).cast("long").alias("value")))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(outputs.alias("outputs"))
    total = X.nested_sum("outputs", "R")
    return rows.select("l_orderkey", total.cast("long").alias("raw"), X.token_amount(total, F.lit(3)).cast("decimal(20,3)").alias("amount"))


def console_tails(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("logs"))
    return rows.select("doc_id", F.md5(F.array_join(X.console_tail("logs"), "\n")).alias("tail_md5"))


def escaped_markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.markdown_escape("text")).alias("escaped_md5"))


def noisy_objects(spark, sf):
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("log "), F.col("props"), F.lit(" end"))).when(F.col("event_id") % 3 == 1, "no object {here").otherwise(F.col("props"))
    found = X.first_json_object(noisy)
    return table(spark, sf, "events").select("event_id", F.try_variant_get(found, "$.k", "long").alias("k"))


def glossaries(spark, sf):
    pair = F.struct(F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("source"), F.concat(F.lit(" "), F.col("p_type")).alias("target"))
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", pair.alias("pair")))).alias("pairs"))
    return rows.select("p_brand", F.md5(X.glossary_text(F.transform("pairs", lambda x: x["pair"]))).alias("text_md5"))


def jsonl_round_trip(spark, sf):
    """Orders exported as lines, a tenth of them spoilt; what is read back, and how many lines couldn't be."""
    path = new_folder(spark, "jsonl")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    io.export_jsonl(orders.filter("o_orderkey % 10 <> 0"), f"{path}/good")
    orders.filter("o_orderkey % 10 = 0").select(F.concat(F.lit('{"o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(", oh")).alias("value")).write.text(f"{path}/bad")
    good, bad = io.read_jsonl(spark, f"{path}/*", "o_orderkey long, o_orderstatus string, o_totalprice double")
    return good.withColumn("bad", F.lit(False)).unionByName(bad.select(F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("o_orderkey"), F.lit(True).alias("bad")), allowMissingColumns=True)


def costs_since(spark, sf):
    """Costs appended by UTC day and read from a day on."""
    path = new_folder(spark, "costs")
    io.append_costs(table(spark, sf, "events").select(F.col("ts").alias("at"), "value"), path)
    return io.read_days(spark, path, "2024-01-03").groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("cost"))


def run_manifests(spark, sf):
    """A CSV row a run, by day; missing numbers are 0."""
    path = new_folder(spark, "runs")
    runs = table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("completed_at"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("attempted"), F.lit(1).alias("validated"), F.lit(None).cast("long").alias("flagged"),
        F.lit(0).alias("failed"), F.lit(0).alias("skipped"), F.lit(0.5).alias("text_cost"), F.lit(None).cast("double").alias("figure_cost"), F.lit(0.0).alias("ocr_cost"), F.lit(0.5).alias("total_cost"),
        F.date_format("o_orderdate", "yyyy").alias("day"),
    )
    io.append_manifest(runs, path)
    return io.read_runs(spark, path).select("run_id", "month", "attempted", "flagged", "figure_cost", "total_cost")


def id_list_round_trip(spark, sf):
    """The ranked list of requested papers, written and read."""
    path = new_folder(spark, "ids")
    asked = usage.request_counts(table(spark, sf, "events").select(F.col("user_id").alias("paper_id")))
    io.write_id_list(usage.ranked_requests(asked), path)
    return io.read_ids(spark, path)


def record_arrays(spark, sf):
    """A1: arrays of records in JSON files, a file a region; a broken file gives none."""
    path = new_folder(spark, "arrays")
    record = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("subjects"))
    arrays = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(record)).alias("value"))
    spoilt = F.when(F.col("n_regionkey") == 2, F.concat(F.lit("["), F.col("value"))).otherwise(F.col("value"))
    arrays.select(spoilt.alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return io.read_records(spark, path).select("id", "title", F.array_join("subjects", ",").alias("subjects"))


def xml_records(spark, sf):
    """Dublin Core records in XML, a file a region; deleted ones go."""
    path = new_folder(spark, "xml")
    n = F.col("n_nationkey").cast("string")
    head = F.concat(F.lit("<header"), F.when(F.col("n_nationkey") % 5 == 0, ' status="deleted"').otherwise(""), F.lit("><identifier>oai:x:"), n, F.lit("</identifier><datestamp>2024-02-03T00:00:00Z</datestamp><setSpec>s</setSpec></header>"))
    body = F.concat(F.lit("<metadata><dc><title>"), F.col("n_name"), F.lit("</title><title>other</title><creator>A</creator><creator>B</creator><identifier>http://x/"), n, F.lit(".pdf</identifier></dc></metadata>"))
    one = F.concat(F.lit("<record>"), head, body, F.lit("</record>"))
    files = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<records>"), F.array_join(F.collect_list(one), ""), F.lit("</records>")).alias("value"))
    files.select("value", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return io.read_oai(spark, f"{path}/*").select("id", "title", "abstract", F.array_join("creators", ",").alias("creators"), "date", "pdf_url")


def archive_records(spark, sf):
    """Another archive's rows under our names."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        k.cast("string").alias("identifier"), F.col("p_name").alias("title"), F.when(k % 2 == 0, F.col("p_brand")).alias("description"), F.when(k % 3 == 0, '["Ada", "Bo"]').otherwise("Solo").alias("creator"),
        F.lit("").alias("subject"), F.concat((F.lit(1990) + F.col("p_size")).cast("string"), F.lit("-05")).alias("date"),
    )
    out = io.other_source(rows, least_year=2005)
    return out.select("id", "title", "abstract", F.array_join("creators", "|").alias("creators"), F.size("subjects").alias("n_subjects"), "date")


def migrated(spark, sf):
    """Rows with flags as numbers and lists as JSON, put over a target; the counts to compare."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).cast("int").alias("has_figures"), F.lit('["Ada"]').alias("creators"), F.lit(1).cast("long").alias("seq"))
    # ids of the target that no order has, however many there are: those below 0
    target = rows.filter("id % 5 = 0").select((-1 - F.col("id")).alias("id"), F.lit(False).alias("has_figures"), F.array().cast("array<string>").alias("creators"), F.lit(0).cast("long").alias("seq"))
    merged, counts = io.migrate(rows, target)
    return merged.groupBy("has_figures", F.size("creators").alias("creators")).agg(F.count("*").alias("n")).crossJoin(counts)  # four rows at most by one


def figure_manifest(spark, sf):
    """The figures of some papers replaced, and the map that is exported."""
    figure = lambda df: df.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"), F.concat(F.lit("/f/"), F.col("l_partkey").cast("string")).alias("url"))
    old, new = (figure(table(spark, sf, "lineitem").filter(c)) for c in ("l_returnflag <> 'R'", "l_returnflag = 'R'"))
    out = io.manifest_map(io.put_figures(old, new))
    return out.select("paper_id", "figure_count", F.array_join(F.transform("figures", lambda f: f["url"]), ",").alias("urls"))


def pointer_records(spark, sf):
    """A21."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.concat(F.lit("validated/"), F.col("o_orderkey").cast("string")).alias("key"))
    return io.pointers(rows, "run-7", F.lit("2024-01-02").cast("timestamp")).select("pointer.*")


def report_round_trip(spark, sf):
    """A report's detail and summary, written and read, with the summary's lines as markdown."""
    path = new_folder(spark, "report")
    detail = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("value"))
    io.write_report(detail, detail.agg(X.summary_markdown("Run", "label", "value", "label").alias("text")), path)
    return spark.read.json(f"{path}/summary").select("text").crossJoin(spark.read.json(f"{path}/detail").agg(F.sum("value").alias("total")))  # one row each


_IDS = f"ids AS (SELECT *, {_ID} AS id FROM orders)"
PLANS = {
    "month_ids": (month_ids, f"WITH {_IDS} SELECT id FROM ids WHERE id LIKE 'arch-199501.%'"),
    "batch_ids": (batch_ids, "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)"),
    "empty_translation_ids": (empty_translation_ids, "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 2"),
    "id_forms": (id_forms, f"""WITH {_IDS}, f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN replace(id, '-', '') WHEN 1 THEN id || '-x' ELSE id END AS id FROM ids)
      SELECT o_orderkey, id, regexp_full_match(id, 'arch-\\d{{6}}\\.\\d{{6}}') AS strict, len(string_split(id, '-')) = 2 AND split_part(id, '-', 1) <> '' AND split_part(id, '-', 2) <> '' AS loose FROM f"""),
    "image_verdicts": (image_verdicts, """SELECT o_orderkey AS id, CASE WHEN floor(o_totalprice * 20) < 20480 THEN 'too_small' WHEN floor(o_totalprice * 20) > 5242880 THEN 'too_large'
      WHEN o_custkey % 400 < 100 OR o_orderkey % 700 < 100 THEN 'too_few_pixels' END AS reason FROM orders"""),
    "report_errors": (report_errors, """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'unknown type' WHEN length(trim(coalesce(text, ''))) < 10 THEN 'description too short'
      WHEN length(trim(coalesce(text, ''))) > 5000 THEN 'description too long' WHEN doc_id % 7 = 0 THEN 'missing url' END AS error FROM documents) SELECT doc_id, error, error IS NULL AS valid FROM e"""),
    "display_columns": (display_columns, """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '/f/' || o_orderkey ELSE '' END AS urls, CASE o_orderkey % 3 WHEN 0 THEN 'Ada|Bo' WHEN 1 THEN 'Solo Author' ELSE '' END AS authors,
      o_orderkey % 4 = 0 AS has_figures, o_orderkey % 3 < 2 AS has_authors FROM orders"""),
    "search_columns": (search_columns, """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name || ' ' || p_brand ELSE p_type END AS title,
      CASE WHEN p_partkey % 2 = 0 THEN 'An abstract of ' || p_name ELSE 'its source' END AS abstract FROM part"""),
    "translation_inputs": (translation_inputs, f"""WITH {_SP}, k AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS s FROM lineitem GROUP BY 1),
      t AS (SELECT id, coalesce(nullif(source_title, ''), CASE WHEN text_status = 'pending' THEN nullif(title, '') END) AS title,
        coalesce(source_abstract, CASE WHEN text_status = 'pending' THEN abstract END, '') AS abstract, coalesce(own, s, '') AS subjects FROM sp LEFT JOIN k ON id = l_orderkey)
      SELECT * FROM t WHERE title IS NOT NULL"""),
    "moved_to_source": (moved_to_source, f"""WITH {_SP}, m AS (SELECT *, text_status = 'pending' AND coalesce(source_title, '') = '' AS mv FROM sp)
      SELECT id, CASE WHEN mv THEN title ELSE source_title END AS source_title, CASE WHEN NOT mv THEN title END AS title, CASE WHEN mv THEN abstract ELSE source_abstract END AS source_abstract,
      CASE WHEN NOT mv THEN abstract END AS abstract FROM m"""),
    "render_lists": (render_lists, """WITH f AS (SELECT l_orderkey AS id, max(l_quantity) > 40 AS has FROM lineitem GROUP BY 1)
      SELECT 'backfill' AS mode, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM f) UNION ALL SELECT 'incremental', o_orderkey FROM orders WHERE o_orderdate >= '1998-01-01'
      UNION ALL SELECT 'figures', o_orderkey FROM orders WHERE o_orderkey IN (SELECT id FROM f WHERE NOT has) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""),
    "reconciled_qa": (reconciled_qa, f"""WITH {_SP}, q AS (SELECT *, CASE id % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS qa FROM sp),
      c AS (SELECT id, qa, text_status = 'complete' AND qa IS DISTINCT FROM 'pass' AND coalesce(title, '') <> '' AND abstract <> '' AS changed FROM q)
      SELECT id, CASE WHEN changed THEN 'pass' ELSE qa END AS qa_status, changed FROM c"""),
    "ocr_needs": (ocr_needs, "SELECT doc_id, coalesce(length(text) < 1500, true) AS need_ocr FROM documents"),
    "transfers": (transfers, """SELECT l_orderkey, l_linenumber, l_quantity - 5 AS raw_value FROM lineitem
      WHERE l_linestatus = 'F' AND l_suppkey % 2 = 0 AND l_partkey % 9 <> 0 AND l_quantity > 5 AND l_linenumber % 2 = 1"""),
    "pruned_files": (pruned_files, "SELECT l_shipdate AS modified, count(*) AS removed FROM lineitem WHERE l_shipdate < '1996-01-01' GROUP BY 1"),
    "missing_sources": (missing_sources, f"WITH {_IDS} SELECT id, o_totalprice FROM ids WHERE strftime(o_orderdate, '%Y%m') = '199603' AND o_orderkey % 2 = 1"),
    "downloads": (downloads, "SELECT o_orderkey AS id, '/pdf/' || o_orderkey AS pdf_url FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)"),
    "translations_with_source": (translations_with_source, """SELECT l_orderkey AS id, l_linenumber, o_orderpriority AS source_title, o_orderstatus AS source_abstract
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45"""),
    "batch_figures": (batch_figures, f"""WITH {_PN} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(translated) AS BIGINT) AS succeeded, CAST(sum(total - translated) AS BIGINT) AS failed,
      round(sum(translated) / CAST(sum(total) AS DOUBLE), 9) AS success_rate FROM pn"""),
    "smoke_gates": (smoke_gates, f"""WITH {_PN} SELECT c_nationkey, round(100 - translated / CAST(greatest(1, total) AS DOUBLE) * 100, 6) AS fail_rate, greatest(0, total - translated - flagged) AS failed,
      100 - translated / CAST(greatest(1, total) AS DOUBLE) * 100 <= 20.0 AS pass FROM pn"""),
    "run_severities": (run_severities, f"""WITH {_PN}, r AS (SELECT c_nationkey, total, CASE c_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN total ELSE flagged END AS failed FROM pn)
      SELECT c_nationkey, CASE WHEN failed = 0 THEN 'success' WHEN failed >= total THEN 'error' ELSE 'warning' END AS severity,
      round(round(CAST(total - failed AS DOUBLE) * 100 / total, 2), 1) AS success_rate FROM r"""),
    "merged_summaries": (merged_summaries, f"""WITH {_PN} SELECT c_nationkey AS run_id, total, CASE WHEN c_nationkey % 2 = 0 THEN translated END AS translated,
      CASE WHEN c_nationkey % 3 = 0 THEN flagged END AS flagged FROM pn"""),
    "storage_prefixes": (storage_prefixes, "SELECT l_returnflag AS prefix, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY 1"),
    "translated_figure_papers": (translated_figure_papers, "SELECT count(DISTINCT l_orderkey) AS papers FROM lineitem WHERE l_linenumber % 3 = 0"),
    "newest_log_lines": (newest_log_lines, """WITH l AS (SELECT user_id % 40 AS file, event_id AS line_no, 1000 - user_id % 40 AS modified FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS rn FROM l) SELECT file, line_no, modified FROM r WHERE rn <= 10 ORDER BY modified DESC, line_no DESC, file LIMIT 20"""),
    "extreme_files": (extreme_files, """WITH f AS (SELECT 'f/' || o_orderkey AS path, o_orderpriority AS name, o_orderdate AS modified, o_totalprice AS size FROM orders)
      (SELECT path, 'name' AS by FROM f ORDER BY name DESC, path DESC LIMIT 1) UNION ALL (SELECT path, 'modified' FROM f ORDER BY modified DESC, path DESC LIMIT 1) UNION ALL (SELECT path, 'size' FROM f ORDER BY size DESC, path DESC LIMIT 1)"""),
    "joined_records": (joined_records, "SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS segment FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer"),
    "lost_marker_lists": (lost_marker_lists, """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '[FIGURE:x] [TABLE:1]' ELSE '[FIGURE:' || o_orderkey || '] [FIGURE:x]' END AS lost FROM orders"""),
    "enum_violations": (enum_violations, """SELECT 'o_orderstatus' AS "column", count(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
      UNION ALL SELECT 'o_orderpriority', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"""),
    "saved_translations": (saved_translations, """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN coalesce(text, '') ELSE '' END AS body FROM documents)
      SELECT doc_id AS id, 'Title ' || doc_id AS title, 'short' AS abstract, 'Ada' AS creators, md5(body) AS body_md5, length(body) > 100 AS has_full_text,
      CASE WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'pass' END AS qa_status, CASE WHEN length(body) > 0 THEN 'complete' ELSE 'pending' END AS text_status,
      CASE WHEN length(body) > 0 THEN TIMESTAMP '2024-01-01' END AS text_completed_at FROM b"""),
    "full_texts": (full_texts, """WITH h AS (SELECT doc_id, coalesce(text, '') AS body, doc_id % 3 = 1 OR length(coalesce(text, '')) > 500 AS has FROM documents)
      SELECT doc_id, has AS has_full_text, md5(CASE WHEN has THEN body ELSE '' END) AS body_md5 FROM h"""),
    "name_parts": (name_parts, f"""WITH {_IDS} SELECT o_orderkey, id || '/v1 a' AS last, strftime(o_orderdate, '%Y%m') AS month, 'oai_example.org_' || id || '_v1_a' AS file,
      strftime(o_orderdate - INTERVAL 2 DAY, '%Y-%m-%d') AS day FROM ids"""),
    "title_cased": (title_cased, """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '-'
      || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part"""),
    "address_hashes": (address_hashes, "SELECT substr(sha256('10.0.0.' || user_id % 50), 1, 16) AS hash, count(*) AS n FROM events GROUP BY 1"),
    "api_errors": (api_errors, """WITH e AS (SELECT event_id, ([401, 402, 404, 429, 503, 200, 200, 200])[event_id % 8 + 1] AS s, CASE event_id % 3 WHEN 0 THEN 'rate limit hit' WHEN 1 THEN 'connection reset' ELSE '' END AS m FROM events)
      SELECT event_id, CASE WHEN s = 401 THEN 'auth' WHEN s = 402 THEN 'payment' WHEN s = 429 OR m LIKE '%rate limit%' THEN 'rate_limit' WHEN s >= 500 OR m LIKE '%connection%' THEN 'transient'
      WHEN s BETWEEN 400 AND 499 THEN 'client' ELSE 'unknown' END AS kind FROM e"""),
    "latex_paragraphs": (latex_paragraphs, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '|' || p_brand ELSE p_name || '|' || p_type END AS paragraphs FROM part"),
    "translation_checks": (translation_checks, """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'empty,citations,commands' WHEN 1 THEN (CASE WHEN (length(p_name) + 17.0) / (length(p_name) + 11) > 3 THEN 'length_ratio,' ELSE '' END) || 'placeholder_left'
      WHEN 2 THEN (CASE WHEN length(p_name) / (length(p_name) + 11.0) < 0.5 THEN 'length_ratio,' ELSE '' END) || 'citations,commands' WHEN 3 THEN 'length_ratio,citations,commands' ELSE '' END AS issues,
      CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_name || ' [1] \\alpha ' WHEN 2 THEN p_name WHEN 3 THEN repeat(p_name || ' [1] \\alpha', 4) ELSE p_name || ' [1] \\alpha' END AS plain FROM part"""),
    "full_bodies": (full_bodies, "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN false ELSE coalesce(len(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '\\S'))) > 0, false) END AS \"full\" FROM documents"),
    "pdf_urls": (pdf_urls, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x/' || o_orderkey || '.PDF' ELSE 'http://y/' || o_orderkey || '.pdf' END AS url FROM orders"),
    "received_amounts": (received_amounts, """WITH s AS (SELECT l_orderkey, coalesce(sum(CAST(l_quantity * 1000 AS BIGINT)) FILTER (l_returnflag = 'R'), 0) AS raw FROM lineitem GROUP BY 1)
      SELECT l_orderkey, CAST(raw AS BIGINT) AS raw, CAST(raw / 1000.0 AS DECIMAL(20,3)) AS amount FROM s"""),
    "console_tails": (console_tails, """SELECT doc_id, md5(array_to_string(list_transform((string_split(coalesce(text, ''), chr(10)))[-10:], lambda x: substr(replace(x, '`', chr(39)), 1, 500)), chr(10))) AS tail_md5 FROM documents"""),
    "escaped_markdown": (escaped_markdown, r"""SELECT doc_id, md5(regexp_replace(text, '([\\`*_{}\[\]()#+\-.!|<>])', '\\\1', 'g')) AS escaped_md5 FROM documents"""),
    "noisy_objects": (noisy_objects, "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"),
    "glossaries": (glossaries, """SELECT p_brand, md5(coalesce(string_agg(p_name || ' => ' || p_type, chr(10) ORDER BY p_partkey) FILTER (p_partkey % 4 <> 0), '')) AS text_md5 FROM part GROUP BY 1"""),
    "jsonl_round_trip": (jsonl_round_trip, """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice,
      o_orderkey % 10 = 0 AS bad FROM orders"""),
    "costs_since": (costs_since, "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS cost FROM events WHERE ts >= '2024-01-03' GROUP BY 1"),
    "run_manifests": (run_manifests, """SELECT 'run-' || o_orderkey AS run_id, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS attempted,
      CAST(0 AS BIGINT) AS flagged, CAST(0 AS DOUBLE) AS figure_cost, CAST(0.5 AS DOUBLE) AS total_cost FROM orders"""),
    "id_list_round_trip": (id_list_round_trip, "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events"),
    "record_arrays": (record_arrays, "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, 'a,b' AS subjects FROM nation WHERE n_regionkey <> 2"),
    "xml_records": (xml_records, """SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, '' AS abstract, 'A,B' AS creators, '2024-02-03' AS date, 'http://x/' || n_nationkey || '.pdf' AS pdf_url
      FROM nation WHERE n_nationkey % 5 <> 0"""),
    "archive_records": (archive_records, """SELECT 'ia-' || p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS abstract, CASE WHEN p_partkey % 3 = 0 THEN 'Ada|Bo' ELSE 'Solo' END AS creators,
      0 AS n_subjects, (1990 + p_size) || '-05' AS date FROM part WHERE p_size >= 15"""),
    "migrated": (migrated, """WITH c AS (SELECT count(*) AS n FROM orders), t AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 = 0),
      m AS (SELECT o_orderkey % 2 = 1 AS has_figures, 1 AS creators FROM orders UNION ALL SELECT false, 0 FROM orders WHERE o_orderkey % 5 = 0)
      SELECT has_figures, creators, count(*) AS n, (SELECT n FROM c) + (SELECT n FROM t) AS target, (SELECT n FROM c) AS source FROM m GROUP BY 1, 2"""),
    "figure_manifest": (figure_manifest, """WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), f AS (
        SELECT l_orderkey AS paper_id, l_linenumber AS number, '/f/' || l_partkey AS url FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM r)
        UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, '/f/' || l_partkey FROM lineitem WHERE l_returnflag = 'R')
      SELECT paper_id, CAST(count(*) AS INT) AS figure_count, string_agg(url, ',' ORDER BY number, url) AS urls FROM f GROUP BY 1"""),
    "pointer_records": (pointer_records, "SELECT o_orderkey AS paper_id, 'validated/' || o_orderkey AS key, 'run-7' AS run_id, TIMESTAMP '2024-01-02' AS validated_at FROM orders"),
    "report_round_trip": (report_round_trip, """WITH d AS (SELECT o_orderstatus AS label, count(*) AS value FROM orders GROUP BY 1)
      SELECT '# Run' || chr(10) || chr(10) || string_agg('- **' || label || ':** ' || value, chr(10) ORDER BY label) AS text, CAST(sum(value) AS BIGINT) AS total FROM d"""),
}

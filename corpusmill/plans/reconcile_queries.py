"""Reconciliation and work-set queries over the driver tables: name -> (query, DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import neardup, reconcile, workset
from corpusmill.plans.views import PAPERS, papers, table

AS_OF = "1998-06-01 00:00:00"


def work_papers(spark, sf):
    """Orders as a work table: status by order status, started on the order date (null for every thirteenth)."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("processing_status"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("timestamp")).alias("processing_started_at"),
        F.when(F.col("o_orderkey") % 3 == 0, "complete").when(F.col("o_orderkey") % 3 == 1, "pending").otherwise("failed").alias("text_status"),
        F.when(F.col("o_orderkey") % 5 == 0, "complete").otherwise("pending").alias("figures_status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("title"),
        F.lit(None).cast("string").alias("source_title"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp")).alias("date"),
    )


_W = """w AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS processing_status,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS started, CASE o_orderkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'pending' ELSE 'failed' END AS text_status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'complete' ELSE 'pending' END AS figures_status, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS title,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS date FROM orders)"""


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def work_queue_default(spark, sf):
    return workset.work_queue(work_papers(spark, sf), _as_of()).select("id", "processing_status")


def work_queue_figures(spark, sf):
    return workset.work_queue(work_papers(spark, sf), _as_of(), "figures_only").select("id")


def work_queue_resume(spark, sf):
    listed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().union(spark.range(1).select(F.lit(-1).cast("long")))
    known = work_papers(spark, sf).withColumn("processing_status", F.when(F.col("text_status") == "complete", "complete").otherwise("pending"))
    return workset.resume(listed, known, "figures")


def needs_translation(spark, sf):
    return workset.needs_translation(work_papers(spark, sf), 200).select("id", "text_status")


def claimable(spark, sf):
    return workset.claimable(work_papers(spark, sf), _as_of()).select("id")


def _jobs(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ("pending", "in_progress", "completed", "failed", "completed"))), (F.col("event_id") % 5 + 1).cast("int"))
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), status.alias("status"), (F.col("user_id") % 5).cast("int").alias("attempts"), at.alias("created_at"),
        F.when(F.col("event_id") % 7 != 0, at).alias("started_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.when(F.col("event_id") % 9 != 0, at).alias("completed_at"),
    )


_J = """j AS (SELECT event_id AS id, (['pending', 'in_progress', 'completed', 'failed', 'completed'])[event_id % 5 + 1] AS status, CAST(user_id % 5 AS INT) AS attempts, ts AS created_at,
  CASE WHEN event_id % 7 <> 0 THEN ts END AS started_at, CASE WHEN event_id % 9 <> 0 THEN ts END AS completed_at FROM events)"""


def jobs_status(spark, sf):
    return workset.job_counts(_jobs(spark, sf))


def recent_completions(spark, sf):
    jobs = _jobs(spark, sf).withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return workset.recent_completions(jobs, 25).select("id")


def claim_batch(spark, sf):
    return workset.claim(_jobs(spark, sf), 50).select("id", "attempts")


def compact_queue(spark, sf):
    return workset.compact(_jobs(spark, sf), 300)[0].select("id", "status")


def compact_archive(spark, sf):
    return workset.compact(_jobs(spark, sf), 300)[1].select("id")


def _months(spark, sf):
    return table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"), (F.col("o_orderkey") % 400 + 1).alias("number"))


def missing_numbers(spark, sf):
    return workset.missing_numbers(_months(spark, sf))


def until_misses(spark, sf):
    found = _months(spark, sf).distinct().withColumn("hit", F.lit(True))
    every = found.groupBy("month").agg(F.max("number").alias("top")).select("month", F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("number"))
    probes = every.join(found, ["month", "number"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return workset.until_misses(probes, 4).groupBy("month").agg(F.count("*").alias("probed"), F.count_if("hit").alias("hits"))


def distinct_months(spark, sf):
    return workset.newest_months(_months(spark, sf), 12)


def month_gaps(spark, sf):
    span = spark.sql("SELECT DATE'1994-12-15' AS a, DATE'2003-02-01' AS b")
    return workset.harvest_progress(_months(spark, sf), workset.month_list(span, "a", "b"))


def first_missing_month(spark, sf):
    return workset.first_missing(month_gaps(spark, sf))


def _artefacts(spark, sf):
    items = table(spark, sf, "lineitem")
    pick = lambda cond: items.filter(cond).select("l_orderkey")
    return {"text": pick("l_linenumber >= 3"), "figures": pick("l_returnflag = 'R'"), "pdf": pick("l_linestatus = 'F'")}


def status_backfill(spark, sf):
    p = work_papers(spark, sf).withColumn("pdf_status", F.when(F.col("id") % 7 == 0, "failed").otherwise("pending"))
    return reconcile.status_backfill(p, _artefacts(spark, sf)).select("id", "new_text_status", "new_figures_status", "new_pdf_status", "new_status")


def status_summary(spark, sf):
    p = work_papers(spark, sf).withColumn("pdf_status", F.when(F.col("id") % 7 == 0, "failed").otherwise("pending"))
    out = reconcile.status_backfill(p, _artefacts(spark, sf))
    return reconcile.change_counts(out)


def stage_summary(spark, sf):
    return reconcile.stage_summary(work_papers(spark, sf), ["text", "figures"])


_B = f"""{_W}, b0 AS (SELECT w.*, CASE WHEN id % 7 = 0 THEN 'failed' ELSE 'pending' END AS pdf_status, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_linenumber >= 3) AS t,
  EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R') AS f, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_linestatus = 'F') AS p FROM w),
b1 AS (SELECT *, CASE WHEN t THEN 'complete' WHEN text_status IN ('failed', 'complete') THEN text_status ELSE 'pending' END AS new_text_status,
  CASE WHEN f THEN 'complete' WHEN figures_status IN ('failed', 'complete') THEN figures_status ELSE 'pending' END AS new_figures_status, CASE WHEN p THEN 'complete' ELSE pdf_status END AS new_pdf_status FROM b0),
b AS (SELECT *, CASE WHEN new_text_status = 'complete' AND new_figures_status = 'complete' AND new_pdf_status = 'complete' THEN 'complete'
  WHEN 'failed' IN (new_text_status, new_figures_status, new_pdf_status, processing_status) THEN 'failed' ELSE 'pending' END AS new_status FROM b1)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), "doc_id")).alias("url"))


def _labels(spark, sf):
    return table(spark, sf, "labels").withColumnRenamed("doc_id", "id")


def drift(spark, sf):
    return reconcile.drift(_docs(spark, sf), _labels(spark, sf)).select("id")


def drift_fixed(spark, sf):
    return reconcile.fix_drift(_docs(spark, sf), _labels(spark, sf), "http://store").select("id", "url")


def missing_ids(spark, sf):
    return reconcile.not_found(_docs(spark, sf), _labels(spark, sf))


def insert_if_new(spark, sf):
    have, new = _labels(spark, sf).select("id", F.lit("old").alias("state")), _docs(spark, sf).select("id")
    return reconcile.insert_new(have, new, {"state": "new"})


def enqueue_new(spark, sf):
    queue = _labels(spark, sf).select("id", F.lit("completed").alias("status"), F.lit(1).alias("attempts"))
    return reconcile.enqueue(queue, _docs(spark, sf))


def unseen_records(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return reconcile.unseen(items, table(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "id"), "seq", 500).select("id", "seq")


def classify_artefacts(spark, sf):
    t = _labels(spark, sf).select("id", F.when(F.col("quality") == 1, "pass").otherwise("flag").alias("status"))
    return reconcile.classify_artefacts(t, _docs(spark, sf).filter("source IN ('src0', 'src1', 'src2', 'src3')"))


def deletion_report(spark, sf):
    out = reconcile.deletion_report(classify_artefacts(spark, sf), 20)
    return out.select("verdict", "n", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


def sync_changed(spark, sf):
    target = _docs(spark, sf).select("id", F.lit(1).alias("quality"))
    out = reconcile.sync_column(target, _labels(spark, sf), "quality")
    return out.select("id", "quality", "changed")


def upsert_last(spark, sf):
    old = _labels(spark, sf).select("id", "quality", F.lit(0).cast("long").alias("seq"))
    new = _docs(spark, sf).filter("id % 4 = 0").select("id", F.lit(7).alias("quality"), F.col("id").alias("seq"))
    return reconcile.upsert(old, new, "id", "seq").select("id", "quality")


def replace_subjects(spark, sf):
    child = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("subject")).distinct()
    new = table(spark, sf, "orders").filter("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("subject"))
    return reconcile.replace_children(child, new, "paper_id")


def staged_updates(spark, sf):
    t = work_papers(spark, sf).select("id", F.col("text_status").alias("status"), F.when(F.col("id") % 9 == 0, F.lit("1990-01-01").cast("timestamp")).alias("completed_at"))
    staged = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("complete").alias("status"))
    return reconcile.apply_staged(t, staged, _as_of()).select("id", "status", F.date_format("completed_at", "yyyy-MM-dd").alias("day"))


def last_costs(spark, sf):
    costs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_quantity").groupBy("paper_id", "line").agg(F.max("l_quantity").alias("cost"))
    return reconcile.with_last_cost(papers(spark, sf), costs.withColumnRenamed("line", "seq")).select("id", "cost")


def marker_sets(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"), "l_returnflag")
    out = reconcile.marker_sets(items.filter("l_returnflag <> 'N'"), items.filter("l_returnflag <> 'A'"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("paper_id", *[joined(c) for c in ("valid", "missing", "extra")])


def union_ids(spark, sf):
    return reconcile.id_sources(_docs(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


def pending_split(spark, sf):
    return reconcile.split_by_membership(_docs(spark, sf), _labels(spark, sf))[0].select("id")


def near_duplicate_vectors(spark, sf):
    codes = table(spark, sf, "embeddings").select("vec_id", neardup.sign_hash("embedding").alias("code"))
    return neardup.near_pairs(codes, "vec_id", "code", 5)


def near_duplicate_classes(spark, sf):
    codes = table(spark, sf, "embeddings").select("vec_id", neardup.sign_hash("embedding").alias("code"))
    return neardup.code_classes(codes, "vec_id", "code")


def near_duplicates_kept(spark, sf):
    codes = table(spark, sf, "embeddings").select("label", "vec_id", neardup.sign_hash("embedding").alias("code"))
    return neardup.keep_greedy(codes, "label", "vec_id", "code", 12)


def near_texts(spark, sf):
    """Pairs of documents whose word codes differ in five bits at most."""
    docs = table(spark, sf, "documents")
    return neardup.near_pairs(neardup.token_hash(docs, "doc_id", "text"), "doc_id", "code", 5)


def near_texts_kept(spark, sf):
    """The documents that a fold over all of them in order keeps: near no kept one."""
    docs = table(spark, sf, "documents")
    return neardup.keep_greedy(neardup.token_hash(docs, "doc_id", "text"), None, "doc_id", "code", 5)


def near_text_classes(spark, sf):
    """Documents by the first with the same word code."""
    docs = table(spark, sf, "documents")
    return neardup.code_classes(neardup.token_hash(docs, "doc_id", "text"), "doc_id", "code")


def clamp_report(spark, sf):
    """Documents as titles, some in tags: which a clamp changes, with the language as the title to fall back on."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<PARA id=1>"), "text", F.lit("</PARA>"))).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("title"))
    sources = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"))
    return reconcile.clamp_report(reconcile.title_fallback(docs, sources)).select("id", "old_length", "new_length", "had_tags", F.md5("prefix").alias("prefix"))


def best_matches(spark, sf):
    """The whole texts of a conversation's answers sought among those of its questions."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "role", "text").filter("text IS NOT NULL")
    texts = turns.filter("role = 'assistant'").select("doc_id", "text")
    found = turns.filter("role <> 'assistant'").select("doc_id", F.col("text").alias("candidate"))
    return reconcile.best_matches(texts, found).select("doc_id", F.md5("text").alias("md5"), "score", "matched")


_CODES = r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents),
      n AS (SELECT doc_id, md5(w) AS h, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL), b AS (SELECT doc_id, i, sum(CASE WHEN (('0x' || substr(h, 1 + 4 * CAST(i // 16 AS INT), 4))::INT >> CAST(15 - i % 16 AS INT)) & 1 = 1 THEN n ELSE -n END) > 0 AS bit
        FROM n, range(64) r(i) GROUP BY ALL), c AS (SELECT doc_id, list(bit ORDER BY i) AS code FROM b GROUP BY doc_id),
      k AS (SELECT doc_id, list_reduce(list_transform(code, lambda x: CASE WHEN x THEN '1' ELSE '0' END), lambda x, y: x || y)::BIT AS code FROM c)"""

PLANS = {
    "work_queue_default": (work_queue_default, f"WITH {_W} SELECT id, processing_status FROM w WHERE processing_status = 'pending' OR (processing_status = 'processing' AND started < TIMESTAMP '{AS_OF}' - INTERVAL 4 HOUR) OR (processing_status = 'failed' AND started < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)"),
    "work_queue_figures": (work_queue_figures, f"WITH {_W} SELECT id FROM w WHERE text_status = 'complete' AND figures_status <> 'complete'"),
    "work_queue_resume": (work_queue_resume, f"WITH {_W}, l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem UNION ALL SELECT -1) SELECT l.id FROM l LEFT JOIN w ON w.id = l.id WHERE w.id IS NULL OR NOT (text_status = 'complete' AND figures_status = 'complete')"),
    "needs_translation": (needs_translation, f"WITH {_W} SELECT id, text_status FROM w WHERE text_status IN ('pending', 'failed') AND title IS NOT NULL ORDER BY date DESC NULLS LAST, id LIMIT 200"),
    "claimable": (claimable, f"WITH {_W} SELECT id FROM w WHERE processing_status <> 'processing' OR started < TIMESTAMP '{AS_OF}' - INTERVAL 4 HOUR"),
    "jobs_status": (jobs_status, f"WITH {_J}, c AS (SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM j) SELECT *, round(completed * 100.0::DOUBLE / total, 1) AS progress, pending * 25 AS eta_seconds FROM c"),
    "recent_completions": (recent_completions, f"WITH {_J} SELECT id FROM j WHERE status = 'completed' ORDER BY completed_at DESC NULLS LAST, id LIMIT 25"),
    "claim_batch": (claim_batch, f"WITH {_J} SELECT id, attempts FROM j WHERE status = 'pending' AND attempts < 3 ORDER BY created_at, id LIMIT 50"),
    "compact_queue": (compact_queue, f"WITH {_J}, k AS (SELECT id FROM j WHERE status = 'completed' ORDER BY coalesce(completed_at, started_at, created_at) DESC NULLS FIRST, id DESC LIMIT 300) SELECT id, status FROM j WHERE status <> 'completed' OR id IN (SELECT id FROM k)"),
    "compact_archive": (compact_archive, f"WITH {_J}, k AS (SELECT id FROM j WHERE status = 'completed' ORDER BY coalesce(completed_at, started_at, created_at) DESC NULLS FIRST, id DESC LIMIT 300) SELECT id FROM j WHERE status = 'completed' AND id NOT IN (SELECT id FROM k)"),
    "missing_numbers": (missing_numbers, "WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month, o_orderkey % 400 + 1 AS number FROM orders), t AS (SELECT month, unnest(range(1, max(number) + 1)) AS number FROM m GROUP BY month) SELECT month, number FROM t EXCEPT SELECT month, number FROM m"),
    "until_misses": (until_misses, """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month, o_orderkey % 400 + 1 AS number FROM orders), t AS (SELECT month, unnest(range(1, max(number) + 1)) AS number FROM m GROUP BY month),
      p AS (SELECT t.month, t.number, m.number IS NOT NULL AS hit FROM t LEFT JOIN m USING (month, number)), i AS (SELECT *, sum(hit::INT) OVER (PARTITION BY month ORDER BY number) AS island FROM p),
      r AS (SELECT month, number, row_number() OVER (PARTITION BY month, island ORDER BY number) AS rn FROM i WHERE NOT hit), s AS (SELECT month, min(number) AS stop FROM r WHERE rn = 4 GROUP BY month)
      SELECT month, count(*) AS probed, count(*) FILTER (hit) AS hits FROM p LEFT JOIN s USING (month) WHERE stop IS NULL OR number < stop GROUP BY month"""),
    "distinct_months": (distinct_months, "SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders ORDER BY month DESC LIMIT 12"),
    "month_gaps": (month_gaps, "WITH e AS (SELECT strftime(d, '%Y%m') AS month FROM (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2003-02-01', INTERVAL 1 MONTH)) AS d)) SELECT month, count(o_orderkey) AS n, count(o_orderkey) > 0 AS complete FROM e LEFT JOIN orders ON strftime(o_orderdate, '%Y%m') = month GROUP BY month"),
    "first_missing_month": (first_missing_month, "WITH e AS (SELECT strftime(d, '%Y%m') AS month FROM (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2003-02-01', INTERVAL 1 MONTH)) AS d)) SELECT min(month) AS month FROM e WHERE month NOT IN (SELECT strftime(o_orderdate, '%Y%m') FROM orders)"),
    "status_backfill": (status_backfill, f"WITH {_B} SELECT id, new_text_status, new_figures_status, new_pdf_status, new_status FROM b"),
    "status_summary": (status_summary, f"WITH {_B} SELECT count(*) FILTER (new_status = 'complete' AND processing_status <> 'complete') AS upgraded, count(*) FILTER (processing_status = 'failed' AND new_status = 'failed') AS preserved_failed, count(*) FILTER (processing_status = new_status AND processing_status <> 'failed') AS no_change FROM b"),
    "stage_summary": (stage_summary, f"WITH {_W} SELECT count(*) AS total, count(id) AS with_id, count(*) FILTER (text_status = 'complete') AS text_complete, count(*) FILTER (figures_status = 'complete') AS figures_complete FROM w"),
    "drift": (drift, "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM labels)"),
    "drift_fixed": (drift_fixed, "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'http://store/' || doc_id || '.pdf' END AS url FROM documents"),
    "missing_ids": (missing_ids, "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels"),
    "insert_if_new": (insert_if_new, "SELECT doc_id AS id, 'old' AS state FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "enqueue_new": (enqueue_new, "SELECT doc_id AS id, 'completed' AS status, 1 AS attempts FROM labels UNION ALL SELECT doc_id, 'pending', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "unseen_records": (unseen_records, "SELECT l_orderkey AS id, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1 ORDER BY seq LIMIT 500"),
    "classify_artefacts": (classify_artefacts, """WITH t AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'pass' ELSE 'flag' END AS status, doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) AS f FROM labels),
      v AS (SELECT id, status, CASE WHEN status <> 'pass' AND f THEN 'flagged_with_pdf' WHEN status <> 'pass' THEN 'flagged_no_pdf' WHEN NOT f THEN 'no_pdf' END AS verdict FROM t) SELECT * FROM v WHERE verdict IS NOT NULL"""),
    "deletion_report": (deletion_report, """WITH t AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'pass' ELSE 'flag' END AS status, doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) AS f FROM labels),
      v AS (SELECT id, status, CASE WHEN status <> 'pass' AND f THEN 'flagged_with_pdf' WHEN status <> 'pass' THEN 'flagged_no_pdf' WHEN NOT f THEN 'no_pdf' END AS verdict FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY id) AS rn FROM v WHERE verdict IS NOT NULL)
      SELECT verdict, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (rn <= 20) AS items FROM r GROUP BY verdict"""),
    "sync_changed": (sync_changed, "SELECT d.doc_id AS id, coalesce(l.quality, 1) AS quality, l.quality IS NOT NULL AND l.quality <> 1 AS changed FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "upsert_last": (upsert_last, "SELECT doc_id AS id, 7 AS quality FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)"),
    "replace_subjects": (replace_subjects, "SELECT DISTINCT l_orderkey AS paper_id, l_returnflag AS subject FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0) UNION ALL SELECT DISTINCT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 6 = 0"),
    "staged_updates": (staged_updates, f"WITH {_W} SELECT id, CASE WHEN id % 2 = 0 THEN 'complete' ELSE text_status END AS status, CASE WHEN id % 9 = 0 THEN '1990-01-01' WHEN id % 2 = 0 AND text_status <> 'complete' THEN '1998-06-01' END AS day FROM w"),
    "last_costs": (last_costs, "SELECT o_orderkey AS id, coalesce((SELECT max(l_quantity) FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_linenumber = (SELECT max(l_linenumber) FROM lineitem m WHERE m.l_orderkey = o_orderkey)), 0) AS cost FROM orders"),
    "marker_sets": (marker_sets, """WITH m AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'N'), f AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'A'),
      j AS (SELECT coalesce(m.p, f.p) AS p, coalesce(m.n, f.n) AS n, m.p IS NOT NULL AS a, f.p IS NOT NULL AS b FROM m FULL JOIN f ON m.p = f.p AND m.n = f.n)
      SELECT p AS paper_id, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (a AND b), '') AS valid, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (a AND NOT b), '') AS missing, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (NOT a AND b), '') AS extra FROM j GROUP BY p"""),
    "union_ids": (union_ids, "SELECT doc_id AS id FROM documents UNION SELECT o_orderkey FROM orders"),
    "pending_split": (pending_split, "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "near_duplicate_classes": (near_duplicate_classes, "WITH h AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS code FROM embeddings) SELECT vec_id, min(vec_id) OVER (PARTITION BY code) AS class FROM h"),
    "near_duplicate_vectors": (near_duplicate_vectors, """WITH h AS (SELECT min(vec_id) AS vec_id, code FROM (SELECT vec_id, list_reduce(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)::BIT AS code FROM embeddings) GROUP BY code)
      SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.code, b.code)) AS INT) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.code, b.code)) <= 5"""),
    "near_duplicates_kept": (
        near_duplicates_kept,
        """WITH RECURSIVE h AS (SELECT label, vec_id, list_reduce(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)::BIT AS code,
        row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
      r AS (SELECT label, rn, vec_id, code, true AS kept, [code] AS held FROM h WHERE rn = 1
        UNION ALL SELECT h.label, h.rn, h.vec_id, h.code, len(list_filter(held, lambda x: bit_count(xor(x, h.code)) <= 12)) = 0,
          CASE WHEN len(list_filter(held, lambda x: bit_count(xor(x, h.code)) <= 12)) = 0 THEN list_append(held, h.code) ELSE held END FROM r JOIN h ON h.label = r.label AND h.rn = r.rn + 1)
      SELECT r.label, r.vec_id, CAST(list_reduce(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END), lambda a, b: a * 2 + b)
        - CASE WHEN embedding[1] > 0 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END AS BIGINT) AS code FROM r JOIN embeddings USING (vec_id) WHERE kept""",
    ),
    "clamp_report": (clamp_report, r"""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '<PARA id=1>' || text || '</PARA>' ELSE text END AS title FROM documents),
      c AS (SELECT *, trim(regexp_replace(trim(regexp_replace(title, '(?i)</?\s*para\b[^>]*>', '', 'g')), '\s+', ' ', 'g')) AS t FROM t), n AS (SELECT *, CASE WHEN length(t) <= 300 THEN t ELSE rtrim(substr(t, 1, 297)) || '...' END AS new FROM c)
      SELECT id, CAST(length(title) AS INT) AS old_length, CAST(length(new) AS INT) AS new_length, id % 3 = 0 AS had_tags, md5(substr(title, 1, 160)) AS prefix FROM n WHERE title <> new"""),
    "near_texts": (near_texts, f"""{_CODES}, f AS (SELECT min(doc_id) AS i, code FROM k GROUP BY code)
      SELECT x.i AS a, y.i AS b, CAST(bit_count(xor(x.code, y.code)) AS INT) AS distance FROM f x JOIN f y ON x.i < y.i WHERE bit_count(xor(x.code, y.code)) <= 5"""),
    "near_text_classes": (near_text_classes, f"{_CODES} SELECT doc_id, min(doc_id) OVER (PARTITION BY code) AS class FROM k"),
    "near_texts_kept": (
        near_texts_kept,
        f"""{_CODES.replace("WITH w", "WITH RECURSIVE w")}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM k),
      r AS (SELECT rn, doc_id, true AS kept, [code] AS held FROM o WHERE rn = 1
        UNION ALL SELECT o.rn, o.doc_id, len(list_filter(held, lambda x: bit_count(xor(x, o.code)) <= 5)) = 0,
          CASE WHEN len(list_filter(held, lambda x: bit_count(xor(x, o.code)) <= 5)) = 0 THEN list_append(held, o.code) ELSE held END FROM r JOIN o ON o.rn = r.rn + 1)
      SELECT doc_id, CAST(list_reduce(list_transform(c.code, lambda x: CASE WHEN x THEN CAST(1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END), lambda a, b: a * 2 + b)
        - CASE WHEN c.code[1] THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END AS BIGINT) AS code FROM r JOIN c USING (doc_id) WHERE kept""",
    ),
    "best_matches": (best_matches, None),
}

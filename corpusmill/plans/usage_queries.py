"""Usage, cost and event queries over the driver tables: name -> (query, DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import usage
from corpusmill.plans.views import table, texts
from corpusmill.sources import io

WINDOW = 6 * 3600  # events of a key come hours apart


def requests(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("paper_id"), F.col("event_type").alias("request_type"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("ts").cast("timestamp").alias("created_at")
    )


def errors(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").filter("event_type = 'error'")
    return rows.select("event_id", (400 + k % 200).alias("status"), F.concat(F.lit("E"), (k % 5).cast("string")).alias("code"), F.col("ts").cast("timestamp").alias("created_at"), "user_id")


_E = "e AS (SELECT event_id, 400 + CAST(json_extract_string(props, '$.k') AS INT) % 200 AS status, 'E' || CAST(json_extract_string(props, '$.k') AS INT) % 5 AS code, ts, user_id FROM events WHERE event_type = 'error')"


def requests_top(spark, sf):
    return usage.ranked_requests(usage.request_counts(requests(spark, sf)), 20)


def requests_totals(spark, sf):
    return usage.request_totals(requests(spark, sf))


def requests_daily(spark, sf):
    return requests(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "request_type").agg(F.count("*").alias("n"))


def daily_history_running(spark, sf):
    runs = requests(spark, sf).select("created_at", F.lit(1).cast("long").alias("attempted"), (F.col("request_type") != "error").cast("long").alias("validated"))
    out = usage.daily_history(runs, ["attempted", "validated"], days=10, time="created_at")
    return out.withColumn("day", F.col("day").cast("string"))


def run_totals(spark, sf):
    runs = table(spark, sf, "events").select(
        F.lit(1).cast("long").alias("attempted"), (F.col("event_type") == "view").cast("long").alias("validated"), (F.col("event_type") == "error").cast("long").alias("flagged"),
        F.col("value").cast("decimal(18,2)").alias("cost"), F.col("ts").cast("timestamp").alias("completed_at"),
    )
    return usage.run_totals(runs).select("attempted", "validated", "flagged", F.col("cost").cast("double").alias("cost"), "pending", "progress")


def error_budget(spark, sf):
    return usage.error_buckets(errors(spark, sf), {"E1": "ALIAS"})


_EB = f"""{_E}, b AS (SELECT unnest(list_filter(['total', 'status:' || status, CASE WHEN status >= 500 THEN 'status:5xx' END, 'code:' || code, CASE WHEN code = 'E1' THEN 'code:ALIAS' END], lambda x: x IS NOT NULL)) AS bucket FROM e),
  c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket)"""


def budget_breach(spark, sf):
    limits = spark.createDataFrame([("total", 100), ("status:5xx", 10), ("code:E1", 10**9)], "bucket string, threshold long")
    return usage.budget_breaches(error_budget(spark, sf), limits)


def top_error_buckets(spark, sf):
    return usage.top_buckets(error_budget(spark, sf))


def alert_groups(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    alerts = table(spark, sf, "events").select(
        F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("m"), (k % 7).cast("string")).alias("message"),
        F.element_at(F.array(*map(F.lit, usage.SEVERITIES)), (k % 4 + 1).cast("int")).alias("level"),
    )
    out = usage.alert_groups(alerts, "6 hours")
    return out.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "severity", F.array_join(F.transform("messages", lambda m: F.concat(m["message"], F.lit("x"), m["n"].cast("string"))), ",").alias("messages"))


def error_types(spark, sf):
    text = F.concat(F.lit("Failed for doc-202401."), F.lpad(F.col("event_id").cast("string"), 5, "0"), F.lit(": "), F.when(F.col("user_id") % 2 == 0, F.lit("http://x/y")).otherwise(F.col("event_type")))
    return table(spark, sf, "events").select(X.error_type(text).alias("error_type")).groupBy("error_type").agg(F.count("*").alias("n"))


def accepted_requests(spark, sf):
    return usage.accept_spaced(requests(spark, sf), ["paper_id", "request_type"], WINDOW).select("event_id")


def rate_limited(spark, sf):
    return usage.limit_rate(requests(spark, sf), ["paper_id"], seconds=24 * 3600, most=2).select("event_id")


def failure_streaks(spark, sf):
    kinds = F.when(F.col("event_type") == "error", "persistent").when(F.col("event_type") == "view", "transient").otherwise("ok")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), kinds.alias("kind"))
    return usage.failure_streaks(rows, 2, 3)


def retention_last_n(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return usage.keep_last(rows, "timestamp", F.lit("2024-01-20 00:00:00").cast("timestamp"), 1000).select("event_id")


def cost_by_model(spark, sf):
    prices = spark.createDataFrame([("A", 0.5, 1.5), ("R", 0.25, 1.0)], "model string, input_price double, output_price double")
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"))
    costs = usage.with_cost(rows, prices)
    return costs.groupBy("model").agg(F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("cost"), F.count("*").alias("n"))


def spend_summary(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("pending").alias("text_status"))
    out = usage.spend_summary(rows)
    return out.select("done", "remaining", F.col("spent").cast("double").alias("spent"), F.col("to_spend").cast("double").alias("to_spend"))


def dated_price_join(spark, sf):
    day = F.to_date("o_orderdate").alias("day")
    prices = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), day).agg(F.max("o_totalprice").cast("decimal(20,2)").alias("price"))
    events = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("at"), F.lit("1-URGENT").alias("symbol"), F.col("l_quantity").cast("decimal(20,2)").alias("amount"))
    out = usage.with_day_price(events, prices)
    return out.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("price").alias("priced"), F.sum(F.col("value").cast("decimal(28,2)")).cast("double").alias("value"))


def metric_means(spark, sf):
    out = usage.metric_means(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], F.col("l_returnflag") != "N")
    return out.select("metric", F.round("mean", 4).alias("mean"))


def monthly_inventory(spark, sf):
    stage = F.element_at(F.array(*map(F.lit, ("harvest", "text", "figures", "pdf"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"), stage.alias("stage"), F.col("o_custkey").alias("n"), F.col("o_orderkey").alias("updated_at"))
    return usage.inventory(rows)


def gap_report(spark, sf):
    from corpusmill.plans.reconcile_queries import missing_numbers

    return usage.gap_report(missing_numbers(spark, sf)).select("month", "n", F.col("cost").cast("double").alias("cost"))


def model_comparison(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("model")).agg(F.sum(F.length("text")).alias("length")).withColumn("price", F.when(F.col("model") == "en", 0.5).otherwise(0.25))
    return usage.model_comparison(rows, "en")


def figure_stats(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("figures"))
    return usage.figure_stats(rows).withColumn("mean", F.round("mean", 6))


def archive_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(X.archive_links("html", ("html", "pdf"), "source")).alias("links"))


def page_texts(spark, sf):
    return texts(spark, sf, "pages").select("page_id", F.length(io.html_text("html")).alias("n"))


def page_records(spark, sf):
    good, rejects = io.page_records(texts(spark, sf, "pages"))
    return good.select("page_id", F.lit("record").alias("outcome")).union(rejects.select("page_id", "reason"))


def page_record_fields(spark, sf):
    """The records of pages whose own links are taken as subject links (even ids) or keyword links, and that have a PDF unless 5 divides the id."""
    kind = F.when(F.col("page_id") % 2 == 0, "subject").otherwise("keyword")
    html = F.replace("html", F.lit('<a href="/'), F.concat(F.lit('<a href="/'), kind, F.lit("/")))
    pdf = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("<a class=x href='/files/"), F.col("page_id").cast("string"), F.lit(".pdf?v=1'>PDF</a>"))).otherwise("")
    good, _ = io.page_records(texts(spark, sf, "pages").withColumn("html", F.concat(html, pdf)))
    return good.select("page_id", "title", F.array_join("subjects", "|").alias("subjects"), F.size("creators").alias("creators"), "pdf_url")


def conversation_order(spark, sf):
    """Turns put together in order, one row a conversation."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.size("t").alias("turns"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("md5"))


PLANS = {
    "requests_top": (requests_top, "SELECT * FROM (SELECT user_id AS paper_id, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, user_id) AS INT) AS rank FROM events GROUP BY user_id) WHERE rank <= 20"),
    "requests_totals": (requests_totals, "SELECT count(*) AS total, count(DISTINCT user_id) AS papers FROM events"),
    "requests_daily": (requests_daily, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS request_type, count(*) AS n FROM events GROUP BY ALL"),
    "daily_history_running": (daily_history_running, """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS validated FROM events GROUP BY 1),
      t AS (SELECT *, sum(attempted) OVER (ORDER BY day) AS total_attempted, sum(validated) OVER (ORDER BY day) AS total_validated FROM d)
      SELECT CAST(day AS VARCHAR) AS day, attempted, validated, CAST(total_attempted AS BIGINT) AS total_attempted, CAST(total_validated AS BIGINT) AS total_validated FROM t WHERE day > (SELECT max(day) FROM d) - INTERVAL 10 DAY"""),
    "run_totals": (run_totals, "SELECT count(*) AS attempted, count(*) FILTER (event_type = 'view') AS validated, count(*) FILTER (event_type = 'error') AS flagged, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, count(*) FILTER (event_type NOT IN ('view', 'error')) AS pending, round(count(*) FILTER (event_type = 'view') * 100.0::DOUBLE / count(*), 1) AS progress FROM events"),
    "error_budget": (error_budget, f"WITH {_EB} SELECT bucket, n FROM c"),
    "budget_breach": (budget_breach, f"WITH {_EB} SELECT bucket, n, CASE bucket WHEN 'total' THEN 100 WHEN 'status:5xx' THEN 10 END::BIGINT AS threshold FROM c WHERE (bucket = 'total' AND n > 100) OR (bucket = 'status:5xx' AND n > 10)"),
    "top_error_buckets": (top_error_buckets, f"WITH {_EB} SELECT bucket, n FROM c ORDER BY n DESC, bucket LIMIT 5"),
    "alert_groups": (alert_groups, """WITH a AS (SELECT event_type AS key, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, 'm' || CAST(json_extract_string(props, '$.k') AS INT) % 7 AS message, CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1 AS l FROM events),
      p AS (SELECT key, start, message, count(*) AS n, max(l) AS l FROM a GROUP BY ALL)
      SELECT key, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, CAST(sum(n) AS BIGINT) AS n, (['info', 'warning', 'error', 'critical'])[max(l)] AS severity, string_agg(message || 'x' || n, ',' ORDER BY n DESC, message) AS messages FROM p GROUP BY key, start"""),
    "error_types": (error_types, "SELECT CASE WHEN user_id % 2 = 0 THEN 'Failed' ELSE 'Failed: ' || event_type END AS error_type, count(*) AS n FROM events GROUP BY 1"),
    "accepted_requests": (accepted_requests, f"""WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
      f AS (SELECT event_id, user_id, event_type, rn, ts AS last, true AS ok FROM r WHERE rn = 1 UNION ALL
        SELECT r.event_id, r.user_id, r.event_type, r.rn, CASE WHEN epoch_us(r.ts) - epoch_us(f.last) >= {WINDOW}000000 THEN r.ts ELSE f.last END, epoch_us(r.ts) - epoch_us(f.last) >= {WINDOW}000000
        FROM f JOIN r ON r.user_id = f.user_id AND r.event_type = f.event_type AND r.rn = f.rn + 1) SELECT event_id FROM f WHERE ok"""),
    "rate_limited": (rate_limited, """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      f AS (SELECT event_id, user_id, rn, t + 86400000000 AS reset, 1 AS n FROM r WHERE rn = 1 UNION ALL
        SELECT r.event_id, r.user_id, r.rn, CASE WHEN r.t > f.reset THEN r.t + 86400000000 ELSE f.reset END, CASE WHEN r.t > f.reset THEN 1 ELSE f.n + 1 END
        FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT event_id FROM f WHERE n <= 2"""),
    "failure_streaks": (failure_streaks, """WITH k AS (SELECT user_id AS source, event_id AS seq, CASE event_type WHEN 'error' THEN 'persistent' WHEN 'view' THEN 'transient' ELSE 'ok' END AS kind FROM events),
      s AS (SELECT *, CAST(kind <> coalesce(lag(kind) OVER (PARTITION BY source ORDER BY seq), '') AS INT) AS step FROM k), i AS (SELECT *, sum(step) OVER (PARTITION BY source ORDER BY seq) AS island FROM s),
      n AS (SELECT source, seq, kind, CAST(row_number() OVER (PARTITION BY source, island ORDER BY seq) AS INT) AS streak FROM i) SELECT * FROM n WHERE (kind = 'persistent' AND streak = 2) OR (kind = 'transient' AND streak = 3)"""),
    "retention_last_n": (retention_last_n, "SELECT event_id FROM events WHERE date_trunc('second', ts) > TIMESTAMP '2024-01-20 00:00:00' ORDER BY event_id DESC LIMIT 1000"),
    "cost_by_model": (cost_by_model, "SELECT l_returnflag AS model, CAST(sum(CAST(CASE l_returnflag WHEN 'A' THEN l_quantity * 0.5 + l_linenumber * 1.5 WHEN 'R' THEN l_quantity * 0.25 + l_linenumber ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS cost, count(*) AS n FROM lineitem GROUP BY 1"),
    "spend_summary": (spend_summary, "SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS remaining, CAST(count(*) FILTER (o_orderstatus = 'F') * 0.08 AS DOUBLE) AS spent, CAST(count(*) FILTER (o_orderstatus <> 'F') * 0.08 AS DOUBLE) AS to_spend FROM orders"),
    "dated_price_join": (dated_price_join, """WITH p AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(max(o_totalprice) AS DECIMAL(20,2)) AS price FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
      SELECT strftime(l_shipdate, '%Y-%m') AS month, count(price) AS priced, CAST(sum(CAST(CAST(l_quantity AS DECIMAL(10,2)) * price AS DECIMAL(28,2))) AS DOUBLE) AS value FROM lineitem LEFT JOIN p ON CAST(l_shipdate AS DATE) = day GROUP BY 1"""),
    "metric_means": (metric_means, "SELECT metric, round(avg(v), 4) AS mean FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem WHERE l_returnflag <> 'N') GROUP BY metric"),
    "monthly_inventory": (monthly_inventory, "WITH l AS (SELECT strftime(o_orderdate, '%Y%m') AS month, o_orderkey % 4 AS s, arg_max(o_custkey, o_orderkey) AS n FROM orders GROUP BY ALL) SELECT month, coalesce(max(n) FILTER (s = 0), 0) AS harvest, coalesce(max(n) FILTER (s = 1), 0) AS text, coalesce(max(n) FILTER (s = 2), 0) AS figures, coalesce(max(n) FILTER (s = 3), 0) AS pdf FROM l GROUP BY month"),
    "gap_report": (gap_report, "WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month, o_orderkey % 400 + 1 AS number FROM orders), t AS (SELECT month, unnest(range(1, max(number) + 1)) AS number FROM m GROUP BY month), g AS (SELECT month, number FROM t EXCEPT SELECT month, number FROM m) SELECT month, count(*) AS n, CAST(count(*) * 5 * 0.08 AS DOUBLE) AS cost FROM g GROUP BY month"),
    "model_comparison": (model_comparison, "WITH l AS (SELECT lang AS model, CAST(sum(length(text)) AS BIGINT) AS length FROM documents GROUP BY lang) SELECT model, length, round(length / 4.0::DOUBLE * CASE WHEN model = 'en' THEN 0.5 ELSE 0.25 END, 8) AS cost, round(length * 100.0::DOUBLE / (SELECT length FROM l WHERE model = 'en'), 1) AS pct_of_base FROM l"),
    "figure_stats": (figure_stats, "WITH f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 0) AS papers_with, round(avg(n), 6) AS mean FROM f"),
    "archive_links": (archive_links, r"""SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1), lambda u: regexp_matches(u, '(?i)\.(html|pdf)(\?|$)|source'))) AS INT) AS links FROM pages"""),
    "page_texts": (page_texts, None),
    "page_records": (page_records, r"""WITH h AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t,
      regexp_matches(html, '(?i)href=["''][^"'']+\.pdf(\?[^"'']*)?["'']') AS pdf FROM pages) SELECT page_id, CASE WHEN length(CASE WHEN h1 <> '' THEN h1 ELSE t END) < 3 THEN 'no_title' WHEN NOT pdf THEN 'no_pdf' ELSE 'record' END AS outcome FROM h"""),
    "page_record_fields": (page_record_fields, r"""WITH h AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t,
      list_filter(list_transform(regexp_extract_all(html, '(?is)<a href="/[^"'']*"[^>]*>(.*?)</a>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS subjects FROM pages)
      SELECT page_id, CASE WHEN h1 <> '' THEN h1 ELSE t END AS title, array_to_string(subjects, '|') AS subjects, 0 AS creators, '/files/' || page_id || '.pdf?v=1' AS pdf_url FROM h WHERE page_id % 5 <> 0 AND length(CASE WHEN h1 <> '' THEN h1 ELSE t END) >= 3"""),
    "conversation_order": (conversation_order, "SELECT conv_id, CAST(count(*) AS INT) AS turns, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS md5 FROM conversations GROUP BY conv_id"),
}

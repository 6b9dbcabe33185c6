"""Catalogue queries over the driver tables: name -> (query, DuckDB oracle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import catalog, search
from corpusmill.plans.views import COUNTS, PAPERS, SUBJECTS, TAXONOMY, papers, subjects, table, taxonomy
from corpusmill.sources.scratch import new_folder

STEMMED = ("economies of rings", "the plates", "standards, widgets", "mediums of small gears")


def _filtered(spark, sf):
    return catalog.query_papers(papers(spark, sf), subjects(spark, sf), date_from="1995", date_to="1998-06", has_figures=True, wanted=["ECONOMY", "PROMO"])


_FILTERED = f"""{PAPERS}, {SUBJECTS}, filtered AS (SELECT * FROM papers WHERE qa_status = 'pass' AND has_figures AND date >= TIMESTAMP '1995-01-01'
  AND date <= TIMESTAMP '1998-06-30 23:59:59' AND EXISTS (SELECT 1 FROM subjects WHERE paper_id = id AND subject IN ('ECONOMY', 'PROMO')))"""


def catalog_page(spark, sf):
    page = catalog.page_of(_filtered(spark, sf), page=2, per_page=50)
    return page.select("id", F.date_format("date", "yyyy-MM-dd").alias("day"), "qa_status", "amount")


def catalog_count(spark, sf):
    return catalog.page_counts(_filtered(spark, sf), per_page=50)


def catalog_category(spark, sf):
    out = catalog.query_papers(papers(spark, sf), subjects(spark, sf), taxonomy(spark, sf), category="S", date_from="bad date")
    return out.select("id", "has_figures")


def subject_counts(spark, sf):
    return catalog.subject_counts(papers(spark, sf), subjects(spark, sf))


def _totals(spark, sf):
    return catalog.category_totals(subject_counts(spark, sf), taxonomy(spark, sf))


def category_papers(spark, sf):
    return catalog.category_papers(papers(spark, sf), subjects(spark, sf), taxonomy(spark, sf))


def facets(spark, sf):
    out = catalog.facets(subject_counts(spark, sf), taxonomy(spark, sf))
    listed = F.transform("subjects", lambda s: F.concat(s["subject"], F.lit("="), s["papers"].cast("string")))
    return out.select("category_id", F.array_join(listed, ";").alias("facets"))


def top_categories(spark, sf):
    return catalog.top_categories(_totals(spark, sf), slots=3)


def full_text_match(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.search_tokens("text", stem=False).alias("tokens"))
    return docs.filter(X.matches_all("tokens", "The and thing", stem=False)).select("doc_id")


def stemmed_search(spark, sf):
    """Parts whose name, type and brand hold forms of all words of a query, by an index that is written first."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    path = new_folder(spark, "index")
    search.write_index(search.postings(parts, "p_partkey", ["p_name", "p_type", "p_brand"]), "p_partkey", path)
    found = [search.find(spark, path, q).withColumn("query", F.lit(q)) for q in STEMMED]
    return reduce(DataFrame.unionByName, found)


def point_lookup(spark, sf):
    return catalog.paper(papers(spark, sf), 1).select("id", "qa_status")


def taxonomy_rows(spark, sf):
    return taxonomy(spark, sf).select("category_id", "category_order", "subject", "pinned")


def latest_errors(spark, sf):
    events = table(spark, sf, "events")
    return catalog.latest(events, F.col("event_type") == "error", "event_id", 20).select("event_id", "user_id")


def candidate_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("paragraphs"))
    return catalog.candidates(docs, 100).select("id", F.size("paragraphs").alias("n"))


_TOTALS = f"""{PAPERS}, {SUBJECTS}, {COUNTS}, {TAXONOMY}, totals AS (SELECT category_id, category_order, pinned, sum(coalesce(papers, 0)) AS total
  FROM taxonomy LEFT JOIN counts USING (subject) GROUP BY ALL)"""

PLANS = {
    "catalog_page": (catalog_page, f"WITH {_FILTERED} SELECT id, strftime(date, '%Y-%m-%d') AS day, qa_status, amount FROM filtered ORDER BY date DESC NULLS FIRST, id LIMIT 50 OFFSET 50"),
    "catalog_count": (catalog_count, f"WITH {_FILTERED} SELECT count(DISTINCT id) AS total, CAST(ceil(count(DISTINCT id) / 50.0) AS BIGINT) AS total_pages FROM filtered"),
    "catalog_category": (
        catalog_category,
        f"WITH {PAPERS}, {SUBJECTS}, {TAXONOMY} SELECT id, has_figures FROM papers WHERE qa_status = 'pass' AND id IN "
        "(SELECT paper_id FROM subjects JOIN taxonomy USING (subject) WHERE category_id = 'S')",
    ),
    "subject_counts": (subject_counts, f"WITH {PAPERS}, {SUBJECTS}, {COUNTS} SELECT subject, papers FROM counts"),
    "category_totals": (_totals, f"WITH {_TOTALS} SELECT category_id, category_order, pinned, CAST(total AS BIGINT) AS total FROM totals"),
    "category_papers": (
        category_papers,
        f"WITH {PAPERS}, {SUBJECTS}, {TAXONOMY} SELECT category_id, count(DISTINCT paper_id) AS papers FROM subjects JOIN papers ON paper_id = id "
        "JOIN taxonomy USING (subject) WHERE qa_status = 'pass' GROUP BY category_id",
    ),
    "facets": (
        facets,
        f"WITH {PAPERS}, {SUBJECTS}, {COUNTS}, {TAXONOMY} SELECT category_id, string_agg(subject || '=' || papers, ';' ORDER BY position) AS facets "
        "FROM taxonomy JOIN counts USING (subject) WHERE papers > 0 GROUP BY category_id",
    ),
    "top_categories": (
        top_categories,
        f"WITH {_TOTALS}, rest AS (SELECT *, row_number() OVER (ORDER BY total DESC, category_order) AS rank FROM totals WHERE NOT pinned) "
        "SELECT category_id, category_order, pinned, CAST(total AS BIGINT) AS total FROM (SELECT category_id, category_order, pinned, total FROM totals WHERE pinned "
        "UNION ALL SELECT category_id, category_order, pinned, total FROM rest WHERE rank <= 3 - (SELECT count(*) FROM totals WHERE pinned)) WHERE total > 0",
    ),
    "full_text_match": (
        full_text_match,
        "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'thing')",
    ),
    # every word form of the table that has one of the queries' stems
    "stemmed_search": (
        stemmed_search,
        """WITH stems(form, stem) AS (VALUES ('economy', 'economi'), ('ring', 'ring'), ('plate', 'plate'), ('standard', 'standard'), ('widget', 'widget'), ('medium', 'medium'), ('small', 'small'), ('gear', 'gear')),
      wanted(query, stem) AS (VALUES ('economies of rings', 'economi'), ('economies of rings', 'ring'), ('the plates', 'plate'), ('standards, widgets', 'standard'), ('standards, widgets', 'widget'),
        ('mediums of small gears', 'medium'), ('mediums of small gears', 'small'), ('mediums of small gears', 'gear')),
      has AS (SELECT DISTINCT p_partkey, stem FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\\p{L}\\p{N}]+')) AS form FROM part) JOIN stems USING (form)),
      k AS (SELECT query, count(*) AS k FROM wanted GROUP BY query), g AS (SELECT p_partkey, query, count(*) AS n FROM has JOIN wanted USING (stem) GROUP BY p_partkey, query)
      SELECT p_partkey, query FROM g JOIN k USING (query) WHERE n = k""",
    ),
    "point_lookup": (point_lookup, f"WITH {PAPERS} SELECT id, qa_status FROM papers WHERE id = 1 AND qa_status = 'pass'"),
    "taxonomy": (taxonomy_rows, f"WITH {TAXONOMY} SELECT category_id, category_order, subject, pinned FROM taxonomy"),
    "latest_errors": (latest_errors, "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20"),
    "candidate_documents": (
        candidate_documents,
        "SELECT doc_id AS id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL "
        "ORDER BY CASE WHEN len(string_split(text, chr(10))) > 20 THEN 0 ELSE 1 END, doc_id LIMIT 100",
    ),
}

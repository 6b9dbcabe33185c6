"""Catalogue queries: filters, facets, counts, pages and display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X

MAX_PAGE, MAX_PER_PAGE = 1000, 100


def query_papers(
    papers: DataFrame, subjects: DataFrame, taxonomy: DataFrame | None = None, category: str | None = None, date_from: str | None = None,
    date_to: str | None = None, search: str | None = None, has_figures: bool | None = None, wanted: list[str] | None = None,
) -> DataFrame:
    """Passed papers under all given filters; subjects override the category, blank values filter nothing.

    subjects has (paper_id, subject), taxonomy (category_id, subject); an unknown category gives no rows.
    """
    out = papers.filter(F.col("qa_status") == "pass")
    out = in_date_range(out, "date", date_from, date_to)
    if has_figures is not None:
        out = out.filter(F.col("has_figures") == has_figures)
    if search and search.strip():
        out = out.filter(X.matches_all("tokens", search) if "tokens" in papers.columns else X.matches_all(X.search_tokens("title"), search))
    if wanted:
        keys = subjects.filter(F.col("subject").isin(wanted))
    elif category:
        keys = subjects.join(taxonomy.filter(F.col("category_id") == category).select("subject").distinct(), "subject", "left_semi")
    else:
        return out
    return out.join(keys, out["id"] == keys["paper_id"], "left_semi")


def in_date_range(df: DataFrame, column: str, date_from: str | None, date_to: str | None) -> DataFrame:
    """B2: from the first second of one period to the last of another; a bad or blank bound filters nothing."""
    start, end = X.period_start(F.lit(date_from)), X.period_end(F.lit(date_to))
    c = F.col(column)
    return df.filter(F.coalesce(c >= start, start.isNull()) & F.coalesce(c <= end, end.isNull()))


def page_of(df: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    """Newest first, rows without a date before all, ids settle ties."""
    page, per_page = min(max(page, 1), MAX_PAGE), min(max(per_page, 1), MAX_PER_PAGE)
    return df.orderBy(F.desc_nulls_first("date"), "id").offset((page - 1) * per_page).limit(per_page)


def page_counts(df: DataFrame, per_page: int = 25) -> DataFrame:
    """(total, total_pages) of distinct ids."""
    total = F.countDistinct("id")
    return df.agg(total.alias("total"), F.ceil(total / min(max(per_page, 1), MAX_PER_PAGE)).alias("total_pages"))


def paper(papers: DataFrame, id_: object) -> DataFrame:
    """B4."""
    return papers.filter((F.col("id") == id_) & (F.col("qa_status") == "pass"))


def subject_counts(papers: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, papers) over passed papers; subjects has each (paper_id, subject) once."""
    passed = papers.filter(F.col("qa_status") == "pass").select("id")
    return subjects.join(passed, subjects["paper_id"] == passed["id"], "left_semi").groupBy("subject").agg(F.count("*").alias("papers"))


def category_totals(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(category_id, total): sums of subject counts, so a paper in two subjects counts twice.

    taxonomy is (category_id, category_order, pinned, subject), one row a subject; it is a small dimension.
    """
    joined = taxonomy.join(counts, "subject", "left")
    return joined.groupBy("category_id", "category_order", "pinned").agg(F.sum(F.coalesce("papers", F.lit(0))).alias("total"))


def category_papers(papers: DataFrame, subjects: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """D3, exact: (category_id, papers), each paper once."""
    passed = papers.filter(F.col("qa_status") == "pass").select("id")
    keyed = subjects.join(passed, subjects["paper_id"] == passed["id"], "left_semi")
    return keyed.join(taxonomy.select("category_id", "subject"), "subject").groupBy("category_id").agg(F.countDistinct("paper_id").alias("papers"))


def facets(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(category_id, subjects array<struct<subject, papers>>) in taxonomy order; empty subjects and categories go."""
    found = taxonomy.join(counts, "subject").filter("papers > 0")
    listed = F.array_sort(F.collect_list(F.struct("position", "subject", "papers")))
    return found.groupBy("category_id").agg(listed.alias("s")).select("category_id", F.transform("s", lambda x: F.struct(x["subject"].alias("subject"), x["papers"].alias("papers"))).alias("subjects"))


def top_categories(totals: DataFrame, slots: int = 5) -> DataFrame:
    """T4: pinned ones by order, then the largest in the slots that are left; zero counts go after that."""
    pinned = totals.filter("pinned")
    rank = F.row_number().over(Window.partitionBy("pinned").orderBy(F.desc("total"), "category_order"))
    rest = totals.filter("NOT pinned").withColumn("rank", rank)
    room = pinned.agg((F.lit(slots) - F.count("*")).alias("room"))
    rest = rest.crossJoin(F.broadcast(room)).filter("rank <= room").select(*totals.columns)  # one row
    return pinned.unionByName(rest).filter("total > 0")


def display_rows(df: DataFrame) -> DataFrame:
    """Figure addresses from JSON (bad JSON: none), creators from a list or one author, flags."""
    figures = F.coalesce(F.from_json("figure_urls", "array<struct<number: string, url: string>>"), F.array().cast("array<struct<number: string, url: string>>"))
    creators = X.json_list("creators")
    return df.withColumns({"figures": figures, "authors": creators, "has_figures": F.size(figures) > 0, "has_authors": F.size(creators) > 0})


def search_rows(df: DataFrame) -> DataFrame:
    """Translated fields before source ones, without markup."""
    plain = lambda a, b: X.collapse_space(F.regexp_replace(F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit("")), "<[^>]+>", " "))
    return df.select("id", plain("title", "source_title").alias("title"), plain("abstract", "source_abstract").alias("abstract"))


def by_month(df: DataFrame, prefix: str, month: str) -> DataFrame:
    """B5."""
    return df.filter(F.col("id").startswith(f"{prefix}-{month}.")).orderBy("id")


def candidates(df: DataFrame, n: int, many: int = 20) -> DataFrame:
    """First those with more than `many` paragraphs, then any with a body."""
    size = F.size("paragraphs")
    return df.filter(size > 0).orderBy(F.when(size > many, 0).otherwise(1), "id").limit(n)


def image_verdict(df: DataFrame, least_kb: int = 20, most_mb: int = 5, least_px: int = 100) -> DataFrame:
    """Why an image is left out; null if it stays."""
    reason = (
        F.when(F.col("bytes") < least_kb * 1024, "too_small").when(F.col("bytes") > most_mb * 1024 * 1024, "too_large")
        .when((F.col("width") < least_px) | (F.col("height") < least_px), "too_few_pixels")
    )
    return df.withColumn("reason", reason)


def latest(df: DataFrame, where: Column, order: str, n: int) -> DataFrame:
    """The newest n rows under a filter, oldest of these first."""
    return df.filter(where).orderBy(F.desc(order)).limit(n).orderBy(order)


REPORT_TYPES = ("translation", "figure", "site-bug", "feature", "other")


def report_error(df: DataFrame) -> DataFrame:
    """The first rule that a report breaks, null if none."""
    n = F.length(F.trim(F.coalesce("description", F.lit(""))))
    error = F.coalesce(
        F.when(~F.coalesce(F.col("type").isin(*REPORT_TYPES), F.lit(False)), "unknown type"),
        F.when(n < 10, "description too short"),
        F.when(n > 5000, "description too long"),
        F.when(F.coalesce(F.col("context.url"), F.lit("")) == "", "missing url"),
    )
    return df.withColumn("error", error).withColumn("valid", error.isNull())

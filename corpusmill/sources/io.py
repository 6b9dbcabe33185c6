"""Sources and sinks: JSON, JSONL, CSV, XML, HTML, text and file listings, and day-partitioned appends."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as X
from corpusmill.operators import reconcile

# DDL, which is parsed where a session is at hand (tasks import this module, too)
RECORD = (
    "id string, title string, abstract string, creators array<string>, subjects array<string>, date string, source_url string, "
    "pdf_url string, setSpec string, license struct<raw: string>"
)
TRANSLATION = (
    "id string, title_en string, abstract_en string, creators_en array<string>, subjects_en array<string>, body_en array<string>, "
    "body_md string, source_url string"
)
RUN = (
    "run_id string, started_at timestamp, completed_at timestamp, month string, attempted long, validated long, flagged long, failed long, skipped long, "
    "text_cost double, figure_cost double, ocr_cost double, total_cost double"
)
_CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """A1: arrays of JSON records in files; a file that can't be read gives none."""
    rows = spark.read.schema(f"{schema}, {_CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    return rows.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def read_documents(spark: SparkSession, path: str, schema: str = TRANSLATION) -> DataFrame:
    """A2: one JSON document a file; its key is the file's stem, and unreadable says that it can't be parsed."""
    rows = spark.read.schema(f"{schema}, {_CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return rows.select("*", stem.alias("key")).withColumn("unreadable", F.col(_CORRUPT).isNotNull()).drop(_CORRUPT)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A3: (good rows, bad lines)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.filter("ok").select("r.*"), parsed.filter("NOT ok").select(F.col("value").alias("line"))


def read_days(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    """A4: a dataset in day=YYYY-MM-DD folders from the cutoff on; other folders aren't opened."""
    return spark.read.parquet(path).filter(F.col("day") >= F.lit(cutoff).cast("date"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A5: CSV run summaries; missing numbers count as 0."""
    return spark.read.schema(RUN).option("header", True).csv(path).na.fill(0)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A6."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def read_oai(spark: SparkSession, path: str) -> DataFrame:
    """Dublin Core records in XML; deleted ones go, the first of repeated fields counts, no date gives the datestamp."""
    schema = (
        "header struct<_status: string, identifier: string, datestamp: string, setSpec: array<string>>, metadata struct<dc: struct<title: array<string>, "
        "description: array<string>, rights: array<string>, date: array<string>, creator: array<string>, subject: array<string>, identifier: array<string>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).schema(schema).load(path)
    live = rows.filter(~F.col("header._status").eqNullSafe("deleted")).select("header", "metadata.dc.*")
    none = F.array().cast("array<string>")
    return live.select(
        X.last_part(F.col("header.identifier")).alias("id"), F.col("title")[0].alias("title"), F.coalesce(F.col("description")[0], F.lit("")).alias("abstract"),
        F.coalesce("creator", none).alias("creators"), F.coalesce("subject", none).alias("subjects"), F.coalesce(F.col("date")[0], F.substring("header.datestamp", 1, 10)).alias("date"),
        F.filter(F.coalesce("identifier", none), lambda u: u.startswith("http"))[0].alias("source_url"), X.first_url(F.coalesce("identifier", none), ".pdf").alias("pdf_url"),
        F.col("header.setSpec")[0].alias("setSpec"), F.struct(F.col("rights")[0].alias("raw")).alias("license"),
    )


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def _html_text(pages: pd.Series) -> pd.Series:

    def one(html):
        if html is None:
            return None
        parser = _Text()
        parser.feed(html)
        parser.close()
        return "\n".join(parser.parts)

    return pages.map(one)


def html_text(html):
    """The visible text of a page, a line for each run of text."""
    return F.pandas_udf(_html_text, T.StringType())(html)


def page_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects with a reason) of landing pages (page_id, url, html).

    Title: first h1, else title. Subjects: subject links, else keyword links, else keyword labels. A record needs a title of three
    characters and an address of a PDF.
    """
    links = lambda word: F.filter(
        F.transform(F.regexp_extract_all("html", F.lit(rf"(?is)<a[^>]*href=[\"'][^\"']*{word}[^\"']*[\"'][^>]*>(.*?)</a>"), F.lit(1)), lambda x: X.collapse_space(F.regexp_replace(x, "<[^>]+>", ""))),
        lambda x: x != "",
    )
    plain = lambda pattern: X.collapse_space(F.regexp_replace(F.regexp_extract("html", pattern, 1), "<[^>]+>", ""))
    heading = plain(r"(?is)<h1[^>]*>(.*?)</h1>")
    title = F.when(heading != "", heading).otherwise(plain(r"(?is)<title[^>]*>(.*?)</title>"))
    out = pages.withColumn("text", html_text("html"))
    label = lambda word: F.trim(F.regexp_extract("text", rf"(?im)^\s*{word}\s*[:：]\s*(.*)$", 1))
    keywords = F.filter(F.split(label("keywords?"), r"\s*[,;，；]\s*"), lambda x: x != "")
    subjects = F.when(F.size(links("subject")) > 0, links("subject")).when(F.size(links("keyword")) > 0, links("keyword")).otherwise(keywords)
    pdf = F.regexp_extract("html", r"(?i)href=[\"']([^\"']+\.pdf(?:\?[^\"']*)?)[\"']", 1)
    out = out.select(
        "page_id", "url", title.alias("title"), links("author").alias("creators"), subjects.alias("subjects"), label("abstract").alias("abstract"),
        F.date_format(X.period_start(F.regexp_extract(label("(?:submitted|published|date)"), r"\d{4}(-\d{2}){0,2}", 0)), "yyyy-MM-dd").alias("date"), F.nullif(pdf, F.lit("")).alias("pdf_url"),
    )
    reason = F.when(F.length("title") < 3, "no_title").when(F.col("pdf_url").isNull(), "no_pdf")
    out = out.withColumn("reason", reason)
    return out.filter("reason IS NULL").drop("reason"), out.filter("reason IS NOT NULL").select("page_id", "url", "reason")


def other_source(rows: DataFrame, prefix: str = "ia-", least_year: int | None = None) -> DataFrame:
    """Records of another archive under our names."""
    year = F.regexp_extract(F.coalesce("date", F.lit("")), r"(\d{4})", 1)
    out = rows.select(
        F.concat(F.lit(prefix), "identifier").alias("id"), "title", F.coalesce("description", F.lit("")).alias("abstract"), X.json_list("creator").alias("creators"),
        X.json_list("subject").alias("subjects"), F.col("date").cast("string").alias("date"), year.alias("y"),
    )
    if least_year is not None:
        out = out.filter(F.col("y").try_cast("int") >= least_year)
    return out.drop("y")


def read_table(spark: SparkSession, name: str, **jdbc: str) -> DataFrame:
    """A10: a table of the catalogue, or of a database with JDBC options."""
    return spark.read.format("jdbc").options(dbtable=name, **jdbc).load() if jdbc else spark.table(name)


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".pdf", ".json"), id_prefix: str = "") -> DataFrame:
    """(path, prefix, id, size, modified) of files below root; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    stem = F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[^.]*$", 1)
    out = files.select("path", F.element_at(parts, -2).alias("prefix"), stem.alias("id"), "size", "modified")
    return out.filter(F.col("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") & F.col("id").startswith(id_prefix))


def load_translations(spark: SparkSession, path: str, papers: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, subjects, counts) after the documents of a folder are put in."""
    docs = read_documents(spark, path).filter("NOT unreadable")
    new = docs.select(F.coalesce("id", "key").alias("id"), F.col("title_en").alias("title"), F.col("abstract_en").alias("abstract"), F.monotonically_increasing_id().alias("seq"))
    child = docs.select(F.coalesce("id", "key").alias("paper_id"), F.explode("subjects_en").alias("subject"))
    merged = reconcile.upsert(papers, new, "id", "seq")
    counts = merged.agg(F.count("*").alias("papers"), F.countDistinct("id").alias("ids"))
    return merged, reconcile.replace_children(subjects, child, "paper_id"), counts


def migrate(rows: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with 0/1 flags and JSON lists put into target; (merged, one row of counts to compare)."""
    typed = rows.withColumns({"has_figures": F.col("has_figures") == 1, "creators": X.json_list("creators")})
    merged = reconcile.upsert(target, typed, "id", "seq")
    return merged, merged.agg(F.count("*").alias("target")).crossJoin(rows.agg(F.countDistinct("id").alias("source")))  # one row each


def write_report(payload: DataFrame, summary: DataFrame, path: str) -> None:
    """A14."""
    payload.write.mode("overwrite").json(f"{path}/detail")
    summary.write.mode("overwrite").json(f"{path}/summary")


def append_manifest(rows: DataFrame, path: str) -> None:
    """CSV by day; rows have a day column."""
    rows.write.mode("append").partitionBy("day").option("header", True).csv(path)


def append_costs(rows: DataFrame, path: str, time: str = "at") -> None:
    """Parquet by UTC day."""
    rows.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def write_id_list(ranked: DataFrame, path: str, column: str = "paper_id") -> None:
    """A ranked list, whose files follow each other by name; a small one is one file."""
    ranked.orderBy("rank").select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def export_jsonl(rows: DataFrame, path: str) -> None:
    """A18."""
    rows.write.mode("overwrite").json(path)


def put_figures(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """Manifest rows (paper_id, number, url) with the papers of incoming replaced."""
    return reconcile.replace_children(manifest, incoming, "paper_id")


def manifest_map(manifest: DataFrame) -> DataFrame:
    """(paper_id, figure_count, figures) for export."""
    figures = F.array_sort(F.collect_list(F.struct("number", "url")))
    return manifest.groupBy("paper_id").agg(figures.alias("figures")).select("paper_id", F.size("figures").alias("figure_count"), "figures")


def pointers(published: DataFrame, run_id: str, as_of) -> DataFrame:
    """(paper_id, pointer)."""
    return published.select("paper_id", F.struct("paper_id", "key", F.lit(run_id).alias("run_id"), as_of.alias("validated_at")).alias("pointer"))

"""Row verdicts and batch gates over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X

BODY, SENTENCE, TITLE, TITLE_MOST, ABSTRACT, SCRIPT_SHARE = 500, 10, 5, 300, 20, 0.005


def _some(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def qa_verdict(df: DataFrame, chars: str = X.HAN_IDEOGRAPHS + X.HAN_PUNCTUATION) -> DataFrame:
    """(status, score, issues, script_ratio, script_chars, flagged, display) over title, abstract, creators, body.

    chars: the character class that must not leak into a translation. A null field counts as empty.
    """
    f = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "body")}
    authors = F.array_join(F.coalesce("creators", F.array().cast("array<string>")), "\n", "")
    ratio = X.script_ratio(F.concat_ws("\n", f["title"], f["abstract"], authors, f["body"]), chars)
    sentences = F.filter(F.split(f["body"], r"[.!?。！？]\s+"), lambda s: F.length(F.trim(s)) > 3)
    mean = F.aggregate(sentences, F.lit(0).cast("long"), lambda a, s: a + F.length(s)) / F.nullif(F.size(sentences), F.lit(0))
    marks = sum((F.regexp_count(f["body"], F.lit(p)) for p in X.TEXT_WATERMARKS), F.lit(0))
    wrapped = lambda c: F.lower(c).contains("<para")
    leaks = lambda c: (F.col("script_ratio") > SCRIPT_SHARE) & (X.script_count(f[c], chars) > 0)
    df = df.withColumn("script_ratio", ratio).withColumn("watermarks", marks)
    df = df.withColumn("issues", _some(
        F.when(F.length(f["body"]) < BODY, "body_short"),
        F.when(F.col("script_ratio") > SCRIPT_SHARE, "script"),
        F.when(mean < SENTENCE, "fragments"),
        F.when(F.col("watermarks") > 0, "watermark"),
        F.when(f["body"].contains("⟪MATH_"), "placeholder"),
        F.when(F.length(f["title"]) < TITLE, "title_short"),
        F.when(wrapped(f["title"]), "title_wrapper"),
        F.when(F.length(f["title"]) > TITLE_MOST, "title_long"),
        F.when(F.length(f["abstract"]) < ABSTRACT, "abstract_short"),
        F.when(wrapped(authors), "authors_wrapper"),
    ))
    has = lambda *names: F.arrays_overlap("issues", F.array(*map(F.lit, names)))
    df = df.withColumn("flagged", _some(
        F.when(has("body_short", "watermark", "placeholder") | leaks("body"), "body"),
        F.when(has("title_short", "title_wrapper", "title_long") | leaks("title"), "title"),
        F.when(has("abstract_short") | leaks("abstract"), "abstract"),
        F.when(has("authors_wrapper"), "creators"),
    ))
    status = (
        F.when(F.col("script_ratio") > SCRIPT_SHARE, "flag_script").when((F.col("watermarks") > 0) | (F.size("issues") >= 3), "flag_content")
        .when(F.size("issues") > 0, "flag_formatting").otherwise("pass")
    )
    score = F.greatest(F.lit(0.0), 1 - F.col("script_ratio") - F.size("issues") * 0.1)
    display = (F.col("script_ratio") <= 0.01) & ~((status == "flag_content") & has("watermark"))
    return df.withColumns({"status": status, "score": score, "display": display})


def complete_status(df: DataFrame) -> DataFrame:
    """A pass becomes flag_formatting where title, abstract or a given body is too short to be whole."""
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    whole = (n("title") >= 5) & (n("abstract") >= 50) & (F.col("body").isNull() | (n("body") >= 150))
    return df.withColumn("complete", whole).withColumn("status", F.when((F.col("status") == "pass") & ~whole, "flag_formatting").otherwise(F.col("status")))


def qa_histogram(df: DataFrame) -> DataFrame:
    """(status, n) with a row for each status."""
    every = df.sparkSession.createDataFrame([(s,) for s in ("pass", "flag_script", "flag_formatting", "flag_content")], "status string")
    return every.join(df.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def translation_gate(df: DataFrame, most_flagged: int = -1, most_ratio: float = 5.0) -> DataFrame:
    """One row; the absolute limit counts only if it isn't negative. df comes from complete_status()."""
    total, flagged = F.count("*"), F.count_if(F.col("status") != "pass")
    out = df.agg(total.alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), flagged.alias("flagged"), F.count_if(~F.col("complete")).alias("completeness_flagged"))
    ratio = F.coalesce(F.try_divide(F.col("flagged").cast("double") * 100, F.col("total")), F.lit(0.0))
    out = out.withColumn("flagged_ratio", F.round(ratio, 2))
    reasons = _some(
        F.when((F.lit(most_flagged) >= 0) & (F.col("flagged") > most_flagged), "too_many_flagged"),
        F.when(ratio > most_ratio, "flagged_ratio_above_threshold"),
    )
    return out.withColumn("reasons", reasons).withColumn("pass", F.size("reasons") == 0)


def ocr_flags(df: DataFrame, gain: int = 500, factor: float = 5.0, alpha: float = 0.5, common: float = 0.3) -> DataFrame:
    """Whether reading an image again helped and is good enough; a missing or zero common share counts as 1."""
    pre, post = F.coalesce("pre_ocr_chars", F.lit(0)), F.coalesce("post_ocr_chars", F.lit(0))
    share = F.coalesce(F.nullif(F.col("post_most_common_ratio"), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({
        "improved": (post - pre >= gain) | F.coalesce((pre > 0) & (F.try_divide(post.cast("double"), pre) >= factor), F.lit(False)),
        "quality": (F.coalesce("post_alpha_ratio", F.lit(0.0)) >= alpha) & (share <= common),
    })


def ocr_gate(df: DataFrame, least_rate: float = 90.0) -> DataFrame:
    """One row over ocr_flags(): ids by fault and the pass rate among papers that needed it."""
    need, ran = F.col("need_ocr"), F.coalesce(F.col("ran_ocr"), F.lit(False))
    ids = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("paper_id"))))
    good = need & ran & F.col("improved") & F.col("quality")
    out = df.agg(
        F.count("*").alias("total"), F.count_if(need).alias("needed"), F.count_if(good).alias("improved"), ids(need & ~ran).alias("missing_execution"),
        ids(need & ran & ~F.col("improved")).alias("unimproved"), ids(need & ran & ~F.col("quality")).alias("low_quality"),
    )
    rate = F.when(F.col("needed") == 0, 100.0).otherwise(F.round(F.col("improved") / F.col("needed") * 100, 2))
    return out.withColumn("pass_rate", rate).withColumn("pass", (F.col("total") > 0) & (F.col("pass_rate") >= least_rate) & (F.size("missing_execution") == 0))


def text_metrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chars, alpha_ratio, most_common_ratio); characters are counted in Arrow batches, a text at a time."""

    def most_common(texts: pd.Series) -> pd.Series:
        def count(t):
            places = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            low = np.bincount(places[places < 0x3000], minlength=1).max() if len(places) else 0
            high = places[places >= 0x3000]
            return max(int(low), int(np.unique(high, return_counts=True)[1].max()) if len(high) else 0)

        return texts.map(count).astype("int64")

    base = df.select(key, F.coalesce(text, F.lit("")).alias("t"))
    n = F.length("t")
    top = F.pandas_udf(most_common, "long")(F.col("t"))
    return base.select(
        key, n.cast("long").alias("chars"), X.alpha_ratio("t").alias("alpha_ratio"), F.when(n == 0, 1.0).otherwise(top / n).alias("most_common_ratio")
    )


def needs_ocr(df: DataFrame, least: int = 1500) -> DataFrame:
    """B25."""
    return df.withColumn("need_ocr", F.coalesce(F.length("text") < least, F.lit(True)))


def record_errors(df: DataFrame, id_pattern: str, strict: bool = True) -> DataFrame:
    """What is wrong with a harvested record: all errors (strict) or the first of the lenient form."""
    named = lambda c: F.coalesce(F.exists(c, lambda x: F.trim(x) != ""), F.lit(False))
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    short = lambda c, n: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) < n
    web = lambda c: F.coalesce(F.col(c).startswith("http"), F.lit(False))
    id_ok = F.coalesce(F.col("id").rlike(id_pattern), F.lit(False))
    if strict:
        missing = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), f"missing_{c}") for c in ("id", "title", "abstract", "date", "source_url", "pdf_url")]
        errors = _some(
            *missing, F.when(~id_ok, "id_format"), F.when(short("title", 5), "title_short"), F.when(short("abstract", 50), "abstract_short"),
            F.when(empty("creators"), "creators_empty").when(~named("creators"), "creators_blank"),
            F.when(empty("subjects"), "subjects_empty").when(~named("subjects"), "subjects_blank"),
            F.when(~web("pdf_url"), "pdf_url"), F.when(~web("source_url"), "source_url"),
        )
        return df.withColumn("errors", errors)
    first = F.coalesce(
        F.when(short("id", 1), "missing_id"), F.when(short("title", 1), "missing_title"), F.when(short("abstract", 1), "missing_abstract"),
        F.when(empty("creators"), "missing_creators"), F.when(F.col("date").isNull(), "missing_date"), F.when(~web("source_url"), "source_url"), F.when(~id_ok, "id_format"),
    )
    return df.withColumn("errors", _some(first))


def duplicate_flags(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every occurrence after the first; a null key is never a duplicate."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("is_duplicate", F.col(key).isNotNull() & (place > 1))


def first_by_key(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))
    return df.withColumn("__rn", place).filter("__rn = 1").drop("__rn")


def harvest_audit(df: DataFrame) -> DataFrame:
    """One row over record_errors() and duplicate_flags(), with recommendations."""
    bad = F.size("errors") > 0
    out = df.agg(F.count("*").alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), F.count_if("is_duplicate").alias("duplicates"))
    share = lambda c: F.coalesce(F.round(F.try_divide(F.col(c).cast("double") * 100, F.col("total")), 2), F.lit(0.0))
    out = out.withColumns({"valid_pct": share("valid"), "duplicate_pct": share("duplicates")})
    advice = _some(
        F.when(F.col("total") == 0, "no records"), F.when(share("valid") < 95, "fix schema failures"), F.when(F.col("duplicates") > 0, "remove duplicate ids")
    )
    return out.withColumn("recommendations", advice)


def issue_counts(df: DataFrame) -> DataFrame:
    """(issue, n)."""
    return df.select(F.explode("errors").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def first_failures(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """D34."""
    return df.filter(F.size("errors") > 0).orderBy(order).limit(n)


def harvest_gate(df: DataFrame, least_schema: float = 95.0, least_pdf: float = 98.0) -> DataFrame:
    """One row; the file rate is over records that pass the schema, so it can exceed 100."""
    out = df.agg(
        F.count("*").alias("total"), F.count_if(F.size("errors") == 0).alias("schema_pass"), F.count_if("pdf_ok").alias("pdf_ok"), F.count_if("is_duplicate").alias("dup_ids")
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double") * 100, F.col(b)), F.lit(0.0))
    schema, pdf = rate("schema_pass", "total"), rate("pdf_ok", "schema_pass")
    reasons = _some(
        F.when(schema < least_schema, "schema_rate_below_threshold"), F.when(pdf < least_pdf, "pdf_rate_below_threshold"), F.when(F.col("dup_ids") > 0, "duplicate_ids_detected")
    )
    out = out.withColumn("reasons", reasons)
    return out.withColumns({"schema_rate": F.round(schema, 2), "pdf_rate": F.round(pdf, 2), "pass": F.size("reasons") == 0})


def smoke_gate(df: DataFrame, limit: float = 20.0) -> DataFrame:
    """Over (total, translated, flagged)."""
    rate = 100 - F.col("translated") / F.greatest(F.lit(1), F.col("total")) * 100
    failed = F.greatest(F.lit(0), F.col("total") - F.col("translated") - F.col("flagged"))
    return df.withColumns({"fail_rate": rate, "failed": failed, "pass": rate <= limit})


def run_severity(df: DataFrame) -> DataFrame:
    """Over (total, failed)."""
    level = (
        F.when(F.col("total") == 0, "info").when(F.col("failed") == 0, "success").when(F.col("failed") >= F.col("total"), "error").otherwise("warning")
    )
    return df.withColumns({"severity": level, "success_rate": F.round(F.coalesce(F.try_divide((F.col("total") - F.col("failed")).cast("double") * 100, F.col("total")), F.lit(0.0)), 2)})


def check_violations(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(column, violations): values outside their enumeration; null passes, as in a CHECK."""
    counts = df.agg(*[F.count_if(~F.col(c).isin(*v)).alias(c) for c, v in allowed.items()])
    return counts.unpivot([], list(allowed), "column", "violations")

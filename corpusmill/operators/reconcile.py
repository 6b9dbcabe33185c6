"""Set reconciliation between the catalogue, artefact listings and staged updates; upserts and status rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.matching import block_ratio
from corpusmill.operators.quality import first_by_key


def flag(df: DataFrame, ids: DataFrame, name: str, key: str = "id") -> DataFrame:
    """df with a column that says whether its key is among ids' first column."""
    marks = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def status_backfill(papers: DataFrame, artefacts: dict[str, DataFrame]) -> DataFrame:
    """A status column for each artefact set, and the overall one.

    An artefact makes its stage complete; without one a failed or complete stage stays and the rest is pending.
    """
    out = papers
    for stage, ids in artefacts.items():
        out = flag(out, ids, f"has_{stage}")
        old = F.col(f"{stage}_status")
        new = F.when(F.col(f"has_{stage}"), "complete").when(old.isin("failed", "complete"), old).otherwise("pending")
        out = out.withColumn(f"new_{stage}_status", new)
    stages = [F.col(f"new_{s}_status") for s in artefacts]
    every = stages[0] == "complete"
    some = stages[0] == "failed"
    for s in stages[1:]:
        every, some = every & (s == "complete"), some | (s == "failed")
    overall = F.when(every, "complete").when(some | (F.col("processing_status") == "failed"), "failed").otherwise("pending")
    return out.withColumn("new_status", overall)


def change_counts(df: DataFrame, old: str = "processing_status", new: str = "new_status") -> DataFrame:
    """One row: upgraded, preserved_failed, no_change."""
    a, b = F.col(old), F.col(new)
    return df.agg(
        F.count_if((b == "complete") & ~a.eqNullSafe(b)).alias("upgraded"), F.count_if((a == "failed") & (b == "failed")).alias("preserved_failed"),
        F.count_if(a.eqNullSafe(b) & ~(a.eqNullSafe(F.lit("failed")))).alias("no_change"),
    )


def stage_summary(df: DataFrame, stages: list[str]) -> DataFrame:
    """One row of complete counts by stage, and of rows and non-null ids."""
    return df.agg(F.count("*").alias("total"), F.count("id").alias("with_id"), *[F.count_if(F.col(f"{s}_status") == "complete").alias(f"{s}_complete") for s in stages])


def apply_staged(target: DataFrame, staged: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Staged (key, status); completed_at is set on the step to complete, and only where it is null."""
    joined = target.join(staged.select(key, F.col("status").alias("__new")), key, "left")
    step = (F.col("__new") == "complete") & ~F.col("status").eqNullSafe(F.lit("complete"))
    done = F.coalesce("completed_at", F.when(F.coalesce(step, F.lit(False)), now))
    return joined.withColumns({"completed_at": done, "status": F.coalesce("__new", "status")}).drop("__new")


def with_last_cost(papers: DataFrame, costs: DataFrame) -> DataFrame:
    """C11: the last logged cost of each paper, 0 without one."""
    last = costs.groupBy("paper_id").agg(F.max_by("cost", "seq").alias("cost"))
    return papers.join(last, papers["id"] == last["paper_id"], "left").select(*[papers[c] for c in papers.columns], F.coalesce(last["cost"], F.lit(0)).alias("cost"))


def classify_artefacts(translations: DataFrame, files: DataFrame) -> DataFrame:
    """(id, verdict) of translations to act on: no file, flagged with a file, flagged without one; the rest are kept."""
    out = flag(translations, files, "has_file")
    flagged = F.col("status") != "pass"
    verdict = F.when(flagged & F.col("has_file"), "flagged_with_pdf").when(flagged, "flagged_no_pdf").when(~F.col("has_file"), "no_pdf")
    return out.withColumn("verdict", verdict).filter("verdict IS NOT NULL").select("id", "status", "verdict")


def deletion_report(df: DataFrame, most: int = 100) -> DataFrame:
    """(verdict, n, first ids). Each task keeps its own first ids of a verdict before any are dealt."""
    counts = df.groupBy("verdict").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("verdict").orderBy("id"))
    first = df.select("verdict", "id").withColumn("rn", place).filter(F.col("rn") <= most)
    first = first.groupBy(F.col("verdict").alias("of")).agg(F.sort_array(F.collect_list("id")).alias("items"))
    return counts.join(first, F.col("verdict").eqNullSafe(F.col("of"))).select("verdict", "n", "items")


def unseen(records: DataFrame, seen: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """C4: records with new ids, first of each, in order; at most n."""
    out = first_by_key(records, "id", order).join(seen.select("id").distinct(), "id", "left_anti").orderBy(order)
    return out if n is None else out.limit(n)


def insert_new(target: DataFrame, incoming: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Target and those incoming rows whose id it hasn't, with defaults for columns that they lack."""
    fresh = incoming.join(target.select("id"), "id", "left_anti")
    for c, v in (defaults or {}).items():
        fresh = fresh.withColumn(c, F.lit(v))
    return target.unionByName(fresh, allowMissingColumns=True)


def enqueue(queue: DataFrame, ids: DataFrame, force: bool = False) -> DataFrame:
    """New pending jobs; force takes the old job of a given id out and adds it again."""
    fresh = ids.select("id").distinct()
    if force:
        queue = queue.join(fresh, "id", "left_anti")
    else:
        fresh = fresh.join(queue.select("id"), "id", "left_anti")
    return queue.unionByName(fresh.select("id", F.lit("pending").alias("status"), F.lit(0).alias("attempts")), allowMissingColumns=True)


def drift(papers: DataFrame, stored: DataFrame, column: str = "url") -> DataFrame:
    """Papers without an address whose file is stored."""
    return papers.filter(F.coalesce(F.col(column), F.lit("")) == "").join(stored.select("id").distinct(), "id", "left_semi")


def fix_drift(papers: DataFrame, stored: DataFrame, base: str, column: str = "url") -> DataFrame:
    """Papers with the address of their stored file where they had none."""
    marked = flag(papers, stored, "__stored")
    missing = (F.coalesce(F.col(column), F.lit("")) == "") & F.col("__stored")
    return marked.withColumn(column, F.when(missing, F.concat(F.lit(base + "/"), F.col("id").cast("string"), F.lit(".pdf"))).otherwise(F.col(column))).drop("__stored")


def sync_column(target: DataFrame, source: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Target with column taken from source where it differs, and changed to say where."""
    new = source.select(key, F.col(column).alias("__new"), F.lit(True).alias("__has"))
    joined = target.join(new, key, "left")
    changed = F.coalesce("__has", F.lit(False)) & ~F.col(column).eqNullSafe(F.col("__new"))
    return joined.withColumn("changed", changed).withColumn(column, F.when(F.col("changed"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__has")


def full_text_sync(df: DataFrame) -> DataFrame:
    """has_full_text and body by the flag or a body over 500 characters."""
    has = F.coalesce("flag", F.lit(False)) | (F.length(F.coalesce("body", F.lit(""))) > 500)
    return df.withColumn("has_full_text", has).withColumn("body", F.when(F.col("has_full_text"), F.coalesce("body", F.lit(""))).otherwise(""))


def qa_status(c: Column) -> Column:
    """G9."""
    return F.when(c.isNull(), "pass").when(c.isin("pass", "pending", "fail"), c).otherwise("pending")


def reconcile_qa(df: DataFrame) -> DataFrame:
    """Text done, a title and an abstract: pass; changed says where that is new."""
    filled = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("abstract", F.lit("")) != "")
    change = (F.col("text_status") == "complete") & ~F.col("qa_status").eqNullSafe(F.lit("pass")) & filled
    df = df.withColumn("changed", F.coalesce(change, F.lit(False)))
    return df.withColumn("qa_status", F.when(F.col("changed"), "pass").otherwise(F.col("qa_status")))


def empty_translations(df: DataFrame) -> DataFrame:
    """B11."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.filter(blank("title") & blank("abstract") & (F.coalesce(F.size("body"), F.lit(0)) <= 0))


def id_valid(c: Column, pattern: str | None = None) -> Column:
    """The full pattern, or the loose form: two parts that aren't empty around one dash."""
    parts = F.split(c, "-")
    return F.coalesce(c.rlike(pattern) if pattern else (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.lit(False))


def marker_sets(markers: DataFrame, figures: DataFrame) -> DataFrame:
    """C14: (paper_id, valid, missing, extra): markers with, without a figure; figures without a marker."""
    a = markers.select("paper_id", "number").distinct().withColumn("m", F.lit(True))
    b = figures.select("paper_id", "number").distinct().withColumn("f", F.lit(True))
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("number"))))
    m, f = F.col("m").isNotNull(), F.col("f").isNotNull()
    return a.join(b, ["paper_id", "number"], "full").groupBy("paper_id").agg(pick(m & f).alias("valid"), pick(m & ~f).alias("missing"), pick(~m & f).alias("extra"))


def with_subjects(papers: DataFrame, subjects: DataFrame) -> DataFrame:
    """Collected subjects where a paper's own list is null."""
    found = subjects.groupBy("paper_id").agg(F.sort_array(F.collect_set("subject")).alias("__subjects"))
    joined = papers.join(found, papers["id"] == found["paper_id"], "left")
    return joined.select(*[papers[c] for c in papers.columns if c != "subjects"], F.coalesce(papers["subjects"], "__subjects", F.array().cast("array<string>")).alias("subjects"))


def translation_input(papers: DataFrame, subjects: DataFrame) -> DataFrame:
    """Source columns; while pending, target columns stand in; rows with neither go."""
    own = F.nullif(F.col("source_title"), F.lit(""))
    pending = F.col("text_status") == "pending"
    out = with_subjects(papers, subjects).select(
        "id", F.coalesce(own, F.when(pending, F.nullif(F.col("title"), F.lit("")))).alias("title"),
        F.coalesce("source_abstract", F.when(pending, F.col("abstract")), F.lit("")).alias("abstract"), "subjects",
    )
    return out.filter("title IS NOT NULL")


def move_to_source(papers: DataFrame) -> DataFrame:
    """Pending rows without a source title: the target columns move to the source columns."""
    move = (F.col("text_status") == "pending") & (F.coalesce("source_title", F.lit("")) == "")
    out = papers.withColumn("__move", F.coalesce(move, F.lit(False)))
    for c in ("title", "abstract"):
        out = out.withColumn(f"source_{c}", F.when(F.col("__move"), F.col(c)).otherwise(F.col(f"source_{c}"))).withColumn(c, F.when(~F.col("__move"), F.col(c)))
    return out.drop("__move")


def missing_source(records: DataFrame, papers: DataFrame, month: str, key: str = "id") -> DataFrame:
    """C17: records of one month whose paper, by its key, lacks its source columns."""
    lacking = papers.filter(F.col("source_title").isNull()).select(key)
    return records.filter(X.month_of_id("id") == month).join(lacking, key, "left_semi")


def not_found(requested: DataFrame, records: DataFrame) -> DataFrame:
    """C22."""
    return requested.select("id").distinct().join(records.select("id"), "id", "left_anti")


def to_download(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with an address and no local file."""
    return records.filter(F.coalesce("pdf_url", F.lit("")) != "").join(files.select("id"), "id", "left_anti")


def render_list(papers: DataFrame, existing: DataFrame, mode: str, cutoff: Column | None = None, with_figures: DataFrame | None = None) -> DataFrame:
    """Papers to render: backfill (no file), incremental (changed since), figures (a file without figures that exist now)."""
    if mode == "backfill":
        return papers.join(existing.select("id"), "id", "left_anti")
    if mode == "incremental":
        return papers.filter(F.col("modified") >= cutoff)
    if mode == "figures":
        plain = existing.filter("NOT has_figures").select("id")
        return papers.join(plain, "id", "left_semi").join(with_figures.select("id"), "id", "left_semi")
    raise ValueError(mode)


def title_fallback(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """Titles clamped with the source's title to fall back on; old and new length where that changes one."""
    joined = papers.join(sources.select("id", F.col("title").alias("__source")), "id", "left")
    new = X.clamp_title("title", F.col("__source"))
    return joined.withColumns({"new_title": new, "had_tags": F.col("title").rlike(r"(?i)<\s*/?\s*para"), "old_length": F.length("title"), "new_length": F.length(new)}).drop("__source")


def clamp_report(df: DataFrame, prefix: int = 160) -> DataFrame:
    """H5: the rows that title_fallback() changes."""
    changed = ~F.col("title").eqNullSafe(F.col("new_title"))
    return df.filter(changed).select("id", "old_length", "new_length", "had_tags", F.substring("title", 1, prefix).alias("prefix"))


def with_source(translations: DataFrame, records: DataFrame) -> DataFrame:
    """C26."""
    return translations.join(records.select("id", F.col("title").alias("source_title"), F.col("abstract").alias("source_abstract")), "id")


def best_matches(expected: DataFrame, candidates: DataFrame, least: float = 0.85) -> DataFrame:
    """(doc_id, text, best, score, matched): a text's best candidate of the same document, of equals the smallest.

    Without regard to case and outer white space, a text that holds the other scores 0.95, all others have the ratio of their matching
    blocks; a blank text is matched.
    """
    texts = expected.select("doc_id", "text").distinct()
    pairs = texts.join(candidates.select("doc_id", "candidate").distinct(), "doc_id", "left")
    a, b = F.lower(F.trim("text")), F.lower(F.trim("candidate"))
    held = F.contains(b, a) | F.contains(a, b)
    pairs = pairs.withColumns({"a": F.when(~held, a), "b": F.when(~held, b), "held": held})  # what is held needs no blocks
    score = F.when(F.col("held"), 0.95).otherwise(F.coalesce(block_ratio(F.col("a"), F.col("b")), F.lit(0.0)))
    best = pairs.withColumn("score", score).groupBy("doc_id", "text").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate")).alias("b"))
    score = -F.col("b.s")
    return best.select("doc_id", "text", F.col("b.candidate").alias("best"), F.round(score, 4).alias("score"), ((score >= least) | (F.trim("text") == "")).alias("matched"))


def match_rates(matches: DataFrame, least: float = 0.95) -> DataFrame:
    """(doc_id, match_rate, passed)."""
    rate = F.avg(F.col("matched").cast("double"))
    return matches.groupBy("doc_id").agg(rate.alias("match_rate"), (rate >= least).alias("passed"))


def upsert(target: DataFrame, incoming: DataFrame, key: str, order: str, mode: str = "last") -> DataFrame:
    """One row a key: the last incoming one, or with mode "first" the row that is there already."""
    old = target.withColumn("__new", F.lit(0))
    new = incoming.withColumn("__new", F.lit(1))
    first = [F.col("__new"), F.col(order)] if mode == "first" else [F.col("__new").desc(), F.col(order).desc()]
    return first_by_key(old.unionByName(new, allowMissingColumns=True), key, *first).drop("__new")


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """The children of every parent that incoming names, replaced by its distinct ones."""
    return children.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming.distinct())


def saved_translation(df: DataFrame) -> DataFrame:
    """The row that a finished translation is stored as."""
    body = F.coalesce(X.strip_nul("body"), F.lit(""))
    return df.select(
        "id", X.clamp_title(X.strip_nul("title"), X.strip_nul("source_title")).alias("title"), X.strip_para(X.strip_nul(F.coalesce("abstract", F.lit("")))).alias("abstract"),
        X.strip_para_list(X.strip_nul_list("creators")).alias("creators"), body.alias("body"), (F.length(body) > 100).alias("has_full_text"), qa_status(F.col("qa")).alias("qa_status"),
        F.when(F.length(body) > 0, "complete").otherwise("pending").alias("text_status"), F.when(F.length(body) > 0, F.col("as_of")).alias("text_completed_at"),
    )


def merge_summaries(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Three summaries of a run in one row of structs."""
    packed = lambda df, name: df.select("run_id", F.struct(*[x for x in df.columns if x != "run_id"]).alias(name))
    return packed(a, "harvest").join(packed(b, "translation"), "run_id", "full").join(packed(c, "ocr"), "run_id", "full")


def id_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """S1."""
    return a.select("id").union(b.select("id")).distinct().orderBy("id")


def all_records(*frames: DataFrame) -> DataFrame:
    """S2."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_by_membership(ids: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (pending, completed)."""
    key = done.select("id").distinct()
    return ids.join(key, "id", "left_anti"), ids.join(key, "id", "left_semi")


def lost_markers(source: Column | str, target: Column | str, pattern: str = r"\[(?:FIGURE|TABLE):[^\]]+\]") -> Column:
    """Markers of the input that the output lacks."""
    found = lambda c: F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(pattern), F.lit(0))
    return F.array_except(found(source), found(target))


def figures_of_bodies(frames: list[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """mentions(..) frames in order of priority; of each (key, type, number) the first is kept, with its source tag."""
    tagged = [df.withColumn("source", F.lit(tag)).withColumn("__p", F.lit(i)) for i, (tag, df) in enumerate(frames)]
    return first_by_key(all_records(*tagged), [key, "type", "number"], "__p", "paragraph").drop("__p")


def prune_list(files: DataFrame, cutoff: Column) -> DataFrame:
    """Files last changed before the cutoff."""
    return files.filter(F.col("modified") < cutoff)


def batch_totals(df: DataFrame) -> DataFrame:
    """One row over (total, succeeded, failed); a rate of 0 without figures."""
    out = df.agg(F.sum("total").alias("total"), F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))
    return out.withColumn("success_rate", F.coalesce(F.try_divide(F.col("succeeded").cast("double"), F.col("total")), F.lit(0.0)))

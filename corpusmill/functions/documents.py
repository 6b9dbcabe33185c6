"""Ordered folds inside one document, as higher-order functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as X


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def merge_lines(lines, least: int = 50) -> Column:  # H19
    """Extracted lines to paragraphs: garbage goes, headings stand alone, a long sentence end before a capital breaks."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flush(acc):
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    def step(acc, line):
        line = F.trim(line)
        grown = F.when(acc["open"] == "", line).otherwise(F.concat(acc["open"], F.lit(" "), line))
        ends = acc["open"].rlike("[.!?。！？]$") & line.rlike(r"^[A-Z\x{4E00}-\x{9FFF}]") & (F.length(acc["open"]) >= least)
        heading = F.struct(F.array_append(flush(acc), line).alias("done"), F.lit("").alias("open"))
        fresh = F.struct(flush(acc).alias("done"), line.alias("open"))
        longer = F.struct(acc["done"].alias("done"), grown.alias("open"))
        skip = (line == "") | (X.is_page_garbage(line) & ~X.is_heading(line))
        return F.when(skip, acc).when(X.is_heading(line), heading).when(ends, fresh).otherwise(longer)

    return F.aggregate(_col(lines), empty, step, flush)


def sections(paragraphs) -> Column:  # H20: array<struct<heading, paragraphs>>; what comes before a heading has a null one
    kind = "array<struct<heading:string,paragraphs:array<string>>>"
    state = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("own"))

    def flush(acc):
        whole = F.struct(acc["heading"].alias("heading"), acc["own"].alias("paragraphs"))
        return F.when(acc["heading"].isNull() & (F.size(acc["own"]) == 0), acc["done"]).otherwise(F.array_append(acc["done"], whole))

    def step(acc, p):
        opened = F.struct(flush(acc).alias("done"), F.trim(p).alias("heading"), F.array().cast("array<string>").alias("own"))
        grown = F.struct(acc["done"].alias("done"), acc["heading"].alias("heading"), F.array_append(acc["own"], p).alias("own"))
        return F.when(X.is_heading(p), opened).otherwise(grown)

    return F.aggregate(_col(paragraphs), state, step, flush)


def merge_fragments(paragraphs, least: int = 50) -> Column:  # H22
    """Short paragraphs that aren't headings join the next one; those at the end join the last."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        p = F.trim(p)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(" "), p))
        short = (F.length(p) < least) & ~X.is_plain_heading(p)
        held = F.struct(acc["done"].alias("done"), joined.alias("open"))
        closed = F.struct(F.array_append(acc["done"], joined).alias("done"), F.lit("").alias("open"))
        return F.when(p == "", acc).when(short, held).otherwise(closed)

    def finish(acc):
        n = F.size(acc["done"])
        last = F.concat(F.element_at(acc["done"], -1), F.lit(" "), acc["open"])
        joined = F.array_append(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), last)
        return F.when(acc["open"] == "", acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(joined)

    return F.aggregate(_col(paragraphs), state, step, finish)


def clean_paragraphs(paragraphs) -> Column:  # H22: white space and doubled punctuation
    return F.transform(_col(paragraphs), lambda p: F.regexp_replace(X.collapse_space(p), r"([.,;:!?])\1+", "$1"))


def chunk_paragraphs(paragraphs, most: int = 1500) -> Column:  # W9: array<array<string>>, greedy
    state = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("own"), F.lit(0).cast("long").alias("n"))

    def flush(acc):
        return F.when(F.size(acc["own"]) == 0, acc["done"]).otherwise(F.array_append(acc["done"], acc["own"]))

    def step(acc, p):
        t = X.estimate_tokens(p)
        full = (F.size(acc["own"]) > 0) & (acc["n"] + t > most)
        opened = F.struct(flush(acc).alias("done"), F.array(p).alias("own"), t.alias("n"))
        grown = F.struct(acc["done"].alias("done"), F.array_append(acc["own"], p).alias("own"), (acc["n"] + t).alias("n"))
        return F.when(full, opened).otherwise(grown)

    return F.aggregate(_col(paragraphs), state, step, flush)


def chunk_sections(parts, most: int = 1500) -> Column:  # W9: sections cut by chunk_paragraphs, later chunks named "(continued)"
    def cut(s):
        again = F.concat(F.coalesce(s["heading"], F.lit("")), F.lit(" (continued)"))
        return F.transform(
            chunk_paragraphs(s["paragraphs"], most),
            lambda c, i: F.struct(F.when(i == 0, s["heading"]).otherwise(again).alias("heading"), c.alias("paragraphs")),
        )

    return F.flatten(F.transform(_col(parts), cut))


MARKER = r"\[(FIGURE|TABLE):\s*([A-Za-z]?\d+[a-z]?)\]"


def strip_markers(c) -> Column:  # H27
    return F.trim(F.regexp_replace(_col(c), MARKER, ""))


def place_images(body, figures) -> Column:  # H27: figures array<struct<number, url>>; web addresses only, tables and the rest go
    whole = F.filter(_col(figures), lambda f: f["url"].rlike("^https?://"))
    numbers = F.array_distinct(F.transform(whole, lambda f: f["number"]))

    def put(acc, n):
        links = F.array_join(F.transform(F.filter(whole, lambda f: f["number"] == n), lambda f: F.concat(F.lit("![Figure "), n, F.lit("]("), f["url"], F.lit(")"))), "\n")
        return F.replace(acc, F.concat(F.lit("[FIGURE:"), n, F.lit("]")), links)

    return strip_markers(F.aggregate(numbers, _col(body), put))

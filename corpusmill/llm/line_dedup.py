"""Line deduplication with a log-template tree, beside an exact rule for long lines.

Fixed-depth parsing: a line goes down the tree by its number of tokens and its first `DEPTH` tokens, of which those
that hold a digit count as one variable. A leaf that fewer than `min_docs` lines reach is left alone. In the other
leaves, a token's support is how many of the leaf's lines have it at its place. A leaf is split by levels of support,
`min_docs` and each `LEVEL` times more: at a level, tokens of that support are constant at their places, and other places
are variable fields. A line's templates are its leaf and its constant places at each level. Levels are counts, not
shares, so a template keeps its constants however many other lines its leaf gets. A template recurs if at least
`CONSTANT_SHARE` of its places are constant, one of them beyond the first `DEPTH`, and `min_docs` documents have it:
its lines are dropped in every document but the first that has it (smallest id), so that no content is lost.

A line of `LONG_TOKENS` tokens or more that two documents or more have is dropped in every one but the first.

Lines of fewer than `MIN_TOKENS` tokens have no template and stay. Tokens are kept as 64-bit hashes of place
and token, and copies of a line are counted before its tokens are looked at.

All of it is DataFrame functions. Defined cases: null text stays null, empty text stays empty; a text whose every line
is dropped becomes empty, the row stays; ties for the first document go to the earlier row; repeated ids
are separate rows; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, materialize, numbered, only_ids

DEPTH = 3
MIN_TOKENS = 4
LONG_TOKENS = 8
MIN_DOCS = 8
LEVEL = 4
CONSTANT_SHARE = 0.6
HOT = 100_000  # tokens of this support are few, so they are broadcast; no other meets more lines in one task


def _plain(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  "))


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _leaf(line: Column) -> Column:
    """The leaf's hash of a plain line; null where it has too few tokens."""
    tokens = _tokens(line)
    lead = F.substring_index(line, " ", DEPTH)
    lead = F.when(lead.rlike("[0-9]"), F.regexp_replace(lead, r"[^ ]*[0-9][^ ]*", "<*>")).otherwise(lead)
    return F.when(tokens >= MIN_TOKENS, F.xxhash64(tokens, lead))


def _codes(line: Column) -> Column:
    """A hash of place and token for each token of a plain line."""
    return F.transform(F.split(line, " "), lambda t, i: F.xxhash64(i, t))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__row, __drop): the 0-based places of the lines to drop, for rows that have any.

    __row is a number that docs' rows hold, see numbered(). Texts are read once for the leaves and once for
    one copy of each line in a busy leaf; all between is hashes.
    """
    rows = docs.select("__row", F.col(id_col).alias("__id"), F.split(text_col, "\n").alias("__lines"))
    places = rows.select("__row", "__id", F.posexplode("__lines").alias("pos", "line")).withColumn("line", _plain(F.col("line")))
    long = _tokens(F.col("line")) >= LONG_TOKENS
    places = places.select("__row", "__id", "pos", _leaf(F.col("line")).alias("leaf"), F.xxhash64("line").alias("line_id"), long.alias("long"))
    places = materialize(places.filter("leaf IS NOT NULL"), "places")
    # copies of a line meet here, and the first speaks for all
    kinds = places.groupBy("leaf", "line_id").agg(
        F.count("*").alias("n"), F.first("long").alias("long"), F.min(F.struct("__row", "pos")).alias("at"),
        F.max("__row").alias("last"), F.min(F.struct("__id", "__row")).alias("first"),
    )
    kinds = materialize(kinds, "kinds")
    repeated = kinds.filter("long AND at.__row != last").select("leaf", "line_id", F.col("first.__row").alias("__first"))
    exact = places.join(repeated, ["leaf", "line_id"]).filter("__row != __first").select("__row", "pos")
    busy = kinds.groupBy("leaf").agg(F.sum("n").alias("all")).filter(F.col("all") >= min_docs).select("leaf")
    wanted = kinds.join(busy, "leaf").select("leaf", "line_id", "n", "at.__row", "at.pos")
    wanted = wanted.groupBy("__row").agg(F.collect_list(F.struct("pos", "leaf", "line_id", "n")).alias("__at"))
    wanted = materialize(wanted, "wanted")
    found = only_ids(rows.select("__row", "__lines"), wanted.select("__row"), "__row").join(wanted, "__row")
    lines = found.select("__lines", F.explode("__at").alias("k")).select("k.*", _plain(F.expr("__lines[k.pos]")).alias("line"))
    coded = materialize(lines.select("leaf", "line_id", "n", _codes(F.col("line")).alias("codes")), "codes")
    support = coded.select("leaf", "n", F.explode("codes").alias("code")).groupBy("leaf", "code").agg(F.sum("n").alias("support"))
    support = materialize(support.filter(F.col("support") >= min_docs), "support")
    each = coded.select("leaf", "line_id", F.size("codes").alias("size"), F.posexplode("codes").alias("place", "code"))
    hot = each.join(F.broadcast(support.filter(F.col("support") >= HOT)), ["leaf", "code"], "left")
    met = hot.filter("support IS NULL").drop("support").join(support.filter(F.col("support") < HOT), ["leaf", "code"])
    constant = hot.filter("support IS NOT NULL").unionByName(met)
    level = F.floor(F.log(F.col("support") / min_docs) / F.log(F.lit(float(LEVEL))) + 1e-9).cast("int")
    held = constant.groupBy("leaf", "line_id", "size").agg(F.collect_list(F.struct("code", "place", level.alias("level"))).alias("held"))
    fixed = held.withColumn("level", F.explode(F.array_distinct("held.level"))).withColumn("fixed", F.expr("filter(held, h -> h.level >= level)"))
    fixed = fixed.filter((F.size("fixed") >= CONSTANT_SHARE * F.col("size")) & F.exists("fixed", lambda h: h["place"] >= DEPTH))
    typed = fixed.select("leaf", "line_id", F.xxhash64("leaf", F.array_sort("fixed.code")).alias("template"))
    where = materialize(places.join(typed, ["leaf", "line_id"]).select("__row", "__id", "pos", "template"), "templates")
    per_doc = where.groupBy("template", "__row").agg(F.first("__id").alias("__id"))
    recurring = per_doc.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__row")).alias("first"))
    recurring = recurring.filter(F.col("n") >= min_docs).select("template", F.col("first.__row").alias("__first"))
    drop = where.join(recurring, "template").filter("__row != __first").select("__row", "pos")
    drops = materialize(drop.union(exact).groupBy("__row").agg(F.collect_set("pos").alias("__drop")), "drops")
    discard(places, kinds, wanted, coded, support, where)
    return drops


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, dropped_col: str | None = None
) -> DataFrame:
    """docs with recurring templates' lines and repeated long lines taken out of text_col; dropped_col: a column for how many, if named."""
    docs, columns = numbered(docs, "rows"), docs.columns
    # the places to drop grow with the texts: both sides are always dealt, never one broadcast
    drops = dropped_lines(docs, id_col, text_col, min_docs).hint("merge")
    whole = docs.join(drops, "__row", "left")
    kept = F.filter(F.split(text_col, "\n"), lambda l, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in columns if c != dropped_col]
    if dropped_col:
        columns.append(F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias(dropped_col))
    return whole.select(*columns)

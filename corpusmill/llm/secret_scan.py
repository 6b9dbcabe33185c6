"""Secrets by pattern, and unlabelled random tokens by a battery of randomness tests.

Base kinds `assign`, `access` and `hex` are patterns. Positions come from splitting a text at a pattern: the pieces'
and the matches' lengths alternate, so running sums give each match's place in code points.

Kind `random`: a token (a run of [A-Za-z0-9+/_=-] of `MIN_TOKEN` or more that holds a digit) gets an encoding from
its characters (hex, base32 or base64) and three tests against "its symbols are drawn evenly and independently":
  uniformity  - chi-squared of symbol classes against their shares in the alphabet (Wilson-Hilferty),
  runs        - Wald-Wolfowitz runs above and below the middle of the alphabet,
  correlation - serial correlation of neighbouring symbols' places in the alphabet.
A token's randomness is the least of the three p-values, times three: near 1 for a key, near 0 for words. What is controlled is the
rate of ordinary tokens among those reported. Every document gives `PER_DOC` ordinary tokens to compare with, words from
some places of its own text joined like identifiers. A token's p-value is the share of those, of its length stratum or a shorter one (short ones
look more random), that are as random as the token, itself counted; Benjamini-Hochberg at `FDR` within each length stratum decides
which tokens are reported. A stratum with too few to compare with has no power and reports nothing. Tokens are counted by
stratum and bin of randomness (strata times bins rows), so no ranking of tokens takes place.

All of it is DataFrame functions. Defined cases: null text counts as empty; a document without spans has zero
counts and the hash of the empty string; a token that overlaps a base span is not reported again; equal starts are
ordered by kind as listed; repeated ids are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import materialize, numbered

# fixed values: the patterns of the base kinds and the least lengths
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, MIN_ACCESS = r"AKIA[A-Z0-9]+", 18
HEX, MIN_HEX = r"[0-9a-f]{16,}", 16  # runs are maximal, so shorter ones may be left out by the pattern
MIN_ASSIGN = 12
TOKEN, MIN_TOKEN = r"[A-Za-z0-9+/_=-]{20,}", 20
KINDS = ("assign", "access", "hex", "random")

FDR = 0.05
PER_DOC = 4  # ordinary tokens a document, to compare with
BINS = 400  # of -ln(p), in steps of 1/10
STRATA = (20, 24, 32, 48, 64, 128, 1024)


def _normal_upper(z: Column) -> Column:
    """P(Z > z), to about 2e-4."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * F.pow(z, 3)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_upper(F.abs(z)))


def spans(docs: DataFrame, row: str, text: str, pattern: str, kind: int) -> DataFrame:
    """(row, kind, start, end, match): the pattern's matches, leftmost and without overlaps."""
    hit = docs.filter(F.col(text).rlike(pattern))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = hit.select(row, pieces.alias("__gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("__found"))
    each = found.select(row, "__gaps", F.posexplode("__found").alias("__at", "match"))
    each = each.select(row, "__at", F.expr("__gaps[__at]").alias("__gap"), "match")
    before = Window.partitionBy(row).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("__gap") + F.length("match")).over(before)
    return each.select(row, F.lit(kind).alias("kind"), (end - F.length("match")).alias("start"), end.alias("end"), "match")


def base_spans(docs: DataFrame, row: str, text: str) -> DataFrame:
    """The base kinds' spans that are long enough."""
    value = F.length(F.regexp_extract("match", ASSIGN, 2))
    assign = spans(docs, row, text, ASSIGN, 0).filter(value >= MIN_ASSIGN)
    access = spans(docs, row, text, ACCESS, 1).filter(F.length("match") >= MIN_ACCESS)
    return assign.union(access).union(spans(docs, row, text, HEX, 2))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens(.., match) with p: three times the least p-value of the three tests, 1 at most."""
    alphabets = F.expr(
        "CASE WHEN rlike(match, '^([0-9a-f]+|[0-9A-F]+)$') THEN '0123456789abcdef' "
        "WHEN rlike(match, '^[A-Z2-7]+=*$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' "
        "ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END"
    )
    coded = tokens.withColumn("alphabet", alphabets).withColumn("size", F.length("alphabet"))
    plain = F.translate(F.regexp_replace("match", "=+$", ""), "-_", "+/")
    plain = F.when(F.col("size") == 16, F.lower(plain)).otherwise(plain)
    # places in the alphabet, from 0; "=" inside a token has none
    codes = F.filter(_codes(plain), lambda c: c >= 0)
    coded = coded.withColumn("codes", codes).withColumn("n", F.size("codes").cast("double"))
    # symbol classes: hex digits and letters; base32 letters and digits; base64 upper, lower, and digits with signs
    edges = F.expr("CASE size WHEN 16 THEN array(5, 10, 16) WHEN 32 THEN array(13, 26, 32) ELSE array(26, 52, 64) END")
    coded = coded.withColumn("edges", edges)
    low = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.expr("edges")[i - 1])
    chi = F.aggregate(
        F.sequence(F.lit(0), F.lit(2)),
        F.lit(0.0),
        lambda acc, i: acc + F.pow(_between(low(i), F.col("edges")[i]) - _expected(low(i), F.col("edges")[i]), F.lit(2)) / _expected(low(i), F.col("edges")[i]),
    )
    wilson = (F.pow(chi / 2, F.lit(1 / 3)) - (1 - 2 / (9 * 2))) / (2 / (9 * 2)) ** 0.5
    coded = coded.withColumn("p_uniform", F.least(F.lit(1.0), _normal_upper(wilson)))
    above = F.transform("codes", lambda c: (c >= F.col("size") / 2).cast("int"))
    coded = coded.withColumn("above", above).withColumn("n1", F.aggregate("above", F.lit(0), lambda a, x: a + x).cast("double"))
    pairs = F.zip_with(F.slice("above", 2, F.greatest(F.size("above") - 1, F.lit(0))), F.col("above"), lambda b, a: F.when(a.isNotNull() & b.isNotNull() & (a != b), 1).otherwise(0))
    runs = F.aggregate(pairs, F.lit(1), lambda a, x: a + x).cast("double")
    n2 = F.col("n") - F.col("n1")
    mean = 2 * F.col("n1") * n2 / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / F.greatest(F.col("n") - 1, F.lit(1.0))
    coded = coded.withColumn("p_runs", F.when(var > 0, _two_sided((runs - mean) / F.sqrt(var))).otherwise(0.0))
    m = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    coded = coded.withColumn("m", m)
    spread = F.aggregate("codes", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("m"), F.lit(2)))
    products = F.zip_with(
        F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(0))), F.col("codes"),
        lambda b, a: F.coalesce((a - F.col("m")) * (b - F.col("m")), F.lit(0.0)),
    )
    serial = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    z = serial / spread * F.sqrt("n") + 1 / F.sqrt("n")
    coded = coded.withColumn("p_serial", F.when(spread > 0, _two_sided(z)).otherwise(0.0))
    p = F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial"))
    return coded.withColumn("p", F.when(F.col("n") < MIN_TOKEN // 2, 0.0).otherwise(p))


def _codes(plain: Column) -> Column:
    return F.transform(F.split(plain, ""), lambda c: F.instr(F.col("alphabet"), c) - 1)


def _between(lo: Column, hi: Column) -> Column:
    return F.aggregate("codes", F.lit(0), lambda a, c: a + ((c >= lo) & (c < hi)).cast("int")).cast("double")


def _expected(lo: Column, hi: Column) -> Column:
    return F.col("n") * (hi - lo) / F.col("size")


def ordinary_tokens(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(match): `PER_DOC` tokens a document of words from its own text, at places and of lengths that hashes decide, with a number."""
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Za-z]{1,15}$"))

    def token(i):
        at = F.pmod(F.xxhash64(row, F.lit(i)), F.greatest(F.size("w"), F.lit(1))).cast("int") + 1
        some = F.slice("w", at, (3 + F.pmod(F.xxhash64(row, F.lit(i + PER_DOC)), F.lit(14))).cast("int"))
        return F.concat_ws("-", F.array_join(some, "-"), F.pmod(F.xxhash64(row, F.lit(i + 2 * PER_DOC)), F.lit(1000)).cast("string"))

    held = docs.select(row, words.alias("w"))
    return held.select(F.explode(F.array(*map(token, range(PER_DOC)))).alias("match")).filter(F.length("match") >= MIN_TOKEN)


def _binned(tokens: DataFrame, *keep: str) -> DataFrame:
    """(*keep, stratum, bin) of tokens; bin 0 holds the most random ones."""
    tested = battery(tokens).withColumn("len", F.length("match"))
    stratum = sum(((F.col("len") >= s).cast("int") for s in STRATA), F.lit(0))
    bin_ = F.when(F.col("p") <= 0, BINS).otherwise(F.least(F.lit(BINS), F.floor(-10 * F.log("p")))).cast("int")
    return tested.select(*keep, stratum.alias("stratum"), bin_.alias("bin"))


def random_tokens(docs: DataFrame, row: str, text: str, fdr: float = FDR) -> DataFrame:
    """(row, kind, start, end): tokens that are more random than ordinary ones, at a false-discovery rate of `fdr` a length stratum."""
    found = spans(docs, row, text, TOKEN, 3).filter(F.col("match").rlike("[0-9]"))
    tested = materialize(_binned(found, row, "kind", "start", "end"), "tokens")
    ordinary = _binned(ordinary_tokens(docs, row, text)).groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    longer = F.explode(F.sequence("stratum", F.lit(len(STRATA))))  # a token is compared with ordinary ones of its stratum and below
    nulls = ordinary.select(longer.alias("stratum"), "bin", F.lit(0).alias("t"), F.col("n").alias("d"))
    counts = tested.groupBy("stratum", "bin").agg(F.count("*").alias("t")).withColumn("d", F.lit(0)).union(nulls)
    counts = counts.groupBy("stratum", "bin").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    upto, whole = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", *(F.sum(c).over(w).alias(f"{c}_{k}") for c in "td" for k, w in (("upto", upto), ("all", whole))))
    # (1 + d_upto) / (1 + d_all) is the p-value of a bin's tokens
    met = ranked.filter((F.col("t_upto") > 0) & ((1 + F.col("d_upto")) * F.col("t_all") <= fdr * F.col("t_upto") * (1 + F.col("d_all"))))
    cut = met.groupBy("stratum").agg(F.max("bin").alias("cut"))  # a row a stratum
    return tested.join(F.broadcast(cut), "stratum").filter("bin <= cut").select(row, "kind", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of its base spans, and all spans."""
    rows = numbered(docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text")), "rows")
    base = materialize(base_spans(rows, "__row", "__text").select("__row", "kind", "start", "end"), "base")
    extra = random_tokens(rows, "__row", "__text")
    overlap = base.select(F.col("__row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    clear = extra.join(overlap, (F.col("__row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left_anti")
    each = base.union(clear)
    names = F.array(*[F.lit(k) for k in KINDS])
    name = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start").cast("string"), F.col("end").cast("string"))
    listed = each.groupBy("__row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))],
        F.array_sort(F.collect_list(F.struct("start", "kind", name.alias("name")))).alias("all"),
    )
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["name"]), ",")
    listed = listed.select(
        "__row", *[f"n_{k}" for k in KINDS],
        joined(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), joined(F.col("all")).alias("spans"),
    )
    ids = rows.select("__row", F.col("__id").alias(id_col))
    whole = ids.join(listed, "__row", "left")
    return whole.select(
        id_col,
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )

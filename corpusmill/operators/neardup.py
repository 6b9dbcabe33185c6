"""Near-duplicate hashes: 64-bit codes, a Hamming join over combinations of bands, and keeping the first of each likeness."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources.scratch import new_folder

AGREE = 1  # bands that two near codes surely have in common
BLOCK = 2048  # codes of one key that one task compares with as many
TILE = 64  # of them at a time
WORDS = 1 << 18  # words whose MD5 a task remembers
PART = 1 << 15  # codes that a fold in order begins with


def sign_hash(vector: str, bits: int = 64) -> Column:
    """The signs of the first components as bits of a long, the first in the highest place."""
    part = F.slice(vector, 1, bits)
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def _word_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: of each text with words (key, text), how many it has, and how many of them have each bit of their MD5 set: two counts a sum."""
    known: dict[bytes, bytes] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            at, n, ones = [], [], []
            for row, text in enumerate(part.column(1).cast(pa.large_binary()).to_pylist()):
                words = Counter((text or b"").split())  # at ASCII white space
                if not words:
                    continue
                if len(known) > WORDS:
                    known.clear()
                for w in [w for w in words if w not in known]:
                    known[w] = hashlib.md5(w, usedforsecurity=False).digest()[:8]
                bits = np.unpackbits(np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint8).reshape(-1, 8), axis=1)
                times = np.fromiter(words.values(), np.float64, len(words))
                at.append(row)
                n.append(int(times.sum()))
                ones.append((times @ bits).astype(np.int64)[::-1])  # by bit, the lowest first
            if at:
                ones = np.stack(ones)
                sums = ones[:, 32:] + (ones[:, :32] << 32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(n, pa.int64()), *(pa.array(x) for x in sums.T)], names=[part.schema.names[0], "n", *(f"s{i}" for i in range(32))])


def token_hash(df: DataFrame, key: str, text: str) -> DataFrame:
    """H38 for texts: (key, code): bit i is set if most words of the text have bit i of their MD5 set; texts without words have none.

    The first hexadecimal digit of the MD5 is bits 63 to 60. Words are counted where their text is; what is dealt is a row a text.
    """
    schema = T.StructType([df.schema[key], T.StructField("n", T.LongType()), *(T.StructField(f"s{i}", T.LongType()) for i in range(32))])
    counted = df.select(key, F.lower(F.col(text)).alias("t")).mapInArrow(_word_votes, schema)
    voted = counted.groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(32)))
    # s<i> holds the count of bit 32 + i in its lower half, that of bit i in its upper half
    code = F.lit(0).cast("long")
    for i in range(64):
        ones = F.shiftright(f"s{i}", 32) if i < 32 else F.col(f"s{i - 32}").bitwiseAND((1 << 32) - 1)
        code = code.bitwiseOR(F.when(2 * ones > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return voted.select(key, code.alias("code"))


def hash_hex(code: Column) -> Column:
    """H38."""
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """H38."""
    return F.bit_count(a.bitwiseXOR(b))


def code_classes(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, class): the smallest key with the same code; a null code is in no class."""
    least = df.groupBy(code).agg(F.min(key).alias("class"))
    return df.filter(F.col(code).isNotNull()).join(least, code).select(key, "class")


def _bands(most: int, agree: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of most + agree bands that share the 64 bits evenly."""
    n = most + agree
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _filed(codes: DataFrame, by: list[str], most: int, agree: int) -> DataFrame:
    """codes, a row for each combination of bands, with its number (combo) and its bits (v)."""
    bands = _bands(most, agree)

    def value(chosen):
        v = F.lit(0).cast("long")
        for x in chosen:
            at, width = bands[x]
            v = F.shiftleft(v, width).bitwiseOR(F.shiftrightunsigned("c", at).bitwiseAND((1 << width) - 1))
        return v

    return codes.select("*", F.posexplode(F.array(*map(value, combinations(range(len(bands)), agree)))).alias("combo", "v"))


def _blocks(n: str) -> Column:
    return F.expr(f"cast(1 + ({n} - 1) div {BLOCK} as int)")


def _sized(filed: DataFrame, at: list[str], *sizes: Column) -> DataFrame:
    """filed with sizes of each key, of columns `at`."""
    counted = filed.groupBy(*at).agg(*sizes)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in at]
    return filed.alias("x").join(counted.alias("y"), same).select("x.*", *(F.col(f"y.{c}") for c in counted.columns if c not in at))


def _close(x: np.ndarray, y: np.ndarray, most: int):
    """Places (i, j) at which codes x and y differ in `most` bits at most, a tile of x at a time."""
    for lo in range(0, len(x), TILE):
        hit = np.flatnonzero(np.bitwise_count(x[lo : lo + TILE, None] ^ y[None, :]) <= most)
        if len(hit):
            i, j = np.divmod(hit, len(y))
            yield i + lo, j


def _codes(rows: pa.Table) -> np.ndarray:
    return rows["c"].to_numpy().astype(np.int64).view(np.uint64)


def _pair_rows(by: list[str], most: int, agree: int):
    """Task: the pairs of blocks p and q of one key that meet here first."""
    bands = _bands(most, agree)
    masks = [np.uint64(((1 << width) - 1) << at) for at, width in bands]
    combos = list(combinations(range(len(bands)), agree))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["i"]))
        c, own = _codes(rows), rows["own"].to_numpy()
        p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
        last = combos[rows["combo"][0].as_py()][-1]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        pairs = []
        for i, j in _close(c[left], c[right], most):
            i, j = left[i], right[j]
            if p == q:
                i, j = i[i < j], j[i < j]
            unlike = c[i] ^ c[j]
            first = sum(((unlike & masks[x]) == 0).astype(np.int8) for x in range(last + 1)) == agree
            pairs.append((np.minimum(i, j)[first], np.maximum(i, j)[first], np.bitwise_count(unlike[first])))
        a, b, distance = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
        found = [*(rows[k].take(a) for k in by), rows["i"].take(a), rows["i"].take(b), pa.chunked_array([distance.astype(np.int32)])]
        return pa.table(found, names=[*by, "a", "b", "distance"])

    return compare


def near_pairs(df: DataFrame, key: str, code: str, most: int = 5, agree: int = AGREE, by: list[str] | None = None) -> DataFrame:
    """(*by, a, b, distance) with a < b: classes of unlike codes with at most `most` unlike bits, by their smallest keys.

    Rows with equal codes (and `by`) are one class, see code_classes(), so a group of copies stands in no pair with itself. Codes
    within `most` bits agree on `agree` of most + agree bands at least: a code is filed under every combination of so many
    bands (with 5 and 1: 6 keys of 10 or 11 bits), and a pair is kept where it meets on the first bands on which it agrees. The codes of
    a key are dealt to blocks, and pairs of blocks compared in tasks of their own, as arrays: of the many pairs of a key only the near
    ones become rows.
    """
    by = by or []
    codes = df.filter(F.col(code).isNotNull()).groupBy(*by, F.col(code).cast("long").alias("c")).agg(F.min(key).alias("i")).filter("i IS NOT NULL")
    return _pairs(codes, by, most, agree)


def _pairs(codes: DataFrame, by: list[str], most: int, agree: int) -> DataFrame:
    """near_pairs() of (*by, c, i)."""
    at = [*by, "combo", "v"]
    met = _sized(_filed(codes, by, most, agree), at, F.count("*").alias("n")).filter("n > 1").withColumn("blocks", _blocks("n"))
    met = met.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).select(*at, "p", "q", "own", "c", "i")
    i = codes.schema["i"].dataType
    schema = T.StructType([*(codes.schema[c] for c in by), T.StructField("a", i), T.StructField("b", i), T.StructField("distance", T.IntegerType())])
    return dealt.groupBy(*at, "p", "q").applyInArrow(_pair_rows(by, most, agree), schema)


def _near_rows(by: list[str], most: int):
    """Task: which codes of one block are near one of the old ones of another."""

    def compare(rows: pa.Table) -> pa.Table:
        c, old = _codes(rows), rows["old"].to_numpy()
        new = np.flatnonzero(~old)
        hit = np.zeros(len(new), bool)
        for i, _ in _close(c[new], c[old], most):
            hit[i] = True
        return rows.take(new[hit]).select([*by, "i"]).rename_columns([*by, "k"])

    return compare


def _near_any(new: DataFrame, old: DataFrame, by: list[str], most: int, agree: int) -> DataFrame:
    """(*by, k): those of new (*by, c, i) that are near one of old."""
    at = [*by, "combo", "v"]
    both = new.withColumn("old", F.lit(False)).unionByName(old.withColumn("old", F.lit(True)))
    met = _sized(_filed(both, by, most, agree), at, F.count_if("old").alias("n_old"), F.count_if(~F.col("old")).alias("n_new"))
    met = met.filter("n_old > 0 AND n_new > 0").withColumns({"b_old": _blocks("n_old"), "b_new": _blocks("n_new")})
    met = met.withColumn("own", F.pmod(F.xxhash64("c"), F.when(F.col("old"), F.col("b_old")).otherwise(F.col("b_new"))).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("old"), F.col("b_new")).otherwise(F.col("b_old")) - 1)).alias("other"))
    p, q = F.when(F.col("old"), F.col("own")).otherwise(F.col("other")), F.when(F.col("old"), F.col("other")).otherwise(F.col("own"))
    schema = T.StructType([*(new.schema[c] for c in by), T.StructField("k", new.schema["i"].dataType)])
    dealt = met.select(*at, p.alias("p"), q.alias("q"), "old", "c", "i")
    return dealt.groupBy(*at, "p", "q").applyInArrow(_near_rows(by, most), schema)


def _written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: a round's plan begins there."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def first_of_each(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, key) that a fold in key order drops: each that is near a smaller kept one. pairs: (*by, a, b) with a < b.

    In rounds: what is near no smaller undecided key is kept, and what is near that is dropped. Each round settles at least the
    smallest keys, in practice nearly all; a chain in which every key is near the next one alone takes a round for two of them.
    """
    at = by or []
    open_ = _written(pairs.select(*at, "a", "b").distinct(), "near-open")
    dropped = None
    while not open_.isEmpty():
        named = lambda df, c: df.select(*at, F.col(c).alias("k")).distinct()
        kept = _minus(named(open_, "a"), named(open_, "b"), at)
        gone = _written(_within(open_, kept, "a", at).select(*at, F.col("b").alias("k")).distinct(), "near-dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = _minus(_minus(_minus(open_, kept, at, "a"), gone, at, "a"), gone, at, "b")
        open_ = _written(left, "near-open")
    return dropped if dropped is not None else open_.select(*at, F.col("a").alias("k"))


def _match(left: DataFrame, keys: DataFrame, column: str, at: list[str], how: str) -> DataFrame:
    other = keys.select(*(F.col(c).alias(f"__{c}") for c in at), F.col("k").alias("__k"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in at] + [F.col(column) == F.col("__k")]
    return left.join(other, same, how)


def _minus(left: DataFrame, keys: DataFrame, at: list[str], column: str = "k") -> DataFrame:
    return _match(left, keys, column, at, "left_anti")


def _within(left: DataFrame, keys: DataFrame, column: str, at: list[str]) -> DataFrame:
    return _match(left, keys, column, at, "left_semi")


def _edges(codes: DataFrame) -> list:
    """Where i is cut: PART codes, then as many as there are before, and so on; none if i has no quantiles."""
    if not isinstance(codes.schema["i"].dataType, T.NumericType):
        return []
    n, at = codes.count(), PART
    shares = []
    while at < n:
        shares.append(at / n)
        at *= 2
    found = codes.agg(F.percentile_approx("i", shares).alias("e")).first()["e"] if shares else []
    return sorted(set(found))


def keep_greedy(items: DataFrame, group: str | None, order: str, code: str, most: int = 5, agree: int = AGREE) -> DataFrame:
    """In order, items that are near no kept one of their group (None: of all); the order is a key of the group.

    Equals a fold over the group in order, but no group is one row or one task. The codes are taken in parts of the order that double:
    those near a kept one of an earlier part go first, so the pairs of near ones within a part, which first_of_each() settles, stay few.
    Of equal codes the first stands for all, the others go; an item without a code is near none.
    """
    at = [group] if group else []
    plain = items.select(*at, F.col(order).alias("i"), F.col(code).alias("c"))
    firsts = plain.filter(F.col("c").isNotNull()).groupBy(*at, "c").agg(F.min("i").alias("i"))
    codes = _written(firsts.withColumn("c", F.col("c").cast("long")), "near-codes")
    edges = _edges(codes)
    kept = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = codes if low is None else codes.filter(F.col("i") > low)
        part = part if high is None else part.filter(F.col("i") <= high)
        if kept is not None:
            part = _written(_minus(part, _near_any(part, kept, at, most, agree).distinct(), at, "i"), "near-part")
        dropped = first_of_each(_pairs(part, at, most, agree), at)
        part = _written(_minus(part, dropped, at, "i"), "near-kept")
        kept = part if kept is None else kept.unionByName(part)
    kept = kept.withColumn("c", F.col("c").cast(items.schema[code].dataType))
    return kept.unionByName(plain.filter(F.col("c").isNull())).select(*at, F.col("i").alias(order), F.col("c").alias(code))

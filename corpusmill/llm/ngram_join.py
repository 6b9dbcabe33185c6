"""Exact Jaccard self-join of documents on word n-grams, by prefix filters under several global token orders.

A document's set is its distinct n-word shingles, as 64-bit hashes. Documents with equal sets are one class, named by a hash of
set and size, and meet once. Two sets of similarity t or more share a token among the first |x| - ceil(t |x|) + 1 of each,
under any order of all tokens; so they do under several orders at once.

  order 1   common tokens last, by a sketch of all documents' tokens whose size is fixed; the rest by hash. Its prefix tokens
            are the buckets that make candidates. A pair that may miss some of its tokens still shares the next ones, so
            it must meet in up to `SPARE` + 1 buckets, or in one large one, and leave enough tokens after each.
  order 2,3 independent hashes. A candidate must share a prefix token under each.

Before texts are fetched, a bitmap of the parity of hash cells, one or two cells a token, bounds how unlike two sets are: the bits
that differ are at most the tokens that only one of them has. Pairs that pass all filters are verified on whole texts.

Buckets are read as sorted streams, so no bucket is ever held whole. Small ones give their pairs there. In larger ones
one pivot, then `PIVOTS`, are compared with all others and links are closed to components; what is then still open
is compared in blocks of `BLOCK` members, components apart, inside tasks that return only pairs that the filters leave. A group of
near copies so costs about its size, and no link between different components is missed, whatever the size of a bucket.
links() compares all members of every bucket in blocks and returns every pair of classes that is similar.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a text of fewer than n words has one
shingle, its whole word sequence; equal texts are always together if their set is not empty; rows of a repeated id
are sets of their own that share the id; a null id takes no part (null component); other columns pass through; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import (
    connected_components,
    discard,
    globally_ranked,
    id_or_least,
    materialize,
    only_ids,
    shuffle_partitions,
    without_ids,
    without_least,
)

WORDS, PERCENT = 5, 80
SKETCH_ROWS, SKETCH_CELLS = 2, 1 << 18  # 4 MB at any size of input; the order matters for speed only
PAGE = 1 << 12  # cells of the sketch to a row
HOT_LEVEL = 12  # tokens of 2**12 documents or more by the sketch: their buckets are dealt to several tasks
SALTS = 16
SMALL_BUCKET = 32
PIVOTS = 8
BLOCK = 1024
SPARE = 3
CHUNK_WORDS = 1 << 17
DEALT_ROWS = 1 << 14  # about so many rows of blocks to a call

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ORDER_2, _ORDER_3 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text; A-Z are lower-cased, words are runs without space or \\t \\n \\v \\f \\r.

    Words of about `CHUNK_WORDS` at a time are hashed side by side, so short texts cost no array operations of their own.
    """
    held: list[list[bytes]] = []
    count = 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass").lower().split() if text else [])  # of bytes: ASCII only
        count += len(held[-1])
        if count >= CHUNK_WORDS:
            yield from _hashed(held, words)
            held, count = [], 0
    yield from _hashed(held, words)


def _hashed(texts: list[list[bytes]], words: int) -> Iterator[np.ndarray]:
    own_words = pa.array(chain.from_iterable(texts), pa.binary()).dictionary_encode()
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, own_words.dictionary.to_pylist()), np.uint64)
    w = of_word[own_words.indices.to_numpy()]
    total = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        total += w[k : len(w) - words + 1 + k] * (_STEP[k % len(_STEP)] + np.uint64(2 * (k // len(_STEP))))
    total = _mix(total)
    at = 0
    for own in texts:
        if not own:
            yield np.empty(0, np.uint64)
        elif len(own) < words:
            yield np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own))], np.uint64)
        else:
            x = np.sort(total[at : at + len(own) - words + 1])
            yield x[np.r_[True, x[1:] != x[:-1]]]
        at += len(own)


def shingles(text: str | None, words: int) -> np.ndarray:
    return next(shingle_sets([text], words))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def parity(tokens: np.ndarray) -> np.ndarray:
    """Which hash cells hold an odd number of tokens, as longs; the number of cells is the next power of two, 64 at least."""
    cells = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """The bitmap of half as many cells (the last axis)."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def class_key(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set; sets of different sizes have independent names."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def _cells(tokens: np.ndarray) -> np.ndarray:
    """Each token's place in each row of the sketch, one row of the result a row of it."""
    shifts = np.arange(SKETCH_ROWS, dtype=np.uint64) * np.uint64(24)
    at = (tokens[None, :] >> shifts[:, None]) % np.uint64(SKETCH_CELLS)
    return at.astype(np.int64) + (np.arange(SKETCH_ROWS) * SKETCH_CELLS)[:, None]


def cell_levels(sketch: np.ndarray) -> np.ndarray:
    """log2 of how much each cell holds beyond what it would by chance; 0 where that isn't clear.

    One deviation is enough: a rare token is only taken for a common one if it has such a cell in every row of the sketch, and then
    it merely comes later in the order.
    """
    usual = float(np.median(sketch))
    beyond = sketch - usual
    return np.where(beyond > usual**0.5 + 8, np.log2(np.maximum(beyond, 1)), 0).astype(np.int8)


def census(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, key, page, counts): a row a document (page -1), and what each task counted in each page of the sketch, in the
    narrowest unsigned type that holds it."""

    def count(batches):
        total = np.zeros(SKETCH_ROWS * SKETCH_CELLS, np.int64)
        for pdf in batches:
            n, key, held, size = [], [], [], 0
            for own in shingle_sets(pdf["t"], words):
                n.append(len(own))
                key.append(class_key(own))
                held.append(own)
                size += len(own)
                if size >= CHUNK_WORDS:  # a batch's tokens are never held together
                    np.add.at(total, _cells(np.concatenate(held)).ravel(), 1)
                    held, size = [], 0
            if held:
                np.add.at(total, _cells(np.concatenate(held)).ravel(), 1)
            yield pd.DataFrame({"id": pdf["id"], "n": n, "key": key}).assign(page=-1, counts=None)
        pages = total.reshape(-1, PAGE)
        page = np.flatnonzero(pages.any(1))
        counts = [pages[i].astype(np.min_scalar_type(int(pages[i].max()))).tobytes() for i in page]
        yield pd.DataFrame({"page": page, "counts": counts}).assign(id=0, n=0, key=0)[["id", "n", "key", "page", "counts"]]

    texts = docs.select(id_or_least(id_col).alias("id"), F.col(text_col).alias("t"))
    return materialize(texts.mapInPandas(count, "id long, n long, key long, page int, counts binary"), "census")


def sketch_of(counted: DataFrame) -> np.ndarray:
    """The levels of the cells of all tasks added up: SKETCH_ROWS * SKETCH_CELLS numbers."""

    def add(batches):
        total: dict[int, np.ndarray] = {}  # no more than the sketch itself
        for pdf in batches:
            for page, counts in zip(pdf["page"], pdf["counts"], strict=True):
                own = total.setdefault(page, np.zeros(PAGE, np.int64))
                own += np.frombuffer(counts, f"u{len(counts) // PAGE}")
        yield pd.DataFrame({"page": list(total), "counts": [x.tobytes() for x in total.values()]})

    pages = counted.filter("page >= 0").select("page", "counts").repartition("page")
    total = np.zeros((SKETCH_ROWS * SKETCH_CELLS // PAGE, PAGE), np.int64)
    for page, counts in pages.mapInPandas(add, "page int, counts binary").toLocalIterator():
        total[page] = np.frombuffer(counts, np.int64)
    return cell_levels(total.ravel())


def signatures(docs: DataFrame, sketch: np.ndarray, text_col: str, words: int, percent: int) -> DataFrame:
    """(key, n, cold, p1, p2, p3, parity) of each class: prefixes under the three orders, how many of the first are of tokens that
    aren't hot, and the bitmap. A class comes once from every batch that holds it."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def sign(batches):
        for pdf in batches:
            rows = {}
            for own in shingle_sets(pdf["t"], words):
                key = class_key(own)
                if not len(own) or key in rows:
                    continue
                k = prefix_length(len(own), percent)
                level = shared.value[_cells(own)].min(0)
                first = np.lexsort((own, level))[:k]
                cold = int((level[first] < HOT_LEVEL).sum())
                second, third = ((np.sort(_mix(own ^ o))[:k] >> np.uint64(48)).astype(np.int16) for o in (_ORDER_2, _ORDER_3))
                rows[key] = (key, len(own), cold, own[first].view(np.int64), second, third, parity(own))
            yield pd.DataFrame(list(rows.values()), columns=["key", "n", "cold", "p1", "p2", "p3", "parity"])

    texts = docs.select(F.col(text_col).alias("t"))
    made = "key long, n int, cold int, p1 array<long>, p2 array<short>, p3 array<short>, parity array<long>"
    return materialize(texts.mapInPandas(sign, made), "signatures")


def meetings(n, other_n, percent: int):
    """(tokens that two sets of these sizes must share, how many of the first of them are surely in both prefixes, SPARE + 1 at most).

    If m tokens must be shared, the first 1 + s common ones are within the first |x| - m + 1 + s of each.
    """
    must = -(-percent * (n + other_n) // (100 + percent))
    reach = [x - -(-percent * x // 100) + 1 - x + must for x in (n, other_n)]
    return must, np.clip(np.minimum(*reach), 1, SPARE + 1)


def leaves_enough(n, pos, other_n, other_pos, percent: int):
    """Whether a common token at these positions may be among the first ones that meetings() counts.

    Sizes are checked by it too, as no more than all tokens of the smaller set can be shared.
    """
    must, times = meetings(n, other_n, percent)
    sizes = 100 * np.minimum(n, other_n) >= percent * np.maximum(n, other_n)
    return sizes & (np.minimum(n - pos, other_n - other_pos) >= must - times + 1)


def bucket_pairs(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one token each that are left by the filters, for rows sorted by token."""
    left, right = [], []
    for step in range(1, len(token)):
        i = np.flatnonzero(token[step:] == token[:-step])
        if not len(i):
            break
        i = i[leaves_enough(n[i], pos[i], n[i + step], pos[i + step], percent)]
        left.append(i)
        right.append(i + step)
    none = np.empty(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def buckets(signed: DataFrame, percent: int, small: int) -> DataFrame:
    """(token, a, b, n, pos, paired): pairs of small buckets, with n the buckets they must meet in, and members of larger ones."""
    salt = F.when(F.col("pos") >= F.col("cold"), 1 + F.pmod("key", F.lit(SALTS))).otherwise(0)
    entries = signed.select("key", "n", "cold", F.posexplode("p1").alias("pos", "token"))
    entries = entries.select("token", salt.cast("int").alias("salt"), "key", "n", "pos")
    entries = entries.repartition(shuffle_partitions(signed.sparkSession), "token", "salt").sortWithinPartitions("token", "n", "key")

    def members(rows: dict) -> pd.DataFrame:
        return pd.DataFrame({"token": rows["token"], "a": rows["key"], "b": 0, "n": rows["n"], "pos": rows["pos"], "paired": False})

    def meet(batches):
        names = ["token", "salt", "key", "n", "pos"]
        held = {c: np.empty(0, np.int64) for c in names}
        large = None  # the token of a bucket that has begun to go out as a larger one

        def settled(rows, last):
            nonlocal held, large
            token = rows["token"]
            if not len(token):
                return
            again = np.zeros(len(token), bool)  # a class that several batches have signed
            again[1:] = (token[1:] == token[:-1]) & (rows["key"][1:] == rows["key"][:-1])
            rows = {c: x[~again] for c, x in rows.items()}
            token = rows["token"]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[starts, len(token)])
            out = np.repeat((size > small), size) | (rows["salt"] > 0)
            if large is not None:
                out |= token == large
            end = len(token) if last else int(starts[-1])  # the last bucket may go on in the next batch
            if not last and out[-1]:
                large, end = token[-1], len(token)
            held = {c: x[end:] for c, x in rows.items()}
            rows, out = {c: x[:end] for c, x in rows.items()}, out[:end]
            yield members({c: x[out] for c, x in rows.items()})
            rows = {c: x[~out] for c, x in rows.items()}
            i, j = bucket_pairs(rows["token"], rows["n"], rows["pos"], percent)
            a, b = rows["key"][i], rows["key"][j]
            times = meetings(rows["n"][i], rows["n"][j], percent)[1]
            yield pd.DataFrame({"token": 0, "a": np.minimum(a, b), "b": np.maximum(a, b), "n": times, "pos": 0, "paired": True})

        for pdf in batches:
            yield from settled({c: np.r_[held[c], pdf[c].to_numpy(np.int64)] for c in names}, last=False)
        yield from settled(held, last=True)

    return entries.mapInPandas(meet, "token long, a long, b long, n int, pos int, paired boolean")


def met_often(met: DataFrame) -> DataFrame:
    """(a, b) of the pairs that meet in as many small buckets as they must. A pair with one of its first common tokens in a
    larger bucket is found there."""
    often = met.filter("paired").groupBy("a", "b").agg(F.count("*").alias("times"), F.first("n").alias("least"))
    return often.filter("times >= least").select("a", "b")


def sketches(signed: DataFrame, keys: DataFrame, *parts: str) -> DataFrame:
    """(key, s) of the classes in keys, s holding the named parts: what pairs are filtered by before texts."""
    found = only_ids(signed.select("key", F.struct(*parts).alias("s")), keys, "key")
    return found.groupBy("key").agg(F.first("s").alias("s"))


def verified(pairs: DataFrame, signed: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the filters leave and whose sets are similar enough on whole texts."""
    pairs = materialize(pairs.distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    keys = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    marks = materialize(sketches(signed, keys, "n", "p2", "p3", "parity"), "sketches")
    met = pairs
    for side in ("a", "b"):  # both sides are dealt at any size, here and below: what is measured on small tables holds for large ones
        met = met.join(marks.select(F.col("key").alias(side), F.col("s").alias(f"s{side}")).hint("merge"), side)
    # sizes are less than a factor of two apart, so bitmaps are folded once at most
    half = lambda x, y: f"""if(size({x}) > size({y}), zip_with(slice({x}, 1, cast(size({x}) / 2 as int)),
        slice({x}, cast(size({x}) / 2 as int) + 1, cast(size({x}) / 2 as int)), (x, y) -> x ^ y), {x})"""  # noqa: E731
    x, y = half("sa.parity", "sb.parity"), half("sb.parity", "sa.parity")
    unlike = F.expr(f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    met = met.filter((100 + percent) * unlike <= (100 - percent) * F.expr("sa.n + sb.n"))
    met = materialize(met.filter(F.arrays_overlap("sa.p2", "sb.p2") & F.arrays_overlap("sa.p3", "sb.p3")).select("a", "b"), "candidates")
    discard(pairs, keys, marks)
    keys = met.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = materialize(classes.join(keys, "key").select("id", "key"), "ids")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    texts = only_ids(texts, materialize(ids.select("id").distinct(), "ids"), "id").join(ids, "id").select("key", "t")
    texts = materialize(texts, "texts")
    both = met.join(texts.select(F.col("key").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")
    both = both.join(texts.select(F.col("key").alias("a"), F.col("t").alias("ta")).hint("merge"), "a")

    def compare(batches):
        last, x = None, np.empty(0, np.uint64)
        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                if ta != last:  # pairs of one document mostly follow each other
                    last, x = ta, shingles(ta, words)
                y = shingles(tb, words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                # another row of a repeated id isn't the class that was asked for
                own = class_key(x) == a and class_key(y) == b
                keep.append(own and 100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]

    links = materialize(both.mapInPandas(compare, "a long, b long"), "links")
    discard(met, ids, texts)
    return links


def pivot_pairs(active: DataFrame, pivots: int, percent: int) -> DataFrame:
    """(a, b) of a few members of each open bucket (the same ones in many buckets) with all its others."""
    bucket = active.groupBy("token").agg(
        F.count("*").alias("m"), F.min(F.xxhash64("key")).alias("least"), (F.min("comp") != F.max("comp")).alias("open")
    )
    chance = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    pivot = (F.xxhash64("key") == F.col("least")) | (chance < F.lit(float(pivots - 1)) / F.col("m"))
    left = active.join(bucket.filter("open"), "token").filter(pivot)
    left = left.select("token", F.col("key").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp"), F.col("comp").alias("pc"))
    met = left.join(active, "token").filter("p != key AND pc != comp")
    most = F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("pp"))
    met = met.filter((100 + percent) * most >= percent * (F.col("n") + F.col("pn")))
    return met.select(F.least("p", "key").alias("a"), F.greatest("p", "key").alias("b"))


def block_pairs(active: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components of each open bucket, compared by bitmap in blocks inside tasks.

    Members are ranked over all buckets by token, component and size; a block is BLOCK neighbours of one bucket. Blocks of one and the
    same component don't meet, nor do blocks whose sizes are too far apart.
    """
    open_ = active.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("token")
    active = active.join(open_, "token", "left_semi")
    ranked = materialize(globally_ranked(active, [F.col(c) for c in ("token", "comp", "n", "key")], "at", "ranks"), "ranks")
    first = ranked.groupBy("token").agg(F.min("at").alias("first"))
    placed = ranked.join(first, "token").withColumn("block", F.expr(f"(at - first) div {BLOCK}"))
    keys = materialize(ranked.select("key").distinct(), "keys")
    marks = sketches(signed, keys, "parity").select("key", "s.parity")
    placed = materialize(placed.join(marks, "key").select("token", "block", "key", "n", "pos", "comp", "parity"), "blocks")
    spans = placed.groupBy("token", "block").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1")
    )
    x, y = (spans.select("token", *(F.col(c).alias(f"{c}{side}") for c in ("block", "c0", "c1", "n0", "n1"))) for side in "xy")
    meets = x.join(y, "token").filter("blockx <= blocky AND NOT (c0x = c1x AND c0y = c1y AND c0x = c0y)")
    meets = meets.filter(100 * F.col("n1x") >= percent * F.col("n0y")).filter(100 * F.col("n1y") >= percent * F.col("n0x"))
    meets = meets.select("token", "blockx", "blocky").withColumn("block", F.explode(F.array_distinct(F.array("blockx", "blocky"))))
    dealt = materialize(meets.join(placed, ["token", "block"]), "meets")
    deals = max(1, dealt.count() // DEALT_ROWS)

    def compare_all(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compare(two) for _, two in pdf.groupby(["token", "blockx", "blocky"], sort=False)])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["block"] == pdf["blockx"]
        same = bool((pdf["blockx"] == pdf["blocky"]).iloc[0])
        x, y = pdf[one], pdf if same else pdf[~one]
        found = [np.empty((0, 2), np.int64)]
        yn, yp, yc, yk = (y[c].to_numpy(np.int64) for c in ("n", "pos", "comp", "key"))
        wide = y["parity"].map(len).to_numpy()
        place = np.zeros(len(y), np.int64)  # of each member's bitmap among those as wide, as they are and folded once
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(wide):
            at = np.flatnonzero(wide == width)
            place[at] = np.arange(len(at))
            whole = np.stack([y["parity"].iloc[i] for i in at]).view(np.uint64)
            maps[width] = whole, folded(whole) if width > 1 else whole
        for key, n, pos, comp, bits in zip(x["key"], x["n"], x["pos"], x["comp"], x["parity"], strict=True):
            at = np.flatnonzero((yc != comp) & leaves_enough(n, pos, yn, yp, percent) & ((yk > key) if same else True))
            own = np.asarray(bits).view(np.uint64)
            for width in np.unique(wide[at]):
                these = at[wide[at] == width]
                theirs = maps[width][int(width > len(own))][place[these]]
                mine = folded(own) if width < len(own) else own
                unlike = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
                these = these[(100 + percent) * unlike <= (100 - percent) * (n + yn[these])]
                found.append(np.column_stack([np.minimum(key, yk[these]), np.maximum(key, yk[these])]))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    deal = F.pmod(F.xxhash64("token", "blockx", "blocky"), F.lit(deals)).alias("deal")
    pairs = dealt.groupBy(deal).applyInPandas(compare_all, "a long, b long")
    pairs = materialize(pairs.distinct(), "pairs")
    discard(ranked, keys, placed, dealt)
    return pairs


def with_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """(token, key, n, pos, comp): a class without links is its own component."""
    members = members.select("token", "key", "n", "pos")
    if found is None:
        return members.withColumn("comp", F.col("key"))
    found = found.select(F.col("node").alias("key"), "component")
    return members.join(found, "key", "left").select("token", "key", "n", "pos", F.coalesce("component", "key").alias("comp"))


def join_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of docs. percent is over 50."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and 100 at most")
    counted = census(docs, id_col, text_col, words)
    sets = counted.filter("page < 0").select(without_least("id").alias("id"), "n", "key")
    classes = materialize(sets.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")), "classes")
    signed = signatures(docs.filter(F.col(id_col).isNotNull()), sketch_of(counted), text_col, words, percent)
    met = materialize(buckets(signed, percent, SMALL_BUCKET), "buckets")
    members = met.filter("NOT paired").withColumnRenamed("a", "key")
    check = (signed, classes, docs, id_col, text_col, words, percent)
    links = [verified(met_often(met), *check)]
    found = _closed(links)
    for pivots in (1, PIVOTS, None):
        active = materialize(with_components(members, found), "active")
        if active.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").isEmpty():
            break  # every bucket is one component
        pairs = block_pairs(active, signed, percent) if pivots is None else pivot_pairs(active, pivots, percent)
        links.append(verified(pairs, *check))
        discard(active)
        if not links[-1].isEmpty():
            discard(found)
            found = _closed(links)
    discard(signed, met, *links)
    tops = classes.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("top", F.coalesce("component", "key"))
    tops = materialize(tops.select("key", "id", "top"), "tops")
    least = tops.groupBy("top").agg(F.min("id").alias("component"))
    whole = tops.join(least, "top").select("key", "component")
    out = sets.join(whole, "key", "left")
    alone = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    out = materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id")), "joined")
    discard(counted, classes, found, tops)
    return out


def _closed(links: list[DataFrame]) -> DataFrame:
    """(node, component) over all links so far."""
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.union(more)
    return connected_components(all_links, "a", "b", "components")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): every similar pair of classes of equal sets, as the smallest ids of both. Class membership is what
    join_components() and equal sets tell; copies aren't expanded into pairs."""
    counted = census(docs, id_col, text_col, words)
    sets = counted.filter("page < 0").select(without_least("id").alias("id"), "n", "key")
    classes = materialize(sets.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")), "classes")
    signed = signatures(docs.filter(F.col(id_col).isNotNull()), sketch_of(counted), text_col, words, percent)
    met = materialize(buckets(signed, percent, SMALL_BUCKET), "buckets")
    active = materialize(with_components(met.filter("NOT paired").withColumnRenamed("a", "key"), None), "active")
    pairs = met_often(met).union(block_pairs(active, signed, percent))
    found = verified(pairs, signed, classes, docs, id_col, text_col, words, percent)
    for side in ("a", "b"):
        found = found.join(classes.select(F.col("key").alias(side), F.col("id").alias(f"id_{side}")), side)
    out = materialize(found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")), "pairs")
    discard(counted, classes, signed, met, active)
    return out


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each component, the document with the smallest id stays; rows without id stay."""
    joined = join_components(docs, id_col, text_col, words, percent)
    gone = joined.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast(docs.schema[id_col].dataType)).distinct()
    gone = materialize(gone, "dropped")
    discard(joined)
    return without_ids(docs, gone, id_col).select(*docs.columns)

"""I-Match fingerprints over randomised lexicon subsets.

The lexicon is the terms whose share of documents lies in a band: neither so common that they say nothing nor so
rare that one edit adds them. Shares below `LOWEST_SHARE` are cut, so the lexicon has at most
(mean distinct terms a document) / LOWEST_SHARE terms however many documents there are; that bound lets it be broadcast.

A subset is named by a density level l and a seed: it keeps a term when the seed's hash of it falls in the lowest
2^-l of the range. A document uses the two levels at which about one band term (0.5 to 2) is left in a subset,
and its fingerprint is the hashes of its sorted distinct terms in each of these subsets. Classic I-Match keeps one
lexicon and so loses a document at its first changed term; sparse subsets survive edits outside them, at any length.

Likeness: among the subsets that both fingerprints use and at least one fills, the share with equal hashes.

Defined cases: null text counts as empty; a document without band terms is fingerprinted on all its terms, one
without any term has the fingerprint "-" (alike 1.0 with itself, 0.0 with others); equal texts have equal
fingerprints; ties and repeated rows follow the order of id, then text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import id_or_least, shuffle_partitions, without_least

LOWEST_SHARE, HIGHEST_SHARE = 1 / 5000, 1 / 10
SEEDS = 16
_WORD = re.compile(r"\w+")
_SEED = np.random.default_rng(8).integers(1, 2**63, SEEDS, dtype=np.uint64) | np.uint64(1)


def terms(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the lower-case words."""
    found = set(_WORD.findall(text.lower()))
    return np.sort(np.fromiter((xxhash.xxh32_intdigest(w) for w in found), np.uint32, len(found)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOWEST_SHARE, high: float = HIGHEST_SHARE) -> np.ndarray:
    """Sorted terms with low <= documents with the term / all documents <= high, counted over all documents."""

    def count(batches):
        for pdf in batches:
            texts = pdf["t"].tolist()
            for at in range(0, len(texts), 2000):
                own = [np.unique(terms(t)) for t in texts[at : at + 2000]]
                term, n = np.unique(np.concatenate(own), return_counts=True) if own else ([], [])
                yield pd.DataFrame({"term": np.asarray(term, np.uint32).view(np.int32), "n": n})

    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("t"))
    total = docs.count()
    df = texts.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = df.filter((F.col("n") >= low * total) & (F.col("n") <= max(high * total, 1))).select("term").toPandas()
    return np.sort(band["term"].to_numpy(np.int32).view(np.uint32))


def fingerprint(text: str, lexicon: np.ndarray) -> tuple[int, list[str]] | None:
    """The first density level and the hashes by level and seed ("" where no term is left); None without terms."""
    own = np.unique(terms(text))
    if not len(own):
        return None
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, own), len(lexicon) - 1)
        band = own[lexicon[at] == own]
        own = band if len(band) else own
    level = int(np.log2(len(own))) if len(own) > 1 else 0
    mixed = (own.astype(np.uint64)[:, None] ^ _SEED) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = []
    for at in (level, level + 1):
        kept = (mixed >> np.uint64(64 - at)) == 0 if at else np.ones(mixed.shape, bool)
        hashes += [xxhash.xxh32_hexdigest(own[k].tobytes()) if k.any() else "" for k in kept.T]
    return level, hashes


def spelled(print_: tuple[int, list[str]] | None) -> str:
    return "-" if print_ is None else f"{print_[0]}:{'.'.join(print_[1])}"


def likeness(a: tuple[int, list[str]] | None, b: tuple[int, list[str]] | None) -> float:
    if a is None or b is None:
        return float(a is b)
    low = max(a[0], b[0])
    high = min(a[0], b[0]) + 2
    if low >= high:
        return 0.0
    x, y = (p[1][(low - p[0]) * SEEDS : (high - p[0]) * SEEDS] for p in (a, b))
    filled = [(h, k) for h, k in zip(x, y, strict=True) if h or k]
    return sum(h == k for h, k in filled) / len(filled) if filled else float(a == b)


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, tail, id, text) dealt so that each part's rows follow each other by id and end with the next document.

    Cut points are quantiles of the ids, a number for each shuffle partition; the documents that begin a part (one
    each) are added as the tail of the part before, the first of all as the tail of the last.
    """
    spark = docs.sparkSession
    rows = docs.select(id_or_least(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    cuts = sorted(set(rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)))
    bucket = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="at", outputCol="part")
    parted = bucket.transform(rows.withColumn("at", F.col("id").cast("double"))).withColumn("part", F.col("part").cast("int")).drop("at")
    heads = parted.groupBy("part").agg(F.min("id").alias("id")).collect()  # a row a part
    first_of = sorted((r["part"], r["id"]) for r in heads)
    ends = [(first_of[i - 1][0], first_of[i][1]) for i in range(len(first_of))]
    tails = spark.createDataFrame(ends, "part int, id long")
    tail_rows = rows.join(F.broadcast(tails), "id").select("part", F.lit(True).alias("tail"), "id", "text")
    whole = parted.select("part", F.lit(False).alias("tail"), "id", "text").unionByName(tail_rows)
    return whole.repartition(n, "part").sortWithinPartitions("part", "tail", "id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    Edited: the last quarter of the code points gives way to the first as many of the next document by id.
    """
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col))

    def compare(batches):
        own = words.value
        held = None  # the row that waits for the next: part, id, text, fingerprint
        for pdf in batches:
            done = []
            for part, tail, id_, text in zip(pdf["part"], pdf["tail"], pdf["id"], pdf["text"], strict=True):
                now = fingerprint(text, own)
                if held is not None and held[0] == part:
                    _, old_id, old, fp = held
                    k = len(old) // 4
                    edited = old[: len(old) - k] + text[:k]
                    fe = fingerprint(edited, own) if k else fp
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    done.append((old_id, len(old), digest, spelled(fp), spelled(fe), likeness(fp, fe), likeness(fp, now)))
                held = None if tail else (part, id_, text, now)
            yield pd.DataFrame(done, columns=[x.split()[0] for x in schema.split(", ")])

    schema = (
        f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_order_with_next(docs, id_col, text_col).mapInPandas(compare, schema).withColumn(id_col, without_least(id_col))

"""Removal of byte strings of `LENGTH` or more that an earlier document holds, by suffix arrays over anchored segments.

1. Anchors. Every LENGTH-byte window has as anchor its GRAM-byte piece with the least hash, so equal windows have
   the same anchor at the same place. About every fifteenth position is an anchor. Its segment, the bytes from
   REACH before it to LENGTH after it, holds all windows that have it as anchor.
2. Whole segments. Anchors meet by hash, packed into byte arrays. A segment that an earlier document has as a whole is
   covered at once; each batch of texts settles its own repeats first, so a common passage is sent once a batch.
3. Suffix arrays. Where an anchor has unlike segments in several documents (the ends of shared passages, edits), their
   bytes are cut from the texts and sorted together by two-stage sorting: only suffixes smaller than their successor
   are sorted directly, the others are induced by scans of the first-byte buckets. Runs of adjacent suffixes with a
   common prefix of LENGTH are equal windows; each is covered in all documents but the smallest id's.
   An anchor with more than `HOT_SEGMENTS` segments has its windows counted by a grouped aggregate instead, which
   splits over tasks.
4. The covered bytes are taken out of each whole text.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing; a null id has no order, so such a row
keeps its text and takes nothing from others; rows with the same id are one document: they don't cover each other, and
what is covered at a place goes in each of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import id_or_least, materialize, only_ids, shuffle_partitions, without_least

LENGTH = 50
GRAM = 22
REACH = LENGTH - GRAM
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
HOT_SEGMENTS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOL = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64; kept and grown in the worker."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, BATCH_BYTES * 2), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = pick(x[:-size], x[size:]), size * 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that follow each other in raw and end at `ends`: the anchors' places, their hashes, their segments' hashes."""
    n = len(raw)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOL[raw] * _power(_BASE, n))])
    back = _power(_BASE_INVERSE, n)
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    least = _slide(gram, REACH + 1, np.minimum)  # of each window
    sizes = np.diff(ends, prepend=0)
    end_of = np.repeat(ends, sizes)[: len(least)]
    least = np.where(np.arange(len(least)) + LENGTH <= end_of, least, np.uint64(0))  # windows don't cross texts
    # a place is an anchor if a window that reaches it has its hash as least; no window of another text reaches it
    reach = _slide(np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)]), REACH + 1, np.maximum)
    at = np.flatnonzero(reach[: len(gram)] == gram)
    start_of = np.repeat(ends - sizes, sizes)
    lo, hi = np.maximum(at - REACH, start_of[at]), np.minimum(at + LENGTH, np.repeat(ends, sizes)[at])
    shape = ((at - lo) * 128 + (hi - at)).astype(np.uint64)
    segment = _mix((sums[hi] - sums[lo]) * back[lo] + shape * np.uint64(0xA0761D6478BD642F))
    return at, gram[at], segment


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of about BATCH_BYTES, by id."""
    for pdf in frames:
        pdf = pdf.sort_values("id", kind="stable")
        ids, texts, size = [], [], 0
        for id_, text in zip(pdf["id"], pdf["t"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            ids.append(id_)
            texts.append(raw)
            size += len(raw)
            if size >= BATCH_BYTES:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
        if ids:
            yield np.array(ids, np.int64), texts


def packed_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hash, segment, doc, pos): arrays as bytes, a row for each batch and bucket; hash null: covered already."""

    def run(frames):
        for ids, raws in _batches(frames):
            ends = np.cumsum([len(r) for r in raws])
            at, gram, segment = anchors(np.frombuffer(b"".join(raws), np.uint8), ends)
            of = np.searchsorted(ends, at, side="right")
            doc, pos = ids[of], (at - (ends - np.diff(ends, prepend=0))[of]).astype(np.int32)
            # texts come by id: a pair's first place is in its smallest document
            order = np.lexsort((at, segment, gram))
            new = np.ones(len(order), bool)
            new[1:] = (gram[order][1:] != gram[order][:-1]) | (segment[order][1:] != segment[order][:-1])
            group = np.cumsum(new) - 1
            repeat = np.zeros(len(order), bool)
            repeat[order] = doc[order] > doc[order][new][group] if len(order) else False
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            rows = []
            for covered in (False, True):
                mine = np.flatnonzero(repeat == covered)
                mine = mine[np.argsort(bucket[mine], kind="stable")]
                for part in np.split(mine, np.flatnonzero(np.diff(bucket[mine])) + 1):
                    if len(part):
                        rest = (gram[part] // np.uint64(buckets)).astype(np.uint32).tobytes()
                        seg = segment[part].tobytes()
                        rows.append((int(bucket[part[0]]), None if covered else rest, None if covered else seg, doc[part].tobytes(), pos[part].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "hash", "segment", "doc", "pos"])

    return texts.mapInPandas(run, "bucket int, hash binary, segment binary, doc binary, pos binary")


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: (doc, a, b, anchor). anchor null: the windows from a to b are covered; else a is a place to look into."""
    done = pdf["hash"].isna()
    join = lambda rows, kind: np.frombuffer(b"".join(rows), kind)
    out_doc, out_pos = [join(pdf["doc"][done], np.int64)], [join(pdf["pos"][done], np.int32)]
    rest = pdf[~done]
    hash_ = join(rest["hash"], np.uint32)
    segment = join(rest["segment"], np.uint64)
    doc, pos = join(rest["doc"], np.int64), join(rest["pos"], np.int32)
    order = np.argsort(hash_, kind="stable")
    first = np.flatnonzero(np.diff(hash_[order], prepend=np.int64(-1)))
    if len(order):
        several = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
        order = order[np.repeat(several, np.diff(first, append=len(order)))]
    hash_, segment, doc, pos = hash_[order], segment[order], doc[order], pos[order]
    order = np.lexsort((doc, segment, hash_))
    hash_, segment, doc, pos = hash_[order], segment[order], doc[order], pos[order]
    new_hash = np.diff(hash_, prepend=np.int64(-1)) != 0
    new = new_hash | (np.diff(segment, prepend=np.uint64(0)) != 0)
    group, kinds = np.cumsum(new) - 1, np.cumsum(new_hash) - 1
    covered = doc > doc[new][group] if len(doc) else np.zeros(0, bool)
    out_doc.append(doc[covered])
    out_pos.append(pos[covered])
    unlike = np.bincount(kinds[new], minlength=1)[kinds] > 1 if len(doc) else np.zeros(0, bool)
    ask = ~covered & unlike
    covers = pd.DataFrame({"doc": np.concatenate(out_doc), "a": np.concatenate(out_pos)})
    covers["b"], covers["a"], covers["anchor"] = covers["a"], np.maximum(covers["a"] - REACH, 0), None
    asked = pd.DataFrame({"doc": doc[ask], "a": pos[ask], "b": pos[ask], "anchor": hash_[ask].astype(np.int64)})
    return pd.concat([covers, asked]) if len(asked) else covers


def settled(packed: DataFrame, buckets: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _settled(pdf)
        out["anchor"] = out["anchor"].astype("Int64") * buckets + int(pdf["bucket"].iloc[0])
        return out

    return packed.groupBy("bucket").applyInPandas(run, "doc long, a int, b int, anchor long")


def two_stage_order(raw: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of raw in the order of their first `depth` bytes at least (what is equal that far is in any order)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    # a suffix is smaller than its successor if the next unlike byte is larger; the end counts as smallest
    change = np.flatnonzero(raw[1:] != raw[:-1])
    up = np.zeros(n, bool)
    nxt = np.searchsorted(change, np.arange(n), side="left")
    has = nxt < len(change)
    up[has] = raw[change[nxt[has]] + 1] > raw[change[nxt[has]]]
    padded = np.concatenate([raw, np.zeros(depth + 16, np.uint8)])
    words = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    small = np.flatnonzero(up)
    small = small[np.argsort(words[small], kind="stable")]
    cut = np.ones(len(small), bool)  # where a group of equal suffixes begins
    cut[1:] = words[small][1:] != words[small][:-1]
    for done in range(8, depth, 8):
        group = np.cumsum(cut) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(small) else small
        if not len(tied):
            break
        key = words[small[tied] + done]
        order = np.lexsort((key, group[tied]))
        small[tied] = small[tied][order]
        key, owner = key[order], group[tied]
        cut[tied[1:]] |= (key[1:] != key[:-1]) & (owner[1:] == owner[:-1])
    direct = np.split(small, np.searchsorted(raw[small], np.arange(1, 256)))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[raw[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        whole = [wave]
        while len(wave):  # runs of c: larger suffixes induced inside the bucket
            before = wave[wave > 0] - 1
            wave = before[(raw[before] == c) & ~up[before]]
            whole.append(wave)
        bucket = np.concatenate([*whole, direct[c]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(raw[before] > c) & ~up[before]]
        before = before[np.argsort(raw[before], kind="stable")]
        for part in np.split(before, np.flatnonzero(np.diff(raw[before].astype(np.int16))) + 1):
            if len(part):
                induced[raw[part[0]]].append(part)
    return np.concatenate(out)


def _equal_windows(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For suffixes in order: whether each has its first LENGTH bytes in common with the one before it."""
    same = np.zeros(len(at), bool)
    live = np.arange(1, len(at))
    words = np.zeros(max(len(raw) - 7, 0), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | raw[k : k + len(words)]
    for off in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        live = live[words[at[live] + off] == words[at[live - 1] + off]]
    same[live] = True
    return same


def covered_windows(segments: pd.DataFrame) -> pd.DataFrame:
    """Segments (doc, start, seg) -> (doc, a, b): runs of windows that a smaller document among them holds."""
    raw = np.frombuffer(b"".join(segments["seg"]), np.uint8)
    sizes = np.array([len(s) for s in segments["seg"]])
    begin = np.cumsum(sizes) - sizes
    doc, start = segments["doc"].to_numpy(np.int64), segments["start"].to_numpy(np.int64)
    order = two_stage_order(raw)
    of = np.searchsorted(begin, order, side="right") - 1
    whole = order + LENGTH <= begin[of] + sizes[of]
    order, of = order[whole], of[whole]
    first = ~_equal_windows(raw, order)
    heads = np.flatnonzero(first)
    least = np.minimum.reduceat(doc[of], heads) if len(of) else doc[:0]
    hit = doc[of] > least[np.cumsum(first) - 1] if len(of) else np.zeros(0, bool)
    at = np.sort(order[hit])  # by segment, then place
    of = np.searchsorted(begin, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(of) != 0)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1) if len(at) else np.empty(0, np.int64)
    where = start[of] + at - begin[of]
    return pd.DataFrame({"doc": doc[of[new]], "a": where[new], "b": where[last]})


def cut_segments(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(anchor, doc, start, seg) of the asked places (doc, a, anchor)."""
    by_doc = materialize(asked.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("a", "anchor")).alias("asked")), "asked")
    found = only_ids(texts, by_doc.select("id"), "id").join(by_doc, "id")

    def run(frames):
        for pdf in frames:
            rows = []
            for id_, text, places in zip(pdf["id"], pdf["t"], pdf["asked"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for place in places:
                    lo = max(place["a"] - REACH, 0)
                    rows.append((place["anchor"], id_, lo, raw[lo : place["a"] + LENGTH]))
            yield pd.DataFrame(rows, columns=["anchor", "doc", "start", "seg"])

    return found.mapInPandas(run, "anchor long, doc long, start int, seg binary")


def covers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, a, b): the windows that start at a to b of doc are held by a document with a smaller id."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    texts = texts.filter("id IS NOT NULL AND t IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    first = materialize(settled(packed_anchors(texts, buckets), buckets), "settled")
    asked = first.filter("anchor IS NOT NULL")
    segments = materialize(cut_segments(texts, asked), "segments")
    hot = segments.groupBy("anchor").count().filter(F.col("count") > HOT_SEGMENTS).select("anchor")
    hot = materialize(hot, "hot")
    usual = segments.join(hot, "anchor", "left_anti").withColumn("bucket", F.pmod(F.col("anchor"), F.lit(buckets)))
    sorted_ = usual.groupBy("bucket").applyInPandas(lambda pdf: covered_windows(pdf), "doc long, a int, b int")
    out = first.filter("anchor IS NULL").select("doc", "a", "b").union(sorted_)
    if hot.isEmpty():
        return out
    many = segments.join(hot, "anchor", "left_semi").filter(F.length("seg") >= LENGTH)
    windows = many.select("doc", "start", "seg", F.explode(F.sequence(F.lit(0), F.length("seg") - LENGTH)).alias("off"))
    windows = windows.select("doc", (F.col("start") + F.col("off")).alias("a"), F.unhex(F.md5(F.expr("substring(seg, off + 1, %d)" % LENGTH))).alias("w"))
    least = windows.groupBy("w").agg(F.min("doc").alias("least"))
    return out.union(windows.join(least, "w").filter("doc > least").select("doc", "a", F.col("a").alias("b")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): what is left of each text, as bytes (a cut may split a character)."""
    found = covers(docs, id_col, text_col).groupBy(F.col("doc").alias("id"))
    spans = found.agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # repeats do no harm
    texts = docs.select(id_or_least(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))

    def run(frames):
        for pdf in frames:
            rows = []
            for id_, text, own in zip(pdf["id"], pdf["t"], pdf["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if own is None or not len(own):
                    rows.append((id_, len(raw), 0, 0, raw))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, np.minimum([s["a"] for s in own], len(raw)), 1)
                np.add.at(edge, np.minimum([s["b"] + LENGTH for s in own], len(raw)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((id_, len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = texts.join(spans, "id", "left").mapInPandas(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return whole.select(without_least("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove_repeats() with the SHA-256 of what is left in place of the bytes."""
    left = remove_repeats(docs, id_col, text_col)
    return left.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



"""Removal of long word sequences that an earlier document holds, over a De Bruijn graph of word k-mers with source coordinates.

An edge is a sequence of `WINDOW` words (it joins the nodes of its first and its last WINDOW - 1 words).

1. Anchors. Every edge has as anchor its GRAM-word piece with the least hash, so equal edges have equal anchors. Only edges whose anchor
   stands in two documents can repeat; about every fourth word is an anchor, and a batch of texts sends each of them once.
2. Edges. The texts that have such anchors give their edges, 96 bits each beside the anchor. A batch settles its own repeats and
   sends one document's edge for all of its documents. Each bucket of anchors then gives every repeated edge its source: the place
   where the smallest document has it. An edge with a smaller source goes; edges that follow each other in document and
   source leave the bucket as one path.
3. Compaction. Paths that meet end to start with the same source, on nodes at which none of the two branches off, become one span
   (document, place, words, source, place there): a shuffle by document and diagonal and a windowed step.
   unitigs() cuts the sources at all nodes where some span begins or ends: repeated nonbranching paths and how often each occurs.
4. Verification. The words of every span and those at its source coordinates are joined by SHA-256; a span that differs is no repeat
   and is given up (and the texts are done again without it).
5. Words that are left are joined by one space.

Defined cases: a null text counts as empty; fewer words than WINDOW lose nothing; a null id has no order, so such a row keeps its text and
takes nothing from others; rows with the same id cover nothing of each other (each is compared with smaller ids only); an
empty table gives no rows; other columns are ignored. An anchor's group grows by some 100 bytes a batch of texts (2 MB).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, id_or_least, marked_ids, materialize, shuffle_partitions, without_least
from corpusmill.llm.suffix_dedup import _mix, _slide

WINDOW = 13
GRAM = 7
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
REQUESTS = 4096  # spans of one source that are verified in one row
OWN, WANTED, MARK = 0, 1, 2  # spans to remove, spans that others have from here, no span

_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)
_SYMBOL = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_space = re.compile(rb"[\x09-\x0d\x20]")
_RUN = ["id", "h", "pos", "len", "src_id", "src_h", "src_pos"]
_RUN_SCHEMA = "id long, h long, pos int, len int, src_id long, src_h long, src_pos int"


_kept_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64; kept in the worker, grown by doubling."""
    have = _kept_powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(1 << max(n, 1).bit_length(), base, np.uint64)
        steps[0] = 1
        have = _kept_powers[int(base)] = np.cumprod(steps)
    return have[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of raw, in order."""
    found, at = [], 0
    while at < len(raw):
        end = min(at + BATCH_BYTES, len(raw))
        if end < len(raw):
            gap = _space.search(raw, end)
            end = gap.start() if gap else len(raw)
        piece = np.frombuffer(raw, np.uint8, end - at, at)
        space = np.concatenate([np.ones(1, bool), _SPACE[piece], np.ones(1, bool)])
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOL[piece] * _power(_BASES[0], len(piece)))])
        found.append(_mix((sums[stop] - sums[start]) * _power(_INVERSES[0], len(piece) + 1)[start]))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _over(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every `width` hashes that follow each other."""
    n = len(hashes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power(_BASES[base], n))])
    return _mix((sums[width:] - sums[:-width]) * _power(_INVERSES[base], n)[: n - width + 1])


class Batch:
    """The words of some texts, their edges and the edges' anchors."""

    def __init__(self, ids: np.ndarray, hs: np.ndarray, raws: list[bytes]):
        self.ids, self.hs = ids, hs
        hashes = [word_hashes(r) for r in raws]
        counts = np.array([len(x) for x in hashes], np.int64)
        self.first = np.cumsum(counts) - counts
        self.words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(raws)), counts)
        n = len(self.words)
        if n < WINDOW:
            self.edge = self.place = np.empty(0, np.int64)
            self.anchor = np.empty(0, np.uint64)
            return
        gram = _over(self.words, GRAM, 1)
        reach = WINDOW - GRAM + 1
        least = _slide(gram, reach, np.minimum)
        self.edge = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= (self.first + counts)[self.doc[: n - WINDOW + 1]])
        place = np.zeros(len(least), np.int64)
        for j in range(reach - 1, -1, -1):  # the leftmost piece with the least hash
            place = np.where(gram[j : j + len(least)] == least, np.arange(len(least)) + j, place)
        self.place, self.anchor = place[self.edge], least[self.edge]

    def edge_hashes(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e1 = _over(self.words, WINDOW, 1)[edge] ^ np.uint64(0x5851F42D4C957F2D)
        e2 = _over(_mix(self.words + np.uint64(0x2545F4914F6CDD1D)), WINDOW, 2)[edge] >> np.uint64(32)
        return e1, e2.astype(np.uint32)


def _batches(frames: Iterator[pd.DataFrame], *more: str) -> Iterator[tuple]:
    """Batches of about BATCH_BYTES, with the values of further columns for each text."""
    held, size = [], 0

    def made():
        ids, hs, raws, *rest = zip(*held, strict=True)
        return Batch(np.array(ids, np.int64), np.array(hs, np.int64), list(raws)), *rest

    for pdf in frames:
        for row in zip(pdf["id"], pdf["h"], pdf["t"], *(pdf[c] for c in more), strict=True):
            raw = row[2].encode()
            held.append((*row[:2], raw, *row[3:]))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def _parts(key: np.ndarray) -> Iterator[np.ndarray]:
    """Places of equal keys."""
    order = np.argsort(key, kind="stable")
    return (p for p in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(p))


def _named(batch: Batch, doc: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents as an index into their distinct ids and text hashes."""
    own, at = np.unique(doc, return_inverse=True)
    return batch.ids[own].tobytes(), batch.hs[own].tobytes(), at.astype(np.uint32).tobytes()


def _joined(pdf: pd.DataFrame, col: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[col]), kind)


def _unnamed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids and text hashes behind the indexes of packed rows."""
    ids, hs = _joined(pdf, "ids", np.int64), _joined(pdf, "hs", np.int64)
    shift = np.cumsum([0, *(len(x) // 8 for x in pdf["ids"])])[:-1]
    at = _joined(pdf, "doc", np.uint32) + np.repeat(shift, [len(x) // 4 for x in pdf["doc"]])
    return ids[at], hs[at]


_ANCHORS = ["bucket", "shared", "lone", "ids", "hs", "doc", "pos"]


def packed_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """Rows a batch and bucket: `shared`, anchors that two of its documents have; `lone`, the others, with place; lone null: places to look into."""

    def run(frames):
        for (batch,) in _batches(frames):
            rows = []
            if len(batch.edge):
                new = np.flatnonzero(np.diff(batch.place, prepend=-1))
                hash_, at = batch.anchor[new], batch.place[new]
                doc = batch.doc[at]
                pos = (at - batch.first[doc]).astype(np.int32)
                order = np.lexsort((batch.ids[doc], hash_))
                hash_, doc, pos = hash_[order], doc[order], pos[order]
                head = np.flatnonzero(np.concatenate([np.ones(1, bool), hash_[1:] != hash_[:-1]]))
                last = np.append(head[1:], len(hash_)) - 1
                group = np.repeat(np.arange(len(head)), last - head + 1)
                shared = batch.ids[doc[head]] != batch.ids[doc[last]]
                lone = ~shared[group]
                told = hash_[head[shared]]
                own = [hash_[lone], doc[lone], pos[lone]]
                by_bucket = {int(told[p[0]] % np.uint64(buckets)): told[p].tobytes() for p in _parts((told % np.uint64(buckets)).astype(np.int64))}
                for p in _parts((own[0] % np.uint64(buckets)).astype(np.int64)):
                    p = p[np.lexsort((own[2][p], own[1][p]))]
                    bucket = int(own[0][p[0]] % np.uint64(buckets))
                    rows.append((bucket, by_bucket.pop(bucket, b""), own[0][p].tobytes(), *_named(batch, own[1][p]), own[2][p].tobytes()))
                rows += [(bucket, told, b"", b"", b"", b"", b"") for bucket, told in by_bucket.items()]
                if shared.any():
                    p = np.flatnonzero(~lone)
                    p = p[np.lexsort((pos[p], doc[p]))]
                    rows.append((int(batch.ids[0] % buckets), b"", None, *_named(batch, doc[p]), pos[p].tobytes()))
            yield pd.DataFrame(rows, columns=_ANCHORS)

    return texts.mapInPandas(run, "bucket int, shared binary, lone binary, ids binary, hs binary, doc binary, pos binary")


def _asked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: (id, h, pos) with the places of each text whose anchors other documents have."""
    direct = pdf["lone"].isna()
    lone = pdf[~direct]
    hash_, told = _joined(lone, "lone", np.uint64), np.unique(_joined(pdf, "shared", np.uint64))
    (ids, hs), pos = _unnamed(lone), _joined(lone, "pos", np.int32)
    order = np.lexsort((ids, hash_))
    hash_, ids, hs, pos = hash_[order], ids[order], hs[order], pos[order]
    if len(hash_):
        head = np.flatnonzero(np.concatenate([np.ones(1, bool), hash_[1:] != hash_[:-1]]))
        last = np.append(head[1:], len(hash_)) - 1
        hit = (ids[head] != ids[last]) | np.isin(hash_[head], told)
        kept = np.repeat(hit, last - head + 1)
        ids, hs, pos = ids[kept], hs[kept], pos[kept]
    (more_ids, more_hs), more = _unnamed(pdf[direct]), _joined(pdf[direct], "pos", np.int32)
    ids, hs, pos = np.concatenate([ids, more_ids]), np.concatenate([hs, more_hs]), np.concatenate([pos, more])
    return pd.DataFrame({"id": ids, "h": hs, "pos": pos})


def _paths(id_, h, pos, src_id, src_h, src_pos) -> np.ndarray:
    """Covered edges, by document and place, as rows of _RUN: those that follow each other here and at the source are one path."""
    if not len(id_):
        return np.empty((0, 7), np.int64)
    order = np.lexsort((pos, h, id_))
    id_, h, pos, src_id, src_h, src_pos = (x[order].astype(np.int64) for x in (id_, h, pos, src_id, src_h, src_pos))
    new = np.ones(len(id_), bool)
    new[1:] = (id_[1:] != id_[:-1]) | (h[1:] != h[:-1]) | (src_id[1:] != src_id[:-1]) | (src_h[1:] != src_h[:-1]) | (pos[1:] != pos[:-1] + 1) | (src_pos[1:] != src_pos[:-1] + 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(id_)))
    return np.stack([id_[head], h[head], pos[head], size, src_id[head], src_h[head], src_pos[head]], axis=1)


def _settle(e1, e2, ids, hs, pos) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (paths of those whose source has a smaller id, places of those in the edge's smallest document)."""
    order = np.lexsort((pos, hs, ids, e2, e1))
    new = np.ones(len(order), bool)
    new[1:] = (e1[order][1:] != e1[order][:-1]) | (e2[order][1:] != e2[order][:-1])
    source = order[new][np.cumsum(new) - 1]
    gone = ids[order] > ids[source]
    here, there = order[gone], source[gone]
    return _paths(ids[here], hs[here], pos[here], ids[there], hs[there], pos[there]), order[~gone]


_EDGES = ["bucket", "e1", "e2", "ids", "hs", "doc", "pos"]


def packed_edges(asked: DataFrame, buckets: int) -> DataFrame:
    """Rows a batch and bucket of edges with asked anchors; e2 null: e1 holds paths that the batch has settled itself."""

    def run(frames):
        for batch, places in _batches(frames, "asked"):
            rows = []
            if len(batch.edge):
                asks = np.zeros(len(batch.words), bool)
                for doc, own in enumerate(places):
                    asks[batch.first[doc] + np.asarray(own)] = True
                live = asks[batch.place]
                edge, anchor = batch.edge[live], batch.anchor[live]
                e1, e2 = batch.edge_hashes(edge)
                doc = batch.doc[edge]
                pos = (edge - batch.first[doc]).astype(np.int32)
                paths, rest = _settle(e1, e2, batch.ids[doc], batch.hs[doc], pos)
                if len(paths):
                    rows.append((int(batch.ids[0] % buckets), paths.tobytes(), None, b"", b"", b"", b""))
                rest = rest[np.lexsort((pos[rest], doc[rest]))]
                bucket = (anchor[rest] % np.uint64(buckets)).astype(np.int64)
                for p in _parts(bucket):
                    q = rest[p]
                    rows.append((int(bucket[p[0]]), e1[q].tobytes(), e2[q].tobytes(), *_named(batch, doc[q]), pos[q].tobytes()))
            yield pd.DataFrame(rows, columns=_EDGES)

    return asked.mapInPandas(run, "bucket int, e1 binary, e2 binary, ids binary, hs binary, doc binary, pos binary")


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the paths of edges that a smaller document has."""
    settled = pdf["e2"].isna()
    rest = pdf[~settled]
    ids, hs = _unnamed(rest)
    paths, _ = _settle(_joined(rest, "e1", np.uint64), _joined(rest, "e2", np.uint32), ids, hs, _joined(rest, "pos", np.int32))
    done = _joined(pdf[settled], "e1", np.int64).reshape(-1, 7)
    return pd.DataFrame(np.concatenate([paths, done]), columns=_RUN)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.coalesce(text_col, F.lit("")).alias("t"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, pos, len, src_id, src_h, src_pos), not yet verified: the edges at pos to pos + len - 1 of text (id, hash h) have an earlier source."""
    texts = _texts(docs, id_col, text_col).filter("id IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    asked = packed_anchors(texts, buckets).groupBy("bucket").applyInPandas(lambda pdf: _asked(pdf), "id long, h long, pos int")
    asked = materialize(asked.groupBy("id", "h").agg(F.collect_list("pos").alias("asked")).withColumn("key", F.xxhash64("id", "h")), "asked-anchors")
    met = marked_ids(texts.withColumn("key", F.xxhash64("id", "h")), asked, "key").filter("__maybe").drop("__maybe", "key")
    met = met.join(asked.drop("key"), ["id", "h"])
    paths = packed_edges(met, buckets).groupBy("bucket").applyInPandas(lambda pdf: _repeated(pdf), _RUN_SCHEMA)
    diagonal = Window.partitionBy("id", "h", "src_id", "src_h", "diagonal").orderBy("pos")
    paths = paths.withColumn("diagonal", F.col("pos") - F.col("src_pos"))
    broken = F.coalesce((F.lag(F.col("pos") + F.col("len")).over(diagonal) < F.col("pos")).cast("int"), F.lit(1))
    paths = paths.withColumn("broken", broken).withColumn("path", F.sum("broken").over(diagonal))
    whole = paths.groupBy("id", "h", "src_id", "src_h", "diagonal", "path").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("len")).alias("end"))
    whole = whole.select("id", "h", "pos", (F.col("end") - F.col("pos")).alias("len"), "src_id", "src_h", (F.col("pos") - F.col("diagonal")).alias("src_pos"))
    found = materialize(whole, "spans")
    discard(asked)
    return found


def unitigs(found: DataFrame) -> DataFrame:
    """(src_id, src_h, start, end, spans): the sources of spans cut at every node where a span begins or ends, and how many pass there."""
    turns = found.select("src_id", "src_h", F.explode(F.array(F.struct(F.col("src_pos").alias("at"), F.lit(1).alias("d")), F.struct((F.col("src_pos") + F.col("len")).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    turns = turns.groupBy("src_id", "src_h", "x.at").agg(F.sum("x.d").alias("d"))
    along = Window.partitionBy("src_id", "src_h").orderBy("at")
    cut = turns.select("src_id", "src_h", F.col("at").alias("start"), F.lead("at").over(along).alias("end"), F.sum("d").over(along).alias("spans"))
    return cut.filter("spans > 0")


def _digest(words: list[bytes], pos: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[pos : pos + n + WINDOW - 1])).digest()[:16]


def _done(texts: DataFrame, found: DataFrame, keep_text: bool) -> DataFrame:
    """All texts without the spans' words, and the digests of every span here and at its source: `part` 0 has a text's own row."""
    wanted = found.select(F.col("src_id").alias("id"), F.col("src_h").alias("h"), F.col("src_pos").alias("pos"), "len").distinct()
    n_parts = wanted.groupBy("id", "h").agg(F.expr(f"cast(1 + count(*) div {REQUESTS} as int)").alias("n_parts"))
    wanted = wanted.join(n_parts, ["id", "h"])
    # no nulls in what Python tasks get: they would turn numbers into floats
    place = F.pmod(F.xxhash64("pos", "len"), F.col("n_parts")).cast("int").alias("part")
    wanted = wanted.select("id", "h", place, F.lit(WANTED).alias("role"), "pos", "len", F.lit(0).alias("src_id"), F.lit(0).alias("src_h"), F.lit(0).alias("src_pos"))
    own = found.select("id", "h", F.lit(0).alias("part"), F.lit(OWN).alias("role"), "pos", "len", "src_id", "src_h", "src_pos")
    mark = n_parts.select("id", "h", F.lit(0), F.lit(MARK), *[F.lit(0)] * 5)
    work = own.union(wanted).union(mark).groupBy("id", "h", "part").agg(F.collect_list(F.struct("role", "pos", "len", "src_id", "src_h", "src_pos")).alias("work"))
    work = materialize(work.withColumn("key", F.xxhash64("id", "h")), "span-work")
    marked = marked_ids(texts.withColumn("key", F.xxhash64("id", "h")), work.select("key").distinct(), "key").drop("key")
    kind = "part int, work array<struct<role:int,pos:int,len:int,src_id:long,src_h:long,src_pos:int>>"
    rest = marked.filter("NOT __maybe").select("id", "h", "t", *(F.lit(None).cast(k).alias(c) for c, k in (x.split(" ", 1) for x in kind.split(", ", 1))))
    whole = rest.union(marked.filter("__maybe").join(work.drop("key"), ["id", "h"], "left").select("id", "h", "t", "part", "work"))
    whole = whole.select(id_or_least("id").alias("id"), "h", "t", F.coalesce("part", F.lit(0)).alias("part"), "work")
    schema = "id long, part int, n_words long, n_removed long, kept binary, kept_sha256 string, checks array<struct<id:long,h:long,pos:int,len:int,digest:binary>>"

    def run(frames):
        for pdf in frames:
            rows = []
            for id_, h, text, part, work in zip(pdf["id"], pdf["h"], pdf["t"], pdf["part"], pdf["work"], strict=True):
                words = text.encode().split()  # bytes are split at ASCII white space only
                checks, gone = [], np.zeros(len(words) + 1, np.int32)
                for s in work if work is not None else ():
                    if s["role"] == MARK:
                        continue
                    digest = _digest(words, s["pos"], s["len"])
                    if s["role"] == WANTED:
                        checks.append((id_, h, s["pos"], s["len"], digest))
                        continue
                    checks.append((s["src_id"], s["src_h"], s["src_pos"], s["len"], digest))
                    gone[s["pos"]] += 1
                    gone[min(s["pos"] + s["len"] + WINDOW - 1, len(words))] -= 1
                if part:
                    rows.append((id_, part, 0, 0, None, None, checks))
                    continue
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                kept = b" ".join(words if len(left) == len(words) else [words[i] for i in left])
                rows.append((id_, 0, len(words), len(words) - len(left), kept if keep_text else None, hashlib.sha256(kept).hexdigest(), checks))
            yield pd.DataFrame(rows, columns=["id", "part", "n_words", "n_removed", "kept", "kept_sha256", "checks"])

    out = materialize(whole.mapInPandas(run, schema), "without-spans")
    discard(work)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept]): what is left of each text without sequences of an earlier document."""
    texts, found = _texts(docs, id_col, text_col), spans(docs, id_col, text_col)
    while True:
        out = _done(texts, found, keep_text)
        checks = out.select(F.explode("checks").alias("c")).groupBy("c.id", "c.h", "c.pos", "c.len")
        unlike = checks.agg(F.min("c.digest").alias("a"), F.max("c.digest").alias("b")).filter("a <> b").drop("a", "b")
        unlike = materialize(unlike.toDF("src_id", "src_h", "src_pos", "len"), "unlike-spans")
        if unlike.isEmpty():
            discard(found, unlike)
            kept = ["kept_sha256", F.col("kept").cast("string").alias("kept")] if keep_text else ["kept_sha256"]
            return out.filter("part = 0").select(without_least("id").alias(id_col), "n_words", "n_removed", *kept)
        before, found = found, materialize(found.join(unlike, ["src_id", "src_h", "src_pos", "len"], "left_anti").select(*_RUN), "spans")
        discard(before, unlike, out)

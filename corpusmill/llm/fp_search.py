"""Ranked lexical search by branch and bound over FP-trees of documents.

1. Items are taken in blocks of bounded size; a block's terms are what documents are restricted to. Tasks read each whole text and write
   its number of terms and its restricted term vector; document frequencies and lengths come from those vectors.
2. Vectors, their terms in order of frequency (rarest first, so that what tells items apart lies near the root), form a compressed trie
   a batch: documents with common leading terms share a path. Every node keeps the largest tf of each term below it, the least m
   and the least id.
3. An item's score over a node's maxima and its least m bounds all scores below. From the root, subtrees are entered depth first,
   best bound first, while their bound can still beat the tenth best found; a single document's bound is its score.
4. Every task yields its best for each item; a window ranks them.

Defined cases: a null or empty text has no terms and isn't found; null ids come before others among ties; rows that repeat a doc_id
are documents of their own, rows that repeat an item_id items of their own; items without terms find nothing; empty tables
give no rows; other columns are ignored. Work is items times documents at worst: a block of items is one pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, globally_ranked, id_or_least, materialize, without_least

ITEM_ROWS = 512  # of one block of items at most
ITEM_BYTES = 8 << 20  # of one block, unless a single item is larger
TREE_DOCS = 16_384
TREE_ENTRIES = 1 << 20
BLOCK_BYTES = 1 << 22  # of a text at a time

_find = re.compile(rb"[0-9a-z\x80-\xff]+").findall  # of lower-cased UTF-8
_outside = re.compile(rb"[^0-9a-z\x80-\xff]")


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size: runs of letters, digits and whatever lies beyond ASCII."""
    raw = text.encode().lower()  # of bytes, only A-Z are lower-cased
    at = 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        if end < len(raw):
            outside = _outside.search(raw, end)
            end = outside.start() if outside else len(raw)
        yield _find(raw[at:end])
        at = end


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Lists of rows (place, id, terms), each of ITEM_ROWS and ITEM_BYTES at most or one row; the driver holds one at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    ranked = globally_ranked(rows, [F.col("id"), F.xxhash64("t")], "place", "items")
    sized = ranked.groupBy(F.expr(f"place div {ITEM_ROWS}").alias("b")).agg(F.sum(F.octet_length("t").cast("long")).alias("n"))
    stack = [(r["b"] * ITEM_ROWS, r["b"] * ITEM_ROWS + ITEM_ROWS, r["n"]) for r in sized.collect()]  # a row a block
    stack.sort(reverse=True)
    while stack:
        lo, hi, n = stack.pop()
        own = ranked.filter((F.col("place") >= lo) & (F.col("place") < hi))
        if n > ITEM_BYTES and hi - lo > 1:
            mid = (lo + hi) // 2
            for a, b in ((mid, hi), (lo, mid)):
                stack.append((a, b, own.filter((F.col("place") >= a) & (F.col("place") < b)).agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]))
            continue
        yield own.orderBy("place").collect()


def restricted(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs): every document's number of terms, and how often it has each of the numbered ones."""
    known = docs.sparkSession.sparkContext.broadcast(number)  # the terms of one block of items, whose size is bounded
    kind = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches):
        get = known.value.get
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                found: Counter = Counter()
                n = 0
                for own in terms_of(text):
                    n += len(own)
                    found.update(map(get, own))
                found.pop(None, None)
                sizes.append(n)
                terms.extend(found)
                tfs.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], schema=kind)

    texts = docs.select(id_or_least(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    return texts.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>").filter("n > 0")


@dataclass
class Tree:
    """A compressed trie in arrays; node 0 is the root and a node's children have consecutive numbers."""

    begin: np.ndarray  # of the children; begin == end: a leaf
    end: np.ndarray
    least_m: np.ndarray
    least_id: np.ndarray
    leaf: np.ndarray  # the leaf's number or -1
    key: np.ndarray  # term * nodes + node, sorted
    most_tf: np.ndarray  # of each key
    gain: np.ndarray  # of each key: what the term adds to a bound, with the node's least m
    docs: list[np.ndarray]  # of each leaf: its documents


def gains(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def build(doc_of: np.ndarray, term: np.ndarray, tf: np.ndarray, ids: np.ndarray, m: np.ndarray, weight: np.ndarray) -> Tree:
    """The tree of documents whose entries (doc_of, term, tf) are sorted by document and term; terms are numbered rarest first."""
    n = len(ids)
    cut = np.searchsorted(doc_of, np.arange(n + 1))
    raw = term.astype(">u4").tobytes()
    words = [raw[4 * cut[i] : 4 * cut[i + 1]] for i in range(n)]
    order = sorted(range(n), key=words.__getitem__)
    vectors, docs = [], []
    for i in order:  # one leaf for each distinct vector
        if vectors and words[i] == vectors[-1]:
            docs[-1].append(i)
        else:
            vectors.append(words[i])
            docs.append([i])
    common = np.zeros(len(vectors), np.int64)  # leading terms in common with the vector before
    for i in range(1, len(vectors)):
        a, b = (np.frombuffer(v, ">u4") for v in (vectors[i - 1], vectors[i]))
        k = min(len(a), len(b))
        unlike = a[:k] != b[:k]
        common[i] = unlike.argmax() if unlike.any() else k
    # nodes in breadth-first order, as ranges of leaves; a range is cut where neighbours have the fewest terms in common
    ranges, parent, begin, end, level = [(0, len(vectors))], [-1], [], [], [0]
    at = 0
    while at < len(ranges):
        lo, hi = ranges[at]
        begin.append(len(ranges))
        if hi - lo > 1:
            inner = common[lo + 1 : hi]
            edges = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
            ranges += list(zip(edges[:-1], edges[1:], strict=True))
            parent += [at] * (len(edges) - 1)
            level += [level[at] + 1] * (len(edges) - 1)
        end.append(len(ranges))
        at += 1
    begin, end, parent, level = (np.array(x, np.int64) for x in (begin, end, parent, level))
    nodes = len(ranges)
    leaf = np.full(nodes, -1)
    ends = np.flatnonzero(begin == end)
    leaf[ends] = [ranges[i][0] for i in ends]
    node_of_leaf = np.empty(len(vectors), np.int64)
    node_of_leaf[leaf[ends]] = ends
    leaf_of_doc = np.empty(n, np.int64)
    for k, own in enumerate(docs):
        leaf_of_doc[own] = k
    least_m, least_id = np.full(nodes, np.iinfo(np.int64).max), np.full(nodes, np.iinfo(np.int64).max)
    np.minimum.at(least_m, node_of_leaf[leaf_of_doc], m)
    np.minimum.at(least_id, node_of_leaf[leaf_of_doc], ids)
    # maxima of tf: from the leaves up, level by level
    terms = len(weight)
    own_node, own_term, own_tf = node_of_leaf[leaf_of_doc[doc_of]], term.astype(np.int64), tf.astype(np.int64)
    of_level = level[own_node]
    kept_key, kept_tf = [], []
    up_key, up_tf = np.empty(0, np.int64), np.empty(0, np.int64)
    for depth in range(int(level.max()), -1, -1):
        mine = of_level == depth
        key = np.concatenate([up_key, own_node[mine] * terms + own_term[mine]])
        most = np.concatenate([up_tf, own_tf[mine]])
        rank = np.argsort(key, kind="stable")
        key, most = key[rank], most[rank]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first):
            key, most = key[first], np.maximum.reduceat(most, first)
        kept_key.append(key)
        kept_tf.append(most)
        here = np.flatnonzero(level == depth)
        if depth:
            np.minimum.at(least_m, parent[here], least_m[here])
            np.minimum.at(least_id, parent[here], least_id[here])
            up_key, up_tf = parent[key // terms] * terms + key % terms, most
    key, most = np.concatenate(kept_key), np.concatenate(kept_tf)
    node, term = key // terms, key % terms
    rank = np.argsort(term * nodes + node)
    node, term, most = node[rank], term[rank], most[rank]
    gain = gains(weight[term], most, least_m[node])
    return Tree(begin, end, least_m, least_id, leaf, term * nodes + node, most, gain, [np.array(d) for d in docs])


class Best:
    """The k best (score, id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def can_enter(self, bound, least_id):
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (least_id < self.id[-1]))

    def add(self, score: np.ndarray, id_: np.ndarray) -> None:
        score, id_ = np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score))[: self.k]
        self.score, self.id = score[order], id_[order]


def search(tree: Tree, query: np.ndarray, times: np.ndarray, doc_scores, ids: np.ndarray, best: Best) -> None:
    """Let the tree's documents enter `best` for one item: its terms and their repeats; doc_scores(docs) gives exact scores."""
    nodes = len(tree.begin)

    def bounds(lo: int, hi: int) -> np.ndarray:
        """Of the nodes lo to hi - 1."""
        a, b = np.searchsorted(tree.key, query * nodes + lo), np.searchsorted(tree.key, query * nodes + hi)
        size = b - a
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, tree.key[at] % nodes - lo, tree.gain[at] * np.repeat(times, size))
        return out

    stack = [(bounds(0, 1)[0], 0)]
    while stack:
        bound, node = stack.pop()
        if not best.can_enter(bound, tree.least_id[node]):
            continue
        lo, hi = tree.begin[node], tree.end[node]
        if lo == hi:
            docs = tree.docs[tree.leaf[node]]
            best.add(np.array([bound]) if len(docs) == 1 else doc_scores(docs), ids[docs])
            continue
        bound = bounds(lo, hi)
        live = np.flatnonzero(best.can_enter(bound, tree.least_id[lo:hi]))
        live = live[np.argsort(bound[live], kind="stable")]  # the best is entered first
        stack += [(bound[i], lo + i) for i in live.tolist()]


def _ranked_in_tasks(vectors: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], rank_of: np.ndarray, weight: np.ndarray, lengths: tuple[int, int], k: int) -> DataFrame:
    """(place, id, score): each task's k best for each item (place, ranks of its terms, their repeats)."""
    docs_all, terms_all = lengths
    shared = vectors.sparkSession.sparkContext.broadcast((queries, rank_of, weight))  # of one block of items
    kind = pa.schema([("place", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        queries, rank_of, weight = shared.value
        best = {place: Best(k) for place, _, _ in queries}

        def take(tables):
            table = pa.Table.from_batches(tables)
            ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
            terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
            sizes = np.diff(terms.offsets.to_numpy())
            doc_of = np.repeat(np.arange(len(ids)), sizes)
            term, tf = rank_of[terms.flatten().to_numpy()], tfs.flatten().to_numpy().astype(np.int64)
            order = np.lexsort((term, doc_of))
            term, tf = term[order], tf[order]
            m = 25 + np.array([75 * int(x) * docs_all // terms_all for x in n], np.int64)
            tree = build(doc_of, term, tf, ids, m, weight)
            key = doc_of * np.int64(len(weight)) + term

            for place, query, times in queries:

                def doc_scores(docs, query=query, times=times):
                    want = docs[:, None] * np.int64(len(weight)) + query[None, :]
                    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                    has = np.where(key[at] == want, tf[at], 0)
                    return (gains(weight[query][None, :], has, m[docs][:, None]) * times[None, :]).sum(axis=1)

                search(tree, query, times, doc_scores, ids, best[place])

        held, docs, entries = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs += len(batch)
            entries += len(batch.column(2).flatten())
            if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                take(held)
                held, docs, entries = [], 0, 0
        if held:
            take(held)
        rows = [(place, np.full(len(b.id), place), b.id, b.score) for place, b in best.items() if len(b.id)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[c] for r in rows])) for c in (1, 2, 3)], schema=kind)

    return vectors.filter(F.size("terms") > 0).select("id", "n", "terms", "tfs").mapInArrow(run, "place long, id long, score long")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, id_col, score): the k documents of highest score above 0 for each item, ties to the smaller id."""
    spark = docs.sparkSession
    found = None
    for rows in item_blocks(items, item_id, item_text):
        counts = [(r["place"], r["id"], sum((Counter(own) for own in terms_of(r["t"])), Counter())) for r in rows]
        number = {t: i for i, t in enumerate(sorted({t for *_, c in counts for t in c}))}
        if not number:
            continue
        vectors = materialize(restricted(docs, id_col, text_col, number), "term-vectors")
        docs_all, terms_all = vectors.agg(F.count("*"), F.sum("n")).first()
        if not docs_all:
            discard(vectors)
            continue
        df = np.zeros(len(number), np.int64)
        for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms
            df[term] = n
        order = np.argsort(df, kind="stable")
        rank_of = np.empty(len(order), np.int64)
        rank_of[order] = np.arange(len(order))
        weight = np.array([math.floor(1000 * math.log((2 * docs_all + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
        queries = []
        for place, _, own in counts:
            if own:
                query = np.array([rank_of[number[t]] for t in own], np.int64)
                by_rank = np.argsort(query)
                queries.append((place, query[by_rank], np.array(list(own.values()), np.int64)[by_rank]))
        best = materialize(_ranked_in_tasks(vectors, queries, rank_of, weight, (docs_all, terms_all), k), "best-of-tasks")
        discard(vectors)
        first = Window.partitionBy("place").orderBy(F.desc("score"), "id")
        names = spark.createDataFrame([(r["place"], r["id"]) for r in rows], f"place long, {item_id} long")
        ranked = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).join(F.broadcast(names), "place")
        ranked = ranked.select(item_id, "rank", without_least("id").alias(id_col), "score")
        found = ranked if found is None else found.union(ranked)
    if found is None:
        return spark.createDataFrame([], f"{item_id} long, rank int, {id_col} long, score long")
    return found

"""Groups of spelling variants in a corpus: words one inserted, deleted or replaced code point apart, by permuterm rotations.

1. Words are counted in tasks (a batch of texts is added up before anything is dealt) and numbered in code-point order.
2. Every word, marked with a terminator, gives its rotations. The rotation that ends with code point i, less that code point, is a
   prefix that all words share which have another code point there, and it is a whole rotation of the word without that code
   point: replacements and indels are both found under one prefix, sorted together.
3. The sorted prefixes are scanned group by group. A group holds at most one word a letter and one shorter word, so it
   is small whatever the corpus. A deletion inside a run of equal letters meets in several groups and counts in the first.
   Each member gets its number of neighbours there and the most frequent of them; no pairs are listed.
4. A word's form is its most frequent neighbour, if that is `ratio` times as frequent; forms are followed to their end by
   doubling joins, of which there are few, as counts grow with every step.

Defined cases: a null text has no words; a null id counts as an empty one where occurrences are edited; repeated rows are rows of
their own; an empty table gives no rows; other columns are ignored. A rotation over `LONG` code points is compared by SHA-256.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, globally_ranked, materialize, shuffle_partitions

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
LONG = 64
BLOCK_CHARS = 1 << 20  # of a text at a time
HELD_WORDS = 200_000  # distinct words a task adds up before it sends them
MARK = "$"

_OUTSIDE = re.compile(r"[^a-zÀ-ÿ]")


def _blocks(text: str) -> Iterator[str]:
    """The text in pieces of about BLOCK_CHARS, cut where no word is cut."""
    at = 0
    while at < len(text):
        end = at + BLOCK_CHARS
        if end < len(text):
            outside = _OUTSIDE.search(text, end)
            end = outside.start() if outside else len(text)
        yield text[at:end]
        at = end


def edited(counts: Counter, id_: object, every: int) -> Counter:
    """Words of one document; where `every` divides the CRC-32 h of `<id>:<word>`, code point h % length is deleted."""
    head = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
    out = Counter()
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), head)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str, min_length: int = MIN_LENGTH, edit_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased, of at least `min_length` code points (after the edits, if any)."""
    find = re.compile("[a-zÀ-ÿ]{%d,}" % min_length).findall
    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=kind)

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for block in _blocks(text.encode().lower().decode()):  # of bytes, only A-Z are lower-cased
                    found = Counter(find(block))
                    held.update(found if edit_every is None else edited(found, id_, edit_every))
                if len(held) >= HELD_WORDS:
                    yield sent()
                    held.clear()
        yield sent()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    found = texts.mapInArrow(run, "word string, n long").filter(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


_SHORTER, _FIRST, _LATER = 0, 1, 2  # a whole rotation; a skipped code point, unlike or like the one before it


def rotations(words: DataFrame) -> DataFrame:
    """(key, id, n, kind): every rotation of every word (id, word, n), whole and without its last code point."""
    size = F.length("word")
    each = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), size * 2)).alias("p"))
    skip = F.col("p") < size
    i = F.when(skip, F.col("p")).otherwise(F.col("p") - size)
    tail = F.substr("word", F.when(skip, i + 2).otherwise(i + 1))
    key = F.concat(tail, F.lit(MARK), F.substr("word", F.lit(1), i))
    again = (i > 0) & (F.substr("word", i + 1, F.lit(1)) == F.substr("word", i, F.lit(1)))
    kind = F.when(~skip, _SHORTER).when(again, _LATER).otherwise(_FIRST)
    return each.select(F.when(F.length(key) > LONG, F.sha2(key, 256)).otherwise(key).alias("key"), "id", "n", kind.cast("byte").alias("kind"))


def _scan(group: np.ndarray, id_: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Members of sorted groups -> (id, near, best_n, best) of those that have neighbours there."""
    size = np.bincount(group)
    wide = size[group] > 1
    group, id_, n, kind = np.unique(group[wide], return_inverse=True)[1], id_[wide], n[wide], kind[wide]
    if not len(group):
        return id_, id_, id_, id_
    short = kind == _SHORTER
    order = np.lexsort((id_, -n, short, group))  # a group's shorter word comes last
    group, id_, n, kind, short = group[order], id_[order], n[order], kind[order], short[order]
    at = np.arange(len(group))
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    end = np.append(begin[1:], len(group))
    has_short = short[end - 1]
    replaced = (end - begin - has_short)[group]  # words of one length
    # the best of one's length: the group's first, or its second for the first itself
    other = np.where(at == begin[group], begin[group] + 1, begin[group])
    other = np.where(replaced > 1, other, -1)
    near = replaced - 1
    # the shorter word, for those whose skipped code point is the first of its run
    meets = has_short[group] & (kind == _FIRST)
    near = near + meets
    shorter = np.where(meets, end[group] - 1, -1)
    # for the shorter word: the best among those
    first = np.full(len(begin), -1)
    firsts = np.flatnonzero(kind == _FIRST)
    np.maximum.at(first, group[firsts], len(group) - firsts)  # the earliest place has the largest remainder
    first = np.where(first >= 0, len(group) - first, -1)
    met = np.bincount(group[firsts], minlength=len(begin))
    near = np.where(short, met[group], near)
    other = np.where(short, first[group], other)
    shorter = np.where(short, -1, shorter)
    # the better of both: larger n, then smaller id
    takes = (shorter >= 0) & ((other < 0) | (n[shorter] > n[other]) | ((n[shorter] == n[other]) & (id_[shorter] < id_[other])))
    best = np.where(takes, shorter, other)
    kept = best >= 0
    return id_[kept], near[kept], n[best[kept]], id_[best[kept]]


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): of the words (id, word, n) that have neighbours, their number and the most frequent one."""
    kind = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.int64())])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = table.column("key").combine_chunks()
            if not len(keys):
                continue
            unlike = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            whole = int(np.flatnonzero(unlike)[-1]) + 1 if unlike.any() else 0  # the last group may go on
            rest = table.slice(whole)
            if whole:
                yield found(table.slice(0, whole), unlike[: whole - 1])
        if rest is not None:
            yield found(rest, np.zeros(len(rest) - 1, bool))

    def found(table, unlike):
        group = np.concatenate([np.zeros(1, np.int64), np.cumsum(unlike)])
        columns = _scan(group, *(table.column(c).to_numpy() for c in ("id", "n", "kind")))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=kind)

    dealt = rotations(words).repartition(shuffle_partitions(words.sparkSession), "key").sortWithinPartitions("key")
    met = dealt.mapInArrow(run, "id long, near long, best_n long, best long")
    return met.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best"))).alias("b")).select(
        "id", "n_near", (-F.col("b.n")).alias("best_n"), "b.best"
    )


def last_of(links: DataFrame) -> DataFrame:
    """Links (id, form) without cycles -> (id, root): where following them ends; every round doubles what a step covers."""
    current = materialize(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = current.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = current.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, current = current, materialize(moved, "roots")
        discard(before)
        if current.filter("moved").isEmpty():
            return current.select("id", "root")


def variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Distinct (word, n) -> (word, n, n_near, form, form_n, root) of the words with `min_count` occurrences or more."""
    counted = materialize(counts.filter(F.col("n") >= min_count), "words")
    words = materialize(globally_ranked(counted, [F.col("word")], "id", "ranked-words"), "numbered-words")
    discard(counted)
    near = materialize(neighbours(words), "near-words")
    with_near = words.join(near, "id", "left")
    form = F.when(F.col("best_n") >= F.col("n") * ratio, F.col("best"))
    formed = materialize(with_near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form_id"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "formed-words")
    discard(near)
    roots = last_of(formed.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    named = lambda col, name: words.select(F.col("id").alias(col), F.col("word").alias(name))
    whole = formed.join(roots.withColumnRenamed("root", "root_id"), "id", "left")
    whole = whole.join(named("form_id", "form"), "form_id", "left").join(named("root_id", "root"), "root_id", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, edit_every: int | None = None) -> DataFrame:
    """variants() of the words of all texts; `edit_every` plants a deletion in about one of so many distinct words a document."""
    return variants(word_counts(docs, id_col, text_col, min_length, edit_every), min_count, ratio)

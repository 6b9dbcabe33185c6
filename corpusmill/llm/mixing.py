"""Pfair mixing of sources to target weights.

Each source's documents are cut into blocks. With share w, block j of a source may start at slot j / w and must
be placed before slot (j + 1) / w; earliest-deadline-first among the blocks that may start is a Pfair schedule: at every
slot each source has had its share to within less than one block.

Shares are exact: a weight is the fraction that its float is, and windows are whole-number divisions, so the deviation
stays below one block of the weights themselves however long the sources last. When a source runs out, the others go
on from there with their weights rescaled: nothing is dropped or repeated. One task lays the blocks out in turn and
holds the next block of each source; the driver holds a count and a weight a source.

Defined cases: a null source is a source of its own; sources without a weight get `default_weight` (with no weights
at all, weights are the square roots of the sources' row counts); weights must be positive; a source's order is
by a hash of the id, then the id; repeated rows are separate rows; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, globally_ranked, identified, materialize, shuffle_partitions

BLOCK_ROWS = 16
CHUNK = 100_000
NULL_SOURCE = "\0null"
_LAST = 2**63 - 1  # a deadline beyond it is none


def whole_parts(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    if not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def edf(parts: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) by earliest deadline first, ties by source, without end."""
    length = sum(parts.values())
    # a source's next deadline is always after its last, so its next block is all that has to wait
    waiting: list[tuple[int, str, int]] = []
    ready = [(-(-length // p), s, 0, 0) for s, p in parts.items()]
    heapq.heapify(ready)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * length // parts[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, slot, release, deadline
        heapq.heappush(waiting, ((j + 1) * length // parts[s], s, j + 1))
        slot += 1


def edf_cycle(parts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The slots after which edf() repeats itself."""
    return list(islice(edf(parts), sum(parts.values())))


def layout(blocks: dict[str, int], parts: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks.

    Slots are filled up to the one whose source has nothing left; that source leaves and the rest go on with a schedule of
    their own.
    """
    left, base = dict(blocks), 0
    while left := {s: n for s, n in left.items() if n}:
        first, slot = {s: blocks[s] - n for s, n in left.items()}, 0
        for s, j, slot, release, deadline in edf({s: parts[s] for s in left}):
            if not left[s]:
                break
            left[s] -= 1
            yield s, first[s] + j, base + slot, base + release, base + deadline
        base += slot


def schedule(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block_rows: int = BLOCK_ROWS, default_weight: float = 1.0, row_col: str | None = None,
) -> DataFrame:
    """(__row, id_col, source_col, block, slot, release, deadline, position), one row per document.

    position is gapless; __row is row_col, a name that docs' rows hold (see identified()); None: numbers of its own.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(number.alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"))
    rows = rows.withColumn("__name", F.coalesce(F.col("__source").cast("string"), F.lit(NULL_SOURCE)))
    ranked = globally_ranked(rows, [F.col("__name"), F.xxhash64("__id"), F.col("__id"), F.col("__row")], "__rank", "sources")
    ranked = materialize(ranked, "ranks")
    counts = {r[0]: (r[1], r[2]) for r in ranked.groupBy("__name").agg(F.count("*"), F.min("__rank")).collect()}  # a row a source
    if weights is None:
        own = {s: n**0.5 for s, (n, _) in counts.items()}
    else:
        own = {s: weights.get(s, default_weight) for s in counts}
    parts = whole_parts(own) if own else {}
    names = sorted(counts)
    sizes = [counts[s][0] for s in names]
    blocks = {k: -(-n // block_rows) for k, n in enumerate(sizes)}
    shares = {k: parts[s] for k, s in enumerate(names)}

    def lay(batches):
        for _ in batches:
            start, slots = 0, layout(blocks, shares)
            while chunk := list(islice(slots, CHUNK)):
                rows = []
                for k, block, slot, release, deadline in chunk:
                    rows.append((k, block, slot, release, min(deadline, _LAST), start))
                    start += min(block_rows, sizes[k] - block * block_rows)  # the last block of a source may not be full
                yield pd.DataFrame(rows, columns=["__k", "block", "slot", "release", "deadline", "__start"])

    laid = spark.range(0, 1, 1, 1).mapInPandas(lay, "__k int, block long, slot long, release long, deadline long, __start long")
    laid = materialize(laid, "layout")
    firsts = [(s, k, counts[s][1]) for k, s in enumerate(names)]
    starts = F.broadcast(spark.createDataFrame(firsts, "__name string, __k int, __first long"))  # a row a source
    out = ranked.join(starts, "__name").withColumn("__in", F.col("__rank") - F.col("__first"))
    out = out.withColumn("block", F.expr(f"__in div {int(block_rows)}")).join(laid.hint("merge"), ["__k", "block"])
    out = out.select(
        "__row", F.col("__id").alias(id_col), F.col("__source").alias(source_col), "block", "slot", "release", "deadline",
        (F.col("__start") + F.col("__in") % block_rows).alias("position"),
    )
    out = materialize(out, "schedule")
    discard(ranked, laid)
    return out


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs in the schedule's order: partitions are ranges of positions, and rows are sorted inside them."""
    rows = identified(docs, "rows")
    places = schedule(rows, weights, id_col, source_col, block_rows, row_col="__row").select("__row", F.col("position").alias("__position"))
    whole = rows.join(places.hint("merge"), "__row")  # both sides are dealt at any size
    whole = whole.repartitionByRange(shuffle_partitions(docs.sparkSession), "__position").sortWithinPartitions("__position")
    return whole.select(*docs.columns)

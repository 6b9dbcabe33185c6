"""Unigram Viterbi encoding and exact decoding with the pieces of a SentencePiece model.

The pieces stand in a double-array trie over UTF-8 bytes, in which the whitespace marker is the
space byte: a literal U+2581 in a text then never meets the marker and goes through byte fallback, so
decoding gives back every text exactly. A text is encoded with one marker in front of it.

No piece has the marker behind another character or holds a line feed, so the best segmentation of a
text is that of its chunks (spaces and the word after them; line feeds) put together, and a chunk's
result can be kept.

Scores: the public vocabulary file gives merge ranks, not probabilities; the log score of a piece is the
Zipf estimate -ln(2 + rank). Runs of markers count as the last rank. A byte of fallback costs
`FALLBACK_PENALTY` more than the worst piece.

Defined cases: null text -> no ids and null decoded text; empty text -> no ids and empty text; ties between
segmentations -> the one whose last piece is longest, at each position; repeated rows are encoded alike; rows
and other columns pass through unchanged.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FALLBACK_PENALTY = 10.0
MARKER = "▁"
KEPT_CHUNKS = 400_000  # about 100 MB a worker
TEXTS_AT_ONCE = 500
LONGEST_KEPT = 64
_CHUNK = re.compile(r" *[^ \n]+|\n| +")


class PieceTrie:
    """Double array: the child of state s by byte c is base[s] + c + 1 if check of it is s."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], byte_ids: list[int], size: int):
        self.byte_ids, self.size = byte_ids, size
        self.spelled: list[bytes] = [b""] * size
        for raw, _, i in pieces:
            self.spelled[i] = raw
        for value, i in enumerate(byte_ids):
            self.spelled[i] = bytes([value])
        self.fallback = min(score for _, score, _ in pieces) - FALLBACK_PENALTY
        self._build(sorted(pieces))

    def _build(self, pieces: list[tuple[bytes, float, int]]) -> None:
        room = 1 << 12
        base, check = [0] * room, [-1] * room
        piece, score = [-1] * room, [-math.inf] * room
        check[0], free, dense = 0, 257, 257  # places below free count as taken; below dense the array is nearly full
        queue = [(0, 0, len(pieces), 0)]  # state, first and last piece below it, depth
        for state, lo, hi, depth in queue:
            if len(pieces[lo][0]) == depth and depth:
                piece[state], score[state] = pieces[lo][2], pieces[lo][1]
                lo += 1
            children: list[tuple[int, int, int]] = []
            while lo < hi:
                c, start = pieces[lo][0][depth], lo
                while lo < hi and pieces[lo][0][depth] == c:
                    lo += 1
                children.append((c, start, lo))
            if not children:
                continue
            while check[free] != -1:
                free += 1
            first = children[0][0] + 1
            at, tried = max(0, (free if len(children) == 1 else dense) - first), 0
            while True:
                if at + 257 >= len(base):
                    base += [0] * len(base)
                    check += [-1] * len(check)
                    piece += [-1] * len(piece)
                    score += [-math.inf] * len(score)
                if all(check[at + c + 1] == -1 for c, _, _ in children):
                    break
                at, tried = at + 1, tried + 1
            if tried > 64:
                dense = at + first
            base[state] = at
            for c, start, end in children:
                check[at + c + 1] = state
                queue.append((at + c + 1, start, end, depth + 1))
        self.base, self.check = np.array(base, np.int32), np.array(check, np.int32)
        self.piece, self.score = np.array(piece, np.int32), np.array(score)  # no child lies beyond the array: at + 257 < len

    def ready(self) -> PieceTrie:
        """The arrays as lists, which single look-ups read faster; called once in each worker."""
        if isinstance(self.base, np.ndarray):
            self.arrays = (self.base, self.check, self.piece, self.score)
            self.base, self.check = self.base.tolist(), self.check.tolist()
            self.piece, self.score = self.piece.tolist(), self.score.tolist()
            sizes = np.array([len(x) for x in self.spelled])
            self.spelling = (np.frombuffer(b"".join(self.spelled), np.uint8), np.cumsum(sizes) - sizes, sizes)
        return self

    def viterbi(self, raw: bytes) -> list[int]:
        """The ids of one chunk, place by place."""
        base, check, piece, score = self.base, self.check, self.piece, self.score
        n, limit = len(raw), len(check)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        came, by = [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here = best[i]
            if here + self.fallback > best[i + 1]:
                best[i + 1], came[i + 1], by[i + 1] = here + self.fallback, i, self.byte_ids[raw[i]]
            state, j = 0, i
            while j < n:
                child = base[state] + raw[j] + 1
                if child >= limit or check[child] != state:
                    break
                state, j = child, j + 1
                if here + score[state] > best[j]:  # -inf where no piece ends
                    best[j], came[j], by[j] = here + score[state], i, piece[state]
        ids = []
        while n:
            ids.append(by[n])
            n = came[n]
        return ids[::-1]

    def viterbi_many(self, raws: list[bytes]) -> list[bytes]:
        """viterbi() of many chunks, as int32 bytes: chunks of one length stand side by side and walk the trie in step."""
        out: list[bytes] = [b""] * len(raws)
        lens = np.array([len(r) for r in raws])
        byte_ids = np.array(self.byte_ids, np.int32)
        base, check, piece, score = self.arrays
        for n in np.unique(lens):
            members = np.flatnonzero(lens == n)
            text = np.frombuffer(b"".join([raws[k] for k in members]), np.uint8).reshape(len(members), n).T.astype(np.int32)
            best = np.full((n + 1, len(members)), -np.inf)
            best[0] = 0.0
            came, by = np.zeros((n + 1, len(members)), np.int32), np.zeros((n + 1, len(members)), np.int32)
            for i in range(n):
                worse = best[i] + self.fallback > best[i + 1]
                best[i + 1][worse] = (best[i] + self.fallback)[worse]
                came[i + 1][worse], by[i + 1][worse] = i, byte_ids[text[i][worse]]
                alive, state = np.arange(len(members)), np.zeros(len(members), np.int32)
                for j in range(i, n):
                    child = base[state] + text[j][alive] + 1
                    ok = check[child] == state
                    alive, state = alive[ok], child[ok]
                    if not len(alive):
                        break
                    reach = best[i][alive] + score[state]  # -inf where no piece ends
                    better = reach > best[j + 1][alive]
                    to = alive[better]
                    best[j + 1][to], came[j + 1][to], by[j + 1][to] = reach[better], i, piece[state[better]]
            taken = np.full((len(members), n), -1, np.int32)  # filled from the right
            at, every = np.full(len(members), n), np.arange(len(members))
            for k in range(n - 1, -1, -1):
                go = at > 0
                if not go.any():
                    break
                taken[go, k] = by[at[go], every[go]]
                at[go] = came[at[go], every[go]]
            kept, sizes = taken[taken >= 0].tobytes(), (taken >= 0).sum(1) * 4
            ends = np.cumsum(sizes)
            for k, lo, hi in zip(members.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                out[k] = kept[lo:hi]
        return out

    def encode_many(self, texts: list[str], kept: dict[str, bytes]) -> list[bytes]:
        """Each text's ids as int32 bytes; `kept` holds chunks' results from one call to the next."""
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(kept)
        if len(kept) + len(fresh) > KEPT_CHUNKS:
            kept.clear()
            fresh = set().union(*cut)
        short = [c for c in fresh if len(c) <= LONGEST_KEPT]
        own = {c: np.array(self.viterbi(c.encode()), np.int32).tobytes() for c in fresh if len(c) > LONGEST_KEPT}
        if short:
            kept.update(zip(short, self.viterbi_many([c.encode() for c in short]), strict=True))
        look = kept | own if own else kept
        return [b"".join(map(look.__getitem__, chunks)) for chunks in cut]

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The texts of consecutive id lists in one buffer, and where each ends; the marker in front goes."""
        flat, starts, sizes = self.spelling
        at, size = starts[ids], sizes[ids]
        begins = np.concatenate([[0], ends[:-1]])
        first = begins[ends > begins]
        at[first] += 1
        size[first] -= 1
        total = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])].tobytes(), total[ends]


def load_trie(model_path: str = DEFAULT_MODEL) -> PieceTrie:
    """The trie of a SentencePiece model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    pieces = []
    for i in range(size):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        rank = min(-model.get_score(i), size)
        pieces.append((model.id_to_piece(i).replace(MARKER, " ").encode(), -math.log(2 + rank), i))
    if any(b" " in raw.lstrip(b" ") or b"\n" in raw for raw, _, _ in pieces):
        raise ValueError("a piece has the marker or a line feed inside: texts can't be cut into chunks")
    return PieceTrie(pieces, byte_ids, size)


_kept: dict[str, bytes] = {}  # of this worker


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """df with ids_col array<int> added (any column of that name goes); each text is read whole."""
    trie = df.sparkSession.sparkContext.broadcast(load_trie(model_path))
    df = df.drop(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        own = trie.value.ready()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                ids = own.encode_many(texts, _kept)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield _with_column(part, ids_col, pa.ListArray.from_arrays(pa.array(ends), flat))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """df with text_col added, spelled out from ids_col; null ids -> null."""
    trie = df.sparkSession.sparkContext.broadcast(load_trie(model_path))
    df = df.drop(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        own = trie.value.ready()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                lists = part.column(part.schema.get_field_index(ids_col))
                sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                spelled, ends = own.decode_many(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
                begins = [0, *ends[:-1].tolist()]
                texts = [spelled[a:b].decode("utf-8", "replace") for a, b in zip(begins, ends.tolist(), strict=True)]
                yield _with_column(part, text_col, pa.array(texts, pa.string(), mask=~np.asarray(lists.is_valid())))

    return df.mapInArrow(run, schema)


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

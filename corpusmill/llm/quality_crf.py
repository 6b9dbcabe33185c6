"""A linear-chain conditional random field labels every line good or bad; its marginals make a document's quality.

A line's features are shares of character classes, word statistics and facts about its document, beside those of
the lines before and after it. The field has one weight a feature and one a label pair. It is trained on labelled
documents, every line of which carries its document's label, by ascent of the exact conditional likelihood.
A document's score is a logistic calibration of the mean log-odds that its lines are good, each line weighted by
its length.

Training uses at most `TRAIN_DOCS` labelled documents, those first in the order of a hash of the id; features
are made by Spark tasks and only these reach the driver (some kilobytes a document). All documents are scored.

Defined cases: null text counts as empty; an empty text is one empty line and gets a score as any other; repeated
rows are scored alike; without labelled documents of both kinds every score is the share of good labels (0.5
without labels); other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_DOCS = 3000
STEPS = 120
THRESHOLD = 0.3
_L2 = 1e-3

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c",
    "stop": b".,;:'\"?()-", "shout": b"!", "bar": b"|", "sign": b"#$%&*@^~<>{}=+_\\/[]`", "wide": bytes(range(128, 256)),
}
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_chars)] = _k + 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: a row of features, the line's length, and each text's number of lines."""
    split = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in split], np.int64)
    raw = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-8", "surrogatepass"), np.uint8)
    begin = np.concatenate([[0], np.flatnonzero(raw == 10)[:-1] + 1]) if len(raw) else np.zeros(0, np.int64)
    kind = _CLASS_OF[raw]
    size = np.diff(begin, append=len(raw)) - 1.0
    share = [np.add.reduceat(kind == k + 1, begin, dtype=np.int64) / np.maximum(size, 1) for k in range(len(_CLASSES))]
    words, distinct, echo, seen = [], [], [], []
    doc_words, doc_distinct = [], []
    for lines in split:
        once: dict[str, int] = {}
        vocabulary: set[str] = set()
        total = 0
        for line in lines:
            own = line.split()
            kinds = set(own)
            words.append(len(own))
            distinct.append(len(kinds))
            echo.append(sum(map(eq, own, own[1:])))
            once[line] = once.get(line, 0) + 1
            vocabulary |= kinds
            total += len(own)
        seen += [once[line] for line in lines]
        doc_words.append(total)
        doc_distinct.append(len(vocabulary))
    n = np.maximum(np.array(words, float), 1)
    per_doc = lambda x: np.repeat(np.array(x, float), counts)
    bytes_of = np.add.reduceat(size, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)
    columns = [
        *share,
        np.log1p(size) / 6, np.log1p(n) / 4, np.minimum(size / n, 40) / 10,
        np.array(distinct) / n, np.array(echo) / n, (np.array(seen) > 1) * 1.0,
        np.log1p(per_doc(bytes_of)) / 10, per_doc(doc_distinct) / np.maximum(per_doc(doc_words), 1),
        np.log1p(per_doc(counts)) / 5, (per_doc(doc_words) < 12) * 1.0,
    ]
    return np.stack(columns, 1).astype(np.float32) if len(size) else np.zeros((0, 0), np.float32), size, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A constant, each line's features, and those of the lines before and after it (zeros beyond the document)."""
    start = np.cumsum(counts) - counts
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[start], after[start + counts - 1] = 0, 0
    return np.concatenate([np.ones((len(x), 1), np.float32), x, before, after], 1)


@dataclass
class LineCrf:
    """Weights for label 1 against label 0, and the label pairs' weights trans[from, to]."""

    weights: np.ndarray
    trans: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def messages(self, phi: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds that reach each line from the lines before it and from those after it; all documents in step."""
        forth, back = np.zeros(len(phi)), np.zeros(len(phi))
        order = np.argsort(-counts, kind="stable")
        start, lens = (np.cumsum(counts) - counts)[order], counts[order]
        t = self.trans
        for step in range(1, int(lens[0]) if len(lens) else 0):
            live = int(np.searchsorted(-lens, -step, side="left"))  # documents with more than `step` lines
            at = start[:live] + step
            x = phi[at - 1] + forth[at - 1]
            forth[at] = np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])
            at = start[:live] + lens[:live] - 1 - step
            x = phi[at + 1] + back[at + 1]
            back[at] = np.logaddexp(t[1, 0], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[0, 1])
        return forth, back

    def doc_logits(self, x: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginal log-odds, bounded so that no line outweighs all others."""
        phi = x @ self.weights
        forth, back = self.messages(phi, counts)
        start, weight = np.cumsum(counts) - counts, np.maximum(size, 1)
        odds = np.clip(phi + forth + back, -20, 20)
        return np.add.reduceat(odds * weight, start) / np.add.reduceat(weight, start)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, size, counts = line_features(texts)
        logit = self.doc_logits(with_neighbours(x, counts), size, counts)
        return 1 / (1 + np.exp(-(self.scale * logit + self.shift)))


def train(x: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> LineCrf:
    """Adam on the mean conditional log-likelihood a line, then a logistic fit of documents' labels to their logits."""
    x = with_neighbours(x, counts)
    y = np.repeat(labels.astype(float), counts)
    start = np.cumsum(counts) - counts
    inner = np.ones(len(x), bool)
    inner[start] = False
    nxt = np.flatnonzero(inner)  # lines with a line before them
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[nxt - 1].astype(int), y[nxt].astype(int)), 1)
    crf = LineCrf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    weight = 1 / np.repeat(counts, counts) ** 0.5  # a long document doesn't decide alone
    m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        phi = x @ crf.weights
        forth, back = crf.messages(phi, counts)
        p = 1 / (1 + np.exp(-np.clip(phi + forth + back, -30, 30)))
        left, right = (phi + forth)[nxt - 1], (phi + back)[nxt]
        joint = np.stack([np.zeros(len(nxt)) + crf.trans[0, 0], right + crf.trans[0, 1], left + crf.trans[1, 0], left + right + crf.trans[1, 1]])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        g_w = x.T @ ((y - p) * weight) / weight.sum() - _L2 * crf.weights
        g_t = (observed - joint.sum(1).reshape(2, 2)) / len(x) - _L2 * crf.trans
        g = np.concatenate([g_w, g_t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        crf.weights = crf.weights + move[:-4]
        crf.trans = crf.trans + move[-4:].reshape(2, 2)
    logit, z = crf.doc_logits(x, size, counts), np.zeros(2)
    design = np.stack([logit, np.ones(len(logit))], 1)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(design @ z, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        z = z + np.linalg.solve(hess, design.T @ (labels - p) - 1e-3 * z)
    crf.scale, crf.shift = float(z[0]), float(z[1])
    return crf


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", train_docs: int = TRAIN_DOCS,
) -> LineCrf | float:
    """The field trained on labelled rows that `usable` (over the labels' id) admits; a float where it can't be."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    chosen = chosen.filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull())
    if usable is not None:
        chosen = chosen.filter(usable)
    chosen = chosen.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(train_docs)
    known = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    known = known.join(F.broadcast(chosen), "__id")  # train_docs rows at most

    def featurise(batches):
        for pdf in batches:
            x, size, counts = line_features(pdf["__text"].tolist())
            cuts = np.cumsum(counts)[:-1]
            yield pd.DataFrame({
                "y": pdf["__y"], "id": pdf["__id"], "x": [a.ravel() for a in np.split(x, cuts)], "size": np.split(size, cuts),
            })

    schema = "y int, id long, x array<float>, size array<double>"
    got = known.mapInPandas(featurise, schema).toPandas().sort_values("id", kind="stable")
    if got["y"].nunique() < 2:
        return float(got["y"].mean()) if len(got) else 0.5
    counts = np.array([len(s) for s in got["size"]])
    x = np.concatenate(list(got["x"])).reshape(counts.sum(), -1)
    return train(x, np.concatenate(list(got["size"])), counts, got["y"].to_numpy())


def score(docs: DataFrame, model: LineCrf | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col added (0 to 1, higher: better), whatever their labels."""
    if isinstance(model, float):
        return docs.withColumn(score_col, F.lit(model))
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                scores = pa.array(model.scores([t or "" for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, score_col])

    return docs.mapInArrow(run, schema)

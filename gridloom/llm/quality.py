"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

Each document becomes a handful of numbers (shares of character classes, word and line shapes,
repetition). Every feature is cut into quantile bins and gets a lookup table of log-odds, learned by
cyclic boosting: in turn, each feature fits a shallow tree (a few splits of its bins) to the current
gradients and adds a small step to its table. Then the pairs of features that explain most of what is
left get two-dimensional tables in the same way. A score is the sigmoid of a sum of table entries, so
scoring is one vectorised look-up for each table.

Fitting takes a bounded sample of labelled rows (``MOST_TRAINING``, chosen by a hash of the id);
features and scores cover every row and the whole text.

Defined cases: null counts as the empty text and gets a score like any other text; an id labelled more
than once has the larger label; null labels are not learned from; with no labels, or one class only,
the score is that share (0.5 without any); repeated rows give repeated results; extra columns do not
take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.language_id import hash62, held_out_rows, remainder, share_of_hashes
from gridloom.llm.textops import LOWER, byte_texts, slices_by_bytes, words_by_document

#: Labelled rows that the model is fitted on, at most.
MOST_TRAINING = 12_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 24, 150, 40, 6, 0.15

NAMES = [
    "log_bytes", "upper", "digit", "blank", "symbol", "high", "bang", "pipe", "top_byte", "entropy", "log_words",
    "word_bytes", "distinct_words", "symbol_words", "short_words", "top_word", "log_lines", "line_words", "distinct_lines", "stops", "bracket",
]

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _DIGIT, _BLANK = slice(65, 91), slice(48, 58), [32, 9, 10, 11, 12, 13]
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-!?()" for b in range(256)])
_END_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()" for b in range(256)])


def features(texts: list[bytes]) -> np.ndarray:
    """One row of NAMES for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    lowered, bounds = words_by_document([t.translate(LOWER) for t in texts])
    for row, text in enumerate(texts):
        n = len(text)
        if not n:
            continue
        a = np.frombuffer(text, np.uint8)
        c = np.bincount(a, minlength=256)
        share = c / n
        used = share[share > 0]
        letters = max(1, c[_LETTERS].sum())
        words = lowered[bounds[row] : bounds[row + 1]]
        w = max(1, len(words))
        counts = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1)
        blank = np.isin(a, _BLANK)
        edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        starts, ends = edges[0::2], edges[1::2]
        lines = text.split(b"\n")
        out[row] = (
            math.log1p(n), c[_UPPER].sum() / letters, c[_DIGIT].sum() / n, share[_BLANK].sum(), share[_SYMBOL].sum(), share[128:].sum(), share[33], share[124],
            share.max(), -(used * np.log2(used)).sum(), math.log1p(len(words)), (ends - starts).mean() if len(starts) else 0.0, len(counts) / w,
            _END_SYMBOL[a[ends - 1]].mean() if len(ends) else 0.0, (ends - starts <= 2).mean() if len(starts) else 0.0, counts.max() / w,
            math.log1p(len(lines)), w / len(lines), len(set(lines)) / len(lines), share[46], share[60] + share[62] + share[123] + share[125],
        )
    return out


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4, ridge: float = 2.0, least: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins: per bin the Newton step of its leaf."""
    cuts = [0, len(gradient)]
    cg, cw = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    value = lambda g, w: g * g / (w + ridge)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for s, e in zip(cuts, cuts[1:]):
            if e - s < 2:
                continue
            k = np.arange(s + 1, e)
            gl, wl, g, w = cg[k] - cg[s], cw[k] - cw[s], cg[e] - cg[s], cw[e] - cw[s]
            gain = value(gl, wl) + value(g - gl, w - wl) - value(g, w)
            gain[(wl < least) | (w - wl < least)] = -1
            i = int(gain.argmax())
            best = max(best, (float(gain[i]), int(k[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for s, e in zip(cuts, cuts[1:]):
        out[s:e] = (cg[e] - cg[s]) / (cw[e] - cw[s] + ridge)
    return out


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)  # tables over coarse bins

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            total += table[b[:, i]]
        for i, j, table in self.pairs:
            total += table[b[:, i] // 3, b[:, j] // 3]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_tables(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return AdditiveModel(float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))))
    base = y.mean()
    model = AdditiveModel(float(np.log(base / (1 - base))))
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for i, size in enumerate(sizes):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(b[:, i], y - p, size), np.bincount(b[:, i], p * (1 - p), size))
            model.tables[i] += step
            total += step[b[:, i]]
    p = 1 / (1 + np.exp(-total))
    coarse = b // 3
    width = [s // 3 + 1 for s in sizes]
    gains = []
    for i in range(len(sizes)):
        for j in range(i):
            at = coarse[:, i] * width[j] + coarse[:, j]
            g, w = np.bincount(at, y - p, width[i] * width[j]), np.bincount(at, p * (1 - p), width[i] * width[j])
            gains.append((float((g * g / (w + 2)).sum()), i, j))
    chosen = sorted(gains, reverse=True)[:PAIRS]
    tables = {(i, j): np.zeros((width[i], width[j])) for _, i, j in chosen}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in tables.items():
            p = 1 / (1 + np.exp(-total))
            at = coarse[:, i] * width[j] + coarse[:, j]
            g, w = np.bincount(at, y - p, table.size), np.bincount(at, p * (1 - p), table.size)
            order = np.argsort(g / (w + 2), kind="stable")  # a tree over the cells, ordered by what they ask for
            step = np.zeros(table.size)
            step[order] = RATE * _tree(g[order], w[order], leaves=4, ridge=4.0)
            table += step.reshape(table.shape)
            total += step[at]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def _with_features(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text binary, y) -> doc_id, x (packed doubles), y"""

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 1 << 20):
            x = features(byte_texts(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], names=["doc_id", "x", "y"])

    return rows.mapInArrow(run, "doc_id long, x binary, y int")


def fit(docs: DataFrame, labels: DataFrame, trainable, id_col="doc_id", text_col="text", most: int = MOST_TRAINING) -> AdditiveModel:
    """Learn from the labelled rows whose id satisfies ``trainable`` (a condition on ``doc_id``)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(trainable & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if not n:
        return fit_tables(np.zeros((0, len(NAMES))), np.zeros(0))
    picked = known.where(hash62(F.col("doc_id"), F.lit("quality")) < F.lit(share_of_hashes(most, n)))
    # some 12,000 pairs of integers: small whatever the table's size, so every executor may have them
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    got = _with_features(source.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float64).reshape(-1, len(NAMES))
    y = np.array(got.column("y").to_pylist(), np.float64)
    order = np.lexsort([*x.T, np.array(got.column("doc_id").to_pylist(), np.int64)]) if len(x) else np.zeros(0, int)
    return fit_tables(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, id_col="doc_id", text_col="text") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 1 << 20):
            s = held.value.score(features(byte_texts(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels, remainder("doc_id", 3) != 1))
    return out.select("doc_id", held_out_rows("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score says label 0 go."""
    held = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True)))
    at = docs.schema.names.index("text")

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 1 << 20):
            x = features([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(held.value.score(x) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

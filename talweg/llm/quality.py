"""Quality classifier: a generalised additive model with pairwise interactions (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import BLANKS, table, text_bytes
from talweg.llm.rules import SYMBOLS, lines_of, repeat_words

FEATURES = ("words", "word_length", "symbols", "upper", "digits", "repeated_lines", "repeated_words", "line_words", "sentence_lines", "distinct_words", "bars", "marks", "long_words", "punctuation")
#: Labelled rows that the fit takes at most, first by the hash of doc_id.
FIT_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 60, 6, 0.15, 2.0
THRESHOLD = 0.3


def features(raw: bytes) -> list[float]:
    """Numbers of one text, from its bytes only; all 0 for a text without words."""
    words, text = raw.split(), raw.decode("utf-8", "replace")
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes, _, _, dup = lines_of(text)
    size = max(1, len(raw) - sum(raw.count(b) for b in BLANKS))
    letters = raw.translate(None, BLANKS)
    upper = sum(map(str.isupper, text))
    return [
        float(n), size / n, (len(letters) - len(letters.translate(None, SYMBOLS))) / n, upper / size,
        (len(letters) - len(letters.translate(None, b"0123456789"))) / size, dup / len(codes), repeat_words(words) / n,
        n / len(codes), sum(c >> 5 & 1 for c in codes) / len(codes), len(set(words)) / n, raw.count(b"|") / n, raw.count(b"!!") / n,
        sum(len(w) > 12 for w in words) / n, (len(letters) - len(letters.translate(None, b".,;:!?"))) / n,
    ]


@dataclass
class Gam:
    """Bin edges and a table of scores for each feature and for each chosen pair (coarse bins)."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: one table look-up and addition for each feature and pair."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, f] * COARSE // BINS, b[:, g] * COARSE // BINS]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of ordered bins by the gain of two leaves over one; cut 0 if none gains."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    left = cg[:-1] ** 2 / (ch[:-1] + RIDGE) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE)
    if not len(left):
        return 0.0, 0
    k = int(left.argmax())
    gain = left[k] - cg[-1] ** 2 / (ch[-1] + RIDGE)
    return (float(gain), k + 1) if gain > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each ordered bin of a regression tree of at most ``depth`` levels."""
    gain, cut = _split(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Two-level tree over a grid: the better first axis, then a cut of the other axis on each side; with its gain."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            values, total = np.zeros_like(a), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs = a[side].sum(0), b[side].sum(0)
                gain, k = _split(gs, hs)
                for part in (slice(0, k), slice(k, None)) if gain else (slice(None),):
                    v = gs[part].sum() / (hs[part].sum() + RIDGE)
                    values[side, part] = v
                    total += v * gs[part].sum()
            if total > best:
                best, out = total, values.T if flip else values
    return out, best


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    """Cyclic boosting of the log loss: each round gives every feature in turn one small step of a shallow tree.

    Then the pairs whose two-level tree gains most on what is left are boosted in turn the same way.
    No rows: a constant of one half; rows of one label: their smoothed share.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    b, z = model.bins(x), np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)))
            t += step
            z += step[b[:, f]]
    small = b * COARSE // BINS

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(small[:, f] * COARSE + small[:, k], v, COARSE * COARSE).reshape(COARSE, COARSE)

    g, h = slopes()
    ranked = sorted(combinations(range(len(FEATURES)), 2), key=lambda p: -pair_tree(grid(*p, g), grid(*p, h))[1])
    model.pairs = ranked[:pairs]
    model.pair_tables = [np.zeros((COARSE, COARSE)) for _ in model.pairs]
    for _ in range(rounds // 2):
        for (f, k), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * pair_tree(grid(f, k, g), grid(f, k, h))[0]
            t += step
            z += step[small[:, f], small[:, k]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["quality", "x"])


def _score(batches: Iterator[pa.RecordBatch], model: Gam, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
        p = model.score(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from the fit: crc32 of its id as text leaves 0 by 5; a null id always is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Gam:
    """Fit on at most ``rows`` labelled documents that aren't held out, the first by hash of doc_id.

    Rows with a null id or label are left out; of several labels of an id the largest holds.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a bounded side
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = found.select(F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    got = sorted((tuple(r["x"]), r["quality"]) for r in found.mapInArrow(_features, "quality int, x array<double>").collect())
    return fit_gam(np.array([x for x, _ in got], float).reshape(-1, len(FEATURES)), np.array([q for _, q in got], float))


def score_documents(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document, by its text alone.

    A null text scores as an empty one, whose features are all 0. Repeated rows score alike; a null
    doc_id is kept; other columns are not read.
    """
    src = text_bytes(docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(partial(_score, model=model, threshold=threshold), f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))

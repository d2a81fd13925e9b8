"""Quality rules: a linear-chain CRF labels each line as content or boilerplate (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import BLANKS, ship, table, text_bytes

SYMBOLS = b"#*$%&|<>"
ENDS = tuple(".!?:;…\"'”»)")
#: Binary features of a line; a line's code has one bit for each.
FEATURES = ("bias", "one_word", "few_words", "some_words", "many_words", "sentence_end", "symbols_dense", "symbols_some", "all_upper", "repeat_of_earlier", "bars", "digits", "long_words", "short_words", "few_distinct", "doubled_marks")
#: Labelled rows that the fit takes at most, first by the hash of doc_id.
FIT_ROWS = 2000
#: Lines of one training sequence; longer documents give several.
FIT_LINES = 64
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 20, 30, 0.5


@dataclass
class LineCrf:
    """Two labels, 0 boilerplate and 1 content: unary weights of label 1, transitions, start."""

    w: np.ndarray = field(default_factory=lambda: np.array([1.0, -0.5, 0.0, 0.3, 0.8, 0.8, -4.0, -0.3, -4.0, -3.0, -3.0, -1.0, -1.0, 0.0, -1.0, -3.0]))
    t: np.ndarray = field(default_factory=lambda: np.array([[0.6, -0.6], [-0.6, 0.6]]))
    s: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def unary(self, codes: np.ndarray) -> np.ndarray:
        return ((codes[:, None] >> np.arange(len(FEATURES))) & 1) @ self.w

    def viterbi(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of sequences that lie one after another in ``codes``; ties go to content."""
        out = np.zeros(len(codes), np.int8)
        if not len(codes):
            return out
        u, starts = self.unary(codes), np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        n, at = lengths[order], starts[order]
        active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # sequences with more than k lines
        back, last = np.zeros((len(codes), 2), np.int8), np.zeros((len(n), 2))
        last[:, 0], last[:, 1] = self.s
        k = active[0]
        last[:k, 1] += u[at[:k]]
        for pos in range(1, n[0]):
            k = active[pos]
            come = last[:k, :, None] + self.t[None]
            best = (come[:, 1] >= come[:, 0]).astype(np.int8)
            back[at[:k] + pos] = best
            last[:k] = np.maximum(come[:, 0], come[:, 1])
            last[:k, 1] += u[at[:k] + pos]
        state = (last[:, 1] >= last[:, 0]).astype(np.int8)
        for pos in range(n[0] - 1, -1, -1):
            k = active[pos]
            out[at[:k] + pos] = state[:k]
            if pos:
                state[:k] = back[at[:k] + pos, state[:k]]
        return out


def fit_crf(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 80, rate: float = 0.15, l2: float = 1e-3) -> LineCrf:
    """Maximum likelihood by Adam over whole-batch gradients (forward-backward in log space).

    ``sequences`` holds line codes and labels. With no sequences, or one label only, the fixed
    default weights are returned.
    """
    model = LineCrf()
    parts = [(c[i : i + FIT_LINES], y[i : i + FIT_LINES]) for c, y in sequences for i in range(0, len(c), FIT_LINES)]
    if not parts or len(np.unique(np.concatenate([y for _, y in parts]))) < 2:
        return model
    parts.sort(key=lambda p: -len(p[0]))
    rows, width = len(parts), len(parts[0][0])
    x, y, live = np.zeros((rows, width, len(FEATURES))), np.zeros((rows, width), np.int64), np.zeros((rows, width), bool)
    for r, (c, lab) in enumerate(parts):
        x[r, : len(c)] = (c[:, None] >> np.arange(len(FEATURES))) & 1
        y[r, : len(c)], live[r, : len(c)] = lab, True
    pair = live[:, 1:] & live[:, :-1]
    seen_t = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    seen_w, seen_s = np.einsum("rlf,rl->f", x, y * live), np.bincount(y[:, 0], minlength=2).astype(float)
    theta = np.zeros(len(FEATURES) + 6)
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), live.sum()
    for step in range(1, steps + 1):
        w, t, s = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        u = np.stack([np.zeros((rows, width)), x @ w], axis=2)
        fwd, bwd = np.zeros((rows, width, 2)), np.zeros((rows, width, 2))
        fwd[:, 0] = u[:, 0] + s
        for k in range(1, width):
            fwd[:, k] = np.logaddexp(fwd[:, k - 1, :1] + t[0], fwd[:, k - 1, 1:] + t[1]) + u[:, k]
        for k in range(width - 2, -1, -1):
            nxt = u[:, k + 1] + bwd[:, k + 1]
            new = np.logaddexp(t[:, 0][None] + nxt[:, :1], t[:, 1][None] + nxt[:, 1:])
            bwd[:, k] = np.where(live[:, k + 1, None], new, 0.0)
        z = np.logaddexp(*np.moveaxis(fwd[:, 0] + bwd[:, 0], 1, 0))
        node = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
        edge = np.exp(fwd[:, :-1, :, None] + t[None, None] + (u + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        grad = np.concatenate([seen_w - np.einsum("rlf,rl->f", x, node[:, :, 1]), (seen_t - edge.sum((0, 1))).ravel(), seen_s - node[:, 0].sum(0)]) / total - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineCrf(theta[:-6].copy(), theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())


def line_code(line: str, words: list[str], repeated: bool) -> int:
    """Feature bits of one line with at least one word."""
    n, code, size = len(words), 1, len(line)
    code |= 2 if n == 1 else 4 if n < 5 else 8 if n < 13 else 16
    if words[-1].endswith(ENDS):
        code |= 32
    marks = sum(map(line.count, "#*$%&|<>"))
    if marks:
        code |= 64 if 10 * marks >= 3 * n else 128
    if line.isupper() and n > 1:
        code |= 256
    if repeated:
        code |= 512
    if line.count("|") >= 2:
        code |= 1024
    if 5 * sum(map(line.count, "0123456789")) >= size:
        code |= 2048
    mean = (size - n + 1) / n
    if mean > 10:
        code |= 4096
    elif mean < 3:
        code |= 8192
    if n >= 8 and 2 * len(set(words)) < n:
        code |= 16384
    if line.count("!!") >= 2:
        code |= 32768
    return code


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words inside ``window``-word windows (a power of two) that the text has twice or more; exact, by doubling ranks."""
    n = len(words)
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if n <= window or len(ids) == n:
        return 0
    rank, span = np.fromiter(map(ids.__getitem__, words), np.int64, n), 1
    while span < window:
        pairs = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        distinct, rank = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        span *= 2
    hit = np.bincount(rank)[rank] >= 2
    edge = np.zeros(n + 1, np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    return int((np.cumsum(edge)[:n] > 0).sum())


def lines_of(text: str) -> tuple[list[int], list[int], list[int], int]:
    """Codes, places among the \\n-split lines, and word characters of the lines with a word, and how many repeat an earlier one."""
    codes, places, sizes, seen, dup = [], [], [], set(), 0
    for k, line in enumerate(text.split("\n")):
        words = line.encode().split()  # bytes split at ASCII blanks only
        if words:
            repeated = line in seen
            dup += repeated
            seen.add(line)
            codes.append(line_code(line, [w.decode() for w in words], repeated))
            places.append(k)
            sizes.append(sum(map(len, words)))
    return codes, places, sizes, dup


def _judge(batches: Iterator[pa.RecordBatch], model: LineCrf, min_content: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, codes, sizes, places = [], [], [], []
        for raw in batch.column(1).to_pylist():
            words, text = raw.split(), raw.decode("utf-8", "replace")
            c, p, z, dup = lines_of(text)
            n, blanks = len(words), len(raw) - len(raw.translate(None, BLANKS))
            rows.append((n, len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat_words(words), len(c)))
            codes += c
            sizes += z
            places += p
        cols = [np.array(x, np.int64) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 6
        n, chars, symbols, dup, rep, lines = cols
        label = model.viterbi(np.array(codes, np.int64), lines)
        ends, sizes = np.cumsum(lines), np.array(sizes, np.float64)
        total, good = (np.concatenate([[0.0], np.cumsum(a)]) for a in (sizes, sizes * label))
        count = np.concatenate([[0], np.cumsum(label, dtype=np.int64)])
        share = (good[ends] - good[ends - lines]) / np.maximum(total[ends] - total[ends - lines], 1)
        failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
        flat, where = label.tolist(), list(places)
        spans = [[q for q, b in zip(where[e - k : e], flat[e - k : e], strict=True) if not b] for e, k in zip(ends.tolist(), lines.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, chars, symbols, dup, rep, failed, ~failed & (share >= min_content), lines, count[ends] - count[ends - lines], share)), pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share", "boilerplate_lines"])


def judge(docs: DataFrame, model: LineCrf, min_content: float = MIN_CONTENT) -> DataFrame:
    """One row per document: base counts, verdict, and the numbers of the \\n-split lines marked boilerplate.

    ``kept`` needs both: the base rules don't fail it, and lines decoded as content hold at least
    ``min_content`` of the bytes of its words. A null or empty text has no words, so it
    fails the base rules. Lines without a word take no part. Repeated rows are judged alike,
    each on its own; a null doc_id is kept as null. Other columns are not read.
    """
    src = text_bytes(docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_judge, model=model, min_content=min_content), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double, boilerplate_lines array<int>")


def _keep(batches: Iterator[pa.RecordBatch], at: int, model: LineCrf, min_content: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(at).cast(pa.large_binary()).fill_null(b"")
        pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), text], ["doc_id", "text"])
        for judged in _judge(iter([pair]), model, min_content):
            yield batch.filter(judged.column(7))


def keep_good(docs: DataFrame, model: LineCrf, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    ship(docs.sparkSession)
    return docs.mapInArrow(partial(_keep, at=docs.columns.index("text"), model=model, min_content=min_content), docs.schema)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([lines_of(t.decode("utf-8", "replace"))[0] for t in batch.column(1).to_pylist()], pa.list_(pa.int32())), batch.column(0)], ["codes", "quality"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> LineCrf:
    """Fit the CRF on at most ``rows`` labelled documents, the first by hash of doc_id.

    The labels are weak: every line of a document of quality 1 counts as content and of quality 0
    as boilerplate, but lines that repeat an earlier line always count as boilerplate.
    Rows with a null id or label are left out; of several labels the largest holds.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a bounded side
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    got = found.mapInArrow(_codes, "codes array<int>, quality int").collect()
    seqs = []
    for codes, quality in sorted((r["codes"], r["quality"]) for r in got):
        c = np.array(codes, np.int64)
        seqs.append((c, np.where((c & 512) > 0, 0, quality)))
    return fit_crf(seqs)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).drop("boilerplate_lines")

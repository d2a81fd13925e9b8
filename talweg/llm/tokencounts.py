"""Token counts by section: whole texts are encoded once and token spans attributed (operator 2)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import one_thread, ship, table

RULES = ("majority", "start")


@lru_cache(2)
def _encoding(path: str):
    """Byte-pair encoder of a rank file and the byte length of each id."""
    one_thread()
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("talweg", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token by its character span, and which tokens cross a bound.

    ``bounds`` are the sections' first characters, ascending from 0; sections tile the text. A
    token inside one section belongs to it. One that crosses goes, by "start", to the section
    of its first character; by "majority", to the one that holds most of its characters, the
    earliest of equals.
    """
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1
    crossing = first != last
    if rule == "majority":
        for t in np.flatnonzero(crossing).tolist():
            edges = np.concatenate([[starts[t]], bounds[first[t] + 1 : last[t] + 1], [ends[t]]])
            first[t] += int(np.diff(edges).argmax())
    return first, crossing


def line_bounds(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First characters of the lines of a text, each with its line feed; ``at`` is each byte's character."""
    after = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], at[after[after < len(raw)]]])


def whole(parts: list[bytes | None]) -> tuple[bytes, list[int]]:
    """One valid UTF-8 text of all parts and the first character of each; bytes that aren't UTF-8 become U+FFFD."""
    read = [(p or b"").decode("utf-8", "replace") for p in parts]
    firsts = np.cumsum([0, *map(len, read)])[:-1].tolist()
    return "".join(read).encode(), firsts


def _count(batches: Iterator[pa.RecordBatch], path: str, rule: str, by_line: bool) -> Iterator[pa.RecordBatch]:
    enc, sizes = _encoding(path)
    for batch in batches:
        rows = []
        for parts in batch.column(1).to_pylist():
            text, firsts = whole(parts)
            ids = np.asarray(enc.encode_to_numpy(text.decode(), disallowed_special=()))
            raw = np.frombuffer(text, np.uint8)
            if not len(raw):
                rows.append((0, 0, 0 if by_line else len(parts), 0, [] if by_line else [0] * len(parts)))
                continue
            at = np.cumsum((raw & 0xC0) != 0x80) - 1
            stop = np.cumsum(sizes[ids])
            starts, ends = at[stop - sizes[ids]], at[stop - 1] + 1  # tokens of part of a character span all of it
            bounds = line_bounds(raw, at) if by_line else np.array(firsts)
            section, crossing = attribute(starts, ends, bounds, rule)
            rows.append((int(at[-1]) + 1, len(ids), len(bounds), int(crossing.sum()), np.bincount(section, minlength=len(bounds))))
        chars, tokens, sections, crossed, each = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (chars, tokens, sections, crossed)), pa.array(each, pa.list_(pa.int32()))], ["doc_id", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_tokens"])


def count_tokens(docs: DataFrame, ranks: str, rule: str = "majority", fields: list[str] | None = None) -> DataFrame:
    """``doc_id, n_chars, n_tokens, n_sections, n_crossing, section_tokens`` of each document.

    Sections are the lines of ``text``, each with its line feed; or, where ``fields`` names columns, these
    columns' texts, which are encoded as one document, one after another with nothing between. The array
    has each section's tokens in order and sums to ``n_tokens``. A null or empty text has no sections and no
    tokens, a null or empty field has none of the tokens; bytes that aren't UTF-8 read as U+FFFD; a text of any length
    is one encoding; repeated rows are counted alike; a null doc_id is kept; an empty table gives no rows; other columns are
    not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    ship(docs.sparkSession)
    src = docs.select("doc_id", F.array(*(F.col(c).cast("string").cast("binary") for c in fields or ["text"])).alias("parts"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_count, path=ranks, rule=rule, by_line=not fields), f"doc_id {kind}, n_chars long, n_tokens long, n_sections long, n_crossing long, section_tokens array<int>")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count_tokens`` by line of every text of ``documents``."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

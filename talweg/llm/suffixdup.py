"""Repeated-passage removal by suffix buckets (operator 5).

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Windows of
that length are first bucketed by an anchor: the q-gram of least hash among those inside the
window. Equal windows have equal anchors, so a window can only repeat within its anchor's bucket,
and anchors seen once end the search for all their windows at once. What is left is settled by
bucket-pointer refinement over the distinct surroundings of each anchor.

Whole equal surroundings are told by two 64-bit hashes together, 128 bits: among n of them, two
that differ are taken for equal with odds of about n * n / 2^129, below 1e-15 for 10^11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import discard, free_name, materialize, release, ship, table, text_bytes

LENGTH, GRAM = 200, 64
#: Bytes that one pass hashes; longer runs of text are cut with an overlap of a window.
SEGMENT = 1 << 20
#: Windows of a block of crowded surroundings.
STEP = 8
#: Distinct surroundings of one anchor that a single task refines; anchors with more are settled by window counts.
BUCKET = 256
#: Surroundings that one refinement holds on average.
BIN = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)


@lru_cache(1)
def _codes() -> np.ndarray:
    return np.random.default_rng(20_000_003).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string of ``data`` (uint8, at most SEGMENT long)."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    powers = _powers(SEGMENT)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_codes()[data] * powers[:n], dtype=np.uint64)])
        h = (sums[k:] - sums[:-k]) * powers[SEGMENT - n + k : SEGMENT + 1][::-1][: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def anchors(h: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of ``length`` bytes, where its gram of least hash (``h``: those of all grams) starts; the first of equal ones."""
    span = length - gram + 1
    if len(h) < span:
        return np.zeros(0, np.int64)
    place = np.uint64((1 << 22) - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    return (key & place).astype(np.int64)


def runs(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of neighbouring windows with one anchor: first window, last window, anchor, hash of the anchor's gram."""
    for at in range(0, max(1, len(text) - length + 1), SEGMENT - length + 1):
        data = np.frombuffer(text, np.uint8, min(SEGMENT, len(text) - at), at)
        h = gram_hashes(data, gram)
        a = anchors(h, length, gram)
        if len(a):
            cut = np.flatnonzero(np.diff(a)) + 1
            first = np.concatenate([[0], cut])
            last = np.concatenate([cut, [len(a)]]) - 1
            yield first + at, last + at, a[first] + at, h[a[first]]


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int, only_grams: bool) -> Iterator[pa.RecordBatch]:
    """Documents are hashed together, a buffer at a time: windows across a border are dropped."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        owner, first, last, place, gh = [], [], [], [], []
        group, size = [], 0
        for k, t in enumerate([*texts, b""]):
            if group and (k == len(texts) or size + len(t) > SEGMENT):
                joined = texts[group[0]] if len(group) == 1 else b"".join([texts[g] for g in group])
                sizes = np.array([len(texts[g]) for g in group])
                starts = np.cumsum(sizes) - sizes
                for f, e, a, h in runs(joined, length, gram):
                    if len(group) > 1:
                        f, e, a, h = _within(f, e, a, h, starts, sizes, length)
                    o = np.searchsorted(starts, f, side="right") - 1
                    owner.append(np.array(group)[o])
                    gh.append(h.view(np.int64))
                    for out, x in ((first, f), (last, e), (place, a)):
                        out.append(x - starts[o])
                group, size = [], 0
            if k < len(texts) and len(t) >= length:
                group.append(k)
                size += len(t)
        if not owner:
            continue
        owner, first, last, place, gh = map(np.concatenate, (owner, first, last, place, gh))
        if only_grams:
            yield pa.RecordBatch.from_arrays([pa.array(gh)], ["gram"])
            continue
        digest = xxhash.xxh3_64_intdigest
        whole = np.array([digest(texts[o][f : e + length], 7) for o, f, e in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(gh), pa.array((whole ^ (place - first).astype(np.uint64) * _BASE).view(np.int64)), pa.array(first), pa.array((last - first).astype(np.int32)), pa.array((place - first).astype(np.int32))], ["doc_id", "text_hash", "gram", "around", "first", "more", "anchor"])


def _within(f, e, a, h, starts, sizes, length):
    """Cut runs at document borders: windows that reach past their document's end go."""
    o = np.searchsorted(starts, f, side="right") - 1
    o2 = np.searchsorted(starts, e, side="right") - 1
    fs, es, as_, hs = [], [], [], []
    for step in range(int((o2 - o).max(initial=0)) + 1):  # a run reaches into few documents, as each is at least a window long
        live = o + step <= o2
        d = (o + step)[live]
        lo = np.maximum(f[live], starts[d])
        hi = np.minimum(e[live], starts[d] + sizes[d] - length)
        ok = lo <= hi
        fs.append(lo[ok])
        es.append(hi[ok])
        as_.append(a[live][ok])
        hs.append(h[live][ok])
    return tuple(map(np.concatenate, (fs, es, as_, hs)))


def bucket_pointer_refine(data: np.ndarray, ends: np.ndarray, q: int = 8, depth: int = LENGTH) -> np.ndarray:
    """Suffix order of ``data`` as bucket pointers: equal pointers share at least ``depth`` bytes.

    ``ends[i]`` is where the string that holds place i ends; suffixes stop there. Initial buckets
    hold equal q-grams. A bucket known to share d bytes is refined by sorting its suffixes on
    the pointers of their places d further on; the new pointers are written at once and
    serve all buckets refined later, and a bucket gains the least depth of the pointers it was
    sorted on, so refined buckets let others leap. Pointers keep the suffixes' order.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64), np.zeros(q, np.uint64)])
    code, room = np.zeros(n, np.uint64), ends - np.arange(n)
    for k in range(q):  # q signs of 9 bits would pass 64: eight 8-bit signs, and the room breaks ties of short ones
        code = (code << np.uint64(8)) | padded[k : k + n]
    short = np.minimum(room, q)
    past = np.flatnonzero(short < q)  # what lies beyond a string's end counts as zeros
    beyond = (8 * (q - short[past])).astype(np.uint64)
    code[past] = code[past] >> beyond << beyond
    order = np.argsort(code)
    sorted_, by_room = code[order], np.diff(short[order]) != 0
    if (by_room & (sorted_[1:] == sorted_[:-1])).any():  # zero bytes in the text
        order = np.lexsort((short, code))
        sorted_, by_room = code[order], np.diff(short[order]) != 0
    new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | by_room])
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [n]]))
    pointer, known = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    pointer[order] = np.repeat(start + size - 1, size)
    known[:n] = short
    pointer[n], known[n] = -1, 1 << 30
    # suffixes shorter than q are told apart from all others of a bucket by their room; those of equal room and text stay together
    open_ = (np.repeat(size, size) > 1) & (room[order] >= q)
    todo = order[open_]
    while len(todo):
        left = []
        for part in _slices(todo, pointer):
            d = known[part]
            ahead = np.where(d < room[part], part + d, n)
            o = np.argsort(pointer[part] * (n + 1) + pointer[ahead] + 1)  # by both pointers in one key: a sort of two keys takes twice as long
            part, ahead, d = part[o], ahead[o], d[o]
            b, key = pointer[part], pointer[ahead]
            head = np.concatenate([[True], b[1:] != b[:-1]])
            sub = head | np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(sub)
            sizes = np.diff(np.concatenate([starts, [len(part)]]))
            heads = np.flatnonzero(head)
            in_bucket = np.diff(np.concatenate([heads, [len(part)]]))
            from_start = np.arange(len(part)) - np.repeat(heads, in_bucket)
            last = np.repeat(from_start[starts + sizes - 1], sizes)
            gain = np.repeat(np.minimum.reduceat(known[ahead], starts), sizes)
            pointer[part] = b - np.repeat(in_bucket, in_bucket) + 1 + last
            known[part] = np.minimum(d + gain, 1 << 29)
            more = (np.repeat(sizes, sizes) > 1) & (known[part] < depth)
            left.append(part[more])
        todo = np.concatenate(left)
    return pointer[:n]


def _slices(todo: np.ndarray, pointer: np.ndarray, most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Whole buckets, about ``most`` suffixes at a time, so that later slices see earlier slices' pointers."""
    todo = todo[np.argsort(pointer[todo], kind="stable")]
    cuts = np.flatnonzero(np.diff(pointer[todo])) + 1
    at = np.unique(cuts[np.searchsorted(cuts, np.arange(most, len(todo), most)).clip(max=len(cuts) - 1)]) if len(cuts) else []
    yield from (x for x in np.split(todo, at) if len(x))


def repeated_windows(strings: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes start at another place too, strings of count over 1 being there more than once."""
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.repeat(np.cumsum(sizes), sizes)
    pointer = bucket_pointer_refine(data, ends, depth=length)
    windows = np.flatnonzero(ends - np.arange(len(data)) >= length)
    order = windows[np.argsort(pointer[windows], kind="stable")]
    near = np.flatnonzero(pointer[order[1:]] == pointer[order[:-1]])
    code = np.concatenate([gram_hashes(data[i : i + SEGMENT], length) for i in range(0, max(1, len(data) - length + 1), SEGMENT - length + 1)])
    rest = np.flatnonzero((pointer[order[1:]] != pointer[order[:-1]]) & (code[order[1:]] == code[order[:-1]]))  # neighbours that differ after ``length`` bytes at the earliest
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    same = [near, *(c[(view[order[c]] == view[order[c + 1]]).all(axis=1)] for c in np.array_split(rest, len(rest) // 4096 + 1))]
    hit = np.zeros(len(data), bool)
    for c in same:
        hit[order[c]] = hit[order[c + 1]] = True
    hit |= np.repeat(np.asarray(counts) > 1, sizes)
    starts = np.cumsum(sizes) - sizes
    return [hit[s : s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def spans_of(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that hit windows cover, joined where they touch."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + length).tolist(), strict=True))


def _refine(pdf: pd.DataFrame, length: int, kind: str) -> pd.DataFrame:
    found = repeated_windows(list(pdf["bytes"]), pdf["n"].to_numpy(), length)
    out = [(d, t, f + s, f + e) for d, t, f, n, hit in zip(pdf["doc_id"], pdf["text_hash"], pdf["first"], pdf["n"], found, strict=True) if n == 1 for s, e in spans_of(hit, length)]
    return pd.DataFrame(out, columns=["doc_id", "text_hash", "s", "e"]).astype({"text_hash": "int64", "s": "int64", "e": "int64"})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, text and a list of runs -> one row for each run, with its bytes."""
    for batch in batches:
        owner, firsts, grams, counts, sizes, places, parts = [], [], [], [], [], [], []
        for k, (text, want) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            for r in want:
                owner.append(k)
                firsts.append(r["first"])
                grams.append(r["gram"])
                counts.append(r["n"])
                sizes.append(r["k"])
                places.append(r["anchor"])
                parts.append(text[r["first"] : r["end"]])
        take = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int64()) for x in (firsts, grams, counts, sizes, places)), pa.array(parts, pa.binary())], ["doc_id", "text_hash", "first", "gram", "n", "k", "anchor", "bytes"])


def _blocks(batches: Iterator[pa.RecordBatch], length: int, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Surroundings of crowded anchors, by blocks of windows aligned to the anchor.

    A block has the bytes of all its windows together and the core that every window of an aligned
    block holds, whichever of them the surroundings have.
    """
    for batch in batches:
        owner, first, core, union = [], [], [], []
        for k, (text, f, anchor) in enumerate(zip(*(batch.column(i).to_pylist() for i in (7, 2, 6)), strict=True)):
            m = len(text) - length + 1
            for block in range((anchor - m + 1) // step, anchor // step + 1):  # windows anchor - d for d of the block
                lo, hi = max(0, anchor - block * step - step + 1), min(m - 1, anchor - block * step)
                if lo <= hi:
                    owner.append(k)
                    first.append(f + lo)
                    union.append(text[lo : hi + length])
                    inner = anchor - block * step
                    core.append(text[max(inner, 0) : min(inner - step + 1 + length, len(text))])
        take = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int64()), batch.column(4).take(take), pa.array(core, pa.binary()), pa.array(union, pa.binary())], ["doc_id", "text_hash", "first", "n", "core", "union"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of a block whose core others share: a 128-bit hash of its bytes."""
    for batch in batches:
        hashes, owner, place = [], [], []
        for k, (b, f) in enumerate(zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for p in range(len(b) - length + 1):
                hashes.append(xxhash.xxh3_128_digest(b[p : p + length]))
                owner.append(k)
                place.append(f + p)
        take = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (0, 1, 3)), pa.array(place, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "text_hash", "m", "s", "window"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and spans -> what is left, and the spans joined."""
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            joined: list[list[int]] = []
            for s, e in sorted((r["s"], r["e"]) for r in spans or ()):
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(e, joined[-1][1])
                else:
                    joined.append([s, e])
            at, keep = 0, []
            for s, e in joined:
                keep.append(text[at:s])
                at = e
            kept = b"".join([*keep, text[at:]])
            rows.append((len(text), len(text) - len(kept), [{"s": s, "e": e} for s, e in joined], kept, hashlib.sha256(kept).hexdigest()))
        n, gone, spans, kept, sha = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])


def repeated_spans(src: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, bin_size: int = BIN) -> DataFrame:
    """``doc_id, text_hash, s, e``: byte ranges to remove of the documents ``src`` (``doc_id``, binary ``text``, ``text_hash``)."""
    spark = src.sparkSession
    kind = src.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {kind}, text_hash long, s long, e long"
    find = partial(_runs, length=length, gram=gram)
    seen = src.mapInArrow(partial(find, only_grams=True), "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    seen = materialize(seen, "seen")  # a table of its own, so that the join can split a hot gram
    release(spark)
    every = src.mapInArrow(partial(find, only_grams=False), f"doc_id {kind}, text_hash long, gram long, around long, first long, more int, anchor int")
    left = materialize(every.join(seen, "gram"), "runs")
    del every
    discard(seen)
    whole = materialize(left.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("first", "more", "anchor", "text_hash", "doc_id")).alias("one")), "around")
    again = left.join(whole.where("n > 1").select("gram", "around"), ["gram", "around"], "left_semi")
    spans = materialize(again.select("doc_id", "text_hash", F.col("first").alias("s"), (F.col("first") + F.col("more") + length).alias("e")), "spans")
    del again
    discard(left)
    crowd = materialize(whole.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "crowd")
    want = whole.join(crowd, "gram").select("gram", "n", "k", "one.*").withColumn("end", F.col("first") + F.col("more") + length)
    want = materialize(want.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "end", "gram", "n", "k", "anchor")).alias("want")), "want")
    discard(whole, crowd)
    # repeated rows have the same bytes: one of them serves
    found = src.join(want.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "text", "want")
    around = materialize(found.mapInArrow(_extract, f"doc_id {kind}, text_hash long, first long, gram long, n long, k long, anchor long, bytes binary").dropDuplicates(["doc_id", "text_hash", "first"]), "bytes")
    del found
    discard(want)
    small = around.where(F.col("k") <= bucket)
    bins = max(1, -(-small.count() // bin_size))
    small = small.withColumn("bin", F.pmod(F.xxhash64("gram"), F.lit(bins)))
    some = materialize(small.groupBy("bin").applyInPandas(partial(_refine, length=length, kind=kind), form), "spans")
    each = around.where(F.col("k") > bucket).mapInArrow(partial(_blocks, length=length), f"doc_id {kind}, text_hash long, first long, n long, core binary, union binary")
    each = materialize(each, "blocks")
    del small
    discard(around)
    alike = materialize(each.groupBy("union").agg(F.sum("n").alias("m"), F.min(F.struct("first", "text_hash", "doc_id", "core")).alias("one")), "alike")
    sure = materialize(each.where("n = 1").join(alike.where("m > 1").select("union"), "union", "left_semi").select("doc_id", "text_hash", F.col("first").alias("s"), (F.col("first") + F.length("union")).alias("e")), "spans")
    mixed = materialize(alike.groupBy(F.col("one.core").alias("core")).agg(F.count("*").alias("k")).where("k > 1").select("core"), "mixed")
    open_ = alike.select("one.*", "m", "union").join(mixed, "core", "left_semi").select("doc_id", "text_hash", "first", "m", "union")
    windows = materialize(open_.mapInArrow(partial(_windows, length=length), f"doc_id {kind}, text_hash long, m long, s long, window binary"), "windows")
    del open_
    discard(each, alike, mixed)
    twice = materialize(windows.groupBy("window").agg(F.sum("m").alias("all")).where("all > 1").select("window"), "twice")
    many = materialize(windows.where("m = 1").join(twice, "window", "left_semi").select("doc_id", "text_hash", "s", (F.col("s") + length).alias("e")), "spans")
    discard(windows, twice)
    return spans.unionByName(some).unionByName(sure).unionByName(many)


def spans_by_text(docs: DataFrame, length: int, gram: int, **sizes: int) -> DataFrame:
    """``d, h, spans``: the spans of each doc_id and hash of its text."""
    src = text_bytes(docs).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(src, length, gram, **sizes)
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})


def _replace(batches: Iterator[pa.RecordBatch], text_at: int, chars_at: int) -> Iterator[pa.RecordBatch]:
    """Rows with their spans last -> rows with the text that is left."""
    for batch in batches:
        text = batch.column(text_at)
        pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), text.cast(pa.large_binary()).fill_null(b""), batch.column(batch.num_columns - 1)], ["doc_id", "text", "spans"])
        for cut in _cut(iter([pair])):
            left = [None if was is None else b.decode("utf-8", "ignore") for b, was in zip(cut.column(4).to_pylist(), text.to_pylist(), strict=True)]
            cols = list(batch.columns[:-1])
            cols[text_at] = pa.array(left, batch.schema.field(text_at).type)
            if chars_at >= 0:
                cols[chars_at] = pa.array([None if t is None else len(t) for t in left], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **sizes: int) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (and ``n_chars`` set anew, if there).

    Characters that a cut at a byte leaves incomplete go too. Rows all stay, a null text as null.
    """
    ship(docs.sparkSession)
    per_doc = spans_by_text(docs, length, gram, **sizes)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_id"), F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))).alias("r_hash"))
    both = rows.join(per_doc, F.col("r_id").eqNullSafe(F.col("d")) & (F.col("r_hash") == F.col("h")), "left").select("row.*", F.col("spans").alias(free_name(docs, "cut")))
    cols = docs.columns
    return both.mapInArrow(partial(_replace, text_at=cols.index("text"), chars_at=cols.index("n_chars") if "n_chars" in cols else -1), docs.schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **sizes: int) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans, kept`` (binary) and ``kept_sha256``.

    All occurrences go, the first included; matches don't cross documents and are judged on the
    input. A null text counts as empty. Texts under ``length`` bytes lose nothing. Repeated rows are
    documents of their own, so each loses all windows. Other columns are not read. Documents are
    known by doc_id and a hash of the text, so ids may repeat or be null.
    """
    src = text_bytes(docs).withColumn("text_hash", F.xxhash64("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    per_doc = spans_by_text(docs, length, gram, **sizes)
    both = src.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary, kept_sha256 string")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP5_SQL = """
with t as (select row_number() over () as d, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select d, j, substr(h, 2 * j + 1, 910) as c from (select d, h, unnest(range(0, strlen(h) // 2, 256)) as j from t)),
g as (select d, j + o as i, md5_number(substr(c, 2 * o + 1, 400)) as g from (select d, j, c, unnest(range(0, greatest(strlen(c) // 2 - 199, 0))) as o from c)),
again as (select g from g group by g having count(*) > 1),
s as (select d, i, case when i - lag(i) over (partition by d order by i) <= 200 then 0 else 1 end as starts from g semi join again using (g)),
n as (select d, i, sum(starts) over (partition by d order by i) as k from s),
r as (select d, min(i) as s, max(i) + 200 as e from n group by d, k),
b as (select d, s, e, coalesce(lag(e) over (partition by d order by s), 0) as before from r),
p as (
  select d, count(*) as n_spans, sum(e - s) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by s) || substr(any_value(h), 2 * max(e) + 1) as kept
  from b join t using (d) group by d)
select doc_id, cast(strlen(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from t left join p using (d)
"""

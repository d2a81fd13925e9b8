"""Best-fit packing with bound-certified repacking (operator 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import free_name, materialize, table, text_bytes
from talweg.llm.wordbpe import encoder

#: Items that one bucket holds at most on average; the number of buckets grows with the input.
BUCKET_ITEMS = 16_384
CAPACITY = 2048


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Bins that any packing of ``sizes`` (1 to ``capacity``, each ``counts`` times) needs, by dual feasible functions.

    The identity gives the volume bound; for each threshold t up to half the capacity, the
    function that rounds items over capacity - t up to a whole bin and those under t down to
    nothing gives one more. The largest is returned; 0 for no items.
    """
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, np.asarray(sizes, dtype=np.int64), 1 if counts is None else np.asarray(counts, dtype=np.int64))
    s = np.arange(capacity + 1)
    volume = np.concatenate([[0], np.cumsum(hist * s)])  # of items below a size
    number = np.concatenate([[0], np.cumsum(hist)])
    t = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - t + 1]
    middle = volume[capacity - t + 1] - volume[t]
    return int(max(big + -(-middle // capacity)))


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Largest first (ties in the given order), each into the fullest bin that takes it.

    An integer's bits say which amounts of free room occur, so the tightest is one bit trick away.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, new = 0, count()
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        if fitting := mask >> n:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, next(new)
        bins[i], offsets[i] = b, capacity - room
        if left := room - n:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: bytes) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        owner, piece, start, length, crc = [], [], [], [], []
        for k, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
            ids += end
            n, size = len(ids) // 4, capacity * 4
            for j, at in enumerate(range(0, len(ids), size)):
                owner.append(k)
                piece.append(j)
                start.append(j * capacity)
                length.append(min(capacity, n - j * capacity))
                crc.append(zlib.crc32(ids[at : at + size]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32``: each document's ids, ``end_id`` last, in pieces of ``capacity``.

    A null or empty text is the one id ``end_id``; bytes that aren't UTF-8 read as U+FFFD. Repeated rows give repeated pieces; a null
    doc_id is kept. Columns other than doc_id and text are not read.
    """
    src = text_bytes(docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_cut, path=tokenizer, capacity=capacity, end=np.uint32(end_id).tobytes()), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _pack_bucket(pdf: pd.DataFrame, capacity: int, base: int, names: tuple[str, ...]) -> pd.DataFrame:
    uid, bucket, fill, gap = names
    pdf = pdf.sort_values(uid, ignore_index=True)
    sizes = pdf["length"].to_numpy()
    bins, offsets = best_fit_decreasing(sizes, capacity)
    full = np.bincount(bins, weights=sizes).astype(np.int64)
    pdf["sequence_id"] = base + (pdf[bucket].to_numpy().astype(np.int64) << 24) + bins
    pdf["offset"] = offsets
    pdf[fill] = full[bins]
    pdf[gap] = len(full) - lower_bound(sizes, capacity)
    return pdf


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """Place rows with a ``length`` (1 to ``capacity``) in sequences: adds ``sequence_id`` and ``offset``.

    Buckets of about ``bucket_items`` rows, dealt by a row number, are packed by best-fit
    decreasing, and a dual-feasible-function bound certifies each bucket's number of bins. A bucket
    that meets its bound keeps its bins, as do full bins. What lies in the other bins of buckets with a gap
    is exchanged: pooled, dealt anew to fewer buckets and packed again. That goes on until no
    bucket has a gap, the pool's own bound is met, or an exchange saves no bin: then the bins
    before it stand. ``certificate`` tells the gap left over all. Sequences are filled from offset 0
    without holes. An empty input gives no rows. Row order and repeated rows don't matter: each row is one
    item. Columns of the input stay, whatever their names, but for ``sequence_id`` and ``offset``, which are set anew.
    """
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = pieces.select(*own)
    names = uid, bucket, fill, gap = tuple(free_name(pieces, n) for n in ("uid", "bucket", "fill", "gap"))
    pool = materialize(pieces.withColumn(uid, F.monotonically_increasing_id()), "pieces")
    schema = pool.withColumn(bucket, F.lit(0)).schema.simpleString()[7:-1] + f",sequence_id:bigint,offset:bigint,{fill}:bigint,{gap}:bigint"
    closed: list[DataFrame] = []
    last, last_bins, base, n = None, 0, 0, pool.count()
    while n:
        buckets = -(-n // bucket_items)
        dealt = pool.withColumn(bucket, F.pmod(F.xxhash64(uid, F.lit(base)), F.lit(buckets)).cast("int"))
        packed = materialize(dealt.groupBy(bucket).applyInPandas(partial(_pack_bucket, capacity=capacity, base=base, names=names), schema), "packed")
        base += buckets << 24
        part = F.col("length") / F.col(fill)  # the parts of a bin's items add up to one
        free = (F.col(gap) > 0) & (F.col(fill) < capacity)
        bins, open_bins, n = packed.agg(F.sum(part), F.coalesce(F.sum(F.when(free, part)), F.lit(0)), F.count(F.when(free, 1))).first()
        if last is not None and round(bins) >= last_bins:
            closed.append(last)
            break
        hist = packed.where(free).groupBy("length").count().collect()  # at most ``capacity`` rows
        bound = lower_bound([r["length"] for r in hist], capacity, [r["count"] for r in hist])
        if buckets == 1 or round(open_bins) <= bound:  # one bucket has nothing to exchange with
            closed.append(packed)
            break
        closed.append(packed.where(~free))
        last, last_bins = packed.where(free), round(open_bins)
        pool = last.select(*own, uid)
    out = closed[0] if closed else pool.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(*own, "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row ``sequences, bound, gap`` of a packing: how many sequences it has over what any packing of its lengths needs."""
    hist = packed.groupBy("length").count().collect()  # at most ``capacity`` rows
    bound = lower_bound([r["length"] for r in hist], capacity, [r["count"] for r in hist])
    return packed.agg(F.countDistinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Documents as pieces in sequences of at most ``capacity`` tokens."""
    return pack(cut_pieces(docs, tokenizer, capacity, end_id), capacity)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())

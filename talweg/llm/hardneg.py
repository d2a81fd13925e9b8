"""Hard-negative mining: k-means inverted lists with stored radii, visited by Cauchy-Schwarz bounds (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.llm.common import materialize, release, ship, table

POSITIVES, NEGATIVES = 5, 10
#: Shares of the positive's score, in hundredths, that a negative's score must lie between.
LOW, HIGH = 30, 90
#: Rows that the centroids are fitted to at most, rounds of fitting, and centroids at most (they are sent to all tasks: 64 components of 8 bytes each, 32 MB).
FIT_ROWS, FIT_ROUNDS, MOST_LISTS = 32_768, 8, 65_536
#: Rows of a block on average: a list of more rows is held in several blocks, each with its own radius.
BLOCK = 2048
#: Anchors of one set, which goes to all blocks at once, and anchors whose scores with a block are held at a time.
SET, TOGETHER = 8192, 256
#: Lists an anchor visits before all others are judged by what these reached, and lists in a task's rounds after each of which floors rise.
FIRST, ROUNDS = 4, (4, 16)
SCALE = 256


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) as long, held to what a long can hold."""
    return np.clip(np.floor(SCALE * values.astype(float)), -(2.0**62), 2.0**62).astype(np.int64)


def _clean(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows of key, id, label, vector -> the vector's whole numbers, padded to ``dim``; rows with null or non-finite components are left out."""
    for batch in batches:
        flat, size = batch.column(3).flatten(), np.asarray(batch.column(3).value_lengths())
        x = np.nan_to_num(np.asarray(flat.to_numpy(zero_copy_only=False), float), nan=np.nan, posinf=np.inf, neginf=-np.inf)
        row, at = np.repeat(np.arange(len(size)), size), np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
        ok = np.ones(len(size), bool)
        ok[row[~np.isfinite(x)]] = False
        z = np.zeros((len(size), dim), np.int64)
        z[row, at] = _whole(np.where(np.isfinite(x), x, 0))
        packed = [z[i].tobytes() if keep else None for i, keep in enumerate(ok.tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(packed, pa.binary())], ["key", "id", "label", "z"]).filter(pa.array(ok))


def fit(sample: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """``k`` centroids of the sample's rows by Lloyd's rounds from rows spread over it; lists that lose all rows keep their centroid."""
    x = sample.astype(float)
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        n = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centroid, a few rows at a time."""
    half = (centroids**2).sum(axis=1) / 2
    step = max(1, 4_000_000 // max(1, len(centroids)))
    return np.concatenate([np.argmin(half - x[i : i + step] @ centroids.T, axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _assign(batches: Iterator[pa.RecordBatch], centroids: object) -> Iterator[pa.RecordBatch]:
    c = centroids.value
    for batch in batches:
        z = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(batch.num_rows, c.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(z.astype(float), c), pa.int64())], ["key", "id", "label", "z", "list"])


def _store(pdf: pd.DataFrame, centroids: object) -> pd.DataFrame:
    """One block of an inverted list as a row: keys, ids, labels and vectors by id, and the largest distance from the list's centroid."""
    pdf = pdf.sort_values(["id", "key"], ignore_index=True, na_position="last")
    z, k = np.frombuffer(b"".join(pdf["z"]), np.int64).reshape(len(pdf), -1), int(pdf["list"].iloc[0])
    far = math.sqrt(float(((z - centroids.value[k]) ** 2).sum(axis=1).max()))
    ids = [None if pd.isna(i) else int(i) for i in pdf["id"]]
    small = z.astype(np.int16) if len(z) and np.abs(z).max() < 2**15 else z
    return pd.DataFrame({"list": [k], "radius": [far * (1 + 1e-9)], "keys": [pdf["key"].astype(np.int64).tolist()], "ids": [ids], "labels": [pdf["label"].astype(np.int64).tolist()], "wide": [small.dtype == np.int64], "blob": [small.tobytes()]})


def index(rows: DataFrame, dim: int, n: int, block: int = BLOCK, lists: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Blocks of the inverted lists of ``key, id, label, z``, the centroids, and each list's radius.

    Centroids are fitted to at most ``FIT_ROWS`` rows, the first by hash; every row is in a list. A
    list that holds a large share of all rows (copies of one vector) is dealt to blocks by hash.
    """
    spark = rows.sparkSession
    k = min(lists or max(1, math.isqrt(n)), MOST_LISTS)
    sample = rows.select("z", F.xxhash64("key").alias("h")).where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(max(1, n // (2 * FIT_ROWS)))) == 0).orderBy("h").limit(FIT_ROWS).toArrow()
    centroids = fit(np.frombuffer(b"".join(sample.column(0).to_pylist()), np.int64).reshape(sample.num_rows, dim), k)
    sent = spark.sparkContext.broadcast(centroids)
    placed = materialize(rows.mapInArrow(partial(_assign, centroids=sent), rows.select("key", "id", "label", "z").schema.add("list", "long")), "placed")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int"))
    form = "list long, radius double, keys array<long>, ids array<long>, labels array<long>, wide boolean, blob binary"

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        return _store(pdf, sent)

    blocks = materialize(dealt.groupBy("list", "part").applyInPandas(store, form), "lists")
    radius = np.full(len(centroids), -1.0)
    for r in blocks.groupBy("list").agg(F.max("radius").alias("radius")).collect():  # a row a list
        radius[r["list"]] = r["radius"]
    return blocks, centroids, radius


def products(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; in doubles while these hold them, else in Python's numbers, held to within 2^63 - 1."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(z).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(float) @ z.T.astype(float)).astype(np.int64)
    return np.clip(a.astype(object) @ z.T.astype(object), 1 - 2**63, 2**63 - 1).astype(np.int64)


@dataclass
class Asked:
    """One set of wants, grouped by anchor: anchors' vectors, keys and labels; each want's anchor, window of scores and floor, and whether the same label is wanted."""

    vectors: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    same: bool
    k: int
    centroids: np.ndarray
    radius: np.ndarray

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that a row of each list can have with each anchor, by Cauchy-Schwarz; empty lists have none."""
        a = self.vectors.astype(float)
        mid, reach = a @ self.centroids.T, np.linalg.norm(a, axis=1)[:, None] * np.maximum(self.radius, 0)[None]
        slack = 1e-6 + 1e-9 * (np.abs(mid) + reach)
        lower, upper = (np.clip(x, -(2.0**63), 2.0**63) for x in (mid - reach - slack, mid + reach + slack))  # as scores are
        return lower, np.where(self.radius[None] < 0, -np.inf, upper)


def _search(batches: Iterator[pa.RecordBatch], asked: object, first: bool) -> Iterator[pa.RecordBatch]:
    """The best rows for each want among the task's blocks.

    In the first wave an anchor visits the ``FIRST`` lists of highest bound whose scores may lie in its window, in the second
    the others, in order of their bounds and in rounds: lists that lie outside the window are skipped, and a
    want is done when the bound of its next list is strictly below its k-th score.
    """
    q: Asked = asked.value
    blocks: dict[int, list] = {}
    for batch in batches:
        for k, _, keys, ids, labels, wide, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            z = np.frombuffer(blob, np.int64 if wide else np.int16).reshape(len(keys), q.vectors.shape[1])
            blocks.setdefault(k, []).append((np.array(keys, np.int64), ids, np.array(labels, np.int64), z))
    here = np.array(sorted(blocks), np.int64)
    floor = q.floor.copy()
    least, none_last = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for start in range(0, len(q.vectors), TOGETHER):
        part = slice(start, min(start + TOGETHER, len(q.vectors)))
        wants = np.flatnonzero((q.anchor >= part.start) & (q.anchor < part.stop))
        if not len(wants) or not len(here):
            continue
        sub = Asked(q.vectors[part], q.keys[part], q.labels[part], q.anchor[wants] - start, q.low[wants], q.high[wants], floor[wants], q.same, q.k, q.centroids, q.radius)
        lower, upper = sub.bounds()
        able = (upper[sub.anchor] >= sub.low[:, None]) & (lower[sub.anchor] <= sub.high[:, None])  # lists that reach into the window
        reach = np.where(able, np.minimum(upper[sub.anchor], sub.high[:, None].astype(float)), -np.inf)
        order = np.argsort(-reach, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        mine = (place[:, here] < FIRST) == first
        reach = np.where(mine, reach[:, here], -np.inf)
        order = np.argsort(-reach, axis=1, kind="stable")
        done, best = 0, tuple(np.zeros(0, np.int64) for _ in range(4))  # want, score, id, key
        for size in (*ROUNDS, len(here)):
            now = np.zeros(reach.shape, bool)
            np.put_along_axis(now, order[:, done : done + size], True, axis=1)
            done += size
            now &= np.isfinite(reach) & (reach >= sub.floor[:, None])
            hits = [best]
            for j in np.flatnonzero(now.any(axis=0)).tolist():
                w = np.flatnonzero(now[:, j])
                rows, which = np.unique(sub.anchor[w], return_inverse=True)
                for keys, ids, labels, z in blocks[int(here[j])]:
                    score = products(sub.vectors[rows], z)
                    fits = (labels[None] == sub.labels[rows][:, None]) == q.same
                    fits &= keys[None] != sub.keys[rows][:, None]
                    s = score[which]
                    ok = fits[which] & (s >= np.maximum(sub.low, sub.floor)[w][:, None]) & (s <= sub.high[w][:, None])
                    if s.shape[1] > q.k:  # of a block's rows only the best can stay, and those that tie with them
                        ok &= s >= np.partition(np.where(ok, s, least), -q.k, axis=1)[:, -q.k][:, None]
                    a, b = np.nonzero(ok)
                    id_ = np.array([none_last if i is None else i for i in ids], np.int64)
                    hits.append((w[a], s[a, b], id_[b], keys[b]))
                    if sum(len(h[0]) for h in hits) > 500_000:
                        hits = [_best(hits, q.k, sub.floor)]
            best = _best(hits, q.k, sub.floor)
            if done >= len(here):
                break
        want, score, id_, key = best
        floor[wants] = sub.floor
        yield pa.RecordBatch.from_arrays([pa.array(wants[want]), pa.array(score), pa.array(id_, mask=id_ == none_last), pa.array(key)], ["want", "score", "id", "key"])


def _best(hits: list[tuple], k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first ``k`` hits of each want by score, then id, then key; raises the floors to the k-th scores."""
    want, score, id_, key = (np.concatenate([h[i] for h in hits]) for i in range(4))
    order = np.lexsort((key, id_, -score, want))
    want, score, id_, key = want[order], score[order], id_[order], key[order]
    head = np.flatnonzero(np.append(True, want[1:] != want[:-1])) if len(want) else np.zeros(0, np.int64)
    rank = np.arange(len(want)) - np.repeat(head, np.diff(np.append(head, len(want))))
    last = rank == k - 1
    floor[want[last]] = np.maximum(floor[want[last]], score[last])
    keep = rank < k
    return want[keep], score[keep], id_[keep], key[keep]


def _ranked(spark: SparkSession, blocks: DataFrame, asked: Asked) -> DataFrame:
    """``want, rank, score, id, key`` of the first rows for each want of one set, in two waves over the blocks."""
    order, found = Window.partitionBy("want").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key"), []
    for first in (True, False):
        sent = spark.sparkContext.broadcast(asked)
        hits = blocks.mapInArrow(partial(_search, asked=sent, first=first), "want long, score long, id long, key long")
        hits = materialize(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.k), "hits")
        sent.destroy()
        found.append(hits)
        if first:
            for r in hits.where(F.col("rank") == asked.k).select("want", "score").collect():  # a row a want of the set
                asked.floor[r["want"]] = max(asked.floor[r["want"]], r["score"])
    both = found[0].drop("rank").unionByName(found[1].drop("rank"))
    return materialize(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.k), "ranked")


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``id, label, vec`` that meet ``anchors``.

    Components become floor(256 x); a score is the inner product, exact. An anchor's
    positives are its first other rows of its label by score, then id; a positive's negatives the first rows of other
    labels whose score lies between ``low`` and ``high`` hundredths of the positive's. Rows with a null label or vector, or a
    null or non-finite component, take no part; missing components of shorter vectors are zero; null ids come
    last and are no anchors unless ``anchors`` says so. Rows that repeat an id are rows of their own, anchors
    each. Positives without negatives give no row, nor does an empty table. Products beyond a long are held to its range, less its least value. Other columns are not read.

    Anchors go to all blocks in sets of bounded size, so the work grows with the product of anchors and rows, less what the bounds spare.
    """
    spark = rows.sparkSession
    ship(spark)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    src = rows.select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor")).where("label is not null and vec is not null")
    src = materialize(src, "vectors")
    dim = src.agg(F.max(F.size("vec"))).first()[0]
    if not dim:
        return spark.createDataFrame([], out)
    clean = materialize(src.select("key", "id", "label", "vec").mapInArrow(partial(_clean, dim=dim), "key long, id long, label long, z binary"), "whole")
    n = clean.count()
    if not n:
        return spark.createDataFrame([], out)
    blocks, centroids, radius = index(clean, dim, n, block, lists)
    release(spark)
    marked = materialize(clean.join(src.where("anchor").select("key"), "key", "left_semi"), "anchors")
    sets, parts = -(-marked.count() // SET), []
    far = np.iinfo(np.int64)
    for s in range(sets):
        held = marked.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(sets)) == s).orderBy("key").toArrow()
        m = held.num_rows
        if not m:
            continue
        keys, ids, labels = (held.column(i).to_pylist() for i in range(3))
        vectors = np.frombuffer(b"".join(held.column(3).to_pylist()), np.int64).reshape(m, dim)
        common = (vectors, np.array(keys, np.int64), np.array(labels, np.int64))
        full = lambda size, v: np.full(size, v, np.int64)
        asked = Asked(*common, np.arange(m), full(m, far.min), full(m, far.max), full(m, far.min), True, positives, centroids, radius)
        near = [(r["want"], r["rank"], r["id"], r["score"]) for r in _ranked(spark, blocks, asked).collect()]  # at most 5 an anchor of the set
        near.sort(key=lambda r: r[:2])
        if not near:
            continue
        score = [r[3] for r in near]
        least, most = (np.array([-(-low * p // 100) if bound is min else high * p // 100 for p in score], np.int64) for bound in (min, max))
        asked = Asked(*common, np.array([r[0] for r in near], np.int64), least, most, least.copy(), False, negatives, centroids, radius)
        pairs = spark.createDataFrame([(k, ids[r[0]], r[2], r[3]) for k, r in enumerate(near)], "want long, anchor_id long, positive_id long, positive_score long")
        found = _ranked(spark, blocks, asked).join(pairs, "want")
        parts.append(materialize(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not parts:
        return spark.createDataFrame([], out)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors, with the labels of every seventh shifted."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vec")), F.col("id") % 100 == 0)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as z from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.z, b.z) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

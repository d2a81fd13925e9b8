"""Near-duplicate join: MinHash banding, pairs verified on full word n-gram sets (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import discard, materialize, release, table, text_bytes
from talweg.operators.graph import PART, components

WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.999, 320
#: Classes and n-grams of a block: larger groups are dealt to blocks, of which two meet where they share a bucket.
BLOCK, BLOCK_GRAMS = 512, 2_000_000
#: A pair whose signatures agree less than this is not verified: over five standard deviations below a true pair.
SLACK = 0.13


def bands_for(similarity: float, recall: float, most: int) -> tuple[int, int]:
    """Bands and rows: the most rows a band, so the fewest false candidates, for which ``most`` hashes reach the recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a text of fewer words has its words as the one gram, none has none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    codes = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * mix + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _sign(batches: Iterator[pa.RecordBatch], n: int, hashes: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(7_919)
    mul = rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, hashes, dtype=np.uint32)
    for batch in batches:
        keys, signs, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            grams = shingles(text, n)
            sizes.append(len(grams))
            if not len(grams):
                keys.append(None)
                signs.append(None)
                continue
            keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
            low, least = grams.astype(np.uint32), np.full(hashes, 2**32 - 1, np.uint32)
            for at in range(0, len(low), 1024):
                v = (low[at : at + 1024, None] ^ add) * mul
                v ^= v >> np.uint32(15)
                np.minimum(least, v.min(axis=0), out=least)
            signs.append((least & np.uint32(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "text_hash", "cid", "sign", "n_grams"])


class Forest:
    """Union-find that tells which links join two groups."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _meet(batches: Iterator[pa.RecordBatch], rows: int, least: float, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by meeting (i, j): class, block, signature, gram set, documents -> for each class how many documents it links to here, and the links that join groups.

    Two classes are compared if they agree in a band and well enough in all, and linked if their
    whole gram sets are similar enough.
    """
    held: list[tuple] = []
    now, out = None, []

    def compare() -> None:
        if len(held) < 2:
            return
        i, j, forest = now[0], now[1], Forest()
        block, docs = np.array([r[3] for r in held]), np.array([r[6] for r in held], np.int64)
        signs = np.frombuffer(b"".join([r[4] for r in held]), np.uint8).reshape(len(held), -1)
        sets = [np.frombuffer(r[5], np.uint64) for r in held]
        others = np.zeros(len(held), np.int64)
        for k in range(len(held) - 1):
            near = np.arange(k + 1, len(held))
            if i != j:
                near = near[block[near] != block[k]]
            same = signs[near] == signs[k]
            ok = same.mean(axis=1) >= least
            near, same = near[ok], same[ok]
            for n in near[same.reshape(len(near), signs.shape[1] // rows, rows).all(axis=2).any(axis=1)].tolist():
                x, y = sets[k], sets[n]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    others[k] += docs[n]
                    others[n] += docs[k]
                    if forest.join(held[k][2], held[n][2]):
                        out.append((held[k][2], held[n][2], 0))
        out.extend((held[k][2], None, int(others[k])) for k in np.flatnonzero(others).tolist())

    def told() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "others"])
        out.clear()
        return batch

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:2] != now:
                compare()
                held, now = [], r[:2]
            held.append(r)
        if len(out) > 50_000:
            yield told()
    compare()
    yield told()


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, n).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["cid", "grams"])


def classes(docs: DataFrame, words: int = WORDS, hashes: int = MOST_HASHES) -> tuple[DataFrame, DataFrame]:
    """Documents with ``cid``, the 128-bit key of their exact gram set (null: no words), and the classes with signature, size, number of grams and one member."""
    src = text_bytes(docs).withColumn("text_hash", F.xxhash64("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    signed = src.mapInArrow(partial(_sign, n=words, hashes=hashes), f"doc_id {kind}, text_hash long, cid binary, sign binary, n_grams long")
    signed = materialize(signed, "signed")
    same = signed.where("cid is not null").groupBy("cid", "sign", "n_grams").agg(F.count("*").alias("n_docs"), F.min(F.struct("text_hash", "doc_id")).alias("one"))
    return signed.select("doc_id", "text_hash", "cid"), materialize(same.select("cid", "sign", "n_grams", "n_docs", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash")), "classes")


def buckets(same: DataFrame, bands: int, rows: int) -> DataFrame:
    """``cid, key`` for each band of each class."""
    at = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.substring(F.col("sign"), i * rows + 1, F.lit(rows)), i))
    return same.select("cid", F.explode(at).alias("key"))


def candidate_groups(same: DataFrame, bands: int, rows: int, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """``cid, root, m, grams``: classes that agree in a band, chained into groups, with the group's classes and grams; and ``key, n, least`` of buckets with several classes.

    Each bucket links its members to its least one only.
    """
    put = buckets(same, bands, rows)
    shared = materialize(put.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("least")).where("n > 1"), "shared")
    stars = put.join(shared, "key").where("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    found = components(stars, part)
    sizes = found.join(same.select(F.col("cid").alias("node"), "n_grams"), "node").groupBy("root").agg(F.count("*").alias("m"), F.sum("n_grams").alias("grams"))
    return materialize(found.join(sizes, "root").select(F.col("node").alias("cid"), "root", "m", "grams"), "groups"), shared


def meetings(groups: DataFrame, shared: DataFrame, same: DataFrame, bands: int, rows: int, block: int, grams: int) -> DataFrame:
    """``cid, block, i, j``: the block of each class in a group, once for each pair of blocks in which it meets others.

    A group of at most ``block`` classes and ``grams`` grams is one block. A larger one is dealt to blocks in one of two ways,
    the one that makes fewer copies of its classes: at random, where all blocks meet, which suits a group of classes all
    alike; or classes stand with those of the same largest bucket (several blocks if these are too many), and only
    blocks that have classes in one bucket meet, which suits a long chain, where each meets few others.
    """
    many = lambda n, g: F.greatest(F.ceil(n / block), F.ceil(g / grams))
    part = lambda n: F.pmod(F.xxhash64("cid", F.lit(3)), n)
    fits = many(F.col("m"), F.col("grams")) <= 1
    whole = groups.where(fits).select("cid", F.xxhash64("root").alias("block")).select("cid", "block", F.col("block").alias("i"), F.col("block").alias("j"))
    large = materialize(same.select("cid", "sign", "n_grams").join(groups.where(~fits).withColumn("parts", many(F.col("m"), F.col("grams"))).select("cid", "root", "m", "parts"), "cid"), "large")
    # blocks by home bucket, and which of them share a bucket
    put = materialize(buckets(large, bands, rows).join(shared.select("key", "n"), "key").select("cid", "key", "n"), "held")
    home = put.groupBy("cid").agg(F.max(F.struct("n", "key")).alias("x")).select("cid", F.col("x.key").alias("home"))
    home = large.select("cid", "root", "n_grams").join(home, "cid")
    parts = home.groupBy("home").agg(many(F.count("*"), F.sum("n_grams")).alias("parts"))
    placed = materialize(home.join(parts, "home").select("cid", "root", F.xxhash64("home", part(F.col("parts"))).alias("block")), "blocks")
    there = materialize(put.join(placed, "cid").select("root", "key", "block").distinct(), "there")
    pairs = there.join(there.select("root", "key", F.col("block").alias("other")), ["root", "key"]).where("block <= other").select("root", F.col("block").alias("i"), F.col("other").alias("j")).distinct()
    turns = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    pairs = materialize(pairs.select("root", F.explode(turns).alias("block"), "i", "j"), "pairs")
    sizes = placed.groupBy("root", "block").agg(F.count("*").alias("n"))
    near = pairs.groupBy("root", "block").agg(F.count("*").alias("turns")).join(sizes, ["root", "block"]).groupBy("root").agg(F.sum(F.col("n") * F.col("turns")).alias("copies"))
    spare = large.select("root", "m", "parts").distinct().join(near, "root").where(F.col("copies") < F.col("m") * F.col("parts")).select("root")
    spare = materialize(spare, "chains")
    met = placed.join(spare, "root", "left_semi").join(pairs, ["root", "block"]).select("cid", "block", "i", "j")
    dealt = large.join(spare, "root", "left_anti").withColumn("own", part(F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    named = lambda c: F.xxhash64("root", c)
    dealt = dealt.select("cid", named(F.col("own")).alias("block"), named(F.least("own", "other")).alias("i"), named(F.greatest("own", "other")).alias("j"))
    return whole.unionByName(met).unionByName(dealt)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, grams: int = BLOCK_GRAMS, part: int = PART) -> DataFrame:
    """``doc_id, text_hash, root, class_id, n_links``: each document's group and links.

    Root names the connected group, class_id is the least doc_id in it,
    n_links counts other documents at Jaccard ``similarity`` or more, copies included. Documents
    of one gram set are one class from the start; classes that agree in a band are chained into
    groups, and within a group blocks of about ``block`` classes and ``grams`` grams that share a bucket meet two at a time. A meeting tells numbers
    of links and a forest, so no pairs are written however many there are. A text
    without words (null, empty, blank) is linked to nothing. Repeated rows count as copies; null doc_ids
    are kept. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(similarity, recall, MOST_HASHES)
    members, same = classes(docs, words, bands * rows)
    groups, shared = candidate_groups(same, bands, rows, part)
    release(spark)
    src = text_bytes(docs).withColumn("text_hash", F.xxhash64("text"))
    used = same.join(groups.select("cid"), "cid")
    texts = src.join(used.select("cid", "one_id", "one_hash"), F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash"))).dropDuplicates(["cid"]).select("cid", "text")
    sets = texts.mapInArrow(partial(_sets, n=words), "cid binary, grams binary")
    held = used.select("cid", "sign", "n_docs").join(sets, "cid")
    mine = meetings(groups, shared, same, bands, rows, block, grams).join(held, "cid").select("i", "j", "cid", "block", "sign", "grams", "n_docs")
    mine = mine.repartition("i", "j").sortWithinPartitions("i", "j")
    told = materialize(mine.mapInArrow(partial(_meet, rows=rows, least=similarity - SLACK, similarity=similarity), "a binary, b binary, others long"), "links")
    del mine, held, sets, texts, used
    release(spark)
    roots = components(told.where("b is not null").select("a", "b"), part)
    sized = same.select("cid", "n_docs")
    linked = told.groupBy("a").agg(F.sum("others").alias("others"))
    info = sized.join(linked, F.col("cid") == F.col("a"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    info = info.select("cid", F.coalesce("root", "cid").alias("root"), (F.col("n_docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    placed = materialize(members.join(info, "cid", "left"), "placed")
    discard(told, groups, shared)
    first = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = placed.join(first, "root", "left").select("doc_id", "text_hash", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id (then hash); all columns.

    Texts without words are in no group and all stay, but for rows that repeat one doc_id and text.
    """
    found = near_duplicates(docs, **options)
    best = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select("x.*")
    stay = best.unionByName(found.where("root is null").select("doc_id", "text_hash").distinct()).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_id"), F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))).alias("r_hash"))
    kept = rows.join(stay, F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_hash") == F.col("k_hash")), "left_semi")
    return kept.dropDuplicates(["r_id", "r_hash"]).select("row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP8_SQL = """
with recursive w as (select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents),
g as (
  select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as gram from w),
n as (select doc_id, count(*) as n from g group by all),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c >= cast(0.8 as double) * (x.n + y.n - c)),
k(doc_id, class_id) using key (doc_id) as (
  select doc_id, doc_id as class_id from documents union
  (select l.b as doc_id, min(k.class_id) as class_id from k join l on l.a = k.doc_id join recurring.k o on o.doc_id = l.b where k.class_id < o.class_id group by l.b))
select doc_id, class_id, coalesce(m, 0) as n_links from k left join (select a as doc_id, count(*) as m from l group by a) using (doc_id)
"""

"""Ranked lexical search as a threshold-seeded join of items and documents (operator 11)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talweg.llm.common import discard, materialize, table, text_bytes
from talweg.llm.search import ranges

TOP = 20
#: Items of one set, whose terms go to all documents at once, and bytes of their texts at most (a longer text is a set of its own).
ITEMS, ITEM_BYTES = 8192, 24_000_000
#: Documents that a task joins with the items at a time, and postings after which it does so with fewer.
TOGETHER, POSTINGS = 8192, 2_000_000
#: What separates terms (ASCII but digits and letters) becomes a blank, and A-Z a-z; all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in order, with repeats."""
    return text.translate(FOLD).split()


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: object) -> Iterator[pa.RecordBatch]:
    """Number of terms of each document that has any, and which of the vocabulary it holds how often."""
    code = vocabulary.value
    for batch in batches:
        keep, sizes, codes, often = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if found := terms(text):
                counts = Counter(found)
                known = counts.keys() & code.keys()
                keep.append(i)
                sizes.append(len(found))
                codes.append([code[t] for t in known])
                often.append([counts[t] for t in known])
        ids = batch.column(0).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(codes, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], ["doc_id", "n", "codes", "tf"])


def postings(batch: pa.RecordBatch | pa.Table, docs: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term code and impact without weight of each posting of rows ``doc_id, n, codes, tf``."""
    flat = lambda c: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten().to_numpy(zero_copy_only=False)
    each, n = np.asarray(pc.list_value_length(batch.column(2))).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
    row, code, tf = np.repeat(np.arange(len(each)), each), flat(batch.column(2)).astype(np.int64), flat(batch.column(3)).astype(np.int64)
    m = 100 - 25 + (25 * n * docs) // total
    return row, code, (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])


def _impacts(batches: Iterator[pa.RecordBatch], docs: int, total: int, top: int) -> Iterator[pa.RecordBatch]:
    """Of the task's documents: each term's ``top`` largest impacts, and in how many it is (with a null impact)."""
    code, impact, df = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trimmed() -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((-impact, code))
        c, x = code[order], impact[order]
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        keep = np.arange(len(c)) - np.repeat(head, np.diff(np.append(head, len(c)))) < top
        return c[keep], x[keep]

    for batch in batches:
        _, c, x = postings(batch, docs, total)
        n = np.bincount(c, minlength=len(df))
        n[: len(df)] += df
        df, code, impact = n, np.append(code, c), np.append(impact, x)
        if len(code) > POSTINGS:
            code, impact = trimmed()
    code, impact = trimmed()
    has = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(code, has)), pa.array(np.append(impact, np.zeros(len(has), np.int64)), mask=np.append(np.zeros(len(code), bool), np.ones(len(has), bool))), pa.array(np.append(np.zeros(len(code), np.int64), df[has]))], ["code", "impact", "df"])


def impacts(vectors: DataFrame, docs: int, total: int, top: int) -> DataFrame:
    """``code, df, most, kth``: each term's document count, largest impact and ``top``-th largest (0: in fewer documents), without weights."""
    told = vectors.mapInArrow(partial(_impacts, docs=docs, total=total, top=top), "code long, impact long, df long")
    told = materialize(told, "impacts")
    order = Window.partitionBy("code").orderBy(F.desc("impact"))
    best = told.where("impact is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    best = best.groupBy("code").agg(F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("place") == top, F.col("impact"))), F.lit(0)).alias("kth"))
    return told.where("impact is null").groupBy("code").agg(F.sum("df").alias("df")).join(best, "code")


@dataclass
class Asked:
    """One set of items, flat: bounds of each one's terms; the terms by falling bound, as codes, with weight times repeats; the sum of the bounds from each term on; the seeded floor."""

    first: np.ndarray
    code: np.ndarray
    weight: np.ndarray
    rest: np.ndarray
    floor: np.ndarray
    codes: int

    @classmethod
    def of(cls, items: list[dict[int, int]], stats: dict[int, tuple[int, int, int]], docs: int, codes: int) -> Asked:
        """``items``: term codes with repeats; ``stats``: df, largest and k-th impact of each code that any document holds."""
        first, code, weight, rest, floor = [0], [], [], [], []
        w = {c: math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for c, (df, _, _) in stats.items()}
        for item in items:
            mine = sorted(((w[c] * n * stats[c][1], c, w[c] * n) for c, n in item.items() if c in stats and w[c] > 0), reverse=True)
            floor.append(max([1, *(x * stats[c][2] for _, c, x in mine)]))  # a score of 0 is no match
            ends = np.cumsum([b for b, _, _ in reversed(mine)], dtype=np.int64)[::-1] if mine else []
            first.append(first[-1] + len(mine))
            code += [c for _, c, _ in mine]
            weight += [x for _, _, x in mine]
            rest += list(ends)
        return cls(np.array(first), np.array(code, np.int64), np.array(weight, np.int64), np.array(rest, np.int64), np.array(floor, np.int64), codes)


def _join(batches: Iterator[pa.RecordBatch], asked: object, docs: int, total: int, top: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The best documents of the task for each item.

    An item's terms stand by falling bound. From the first term on whose bounds together stay
    strictly below the floor, no document that holds only those can enter: candidates are the documents in postings of
    the terms before. Those whose scores so far and the rest's bound reach the floor are scored with all terms.
    Floors begin at what the stored k-th impacts say and rise with the task's own k-th scores.
    """
    q: Asked = asked.value
    floor = q.floor.copy()
    form = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", kind)])
    best = form.empty_table()
    held: list[pa.RecordBatch] = []

    def judge() -> None:
        nonlocal best
        rows = pa.Table.from_batches(held)
        held.clear()
        row, code, impact = postings(rows, docs, total)
        order = np.lexsort((row, code))
        row, code, impact = row[order], code[order], impact[order]
        start = np.searchsorted(code, np.arange(q.codes + 1))
        key = code * len(rows) + row  # rising: where a document's posting of a term is found
        items, scores, places = [], [], []
        for i in range(len(floor)):
            lo, hi = q.first[i], q.first[i + 1]
            need = lo + int(np.searchsorted(-q.rest[lo:hi], -floor[i], side="right"))  # terms whose suffix still reaches the floor
            c, w = q.code[lo:need], q.weight[lo:need]
            at = ranges(start[c], start[c + 1])
            if not len(at):
                continue
            score = np.zeros(len(rows), np.int64)
            np.add.at(score, row[at], np.repeat(w, start[c + 1] - start[c]) * impact[at])
            left = int(q.rest[need]) if need < hi else 0
            live = np.flatnonzero((score > 0) & (score + left >= floor[i]))
            score = score[live]
            for k in range(need, hi):  # terms of small bounds, looked up for candidates only
                if not len(live):
                    break
                wanted = q.code[k] * len(rows) + live
                found = np.searchsorted(key, wanted)
                found[found == len(key)] = 0
                score += np.where(key[found] == wanted, q.weight[k] * impact[found], 0)
                left = int(q.rest[k + 1]) if k + 1 < hi else 0
                ok = score + left >= floor[i]
                live, score = live[ok], score[ok]
            if len(score) > top:
                ok = score >= np.partition(score, -top)[-top]  # and those that tie with it
                live, score = live[ok], score[ok]
            items.append(np.full(len(live), i))
            scores.append(score)
            places.append(live)
        if not items:
            return
        ids = rows.column(0).take(pa.array(np.concatenate(places)))
        new = pa.table([pa.array(np.concatenate(items), pa.int64()), pa.array(np.concatenate(scores), pa.int64()), ids.cast(kind)], schema=form)
        every = pa.concat_tables([best, new]).combine_chunks()
        every = every.take(pc.sort_indices(every, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
        item, score = np.asarray(every.column(0)), np.asarray(every.column(1))
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == top - 1
        floor[item[last]] = np.maximum(floor[item[last]], score[last])
        best = every.filter(pa.array(place < top))

    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(2).flatten())
        if sum(b.num_rows for b in held) >= TOGETHER or size > POSTINGS:
            judge()
            size = 0
    if held:
        judge()
    yield from best.to_batches()


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of highest score above 0 for each row of ``items`` (``item_id, text``).

    Terms are maximal runs of ASCII letters and digits and all beyond ASCII, A-Z lower-cased, over whole texts; scores are integers:
    a term's weight floor(1000 ln((2N+2)/(2df+1))) times its impact (1000000000 tf) div (1000 tf + 12 m), over the item's terms with
    repeats, where m is 75 + (25 n N) div L. N counts the documents with a term, L their terms. Ties go to the smaller doc_id, null last.
    Null, empty and term-less texts are no documents and match nothing. Repeated rows of ``docs`` are documents of
    their own; rows of ``items`` that repeat id and text are one item, equal ids with other texts are ranked each. Empty
    tables give no rows. Other columns are not read.

    Items go to the documents in sets of bounded size, each with its own vocabulary, so documents are never shuffled: each
    task emits its best ``top`` of an item at most.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    item_kind = items.schema["item_id"].dataType.simpleString()
    wanted = materialize(items.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).distinct(), "items")
    count, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sets, parts = max(-(-count // ITEMS), -(-size // ITEM_BYTES)), []
    for s in range(sets):
        held = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == s).toArrow()
        counts = [Counter(terms(t)) for t in held.column("text").to_pylist()]
        code = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        if not code:
            continue
        sent = spark.sparkContext.broadcast(code)
        vectors = materialize(text_bytes(docs).mapInArrow(partial(_vectors, vocabulary=sent), f"doc_id {kind.simpleString()}, n long, codes array<int>, tf array<int>"), "vectors")
        sent.destroy()
        n, total = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n:
            return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind.simpleString()}, score long")
        stats = {r["code"]: (r["df"], r["most"], r["kth"]) for r in impacts(vectors, n, total, top).collect()}  # a row a term of the set
        asked = Asked.of([{code[t]: c for t, c in x.items()} for x in counts], stats, n, len(code))
        sent = spark.sparkContext.broadcast(asked)
        hits = vectors.mapInArrow(partial(_join, asked=sent, docs=n, total=total, top=top, kind=to_arrow_type(kind)), f"item long, score long, doc_id {kind.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(held.column("item_id").to_pylist())), f"item long, item_id {item_kind}")
        parts.append(materialize(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
        sent.destroy()
        discard(vectors)
    if not parts:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind.simpleString()}, score long")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
with dt as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents where text is not null),
it as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark where text is not null),
q as (select item_id, term, count(*) as c from it group by all),
tf as (select doc_id, term, count(*) as tf from dt group by all),
size as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
whole as (select count(*) as docs, cast(sum(n) as bigint) as total from size),
m as (select doc_id, 100 - 25 + ((25 * n * docs) // total) as m from size, whole),
w as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from tf group by term), whole),
s as (select item_id, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from q join tf using (term) join w using (term) join m using (doc_id) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0
qualify rank <= 20
"""

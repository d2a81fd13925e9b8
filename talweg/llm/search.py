"""Exact top-k search: sharded inverted index with block-max WAND pruning for BM25 (operator 9)."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talweg.llm.common import materialize, release, table, text_bytes

TERM = re.compile(r"\w+")
K1, B, TOP = 1.2, 0.75, 10
#: Documents and bytes of text of a shard on average, and documents of a block within it.
SHARD, SHARD_BYTES, BLOCK = 4096, 16_000_000, 32
#: Queries of one set, which goes to all shards at once, and the bytes of its terms at most (larger texts make smaller sets).
QUERIES, QUERY_BYTES = 8192, 24_000_000
#: Queries that are held together, how many of them with live blocks alike are scored together, the postings of rarer terms
#: that are added up at once (one query alone may pass that), and how many blocks queries without a floor take first; the
#: last round takes all that may still matter.
TOGETHER, NEAR, RUNS, ROUNDS = 512, 128, 300_000, (16,)
#: Scores are compared when rounded to 6 digits, which moves them by up to half of this.
STEP = 1e-6
#: Postings of terms in more than this share of a shard are held as a matrix, those of others as rows, each padded by up to about this factor.
DENSE, PADDED = 0.03, 1.25
#: Common terms whose presence orders the documents, so that blocks hold alike documents and their bounds are tight.
ALIKE = 24


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the lower-cased words of a text and how often each occurs."""
    counts = Counter(TERM.findall(text.decode("utf-8", "replace").lower()))
    ids = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in counts), np.uint64, len(counts)).view(np.int64)
    order = np.argsort(ids)
    return ids[order], np.fromiter(counts.values(), np.int64, len(counts))[order]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            t, c = terms(text)
            ids.append(t)
            counts.append(c.astype(np.int32))
            sizes.append(int(c.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], ["doc_id", "text_hash", "terms", "counts", "size"])


def _store(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of one shard as one row: postings by term, packed, with the documents' ids and sizes.

    Places are dealt by the presence of the shard's commonest terms, then by size; ``rank`` keeps the order by doc_id, which decides ties.
    """
    pdf = pdf.sort_values(["doc_id", "text_hash"], ignore_index=True, na_position="last")
    n, each = len(pdf), pdf["terms"].map(len).to_numpy(np.int64)
    names, code, df = np.unique(np.concatenate(list(pdf["terms"])).astype(np.int64), return_inverse=True, return_counts=True)
    doc, tf = np.repeat(np.arange(n), each), np.concatenate(list(pdf["counts"])).astype(np.int64)
    sizes, bit = pdf["size"].to_numpy(np.int64), np.full(len(names), -1)
    common = np.argsort(-df, kind="stable")[:ALIKE]
    bit[common] = np.arange(len(common))[::-1]
    alike, has = np.zeros(n, np.int64), bit[code] >= 0
    np.bitwise_or.at(alike, doc[has], np.int64(1) << bit[code[has]])
    rank = np.lexsort((sizes, alike))  # of the document at each place
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    order = np.lexsort((place[doc], code))
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    ids = [None if i is None or i != i else i for i in pdf["doc_id"].tolist()]
    blob = pickle.dumps((ids, small(rank), sizes[rank], names, np.append(0, np.cumsum(df)), small(place[doc][order]), small(tf[order])))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [n], "size": [int(sizes.sum())], "blob": [blob]})


def _deflated(pdf: pd.DataFrame) -> pd.DataFrame:
    """``_store``, deflated: executor and worker hold a row's bytes several times over while it passes between them."""
    row = _store(pdf)
    row["blob"] = [zlib.compress(b, 1) for b in row["blob"]]
    return row


def unpacked(blob: bytes | pa.Buffer) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and what ``Shard`` takes: ranks, sizes, names of terms, bounds of their postings, places and counts."""
    return pickle.loads(zlib.decompress(blob))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a shard each of its terms is."""
    for batch in batches:
        for blob in batch.column(0):
            _, _, _, names, first, _, _ = unpacked(blob.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.diff(first))], ["term", "df"])


@dataclass
class Asked:
    """One set of queries, flat: query numbers, bounds of each one's terms, terms as codes of ``names``, weights, and the score that is known to be reached ``TOP`` times."""

    number: np.ndarray
    first: np.ndarray
    code: np.ndarray
    weight: np.ndarray
    names: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Asked:
        """``rows``: number, terms and weights of each query."""
        each = np.array([len(t) for _, t, _ in rows], np.int64)
        flat = [np.concatenate([np.asarray(r[i], kind) for r in rows] or [np.zeros(0, kind)]) for i, kind in ((1, np.int64), (2, np.float64))]
        names, code = np.unique(flat[0], return_inverse=True)
        return cls(np.array([r[0] for r in rows], np.int64), np.append(0, np.cumsum(each)), code.astype(np.int32), flat[1], names, np.zeros(len(rows)))


class Shard:
    """Index of one shard: a matrix of the impacts of common terms with each block's largest, and rows of places and impacts for the others.

    Impacts are BM25 term scores without idf. The matrix has single precision; what it lets through
    is scored again from the counts, in double precision. Rows of terms of about as many documents
    lie together, padded to one width with impact 0.
    """

    def __init__(self, rank: np.ndarray, sizes: np.ndarray, names: np.ndarray, first: np.ndarray, doc: np.ndarray, tf: np.ndarray, mean: float) -> None:
        self.n, self.names, self.rank = len(sizes), names, rank.astype(np.int64)
        self.blocks = -(-self.n // BLOCK)
        self.places = self.blocks * BLOCK
        self.long = K1 * (1 - B + B * sizes / mean)
        df = np.diff(first)
        common = df > max(DENSE * self.n, 16)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.tf = np.zeros((int(common.sum()), self.places), tf.dtype)
        dense = np.zeros(self.tf.shape, np.float32)
        for j, t in enumerate(np.flatnonzero(common).tolist()):
            at, often = doc[first[t] : first[t + 1]], tf[first[t] : first[t + 1]]
            self.tf[j, at], dense[j, at] = often, often * (K1 + 1) / (often + self.long[at])
        self.dense = dense.reshape(len(dense), self.blocks, BLOCK)
        self.dense_most = self.dense.max(axis=2)
        self.widths = [1]
        while self.widths[-1] < df[~common].max(initial=0):
            self.widths.append(max(self.widths[-1] + 1, int(self.widths[-1] * PADDED)))
        self.group = np.where(common, -1, np.searchsorted(self.widths, df)).astype(np.int16)
        self.row, self.rows = np.zeros(len(df), np.int64), []
        for g, width in enumerate(self.widths):
            t = np.flatnonzero(self.group == g)
            self.row[t] = np.arange(len(t))
            held, posts = np.arange(width) < df[t, None], ranges(first[t], first[t + 1])
            place, impact = np.zeros(held.shape, np.int64), np.zeros(held.shape)
            often = tf[posts].astype(float)
            place[held], impact[held] = doc[posts], often * (K1 + 1) / (often + self.long[doc[posts]])
            self.rows.append((place, impact))
        often = np.argsort(-df, kind="stable")[:ALIKE]
        self.bit = np.zeros(len(df))
        self.bit[often] = 2.0 ** np.arange(len(often))[::-1]

    def search(self, asked: Asked, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of the best ``k`` documents of each query, ties by rank, and raises ``floor`` to the k-th score.

        Rarer terms are added up first. Their largest sum in a block and the largest impacts of the
        query's common terms there add up to the block's bound. A block whose bound stays under the
        floor can't hold a pivot, a document that would enter the k best, and is skipped with all its
        columns. Queries without a floor take a few blocks of the highest bounds first to find one.
        Documents under the floor given may be left out.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked.number)
        if not len(self.names):
            return out
        at = np.searchsorted(self.names, asked.names)
        at[at == len(self.names)] = 0
        term = np.where(self.names[at] == asked.names, at, -1)[asked.code]
        here = term >= 0
        query = np.repeat(np.arange(len(out)), np.diff(asked.first))[here]
        term, weight = term[here], asked.weight[here]
        first = np.searchsorted(query, np.arange(len(out) + 1))
        alike = np.argsort(np.bincount(query, self.bit[term], len(out)), kind="stable")
        for done in range(0, len(out), TOGETHER):
            these = alike[done : done + TOGETHER]
            part = ranges(first[these], first[these + 1])
            found = self._batch(np.repeat(np.arange(len(these)), first[these + 1] - first[these]), term[part], weight[part], floor[these], k)
            for q, best in zip(these.tolist(), found, strict=True):
                out[q] = best
                if len(best[1]) == k:
                    floor[q] = max(floor[q], best[1][-1])
        return out

    def _batch(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        m, common = len(floor), self.column[term] >= 0
        rare = self._rare(query[~common], term[~common], weight[~common], m)
        query, column, weight = query[common], self.column[term[common]], weight[common]
        light = np.zeros((m, len(self.dense)), np.float32)
        light[query, column] = weight
        # impacts, weights, products and sums are rounded, each by 2**-24 at most, and nothing is below 0
        slack = (np.bincount(query, minlength=m).max(initial=0) + 8) * 2.0**-23
        bound = ((light @ self.dense_most).astype(float) + rare.max(axis=2)) * (1 + slack)
        low, score = floor - STEP, np.zeros(rare.shape, np.float32)
        flat = score.reshape(m, -1)
        new = np.flatnonzero(floor <= 0)
        for size in (*(x for x in ROUNDS if k <= x < self.blocks and len(new)), self.blocks):
            if size < self.blocks:
                some = new
            else:
                live = (bound > 0) & (bound >= low[:, None])
                some = np.flatnonzero(live.any(axis=1))
                middle = live[some] @ np.arange(self.blocks, dtype=float) / np.count_nonzero(live[some], axis=1)
                some = some[np.argsort(middle, kind="stable")]
            for done in range(0, len(some), NEAR):
                these = some[done : done + NEAR]
                if size < self.blocks:
                    blocks = np.sort(np.argsort(-(bound[these] / (bound[these].max(axis=1, keepdims=True) + STEP)).sum(axis=0), kind="stable")[:size])
                else:
                    blocks = np.flatnonzero(live[these].any(axis=0))
                used, at = np.flatnonzero(light[these].any(axis=0)), np.ix_(these, blocks)
                part = light[np.ix_(these, used)] @ self.dense[np.ix_(used, blocks)].reshape(len(used), len(blocks) * BLOCK)
                score[at] = part.reshape(len(these), -1, BLOCK) + rare[at]
            if self.blocks >= k and len(new):  # k blocks hold a document of at least the k-th largest block's best
                reached = np.partition(score[new].max(axis=2), -k, axis=1)[:, -k].astype(float)
                low[new] = np.maximum(low[new], reached * (1 - slack) - STEP)
        at = np.flatnonzero((flat > 0) & (flat >= (low * (1 - slack)).astype(np.float32)[:, None]))
        of, place = np.divmod(at, self.places)
        near = flat.reshape(-1)[at].astype(float)
        order, start = np.lexsort((-near, of)), np.searchsorted(of, np.arange(m + 1))
        many = np.flatnonzero(np.diff(start) > k)
        low[many] = np.maximum(low[many], near[order[start[many] + k - 1]] * (1 - slack) - STEP)
        at, of, place = (x[near >= low[of] * (1 - slack)] for x in (at, of, place))
        exact = rare.reshape(-1)[at] + self._common(of, place, query, column, weight, m)
        ok = exact >= low[of]
        of, place, exact = of[ok], place[ok], np.round(exact[ok], 6)
        order = np.lexsort((self.rank[place], -exact, of))
        start = np.searchsorted(of, np.arange(m + 1)).tolist()
        return [(place[x], exact[x]) for x in (order[a : min(a + k, b)] for a, b in zip(start, start[1:], strict=False))]

    def _rare(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
        """Scores of all places by the rarer terms of ``m`` queries."""
        out = np.empty((m, self.places))
        group = self.group[term]
        widths, first = np.array(self.widths), np.searchsorted(query, np.arange(m + 1))
        before = np.append(0, np.cumsum(widths[group]))[first]
        done = 0
        while done < m:
            end = max(done + 1, int(np.searchsorted(before, before[done] + RUNS, side="right")) - 1)
            order = first[done] + np.argsort(group[first[done] : first[end]], kind="stable")
            row, shift, w = self.row[term[order]], (query[order] - done) * self.places, weight[order]
            bounds = np.searchsorted(group[order], np.arange(len(widths) + 1)).tolist()
            place, score, at = np.empty(before[end] - before[done], np.int64), np.empty(before[end] - before[done]), 0
            for (places, impacts), a, b in zip(self.rows, bounds, bounds[1:], strict=False):
                size = (b - a) * places.shape[1]
                if size:
                    p, s = (x[at : at + size].reshape(b - a, -1) for x in (place, score))
                    np.take(places, row[a:b], axis=0, out=p, mode="clip")
                    np.take(impacts, row[a:b], axis=0, out=s, mode="clip")
                    p += shift[a:b, None]
                    s *= w[a:b, None]
                at += size
            out[done:end] = np.bincount(place, score, (end - done) * self.places).reshape(end - done, -1)
            done = end
        return out.reshape(m, self.blocks, BLOCK)

    def _common(self, of: np.ndarray, place: np.ndarray, query: np.ndarray, column: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
        """Exact scores of places by the common terms of the queries that each is for."""
        first = np.searchsorted(query, np.arange(m + 1))
        out, each, done = np.zeros(len(of)), first[of + 1] - first[of], 0
        before = np.append(0, np.cumsum(each))
        while done < len(of):
            end = max(done + 1, int(np.searchsorted(before, before[done] + RUNS, side="right")) - 1)
            part, pair = ranges(first[of[done:end]], first[of[done:end] + 1]), np.repeat(np.arange(end - done), each[done:end])
            at = place[done:end][pair]
            often = self.tf[column[part], at].astype(float)
            out[done:end] = np.bincount(pair, weight[part] * (often * (K1 + 1) / (often + self.long[at])), end - done)
            done = end
        return out


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo to hi, one range after another."""
    each = hi - lo
    ends = np.cumsum(each)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(lo - (ends - each), each) + np.arange(ends[-1])


def _search(batches: Iterator[pa.RecordBatch], queries: object, mean: float, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Best documents of the task's shards; what one shard reaches is the floor of the next."""
    asked: Asked = queries.value
    floor, numbers, docs, scores = asked.floor.copy(), [], [], []
    for batch in batches:
        for blob in batch.column(0):
            ids, *parts = unpacked(blob.as_buffer())
            shard = Shard(*parts, mean)
            del parts
            best = shard.search(asked, floor, k)
            at = np.repeat(np.arange(len(best)), [len(p) for p, _ in best])
            place, score = (np.concatenate([b[i] for b in best]) if best else np.zeros(0, np.int64) for i in (0, 1))
            ok = score >= floor[at]
            numbers.append(at[ok])
            docs.append(pa.array(ids, kind).take(pa.array(shard.rank[place[ok].astype(np.int64)])))
            scores.append(score[ok])
    for at, ids, score in zip(numbers, docs, scores, strict=True):
        ok = score >= floor[at]  # floors have risen since
        yield pa.RecordBatch.from_arrays([pa.array(asked.number[at[ok]]), ids.filter(pa.array(ok)), pa.array(score[ok])], ["query", "doc_id", "score"])


def search(docs: DataFrame, asked: F.Column, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, doc_id, score``: best ``top`` documents by BM25 for each row of ``docs`` that meets ``asked``.

    A query is the row's whole text, each word as often as it occurs. Number and mean length of documents,
    and how many have each term, are over all rows, so shards' results merge exactly. Scores are
    rounded to 6 digits; ties go to the smaller doc_id, null last. The row itself is among the documents. Texts without
    words (null, empty, blank) match nothing. Repeated rows are documents of their own but one query. Bytes that
    aren't UTF-8 read as U+FFFD, which is no word. Other columns are not read. An empty table gives no rows.

    Query terms go to the shards in sets of bounded size, one set after another. An eighth of the
    shards goes first: what a query reaches there is the floor that prunes the other shards.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", F.coalesce(asked, F.lit(False)).alias("asked"))
    kind = marked.schema["doc_id"].dataType
    none = spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, doc_id {kind.simpleString()}, score double")
    form = f"doc_id {kind.simpleString()}, text_hash long, terms array<long>, counts array<int>, size long"

    def of(rows: DataFrame) -> DataFrame:
        return text_bytes(rows).withColumn("text_hash", F.xxhash64("text")).mapInArrow(_terms, form)

    count, size = marked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(-(-count // shard), -(-size // SHARD_BYTES))
    if not count:
        return none
    dealt = of(marked).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int"))
    index = materialize(dealt.groupBy("shard").applyInPandas(_deflated, "shard int, n long, size long, blob binary"), "index")
    del dealt
    release(spark)
    n, total = index.agg(F.sum("n"), F.sum("size")).first()
    if not total:
        return none
    words = of(marked.where("asked")).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("doc_id", "text_hash", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    df = index.select("blob").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asks = words.join(df, "term").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("term", (idf * F.col("tf")).alias("w")))).alias("x"))
    asks = materialize(asks.select("doc_id", F.col("x.term").alias("terms"), F.col("x.w").alias("w"), F.monotonically_increasing_id().alias("query")), "queries")
    del words, df
    release(spark)
    sets = asks.agg(F.greatest(F.ceil(F.count("*") / QUERIES), F.ceil(F.coalesce(F.sum(F.size("terms")), F.lit(0)) * 16 / QUERY_BYTES))).first()[0]
    early, found = -(-shards // 8), []
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for k in range(sets):
        part = asks.where(F.pmod(F.xxhash64("query"), F.lit(sets)) == k).select("query", "terms", "w").toArrow()
        if not part.num_rows:
            continue
        held = Asked.of([(q, t.values.to_numpy(), w.values.to_numpy()) for q, t, w in zip(*(part.column(i) if i else part.column(i).to_pylist() for i in range(3)), strict=True)])
        del part
        for wave in (F.col("shard") < early, F.col("shard") >= early):
            sent = spark.sparkContext.broadcast(held)
            hits = index.where(wave).select("blob").mapInArrow(partial(_search, queries=sent, mean=total / n, k=top, kind=to_arrow_type(kind)), f"query long, doc_id {kind.simpleString()}, score double")
            hits = materialize(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "hits")
            sent.destroy()
            found.append(hits)
            if shards == early:
                break
            reached = {r["query"]: r["score"] for r in hits.where(F.col("rank") == top).select("query", "score").collect()}
            held.floor = np.array([reached.get(q, 0.0) for q in held.number.tolist()])
    if not found:
        return none
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(asks.select("query", F.col("doc_id").alias("query_id")), "query").select("query_id", "rank", "doc_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0).withColumn("score", F.round("score", 3))


OP9_SQL = """
with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
size as (select doc_id, coalesce(sum(tf), 0) as size from documents left join tf using (doc_id) group by doc_id),
mean as (select count(*) as n, avg(size) as mean from size),
df as (select term, count(*) as df from tf group by term),
score as (
  select q.doc_id as query_id, d.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) as score
  from tf q join tf d using (term) join df using (term) join size on size.doc_id = d.doc_id, mean where q.doc_id % 20 = 0 group by all),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from score)
select query_id, rank, doc_id, round(score, 3) as score from ranked where rank <= 10
"""

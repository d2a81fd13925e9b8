"""Ranked search, hard negatives and WARC archives against brute force and on odd rows: nulls, empty, repeated, long and tied ones, clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.llm import hardneg, ranked, warc

SF = "/root/testdata/sf0.001"


def in_duckdb(text, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(text)


def same_rows(query, text, spark, *tables):
    want = in_duckdb(text, *tables)
    got = query(spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# --- 11 ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_hand(docs, items, top):
    held = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t is not None]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(TERM.findall((text or "").translate(LOWER))).items() if t in c)
            if s > 0:
                found.append((-s, math.inf if d is None else d, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:top])]
    return sorted(map(str, out))


@pytest.mark.parametrize("together,top", [(8192, 20), (64, 3)])
def test_ranked_search(spark, monkeypatch, together, top):
    monkeypatch.setattr(ranked, "TOGETHER", together)
    rng = random.Random(together)
    word = lambda: rng.choice([f"w{int(rng.paretovariate(0.7)) % 400}", "Straße", "ÉTÉ", "été", "x_y", "naïve-2"])
    docs = [(i if i % 41 else None, " ".join(word() for _ in range(rng.randrange(1, 90)))) for i in range(300)]
    docs += [(1000 + i, "same words here") for i in range(60)] + [(7, "same words here")] * 3 + [(2000, None), (2001, ""), (2002, " ,.\t"), (2003, "w1 " * 30_000)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(12)] + [(50, "Same same WORDS"), (50, "Same same WORDS"), (50, "w1"), (51, None), (52, ""), (53, "unheard"), (None, "w2 w3")]
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, rank int, item_id string, score int")
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    got = ranked.rank(d, q, top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == ranked_by_hand(docs, items, top)


def test_ranked_search_of_nothing(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank(d.limit(0), q).count() == ranked.rank(d, q.limit(0)).count() == 0


def test_ranked_search_in_sets(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS", 10)
    same_rows(ranked.op11_ranked_search, ranked.OP11_SQL, spark, "documents", "benchmark")


def test_few_documents_of_frequent_terms_are_scored():
    """A rare term's stored k-th impact lets the frequent one go: documents that hold only that are no candidates."""
    stats = {0: (900, 300_000, 290_000), 1: (30, 500_000, 480_000)}
    asked = ranked.Asked.of([{0: 1, 1: 1}], stats, 1000, 2)
    assert asked.code.tolist() == [1, 0] and asked.rest[1] < asked.floor[0] < asked.rest[0]


# --- 12 hard negatives


def mined_by_hand(rows, is_anchor):
    hold = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    live = [(i, lab, [max(-(2**62), min(2**62, math.floor(256 * x))) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, label, za) in enumerate(live):
        if a is None or not is_anchor(a):
            continue
        s = sorted(((hold(sum(x * y for x, y in zip(za, z, strict=False))), i, lab, k) for k, (i, lab, z) in enumerate(live) if k != at), key=lambda t: (-t[0], math.inf if t[1] is None else t[1], t[3]))
        for p in [t for t in s if t[2] == label][:5]:
            out += [(a, p[1], k + 1, t[1], p[0], t[0]) for k, t in enumerate([t for t in s if t[2] != label and 30 * p[0] <= 100 * t[0] <= 90 * p[0]][:10])]
    return sorted(map(str, out))


@pytest.mark.parametrize("block,lists,together", [(64, None, 256), (2048, 1, 3), (16, 40, 256)])
def test_hard_negatives(spark, monkeypatch, block, lists, together):
    monkeypatch.setattr(hardneg, "TOGETHER", together)
    rng = random.Random(block)
    rows = [(i if i % 97 else None, rng.randrange(4) if i % 50 else None, [rng.gauss(0, 1) + 2 * (i % 3 == k) for k in range(8)]) for i in range(600)]
    rows += [(2000 + i, i % 3, [0.5] * 8) for i in range(300)]  # a third are copies of one vector
    rows += [(3000, 1, None), (3001, 1, [None] * 8), (3002, 1, [float("nan")] * 8), (3003, 1, [float("inf")] * 8), (3100, 2, []), (3200, 2, [1.0] * 3), (100, 1, [1.0] * 8), (3300, 1, [1e300] * 8), (3400, 2, [2e5] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label int, vec array<double>, rank string, score int")
    got = hardneg.mine(df, F.col("id") % 100 == 0, block=block, lists=lists)
    assert sorted(str(tuple(r)) for r in got.collect()) == mined_by_hand(rows, lambda i: i % 100 == 0)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, None, [1.0]), (2, 1, None)], "id long, label int, vec array<double>")
    assert hardneg.mine(df.limit(0), F.col("id") >= 0).count() == 0
    assert hardneg.mine(df.where("id > 0"), F.col("id") >= 0).count() == 0
    assert hardneg.mine(df, F.col("id") >= 0).count() == 0  # an anchor without positives


def test_hard_negatives_equal_sql(spark):
    same_rows(hardneg.op12_hard_negatives, hardneg.OP12_SQL, spark, "embeddings")


def test_bounds_hold_and_lists_are_skipped():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16)) * 2000
    z = (np.repeat(centres, 50, axis=0) + rng.normal(size=(300, 16)) * 20).astype(np.int64)
    near = hardneg.nearest(z.astype(float), centres)
    radius = np.array([np.linalg.norm(z[near == k] - centres[k], axis=1).max() for k in range(6)])
    one = np.ones(1, np.int64)
    asked = hardneg.Asked(z[:1], one, one, one * 0, one, one, one, True, 5, centres, radius)
    low, high = asked.bounds()
    scores = hardneg.products(z[:1], z)[0]
    assert all(low[0, near[i]] <= s <= high[0, near[i]] for i, s in enumerate(scores))
    fifth = np.sort(scores)[-5]
    assert (high[0] >= fifth).sum() < 6  # some list's bound is strictly below the k-th score


# --- 13 WARC

BIG = "x" * 1500
PAGES = [(1, "http://a/ b", BIG), (2, None, BIG), (None, "http://c/", BIG), (2, None, BIG), (3, "z", "short"), (4, "z", "short"), (5, "u", None), (6, "", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nx" * 100), (7, "é://é?q#f", BIG + "é"), (8, "http://h/\r\nWARC-Type: x", "y" * 300_000), (9, "http://i", "y" * 300_000), (10, "j", "z" * 999), (11, "j", "z" * 999), (12, "k", "z" * 1000), (13, "k", "z" * 1000)]


def pages_frame(spark):
    return spark.createDataFrame([(*p, "q", "k", 1) for p in PAGES], "page_id long, url string, html string, type string, record_id string, payload int")


def pages_by_hand():
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        last = max((j if j is not None else -1 for j, _, h in PAGES if h == html), default=-1) if len(data) >= 1000 else i
        again = last != (i if i is not None else -1) and len(data) >= 1000
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(map(str, out))


def test_warc_round_trip(spark):
    got = warc.round_trip(pages_frame(spark))
    assert sorted(str(tuple(r)) for r in got.collect()) == pages_by_hand()
    assert warc.round_trip(pages_frame(spark).limit(0)).count() == 0


def test_warc_equals_sql(spark):
    same_rows(warc.op13_warc_assembly, warc.OP13_SQL, spark, "pages")


def test_archives_hold_three_records_a_page_and_one_row_a_capture(spark, tmp_path):
    files = warc.write_archives(pages_frame(spark), str(tmp_path), archive=10_000)
    assert {r["path"] for r in files.collect()} == {str(p) for p in tmp_path.iterdir()}
    records = warc.read_records(warc.archives(spark, str(tmp_path)))
    assert records.groupBy("type").count().where("type in ('request', 'metadata')").collect() and records.count() == 3 * len(PAGES)
    got = warc.assemble(records).collect()
    assert len(got) == len(PAGES) and all(r["n_requests"] == r["n_metadata"] == 1 and r["request"]["head"].startswith("GET /") for r in got)
    payloads = {bytes(r["response"]["payload"]) for r in got if r["type"] == "response"}
    assert payloads == {(h or "").encode() for _, _, h in PAGES}
    assert all(r["response"]["digest"] == r["response"]["payload_digest"] for r in got if r["type"] == "response")


def written_by_hand(path, records, packed):
    data = []
    for kind, name, fields, block in records:
        lines = ["WARC/1.0", f"WARC-Type: {kind}", *([f"WARC-Record-ID: {name}"] if name else []), *fields, f"Content-Length: {len(block)}", "", ""]
        one = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
        data.append(gzip.compress(one) if packed else one)
    path.write_bytes(b"".join(data))


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    """Ties in both directions and over one record between, records without partners, folded fields, hexadecimal digests, spread over files."""
    http = "Content-Type: application/http; msgtype=response"
    digest = hashlib.sha1(b"body").hexdigest()
    written_by_hand(tmp_path / "a.warc", [("warcinfo", "i", [], b"software: x"), ("request", "r1", ["WARC-Concurrent-To: p1"], b"GET /1"), ("response", "p1", [http, f"WARC-Payload-Digest: sha1:{digest.upper()}"], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"), ("metadata", "m1", ["WARC-Concurrent-To:", "  r1"], b"k: v")], packed)
    written_by_hand(tmp_path / "b.warc", [("response", "p2", [http, "WARC-Concurrent-To: r2", "WARC-Concurrent-To: r3"], b"HTTP/1.1 404 No\r\n\r\n"), ("request", "r3", [], b"GET /3"), ("request", "r2", [], b"GET /2"), ("request", "lost", ["WARC-Concurrent-To: nowhere"], b"GET /0"), ("metadata", None, [], b"")], packed)
    got = {r["record_id"]: r for r in warc.assemble(warc.read_records(warc.archives(spark, str(tmp_path)))).collect()}
    assert set(got) == {"i", "p1", "p2", "r3", "lost", None}
    assert (got["p1"]["request"]["record_id"], got["p1"]["metadata"]["head"], bytes(got["p1"]["response"]["payload"]), got["p1"]["response"]["digest"]) == ("r1", "k: v", b"body", digest)
    assert (got["p2"]["request"]["record_id"], got["p2"]["n_requests"], got["p2"]["response"]["payload_bytes"], got["p2"]["metadata"]) == ("r2", 2, 0, None)
    assert got["lost"]["response"] is None and got["lost"]["request"]["head"] == "GET /0"


def test_damaged_archives_are_named(tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc")
    with open(tmp_path / "x.warc", "rb") as f, pytest.raises(ValueError, match=r"x\.warc"):
        list(warc.parsed(f, "x.warc"))

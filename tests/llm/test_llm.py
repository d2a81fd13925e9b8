"""Training-data operators against brute force and on odd rows: nulls, empty, repeated, long and tied ones, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.llm import htmltext, mixing, neardup, packing, quality, registry, rules, search, suffixdup, tokencounts, urlfilter
from talweg.llm.common import table
from talweg.llm.wordbpe import WordEncoder

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, root int, spans int, prob int, row int"


def frame(spark, rows, form=FORM):
    """Rows of (doc_id, text) among columns that clash with what operators name theirs."""
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, f"s{(i or 0) % 2}", None, 0.5, "x", 1, 2, 3, 4) for i, t in rows], form)


def odd_rows():
    words = " ".join(f"word{i % 97}" for i in range(3000))
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (None, "a b c"), (5, words), (6, words), (6, words), (7, "x" * 5000), (8, "é" * 300 + "\n" + "é" * 300)]


def docs_of(name="documents"):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'").fetchall()


# --- 1 quality rules


def base_by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_counts(spark):
    rows = odd_rows() + [(r[0] + 100, r[1]) for r in docs_of()] + [(500, "a b c\x0bd\x1ce\n" * 9)]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.judge(frame(spark, rows), rules.LineCrf()).collect())
    want = Counter()
    for i, t in rows:
        b = base_by_hand(t)
        want[(i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0])] += 1
    assert got == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    model = rules.LineCrf(rng.normal(size=16), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([3, 0, 7, 1, 5])
    codes = rng.integers(0, 2**16, lengths.sum())
    got, at = model.viterbi(codes, lengths), 0
    for n in lengths:
        u = model.unary(codes[at : at + n])
        best = max((tuple(k >> i & 1 for i in range(n)) for k in range(2**n)), key=lambda y: sum(u[i] * y[i] for i in range(n)) + sum(model.t[y[i], y[i + 1]] for i in range(n - 1)) + (model.s[y[0]] if n else 0))
        assert tuple(got[at : at + n]) == best
        at += n


def test_crf_learns_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = rules.train(docs, labels)
    got = rules.judge(docs, model).join(labels.groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["q"] == 1) for r in got) / len(got) > 0.95
    kept = rules.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == rules.judge(docs, model).where("kept").count()
    assert np.array_equal(rules.train(docs, labels.limit(0)).w, rules.LineCrf().w)


# --- 2 token counts


def test_token_attribution(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = odd_rows() + [(20, "a\n\n\nb  \n c"), (21, "日本語\n\nテキスト😀\n")]
    enc, sizes = tokencounts._encoding(path)
    for rule in tokencounts.RULES:
        got = sorted((str(r["doc_id"]), r["n_chars"], r["n_tokens"], list(r["section_tokens"])) for r in tokencounts.count_tokens(frame(spark, rows), path, rule).collect())
        want = []
        for i, t in rows:
            t = t or ""
            lines = [line for line in t.splitlines(keepends=True)] if set(t) <= {*t.replace("\r", "")} else []
            owner = [k for k, line in enumerate(t[:-1].split("\n") if t.endswith("\n") else t.split("\n")) for _ in range(len(line) + 1)][: len(t)]
            raw, at, n = t.encode(), 0, [0] * (owner[-1] + 1 if t else 0)
            place = [k for k, c in enumerate(t) for _ in c.encode()]
            for token in enc.encode_ordinary(t):
                span = [owner[c] for c in range(place[at], place[at + sizes[token] - 1] + 1)]
                n[span[0] if rule == "start" else max(sorted(set(span)), key=span.count)] += 1
                at += sizes[token]
            assert at == len(raw) and lines is not None
            want.append((str(i), len(t), sum(n), n))
        assert got == sorted(want)
    with pytest.raises(ValueError, match="rule"):
        tokencounts.count_tokens(frame(spark, rows), path, "none")


def test_token_attribution_of_fields_and_odd_bytes(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc, _ = tokencounts._encoding(path)
    raw = [(1, b"bad \xff\xfe end\n\xe4\xb8", b"tail"), (2, None, b""), (3, b"inter", b"national words"), (None, b"", b"only"), (3, b"x " * 50_000, None)]
    docs = spark.createDataFrame(raw, "doc_id long, text binary, title binary").selectExpr("doc_id", "cast(text as string) as text", "cast(title as string) as title")
    lines = {str(r["doc_id"]): r for r in tokencounts.count_tokens(docs.where("doc_id < 3"), path).collect()}
    read = raw[0][1].decode("utf-8", "replace")
    assert lines["1"]["n_chars"] == len(read) and lines["1"]["n_tokens"] == len(enc.encode_ordinary(read)) == sum(lines["1"]["section_tokens"]) and lines["1"]["n_sections"] == 2
    assert lines["2"][1:] == (0, 0, 0, 0, [])
    for rule in tokencounts.RULES:
        got = tokencounts.count_tokens(docs, path, rule, ["text", "title"]).collect()
        for (i, a, b), r in zip(raw, got, strict=True):
            parts, n, at = [(x or b"").decode("utf-8", "replace") for x in (a, b)], [0, 0], 0
            owner = [k for k, p in enumerate(parts) for c in p for _ in c.encode()]
            chars = [k for k, c in enumerate("".join(parts)) for _ in c.encode()]
            for token in enc.encode_ordinary("".join(parts)):
                size = len(enc.decode_single_token_bytes(token))
                held = {chars[j]: owner[j] for j in range(at, at + size)}
                n[owner[at] if rule == "start" else max(sorted(set(held.values())), key=list(held.values()).count)] += 1
                at += size
            assert r["doc_id"] == i and list(r["section_tokens"]) == n and r["n_tokens"] == sum(n) and r["n_sections"] == 2
    assert tokencounts.count_tokens(docs.limit(0), path).count() == 0


# --- 3 classifier


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.score_documents(docs, quality.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    odd = quality.score_documents(frame(spark, odd_rows()), quality.train(docs, labels.limit(0)))
    assert {r["score"] for r in odd.collect()} == {0.5} and odd.count() == len(odd_rows())


def test_additive_model_finds_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) != (x[:, 5] > 0.5)).astype(float)
    model = quality.fit_gam(x, y)
    assert (2, 5) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


# --- 4 mixing


def test_raking_meets_targets():
    rng = np.random.default_rng(2)
    codes = [np.repeat([0, 1, 2], 4), np.tile([0, 1, 2, 3], 3)]
    tokens = rng.integers(500, 1500, 12).astype(float)
    goals = [(lambda s: s / s.sum() * 0.5 * tokens.sum())(np.bincount(c, tokens) ** 0.9) for c in codes]
    w, rested = mixing.rake(tokens, codes, goals)
    assert rested and not mixing.rake(tokens, codes, goals, 1)[1] and (w <= tokens + 1e-9).all()
    for c, g in zip(codes, goals, strict=True):
        assert np.allclose(np.bincount(c, w), g, rtol=1e-5)


def mix_by_hand(rows, fraction, temper, wanted):
    """Probability of each cell by dictionary loops: rows of (source, lang, topic, tokens)."""
    held, every = defaultdict(float), sum(r[3] for r in rows)
    for r in rows:
        held[r[:3]] += r[3]
    goal = []
    for i, d in enumerate(mixing.DIMENSIONS):
        own = defaultdict(float)
        for c, t in held.items():
            own[c[i]] += t
        share = {v: wanted[d].get(v, 0.0) if d in wanted else t**temper if t else 0.0 for v, t in own.items()}
        goal.append((own, share))
    left_of_all = min(min(fraction * every, sum(t for v, t in own.items() if share[v])) for own, share in goal)
    for i, (own, share) in enumerate(goal):  # fill the scarcest value first; what it lacks is the others'
        left, shares, goal[i] = left_of_all, sum(share.values()), {}
        for v in sorted(own, key=lambda v: own[v] / share[v] if share[v] else math.inf):
            goal[i][v] = min(own[v], left * share[v] / shares) if share[v] else 0.0
            left, shares = left - goal[i][v], shares - share[v]
    u, w = dict(held), dict(held)
    for _ in range(200):
        before = dict(w)
        for i in range(3):
            for v, g in goal[i].items():
                mine = [c for c in u if c[i] == v]
                full = sum(held[c] for c in mine if u[c] >= held[c])
                free, now = sum(u[c] for c in mine if u[c] < held[c]), sum(min(u[c], held[c]) for c in mine)
                by = (g - full) / free if g > full and free else g / now if now else 0.0
                for c in mine:
                    u[c] = max(u[c], held[c]) if g >= sum(held[c] for c in mine) else u[c] * by
        w = {c: min(x, held[c]) for c, x in u.items()}
        if max(abs(w[c] - before[c]) for c in w) <= 1e-7 * max(1, *w.values()):
            break
    return {c: w[c] / held[c] if held[c] else 1.0 for c in held}, goal


@pytest.mark.parametrize("driver_cells", [100_000, 0])
def test_mix(spark, driver_cells):
    import re

    rows = odd_rows() + [(r[0] + 100, r[1]) for r in docs_of()]
    docs = frame(spark, rows)
    given = {"source": {"s0": 0.3, "s1": 0.7}}
    wanted = spark.createDataFrame([("source", "s0", 0.3), ("source", "s1", 0.7), ("source", "none", 0.0)], "dimension string, value string, share double")
    for tables, shares in ((None, {}), (wanted, given)):
        topic = F.when(F.length("text") % 3 == 0, "a").when(F.length("text") % 3 == 1, "b")
        mixed = mixing.with_mix(docs, "mix", topic, 0.4, 0.8, tables, driver_cells=driver_cells)
        got = mixed.collect()
        kind = lambda t: "(null)" if t is None or len(t) % 3 == 2 else "ab"[len(t) % 3]
        cells = [(f"s{(i or 0) % 2}", "en" if i != 3 else "(null)", kind(t), len(re.findall(mixing.WORD, t or ""))) for i, t in rows]
        prob, goal = mix_by_hand(cells, 0.4, 0.8, shares)
        assert Counter((str(r["doc_id"]), *r["mix"][:4], round(r["mix"]["prob"], 5)) for r in got) == Counter((str(i), *c, round(prob[c[:3]], 5)) for (i, _), c in zip(rows, cells, strict=True))
        for r in mixing.mix_report(mixed, "mix", 0.4, 0.8, tables).collect():
            d = mixing.DIMENSIONS.index(r["dimension"])
            mine = [(c[3], prob[c[:3]]) for c in cells if c[d] == r["value"]]
            assert abs(r["goal"] - goal[d][r["value"]]) < 1e-3 and abs(r["expected"] - sum(n * p for n, p in mine)) < 1e-2 and abs(r["expected"] - r["goal"] - r["residual"]) < 1e-6


def test_goals_pass_on_what_a_value_lacks(spark):
    rows = spark.createDataFrame([("topic", "a", 10), ("topic", "b", 100), ("topic", "c", 100), ("topic", "none", 0), ("lang", "x", 150), ("lang", "y", 60)], "dimension string, value string, tokens long")
    table = spark.createDataFrame([("topic", "a", 0.5), ("topic", "b", 0.25), ("topic", "c", 0.25)], "dimension string, value string, share double")
    goal = {r["value"]: r["goal"] for r in mixing.targets_of(rows, 0.5, 1.0, table).collect()}
    assert goal == pytest.approx({"a": 10, "b": 47.5, "c": 47.5, "none": 0, "x": 75, "y": 30})
    goal = {r["value"]: r["goal"] for r in mixing.targets_of(rows, 0.5, 1.0, table.where("value = 'a'")).collect()}
    assert goal == pytest.approx({"a": 10, "b": 0, "c": 0, "none": 0, "x": 10 * 150 / 210, "y": 10 * 60 / 210})  # all that has a share
    assert mixing.targets_of(rows.limit(0), 0.5, 1.0, None).count() == 0


def test_the_documents_mix_meets_its_goals(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.with_mix(docs, "mix", keep=["doc_id"])
    assert mixed.where("not mix.rested").isEmpty()
    for r in mixing.mix_report(mixed, "mix").collect():
        assert abs(r["residual"]) <= 1e-3 * max(r["goal"], 1), r


def test_mix_keeps_by_probability(spark):
    rows = odd_rows() + [(r[0] + 100, r[1]) for r in docs_of()]
    docs = frame(spark, rows)
    out, mixed = mixing.sample(docs), mixing.with_mix(docs, "text", keep=["doc_id", "text", "row"])
    assert mixed.columns == ["doc_id", "row", "text"] and mixed.count() == len(rows)
    assert out.columns == docs.columns and out.count() == mixed.where("text.kept").count()
    alike = defaultdict(set)
    for r in mixed.collect():
        alike[r["doc_id"], *r["text"][:3]].add(r["text"]["kept"])
    assert all(len(v) == 1 for v in alike.values())
    assert mixing.sample(docs.limit(0)).count() == 0


# --- 5 repeated passages


def removed_by_hand(docs, n):
    count = Counter(t[i : i + n] for _, t in docs for i in range(len(t) - n + 1))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        left = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((str(d), len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"bucket": 1}, {"bucket": 2, "bin_size": 3}])
def test_repeats(spark, sizes):
    rnd = random.Random(5)
    common = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(10, 60))) for _ in range(6)]
    rows = [(i, "".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    rows += [(5, rows[5][1]), (90, rows[7][1]), (91, ""), (92, None), (None, rows[3][1]), (93, "a" * 100), (94, "ab" * 50)]
    got = suffixdup.remove_repeats(frame(spark, rows), 20, 8, **sizes).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), "kept_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == removed_by_hand([(d, (t or "").encode()) for d, t in rows], 20)
    cut = suffixdup.without_repeats(frame(spark, rows), 20, 8, **sizes)
    assert cut.columns == frame(spark, rows).columns and cut.count() == len(rows)
    assert cut.where("n_chars <> length(text)").count() == 0 and cut.where("text is null").count() == 1


def test_repeats_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(tuple(str(r[c]) for c in cols) for r in suffixdup.op5_suffix_array_dedup(spark, SF).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(cols)} from ({suffixdup.OP5_SQL})").fetchall())


def test_suffix_buckets():
    rnd = random.Random(1)
    for _ in range(20):
        parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))).encode() for _ in range(6)]
        data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        p = suffixdup.bucket_pointer_refine(data, ends, 8, 16)
        raw = data.tobytes()
        keys = [raw[i : ends[i]] for i in range(len(raw))]
        order = np.argsort(p, kind="stable").tolist()
        assert all(p[i] == p[j] or keys[i] < keys[j] or keys[i] == keys[j] for i, j in zip(order, order[1:], strict=False))
        assert all(keys[i][:16] == keys[j][:16] for i, j in zip(order, order[1:], strict=False) if p[i] == p[j])


# --- 6 packing


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path, rnd = packing.tokenizer_file(), random.Random(3)
    plain, cached = Tokenizer.from_file(path), WordEncoder(path, 2000)
    signs = "aZé1ß'sΣİ²½ \n\t\x0b\x1c\x85\xa0́eÅ中文<|endoftext|>don't _-!😀ﬁ\x00\x7f\xad"
    texts = [r[1] for r in docs_of()] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for t, ids in zip(texts, cached.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rows = odd_rows() + [(r[0] + 100, r[1]) for r in docs_of()]
    got = packing.pack_documents(frame(spark, rows), packing.tokenizer_file()).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    enc = WordEncoder(packing.tokenizer_file())
    want = Counter()
    for (i, _), ids in zip(rows, enc.encode([(t or "").encode() for _, t in rows]), strict=True):
        ids += b"\0\0\0\0"
        for k in range(0, len(ids) // 4, 2048):
            part = ids[4 * k : 4 * (k + 2048)]
            want[(i, k // 2048, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len(by) <= packing.lower_bound(np.array([r["length"] for r in got])) + 1
    assert packing.pack_documents(frame(spark, []), packing.tokenizer_file()).count() == 0


def test_ids_of_odd_bytes_and_other_files(spark):
    from tokenizers import Tokenizer

    raw = [b"ok \xff\xfe word", b"\xe4\xb8 cut", b"", b"a\xc3", None]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    other = packing.tokenizer_file("byte_bpe_50k.json")
    for path in (packing.tokenizer_file(), other):
        plain = Tokenizer.from_file(path)
        want = sorted((i, zlib.crc32(np.array([*plain.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in enumerate(raw))
        assert sorted((r["doc_id"], r["ids_crc32"]) for r in packing.pack_documents(docs, path).collect()) == want


@pytest.mark.parametrize("bucket_items", [100, 1000, 16_384])
def test_exchange_between_buckets(spark, bucket_items):
    sizes = [int(x) for x in np.random.default_rng(4).integers(1, 2049, 3000)]
    own = "uid long, length long, bucket string, fill int, gap int, OFFSET long"
    pieces = spark.createDataFrame([(i, n, f"b{i}", i, -i, 5) for i, n in enumerate(sizes)], own)
    packed = packing.pack(pieces, bucket_items=bucket_items)
    got = packed.collect()
    assert packed.columns == ["uid", "length", "bucket", "fill", "gap", "sequence_id", "offset"]
    assert sorted(r[:5] for r in got) == [(i, n, f"b{i}", i, -i) for i, n in enumerate(sizes)]
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    bound = packing.lower_bound(np.array(sizes))
    assert packing.certificate(packed).first()[:] == (len(by), bound, len(by) - bound)
    assert len(by) <= bound * (1.06 if bucket_items == 100 else 1.02)
    alone = sum(packing.best_fit_decreasing(np.array(sizes[i : i + bucket_items]))[0].max() + 1 for i in range(0, 3000, bucket_items))
    assert len(by) <= alone * 1.01


def test_bound_never_exceeds_packing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 21, rng.integers(0, 30))
        bins, offsets = packing.best_fit_decreasing(sizes, 20)
        assert packing.lower_bound(sizes, 20) <= (bins.max() + 1 if len(bins) else 0)


# --- 7 HTML


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("<p>a<p>b &amp; <b>c</b>d", "a\n\nb & cd"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>end", "- one\n- two\n  3. x\n  4. y\n\nend"),
        ("<table><tr><td>a<td>long<tr><td>bbb<td>c</table>z", "a    long\nbbb  c\n\nz"),
        ("<div hidden>no</div><div style='display: none'>no</div><script>no</script><style>no</style>yes", "yes"),
        ("<title>no</title>a<br>b<!-- no -->c", "a\nbc"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<blockquote>q<br>r</blockquote>", "> q\n> r"),
        ("a < b & c <", "a < b & c <"),
        ("</p>x</br>y", "x\ny"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("x <b> y</b> z", "x y z"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>", "a  b\n   c  d"),
        ("<table><tr><td>a<td colspan=2>wide one<tr><td rowspan=0>b<td>c<td>d<tr><td>e<td colspan=99999999999>f</table>", "a  wide one\nb  c  d\n   e  f"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<style>/* p{} */ .h, p#i.x {display:none} .v{display:block} @media print{.p{display:none}} a b{display:none}</style><p class='a h'>no<p class=p>yes<p id=i class=x>no<p id=i>two<p class='h v'>three", "yes\n\ntwo\n\nthree"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>x<p hidden>no", "x"),
        ("<svg><title>no</title><text>label</text></svg><math><mi>x</mi></math>", "labelx"),
        ("<select><option>one<option>two</select><input value=go type=submit><input type=hidden value=no>", "one\ntwo\ngo"),
        ("<a href=\"x>text</a> more", "text more"),
        ("<a title=\"a > b\" x='>' y=\">c", "c"),
        ("a</ b>c<!-->d<? e >f<!doctype html>g", "acdfg"),
    ],
)
def test_render(source, text):
    assert htmltext.render(source) == text


@pytest.mark.parametrize("part", ["<a x=\"", "<a x='\" ", "<a \"'", "<!--", "</", "<a x=\"'>", "<p", "<td>", "<style>p{", "<li><ul>", "&amp", "<!", "<select><option>"])
def test_odd_pages_take_little_time(part):
    import time

    began = time.process_time()
    htmltext.render(part * (1_000_000 // len(part)))
    assert time.process_time() - began < (2 if "\"" in part else 20)


def test_cells_lie_below_their_columns():
    """Against a plain grid of taken places: each cell's text starts where its first column does."""
    rnd = random.Random(8)
    for _ in range(200):
        rows = [[([f"{r}.{c}" * rnd.randint(1, 3)], rnd.randint(1, 3), rnd.randint(1, 3)) for c in range(rnd.randint(0, 4))] for r in range(5)]
        taken, want = set(), {}
        for r, row in enumerate(rows):
            col = 0
            for lines, across, down in row:
                while (r, col) in taken:
                    col += 1
                want[lines[0], r] = col
                taken |= {(r + i, col + j) for i in range(down) for j in range(across)}
                col += across
        out = htmltext.lay_out(rows)
        filled = [r for r, row in enumerate(rows) if row]
        place: dict[int, int] = {}
        for line, r in zip(out, filled, strict=True):
            cells = [(lines[0], want[lines[0], r]) for lines, _, _ in rows[r]]
            assert line.split() == [t for t, _ in cells]
            at = 0
            for t, col in cells:
                at = line.index(t, at)
                assert place.setdefault(col, at) == at
                at += len(t)
        assert [place[c] for c in sorted(place)] == sorted(place.values())


def test_pages(spark):
    rows = [(1, None, "u"), (None, "<p>x", "u"), (2, "<div>" * 3000 + "deep", "u"), (2, "<div>" * 3000 + "deep", "u")]
    got = Counter((r["page_id"], r["text"]) for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect())
    assert got == {(1, ""): 1, (None, "x"): 1, (2, "deep"): 2}


# --- 8 near duplicates


def near_by_hand(rows):
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    sets = [set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) > 4 else {tuple(w)} - {()} for w in words]
    near = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    group, out = {}, []
    for i in range(len(rows)):
        todo = [] if i in group else [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = i
                todo += near[x]
    ids = defaultdict(list)
    for i, g in group.items():
        if rows[i][0] is not None:
            ids[g].append(rows[i][0])
    for i, (d, _) in enumerate(rows):
        out.append((str(d), str(min(ids[group[i]], default=None) if sets[i] else d), len(near[i])))
    return sorted(out)


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, block):
    rnd = random.Random(6)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(40, 120))] for _ in range(4)]
    rows = odd_rows()
    for k in range(40):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 9)}"
        rows.append((100 + k, " ".join(w)))
    docs = frame(spark, rows)
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in neardup.near_duplicates(docs, block=block).collect())
    assert got == near_by_hand(rows)
    if block == 512:
        one = neardup.keep_one(docs)
        assert one.columns == docs.columns
        assert len({r["class_id"] for r in neardup.near_duplicates(docs).where("root is not null").collect()}) == one.where("trim(text) rlike '[^ \\n\\t]'").count()
        assert neardup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block,grams,part", [(512, 2_000_000, 250_000), (16, 2_000_000, 0), (512, 700, 0)])
def test_near_duplicates_along_a_chain(spark, block, grams, part):
    words = [f"w{i}" for i in range(60 * 4 + 120)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 120])) for i in range(60)] + [(900 + i, " ".join(words[:8] * 3_000)) for i in range(2)]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in neardup.near_duplicates(frame(spark, rows), block=block, grams=grams, part=part).collect())
    assert got == near_by_hand(rows)


def test_blocks_of_a_chain_meet_few_others(spark):
    words = [f"w{i}" for i in range(400 * 4 + 120)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 4 : i * 4 + 120])) for i in range(400)], "doc_id long, text string")
    bands, rows = neardup.bands_for(0.8, 0.999, 320)
    _, same = neardup.classes(docs, 5, bands * rows)
    groups, shared = neardup.candidate_groups(same, bands, rows)
    met = neardup.meetings(groups, shared, same, bands, rows, 32, 2_000_000)
    assert groups.select("root").distinct().count() == 1
    assert met.count() < 400 * 20  # all blocks of a group of 400 meeting would be far more
    assert met.select("cid").distinct().count() == 400


def test_bands_reach_recall():
    bands, rows = neardup.bands_for(0.8, 0.999, 320)
    assert bands * rows <= 320 and 1 - (1 - 0.8**rows) ** bands >= 0.999


# --- 9 search


def search_by_hand(rows, k=10):
    """query, rank, document and score by scoring every pair; queries are distinct rows whose id divides by 20."""
    count = [Counter(search.TERM.findall((t or "").lower())) for _, t in rows]
    size = [sum(c.values()) for c in count]
    mean, df = sum(size) / len(rows), Counter(t for c in count for t in c)
    out = []
    for q in dict.fromkeys(r for r in rows if r[0] is not None and r[0] % 20 == 0):
        score, asked = [], Counter(search.TERM.findall((q[1] or "").lower()))
        for (d, _), c, n in zip(rows, count, size, strict=True):
            s = sum(k * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t, k in asked.items() if t in c)
            if s > 0:
                score.append((-round(s, 6), d is None, d or 0, d))
        out += [(q[0], rank, s[3], round(-s[0], 4)) for rank, s in enumerate(sorted(score)[:k], 1)]
    return sorted(out, key=str)


def found_by(df):
    return sorted(((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 4)) for r in df.collect()), key=str)


def test_search_is_exact(spark):
    rows = [(i, t) for i, t in odd_rows() if i is not None] + [(None, "word1 word2")] + [(r[0] + 100, r[1]) for r in docs_of()[:120]]
    rows += [(300 + i, "word5 word6 word7") for i in range(60)] + [(400, " ".join(f"long{i % 9000}" for i in range(60_000)))]
    want = search_by_hand(rows)
    for shard in (8192, 20):
        assert found_by(search.search(frame(spark, rows), F.col("doc_id") % 20 == 0, shard=shard)) == want
    assert search.search(frame(spark, []), F.lit(True)).count() == 0
    assert search.search(frame(spark, [(20, None), (40, " ")]), F.lit(True)).count() == 0
    raw = spark.createDataFrame([(20, b"a \xff b"), (21, b"\xff"), (22, b"b")], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    assert [r[:3] for r in found_by(search.search(raw, F.col("doc_id") == 20))] == [(20, 1, 20), (20, 2, 22)]


@pytest.mark.parametrize("texts", [["the same words"] * 90, ["the same words", "the same", "words the"] * 40, [f"the the the {'a ' * (i % 7)}" for i in range(400)]])
def test_search_of_common_terms_only(spark, texts):
    rows = list(enumerate(texts))
    for shard in (8192, 30):
        assert found_by(search.search(frame(spark, rows), F.col("doc_id") % 20 == 0, shard=shard)) == search_by_hand(rows)


def stored(texts):
    import pickle

    import pandas as pd

    t = [search.terms(x.encode()) for x in texts]
    pdf = pd.DataFrame({"doc_id": range(len(t)), "text_hash": 0, "terms": [a for a, _ in t], "counts": [c for _, c in t], "size": [int(c.sum()) for _, c in t], "shard": 0})
    _, rank, sizes, *parts = pickle.loads(search._store(pdf)["blob"][0])
    return search.Shard(rank, sizes, *parts, sizes.mean())


def test_search_ties_beyond_one_block():
    rng = np.random.default_rng(3)
    kinds = [f"p{k} q{k} r{k}" for k in range(12)]
    texts = [f"x{i} y{i % 997} z" for i in range(6000)]
    for k, text in enumerate(kinds):
        at = rng.permutation(6000)[:320]
        for i in at[:300]:
            texts[i] = text
        for i in at[300:]:  # raise the bounds of some blocks, so these come first, but score less than a copy
            texts[i] = f"p{k} p{k}"
    shard = stored(texts)
    for weight in (1.0, 2.3456781, 3.1415926, 7.7777777):
        asked = search.Asked.of([(k, ids, counts * weight) for k, (ids, counts) in enumerate(search.terms(x.encode()) for x in kinds)])
        for text, (place, found) in zip(kinds, shard.search(asked, np.zeros(len(kinds)), 10), strict=True):
            assert len(set(found)) == 1
            assert shard.rank[place].tolist() == [i for i, x in enumerate(texts) if x == text][:10]


def test_search_keeps_ties_of_one_text_at_any_place():
    shard = stored(["one two"] * 640)
    asked = search.Asked.of([(0, ids, counts * 1.2345678) for ids, counts in [search.terms(b"one two")]])
    for k in (1, 7):
        (place, _), floor = shard.search(asked, np.zeros(1), k)[0], np.zeros(1)
        assert shard.rank[place].tolist() == list(range(k))
        shard.search(asked, floor, k)
        (again, _) = shard.search(asked, floor, k)[0]  # a floor that copies just reach leaves them in
        assert shard.rank[again].tolist() == list(range(k))


def test_search_prunes_blocks(monkeypatch):
    """Alike documents lie together, so a query of one kind scores few blocks of the others, with few runs held at a time too."""
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{j}" for j in range(i % 5, 20)) for i in range(4096)]
    shard = stored(texts)
    asked = search.Asked.of([(i, ids, counts * 1.0) for i, (ids, counts) in enumerate(search.terms(texts[i].encode()) for i in range(40))])
    many = shard.search(asked, np.zeros(40), 10)
    monkeypatch.setattr(search, "RUNS", 10)
    few = shard.search(asked, np.zeros(40), 10)
    for q in range(40):
        assert many[q][0].tolist() == few[q][0].tolist()
        assert shard.rank[many[q][0]].tolist() == [i for i in range(4096) if texts[i] == texts[q]][:10]


# --- 10 URL filter


def test_url_filter(spark):
    rows = [(1, None), (2, "nothing"), (3, "http://A.Net"), (4, "http://a.net/x"), (5, "https://www.Example.net/en/1?a#b"), (6, "http://example.com/de/1"), (7, "http://x.org/fr/?utm_source=1"), (8, "http://y.com/1?utm_source=f"), (9, "http://y.com/1"), (None, "ftp://y.com/2#utm_source="), (9, "http://y.com/1"), (11, "http://?q"), (12, "http://notnet/")]
    docs = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in urlfilter.judge_urls(docs, F.col("url").rlike(urlfilter.TRACKING)).collect())
    want = [(1, "", "", "", "allow"), (2, "", "", "", "allow"), (3, "a.net", "", "", "allow"), (4, "a.net", "/x", "net/", "block"), (5, "www.example.net", "/en/1", "example.net/en/", "allow"), (6, "example.com", "/de/1", "example.com/de/", "block"), (7, "x.org", "/fr/", "org/fr/", "allow"), (8, "y.com", "/1", "", "block"), (9, "y.com", "/1", "", "block"), (None, "y.com", "/2", "", "allow"), (9, "y.com", "/1", "", "block"), (11, "", "", "", "allow"), (12, "notnet", "/", "", "allow")]
    assert got == sorted((str(w[0]), *w[1:]) for w in want)
    for bits in (5, 12):
        dealt = urlfilter.judge_urls(docs, F.col("url").rlike(urlfilter.TRACKING), max_bits=bits)
        assert sorted((str(r["page_id"]), r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in dealt.collect()) == got
    long_ = spark.createDataFrame([(1, "http://h.com/" + "p" * 100_000 + "?utm_source=1"), (2, "http://h.com/" + "p" * 100_000), (3, "http://h.com/" + "p" * 99_999)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(long_, F.col("url").rlike(urlfilter.TRACKING)).collect()} == {1: "block", 2: "block", 3: "allow"}
    assert urlfilter.judge_urls(docs.limit(0), F.lit(True)).count() == 0


def test_plan_of_many_cascades_is_as_small_as_of_one(spark):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://h', id % 150, '.com/', id % 7, if(id % 3 = 0, '?utm_source=x', '')) as url")
    listed = F.col("url").rlike(urlfilter.TRACKING)
    one = urlfilter.judge_urls(pages, listed)
    many = urlfilter.judge_urls(pages, listed, max_bits=1 << 8)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert len(plan(many)) < 1.2 * len(plan(one))
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(tuple(str(r[c]) for c in cols) for r in urlfilter.op10_url_filter(spark, SF).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(cols)} from ({urlfilter.OP10_SQL})").fetchall())


# --- pipeline and registry


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    cols, n = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, SF), name)
        assert docs.columns == cols and 0 < docs.count() <= n
        n = docs.count()
    got = cp.STAGES[-1][1](spark, docs, SF)
    assert got.select("doc_id").distinct().count() == n
    assert sorted(map(str, got.drop("sequence_id", "offset").collect())) == sorted(map(str, cp.run(spark, SF).drop("sequence_id", "offset").collect()))


def test_registry():
    assert len(registry.queries()) == 13 and set(registry.oracle_sql()) <= set(registry.queries())

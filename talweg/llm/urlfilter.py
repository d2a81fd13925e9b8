"""URL rules and a Bloom filter cascade, in DataFrame functions only (operator 10)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import discard, materialize, shared_dir, table

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A URL whose query names this parameter puts its host and path on the list.
TRACKING = r"[?&]utm_source="
#: Bits of a level for each of its keys (about one key in a hundred is mistaken) and bits that a key sets.
BITS_PER_KEY, BITS_OF_KEY = 12, 4
#: Bits of one cascade's first level at most on average (32 MB): a longer list is dealt by key to several cascades.
MAX_BITS = 1 << 28


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (after the first ://, A-Z lower-cased) and ``path`` (up to ? or #).

    Null, or no ://: both are empty.
    """
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return urls.withColumns({"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and as verdict; null if none. Equally long ones: the first given."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


@dataclass
class Level:
    """One blocked Bloom filter: a one-row table ``words`` (array of 64-bit words), its number and how many words."""

    words: DataFrame
    number: int
    size: int

    def place(self, key: Column) -> Column:
        """The word of a key."""
        return F.pmod(F.xxhash64(key, F.lit(2 * self.number)), F.lit(self.size)).cast("int")

    def mask(self, key: Column) -> Column:
        """The bits of a key in its word: ``BITS_OF_KEY`` slices of a second hash."""
        h = F.xxhash64(key, F.lit(2 * self.number + 1))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(BITS_OF_KEY)]
        return reduce(Column.bitwiseOR, bits)

    def has(self, key: Column) -> Column:
        """Whether the filter takes the key for one of its own; the words are a scalar, read once a query."""
        return F.get(self.words.select("words").scalar(), self.place(key)).bitwiseAND(self.mask(key)) == self.mask(key)


def build_level(keys: DataFrame, n: int, number: int, bits_per_key: int) -> Level:
    """Bloom filter of the ``n`` rows of ``keys`` (column ``key``): masks are or-ed per word before and after one shuffle."""
    level = Level(keys, number, -(-n * bits_per_key // 64))
    put = keys.select(level.place(F.col("key")).alias("word"), level.mask(F.col("key")).alias("bits"))
    empty = keys.sparkSession.range(level.size).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = put.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    level.words = materialize(words, "bloom")
    return level


def build_cascade(universe: DataFrame, bits_per_key: int = BITS_PER_KEY) -> list[Level]:
    """Levels over ``universe`` (distinct ``key``, boolean ``listed``).

    Level 0 holds the listed keys, level 1 the unlisted keys that level 0 takes for listed,
    level 2 the listed keys that level 1 takes for unlisted, and so on until nothing is mistaken.
    No listed keys: no levels, and nothing is a member.
    """
    levels: list[Level] = []
    made: list[DataFrame] = []
    side, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
    while n := side.count():
        level = build_level(side, n, len(levels), bits_per_key)
        levels.append(level)
        side, other = materialize(other.where(level.has(F.col("key"))), "mistaken"), side
        made.append(side)
    discard(*made)
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe: the first level without it decides by its parity."""
    out = F.when(F.lit(False), False)
    for level in levels:
        out = out.when(~level.has(key), level.number % 2 == 1)
    return out.otherwise(len(levels) % 2 == 1)


def judge_urls(pages: DataFrame, listed: Column, rules: tuple = RULES, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages`` (``page_id``, ``url``).

    ``listed`` is a condition on ``url``: if any row of a key (host and path) meets it, the key is
    on the list. A rule that fits gives the verdict; else listed keys are blocked and others allowed.
    A null url, or one without ://, has the empty key and no rule. Repeated rows are each judged, a null
    page_id as any other; URLs may have any length; empty tables give no rows; other columns are not read.

    The keys are dealt by hash to as many cascades as ``max_bits`` asks for. One after another they judge the rows of their own
    keys, which are written, and are deleted: what driver and tasks hold, and the size of a plan, don't depend on how many there are.
    """
    spark = pages.sparkSession
    rows = with_parts(pages.select("page_id", "url", listed.alias("listed")))
    rows = rows.withColumn("key", F.concat("host", "path"))
    universe = materialize(rows.groupBy("key").agg(F.coalesce(F.bool_or("listed"), F.lit(False)).alias("listed")), "keys")
    parts = max(1, -(-universe.where("listed").count() * bits_per_key // max_bits))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)).cast("int").alias("part")
    rows, keys = rows.select("page_id", "host", "path", "key", part), universe.select("*", part)
    if parts > 1:  # a folder for each, so each is read once
        rows, keys = materialize(rows, "rows", "part"), materialize(keys, "parts", "part")
    at = f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    for k in range(parts):
        levels = build_cascade(keys.where(F.col("part") == k), bits_per_key)
        hit = rows.where(F.col("part") == k).withColumn("hit", member(levels, F.col("key")))
        out = hit.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
        out.write.parquet(f"{at}/cascade={k}")
        if levels:
            discard(*(x.words for x in levels))
    discard(universe, *([rows, keys] if parts > 1 else []))
    return spark.read.schema(out.schema).parquet(at).select("page_id", "host", "path", "rule", "verdict")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge_urls`` over all of ``pages``; keys of tracked URLs are listed."""
    return judge_urls(table(spark, sf_dir, "pages"), F.col("url").rlike(TRACKING))


OP10_SQL = """
with parts as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
listed as (select host || path as key, bool_or(coalesce(regexp_matches(url, '[?&]utm_source='), false)) as hit from split group by 1),
ruled as (
  select *, case
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from split)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when hit then 'block' else 'allow' end as verdict
from ruled join listed on key = host || path
"""

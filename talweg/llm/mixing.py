"""Mixing sources to target weights by iterative proportional fitting (operator 4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import discard, free_name, materialize, table

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens to keep, and the power that flattens each marginal's own shares into targets.
FRACTION, TEMPER = 0.75, 0.8
#: Cells that are raked on the driver at most (a few tens of bytes each); more are raked by Spark, to the same weights.
DRIVER_CELLS = 100_000
ROUNDS, TOLERANCE, SEED = 200, 1e-7, 11
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A topic by the shape of a text: tables, shouting, marked-up words, and prose by length; null text: none."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|")))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&<>", ""))
    return (
        F.when(text.isNull(), "none")
        .when(bars * 4 >= n_tokens + 1, "table")
        .when((F.upper(text) == text) & (F.lower(text) != text), "shout")
        .when(marks * 2 >= n_tokens + 1, "marked")
        .when(n_tokens < 150, "short")
        .when(n_tokens < 1000, "article")
        .otherwise("long")
    )


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, bool]:
    """Weights of the cells whose marginal sums meet ``targets``, none over its ``tokens``, and whether they came to rest.

    A cell's weight is its own product of factors, cut to what it holds. Each round sets the factors of one
    marginal after another: cells that are full count with what they hold, the others are scaled to the rest of the
    target; where the full ones alone pass it, all are scaled down. A value whose target is all it holds is
    filled. Cells without tokens stay 0. Where the targets can't be met the last round stands.
    """
    w = u = tokens.astype(float)
    for _ in range(rounds):
        before = w
        for code, target in zip(codes, targets, strict=True):
            sums = (np.bincount(code, weights=x, minlength=len(target)) for x in (tokens, np.where(u >= tokens, tokens, 0), np.where(u >= tokens, 0, u), np.minimum(u, tokens)))
            every, held, free, now = sums
            over = np.divide(target, now, out=np.zeros(len(target)), where=now > 0)
            by = np.where((target > held) & (free > 0), np.divide(target - held, free, out=np.zeros(len(target)), where=free > 0), over)
            u = np.where((target >= every)[code], np.maximum(u, tokens), u * by[code])
        w = np.minimum(u, tokens)
        if np.abs(w - before).max(initial=0) <= tolerance * max(w.max(initial=0), 1):
            return w, True
    return w, False


def targets_of(marginals: DataFrame, fraction: float, temper: float, wanted: DataFrame | None) -> DataFrame:
    """``marginals`` (``dimension, value, tokens``) with ``goal``, the tokens that each value should have, written.

    Shares come from ``wanted`` (``dimension, value, share``) for the dimensions it names, 0 for values it lacks, and
    else from the value's own tokens to the power ``temper``. No goal passes what its value has: what a value lacks goes
    to the others of its dimension by their shares. All dimensions' goals come to one sum, ``fraction`` of all tokens, or
    less where the values with a share hold less.
    """
    own = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(temper))).otherwise(0.0)
    if wanted is None:
        rows = marginals.withColumn("share", own)
    else:
        given = wanted.groupBy("dimension", F.coalesce(F.col("value").cast("string"), F.lit("(null)")).alias("value")).agg(F.sum("share").cast("double").alias("share"))
        named = given.select("dimension", F.lit(True).alias("named")).distinct()
        rows = marginals.join(given, ["dimension", "value"], "left").join(named, "dimension", "left")
        rows = rows.withColumn("share", F.when(F.col("named"), F.coalesce("share", F.lit(0.0))).otherwise(own)).drop("named")
    rows = materialize(rows.select("dimension", "value", "tokens", "share"), "shares")
    sums = rows.groupBy("dimension").agg(F.sum("tokens").alias("every"), F.sum(F.when(F.col("share") > 0, F.col("tokens")).otherwise(0)).alias("reach"), F.sum("share").alias("shares")).collect()  # a row a dimension
    total = float(min((min(fraction * r["every"], r["reach"]) for r in sums), default=0.0))
    level = {r["dimension"]: total / r["shares"] if r["shares"] else 0.0 for r in sums}
    while True:
        at = F.coalesce(*(F.when(F.col("dimension") == d, F.lit(x)) for d, x in level.items()), F.lit(0.0)) * F.col("share")
        full = at >= F.col("tokens")
        now = rows.groupBy("dimension").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")).collect()
        risen = {r["dimension"]: max(level[r["dimension"]], (total - r["held"]) / r["open"]) if r["open"] else level[r["dimension"]] for r in now}
        if all(risen[d] <= x * (1 + 1e-12) for d, x in level.items()):
            return rows.select("dimension", "value", "tokens", F.least(at, F.col("tokens").cast("double")).alias("goal"))
        level = risen


def marginals_of(cells: DataFrame, dims: list[str], *more: Column) -> DataFrame:
    """``dimension, value, tokens`` of cells, and more sums over them."""
    values = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims)))
    return cells.withColumn("m", values).groupBy("m.dimension", "m.value").agg(F.sum("tokens").alias("tokens"), *more)


def rake_frames(cells: DataFrame, dims: list[str], goals: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, bool]:
    """``rake`` for any number of cells: one aggregation and join for each marginal, a written table for each round."""
    tokens, u = F.col("tokens").cast("double"), F.col("u")
    now = materialize(cells.withColumn("u", tokens), "cells")
    rested = False
    for _ in range(rounds):
        step = now.withColumn("before", F.least("u", tokens))
        for d in dims:
            goal = goals.where(F.col("dimension") == d).select(F.col("value").alias(d), "goal")
            sums = step.groupBy(d).agg(F.sum(tokens).alias("every"), F.sum(F.when(u >= tokens, tokens).otherwise(0.0)).alias("held"), F.sum(F.when(u >= tokens, 0.0).otherwise(u)).alias("free"), F.sum(F.least(u, tokens)).alias("now"))
            by = F.when((F.col("goal") > F.col("held")) & (F.col("free") > 0), (F.col("goal") - F.col("held")) / F.col("free")).when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0)
            step = step.join(sums.join(goal, d).select(d, by.alias("by"), (F.col("goal") >= F.col("every")).alias("fill")), d)
            step = step.withColumn("u", F.when(F.col("fill"), F.greatest(u, tokens)).otherwise(u * F.col("by"))).drop("by", "fill")
        step = materialize(step, "cells")
        end = step.agg(F.max(F.abs(F.least(u, tokens) - F.col("before"))).alias("moved"), F.max(F.least(u, tokens)).alias("most")).first()
        discard(now)
        now = step.drop("before")
        now.stored_at = step.stored_at
        rested = end["moved"] is None or end["moved"] <= tolerance * max(end["most"], 1)
        if rested:
            break
    return now.select(*dims, "tokens", F.least(u, tokens).alias("w")), rested


def rake_rows(cells: DataFrame, dims: list[str], goals: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, bool]:
    """``rake_frames`` on the driver, for a number of cells that the caller has bounded; so are the goals."""
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in dims))
    goal = {(r["dimension"], r["value"]): r["goal"] for r in goals.collect()}
    codes, targets = [], []
    for d in dims:
        names = {v: k for k, v in enumerate(sorted({r[d] for r in rows}))}
        codes.append(np.array([names[r[d]] for r in rows], np.int64))
        targets.append(np.array([goal[d, v] for v in names], float))
    w, rested = rake(np.array([r["tokens"] for r in rows], float), codes, targets, rounds)
    return cells.sparkSession.createDataFrame([(*(r[d] for d in dims), r["tokens"], float(x)) for r, x in zip(rows, w, strict=True)], ", ".join(f"{d} string" for d in dims) + ", tokens long, w double"), rested


def with_mix(docs: DataFrame, name: str, topic: Column | None = None, fraction: float = FRACTION, temper: float = TEMPER, wanted: DataFrame | None = None, seed: int = SEED, driver_cells: int = DRIVER_CELLS, keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with a struct column ``name``: source, lang, topic, n_tokens, prob, weight, kept, rested.

    Tokens are blank-separated words. Token weights of the cells source x language x topic are raked
    to each marginal's target over ``fraction`` of all tokens: shares by the table ``wanted`` (``dimension, value, share``) for
    the dimensions it names, else tempered own shares, held to what each value has (``targets_of``). A cell's probability is its raked share of what it holds, so expected
    kept tokens meet the targets as far as the cells reach (``mix_report`` tells how far), and a document is kept if a hash of its doc_id
    falls below. Weight is 1 / prob, null where prob is 0; ``rested`` is false where ``rounds`` ended the raking before it came to rest. ``topic`` is a column of the caller's own, else the text's shape. Null attributes
    are the value "(null)"; a null doc_id is a value of its own; repeated rows are decided alike. Texts without words, null or
    empty, take their cell's probability, 1 if the cell has no tokens; a text of any length is counted whole. An empty table gives no rows. Columns of
    ``keep`` (else all) pass through, whatever their names, but one called ``name`` is set anew.

    Texts are read once: rows are written with their counts and read again for the verdict.
    """
    spark, dims = docs.sparkSession, list(DIMENSIONS)
    own = [c for c in keep or docs.columns if c.lower() != name.lower()]
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plain = [F.coalesce(F.col(d).cast("string"), F.lit("(null)")).alias(d) for d in ("source", "lang")]
    base = docs.select(F.struct(*(F.col(c) for c in own)).alias("row"), F.struct("doc_id", "text").alias("x"), *plain, n.alias("n_tokens"), *([F.coalesce(topic.cast("string"), F.lit("(null)")).alias("topic")] if topic is not None else []))
    if topic is None:
        base = base.withColumn("topic", topic_of(F.col("x.text"), F.col("n_tokens")))
    base = materialize(base.select("row", *dims, "n_tokens", F.xxhash64(F.col("x.doc_id").cast("string"), F.lit(seed)).alias("even")), "mix")
    cells = materialize(base.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "cells")
    goals = targets_of(marginals_of(cells, dims), fraction, temper, wanted)
    few = cells.count() <= driver_cells
    raked, rested = (rake_rows if few else rake_frames)(cells, dims, goals, rounds)
    prob = raked.select(*dims, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("prob"))
    out = base.join(F.broadcast(prob) if few else prob, dims)  # few: the cells' number has just been checked
    even = F.shiftrightunsigned(F.col("even"), 11) * F.lit(2.0**-53)
    mix = F.struct(*dims, "n_tokens", "prob", (1 / F.when(F.col("prob") > 0, F.col("prob"))).alias("weight"), (even < F.col("prob")).alias("kept"), F.lit(rested).alias("rested"))
    return out.select(*([F.col(f"row.`{c}`") for c in own] if own else []), mix.alias(name))


def mix_report(mixed: DataFrame, name: str, fraction: float = FRACTION, temper: float = TEMPER, wanted: DataFrame | None = None) -> DataFrame:
    """``dimension, value, tokens, goal, expected, kept, residual`` of what ``with_mix`` gave.

    Expected sums prob times tokens, kept the tokens of documents kept; residual is expected less
    goal, far from 0 where a value's cells hold too little.
    """
    rows = mixed.select(*(F.col(f"{name}.{d}").alias(d) for d in DIMENSIONS), F.col(f"{name}.n_tokens").alias("tokens"), (F.col(f"{name}.n_tokens") * F.col(f"{name}.prob")).alias("e"), F.when(F.col(f"{name}.kept"), F.col(f"{name}.n_tokens")).otherwise(0).alias("k"))
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.sum("e").alias("e"), F.sum("k").alias("k"))
    sums = marginals_of(cells, list(DIMENSIONS), F.sum("e").alias("expected"), F.sum("k").alias("kept"))
    goals = targets_of(sums.select("dimension", "value", "tokens"), fraction, temper, wanted)
    return goals.join(sums.drop("tokens"), ["dimension", "value"]).select("dimension", "value", "tokens", "goal", "expected", "kept", (F.col("expected") - F.col("goal")).alias("residual"))


def sample(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that the mix keeps, with their own columns."""
    name = free_name(docs, "mix")
    return with_mix(docs, name, **options).where(F.col(f"{name}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``with_mix`` over all of ``documents``: the verdict on each."""
    return with_mix(table(spark, sf_dir, "documents"), "mix", keep=["doc_id"]).select("doc_id", "mix.*")

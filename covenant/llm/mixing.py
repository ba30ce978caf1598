"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell of (source, language, topic). The cells' weights are
raked: each round scales them so that the marginals of one dimension after the
other meet their targets. A document's weight is its cell's scale; the chance of
sampling it is its weight times one factor, at most 1, such that the expected
tokens of the sample meet a budget. Whether a document is sampled depends only
on a hash of its id. DataFrame functions only.

Where a cell's chance is held at 1, ``sampled`` has less of it than the target,
and more of the others: only repeats can make up for it. ``copies`` repeats
documents instead (weight times the budget, rounded up or down by the same hash),
and its expected tokens have the raked weights exactly. `marginals` tells what
both give beside the targets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import materialize

#: What marks a topic in a text, first match first; the rest is "prose". The
#: tables have no topic of their own, so form stands for it.
TOPICS = (("license", "icensed under"), ("list", " | "), ("shout", "!! "), ("symbols", "%%% "))
DIMENSIONS = ("source", "lang", "topic")
#: Stands for a null in a dimension; null is a value of its own.
NOTHING = "\u0001null"
ROUNDS, ALPHA, SHARE, BITS = 8, 0.5, 0.5, 52
#: Rounds that one plan holds.
CHAIN = 2


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    """The topic of a text by what it holds; null and empty texts are "prose"."""
    found = F.lit("prose")
    for name, mark in reversed(topics):
        found = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(found)
    return found


def tokens_of(text: Column) -> Column:
    """Tokens as a quarter of the UTF-8 bytes, rounded up; null counts as empty."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) by a hash of ``key``; null counts as empty text."""
    told = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(told, 1, BITS // 4), 16, 10).cast("double") / float(1 << BITS)


def cells_of(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    return rows.groupBy(*dims).agg(F.sum("tokens").cast("double").alias("mass")).where("mass > 0")


def rake(cells: DataFrame, dims: Sequence[str] = DIMENSIONS, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """``cells (*dims, mass)`` with ``weight``, a share of 1 raked to targets.

    ``targets`` gives shares by dimension and value (scaled to sum to 1; values
    it lacks get 0). A dimension without any gets its own shares to the power
    ``alpha``: 1 keeps them, 0 makes them equal. Cells are the aggregate of all
    rows, so the windows here never see documents.
    """
    targets = targets or {}
    out, goals = cells, []
    for d in dims:
        goal = f"__goal_{d}"
        if d in targets:
            total = sum(targets[d].values())
            rule = F.lit(0.0)
            for value, share in targets[d].items():
                rule = F.when(F.col(d) == F.lit(value), F.lit(share / total)).otherwise(rule)
            out = out.withColumn(goal, rule)
        else:
            shares = cells.groupBy(d).agg(F.pow(F.sum("mass"), F.lit(alpha)).alias("__part"))
            whole = shares.agg(F.sum("__part")).first()[0] or 1.0
            out = out.join(shares.select(F.col(d).alias("__value"), (F.col("__part") / F.lit(whole)).alias(goal)), F.col(d) == F.col("__value")).drop("__value")
        goals.append(goal)
    total = cells.agg(F.sum("mass")).first()[0] or 1.0
    out = out.withColumn("weight", F.col("mass") / F.lit(total))
    for n in range(rounds):
        if n and n % CHAIN == 0:  # keep the plan short
            out = materialize(out, "mix-rake")
        for d, goal in zip(dims, goals, strict=True):
            held = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(goal) / held).otherwise(F.lit(0.0)))
    return out.drop(*goals)


def calibrate(raked: DataFrame, share: float) -> DataFrame:
    """``raked`` with ``scale`` (weight by mass, 1 on average) and ``chance``.

    The common factor solves sum(min(1, factor * scale) * mass) = share * total.
    Each step fixes the cells that have reached 1 and solves for the rest; these
    only grow in number, so the steps end: at a solution, after as many steps as
    there are cells at most. Two sums go to the driver per step.
    """
    total = raked.agg(F.sum("mass")).first()[0] or 0.0
    out = raked.withColumn("scale", F.col("weight") / F.col("mass") * F.lit(total))
    factor = share
    while True:
        full = F.col("scale") * F.lit(factor) >= 1
        fixed, rest = out.agg(F.coalesce(F.sum(F.when(full, F.col("mass"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("mass") * F.col("scale"))), F.lit(0.0))).first()
        after = max(factor, (share * total - fixed) / rest) if rest > 0 else factor
        if after <= factor * (1 + 1e-12):
            break
        factor = after
    return out.withColumn("chance", F.least(F.lit(1.0), F.col("scale") * F.lit(factor)))


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA, share: float = SHARE, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """``df`` with ``topic string, tokens long, scale double, chance double,
    sampled boolean, copies long``.

    ``sampled`` takes no document twice, so it falls short of targets that cells
    cannot supply; taking each document ``copies`` times does not.

    Null sources and languages are values of their own. Null and empty texts have
    no tokens, so they weigh nothing and are not sampled (scale and chance 0).
    Rows of equal id share their luck, so copies of a row stay together. An empty
    table gives an empty one; columns of ``df`` are passed on, except ones named
    like the added.
    """
    added = ("topic", "tokens", "scale", "chance", "sampled", "copies")
    rows = df.select(*(df[c] for c in df.columns if c not in added), topic_of(df[text]).alias("topic"), tokens_of(df[text]).alias("tokens"), F.coalesce(df[source], F.lit(NOTHING)).alias("__source"), F.coalesce(df[lang], F.lit(NOTHING)).alias("__lang"))
    dims = ("__source", "__lang", "topic")
    named = {{"source": "__source", "lang": "__lang"}.get(d, d): v for d, v in (targets or {}).items()}
    cells = materialize(cells_of(rows, dims), "mix-cells")
    chances = materialize(calibrate(materialize(rake(cells, dims, named, alpha, rounds), "mix-raked"), share).select(*dims, "scale", "chance"), "mix-chances")
    joined = rows.join(chances, list(dims), "left").drop("__source", "__lang")
    chance = F.coalesce("chance", F.lit(0.0))
    sampled = joined.withColumn("scale", F.coalesce("scale", F.lit(0.0))).withColumn("chance", chance).withColumn("sampled", uniform(F.col(key), seed) < F.col("chance"))
    rate = F.col("scale") * F.lit(share)
    return sampled.withColumn("copies", F.floor(rate) + (uniform(F.col(key), seed) < rate - F.floor(rate)).cast("long"))


def marginals(mixed: DataFrame, source: str = "source", lang: str = "lang") -> DataFrame:
    """``(dimension, value, own, target, sampled, short)`` of what `mix` returns:
    shares of the tokens as they are, as raked (which ``copies`` meets) and as
    expected of ``sampled``; ``short`` where the sample cannot meet the target."""
    parts = []
    for d in (source, lang, "topic"):
        sums = mixed.groupBy(F.col(d).cast("string").alias("value")).agg(F.sum("tokens").alias("own"), F.sum(F.col("tokens") * F.col("scale")).alias("target"), F.sum(F.col("tokens") * F.col("chance")).alias("sampled"))
        parts.append(sums.select(F.lit(d).alias("dimension"), "value", "own", "target", "sampled"))
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = Window.partitionBy("dimension")  # a row per value
    shares = sums.select("dimension", "value", *((F.col(c) / F.sum(c).over(of)).alias(c) for c in ("own", "target", "sampled")))
    return shares.withColumn("short", F.col("sampled") < F.col("target") - 1e-6)


def mix_sql(documents: str = "documents", alpha: float = ALPHA, share: float = SHARE, rounds: int = ROUNDS, seed: int = 1, steps: int = 12) -> str:
    """The same as DuckDB SQL: CTEs that end with ``mixed``."""
    topic = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPICS)
    parts = [
        f"mix_rows AS (SELECT *, CASE {topic} ELSE 'prose' END AS topic, CAST(coalesce(ceil(strlen(text) / 4.0), 0) AS BIGINT) AS tokens, coalesce(source, chr(1) || 'null') AS k_source, coalesce(lang, chr(1) || 'null') AS k_lang FROM {documents})",
        "mix_cells AS (SELECT k_source, k_lang, topic, CAST(sum(tokens) AS DOUBLE) AS mass FROM mix_rows GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    dims = ("k_source", "k_lang", "topic")
    for d in dims:
        parts.append(f"goal_{d} AS (SELECT {d}, part / sum(part) OVER () AS goal_{d} FROM (SELECT {d}, pow(sum(mass), {alpha}) AS part FROM mix_cells GROUP BY {d}))")
    parts.append(f"rake_0 AS (SELECT *, mass / (SELECT sum(mass) FROM mix_cells) AS weight FROM mix_cells {' '.join(f'JOIN goal_{d} USING ({d})' for d in dims)})")
    n = 0
    for _ in range(rounds):
        for d in dims:
            parts.append(f"rake_{n + 1} AS (SELECT * EXCLUDE (weight), weight * goal_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM rake_{n})")
            n += 1
    parts.append(f"scaled AS MATERIALIZED (SELECT k_source, k_lang, topic, mass, weight / mass * (SELECT sum(mass) FROM mix_cells) AS scale FROM rake_{n})")
    parts.append(f"factor_0 AS (SELECT CAST({share} AS DOUBLE) AS f)")
    for i in range(steps):
        parts.append(f"factor_{i + 1} AS (SELECT CASE WHEN r > 0 THEN greatest(f, ({share} * t - x) / r) ELSE f END AS f FROM (SELECT any_value(f) AS f, sum(mass) AS t, coalesce(sum(mass) FILTER (WHERE scale * f >= 1), 0) AS x, coalesce(sum(mass * scale) FILTER (WHERE scale * f < 1), 0) AS r FROM scaled, factor_{i}))")
    told = f"substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4})"
    parts.append(
        f"mixed AS (SELECT * EXCLUDE (k_source, k_lang), CAST(('0x' || {told}) AS BIGINT) / {float(1 << BITS)!r} < chance AS sampled FROM (SELECT r.*, coalesce(c.scale, 0) AS scale, coalesce(least(1.0, c.scale * (SELECT f FROM factor_{steps})), 0) AS chance FROM mix_rows r LEFT JOIN scaled c USING (k_source, k_lang, topic)))"
    )
    return ",\n".join(parts)

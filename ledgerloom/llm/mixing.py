"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how many times it is used on average. Among all rates under which
the groups (sources, and languages) have their target shares of the tokens, and the mean log length of
a token's document stays as it is, those are taken that are nearest to 1 in relative entropy over tokens.
They are exponential: ``rate = exp(a_source + b_lang + c * (log length - mean))``. The coefficients solve the
convex dual; each Newton iteration is one distributed pass that sums the dual's value, gradient and
curvature by cell of source and language. The rates are then rounded to whole copies at random, by a hash
of the document, so that each document's expected copies are its rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .workspace import free_name, written

TEMPERATURE_SOURCE, TEMPERATURE_LANG, ITERATIONS, TOLERANCE, SEED = 0.5, 0.8, 60, 1e-9, 17
_NULL = "\u0000null"


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(_NULL))


def _shares(tokens: dict[str, float], targets: dict[str, float] | None, temperature: float) -> dict[str, float]:
    """Shares that add up to 1 over the groups that have tokens."""
    present = {g: t for g, t in tokens.items() if t > 0}
    raw = {g: targets.get(_NULL if g is None else g, 0.0) for g in present} if targets is not None else {g: t**temperature for g, t in present.items()}
    total = sum(raw.values())
    if present and not total > 0:
        raise ValueError("no group that has tokens has a target above 0")
    return {g: v / total for g, v in raw.items()}


def solve(cells: DataFrame, sources: dict[str, float], langs: dict[str, float], total: float, budget: float, mean: float) -> tuple[dict[str, float], dict[str, float], float]:
    """Coefficients of source, language and log length.

    ``cells``: source, lang, z (log length less its mean) and tokens, of any number of rows. Groups of target 0 get rate 0
    and must not be in ``cells``. If the targets contradict each other the nearest rates in the sense of a slight ridge penalty result.
    """
    s_at = {g: i for i, g in enumerate(sources)}
    l_at = {g: len(s_at) + i for i, g in enumerate(langs)}
    d = len(s_at) + len(l_at) + 1
    goal = np.array([*sources.values(), *langs.values(), 0.0])
    beta = np.zeros(d)
    beta[: len(s_at)] = np.log(budget)

    def look(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        a_s = F.create_map(*[x for g, i in s_at.items() for x in (F.lit(g), F.lit(float(b[i])))])
        a_l = F.create_map(*[x for g, i in l_at.items() for x in (F.lit(g), F.lit(float(b[i])))])
        # one sum by cell first, so that the maps are looked up once a cell
        tilted = cells.withColumn("w", F.col("tokens") * F.exp(F.col("z") * float(b[-1])))
        by_cell = tilted.groupBy("source", "lang").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum(F.col("w") * F.col("z") ** 2).alias("wzz"))
        rate = F.exp(a_s[F.col("source")] + a_l[F.col("lang")]) / (total * budget)
        rows = by_cell.select("source", "lang", *[(F.col(c) * rate).alias(c) for c in ("w", "wz", "wzz")]).collect()
        gradient, curve, value = -goal.copy(), np.zeros((d, d)), -float(goal @ b)
        for r in sorted(rows):
            i, j = s_at[r["source"]], l_at[r["lang"]]
            value += r["w"]
            gradient[[i, j]] += r["w"]
            gradient[-1] += r["wz"]
            curve[i, i] += r["w"]
            curve[j, j] += r["w"]
            curve[i, j] += r["w"]
            curve[j, i] += r["w"]
            for k in (i, j):
                curve[k, -1] += r["wz"]
                curve[-1, k] += r["wz"]
            curve[-1, -1] += r["wzz"]
        ridge = 1e-10
        return value + ridge / 2 * float(b @ b), gradient + ridge * b, curve + ridge * np.eye(d)

    value, gradient, curve = look(beta)
    for _ in range(ITERATIONS):
        if np.abs(gradient).max() < TOLERANCE:
            break
        step = np.linalg.lstsq(curve, -gradient, rcond=1e-14)[0]
        size = min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        while size > 1e-6:
            new = look(beta + size * step)
            if new[0] <= value + 1e-4 * size * float(gradient @ step) or np.abs(new[1]).max() < np.abs(gradient).max() * 0.5:
                break
            size /= 2
        else:
            break
        beta, (value, gradient, curve) = beta + size * step, new
    return {g: float(beta[i]) for g, i in s_at.items()}, {g: float(beta[i]) for g, i in l_at.items()}, float(beta[-1])


def _rates(docs: DataFrame, sources: dict[str, float] | None, langs: dict[str, float] | None, budget: float, tokens: Column | None) -> tuple[Column, Column]:
    """(tokens, rate) as expressions over ``docs``."""
    n = words(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    facts = written(docs.select(_group("source").alias("source"), _group("lang").alias("lang"), n.alias("n")).groupBy("source", "lang", "n").agg(F.count("*").alias("docs")), "mixing-cells")
    facts = facts.filter("n > 0").withColumn("tokens", (F.col("n") * F.col("docs")).cast("double")).withColumn("z", F.log(F.col("n").cast("double")))
    total, mean = facts.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("z")) / F.sum("tokens")).first()
    if not total:
        return n, F.lit(1.0)
    by = {c: {r[0]: r[1] for r in facts.groupBy(c).agg(F.sum("tokens")).collect()} for c in ("source", "lang")}
    goal_s = {g: v for g, v in _shares(by["source"], sources, TEMPERATURE_SOURCE).items() if v > 0}
    goal_l = {g: v for g, v in _shares(by["lang"], langs, TEMPERATURE_LANG).items() if v > 0}
    cells = facts.filter(F.col("source").isin(*goal_s) & F.col("lang").isin(*goal_l)).withColumn("z", F.col("z") - mean)
    a, b, c = solve(cells, goal_s, goal_l, total, budget, mean)
    maps = [F.create_map(*[x for g, v in m.items() for x in (F.lit(g), F.lit(v))]) for m in (a, b)]
    z = F.log(F.greatest(n, F.lit(1)).cast("double")) - mean
    return n, F.coalesce(F.exp(maps[0][_group("source")] + maps[1][_group("lang")] + z * c), F.lit(0.0))


def _copies(rate: Column, seed: int) -> Column:
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 52)) / float(1 << 52)
    return F.floor(rate + draw).cast("int")


def mixing_rates(docs: DataFrame, sources: dict[str, float] | None = None, langs: dict[str, float] | None = None, budget: float = 1.0, tokens: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, n_tokens, rate, copies: a row for each row of ``docs``.

    ``sources`` and ``langs`` map a group to its target share of the tokens (any scale; groups left out get none); without them shares
    follow the power 0.5 and 0.8 of the groups' tokens. ``budget``: wanted tokens by those there are. ``tokens`` counts a row's tokens, by
    default the words. The groups named must be few enough for one driver's matrix. A null source or language is a group of its own (``"\\0null"``
    in the targets). Rows without tokens carry the rate of a one-token row and count for nothing; if no row has tokens all rates are 1.
    Repeated rows get equal copies. Columns of ``docs`` other than these five are not read.
    """
    n, rate = _rates(docs, sources, langs, budget, tokens)
    return docs.select("doc_id", "source", "lang", "text", n.alias("n_tokens"), rate.alias("rate")).select("doc_id", "source", "lang", "n_tokens", "rate", _copies(F.col("rate"), seed).alias("copies"))


def mix(docs: DataFrame, sources: dict[str, float] | None = None, langs: dict[str, float] | None = None, budget: float = 1.0, tokens: Column | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as :func:`mixing_rates` says, 0 times included; the columns stay."""
    _, rate = _rates(docs, sources, langs, budget, tokens)
    return docs.select("*", F.explode(F.array_repeat(F.lit(0), _copies(rate, seed))).alias(free_name(docs, "__copy"))).select(*docs.columns)

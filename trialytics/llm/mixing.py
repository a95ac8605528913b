"""Mixing of sources to target weights, by iterative proportional fitting.

Documents fall into cells of (source, language, topic). The cells' token counts, one small
aggregate over all documents, are raked: scaled to the target share of each source, then of
each language, then of each topic, round after round. A cell's calibrated weight is what its
tokens must be multiplied by. Documents are then sampled with a probability in proportion to
that, scaled so that `fraction` of all tokens is expected to stay; where that would pass 1 the
document stays and its weight says how often it should be repeated, so that weight x tokens of
the sample meets the targets. sample() repeats the documents itself: each is expected
probability x weight times, so that the tokens of its rows meet the targets. The draw is a hash
of the id, so that it is the same on every run and in every partition.

After `rounds` rounds the largest distance of a side's share from its target is the residual.
Targets can contradict each other (a source that has one language only); then the residual
stays, a warning tells it, and with `tolerance` a residual above that is an error.

The table of cells has a row for each combination that occurs: their number is that of sources
x languages x topics, not of documents. Up to `driver_cells` rows it is raked on the driver, in
arrays; a larger one stays a table and is raked by DataFrame operations, with the same results
to the precision of the sums. Up to BROADCAST_CELLS rows it is broadcast to the documents; a
larger one is joined by a shuffle.

Nulls and edge cases: null source, language or topic is a value of its own, '(none)'; a null
text has no word, and every document counts one token besides its words. A null id draws as the
empty string. Targets of values that don't occur are left out, and the shares of those that do
are scaled to sum to 1; a value without a target keeps its share of what is left. Repeated
rows share their draw. An empty table gives no rows. The operator's own columns are called as
in OWN; where docs has a column of such a name, the operator's gets one more underscore in front
(see own_names), and the input's column stays.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialytics.llm.common import cut, own_names

Targets = Mapping[str, Mapping[str, float] | float]
OWN = ("_source", "_lang", "_topic", "_tokens", "_probability", "_weight", "_draw", "_kept")
#: Rows of the table of cells that is broadcast: a few MB.
BROADCAST_CELLS = 20_000


def default_topic(text: str = "text") -> Column:
    """legal, contact, numeric or prose."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.lower(value).contains("license"), "legal").when(value.contains("@"), "contact").when(value.rlike("[0-9]"), "numeric").otherwise("prose")


def token_count(text: str = "text") -> Column:
    """Words and one end token."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long") + 1


def shares(tokens: np.ndarray, labels: Sequence[str], target: Mapping[str, float] | float) -> dict[str, float]:
    """Target share of each value. A number is a temperature: shares go with the power of the counts (0: equal)."""
    counts: dict[str, float] = {}
    for label, count in zip(labels, tokens.tolist(), strict=True):
        counts[label] = counts.get(label, 0.0) + count
    if isinstance(target, Mapping):
        given = {v: float(target[v]) for v in counts if v in target}
        left = sum(c for v, c in counts.items() if v not in given)
        spare = max(0.0, 1.0 - sum(given.values())) if left else 0.0
        wanted = {v: given[v] if v in given else spare * c / left for v, c in counts.items()}
    else:
        wanted = {v: c ** float(target) for v, c in counts.items()}
    total = sum(wanted.values()) or 1.0
    return {v: w / total for v, w in wanted.items()}


def rake(tokens: np.ndarray, labels: Sequence[Sequence[str]], targets: Sequence[Mapping[str, float]], rounds: int = 20) -> tuple[np.ndarray, float]:
    """Cell shares whose marginals meet the targets, starting from the cells' tokens, and the largest distance of a marginal from its target."""
    weight = tokens / tokens.sum()
    sides = []
    for names, target in zip(labels, targets, strict=True):
        values = sorted(set(names))
        place = {v: i for i, v in enumerate(values)}
        sides.append((np.array([place[n] for n in names]), np.array([target[v] for v in values])))
    for _ in range(rounds):
        for index, wanted in sides:
            now = np.bincount(index, weight, len(wanted))
            weight = weight * np.divide(wanted, now, out=np.zeros_like(wanted), where=now > 0)[index]
    return weight, max(float(np.abs(np.bincount(index, weight, len(wanted)) - wanted).max()) for index, wanted in sides)


def probabilities(tokens: np.ndarray, multiplier: np.ndarray, fraction: float) -> np.ndarray:
    """min(1, scale x multiplier), with the scale for which `fraction` of the tokens is expected."""
    wanted = fraction * tokens.sum()
    order = np.argsort(-multiplier, kind="stable")
    order = order[multiplier[order] > 0]  # a cell of no weight is never sampled
    sure = np.append(0.0, np.cumsum(tokens[order]))[:-1]
    rest = np.cumsum((tokens * multiplier)[order][::-1])[::-1]
    scale = (wanted - sure) / rest
    fits = np.flatnonzero(scale * multiplier[order] <= 1)
    return np.minimum(1.0, multiplier * scale[fits[0]]) if len(fits) else (multiplier > 0).astype(float)


def _wanted(cells: DataFrame, side: str, target: Mapping[str, float] | float) -> DataFrame:
    """side, _wanted: the target share of each value of a side (see shares)."""
    counts = cells.groupBy(side).agg(F.sum("tokens").alias("_n"))
    if isinstance(target, Mapping):
        listed = F.create_map(*(F.lit(x) for pair in target.items() for x in (pair[0], float(pair[1])))) if target else F.lit(None).cast("map<string,double>")
        counts = cut(counts.withColumn("_given", F.try_element_at(listed, F.col(side))), "side")
        given, left = counts.agg(F.sum("_given"), F.sum(F.when(F.col("_given").isNull(), F.col("_n")))).head()
        spare = max(0.0, 1.0 - (given or 0.0)) if left else 0.0
        raw = counts.withColumn("_raw", F.coalesce("_given", F.lit(spare) * F.col("_n") / F.lit(left or 1.0)))
    else:
        raw = cut(counts.withColumn("_raw", F.pow("_n", F.lit(float(target)))), "side")
    total = raw.agg(F.sum("_raw")).head()[0] or 1.0
    return cut(raw.select(side, (F.col("_raw") / total).alias("_wanted")), "wanted")


def _rake_table(cells: DataFrame, sides: Sequence[str], targets: Sequence[Mapping[str, float] | float], fraction: float, rounds: int) -> tuple[DataFrame, float]:
    """sides, _chance, _factor of a table of cells (sides, tokens), and the residual: what rake and probabilities do, as DataFrame operations."""
    cells = cut(cells.withColumn("tokens", F.col("tokens").cast("double")), "cells")
    total = cells.agg(F.sum("tokens")).head()[0]
    wanted = [_wanted(cells, side, target) for side, target in zip(sides, targets, strict=True)]
    weights = cells.withColumn("_w", F.col("tokens") / total)
    for _ in range(rounds):
        for side, share in zip(sides, wanted, strict=True):
            now = weights.groupBy(side).agg(F.sum("_w").alias("_now")).join(share, side)
            weights = weights.join(now, side).withColumn("_w", F.when(F.col("_now") > 0, F.col("_w") * F.col("_wanted") / F.col("_now")).otherwise(0.0)).select(*sides, "tokens", "_w")
        weights = cut(weights, "raked")
    residual = max(weights.groupBy(s).agg(F.sum("_w").alias("_now")).join(w, s).agg(F.max(F.abs(F.col("_now") - F.col("_wanted")))).head()[0] or 0.0 for s, w in zip(sides, wanted, strict=True))
    rows = cut(weights.withColumn("_m", F.col("_w") / (F.col("tokens") / total)), "multipliers")
    # the scale at which `fraction` of the tokens is expected: halved in, then worked out from the cells that stay below 1
    low, high = 0.0, 1.0
    expected = lambda s: rows.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("_m") * F.lit(s)))).head()[0] or 0.0
    most = rows.agg(F.sum(F.when(F.col("_m") > 0, F.col("tokens")))).head()[0] or 0.0
    if most <= fraction * total:
        chance = F.when(F.col("_m") > 0, 1.0).otherwise(0.0)
    else:
        while expected(high) < fraction * total:
            low, high = high, high * 2
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if expected(middle) < fraction * total else (low, middle)
        below = F.col("_m") * F.lit(high) < 1
        sure, rest = rows.agg(F.sum(F.when(~below, F.col("tokens"))), F.sum(F.when(below, F.col("tokens") * F.col("_m")))).head()
        scale = (fraction * total - (sure or 0.0)) / rest if rest else high
        chance = F.least(F.lit(1.0), F.col("_m") * F.lit(scale))
    out = rows.withColumn("_chance", chance)
    return out.select(*sides, "_chance", F.when(F.col("_chance") > 0, F.lit(fraction) * F.col("_m") / F.col("_chance")).otherwise(0.0).alias("_factor")), residual


def _calibrate(docs: DataFrame, targets: Targets, fraction: float, source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, text_col: str = "text", id_col: str = "doc_id",
    rounds: int = 20, driver_cells: int = 200_000, tolerance: float | None = None) -> tuple[DataFrame, dict[str, str]]:
    own = own_names(docs, OWN)
    sides = [own[n] for n in OWN[:3]]
    side = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    columns = dict(zip(sides, (side(F.col(source_col)), side(F.col(lang_col)), side(default_topic(text_col) if topic is None else topic)), strict=True))
    named = docs.withColumns(columns | {own["_tokens"]: token_count(text_col)})
    cells = named.groupBy(*sides).agg(F.sum(own["_tokens"]).alias("tokens"))
    table = cells.limit(driver_cells + 1).collect()
    wanted = [targets[k] for k in ("source", "lang", "topic")]
    residual, rows = 0.0, []
    if len(table) > driver_cells:
        fitted, residual = _rake_table(cells, sides, wanted, fraction, rounds)
        fitted = fitted.withColumnsRenamed({"_chance": own["_probability"], "_factor": own["_weight"]})
    else:
        table.sort(key=lambda r: tuple(r[:3]))
        if table:
            tokens = np.array([float(r["tokens"]) for r in table])
            labels = [[r[i] for r in table] for i in range(3)]
            raked, residual = rake(tokens, labels, [shares(tokens, names, target) for names, target in zip(labels, wanted, strict=True)], rounds)
            multiplier = raked / (tokens / tokens.sum())
            chance = probabilities(tokens, multiplier, fraction)
            weight = np.divide(fraction * multiplier, chance, out=np.zeros_like(chance), where=chance > 0)
            rows = list(zip(*labels, chance.tolist(), weight.tolist(), strict=True))
        fitted = docs.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` string" for n in sides) + f", `{own['_probability']}` double, `{own['_weight']}` double")
    if tolerance is not None and residual > tolerance:
        raise ValueError(f"the targets are missed by {residual:.4f} after {rounds} rounds")
    if residual > 1e-3:
        warnings.warn(f"the targets are missed by {residual:.4f} after {rounds} rounds", stacklevel=3)
    fitted = F.broadcast(fitted) if len(table) <= min(driver_cells, BROADCAST_CELLS) else fitted.hint("merge")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    drawn = named.join(fitted, sides).withColumn(own["_draw"], draw)
    return drawn.withColumn(own["_kept"], F.col(own["_draw"]) < F.col(own["_probability"])), own


def calibrated(docs: DataFrame, targets: Targets, fraction: float, **options) -> DataFrame:
    """All columns of docs with those of OWN.

    targets: for source, lang and topic a share of each value, or a temperature. options:
    source_col, lang_col, topic (a column), text_col, id_col, rounds, driver_cells, tolerance.
    """
    mixed, own = _calibrate(docs, targets, fraction, **options)
    return mixed.select(*docs.columns, *own.values())


def sample(docs: DataFrame, targets: Targets, fraction: float, **options) -> DataFrame:
    """The columns of docs, each document as often as probability x weight says: its integer part, and once more where the document's draw is below the rest."""
    mixed, own = _calibrate(docs, targets, fraction, **options)
    copies = F.col(own["_probability"]) * F.col(own["_weight"])
    whole = F.floor(copies)
    times = (whole + (F.col(own["_draw"]) < copies - whole).cast("int")).cast("int")
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(own["_kept"])).select(*docs.columns)

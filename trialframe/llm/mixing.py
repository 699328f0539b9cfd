"""Temperature mixing of sources: weights from a searched exponent, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, fresh, running, staged, text_of

SEED = 17
BLOCK_TOKENS = 1_000_000
MAX_EXPONENT = 8.0
GRID = 32
PASSES = 8
BROADCAST_SOURCES = 10_000


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WHITE.replace("[", "[^", 1) + "+")).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, n_docs, tokens, share); an empty document costs one token, so that every source has a share."""
    totals = staged(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("cost").alias("tokens")), "sources")
    everything = totals.agg(F.sum("tokens").alias("all")).first()["all"]
    return totals.select("source", "n_docs", "tokens", (F.col("tokens") / F.lit(everything or 1)).alias("share"))


def _measure(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(log of the sum of share ** a, entropy of the weights) for each exponent a, in one aggregation over the sources."""
    aggs = []
    for i, a in enumerate(exponents):
        power = F.exp(F.lit(a) * F.log("share"))
        aggs += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("share")).alias(f"s{i}")]
    row = shares.agg(*aggs).first()
    return [(math.log(row[f"z{i}"]), math.log(row[f"z{i}"]) - a * row[f"s{i}"] / row[f"z{i}"]) for i, a in enumerate(exponents)]


def _bisect(shares: DataFrame, low: float, high: float, enough) -> float:
    """The smallest exponent for which ``enough`` holds; it must be monotone. Each pass cuts the interval into 32."""
    for _ in range(PASSES):
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        held = [enough(a, *m) for a, m in zip(points, _measure(shares, points), strict=True)]
        if held[0]:
            return low
        if not any(held):
            return high
        first = held.index(True)
        low, high = points[first - 1], points[first]
    return round(high, 9)


@dataclass(frozen=True)
class Mixture:
    """``sources``: source, n_docs, tokens, share, weight, budget, full, rest. ``exponent`` 1 is no change, 0 is uniform."""

    sources: DataFrame
    exponent: float
    budget: int


def plan_mixture(rows: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | str | None = None) -> Mixture | None:
    """Weights proportional to ``share ** exponent``.

    ``target_entropy`` is a fraction of the entropy of equal weights: the exponent is the smallest that does not exceed
    it. ``max_repeats`` bounds how often a source's tokens are used: the exponent is raised until it holds. With both, the
    larger exponent counts; with neither, the weights are the shares. ``budget``: tokens, default those of the input;
    ``"cover"`` is the least budget that uses every source whole at least once. A budget above ``max_repeats`` times the
    input is lowered to that.
    """
    shares = source_totals(rows)
    top = shares.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.min("share").alias("lo"), F.max("share").alias("hi")).first()
    if not top["n"]:
        return None
    cover = budget == "cover"
    want = top["t"] if budget is None or cover else int(budget)
    if max_repeats is not None and not cover:
        want = min(want, int(max_repeats * top["t"]))
    exponent = 1.0 if target_entropy is None and max_repeats is None else 0.0
    if target_entropy is not None and top["n"] > 1:
        goal = target_entropy * math.log(top["n"])
        exponent = max(exponent, _bisect(shares, 0.0, MAX_EXPONENT, lambda a, z, h: h <= goal + 1e-12))
    if max_repeats is not None:
        lo, hi = math.log(top["lo"]), math.log(top["hi"])

        def few(a: float, z: float, h: float) -> bool:
            most = (a - 1) * lo - z if a <= 1 else (a - 1) * hi - z
            if cover:  # the budget follows the weights
                return (hi - lo) * abs(1 - a) <= math.log(max_repeats) + 1e-12
            return most + math.log(want / top["t"]) <= math.log(max_repeats) + 1e-9

        exponent = max(exponent, _bisect(shares, 0.0, 1.0, few))
    z, _ = _measure(shares, [exponent])[0]
    if cover:
        want = math.ceil(top["t"] * math.exp(max((1 - exponent) * math.log(top["lo"]), (1 - exponent) * math.log(top["hi"])) + z) * (1 - 1e-12))
    weight = F.exp(F.lit(exponent) * F.log("share") - F.lit(z))
    given = F.round(weight * want).cast("long")
    if cover:
        given = F.greatest(given, F.col("tokens"))
    out = shares.withColumns({"weight": weight, "budget": given})
    full = F.floor(F.col("budget") / F.col("tokens")).cast("long")
    out = out.withColumns({"full": full, "rest": F.col("budget") - full * F.col("tokens")})
    return Mixture(staged(out, "mixture"), exponent, want)


def _attached(rows: DataFrame, sources: DataFrame, source_col: str, columns: list[str], names: dict[str, str], how: str = "inner") -> DataFrame:
    """``rows`` with columns of ``sources``: broadcast up to a counted number of sources, else a join Spark may split."""
    right = sources.select(F.col("source").alias(names["source"]), *[F.col(c).alias(names[c]) for c in columns])
    if sources.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, F.col(source_col).eqNullSafe(F.col(names["source"])), how).drop(names["source"])


def _order(unit: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, unit)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokens: Column | None) -> DataFrame:
    count = word_count(text_col) if tokens is None else tokens.cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("unit"),
        F.coalesce(count, F.lit(0)).alias("n_tokens"))
    return rows.withColumn("cost", F.greatest("n_tokens", F.lit(1)).cast("long"))


def _uses(rows: DataFrame, mixture: Mixture, seed: int, whole: bool) -> DataFrame:
    """Uses of documents, by epoch, with the tokens of the source and epoch before each.

    The partial epoch, still with all its documents; with ``whole`` the full epochs as well.
    """
    names = {c: f"m_{c}" for c in ("source", "full", "rest", "budget", "tokens")}
    each = _attached(rows, mixture.sources, "source", ["full", "rest", "budget", "tokens"], names)
    if whole:
        last = F.col("m_full") - F.when(F.col("m_rest") == 0, 1).otherwise(0)
        each = each.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    else:
        each = each.filter(F.col("m_rest") > 0).withColumn("epoch", F.col("m_full"))
    each = each.withColumn("at", _order(F.col("unit"), F.col("epoch"), seed))
    return running(each, ["source", "epoch"], ["at"], "cost", "before", "nth")


def _cuts(uses: DataFrame) -> DataFrame:
    """Per source, the order value at which the last, partial epoch ends: that of the first document over the budget."""
    over = uses.filter((F.col("epoch") == F.col("m_full")) & (F.col("before") + F.col("cost") > F.col("m_rest")))
    return over.groupBy("source").agg(F.min("at").alias("cut"))


def mix_sources(
    docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | str | None = None, block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None,
) -> DataFrame:
    """One row per use of a document: ``doc_id, source, epoch, block, place, n_tokens``.

    Each source runs through its documents in an order of its own per epoch, as often as its budget allows; the last
    epoch ends before the first document that exceeds the budget, so a source lacks less than that document. ``block``
    cuts all sources' sequences into equally many parts, so that each block of about ``block_tokens`` tokens holds the
    sources at their weights; ``place`` orders a block. Read in order of (block, place), the rows are the mixture.

    Tokens are words, or the column given. Documents without words cost one token. A null source is a source. Rows
    repeated with the same id and text share their place and are used or left out together. An empty table gives no rows.
    Only sums over sources reach the driver; a source of any size is ordered over all tasks.
    """
    rows = staged(_rows(docs, id_col, text_col, source_col, tokens), "mix-rows")
    mixture = plan_mixture(rows, target_entropy, max_repeats, budget)
    if mixture is None:
        return rows.select("doc_id", "source", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("place"), "n_tokens")
    uses = staged(_uses(rows, mixture, seed, True), "mix-uses")
    cuts = staged(_cuts(uses), "mix-cuts")
    kept = _attached(uses, cuts, "source", ["cut"], {"source": "c_source", "cut": "cut"}, "left").filter((F.col("epoch") < F.col("m_full")) | F.col("cut").isNull() | (F.col("at") < F.col("cut")))
    blocks = max(1, math.ceil(mixture.budget / block_tokens))
    position = F.col("epoch") * F.col("m_tokens") + F.col("before")
    block = F.least(F.floor(position * F.lit(float(blocks)) / F.col("m_budget")).cast("long"), F.lit(blocks - 1).cast("long"))
    return kept.select("doc_id", "source", "epoch", block.alias("block"), F.xxhash64(F.lit(seed), "unit", "epoch", "source").alias("place"), "n_tokens")


def apply_mixture(
    docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | str | None = None, block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix_sources` uses it, with all their columns, in order of the mixture.

    A row's number of uses follows from its source's full epochs and from where its order value lies against the cut of
    the partial epoch. A use's block follows from its epoch and from how far its order value, which is even over its range,
    lies in that range: blocks hold the sources at their weights up to what such a draw varies, and no sums are joined
    back. Rows are range-partitioned by (block, place) and sorted; they move once. A null source is a source, a null text
    costs one token, repeated rows are used alike, an empty table stays empty.
    """
    rows = staged(_rows(docs, id_col, text_col, source_col, tokens), "mix-rows")
    mixture = plan_mixture(rows, target_entropy, max_repeats, budget)
    if mixture is None:
        return docs
    cuts = staged(_cuts(_uses(rows, mixture, seed, False)).withColumnRenamed("source", "c"), "mix-cuts")
    per = staged(
        mixture.sources.join(cuts, F.col("source").eqNullSafe(F.col("c")), "left").select("source", "full", "rest", "cut", "tokens", "budget"), "mix-plan")
    columns = ["full", "rest", "cut", "tokens", "budget"]
    names = {c: fresh(docs, f"__{c}") for c in ("source", *columns)}
    key = fresh(docs, "__key")
    both = _attached(docs.withColumn(key, F.col(source_col).cast("string")), per, key, columns, names)
    held = {c: F.col(n) for c, n in names.items()}
    unit, epoch, block, place = F.xxhash64(F.col(id_col), F.col(text_col)), *[fresh(docs, f"__{c}") for c in ("epoch", "block", "place")]
    more = F.when(held["rest"] == 0, 0).when(held["cut"].isNull() | (_order(unit, held["full"], seed) < held["cut"]), 1).otherwise(0)
    uses = both.withColumn(epoch, F.explode(F.expr(f"sequence(0L, {names['full']})"))).filter(F.col(epoch) < held["full"] + more)
    blocks = max(1, math.ceil(mixture.budget / block_tokens))
    part = F.col(epoch) + 0.5 + _order(unit, F.col(epoch), seed) / F.lit(2.0**64)
    at = F.floor(part * held["tokens"] * F.lit(float(blocks)) / held["budget"]).cast("long")
    uses = uses.withColumns({block: F.least(at, F.lit(blocks - 1).cast("long")), place: F.xxhash64(F.lit(seed), unit, F.col(epoch), F.col(key))})
    return uses.select(*docs.columns, block, place).repartitionByRange(block, place).sortWithinPartitions(block, place).select(*docs.columns)

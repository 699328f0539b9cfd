"""Ranking quality: top-k agreement, gains, per-key and per-region rank metrics, consensus ranking."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import l2
from ..functions.pvalues import fair_coin_tail
from ..plans.concordance import concordance
from ..plans.ordered import join_on, ordered, settle
from ..plans.ranks import top_rows, with_ranks
from ..plans.stage import staged
from .metrics import both_finite, spearman, tau_from_counts


def _top_pair(df: DataFrame, by: list[str], true: str, pred: str, ident: str, k: int) -> DataFrame:
    """Rows in the true or predicted first ``k`` of each group, with both positions."""
    t = top_rows(df.select(*by, ident, true), by, [f"-{true}", ident], k, "__rt").select(*by, ident, "__rt")
    p = top_rows(df.select(*by, ident, pred), by, [f"-{pred}", ident], k, "__rp").select(*by, ident, "__rp")
    return join_on(t, p, [*by, ident], "full_outer")


def _predictions(df: DataFrame, by: list[str], true: str, pred: str, ident: str) -> DataFrame:
    """The usable rows with the columns the rankings need, written once: each ranking sorts them anew."""
    return staged(both_finite(df.select(*by, ident, true, pred), true, pred), "predictions")


def topk_quality(df: DataFrame, by: list[str], true: str, pred: str, ident: str, kmax: int = 6) -> DataFrame:
    """Precision, recall, top-1 hit and random baseline for k = 1..min(kmax, n). Ties go by ``ident``."""
    return _topk(_predictions(df, by, true, pred, ident), by, true, pred, ident, kmax)


def _topk(rows: DataFrame, by: list[str], true: str, pred: str, ident: str, kmax: int) -> DataFrame:
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    top = _top_pair(rows, by, true, pred, ident, kmax)
    both = (F.col("__rt") <= F.col("k")) & (F.col("__rp") <= F.col("k"))
    hit = (F.col("__rt") == 1) & (F.col("__rp") <= F.col("k"))
    ks = top.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(kmax))))
    per = ks.groupBy(*by, "k").agg(
        F.count_if(both).alias("overlap"), F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("hit")
    )
    joined = join_on(per, size, by)
    share = F.col("overlap") / F.col("k")
    return joined.filter(F.col("k") <= F.col("n")).select(
        *by, "k", "n", share.alias("precision"), share.alias("recall"), "hit",
        (F.col("k") / F.col("n")).alias("baseline"),
    )


def gains_curve(
    df: DataFrame, by: list[str], true: str, pred: str, ident: str, q: float = 0.25, cap: int | None = None
) -> DataFrame:
    """Recall of the true best ``q`` share among the first k predicted, for every k."""
    rows = _predictions(df, by, true, pred, ident)
    cap = settle(rows, by, cap)
    ranked = ordered(rows, by, [f"-{true}", ident], cap).index("__rt").total(n=("count", F.lit(1))).done()
    good = F.greatest(F.lit(1), F.ceil(q * F.col("n")))
    flagged = ranked.withColumn("m", good).withColumn("__good", (F.col("__rt") <= F.col("m")).cast("long"))
    walk = ordered(flagged, by, [f"-{pred}", ident], cap).index("k").running(__cum=("sum", F.col("__good"))).done()
    return walk.select(
        *by, ident, "k", "n", "m", (F.col("k") / F.col("n")).alias("fraction"), (F.col("__cum") / F.col("m")).alias("recall")
    )


def gains_points(curve: DataFrame, by: list[str], thresholds=(2.0 / 3.0, 1.0)) -> DataFrame:
    """Smallest k reaching each recall threshold."""
    names = [f"k_at_{i + 1}" for i in range(len(thresholds))]
    return curve.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("m").alias("m"),
        *[F.min(F.when(F.col("recall") >= t, F.col("k"))).alias(a) for a, t in zip(names, thresholds)],
    )


def top_hit_sets(df: DataFrame, by: list[str], true: str, pred: str, label: str) -> DataFrame:
    """Whether the best one agrees and the best two overlap, with the label lists."""
    top = _top_pair(_predictions(df, by, true, pred, label), by, true, pred, label, 2)

    def labels(rank: str, k: int) -> Column:
        # two rows at most per group
        kept = F.array_sort(F.collect_list(F.when(F.col(rank) <= k, F.struct(F.col(rank), F.col(label).alias("v")))))
        return F.transform(kept, lambda s: s["v"])

    out = top.groupBy(*by).agg(
        labels("__rt", 1).alias("true_top1"), labels("__rp", 1).alias("pred_top1"),
        labels("__rt", 2).alias("true_top2"), labels("__rp", 2).alias("pred_top2"),
    )
    return out.withColumns(
        {
            "top1_hit": F.arrays_overlap("true_top1", "pred_top1").cast("int"),
            "top2_hit": F.arrays_overlap("true_top2", "pred_top2").cast("int"),
        }
    )


def rank_metrics(
    df: DataFrame, by: list[str], true: str, pred: str, ident: str, k: int = 2, min_n: int = 1,
    zero_var: float | None = 0.0, variant: str = "custom", cap: int | None = None,
) -> DataFrame:
    """Spearman, Kendall, pair accuracy with tail probability, and top-k agreement per group."""
    df = _predictions(df, by, true, pred, ident)
    rho = spearman(df, by, true, pred, zero_var, cap).filter(F.col("n") >= min_n)
    pairs = concordance(both_finite(df.select(*by, true, pred), true, pred), by, true, pred)
    m = F.col("concordant") + F.col("discordant")
    pairs = pairs.select(
        *by, tau_from_counts(variant).alias("kendall_tau"), m.alias("untied_pairs"),
        F.col("concordant").alias("correct_pairs"), F.when(m > 0, F.col("concordant").cast("double") / m.cast("double")).alias("pair_accuracy"),
    )
    top = _topk(df, by, true, pred, ident, k).filter(F.col("k") == F.least(F.lit(k), F.col("n")))
    top = top.select(*by, F.col("precision").alias("precision_at_k"), F.col("hit").alias("hit_at_k"))
    out = join_on(join_on(rho, pairs, by), top, by)
    return out.withColumn(
        "binomial_tail", fair_coin_tail(F.col("correct_pairs").cast("double"), F.col("untied_pairs").cast("double"))
    )


def metrics_by_key(df: DataFrame, key: str, true: str, pred: str, ident: str, min_n: int = 3, **kw) -> DataFrame:
    """Rank metrics per time point; small groups are skipped."""
    return rank_metrics(df, [key], true, pred, ident, min_n=min_n, **kw)


def add_regions(df: DataFrame, axes: list[str], name: str = "cube") -> DataFrame:
    """Corner of the covariate box a row falls in, from observed bounds; one digit per axis."""
    bounds = df.agg(
        F.struct(*[f(a).cast("double").alias(f"{s}_{a}") for a in axes for s, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    out = df.withColumn("__b", bounds)
    digit = [
        F.when((F.col(a) - F.col(f"__b.lo_{a}")) / (F.col(f"__b.hi_{a}") - F.col(f"__b.lo_{a}") + 1e-12) >= 0.5, "1")
        .otherwise("0") for a in axes
    ]
    return out.withColumn(name, F.concat(*digit)).drop("__b")


def region_out(df: DataFrame, axes: list[str], true: str, pred: str, ident: str, min_n: int = 4, **kw) -> DataFrame:
    return rank_metrics(add_regions(df, axes), ["cube"], true, pred, ident, min_n=min_n, **kw)


def consensus_rank(
    df: DataFrame, key: str, first: str, second: str, axes: list[str], w: tuple[float, float] = (0.6, 0.4),
    cap: int | None = None,
) -> DataFrame:
    """Combine two predicted scores into one ranking with gap, agreement and edge scores.

    ``axes`` are covariates scaled to [0, 1]. Scores are min-max scaled over the table; a range below
    1e-12 leaves the score out (counted as 0 in the total).
    """
    cap = settle(df, [], cap)
    out = with_ranks(df, [], first, "__a", desc=True, cap=cap)
    out = with_ranks(out, [], second, "__b", desc=True, cap=cap)
    raw = w[0] * F.col("__a_min") + w[1] * F.col("__b_min")
    out = out.select(
        *df.columns, F.col("__a_min").alias("rank_first"), F.col("__b_min").alias("rank_second"),
        raw.alias("rank_raw"), F.abs(F.col("__a_min") - F.col("__b_min")).alias("rank_gap"),
    )
    out = with_ranks(out, [], "rank_raw", "__c", cap=cap).withColumnRenamed("__c_min", "rank_consensus")
    out = out.drop("__c_max", "__c_avg", "__c_dense")
    out = ordered(out, [], [f"-{first}", key], cap).following(__next=F.col(first)).done()
    out = out.withColumn("gap_next", F.col(first) - F.col("__next")).drop("__next")
    out = staged(out, "consensus")  # its bounds are needed before its rows
    edges = [F.least(F.col(a), 1.0 - F.col(a)) for a in axes]
    out = out.withColumn("edge_score", sum(edges[1:], edges[0]) / float(len(edges)))
    scored = ["gap_next", "edge_score", "rank_gap"]
    span = out.agg(
        F.struct(*[f(c).cast("double").alias(f"{s}_{c}") for c in scored for s, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    out = out.withColumn("__s", span)

    def unit(c: str) -> Column:
        lo, hi = F.col(f"__s.lo_{c}"), F.col(f"__s.hi_{c}")
        return F.when(hi - lo >= 1e-12, (F.col(c) - lo) / (hi - lo))

    out = out.withColumns(
        {"score_gap": unit("gap_next"), "score_agree": 1.0 - unit("rank_gap"), "score_edge": unit("edge_score")}
    ).drop("__s")
    total = sum(
        (wt * F.coalesce(F.col(c), F.lit(0.0)) for wt, c in ((0.3, "score_agree"), (0.2, "score_edge"))),
        0.5 * F.coalesce(F.col("score_gap"), F.lit(0.0)),
    )
    return out.withColumn("score_overall", total)


def diverse_subset(cons: DataFrame, key: str, axes: list[str], pool: int = 4, pick: int = 2) -> DataFrame:
    """Best ``pick`` of the first ``pool`` consensus rows: mean distance + 0.1 score - 0.01 rank."""
    lead = top_rows(cons, [], ["rank_consensus", "-score_overall", key], pool, "pos")
    point = F.array(*[F.col(a).cast("double") for a in axes])
    slots = lead.agg(  # ``pool`` rows by construction
        F.array_sort(F.collect_list(F.struct("pos", key, point.alias("x"), "score_overall", "rank_consensus"))).alias("p")
    )
    options = F.array(*[F.array(*[F.lit(i + 1) for i in c]) for c in combinations(range(pool), pick)])
    picked = slots.withColumn("ids", F.explode(options)).filter(F.array_max("ids") <= F.size("p"))
    members = [F.element_at("p", F.col("ids")[i]) for i in range(pick)]
    pairs = list(combinations(range(pick), 2))
    spread = sum((l2(members[i]["x"], members[j]["x"]) for i, j in pairs), F.lit(0.0)) / float(max(1, len(pairs)))
    score = sum((m["score_overall"] for m in members), F.lit(0.0)) / float(pick)
    rank = sum((m["rank_consensus"] for m in members), F.lit(0.0)) / float(pick)
    out = picked.select(
        F.array(*[m[key] for m in members]).alias("members"), (spread + 0.1 * score - 0.01 * rank).alias("objective"),
        F.col("ids"),
    )
    return out.orderBy(F.desc("objective"), F.asc("ids")).limit(1).drop("ids")

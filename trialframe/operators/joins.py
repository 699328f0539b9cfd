"""Joins of the curation and audit jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_tokens, norm_label
from ..functions.units import to_percent_w_w, is_target
from ..plans.ordered import join_on, ordered
from ..plans.stage import staged
from .corpus import first_per_key


class LostRows(ValueError):
    """Raised when a checked join would lose rows; carries some of the missing keys."""


def join_checked(a: DataFrame, b: DataFrame, key: list[str], show: int = 20) -> DataFrame:
    """Inner join that keeps the left columns first and refuses to lose left rows."""
    missing = join_on(a.select(*key), b.select(*key), key, "left_anti").limit(show).collect()
    if missing:
        raise LostRows(f"no match for keys such as {[tuple(r) for r in missing]}")
    return join_on(a, b, key)


def attach_formulations(endpoints: DataFrame, curve_map: DataFrame, formulations: DataFrame) -> DataFrame:
    """Usable amount endpoints, their curve mapping and the mapped formulation; unmatched stay with nulls."""
    usable = endpoints.filter(
        (F.col("status") == "ok") & F.coalesce(F.col("y_kind") != "percent", F.lit(True))
    )
    mapped = usable.join(curve_map, ["doi", "curve_id"], "left")
    own = formulations.withColumns({"doi": F.trim("doi"), "formulation_label": F.trim("formulation_label")})
    clash = {c: f"{c}_fm" for c in own.columns if c in mapped.columns and c != "doi"}
    right = own.withColumnsRenamed({"doi": "__doi", **clash})
    label = clash.get("formulation_label", "formulation_label")
    same = (F.col("doi") == F.col("__doi")) & (F.trim("mapped_formulation_label") == F.col(label))
    return mapped.join(right, same, "left").drop("__doi")


def split_mapped(df: DataFrame, label: str = "mapped_formulation_label") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(label).isNotNull()), df.filter(F.col(label).isNull())


GRAM = 4


def _grams(text: Column, low: int, high: int) -> Column:
    """The distinct substrings of ``low`` to ``high`` characters: at most ``high`` per character."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(low, high + 1)])))


def _containing(short: DataFrame, long: DataFrame, key: list[str], s: str, t: str) -> DataFrame:
    """(key, s, t) for every ``s`` of more than ``GRAM`` characters inside a ``t``.

    An ``s`` is looked up by the one of its grams that the fewest ``t`` have, then compared whole.
    """
    held = long.select(*key, t, F.explode(_grams(F.col(t), GRAM, GRAM)).alias("__g"))
    rare = held.groupBy(*key, "__g").agg(F.count(F.lit(1)).alias("__df"))
    asked = short.filter(F.length(s) > GRAM).select(*key, s, F.explode(_grams(F.col(s), GRAM, GRAM)).alias("__g"))
    probe = join_on(asked, rare, [*key, "__g"], "left").groupBy(*key, s).agg(
        F.min(F.struct("__df", "__g")).alias("__p"), F.bool_or(F.col("__df").isNull()).alias("__none"))
    probe = probe.filter(~F.col("__none")).select(*key, s, F.col("__p")["__g"].alias("__g"))
    return join_on(probe, held, [*key, "__g"]).filter(F.contains(F.col(t), F.col(s))).select(*key, s, t)


def match_labels(
    curves: DataFrame, labels: DataFrame, key: list[str], curve_label: str, label: str, order: str
) -> DataFrame:
    """Map each curve label to a formulation label of its key: exact, shared identifier, then substring.

    Every rule is an equality join on a table holding one first label per (key, normal form, token or short text).
    Labels that neither rule settles are searched for containment: texts up to ``GRAM`` characters by all short parts of
    the other side, longer ones by their rarest gram, then compared whole. Rows grow in proportion to the labels' length.
    """
    cur = curves.withColumn("__c", norm_label(curve_label))
    tagged = F.struct(F.col(order).alias("o"), F.col(label).alias("l"))
    base = labels.withColumns({"__n": norm_label(label), "__tag": tagged})

    def first_by(df: DataFrame, form: str) -> DataFrame:
        return df.groupBy(*key, form).agg(F.min("__tag").alias("__first"))

    first = first_by(base.filter(F.col("__n") != ""), "__n")
    token = first_by(base.withColumn("__t", F.explode(id_tokens(label))), "__t")
    ids = [*key, curve_label]
    distinct = cur.select(*ids, "__c").distinct()
    by_exact = join_on(distinct, first.select(*key, F.col("__n").alias("__c"), F.col("__first").alias("__exact")), [*key, "__c"], "left")
    tokens = distinct.withColumn("__t", F.explode(id_tokens(curve_label)))
    hit = join_on(tokens, token, [*key, "__t"]).groupBy(*ids).agg(F.min("__first").alias("__token"))
    settled = staged(join_on(by_exact, hit, ids, "left"), "labels")
    forms = settled.filter(F.col("__exact").isNull() & F.col("__token").isNull() & (F.col("__c") != "")).select(*key, "__c").distinct()
    short_labels = first.withColumn("__g", F.explode(_grams(F.col("__n"), 1, GRAM))).groupBy(*key, "__g").agg(F.min("__first").alias("__first"))
    short_forms = forms.withColumn("__g", F.explode(_grams(F.col("__c"), 1, GRAM)))
    found = [
        join_on(forms.withColumn("__g", F.col("__c")), short_labels, [*key, "__g"]),
        join_on(short_forms, first.withColumnRenamed("__n", "__g"), [*key, "__g"]),
        join_on(_containing(forms, first, key, "__c", "__n"), first, [*key, "__n"]),
        join_on(_containing(first, forms, key, "__n", "__c"), first, [*key, "__n"]),
    ]
    inside = reduce(DataFrame.unionByName, [f.select(*key, "__c", "__first") for f in found]).groupBy(*key, "__c").agg(F.min("__first").alias("__sub"))
    has = labels.select(*key).distinct().withColumn("__has", F.lit(True))
    found = join_on(join_on(settled, inside, [*key, "__c"], "left"), has, key, "left")
    open_ = F.col("__exact").isNull() & F.col("__token").isNull()
    found = found.select(
        *ids,
        F.coalesce(F.col("__exact"), F.col("__token"), F.col("__sub"))["l"].alias("mapped_label"),
        F.when(F.col("__has").isNull(), "no_formulations").when(F.col("__exact").isNotNull(), "exact_norm_match")
        .when(F.col("__token").isNotNull(), "token_match").when(open_ & F.col("__sub").isNotNull(), "substring_norm_match")
        .otherwise("unmapped").alias("status"),
    )
    return join_on(curves, found, ids, "left")


def legend_match(df: DataFrame, legend: str, color: str, curve_id: str) -> DataFrame:
    """Label of a curve from legend colours containing each other; the curve id where none does."""
    c = F.lower(F.coalesce(F.col(color), F.lit("")))

    def fits(item: Column) -> Column:
        h = F.lower(F.coalesce(item["color_hint"], F.lit("")))
        return (c != "") & (h != "") & (F.contains(h, c) | F.contains(c, h)) & (F.trim(item["label"]) != "")

    kept = F.transform(F.filter(F.coalesce(F.col(legend), F.array()), fits), lambda i: F.trim(i["label"]))
    out = df.withColumn("__kept", kept)
    n = F.size("__kept")
    return out.withColumns(
        {
            "curve_label": F.when(n > 0, F.get("__kept", F.lit(0))).otherwise(F.col(curve_id)),
            "label_source": F.when(n == 1, "legend_color_unique").when(n > 1, "legend_color_ambiguous")
            .otherwise("curve_id_fallback"),
        }
    ).drop("__kept")


def _one_to_one(cand: DataFrame, places: DataFrame, closest: bool, cap: int | None = None) -> DataFrame:
    """(curve, head, diff, nth): which of the candidates (curve, head, diff) come together, and the curve's place there.

    ``places`` (head, places) says how many curves a head takes. All curves ask for their closest head; a head with more
    than it takes keeps the first (by name, or by difference and name), and whoever stands behind the last one kept never
    gets there, so all such candidates go and the others ask again. Once nobody is refused, the result is that of serving
    the curves one after the other. A round is a few aggregations of the candidates left; only a flag reaches the driver.
    """
    order = ["diff", "curve"] if closest else ["curve"]
    cand = staged(cand, "candidates")
    while True:
        asked = cand.groupBy("curve").agg(F.min(F.struct("diff", "head")).alias("best")).select("curve", "best.*")
        placed = join_on(ordered(asked, ["head"], order, cap).index("nth").done(), places, ["head"])
        placed = staged(placed, "placed")
        if not placed.filter("nth > places").limit(1).count():
            return placed.select("curve", "head", "diff", "nth")
        last = placed.filter("nth = places").select("head", F.struct(*order).alias("__last"))
        left = join_on(cand, last, ["head"], "left")
        cand = staged(left.filter(F.col("__last").isNull() | (F.struct(*order) <= F.col("__last"))).drop("__last"), "candidates")


def match_curve_sets(
    pred: DataFrame, canon: DataFrame, curve: str, position: str, value: str, tol: float = 1e-5, closest: bool = False, cap: int | None = None
) -> DataFrame:
    """Which reference curve each predicted curve is, by largest absolute difference within ``tol``, one to one.

    The predicted curves take, in order of their names, the closest reference that is still free; with ``closest`` the
    closest pair of all comes first, then the closest of those left. Equal differences go by the reference's name. A curve
    without a free reference within ``tol`` stays unmatched and takes none.

    Points repeated at a position are averaged first. Curves are then merged by content, so copies are compared once; a
    reference content takes as many curves as it has copies, in order of their names. Candidates come from an equality
    join on quantised first and mean values (with neighbouring cells); only those are compared point by point.
    """

    def digest(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        points = df.groupBy(F.col(curve).alias(name), F.col(position).alias("__p")).agg(F.avg(value).alias("__v"))
        # sums of two hashes don't cancel, whatever the order of the points
        per = points.groupBy(name).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("__v", "__p").alias("v0"), F.avg("__v").alias("m"),
            *[F.sum(F.xxhash64(F.lit(seed), "__p", "__v").cast("decimal(38,0)")).alias(h) for seed, h in enumerate(("h1", "h2"))],
        )
        heads = per.groupBy("h1", "h2", "n").agg(F.min(name).alias(name), F.min("v0").alias("v0"), F.min("m").alias("m"), F.count(F.lit(1)).alias("places"))
        return points, per, heads

    (pts_a, a, heads_a), (pts_b, b, heads_b) = digest(pred, "pred_curve"), digest(canon, "canon_curve")
    cell = lambda c: F.floor(F.col(c) / (2 * tol)).cast("long")
    near = lambda c: F.sequence(cell(c) - 1, cell(c) + 1)
    cells = heads_b.select("canon_curve", "n", cell("v0").alias("c0"), cell("m").alias("c1"))
    wide = heads_a.select("pred_curve", "n", F.explode(near("v0")).alias("c0"), "m").select(
        "pred_curve", "n", "c0", F.explode(near("m")).alias("c1")
    )
    cand = wide.join(cells, ["n", "c0", "c1"]).select("pred_curve", "canon_curve", "n")
    diff = (
        cand.join(pts_a.withColumnRenamed("__v", "__va"), "pred_curve").join(pts_b.withColumnRenamed("__v", "__vb"), ["canon_curve", "__p"])
        .groupBy("pred_curve", "canon_curve", "n")
        .agg(F.max(F.abs(F.col("__va") - F.col("__vb"))).alias("max_abs_diff"), F.count(F.lit(1)).alias("__c"))
        .filter((F.col("max_abs_diff") <= tol) & (F.col("__c") == F.col("n")))
    )

    def copies(per: DataFrame, heads: DataFrame, name: str, head: str) -> DataFrame:
        """Every curve with its content's head."""
        named = heads.select("h1", "h2", "n", F.col(name).alias(head))
        return per.select(name, "h1", "h2", "n").join(named, ["h1", "h2", "n"]).select(name, head)

    close = diff.select(F.col("pred_curve").alias("__a"), F.col("canon_curve").alias("head"), F.col("max_abs_diff").alias("diff"))
    wanted = join_on(copies(a, heads_a, "pred_curve", "__a"), close, ["__a"]).select(F.col("pred_curve").alias("curve"), "head", "diff")
    held = _one_to_one(wanted, heads_b.select(F.col("canon_curve").alias("head"), "places"), closest, cap)
    free = ordered(copies(b, heads_b, "canon_curve", "head"), ["head"], ["canon_curve"], cap).index("nth").done()
    taken = join_on(held, free, ["head", "nth"]).select("curve", "canon_curve", F.col("diff").alias("max_abs_diff"))
    return join_on(a.select("pred_curve"), taken.withColumnRenamed("curve", "pred_curve"), ["pred_curve"], "left")


def curve_set_verdict(
    pred: DataFrame, canon: DataFrame, matches: DataFrame, curve: str, position: str, value: str, tol: float = 1e-5, cap: int | None = None
) -> DataFrame:
    """One row: whether the predicted curves are the reference's (``curve_set_matches``: every curve matched, and as many of
    each), the largest difference of a match, and whether the points, in order of curve and position, are the same within
    ``tol`` without any matching (``same_sequence``, with its largest difference; false where the numbers of points differ).

    ``matches`` is the result of :func:`match_curve_sets`.
    """

    def listed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(curve).alias("__c"), F.col(position).alias("__p"), F.col(value).cast("double").alias(name))
        return ordered(rows, [], ["__c", "__p", name], cap).index("__i").done().select("__i", name)

    n_canon = canon.agg(F.countDistinct(curve).alias("n_canon"))
    found = matches.agg(F.count(F.lit(1)).alias("n_pred"), F.count("canon_curve").alias("n_matched"), F.max("max_abs_diff").alias("max_abs_diff"))
    both = listed(pred, "__a").withColumnRenamed("__i", "__j").join(listed(canon, "__b"), F.col("__i") == F.col("__j"), "full_outer")
    gap = F.abs(F.col("__a") - F.col("__b"))
    order = both.agg(
        F.max(gap).alias("sequence_max_abs_diff"),
        F.coalesce(F.bool_and(F.col("__i").isNotNull() & F.col("__j").isNotNull() & F.coalesce(gap <= tol, F.lit(False))), F.lit(True)).alias("same_sequence"))
    out = join_on(join_on(found, n_canon, []), order, [])  # one row each
    same = (F.col("n_matched") == F.col("n_pred")) & (F.col("n_pred") == F.col("n_canon")) & (F.col("n_pred") > 0)
    return out.withColumn("curve_set_matches", same)


def same_order(a: DataFrame, b: DataFrame, ident: str, position: str) -> Column:
    """Whether two lists hold the same identifiers at the same positions, as a single value."""
    both = a.select(F.col(ident).alias("__x"), F.col(position).alias("__p")).join(
        b.select(F.col(ident).alias("__y"), F.col(position).alias("__q")), F.col("__p") == F.col("__q"), "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.col("__x").eqNullSafe(F.col("__y"))), F.lit(True)).alias("same")).scalar()


def leakage_check(
    train: DataFrame, test: DataFrame, run: str, axes: list[str], digits: int = 8
) -> DataFrame:
    """Runs and rounded conditions that occur in both sets, one row per kind and value."""
    text = F.concat_ws("|", *[F.round(F.col(a), digits).cast("string") for a in axes])
    runs = train.select(F.col(run).cast("string").alias("value")).intersect(test.select(F.col(run).cast("string").alias("value")))
    conds = train.select(text.alias("value")).intersect(test.select(text.alias("value")))
    return runs.select(F.lit("run").alias("kind"), "value").unionByName(conds.select(F.lit("condition").alias("kind"), "value"))


def assign_split(df: DataFrame, train: DataFrame, test: DataFrame, key: list[str]) -> DataFrame:
    """Membership of each row; a row in both sets belongs to test."""
    tr = train.select(*key).distinct().withColumn("__tr", F.lit(True))
    te = test.select(*key).distinct().withColumn("__te", F.lit(True))
    out = join_on(join_on(df, tr, key, "left"), te, key, "left")
    where = F.when(F.col("__te"), "test").when(F.col("__tr"), "train").otherwise("none")
    return out.withColumn("split", where).drop("__tr", "__te")


def material_change(old: DataFrame, new: DataFrame, key: list[str], mean: str = "mean", sd: str = "sd") -> DataFrame:
    """Change of the mean per group, flagged where it exceeds the old standard deviation."""
    o = old.select(*key, F.col(mean).alias("old_mean"), F.col(sd).alias("old_sd"))
    n = new.select(*key, F.col(mean).alias("new_mean"))
    delta = F.col("new_mean") - F.col("old_mean")
    return join_on(o, n, key).select(*key, "old_mean", "old_sd", "new_mean", delta.alias("delta"),
                                     (F.abs(delta) > F.col("old_sd")).alias("material"))


def merge_audits(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join in which null keys (no seed) match each other."""
    return join_on(a, b, key, "full_outer")


def replay_diff(
    a: DataFrame, b: DataFrame, record: str, time: str, value: str, t_end: float, tol: float
) -> DataFrame:
    """Largest and mean absolute difference of two replays, over all points and at the end, with flags."""
    left = a.select(record, time, F.col(value).alias("__a"))
    right = b.select(record, time, F.col(value).alias("__b"))
    d = F.abs(F.col("__a") - F.col("__b"))
    at_end = F.when(F.abs(F.col(time) - t_end) <= 1e-8, d)
    return join_on(left, right, [record, time]).agg(
        F.count(F.lit(1)).alias("points"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"),
        F.max(at_end).alias("max_abs_end"), F.avg(at_end).alias("mean_abs_end"),
        (F.max(d) <= tol).alias("within_tol"), (F.max(at_end) <= tol).alias("end_within_tol"),
    )


def lookup_refined(df: DataFrame, answers: DataFrame, key: list[str], label: str, items: str = "items") -> DataFrame:
    """Join nested answers back by trimmed label; the last answer of a label counts, none gives nulls."""
    flat = answers.select(*key, F.posexplode(items).alias("__pos", "__it"))
    flat = flat.select(*key, F.trim(F.col(f"__it.{label}")).alias("__lab"), "__pos", "__it")
    last = first_per_key(flat, [*key, "__lab"], [F.desc("__pos")]).drop("__pos")
    out = join_on(df.withColumn("__lab", F.trim(label)), last, [*key, "__lab"], "left")
    pct = to_percent_w_w(F.col("__it.api_value"), F.col("__it.api_unit"), F.col("__it.api_basis"))
    return out.withColumns(
        {
            "api_value_refined": F.col("__it.api_value"),
            "api_unit_refined": F.coalesce("__it.api_unit", F.lit("")),
            "api_pct_refined": pct,
            "confirmed_refined": is_target(pct),
        }
    ).drop("__it", "__lab")

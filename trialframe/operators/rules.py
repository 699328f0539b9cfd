"""Screening, gating, routing and validation of records as Column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_pattern, safe_parse, text_or_empty
from ..functions.units import is_target, parse_concentration

# Patterns of the corpus screen.
SCREEN_MUST = (r"\bibuprofen\b",)
SCREEN_ANY = (
    r"\bin vitro\b", r"\bpermeat", r"\bdiffus", r"\brelease\b", r"\btransdermal\b", r"\btopical\b", r"\bskin\b",
    r"\bmembrane\b", r"\bfranz\b", r"\bdiffusion cell\b",
)
SCREEN_NONE = (r"\boral\b", r"\btablet\b", r"\bcapsule\b", r"\bplasma\b", r"\bpharmacokinet", r"\bin vivo\b")
# The drug names that keep concentration evidence honest.
DRUG_NAMES = ("ibuprofen", "ibu")
COMPONENTS = (
    "array<struct<name_raw:string,concentration_value:string,concentration_unit:string,basis:string,remark:string>>"
)


def keyword_screen(df: DataFrame, texts: list[str], must=SCREEN_MUST, any_=SCREEN_ANY, none=SCREEN_NONE) -> DataFrame:
    """Adds ``route``: pass where the joined texts hold all ``must``, one of ``any_`` and none of ``none``."""
    joined = F.concat_ws(" ", *[text_or_empty(t) for t in texts])
    keep = any_pattern(joined, any_) & ~any_pattern(joined, none)
    for p in must:
        keep = keep & any_pattern(joined, [p])
    return df.withColumn("route", F.when(keep, "pass").otherwise("fail"))


def evidence_route(carrier: str = "endpoint_carrier") -> Column:
    c = F.col(carrier)
    return F.when(c.isin("figure", "supplement"), c).when(c.isin("table_text", "narrative"), "text").otherwise("unknown")


def readiness_reason(text_route: bool = True) -> Column:
    """First gate a paper fails, null when it is ready. The earlier variant has no text-route gate."""
    yes = lambda c: F.coalesce(F.col(c) == "yes", F.lit(False))
    gates = (
        F.when(F.coalesce(F.col("paper_type") != "primary_experiment", F.lit(True)), "not_primary")
        .when(~yes("mentions_drug"), "no_drug")
        .when(~(yes("franz_confirmed") | yes("mentions_diffusion_cell")), "no_cell")
        .when(~yes("endpoint_found"), "no_endpoint")
        .when(~yes("endpoint_time_found"), "no_time")
        .when(yes("figure_only"), "figure_only")
    )
    if text_route:
        gates = gates.when(evidence_route() != "text", "not_text_route")
    return gates


def readiness_gate(df: DataFrame, text_route: bool = True) -> DataFrame:
    reason = readiness_reason(text_route)
    return df.withColumns({"gate_reason": reason, "ready": F.when(reason.isNull(), "yes").otherwise("no")})


def queue_build(df: DataFrame) -> DataFrame:
    """One row per (paper, queue): text when ready, figure and supplement by route; a paper can be in two."""
    route = evidence_route()
    queues = F.array_compact(
        F.array(
            F.when(F.col("ready") == "yes", "text"),
            F.when((route == "figure") | F.coalesce(F.col("figure_only") == "yes", F.lit(False)), "figure"),
            F.when((route == "supplement") | F.coalesce(F.col("needs_supp") == "yes", F.lit(False)), "supplement"),
        )
    )
    return df.withColumn("queue", F.explode(queues))


def queue_priority() -> Column:
    """+2 for a table locator, +1 for a confirmed cell, +1 for a stated concentration."""
    return (
        F.when(F.contains(F.lower(text_or_empty("where_endpoint")), F.lit("table")), 2).otherwise(0)
        + F.when(F.col("franz_confirmed") == "yes", 1).otherwise(0)
        + F.when(F.col("conc_found") == "yes", 1).otherwise(0)
    )


def strict_pass() -> Column:
    """Six conditions on a verified record after unit conversion."""
    return F.coalesce(
        (F.col("franz_confirmed") == "yes") & (F.col("target_5pct") == "yes") & F.col("endpoint_value").isNotNull()
        & F.col("endpoint_time_h").isNotNull() & F.col("endpoint_kind").isin("amount_per_area", "amount_total")
        & F.col("endpoint_ug_cm2").isNotNull(),
        F.lit(False),
    )


def fail_bucket() -> Column:
    """First reason, in order, why a verified record fails."""
    differs = lambda c: F.coalesce(F.col(c) != "yes", F.lit(True))
    unconverted = F.col("endpoint_ug_cm2").isNull()
    return (
        F.when(differs("franz_confirmed"), "not_franz")
        .when(differs("target_5pct"), "not_5pct")
        .when(F.col("endpoint_value").isNull() | F.col("endpoint_time_h").isNull(), "missing_endpoint_or_time")
        .when(F.col("endpoint_kind") == "percent", "endpoint_is_percent")
        .when(
            unconverted & (F.col("endpoint_kind") == "amount_total") & F.col("area_cm2").isNull(),
            "total_amount_missing_area",
        )
        .when(unconverted, "unit_or_conversion_issue")
        .otherwise("other")
    )


def evidence_honesty(df: DataFrame, snippet: str, drugs=DRUG_NAMES) -> DataFrame:
    """Blank concentration evidence whose snippet does not name the drug, and say so in the notes."""
    text = F.trim(text_or_empty(snippet))
    named = any_pattern(F.lower(text), drugs)
    bad = (text != "") & ~named
    return df.withColumns(
        {
            "conc_found": F.when(bad, "uncertain").otherwise(F.col("conc_found")),
            "conc_raw": F.when(bad, "").otherwise(F.col("conc_raw")),
            "conc_basis": F.when(bad, "uncertain").otherwise(F.col("conc_basis")),
            "notes": F.when(bad, F.concat(text_or_empty("notes"), F.lit(" | conc_snippet_missing_drug"))).otherwise(
                F.col("notes")
            ),
            snippet: F.when(bad, "").otherwise(F.col(snippet)),
        }
    )


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per record and broken rule. A rule holds when its Column is true; null breaks it."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(*key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def required(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")


def one_of(c: str, values: list) -> Column:
    """Enumeration membership; a missing value is the business of ``required``."""
    return F.col(c).isNull() | F.col(c).isin(*values)


def typed(c: str, kind: str) -> Column:
    return F.col(c).isNull() | F.col(c).cast("string").try_cast(kind).isNotNull()


# Required keys of the published record, by the object that holds them ("" is the record).
RECORD_KEYS = {
    "": ("record_id", "paper", "device", "study_type", "barrier", "api", "formulation", "endpoints", "evidence", "formulation_completeness_class"),
    "paper": ("doi_or_pmid", "year", "title"),
    "device": ("name", "franz_confirmed"),
    "barrier": ("category", "name"),
    "api": ("name", "conc"),
    "api.conc": ("raw", "basis", "is_target_5pct"),
    "formulation": ("dosage_form", "ingredients"),
    "endpoints": ("Q_final",),
    "endpoints.Q_final": ("value", "unit", "time_h"),
    "evidence": ("source_type", "locator", "snippet"),
}
# Enumerations of the published record.
RECORD_VALUES = {
    "device.name": ("Franz diffusion cell",),
    "device.franz_confirmed": ("yes", "uncertain"),
    "study_type": ("IVPT", "IVRT"),
    "barrier.category": ("skin", "synthetic_membrane"),
    "api.name": ("ibuprofen",),
    "api.conc.basis": ("w/w", "w/v", "v/v", "mg/mL", "unknown"),
    "api.conc.is_target_5pct": ("yes", "no", "uncertain"),
    "evidence.source_type": ("Table", "Text", "Supplement"),
    "formulation_completeness_class": ("A", "B"),
}
INGREDIENT_BASES = ("w/w", "w/v", "v/v", "mg/mL", "balance", "unknown")


def record_rules() -> dict[str, Column]:
    """Rules of a nested record: required keys of objects that are there, enumerations, and the ingredients' own.

    Types are those of the struct; what does not parse into it is null and counts as missing.
    """
    rules = {}
    for owner, keys in RECORD_KEYS.items():
        for key in keys:
            path = f"{owner}.{key}" if owner else key
            here = F.col(path).isNotNull()
            rules[f"required {path}"] = F.col(owner).isNull() | here if owner else here
    for path, values in RECORD_VALUES.items():
        rules[f"value of {path}"] = one_of(path, list(values))
    items = F.col("formulation.ingredients")
    rules["required formulation.ingredients.name_raw"] = F.coalesce(F.forall(items, lambda x: x["name_raw"].isNotNull()), F.lit(True))
    rules["value of formulation.ingredients.conc_basis"] = F.coalesce(F.forall(items, lambda x: x["conc_basis"].isNull() | x["conc_basis"].isin(*INGREDIENT_BASES)), F.lit(True))
    return rules


def violation_rates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rate per rule in one pass over the records."""
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()],
    )
    tall = one.unpivot(["n"], list(rules), "rule", "violations")
    return tall.select("rule", "n", "violations", (F.col("violations") / F.col("n")).alias("rate"))


def holdout_policy(figure_only, basis, answer) -> Column:
    """Where a record goes: figure quarantine, unclear basis, other concentration, or in."""
    return (
        F.when(F.coalesce(F.col(figure_only) == "yes", F.lit(False)), "quarantine_figure_only")
        .when(F.coalesce(F.col(basis), F.lit("unknown")) == "unknown", "holdout_uncertain_basis")
        .when(F.col(answer) == "uncertain", "holdout_uncertain_basis")
        .when(F.col(answer) != "yes", "holdout_not_5pct")
        .otherwise("include")
    )


def api_from_components(
    df: DataFrame, value: str = "api_concentration_value", unit: str = "api_concentration_unit",
    basis: str = "api_basis", components: str = "components_json", drugs=("ibuprofen", "ibu"),
) -> DataFrame:
    """Percent of the drug: a stated percentage wins, else the first usable ingredient named like it.

    The components stay an array inside the row; nothing is exploded or shuffled.
    """
    looks_percent = lambda u: F.contains(u, F.lit("%")) | F.contains(F.lower(u), F.lit("wt"))
    own_unit = text_or_empty(unit)
    own = F.col(value).try_cast("double")
    stated = own.isNotNull() & (own_unit != "") & looks_percent(own_unit)

    def named(c: Column) -> Column:
        n = F.trim(F.lower(F.regexp_replace(text_or_empty(c["name_raw"]), r"\s+", " ")))
        return F.contains(n, F.lit(drugs[0])) | n.isin(*drugs[1:])

    def reading(c: Column) -> Column:
        name, u, b, remark = (
            text_or_empty(c[k]) for k in ("name_raw", "concentration_unit", "basis", "remark")
        )
        v = c["concentration_value"].try_cast("double")
        direct = v.isNotNull() & (u != "") & looks_percent(u)
        blob = F.trim(F.concat_ws(" ", name, u, b, remark))
        note = F.trim(F.concat(name, F.lit(": "), v.cast("string"), F.lit(" "), u, F.lit(" "), b, F.lit(" "), remark))
        return F.struct(
            F.when(direct, v).otherwise(parse_concentration(blob)).alias("pct"),
            F.when(direct, u).otherwise("%").alias("unit"),
            F.when(direct & (b != ""), b).otherwise("w/w").alias("basis"),
            F.when(direct, note).otherwise(F.concat(name, F.lit(": "), blob)).alias("evidence"),
        )

    parsed = safe_parse(components, COMPONENTS)
    readings = F.transform(F.filter(parsed, named), reading)
    first = F.get(F.filter(readings, lambda r: r["pct"].isNotNull()), F.lit(0))
    out = df.withColumn("__first", first)
    pick = lambda mine, field: F.when(stated, mine).otherwise(F.coalesce(F.col(f"__first.{field}"), F.lit("")))
    out = out.withColumns(
        {
            "pct_inferred": F.when(stated, own).otherwise(F.col("__first.pct")),
            "unit_inferred": pick(own_unit, "unit"),
            "basis_inferred": pick(F.when(text_or_empty(basis) != "", F.col(basis)).otherwise("w/w"), "basis"),
            "evidence_inferred": pick(F.lit("from_api_fields"), "evidence"),
        }
    )
    return out.withColumn("confirmed", is_target("pct_inferred")).drop("__first")


def triage_completeness(df: DataFrame, box: str, ranges: list[str], digitizable: str) -> DataFrame:
    """How many figures have a full calibration, over all and among digitizable ones."""
    full = F.col(box).isNotNull()
    for r in ranges:
        full = full & F.col(r).isNotNull()
    usable = F.coalesce(F.col(digitizable) == "yes", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("figures"), F.count_if(full).alias("complete"), F.count_if(usable).alias("digitizable"),
        F.count_if(full & usable).alias("complete_digitizable"),
    )

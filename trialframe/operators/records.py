"""Extracted records: flattening, unit standardisation, merging of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import minmax_fixed, softcap_objective
from ..functions.text import (
    anchor_pages, expr_features, id_tokens, norm_key, norm_label, safe_parse, table_hint, text_or_empty,
)
from ..functions.units import (
    amount_of, clean_unit, hours_of, is_balance, is_target, parse_concentration, percent_of, target_answer,
)
from .corpus import first_per_key


def ensure_columns(df: DataFrame, spec: dict[str, Column]) -> DataFrame:
    """Add the columns of ``spec`` the table lacks."""
    missing = {n: c for n, c in spec.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def flatten_records(papers: DataFrame, paper_cols: list[str], records: str = "records") -> DataFrame:
    """One row per record of a paper with a 1-based index; papers without records give no row."""
    exploded = papers.select(*paper_cols, F.posexplode(records).alias("__pos", "__rec"))
    return exploded.select(*paper_cols, (F.col("__pos") + 1).alias("record_idx"), "__rec.*")


def standardise_records(df: DataFrame) -> DataFrame:
    """Parsed concentration, target flags, hours, amounts, label keys and locators in one projection.

    Expects ``conc_raw, conc_value, conc_unit, conc_basis, endpoint_value, endpoint_unit, endpoint_kind,
    area_cm2, time_value, time_unit, label, locator``; absent ones count as null.
    """
    null = F.lit(None)
    strings = ["conc_raw", "conc_unit", "conc_basis", "endpoint_unit", "endpoint_kind", "time_unit", "label", "locator"]
    numbers = ["conc_value", "endpoint_value", "area_cm2", "time_value"]
    df = ensure_columns(
        df, {**{c: null.cast("string") for c in strings}, **{c: null.cast("double") for c in numbers}}
    )
    # cleaned once here: the rules below refer to each of these several times
    clean = df.withColumns(
        {
            "__balance": is_balance("conc_raw"), "__cu": clean_unit("conc_unit"), "__eu": clean_unit("endpoint_unit"),
            "__basis": F.lower(text_or_empty("conc_basis")), "__tu": norm_key("time_unit"),
        }
    )
    value, amount = F.col("conc_value").cast("double"), F.col("endpoint_value").cast("double")
    balance = F.col("__balance")
    out = clean.withColumns(
        {
            "conc_pct_text": F.when(~balance, parse_concentration("conc_raw")),
            "conc_pct": F.when(~balance, percent_of(value, F.col("__cu"), F.col("__basis"))),
            "conc_basis_std": F.when(balance, "balance").otherwise(F.coalesce("conc_basis", F.lit("unknown"))),
            "target_5pct": target_answer("conc_raw", "conc_value", "conc_unit", "conc_basis"),
            "endpoint_time_h": hours_of(F.col("time_value").cast("double"), F.col("__tu")),
            "endpoint_ug_cm2": amount_of(amount, F.col("__eu"), F.col("area_cm2").cast("double"), F.col("endpoint_kind")),
            "label_key": norm_label("label"),
            "label_ids": id_tokens("label"),
            "pages": anchor_pages("locator"),
            "table_ref": table_hint("locator"),
        }
    ).drop("__balance", "__cu", "__eu", "__basis", "__tu")
    return out.withColumns(
        {"target_exact": is_target("conc_pct"), "target_band": is_target(F.coalesce("conc_pct", "conc_pct_text"), "band")}
    )


def standardise_design(
    df: DataFrame, bounds: dict[str, tuple[float, float]], objective: str | None = None,
    cap: float = float("inf"), lam: float = 0.0, formula: str | None = None,
) -> DataFrame:
    """Fixed-bounds scaling of design axes, penalised objective and formula features in one projection."""
    cols = {f"{c}_scaled": minmax_fixed(c, lo, hi) for c, (lo, hi) in bounds.items()}
    if objective is not None:
        cols["objective_penalised"] = softcap_objective(objective, cap, lam)
    if formula is not None:
        cols.update(expr_features(formula))
    return df.withColumns(cols)


def parse_properties(df: DataFrame, text: str, schema: str, name: str) -> DataFrame:
    return df.withColumn(name, safe_parse(text, schema))


MERGE_KEY = ["doi", "formulation_label", "endpoint_kind", "endpoint_time_h", "endpoint_value_std"]


def _standard_source(df: DataFrame, source: str) -> DataFrame:
    if "endpoint_time_h" not in df.columns and "endpoint_time" in df.columns:
        df = df.withColumnRenamed("endpoint_time", "endpoint_time_h")
    null = F.lit(None).cast("string")
    df = ensure_columns(df, {"doi": null, "endpoint_time_h": null.cast("double"), "endpoint_kind": null})
    if "endpoint_value_ug_per_cm2" in df.columns:
        value, unit = F.col("endpoint_value_ug_per_cm2"), F.lit("ug/cm^2")
        unit = F.col("endpoint_unit_std") if "endpoint_unit_std" in df.columns else unit
    elif "endpoint_value" in df.columns:
        value = F.col("endpoint_value")
        unit = F.col("endpoint_unit") if "endpoint_unit" in df.columns else F.lit("")
    else:
        value, unit = F.lit(None).cast("double"), F.lit("")
    if "formulation_label" not in df.columns:
        other = next((c for c in ("vehicle_label", "formulation_id", "formula_id") if c in df.columns), None)
        df = df.withColumn("formulation_label", F.col(other) if other else F.lit(""))
    return df.withColumns({"source": F.lit(source), "endpoint_value_std": value, "endpoint_unit_std": unit})


def merge_sources(text: DataFrame, figure: DataFrame, tie: list[str], confirmed: str | None = None) -> DataFrame:
    """Text records then confirmed figure records, first one wins on the five-column key.

    ``tie`` orders the rows of one source; missing columns are filled with null.
    """
    if confirmed is not None:
        figure = figure.filter(F.coalesce(F.col(confirmed), F.lit(False)))
    both = _standard_source(text, "text").unionByName(_standard_source(figure, "figure"), allowMissingColumns=True)
    return first_per_key(both, MERGE_KEY, [F.desc("source"), *[F.asc(t) for t in tie]])

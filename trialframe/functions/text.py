"""Text Column expressions of the literature jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# every character Python and Unicode call white space, in a class Java and RE2 read alike
SPACES = r"[\t-\r\x1c-\x1f \x85\p{Z}]+"
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Words that carry no identity in a formulation label.
LABEL_NOISE = "formulation|formulations|vehicle|vehicles|gel|cream|solution|ointment|batch"
# Operators, variables and argument aliases of formula candidates.
FORMULA_OPERATORS = ("add", "sub", "mul", "div", "pow2")
FORMULA_VARIABLES = {"Q": "ARG0", "C1": "ARG1", "C2": "ARG2", "C3": "ARG3"}
TRUNCATION_MARK = " ...[truncated]"

# Page keywords and those that count three.
PAGE_KEYWORDS = (
    "ibuprofen", " ibu ", "franz", "diffusion cell", "permeation cell", "vertical diffusion", "ivpt", "ivrt",
    "in vitro permeation", "in vitro release", "cumulative", "amount permeated", "amount released", "permeation",
    "release", "flux", "jss", "steady-state", "table", "figure", "fig.", "supporting information", "supplement",
    "formulation", "composition", "ingredients", "vehicle", "% w/w", "w/w", "mg/g", "mg g", "µg/cm", "ug/cm", "cm2",
    "cm^2", "diffusion area", "effective area", "exposed area", "skin", "human skin", "porcine", "rat skin",
    "mouse skin", "membrane", "nylon", "strat-m", "synthetic membrane",
)
PAGE_STRONG = (
    "ibuprofen", "franz", "table", "supporting information", "supplement", "cumulative", "amount permeated",
    "amount released", "% w/w", "mg/g",
)
# Signals of a formulation table, any of the words giving the points.
TABLE_SIGNALS = (
    (("table",), 6), (("formulation", "composition"), 6), (("ingredient",), 3), (("ibuprofen",), 3),
    (("w/w", "wt%", "%"), 2), (("mg", " g ", "ml", "v/v"), 1),
)
# General keywords of such tables, a point each.
TABLE_KEYWORDS = (
    "table", "formulation", "formulations", "composition", "ingredient", "vehicle", "w/w", "wt%", "weight", "%", "mg", "g", "ml", "v/v",
    "propylene glycol", "ethanol", "poloxamer", "carbomer", "gel", "cream", "ibuprofen",
)


def text_or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(text_or_empty(c), F.lit(SPACE_CHARS))


def norm_ws(c) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), SPACES, " "))


def norm_key(c) -> Column:
    return F.lower(strip(c))


def safe_filename(c, max_len: int = 120) -> Column:
    bare = F.regexp_replace(norm_key(c), "https?://", "")
    name = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(name == "", "unknown").otherwise(name), 1, max_len)


def record_hash(doi, title, fallback) -> Column:
    """First ten hex digits of SHA-1 over the first non-empty key."""
    first = [F.when(norm_key(c) != "", norm_key(c)) for c in (doi, title)]
    return F.substring(F.sha1(F.encode(F.coalesce(*first, text_or_empty(fallback)), "utf-8")), 1, 10)


def is_pdf_url(c) -> Column:
    return F.contains(F.lower(text_or_empty(c)), F.lit("pdf"))


def truncate_text(c, n: int) -> Column:
    text = strip(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(TRUNCATION_MARK))).otherwise(text)


def any_pattern(c, patterns) -> Column:
    """Case-insensitive match of any pattern, as one alternation."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return col(c).rlike(f"(?i){joined}")


def keyword_score(c, keywords, strong=(), weight: int = 1, strong_weight: int = 3) -> Column:
    """Points for each distinct keyword found as a substring of the padded lower-case text."""
    return signal_score(c, [((k,), strong_weight if k in strong else weight) for k in keywords])


def table_page_score(c) -> Column:
    """How much a page looks like one with a formulation table."""
    return signal_score(c, [*TABLE_SIGNALS, *[((k,), 1) for k in TABLE_KEYWORDS]])


def signal_score(c, signals) -> Column:
    """Points for each signal of which any word occurs."""
    padded = F.concat(F.lit(" "), F.lower(text_or_empty(c)), F.lit(" "))

    def points(words, weight):
        hit = reduce(lambda a, b: a | b, [F.contains(padded, F.lit(w)) for w in words])
        return F.when(hit, weight).otherwise(0)

    return reduce(lambda a, b: a + b, [points(w, n) for w, n in signals], F.lit(0))


def norm_label(c) -> Column:
    words = F.regexp_replace(F.lower(text_or_empty(c)), rf"\b({LABEL_NOISE})\b", " ")
    return F.regexp_replace(words, "[^a-z0-9]+", "")


def id_tokens(c) -> Column:
    """Ordered distinct identifiers of a label: F1, single capitals, GEL-1, FORMULATION-A."""
    up = F.upper(text_or_empty(c))
    found = [
        F.regexp_extract_all(up, F.lit(r"\b(F\d+)\b")),
        F.regexp_extract_all(up, F.lit(r"\b([A-Z])\b")),
        F.regexp_extract_all(up, F.lit(r"\b(GEL[-\s]?\d+)\b")),
        F.regexp_extract_all(up, F.lit(r"\b(FORMULATION[-\s]?[A-Z0-9]+)\b")),
    ]
    return F.array_distinct(F.transform(F.concat(*found), lambda t: F.replace(t, F.lit(" "), F.lit(""))))


def anchor_pages(c) -> Column:
    """Zero-based pages named by 'page n' or 'p. n', sorted and distinct."""
    text = F.lower(text_or_empty(c))
    nums = F.concat(
        F.regexp_extract_all(text, F.lit(r"\bpage\s*(\d+)\b")), F.regexp_extract_all(text, F.lit(r"\bp\.?\s*(\d+)\b"))
    )
    pages = F.transform(nums, lambda s: s.try_cast("int"))
    kept = F.filter(pages, lambda p: p > 0)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda p: p - 1)))


def table_hint(c) -> Column:
    hit = F.regexp_extract(text_or_empty(c), r"(?i)(table\s*\d+)", 1)
    return F.when(hit != "", hit)


def expr_features(c) -> dict[str, Column]:
    """Size features of a formula candidate and the variables it uses."""
    text = text_or_empty(c)
    used = F.array(*[F.lit(v) for v in FORMULA_VARIABLES])
    held = [F.when(text.rlike(rf"\b({v}|{a})\b"), F.lit(v)) for v, a in FORMULA_VARIABLES.items()]
    return {
        "expression_length": F.length(text),
        "operator_calls": F.regexp_count(text, F.lit(rf"\b({'|'.join(FORMULA_OPERATORS)})\s*\(")),
        "constants": F.regexp_count(text, F.lit(r"(?i)(?<![A-Za-z_])-?\d+\.\d+(?:e[+-]?\d+)?")),
        "variables": F.array_intersect(used, F.array_compact(F.array(*held))),
    }


def safe_parse(c, schema: str) -> Column:
    """JSON, else a Python literal (single quotes, None/True/False), else null."""
    text = F.when(F.lower(F.trim(col(c))).isin("", "nan"), None).otherwise(F.trim(col(c)))
    # inside an array a malformed text parses to null, not to a struct of nulls
    inner = schema if schema.startswith(("array", "struct", "map")) else f"struct<{schema}>"

    def parse(t: Column, quotes: str) -> Column:
        wrapped = F.from_json(F.concat(F.lit("["), t, F.lit("]")), f"array<{inner}>", {"allowSingleQuotes": quotes})
        return F.get(wrapped, F.lit(0))

    loose = reduce(
        lambda t, pair: F.regexp_replace(t, rf"(?<=[:,\[\{{]\s{{0,8}}){pair[0]}(?=\s*[,\]\}}])", pair[1]),
        (("None", "null"), ("True", "true"), ("False", "false")), text,
    )
    return F.coalesce(parse(text, "false"), parse(loose, "true"))

"""Corpus jobs: cleaning, deduplication, resume, page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    PAGE_KEYWORDS, PAGE_STRONG, is_pdf_url, keyword_score, norm_key, norm_ws, record_hash, safe_filename, truncate_text,
)
from ..plans.ordered import join_on


def clean_corpus(
    df: DataFrame, title: str = "title", abstract: str = "abstract", doi: str = "doi", url: str = "url",
    max_chars: int = 2000,
) -> DataFrame:
    """Normalised text, keys, file names and PDF flags of papers in one narrow projection."""
    return df.withColumns(
        {
            "title_clean": norm_ws(title),
            "abstract_clean": norm_ws(abstract),
            "abstract_short": truncate_text(abstract, max_chars),
            "doi_key": norm_key(doi),
            "file_name": safe_filename(url),
            "record_hash": record_hash(doi, title, url),
            "is_pdf": is_pdf_url(url),
        }
    )


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def dedupe_corpus(
    df: DataFrame, doi: str = "doi", title: str = "title", year: str = "year", tie: str = "id", empty_is_key: bool = False
) -> DataFrame:
    """One row per DOI (earliest year), then one per (title, year).

    Papers without a DOI are different papers unless ``empty_is_key``, which treats the empty DOI as
    one more key and keeps a single one of them.
    """
    d = F.coalesce(F.col(doi), F.lit(""))
    # a paper without DOI is its own key: its identifier, kept apart from real DOIs by the flag
    own = F.lit(empty_is_key) | (d != "")
    keyed = df.withColumns(
        {"__own": own, "__key": F.when(own, d).otherwise(F.col(tie).cast("string"))}
    )
    first = first_per_key(keyed, ["__own", "__key"], [F.asc_nulls_last(year), F.asc(tie)]).drop("__own", "__key")
    # keep order of the sorted table: by DOI, then year
    return first_per_key(first, [title, year], [F.asc(F.coalesce(F.col(doi), F.lit(""))), F.asc(tie)])


def pending(df: DataFrame, done: DataFrame, keys: dict[str, Column], error: str | None = None) -> DataFrame:
    """Rows of ``df`` not yet in ``done`` by normalised key; failed rows are tried again."""
    finished = done if error is None else done.filter(F.coalesce(F.trim(F.col(error)), F.lit("")) == "")
    names = {f"__p{i}": c for i, c in enumerate(keys.values())}
    marks = finished.select(*[c.alias(n) for n, c in names.items()]).distinct()
    return join_on(df.withColumns(names), marks, list(names), "left_anti").drop(*names)


def expand_neighbours(anchors: DataFrame, doc: list[str], page: str, n_pages: str, k: int = 1) -> DataFrame:
    """Pages within ``k`` of an anchor, clipped to the document, each once."""
    span = F.sequence(F.greatest(F.col(page) - k, F.lit(0)), F.least(F.col(page) + k, F.col(n_pages) - 1))
    inside = anchors.filter((F.col(page) - k < F.col(n_pages)) & (F.col(page) + k >= 0) & (F.col(n_pages) > 0))
    return inside.select(*doc, F.explode(span).alias(page)).distinct()


def select_pages(
    pages: DataFrame, doc: list[str], page: str, text: str, score: Column | None = None, first: int = 2,
    limit: int = 12, max_chars: int = 26_000,
) -> DataFrame:
    """The leading pages and the best scored ones of each document, in page order, as one text.

    Ties go to the later page. A document without any selected page falls back to its first three.
    At most ``limit`` pages per document leave the map side, so the gathered list is bounded.
    """
    score = keyword_score(text, PAGE_KEYWORDS, PAGE_STRONG) if score is None else score
    kind = F.when(F.col(page) < first, 0).when(F.col("__score") > 0, 1).when(F.col(page) < 3, 2)
    scored = pages.withColumn("__score", score).withColumn("__kind", kind).filter(F.col("__kind").isNotNull())
    order = [
        F.asc("__kind"), F.desc(F.when(F.col("__kind") == 1, F.col("__score")).otherwise(0)),
        F.when(F.col("__kind") == 1, -F.col(page)).otherwise(F.col(page)),
    ]
    w = Window.partitionBy(*doc).orderBy(*order)
    kept = scored.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max(limit, first))
    kept = kept.withColumn("__best", F.min("__kind").over(Window.partitionBy(*doc)))
    kept = kept.filter((F.col("__kind") < 2) | (F.col("__best") == 2))
    shown = F.when(F.col("__kind") == 0, 999).otherwise(F.col("__score"))
    part = F.concat(
        F.lit("--- PAGE "), (F.col(page) + 1).cast("string"), F.lit(" (kw_score="), shown.cast("string"), F.lit(") --- "),
        F.col(text),
    )
    gathered = kept.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("pages"),
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), part.alias("t")))).alias("__parts"),
    )
    joined = norm_ws(F.array_join(F.transform("__parts", lambda s: s["t"]), " "))
    return gathered.select(*doc, "pages", F.substring(joined, 1, max_chars).alias("text"))


def select_table_pages(
    pages: DataFrame, doc: list[str], page: str, n_pages: str, score: str, image: str, drawn: str, limit: int = 5, k: int = 1
) -> DataFrame:
    """Pages of each document to read for tables: ``doc, page, weak``.

    A page counts by its text score, 5 for an image and 4 for drawings on 2 % of it or more. The best ``limit`` pages
    come with their neighbours and are cut to ``limit`` again by rank; neighbours without a score come last. ``weak``
    pages look like a table but have little text. Ties go to the earlier page.
    """
    graphic = F.col(image) | (F.col(drawn) >= 0.02)
    total = F.col(score) + F.when(F.col(image), 5).otherwise(0) + F.when(F.col(drawn) >= 0.02, 4).otherwise(0)
    w = Window.partitionBy(*doc).orderBy(F.desc("__total"), F.asc(page))
    scored = pages.withColumn("__total", total).filter(F.col("__total") > 0).withColumn("__rank", F.row_number().over(w))
    top = scored.filter(F.col("__rank") <= limit)
    near = expand_neighbours(top, doc, page, n_pages, k)
    ranks = scored.select(*doc, page, "__rank", ((F.col("__rank") <= limit) & (F.col(score) <= 3) & graphic).alias("weak"))
    both = join_on(near, ranks, [*doc, page], "left").withColumn("__last", F.col("__rank").isNull())
    best = Window.partitionBy(*doc).orderBy("__last", "__rank", page)
    return both.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= limit).select(*doc, page, F.coalesce("weak", F.lit(False)).alias("weak"))

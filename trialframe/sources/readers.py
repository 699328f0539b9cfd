"""Readers with declared schemas."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordered import join_on
from ..plans.stage import staged

SEARCH_SCHEMA = (
    "resultList struct<result:array<struct<source:string,id:string,pmid:string,doi:string,title:string,"
    "abstractText:string,journalTitle:string,authorString:string,pubYear:string,doiUrl:string,pmidUrl:string,"
    "fullTextUrlList:struct<fullTextUrl:array<struct<url:string>>>>>>, query string"
)
EXTRACTION_SCHEMA = (
    "doi string, title string, pdf_path string, records array<struct<study_type:string,cell_type:string,"
    "dosage_form:string,barrier_category:string,barrier_name:string,api_conc_raw:string,diffusion_area_cm2:double,"
    "endpoint_main:struct<endpoint_type:string,value:double,unit:string,time_value:double,time_unit:string>,"
    "ingredients:array<struct<name:string,concentration_raw:string>>,"
    "evidence:array<struct<field:string,locator:string,snippet:string>>,"
    "needs_supp:string,confidence:double,notes:string>>"
)


def read_search_dump(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Papers of saved search responses; the link is the DOI, the PubMed or the first full-text one.

    A multi-line response is one unsplittable file; one response per line splits and scales.
    """
    raw = spark.read.schema(SEARCH_SCHEMA).option("multiLine", multi_line).json(path)
    r = raw.select(F.explode_outer("resultList.result").alias("r"), "query").filter("r IS NOT NULL")
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    link = F.coalesce(filled("r.doiUrl"), filled("r.pmidUrl"), F.get(F.col("r.fullTextUrlList.fullTextUrl"), F.lit(0))["url"])
    return r.select(
        "r.source", "r.id", "r.pmid", "r.doi", "r.title", F.col("r.abstractText").alias("abstract"),
        F.col("r.pubYear").try_cast("int").alias("year"), F.col("r.journalTitle").alias("journal"),
        F.col("r.authorString").alias("authors"), link.alias("url"), F.col("query").alias("query_used"),
    )


def _csv_lines(spark: SparkSession, path: str, split_bytes: int | None) -> DataFrame:
    """(file, block, at, line): the lines of the files in ``path``, with the byte range they were read in and their order."""
    reader = spark.read.option("lineSep", "\n")
    if split_bytes is not None:
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        lines = reader.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
        return staged(lines, "csv-lines")  # so the order can't differ between the passes below
    finally:
        if split_bytes is not None:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def read_records_csv(spark: SparkSession, path: str, schema: str, split_bytes: int | None = None) -> DataFrame:
    """CSV with a header line, quoted line breaks and doubled quotes, and maybe a byte-order mark; a file of any size is read
    by many tasks.

    A line begins a record if the quotes before it in its file are even in number. Quotes are counted per byte range; the
    ranges' sums, one row a range, tell each range how it begins and which record its first lines may belong to. Lines
    that are a whole record are parsed where they are; only records of several lines are gathered, each by itself.
    Columns go by position; fields that don't parse are null. Lines end in a line feed, with or without a carriage return
    before it. ``split_bytes``: the size of the ranges, else the session's.
    """
    lines = _csv_lines(spark, path, split_bytes)
    quotes = F.regexp_count("line", F.lit('"')).cast("long")
    within = Window.partitionBy("file", "block").orderBy("at")
    past = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = lines.withColumn("quotes", quotes).withColumn("past", past)
    begins = lambda parity: F.max(F.when(F.pmod("past", F.lit(2)) == parity, F.col("at")))
    ranges = local.groupBy("file", "block").agg(F.sum("quotes").alias("n"), begins(0).alias("even"), begins(1).alias("odd"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("open", F.pmod(F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.lit(2)))
    ranges = ranges.withColumn("last", F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd")))
    ranges = ranges.select(
        F.col("file").alias("f"), F.col("block").alias("b"), "open", F.last("last", ignorenulls=True).over(earlier).alias("carried"),
        F.first("first").over(Window.partitionBy("file").orderBy("block")).alias("header"))
    known = local.join(ranges, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    start = F.pmod(F.col("past") + F.col("open"), F.lit(2)) == 0
    whole = start & (F.pmod("quotes", F.lit(2)) == 0)
    known = known.withColumns({"record": F.coalesce(F.last(F.when(start, F.col("at")), ignorenulls=True).over(within), F.col("carried")), "whole": whole})
    known = known.filter(F.col("record") != F.col("header"))
    several = known.filter("NOT whole").groupBy("file", "record").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "at", "line")))["line"], "\n").alias("line"))
    records = known.filter("whole").select("line").unionByName(several.select("line"))
    text = F.regexp_replace("line", "\r$", "")
    parsed = records.filter(text != "").select(F.from_csv(text, F.lit(schema), {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*")


def read_extraction_jsonl(spark: SparkSession, path: str, schema: str = EXTRACTION_SCHEMA) -> DataFrame:
    """Nested papers, one JSON object per line; malformed lines are left out."""
    bad = "_corrupt_record"
    raw = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").json(path)
    read = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in raw.columns if c != bad])
    return raw.filter(F.col(bad).isNull() & read).drop(bad)


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]]) -> dict[str, str]:
    """Map wanted names to actual columns: exact (ignoring case) first, then by containment."""
    actual = {c.strip().lower(): c for c in df.columns}
    found = {}
    for want, names in aliases.items():
        low = [n.lower() for n in names]
        hit = next((actual[n] for n in low if n in actual), None)
        hit = hit or next((c for k, c in actual.items() if any(n in k for n in low)), None)
        if hit is None:
            raise KeyError(f"no column for {want!r} among {df.columns}")
        found[want] = hit
    return found


def read_experiment_pair(
    formulas: DataFrame, releases: DataFrame, aliases: dict[str, list[str]], run: str = "run_no", prefix: str = "R_t"
) -> DataFrame:
    """Formulas and their release columns (ordered by number) joined on the run."""
    f = resolve_columns(formulas, aliases)
    r = resolve_columns(releases, {run: aliases[run]})
    numbered = [(int(m.group(1)), c) for c in releases.columns if (m := re.fullmatch(rf"{re.escape(prefix)}(\d+)", c.strip()))]
    left = formulas.select(*[F.col(f"`{c}`").alias(n) for n, c in f.items()])
    right = releases.select(F.col(f"`{r[run]}`").alias(run), *[F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in sorted(numbered)])
    return join_on(left, right, [run])


def combine_parts(parts: list[DataFrame], orders: dict[str, list[str]], sort: list[str]) -> DataFrame:
    """Stack part tables and sort by the columns, named ones in their given order of values."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    keys = []
    for c in sort:
        if c in orders:
            place = F.array_position(F.array(*[F.lit(v) for v in orders[c]]), F.col(c))
            keys.append(F.when(place > 0, place).otherwise(len(orders[c]) + 1).asc())
        keys.append(F.asc(c))
    return out.orderBy(*keys)

"""Reader and sink queries: the tables are written in the source format first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import readers as S
from ..sources import writers as W
from .base import query, table


@query(
    "search_dump_papers",
    """SELECT doc_id::VARCHAR AS id, source, md5(text) AS title, 1990 + n_chars % 30 AS year, CASE WHEN n_chars % 3 = 0 THEN 'doi/' || doc_id WHEN n_chars % 3 = 1 THEN 'pm/' || doc_id ELSE 'full/' || doc_id END AS url, lang AS query_used FROM documents""",
)
def search_dump_papers(spark, sf):
    d = table(spark, sf, "documents")
    k, name = F.col("n_chars") % 3, F.col("doc_id").cast("string")
    link = lambda p: F.concat(F.lit(p), name)
    hit = F.struct(
        "source", name.alias("id"), F.col("text").alias("title"), (1990 + F.col("n_chars") % 30).cast("string").alias("pubYear"),
        F.when(k == 0, link("doi/")).otherwise("").alias("doiUrl"), F.when(k == 1, link("pm/")).alias("pmidUrl"),
        F.struct(F.array(F.struct(link("full/").alias("url"))).alias("fullTextUrl")).alias("fullTextUrlList"),
    )
    path = scratch_path(spark, "dump")
    d.select(F.struct(F.array(hit).alias("result")).alias("resultList"), F.col("lang").alias("query")).write.json(path)
    out = S.read_search_dump(spark, path, multi_line=False)
    return out.select("id", "source", F.md5("title").alias("title"), F.col("year").cast("long").alias("year"), "url", "query_used")


@query("records_csv_documents", "SELECT doc_id, md5(text) AS text, lang, n_chars FROM documents")
def records_csv_documents(spark, sf):
    path = scratch_path(spark, "csv")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    d.write.options(header=True, escape='"', quoteAll=True).csv(path)
    out = S.read_records_csv(spark, path, "doc_id long, text string, lang string, n_chars long")
    return out.withColumn("text", F.md5("text"))


@query("records_csv_in_ranges", "SELECT doc_id, md5(text) AS text, lang, n_chars FROM documents")
def records_csv_in_ranges(spark, sf):
    """Files with line breaks inside quotes, each cut into many byte ranges."""
    path = scratch_path(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars").write.options(header=True, escape='"').csv(path)
    out = S.read_records_csv(spark, path, "doc_id long, text string, lang string, n_chars long", split_bytes=100_000)
    return out.withColumn("text", F.md5("text"))


@query(
    "extraction_lines_conversations",
    "SELECT conv_id::VARCHAR AS doi, role AS title, 1 AS records, md5(text) AS notes FROM conversations",
)
def extraction_lines_conversations(spark, sf):
    c = table(spark, sf, "conversations")
    record = F.struct(F.col("role").alias("study_type"), F.col("text").alias("notes"))
    path = scratch_path(spark, "jsonl")
    c.select(F.col("conv_id").cast("string").alias("doi"), F.col("role").alias("title"), F.array(record).alias("records")).write.json(path)
    out = S.read_extraction_jsonl(spark, path)
    return out.select("doi", "title", F.size("records").alias("records"), F.md5(F.col("records")[0]["notes"]).alias("notes"))


@query(
    "experiment_pairs_by_supplier",
    """WITH r AS (SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS a, sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS b FROM lineitem GROUP BY 1)
    SELECT s_suppkey AS run_no, s_acctbal AS c1, s_nationkey::BIGINT AS c2, a AS "R_t1", b AS "R_t10" FROM supplier JOIN r ON s_suppkey = l_suppkey""",
)
def experiment_pairs_by_supplier(spark, sf):
    forms = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Run No"), F.col("s_acctbal").alias("Poloxamer 407 (%)"), F.col("s_nationkey").cast("long").alias("Ethanol"))
    n = F.col("l_linenumber")
    rel = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run no")).agg(F.sum(F.when(n == 2, F.col("l_quantity"))).alias("R_t10"), F.sum(F.when(n == 1, F.col("l_quantity"))).alias("R_t1"))
    return S.read_experiment_pair(forms, rel, {"run_no": ["run no"], "c1": ["poloxamer 407"], "c2": ["ethanol"]})


@query("routed_orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'pass' ELSE 'fail' END AS route FROM orders")
def routed_orders(spark, sf):
    path = scratch_path(spark, "routed")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "pass").otherwise("fail").alias("route"))
    W.write_routed(o, "route", path)
    return spark.read.schema("o_orderkey long, route string").parquet(path)


@query("appended_status", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def appended_status(spark, sf):
    path = scratch_path(spark, "status")
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    for status in ("F", "O"):
        W.status_append(counts.filter(F.col("l_linestatus") == status), path)
    return spark.read.schema("l_returnflag string, l_linestatus string, n long").parquet(path)

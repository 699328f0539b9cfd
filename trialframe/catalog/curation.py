"""Literature-record curation queries over the documents, pages, conversations, orders and sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import joins as J
from ..operators import records as D
from ..operators import rules as U
from ..operators import sets
from ..operators import vocabulary as V
from ..sources.readers import combine_parts
from .base import DAY_CURVE, R, day_curve, grid, gridded, query, table

WS = X.SPACES
TRIM = f", '{X.SPACE_CHARS}'"
HIDE = lambda *cs: {c: F.md5(F.col(c)) for c in cs}  # noqa: E731 - long texts are compared by digest


def sql_norm_ws(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


def sql_strip(c: str) -> str:
    return f"trim(coalesce({c}, ''){TRIM})"


@query(
    "clean_corpus_documents",
    f"""SELECT doc_id, md5({sql_norm_ws('text')}) AS abstract_clean, md5(CASE WHEN length({sql_strip('text')}) > 2000 THEN substring({sql_strip('text')}, 1, 2000) || '{X.TRUNCATION_MARK}'
      ELSE {sql_strip('text')} END) AS abstract_short, lower({sql_strip('source')}) AS doi_key,
      substring(sha1(CASE WHEN lang = 'es' THEN lower({sql_strip('text')}) ELSE lower({sql_strip('source')}) END), 1, 10) AS record_hash FROM documents""",
)
def clean_corpus_documents(spark, sf):
    docs = table(spark, sf, "documents").withColumn("doi", F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("source")))
    out = C.clean_corpus(docs, title="text", abstract="text", doi="doi", url="source")
    return out.select("doc_id", F.md5("abstract_clean").alias("abstract_clean"), F.md5("abstract_short").alias("abstract_short"), X.norm_key("source").alias("doi_key"), "record_hash")


@query(
    "page_file_names",
    """SELECT page_id, substring(CASE WHEN f = '' THEN 'unknown' ELSE f END, 1, 120) AS file_name, substring(sha1(lower(trim(url))), 1, 10) AS record_hash, contains(lower(html), 'pdf') AS mentions_pdf
    FROM (SELECT *, regexp_replace(regexp_replace(replace(replace(lower(trim(url)), 'https://', ''), 'http://', ''), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS f FROM pages)""",
)
def page_file_names(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.safe_filename("url").alias("file_name"), X.record_hash("url", F.lit(""), F.lit("")).alias("record_hash"),
        X.is_pdf_url("html").alias("mentions_pdf"),
    )


@query(
    "corpus_dedupe",
    """WITH p AS (SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE source || '/' || n_chars END AS doi, text AS title, CASE WHEN lang <> 'de' THEN 1990 + n_chars % 30 END AS year FROM documents),
    a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY CASE WHEN doi = '' THEN 'id' || doc_id ELSE 'doi' || doi END ORDER BY year NULLS LAST, doc_id) = 1)
    SELECT doc_id, doi, year FROM a QUALIFY row_number() OVER (PARTITION BY title, year ORDER BY doi, doc_id) = 1""",
)
def corpus_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "es", "").otherwise(F.concat_ws("/", "source", "n_chars")).alias("doi"), F.col("text").alias("title"),
        F.when(F.col("lang") != "de", 1990 + F.col("n_chars") % 30).alias("year"),
    )
    return C.dedupe_corpus(docs, tie="doc_id").select("doc_id", "doi", "year")


@query(
    "first_order_per_customer",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_order_per_customer(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return C.first_per_key(orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


SCREEN = {
    "must": [r"(^|[^\p{L}\p{N}_])(the|der|la)([^\p{L}\p{N}_]|$)"],
    "any_": [r"tion", r"ung([^\p{L}\p{N}_]|$)", r"eau"],
    "none": [r"password", r"copyright", r"[0-9]{4,}"],
}


@query(
    "document_keyword_screen",
    f"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i){SCREEN['must'][0]}') AND regexp_matches(t, '(?i){"|".join(SCREEN['any_'])}') AND NOT regexp_matches(t, '(?i){"|".join(SCREEN['none'])}')
    THEN 'pass' ELSE 'fail' END AS route FROM (SELECT doc_id, source || ' ' || text AS t FROM documents)""",
)
def document_keyword_screen(spark, sf):
    docs = table(spark, sf, "documents")
    return U.keyword_screen(docs, ["source", "text"], **SCREEN).select("doc_id", "route")


TURN_WORDS = ("the", " die ", "que", "tion", "ung", "eau", "heit", "and")
TURN_STRONG = ("tion", "ung")


def _turn_score_sql() -> str:
    return " + ".join(
        f"(CASE WHEN contains(' ' || lower(text) || ' ', '{w}') THEN {3 if w in TURN_STRONG else 1} ELSE 0 END)" for w in TURN_WORDS
    )


@query("turn_keyword_scores", f"SELECT conv_id, turn, ({_turn_score_sql()})::INT AS score FROM conversations")
def turn_keyword_scores(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.keyword_score("text", TURN_WORDS, TURN_STRONG).alias("score"))


@query(
    "page_table_signals",
    """SELECT page_id, (6*contains(t,'table')::INT + 6*(contains(t,'formulation') OR contains(t,'composition'))::INT + 3*contains(t,'ingredient')::INT + 3*contains(t,'ibuprofen')::INT
    + 2*(contains(t,'w/w') OR contains(t,'wt%') OR contains(t,'%'))::INT + (contains(t,'mg') OR contains(t,' g ') OR contains(t,'ml') OR contains(t,'v/v'))::INT
    + list_sum(list_transform(['table','formulation','formulations','composition','ingredient','vehicle','w/w','wt%','weight','%','mg','g','ml','v/v','propylene glycol','ethanol','poloxamer',
        'carbomer','gel','cream','ibuprofen'], lambda k: contains(t, k)::INT)))::INT AS score
    FROM (SELECT page_id, ' ' || lower(html) || ' ' AS t FROM pages)""",
)
def page_table_signals(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.table_page_score("html").alias("score"))


@query(
    "selected_turns",
    f"""WITH s AS (SELECT conv_id, turn, text, {_turn_score_sql()} AS sc FROM conversations),
    k AS (SELECT *, CASE WHEN turn < 1 THEN 0 WHEN sc > 0 THEN 1 WHEN turn < 3 THEN 2 END AS kind FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind, CASE WHEN kind = 1 THEN sc ELSE 0 END DESC, CASE WHEN kind = 1 THEN -turn ELSE turn END) AS rn,
      min(kind) OVER (PARTITION BY conv_id) AS best FROM k WHERE kind IS NOT NULL)
    SELECT conv_id, count(*) AS pages, md5(substring({sql_norm_ws("string_agg('--- PAGE ' || (turn+1) || ' (kw_score=' || CASE WHEN kind = 0 THEN 999 ELSE sc END || ') --- ' || text, ' ' ORDER BY turn)")}, 1, 26000)) AS text
    FROM r WHERE rn <= 4 AND (kind < 2 OR best = 2) GROUP BY conv_id""",
)
def selected_turns(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("int"))
    score = X.keyword_score("text", TURN_WORDS, TURN_STRONG)
    out = C.select_pages(turns, ["conv_id"], "turn", "text", score, first=1, limit=4)
    return out.withColumn("text", F.md5("text"))


@query(
    "neighbour_turns",
    f"""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
    a AS (SELECT conv_id, turn, n FROM (SELECT conv_id, turn, {_turn_score_sql()} AS sc FROM conversations) JOIN n USING (conv_id) WHERE sc >= 3)
    SELECT DISTINCT conv_id, unnest(range(greatest(turn - 1, 0), least(turn + 1, n - 1) + 1)) AS turn FROM a""",
)
def neighbour_turns(spark, sf):
    conv = table(spark, sf, "conversations")
    size = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    anchors = conv.withColumn("sc", X.keyword_score("text", TURN_WORDS, TURN_STRONG)).filter("sc >= 3").select("conv_id", "turn")
    return C.expand_neighbours(anchors.join(size, "conv_id"), ["conv_id"], "turn", "n", 1)


@query(
    "pending_documents",
    "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)",
)
def pending_documents(spark, sf):
    docs, done = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    done = done.withColumn("error", F.when(F.col("toxic") == 1, "toxic"))
    return C.pending(docs, done, {"doc_id": F.col("doc_id")}, error="error")


# ---- record standardisation over sales lines ---------------------------------------------------
RAW_SQL = """raw AS (SELECT l_orderkey, l_linenumber, l_quantity AS conc_value,
   CASE l_linenumber WHEN 1 THEN '%' WHEN 2 THEN 'mg/g' WHEN 3 THEN 'g/100 g' WHEN 4 THEN 'mg/mL' WHEN 5 THEN '% w/v' WHEN 6 THEN 'WT%' ELSE '' END AS conc_unit,
   CASE l_returnflag WHEN 'A' THEN 'w/w' WHEN 'N' THEN 'mg/g' END AS conc_basis,
   CASE l_linenumber WHEN 1 THEN l_quantity || '% w/w' WHEN 2 THEN l_quantity || ' mg/g' WHEN 3 THEN l_quantity || ' g/100 g' WHEN 4 THEN l_quantity || ' g per 100 g'
     WHEN 5 THEN 'q.s. to ' || l_quantity || ' %' WHEN 6 THEN l_quantity || ' mg/mL' ELSE 'make up to volume' END AS conc_raw,
   l_extendedprice AS endpoint_value, CASE l_linenumber WHEN 1 THEN 'µg/cm²' WHEN 2 THEN 'mg/cm^2' WHEN 3 THEN 'ng / cm2' WHEN 4 THEN 'mg/cm2/h' WHEN 5 THEN 'mg' WHEN 6 THEN 'μg' ELSE '%' END AS endpoint_unit,
   CASE WHEN l_linenumber <= 4 THEN 'amount_per_area' WHEN l_linenumber <= 6 THEN 'amount_total' ELSE 'percent' END AS endpoint_kind,
   CASE WHEN l_discount > 0 THEN l_discount * 10 END AS area_cm2, l_tax * 100 AS time_value, CASE l_returnflag WHEN 'A' THEN 'h' WHEN 'N' THEN 'Min' ELSE 'days' END AS time_unit FROM lineitem)"""


def _raw_records(spark, sf):
    li = table(spark, sf, "lineitem")
    q, n = F.col("l_quantity").cast("string"), F.col("l_linenumber")

    def case(values, default):
        out = F.when(n == 1, values[0])
        for i, v in enumerate(values[1:], start=2):
            out = out.when(n == i, v)
        return out.otherwise(default)

    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("conc_value"),
        case(["%", "mg/g", "g/100 g", "mg/mL", "% w/v", "WT%"], "").alias("conc_unit"),
        F.when(F.col("l_returnflag") == "A", "w/w").when(F.col("l_returnflag") == "N", "mg/g").alias("conc_basis"),
        case([F.concat(q, F.lit(s)) for s in ("% w/w", " mg/g", " g/100 g", " g per 100 g")]
             + [F.concat(F.lit("q.s. to "), q, F.lit(" %")), F.concat(q, F.lit(" mg/mL"))], "make up to volume").alias("conc_raw"),
        F.col("l_extendedprice").alias("endpoint_value"),
        case(["µg/cm²", "mg/cm^2", "ng / cm2", "mg/cm2/h", "mg", "μg"], "%").alias("endpoint_unit"),
        F.when(n <= 4, "amount_per_area").when(n <= 6, "amount_total").otherwise("percent").alias("endpoint_kind"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("area_cm2"), (F.col("l_tax") * 100).alias("time_value"),
        F.when(F.col("l_returnflag") == "A", "h").when(F.col("l_returnflag") == "N", "Min").otherwise("days").alias("time_unit"),
    )


STD_SQL = RAW_SQL + r""", cu AS (SELECT *, replace(translate(replace(lower(endpoint_unit), '^2', '2'), 'µμ²', 'uu2'), ' ', '') AS eu, replace(lower(conc_unit), ' ', '') AS u,
     regexp_matches(conc_raw, '(?i)\bqs\b|\bq\.\s?s\.|\bbalance\b|make up to') AS bal FROM raw),
  st AS (SELECT *, CASE WHEN NOT bal THEN coalesce(try_cast(nullif(regexp_extract(conc_raw, '(?i)(\d+(?:\.\d+)?)\s*(?:%|wt%|w/w%|%w/w)', 1), '') AS DOUBLE),
       try_cast(nullif(regexp_extract(conc_raw, '(?i)(\d+(?:\.\d+)?)\s*mg\s*/\s*g', 1), '') AS DOUBLE) * 0.1, try_cast(nullif(regexp_extract(conc_raw, '(?i)(\d+(?:\.\d+)?)\s*g\s*/\s*100\s*g', 1), '') AS DOUBLE),
       try_cast(nullif(regexp_extract(conc_raw, '(?i)(\d+(?:\.\d+)?)\s*g\s*per\s*100\s*g', 1), '') AS DOUBLE)) END AS pct_text,
     CASE WHEN bal THEN NULL WHEN contains(u, '%') OR contains(u, 'w/w') THEN conc_value WHEN contains(u, 'mg/g') THEN conc_value * 0.1 WHEN contains(u, 'g/100g') THEN conc_value
       WHEN conc_basis = 'mg/g' THEN conc_value * 0.1 END AS pct,
     CASE WHEN bal THEN 'balance' ELSE coalesce(conc_basis, 'unknown') END AS basis_std,
     CASE WHEN regexp_matches(lower(conc_raw), '\b5(\.0)?\s*%\s*(w/w)?\b') OR regexp_matches(lower(conc_raw), '\b50(\.0)?\s*mg\s*/\s*g\b') THEN 'yes'
       WHEN conc_basis = 'w/w' AND conc_unit = '%' THEN CASE WHEN abs(conc_value - 5) <= 0.2 THEN 'yes' ELSE 'no' END ELSE 'uncertain' END AS target_5pct,
     CASE WHEN lower(time_unit) = 'h' THEN time_value WHEN lower(time_unit) = 'min' THEN time_value / 60 END AS th,
     CASE WHEN contains(eu, 'ug') THEN 1.0::DOUBLE WHEN contains(eu, 'mg') THEN 1000.0::DOUBLE WHEN contains(eu, 'ng') THEN 0.001::DOUBLE END AS sc FROM cu),
  fin AS (SELECT *, CASE WHEN eu LIKE '%/h' THEN NULL WHEN endpoint_kind = 'amount_per_area' AND contains(eu, 'cm') THEN endpoint_value * sc WHEN endpoint_kind = 'amount_total' AND area_cm2 > 0 THEN endpoint_value * sc / area_cm2 END AS ug FROM st)"""


@query(
    "standardised_records",
    f"""WITH {STD_SQL} SELECT l_orderkey, l_linenumber, {R('pct_text', 4)} AS conc_pct_text, {R('pct', 4)} AS conc_pct, basis_std AS conc_basis_std, target_5pct, {R('th', 6)} AS endpoint_time_h,
    {R('ug/1000', 4)} AS endpoint_mg_cm2, coalesce(abs(pct - 5) < 1e-6, false) AS target_exact, coalesce(coalesce(pct, pct_text) BETWEEN 4.8 AND 5.2, false) AS target_band FROM fin""",
)
def standardised_records(spark, sf):
    out = D.standardise_records(_raw_records(spark, sf)).withColumn("endpoint_mg_cm2", F.col("endpoint_ug_cm2") / 1000)
    out = gridded(out, conc_pct_text=4, conc_pct=4, endpoint_time_h=6, endpoint_mg_cm2=4)
    return out.select("l_orderkey", "l_linenumber", "conc_pct_text", "conc_pct", "conc_basis_std", "target_5pct", "endpoint_time_h", "endpoint_mg_cm2", "target_exact", "target_band")


FAILS = """CASE WHEN franz_confirmed <> 'yes' THEN 'not_franz' WHEN target_5pct <> 'yes' THEN 'not_5pct' WHEN endpoint_value IS NULL OR th IS NULL THEN 'missing_endpoint_or_time'
   WHEN endpoint_kind = 'percent' THEN 'endpoint_is_percent' WHEN ug IS NULL AND endpoint_kind = 'amount_total' AND area_cm2 IS NULL THEN 'total_amount_missing_area' WHEN ug IS NULL THEN 'unit_or_conversion_issue' ELSE 'other' END"""


def _verified(spark, sf):
    std = D.standardise_records(_raw_records(spark, sf))
    # a wider target so that every later bucket is reached
    target = F.when(F.col("target_5pct") == "uncertain", "yes").otherwise(F.col("target_5pct"))
    return std.withColumns({"target_5pct": target, "franz_confirmed": F.when(F.col("conc_value") > 10, "yes").otherwise("uncertain")})


@query(
    "verification_buckets",
    f"""WITH {STD_SQL}, v AS (SELECT * REPLACE (CASE WHEN target_5pct = 'uncertain' THEN 'yes' ELSE target_5pct END AS target_5pct), CASE WHEN conc_value > 10 THEN 'yes' ELSE 'uncertain' END AS franz_confirmed FROM fin),
    b AS (SELECT {FAILS} AS bucket, franz_confirmed = 'yes' AND target_5pct = 'yes' AND endpoint_value IS NOT NULL AND th IS NOT NULL AND endpoint_kind IN ('amount_per_area', 'amount_total') AND ug IS NOT NULL AS passed FROM v)
    SELECT bucket, passed, count(*) AS n FROM b GROUP BY bucket, passed""",
)
def verification_buckets(spark, sf):
    v = _verified(spark, sf).select(U.fail_bucket().alias("bucket"), U.strict_pass().alias("passed"))
    return v.groupBy("bucket", "passed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "holdout_policy_counts",
    f"""WITH {STD_SQL} SELECT CASE WHEN l_linenumber = 7 THEN 'quarantine_figure_only' WHEN basis_std = 'unknown' OR target_5pct = 'uncertain' THEN 'holdout_uncertain_basis'
    WHEN target_5pct <> 'yes' THEN 'holdout_not_5pct' ELSE 'include' END AS policy, count(*) AS n FROM fin GROUP BY 1""",
)
def holdout_policy_counts(spark, sf):
    std = D.standardise_records(_raw_records(spark, sf)).withColumn("figure_only", F.when(F.col("l_linenumber") == 7, "yes").otherwise("no"))
    return std.groupBy(U.holdout_policy("figure_only", "conc_basis_std", "target_5pct").alias("policy")).agg(F.count(F.lit(1)).alias("n"))


# ---- evidence gates over orders ----------------------------------------------------------------
EV_SQL = """ev AS (SELECT o_orderkey, o_orderpriority, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'figure' WHEN '2' THEN 'supplement' WHEN '3' THEN 'table_text' WHEN '4' THEN 'narrative' END AS endpoint_carrier,
  CASE o_orderstatus WHEN 'O' THEN 'review' ELSE 'primary_experiment' END AS paper_type, CASE WHEN o_totalprice > 20000 THEN 'yes' ELSE 'no' END AS mentions_drug,
  CASE WHEN o_custkey % 3 = 0 THEN 'yes' ELSE 'uncertain' END AS franz_confirmed, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS mentions_diffusion_cell,
  CASE WHEN o_custkey % 7 = 0 THEN 'no' ELSE 'yes' END AS endpoint_found, CASE WHEN o_custkey % 11 = 0 THEN 'uncertain' ELSE 'yes' END AS endpoint_time_found,
  CASE WHEN o_custkey % 13 = 0 THEN 'yes' ELSE 'no' END AS figure_only, CASE WHEN o_custkey % 5 = 0 THEN 'yes' ELSE 'no' END AS needs_supp,
  CASE WHEN o_custkey % 4 = 0 THEN 'see ' || o_orderpriority ELSE 'Table ' || o_custkey END AS where_endpoint, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS conc_found FROM orders),
  gt AS (SELECT *, CASE WHEN endpoint_carrier IN ('figure','supplement') THEN endpoint_carrier WHEN endpoint_carrier IN ('table_text','narrative') THEN 'text' ELSE 'unknown' END AS route FROM ev),
  gs AS (SELECT *, CASE WHEN paper_type <> 'primary_experiment' THEN 'not_primary' WHEN mentions_drug <> 'yes' THEN 'no_drug' WHEN NOT (franz_confirmed = 'yes' OR mentions_diffusion_cell = 'yes') THEN 'no_cell'
    WHEN endpoint_found <> 'yes' THEN 'no_endpoint' WHEN endpoint_time_found <> 'yes' THEN 'no_time' WHEN figure_only = 'yes' THEN 'figure_only' WHEN route <> 'text' THEN 'not_text_route' END AS gate_reason FROM gt)"""


def _evidence(spark, sf):
    o = table(spark, sf, "orders")
    k, p = F.col("o_custkey"), F.substring("o_orderpriority", 1, 1)
    yes = lambda cond, other="no": F.when(cond, "yes").otherwise(other)
    return o.select(
        "o_orderkey", "o_orderpriority",
        F.when(p == "1", "figure").when(p == "2", "supplement").when(p == "3", "table_text").when(p == "4", "narrative").alias("endpoint_carrier"),
        F.when(F.col("o_orderstatus") == "O", "review").otherwise("primary_experiment").alias("paper_type"),
        yes(F.col("o_totalprice") > 20000).alias("mentions_drug"), yes(k % 3 == 0, "uncertain").alias("franz_confirmed"),
        yes(k % 2 == 0).alias("mentions_diffusion_cell"), yes(k % 7 != 0).alias("endpoint_found"), yes(k % 11 != 0, "uncertain").alias("endpoint_time_found"),
        yes(k % 13 == 0).alias("figure_only"), yes(k % 5 == 0).alias("needs_supp"),
        F.when(k % 4 == 0, F.concat(F.lit("see "), "o_orderpriority")).otherwise(F.concat(F.lit("Table "), k.cast("string"))).alias("where_endpoint"),
        yes(k % 2 == 0).alias("conc_found"),
    )


@query("evidence_routes", f"WITH {EV_SQL} SELECT o_orderkey, route FROM gs")
def evidence_routes(spark, sf):
    return _evidence(spark, sf).select("o_orderkey", U.evidence_route().alias("route"))


@query("readiness_gates", f"WITH {EV_SQL} SELECT o_orderkey, gate_reason, CASE WHEN gate_reason IS NULL THEN 'yes' ELSE 'no' END AS ready FROM gs")
def readiness_gates(spark, sf):
    return U.readiness_gate(_evidence(spark, sf)).select("o_orderkey", "gate_reason", "ready")


@query(
    "extraction_queues",
    f"""WITH {EV_SQL} SELECT o_orderkey, 'text' AS queue FROM gs WHERE gate_reason IS NULL UNION ALL SELECT o_orderkey, 'figure' FROM gs WHERE route = 'figure' OR figure_only = 'yes'
    UNION ALL SELECT o_orderkey, 'supplement' FROM gs WHERE route = 'supplement' OR needs_supp = 'yes'""",
)
def extraction_queues(spark, sf):
    return U.queue_build(U.readiness_gate(_evidence(spark, sf))).select("o_orderkey", "queue")


@query(
    "queue_priorities",
    f"WITH {EV_SQL} SELECT o_orderkey, (2*contains(lower(where_endpoint), 'table')::INT + (franz_confirmed = 'yes')::INT + (conc_found = 'yes')::INT)::INT AS priority FROM gs ORDER BY priority DESC",
)
def queue_priorities(spark, sf):
    return _evidence(spark, sf).select("o_orderkey", U.queue_priority().alias("priority")).orderBy(F.desc("priority"))


@query(
    "evidence_honesty_turns",
    """SELECT conv_id, turn, CASE WHEN bad THEN 'uncertain' ELSE 'yes' END AS conc_found, CASE WHEN bad THEN '' ELSE role END AS conc_raw, CASE WHEN bad THEN 'uncertain' ELSE 'w/w' END AS conc_basis,
    CASE WHEN bad THEN 'n | conc_snippet_missing_drug' ELSE 'n' END AS notes FROM (SELECT *, trim(text) <> '' AND NOT regexp_matches(lower(text), '(?i)tion|ung') AS bad FROM conversations)""",
)
def evidence_honesty_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit("yes").alias("conc_found"), F.col("role").alias("conc_raw"), F.lit("w/w").alias("conc_basis"), F.lit("n").alias("notes"))
    return U.evidence_honesty(c, "text", ("tion", "ung")).drop("text")


ORDER_RULES = {
    "status_enum": lambda: U.one_of("o_orderstatus", ["F", "O"]),
    "priority_required": lambda: U.required("o_orderpriority"),
    "price_range": lambda: F.col("o_totalprice").between(1000, 400000),
    "priority_is_number": lambda: U.typed("o_orderpriority", "double"),
    "date_known": lambda: F.col("o_orderdate").isNotNull(),
}
BROKEN = {
    "status_enum": "o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')", "priority_required": "o_orderpriority IS NULL OR trim(o_orderpriority) = ''",
    "price_range": "NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false)", "priority_is_number": "o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS DOUBLE) IS NULL", "date_known": "o_orderdate IS NULL",
}


@query("order_violations", " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS rule FROM orders WHERE {c}" for n, c in BROKEN.items()))
def order_violations(spark, sf):
    return U.violations(table(spark, sf, "orders"), ["o_orderkey"], {n: f() for n, f in ORDER_RULES.items()})


@query(
    "order_violation_rates",
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n, count(*) FILTER (WHERE {c}) AS violations, {R(f'count(*) FILTER (WHERE {c}) / count(*)::DOUBLE')} AS rate FROM orders" for n, c in BROKEN.items()),
)
def order_violation_rates(spark, sf):
    return gridded(U.violation_rates(table(spark, sf, "orders"), {n: f() for n, f in ORDER_RULES.items()}), rate=6)


VOCAB_WORDS = {"small_part": ("small ring", "small widget", "small bolt"), "red_part": ("red ring", "red widget"), "ring": ("ring", "blue ring"), "widget": ("widget", "green widget")}
VOCAB_SQL = "vocab AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{s}')" for k, v in VOCAB_WORDS.items() for s in v
) + ") t(canonical, synonym))"


@query("canonical_part_names", f"WITH {VOCAB_SQL} SELECT p_partkey, p_name, canonical AS name_canonical FROM part LEFT JOIN vocab ON lower(trim(p_name)) = synonym")
def canonical_part_names(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return V.canonical_name(part, "p_name", V.vocabulary(spark, VOCAB_WORDS))


@query(
    "completeness_by_order",
    f"""WITH {VOCAB_SQL} SELECT l_orderkey, count(canonical) AS key_ingredients, CASE WHEN coalesce(bool_and(l_discount > 0) FILTER (WHERE canonical IS NOT NULL), true) THEN 'A' ELSE 'B' END AS completeness
    FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN vocab ON lower(trim(p_name)) = synonym GROUP BY l_orderkey""",
)
def completeness_by_order(spark, sf):
    li, part = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_discount"), table(spark, sf, "part").select("p_partkey", "p_name")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    return V.completeness_class(rows, ["l_orderkey"], "p_name", F.col("l_discount") > 0, V.vocabulary(spark, VOCAB_WORDS))


@query(
    "component_percentages",
    r"""WITH c AS (SELECT p_partkey, p_size::VARCHAR AS v, CASE p_size % 4 WHEN 0 THEN '%' WHEN 1 THEN 'wt' WHEN 2 THEN 'mg/g' ELSE 'ml' END AS u, p_name, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size::DOUBLE WHEN u IN ('%', 'wt') THEN v::DOUBLE WHEN u = 'mg/g' THEN floor((p_size * 0.1::DOUBLE) * 1000 + 0.5003) / 1000 END AS pct_inferred,
      CASE WHEN p_size % 5 = 0 THEN 'from_api_fields' WHEN u IN ('%', 'wt') THEN p_name || ': ' || v || '.0 ' || u || ' w/w of it' WHEN u = 'mg/g' THEN p_name || ': ' || p_name || ' mg/g w/w ' || v || ' mg/g' ELSE '' END AS evidence_inferred FROM c""",
)
def component_percentages(spark, sf):
    part = table(spark, sf, "part")
    s, size = F.col("p_size").cast("string"), F.col("p_size")
    unit = F.when(size % 4 == 0, "%").when(size % 4 == 1, "wt").when(size % 4 == 2, "mg/g").otherwise("ml")
    remark = F.when(size % 4 == 2, F.concat(s, F.lit(" mg/g"))).otherwise("of it")
    text = F.concat(
        F.lit("[{'name_raw': 'water', 'concentration_value': None}, {'name_raw': '"), F.col("p_name"), F.lit("', 'concentration_value': "),
        F.when(size % 4 == 2, F.lit("None")).otherwise(s), F.lit(", 'concentration_unit': '"), unit, F.lit("', 'basis': 'w/w', 'remark': '"), remark, F.lit("'}]"),
    )
    df = part.select(
        "p_partkey", text.alias("components_json"), F.when(size % 5 == 0, s).alias("api_concentration_value"), F.lit("%").alias("api_concentration_unit"), F.lit("").alias("api_basis"),
        F.lower("p_name").alias("drug"),
    )
    out = U.api_from_components(df, drugs=(" ",))  # two-word part names play the drug
    return out.select("p_partkey", grid("pct_inferred", 3).alias("pct_inferred"), "evidence_inferred")


@query(
    "triage_completeness_events",
    """SELECT count(*) AS figures, count(*) FILTER (WHERE k < 90 AND value < 200) AS complete, count(*) FILTER (WHERE event_type = 'view') AS digitizable,
    count(*) FILTER (WHERE k < 90 AND value < 200 AND event_type = 'view') AS complete_digitizable FROM (SELECT *, (props->>'k')::INT AS k FROM events)""",
)
def triage_completeness_events(spark, sf):
    ev = D.parse_properties(table(spark, sf, "events"), "props", "k int", "p")
    ev = ev.select(
        F.when(F.col("p.k") < 90, F.col("p.k")).alias("box"), F.when(F.col("value") < 200, F.col("value")).alias("x0"), F.col("value").alias("x1"),
        F.when(F.col("event_type") == "view", "yes").alias("ok"),
    )
    return U.triage_completeness(ev, "box", ["x0", "x1"], "ok")


@query("parsed_event_props", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def parsed_event_props(spark, sf):
    return D.parse_properties(table(spark, sf, "events").select("event_id", "props"), "props", "k int", "p").select("event_id", "p.k")


@query(
    "flattened_document_lines",
    "SELECT doc_id, lang, i::INT AS record_idx, length(l[i])::INT AS value, md5(l[i]) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents), range(1, 100000) r(i) WHERE i <= len(l)",
)
def flattened_document_lines(spark, sf):
    docs = table(spark, sf, "documents")
    # the lines of a text are its nested records
    nested = F.transform(F.split("text", "\n"), lambda t: F.struct(F.length(t).alias("value"), F.md5(t).alias("line")))
    return D.flatten_records(docs.select("doc_id", "lang", nested.alias("records")), ["doc_id", "lang"])


LABEL_BASE = r"""lab AS (SELECT p_brand AS k, lower(p_type) || ' gel' AS label, min(p_partkey) AS ord FROM part GROUP BY ALL UNION ALL SELECT p_brand, 'Vehicle F' || p_size, min(p_partkey) FROM part WHERE p_retailprice < 1500 GROUP BY ALL),
  cur AS (SELECT p_partkey, p_brand AS k, CASE p_partkey % 4 WHEN 0 THEN p_type || ' cream' WHEN 1 THEN 'line F' || p_size WHEN 2 THEN p_name || ' ' || p_type ELSE p_name END AS cl FROM part),
  nl AS (SELECT *, regexp_replace(regexp_replace(lower(label), '\b(formulation|formulations|vehicle|vehicles|gel|cream|solution|ointment|batch)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS n, regexp_extract_all(upper(label), '\bF\d+\b') || regexp_extract_all(upper(label), '\b[A-Z]\b') AS tk FROM lab),
  nc AS (SELECT *, regexp_replace(regexp_replace(lower(cl), '\b(formulation|formulations|vehicle|vehicles|gel|cream|solution|ointment|batch)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS n, regexp_extract_all(upper(cl), '\bF\d+\b') || regexp_extract_all(upper(cl), '\b[A-Z]\b') AS tk FROM cur)"""


@query(
    "matched_part_labels",
    f"""WITH {LABEL_BASE}, m AS (SELECT c.p_partkey, c.cl, arg_min(l.label, (l.ord, l.label)) FILTER (WHERE c.n <> '' AND c.n = l.n) AS ex, arg_min(l.label, (l.ord, l.label)) FILTER (WHERE list_has_any(c.tk, l.tk)) AS tok,
      arg_min(l.label, (l.ord, l.label)) FILTER (WHERE c.n <> '' AND l.n <> '' AND (contains(c.n, l.n) OR contains(l.n, c.n))) AS sub FROM nc c JOIN nl l USING (k) GROUP BY 1, 2)
    SELECT p_partkey, cl AS curve_label, coalesce(ex, tok, sub) AS mapped_label, CASE WHEN ex IS NOT NULL THEN 'exact_norm_match' WHEN tok IS NOT NULL THEN 'token_match' WHEN sub IS NOT NULL THEN 'substring_norm_match' ELSE 'unmapped' END AS status FROM m""",
)
def matched_part_labels(spark, sf):
    part = table(spark, sf, "part")
    cls = F.col("p_partkey") % 4
    curves = part.select(
        "p_partkey", F.col("p_brand").alias("k"),
        F.when(cls == 0, F.concat("p_type", F.lit(" cream"))).when(cls == 1, F.concat(F.lit("line F"), F.col("p_size").cast("string")))
        .when(cls == 2, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name")).alias("curve_label"),
    )
    first = F.min("p_partkey").alias("ord")
    labels = part.groupBy(F.col("p_brand").alias("k"), F.concat(F.lower("p_type"), F.lit(" gel")).alias("label")).agg(first).unionByName(
        part.filter("p_retailprice < 1500").groupBy(F.col("p_brand").alias("k"), F.concat(F.lit("Vehicle F"), F.col("p_size").cast("string")).alias("label")).agg(first)
    )
    return J.match_labels(curves, labels, ["k"], "curve_label", "label", "ord").drop("k")


@query(
    "legend_colour_matches",
    """WITH lg AS (SELECT p_partkey, p_name, list_filter([{'l': 'small one', 'c': 'small'}, {'l': p_brand, 'c': 'ring'}, {'l': 'w', 'c': 'red widget'}], lambda x: contains(x.c, p_name) OR contains(p_name, x.c)) AS h FROM part)
    SELECT p_partkey, CASE WHEN len(h) > 0 THEN h[1].l ELSE p_partkey::VARCHAR END AS curve_label, CASE WHEN len(h) = 1 THEN 'legend_color_unique' WHEN len(h) > 1 THEN 'legend_color_ambiguous' ELSE 'curve_id_fallback' END AS label_source FROM lg""",
)
def legend_colour_matches(spark, sf):
    item = lambda lab, hint: F.struct(lab.alias("label"), F.lit(hint).alias("color_hint"))
    legend = F.array(item(F.lit("small one"), "small"), item(F.col("p_brand"), "ring"), item(F.lit("w"), "red widget"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("color"), legend.alias("legend"), F.col("p_partkey").cast("string").alias("cid"))
    return J.legend_match(part, "legend", "color", "cid").select("p_partkey", "curve_label", "label_source")


@query(
    "table_turns",
    """WITH p AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, length(text) % 6 AS score, length(text) % 7 = 0 AS image, (length(text) % 10) / 100.0::DOUBLE AS drawn FROM conversations),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score + 5*image::INT + 4*(drawn >= 0.02)::INT DESC, turn) AS r FROM p WHERE score + 5*image::INT + 4*(drawn >= 0.02)::INT > 0),
    e AS (SELECT DISTINCT conv_id, turn + d AS turn FROM s, (VALUES (-1), (0), (1)) v(d) WHERE r <= 2 AND turn + d BETWEEN 0 AND n - 1)
    SELECT conv_id, turn, coalesce(r <= 2 AND score <= 3 AND (image OR drawn >= 0.02), false) AS weak FROM e LEFT JOIN s USING (conv_id, turn)
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY r IS NULL, r, turn) <= 2""",
)
def table_turns(spark, sf):
    c, n = table(spark, sf, "conversations"), F.length("text")
    sizes = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    pages = c.select("conv_id", "turn", (n % 6).alias("score"), (n % 7 == 0).alias("image"), ((n % 10) / 100.0).alias("drawn")).join(sizes, "conv_id")
    return C.select_table_pages(pages, ["conv_id"], "turn", "n", "score", "image", "drawn", limit=2)


RECORD_SQL = """r AS (SELECT p_partkey, CASE WHEN p_size % 11 <> 0 THEN p_name END AS record_id, p_size % 13 <> 0 AS has_paper, CASE WHEN p_size % 5 <> 0 THEN p_name END AS title,
  CASE p_size % 3 WHEN 0 THEN 'Franz diffusion cell' WHEN 1 THEN 'beaker' END AS device, CASE WHEN p_size % 2 = 0 THEN 'IVPT' ELSE 'IVXT' END AS study, CASE WHEN p_size % 4 = 0 THEN 'skin' ELSE p_type END AS barrier,
  CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN 'w/w' ELSE 'volume' END AS basis, p_size % 9 = 0 AS no_name, CASE WHEN p_size % 8 = 0 THEN 'odd' ELSE 'balance' END AS item_basis,
  CASE WHEN p_size % 6 <> 0 THEN p_retailprice END AS q, CASE WHEN p_size % 10 = 0 THEN 'Guess' ELSE 'Table' END AS source, CASE WHEN p_size % 12 = 0 THEN 'C' ELSE 'A' END AS class FROM part)"""
RECORD_BROKEN = {
    "required record_id": "record_id IS NULL", "required paper": "NOT has_paper", "required paper.title": "has_paper AND title IS NULL", "required device.name": "device IS NULL",
    "value of device.name": "device <> 'Franz diffusion cell'", "value of study_type": "study <> 'IVPT'", "value of barrier.category": "barrier <> 'skin'", "required api.conc.basis": "basis IS NULL",
    "value of api.conc.basis": "basis <> 'w/w'", "required formulation.ingredients.name_raw": "no_name", "value of formulation.ingredients.conc_basis": "item_basis = 'odd'",
    "required endpoints.Q_final.value": "q IS NULL", "value of evidence.source_type": "source = 'Guess'", "value of formulation_completeness_class": "class = 'C'",
}


@query("record_violations", f"WITH {RECORD_SQL} " + " UNION ALL ".join(f"SELECT p_partkey, '{rule}' AS rule FROM r WHERE {broken}" for rule, broken in RECORD_BROKEN.items()))
def record_violations(spark, sf):
    p, n = table(spark, sf, "part"), F.col("p_size")
    name = F.col("p_name")
    paper = F.struct(F.lit("10.1/x").alias("doi_or_pmid"), F.lit(2020).alias("year"), F.when(n % 5 != 0, name).alias("title"))
    device = F.struct(F.when(n % 3 == 0, "Franz diffusion cell").when(n % 3 == 1, "beaker").alias("name"), F.lit("yes").alias("franz_confirmed"))
    conc = F.struct(name.alias("raw"), F.when(n % 7 == 0, None).when(n % 7 == 1, "w/w").otherwise("volume").alias("basis"), F.lit("no").alias("is_target_5pct"))
    item = lambda raw, basis: F.struct(raw.alias("name_raw"), basis.alias("conc_basis"))
    items = F.array(item(name, F.lit("w/w")), item(F.when(n % 9 != 0, name), F.when(n % 8 == 0, "odd").otherwise("balance")))
    records = p.select(
        "p_partkey", F.when(n % 11 != 0, name).alias("record_id"), F.when(n % 13 != 0, paper).alias("paper"), device.alias("device"), F.when(n % 2 == 0, "IVPT").otherwise("IVXT").alias("study_type"),
        F.struct(F.when(n % 4 == 0, "skin").otherwise(F.col("p_type")).alias("category"), name.alias("name")).alias("barrier"), F.struct(F.lit("ibuprofen").alias("name"), conc.alias("conc")).alias("api"),
        F.struct(F.lit("gel").alias("dosage_form"), items.alias("ingredients")).alias("formulation"),
        F.struct(F.struct(F.when(n % 6 != 0, F.col("p_retailprice")).alias("value"), F.lit("ug").alias("unit"), F.lit(6.0).alias("time_h")).alias("Q_final")).alias("endpoints"),
        F.struct(F.when(n % 10 == 0, "Guess").otherwise("Table").alias("source_type"), name.alias("locator"), name.alias("snippet")).alias("evidence"),
        F.when(n % 12 == 0, "C").otherwise("A").alias("formulation_completeness_class"),
    )
    return U.violations(records, ["p_partkey"], U.record_rules())


def curve_sets(spark, sf):
    """Two references a user, 6e-6 apart, and up to three predictions between and beside them; every point of a prediction
    is there twice. A third of the users has predictions off every reference."""
    from ..plans.ordered import ordered

    own = ordered(day_curve(spark, sf), ["user_id"], ["time_h"]).index("pos").done().select("user_id", "pos", "q_obs")
    shifted = lambda df, add, off: df.select((F.col("user_id") + add).alias("user_id"), "pos", (F.col("q_obs") + off).alias("q_obs"))
    canon = own.unionByName(shifted(own, 500000, 0.000006))
    off = F.when(F.col("user_id") % 3 > 0, 0.000004).otherwise(0.5)
    pred = shifted(own, 1000000, off).unionByName(shifted(own, 2000000, 0.000005)).unionByName(shifted(own.filter("user_id % 3 = 2"), 3000000, 0.000008))
    return pred.unionByName(pred), canon


CURVE_SETS = f"""{DAY_CURVE}, own AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY time_h) AS pos, q_obs FROM curve),
canon AS (SELECT user_id, pos, q_obs FROM own UNION ALL SELECT user_id + 500000, pos, q_obs + 0.000006::DOUBLE FROM own),
pred AS (SELECT user_id + 1000000 AS user_id, pos, q_obs + CASE WHEN user_id % 3 > 0 THEN 0.000004::DOUBLE ELSE 0.5::DOUBLE END AS q_obs FROM own
  UNION ALL SELECT user_id + 2000000, pos, q_obs + 0.000005::DOUBLE FROM own UNION ALL SELECT user_id + 3000000, pos, q_obs + 0.000008::DOUBLE FROM own WHERE user_id % 3 = 2),
cand AS (SELECT p.user_id AS p, c.user_id AS c, max(abs(p.q_obs - c.q_obs)) AS d FROM pred p JOIN canon c USING (pos)
  JOIN (SELECT user_id, count(*) AS n FROM pred GROUP BY ALL) np ON np.user_id = p.user_id JOIN (SELECT user_id, count(*) AS n FROM canon GROUP BY ALL) nc ON nc.user_id = c.user_id AND nc.n = np.n
  GROUP BY p.user_id, c.user_id, np.n HAVING max(abs(p.q_obs - c.q_obs)) <= 0.00001::DOUBLE AND count(*) = np.n),
turn AS (SELECT {{0}}),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ps, []::BIGINT[] AS cs, NULL::BIGINT AS p, NULL::BIGINT AS c, NULL::DOUBLE AS d UNION ALL
  SELECT t.i, CASE WHEN t.c IS NULL THEN ps ELSE list_append(ps, t.p) END, CASE WHEN t.c IS NULL THEN cs ELSE list_append(cs, t.c) END, t.p, t.c, t.d FROM (
    SELECT walk.i + 1 AS i, ps, cs, turn.p, {{1}} FROM walk JOIN turn ON turn.i = walk.i + 1 {{2}}) t),
best AS (SELECT p, c, d FROM walk WHERE c IS NOT NULL)"""
# a curve a turn, and the closest reference free by then
IN_TURN = CURVE_SETS.format(
    "user_id AS p, row_number() OVER (ORDER BY user_id) AS i FROM (SELECT DISTINCT user_id FROM pred)", "k.c, k.d",
    "LEFT JOIN cand k ON k.p = turn.p AND NOT list_contains(cs, k.c) QUALIFY row_number() OVER (ORDER BY k.d, k.c) = 1")
# a pair a turn, the closest first
BY_DISTANCE = CURVE_SETS.format(
    "p, c AS tc, d AS td, row_number() OVER (ORDER BY d, p, c) AS i FROM cand",
    "CASE WHEN list_contains(cs, tc) OR list_contains(ps, turn.p) THEN NULL ELSE tc END AS c, td AS d", "")
MATCHED = f"SELECT user_id AS pred_curve, c AS canon_curve, CASE WHEN c IS NOT NULL THEN {R('d', 7)} END AS max_abs_diff FROM (SELECT DISTINCT user_id FROM pred) LEFT JOIN best ON p = user_id"


@query("matched_curve_sets", f"WITH RECURSIVE {IN_TURN} {MATCHED}")
def matched_curve_sets(spark, sf):
    """Predictions take the closest free reference in turn."""
    return gridded(J.match_curve_sets(*curve_sets(spark, sf), "user_id", "pos", "q_obs"), max_abs_diff=7)


@query("matched_curve_sets_closest", f"WITH RECURSIVE {BY_DISTANCE} {MATCHED}")
def matched_curve_sets_closest(spark, sf):
    return gridded(J.match_curve_sets(*curve_sets(spark, sf), "user_id", "pos", "q_obs", closest=True), max_abs_diff=7)


@query(
    "curve_set_verdict",
    f"""WITH RECURSIVE {IN_TURN},
a AS (SELECT row_number() OVER (ORDER BY user_id, pos) AS i, q_obs FROM (SELECT * FROM pred UNION ALL SELECT * FROM pred)), b AS (SELECT row_number() OVER (ORDER BY user_id, pos) AS i, q_obs FROM canon)
SELECT n_pred, n_matched, n_canon, {R('max_abs_diff', 7)} AS max_abs_diff, {R('sequence_max_abs_diff', 5)} AS sequence_max_abs_diff, same_sequence, n_matched = n_pred AND n_pred = n_canon AS curve_set_matches FROM
  (SELECT count(DISTINCT user_id) AS n_pred FROM pred), (SELECT count(*) AS n_matched, max(d) AS max_abs_diff FROM best), (SELECT count(DISTINCT user_id) AS n_canon FROM canon),
  (SELECT max(abs(a.q_obs - b.q_obs)) AS sequence_max_abs_diff, bool_and(coalesce(abs(a.q_obs - b.q_obs) <= 0.00001::DOUBLE, false)) AS same_sequence FROM a FULL JOIN b USING (i))""",
)
def curve_set_verdict(spark, sf):
    pred, canon = curve_sets(spark, sf)
    matches = J.match_curve_sets(pred, canon, "user_id", "pos", "q_obs")
    return gridded(J.curve_set_verdict(pred, canon, matches, "user_id", "pos", "q_obs"), max_abs_diff=7, sequence_max_abs_diff=5)


@query("orders_with_customers", "SELECT o_custkey, o_orderkey, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def orders_with_customers(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return J.join_checked(o, c, ["o_custkey"])


ENDP = """e AS (SELECT event_id, user_id AS doi, event_type AS curve_id, CASE WHEN value > 100 THEN 'bad' ELSE 'ok' END AS status, CASE WHEN event_id % 10 = 0 THEN 'percent' ELSE 'amount' END AS y_kind FROM events),
   m AS (SELECT user_id AS doi, event_type AS curve_id, CASE WHEN max(value) < 150 THEN ' ' || event_type || '-' || (user_id % 3) || ' ' END AS mapped_formulation_label FROM events GROUP BY user_id, event_type),
   f AS (SELECT user_id AS doi, event_type || '-' || (user_id % 2) AS formulation_label, count(*) AS dosage FROM events GROUP BY ALL),
   j AS (SELECT e.*, m.mapped_formulation_label, f.formulation_label, f.dosage FROM e LEFT JOIN m USING (doi, curve_id) LEFT JOIN f ON f.doi = e.doi AND f.formulation_label = trim(m.mapped_formulation_label) WHERE status = 'ok' AND y_kind <> 'percent')"""


def _attached(spark, sf):
    ev = table(spark, sf, "events")
    e = ev.select("event_id", F.col("user_id").alias("doi"), F.col("event_type").alias("curve_id"), F.when(F.col("value") > 100, "bad").otherwise("ok").alias("status"), F.when(F.col("event_id") % 10 == 0, "percent").otherwise("amount").alias("y_kind"))
    e = e.withColumn("doi", F.col("doi").cast("string"))
    m = ev.groupBy(F.col("user_id").cast("string").alias("doi"), F.col("event_type").alias("curve_id"), "user_id").agg(F.max("value").alias("v"))
    lab = F.when(F.col("v") < 150, F.concat(F.lit(" "), "curve_id", F.lit("-"), (F.col("user_id") % 3).cast("string"), F.lit(" ")))
    m = m.select("doi", "curve_id", lab.alias("mapped_formulation_label"))
    f = ev.groupBy(F.col("user_id").cast("string").alias("doi"), F.concat("event_type", F.lit("-"), (F.col("user_id") % 2).cast("string")).alias("formulation_label")).agg(F.count(F.lit(1)).alias("dosage"))
    return J.attach_formulations(e, m, f)


@query("attached_formulations", f"WITH {ENDP} SELECT event_id, doi::VARCHAR AS doi, curve_id, trim(mapped_formulation_label) AS mapped, formulation_label, dosage FROM j WHERE mapped_formulation_label IS NOT NULL")
def attached_formulations(spark, sf):
    mapped, _ = J.split_mapped(_attached(spark, sf))
    return mapped.select("event_id", "doi", "curve_id", F.trim("mapped_formulation_label").alias("mapped"), "formulation_label", "dosage")


@query("unmapped_endpoints", f"WITH {ENDP} SELECT event_id, doi::VARCHAR AS doi, curve_id FROM j WHERE mapped_formulation_label IS NULL")
def unmapped_endpoints(spark, sf):
    _, unmapped = J.split_mapped(_attached(spark, sf))
    return unmapped.select("event_id", "doi", "curve_id")


@query(
    "split_leakage",
    """WITH tr AS (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 30), te AS (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 28)
    SELECT 'run' AS kind, count(*) AS n FROM (SELECT p_partkey FROM tr INTERSECT SELECT p_partkey FROM te) UNION ALL SELECT 'condition', count(*) FROM (SELECT p_size, round(p_retailprice, 8) FROM tr INTERSECT SELECT p_size, round(p_retailprice, 8) FROM te)""",
)
def split_leakage(spark, sf):
    part = table(spark, sf, "part")
    hits = J.leakage_check(part.filter("p_size <= 30"), part.filter("p_size >= 28"), "p_partkey", ["p_size", "p_retailprice"])
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("assigned_splits", "SELECT p_partkey, CASE WHEN p_size >= 28 THEN 'test' WHEN p_size > 5 THEN 'train' ELSE 'none' END AS split FROM part")
def assigned_splits(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return J.assign_split(part, part.filter("p_size between 6 and 30"), part.filter("p_size >= 28"), ["p_partkey"]).select("p_partkey", "split")


HALF = "(SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS mean, stddev_samp(l_discount) * 100 AS sd FROM lineitem WHERE l_linestatus = '{s}' GROUP BY ALL)"


@query(
    "material_changes",
    f"""SELECT o.l_returnflag, o.l_linenumber, {R('o.mean', 3)} AS old_mean, {R('o.sd', 6)} AS old_sd, {R('n.mean', 3)} AS new_mean, {R('n.mean - o.mean', 3)} AS delta, abs(n.mean - o.mean) > o.sd AS material
    FROM {HALF.format(s='F')} o JOIN {HALF.format(s='O')} n USING (l_returnflag, l_linenumber)""",
)
def material_changes(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("mean"), (F.stddev_samp("l_discount") * 100).alias("sd"))
    half = lambda s: per.filter(F.col("l_linestatus") == s).drop("l_linestatus")
    return gridded(J.material_change(half("F"), half("O"), ["l_returnflag", "l_linenumber"]), old_mean=3, old_sd=6, new_mean=3, delta=3)


@query(
    "merged_audits",
    """WITH a AS (SELECT lang, nullif(n_chars % 5, 0) AS seed, count(*) AS docs FROM documents GROUP BY ALL), b AS (SELECT lang, nullif(n_chars % 7, 0) AS seed, max(n_chars) AS longest FROM documents WHERE lang <> 'fr' GROUP BY ALL)
    SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.seed, b.seed) AS seed, docs, longest FROM a FULL JOIN b ON a.lang = b.lang AND a.seed IS NOT DISTINCT FROM b.seed""",
)
def merged_audits(spark, sf):
    d = table(spark, sf, "documents")
    a = d.groupBy("lang", F.nullif(F.col("n_chars") % 5, F.lit(0)).alias("seed")).agg(F.count(F.lit(1)).alias("docs"))
    b = d.filter("lang <> 'fr'").groupBy("lang", F.nullif(F.col("n_chars") % 7, F.lit(0)).alias("seed")).agg(F.max("n_chars").alias("longest"))
    return J.merge_audits(a, b, ["lang", "seed"])


@query(
    "replay_differences",
    f"""WITH {DAY_CURVE}, d AS (SELECT time_h, abs(q_obs - q_pred) AS d FROM curve) SELECT count(*) AS points, {R('max(d)', 3)} AS max_abs, {R('avg(d)', 4)} AS mean_abs, {R('max(d) FILTER (WHERE time_h = 29)', 3)} AS max_abs_end,
    {R('avg(d) FILTER (WHERE time_h = 29)', 4)} AS mean_abs_end, max(d) <= 100 AS within_tol, max(d) FILTER (WHERE time_h = 29) <= 1000 AS end_within_tol FROM d""",
)
def replay_differences(spark, sf):
    c = day_curve(spark, sf)
    a = c.select("user_id", "time_h", F.col("q_obs").alias("q"))
    b = c.select("user_id", "time_h", F.col("q_pred").alias("q"))
    out = J.replay_diff(a, b, "user_id", "time_h", "q", 29.0, 100.0)
    out = out.withColumn("end_within_tol", F.col("max_abs_end") <= 1000)
    return gridded(out, max_abs=3, mean_abs=4, max_abs_end=3, mean_abs_end=4)


@query(
    "refined_lookups",
    f"""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 7)::DOUBLE WHEN o_custkey % 3 = 1 THEN o_totalprice / 1000 END AS api_value_refined, CASE o_custkey % 3 WHEN 0 THEN 'mg/g' WHEN 1 THEN '%' ELSE '' END AS api_unit_refined,
    {R('CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 7) * 0.1::DOUBLE WHEN o_custkey % 3 = 1 THEN o_totalprice / 1000 END', 5)} AS api_pct_refined FROM orders""",
)
def refined_lookups(spark, sf):
    o = table(spark, sf, "orders")
    pick = F.col("o_custkey") % 3
    asked = o.select("o_orderkey", F.when(pick == 0, " A ").when(pick == 1, "N").otherwise("R").alias("formulation_label"))
    item = lambda lab, v, u: F.struct(F.lit(lab).alias("formulation_label"), v.alias("api_value"), F.lit(u).alias("api_unit"), F.lit("").alias("api_basis"))
    price, small = F.col("o_totalprice") / 1000, (F.col("o_custkey") % 7).cast("double")
    answers = o.select("o_orderkey", F.array(item("A", price, "%"), item("N ", price, "%"), item("A", small, "mg/g")).alias("items"))
    return J.lookup_refined(asked, answers, ["o_orderkey"], "formulation_label").select("o_orderkey", "api_value_refined", "api_unit_refined", grid("api_pct_refined", 5).alias("api_pct_refined"))


@query(
    "merged_sources",
    """WITH t AS (SELECT l_orderkey AS id, l_returnflag AS doi, l_quantity AS v, l_linenumber::DOUBLE AS th, 'text' AS source FROM lineitem), f AS (SELECT o_orderkey AS id, o_orderstatus AS doi, floor(o_totalprice / 10000) AS v, (o_custkey % 8)::DOUBLE AS th, 'figure' AS source FROM orders WHERE o_totalprice > 50000)
    SELECT id, doi, v AS endpoint_value_std, th AS endpoint_time_h, source FROM (SELECT * FROM t UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY doi, v, th ORDER BY source DESC, id) = 1""",
)
def merged_sources(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    text = li.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("doi"), F.col("l_quantity").alias("endpoint_value"), F.col("l_linenumber").cast("double").alias("endpoint_time_h"), F.lit("amount").alias("endpoint_kind"))
    fig = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("doi"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("endpoint_value_ug_per_cm2"), (F.col("o_custkey") % 8).cast("double").alias("endpoint_time"), F.lit("amount").alias("endpoint_kind"), (F.col("o_totalprice") > 50000).alias("confirmed"))
    return D.merge_sources(text, fig, ["id"], "confirmed").select("id", "doi", "endpoint_value_std", "endpoint_time_h", "source")


@query("excluded_parts", "SELECT DISTINCT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def excluded_parts(spark, sf):
    """Parts that were never returned in large amounts: some are excluded, some stay."""
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40")
    return sets.exclude_set(table(spark, sf, "part").select("p_partkey"), returned.select(F.col("l_partkey").alias("p_partkey")))


@query(
    "combined_parts_ordered",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL",
)
def combined_parts_ordered(spark, sf):
    li = table(spark, sf, "lineitem")
    pieces = [li.filter(F.col("l_returnflag") == f).groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n")) for f in ("A", "N", "R")]
    return combine_parts(pieces, {"l_returnflag": ["R", "A", "N"], "l_linestatus": ["O", "F"]}, ["l_returnflag", "l_linestatus", "l_linenumber"])


FORMULA = """'add(mul(' || p_name || ', C1), sub(' || p_retailprice || ', ARG2))' || repeat('div(Q, -2.5e-3)', (p_size % 3)::INT) || CASE WHEN p_size % 4 = 0 THEN ' pow2 (ARG3)' WHEN p_size % 4 = 1 THEN ' subC30(XQ)' ELSE '' END"""


@query(
    "design_standardised",
    rf"""SELECT p_partkey, {R('(p_size - 1) / 49.0::DOUBLE')} AS p_size_scaled, {R('(p_retailprice - 900) / 1200.0::DOUBLE')} AS p_retailprice_scaled, {R('p_retailprice - 0.01::DOUBLE * greatest(p_retailprice - 1000, 0) * greatest(p_retailprice - 1000, 0)', 3)} AS objective_penalised,
    length({FORMULA})::INT AS expression_length, len(regexp_extract_all({FORMULA}, '\b(add|sub|mul|div|pow2)\s*\('))::INT AS operator_calls,
    len(regexp_extract_all({FORMULA}, '(^|[^A-Za-z_0-9.])-?[0-9]+\.[0-9]+'))::INT AS constants,
    array_to_string(list_filter(['Q', 'C1', 'C2', 'C3'], lambda v: regexp_matches({FORMULA}, '\b(' || v || '|' || CASE v WHEN 'Q' THEN 'ARG0' ELSE replace(v, 'C', 'ARG') END || ')\b')), ',') AS variables FROM part""",
)
def design_standardised(spark, sf):
    size = F.col("p_size")
    more = F.when(size % 4 == 0, " pow2 (ARG3)").when(size % 4 == 1, " subC30(XQ)").otherwise("")
    f = F.concat(F.lit("add(mul("), "p_name", F.lit(", C1), sub("), F.col("p_retailprice").cast("string"), F.lit(", ARG2))"), F.expr("repeat('div(Q, -2.5e-3)', cast(p_size % 3 AS int))"), more)
    part = table(spark, sf, "part").withColumn("f", f)
    out = D.standardise_design(part, {"p_size": (1, 50), "p_retailprice": (900, 2100)}, "p_retailprice", 1000.0, 0.01, "f")
    out = gridded(out, p_size_scaled=6, p_retailprice_scaled=6, objective_penalised=3).withColumn("variables", F.array_join("variables", ","))
    return out.select("p_partkey", "p_size_scaled", "p_retailprice_scaled", "objective_penalised", "expression_length", "operator_calls", "constants", "variables")


@query(
    "locator_anchors",
    r"""SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size - 1, p_size % 7 + 2])), ',') AS pages, 'Table ' || (p_size % 9) AS table_ref,
    regexp_replace(regexp_replace(lower(p_name || ' Gel ' || p_size), '\b(gel)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS label_key, array_to_string(['GEL' || p_size], ',') AS label_ids FROM part""",
)
def locator_anchors(spark, sf):
    size = F.col("p_size").cast("string")
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", F.lit("Gel"), size).alias("label"),
        F.concat(F.lit("Page "), size, F.lit(" and p. "), (F.col("p_size") % 7 + 3).cast("string"), F.lit(", Table "), (F.col("p_size") % 9).cast("string"), F.lit(" foot")).alias("locator"),
    )
    out = D.standardise_records(part)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return out.select("p_partkey", text("pages").alias("pages"), "table_ref", "label_key", text("label_ids").alias("label_ids"))


@query(
    "value_counts_priority",
    "SELECT CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1",
)
def value_counts_priority(spark, sf):
    from ..operators.runs import value_counts

    o = table(spark, sf, "orders").select(F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("priority"))
    return value_counts(o, ["priority"])

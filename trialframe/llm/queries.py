"""The registered queries: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, lexical, licenses, line_dedup, mixing, near_dedup, packing, quality, secret_scan, spelling, suffix_dedup
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer file's path; TRIALFRAME_VOCABULARY names another place."""
    if found := os.environ.get("TRIALFRAME_VOCABULARY"):
        return found
    import public_tokenizers

    return str(public_tokenizers.path(name))


BARE = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"


@query("op1_source_mix")
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query(
    "op2_line_dedup",
    """WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, min(doc_id) AS lo, max(doc_id) AS hi FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT doc_id, i, line, coalesce(lo < hi AND doc_id > lo, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1  # all documents, in two batches
    index = line_dedup.LineIndex.empty(spark).insert(docs.filter(~late)).insert(docs.filter(late))
    out = line_dedup.drop_lines(docs, index)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    each = F.arrays_zip("kinds", "starts", "ends", "layers")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    plain = F.filter(each, lambda s: s["layers"] == 0)
    only = F.filter(F.col("kinds"), lambda k, i: F.get(F.col("layers"), i) == 0)
    counts = [F.size(only).cast("long") - F.size(F.array_remove(only, k)) for k in secret_scan.KINDS]
    counts = [c.alias(f"n_{k}") for c, k in zip(counts, secret_scan.KINDS, strict=True)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(plain), 256).alias("base_sha256"), joined(each).alias("spans"), "n_oversized")


@query(
    "op7_exact_dedup",
    f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {BARE} AS bare FROM documents),
g AS (SELECT bare, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM d JOIN g USING (bare)""",
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train_lines(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, field)


@query(
    "op6_perspective_chat",
    f"""WITH t AS (SELECT conv_id, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, turn, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS pos FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM n WHERE speaker <> 'system'),
r AS (SELECT n.conv_id, perspective, pos, pos // {chat.BLOCK_TURNS} AS block, speaker = perspective AS learn,
  '{chat.OPEN}' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
    ELSE 'user name=' || replace(speaker, '<|im_', '< |im_') END || chr(10) AS head,
  replace(text, '<|im_', '< |im_') || '{chat.CLOSE}' || chr(10) AS body FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg((start + length(head)) || ':' || (start + length(head) + length(body) - 1), ',' ORDER BY pos) FILTER (learn), '') AS mask
FROM o GROUP BY conv_id, perspective, block""",
)
def op6_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render(chat.rotate(table(spark, sf_dir, "conversations")))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def filed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/hundreds of ids/tens of ids/name. One that opens with a licence statement is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    opening = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    name = F.when(opening.contains("licen"), F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), part(1000), part(100), name).alias("path"), "text")


TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
SQL_TERMS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9.-]+', ' ', 'g'), '[.-]+( |$)', ' ', 'g'), ' +'), lambda w: w <> '')"
SQL_CUE = "(" + " OR ".join(f"contains(lower({{0}}), '{cue}')" for cue in licenses.CUES) + ")"


@query(
    "op10_license_scan",
    f"""WITH f AS (SELECT doc_id, coalesce(source, 'none') || '/' || doc_id // 1000 || '/' || doc_id // 100 || '/' ||
  CASE WHEN contains(lower(string_split(coalesce(text, ''), chr(10))[1]), 'licen') THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS path, text FROM documents),
h AS (SELECT DISTINCT doc_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM f) WHERE {SQL_CUE.format('line')}),
lines AS (SELECT line, count(*) AS n FROM h GROUP BY line),
tpl AS (SELECT * FROM (VALUES {TEMPLATE_ROWS}) AS v(template, license, line)),
words AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest({SQL_TERMS.format('line')}) AS term FROM lines) GROUP BY ALL),
model AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({SQL_TERMS.format('line')}) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT coalesce(sum(n), 0) FROM lines) + {len(licenses.TEMPLATES)}) / (1.0::DOUBLE + sum(df))) + 1 AS idf FROM (
  SELECT term, n AS df FROM words UNION ALL SELECT term, 1 FROM model) GROUP BY term),
own AS (SELECT line, term, tf * idf AS w FROM words JOIN idf USING (term)),
side AS (SELECT template, license, term, v / sqrt(sum(v * v) OVER (PARTITION BY template)) AS v FROM (SELECT template, license, term, tf * idf AS v FROM model JOIN idf USING (term))),
scored AS (SELECT line, license, cosine FROM (SELECT line, template, license, round(sum(w * v) / any_value(norm), 4) AS cosine
    FROM own JOIN side USING (term) JOIN (SELECT line, sqrt(sum(w * w)) AS norm FROM own GROUP BY line) USING (line) GROUP BY ALL)
  WHERE cosine >= {licenses.MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, template) = 1),
best AS (SELECT doc_id, arg_max(license, (cosine, license)) AS own_license, max(cosine) AS cosine FROM h JOIN scored USING (line) GROUP BY doc_id),
known AS (SELECT f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own_license, cosine FROM f LEFT JOIN best USING (doc_id)),
givers AS (SELECT dir AS up, arg_min(own_license, (-cosine, path)) AS dir_license FROM known
  WHERE own_license IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '^(licen[cs]e|copying|copyright|notice)', 'i') GROUP BY dir),
near AS (SELECT dir, arg_max(up, length(up)) AS up, arg_max(dir_license, length(up)) AS dir_license FROM (SELECT DISTINCT dir FROM known) JOIN givers
  ON dir = up OR starts_with(dir, up || '/') GROUP BY dir)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, dir_license) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own_license IS NOT NULL THEN dir ELSE up END AS from_dir
FROM known LEFT JOIN near USING (dir)""",
)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(filed_documents(spark, sf_dir), passed=("doc_id",))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# crc32 by bytes: the register after a byte is its upper part against the table entry of its lower byte
SQL_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex({0})) // 2), lambda i: ('0x' || substr(hex({0}), 2 * i::BIGINT + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"""
SQL_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


@query(
    "op11_spelling_variants",
    f"""WITH RECURSIVE steps AS (SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT b, {SQL_CRC_STEP.format('c')}, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS tagged, run, count(*) AS c FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, xor({SQL_CRC.format('tagged')}, 4294967295) AS h FROM runs, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.k = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.k = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM near GROUP BY word),
known AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.MIN_RATIO} * words.n THEN form END AS form,
  CASE WHEN form_n >= {spelling.MIN_RATIO} * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS k FROM known UNION ALL SELECT walk.word, known.form, k + 1 FROM walk JOIN known ON walk.here = known.word WHERE known.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)""",
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL_SEARCH_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"


@query(
    "op12_lexical_search",
    f"""WITH i AS (SELECT DISTINCT item_id, {SQL_SEARCH_TERMS} AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {SQL_SEARCH_TERMS} AS term FROM documents) GROUP BY ALL),
s AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM s),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g),
m AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM s, g),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= {lexical.TOP}""",
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_ranks(name: str = "byte_bpe_50k.tiktoken") -> bpe.Ranks:
    """The byte-level vocabulary and its pattern; TRIALFRAME_RANKS names another file."""
    import public_tokenizers

    return bpe.Ranks.read(os.environ.get("TRIALFRAME_RANKS") or str(public_tokenizers.path(name)), public_tokenizers.PATTERN)


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_ranks()
    out = bpe.encode(table(spark, sf_dir, "documents"), ranks)
    ids = F.col("ids")
    return out.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(ranks.decode(ids), 256).alias("decoded_sha256"))

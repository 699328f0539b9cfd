"""Exact duplicates by a tree merge of sorted digest runs. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, fresh, staged, text_of

FAN_IN = 16
KEYS = ["sha", "check", "size"]


def _digest(text: Column) -> dict[str, Column]:
    return {"sha": F.unhex(F.sha2(text, 256)), "check": F.xxhash64(text), "size": F.octet_length(text)}


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: id, code points, and three independent digests of the text without white space."""
    raw = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("raw"))
    bare = raw.select("id", F.length("raw").cast("long").alias("n_chars"), F.regexp_replace("raw", f"{WHITE}+", "").alias("bare"))
    return bare.select("id", "n_chars", *[c.alias(n) for n, c in _digest(F.col("bare")).items()])


def tree_merge(runs: DataFrame, best: Column, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the partitions' digest runs, ``fan_in`` runs at a time, until one run is left.

    The order struct isn't a fixed-width type, so Spark aggregates it by sorting: each partition sorts its run by digest
    and collapses it before the exchange, and a merge task reads such runs and merges them again. A run of any level is
    spread over all tasks by digest; a digest held by a third of all rows is one row per run already on the first level.
    ``sha``, ``check`` and ``size`` are the key together: texts whose SHA-256 agrees by accident stay apart.
    """
    last = runs.select(F.spark_partition_id().alias("run")).agg(F.max("run").alias("last")).first()["last"]
    width = 1 if last is None else last + 1
    cur = runs.select(F.spark_partition_id().alias("run"), *KEYS, best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        width = -(-width // fan_in)
        cur = cur.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        cur = cur.groupBy("run", *KEYS).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        if width == 1:
            return cur.drop("run")


def _order(row: Column | None = None) -> Column:
    """The row that stays sorts first: most code points, then the smallest id (none: last), then the first row."""
    parts = [(-F.col("n_chars")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")]
    return F.struct(*parts, *([row.alias("row")] if row is not None else []))


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are identical without white space; null counts as empty, so all empty texts are one group.
    Of a group the row with the most code points stays, then the one with the smallest id (a null id comes last), then
    one of the repeated rows: exactly one row of a group has ``kept``. An empty table gives an empty result. Other
    columns are not read. The digests are written once; both the merge and the result read that table.
    """
    small = staged(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    merged = tree_merge(small, _order(F.col("row"))).filter("n > 1")
    found = merged.select(*[F.col(k).alias(f"m_{k}") for k in KEYS], "best", "n")
    match = [F.col(k) == F.col(f"m_{k}") for k in KEYS]
    both = small.join(found, match[0] & match[1] & match[2], "left")
    alone = F.col("n").isNull()
    return both.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay under :func:`mark_exact`, with all their columns.

    The winners are matched on digest, code points and id together, so the copies of one text spread over all tasks.
    Only rows repeated with the same id, text and length need one more step, which keeps one of each.
    """
    names = {k: fresh(docs, f"__{k}") for k in [*KEYS, "bare", "n_chars", "ties"]}
    bare = docs.withColumn(names["bare"], F.regexp_replace(text_of(text_col), f"{WHITE}+", ""))
    keyed = bare.withColumns({names[k]: c for k, c in _digest(F.col(names["bare"])).items()}).drop(names["bare"])
    keyed = keyed.withColumn(names["n_chars"], F.length(text_of(text_col)).cast("long"))
    small = staged(digests(docs, id_col, text_col), "digests")
    tied = small.groupBy(*KEYS, "n_chars", "id").agg(F.count(F.lit(1)).alias("ties"))
    best = tree_merge(small, _order()).select(*KEYS, (-F.col("best.neg")).alias("n_chars"), F.col("best.id").alias("id"))
    # the tie count rides along; a null id is matched as a value
    tied = tied.filter("ties > 1").select(*[F.col(c).alias(f"t_{c}") for c in [*KEYS, "n_chars", "id"]], "ties")
    same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("n_chars") == F.col("t_n_chars"))
    for k in KEYS:
        same &= F.col(k) == F.col(f"t_{k}")
    best = best.join(tied, same, "left").select(
        *[F.col(k).alias(f"w_{k}") for k in [*KEYS, "n_chars", "id"]], F.coalesce("ties", F.lit(1)).alias(names["ties"]))
    best = staged(best, "winners")
    on = F.col(id_col).eqNullSafe(F.col("w_id")) & (F.col(names["n_chars"]) == F.col("w_n_chars"))
    for k in KEYS:
        on &= F.col(names[k]) == F.col(f"w_{k}")
    stay = keyed.join(best.hint("shuffle_hash"), on).drop(*[f"w_{k}" for k in [*KEYS, "n_chars", "id"]])
    if best.filter(F.col(names["ties"]) > 1).limit(1).count():
        keys = [names[k] for k in [*KEYS, "n_chars"]]
        once = stay.filter(F.col(names["ties"]) > 1).dropDuplicates([*keys, id_col])
        stay = stay.filter(F.col(names["ties"]) == 1).unionByName(once)
    return stay.select(*docs.columns)

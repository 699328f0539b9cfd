"""Spelling variants: words one edit apart, found as prefix ranges of sorted permuterm rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, staged

# fixed values of the contract: the letters of a run, the letters that change case, one run in 97 loses a letter
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 97

MIN_LENGTH, MIN_COUNT, MIN_RATIO = 5, 3, 2
END = "$"  # ends a word; no run holds it
ROTATIONS_EACH = 400_000


def _lowered(run: Column) -> Column:
    plain = F.octet_length(run) == F.char_length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def word_counts(docs: DataFrame, every: int | None = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the lower-case runs of letters of all texts and how often they occur.

    With ``every``, a run loses one letter if ``every`` divides the crc32 of its document's id and itself: the same run
    of one document always has the same spelling. Counts are added up before the shuffle, so a frequent word costs no
    more than a rare one. Null texts have no words, a null id counts as an empty one, repeated rows count again, and other
    columns are not read.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", _lowered(F.col("run")).alias("run"))
    word = F.col("run")
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
        at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % every == 0, cut).otherwise(word)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, whole, lead, n, word): where each word of ``words`` (word, n) stands among the sorted rotations.

    A word of L letters with its end mark has L + 1 rotations. As a whole, a rotation is its own key. Without its last
    letter it is the prefix that all words share which differ in that letter only, and the whole rotation of the word that
    lacks it: one key therefore holds the replacements of a letter and the word without it. ``lead``: the letter differs
    from the one before, so that of a run of equal letters a deletion counts once.
    """
    marked = F.concat("word", F.lit(END))
    size = F.char_length("word")
    turned = lambda i: F.concat(F.substring(marked, i + 1, size + 1), F.substring("word", F.lit(1), i))
    wholes = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("lead")))
    skips = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.concat(F.substring(marked, i + 2, size + 1), F.substring("word", F.lit(1), i)).alias("key"), F.lit(False).alias("whole"),
            ((i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))).alias("lead")))
    return words.filter(F.char_length("word") > 0).select("word", "n", F.explode(F.concat(wholes, skips)).alias("r")).select("r.*", "n", "word")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of ``words`` (word, n) are one edit away, and the one of largest ``n`` (struct
    n, word; ties: the smallest word). Words without neighbours have no row.

    The rotations are sorted by key. A key is a handful of rows whatever the input looks like, as its members differ in
    one letter: at most one whole rotation and one row a letter. Each member gets its count and best partner from the
    ranked first two rows, so pairs are never formed.
    """
    held = rotations(words)
    n = partitions_for(words.agg(F.sum(2 * F.char_length("word") + 1)).first()[0] or 0, ROTATIONS_EACH)
    held = held.withColumn("place", F.struct((-F.col("n")).alias("m"), "word"))
    key = Window.partitionBy("key")
    ranked = key.orderBy("whole", "place")
    every = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skip = ~F.col("whole")
    held = held.repartitionByRange(n, "key").withColumns({
        "i": F.row_number().over(ranked), "skips": F.count_if(skip).over(every), "leads": F.count_if("lead").over(every),
        "first": F.first("place").over(every), "second": F.nth_value("place", 2).over(every), "shorter": F.max(F.when(F.col("whole"), F.col("place"))).over(every),
        "longer": F.min(F.when(F.col("lead"), F.col("place"))).over(every)})
    held = held.filter(F.when(F.col("whole"), F.col("leads") > 0).otherwise((F.col("skips") > 1) | (F.col("lead") & F.col("shorter").isNotNull())))
    replaced = F.when(F.col("skips") > 1, F.when(F.col("i") == 1, F.col("second")).otherwise(F.col("first")))
    deleted = F.when(F.col("lead"), F.col("shorter"))
    seen = held.select(
        "word", F.when(F.col("whole"), F.col("leads")).otherwise(F.col("skips") - 1 + F.when(deleted.isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("whole"), F.col("longer")).otherwise(F.least(replaced, deleted)).alias("best"))
    out = seen.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", F.struct((-F.col("best.m")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): where the chain of forms ends. Chains must not be circular.

    Pointers double, so a chain of k forms takes log2(k) rounds; only the number of pointers still moving reaches the
    driver. Each round is written.
    """
    cur = forms.select("word", F.col("form").alias("root"))
    while True:
        up = cur.select(F.col("word").alias("at"), F.col("root").alias("next"))
        cur = staged(cur.join(up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not cur.filter("moved").limit(1).count():
            return cur.select("word", "root")
        cur = cur.select("word", "root")


def variants(
    docs: DataFrame, every: int | None = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, min_ratio: int = MIN_RATIO, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per word of at least ``min_length`` letters and ``min_count`` occurrences: ``word, form, root, n, n_near, form_n``.

    Two words are near if one inserted, deleted or replaced letter makes one the other. The form of a word is its near
    word of most occurrences (ties: the smallest in code-point order), if that has at least ``min_ratio`` (2 or more, so
    chains end) times as many as the word, else null; the root is where the forms end, the word itself without a form.
    Counts cover all texts (:func:`word_counts` tells of nulls and repeated rows). An empty table gives an empty result.
    """
    if min_ratio < 2:
        raise ValueError("min_ratio must be 2 or more, else forms may be circular")
    words = staged(word_counts(docs, every, id_col, text_col).filter((F.col("n") >= min_count) & (F.char_length("word") >= min_length)), "spelling-words")
    near = neighbours(words)
    known = words.join(near, "word", "left")
    taken = F.col("best.n") >= min_ratio * F.col("n")
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, F.col("best.n")).alias("form_n")), "spelling-forms")
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

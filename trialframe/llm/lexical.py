"""Ranked lexical search of a query set over all documents: documents of equal bags are scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_batches, running, staged

TOP = 50
BLOCK_TERMS = 500_000
CELLS = 4_000_000
CHUNK_BYTES = 1 << 20

# fixed values of the contract: terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCORED = "item int, class long, first long, score long"
NO_ID = -(2**63)  # stands for a null id, which comes first


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about a megabyte. Bytes beyond ASCII belong to terms, so UTF-8 needs no decoding."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(SPLIT)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), each once: the terms of every item. Rows of one id are one item; so are those of a null id."""
    kind = items.schema[id_col].dataType.simpleString()

    def start():
        def step(cols):
            found = [(i, t) for i, text in zip(cols["item"], cols["text"], strict=True) for t in set().union(*terms_of(text))]
            return {"item": [i for i, _ in found], "term": [t for _, t in found]}

        return step

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, start, f"item {kind}, term binary").distinct()


def bags(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, codes, tfs) of every document with a term: its number of terms, and how often it has which of ``vocabulary``."""

    def start():
        codes = {t: i for i, t in enumerate(vocabulary)}

        def step(cols):
            out = {"doc_id": [], "n": [], "codes": [], "tfs": []}
            for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
                n, held = 0, Counter()
                for terms in terms_of(text):
                    n += len(terms)
                    seen = Counter(terms)
                    for t in seen.keys() & codes.keys():
                        held[codes[t]] += seen[t]
                if n:
                    mine = sorted(held)
                    for k, v in (("doc_id", doc), ("n", n), ("codes", mine), ("tfs", [held[c] for c in mine])):
                        out[k].append(v)
            return out

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, start, "doc_id long, n long, codes array<int>, tfs array<long>")


def classes_of(bags: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(class, m, codes, tfs, members): documents of equal tf vectors and equal length factor ``m``, one row each.

    Documents meet by the hash of vector and factor; grouping by the values themselves verifies it. Of a class only the
    ``top`` smallest ids can be among an item's ``top`` documents, so others are dropped before the shuffle; a class of any
    size reaches a task as ``top`` rows of each task before it. Documents without a term of the vocabulary score 0.
    """
    m = F.expr(f"100L - 50L + ((50L * n * {n_docs}L) div {n_terms}L)")
    rows = bags.filter(F.size("codes") > 0).select("doc_id", m.alias("m"), "codes", "tfs").withColumn("hash", F.xxhash64("m", "codes", "tfs"))
    key = ["hash", "m", "codes", "tfs"]
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("doc_id")))).filter(F.col("i") <= top)
    held = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("doc_id"))).alias("members"))
    return held.select(F.monotonically_increasing_id().alias("class"), "m", "codes", "tfs", F.col("members.doc_id").alias("members"))


def score_classes(classes: DataFrame, items: list[list[int]], weights: np.ndarray, top: int) -> DataFrame:
    """(item, class, first, score): a task's ``top`` classes of every item by score and smallest member.

    ``items`` has the codes of each item. A class goes to the postings of its codes; scores are whole numbers, added
    exactly. A task holds ``top`` rows an item and at most ``CELLS`` products at a time.
    """
    order = sorted((c, i) for i, codes in enumerate(items) for c in codes)
    held = np.asarray([i for _, i in order], dtype=np.int64)
    starts = np.searchsorted(np.asarray([c for c, _ in order], dtype=np.int64), np.arange(len(weights) + 1))
    n_items, longest = len(items), max((len(x) for x in items), default=0)
    exact = longest * float(weights.max(initial=0)) * 1e6 < 2.0**53  # so are sums of doubles

    def score(codes, tfs, ms, sizes):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        part = weights[codes] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * ms[owner]))
        fan = starts[codes + 1] - starts[codes]
        at = np.repeat(np.arange(len(codes)), fan)
        item = held[np.arange(len(at)) + np.repeat(starts[codes] - np.cumsum(fan) + fan, fan)]
        cell = owner[at] * n_items + item
        if exact:
            return np.bincount(cell, part[at], len(sizes) * n_items).astype(np.int64).reshape(len(sizes), n_items)
        out = np.zeros(len(sizes) * n_items, dtype=np.int64)
        np.add.at(out, cell, part[at])
        return out.reshape(len(sizes), n_items)

    def run(batches):
        best = [np.zeros(0, dtype=np.int64)] * 4  # item, score, first, class
        least = np.ones(n_items, dtype=np.int64)
        for batch in batches:
            col = lambda k, b=batch: b.column(b.schema.get_field_index(k))
            offsets = np.asarray(col("codes").offsets)
            codes, tfs = np.asarray(col("codes").values, dtype=np.int64), np.asarray(col("tfs").values, dtype=np.int64)
            ms, ids = np.asarray(col("m")), np.asarray(col("class"))
            first = np.asarray(col("first").fill_null(NO_ID))
            work = np.concatenate([[0], np.cumsum(starts[codes + 1] - starts[codes])])[offsets - offsets[0]] + n_items * np.arange(len(offsets))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(work, work[lo] + CELLS, "right")) - 1)
                a, b = offsets[lo], offsets[hi]
                got = score(codes[a:b], tfs[a:b], ms[lo:hi], np.diff(offsets[lo : hi + 1]))
                row, item = np.nonzero(got >= least)
                best = [np.concatenate(x) for x in zip(best, (item, got[row, item], first[lo:hi][row], ids[lo:hi][row]), strict=True)]
                keep = np.lexsort((best[3], best[2], -best[1], best[0]))
                items_in = best[0][keep]
                place = np.arange(len(keep)) - np.searchsorted(items_in, items_in, "left")
                best = [x[keep[place < top]] for x in best]
                full = place[place < top] == top - 1
                least[best[0][full]] = best[1][full]
                lo = hi
        if len(best[0]):
            firsts = pa.array(best[2], mask=best[2] == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), pa.array(best[3]), firsts, pa.array(best[1])], names=["item", "class", "first", "score"])

    return classes.select("class", "m", "codes", "tfs", F.get("members", F.lit(0)).alias("first")).mapInArrow(run, SCORED)


def _searched(docs: DataFrame, pairs: list, top: int, doc_id: str, doc_text: str) -> DataFrame:
    """(item, rank, doc_id, score) for the items numbered in ``pairs`` (item number, term)."""
    vocabulary = sorted({bytes(t) for _, t in pairs})
    code = {t: c for c, t in enumerate(vocabulary)}
    items: list[list[int]] = [[] for _ in range(max(i for i, _ in pairs) + 1)]
    for i, t in pairs:
        items[i].append(code[bytes(t)])
    held = staged(bags(docs, vocabulary, doc_id, doc_text), "search-bags")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = held.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in df.select("code", weight.alias("w")).collect():  # one row a term of the block
        weights[r.code] = r.w
    classes = staged(classes_of(held, n_docs, max(n_terms, 1), top), "search-classes")
    scored = score_classes(classes, items, weights, top)
    by = Window.partitionBy("item")
    lead = scored.withColumn("i", F.row_number().over(by.orderBy(F.desc("score"), F.asc_nulls_first("first")))).filter(F.col("i") <= top)
    out = lead.join(classes.select("class", "members"), "class").select("item", "score", F.explode("members").alias("doc_id"))
    out = out.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).filter(F.col("rank") <= top)
    return out.select("item", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Per item its ``top`` best documents with a score above 0: ``item_id`` (its own name and type), ``rank``, ``doc_id``, ``score``.

    The score is the contract's: whole-number term weights by document frequency, saturated by term frequency and document
    length. Equal scores go by ascending id, null ids first. Document frequencies, lengths and counts cover all documents;
    a document without a term (null, empty or only separators) counts nowhere. Repeated rows are documents of their own;
    rows of one item id are one item. Ids of documents are whole numbers. Empty tables give an empty result, and other columns are not read.

    Every class of documents with equal bags is scored once against all items. An item's ``top`` documents lie in its
    ``top`` classes by score and smallest member, so only those are expanded into documents. Items go in blocks of about
    ``block_terms`` terms; a block's terms are what the tasks get (and the driver holds), whatever the number of items.
    """
    terms = staged(item_terms(items, item_id, item_text), "search-terms")
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("k")).withColumn("all", F.lit(1))
    numbered = staged(running(sizes, ["all"], ["item"], "k", "before", "at").select("item", "at", F.floor(F.col("before") / block_terms).alias("block")), "search-items")
    out = []
    for block in [r.block for r in numbered.select("block").distinct().orderBy("block").collect()]:
        mine = numbered.filter(F.col("block") == block)
        low = mine.agg(F.min("at")).first()[0]
        pairs = mine.withColumnRenamed("item", "it").join(terms, F.col("it").eqNullSafe(F.col("item"))).select((F.col("at") - low).alias("i"), "term")
        found = _searched(docs, [(r.i, r.term) for r in pairs.collect()], top, doc_id, doc_text)
        named = mine.select((F.col("at") - low).cast("int").alias("i"), F.col("item").alias("name"))
        out.append(found.join(named, F.col("item") == F.col("i")).select(F.col("name").alias(item_id), "rank", "doc_id", "score"))
    if out:
        return reduce(DataFrame.unionByName, out)
    none = F.lit(None)
    return items.limit(0).select(item_id, none.cast("int").alias("rank"), none.cast("long").alias(fresh(items.select(item_id), "doc_id")), none.cast("long").alias("score"))

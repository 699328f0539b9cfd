"""Reversible line dedup: exact reference counts per line, fronted by sharded cuckoo filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, partitions_for, staged, text_of

MIN_KEY_CHARS = 10
SHARD_KEYS = 200_000
SLOTS = 4
NO_ID = 2**63 - 1  # stands for a null id: one document, after all others

REFS = "key binary, refs long, lo long, hi long"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, two buckets per key. All operations take arrays of 64-bit hashes.

    A key inserted twice is held twice, so one deletion leaves the other. False positives are possible, false negatives
    aren't; the exact table behind the filter settles the former.
    """

    def __init__(self, n_keys: int, slots: np.ndarray | None = None):
        if slots is None:
            n = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))
            slots = np.zeros((n, SLOTS), dtype=np.uint16)
        self.slots = slots

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, one, self._other(mark, one)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        jump = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (at.astype(np.uint64) ^ (jump & np.uint64(len(self.slots) - 1))).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def _first_of_each(self, at: np.ndarray) -> np.ndarray:
        _, first = np.unique(at, return_index=True)
        return first

    def insert(self, h: np.ndarray, rounds: int = 2000) -> bool:
        """False if some key found no place; the filter must then be rebuilt larger from the exact table."""
        mark, at, other = self._places(h)
        rng = np.random.default_rng(len(h))
        for r in range(rounds):
            if not len(mark):
                return True
            # of the keys that want a bucket, one is placed per round
            pick = self._first_of_each(at)
            free = self.slots[at[pick]] == 0
            fits = free.any(1)
            placed, full = pick[fits], pick[~fits]
            self.slots[at[placed], free[fits].argmax(1)] = mark[placed]
            if r % 2 and len(full):  # neither bucket was free: change places with a random tenant
                slot = rng.integers(0, SLOTS, len(full))
                out = self.slots[at[full], slot].copy()
                self.slots[at[full], slot] = mark[full]
                mark[full] = out
                other[full] = self._other(out, at[full])
            at[full], other[full] = other[full], at[full].copy()
            rest = np.ones(len(mark), dtype=bool)
            rest[placed] = False
            mark, at, other = mark[rest], at[rest], other[rest]
        return not len(mark)

    def delete(self, h: np.ndarray) -> None:
        """Remove one copy of each key; the keys must have been inserted."""
        for m, *places in zip(*(x.tolist() for x in self._places(h)), strict=True):
            for at in places:
                hit = np.flatnonzero(self.slots[at] == m)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8")[::2]


def build_filter(h: np.ndarray) -> CuckooFilter:
    n = len(h)
    while True:
        made = CuckooFilter(n)
        if made.insert(h):
            return made
        n *= 2


def line_key(line: bytes) -> bytes | None:
    """The 128-bit key of a line, or None if its normal form is shorter than ten code points."""
    bare = line.strip().lower()  # of bytes: ASCII white space, A-Z only
    if len(bare) < MIN_KEY_CHARS or (len(bare) < 4 * MIN_KEY_CHARS and len(bare.decode("utf-8", "replace")) < MIN_KEY_CHARS):
        return None
    return xxhash.xxh3_128_digest(bare)


def line_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc): one row per row of ``docs`` and distinct line key in it."""

    def start():
        def step(cols):
            keys, ids = [], []
            for doc, text in zip(cols["doc"], cols["text"], strict=True):
                own = {line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")} - {None}
                keys += sorted(own)
                ids += [doc] * len(own)
            return {"key": keys, "doc": ids}

        return step

    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return map_batches(docs.select(doc.alias("doc"), text_of(text_col).alias("text")), start, "key binary, doc long")


def _counted(postings: DataFrame) -> DataFrame:
    """Exact reference counts: combined in the map tasks first, so a line of a third of all documents is a row per task."""
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))


@dataclass(frozen=True)
class LineIndex:
    """Which lines are held, by how many documents and first by which.

    ``refs`` (key, refs, lo, hi) is the exact table, ``postings`` (key, doc) its evidence, ``filters`` one cuckoo filter
    per shard over the keys of ``refs``. An insertion asks the filter first: what it doesn't know is new and skips the
    look-up in the exact table. A deletion lowers the counts, finds the next holder of a line whose first holder goes,
    and takes keys without holders out of the filter. Deleting what was inserted gives back the index before it.
    All tables are written to the shared folder; nothing of them reaches the driver but row counts.
    """

    refs: DataFrame
    postings: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession) -> LineIndex:
        none = spark.createDataFrame([], REFS)
        return cls(none, spark.createDataFrame([], "key binary, doc long"), spark.createDataFrame([], "shard int, slots binary"), 1)

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _rebuilt(self, refs: DataFrame, postings: DataFrame, shards: int) -> LineIndex:
        """With new filters over all of ``refs``."""

        def build(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": part["shard"].iloc[:1], "slots": [build_filter(hashes(part["key"].tolist())).dump()]})

        made = LineIndex(refs, postings, refs, shards)
        keyed = refs.select("key", made._shard().alias("shard"))
        return LineIndex(refs, postings, staged(keyed.groupBy("shard").applyInPandas(build, "shard int, slots binary"), "line-filters"), shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with all lines of ``docs`` added.

        Each row counts: an id inserted again adds to the counts of its lines, so a document with a new text is deleted
        first. Null ids are one document, null and empty texts hold no line with a key, other columns are not read.
        """
        new = staged(line_postings(docs, id_col, text_col), "line-postings")
        postings = self.postings.unionByName(new)
        batch = staged(_counted(new), "line-batch")

        def ask(key, part):
            """The batch's keys of a shard with what its filter says of each, and the filter with the keys it didn't know."""
            slots, add = part["slots"][part["key"].isna()], part[part["key"].notna()]
            known = CuckooFilter.load(slots.iloc[0]) if len(slots) else None
            h = hashes(add["key"].tolist()) if len(add) else np.zeros(0, dtype=np.uint64)
            maybe = known.contains(h) if known is not None and len(h) else np.zeros(len(h), dtype=bool)
            full = known is None or not known.insert(h[~maybe])
            out = add.assign(maybe=maybe, slots=None)
            last = pd.DataFrame({"key": [None], "refs": [0], "lo": [0], "hi": [0], "shard": [key[0]], "maybe": [full], "slots": [None if full else known.dump()]})
            return pd.concat([out, last])[["key", "refs", "lo", "hi", "shard", "maybe", "slots"]]

        # a shard's keys of one batch are a task's group; a filter travels to its shard as one row
        none = lambda kind: F.lit(None).cast(kind)
        adds = batch.select("key", "refs", "lo", "hi", self._shard().alias("shard"), none("binary").alias("slots"))
        held = self.filters.select(none("binary").alias("key"), *[F.lit(0).cast("long").alias(c) for c in ("refs", "lo", "hi")], "shard", "slots")
        asked = staged(adds.unionByName(held).groupBy("shard").applyInPandas(ask, f"{REFS}, shard int, maybe boolean, slots binary"), "line-asked")
        keys = asked.filter("key IS NOT NULL")
        maybe = staged(keys.filter("maybe").select("key", "refs", "lo", "hi"), "line-maybe")
        refs = self.refs.unionByName(keys.filter("NOT maybe").select("key", "refs", "lo", "hi"))
        if maybe.limit(1).count():  # only these are looked up in the exact table
            seen = self.refs.join(maybe.select("key"), "key", "left_semi").unionByName(maybe).groupBy("key").agg(
                F.sum("refs").alias("refs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            refs = self.refs.join(maybe.select("key"), "key", "left_anti").unionByName(keys.filter("NOT maybe").select("key", "refs", "lo", "hi")).unionByName(seen)
        refs = staged(refs, "line-refs")
        filters = asked.filter("key IS NULL")
        shards = partitions_for(refs.count(), SHARD_KEYS)
        if shards > self.shards or filters.filter("maybe").limit(1).count():  # more shards, or a filter that is full
            return self._rebuilt(refs, postings, max(shards, self.shards))
        return LineIndex(refs, postings, filters.select("shard", "slots"), self.shards)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents whose ids ``ids`` lists; ids it doesn't hold are passed over."""
        gone = ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        removed = self.postings.join(gone, "doc", "left_semi")
        left = staged(self.postings.join(gone, "doc", "left_anti").select("key", "doc"), "line-postings")
        touched = staged(removed.select("key").distinct(), "touched-lines")
        again = _counted(left.join(touched, "key", "left_semi"))
        refs = staged(self.refs.join(touched, "key", "left_anti").unionByName(again), "line-refs")
        dead = touched.join(refs, "key", "left_anti").select("key", self._shard().alias("shard"), F.lit(None).cast("binary").alias("slots"))

        def run(part):
            slots = part[part["key"].isna()]
            keys = part[part["key"].notna()]["key"].tolist()
            known = CuckooFilter.load(slots["slots"].iloc[0])
            known.delete(hashes(keys) if keys else np.zeros(0, dtype=np.uint64))
            return pd.DataFrame({"shard": slots["shard"], "slots": [known.dump()]})

        old = self.filters.select(F.lit(None).cast("binary").alias("key"), "shard", "slots")
        filters = staged(dead.unionByName(old).groupBy("shard").applyInPandas(run, "shard int, slots binary"), "line-filters")
        return LineIndex(refs, left, filters, self.shards)

    def duplicates(self) -> DataFrame:
        """(doc, key) of every line that a document loses because a smaller id holds it."""
        twice = self.refs.filter(F.col("lo") < F.col("hi")).select("key", "lo")
        return self.postings.join(twice, "key").filter(F.col("doc") > F.col("lo")).select("doc", "key")


def drop_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` (which ``index`` holds): ``doc_id``, ``n_lines``, ``n_dropped``, ``text`` of the lines that stay.

    Lines with a key of ten code points or more that two documents hold stay only in the one with the smallest id; a null
    id comes last and is one document. Rows with the same id are one document and all keep its lines. Null and empty
    texts are one empty line. Repeated lines inside the first holder stay. Other columns are not read.
    """
    lost = index.duplicates().groupBy("doc").agg(F.collect_set("key").alias("lost"))  # at most a document's own lines
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text_of(text_col).alias("text"))
    both = rows.join(lost.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "lost")

    def start():
        def step(cols):
            n_lines, n_dropped, texts = [], [], []
            for text, lost_keys in zip(cols["text"], cols["lost"], strict=True):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                stay = lines
                if lost_keys:
                    drop = set(lost_keys)
                    stay = [x for x in lines if line_key(x) not in drop]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                texts.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
            return {"doc_id": cols["doc_id"], "n_lines": n_lines, "n_dropped": n_dropped, "text": texts}

        return step

    return map_batches(both, start, "doc_id long, n_lines long, n_dropped long, text string")

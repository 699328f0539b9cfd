"""Repeated byte strings across documents: prefix doubling over sampled positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, running, staged, text_of

THRESHOLD = 100
GRAM = 32
CHUNK_BYTES = 1 << 21
POSITION_BITS = 22

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranks:
    """Hashes of any substring of a buffer in constant time, equal for equal strings wherever they lie."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)]), dtype=np.uint64) for b in (np.uint64(_BASE), np.uint64(inverse)))

    def read(self, data: np.ndarray) -> None:
        self._powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def anchors(ranks: Ranks, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """The sampled positions of the texts at [start, end) of the buffer ``ranks`` has read.

    Every string of ``length`` bytes elects the gram with the smallest hash inside it (the leftmost of equals), so equal
    strings elect the same place. Returns per elected place: its text, its position, the first and last string electing
    it, the gram's rank, and the rank of the whole context that all strings electing it could see.
    """
    n = len(ranks.sums) - 1
    reach = length - gram
    none = [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=np.uint64)] * 2
    if n < length:
        return none
    g = ranks.every(gram)
    place = np.arange(len(g), dtype=np.uint64)
    order = (g >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | place
    width = 1
    least = order
    while width * 2 <= reach + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = reach + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    first = np.arange(len(least))  # a string of the buffer starts here; it must lie inside one text
    text = np.searchsorted(starts, first, side="right") - 1
    inside = first + length <= ends[text]
    first, text = first[inside], text[inside]
    if not len(first):
        return none
    at = (least[inside] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))  # a place is elected by a run of strings
    low, high = first[new], first[np.append(new[1:], len(at)) - 1]
    at, text = at[new], text[new]
    left, right = np.maximum(at - reach, starts[text]), np.minimum(at + length, ends[text])
    shape = ((at - left) * 1000 + (right - at)).astype(np.uint64)
    context = mix(ranks.of(left, right) + mix(shape + np.uint64(1)))
    return text, at, low, high, g[at], context


RECORD = np.dtype([("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("back", "u1"), ("more", "u1"), ("cores", "<u2", 4)])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")])
EDGE = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("back", "u1"), ("more", "u1"), ("open", "u1")])
REACH = THRESHOLD - GRAM  # a string electing a place starts at most so many bytes before it
STEP = REACH // 4
CONTEXT = REACH + THRESHOLD
LOCAL_CONTEXTS = 64
SHARD_BYTES = 24 << 20
WIDE = 128  # marks, in ``more``, a gram whose records in a chunk went elsewhere


def packed(a: np.ndarray) -> bytes:
    """Field by field, which compresses far better than record by record."""
    return b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names)


def unpacked(blobs, dtype: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        n, at = len(blob) // dtype.itemsize, 0
        a = np.zeros(n, dtype=dtype)
        for f in dtype.names:
            kind = dtype[f]
            a[f] = np.frombuffer(blob, dtype=kind.base, count=n * int(np.prod(kind.shape, dtype=int)), offset=at).reshape((n, *kind.shape))
            at += n * kind.itemsize
        parts.append(a)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def dealt(a: np.ndarray, by: np.ndarray, n: int):
    """(shard, records): ``by`` modulo the prime ``n``, as Spark's pmod has it."""
    shard = np.mod(by, by.dtype.type(n)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    if not len(a):
        return
    for s, e in zip(cuts, [*cuts[1:], len(a)], strict=True):
        yield int(shard[order[s]]), a[order[s:e]]


def segments(ids: list[int], texts: list[bytes]):
    """Chunks of about CHUNK_BYTES as (doc ids, offsets, pieces); a longer text is cut with room to see past the cut."""
    ids_, offs, parts, size = [], [], [], 0
    for doc, text in zip(ids, texts, strict=True):
        at = 0
        while True:
            end = min(len(text), at + CHUNK_BYTES)
            # strings that start before ``end`` belong here; their contexts may begin earlier and end later
            lo, hi = max(0, at - CONTEXT), min(len(text), end + CONTEXT)
            ids_.append((doc, at, end))
            offs.append(lo)
            parts.append(text[lo:hi])
            size += hi - lo
            if size >= CHUNK_BYTES // 2:
                yield ids_, offs, parts
                ids_, offs, parts, size = [], [], [], 0
            at = end
            if at >= len(text):
                break
    if parts:
        yield ids_, offs, parts


def first_in_group(*keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by ``keys``: which differ from the row before."""
    new = np.zeros(len(keys[0]), dtype=bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def sampled(ranks: Ranks, ids, offs, parts) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    keep = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ranks.read(data)
    text, at, low, high, gram, context = anchors(ranks, starts[keep], ends[keep], THRESHOLD, GRAM)
    text = keep[text]
    doc = np.fromiter((d for d, _, _ in ids), dtype=np.int64, count=len(ids))[text]
    begin = np.fromiter((b for _, b, _ in ids), dtype=np.int64, count=len(ids))[text]
    stop = np.fromiter((e for _, _, e in ids), dtype=np.int64, count=len(ids))[text]
    shift = np.asarray(offs, dtype=np.int64)[text] - starts[text]
    # of a cut text, a part answers for the strings that start inside it
    low, high = np.maximum(low, begin - shift), np.minimum(high, stop - 1 - shift)
    mine = low <= high
    text, at, low, high, gram, context, doc, shift = (x[mine] for x in (text, at, low, high, gram, context, doc, shift))
    out = np.zeros(len(at), dtype=RECORD)
    out["gram"], out["context"], out["doc"], out["at"] = gram, context, doc, at + shift
    out["back"], out["more"] = at - low, at - high
    for i in range(4):  # what all strings that start STEP * i .. STEP * (i + 1) bytes before the place have in common
        lo, hi = at - STEP * i, at - STEP * (i + 1) + THRESHOLD
        ok = (lo >= starts[text]) & (hi <= ends[text])
        core = np.zeros(len(at), dtype=np.uint64)
        core[ok] = ranks.of(lo[ok], hi[ok])
        out["cores"][:, i] = np.where(ok, np.maximum(core >> np.uint64(48), np.uint64(1)), 0).astype(np.uint16)
    return out


def spans_of(r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), dtype=SPAN)
    out["doc"], out["start"], out["stop"] = r["doc"], r["at"] - r["back"], r["at"].astype(np.int64) - r["more"] + THRESHOLD
    return out


def ranked(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted records, which come first in their context, and how many contexts their gram has."""
    r = r[np.lexsort((r["at"], r["doc"], r["context"], r["gram"]))]
    if not len(r):
        return r, np.zeros(0, dtype=bool), np.zeros(0)
    gram = first_in_group(r["gram"])
    context = gram | first_in_group(r["context"])
    lead = np.flatnonzero(context)[np.cumsum(context) - 1]
    # a place next to a cut of a long text has two records
    first = (r["doc"] == r["doc"][lead]) & (r["at"] == r["at"][lead])
    return r, first, np.bincount(np.cumsum(gram) - 1, weights=context)[np.cumsum(gram) - 1]


def edges_of(r: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Of the first records of each context, sorted by gram: those sharing a core with another context, range by range.

    Grams in ``wide`` have records elsewhere, so all of theirs stay open.
    """
    alive = np.zeros(len(r), dtype=np.uint8)
    for i in range(4):
        core = r["cores"][:, i]
        order = np.lexsort((core, r["gram"]))
        new = first_in_group(r["gram"][order], core[order])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        near, far = STEP * i + (i > 0), STEP * (i + 1)
        some = np.maximum(r["more"].astype(int), near) <= np.minimum(r["back"].astype(int), far)
        hit = np.zeros(len(r), dtype=bool)
        hit[order] = many
        alive |= ((hit & (core > 0) & some).astype(np.uint8) << i).astype(np.uint8)
    alive[np.isin(r["gram"], wide)] = 15
    r, alive = r[alive > 0], alive[alive > 0]
    out = np.zeros(len(r), dtype=EDGE)
    for f in ("gram", "doc", "at", "back", "more"):
        out[f] = r[f]
    out["open"] = alive
    return out


def compared(edges: np.ndarray, bodies: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Strings of the edges' open ranges that an earlier edge has as well, as spans.

    ``bodies`` are the contexts, REACH bytes before the place and THRESHOLD after it. The last doubling is to THRESHOLD
    itself: strings are ranked whole.
    """
    ranks.read(bodies.reshape(-1))
    base = np.arange(len(edges)) * CONTEXT + REACH
    which, back = [], []
    for d in range(REACH + 1):
        i = 0 if d <= STEP else min(3, (d - 1) // STEP)
        here = np.flatnonzero((edges["back"] >= d) & (edges["more"] <= d) & ((edges["open"] >> i) & 1 > 0))
        which.append(here)
        back.append(np.full(len(here), d))
    which, back = np.concatenate(which), np.concatenate(back)
    rank = ranks.of(base[which] - back, base[which] - back + THRESHOLD)
    doc, start = edges["doc"][which], edges["at"][which].astype(np.int64) - back
    order = np.lexsort((start, doc, rank))
    doc, start = doc[order], start[order]
    new = first_in_group(rank[order])
    if not len(new):
        return np.zeros(0, dtype=SPAN)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (doc != doc[lead]) | (start != start[lead])
    doc, start = doc[again], start[again]
    # neighbouring starts become one span
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = first_in_group(doc)
    cut[1:] |= start[1:] > start[:-1] + 1
    at = np.flatnonzero(cut)
    out = np.zeros(len(at), dtype=SPAN)
    if len(at):
        out["doc"], out["start"], out["stop"] = doc[at], start[at], start[np.append(at[1:], len(start)) - 1] + THRESHOLD
    return out


def covered(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(zip(spans["start"].tolist(), spans["stop"].tolist(), strict=True)):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


BLOBS = "kind int, shard int, payload binary"
LOCAL, SPANS, EDGES, BODIES = 0, 1, 2, 3


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with ``doc`` unique and in the order of ids, and the table from ``doc`` to ids where they differ.

    Unique ids number the documents. Otherwise rows with the same id and text are one document, null ids come last, and
    documents are numbered in order of id and text hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids")).first()
    if n["n"] == n["ids"] and not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        return rows.select(F.col("id").alias("doc"), "text"), None
    marked = rows.withColumn("mark", F.xxhash64("text"))
    each = marked.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).select(F.col("id").isNull().alias("last"), "id", "mark", "n", F.lit(0).alias("zero"))
    each = each.withColumn("all", F.lit(0))
    order = staged(running(each, ["all"], ["last", "id", "mark"], "zero", "none", "doc").select("doc", "id", "mark", "n"), "suffix-docs")
    same = F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_mark") == F.col("mark"))
    texts = marked.dropDuplicates(["id", "mark"]).withColumnsRenamed({"id": "t_id", "mark": "t_mark"}).join(order, same).select(F.col("doc").cast("long").alias("doc"), "text")
    return staged(texts, "suffix-texts"), order


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes).

    Every byte goes that a string of 100 bytes covers which also starts earlier: in a smaller id, or earlier in the same
    document. Matches overlap freely, never cross documents, and are judged on the input.

    Ranks grow as in prefix doubling, but only at sampled positions: every 100-byte string elects the place of the
    32-byte string with the smallest hash in it, so equal strings elect equal places, one in about 35.
      32 bytes: places whose 32 bytes are unique are done; nothing that elects them repeats.
      168 bytes, all that strings electing a place can see: of equal ones every later one is a repeat as a whole.
      83 bytes: of the places left, those sharing 83 bytes at one of four offsets with another go on.
      100 bytes: strings electing them are ranked one by one, and all but the earliest of a rank are repeats.
    A map task drops what repeats inside a chunk before the exchange, and a 32-byte string with more than 64 different
    contexts in a chunk leaves it as edges, so that a passage of very many documents isn't sorted in one place.

    Null and empty texts have no bytes. Rows with the same id and text are one document; with the same id and different
    texts they follow each other in order of the text's hash. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    texts, names = _numbered(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = next_prime(max(3 * shuffle, -(-total // SHARD_BYTES)))
    arrow = to_arrow_schema(T.StructType.fromDDL(BLOBS))

    def rows_of(kind, pairs):
        return [(kind, s, packed(a)) for s, a in pairs]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

    def sample(batches):
        ranks, pending = Ranks(), []
        held, size = ([], []), 0

        def chunk():
            for ids, offs, parts in segments(*held):
                r = sampled(ranks, ids, offs, parts)
                r, first, contexts = ranked(r)
                again = spans_of(r[~first])
                r, contexts = r[first], contexts[first]
                wide = contexts > LOCAL_CONTEXTS
                pending.extend(rows_of(SPANS, dealt(again, again["doc"], shards)))
                if wide.any():
                    hot = r[wide]
                    edge = np.zeros(len(hot), dtype=EDGE)
                    for f in ("gram", "doc", "at", "back", "more"):
                        edge[f] = hot[f]
                    edge["open"] = 15
                    pending.extend(rows_of(EDGES, dealt(edge, edge["doc"], shards)))
                    # a few stand for the rest, so that other chunks see that the gram isn't alone
                    nth = np.arange(len(hot)) - np.flatnonzero(first_in_group(hot["gram"]))[np.cumsum(first_in_group(hot["gram"])) - 1]
                    few = hot[nth < 3]
                    few["more"] |= WIDE
                    r = np.concatenate([r[~wide], few])
                pending.extend(rows_of(LOCAL, dealt(r, r["gram"], shards)))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                held[0].append(doc)
                held[1].append(data)
                size += len(data)
                if size >= CHUNK_BYTES:
                    chunk()
                    held, size = ([], []), 0
                    yield batch_of(pending)
                    pending.clear()
        chunk()
        if pending:
            yield batch_of(pending)

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, s, p) for k, s, p in zip(part["kind"], part["shard"], part["payload"], strict=True) if k != LOCAL]
        r = unpacked(part["payload"][part["kind"] == LOCAL], RECORD)
        wide = np.unique(r["gram"][(r["more"] & WIDE) > 0])
        r["more"] &= WIDE - 1
        r, first, contexts = ranked(r)
        if len(r):
            again = spans_of(r[~first])
            edge = edges_of(r[first & ((contexts > 1) | np.isin(r["gram"], wide))], wide)
            rows += rows_of(SPANS, dealt(again, again["doc"], shards)) + rows_of(EDGES, dealt(edge, edge["doc"], shards))
        return pd.DataFrame(rows, columns=["kind", "shard", "payload"])

    found = staged(texts.mapInArrow(sample, BLOBS).groupBy("shard").applyInPandas(rank, BLOBS), "suffix-ranks")
    home = texts.withColumn("shard", F.pmod("doc", F.lit(shards).cast("long")).cast("int"))

    def contexts_of(key, part: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        edges = unpacked(blobs["payload"], EDGE)
        if not len(edges):
            return pd.DataFrame([], columns=["kind", "shard", "payload"])
        edges = edges[np.argsort(edges["doc"], kind="stable")]
        bodies = np.zeros((len(edges), CONTEXT), dtype=np.uint8)
        where = dict(zip(part["doc"], part["text"], strict=True))
        doc, data = None, b""
        for i, (d, at) in enumerate(zip(edges["doc"].tolist(), edges["at"].tolist(), strict=True)):
            if d != doc:
                doc, data = d, where[d].encode("utf-8", "surrogatepass")
            lo, hi = max(0, at - REACH), min(len(data), at + THRESHOLD)
            bodies[i, lo - at + REACH : hi - at + REACH] = np.frombuffer(data, dtype=np.uint8, count=hi - lo, offset=lo)
        both = np.zeros(len(edges), dtype=[*[(f, edges.dtype[f]) for f in EDGE.names], ("body", "u1", CONTEXT)])
        for f in EDGE.names:
            both[f] = edges[f]
        both["body"] = bodies
        return pd.DataFrame(rows_of(BODIES, dealt(both, both["gram"], shards)), columns=["kind", "shard", "payload"])

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        both = unpacked(part["payload"], np.dtype([*[(f, EDGE[f]) for f in EDGE.names], ("body", "u1", CONTEXT)]))
        spans = compared(both, np.ascontiguousarray(both["body"]), Ranks())
        return pd.DataFrame(rows_of(SPANS, dealt(spans, spans["doc"], shards)), columns=["kind", "shard", "payload"])

    edges = found.filter(F.col("kind") == EDGES)
    bodies = home.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(contexts_of, BLOBS)
    late = bodies.groupBy("shard").applyInPandas(settle, BLOBS)
    spans = found.filter(F.col("kind") == SPANS).unionByName(late)

    def cut(key, part: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        gone = unpacked(blobs["payload"], SPAN)
        gone = gone[np.argsort(gone["doc"], kind="stable")]
        names_, first = (x.tolist() for x in np.unique(gone["doc"], return_index=True))
        where = {d: gone[s:e] for d, s, e in zip(names_, first, [*first[1:], len(gone)][: len(first)], strict=True)}
        rows = []
        for doc, text in zip(part["doc"].tolist(), part["text"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            runs = covered(where[doc]) if doc in where else []
            last, kept = 0, []
            for start, stop in runs:
                kept.append(data[last:start])
                last = stop
            rows.append((doc, len(data), sum(e - s for s, e in runs), len(runs), b"".join([*kept, data[last:]])))
        return pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = home.groupBy("shard").cogroup(spans.groupBy("shard")).applyInPandas(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    columns = ["n_bytes", "n_removed", "n_spans", "kept"]
    if names is None:
        return out.select(F.col("doc").alias("doc_id"), *columns)
    again = fresh(out, "__again")
    back = out.join(names.select("doc", "id", "n"), "doc").withColumn(again, F.explode(F.array_repeat(F.lit(True), F.col("n").cast("int"))))
    return back.select(F.col("id").alias("doc_id"), *columns)

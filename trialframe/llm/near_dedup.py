"""Near duplicates by weighted Jaccard similarity of word shingle multisets: BagMinHash, banding, verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, give_back, map_batches, slices, staged, text_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
CHUNK_WORDS = 300_000
DRAWS = 50_000
BLOCK = 50_000
MEETING = 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _gold(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle multisets of texts. Words are maximal runs without ASCII white space. Each is hashed where it stands: a table of
    a corpus' words is slower to look into than a hash."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def words(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").split()

    def bag(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingle hashes and their counts. A text of fewer words than a shingle is one shingle."""
        if not words:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        codes = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
        size = min(self.size, len(words))
        h = np.full(len(words) - size + 1, np.uint64(size), dtype=np.uint64)
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + codes[j : j + len(h)]
        return np.unique(mix(h), return_counts=True)


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """The identities of the ``m`` signature components of every bag, as an array (bags, m).

    Weights are counts, whole numbers, so the discretisation is exact and components agree with a probability equal to
    the weighted Jaccard similarity. A shingle's weight axis is cut into the intervals (0, 1], (1, 2], (2, 4], (4, 8], ...
    and each interval carries a Poisson process of its length as rate, seeded by shingle and interval alone. A point has a
    component and a unit of its interval; it counts if that unit lies within the shingle's count. A component keeps its
    earliest point. Points are drawn in order of time, one of every process per round, and a process ends as soon as its
    time exceeds the latest component of its bag: most processes of a large bag draw a single point. Once few processes
    are left, a round draws up to ``DRAWS`` points of them; those after the latest component change nothing.
    """
    n = len(bags)
    hashes = np.concatenate([b[0] for b in bags])
    counts = np.concatenate([b[1] for b in bags])
    bag = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    keys, rates, base, limit, owner = [mix(hashes + _GOLD)], [np.ones(len(hashes))], [np.zeros(len(hashes))], [counts], [bag]
    k = 1
    more = np.flatnonzero(counts > 1)
    while len(more):  # interval k covers (2 ** (k - 1), 2 ** k]
        low = 1 << (k - 1)
        keys.append(mix(hashes[more] + _gold(k + 1)))
        rates.append(np.full(len(more), float(low)))
        base.append(np.full(len(more), float(low)))
        limit.append(counts[more])
        owner.append(bag[more])
        more = more[counts[more] > 2 * low]
        k += 1
    key, rate, low, most, own = (np.concatenate(x) for x in (keys, rates, base, limit, owner))
    time = np.zeros(len(key))
    first = np.full(n * m, np.inf)
    ident = np.zeros(n * m, dtype=np.uint64)
    step = 0
    while len(key):
        many = 1 if 2 * len(key) > DRAWS else min(DRAWS // len(key), 256)
        steps = np.asarray([_gold(2 * (step + j)) for j in range(1, many + 1)])
        draw = mix(key[:, None] + steps)
        place = mix(draw + _GOLD)
        gaps = -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        unit = (low + 1)[:, None] + np.floor((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate[:, None])
        good = unit <= most[:, None]
        at = np.broadcast_to(own[:, None] * m, good.shape)[good] + ((place[good] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        when, name = times[good], draw[good]
        soon = when < first[at]
        at, when, name = at[soon], when[soon], name[soon]
        np.minimum.at(first, at, when)
        won = first[at] == when
        ident[at[won]] = name[won]
        owners = own[np.flatnonzero(np.diff(own, prepend=-1))] if not step else np.unique(own)
        latest = np.zeros(n)
        latest[owners] = first.reshape(n, m)[owners].max(axis=1)
        step += many
        time = times[:, -1]
        live = time < latest[own]
        key, rate, low, most, own, time = key[live], rate[live], low[live], most[live], own[live], time[live]
    return ident.reshape(n, m)


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per bag and band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return h.view(np.int64)


def signed_documents(docs: DataFrame, size: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, key, total, buckets) per row. ``key`` is the 128-bit digest of the words, ``mark`` a hash of the text."""

    def start():
        shingler = Shingler(size)

        def step(cols):
            keys, totals, out = [], [], []
            held, words_held = [], 0

            def flush():
                nonlocal held, words_held
                full = [b for b in held if len(b[0])]
                made = iter(bands_of(bag_min_hash(full, bands * rows), bands, rows).tolist() if full else [])
                out.extend(next(made) if len(b[0]) else [] for b in held)
                held, words_held = [], 0

            for text in cols["text"]:
                words = shingler.words(text)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bag = shingler.bag(words)
                totals.append(int(bag[1].sum()))
                held.append(bag)
                words_held += len(words)
                if words_held > CHUNK_WORDS or len(held) >= 1000:
                    flush()
            flush()
            return {"id": cols["id"], "mark": cols["mark"], "key": keys, "total": totals, "buckets": out}

        return step

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    return map_batches(rows_in, start, "id long, mark long, key binary, total long, buckets array<long>", lean=True)


def _texts(keys: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of the ``keys``: the text that stands for each."""
    wanted = staged(keys.join(nodes.select("key", F.col("rep.id").alias("r_id"), F.col("rep.mark").alias("r_mark")), "key"), "near-wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    texts = texts.join(wanted.hint("merge"), (F.col("mark") == F.col("r_mark")) & F.col("id").eqNullSafe(F.col("r_id")))
    return staged(texts.groupBy("key").agg(F.first("text").alias("text")), "near-texts")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every key in ``edges`` (a, b): the smallest key it is connected to, by alternating stars.

    Edges are written after every round; a round ends the work once every key has only larger neighbours, or one smaller one
    and no other. Only that verdict reaches the driver.
    """
    cur = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    near = Window.partitionBy("u")
    while True:
        both = cur.union(cur.select("v", "u"))
        sides = both.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
        if not sides.filter("below > 1 or (below > 0 and above > 0)").limit(1).count():
            return cur.select(F.col("u").alias("key"), F.col("v").alias("root")).union(cur.select("v", "v").distinct())
        # large star: the larger neighbours of u go to the smallest key among u and its neighbours
        large = both.withColumn("m", F.least("u", F.min("v").over(near))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        small = large.withColumn("m", F.min("v").over(near)).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        cur = staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")


def _standing(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``members`` (bucket, key, total, degree, root) with their classes by now, without the buckets of one class: classes
    only grow, so those have no pair left. A key without a root is its own."""
    known = members.withColumnRenamed("root", "own").join(roots, "key", "left").withColumn("root", F.coalesce("root", "own")).select(*members.columns)
    sides = Window.partitionBy("bucket")
    known = known.withColumns({"lo": F.min("root").over(sides), "hi": F.max("root").over(sides)})
    return staged(known.filter("lo <> hi").drop("lo", "hi"), "near-members")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows of the blocks of about ``block`` shingles into which every bucket is cut. Its most central member, which shares
    most with the others, is in each of them; every other one is in one."""
    whole = Window.partitionBy("bucket")
    cut = members.withColumns({"n": F.ceil(F.sum("total").over(whole) / F.lit(float(block))).cast("int"), "top": F.max(F.struct("degree", "key")).over(whole)})
    one = F.array(F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    at = F.when(F.col("key") == F.col("top.key"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(one)
    return cut.select("bucket", F.explode(at).alias("s"), F.lit(0).alias("o"), F.lit(None).cast("boolean").alias("stray"), "key", "degree", "root")


def _mains(members: DataFrame, block: int) -> DataFrame:
    """(bucket, main, n_strays, n_others, n, rows) of the buckets of several classes: the class with most members, the blocks
    of all others' members and of all members, the members, and the rows that :func:`_meeting` gives."""
    held = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t"))
    held = held.groupBy("bucket").agg(
        F.max(F.struct("n", "t", "root")).alias("main"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    cuts = lambda t: F.ceil(t / F.lit(float(block))).cast("int")
    held = held.select("bucket", "n", F.col("main.n").alias("most"), F.col("main.root").alias("main"), cuts(F.col("t") - F.col("main.t")).alias("n_strays"), cuts(F.col("t")).alias("n_others"))
    return held.withColumn("rows", (F.col("n") - F.col("most")) * F.col("n_others") + F.col("n") * F.col("n_strays")).drop("most")


def _meeting(members: DataFrame, block: int) -> DataFrame:
    """Rows of the blocks in which every two members of a bucket that stand in different classes meet.

    ``members`` (bucket, key, total, degree, root). The class with most members of a bucket is its main one, all other members
    are strays, so one of two members in different classes is a stray. Strays and members are cut into blocks of about
    ``block`` shingles each and every block of strays meets every block of members: rows are members times blocks, not pairs,
    and no task gets more than two blocks at once.
    """
    known = members.join(_mains(members, block).drop("n", "rows"), "bucket")
    at = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "degree", "root"]
    strays = known.filter("root <> main").select("bucket", at("n_strays").alias("s"), every("n_others").alias("o"), F.lit(True).alias("stray"), *kept)
    others = known.select("bucket", every("n_strays").alias("s"), at("n_others").alias("o"), F.lit(False).alias("stray"), *kept)
    return strays.unionByName(others)


def _near(bags: list[tuple[np.ndarray, np.ndarray]], similarity: float):
    """A function from a bag to the places of the ``bags`` similar enough to it."""
    hashes, counts = (np.concatenate([b[i] for b in bags]) for i in (0, 1))
    owner, order = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags]), np.argsort(hashes, kind="stable")
    hashes, counts, owner = hashes[order], counts[order], owner[order]
    totals = np.asarray([b[1].sum() for b in bags])

    def near(mine: np.ndarray, many: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
        n = hi - lo
        place = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        shared = np.bincount(owner[place], np.minimum(counts[place], np.repeat(many, n)), len(bags))
        return np.flatnonzero(shared >= similarity * (totals + many.sum() - shared) - 1e-9)

    return near


def _together(keys: list[bytes], degrees: list[int], bags: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple[bytes, bytes]]:
    """The classes of one block as (key, smallest key). The most central text is compared with all others, then one outside
    the largest class of those not compared yet, until these are of one class: no other two can be in different ones."""
    near, classes, left = _near(bags, similarity), np.arange(len(keys)), np.ones(len(keys), dtype=bool)
    at = int(np.argmax(degrees))
    while True:
        left[at] = False
        classes[np.isin(classes, classes[near(*bags[at])])] = classes[at]
        main = np.bincount(classes[left], minlength=1).argmax()
        rest = np.flatnonzero(left & (classes != main))
        if not len(rest):
            break
        at = int(rest[0])
    held: dict[int, list[bytes]] = {}
    for key, c in zip(keys, classes.tolist(), strict=True):
        held.setdefault(c, []).append(key)
    return [(key, low) for group in held.values() for low in [min(group)] for key in group if key != low]


def _across(strays: dict[bytes, bytes], others: dict[bytes, bytes], bags: dict[bytes, tuple], similarity: float) -> list[tuple[bytes, bytes]]:
    """The links of a block of strays with a block of members (key to root): one for a stray and another class."""
    names = list(others)
    near, classes = _near([bags[k] for k in names], similarity), pd.factorize(np.asarray(list(others.values()), dtype=object))[0]
    out = []
    for a, root in strays.items():
        found = near(*bags[a])
        out += [(a, names[i]) for i in found[np.unique(classes[found], return_index=True)[1]] if others[names[i]] != root]
    return out


def _links(rows: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The links (a, b) found in the blocks of :func:`_blocks` or :func:`_meeting`; a task reads one block after the other."""
    block = ["bucket", "s", "o"]
    rows = rows.join(texts.hint("merge"), "key").select(*block, "stray", "key", "degree", "root", "text")

    def found(shingler, rows):
        bags = {}
        for row in rows:
            if row[1] not in bags:
                bags[row[1]] = shingler.bag(shingler.words(row[4]))
        if rows[0][0] is None:
            return _together([r[1] for r in rows], [r[2] for r in rows], [bags[r[1]] for r in rows], similarity) if len(rows) > 1 else []
        strays, others = ({r[1]: r[3] for r in rows if r[0] == side} for side in (True, False))
        return _across(strays, others, bags, similarity) if strays and others else []

    def run(batches):
        shingler, at, held, out = Shingler(size), None, [], []
        for batch in slices(batches):
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if row[:3] != at:
                    out += found(shingler, held) if held else []
                    at, held = row[:3], []
                held.append(row[3:])
            yield linked(out)
            out = []
        yield linked(out + (found(shingler, held) if held else []))
        del held
        give_back()

    def linked(out):
        return pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return staged(rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "a binary, b binary"), "near-links")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: ``id, mark, class_id, class_size, kept``; ``class_id`` is the smallest id of the class.

    Two texts are linked if the weighted Jaccard similarity of their shingle multisets is ``similarity`` or more; classes
    are the connected texts. Texts with the same words are one node from the start (empty and null texts too), so copies
    are never compared. A pair at the threshold shares a bucket of 32 bands of 5 components with probability 1 - 3e-6.

    Copies with few edits meet in most bands, so the buckets with the same smallest key become one. Such a bucket is cut into
    blocks and every two texts of a block are compared, unless they already stand in one class (:func:`_blocks`); the most
    central text is in every block. In buckets of several blocks and classes, one text a class is compared in the same way
    as long as that links some and the rest would be long; then every two texts that still stand in different classes are,
    block by block (:func:`_meeting`). So no candidate is dropped.

    Exactly one row of a class has ``kept``, unless a row is repeated with the same id and text: then all its copies do
    (:func:`drop_near` keeps one). Null ids come last. An empty table gives an empty result.
    """
    signed = staged(signed_documents(docs, size, bands, rows, id_col, text_col), "near-signed")
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    nodes = staged(
        signed.groupBy("key").agg(F.min(rep).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("total").alias("total"), F.first("buckets").alias("buckets")), "near-nodes")
    same = Window.partitionBy("bucket")
    held = nodes.select("key", "total", F.explode("buckets").alias("bucket")).withColumns({"n": F.count(F.lit(1)).over(same), "low": F.min("key").over(same)})
    members = held.filter("n > 1").groupBy(F.col("low").alias("bucket"), "key").agg(F.first("total").alias("total"), F.sum("n").alias("degree"))
    members = staged(members.withColumn("root", F.col("key")), "near-members")
    texts = _texts(members.select("key").distinct(), nodes, docs, id_col, text_col)
    links = _links(_blocks(members, block), texts, similarity, size)
    roots = components(links)
    open_ = members.withColumn("all", F.sum("total").over(same)).filter(F.col("all") > block).drop("all")
    fruitless = False
    while True:
        open_ = _standing(open_, roots)
        cost = _mains(open_, block).agg(F.sum("rows"), F.sum("n")).first()
        if not cost[1]:
            break
        last = fruitless or cost[0] <= MEETING * cost[1]
        if last:
            links = _links(_meeting(open_, block), texts, similarity, size)
        else:
            one = F.max(F.struct("degree", "key", "total")).alias("one")
            leaders = open_.groupBy("bucket", "root").agg(one).select("bucket", "one.key", "one.total", "one.degree", "root")
            links = _links(_blocks(leaders, block), texts, similarity, size)
        fruitless = not links.limit(1).count()
        if not fruitless:
            roots = components(roots.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(links))
        if last:
            break

    whole = Window.partitionBy("root")
    known = nodes.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "rep", "copies")
    known = known.select("key", F.min("rep").over(whole).alias("first"), F.sum("copies").over(whole).alias("class_size")).filter("class_size > 1")
    out = signed.select("id", "mark", "key").join(known, "key", "left")
    alone = F.col("class_size").isNull()
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    return out.select(
        "id", "mark", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), (alone | first).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per class of :func:`near_classes`, with all columns of ``docs``, whatever their names.

    Null and empty texts are one class, of which the smallest id stays (a null id only if there is no other); of rows
    repeated with the same id and text one stays; an empty table stays empty.
    """
    marked = staged(near_classes(docs, id_col=id_col, text_col=text_col, **how), "near-marked")
    names = {c: fresh(docs, f"__{c}") for c in ("id", "mark", "kept", "own")}
    verdict = marked.filter("class_size > 1").groupBy("id", "mark").agg(F.first("kept").alias(names["kept"]), F.count(F.lit(1)).alias("n"))
    verdict = verdict.withColumnsRenamed({"id": names["id"], "mark": names["mark"]})
    own = docs.withColumn(names["own"], F.xxhash64(text_of(text_col)))
    on = (F.col(names["own"]) == F.col(names["mark"])) & F.col(id_col).cast("long").eqNullSafe(F.col(names["id"]))
    gone = verdict.filter(~F.col(names["kept"])).drop("n", names["kept"])
    stay = own.join(gone, on, "left_anti")
    twice = staged(verdict.filter(F.col(names["kept"]) & (F.col("n") > 1)).select(names["id"], names["mark"]), "near-twice")
    if twice.limit(1).count():  # rows repeated with the same id and text: one of them
        again = stay.join(twice, on, "left_semi").dropDuplicates([id_col, names["own"]])
        stay = stay.join(twice, on, "left_anti").unionByName(again)
    return stay.select(*docs.columns)

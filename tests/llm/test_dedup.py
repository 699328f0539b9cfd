import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialframe.llm import exact_dedup, line_dedup, near_dedup, suffix_dedup

from . import helpers as H


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(H.awkward_rows(), H.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.SCHEMA)


# ---- exact -----------------------------------------------------------------------------------
def test_exact_matches_brute_force(rows):
    groups = defaultdict(list)
    for r in H.awkward_rows():
        groups[H.bare(r[1])].append(r)
    got = exact_dedup.mark_exact(rows).collect()
    assert len(got) == len(H.awkward_rows())
    kept = Counter(r.text_sha256 for r in got if r.kept)
    want = {hashlib.sha256(b.encode()).hexdigest(): g for b, g in groups.items()}
    assert kept == Counter(want.keys())
    for r in got:
        g = want[r.text_sha256]
        best = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0]))
        assert (r.keep_id, r.group_size) == (best[0], len(g))


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_tree_merge_of_many_runs(spark, fan_in):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(100)], "doc_id long, text string").repartition(40)
    small = exact_dedup.staged(exact_dedup.digests(docs), "t")
    got = exact_dedup.tree_merge(small, exact_dedup._order(), fan_in).collect()
    assert sorted((r.best.id, r.n) for r in got) == [(i, 15 if i < 2 else 14) for i in range(7)]


def test_drop_exact_keeps_one_row_of_each_group(rows, empty):
    out = exact_dedup.drop_exact(rows)
    assert out.columns == rows.columns
    got = Counter(H.bare(r.text) for r in out.collect())
    assert got == Counter({H.bare(r[1]): 1 for r in H.awkward_rows()})
    assert exact_dedup.drop_exact(empty).count() == 0 and exact_dedup.mark_exact(empty).count() == 0


# ---- lines -----------------------------------------------------------------------------------
def _key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    return k if len(k) >= 10 else None


def _lines(docs):
    """{id: kept lines} by brute force; ids unique, None last."""
    order = lambda d: (d is None, d)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[_key(line)].add(d)
    out = []
    for d, t in docs:
        out.append((d, [x for x in (t or "").split("\n") if _key(x) is None or len(holders[_key(x)]) < 2 or min(holders[_key(x)], key=order) == d]))
    return out


def _shown(index, docs):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(docs, index).collect()))


def test_lines_match_brute_force(spark, rows, empty):
    docs = [(r[0], r[1]) for r in H.awkward_rows()]
    got = _shown(line_dedup.LineIndex.empty(spark).insert(rows), rows)
    want = [(d is None, d or 0, "\n".join(k), len((t or "").split("\n")), len((t or "").split("\n")) - len(k)) for (d, k), (_, t) in zip(_lines(docs), docs, strict=True)]
    assert got == sorted(want)
    index = line_dedup.LineIndex.empty(spark).insert(empty)
    assert line_dedup.drop_lines(empty, index).count() == 0


def test_insertion_in_parts_and_deletion_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    rng = random.Random(1)
    pool = [H.sentence(rng, 6) for _ in range(60)]
    data = [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in range(40)]
    frame = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    state = lambda i: sorted((bytes(r.key), r.refs, r.lo, r.hi) for r in i.refs.collect())
    first = line_dedup.LineIndex.empty(spark).insert(frame(data[:25]))
    both = first.insert(frame(data[25:]))
    once = line_dedup.LineIndex.empty(spark).insert(frame(data))
    assert state(both) == state(once)
    back = both.delete(frame(data[25:]))
    assert state(back) == state(first)
    # the first holder of a line goes: the next one keeps it
    rest = once.delete(frame(data[:5]))
    left = frame(data[5:])
    assert {(r.doc_id, r.text) for r in line_dedup.drop_lines(left, rest).collect()} == {(d, "\n".join(k)) for d, k in _lines(data[5:])}
    for index in (both, back, rest):  # the filters hold every key of their shard
        keys = defaultdict(list)
        for r in index.refs.select("key", index._shard().alias("s")).collect():
            keys[r.s].append(bytes(r.key))
        filters = {r.shard: line_dedup.CuckooFilter.load(r.slots) for r in index.filters.collect()}
        assert all(filters[s].contains(line_dedup.hashes(k)).all() for s, k in keys.items())
    unknown = back.delete(frame([(999, "x")]))
    assert state(unknown) == state(back)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    made = line_dedup.build_filter(h)
    assert made.contains(h).all()
    other = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    assert made.contains(other).mean() < 0.002
    again = line_dedup.CuckooFilter.load(made.dump())
    again.delete(h[:25_000])
    assert again.contains(h[25_000:]).all() and again.contains(h[:25_000]).mean() < 0.01
    twice = line_dedup.CuckooFilter(4)
    assert twice.insert(np.asarray([h[0], h[0]]))
    twice.delete(h[:1])
    assert twice.contains(h[:1]).all()


# ---- near ------------------------------------------------------------------------------------
def test_signatures_are_unbiased_for_multisets():
    rng = np.random.default_rng(2)
    gaps = []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        a = (keys[:33], rng.integers(1, 30, 33))
        b = (keys[3:36], np.concatenate([a[1][3:] + rng.integers(0, 5, 30), [1, 2, 3]]))
        s = near_dedup.bag_min_hash([a, b], 400)
        _, i, j = np.intersect1d(a[0], b[0], return_indices=True)
        shared = np.minimum(a[1][i], b[1][j]).sum()
        gaps.append((s[0] == s[1]).mean() - shared / (a[1].sum() + b[1].sum() - shared))
    assert abs(np.mean(gaps)) < 0.012  # three standard errors


def test_near_classes_match_all_pairs(rows, empty):
    data = H.awkward_rows()
    group = H.near_groups([r[1] for r in data])
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(data[i])
    got = near_dedup.near_classes(rows).collect()
    want = Counter()
    for g in members.values():
        first = min((r[0] for r in g if r[0] is not None), default=None)
        want.update((r[0], first, len(g)) for r in g)
    assert Counter((r.id, r.class_id, r.class_size) for r in got) == want
    out = near_dedup.drop_near(rows)
    assert out.columns == rows.columns and out.count() == len(members)
    assert near_dedup.near_classes(empty).count() == 0 and near_dedup.drop_near(empty).count() == 0


def _drifting(rng, n, length=60):
    """Texts of which each is near the one before, the ends far apart."""
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        out.append(" ".join(w))
        w = list(w)
        w[(7 * i) % length] = f"w{rng.randint(0, 10**6)}"
    return out


def test_near_classes_of_chains_and_shared_passages(spark):
    rng = random.Random(4)
    texts = _drifting(rng, 40) + _drifting(rng, 10, 30) + [H.sentence(rng, 40) for _ in range(10)]
    common = " ".join(f"c{i}" for i in range(30))
    texts += [f"{common} {H.sentence(rng, 22)}" for _ in range(30)]
    # edited copies of one text, most of which are too far from each other
    base = H.sentence(rng, 80).split(" ")
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(enumerate(H.near_groups(texts)))
    assert sorted((r.id, r.class_id) for r in near_dedup.near_classes(docs).collect()) == want


def test_near_classes_link_texts_that_are_central_nowhere(spark):
    """Two near texts whose one bucket holds more central texts (by key, as all share that bucket), near to none."""
    rng = random.Random(0)
    base = H.sentence(rng, 62).split(" ")
    texts = [" ".join(base + [f"e{rng.randint(0, 10**6)}" for _ in range(7 if i < 2 else 20)]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(enumerate(H.near_groups(texts)))
    assert want == [(0, 0), (1, 0), *((i, i) for i in range(2, 12))]
    for block in (150, near_dedup.BLOCK):
        got = near_dedup.near_classes(docs, bands=1, rows=1, block=block).collect()
        assert sorted((r.id, r.class_id) for r in got) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r.key[0]: r.root[0] for r in near_dedup.components(df).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# ---- byte strings ----------------------------------------------------------------------------
def _repeats(docs):
    """docs in their order; every byte covered by a 100-byte string seen before."""
    seen, out = set(), []
    for d, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, c in enumerate(gone) if c and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, bytes(x for x, c in zip(b, gone, strict=True) if not c)))
    return out


def _removed(docs):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())


@pytest.mark.parametrize("chunk, wide", [(1 << 21, 64), (1000, 64), (700, 2)])
def test_repeats_match_brute_force(spark, monkeypatch, chunk, wide):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "LOCAL_CONTEXTS", wide)
    rng = random.Random(chunk)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, docs = [noise(rng.randint(50, 700)) for _ in range(6)], []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            s = rng.randint(0, len(b) - 1)
            parts.append(rng.choice([noise(rng.randint(0, 150)), b[s : s + rng.randint(50, 260)], b, "ab" * rng.randint(0, 120), "é" * rng.randint(0, 130)]))
        docs.append((i, "".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert _removed(df) == _repeats(docs)


def test_repeats_of_awkward_rows(spark, rows, empty):
    df = spark.createDataFrame(H.unique_rows(), H.SCHEMA).repartition(4)
    assert _removed(df) == _repeats([(r[0], r[1]) for r in H.unique_rows()])
    got = suffix_dedup.remove_repeats(rows).collect()  # repeated ids: rows with the same id and text are one document
    assert len(got) == len(H.awkward_rows())
    sevens = [r for r in got if r.doc_id == 7]
    assert len(sevens) == 3 and len({(r.n_removed, bytes(r.kept)) for r in sevens}) == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_buckets_of_one_class_leave_the_rounds(spark):
    rows = [(1, b"a", 9, 3, b"a"), (1, b"b", 9, 3, b"b"), (2, b"b", 9, 3, b"b"), (2, b"c", 8, 1, b"c")]
    members = spark.createDataFrame(rows, "bucket long, key binary, total long, degree long, root binary")
    roots = spark.createDataFrame([(b"a", b"a"), (b"b", b"a"), (b"c", b"c")], "key binary, root binary")
    left = {(r.bucket, bytes(r.key), bytes(r.root)) for r in near_dedup._standing(members, roots).collect()}
    assert left == {(2, b"b", b"a"), (2, b"c", b"c")}


def test_texts_move_once_and_rounds_are_few(spark, monkeypatch):
    """Documents are read for their signatures and once for the texts that share a bucket, however many blocks meet."""
    rng, names, staged = random.Random(9), [], near_dedup.staged
    texts = _drifting(rng, 40) + _drifting(rng, 10, 30) + [H.sentence(rng, 40) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(enumerate(H.near_groups(texts)))
    monkeypatch.setattr(near_dedup, "staged", lambda df, name="stage": names.append(name) or staged(df, name))
    for block, meeting in ((near_dedup.BLOCK, 16), (300, 10**6), (300, 0)):  # one block; blocks that meet at once; leaders first
        monkeypatch.setattr(near_dedup, "MEETING", meeting)
        names.clear()
        assert sorted((r.id, r.class_id) for r in near_dedup.near_classes(docs, block=block).collect()) == want
        assert names.count("near-texts") == 1
        assert block < near_dedup.BLOCK or names.count("near-links") == 1


def test_classes_of_a_block_match_all_pairs():
    rng = random.Random(6)
    texts = _drifting(rng, 12) + _drifting(rng, 5, 40) + [H.sentence(rng, 30) for _ in range(5)]
    rng.shuffle(texts)
    shingler = near_dedup.Shingler()
    bags = [shingler.bag(shingler.words(t)) for t in texts]
    want = H.near_groups(texts)
    for degrees in ([1] * len(texts), list(range(len(texts)))):
        low = dict(near_dedup._together([bytes([i]) for i in range(len(texts))], degrees, bags, near_dedup.SIMILARITY))
        assert [low.get(bytes([i]), bytes([i]))[0] for i in range(len(texts))] == want


def plain_signature(hashes, counts, m):
    """One point after the other, in order of a process' time."""
    first, ident = [math.inf] * m, [0] * m
    for h, count in zip(hashes, counts, strict=True):
        k, low, rate = 0, 0, 1
        while low < count:
            key = near_dedup.mix(h + near_dedup._gold(k + 1))
            time, step = 0.0, 0
            while time < max(first):
                step += 1
                draw = near_dedup.mix(key + near_dedup._gold(2 * step))
                place = int(near_dedup.mix(draw + near_dedup._gold(1)))
                time = time - np.log(float(int(draw) >> 11) * 2.0**-53 + 2.0**-54) / rate
                if low + 1 + math.floor((place >> 32) * 2.0**-32 * rate) <= count and time < first[(place & 0xFFFFFFFF) % m]:
                    first[(place & 0xFFFFFFFF) % m], ident[(place & 0xFFFFFFFF) % m] = time, int(draw)
            k, low, rate = k + 1, max(1, 2 * low), max(1, low * 2) if low else 1
    return ident


def test_a_round_draws_many_points_of_few_processes(monkeypatch):
    shingler = near_dedup.Shingler()
    bags = [shingler.bag(t.encode().split()) for t in ("alone", "a b c d e f", "word " * 40, "x y " * 9 + "z")]
    with np.errstate(over="ignore"):
        expected = [plain_signature(*b, 160) for b in bags]
    rounds, mix = [], near_dedup.mix
    monkeypatch.setattr(near_dedup, "mix", lambda x: rounds.append(0) or mix(x))
    assert near_dedup.bag_min_hash(bags, 160).tolist() == expected
    assert len(rounds) < 100  # a bag of one shingle draws 900 points and more


def test_words_are_hashed_without_a_table():
    shingler = near_dedup.Shingler()
    hashes, counts = shingler.bag([b"%d" % i for i in range(1000)])
    assert len(hashes) == 996 and counts.sum() == 996
    assert not [v for v in vars(shingler).values() if isinstance(v, dict)]

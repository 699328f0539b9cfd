"""Spelling variants, ranked search and byte-level BPE against plain versions on small tables."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from trialframe.llm import bpe, lexical, spelling
from trialframe.llm.queries import byte_ranks

from . import helpers as H


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(H.awkward_rows(), H.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.SCHEMA)


# ---- spelling variants -------------------------------------------------------------------------
def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _word_counts(docs, every):
    n = Counter()
    for doc, text in docs:
        for run in map(_lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if every and h % every == 0 else run] += 1
    return n


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(n, min_ratio=2):
    near = {w: [v for v in n if v != w and _one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= min_ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_neighbours_of_short_words(spark):
    """All words of up to four letters out of two: runs of equal letters, indels at both ends, many ties."""
    rng = random.Random(1)
    words = [w for k in range(1, 5) for w in map("".join, product("ab", repeat=k))] + ["abé", "aé", "é", "ééé"]
    n = {w: rng.randint(1, 4) for w in words}
    got = {r.word: (r.n_near, r.best.n, r.best.word) for r in spelling.neighbours(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)).collect()}
    want = {}
    for w in n:
        near = [v for v in n if v != w and _one_edit(v, w)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), n[best], best)
    assert got == want


@pytest.mark.parametrize("every", [None, 5, 97])
def test_variants_one_by_one(spark, every):
    rng = random.Random(2)
    stems = ["Ambers", "ambers", "birches", "CEDARS", "éclairs", "Éclairs", "aabbcc", "abc"]
    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abxé") + w[i:], w[:i] + rng.choice("aeé") + w[i + 1 :]])
    docs = [(i if i % 9 else None, " ".join(typo(rng.choice(stems)) + rng.choice(["", ",", "7", "_"]) for _ in range(60))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "12 \n"), docs[3], docs[3]]
    n = {w: c for w, c in _word_counts(docs, every).items() if len(w) >= 5 and c >= 3}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in spelling.variants(df, every).collect()} == _variants(n)


def test_variants_of_awkward_rows(rows, empty):
    docs = [(r[0], r[1]) for r in H.awkward_rows()]
    n = {w: c for w, c in _word_counts(docs, 97).items() if len(w) >= 5 and c >= 3}
    got = spelling.variants(rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and {tuple(r) for r in got.collect()} == _variants(n)
    assert spelling.variants(empty).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(300)] + [("x", "y")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string").repartition(3)).collect()))
    assert got == {f"w{i:03d}": "w300" for i in range(300)} | {"x": "y"}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), min_ratio=1)


# ---- ranked search -----------------------------------------------------------------------------
def _terms(text):
    return _lower_terms(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or ""))


def _lower_terms(terms):
    return [_lower(t) for t in terms]


def _search(docs, items, top):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, size = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * k + 1))) for t, k in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(_terms(t))
    out = Counter()
    for i, terms in wanted.items():
        found = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * total) // size
            score = sum(weight[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in terms & b.keys())
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(found)[:top], 1):
            out[(i, rank, d, -score)] += 1
    return out


def _got(docs, items, **how):
    return Counter(map(tuple, lexical.search(docs, items, **how).collect()))


@pytest.mark.parametrize("top, block_terms", [(3, 500_000), (50, 500_000), (7, 9)])
def test_search_one_by_one(spark, top, block_terms):
    """Many equal bags and equal scores, items in one block and in several."""
    rng = random.Random(4)
    vocabulary = "ant bee cow dog EEL fox gnu 7 été".split()
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "--"), (None, "ant bee"), (5, docs[5][1]), (6, "Ant-bee\x00cow"), (500, "ant " * 40_000)]
    items = [(f"i{k}", " ".join(rng.sample(vocabulary, rng.randint(1, 6)))) for k in range(12)] + [("i3", "fox ANT"), ("none", None), ("absent", "zebra"), (None, "gnu")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert _got(frame, spark.createDataFrame(items, "item_id string, text string"), top=top, block_terms=block_terms) == _search(docs, items, top)


def test_search_of_awkward_rows(spark, rows, empty, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 50)
    docs = [(r[0], r[1]) for r in H.awkward_rows()]
    items = [(i, t) for i, t in enumerate(H.awkward_texts()[::3])]
    wanted = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    assert _got(rows, wanted, top=5) == _search(docs, items, 5)
    assert lexical.search(rows, wanted.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(rows, wanted.limit(0)).count() == 0 and lexical.search(empty, wanted).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 7)
    text = "alpha beta-gamma é" * 9
    assert [t.decode() for part in lexical.terms_of(text) for t in part] == _terms(text)


# ---- byte-level BPE ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def ranks():
    return byte_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("test", pat_str=ranks.pattern, mergeable_ranks=ranks.ids, special_tokens={})


ODD = [
    "I'm we'll 12 345\n\n  x \t y z", "日本語のテキスト 🤖🤖 ẞß ŉ", "<|endoftext|> a<|im_start|>", "a" * 700, "ab" * 300 + "!" * 40, "\x00\x01\x7f\x85 ", "ไทย עברית العربية हिन्दी", "\U0001e5d0 \U00010d4a",
    "x" + "́" * 30, "   ", " \n \n", "don't DON'T ’s", "½ ² Ⅷ ٣", "e" * 5 + " " * 50 + "f",
]


@pytest.mark.parametrize("cache_words", [0, 40, 1 << 18])
def test_ids_are_those_of_the_library(spark, ranks, reference, cache_words):
    rng = random.Random(6)
    pool = [chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x370, 0x5FF), rng.randint(0x4E00, 0x4FFF), rng.randint(0x1F600, 0x1F64F)])) for _ in range(200)]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(60)] + H.awkward_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = bpe.encode(docs, ranks, cache_words=cache_words).select("doc_id", "ids", ranks.decode(F.col("ids")).alias("back"))
    got = {r.doc_id: (r.ids, bytes(r.back)) for r in out.collect()}
    assert got == {i: (reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}


def test_encoding_of_awkward_rows(rows, empty, ranks, reference):
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(rows, ranks).collect())
    assert got == Counter((r[0], tuple(reference.encode_ordinary(r[1] or ""))) for r in H.awkward_rows())
    assert bpe.encode(empty, ranks).columns == ["doc_id", "ids"] and bpe.encode(empty, ranks).count() == 0


def test_ranks_must_cover_all_bytes(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.Ranks.read(str(tmp_path / "few"), "a")


def test_a_merge_rebuilds_one_array(ranks):
    folded = str(ranks.fold(F.array("word")))
    assert folded.count("slice(") <= 3  # the state's two sides and the answer; ranks and parts are no arrays of their own


def test_a_merge_cuts_no_slices(ranks):
    folded = str(ranks.fold(F.array("word")))
    assert folded.count("slice(") == 1 and "array_position(" not in folded  # the answer's; a merge removes and inserts parts


def test_latin_texts_are_split_alike(ranks):
    rng = random.Random(8)
    quick, whole = bpe.latin_pattern(ranks.pattern), regex.compile(ranks.pattern)
    for pool in ([chr(c) for c in range(256)], list(" a'stéL1\n\t\x85\x1c\xa0½²ª!")):
        for text in ("".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(2000)):
            assert quick.findall(text) == whole.findall(text)
    assert bpe.splitter(ranks.pattern)("é日本 ½") == ["é日本", " ½"]
    assert all(bpe.latin_pattern(p) is None for p in (r"\w+", r"[\S]", r"(?i)a", r"[a--b]", r"(?:ab){e<=1}"))  # left to the whole engine


def test_remembered_words_are_no_pieces(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 8), ("c日", 8), ("d", 8), ("e", 1), ("f", 9)], "word string, n long").repartition(3)
    got = bpe.most_frequent(counts, 3, frozenset(["a", "d", "x"])).collect()
    assert [(r.word, r.n) for r in got] == [("f", 9), ("b", 8), ("c日", 8)]


def test_equal_ranks_merge_the_first_pair(spark):
    ids = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaa": 260, b"xabc": 261}
    texts = ["a" * k for k in range(1, 9)] + ["abcabc", "aabcc", "xabcabca", "baabaaabc", "é" * 3 + "aaabc"]

    def plain(word):
        parts = [bytes([b]) for b in word.encode()]
        while pairs := [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ids[p] for p in parts]

    rows = spark.createDataFrame([(t,) for t in texts], "word string")
    got = {r.word: r.ids for r in rows.select("word", bpe.Ranks(ids, r"\w+").fold(F.array("word"))[0].alias("ids")).collect()}
    assert got == {t: plain(t) for t in texts}

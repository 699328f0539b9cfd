import base64
import bz2
import gzip
import lzma
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import chat, licenses, mixing, packing, quality, secret_scan
from trialframe.llm.queries import vocabulary

from . import helpers as H


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(H.awkward_rows(), H.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.SCHEMA)


# ---- mixing ----------------------------------------------------------------------------------
def _sources(spark, n=600):
    rng = random.Random(5)
    pick = lambda i: "big" if i % 3 else rng.choice(["a", "b", "c", "d", None])
    return spark.createDataFrame([(i, H.sentence(rng, rng.randint(0, 60)), pick(i)) for i in range(n)], "doc_id long, text string, source string").repartition(6)


def _weights(totals, exponent):
    z = sum((t / sum(totals.values())) ** exponent for t in totals.values())
    return {s: (t / sum(totals.values())) ** exponent / z for s, t in totals.items()}


def _entropy(weights):
    return -sum(w * math.log(w) for w in weights.values())


@pytest.mark.parametrize("target, repeats", [(0.97, None), (None, 1.3), (0.99, 1.4), (None, None)])
def test_exponent_meets_target_and_limit(spark, target, repeats):
    docs = _sources(spark)
    rows = mixing._rows(docs, "doc_id", "text", "source", None).cache()
    totals = Counter()
    for r in rows.collect():
        totals[r.source] += r.cost
    plan = mixing.plan_mixture(rows, target, repeats)
    weights = _weights(totals, plan.exponent)
    for r in plan.sources.collect():
        assert r.weight == pytest.approx(weights[r.source], rel=1e-9) and abs(r.budget - r.weight * plan.budget) <= 1
    if target is None and repeats is None:
        assert plan.exponent == 1.0
    looser = _weights(totals, plan.exponent - 1e-4)
    most = lambda w: max(w[s] * plan.budget / totals[s] for s in totals)
    limit, goal = repeats or math.inf, (target or 1) * math.log(len(totals))
    assert most(weights) <= limit * (1 + 1e-6) and _entropy(weights) <= goal + 1e-6
    if plan.exponent not in (0.0, 1.0):  # it is the smallest exponent that does
        assert most(looser) > limit or _entropy(looser) > goal


def test_applied_mixture_is_in_blocks(spark):
    """Every stretch of the mixed table holds the sources at their weights, whatever the order of the input."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string"), F.lit("x y z")).alias("text"),
        F.when(F.col("id") < 16_000, "big").when(F.col("id") < 19_000, "middle").otherwise("small").alias("source"))
    got = [r.source for r in mixing.apply_mixture(docs, None, 1.5, "cover", block_tokens=5_000).select("source").collect()]
    share = {s: n / len(got) for s, n in Counter(got).items()}
    assert share["small"] > 0.055 and len(got) > 20_000
    for at in range(0, len(got) - 2_000, 2_000):
        part = Counter(got[at : at + 2_000])
        for s, p in share.items():
            assert abs(part[s] / 2_000 - p) < 5 * math.sqrt(p * (1 - p) / 2_000), (at, s)


def test_mixture_is_made_of_whole_permuted_epochs(spark):
    docs = _sources(spark)
    rows = mixing._rows(docs, "doc_id", "text", "source", None).cache()
    plan = {r.source: r for r in mixing.plan_mixture(rows, 0.99, 4.0, 30_000).sources.collect()}
    cost = {r.doc_id: r.cost for r in rows.collect()}
    of = defaultdict(set)
    for r in rows.collect():
        of[r.source].add(r.doc_id)
    got = mixing.mix_sources(docs, 0.99, 4.0, 30_000, block_tokens=3000).collect()
    used = defaultdict(lambda: defaultdict(list))
    for r in got:
        used[r.source][r.epoch].append(r.doc_id)
    for s, p in plan.items():
        for e in range(p.full):
            assert sorted(used[s][e]) == sorted(of[s])
        partial = used[s].get(p.full, [])
        assert len(partial) == len(set(partial)) and set(used[s]) <= set(range(p.full + 1))
        spent = sum(cost[d] for d in partial)
        assert p.rest - max(cost.values()) <= spent <= p.rest
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r.block][r.source] += cost[r.doc_id]
    assert sorted(blocks) == list(range(10))
    for b in list(blocks)[:-1]:
        for s, p in plan.items():
            assert abs(blocks[b][s] - p.budget / 10) <= 2 * max(cost.values())
    applied = mixing.apply_mixture(docs, 0.99, 4.0, 30_000)
    assert applied.columns == docs.columns
    assert Counter(r.doc_id for r in applied.collect()) == Counter(r.doc_id for r in got)


def test_cover_uses_every_document(spark, rows, empty):
    docs = _sources(spark)
    times = Counter(r.doc_id for r in mixing.apply_mixture(docs, None, 1.5, "cover").collect())
    assert set(times) == set(range(600)) and max(times.values()) == 2
    again = mixing.apply_mixture(rows, None, 1.5, "cover")
    assert again.columns == rows.columns and {r.doc_id for r in again.collect()} == {r[0] for r in H.awkward_rows()}
    assert mixing.apply_mixture(empty).count() == 0 and mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(rows).count() == mixing.apply_mixture(rows).count()


SECRET = "password=hunter2secret99"


def _packed(data):
    return base64.b64encode(gzip.compress(data, mtime=0)).decode()


def _tar(text):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        entry = tarfile.TarInfo("a.txt")
        entry.size = len(text)
        t.addfile(entry, io.BytesIO(text))
    return out.getvalue()


@pytest.mark.parametrize(
    "inside",
    [SECRET.encode(), b"a\x00b " + SECRET.encode(), b"\x1b[1m" + SECRET.encode(), b"caf\xe9 " + SECRET.encode(), _tar(SECRET.encode()), SECRET.encode("utf-16"),
     SECRET.encode("utf-16-be"), gzip.compress(b"\x00" + SECRET.encode()), b"\xff\x00" * 50 + SECRET.encode() + b"\x01" * 9],
)
def test_streams_show_their_secrets_whatever_lies_beside(inside):
    blob = _packed(inside)
    spans, _ = secret_scan.scan(f"x {blob} y")
    assert (2, "assign") in {(a, k) for a, k, _, _ in spans} and all(b <= 2 + len(blob) for _, _, b, _ in spans)


def test_wide_text_in_base64():
    for codec in ("utf-16", "utf-16-le", "utf-16-be"):
        spans, _ = secret_scan.scan(base64.b64encode(SECRET.encode(codec)).decode())
        assert [k for _, k, _, _ in spans] == ["assign"]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_long_streams_are_read_in_windows(pack):
    """Secrets at the start, the end and over every edge of the windows of a stream far above the limit."""
    rng = random.Random(1)
    for at in (0, 900, 990, 999, 1000, 1500, 30_000 - len(SECRET)):
        body = bytearray(rng.choice(b"abc ,.") for _ in range(30_000))
        body[at : at + len(SECRET)] = SECRET.encode()
        if at:
            body[at - 1 : at] = b" "
        spans, n = secret_scan.scan(base64.b64encode(pack(bytes(body))).decode(), limit=1000)
        assert n >= 1 and [k for _, k, _, _ in spans] == ["assign"], at
    inner = _packed(b"\x00" + SECRET.encode()).encode()
    spans, n = secret_scan.scan(base64.b64encode(pack(b"." * 5000 + b" " + inner + b" " + b"," * 5000)).decode(), limit=1000)
    assert n >= 1 and [k for _, k, _, _ in spans] == ["assign"]


# ---- packing ---------------------------------------------------------------------------------
@pytest.mark.parametrize("length, windows", [(64, 2), (256, 8), (4096, 32)])
def test_packing_is_an_exact_round_trip(rows, length, windows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    got = packing.pack(rows, vocabulary(), seq_len=length, open_windows=windows, min_cut=8).collect()
    want = Counter((r[0], tuple([*model.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in H.awkward_rows())
    ids = {id(r): struct.unpack(f"<{r.length}I", r.ids) for r in got}
    for doc in {r[0] for r in H.awkward_rows()}:
        if sum(r[0] == doc for r in H.awkward_rows()) == 1:
            parts = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
            assert want[doc, tuple(x for r in parts for x in ids[id(r)])] == 1
            assert [r.start for r in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(q.length for q in s[:i]) for i in range(len(s))] and sum(r.length for r in s) <= length
    assert packing.pack(rows.limit(0), vocabulary()).count() == 0


def test_windows_stay_bounded_and_emit_the_fullest():
    rng = random.Random(2)
    w, placed = packing.Windows(100, 4, 0), Counter()
    for _ in range(2000):
        n = rng.randint(1, 230)
        for window, offset, length in w.place(n, 8):
            assert placed[window] == offset
            placed[window] += length
        assert len(w.used) <= 4 and all(placed[k] == u for k, u in w.used.items())
    closed = [placed[k] for k in w.closed]
    assert max(closed) == 100 and min(closed) > 92


def test_leftovers_are_merged_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = defaultdict(list)
    for i, (b, at) in enumerate(packing.best_fit_bins(sizes, 100)):
        bins[b].append((at, sizes[i]))
    for b in bins.values():
        b.sort()
        assert all(at == sum(n for _, n in b[:i]) for i, (at, _) in enumerate(b)) and sum(n for _, n in b) <= 100
    assert len(bins) <= math.ceil(sum(sizes) / 100) * 1.02 + 1


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(vocabulary()), packing.Tokenizer(vocabulary())
    rng = random.Random(9)
    for letters in ("abcXYZ019 '\n\t\r.,!?-_#s'tll'reÀÉßÿÖø–—‘’“”…", "abZ9 \n'<|>é́ºµ×\x0b\x1c\x85\xa0İΣς漢字٣½​\U0001F600ﬁ"):
        for _ in range(1500):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
            if rng.random() < 0.1:
                text += rng.choice(["<|endoftext|>", " <|startoftext|>x", "don't'd"]) + text
            assert own.ids(text).tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


# ---- secrets ---------------------------------------------------------------------------------
def _base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return set(out) | {(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24}


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(8)
    bits = ["password", "PASSWD", "token=", "api_key", "apikey:", " = ", '"', "abcdef", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "ſecret=abcdefg", "\n", "=", "secret"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert {(a, k, b) for a, k, b, d in secret_scan.scan(text)[0] if d == 0} >= _base(text)
        assert set(secret_scan.base_spans(text)) == _base(text)


@pytest.mark.parametrize("depth", range(1, 5))
def test_nested_layers_are_unwrapped_and_mapped(depth):
    rng = random.Random(depth)
    secret = "token=Q1w2E3r4T5y6U7i8"
    wraps = {
        "url": lambda s: "".join(f"%{b:02X}" for b in s.encode()), "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        "html": lambda s: "".join(f"&#x{ord(c):x};" for c in s), "base64": lambda s: base64.b64encode(s.encode()).decode(),
        "urlsafe": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="), "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    }
    for _ in range(40):
        inner = secret
        for _ in range(depth):
            inner = wraps[rng.choice(list(wraps))](inner)
        before = "some prose "
        found, _ = secret_scan.scan(f"{before}{inner} and more")
        hits = [(a, b) for a, k, b, d in found if k == "assign" and d == depth]
        assert hits and all(len(before) <= a < b <= len(before) + len(inner) for a, b in hits), inner


def test_mapping_is_exact_for_partly_encoded_text():
    text = "x pass%77ord%3Dabc%64ef9 y"
    assert [(a, b) for a, k, b, _ in secret_scan.scan(text)[0] if k == "assign"] == [(2, text.index(" y"))]
    blob = base64.b64encode(b"prose prose token=abcdefgh prose").decode()
    (a, _, b, d), = secret_scan.scan(blob)[0]
    assert d == 1 and base64.b64decode(blob[a - a % 4 : b + -b % 4]).find(b"token=abcdefgh") >= 0 and b - a < 24


def test_cycles_and_large_streams_end():
    bomb = base64.b64encode(zlib.compress(b"0" * 100_000)).decode()
    assert secret_scan.scan(bomb, limit=1000)[1] == 1
    nested = "%2525252541" * 50 + "&#38;#38;#38;" + "\\u005cu005c" * 20
    secret_scan.scan(nested)


def test_wrapped_joined_and_escaped_streams_are_unwrapped():
    rng = random.Random(3)
    noise = " ".join(str(rng.random()) for _ in range(12))
    secret = "token=Q1w2E3r4T5y6U7i8"
    long = f"{noise} {secret} {noise}".encode()
    wrap = lambda b, n, end: end.join(re.findall(f".{{1,{n}}}", base64.b64encode(b).decode()))
    found = lambda text: [(a, b) for a, k, b, d in secret_scan.scan(text)[0] if k == "assign" and d > 0]
    for n, end in ((76, "\n"), (64, "\r\n"), (60, "\n    ")):
        for data in (long, gzip.compress(long), bz2.compress(long)):
            assert found(f"see\n{wrap(data, n, end)}\nand more"), (n, data[:4])
        a, b = found(wrap(b"x" * 50 + secret.encode() + b" " + b"x" * 50, n, end))[0]
        assert b - a < 40
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        both = pack(noise.encode()) + pack(long)
        assert found(base64.b64encode(both).decode()), pack
        assert found("".join(f"%{x:02X}" for x in both)) and found(repr(both)) and found("".join(f"\\u00{x:02x}" for x in both)), pack
        assert found(quote(both)) and found("".join(f"&#{x};" for x in both)), pack
    for before in ("a", "ab", "abc", "abcd", "data/x/", "https://host/path/of/"):
        assert found(before + base64.b64encode(f"some {secret} here".encode()).decode()), before


def test_scan_of_awkward_rows(rows, empty):
    got = secret_scan.scan_secrets(rows).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in H.awkward_rows())
    text = {r[0]: r[1] or "" for r in H.unique_rows()}
    for r in got:
        if r.id is not None and r.id not in (7, 9):
            assert {(a, k, b) for a, k, b, d in zip(r.starts, r.kinds, r.ends, r.layers, strict=True) if d == 0} == _base(text[r.id])
    assert secret_scan.scan_secrets(empty).count() == 0


# ---- quality ---------------------------------------------------------------------------------
def _rules(text):
    text = text or ""
    w, seen, dup = H.words(text), set(), 0
    for line in text.split("\n"):
        if H.words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if many[x] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": failed}


def test_base_rules_match_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randint(0, 80)
        text = "".join(rng.choice(["a", "b", "c#", "dé"]) + rng.choice([" ", " ", "\n", "\t\x0b", "\x1c ", "\xa0"]) for _ in range(n))
        assert quality.base_rules(text) == _rules(text), repr(text)
    for text in H.awkward_texts():
        assert quality.base_rules(text or "") == _rules(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        x = rng.normal(size=(n, 3))
        field = quality.LineField(tuple(rng.normal(size=3)), tuple(map(tuple, rng.normal(size=(2, 2)))))
        e = x @ np.asarray(field.emit)

        def score(states, e=e, field=field):
            return sum(e[i] for i, s in enumerate(states) if s) + sum(field.step[a][b] for a, b in zip(states, states[1:]))

        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        assert score(field.viterbi(x).astype(int).tolist()) == pytest.approx(max(map(score, paths)))


def test_field_learns_lines_from_document_labels(spark, rows, empty):
    rng = random.Random(11)
    clean = lambda: "\n".join(H.sentence(rng, 12).capitalize() + "." for _ in range(5))
    junk = lambda: "\n".join(" ".join(w.upper() + "!!" for w in H.sentence(rng, 12).split()) for _ in range(5))
    texts = [clean() if i % 4 else junk() for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int")
    field = quality.train_lines(docs, labels, sample_docs=60)
    got = {r.doc_id: r for r in quality.judge(docs, field).collect()}
    assert all(got[i].kept == (i % 4 > 0) for i in range(100, 200))  # held out
    mixed = spark.createDataFrame([(1, clean() + "\n" + junk()), (2, clean() + "\n" + clean() + "\n" + junk()[:60])], "doc_id long, text string")
    share = {r.doc_id: r.content_share for r in quality.judge(mixed, field).collect()}
    assert 0.3 < share[1] < 0.7 and share[2] > 0.85
    kept = quality.keep_good(rows, field)
    judged = quality.judge(rows, field).collect()
    assert kept.columns == rows.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged if r.kept)
    assert len(judged) == len(H.awkward_rows()) and quality.judge(empty, field).count() == 0 and quality.keep_good(empty, field).count() == 0
    one = quality.train_lines(docs, labels.filter("quality = 1"))  # without both labels every line is content
    assert all(r.content_share == 1.0 for r in quality.judge(docs, one).collect())
    assert quality.train_lines(docs, labels.limit(0)) == one


# ---- chat ------------------------------------------------------------------------------------
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi <|im_end|> there"), (1, 3, "cy", None), (1, 3, "cy", None), (1, 4, "ann", ""), (2, None, None, "anon"),
    (2, 1, " ", "blank"), (3, 0, "system", "alone"), (None, 1, "ann", "no id"), (None, 2, "bob", "same dialogue"),
] + [(4, i, "ann" if i % 2 else "bob", f"turn {i}") for i in range(150)]


def _render(turns, size):
    out, by = {}, defaultdict(list)
    for c, t, s, x in turns:
        by[c].append((t is not None, t or 0, (s or "").strip() or "unknown", x or ""))
    for c, ts in by.items():
        ts.sort()
        for who in {s for _, _, s, _ in ts} - {"system"}:
            for b in range(0, len(ts), size):
                text, mask = "", []
                for _, _, s, x in ts[b : b + size]:
                    head = "<|im_start|>" + ("system" if s == "system" else "assistant" if s == who else f"user name={s}") + "\n"
                    body = x.replace("<|im_", "< |im_") + "<|im_end|>"
                    if s == who:
                        mask.append((len(text) + len(head), len(text) + len(head) + len(body)))
                    text += head + body + "\n"
                out[c, who, b // size] = (text, mask, len(ts[b : b + size]))
    return out


@pytest.mark.parametrize("size", [64, 4, 1])
def test_every_speaker_is_the_assistant_once(spark, size):
    df = spark.createDataFrame([(*t, "clash", 1) for t in TURNS], "conv_id long, turn long, role string, text string, perspective string, at int").repartition(4)
    got = {(r.conv_id, r.perspective, r.block): (r.text, [(s.start, s.end) for s in r.mask], r.n_turns) for r in chat.render(chat.rotate(df), size).collect()}
    assert got == _render(TURNS, size)
    assert chat.render(chat.rotate(df.limit(0))).count() == 0


def test_turns_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "running", lambda *a: __import__("trialframe.llm.common", fromlist=["running"]).running(*a, each=20))
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.perspective, r.block): r.text for r in chat.render(chat.rotate(df)).collect()}
    assert got == {k: v[0] for k, v in _render(TURNS, 64).items()}


# ---- licences --------------------------------------------------------------------------------
def test_licences_are_found_and_inherited(spark):
    files = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0"), ("a/x/1.py", "code"), ("a/x/y/2.py", "code"), ("a/x/y/COPYING", "text\nReleased under the MIT License.\nmore"),
        ("a/x/y/z/3.py", "# Licensed under CC BY-NC 4.0."), ("a/x/y/z/4.py", "a " * 200 + "licensed " + "b " * 200), ("b/5.py", None), ("ab/6.py", ""), (None, "nothing"),
        ("a/x/1.py", "code again"), ("c/LICENSE", "no known licence here"), ("c/7.py", ""), ("d/LICENSE.a", "Released under the MIT License"), ("d/LICENSE.b", "Released under the MIT License"),
    ]
    df = spark.createDataFrame([(*f, "clash", 1.0) for f in files], "path string, text string, license string, row double").repartition(3)
    got = defaultdict(list)
    for r in licenses.scan_licenses(df).collect():
        got[r.path].append((r.license, r.how, r.from_dir))
    assert got == {
        "a/LICENSE": [("Apache-2.0", "own", "a")], "a/x/1.py": [("Apache-2.0", "inherited", "a")] * 2, "a/x/y/2.py": [("MIT", "inherited", "a/x/y")], "a/x/y/COPYING": [("MIT", "own", "a/x/y")],
        "a/x/y/z/3.py": [("CC-BY-NC-4.0", "own", "a/x/y/z")], "a/x/y/z/4.py": [("MIT", "inherited", "a/x/y")], "b/5.py": [(None, "none", None)], "ab/6.py": [(None, "none", None)],
        "": [(None, "none", None)], "c/LICENSE": [(None, "none", None)], "c/7.py": [(None, "none", None)], "d/LICENSE.a": [("MIT", "own", "d")], "d/LICENSE.b": [("MIT", "own", "d")],
    }
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    root = spark.createDataFrame([("LICENSE", "Released under the MIT License"), ("a/b/c.py", "x"), ("d.py", "x")], "path string, text string")
    assert {r.license for r in licenses.scan_licenses(root).collect()} == {"MIT"}


def test_every_template_is_its_own_licence(spark):
    df = spark.createDataFrame([(str(i), f"prose\n{t}\nprose") for i, (_, t) in enumerate(licenses.TEMPLATES)], "path string, text string")
    got = {int(r.path): (r.own_license, r.cosine) for r in licenses.scan_licenses(df).collect()}
    assert got == {i: (name, pytest.approx(1.0)) for i, (name, _) in enumerate(licenses.TEMPLATES)}
    assert isinstance(licenses.terms(F.lit("x")), type(F.lit("x")))

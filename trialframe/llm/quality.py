"""Quality rules: word statistics, and a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, slices, text_of

# fixed values of the base rules
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

FEATURES = (
    "bias", "upper", "symbols", "bangs", "digits", "others", "short", "long", "word_repeats", "seen_before", "sentence_end", "wordless",
)
MIN_CONTENT_SHARE = 0.5
SAMPLE_DOCS = 3000
SAMPLE_LINES = 64

_CLASSES = np.zeros((256, 6), dtype=np.float32)
for _i in range(256):
    _c = chr(_i)
    _k = 0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 2 if _c in SYMBOLS else 3 if _c in "!?" else 4 if _c.isdigit() and _i < 128 else 5
    _CLASSES[_i, _k] = 1


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs twice or more in the text."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, dtype=np.int32)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_rules(text: str) -> dict:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the contract's white space
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").strip():
            dup += line in seen
            seen.add(line)
    n_repeat = repeated_words(ids) if len(codes) < len(words) else 0
    return {
        "n_words": len(words), "word_chars": len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r"), "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": dup, "n_repeat_words": n_repeat, "base_failed": len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words),
    }


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The feature matrix of the text's lines (at \\n) and their lengths in bytes."""
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    counts = np.zeros((len(lines), 6), dtype=np.float32)
    if data:
        full = np.flatnonzero(sizes > 0)
        if len(full):
            # one more byte per line (its \n, class 5) falls into the sum; it is taken off again where there is one
            sums = np.add.reduceat(_CLASSES[np.frombuffer(data, dtype=np.uint8)], starts[full], axis=0)
            ends = np.append(starts[full][1:], len(data))
            sums[:, 5] -= ends - starts[full] - sizes[full]
            counts[full] = sums
    n = np.maximum(sizes, 1).astype(np.float32)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    x = np.zeros((len(lines), len(FEATURES)), dtype=np.float32)
    x[:, 0] = 1
    x[:, 1] = counts[:, 0] / letters
    x[:, 2] = np.minimum(counts[:, 2] / n * 5, 1)
    x[:, 3] = np.minimum(counts[:, 3] / n * 5, 1)
    x[:, 4] = counts[:, 4] / n
    x[:, 5] = counts[:, 5] / n
    x[:, 6] = sizes < 30
    x[:, 7] = sizes > 120
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        if not words:
            x[i, 11] = 1
            continue
        x[i, 8] = 1 - len(set(words)) / len(words)
        x[i, 9] = line in seen
        x[i, 10] = words[-1][-1:] in b".!?:;\""
        seen.add(line)
    return x, sizes


@dataclass(frozen=True)
class LineField:
    """Weights of a two-state linear chain: state 1 is content, state 0 boilerplate."""

    emit: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        score = (x @ np.asarray(self.emit, dtype=np.float64)).tolist()
        (t00, t01), (t10, t11) = self.step
        a, b, back = 0.0, score[0], []
        for s in score[1:]:
            from_b0, from_b1 = b + t10 > a + t00, b + t11 >= a + t01
            back.append((from_b0, from_b1))
            a, b = (b + t10 if from_b0 else a + t00), (b + t11 if from_b1 else a + t01) + s
        state = b >= a
        states = [state]
        for from_b0, from_b1 in reversed(back):
            state = from_b1 if state else from_b0
            states.append(state)
        return np.asarray(states[::-1], dtype=bool)


def fit_lines(xs: list[np.ndarray], ys: list[int], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """Maximum conditional likelihood by gradient ascent (Adam); every line carries the label of its document.

    All sequences advance together, one line at a time. Without both labels the field calls every line content.
    """
    if len(set(ys)) < 2:
        return LineField((1.0, *[0.0] * (len(FEATURES) - 1)), ((0.0, 0.0), (0.0, 0.0)))
    longest, n, k = max(map(len, xs)), len(xs), xs[0].shape[1]
    x, mask = np.zeros((n, longest, k)), np.zeros((n, longest), dtype=bool)
    for i, m in enumerate(xs):
        x[i, : len(m)], mask[i, : len(m)] = m, True
    y = np.asarray(ys)
    # both labels weigh the same
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / np.maximum(1, mask.sum(1))
    w, t = np.zeros(k), np.zeros((2, 2))
    m1, m2 = np.zeros(k + 4), np.zeros(k + 4)
    for r in range(1, rounds + 1):
        e = np.stack([np.zeros((n, longest)), x @ w], axis=2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for j in range(1, longest):
            go = np.logaddexp(alpha[:, j - 1, 0, None] + t[0], alpha[:, j - 1, 1, None] + t[1]) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], go, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            ahead = e[:, j + 1] + beta[:, j + 1]
            go = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
            beta[:, j] = np.where(mask[:, j + 1, None], go, 0)
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None]) * mask
        grad_w = np.einsum("nl,nlk->k", ((y[:, None] - p1) * mask) * weight[:, None], x)
        grad_t = np.zeros((2, 2))
        pairs = mask[:, 1:] * weight[:, None]
        for i in range(2):
            for j in range(2):
                p = np.exp(alpha[:, :-1, i] + t[i, j] + e[:, 1:, j] + beta[:, 1:, j] - log_z[:, None])
                grad_t[i, j] = ((((y[:, None] == i) & (i == j)) - p) * pairs).sum()
        grad = np.concatenate([grad_w - decay * w, grad_t.ravel() - decay * t.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
        w, t = w + move[:k], t + move[k:].reshape(2, 2)
    return LineField(tuple(np.round(w, 6).tolist()), tuple(tuple(row) for row in np.round(t, 6).tolist()))


def train_lines(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """Fit the field on at most ``sample_docs`` labelled documents per label, ``sample_lines`` spread lines of each.

    The sample is a bound on what the driver holds, whatever the input: the documents with the smallest hash of their id.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    draw = F.xxhash64(F.lit("lines"), "id")
    chosen = None
    for label in (0, 1):
        part = marked.filter(F.col("label") == label).orderBy(draw, "id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    picked = texts.join(F.broadcast(chosen), "id")  # at most 2 * sample_docs ids

    def start():
        def step(cols):
            rows = []
            for text in cols["text"]:
                x, _ = line_features(text)
                if len(x) > sample_lines:  # training only
                    x = x[np.linspace(0, len(x) - 1, sample_lines).astype(int)]
                rows.append(x.ravel().tolist())
            return {"id": cols["id"], "label": cols["label"], "x": rows}

        return step

    rows = map_batches(picked, start, "id long, label int, x array<float>").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.x))
    return fit_lines([np.asarray(r.x).reshape(-1, len(FEATURES)) for r in rows], [r.label for r in rows])


def verdict(text: str, field: LineField, min_share: float) -> dict:
    out = base_rules(text) | {"content_share": 0.0, "kept": False}
    x, sizes = line_features(text)
    weight = np.where(x[:, 11] > 0, 0, sizes)
    if weight.sum():
        out["content_share"] = float(weight[field.viterbi(x)].sum() / weight.sum())
    out["kept"] = not out["base_failed"] and out["content_share"] >= min_share
    return out


def judge(docs: DataFrame, field: LineField, min_share: float = MIN_CONTENT_SHARE, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base statistics, the share of bytes in content lines, and ``kept``.

    Lines without a word carry no weight. Null and empty texts have no words and fail the base rules; so do texts of
    fewer than 20 words. Repeated rows are judged each, texts of any length whole; other columns are not read, an empty table
    gives an empty result. Map-only.
    """
    passed = [] if id_col is None else [id_col]

    def start():
        def step(cols):
            out: dict[str, list] = {c: [] for c in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")}
            for text in cols["__text"]:
                for k, v in verdict(text, field, min_share).items():
                    out[k].append(v)
            return {c: cols[c] for c in passed} | out

        return step

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{c}` {types[c]}, " for c in passed) + (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
    return map_batches(docs.select(*passed, text_of(text_col).alias("__text")), start, schema)


def keep_good(docs: DataFrame, field: LineField, min_share: float = MIN_CONTENT_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, whatever their names. Rows stay in their Arrow
    batch: no join. A text of any type is read as a string, a null one goes, an empty table stays empty."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            keep = [verdict(text or "", field, min_share)["kept"] for text in texts]
            yield batch.filter(pa.array(keep, type=pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)

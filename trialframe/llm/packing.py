"""Bounded-space online packing of documents into fixed-length token sequences."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, partitions_for, slices, staged, text_of

SEQ_LEN = 4096
END_ID = 2
OPEN_WINDOWS = 32
MIN_CUT = 64
MERGE_ROWS = 4096
WORD_CACHE = 500_000

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, window long, offset long, open boolean, ids binary"
)


# characters whose treatment by the tokenizer is settled: ASCII, the letters of Latin-1, and common typographic marks
SETTLED = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ÿ\\u2013\\u2014\\u2018\\u2019\\u201c\\u201d\\u2026]")
# fixed value: the tokenizer's own split of lower-case text, written for those characters
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Table(dict):
    """Numbers strings as they come; ``new`` holds those whose ids aren't known yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Ids:
    """The ids of the strings of a table, one after another."""

    def __init__(self):
        self.table = Table()
        self.flat = np.zeros(1 << 16, dtype="<u4")
        self.first, self.count = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.used = self.known = 0

    def learn(self, lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        total, n = int(counts.sum()), self.known + len(lists)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.first):
            self.first, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.count))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), dtype="<u4", count=total)
        self.first[self.known : n] = self.used + np.cumsum(counts) - counts
        self.count[self.known : n] = counts
        self.used, self.known = self.used + total, n
        self.table.new.clear()

    def of(self, codes: np.ndarray) -> np.ndarray:
        first, count = self.first[codes], self.count[codes]
        total = int(count.sum())
        return self.flat[np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)]


class Tokenizer:
    """Ids of whole texts, part by part.

    The tokenizer normalises, splits into parts and encodes each part by itself; parts never cross white space. Texts of
    settled characters are split here and only new parts are encoded. Any other text is cut at white space and each new
    piece goes through the whole tokenizer. Parts and pieces are remembered within a task.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Model
        from tokenizers import pre_tokenizers

        self.model = Model.from_file(path)
        self.bpe = self.model.model
        # how the byte level writes each byte that is no printable ASCII character
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {chr(c): level.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xC0, 0x100), *map(ord, "–—‘’“”…")]}
        self.written = str.maketrans(self.written)
        self.parts, self.pieces = Ids(), Ids()

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or SETTLED.search(text):
            return self._whole(text)
        if self.parts.known > WORD_CACHE:  # emptied between texts only
            self.parts = Ids()
        found, table = PARTS.findall(text.lower()), self.parts.table
        codes = np.fromiter(map(table.__getitem__, found), dtype=np.int64, count=len(found))
        if table.new:
            encode, written = self.bpe.tokenize, self.written
            self.parts.learn([[t.id for t in encode(w if w.isascii() else w.translate(written))] for w in table.new])
        return self.parts.of(codes)

    def _whole(self, text: str) -> np.ndarray:
        if self.pieces.known > WORD_CACHE:
            self.pieces = Ids()
        found, table = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), self.pieces.table
        codes = np.fromiter(map(table.__getitem__, found), dtype=np.int64, count=len(found))
        if table.new:
            self.pieces.learn([e.ids for e in self.model.encode_batch(table.new, add_special_tokens=False)])
        return self.pieces.of(codes)


@dataclass
class Windows:
    """At most ``limit`` open windows. ``closed`` holds those emitted since it was last read."""

    size: int
    limit: int
    next_id: int
    used: dict[int, int] = field(default_factory=dict)
    closed: list[int] = field(default_factory=list)

    def place(self, length: int, min_cut: int) -> list[tuple[int, int, int]]:
        """Where ``length`` ids go: (window, offset, ids placed)."""
        out = []
        while length:
            if length >= self.size:
                w = self._new()
                out.append((w, 0, self.size))
                self.closed.append(w)
                length -= self.size
                continue
            fits = [(self.size - u - length, w) for w, u in self.used.items() if self.size - u >= length]
            if fits:
                _, w = min(fits)
                out.append((w, self.used[w], length))
                self._fill(w, length)
                return out
            if len(self.used) < self.limit:
                w = self._new()
                out.append((w, 0, length))
                self.used[w] = length
                return out
            # none fits: the fullest window goes out, topped up with the head of this piece where that saves padding
            room, w = min((self.size - u, w) for w, u in self.used.items())
            if room >= min_cut:
                out.append((w, self.used[w], room))
                length -= room
            self._close(w)
        return out

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _fill(self, w: int, length: int) -> None:
        self.used[w] += length
        if self.used[w] == self.size:
            self._close(w)

    def _close(self, w: int) -> None:
        del self.used[w]
        self.closed.append(w)


def best_fit_bins(sizes: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset) of every item, best fit in falling order of size."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        n = sizes[i]
        room = next((r for r in range(n, size + 1) if by_room[r]), None)
        if room is None:
            b, at = len(used), 0
            used.append(0)
        else:
            b = by_room[room].pop()
            at = used[b]
        used[b] = at + n
        by_room[size - used[b]].append(b)
        out[i] = (b, at)
    return out


def pack(
    docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian uint32).

    A task keeps ``open_windows`` windows. A document (its ids and ``end_id``) gives full windows while it is longer than
    one; the rest goes where it leaves the least room. If no window has the room and no new one may be opened, the fullest
    is emitted, topped up with the head of the piece if it lacks ``min_cut`` ids or more: emitted windows lack fewer than
    ``min_cut``. The windows open at the end of all tasks are merged, in groups of about 4096 windows, best fit first.
    Every row is a document of its own, repeated ids too. Null and empty texts are the end id alone. An empty table gives
    no piece, other columns are not read, and a text of any length is encoded whole by one task. ``vocabulary`` is the tokenizer file's path, the same on every machine; it is read once per task.

    The pieces are written once, ids included: a lost executor can't make a task pack its rows another way later on.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    arrow = to_arrow_schema(T.StructType.fromDDL(PIECES))

    def run(batches):
        from pyspark import TaskContext

        model = Tokenizer(vocabulary)
        windows = Windows(seq_len, open_windows, TaskContext.get().partitionId() << 32)
        end = np.asarray([end_id], dtype="<u4")
        held: dict[int, list[tuple]] = {}  # pieces of open windows

        def emitted(ids: list[int], still_open: bool) -> pa.RecordBatch:
            rows = [(*piece[:6], still_open, piece[6]) for w in ids for piece in held.pop(w)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([model.ids(text), end]).astype("<u4", copy=False)
                start = 0
                for window, offset, length in windows.place(len(ids), min_cut):
                    held.setdefault(window, []).append((doc_id, start, length, len(ids), window, offset, ids[start : start + length].tobytes()))
                    start += length
                if len(windows.closed) >= 256:
                    yield emitted(windows.closed, False)
                    windows.closed.clear()
            yield emitted(windows.closed, False)
            windows.closed.clear()
        yield emitted(list(windows.used), True)
        del model, emitted
        give_back()

    pieces = staged(rows.mapInArrow(run, PIECES), "pieces")
    left = staged(pieces.filter("open").groupBy("window").agg(F.sum("length").alias("used")), "open-windows")
    groups = partitions_for(left.count(), MERGE_ROWS)

    def merge(part):
        part = part.sort_values("window", ignore_index=True)
        bins = best_fit_bins(part["used"].tolist(), seq_len)
        names = {b: int(part["window"].iloc[i]) for i, (b, at) in enumerate(bins) if at == 0}  # a bin is named after its first window
        part["merged"] = [names[b] for b, _ in bins]
        part["base"] = [at for _, at in bins]
        return part[["window", "merged", "base"]]

    moves = left.groupBy(F.pmod(F.xxhash64("window"), F.lit(groups)).alias("g")).applyInPandas(merge, "window long, merged long, base long")
    done = pieces.filter("NOT open").select("doc_id", "start", "length", "doc_tokens", F.col("window").alias("sequence_id"), "offset", "ids")
    late = pieces.filter("open").join(moves, "window")
    return done.unionByName(late.select(
        "doc_id", "start", "length", "doc_tokens", F.col("merged").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"), "ids"))

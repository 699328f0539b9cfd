"""Byte-level BPE: merges folded by higher-order functions with a literal rank map; pieces joined back to bytes."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

PAIR_BUCKETS, PAIR_STEP = 65_536, 1_000_003
WORD_END = 2**30
CACHE_WORDS = 1 << 18
CACHE_WORD_BYTES = 64
FLUSH_CHARS = 4_000_000
LATIN_CLASSES = (r"\p{L}", r"\p{N}", r"\s")

PARTLY = "doc_id long, known array<array<int>>, holes array<int>, rare array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


@dataclass(frozen=True)
class Ranks:
    """A vocabulary of byte strings: a string's id is its merge rank."""

    ids: dict[bytes, int]
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Ranks:
        """From a file with a base64 string and its rank a line. Each single byte must have a rank."""
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if any(bytes([b]) not in ids for b in range(256)) or sorted(ids.values()) != list(range(len(ids))):
            raise ValueError("the ranks must be 0, 1, 2, ... and cover every byte")
        return Ranks(ids, pattern)

    @cached_property
    def words(self) -> dict[str, int]:
        """The pieces that are whole characters."""
        out = {}
        for piece, i in self.ids.items():
            try:
                out[piece.decode()] = i
            except UnicodeDecodeError:
                continue
        return out

    @cached_property
    def _pairs(self) -> Column:
        """The literal rank map: the rank of two neighbours' join, by their ids. An array of small maps, as a lookup in
        a map goes through its keys."""
        buckets: list[dict[int, int]] = [{} for _ in range(PAIR_BUCKETS)]
        for piece, rank in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    buckets[(a * PAIR_STEP + b) & (PAIR_BUCKETS - 1)][a * PAIR_STEP + b] = rank
        return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")

    @cached_property
    def _pieces(self) -> Column:
        order = sorted(self.ids, key=self.ids.__getitem__)
        return F.from_json(F.lit(json.dumps([base64.b64encode(b).decode() for b in order])), "array<binary>").cast("array<string>")

    @cached_property
    def _bytes(self) -> Column:
        return F.from_json(F.lit(json.dumps([self.ids[bytes([b])] for b in range(256)])), "array<bigint>")

    @property
    def _none(self) -> int:
        """Above every rank and id, of one bit more than they need."""
        return (1 << len(self.ids).bit_length() + 1) - 1

    def fold(self, words: Column) -> Column:
        """The ids of each of ``words``, an array of matches of the pattern that are no pieces themselves: of its bytes, the
        neighbours whose join has the lowest rank (the first, if equal) merge until no join has a rank. A merge asks for
        two new ranks only.
        """
        return let(self._pairs, lambda pairs: F.transform(words, lambda word: self._folded(word, pairs)))

    def _folded(self, word: Column, pairs: Column) -> Column:
        """The state is one array of numbers, a part each: the rank of its join with the next part in the highest bits, its
        id in the lowest. With the places put between them, the least number is the next merge: the lowest rank, then the
        first. The part's first byte lies there too, so all numbers differ and parts leave and enter by functions on arrays.
        """
        shift = 63 - self._none.bit_length()
        none, ids, places = (F.lit(x).cast("long") for x in (self._none, self._none, (1 << shift) - 1))
        over = F.lit(self._none << shift).cast("long")  # no join, or the bits of a rank

        def joined(a: Column, b: Column) -> Column:  # the highest bits: the rank of the join of two pieces
            key = a * F.lit(PAIR_STEP) + b
            return F.shiftleft(F.coalesce(pairs[key.bitwiseAND(F.lit(PAIR_BUCKETS - 1)).cast("int")][key], none), shift)

        def merge(acc: Column, low: Column, at: Column) -> Column:  # the parts at the place and after it
            new, before, this = F.shiftright(low, shift), acc[at - 1], acc[at]
            left = joined(before.bitwiseAND(ids), new).bitwiseOR(before.bitwiseAND(places))
            right = joined(new, acc[at + 2].bitwiseAND(ids)).bitwiseOR(this.bitwiseAND(places - ids)).bitwiseOR(new)
            rest = F.array_remove(F.array_remove(F.array_remove(acc, before), this), acc[at + 1])
            return F.array_insert(F.array_insert(rest, at, right), at, left)

        def step(acc: Column, _: Column) -> Column:
            least = F.array_min(F.transform(acc, lambda x, i: x.bitwiseAND(over).bitwiseOR(i.cast("long"))))
            return let(least, lambda low: F.when(low >= over, acc).otherwise(
                let(low.bitwiseAND(places).cast("int"), lambda at: merge(acc, low, at))))

        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # a character a byte
        ends = F.array(ids)  # no piece has this id
        parts = F.concat(ends, F.transform(F.split(raw, ""), lambda c: self._bytes[F.ascii(c)]), ends)
        place = lambda i: F.shiftleft(i.cast("long"), self._none.bit_length())
        start = let(parts, lambda p: F.transform(p, lambda x, i: joined(x, F.coalesce(F.get(p, i + 1), ids)).bitwiseOR(place(i)).bitwiseOR(x)))
        times = F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2)))
        return F.aggregate(times, start, step, lambda acc: F.transform(F.slice(acc, F.lit(2), F.size(acc) - 2), lambda x: x.bitwiseAND(ids).cast("int")))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: their binary pieces, held as strings of any bytes, one after the other. An unknown id
        is an error."""
        return let(self._pieces, lambda pieces: F.array_join(F.transform(ids, lambda i: pieces[i]), "")).cast("binary")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for the standard library's faster engine, which matches texts of the first 256 code points alike; none if it
    uses more than letters, numbers, white space and plain characters. Classes are spelled out, as the engines' own differ.
    """
    members = {e: "".join(re.escape(chr(c)) for c in range(256) if regex.match(e, chr(c))) for e in LATIN_CLASSES}

    def spelled(found: re.Match) -> str:
        part = found[0]
        if part == r"\S":
            return f"[^{members[LATIN_CLASSES[-1]]}]"
        if part in members:
            return f"[{members[part]}]"
        for escape, chars in members.items():
            part = part.replace(escape, chars)
        return part

    plain = re.sub(r"\\p\{[LN]\}|\\s|\\S", "", pattern)
    if re.search(r"\\|\[\[|&&|--|\|\||~~|\(\?[^!:=]|\{[^0-9,]", plain) or re.search(r"\[[^\]]*\\S", pattern):
        return None
    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", spelled, pattern))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of ``pattern`` in a text, by the engine with the tokenizer's own classes or one that matches alike."""
    whole, latin = regex.compile(pattern).findall, latin_pattern(pattern)
    if latin is None:
        return whole
    fast = latin.findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return fast(text)

    return split


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, added up before the shuffle. The JVM's classes may lack the newest letters, so this only
    chooses which words are worth remembering; texts themselves are split by :func:`_known`."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, n: int, pieces: frozenset[str]) -> DataFrame:
    """The ``n`` words of largest count (ties: smallest word) that are no ``pieces``, which have their id already."""

    def others(batches):
        for batch in batches:
            yield batch.filter(pa.array([w not in pieces for w in batch.column(0).to_pylist()], pa.bool_()))

    order = [F.desc("n"), F.col("word")]
    return counts.orderBy(*order).limit(n + len(pieces)).mapInArrow(others, "word string, n long").orderBy(*order).limit(n)


def _known(codes: dict[str, bytes], pattern: str):
    """Rows of PARTLY: the ids of known words, in runs between the others, which are named in ``rare``, each once."""

    def flushed(rows):
        ids, runs, docs, holes, hole_ends, rare, rare_ends = [], [0], [0], [], [0], [], [0]
        for _, parts, missing, names in rows:
            for run in parts:
                ids.append(run)
                runs.append(runs[-1] + len(run) // 4)
            docs.append(len(runs) - 1)
            holes += missing
            hole_ends.append(len(holes))
            rare += names
            rare_ends.append(len(rare))
        flat = pa.Array.from_buffers(pa.int32(), runs[-1], [None, pa.py_buffer(b"".join(ids))])
        listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), listed(docs, listed(runs, flat)), listed(hole_ends, pa.array(holes, pa.int32())), listed(rare_ends, pa.array(rare, pa.string()))],
            names=["doc_id", "known", "holes", "rare"])

    def run(batches):
        split = splitter(pattern)
        rows, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = split(text)
                got = list(map(codes.get, found))
                parts, missing, names, at = [], [], {}, 0
                for _ in range(got.count(None)):
                    k = got.index(None, at)
                    parts.append(b"".join(got[at:k]))
                    missing.append(names.setdefault(found[k], len(names)))
                    at = k + 1
                parts.append(b"".join(got[at:]))
                rows.append((doc.as_py(), parts, missing, list(names)))
                size += len(text)
                if size > FLUSH_CHARS:
                    yield flushed(rows)
                    rows, size = [], 0
        if rows:
            yield flushed(rows)

    return run


def encode(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: the ids of every match of the pattern, one match after the other, no special tokens.

    A match that is a piece has its id. The corpus' most frequent other words are folded once and given to the tasks: ``cache_words``
    at most, of 64 bytes at most, whatever the size of the input. Every other word is folded in its document's row, once a document, so that documents
    are never shuffled; results don't depend on ``cache_words``. Null and empty texts have no ids, ids of documents are whole numbers or
    null, repeated rows are encoded each, an empty table gives an empty result, other columns are not read. A word of k
    bytes costs k steps of k numbers at most: a letter run of 10,000 bytes takes seconds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = lambda ids: np.asarray(ids, dtype=np.int32).tobytes()
    codes: dict[str, bytes] = {}
    if cache_words:
        counts = word_counts(docs, ranks.pattern, text_col).filter(F.octet_length("word") <= CACHE_WORD_BYTES)
        often = staged(most_frequent(counts, cache_words, frozenset(ranks.words)), "bpe-words")
        made = often.repartition(docs.sparkSession.sparkContext.defaultParallelism).select("word", ranks.fold(F.array("word"))[0].alias("ids"))
        codes = {r.word: packed(r.ids) for r in made.toLocalIterator()}  # a row a word: at most cache_words
    codes |= {word: packed([i]) for word, i in ranks.words.items()}
    partly = rows.mapInArrow(_known(codes, ranks.pattern), PARTLY)
    none = F.array().cast("array<int>")
    ids = let(ranks.fold(F.col("rare")), lambda made: F.flatten(F.transform(
        "known", lambda run, i: F.flatten(F.array(run, F.coalesce(F.get(made, F.get("holes", i)), none))))))
    return partly.select("doc_id", ids.alias("ids"))

"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

The patterns are the distinct sequences of GRAM words of all evaluation items. As in Wu and Manber's
method a window of GRAM words slides over a text; its last BLOCK words index a shift table: a block that no
pattern holds lets the window skip, a block that ends some pattern leads to the patterns with that suffix,
and a direct comparison confirms the occurrence. Letters here are words, so the tables stay sparse and most
windows skip. An item of fewer than GRAM words is one pattern of its own length.

Items of up to TABLE_BYTES of text fit into tables that every task holds. Beyond, the patterns stay spread
over the cluster: texts are sifted by two bit filters of bounded size, one over blocks (the shift) and one
over whole patterns, and only windows that pass both are joined to the patterns they equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.skew import hot_keys, skew_join
from lodestrata.runtime import materialize

#: Words of a pattern; words of a block of the shift table.
GRAM = 4
BLOCK = 2
#: A passage of so many consecutive words of an item is a leak; so is this share of its distinct sequences.
RUN = 12
SHARE = 0.5
#: Bytes of item text whose tables are sent to every task; a table takes some 80 times its text.
TABLE_BYTES = 4 << 20
#: Bits of a filter: 16 for each pattern, at most so many (64 MB), in slices that one task makes.
FILTER_BITS = 1 << 29
SLICE_BITS = 1 << 23

INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
WORD = re.compile(r"[^\W_]+")
#: Scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han); each character is a word.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
_PIECES = re.compile(rf"(?=[^\W_]){UNSPACED.pattern}|(?:(?!{UNSPACED.pattern})[^\W_])+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case and composed form, zero-width characters and soft hyphens removed.

    In scripts without blanks every letter is a word of its own.
    """
    t = text.translate(INVISIBLE)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    t = t.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
        if UNSPACED.search(t):
            return _PIECES.findall(t)
    return WORD.findall(t)


def grams(seq: list) -> Iterator[tuple[int, list]]:
    """(position, words) of an item's patterns: its sequences of GRAM words, or all of a shorter item."""
    n = min(GRAM, len(seq))
    for p in range(len(seq) - n + 1 if n else 0):
        yield p, seq[p : p + n]


class Patterns:
    """The shift table, the patterns by their words, and the items' own places of each pattern."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        self.shift: dict[tuple[int, ...], int] = {}
        self.index: dict[tuple[int, ...], int] = {}
        self.places: list[list[tuple[int, int]]] = []  # per pattern: (item, position)
        self.distinct: dict[int, int] = {}
        for item, text in items:
            own = set()
            for p, gram in grams([self.ids.setdefault(w, len(self.ids)) for w in words(text or "")]):
                k = self.index.setdefault(tuple(gram), len(self.places))
                if k == len(self.places):
                    self.places.append([])
                own.add(k)
                self.places[k].append((item, p))
            if own:
                self.distinct[item] = len(own)
        for gram in self.index:
            for end in range(BLOCK, GRAM + 1) if len(gram) == GRAM else ():
                block = gram[end - BLOCK : end]
                self.shift[block] = min(self.shift.get(block, GRAM), GRAM - end)
        self.skip = GRAM - BLOCK + 1
        self.short = sorted({len(g) for g in self.index} - {GRAM})

    def occurrences(self, text: str) -> Iterator[tuple[int, int]]:
        """(position, pattern) of every occurrence in a text, by position."""
        ids, shift, skip, index = self.ids, self.shift, self.skip, self.index
        seq = [ids.get(w, -1) for w in words(text)]
        at, n = GRAM, len(seq)
        while at <= n:
            s = shift.get((seq[at - 2], seq[at - 1]), skip)
            if s:
                at += s
                continue
            k = index.get(tuple(seq[at - GRAM : at]))
            if k is not None:
                yield at - GRAM, k
            at += 1
        for size in self.short:
            for p in range(n - size + 1):
                k = index.get(tuple(seq[p : p + size]))
                if k is not None:
                    yield p, k

    def leaks(self, text: str) -> list[int]:
        """The items that a text leaks, in order."""
        seen: dict[int, set[int]] = {}
        runs: dict[tuple[int, int], tuple[int, int]] = {}  # (item, offset of text to item) -> (last position, length)
        found = set()
        for pos, k in self.occurrences(text):
            for item, p in self.places[k]:
                seen.setdefault(item, set()).add(k)
                last, length = runs.get((item, pos - p), (-2, 0))
                length = length + 1 if last == pos - 1 else 1
                runs[(item, pos - p)] = (pos, length)
                if length >= RUN - GRAM + 1:
                    found.add(item)
        found.update(i for i, ks in seen.items() if len(ks) >= SHARE * self.distinct[i])
        return sorted(found)


def _bits(words_: list[str], size: int) -> list[int]:
    """The places of a block or pattern in a filter of ``size`` bits."""
    h = xxhash.xxh3_128_intdigest("\x1f".join(words_))
    return [(h >> s) % size for s in (0, 42, 84)]


def bit_filter(rows: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(bits, bytes) of a filter over the distinct values of ``column`` (words joined by a unit separator).

    Its slices are made by the tasks; what reaches the driver is the filter itself, FILTER_BITS at most.
    """
    values = rows.select(column).distinct()
    size = int(min(FILTER_BITS, max(1 << 10, 16 * values.count())))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.array([x for v in b.column(0).to_pylist() for x in _bits(v.split("\x1f"), size)], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at // SLICE_BITS), pa.array(at % SLICE_BITS)], names=["slice", "bit"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            s, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(s):
                made.setdefault(int(k), np.zeros(SLICE_BITS, dtype=bool))[bit[s == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in made.values()], pa.binary())], names=["slice", "bytes"])

    spread = values.mapInArrow(places, "slice long, bit long").repartition(max(1, min(64, -(-size // SLICE_BITS))), "slice")
    out = np.zeros((-(-size // SLICE_BITS)) * SLICE_BITS // 8, dtype=np.uint8)
    for r in spread.mapInArrow(slices, "slice long, bytes binary").toLocalIterator():
        out[r["slice"] * SLICE_BITS // 8 : (r["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(r["bytes"], dtype=np.uint8)
    return size, out


def _spread_search(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """The pairs of (doc_id, t) rows and (i, t) items by patterns that stay spread over the cluster."""
    spark = rows.sparkSession
    number = numbered.schema["i"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, p, "\x1f".join(g), len(g)) for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist()) for p, g in grams(words(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field("i").type), *(pa.array([r[k] for r in out], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int32())))], names=["item", "p", "gram", "size"])

    patterns = materialize(numbered.mapInArrow(cut, f"item {number}, p long, gram string, size int").distinct(), "patterns")
    pair = F.split("gram", "\x1f")
    blocks = patterns.where(F.col("size") == GRAM).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRAM - BLOCK + 1)), lambda k: F.array_join(F.slice(pair, k, F.lit(BLOCK)), "\x1f"))).alias("block"))
    sizes = sorted(r["size"] for r in patterns.select("size").distinct().toLocalIterator())
    known = spark.sparkContext.broadcast((bit_filter(blocks, "block"), bit_filter(patterns, "gram"), sizes))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bn, bb), (gn, gb), sizes = known.value

        def holds(w: list[str], n: int, bits: np.ndarray) -> bool:
            return all(bits[x >> 3] >> (x & 7) & 1 for x in _bits(w, n))

        for b in batches:
            out = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist()):
                seq = words(t)
                at = GRAM
                while GRAM in sizes and at <= len(seq):
                    if not holds(seq[at - BLOCK : at], bn, bb):  # in no pattern: no window that holds it can match
                        at += GRAM - BLOCK + 1
                        continue
                    if holds(seq[at - GRAM : at], gn, gb):
                        out.append((d, at - GRAM, "\x1f".join(seq[at - GRAM : at])))
                    at += 1
                for n in sizes:
                    if n < GRAM:
                        out += [(d, p, "\x1f".join(seq[p : p + n])) for p in range(len(seq) - n + 1) if holds(seq[p : p + n], gn, gb)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field("doc_id").type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["doc_id", "pos", "gram"])

    windows = materialize(rows.mapInArrow(sift, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos long, gram string"), "windows")
    hits = skew_join(windows, patterns, "gram", "inner", hot_keys(windows, F.col("gram")), F.xxhash64("doc_id", "pos"))
    total = patterns.groupBy("item").agg(F.count_distinct("gram").alias("total"))
    share = hits.groupBy("doc_id", "item").agg(F.count_distinct("gram").alias("n")).join(total, "item").where(F.col("n") >= SHARE * F.col("total"))
    line = Window.partitionBy("doc_id", "item", "offset").orderBy("pos")
    runs = hits.where(F.col("size") == GRAM).select("doc_id", "item", "pos", (F.col("pos") - F.col("p")).alias("offset")).withColumn("run", F.col("pos") - F.row_number().over(line))
    long_runs = runs.groupBy("doc_id", "item", "offset", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RUN - GRAM + 1)
    return share.select("doc_id", F.col("item").alias("item_id")).unionByName(long_runs.select("doc_id", F.col("item").alias("item_id"))).distinct()


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id``, ``item_id`` of every document that holds a passage of an item, each pair once.

    Null and empty texts hold and are nothing. An item of fewer than GRAM words leaks where all its words
    stand in a row. Every document is read whole, once. With items of up to ``table_bytes`` nothing of the
    corpus is shuffled but the pairs; beyond, the windows that equal a pattern are.
    """
    spark = docs.sparkSession
    numbered = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t IS NOT NULL")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    if size > table_bytes:
        return _spread_search(rows, numbered)
    known = spark.sparkContext.broadcast(Patterns([(r["i"], r["t"]) for r in numbered.toLocalIterator()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = known.value
        for b in batches:
            ids, hit, item = b.column("doc_id").to_pylist(), [], []
            for d, t in zip(ids, b.column("t").to_pylist()):
                for i in patterns.leaks(t):
                    hit.append(d)
                    item.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(hit, b.schema.field("doc_id").type), pa.array(item, pa.int64())], names=["doc_id", "item_id"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id bigint").distinct()

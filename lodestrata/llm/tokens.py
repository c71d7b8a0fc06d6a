"""Encoding of texts with a public byte-level BPE tokenizer, by a pair occurrence index.

The distinct words of a block of texts are laid out as one array of byte symbols, linked to their
neighbours. An index maps each adjacent pair to all its positions; the ranks of the pairs that occur are
active and applied in ascending order, each at all its positions at once, and the lists of the pairs that a
merge makes or breaks are updated. A merge only makes pairs with a token that did not exist before it, so
an applied rank never comes back. Texts are then put together from their words' ids.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie unless a path is given; they are never copied into this repository.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"

#: Fixed value: the pattern that splits text into words before the merges of this vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of text encoded together: the block's index stays within tens of MB of a Python worker.
BLOCK_CHARS = 4_000_000
#: Words whose ids a worker keeps between blocks; the memory is dropped when it is full.
KEPT_WORDS = 200_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary's file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids of the bytes, and for each mergeable pair of ids its rank and the merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.byte_id = [ids[c] for _, c in sorted(byte_symbols().items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """The token ids of each word, all words together, by the pair occurrence index."""
    merges = vocab.merges
    sym: list[int] = []
    starts: list[int] = []
    for w in words:
        starts.append(len(sym))
        sym.extend(vocab.byte_id[b] for b in w)
        sym.append(-1)  # a wall no pair crosses
    n = len(sym)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    where: dict[int, list[int]] = {}  # rank -> positions of its pair's left symbols
    merged_of: dict[int, tuple[int, int, int]] = {}
    active: list[int] = []
    for i in range(n - 1):
        m = merges.get((sym[i], sym[i + 1]))
        if m:
            at = where.get(m[0])
            if at is None:
                where[m[0]] = [i]
                merged_of[m[0]] = (sym[i], sym[i + 1], m[1])
            else:
                at.append(i)
    active = list(where)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        a, b, new = merged_of[rank]
        positions = where.pop(rank)
        positions.sort()
        for i in positions:
            if sym[i] != a:
                continue
            j = nxt[i]
            if j >= n or sym[j] != b:
                continue
            sym[i] = new
            sym[j] = -2  # gone
            k = nxt[j]
            nxt[i] = k
            prv[k] = i
            right = sym[k]
            if right >= 0:
                m = merges.get((new, right))
                if m:
                    at = where.get(m[0])
                    if at is None:
                        where[m[0]] = [i]
                        merged_of[m[0]] = (new, right, m[1])
                        heapq.heappush(active, m[0])
                    else:
                        at.append(i)
            h = prv[i]
            if h >= 0:
                m = merges.get((sym[h], new)) if sym[h] >= 0 else None
                if m:
                    at = where.get(m[0])
                    if at is None:
                        where[m[0]] = [h]
                        merged_of[m[0]] = (sym[h], new, m[1])
                        heapq.heappush(active, m[0])
                    else:
                        at.append(h)
    out = []
    for s, w in zip(starts, words):
        ids, i = [], s
        while i < n and sym[i] != -1:
            ids.append(sym[i])
            i = nxt[i]
        out.append(ids)
    return out


class Encoder:
    """Encodes blocks of texts; keeps the ids of words it has met, up to a bound."""

    def __init__(self, path: str):
        import regex

        self.vocab = Vocabulary(path)
        self.find = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        fresh = list({w for ws in split for w in ws if w not in self.known})
        for w, ids in zip(fresh, merge_words([w.encode("utf-8") for w in fresh], self.vocab)):
            self.known[w] = ids
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in split]


def encode_texts(rows: DataFrame, keep: list[str], text: str, vocabulary: str = BYTE_BPE_50K, folder: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids``, an array<int>, of every row; special tokens are ordinary text.

    Null and empty texts have an empty list. ``folder`` must be readable on every executor. A map over rows:
    whole texts, no shuffle; repeated rows come out repeated; an empty table gives an empty result.
    """
    path = os.path.join(folder or TOKENIZERS, vocabulary)
    picked = rows.select(*keep, rows[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in keep), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BLOCK_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                ids = encoder.encode(texts[at:end])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])
                at = end

    return picked.mapInArrow(run, schema)

"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A text is cut into pretokens as the vocabulary file's byte-level pretokenizer cuts them. The bytes
of a pretoken form a linked list; a heap holds the ranks of its adjacent pairs, the lowest (then
leftmost) is popped again and again, and the count is the initial symbols minus the merges. This
takes O(n log n) for a pretoken of n bytes, so a very long one is no trouble. Counts of pieces that
recur are kept in a bounded table for each worker.

Cases: a null or empty text has no tokens and no bytes; the file's special strings inside a text
count as one token each, as the library does by default; rows are independent, so repeated ids,
ties and other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .scan import register_cache

HELD = 400_000  # pieces remembered by a worker
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the public byte-level pretokenizer pattern


def _byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        ids = {s: i for i, s in enumerate(_byte_symbols())}
        self.merges: dict[int, tuple[int, int]] = {}  # left << 32 | right -> (rank, merged symbol)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids.setdefault(a, len(ids)) << 32 | ids.setdefault(b, len(ids))] = (rank, ids.setdefault(a + b, len(ids)))
        self.split = regex.compile(SPLIT)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.mark = special[0][:2] if special and all(s[:2] == special[0][:2] for s in special) else ""
        self.pieces = _Held(self.regular)
        self.words = _Held(self.pretoken)

    def pretoken(self, word: str) -> int:
        """Tokens of one pretoken: pop the lowest-ranked pair until none is left."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        n = len(symbols)
        if n < 2:
            return n
        merges = self.merges
        heap = []
        for i in range(n - 1):
            if found := merges.get(symbols[i] << 32 | symbols[i + 1]):
                heap.append((found[0], i, symbols[i], symbols[i + 1]))
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue  # the pair is gone
            merged = merges[a << 32 | b][1]
            symbols[i], symbols[j] = merged, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get(merged << 32 | symbols[k]):
                    heappush(heap, (found[0], i, merged, symbols[k]))
            h = before[i]
            if h >= 0 and (found := merges.get(symbols[h] << 32 | merged)):
                heappush(heap, (found[0], h, symbols[h], merged))
        return left

    def regular(self, text: str) -> int:
        """Tokens of a text without special strings."""
        words = self.words
        return sum([words[w] for w in self.split.findall(text)])

    def __call__(self, text: str) -> int:
        if self.special and self.mark in text and (found := self.special.findall(text)):
            return len(found) + sum(self._text(t) for t in self.special.split(text))
        return self._text(text)

    def _text(self, text: str) -> int:
        """Cuts at single spaces and line feeds between words, where the pretokenizer cuts anyway."""
        if not text:
            return 0
        if text.replace("\n", " ").split(" ") != text.split():
            return self.regular(text)  # other or repeated white space
        pieces = text.replace("\n", " \n").split(" ")
        held = self.pieces
        count = held[pieces[0]]
        get = held.__getitem__
        return count + sum([get(p) if p[0] == "\n" else get(" " + p) for p in pieces[1:]])


class _Held(dict):
    """A bounded table of computed counts."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= HELD:
            self.clear()
        n = self.make(key)
        if len(key) <= 64:
            self[key] = n
        return n


_counters: dict[str, MergeCounter] = {}


def _forget() -> bool:
    held = any(c.pieces for c in _counters.values())
    for c in _counters.values():
        c.pieces.clear()
        c.words.clear()
    return held


register_cache(_forget)


def counter(path: str) -> MergeCounter:
    """The worker's counter for a file."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row; path is the vocabulary file on each machine."""

    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

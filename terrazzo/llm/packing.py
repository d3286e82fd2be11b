"""Packing of tokenised documents into sequences of a fixed length by hierarchical best fit.

Each task tokenises its documents, cuts only those longer than a sequence, and packs its pieces by
best fit, the longest first. Bins that are nearly full are final. The underfull ones go on as
items of their fill: rounds of a tree merge gather them from many tasks into ever fewer groups,
packed by best fit again, until one group is left or merging no longer helps. Tasks hold piece
lengths only, and rounds hold bins, never texts.

Token identifiers come from the vocabulary file's own library. NumPy lower-cases a slice of texts and cuts
it into pretokens by tables of bytes, Arrow finds the distinct ones; only those are looked up, and NumPy
lays their identifiers out by the places of the pretokens. The identifiers are kept in a bounded table;
new pretokens go to the library in one call for many. A word with a character that the tables of bytes
cannot tell is looked up whole.

Cases: a null or empty text is the single end identifier; a very long text is tokenised whole and cut
into pieces; pieces of one length go in the order of their rows; rows that repeat an id are packed each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import LOWER, register_cache, trim
from .shared import stored

HELD = 400_000  # entries of each half of a worker's table, about 200 bytes each
SLICE = 4_000_000  # bytes of text encoded at a time
WINDOW = 200_000  # pieces a task packs at a time
GROUP = 50_000  # underfull bins a task merges at a time
SLACK = 32  # a bin with fewer free tokens is nearly full


class _Recent:
    """A bounded table: entries not used while half of it filled anew are forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        """Forgets the old half if the new one is full."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new

    def found(self, keys: list) -> list:
        """The value of each key, which is in the new half then, or None."""
        out = list(map(self.new.get, keys))
        if self.old:
            new, old = self.new, self.old
            for i in [i for i, x in enumerate(out) if x is None]:
                if (x := old.get(keys[i])) is not None:
                    out[i] = new[keys[i]] = x
        return out


# What a byte is: white space between words, a letter, a digit, a mark, or one that the table cannot tell.
_GAP, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[[10, 32]] = _GAP
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[39, 60]] = _ODD  # an apostrophe may begin 's or 't, and < a special token


def spans(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased pretokens of all texts, one after another, which of them are odd, and the place where each text's begin and the last's end.

    A word with an odd character is one span as it stands; others are the letters \xc0 to \xff and ASCII but
    for control characters, ' and <.
    """
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    kind, low = _KIND[raw], LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    tail = raw[lead + 1]
    letter = (tail & 0xC0 == 0x80) & (tail != 0x97) & (tail != 0xB7)
    lead, tail = lead[letter], tail[letter]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = np.where(tail < 0x9F, tail + 0x20, tail)
    solid, begins = kind != _GAP, np.zeros(len(raw), bool)
    begins[edges[edges < len(raw)]] = True
    cut = kind == _DIGIT
    cut |= begins
    cut[1:] |= kind[1:] != kind[:-1]
    strange = np.zeros(0, np.int64)
    if len(odd := np.flatnonzero(kind == _ODD)):
        begins[1:] |= ~solid[:-1]
        begins &= solid
        word = np.cumsum(begins, dtype=np.int32) - 1
        whole = np.zeros(len(raw) and int(word[-1]) + 1, bool)
        whole[word[odd]] = True
        mask = whole[word] & solid
        low[mask], cut[mask] = raw[mask], begins[mask]
        strange = np.flatnonzero(mask & begins)
    starts = np.flatnonzero(cut & solid)
    data = low[solid]
    offsets = np.append(np.flatnonzero(cut[solid]), len(data))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(starts, strange), np.searchsorted(starts, edges)


class WordEncoder:
    """Identifiers, as little-endian unsigned 32-bit bytes, of whole texts."""

    # Fixed: the pretokenizer pattern of the public vocabulary file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
    # Words of these characters alone are lower-cased and cut here just as the library does it.
    PLAIN = re.compile("[!-~\xa1-\xac\xae-\u012f\u0131-\u024f]+").fullmatch
    LETTERS, DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"

    def __init__(self, path: str, held: int = HELD):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.split = re.compile(self.PATTERN.replace("{L}", self.LETTERS).replace("{N}", self.DIGITS)).findall
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = _Recent(held)  # of pretokens and odd words: a pretoken is a word that is cut into itself

    def _learn(self, pretokens: list[str]) -> None:
        """Puts the identifiers of new pretokens into the table."""
        known = self.words.new
        for at in range(0, len(pretokens), 20_000):
            some = pretokens[at : at + 20_000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                raise RuntimeError("the vocabulary does not close every word")
            raw, a = ids.tobytes(), 0
            for p, b in zip(some, (4 * ends).tolist()):
                known[p] = raw[a:b]
                a = b

    def _learn_odd(self, words: list[str]) -> None:
        """Puts the identifiers of new words, in any characters, into the table."""
        plain, cut_word, known = self.PLAIN, self.split, self.words.new
        parts = {w: cut_word(w.lower()) for w in words if plain(w) and "<|" not in w}
        odd = [w for w in words if w not in parts]
        if odd:
            for w, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        pieces = list({p for x in parts.values() for p in x})
        self._learn([p for p, x in zip(pieces, self.words.found(pieces)) if x is None])
        for w, x in parts.items():
            if w not in known:
                known[w] = b"".join([known[p] for p in x])

    def __call__(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The identifiers of all texts, one after another, and the place where each text's begin and the last's end."""
        parts, odd, bounds = spans(texts)
        parts = parts.dictionary_encode()
        distinct, which = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        self.words.turn()
        found = self.words.found(distinct)
        if absent := [i for i, x in enumerate(found) if x is None]:
            strange = set(which[odd].tolist())
            self._learn([distinct[i] for i in absent if i not in strange])
            if strange:
                self._learn_odd([distinct[i] for i in absent if i in strange])
            known = self.words.new
            for i in absent:
                found[i] = known[distinct[i]]
        ids = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = (np.cumsum(n) - n)[which], n[which]
        ends = np.cumsum(n)
        at = np.repeat(first - ends + n, n)
        at += np.arange(len(at))
        return ids[at].tobytes(), np.append(0, ends)[bounds]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _forget() -> bool:
    held = bool(_encoders)
    _encoders.clear()
    return held


register_cache(_forget)


def encoder(path: str, held: int = HELD) -> WordEncoder:
    if (path, held) not in _encoders:
        _encoders[path, held] = WordEncoder(path, held)
    return _encoders[path, held]


def best_fit(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item in the order given, and the fill of each bin.

    Bins with the same free space form a stack; a bit set of the free spaces in use finds the
    tightest that fits.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fill, bins, offsets = 0, [], [], []
    for n in lengths:
        fits = open_ >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_ ^= 1 << free
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if rest := free - n:
            if not stacks[rest]:
                open_ |= 1 << rest
            stacks[rest].append(b)
    return bins, offsets, fill


def _packed(lengths: np.ndarray, ties: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_fit of the longest first, in the order of the input again: bin, offset, fill of the bin."""
    order = np.lexsort((ties, -lengths))
    bins, offsets, fill = best_fit(lengths[order].tolist(), capacity)
    bin_, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    bin_[order], offset[order] = bins, offsets
    return bin_, offset, np.array(fill, np.int64)[bin_]


def _slices(texts: pa.Array, most: int = SLICE):
    """Consecutive texts of about `most` bytes; a longer text is not cut."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield texts.slice(at, to - at)
        at, done = to, ends[to - 1]


def _tokenise_and_pack(path: str, capacity: int, end: int, held_words: int):
    closing = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, base = encoder(path, held_words), TaskContext.get().partitionId() << 36
        ids, held, windows = [], [], 0

        def emit():
            nonlocal ids, held, windows
            piece, start, length, crc = (np.array(x, np.int64) for x in zip(*held))
            bin_, offset, fill = _packed(length, np.arange(len(length)), capacity)
            columns = [piece.astype(np.int32), start, length, crc, base + (windows << 20) + bin_, offset, fill]
            windows += 1
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, columns)], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
            ids, held = [], []
            return out

        for batch in batches:
            at, rows = 0, []
            for part in _slices(pc.fill_null(batch.column(1), "")):
                data, bounds = encode(part)
                bounds = (4 * bounds).tolist()
                for first, last in zip(bounds, bounds[1:]):
                    raw = data[first:last] + closing
                    for piece, a in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[a : a + 4 * capacity]
                        held.append((piece, a // 4, len(cut) // 4, zlib.crc32(cut)))
                        rows.append(at)
                    at += 1
            ids.append(batch.column(0).take(pa.array(rows, pa.int64())))
            trim()
            if len(held) >= WINDOW:
                yield emit()
        if held:
            yield emit()

    return run


def _merge(capacity: int, depth: int):
    def run(batches):
        base = depth << 60 | TaskContext.get().partitionId() << 36
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        bins, fill = t["bin"].to_numpy(), t["fill"].to_numpy()
        into, shift, full = _packed(fill, bins, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(base + into), pa.array(shift), pa.array(full)], names=["bin", "into", "shift", "fill"])

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, text: str = "text", doc_id: str = "doc_id", held: int = HELD) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    path is the vocabulary file on each machine; `end` is appended to every document.
    `held` bounds the table of recurring words in a worker; the result does not depend on it.
    """
    id_type = dict(docs.dtypes)[doc_id]
    pieces = stored(docs.select(doc_id, text).mapInArrow(_tokenise_and_pack(path, capacity, end, held), f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint"), "packed-pieces")
    loose = pieces.where((F.col("offset") == 0) & (F.col("fill") <= capacity - SLACK)).select("bin", "fill")
    out, last, n = pieces.withColumn("sequence_id", F.col("bin")), 0, loose.count()
    for depth in range(1, 7):
        groups = -(-n // GROUP)
        if n < 2:
            break
        merged = stored(loose.repartition(groups, "bin").mapInArrow(_merge(capacity, depth), "bin bigint, into bigint, shift bigint, fill bigint"), f"packed-round{depth}")
        moves = merged.select(F.col("bin").alias("__bin"), F.col("into").alias("__into"), F.col("shift").alias("__shift"))
        out = out.join(moves, out.sequence_id == moves["__bin"], "left").withColumns({"sequence_id": F.coalesce("__into", "sequence_id"), "offset": F.col("offset") + F.coalesce("__shift", F.lit(0))}).drop("__bin", "__into", "__shift")
        loose = merged.where((F.col("shift") == 0) & (F.col("fill") <= capacity - SLACK)).select(F.col("into").alias("bin"), "fill")
        last, n = n, loose.count()
        if groups == 1 or n > 0.95 * last:
            break
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

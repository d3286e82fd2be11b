"""Approximate occurrences of benchmark passages in documents, by q-gram lemma filtering.

Texts become lower-case letters and digits with single spaces between. A passage of length n with
at most k edits shares n - q + 1 - k q of its q-grams with the place it occurs at, all within k
diagonals of each other. Shared q-grams are therefore counted in diagonal bands of 2 (k + 1), each
overlapping the next by half; bands that reach the bound, and lack no q-grams so apart that they need
more edits, are verified by a banded alignment of
the whole passage, its ends free in the text. k is 12 % of the length, less where the bound would
vanish; a passage shorter than q is sought exactly.

The passages are indexed in blocks of bounded size; every block goes over all documents once, so
neither the index nor a broadcast grows with the benchmark. Documents are not shuffled.

Cases: null, empty and letterless passages match nothing, as do such texts; a very long text is
searched whole, by itself; of places that take as many edits the first counts; passages that read the
same are sought once and reported under each id; rows that repeat an id are searched each; an
empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import codes, word_table
from .scan import SLICE, prefix, release, span_hash, trim

_U = np.uint64
Q = 7
EDITS = 0.12  # of a passage's length
HITS = 500_000  # shared q-grams handled at a time; a text with more goes alone
BLOCK = 2_000_000  # characters of passages indexed at a time


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points with runs of others as one 0; their places in the joined input; starts of texts."""
    raw, bounds = codes(texts)
    c = word_table()[raw]
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    keep[bounds[1:] - 1] = True  # one 0 at least between texts
    at = np.flatnonzero(keep)
    return c[at], at, np.searchsorted(at, bounds)


def budget(n: int, q: int = Q, edits: float = EDITS) -> tuple[int, int]:
    """The edits allowed to a passage of n characters, and the q-grams it must share then."""
    k = max(0, min(int(edits * n), (n - q) // q))
    return k, n - q + 1 - k * q


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The best place of the passage in the text that starts on a diagonal of low..high, as (edits, start, end).

    A banded alignment: row i holds cells i + low - k .. i + high + k. None if it takes over k edits.
    """
    base = low - k
    width = high - low + 2 * k + 1
    at = np.arange(width) + base
    big = k + 1
    cost = np.where((at >= 0) & (at <= len(text)) & (at >= low) & (at <= high), 0, big)
    start = at.copy()
    steps = np.arange(width)
    padded = np.concatenate((np.full(max(0, -base), 0xFFFFFFFF, np.uint32), text[max(0, base) :], np.full(len(passage) + width + 1, 0xFFFFFFFF, np.uint32)))
    for i, c in enumerate(passage.tolist()):
        best = cost + (padded[i : i + width] != c)  # the cell one up and one left is the same diagonal
        from_ = start
        skip = np.append(cost[1:], big) + 1  # a passage character without a partner
        take = skip < best
        best, from_ = np.where(take, skip, best), np.where(take, np.append(start[1:], 0), from_)
        low_run = np.minimum.accumulate(best - steps)  # text characters without a partner
        run = low_run + steps
        moved = run < best
        if moved.any():
            origin = np.maximum.accumulate(np.where(best - steps == low_run, steps, 0))
            from_ = np.where(moved, from_[origin], from_)
            best = run
        cost, start = np.minimum(best, big), from_
        if cost.min() > k:
            return None
    j = int(cost.argmin())
    return (int(cost[j]), int(start[j]), min(len(text), j + base + len(passage))) if cost[j] <= k else None


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    start = np.arange(max(0, len(c) - q + 1))
    return span_hash(prefix(c), start, start + q)


def least_edits(grams: np.ndarray, region: np.ndarray, q: int, k: int) -> int:
    """A lower bound, up to k + 1, of the edits that leave the passage with these q-grams in the region.

    Every q-gram that the region lacks holds an edit, and an edit lies in q successive q-grams at most.
    """
    lacks = (~np.isin(grams, gram_hashes(region, q))).tobytes()
    edits, at = 0, lacks.find(1)
    while at >= 0 and edits <= k:
        edits, at = edits + 1, lacks.find(1, at + q)
    return edits


class PassageIndex:
    """The q-grams of a block of passages."""

    def __init__(self, ids: list, texts: list[str]):
        self.passages: list[np.ndarray] = []
        self.ids: list[list] = []
        seen: dict[bytes, int] = {}
        c, _, first = normal(texts)
        for item, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()):
            p = c[a:b]
            some = np.flatnonzero(p)
            if not len(some):
                continue
            p = p[some[0] : some[-1] + 1].copy()
            n = seen.setdefault(p.tobytes(), len(self.passages))
            if n == len(self.passages):
                self.passages.append(p)
                self.ids.append([])
            self.ids[n].append(item)
        self.tables = {}
        for q in sorted({min(Q, len(p)) for p in self.passages}):
            own = [i for i, p in enumerate(self.passages) if min(Q, len(p)) == q]
            hashes, item, offset = [], [], []
            for i in own:
                starts = np.arange(len(self.passages[i]) - q + 1)
                hashes.append(span_hash(prefix(self.passages[i]), starts, starts + q))
                item.append(np.full(len(starts), i))
                offset.append(starts)
            h, item, offset = np.concatenate(hashes), np.concatenate(item), np.concatenate(offset)
            order = np.argsort(h, kind="stable")
            bits = max(20, int(len(h) * 16 - 1).bit_length())
            marks = np.zeros(1 << bits, bool)
            marks[(h >> _U(64 - bits)).astype(np.int64)] = True
            self.tables[q] = (h[order], item[order], offset[order], marks, bits)
        self.k, self.need = (np.array(x, np.int64) for x in zip(*(budget(len(p), min(Q, len(p))) for p in self.passages))) if self.passages else (np.zeros(0, np.int64),) * 2

    def grams(self, passage: int) -> np.ndarray:
        p = self.passages[passage]
        return gram_hashes(p, min(Q, len(p)))

    def candidates(self, c: np.ndarray, first: np.ndarray):
        """(text, passage, band) of all bands that reach the bound; first has the starts of texts in c."""
        sums = prefix(c)
        for q, (hashes, item, offset, marks, bits) in self.tables.items():
            if len(c) < q:
                continue
            start = np.arange(len(c) - q + 1)
            h = span_hash(sums, start, start + q)
            near = np.flatnonzero(marks[(h >> _U(64 - bits)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, h[near]), np.searchsorted(hashes, h[near], "right")
            near, n, lo = near[hi > lo], (hi - lo)[hi > lo], lo[hi > lo]
            if not len(near):
                continue
            text = np.searchsorted(first, near, "right") - 1
            # The hits of some whole texts at a time: common q-grams stand in many passages.
            ends = np.flatnonzero(np.diff(text, append=-1)) + 1
            sums_n = np.cumsum(n)
            x = 0
            while x < len(near):
                limit = np.searchsorted(sums_n[ends - 1], (sums_n[x - 1] if x else 0) + HITS, "right")
                y = int(ends[max(limit - 1, np.searchsorted(ends, x, "right"))])
                yield from self._bands(near[x:y], n[x:y], lo[x:y], text[x:y], first, item, offset, q)
                x = y

    def _bands(self, near, n, lo, text, first, item, offset, q):
        """The bands that reach the bound, of q-grams at `near` with n hits each from lo on."""
        inside = near + q <= first[text + 1]
        near, n, lo, text = near[inside], n[inside], lo[inside], text[inside]
        if not len(near):
            return
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        passage = item[which]
        band = np.floor_divide(np.repeat(near - first[text], n) - offset[which], self.k[passage] + 1)
        low, t0 = int(band.min()) - 1, int(text[0])
        width = int(band.max()) - low + 1
        key = (np.repeat(text - t0, n) * len(self.passages) + passage) * width + (band - low)
        key = np.concatenate((key, key - 1))
        key.sort()
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count, key = np.diff(np.append(head, len(key))), key[head]
        pair, band = np.divmod(key, width)
        text, passage = np.divmod(pair, len(self.passages))
        enough = count >= self.need[passage]
        yield from zip((text[enough] + t0).tolist(), passage[enough].tolist(), (band[enough] + low).tolist())

    def search(self, texts: list[str]):
        """(text, passage, start, end, edits) of all occurrences, in code points of the text; overlapping ones are reported once."""
        c, at, first = normal(texts)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        last = None
        for text, passage, band in self.candidates(c, first):
            own = c[first[text] : first[text + 1]]
            k, p = int(self.k[passage]), self.passages[passage]
            low, high = band * (k + 1), (band + 2) * (k + 1) - 1
            done = last[2] if last and last[:2] == (text, passage) else 0
            low = max(low, done)  # a start further left is the neighbouring band's occurrence
            if low > high:
                continue
            a, b = max(0, low - k, done), min(len(own), high + len(p) + k)
            where = own[a:b].tobytes().find(p.tobytes())
            while where >= 0 and where % 4:
                where = own[a:b].tobytes().find(p.tobytes(), where + 1)
            if where >= 0:
                found = 0, a + where // 4, a + where // 4 + len(p)
            else:
                found = align(p, own, low, high, k) if least_edits(self.grams(passage), own[a:b], min(Q, len(p)), k) <= k else None
            if found:
                edits, x, y = found
                x, y = max(0, x), max(x + 1, y)
                last = (text, passage, y)
                place = at[first[text] : first[text + 1]] - starts[text]
                yield text, passage, int(place[x]), int(place[min(y, len(place)) - 1]) + 1, edits


def _parts(texts: list[str]):
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > SLICE:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _indexes(benchmark: DataFrame, item_text: str, item_id: str, block: int):
    """Broadcast indexes of the passages, each over about `block` characters."""
    passages = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, -(-int(passages.agg(F.sum(F.length("t"))).first()[0] or 0) // block))
    for n in range(blocks):
        mine = passages.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).sort("i", "t").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(PassageIndex(mine["i"].to_pylist(), mine["t"].to_pylist()))


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block: int = BLOCK) -> DataFrame:
    """One row for each occurrence: doc_id, item_id, start and end (code points of the text) and edits."""
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(benchmark.dtypes)[item_id]}, start bigint, `end` bigint, edits int"
    item_kind = benchmark.select(item_id).limit(0).toArrow().schema.field(0).type
    out = []
    for index in _indexes(benchmark, item_text, item_id, block):

        def run(batches, index=index):
            release()
            for batch in batches:
                rows = []
                for at, part in _parts([t or "" for t in batch.column(1).to_pylist()]):
                    for i, passage, a, b, edits in index.value.search(part):
                        rows += [(at + i, item, a, b, edits) for item in index.value.ids[passage]]
                where, items, a, b, edits = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(items, item_kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "start", "end", "edits"])
                trim()

        out.append(docs.select(doc_id, text).mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", block: int = BLOCK) -> DataFrame:
    """The rows of docs, with their columns, in which no passage occurs."""
    source = docs.columns.index(text)
    for index in _indexes(benchmark, item_text, item_id, block):

        def run(batches, index=index):
            release()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, part in _parts([t or "" for t in batch.column(source).to_pylist()]):
                    clean[[at + hit[0] for hit in index.value.search(part)]] = False
                yield batch.filter(pa.array(clean))
                trim()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

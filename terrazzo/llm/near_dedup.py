"""Near-duplicate groups by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word windows (A-Z lowered). A window of multiplicity w holds the
weights (0, w], cut into dyadic blocks (0,1], (1,2], (2,4], ... Each block carries a Poisson process
whose rate is its width and whose points have a level inside the block and a register; points above
w do not count. A register keeps its earliest point, so two texts agree in a register with the
probability of their weighted Jaccard similarity, without bias. All windows of a text run only up
to the time by which its registers fill; a text with a register left empty runs on to twice that.

Texts with the same words fall together first, by a 128-bit key. One text of each then enters the
bands. Of the texts that share a bucket, those settle first that cannot have a link at all: a text
whose windows known to other candidates are too few for the similarity leaves its buckets. In a
bucket all texts are then compared with one centre, not with each other. Where different components
remain, the texts outside a bucket's commonest component are compared with a few of that component,
and at last with all texts of the bucket in other components, by rounds of so many for each bucket.
A pair is compared if its counts of shared windows and its signatures (a byte of each register)
allow the similarity; the latter rule out a pair of just that similarity once in ten million.
So every pair in every bucket is compared, ruled out, or joined by other links. Comparisons count
the whole multisets, a centre's against a bounded group of other texts. Components are taken over
all links.

Large buckets are salted: minima and counts of a bucket are combined before they are shuffled, and
come back to its texts over several keys, by the bucket's number of texts and bytes.

Cases: null, empty and wordless texts and rows without an id are alone in their class; a text of
fewer than five words is one window of all its words; very long texts are compared whole; rows that
repeat an id form one document, which stands with the text of the least key, whatever their texts;
ties fall to the least id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scan import Joined, mix, owner, release, shingles, text_slices, utf8
from .shared import exchange, pack_counts, pack_keys, parts_by_shard, parts_for, partitions, places, remove, sieved, stored, text_bytes, unpack_counts, unpack_keys

_U = np.uint64
REGISTERS, ROWS = 96, 4  # 24 bands of 4: a pair of similarity 0.8 is missed with probability 3e-6
WIDTH, SIMILARITY = 5, 0.8
FEW, CENTRES = 8, 256  # texts of a bucket compared in the middle round, and in each last round
PASSES = 2  # over the candidates, to settle texts without possible links
BLOCK = 12 << 20  # bytes of text for each block, and for each shard
SALT_ROWS, SALT_BYTES = 128, 4 << 20  # of a bucket under one key
GROUP = 8 << 20  # bytes of text compared in one task
RULED_OUT = 1e-7  # chance that the signatures of a pair of just the similarity rule it out


def bags(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of every text, sorted, with their multiplicities and `first`; and each text's two key words."""
    joined = Joined(texts, lower=True)
    start, end, first = joined.words()
    h = joined.hashes(start, end)
    windows, _, begin = shingles(h, first, width)
    of = owner(begin)
    order = np.lexsort((windows, of))
    windows, of = windows[order], of[order]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (windows[1:] != windows[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(windows)))
    # Sums over words, each mixed with its place: the key of the word sequence.
    place = (np.arange(len(h)) - first[owner(first)]).astype(_U)
    keys = np.zeros((len(texts), 2), _U)
    some = np.flatnonzero(np.diff(first))
    for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(some):
            keys[some, i] = np.add.reduceat(mix(h ^ mix(place + _U(salt))), first[some])
    return windows[head], n, np.searchsorted(head, begin), keys


def signatures(windows: np.ndarray, weight: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers (times of earliest points) of texts that have at least one window."""
    texts = len(first) - 1
    out = np.full((texts, registers), np.inf)
    total = np.add.reduceat(weight, first[:-1]) if texts else np.zeros(0)
    until = registers * (np.log(registers) + 3.0) / np.maximum(total, 1)
    left = np.ones(texts, bool)
    of = owner(first)
    while left.any():
        pick = left[of]
        h, w, doc = windows[pick], weight[pick], of[pick]
        parts = []
        block, low = 0, 0
        while len(h):  # the dyadic blocks that reach below w
            width = max(1, low)
            parts.append((mix(h + _U(block * 0x9FB21C651E98DF25 & (2**64 - 1))), np.full(len(h), width), np.full(len(h), low), w, doc))
            low, block = low + width, block + 1
            more = w > low
            h, w, doc = h[more], w[more], doc[more]
        seed, width, low, w, doc = (np.concatenate(x) for x in zip(*parts))
        time = np.zeros(len(seed))
        flat, step = np.full(texts * registers, np.inf), 0
        while len(seed):
            r = mix(seed + _U(step * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            time = time - np.log(((r >> _U(11)).astype(float) + 0.5) * 2.0**-53) / width
            live = time < until[doc]
            if not live.all():
                seed, width, low, w, doc, time, r = seed[live], width[live], low[live], w[live], doc[live], time[live], r[live]
            r = mix(r ^ _U(0x6A09E667F3BCC909))
            level = low + (((r & _U(0xFFFFFFFF)) * width.astype(_U)) >> _U(32)).astype(np.int64)
            counts = level < w
            at = doc * registers + (((r >> _U(32)) * _U(registers)) >> _U(32)).astype(np.int64)
            np.minimum.at(flat, at[counts], time[counts])
            step += 1
        flat = flat.reshape(texts, registers)
        done = left & np.isfinite(flat).all(1)
        out[done] = flat[done]
        left &= ~done
        until = np.where(left, until * 2, until)
    return out


def band_keys(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    bits = np.ascontiguousarray(registers).view(_U).reshape(len(registers), -1, rows)
    key = np.zeros(bits.shape[:2], _U)
    for i in range(rows):
        key = mix(key * _U(0xD1342543DE82EF95) + bits[:, :, i])
    return mix(key + np.arange(bits.shape[1]).astype(_U) * _U(0x9E3779B97F4A7C15))


def short_registers(registers: np.ndarray) -> np.ndarray:
    """A byte of each register, eight to a 64-bit number."""
    return np.ascontiguousarray(mix(registers.view(_U)).astype(np.uint8)).view(np.int64)


def least_matches(similarity: float, registers: int = REGISTERS, chance: float = RULED_OUT) -> int:
    """The most registers that a pair of the similarity has in common, but for the chance."""
    below = 0.0
    for k in range(registers + 1):
        below += math.comb(registers, k) * similarity**k * (1 - similarity) ** (registers - k)
        if below > chance:
            return k
    return registers


def matches(a: str, b: str, registers: int = REGISTERS):
    """How many bytes two columns of short registers have in common."""
    differ = F.lit(0)
    for i in range(registers // 8):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (4, 2, 1):  # the lowest bit of each byte gathers all of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(registers) - differ


def _sketch(batches):
    for batch in batches:
        size = batch.num_rows
        keys, total, length = np.zeros((size, 2), _U), np.zeros(size, np.int64), np.zeros(size, np.int64)
        bands, short = np.zeros((size, REGISTERS // ROWS), _U), np.zeros((size, REGISTERS // 8), np.int64)
        small = []

        def sign(rows, windows, n, sizes):
            registers = signatures(windows, n, np.concatenate(([0], np.cumsum(sizes))))
            bands[rows], short[rows] = band_keys(registers), short_registers(registers)

        for at, texts in text_slices(batch.column(1)):
            windows, n, first, key = bags(texts)
            rows = np.arange(at, at + len(texts))
            keys[rows], length[rows] = key, [len(t) for t in texts]
            sums = np.concatenate(([0], np.cumsum(n)))
            total[rows] = sums[first[1:]] - sums[first[:-1]]
            # short texts take many steps, so those of a whole batch go together
            for few in (True, False):
                chosen = np.flatnonzero((total[rows] > 0) & ((total[rows] < 64) == few))
                if not len(chosen):
                    continue
                pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
                got = rows[chosen], windows[pick], n[pick], np.diff(first)[chosen]
                if few:
                    small.append(got)
                else:
                    sign(*got)
        if small:
            sign(*(np.concatenate(x) for x in zip(*small)))
        lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), batch.column(2), pa.array(total), pa.array(length),
            lists(bands.view(np.int64)), lists(short),
        ], names=["id", "k1", "k2", "t", "windows", "b", "bands", "sig"])


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two multisets (sorted distinct windows, multiplicities)."""
    x, y = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(x[0]):
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    same = y[0][at] == x[0]
    return int(np.minimum(x[1][same], y[1][at[same]]).sum())


def _verify(similarity: float):
    def run(members: pa.Table, centres: pa.Table) -> pa.Table:
        """The links of texts with their centres; members has (c, rep, text), centres (c_c, c_text)."""
        text_of = dict(zip(centres["c_c"].to_pylist(), utf8(centres["c_text"])))
        members = members.sort_by("c")
        wanted, keep, held, centre = members["c"].to_pylist(), np.zeros(members.num_rows, bool), None, None
        for at, texts in text_slices(members["text"]):
            windows, n, first, _ = bags(texts)
            sums = np.concatenate(([0], np.cumsum(n)))
            for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), at):
                if centre is None or wanted[i] != held:
                    held = wanted[i]
                    centre = bags([text_of[held]])[:2]
                    total = int(centre[1].sum())
                mine = int(sums[y] - sums[x])
                if min(mine, total) >= similarity * max(mine, total) - 1e-9:
                    both = overlaps(centre, (windows[x:y], n[x:y]))
                    keep[i] = both > 0 and both >= similarity * (mine + total - both) - 1e-9
        members = members.select(["c", "rep"]).filter(pa.array(keep))
        return members.rename_columns(["a", "b"])

    return run


def _ask(shards: int):
    """The distinct windows of a block, with the number of its texts that hold each."""

    def request(table: pa.Table) -> pa.Table:
        found = [bags(texts)[0] for _, texts in text_slices(table["text"])]
        keys, n = np.unique(np.concatenate([np.zeros(0, _U), *found]), return_counts=True)
        (asked, bounds), block = parts_by_shard(keys, shards), table["__block"][0].as_py()
        parts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return pa.table({
            "__block": pa.array([block] * len(parts), pa.int32()), "shard": pa.array(asked.astype(np.int32)),
            "keys": pa.array([pack_keys(keys[x:y]) for x, y in parts], pa.binary()), "n": pa.array([pack_counts(n[x:y]) for x, y in parts], pa.binary()),
        })

    return request


def _tell(table: pa.Table) -> pa.Table:
    """For each window that a block asked for, whether two texts or more hold it."""
    keys = [unpack_keys(x) for x in table["keys"].to_pylist()]
    n = [unpack_counts(x, len(k)) for x, k in zip(table["n"].to_pylist(), keys)]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(inverse, np.concatenate(n), len(unique)) > 1
    parts = np.split(shared[inverse], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"__block": table["__block"], "shard": table["shard"], "shared": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})


def _support(shards: int):
    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        """The windows of each text, and those of them that another text holds, with multiplicity."""
        got = [bags(texts)[:3] for _, texts in text_slices(table["text"])]
        keys = np.unique(np.concatenate([np.zeros(0, _U), *(w for w, _, _ in got)]))
        told = told.sort_by("shard")
        parts = zip(told["shared"].to_pylist(), *places(keys, told["shard"].to_numpy(), shards))
        shared = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(x, np.uint8), count=int(b - a)) for x, a, b in parts)])
        n, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for windows, count, first in got:
            known = count * shared[np.searchsorted(keys, windows)]
            for out, x in ((n, count), (held, known)):
                sums = np.concatenate(([0], np.cumsum(x)))
                out.append(sums[first[1:]] - sums[first[:-1]])
        return pa.table({"rep": table["id"], "n": pa.array(np.concatenate(n), pa.int64()), "s": pa.array(np.concatenate(held).astype(np.int64), pa.int64())})

    return finish


def _by_bucket(state: DataFrame, *sums) -> DataFrame:
    """One row for each bucket, with its salts."""
    return state.groupBy("key").agg(F.max("salts").alias("salts"), *sums)


def _to_members(state: DataFrame, buckets: DataFrame) -> DataFrame:
    """The columns of buckets (key, salts, ...) beside each row of state; a large bucket is met under several keys."""
    rest = [c for c in buckets.columns if c not in ("key", "salts")]
    wide = buckets.select(F.col("key").alias("__key"), *rest, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("__salt"))
    salt = F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")
    return state.join(wide, (F.col("key") == F.col("__key")) & (salt == F.col("__salt"))).drop("__key", "__salt")


def _open(state: DataFrame) -> DataFrame:
    """The rows of buckets that still hold more than one component."""
    return _to_members(state, _by_bucket(state, F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).where("__lo < __hi").drop("__lo", "__hi"))


def _first(state: DataFrame, k: int) -> DataFrame:
    """k rows of each bucket, by a hash of their ids; each task passes on k rows of a bucket at most."""
    w = Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep")
    return state.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def _needed(texts: DataFrame, state: DataFrame) -> DataFrame:
    """The texts (id, text) that still have rows in state; the table given goes."""
    made = stored(texts.join(state.select(F.col("rep").alias("__rep")), F.col("id") == F.col("__rep"), "left_semi"), "texts")
    remove(texts)
    return made


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the least id of its class), n_compared_links and kept.

    n_compared_links counts the links found between the document's text and those it was compared with;
    it is no degree, as most pairs of a class are not compared. kept is true for the document that stands
    for its class.
    """
    id_type, spark = dict(docs.dtypes)[doc_id], docs.sparkSession
    kept = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    given = kept.where("id is not null and text is not null")
    sketch = given.withColumn("t", F.xxhash64("text")).mapInArrow(_sketch, f"id {id_type}, k1 bigint, k2 bigint, t bigint, windows bigint, b bigint, bands array<bigint>, sig array<bigint>").where("windows > 0")
    least = sketch.groupBy("id").agg(F.min(F.struct("k1", "k2", "t", "b", "bands", "sig")).alias("k"), F.count("*").alias("rows"))  # an id that repeats stands once, with one of its texts
    sketch = stored(least.select("id", "k.*", "rows"), "sketches")
    single = sketch.select("id", "k1", "k2")
    repeats = sketch.where("rows > 1").select(F.col("id").alias("__id"), F.col("t").alias("__t"))
    same = stored(sketch.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "same")
    rows = sketch.join(same.select(F.col("rep").alias("__rep")), F.col("id") == F.col("__rep"), "left_semi").select(F.col("id").alias("rep"), "b", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("b").alias("b")).where("n > 1")
    salts = F.ceil(F.greatest(F.col("n") / SALT_ROWS, F.col("b") / SALT_BYTES)).cast("int")
    full = stored(full.select(F.col("key").alias("__key"), salts.alias("salts")), "full")
    buckets = stored(rows.join(full, rows.key == full["__key"]).select("rep", "key", "salts"), "buckets")
    remove(full)
    texts = sieved(given, "id", buckets, "rep").where("__may").drop("__may")  # most texts are no candidates and stay where they are
    texts = texts.join(buckets.select(F.col("rep").alias("__rep")), F.col("id") == F.col("__rep"), "left_semi")
    texts = texts.join(repeats, F.col("id") == F.col("__id"), "left").where(F.col("__t").isNull() | (F.xxhash64("text") == F.col("__t")))
    texts = stored(texts.groupBy("id").agg(F.min("text").alias("text")), "candidates")

    def possible(s, n, m):
        """Whether texts of n and m windows with at most s in common can be similar enough."""
        return s >= similarity * (n + m - s) - 1e-9

    least = F.greatest(F.col("__m"), F.col("s"), F.lit(similarity) * F.col("n"))  # windows that a partner has at least
    about = sketch.select(F.col("id").alias("__id"), "b", "bands", "sig")
    state = buckets
    for _ in range(PASSES):  # what goes in one pass leaves others without company in the next
        shards = parts_for(spark, text_bytes(texts, "text"), BLOCK)
        support = exchange(
            texts, F.col("id"), shards, shards, _ask(shards), "__block int, shard int, keys binary, n binary",
            _tell, "__block int, shard int, shared binary", _support(shards), f"rep {id_type}, n bigint, s bigint",
        ).select(F.col("rep").alias("__rep"), "n", "s")
        known = stored(state.select("rep", "key", "salts").join(support, F.col("rep") == F.col("__rep")).drop("__rep"), "known")
        near = _to_members(known, _by_bucket(known, F.min("n").alias("__m"))).where(possible(F.col("s"), F.col("n"), least)).drop("__m")
        near = stored(near.withColumn("comp", F.col("rep")), "near")
        last, state = state, stored(_open(near), "state")
        remove(last, known, near)
        texts = _needed(texts, state)

    about = sieved(about, "__id", state, "rep").where("__may").drop("__may")
    last, state = state, stored(state.join(about, F.col("rep") == F.col("__id")).drop("__id"), "state")
    remove(last)
    joined = links = None
    enough, turn = least_matches(similarity), 0  # turns: one centre; outsiders with a few of the commonest component; then CENTRES at a time
    while not state.isEmpty():
        members, others = state, state
        if turn == 0:
            centres = _first(state, 1)
        else:
            sizes = state.groupBy("key", "comp").agg(F.max("salts").alias("salts"), F.count("*").alias("__n"))
            ranked = stored(_to_members(state, _by_bucket(sizes, F.max(F.struct("__n", "comp"))["comp"].alias("__top"))), "ranked")
            rare = F.col("comp") != F.col("__top")
            members, others = (ranked.where(rare), ranked.where(~rare)) if turn == 1 else (ranked, ranked.where(rare))
            centres = _first(others.drop("__top"), FEW if turn == 1 else CENTRES)
        centres = stored(centres, "centres")
        met = _to_members(members, centres.select("key", "salts", F.col("rep").alias("c"), F.col("salts").alias("cut"), *(F.col(x).alias(f"c_{x}") for x in ("comp", "n", "s", "b", "bands", "sig"))))
        met = met.where((F.col("comp") != F.col("c_comp")) & possible(F.least("s", "c_s"), F.col("n"), F.col("c_n")) & (matches("sig", "c_sig") >= enough))
        if turn > 1:  # a pair in several buckets counts in the first
            met = met.where(F.element_at(F.array_intersect("bands", "c_bands"), 1) == F.col("key"))
        pair = met.select(F.least("c", "rep").alias("__a"), F.greatest("c", "rep").alias("__b"), "c", "rep", F.struct("c", "rep", "cut", "b", "c_b").alias("p"))
        pairs = stored(pair.groupBy("__a", "__b").agg(F.max("p").alias("p")).select("p.*"), "pairs")
        size = pairs.agg(F.sum(F.col("b") + F.col("c_b")).alias("b")).first()["b"] or 0
        groups = parts_for(spark, size, GROUP)
        group = F.pmod(F.xxhash64("c", F.pmod(F.xxhash64("rep"), F.col("cut"))), F.lit(groups)).cast("int")
        pairs_g = pairs.select("c", "rep", group.alias("g"))
        text_of = texts.select(F.col("id").alias("__id"), "text")
        left = pairs_g.join(text_of, F.col("rep") == F.col("__id")).select("g", "c", "rep", "text").repartitionById(groups, F.col("g"))
        right = pairs_g.select("g", "c").distinct().join(text_of, F.col("c") == F.col("__id"))
        right = right.select(*(F.col(x).alias(f"c_{x}") for x in ("g", "c", "text"))).repartitionById(groups, F.col("c_g"))
        found = stored(left.groupBy("g").cogroup(right.groupBy("c_g")).applyInArrow(_verify(similarity), f"a {id_type}, b {id_type}"), "verified")
        links = found if links is None else links.union(found)
        before, joined = joined, components(found if joined is None else joined.union(found))
        rest = state
        if turn != 1:  # these centres are done with all of their buckets: they retire
            gone = centres.select(F.col("key").alias("__key"), F.col("rep").alias("__rep"))
            rest = rest.join(gone, (F.col("key") == F.col("__key")) & (F.col("rep") == F.col("__rep")), "left_anti")
        rest = rest.drop("comp").join(joined.select(F.col("a").alias("__a"), F.col("b").alias("__b")), F.col("rep") == F.col("__a"), "left").withColumn("comp", F.coalesce("__b", "rep")).drop("__a", "__b")
        rest = stored(rest, "rest")
        last, state = state, stored(_open(rest), "state")
        remove(last, rest, pairs, centres, before, *([ranked] if turn else []))
        texts = _needed(texts, state)
        turn += 1

    remove(texts, state)
    if joined is None:
        classes = same.select("k1", "k2", F.col("rep").alias("class_id"), F.lit(0).cast("bigint").alias("n"))
    else:
        counts = links.distinct().select(F.explode(F.array("a", "b")).alias("__l")).groupBy("__l").agg(F.count("*").alias("n"))
        of = joined.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
        classes = same.join(of, F.col("rep") == F.col("__a"), "left").join(counts, F.col("rep") == F.col("__l"), "left")
        classes = stored(classes.select("k1", "k2", F.coalesce("__b", "rep").alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")), "classes")
    classes = classes.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "class_id", "n")
    member = single.join(classes, (single.k1 == F.col("__k1")) & (single.k2 == F.col("__k2"))).select(F.col("id").alias("__id"), "class_id", "n")
    ids = kept.select("id")
    return ids.join(member, ids.id == member["__id"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_compared_links"), F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Deleted-interpolation bigram language model, counted over the whole training corpus.

Blocks of documents send their distinct unigrams and bigrams once, with the block's training
counts, to the shard of each hash; shards add up and answer with corpus counts. The counts of all
tokens are then stored with their documents. Mixture weights of the uniform, unigram and bigram
maximum-likelihood estimates are set for each bucket of context frequency (powers of two) by
expectation-maximisation on deleted counts: every training token is held out in turn, so its own
occurrence is taken from the counts that predict it. The estimates enter the maximisation through
a histogram whose size is bounded by its grid.

Cases: a null or empty text is one end token; rows without an id are scored but not learned from;
rows that repeat an id are each counted and scored; rows of equal texts have equal scores; a very
long text is counted whole, within one block; an empty training side gives scores from the uniform
estimate alone, an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Joined, mix, owner, text_slices
from .shared import exchange, pack_counts, pack_keys, parts_for, places, remainder, shard_of, stored, text_bytes, unpack_counts, unpack_keys

_U = np.uint64
_END = _U(0x1E0F3A5C7B9D2468)  # no word: the end of a text
_START = _U(0x2468ACE013579BDF)
STEP = 4  # histogram steps for each factor of two of a probability
BLOCK = 24 << 20  # bytes of text for each block, and for each shard
_GRID = 64 * STEP  # smallest probability 2**-64; one more step stands for zero


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words, then one end each), and `first` by text."""
    joined = Joined(texts, lower=True)
    start, end, first = joined.words()
    out = np.full(len(start) + len(texts), _END, _U)
    out[np.arange(len(start)) + owner(first)] = joined.hashes(start, end)
    return out, first + np.arange(len(first))


def _block_tokens(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram and bigram hashes of a block's tokens, and `first` by document."""
    parts, sizes = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for _, texts in text_slices(table[text]):
        h, first = _tokens(texts)
        parts.append(h)
        sizes.append(np.diff(first))
    h, first = np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = _START
    return h, mix(before * _U(0xA24BAED4963EE407) + h), first


def _request(text: str, train: str, shards: int):
    def request(table: pa.Table) -> pa.Table:
        one, two, first = _block_tokens(table, text)
        learn = np.repeat(table[train].to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        found = []
        for h in (one, two):
            keys, inverse = np.unique(h, return_inverse=True)
            found.append((keys, np.bincount(inverse[learn], minlength=len(keys))))
        asked = np.union1d(*(shard_of(keys, shards) for keys, _ in found))
        made = {"__block": pa.array([table["__block"][0].as_py()] * len(asked), pa.int32()), "shard": pa.array(asked.astype(np.int32))}
        for kind, (keys, counts) in zip("12", found):
            lo, hi = places(keys, asked, shards)
            made["keys" + kind] = pa.array([pack_keys(keys[a:b]) for a, b in zip(lo, hi)], pa.binary())
            made["n" + kind] = pa.array([pack_counts(counts[a:b]) for a, b in zip(lo, hi)], pa.binary())
        return pa.table(made)

    return request


def _answer(blocks: int):
    def answer(table: pa.Table) -> pa.Table:
        """The corpus counts of the keys each block asked for, and a row of the shard's sums, sent to some block."""
        shard, n = table["shard"][0].as_py(), table.num_rows
        made, total, distinct = {}, 0, 0
        for kind in ("1", "2"):
            keys = [unpack_keys(x) for x in table["keys" + kind].to_pylist()]
            counts = [unpack_counts(x, len(k)) for x, k in zip(table["n" + kind].to_pylist(), keys)]
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            every = np.bincount(inverse, np.concatenate(counts), len(unique)).astype(np.int64)
            if kind == "1":
                total, distinct = int(every.sum()), int((every > 0).sum())
            edges = np.cumsum([len(k) for k in keys])[:-1]
            made["n" + kind] = pa.array([*(pack_counts(every[i]) for i in np.split(inverse, edges)), None], pa.binary())
        return pa.table({
            "__block": pa.array([*table["__block"].to_pylist(), shard % blocks], pa.int32()), "shard": pa.array([shard] * (n + 1), pa.int32()), **made,
            "total": pa.array([None] * n + [total], pa.int64()), "distinct": pa.array([None] * n + [distinct], pa.int64()),
        })

    return answer


def _bytes_of(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest: its width, then the numbers."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _counts_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _finish(text: str, doc_id: str, shards: int):
    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        sums = told.filter(told["total"].is_valid())
        told = told.filter(told["total"].is_null()).sort_by("shard")
        asked = told["shard"].to_numpy()
        one, two, first = _block_tokens(table, text)
        corpus = []
        for name, h in (("n1", one), ("n2", two)):
            keys, inverse = np.unique(h, return_inverse=True)
            counts = [unpack_counts(x, int(b - a)) for x, a, b in zip(told[name].to_pylist(), *places(keys, asked, shards))]
            corpus.append(np.concatenate([np.zeros(0, np.int64), *counts])[inverse])
        n = table.num_rows
        cuts = list(zip(first[:-1].tolist(), first[1:].tolist()))
        made = pa.table({
            "doc_id": table[doc_id], "held_out": table["__held_out"], "train": table["__train"],
            "c1": pa.array([_bytes_of(corpus[0][a:b]) for a, b in cuts], pa.binary()),
            "c2": pa.array([_bytes_of(corpus[1][a:b]) for a, b in cuts], pa.binary()),
            "total": pa.nulls(n, pa.int64()), "distinct": pa.nulls(n, pa.int64()),
        })
        rest = [pa.nulls(sums.num_rows, made.schema.field(c).type) for c in ("doc_id", "held_out", "train", "c1", "c2")]
        return pa.concat_tables([made, pa.table([*rest, sums["total"], sums["distinct"]], schema=made.schema)])

    return finish


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count)); the count is that of the whole training side."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _contexts(c1: list[np.ndarray], docs: int) -> np.ndarray:
    """Training counts of the token before each token; a text's first follows the start."""
    return np.concatenate([np.concatenate(([docs], c[:-1])) for c in c1])


def _step(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log2(np.maximum(p, 1e-300)) * STEP), _GRID - 1), _GRID).astype(np.int64)


def _histogram(batches, docs: int, total: int):
    cells: dict[int, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            if not part.num_rows:
                continue
            c1 = [_counts_of(x) for x in part["c1"].to_pylist()]
            c2, context = np.concatenate([_counts_of(x) for x in part["c2"].to_pylist()]), _contexts(c1, docs)
            p1 = np.maximum(np.concatenate(c1) - 1, 0) / max(1, total - 1)
            p2 = np.where(context > 1, np.maximum(c2 - 1, 0) / np.maximum(context - 1, 1), 0.0)
            cell = (bucket_of(context) * (_GRID + 1) + _step(p1)) * (_GRID + 1) + _step(p2)
            for k, n in zip(*(x.tolist() for x in np.unique(cell, return_counts=True))):
                cells[k] = cells.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(cells.keys()), pa.int64()), pa.array(list(cells.values()), pa.int64())], names=["cell", "n"])


def weights_by_em(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) for each context bucket 0..65.

    A bucket without training tokens has the weights of all tokens together; after a context never
    seen the bigram's share goes to the other two.
    """
    step = lambda s: np.where(s < _GRID, 2.0 ** (-s / STEP), 0.0)
    p = np.stack([np.full(len(cells), uniform), step(cells // (_GRID + 1) % (_GRID + 1)), step(cells % (_GRID + 1))], 1)
    bucket = cells // (_GRID + 1) ** 2

    def learned(mine, w):
        q, m = p[mine], n[mine].astype(float)
        w = w * (q.sum(0) > 0)
        w = w / w.sum() if w.sum() > 0 else np.array([1.0, 0.0, 0.0])
        for _ in range(rounds if len(q) else 0):
            joint = q * w
            share = (joint / np.maximum(joint.sum(1, keepdims=True), 1e-300) * m[:, None]).sum(0)
            w = (share + np.array([0.5, 0.0, 0.0])) / (share.sum() + 0.5)  # the uniform share never vanishes
        return w

    whole = learned(slice(None), np.array([0.2, 0.4, 0.4]))
    out = np.tile(whole, (66, 1))
    out[0] = whole * [1, 1, 0] / whole[:2].sum()
    for b in np.unique(bucket).tolist():
        out[b] = learned(bucket == b, whole)
    return out


def _scores(batches, docs: int, total: int, distinct: int, weights: np.ndarray):
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            if not part.num_rows:
                continue
            lists = [_counts_of(x) for x in part["c1"].to_pylist()]
            c1, c2, context = np.concatenate(lists), np.concatenate([_counts_of(x) for x in part["c2"].to_pylist()]), _contexts(lists, docs)
            w = weights[bucket_of(context)]
            p = w[:, 0] / (distinct + 1) + w[:, 1] * c1 / max(1, total) + w[:, 2] * c2 / np.maximum(context, 1)
            size = np.array([len(c) for c in lists])
            head = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], part["held_out"], pa.array(size, pa.int64()), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), head)), pa.array([total] * part.num_rows, pa.int64()),
                pa.array(np.add.reduceat(np.log10((c1 + 1) / (total + distinct + 1)), head)), pa.array(np.add.reduceat(np.log10(p), head)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held_out: int = 2, blocks: int | None = None, shards: int | None = None) -> DataFrame:
    """One row for each row of docs with the base and model log10 probabilities of its text.

    Learns from rows whose crc32(id) mod folds is not held_out; the result's train_tokens is their
    number of tokens.
    """
    spark = docs.sparkSession
    rest = remainder(doc_id, folds)
    kept = docs.select(F.col(doc_id), F.col(text), F.coalesce(rest == held_out, F.lit(False)).alias("__held_out"), F.coalesce(rest != held_out, F.lit(False)).alias("__train"))
    size = text_bytes(kept, text)
    blocks, shards = blocks or parts_for(spark, size, BLOCK), shards or parts_for(spark, size, BLOCK)
    deal = F.when(F.col(doc_id).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(doc_id, text))
    id_type = dict(docs.dtypes)[doc_id]
    counted = stored(exchange(
        kept, deal, blocks, shards, _request(text, "__train", shards), "__block int, shard int, keys1 binary, n1 binary, keys2 binary, n2 binary",
        _answer(blocks), "__block int, shard int, n1 binary, n2 binary, total bigint, distinct bigint",
        _finish(text, doc_id, shards), f"doc_id {id_type}, held_out boolean, train boolean, c1 binary, c2 binary, total bigint, distinct bigint",
    ), "lm-counts")
    about = counted.agg(F.count_if("train").alias("docs"), F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    n_docs, total, distinct = (int(about[c] or 0) for c in ("docs", "total", "distinct"))
    cells = counted.where("train").select("c1", "c2").mapInArrow(lambda b: _histogram(b, n_docs, total), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = weights_by_em(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), 1 / (distinct + 1))
    scored = counted.where("c1 is not null").drop("train", "total", "distinct")
    return scored.mapInArrow(lambda b: _scores(b, n_docs, total, distinct, weights), f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Removal of lines that many documents share, through sharded minimal perfect hashes.

Every distinct long line of a document gives one narrow row with the line's hash, an independent
fingerprint and the document's id; grouped sums, combined before they are shuffled, turn these into
distinct line hashes with their document counts and largest ids. The hashes held by enough
documents are cut into shards by ranges, of as many hashes each. A shard is a minimal perfect hash
that indexes three compact arrays: fingerprints, saturating document counts and largest ids.
Documents then probe the arrays with all their lines; a line that is not held lands on some slot,
whose fingerprint tells it apart. Arrays of a checked size go to every executor and the documents
are probed where they are; larger ones stay with their shards and blocks of documents ask them,
with the same result. Lines are joined in neither case.

Cases: a null or empty text is one empty line and comes back empty; a row without an id counts as
no document and loses every hot line; rows that repeat an id are one document for the counts, and
each is cleaned; ids may be of any type that has an order; of equal lines in one document all stay
or all go; very long texts and lines are handled whole, one text at a time; an empty table gives an
empty result; other columns pass through unchanged, whatever their names, but columns named as one
of the two counts are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .perfecthash import PerfectHash
from .scan import Joined, fingerprints, owner, release, text_slices
from .shared import parts_by_shard, parts_for, stored, text_bytes

_U = np.uint64
_SATURATED = 2**16 - 1
SHARD = 250_000  # hashes of a shard, on average
ARRAYS = 64 << 20  # bytes of all shards together that go to every executor
BLOCK = 24 << 20  # bytes of text in a block, beyond that


def _line_keys(joined: Joined, min_chars: int):
    """For every line: its key's hash and fingerprint and whether the key is long enough; starts, ends, and `first` by text."""
    start, end, first = joined.lines()
    word_start, word_end, _ = joined.words()
    a, b = np.searchsorted(word_start, start), np.searchsorted(word_start, end) - 1
    some = a <= b
    begin, stop = start.copy(), start.copy()
    begin[some], stop[some] = word_start[a[some]], word_end[b[some]]
    points = np.concatenate(([0], np.cumsum((joined.bytes & 0xC0) != 0x80)))
    long = points[stop] - points[begin] >= min_chars
    h, prints = np.zeros(len(start), _U), np.zeros(len(start), _U)
    if long.any():
        h[long], prints[long] = joined.hashes(begin[long], stop[long]), fingerprints(joined, begin[long], stop[long])
    return h, prints, long, start, end, first


def _rows(batches, min_chars: int):
    """The distinct long lines of each text: row of the batch, hash, fingerprint."""
    for batch in batches:
        for at, texts in text_slices(batch.column(1)):
            h, prints, long, _, _, first = _line_keys(Joined(texts, lower=True), min_chars)
            h, prints, doc = h[long], prints[long], owner(first)[long]
            order = np.lexsort((h, doc))
            h, prints, doc = h[order], prints[order], doc[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])
            ids = batch.column(0).take(pa.array(at + doc[fresh], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h[fresh].view(np.int64)), pa.array(prints[fresh].view(np.int64))], names=["id", "h", "f"])


class LineShard:
    """The arrays of one shard: what documents probe."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, docs: np.ndarray, tops: pa.Array):
        """keys in order; tops holds the largest ids."""
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        # two lines of one hash differ in their fingerprints: the later ones are kept beside the arrays
        self.more = {(int(k), int(f)): (int(n), t) for k, f, n, t in zip(keys[~fresh], prints[~fresh], docs[~fresh], tops.filter(pa.array(~fresh)).to_pylist())}
        self.hash = PerfectHash(keys[fresh])
        at = self.hash(keys[fresh])
        n = len(at)
        self.prints, self.docs, place = np.zeros(n, _U), np.zeros(n, np.uint16), np.zeros(n, np.int64)
        self.prints[at], self.docs[at], place[at] = prints[fresh], np.minimum(docs[fresh], _SATURATED), np.flatnonzero(fresh)
        self.tops = tops.take(pa.array(place))

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Document counts, 0 for a line that is not held, and largest ids, null for those."""
        at = self.hash(keys) if self.hash.n else np.full(len(keys), -1)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        count = np.zeros(len(keys), np.int64)
        count[known] = self.docs[at[known]]
        top = self.tops.take(pa.array(at, mask=~known))
        if self.more:
            other = [self.more.get((k, f), (0, None)) for k, f in zip(keys.tolist(), prints.tolist())]
            extra = np.array([n for n, _ in other])
            if extra.any():
                values = top.to_pylist()
                top = pa.array([b if n else a for a, (n, b) in zip(values, other)], top.type)
                count = np.where(extra > 0, extra, count)
        return count, top


class LineArrays:
    """All shards, for documents that probe them where they are."""

    def __init__(self, shards: int, rows: list[dict], kind: pa.DataType):
        self.shards, self.kind = shards, kind
        self.packed = {r["shard"]: r["lines"] for r in rows}
        self.opened: dict[int, LineShard] = {}

    def __getstate__(self):
        return {**self.__dict__, "opened": {}}

    def probe(self, h: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        order = np.argsort(h, kind="stable")
        ids, bounds = parts_by_shard(h[order], self.shards)
        count, tops = np.zeros(len(h), np.int64), []
        for s, a, b in zip(ids.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            mine = order[a:b]
            if s in self.packed:
                if s not in self.opened:
                    self.opened[s] = _opened(self.packed[s])
                count[mine], top = self.opened[s].probe(h[mine], prints[mine])
                tops.append(top)
            else:
                tops.append(pa.nulls(len(mine), self.kind))
        back = np.empty(len(h), np.int64)
        back[order] = np.arange(len(h))
        return count, (pa.concat_arrays([t.cast(self.kind) for t in tops]) if tops else pa.nulls(0, self.kind)).take(pa.array(back))


def _sealed(lines: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, lines.schema) as out:
        out.write_table(lines)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> LineShard:
    lines = pa.ipc.open_stream(data).read_all()
    keys, prints = (lines[c].to_numpy().view(_U) for c in ("h", "f"))
    return LineShard(keys, prints, lines["n"].to_numpy(), lines["top"].combine_chunks())


def _seal(table: pa.Table) -> pa.Table:
    """A shard's hot lines, in order of their hashes, as one value."""
    order = np.lexsort((table["f"].to_numpy(), table["h"].to_numpy().view(_U)))
    lines = table.select(["h", "f", "n", "top"]).take(pa.array(order)).combine_chunks()
    return pa.table({"shard": table["shard"].slice(0, 1), "lines": pa.array([_sealed(lines)], pa.binary())})


def hot_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h, f, n, top): hash, fingerprint, documents and largest id of the lines in at least min_docs documents."""
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.where(F.col(doc_id).isNotNull() & (F.length(text) >= min_chars)).select(doc_id, text)
    seen = given.mapInArrow(lambda batches: _rows(batches, min_chars), f"id {kind}, h bigint, f bigint")
    lines = seen.distinct().groupBy("h", "f").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    return lines.where(F.col("n") >= min_docs)


def _clean(ids: pa.Array, column: pa.ChunkedArray | pa.Array, probe, min_chars: int, min_docs: int):
    """(texts, lines, lines dropped) of a column of texts."""
    out, lines, gone = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, texts in text_slices(column):
        h, prints, long, start, end, first = _line_keys(Joined(texts, lower=True), min_chars)
        drop, some = np.zeros(len(h), bool), np.flatnonzero(long)
        if len(some):
            keys, inverse = np.unique(np.stack([h[some], prints[some]], 1), axis=0, return_inverse=True)
            count, top = probe(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
            hot = count[inverse] >= min_docs
            some, inverse = some[hot], inverse[hot]
            mine = ids.take(pa.array(at + owner(first)[some], pa.int64()))
            same = pc.equal(mine, top.take(pa.array(inverse)).cast(mine.type)).fill_null(False)
            drop[some] = ~same.to_numpy(zero_copy_only=False)
        dropped = np.add.reduceat(drop.astype(np.int64), first[:-1])
        offset = 0
        for i, t in enumerate(texts):
            if dropped[i]:
                a, b = first[i], first[i + 1]
                keep = np.flatnonzero(~drop[a:b]) + a
                out.append(b"\n".join([t[s - offset : e - offset] for s, e in zip(start[keep].tolist(), end[keep].tolist())]))
            else:
                out.append(t)
            offset += len(t) + 1
        lines.append(np.diff(first))
        gone.append(dropped)
    return pa.array(out, pa.binary()).cast(pa.string()), pa.array(np.concatenate(lines)), pa.array(np.concatenate(gone))


def _in_place(docs: DataFrame, arrays: LineArrays, text: str, doc_id: str, min_chars: int, min_docs: int, schema: T.StructType) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(arrays)  # at most ARRAYS bytes
    at, who = docs.columns.index(text), docs.columns.index(doc_id)

    def run(batches):
        release()
        for batch in batches:
            made, lines, gone = _clean(batch.column(who), batch.column(at), held.value.probe, min_chars, min_docs)
            yield pa.RecordBatch.from_arrays([*(made if i == at else batch.column(i) for i in range(batch.num_columns)), lines, gone], names=schema.names)

    return docs.mapInArrow(run, schema)


def _by_blocks(docs: DataFrame, sealed: DataFrame, shards: int, text: str, doc_id: str, min_chars: int, min_docs: int, schema: T.StructType) -> DataFrame:
    """Blocks of documents ask the shards that hold their lines; a shard is a document with its arrays."""
    spark, names = docs.sparkSession, docs.columns
    at, who = names.index(text), names.index(doc_id)
    safe = docs.toDF(*(f"c{i}" for i in range(len(names))))
    total = text_bytes(safe, f"c{at}")
    blocks, per_shard = parts_for(spark, total, BLOCK), parts_for(spark, total, 8 * BLOCK)
    spread = max(1, -(-per_shard // shards))  # copies of a shard's arrays, so that each answers for some blocks only
    deal = F.when(F.col(f"c{who}").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(f"c{who}", f"c{at}"))
    dealt = safe.withColumn("__block", F.pmod(F.xxhash64(deal), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("__block"))

    def request(table: pa.Table) -> pa.Table:
        keys = []
        for _, texts in text_slices(table[f"c{at}"]):
            h, prints, long, *_ = _line_keys(Joined(texts, lower=True), min_chars)
            keys.append(np.stack([h[long], prints[long]], 1))
        keys = np.unique(np.concatenate([np.zeros((0, 2), _U), *keys]), axis=0)
        ids, bounds = parts_by_shard(keys[:, 0], shards)
        block = table["__block"][0].as_py()
        return pa.table({
            "__block": pa.array([block] * len(ids), pa.int32()), "place": pa.array(ids * spread + block % spread, pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
        })

    def answer(lines: pa.Table, asked: pa.Table) -> pa.Table:
        blocks_, found = [], []
        if lines.num_rows and asked.num_rows:
            shard = _opened(lines["lines"][0].as_py())
            for block, data in zip(asked["__block"].to_pylist(), asked["keys"].to_pylist()):
                keys = np.frombuffer(data, _U).reshape(-1, 2)
                count, top = shard.probe(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
                hot = np.flatnonzero(count >= min_docs)
                if len(hot):
                    blocks_.append(block)
                    found.append(_sealed(pa.table({"h": keys[hot, 0].view(np.int64), "f": keys[hot, 1].view(np.int64), "n": count[hot], "top": top.take(pa.array(hot))})))
        return pa.table({"__block": pa.array(blocks_, pa.int32()), "lines": pa.array(found, pa.binary())})

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        ids = table[f"c{who}"].combine_chunks()
        lines = [pa.ipc.open_stream(x).read_all() for x in told["lines"].to_pylist()]
        if lines and table.num_rows:
            mine = pa.concat_tables(lines).combine_chunks()
            mine = mine.take(pa.array(np.lexsort((mine["f"].to_numpy(), mine["h"].to_numpy().view(_U)))))
            shard = LineShard(mine["h"].to_numpy().view(_U), mine["f"].to_numpy().view(_U), mine["n"].to_numpy(), mine["top"].combine_chunks())
            probe = shard.probe
        else:
            probe = lambda h, f: (np.zeros(len(h), np.int64), pa.nulls(len(h), ids.type))
        made, n, gone = _clean(ids, table[f"c{at}"], probe, min_chars, min_docs)
        return pa.table([*(made if i == at else table[f"c{i}"] for i in range(len(names))), n, gone], names=[f.name for f in inner])

    asked = dealt.groupBy("__block").applyInArrow(request, "__block int, place bigint, keys binary")
    copies = sealed.select(F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("c"), "shard", "lines").select((F.col("shard") * spread + F.col("c")).alias("place"), "lines")
    told = copies.groupBy("place").cogroup(asked.groupBy("place")).applyInArrow(answer, "__block int, lines binary").repartitionById(blocks, F.col("__block"))
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return dealt.groupBy("__block").cogroup(told.groupBy("__block")).applyInArrow(finish, inner).toDF(*schema.names)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40, min_docs: int = 5, n_lines: str = "n_lines", n_dropped: str = "n_dropped", shard: int = SHARD, arrays: int = ARRAYS) -> DataFrame:
    """docs with hot lines removed from `text`, plus the counts n_lines and n_dropped.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lowered. Keys of min_chars code
    points or more, in min_docs documents or more, stay only in the largest id that holds them.
    `shard` is the number of hashes of a shard; shards of over `arrays` bytes together stay where
    they are and are asked by blocks of documents.
    """
    if not 0 < min_docs <= _SATURATED or min_chars < 1:
        raise ValueError(f"min_docs must be 1 to {_SATURATED}, min_chars at least 1")
    docs = docs.drop(*({n_lines, n_dropped} & set(docs.columns)))
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    found = stored(hot_lines(docs, text, doc_id, min_chars, min_docs), "hot-lines")
    shards = max(1, -(-found.count() // shard))
    where = F.shiftrightunsigned("h", 32)  # as shard_of()
    dealt = found.withColumn("shard", F.shiftright(where * F.lit(shards), 32))
    kind = docs.schema[doc_id].dataType
    sealed = stored(dealt.groupBy("shard").applyInArrow(_seal, "shard bigint, lines binary"), "line-shards")
    if (sealed.agg(F.sum(F.length("lines"))).first()[0] or 0) > arrays:
        return _by_blocks(docs, sealed, shards, text, doc_id, min_chars, min_docs, schema)
    id_type = docs.select(doc_id).limit(0).toArrow().schema.field(0).type
    return _in_place(docs, LineArrays(shards, [r.asDict() for r in sealed.collect()], id_type), text, doc_id, min_chars, min_docs, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
hot AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, i, line, hot.k IS NOT NULL AND l.doc_id <> hot.top AS gone FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

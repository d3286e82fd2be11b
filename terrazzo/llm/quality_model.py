"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded from counts of its bytes and
words, gated attention weighs the passages, and the weighted sum of their encodings gives the
document's score. Weights are learned from document labels only, by Adam in NumPy on the driver,
from a sample of labelled rows of documented size (whole texts, picked by a hash of the id).

Cases: a null, empty or wordless text is one passage of zeros and gets a score; a very long text is
scored whole; equal texts have equal scores; columns of other names, as `y`, do no harm; null labels teach
nothing, and of several labels for an id the largest counts; without labels of both kinds every
score is the share of label 1 (0.5 without any); rows that repeat an id are scored each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Joined, owner, text_slices
from .shared import remainder

PASSAGE = 64  # words
TRAIN_ROWS = 12_000  # labelled rows to learn from, at most in expectation
TRAIN_BYTES = 256 << 20  # of their texts, in expectation; the driver holds a quarter of that as features
CUT = 0.3  # a score of at least this predicts label 1

# Exclusive byte classes that a passage counts.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".?", b"!", b",;:", b"*", b"#", b"$%&", b"|", b"<>{}[]()=/\\_~^+@", b"\"'-")
_CLASS = np.full(256, len(_CLASSES), np.int32)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[0x80:0xC0] = len(_CLASSES) + 1  # continuation bytes
_CLASS[0xC0:] = len(_CLASSES) + 2
_K = len(_CLASSES) + 3
WIDTH = _K + 9


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and `first` of passages by text."""
    joined = Joined(texts)
    start, end, first = joined.words()
    n = np.diff(first)
    per = np.maximum(1, -(-n // PASSAGE))
    begin = np.concatenate(([0], np.cumsum(per)))
    of = owner(begin)
    rank = np.arange(begin[-1]) - begin[of]
    word = first[of] + rank * PASSAGE
    words = np.minimum(PASSAGE, first[of + 1] - word)
    head = np.where(rank == 0, joined.start[of], start[np.minimum(word, max(0, len(start) - 1))] if len(start) else 0)
    size = np.diff(np.append(head, len(joined.bytes)))
    total = len(of)
    passage = np.repeat(np.arange(total, dtype=np.int32), size)
    counts = np.bincount(passage * np.int32(_K) + _CLASS[joined.bytes], minlength=total * _K).reshape(total, _K).astype(np.float32)
    out = np.zeros((total, WIDTH), np.float32)
    length = np.maximum(size, 1).astype(np.float32)
    out[:, :_K] = counts / length[:, None]
    own = np.maximum(words, 1)
    out[:, _K] = np.log1p(words)
    out[:, _K + 1] = (counts.sum(1) - counts[:, 3] - counts[:, 4]) / own
    out[:, _K + 2] = np.log1p(n[of])
    out[:, _K + 3] = np.log1p(rank)
    if len(start):
        h = joined.hashes(start, end)
        mine = np.repeat(np.arange(total), words)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (mine[1:] == mine[:-1])
        order = np.lexsort((h, mine))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (mine[order][1:] != mine[order][:-1])
        count = lambda flag: np.bincount(mine[flag], minlength=total) / own
        short, closed = end - start <= 3, np.isin(joined.bytes[end - 1], list(b".!?,;:"))
        out[:, _K + 4], out[:, _K + 5] = count(again), np.bincount(mine[order][fresh], minlength=total) / own
        out[:, _K + 6], out[:, _K + 7] = count(short), count(closed)
        order = np.lexsort((h, np.repeat(np.arange(len(texts)), n)))  # distinct words of the whole text
        text_of = np.repeat(np.arange(len(texts)), n)[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (text_of[1:] != text_of[:-1])
        out[:, _K + 8] = (np.bincount(text_of[fresh], minlength=len(texts)) / np.maximum(n, 1))[of]
    return out, begin


class AttentionModel:
    """tanh encoder, gated attention (tanh gate times sigmoid gate), linear head."""

    NAMES = ("W", "b", "V", "v", "U", "u", "a", "c", "d")

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(width, hidden), "b": np.zeros(hidden), "V": g(hidden, gate), "v": np.zeros(gate), "U": g(hidden, gate), "u": np.zeros(gate), "a": g(gate), "c": g(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, begin: np.ndarray):
        p, head, of = self.p, begin[:-1], owner(begin)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, head)[of])
        weight = e / np.add.reduceat(e, head)[of]
        bag = np.add.reduceat(weight[:, None] * h, head)
        return x, h, t, s, weight, bag, bag @ p["c"] + p["d"]

    def score(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of bags, and the attention weights of their passages."""
        *_, weight, _, z = self.forward(x, begin)
        if self.constant is not None:
            return np.full(len(z), self.constant), weight
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), weight

    def gradients(self, x, begin, y) -> dict[str, np.ndarray]:
        p, of = self.p, owner(begin)
        x, h, t, s, weight, bag, z = self.forward(x, begin)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        dbag = dz[:, None] * p["c"]
        dh = weight[:, None] * dbag[of]
        dw = (dbag[of] * h).sum(1)
        de = weight * (dw - np.add.reduceat(weight * dw, begin[:-1])[of])
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ ds, "u": ds.sum(0), "a": (t * s).T @ de, "c": bag.T @ dz, "d": np.array([dz.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.005, decay: float = 1e-4, seed: int = 11) -> AttentionModel:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                some, step = order[at : at + batch], step + 1
                chosen = [bags[i] for i in some]
                grads = self.gradients(np.concatenate(chosen), np.concatenate(([0], np.cumsum([len(b) for b in chosen]))), y[some])
                pace = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _featurise(batches):
    for batch in batches:
        for at, texts in text_slices(batch.column(1)):
            x, begin = passages(texts)
            rows = [x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> AttentionModel:
    """A model from the labelled rows of docs: about `rows` of labels with about `text_bytes` of text, picked by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(doc_id, F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("double").alias("__y"))
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    some = docs.join(F.broadcast(known), F.col("id") == F.col("__id"))  # at most `rows` rows of two numbers
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > text_bytes:
        some = some.where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1_000_000)) < int(1_000_000 * text_bytes / size))
    got = some.select("id", "text", "__y").mapInArrow(_featurise, f"doc_id {docs.dtypes[0][1]}, y double, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(float) for b in got["x"].to_pylist()]
    return AttentionModel().fit(bags, got["y"].to_numpy())


def score(docs: DataFrame, model: AttentionModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """The columns `keep` with score, predicted, and the passage of the largest attention weight."""

    columns = [*keep, *[text] * (text not in keep)]
    source = columns.index(text)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(source)):
                x, begin = passages(texts)
                s, weight = model.score(x, begin)
                top = [int(weight[a:b].argmax()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in range(len(keep))), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(top, pa.int32())], names=[*keep, "score", "predicted", "top_passage"])

    types = dict(docs.dtypes)
    return docs.select(*columns).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double, predicted int, top_passage int"]))


def keep_good(docs: DataFrame, model: AttentionModel, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that the model predicts to be good."""
    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = score(renamed, model, f"c{docs.columns.index(text)}", tuple(renamed.columns)).where("predicted = 1")
    return kept.select(renamed.columns).toDF(*docs.columns)


def fit_for(spark, docs: DataFrame, sf_dir: str) -> AttentionModel:
    """The production model: labels.quality of documents outside the fold held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return fit(docs.select("doc_id", "text"), labels.where(remainder("doc_id", 5) != 0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_for(spark, docs, sf_dir)
    return score(docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))), model, keep=("doc_id", "held_out"))

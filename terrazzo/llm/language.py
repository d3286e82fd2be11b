"""Language identification of whole texts, with spans of mixed-language text.

A word's script narrows its candidate languages. Each candidate scores the word by the letter
trigrams it ends, from smoothed counts of training texts held in a hashed table of fixed size. A
Viterbi pass over the words, with a penalty for switching, labels spans; the text's language is the
one with the most letters. A text whose best single language cannot be bettered by any switch is
told at once, from running sums of the leads of the others.

Training reads a sample of labelled texts of documented size, whole texts only, picked by a hash
of the id; counts are added up on the executors.

Cases: a null text or one without letters (of marks or digits alone, say) is `und` with score 0; a
null label teaches nothing; without any training text all is `und`; ties go to the first language by
name; a very long text is labelled whole, by itself; rows that repeat an id are scored each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import SCRIPT_NAMES, codes, letter_table
from .scan import SLICE
from .shared import remainder

SLOTS = 1 << 15  # hashed trigrams
TRAIN_ROWS = 30_000  # labelled texts to learn from, at most in expectation
PENALTY = 12.0  # for a switch of language, in nats
SMOOTH = 0.5
SCRIPT_SHARE = 0.01  # of a language's letters, for a script to be one of its own
UNKNOWN = "und"


class Letters:
    """The words of several texts: a letter, then all letters and marks that follow it."""

    def __init__(self, texts: list[str]):
        raw, bounds = codes(texts)
        fold, script, mark = letter_table()
        c, self.script, marks = fold[raw], script[raw], mark[raw]
        if marks.any():  # those that no letter stands before belong to no word
            at = np.arange(len(c))
            gap = np.maximum.accumulate(np.where(c == 0, at, -1))
            letter = np.maximum.accumulate(np.where((c > 0) & ~marks, at, -1))
            c[marks & (letter <= gap)] = 0
            self.script[c == 0] = 0
        some = np.concatenate(([False], c > 0))
        edge = np.flatnonzero(some[1:] != some[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, bounds)
        self.codes = c

    def grams(self) -> np.ndarray:
        """The slot of the trigram that ends at each position; a word's end ends one as well."""
        c = self.codes
        b, a = np.zeros_like(c), np.zeros_like(c)
        b[1:], a[2:] = c[:-1], c[:-2]
        a[b == 0] = 0
        h = a * np.uint32(0x9E3779B1)
        h ^= b * np.uint32(0x85EBCA77)
        h ^= c * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        return (h >> np.uint32(17)).astype(np.int32)


def _learn(batches):
    """Counts of trigram slots, then of scripts, for each language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            held = counts.setdefault(lang, np.zeros(SLOTS + len(SCRIPT_NAMES), np.int64))
            for part in _parts(texts):
                w = Letters(part)
                inside = np.flatnonzero((w.codes > 0) | np.concatenate(([False], w.codes[:-1] > 0)))
                held[:SLOTS] += np.bincount(w.grams()[inside], minlength=SLOTS)
                held[SLOTS:] += np.bincount(w.script, minlength=len(SCRIPT_NAMES))
    for lang, held in counts.items():
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(held[slot])], names=["lang", "slot", "n"])


def _parts(texts: list[str]):
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > SLICE:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


class LanguageModel:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = len(self.languages)
        grams = np.array([counts[x][:SLOTS] for x in self.languages], float).reshape(n, SLOTS)
        scripts = np.array([counts[x][SLOTS:] for x in self.languages], float).reshape(n, len(SCRIPT_NAMES))
        p = np.log((grams + SMOOTH) / (grams.sum(1, keepdims=True) + SMOOTH * SLOTS))
        self.table = (p - p.mean(0)).astype(np.float32) if n else np.zeros((0, SLOTS), np.float32)  # language x slot
        self.own = scripts[:, 1:] >= SCRIPT_SHARE * np.maximum(scripts[:, 1:].sum(1, keepdims=True), 1)  # language x script

    def word_scores(self, words: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all words, one column a language, and their letters."""
        size = words.end - words.start
        if not len(size):
            return np.zeros((0, len(self.languages)), np.float32), size
        grams, scores = np.append(words.grams(), 0), np.empty((len(size), len(self.languages)))
        edges = np.stack([words.start, words.end + 1], 1).ravel()  # with the trigram that closes the word
        for i, row in enumerate(self.table):
            scores[:, i] = np.add.reduceat(row[grams], edges)[::2]
        allowed = self.own.T[np.maximum(words.script[words.start].astype(int) - 1, 0)]
        some = allowed.any(1)
        scores[~some] = 0.0
        scores[some & ~allowed.all(1)] += np.where(allowed[some & ~allowed.all(1)], 0.0, -50.0)
        return scores, size

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of every word of one text."""
        n, k = scores.shape
        total = scores.sum(0)
        best = int(np.argmax(total))
        lead = np.zeros((n + 1, k))
        np.cumsum(scores - scores[:, [best]], axis=0, out=lead[1:])
        # No run of words gains the penalty, nor do a first and a last run together: no switch pays.
        if (lead - np.minimum.accumulate(lead, axis=0)).max() <= PENALTY:
            head, tail = np.maximum.accumulate(lead.max(1)), np.maximum.accumulate((lead[-1] - lead).max(1)[::-1])[::-1]
            if (head + tail).max() <= PENALTY:
                return np.full(n, best)
        back, value = [], [0.0] * k
        states = range(k)
        for row in scores.tolist():
            high = max(value)
            low, top = high - PENALTY, value.index(high)
            back.append([s if value[s] >= low else top for s in states])
            value = [(v if v >= low else low) + x for v, x in zip(value, row)]
        out, state = [0] * n, value.index(max(value))
        for t in range(n - 1, -1, -1):
            out[t] = state
            state = back[t][state]
        return np.array(out)

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text its language, a score of 0 to 1, and its spans (first word, words, language)."""
        words = Letters(texts)
        scores, size = self.word_scores(words)
        out = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if a == b or not self.languages:
                out.append((UNKNOWN, 0.0, []))
                continue
            path = self.path(scores[a:b])
            letters = np.bincount(path, size[a:b], len(self.languages))
            best = int(letters.argmax())
            total = scores[a:b][path == best].sum(0)
            odds = np.exp(np.clip((total - total[best]) / np.sqrt(max(1, (path == best).sum())), -50, 50))
            cuts = np.flatnonzero(np.diff(path)) + 1
            edges = [0, *cuts.tolist(), b - a]
            spans = [(x, y - x, self.languages[path[x]]) for x, y in zip(edges[:-1], edges[1:])]
            out.append((self.languages[best], float(letters[best] / letters.sum() / odds.sum()), spans))
        return out


def fit(train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from rows with a text and a language; about `rows` of them, picked by a hash of the id."""
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = train.count()
    if n > rows:
        train = train.where(F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    # at most languages x (SLOTS + scripts) rows reach the driver
    got = train.select(text, lang).mapInArrow(_learn, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    slots, n = got["slot"].to_numpy(), got["n"].to_numpy()
    names = np.array(got["lang"].to_pylist(), object)
    for x in set(names.tolist()):
        counts[x] = np.zeros(SLOTS + len(SCRIPT_NAMES), np.int64)
        counts[x][slots[names == x]] = n[names == x]
    return LanguageModel(counts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred, score and spans (first word, words, language)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages floats

    def run(batches):
        m = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            got = [x for part in _parts(texts) for x in m.label(part)]
            spans = [[{"first": a, "words": n, "lang": g} for a, n, g in x[2]] for x in got]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "spans"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in keep), "lang_pred string, score double, spans array<struct<first:bigint,words:bigint,lang:string>>"])
    return docs.select(*keep, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder("doc_id", 3) == 1
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model, keep=("doc_id", "held_out")).withColumn("n_spans", F.size("spans")).drop("spans")

"""Line-first cleaning: rules fail lines, failed lines go, and a document that loses too much goes too.

Each rule sees one line: symbols (too many of `#*$%&|<>` for its words), shouting (exclamation marks
or capitals dominate), navigation (a few words without closing punctuation) and boilerplate
(licence, cookie and similar phrases). All counts are sums over byte ranges of whole texts.

Cases: a null, empty or wordless text has zero counts, fails the base rule and is not kept; lines
without words are no loss; rows are independent, so repeated ids and ties do not matter; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scan import SPACE, Joined, owner, shingles, text_slices

# Fixed: the characters counted as symbols, closing punctuation, and phrases of boilerplate lines.
SYMBOLS = b"#*$%&|<>"
CLOSING = ".!?:;,)]}\"'…”’»。！？"
BOILERPLATE = (
    "licensed under", "all rights reserved", "cookie policy", "cookies to", "privacy policy", "terms of service", "terms of use", "terms and conditions",
    "subscribe to", "sign up for", "enable javascript", "click here", "share this", "copyright (c)", "spdx-license-identifier", "permission is hereby granted",
)

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), range(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), range(97, 123))
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_CLOSING = {c.encode() for c in CLOSING}
_LAST = np.isin(np.arange(256), [c[-1] for c in _CLOSING])


class Limits:
    """Production parameters. Shares are percentages, so that all tests are on whole numbers."""

    symbols = 30  # of a line's words
    bangs = 30  # of a line's words
    capitals = 60  # of a line's ASCII letters, if it has capital_letters or more
    capital_letters = 20
    short_words = 8  # a line of fewer words needs closing punctuation
    lost_words = 50  # of a document's words
    least_words = 10
    repeated = 20
    window = 5


def _sum(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[end] - total[start]


def _closed(joined: Joined, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each offset is closing punctuation."""
    out = _LAST[joined.bytes[last - 1]]
    wide = np.flatnonzero(out & (joined.bytes[last - 1] >= 0x80))
    raw = joined.bytes
    for i in wide.tolist():
        e = int(last[i])
        out[i] = raw[max(0, e - 2) : e].tobytes() in _CLOSING or raw[max(0, e - 3) : e].tobytes() in _CLOSING
    return out


def examine(texts: list[bytes], limits=Limits) -> dict[str, np.ndarray]:
    """The counts and verdicts of whole texts, and `lost`: for each text the words of failed lines."""
    joined = Joined(texts)
    raw = joined.bytes
    start, end, first = joined.words()
    n_words = np.diff(first)
    points = (raw & 0xC0) != 0x80
    doc = lambda mask: _sum(mask, joined.start, joined.end)
    out = {"n_words": n_words, "word_chars": doc(points & ~SPACE[raw]), "n_symbols": doc(_SYMBOL[raw])}

    line_start, line_end, line_first = joined.lines()
    a, b = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    words = b - a
    some = words > 0
    lines = owner(line_first)
    h = joined.hashes(line_start, line_end)
    order = np.lexsort((h, lines))
    order = order[some[order]]
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (lines[order[1:]] == lines[order[:-1]])
    count = lambda flag: np.add.reduceat(flag.astype(np.int64), line_first[:-1]) if len(texts) else np.zeros(0, np.int64)
    out["n_dup_lines"] = count(again)

    windows, at, begin = shingles(joined.hashes(start, end), first, limits.window)
    full = np.repeat(n_words >= limits.window, np.diff(begin))
    windows, at, of = windows[full], at[full], owner(begin)[full]
    order = np.lexsort((windows, of))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (windows[order[1:]] == windows[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    repeated = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + limits.window, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    out["n_repeat_words"] = covered[first[1:]] - covered[first[:-1]]

    symbols, bangs = _sum(_SYMBOL[raw], line_start, line_end), _sum(raw == 33, line_start, line_end)
    upper, letters = _sum(_UPPER[raw], line_start, line_end), _sum(_LETTER[raw], line_start, line_end)
    last = np.where(some, end[np.maximum(b - 1, 0)] if len(end) else 0, 1)
    failed = 100 * symbols > limits.symbols * words
    failed |= 100 * bangs > limits.bangs * words
    failed |= (letters >= limits.capital_letters) & (100 * upper > limits.capitals * letters)
    failed |= (words < limits.short_words) & ~_closed(joined, np.maximum(last, 1))
    low = joined.bytes.tobytes().lower()
    found = np.array([m.start() for m in _PHRASES.finditer(low)], np.int64)
    failed[np.searchsorted(line_end, found)] = True
    failed &= some
    lost = count(failed * 1) if not len(texts) else np.add.reduceat(np.where(failed, words, 0), line_first[:-1])
    out["n_failed_lines"], out["lost_words"] = count(failed), lost
    out["base_failed"] = (n_words < limits.least_words) | (100 * out["n_repeat_words"] > limits.repeated * n_words)
    out["kept"] = ~out["base_failed"] & (100 * lost <= limits.lost_words * n_words)
    out["_failed"], out["_line_first"] = failed, line_first
    return out


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_words")
FLAGS = ("base_failed", "kept")


def check_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limits=Limits, cleaned: bool = False) -> DataFrame:
    """The id, counts and verdicts of each row; with `cleaned`, also the text without its failed lines."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                got = examine(texts, limits)
                columns = [batch.column(0).slice(at, len(texts)), *(pa.array(got[c], pa.int64()) for c in LONGS), *(pa.array(got[c]) for c in FLAGS)]
                if cleaned:
                    keep = (~got["_failed"]).tolist()
                    first = got["_line_first"].tolist()
                    columns.append(pa.array([b"\n".join([x for x, k in zip(t.split(b"\n"), keep[a:]) if k]) for t, a in zip(texts, first)], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *LONGS, *FLAGS, *["cleaned"] * cleaned])

    id_type = dict(docs.dtypes)[doc_id]
    schema = ", ".join([f"doc_id {id_type}", *(f"{c} bigint" for c in LONGS), *(f"{c} boolean" for c in FLAGS), *["cleaned string"] * cleaned])
    return docs.select(doc_id, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return check_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_quoted = lambda s: s.replace("'", "''")
_phrases = _quoted("|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in BOILERPLATE))
_closing = _quoted("".join("\\" + c if c in "]\\^-" else c for c in CLOSING))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w0),
w AS (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS i FROM w0),
g AS (SELECT doc_id, i, CASE WHEN lead(t, 4) OVER o IS NOT NULL THEN concat_ws(' ', t, lead(t) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o) END AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g),
c AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM r) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS s FROM l0),
f AS (SELECT doc_id, line, n, n > 0 AND (
   100 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > 30 * n
   OR 100 * (length(line) - length(replace(line, '!', ''))) > 30 * n
   OR (length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 20 AND 100 * length(regexp_replace(line, '[^A-Z]', '', 'g')) > 60 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')))
   OR (n < 8 AND NOT regexp_matches(s, '[{_closing}]$'))
   OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_phrases}')) AS failed FROM l),
e AS (SELECT doc_id, sum(n) - sum(n) AS z, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (failed), 0) AS lost_words FROM f GROUP BY doc_id),
x AS (SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, n_failed_lines, CAST(lost_words AS BIGINT) AS lost_words FROM b JOIN e USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM x
"""

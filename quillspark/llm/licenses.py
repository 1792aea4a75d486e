"""License scans: which templates a document holds, how much of each and where.

A match is a stretch of words that becomes the template by few edits (a word exchanged, added or left out): at most the part of its
words that ``coverage`` leaves. Between so few edits some run of words must be untouched, and its least length
follows from the template's (``least_run``). So templates are fingerprinted as finely as that asks for: longer ones by runs of
three words, winnowed, shorter ones by every run of two, and every acceptable match shares fingerprints with its template; how many
at least follows too. The fingerprints are an inverted index, which is as large as the templates; every text is
fingerprinted the same way. Where enough hits stand close to one diagonal, a banded alignment of the template with the words around
tells how many of its words are matched in order and from which byte to which.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import table
from ._templates import TEMPLATES

K, WINDOW = 3, 2
COVERAGE = 0.8
#: Bytes of templates that one scan of the texts looks for; more are looked for by further scans.
SCAN_BYTES = 16 << 20


def edits(words: int, coverage: float) -> int:
    """How many edits a match of a template of so many words may have."""
    return int((1 - coverage) * words + 1e-9)


def least_run(words: int, coverage: float) -> int:
    """The length of the longest untouched run, at least: what is left of the words, shared by the runs between the edits."""
    e = edits(words, coverage)
    return -(-(words - e) // (e + 1))


def winnow(grams: np.ndarray, by_row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: of every ``window`` neighbouring grams of a row the least, the right one on a tie; all of a shorter row's least."""
    n = len(grams)
    chosen = np.zeros(n, bool)
    for row in np.flatnonzero((np.diff(by_row) > 0) & (np.diff(by_row) < window)):
        a, b = by_row[row], by_row[row + 1]
        chosen[a + int(grams[a:b].argmin())] = True
    if n >= window:
        view = np.lib.stride_tricks.sliding_window_view(grams, window)
        at = np.arange(n - window + 1)
        least = at + window - 1 - view[:, ::-1].argmin(1)
        row_end = np.repeat(by_row[1:], np.diff(by_row))
        chosen[least[at + window <= row_end[: len(at)]]] = True
    return np.flatnonzero(chosen)


class Band:
    """Edit distances of a template's prefixes to stretches of ``words`` that end on diagonals ``low`` to ``high``; the start is free.

    ``rows[i, d]`` is for the first i words of the template and the words before place i + low + d.
    """

    def __init__(self, template: np.ndarray, words: np.ndarray, low: int, high: int) -> None:
        self.template, self.words, self.low = template, words, low
        m, n, width = len(template), len(words), high - low + 1
        far = m + n + 1
        steps = np.arange(width)
        self.rows = np.full((m + 1, width), far, np.int32)
        ends = low + steps
        self.rows[0] = np.where((ends >= 0) & (ends <= n), 0, far)
        for i in range(1, m + 1):
            ends = i + low + steps
            inside = (ends >= 0) & (ends <= n)
            same = (ends >= 1) & (ends <= n)
            equal = np.zeros(width, bool)
            equal[same] = words[ends[same] - 1] == template[i - 1]
            now = np.where(same, self.rows[i - 1] + ~equal, far)
            now[:-1] = np.minimum(now[:-1], self.rows[i - 1, 1:] + 1)
            now = np.minimum.accumulate(np.where(inside, now, far) - steps) + steps
            self.rows[i] = np.where(inside, np.minimum(now, far), far)

    def ends(self, most: int) -> list[tuple[int, int]]:
        """(edits, end) of all stretches with few enough, the best first, then the earliest."""
        d = np.flatnonzero(self.rows[-1] <= most)
        return sorted(zip(self.rows[-1, d].tolist(), (len(self.template) + self.low + d).tolist(), strict=True))

    def matched(self, end: int) -> list[tuple[int, int]]:
        """(template word, text word) of the equal words of the best alignment that ends there; on a tie steps go through both, then the template."""
        i, out = len(self.template), []
        while i:
            d = end - i - self.low
            here, equal = self.rows[i, d], end > 0 and self.words[end - 1] == self.template[i - 1]
            if end > 0 and self.rows[i - 1, d] + (not equal) == here:
                i, end = i - 1, end - 1
                if equal:
                    out.append((i, end))
            elif d + 1 < self.rows.shape[1] and self.rows[i - 1, d + 1] + 1 == here:
                i -= 1
            else:
                end -= 1
        return out[::-1]


class Scanner:
    """The index of some templates, name -> (text, words that a match must hold); a plain object that Spark sends to its workers."""

    def __init__(self, templates: dict[str, tuple[str, str]], coverage: float = COVERAGE) -> None:
        split = lambda texts: (lambda h: [h[0][a:b] for a, b in zip(h[3][:-1], h[3][1:], strict=True)])(T.words(*T.utf8(pa.array(texts, pa.string())), T.PUNCTUATION))
        self.names = list(templates)
        self.words = split([t for t, _ in templates.values()])
        self.asked = [set(w.tolist()) for w in split([a for _, a in templates.values()])]
        self.edits = [edits(len(w), coverage) for w in self.words]
        self.index, self.need = {}, [0] * len(self.words)
        for k, window in ((K, WINDOW), (2, 1), (1, 1)):
            mine = [o for o, w in enumerate(self.words) if len(w) and self._fineness(len(w), coverage) == (k, window)]
            if not mine:
                continue
            grams, ends = T.shingles(np.concatenate([self.words[o] for o in mine]), np.concatenate([[0], np.cumsum([len(self.words[o]) for o in mine])]), k)
            at = winnow(grams, ends, window)
            order = at[np.argsort(grams[at], kind="stable")]
            local = np.searchsorted(ends, order, "right") - 1
            self.index[k, window] = (grams[order], np.array(mine)[local], order - ends[local])
            for o in mine:  # each of the runs between the edits has its length less k + window - 2 windows, a gram serves up to ``window`` of them
                m, e = len(self.words[o]), self.edits[o]
                self.need[o] = max(1, math.ceil((m - e - (k + window - 2) * (e + 1)) / window))

    @staticmethod
    def _fineness(words: int, coverage: float) -> tuple[int, int]:
        run = least_run(words, coverage)
        return (K, WINDOW) if run >= K + WINDOW - 1 else (2, 1) if run >= 2 else (1, 1)

    def _candidates(self, hashes: np.ndarray, by_row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, template, least, greatest diagonal) of stretches that may hold a match."""
        for (k, window), (known, owners, places) in self.index.items():
            grams, ends = T.shingles(hashes, by_row, k)
            at = winnow(grams, ends, window)
            low, high = np.searchsorted(known, grams[at], "left"), np.searchsorted(known, grams[at], "right")
            n = high - low
            hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            at = np.repeat(at, n)
            row = np.searchsorted(ends, at, "right") - 1
            shift, owner = at - ends[row] - places[hit], owners[hit]
            order = np.lexsort((shift, owner, row))
            row, owner, shift = row[order], owner[order], shift[order]
            need, reach = np.array(self.need)[owner], np.array(self.edits)[owner]
            last = np.arange(len(row)) + need - 1  # the hit that completes the needed number, if it is close enough
            ok = last < len(row)
            last = np.minimum(last, len(row) - 1)
            ok &= (row[last] == row) & (owner[last] == owner) & (shift[last] - shift <= reach)
            group: list[int] | None = None
            for r, o, a, b in zip(row[ok].tolist(), owner[ok].tolist(), (shift - reach)[ok].tolist(), (shift[last] + reach)[ok].tolist(), strict=True):
                if group and group[:2] == [r, o] and a <= group[3]:
                    group[3] = max(group[3], b)
                    continue
                if group:
                    yield tuple(group)
                group = [r, o, a, b]
            if group:
                yield tuple(group)

    def scan(self, column: pa.Array) -> list[tuple[int, str, int, int, int, float]]:
        """(row, template, first byte, end byte, matched words, coverage) of every match; of overlapping ones of a template the best, then the first."""
        data, offsets = T.utf8(column)
        hashes, starts, ends, by_row = T.words(data, offsets, T.PUNCTUATION)
        out = []
        for r, o, low, high in sorted(self._candidates(hashes, by_row)):
            template, most, base = self.words[o], self.edits[o], by_row[r]
            words = hashes[base : by_row[r + 1]]
            band = Band(template, words, max(low, -len(template)), min(high, len(words)))
            taken: list[tuple[int, int]] = []
            for _, end in band.ends(most):
                if any(a < end <= b + most for a, b in taken):
                    continue
                pairs = band.matched(end)
                first, last = pairs[0][1], pairs[-1][1] + 1
                if any(first < b and a < last for a, b in taken) or not self.asked[o] <= {int(template[i]) for i, _ in pairs}:
                    continue
                taken.append((first, last))
                out.append((r, self.names[o], int(starts[base + first] - offsets[r]), int(ends[base + last - 1] - offsets[r]), len(pairs), len(pairs) / len(template)))
        return out


MATCH = "doc_id long, template string, start long, end long, matched_words long, coverage double"


def _scanners(templates: DataFrame | dict | None, coverage: float) -> Iterator[Scanner]:
    if isinstance(templates, DataFrame):
        some: dict[str, tuple[str, str]] = {}
        size = 0
        asked = F.col("asked") if "asked" in templates.columns else F.lit("").alias("asked")
        for r in templates.where("name is not null and text is not null").select("name", "text", asked).orderBy("name", "text").toLocalIterator():
            some[r.name] = (r.text, r.asked or "")
            size += len(r.text)
            if size >= SCAN_BYTES:
                yield Scanner(some, coverage)
                some, size = {}, 0
        if some:
            yield Scanner(some, coverage)
        return
    yield Scanner({k: (v, "") if isinstance(v, str) else v for k, v in (TEMPLATES if templates is None else templates).items()}, coverage)


def scan_licenses(docs: DataFrame, templates: DataFrame | dict | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and match: doc_id, template, start and end byte in the UTF-8 text, matched_words, coverage of the template.

    ``templates`` is a table (name, text, and asked, words that a match must hold) or a dictionary. Words are runs of letters and digits
    with A-Z as a-z; a match has at most (1 - coverage) of the template's words as edits. Defined cases: null, empty or short texts match
    nothing; null doc_id is passed on; repeated rows give repeated results; of matches that overlap the one with fewest edits stays,
    on a tie the one that ends first; very long texts are scanned whole; templates without words match nothing; an empty table
    gives no row; extra columns are ignored.
    """

    def searcher(scanner: Scanner):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.pieces(batch, "text"):
                    rows = scanner.scan(part.column(1))
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    ids = part.column(0).take(pa.array(columns[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], [c.split()[0] for c in MATCH.split(", ")])

        return run

    found = docs.sparkSession.createDataFrame([], MATCH)
    for scanner in _scanners(templates, coverage):
        found = found.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(searcher(scanner), MATCH))
    return found


def op2_winnowed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

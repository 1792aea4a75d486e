"""Lexicon segmenter: markers, header ends, segments; and headers from a prefix.

One Arrow kernel walks each text once with one compiled alternation, so a text is not copied per marker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.lexicon import CHAIN_STEMS, HEADER_STOPS, HEADER_VERBS, QUOTE
from quillspark.functions.text import strip, upper_median
from quillspark.operators.slices import pieces

SEGMENT = "id long, start long, end long, header string, header_len long, body_len long"
_MARKS = re.compile("[ً-ٰٟ]")
_PLAIN = str.maketrans("أإآٱةى", "ااااهي")


def normalize(text: str) -> str:
    return _MARKS.sub("", text).translate(_PLAIN)


class Segmenter:
    """Segments of single texts; a plain object that Spark sends to its workers.

    ``original_offsets``: markers are found in the normalized text, whose offsets drift from the original's after each
    removed mark. By default they are used as they are; True maps them back.
    """

    def __init__(self, stems: tuple[str, ...] = CHAIN_STEMS, quote: str = QUOTE, normalized: bool = True, original_offsets: bool = False) -> None:
        self.stems, self.quote, self.normalized, self.original_offsets = tuple(stems), quote, normalized, original_offsets
        some = "|".join(re.escape(s) for s in sorted(stems, key=len, reverse=True))
        self.any_stem = re.compile(f"(?=({some}))")
        self.starts_with = re.compile(some)
        self.quotes = re.compile(re.escape(quote))
        self.blanks = re.compile("[ \n\t]*")

    def markers(self, text: str) -> list[int]:
        """Offsets of the stems, left to right; one that starts up to the end of the last kept one is skipped."""
        kept, last = [], -1
        for m in self.any_stem.finditer(text):
            if m.start() > last:
                shortest = min(len(s) for s in self.stems if text.startswith(s, m.start()))
                kept.append(m.start())
                last = m.start() + shortest
        return kept

    def header_end(self, text: str, start: int, window: int, default: int = 150) -> int:
        """After the first quotation verb in the window that no stem follows, and the blanks after it."""
        for m in self.quotes.finditer(text, start, min(start + window, len(text))):
            end = self.blanks.match(text, m.end()).end()
            if not self.starts_with.match(text, end):
                return end
        return start + default

    def segments(self, original: str) -> list[tuple[int, int, int, str, int, int]]:
        text = normalize(original) if self.normalized else original
        back = None
        if self.original_offsets and self.normalized:
            back = [i for i, c in enumerate(original) if not _MARKS.match(c)] + [len(original)]
        starts, out = self.markers(text), []
        if not starts:
            return out
        for start, following in zip(starts, [*starts[1:], len(text)], strict=True):
            end = self.header_end(text, start, min(900, following - start + 50))
            if end <= start or end > following:
                end = min(start + 400, following)
            a, b = (back[start], back[end]) if back else (start, end)
            header = original[a:b].strip()
            if end - start >= 8 and header:
                out.append((len(out), a, b, header[:100], b - a, (back[following] if back else following) - b))
        return out


def marker_segments(docs: DataFrame, segmenter: Segmenter) -> DataFrame:
    """(doc_id, text) -> doc_id and the segments: id, start, end, header (100 characters), header_len, body_len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        kinds = [pa.string() if "string" in c else pa.int64() for c in SEGMENT.split(", ")]
        for batch in batches:
            for part in pieces(batch, 1):
                found = [segmenter.segments(t) if t else [] for t in part.column(1).to_pylist()]
                doc = part.column(0).take(pa.array([i for i, s in enumerate(found) for _ in s], pa.int64()))
                flat = list(zip(*[x for s in found for x in s], strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([doc, *[pa.array(v, k) for v, k in zip(flat, kinds, strict=True)]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + SEGMENT)


def segment_gaps(segments: DataFrame) -> DataFrame:
    """Per document: least, upper median and greatest gap between a segment's end and the next start, and how many are over 100 and 500."""
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "id"))
    gaps = segments.select("doc_id", (F.col("start") - before).alias("gap")).where("gap is not null")
    return gaps.groupBy("doc_id").agg(
        F.min("gap").alias("min_gap"), upper_median(F.collect_list("gap")).alias("median_gap"), F.max("gap").alias("max_gap"),
        F.count_if(F.col("gap") > 100).alias("over_100"), F.count_if(F.col("gap") > 500).alias("over_500"),
    )


def header_prefix(text: Column, verbs: tuple[str, ...] = HEADER_VERBS, stops: str = HEADER_STOPS, limit: int = 200, least: int = 10) -> Column:
    """The start of a text through its last verb within ``limit`` characters and on to a stop; null if it has no verb or is short."""
    some = "|".join(rf"\Q{v}\E" for v in sorted(verbs, key=len, reverse=True))
    found = strip(F.regexp_extract(F.substring(text, 1, limit), rf"(?s)\A(.*(?:{some})[^{stops}]*)", 1))
    return F.when(F.length(found) > least, found)

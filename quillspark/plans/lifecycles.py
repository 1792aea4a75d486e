"""The three ways from documents to units, end to end."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import annotations, chunks, clean, onepass, records, scoring, segments
from quillspark.operators.slices import with_slices

#: A cluster's text with so many characters before and after.
CONTEXT = {"text_context": (40, 80)}


def by_scorer(docs: DataFrame, load: Callable[[], scoring.Scorer], gap: int = 20) -> tuple[DataFrame, DataFrame]:
    """Raw (doc_id, text) -> (cleaned documents, boundary clusters with their context)."""
    cleaned = clean.clean_documents(docs.select("doc_id", "text"))
    return cleaned, onepass.gap_clusters(cleaned, load, gap, CONTEXT)


def by_rules(docs: DataFrame, segmenter: segments.Segmenter | None = None, **header) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> (segments, units)."""
    found = segments.marker_segments(docs, segmenter or segments.Segmenter())
    return found, records.unit_source(None, found, docs, **header)


def by_annotator(docs: DataFrame, connect: Callable[[], Callable[[str], str]], size: int = 3500, overlap: int = 500, least: int = 500, threshold: int = 50, requests: int | None = None) -> DataFrame:
    """(doc_id, text) -> units that an outside annotator names in overlapping chunks, located, freed of duplicates and merged.

    ``requests`` bounds how many chunks are asked for at once.
    """
    pieces = chunks.smart_chunks(docs, size, overlap, least)
    pieces = with_slices(pieces, docs, {"text": (F.col("start"), F.col("end"))})
    asked = pieces.select("doc_id", "chunk_id", annotations.prompt(F.col("text")).alias("prompt"))
    replies = annotations.call(asked.repartition(requests) if requests else asked, connect)
    units = replies.select("doc_id", "chunk_id", F.posexplode(annotations.parse_reply(F.col("reply"))).alias("place", "u"))
    units = units.join(pieces.select("doc_id", "chunk_id", F.col("start").alias("chunk_start")), ["doc_id", "chunk_id"])
    units = units.select("doc_id", "chunk_start", (F.col("chunk_id") * 100_000 + F.col("place")).alias("ord"), "u.unit_id", "u.text_start", "u.text_end", F.col("u.isnad_text").alias("header_text"))
    single = annotations.dedup_units(annotations.resolve_units(units, docs), threshold)
    return annotations.merge_intervals(single)


class ParagraphClient:
    """A deterministic stand-in for an annotator: each longer line of the prompt's text is a unit."""

    def __call__(self, prompt: str) -> str:
        lines = [x.strip() for x in prompt.split("\n\n", 1)[1].split("\n")]
        units = [{"unit_id": k, "text_start": x[:30], "text_end": x[-20:], "unit_type": "sans_isnad", "has_isnad": False, "isnad_text": x.split(",")[0] if "," in x else None} for k, x in enumerate(lines) if len(x) > 60]
        return "```json\n" + json.dumps({"units": units}, ensure_ascii=False) + "\n```"

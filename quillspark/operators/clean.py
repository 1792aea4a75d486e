"""Cleaning of marked-up prose: header, line markup, continuations, annotations, white space.

All steps are expressions on one text column, so a scan, the cleaning and what follows stay in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import WS, word_count

#: White space but for the line end.
GAP = r"[\s\x1c-\x1f&&[^\n]]"


def remove_header(c: Column) -> Column:
    """Drops the text up to the first end-of-header mark and the white space to a line end, then a metadata section."""
    c = F.regexp_replace(c, rf"(?Us)\A.*?#META#Header#End#{WS}*\n", "")
    return F.regexp_replace(c, rf"(?Us)\A.*?###{WS}*\|HEADER-METADATA\|.*?###{WS}*\|END HEADER\|", "")


def filter_lines(c: Column) -> Column:
    """Drops metadata, heading and empty marker lines; strips a page mark at the end of a line."""
    kept = F.filter(F.split(c, "\n", -1), lambda x: ~x.rlike(rf"(?U)\A{WS}*+(?:#META#|######OpenITI#)"))
    bare = F.transform(kept, lambda x: F.when(x.contains("PageV"), F.regexp_replace(x, rf"(?U){WS}*PageV\d+P\d+{WS}*\z", "")).otherwise(x))
    return F.array_join(F.filter(bare, lambda x: ~x.startswith("#") | ~x.rlike(rf"(?U)\A(?:###{WS}*\||#{WS}*\z)")), "\n")


def join_continuations(c: Column) -> Column:
    """Lines that start with ~~ continue the line before, after one space; empty lines go."""
    c = F.regexp_replace(c, rf"(?U)(?<=[^\n])\n~~{GAP}*+", " ")
    c = F.regexp_replace(c, rf"(?U)(?:(?<=\n)|\A)~~{GAP}*+", "")
    return F.regexp_replace(F.regexp_replace(c, "\n{2,}", "\n"), r"\A\n|\n\z", "")


def remove_annotations(c: Column) -> Column:
    """Footnote marks become a space; page references and bracketed notes that start a line go, with the space before."""
    c = F.regexp_replace(c, rf"(?U){WS}*ms\d+{WS}*", " ")
    c = F.regexp_replace(c, rf"(?U){WS}*\[ص:{WS}*\d+\]", "")
    return F.regexp_replace(c, rf"(?Ud)(?:(?<=\n)|\A){WS}*\[[^\n]*?:\]{WS}*", "")


def tidy_spaces(c: Column) -> Column:
    """Strips every line, keeps empty lines inside and drops those at the end."""
    c = F.regexp_replace(c, rf"(?U){GAP}++(?=\n|\z)|(?:(?<=\n)|\A){GAP}++", "")
    return F.regexp_replace(c, r"\n+\z", "")


STEPS = (remove_header, filter_lines, join_continuations, remove_annotations, tidy_spaces)


def clean(c: Column) -> Column:
    for step in STEPS:
        c = step(c)
    return c


def clean_stats(before: Column, after: Column) -> list[Column]:
    """Sizes before and after cleaning, words, the share of characters without blanks that stayed (0 for an empty text), a sample."""
    dense = lambda c: F.length(F.replace(F.replace(c, F.lit(" ")), F.lit("\n"))).cast("long")
    lines = lambda c: F.regexp_count(c, F.lit("\n")).cast("long")
    return [
        lines(before).alias("original_lines"), lines(after).alias("cleaned_lines"),
        F.length(before).cast("long").alias("original_chars"), F.length(after).cast("long").alias("cleaned_chars"),
        (F.length(before) - F.length(after)).cast("long").alias("removed_chars"), word_count(after).alias("words"),
        F.when(dense(before) > 0, dense(after) / dense(before)).otherwise(0.0).alias("content_retention"),
        F.substring(F.array_join(F.slice(F.split(after, "\n", -1), 6, 5), "\n"), 1, 300).alias("sample_text"),
    ]


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text cleaned."""
    return docs.withColumn(text, clean(F.col(text)))

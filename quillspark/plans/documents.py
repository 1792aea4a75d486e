"""Queries over ``documents``, ``pages`` and ``benchmark``: cleaning, chunks, segments, records, locating, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.lexicon import CHAIN_STEMS, LATIN_QUOTE, LATIN_STEMS, QUOTE
from quillspark.functions.text import escape_html, normalize_arabic
from quillspark.operators import annotations, boundaries, chunks, clean, onepass, records, report, scoring, segments
from quillspark.operators.slices import with_slices
from quillspark.plans import lifecycles
from quillspark.plans._read import spread, table
from quillspark.sources.files import name_of

LATIN = segments.Segmenter(LATIN_STEMS, LATIN_QUOTE, normalized=False)
VERBS = {"verbs": LATIN_STEMS}


def marked(docs: DataFrame) -> DataFrame:
    """Documents with the markup that the cleaner removes; the test tables have none of their own."""
    t = F.replace(F.replace(F.replace("text", F.lit(".\n"), F.lit(". PageV01P002\n")), F.lit(", "), F.lit(" ms12 ")), F.lit(" la "), F.lit("\n~~ la "))
    t = F.replace(F.replace(t, F.lit(" der "), F.lit("\n[note 1:] der ")), F.lit(" with "), F.lit(" [ص: 23] with "))
    return docs.select("doc_id", F.concat(F.lit("######OpenITI#\n#META# a\n#META#Header#End#\n\n\n### | title\n#\n# keep\n\n"), t, F.lit("\n \n\n")).alias("text"))


MARKED_SQL = r"""marked AS (SELECT doc_id, '######OpenITI#' || chr(10) || '#META# a' || chr(10) || '#META#Header#End#' || chr(10) || chr(10) || chr(10) || '### | title' || chr(10) || '#' || chr(10) || '# keep' || chr(10) || chr(10)
    || replace(replace(replace(replace(replace(text, '.' || chr(10), '. PageV01P002' || chr(10)), ', ', ' ms12 '), ' la ', chr(10) || '~~ la '), ' der ', chr(10) || '[note 1:] der '), ' with ', ' [ص: 23] with ') || chr(10) || ' ' || chr(10) || chr(10) AS text FROM documents),
c1 AS (SELECT doc_id, text AS raw, regexp_replace(text, '(?s)^.*?#META#Header#End#\s*\n', '') AS t FROM marked),
c2 AS (SELECT doc_id, raw, array_to_string(list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(#META#|######OpenITI#)')), lambda x: regexp_replace(x, '\s*PageV\d+P\d+\s*$', '')), lambda x: NOT regexp_matches(x, '^(###\s*\||#\s*$)')), chr(10)) AS t FROM c1),
c3 AS (SELECT doc_id, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([^\n])\n~~[ \t]*', '\1 ', 'g'), '(?m)^~~[ \t]*', '', 'g'), '\n{2,}', chr(10), 'g'), '^\n|\n$', '', 'g') AS t FROM c2),
c4 AS (SELECT doc_id, raw, regexp_replace(regexp_replace(regexp_replace(t, '\s*ms\d+\s*', ' ', 'g'), '\s*\[ص:\s*\d+\]', '', 'g'), '(?m)^\s*\[[^\n]*?:\]\s*', '', 'g') AS t FROM c3),
cleaned AS (SELECT doc_id, raw, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n+$', '') AS t FROM c4)"""

def starts_sql(stems: tuple[str, ...], quote: str, src: str) -> str:
    """Segments of ``src`` (doc_id, text as it is searched, orig as it is cut) by the stems; the shortest stem decides where the search goes on."""
    some, q = "|".join(sorted(stems, key=len)), len(quote)
    return rf"""src0 AS ({src}),
m AS (SELECT doc_id, text, regexp_extract_all(text, '(?:{some})(?s:.)?') AS ms, string_split_regex(text, '(?:{some})(?s:.)?') AS sp FROM src0),
e AS (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, unnest(list_transform(ms, lambda x: len(x))) AS ml, unnest(list_transform(sp[1:len(ms)], lambda x: len(x))) AS gl FROM m),
starts AS (SELECT doc_id, k, (sum(gl + ml) OVER (PARTITION BY doc_id ORDER BY k) - ml)::BIGINT AS s FROM e),
mk AS (SELECT s.doc_id, s.s, coalesce(lead(s.s) OVER (PARTITION BY s.doc_id ORDER BY s.s), len(d.text)) AS nx FROM starts s JOIN src0 d USING (doc_id)),
q0 AS (SELECT doc_id, text, string_split(text, '{quote}') AS sp FROM src0),
q1 AS (SELECT doc_id, unnest(range(1, len(sp))) AS k, unnest(list_transform(sp[1:len(sp) - 1], lambda x: len(x))) AS gl FROM q0),
q2 AS (SELECT doc_id, (sum(gl + {q}) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS qe FROM q1),
q3 AS (SELECT q2.doc_id, qe, qe + len(regexp_extract(substr(text, qe + 1, 100), '^[ \n\t]*')) AS ws, text FROM q2 JOIN src0 USING (doc_id)),
q AS (SELECT doc_id, qe, ws FROM q3 WHERE NOT regexp_matches(substr(text, ws + 1, 8), '^(?:{some})')),
en AS (SELECT mk.doc_id, s, nx, min(ws) AS ws FROM mk LEFT JOIN q ON q.doc_id = mk.doc_id AND qe >= s + {q} AND qe <= s + least(900, nx - s + 50) GROUP BY ALL),
fx AS (SELECT doc_id, s, nx, CASE WHEN coalesce(ws, s + 150) > nx THEN least(s + 400, nx) ELSE coalesce(ws, s + 150) END AS en FROM en)"""


_CUT_SQL = r""",
segs AS (SELECT f.doc_id, (row_number() OVER (PARTITION BY f.doc_id ORDER BY s) - 1)::BIGINT AS id, s AS start, en::BIGINT AS "end", left(trim(substr(orig, s + 1, en - s), ' ' || chr(10)), 100) AS header, (en - s)::BIGINT AS header_len, (nx - en)::BIGINT AS body_len, text
  FROM fx f JOIN src0 USING (doc_id) WHERE en - s >= 8 AND trim(substr(orig, s + 1, en - s), ' ' || chr(10)) <> '')"""
_BACK_SQL = r""",
bk AS (SELECT doc_id, orig, list_append(list_filter(range(0, len(orig)), lambda i: NOT regexp_matches(cs[i + 1], '[\x{64B}-\x{65F}\x{670}]')), len(orig)) AS b FROM (SELECT doc_id, orig, string_split(orig, '') AS cs FROM src0)),
sg AS (SELECT f.doc_id, f.s, b[s + 1] AS bs, b[en + 1] AS be, b[nx + 1] AS bn, trim(substr(orig, b[s + 1] + 1, b[en + 1] - b[s + 1]), ' ' || chr(10)) AS h, en - s AS w FROM fx f JOIN bk USING (doc_id)),
segs AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS id, bs::BIGINT AS start, be::BIGINT AS "end", left(h, 100) AS header, (be - bs)::BIGINT AS header_len, (bn - be)::BIGINT AS body_len FROM sg WHERE w >= 8 AND h <> '')"""
STARTS_SQL = starts_sql(LATIN_STEMS, LATIN_QUOTE, "SELECT doc_id, text, text AS orig FROM documents") + _CUT_SQL
_ARABIC = (("the", "قَالَ"), ("and", "حَدَّثنا"), ("der", "أخبرنا"), ("de", "سَمِعْتُ"), ("of", "وحدثني"), ("la", "رَواه"), ("in", "بلغني"), ("die", "أنبأنا"))


def arabic(docs: DataFrame) -> DataFrame:
    """Documents with frequent words exchanged for Arabic ones, some with vowel marks: the test tables have no Arabic."""
    text = F.col("text")
    for word, other in _ARABIC:
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {other} "))
    return docs.select("doc_id", text.alias("text"))


def _arabic_sql() -> str:
    text = "text"
    for word, other in _ARABIC:
        text = f"replace({text}, ' {word} ', ' {other} ')"
    plain = r"translate(regexp_replace(orig, '[\x{64B}-\x{65F}\x{670}]', '', 'g'), 'أإآٱةى', 'ااااهي')"
    return starts_sql(CHAIN_STEMS, QUOTE, f"SELECT doc_id, orig, {plain} AS text FROM (SELECT doc_id, {text} AS orig FROM documents)")


HEADER_SQL = r"""regexp_replace(regexp_extract(left({0}, 200), '(?s)^(.*(?:that|with|para|eaux|schr|ment|thon)[^۔。.،,\n]*)', 1), '^\s+|\s+$', '', 'g')"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.marker_segments(spread(table(spark, d, "documents").select("doc_id", "text")), LATIN)


def marker_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def arabic_segments(spark: SparkSession, d: str) -> DataFrame:
    """The default word lists over normalized text, with offsets as they are found there."""
    return segments.marker_segments(arabic(spread(table(spark, d, "documents"))), segments.Segmenter())


def arabic_segments_mapped(spark: SparkSession, d: str) -> DataFrame:
    """The same with offsets mapped back to the text as it was."""
    return segments.marker_segments(arabic(spread(table(spark, d, "documents"))), segments.Segmenter(original_offsets=True))


def segment_gaps(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_gaps(_segments(spark, d))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.fixed_chunks(table(spark, d, "documents")).select("doc_id", "chunk_id", "start", "end", F.md5("text").alias("digest"))


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    n = chunks.chunk_count(F.length("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n_chunks"), chunks.workers(n).alias("n_workers"))


def smart_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.smart_chunks(spread(table(spark, d, "documents").select("doc_id", "text")), 700, 100, 100)


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_documents(marked(spread(table(spark, d, "documents").select("doc_id", "text")))).select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = marked(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "text", clean.clean(F.col("text")).alias("after"))
    return rows.select("doc_id", *clean.clean_stats(F.col("text"), F.col("after"))).withColumn("content_retention", F.round("content_retention", 9)).withColumn("sample_text", F.md5("sample_text"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(escape_html(F.col("html"))).alias("digest"))


def header_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", segments.header_prefix(F.col("text"), **VERBS).alias("header_text"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Accented Latin letters stand for the marked Arabic ones: the table has no Arabic, so some letters are exchanged first."""
    return table(spark, d, "documents").select("doc_id", F.md5(normalize_arabic(F.translate("text", "aeo", "أىُ"))).alias("digest"))


def greedy_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).select("doc_id", F.col("id").alias("boundary_id"), F.col("start").alias("char_start"))
    return records.spaced(rows, 200).select("doc_id", "char_start")


def _boundaries(spark: SparkSession, d: str) -> DataFrame:
    prob = (F.col("header_len") % 100) / 100.0
    return _segments(spark, d).select("doc_id", F.col("id").alias("boundary_id"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), prob.alias("max_prob"), F.split("header", " ").alias("tokens"))


def build_records(spark: SparkSession, d: str) -> DataFrame:
    return records.build_records(_boundaries(spark, d), table(spark, d, "documents")).withColumn("body", F.md5("body"))


def record_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = records.record_totals(records.build_records(_boundaries(spark, d), table(spark, d, "documents")))
    return rows.withColumn("avg_header", F.round("avg_header", 6)).withColumn("avg_body", F.round("avg_body", 6))


def narrative_units(spark: SparkSession, d: str) -> DataFrame:
    return records.unit_source(None, _segments(spark, d), table(spark, d, "documents"), **VERBS)


def unit_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.unit_summary(narrative_units(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 9) for n in names})


def scored_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Chunks through the stand-in scorer: tokens with absolute offsets, without the overlap's first ones."""
    return onepass.token_table(_texts(spark, d), scoring.HashScorer, 9)


def inference_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(onepass.inference_stats(_texts(spark, d), scoring.HashScorer), "boundary_percentage", "mean_prob")


def boundary_tokens(spark: SparkSession, d: str) -> DataFrame:
    return onepass.boundary_tokens(_texts(spark, d), scoring.HashScorer)


def offset_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(onepass.offset_accuracy(_texts(spark, d), scoring.HashScorer), "accuracy")


def boundary_positions(spark: SparkSession, d: str) -> DataFrame:
    return onepass.boundary_positions(_texts(spark, d), scoring.HashScorer, 9)


def _shown(clusters: DataFrame) -> DataFrame:
    return _rounded(clusters.withColumn("tokens", F.array_join("tokens", " ")), "max_prob")


def clusters_in_context(spark: SparkSession, d: str) -> DataFrame:
    return _shown(onepass.gap_clusters(_texts(spark, d), scoring.HashScorer, 5, lifecycles.CONTEXT))


def cluster_units(spark: SparkSession, d: str) -> DataFrame:
    """Units from the scorer's clusters, with the headers in their text."""
    rows = onepass.gap_clusters(_texts(spark, d), scoring.HashScorer, 5, {"span": (0, 0)})
    return records.units_of_spans(rows.withColumnRenamed("boundary_id", "unit_id"), **VERBS)


def mid_word(spark: SparkSession, d: str) -> DataFrame:
    return boundaries.mid_word_boundaries(_boundaries(spark, d), table(spark, d, "documents"))


def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    rows = report.confidence_stats(_boundaries(spark, d), lengths)
    return rows.withColumn("avg_length", F.round("avg_length", 6)).withColumn("coverage", F.round("coverage", 6))


def boundary_colors(spark: SparkSession, d: str) -> DataFrame:
    return _boundaries(spark, d).select("doc_id", "boundary_id", report.color(F.col("max_prob")).alias("color"))


def report_pages(spark: SparkSession, d: str) -> DataFrame:
    return report.pages(_boundaries(spark, d), table(spark, d, "documents")).select("doc_id", F.md5("html").alias("digest"))


def locate_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text in every document that holds it."""
    return annotations.holding_documents(table(spark, d, "benchmark").select(F.col("item_id").alias("unit_id"), "text"), table(spark, d, "documents"))


def resolve_units(spark: SparkSession, d: str) -> DataFrame:
    """Passages as an annotator names them, by their first and last words, located near where they stand."""
    found = locate_passages(spark, d).select("doc_id", "unit_id", F.greatest(F.col("char_start") - 500, F.lit(0)).alias("chunk_start"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("unit_id"), F.substring("text", 1, 40).alias("text_start"), F.expr("right(text, 20)").alias("text_end"))
    return annotations.resolve_units(found.join(items, "unit_id"), table(spark, d, "documents")).select("doc_id", "unit_id", "char_start", "char_end", "start_found", "end_found")


def parse_replies(spark: SparkSession, d: str) -> DataFrame:
    """Segments as an annotator's replies in three wrappings, parsed back."""
    part = F.struct(F.col("id").alias("unit_id"), F.col("header").alias("text_start"), F.col("header").alias("text_end"), F.lit("avec_isnad").alias("unit_type"), F.lit(True).alias("has_isnad"), F.lit(None).cast("string").alias("isnad_text"))
    rows = _segments(spark, d).groupBy("doc_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(part)).alias("units"))).alias("json"))
    reply = F.when(F.col("doc_id") % 3 == 0, F.col("json")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "json", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("So "), "json", F.lit(" it is.")))
    units = rows.select("doc_id", F.inline(annotations.parse_reply(reply)))
    return units.select("doc_id", "unit_id", "text_start", "has_isnad")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = with_slices(smart_chunks(spark, d), table(spark, d, "documents"), {"text": (F.col("start"), F.col("end"))})
    return rows.select("doc_id", "chunk_id", F.md5(annotations.prompt(F.col("text"))).alias("digest"))


def annotated_units(spark: SparkSession, d: str) -> DataFrame:
    """Chunks through a stand-in annotator: located, without duplicates, merged."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    rows = lifecycles.by_annotator(docs, lifecycles.ParagraphClient, 1500, 300, 100)
    return rows.withColumn("merged_from", F.array_join("merged_from", ","))


def scorer_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Marked-up documents cleaned, scored and clustered."""
    return _shown(lifecycles.by_scorer(spread(marked(table(spark, d, "documents"))), scoring.HashScorer, 5)[1])


def text_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", name_of(F.regexp_replace("url", "[?#].*", "")).alias("name"), report.name_from_stem(F.regexp_replace("url", "[?#].*", ""), "http://", "/").alias("stem"))


QUERIES = {f.__name__: f for f in (
    marker_segments, arabic_segments, arabic_segments_mapped, segment_gaps, fixed_chunks, chunk_counts, smart_chunks, clean_text, clean_stats, html_escape, header_prefix, normalize_text, greedy_filter,
    build_records, record_totals, narrative_units, unit_summary, scored_tokens, inference_stats, boundary_tokens, offset_accuracy, boundary_positions, clusters_in_context, cluster_units,
    mid_word, confidence_bands, boundary_colors, report_pages, locate_passages, resolve_units, parse_replies, prompts, annotated_units, scorer_lifecycle, text_names,
)}

_BOUNDS_SQL = STARTS_SQL + ", bd AS (SELECT doc_id, id AS boundary_id, start AS char_start, \"end\" AS char_end, (header_len % 100) / 100.0::DOUBLE AS max_prob, text FROM segs)"
_SPACED_SQL = """, nxt AS (SELECT a.doc_id, a.char_start AS s, min(b.char_start) AS t FROM bd a JOIN bd b ON a.doc_id = b.doc_id AND a.char_start + {0} <= b.char_start GROUP BY a.doc_id, a.char_start),
kept AS (SELECT doc_id, min(char_start) AS s FROM bd WHERE char_start >= {0} GROUP BY doc_id UNION ALL SELECT kept.doc_id, nxt.t FROM kept JOIN nxt ON nxt.doc_id = kept.doc_id AND nxt.s = kept.s WHERE nxt.t IS NOT NULL)"""
_RECORDS_SQL = "WITH RECURSIVE " + _BOUNDS_SQL + _SPACED_SQL.format(50) + r""",
r0 AS (SELECT bd.*, lead(char_start) OVER (PARTITION BY bd.doc_id ORDER BY char_start) AS nx FROM bd JOIN kept ON kept.doc_id = bd.doc_id AND kept.s = bd.char_start),
r1 AS (SELECT *, regexp_replace(substr(text, char_start + 1, char_end - char_start), '^\s+|\s+$', '', 'g') AS header, regexp_replace(substr(text, char_end + 1, coalesce(nx, len(text)) - char_end), '^\s+|\s+$', '', 'g') AS body FROM r0),
rec AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1)::BIGINT AS id, char_start, (char_end + len(body))::BIGINT AS char_end, header, md5(body) AS body, len(header)::BIGINT AS header_length, len(body)::BIGINT AS body_length, max_prob AS confidence FROM r1 WHERE len(header) >= 5)
"""
_TOKEN = "[0-9A-Za-z]+|[^0-9A-Za-z \\t\\n\\r\\f\\v]"
_TOKENS_SQL = rf"""ch AS (SELECT doc_id, text, unnest(range(0, len(text), 500)) AS cs FROM src),
ck AS (SELECT doc_id, cs, cs // 500 AS ci, substr(text, cs + 1, 550) AS x FROM ch),
cm AS (SELECT doc_id, cs, ci, regexp_extract_all(x, '{_TOKEN}') AS ts, string_split_regex(x, '{_TOKEN}') AS gs FROM ck),
cu AS (SELECT doc_id, cs, ci, unnest(range(1, len(ts) + 1)) AS tok, unnest(ts) AS token, unnest(list_transform(gs[1:len(ts)], lambda g: len(g))) AS g FROM cm),
cp AS (SELECT doc_id, cs, ci, tok, token, (sum(g + len(token)) OVER (PARTITION BY doc_id, ci ORDER BY tok))::BIGINT AS e FROM cu),
ct AS (SELECT doc_id, cs, ci, tok, token, e - len(token) AS b, e, (('0x' || substr(md5(token), 1, 8))::BIGINT % 997) / 100::DOUBLE AS l0, (('0x' || substr(md5(token), 9, 8))::BIGINT % 997) / 100::DOUBLE AS l1 FROM cp
  UNION ALL SELECT doc_id, cs, ci, 0, '[CLS]', 0, 0, 1, 0 FROM cm UNION ALL SELECT doc_id, cs, ci, len(ts) + 1, '[SEP]', 0, 0, 1, 0 FROM cm),
tokens AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ci, tok) - 1)::BIGINT AS tok_idx, token, (b + cs)::BIGINT AS char_start, (e + cs)::BIGINT AS char_end, (l1 > l0)::INT AS pred, 1 / (1 + exp(l0 - l1)) AS prob FROM ct WHERE ci = 0 OR tok >= 5)"""
_POSITIONS_SQL = _TOKENS_SQL + """,
pos AS (SELECT doc_id, char_start AS pos, prob, token FROM tokens JOIN (SELECT doc_id, len(text) AS n FROM src) USING (doc_id) WHERE pred = 1 AND token NOT IN ('[PAD]', '[CLS]', '[SEP]', '[UNK]') AND NOT (char_start = 0 AND char_end = 0) AND char_start <= n
  QUALIFY row_number() OVER (PARTITION BY doc_id, char_start ORDER BY prob DESC, tok_idx) = 1)"""
_CLUSTERS_SQL = _POSITIONS_SQL + """,
gf AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 5)::INT, 0) AS f FROM pos),
gn AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM gf),
cl AS (SELECT doc_id, b::BIGINT AS boundary_id, min(pos) AS char_start, max(pos) AS char_end, count(*) AS n_tokens, array_to_string(list(token ORDER BY pos)[1:10], ' ') AS tokens, round(max(prob), 9) AS max_prob FROM gn GROUP BY doc_id, b)"""
_SRC = "src AS (SELECT doc_id, text FROM documents), "
_CONTEXT = "SELECT cl.*, substr(text, greatest(char_start - 40, 0) + 1, char_end + 80 - greatest(char_start - 40, 0)) AS text_context FROM cl JOIN src USING (doc_id)"


def _escaped(x: str) -> str:
    for char, entity in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'\"'", "&quot;"), ("chr(39)", "&#39;")):
        x = f"replace({x}, {char}, '{entity}')"
    return f"replace({x}, chr(10), '<br>' || chr(10))"


def _report_sql() -> str:
    near = lambda n: f"replace({_escaped(f'substr(text, greatest(a - {n}, 0) + 1, b + {n} - greatest(a - {n}, 0))')}, '<br>' || chr(10), ' | ')"
    page = report.PAGE.replace(chr(39), 2 * chr(39)).replace("%%", "%").split("%s")
    head, numbers, tail = page[1].split("%d")[0], page[2], page[3:]
    bars = numbers
    for c in ("n", "high", "medium", "low"):
        bars = bars.replace("%d", f"' || {c} || '", 1)
    bars = bars.replace("%.1f", "' || format('{:.1f}', round(avg_length, 1)) || '", 1).replace("%.2f", "' || format('{:.2f}', round(coverage, 2)) || '", 1)
    for c in ("high", "medium", "low"):
        bars = bars.replace("%.1f", f"' || format('{{:.1f}}', CASE WHEN n > 0 THEN round(90.0::DOUBLE * {c} / n, 1) ELSE 0::DOUBLE END) || '", 1)
    assert head == page[1] and len(tail) == 2
    return f"""WITH {STARTS_SQL}, bb AS (SELECT doc_id, id, start AS a, "end" AS b, (header_len % 100) / 100.0::DOUBLE AS p, string_split(header, ' ') AS toks, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY id), 0) AS last, text FROM segs),
    mk2 AS (SELECT doc_id, id, b, p, a, {_escaped('substr(text, last + 1, greatest(a - last, 0))')} || '<mark id="b' || id || '" class="' || CASE WHEN p > 0.95::DOUBLE THEN 'high' WHEN p > 0.8::DOUBLE THEN 'medium' ELSE 'low' END || '" data-prob="' || printf('%.3f', p)
      || '" data-tokens="' || {_escaped("array_to_string(toks[1:5], ', ')")} || '" data-around="' || {near(100)} || '">' || {_escaped('substr(text, a + 1, b - a)')} || '</mark>' AS part,
      '<li value="' || id || '"><a href="#b' || id || '">' || printf('%.3f', p) || '</a> <q>' || {near(150)} || '</q></li>' || chr(10) AS detail FROM bb),
    ag AS (SELECT doc_id, string_agg(part, '' ORDER BY id) AS body, string_agg(detail, '' ORDER BY id) AS details, arg_max(b, id) AS last, count(*) AS n, sum(b - a)::DOUBLE AS span, count(*) FILTER (p > 0.95::DOUBLE) AS high, count(*) FILTER (p >= 0.8::DOUBLE AND p <= 0.95::DOUBLE) AS medium, count(*) FILTER (p < 0.8::DOUBLE) AS low FROM mk2 GROUP BY doc_id),
    al AS (SELECT d.doc_id, coalesce(body, '') || {_escaped('substr(d.text, coalesce(last, 0) + 1)')} AS html, coalesce(details, '') AS details, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, CASE WHEN n > 0 THEN span / n ELSE 0 END AS avg_length, CASE WHEN len(d.text) > 0 THEN coalesce(span, 0) / len(d.text) * 100 ELSE 0 END AS coverage FROM documents d LEFT JOIN ag USING (doc_id))
    SELECT doc_id, md5('{page[0]}' || doc_id || '{page[1]}' || doc_id || '{bars}' || html || '{tail[0]}' || details || '{tail[1]}') AS digest FROM al"""


def _ends_sql(size: int) -> str:
    """Where a chunk of ``size`` characters from a ends; delimiters as in ``smart_chunks``, of which the tables have two."""
    region = f"substr(text, greatest(a + {size} - 200, a) + 1, a + {size} - greatest(a + {size} - 200, a))"
    back = "".join(f" WHEN strpos(reverse({region}), {m}) > 0 THEN a + {size} - strpos(reverse({region}), {m}) + 1" for m in ("chr(10)", "'،'", "' '"))
    return f"CASE WHEN a + {size} >= n THEN n{back} ELSE a + {size} END"


def _chunks_sql(size: int, overlap: int, least: int) -> str:
    end = _ends_sql(size)
    return f"""c0 AS (SELECT doc_id, text, len(text) AS n, 0::BIGINT AS a FROM documents WHERE len(text) > 0),
    w0 AS (SELECT doc_id, text, n, a, ({end})::BIGINT AS e FROM c0 UNION ALL SELECT doc_id, text, n, a, ({end})::BIGINT AS e FROM (SELECT doc_id, text, n, e - least({overlap}, (e - a) // 2) AS a FROM w0 WHERE e < n)),
    sc AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::BIGINT AS chunk_id, a, e, substr(text, a + 1, e - a) AS x, text FROM w0 WHERE e - a >= {least} OR e >= n)"""


def stays_sql(source: str) -> str:
    """Recursive steps over the sorted units of ``source`` (doc_id, s, e, n, o): win stands for what is met, last is the last it stood for, j is looked at."""
    inside = "j <= len(u) AND u[j].s - u[win].s <= 50"
    dup = f"{inside} AND abs(u[j].e - u[win].e) <= 50"
    return f"""us AS (SELECT doc_id, list({{'s': s, 'e': e, 'n': n, 'o': o}} ORDER BY s, e, o) AS u FROM {source} GROUP BY doc_id),
    st AS (SELECT doc_id, u, 1::BIGINT AS win, 1::BIGINT AS last, 2::BIGINT AS j, NULL::BIGINT AS o FROM us
      UNION ALL SELECT doc_id, u, CASE WHEN NOT ({inside}) THEN last + 1 WHEN {dup} AND u[j].n > u[win].n THEN j ELSE win END, CASE WHEN NOT ({inside}) THEN last + 1 WHEN {dup} THEN j ELSE last END,
        CASE WHEN NOT ({inside}) THEN last + 2 ELSE j + 1 END, CASE WHEN NOT ({inside}) THEN u[win].o END FROM st WHERE win <= len(u)),
    stays AS (SELECT doc_id, o FROM st WHERE o IS NOT NULL)"""


_ANNOTATED_SQL = "WITH RECURSIVE " + _chunks_sql(1500, 300, 100) + r""",
    li AS (SELECT doc_id, chunk_id, a, text, unnest(string_split(x, chr(10))) AS y, unnest(range(0, len(string_split(x, chr(10))))) AS k FROM sc),
    lt AS (SELECT doc_id, chunk_id, a, text, k, regexp_replace(y, '^\s+|\s+$', '', 'g') AS y FROM li),
    un AS (SELECT doc_id, chunk_id * 100000 + row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY k) - 1 AS o, k AS unit_id, text, greatest(a - 100, 0) AS f, regexp_replace(left(y, 30), '^\s+|\s+$', '', 'g') AS s, regexp_replace(right(y, 20), '^\s+|\s+$', '', 'g') AS z,
      CASE WHEN contains(y, ',') THEN string_split(y, ',')[1] END AS h FROM lt WHERE len(y) > 60),
    pl AS (SELECT *, f + strpos(substr(text, f + 1), s) - 1 AS cs FROM un),
    pe AS (SELECT *, cs + len(s) AS q, strpos(substr(text, cs + len(s) + 1), z) AS i1, strpos(substr(text, cs + len(s) + 1), left(z, least(20, len(z) // 2)::BIGINT)) AS i2 FROM pl),
    lo AS (SELECT doc_id, o, unit_id, cs AS s, CASE WHEN len(z) >= 3 AND i1 > 0 THEN q + i1 - 1 + len(z) WHEN len(z) >= 3 AND i2 > 0 THEN q + i2 - 1 + len(z) ELSE least(cs + 400, len(text)) END AS e, h, coalesce(len(h), 0) AS n, len(text) AS tn FROM pe),
    ok AS (SELECT * FROM lo WHERE s < e AND e <= tn), """ + stays_sql("ok") + """,
    iv AS (SELECT ok.* FROM ok JOIN stays ON stays.doc_id = ok.doc_id AND stays.o = ok.o),
    io AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, o) AS r, coalesce((s >= max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS fl FROM iv),
    ii AS (SELECT *, sum(fl) OVER (PARTITION BY doc_id ORDER BY r) AS isl FROM io),
    im AS (SELECT doc_id, isl, min(s)::BIGINT AS char_start, max(e)::BIGINT AS char_end, arg_max(h, r) FILTER (len(h) > 0) AS header_text, CASE WHEN count(*) > 1 THEN string_agg(unit_id::VARCHAR, ',' ORDER BY r) END AS merged_from FROM ii GROUP BY doc_id, isl)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1)::BIGINT AS unit_id, char_start, char_end, header_text, header_text IS NOT NULL AS has_header, merged_from FROM im"""
_PROMPT = annotations.PROMPT.replace(chr(39), 2 * chr(39))

ORACLES = {
    "scored_tokens": f"WITH {_SRC}{_TOKENS_SQL} SELECT * REPLACE (round(prob, 9) AS prob) FROM tokens",
    "inference_stats": f"WITH {_SRC}{_TOKENS_SQL} SELECT doc_id, count(*) AS total_tokens, sum(pred)::BIGINT AS boundary_tokens, round(100.0::DOUBLE * sum(pred) / count(*), 9) AS boundary_percentage, round(avg(prob), 9) AS mean_prob FROM tokens GROUP BY doc_id",
    "boundary_tokens": f"WITH {_SRC}{_TOKENS_SQL} SELECT doc_id, tok_idx, token, char_start FROM tokens WHERE pred = 1",
    "offset_accuracy": f"WITH {_SRC}{_TOKENS_SQL} SELECT doc_id, count(*) AS n_sampled, round(100.0::DOUBLE * count(*) FILTER (char_end <= len(text) AND substr(text, char_start + 1, char_end - char_start) = ltrim(token, '#')) / count(*), 9) AS accuracy FROM tokens JOIN src USING (doc_id) WHERE tok_idx < 100 GROUP BY doc_id",
    "boundary_positions": f"WITH {_SRC}{_POSITIONS_SQL} SELECT * REPLACE (round(prob, 9) AS prob) FROM pos",
    "clusters_in_context": f"WITH {_SRC}{_CLUSTERS_SQL} {_CONTEXT}",
    "cluster_units": f"WITH {_SRC}{_CLUSTERS_SQL}, sp AS (SELECT doc_id, boundary_id, char_start, char_end, substr(text, char_start + 1, char_end - char_start) AS sp FROM cl JOIN src USING (doc_id)), hd AS (SELECT *, {HEADER_SQL.format('sp')} AS h FROM sp) SELECT doc_id, boundary_id AS unit_id, 'record' AS type, char_start, char_end, len(h) > 10 AS has_header, CASE WHEN len(h) > 10 THEN h END AS header_text, len(sp)::BIGINT AS text_length FROM hd",
    "scorer_lifecycle": f"WITH {MARKED_SQL}, src AS (SELECT doc_id, t AS text FROM cleaned), {_CLUSTERS_SQL} {_CONTEXT}",
    "report_pages": _report_sql(),
    "prompts": f"WITH RECURSIVE {_chunks_sql(700, 100, 100)} SELECT doc_id, chunk_id, md5(replace('{_PROMPT}', '{{text}}', x)) AS digest FROM sc",
    "annotated_units": _ANNOTATED_SQL,
    "marker_segments": f"WITH {STARTS_SQL} SELECT doc_id, id, start, \"end\", header, header_len, body_len FROM segs",
    "arabic_segments": f"WITH {_arabic_sql()}{_CUT_SQL} SELECT doc_id, id, start, \"end\", header, header_len, body_len FROM segs",
    "arabic_segments_mapped": f"WITH {_arabic_sql()}{_BACK_SQL} SELECT * FROM segs",
    "segment_gaps": f"WITH {STARTS_SQL}, g AS (SELECT doc_id, start - lag(\"end\") OVER (PARTITION BY doc_id ORDER BY start) AS gap FROM segs) SELECT doc_id, min(gap) AS min_gap, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median_gap, max(gap) AS max_gap, count(*) FILTER (gap > 100) AS over_100, count(*) FILTER (gap > 500) AS over_500 FROM g WHERE gap IS NOT NULL GROUP BY doc_id",
    "fixed_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(0, len(text), 500)) AS start FROM documents) SELECT doc_id, start // 500 AS chunk_id, start, least(start + 550, len(text)) AS \"end\", md5(substr(text, start + 1, 550)) AS digest FROM c",
    "chunk_counts": "WITH c AS (SELECT doc_id, (len(text) + 499) // 500 AS n_chunks FROM documents) SELECT doc_id, n_chunks, (CASE WHEN n_chunks <= 2 THEN 1 WHEN n_chunks <= 6 THEN least(n_chunks, 4) WHEN n_chunks <= 20 THEN least(n_chunks, 6) ELSE least(n_chunks, 8) END)::BIGINT AS n_workers FROM c",
    "smart_chunks": f"WITH RECURSIVE {_chunks_sql(700, 100, 100)} SELECT doc_id, chunk_id, a AS start, e AS \"end\" FROM sc",
    "clean_text": f"WITH {MARKED_SQL} SELECT doc_id, len(t)::BIGINT AS n, md5(t) AS digest FROM cleaned",
    "clean_stats": f"WITH {MARKED_SQL}, s AS (SELECT doc_id, raw, t, len(replace(replace(raw, ' ', ''), chr(10), '')) AS a, len(replace(replace(t, ' ', ''), chr(10), '')) AS b FROM cleaned) SELECT doc_id, (len(raw) - len(replace(raw, chr(10), '')))::BIGINT AS original_lines, (len(t) - len(replace(t, chr(10), '')))::BIGINT AS cleaned_lines, len(raw)::BIGINT AS original_chars, len(t)::BIGINT AS cleaned_chars, (len(raw) - len(t))::BIGINT AS removed_chars, len(regexp_extract_all(t, '\\S+'))::BIGINT AS words, round(b::DOUBLE / a, 9) AS content_retention, md5(left(array_to_string(string_split(t, chr(10))[6:10], chr(10)), 300)) AS sample_text FROM s",
    "html_escape": "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), chr(10), '<br>' || chr(10))) AS digest FROM pages",
    "header_prefix": f"WITH h AS (SELECT doc_id, {HEADER_SQL.format('text')} AS h FROM documents) SELECT doc_id, CASE WHEN len(h) > 10 THEN h END AS header_text FROM h",
    "normalize_text": "SELECT doc_id, md5(translate(replace(translate(text, 'aeo', 'أىُ'), 'ُ', ''), 'أإآٱةى', 'ااااهي')) AS digest FROM documents",
    "greedy_filter": "WITH RECURSIVE " + _BOUNDS_SQL + _SPACED_SQL.format(200) + " SELECT doc_id, s AS char_start FROM kept",
    "build_records": _RECORDS_SQL + "SELECT * FROM rec",
    "record_totals": _RECORDS_SQL + "SELECT count(*) AS n_records, sum(header_length)::BIGINT AS total_header, sum(body_length)::BIGINT AS total_body, round(avg(header_length), 6) AS avg_header, round(avg(body_length), 6) AS avg_body FROM rec",
    "narrative_units": f"WITH {STARTS_SQL}, u AS (SELECT *, substr(text, start + 1, \"end\" - start) AS sp FROM segs), h AS (SELECT *, {HEADER_SQL.format('sp')} AS h FROM u) SELECT doc_id, id AS unit_id, 'record' AS type, start AS char_start, \"end\" AS char_end, len(h) > 10 AS has_header, CASE WHEN len(h) > 10 THEN h END AS header_text, len(sp)::BIGINT AS text_length FROM h",
    "unit_summary": f"WITH {STARTS_SQL}, h AS (SELECT doc_id, {HEADER_SQL.format('substr(text, start + 1, \"end\" - start)')} AS h FROM segs) SELECT doc_id, count(*) AS n_units, count(*) FILTER (len(h) > 10) AS n_with_header FROM h GROUP BY doc_id",
    "mid_word": f"WITH {_BOUNDS_SQL} SELECT doc_id, count(*) FILTER (char_start > 0 AND char_start < len(text) AND substr(text, char_start, 1) NOT IN (' ', chr(10)) AND substr(text, char_start + 1, 1) NOT IN (' ', chr(10))) AS mid_word_boundaries FROM bd GROUP BY doc_id",
    "confidence_bands": f"WITH {_BOUNDS_SQL} SELECT d.doc_id, count(b.doc_id) AS n_boundaries, round(coalesce(sum(char_end - char_start)::DOUBLE / count(b.doc_id), 0), 6) AS avg_length, round(coalesce(sum(char_end - char_start)::DOUBLE, 0) / len(d.text) * 100, 6) AS coverage, count(*) FILTER (max_prob > 0.95::DOUBLE) AS high, count(*) FILTER (max_prob >= 0.8::DOUBLE AND max_prob <= 0.95::DOUBLE) AS medium, count(*) FILTER (max_prob < 0.8::DOUBLE) AS low FROM documents d LEFT JOIN bd b ON b.doc_id = d.doc_id GROUP BY d.doc_id, d.text",
    "boundary_colors": f"WITH {_BOUNDS_SQL} SELECT doc_id, boundary_id, CASE WHEN max_prob > 0.95::DOUBLE THEN '#6bcf7f' WHEN max_prob > 0.8::DOUBLE THEN '#ffd93d' ELSE '#ff6b6b' END AS color FROM bd",
    "locate_passages": "SELECT doc_id, item_id AS unit_id, (strpos(d.text, b.text) - 1)::BIGINT AS char_start FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "resolve_units": r"WITH p AS (SELECT doc_id, item_id AS unit_id, d.text, regexp_replace(left(b.text, 40), '^\s+|\s+$', '', 'g') AS s, regexp_replace(right(b.text, 20), '^\s+|\s+$', '', 'g') AS e, greatest(greatest(strpos(d.text, b.text) - 1 - 500, 0) - 100, 0) AS f FROM documents d JOIN benchmark b ON contains(d.text, b.text)), q AS (SELECT *, f + strpos(substr(text, f + 1), s) - 1 AS cs FROM p), r AS (SELECT *, strpos(substr(text, cs + len(s) + 1), e) AS x, strpos(substr(text, cs + len(s) + 1), left(e, (len(e) // 2)::BIGINT)) AS y FROM q), t AS (SELECT *, CASE WHEN x > 0 THEN cs + len(s) + x - 1 + len(e) WHEN y > 0 THEN cs + len(s) + y - 1 + len(e) ELSE least(cs + 400, len(text)) END AS ce FROM r) SELECT doc_id, unit_id, cs::BIGINT AS char_start, ce::BIGINT AS char_end, left(s, 50) AS start_found, left(e, 50) AS end_found FROM t WHERE cs < ce AND ce <= len(text)",
    "parse_replies": f"WITH {STARTS_SQL} SELECT doc_id, id AS unit_id, header AS text_start, true AS has_isnad FROM segs",
    "text_names": r"WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*', '') AS u FROM pages) SELECT page_id, string_split(string_split(u, '/')[-1], '.')[1] AS name, replace(replace(u, 'http://', ''), '/', '') AS stem FROM u",
}

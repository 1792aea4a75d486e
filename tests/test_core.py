"""Operators against hand-written cases, published numbers and plain-Python restatements."""

import random
from statistics import mean

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.lexicon import CHAIN_STEMS
from quillspark.operators import annotations, boundaries, chunks, clean, compare, records, report, scoring, segments, training
from quillspark.sources import files

# Published clusters of one text of 15,740 characters, the record starts derived from them, and two unit lists of the same text.
CLUSTERS = [(2, 211), (1248, 1332), (1517, 1689), (2001, 2083), (2630, 2688), (2894, 3008), (3086, 3237), (3424, 3573), (3736, 3809), (4083, 4130), (4349, 4457), (4986, 5053), (5409, 5484), (5815, 5989), (6325, 6459), (7057, 7141), (7690, 7815), (8112, 8220), (9915, 9982), (10245, 10355), (11173, 11332), (11493, 11550), (12397, 12576), (13435, 13504), (15117, 15212), (15285, 15320)]
NEURAL = [2, 1248, 1517, 2001, 2630, 2894, 3086, 3424, 3736, 4083, 4349, 4986, 5409, 5813, 6323, 7055, 7688, 8110, 9911, 10239, 11167, 11487, 12391, 13429, 15113, 15281]
RULES = [27, 1125, 1262, 1415, 1658, 2015, 2644, 2675, 2684, 2962, 2983, 3183, 3220, 3233, 3241, 3259, 3295, 3519, 3556, 3569, 3656, 4127, 4415, 4435, 4445, 4569, 4735, 4998, 5423, 6325, 6388, 6432, 6453, 6684, 6706, 6859, 6943, 7540, 7763, 7949, 8122, 9925, 9964, 9978, 11237, 11371, 11500, 11799, 12233, 12524, 12625, 12775, 13172, 13444, 13474, 13494, 13551, 13690, 15156, 15188, 15281, 15306, 15449]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("step", "given", "wanted"),
    [
        (clean.remove_header, "x\n#META#Header#End#\n\n\nA", "A"),
        (clean.remove_header, "x\n#META# y\nA", "x\n#META# y\nA"),
        (clean.filter_lines, "### | title\n#\ntext PageV01P002\n#META# x\n# keep", "text\n# keep"),
        (clean.join_continuations, "a\n~~ b\n\nc", "a b\nc"),
        (clean.join_continuations, "\n~~x\n\n~~ y\nz", "x\ny\nz"),
        (clean.remove_annotations, "a ms12 b [ص: 23]", "a b"),
        (clean.remove_annotations, "x [ص: ٢٣]", "x"),
        (clean.remove_annotations, "a\n \n[note:] b", "a\nb"),
        (clean.tidy_spaces, " a \n\n b \n \n", "a\n\nb"),
        (T.normalize_arabic, "أُمَّة", "امه"),
        (T.escape_html, "<a & 'b'>\n\"", "&lt;a &amp; &#39;b&#39;&gt;<br>\n&quot;"),
        (T.strip, "\x1c  a b\u0085\n", "a b"),
    ],
)
def test_text_steps(spark, step, given, wanted):
    assert one(spark, given, step) == wanted


def test_clean_of_an_empty_text(spark):
    row = spark.createDataFrame([("",)], "t string").select(*clean.clean_stats(F.col("t"), clean.clean(F.col("t")))).first()
    assert row.content_retention == 0 and row.words == 0


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 1300), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunks.fixed_chunks(docs).orderBy("start").collect()
    assert [(r.start, r.end, len(r.text)) for r in rows] == [(0, 550, 550), (500, 1050, 550), (1000, 1300, 300)]


def test_smart_chunks_follow_the_delimiters():
    text = "word " * 400
    found = chunks.smart_bounds(text, 700, 100, 100, ("\n", " "))
    assert found[0] == (0, 700) and found[1][0] == 600 and found[-1][1] == len(text)
    assert all(text[b - 1] == " " for _, b in found)


def restated_markers(text, stems):
    found, kept, last = sorted((i, s) for s in stems for i in range(len(text)) if text.startswith(s, i)), [], -1
    for at, stem in found:
        if at > last:
            kept.append(at)
            last = at + len(stem)
    return kept


def test_markers_against_a_restatement():
    random.seed(4)
    for stems in (("ab", "abc", "bd", "ca"), CHAIN_STEMS[:9]):
        letters = "".join(sorted(set("".join(stems))))
        seg = segments.Segmenter(stems)
        for _ in range(300):
            text = "".join(random.choice(letters) for _ in range(40))
            assert seg.markers(text) == restated_markers(text, stems)
    assert segments.Segmenter().markers("حدثنسمعت") == [0]
    assert segments.Segmenter(("وروى",)).segments("وروى" + "ا" * 60) == []


def test_segments_and_offset_modes(spark):
    text = "حدَّثنا فلان قال حدثنا زيد قال ذهب الرجل إلى السوق. " * 3
    rows = segments.Segmenter().segments(text)
    assert rows and all(r[4] == r[2] - r[1] >= 8 for r in rows)
    exact = segments.Segmenter(original_offsets=True).segments(text)
    assert all(text[r[1] : r[2]].strip().startswith(("حدَّثن", "حدثن")) for r in exact)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert segments.marker_segments(docs, segments.Segmenter()).count() == len(rows)


def test_header_prefix(spark):
    pick = lambda c: segments.header_prefix(c)
    assert one(spark, "أخبرنا محمد قال حدثنا زيد. ثم ذهب", pick) == "أخبرنا محمد قال حدثنا زيد"
    assert one(spark, "لا فعل هنا", pick) is None and one(spark, "قال نعم", pick) is None


def test_positions_keep_the_first_of_equal_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "a", 5, 6, 1, 0.9), (1, 1, "b", 5, 6, 1, 0.9), (1, 2, "[CLS]", 7, 7, 1, 1.0), (1, 3, "c", 0, 0, 1, 1.0), (1, 4, "d", 10, 12, 1, 0.5), (1, 5, "e", 11, 12, 1, 0.5)], "doc_id long, tok_idx long, token string, char_start long, char_end long, pred int, prob double")
    docs = spark.createDataFrame([(1, "x" * 10)], "doc_id long, text string")
    assert sorted((r.pos, r.token) for r in boundaries.boundary_positions(tokens, docs).collect()) == [(5, "a"), (10, "d")]


def test_gap_clusters(spark):
    pos = spark.createDataFrame([(1, p, 0.5, str(p)) for p in (0, 20, 41)], "doc_id long, pos long, prob double, token string")
    rows = boundaries.gap_clusters(pos).orderBy("boundary_id").collect()
    assert [(r.char_start, r.char_end, r.n_tokens, r.tokens) for r in rows] == [(0, 20, 2, ["0", "20"]), (41, 41, 1, ["41"])]


def clusters_frame(spark):
    return spark.createDataFrame([(1, i, a, b, 0.9, ["t"]) for i, (a, b) in enumerate(CLUSTERS)], "doc_id long, boundary_id long, char_start long, char_end long, max_prob double, tokens array<string>")


def test_published_validation(spark):
    lengths = spark.createDataFrame([(1, 15740), (2, 0)], "doc_id long, n long")
    row, empty = boundaries.validate_clusters(clusters_frame(spark), lengths).orderBy("doc_id").collect()
    assert (row.total_boundaries, row.text_coverage, row.min_gap, row.max_gap, row.median_gap, row.mean_gap, row.very_short, row.very_long) == (26, 17.69377382465057, 73, 1695, 331, 501.32, 0, 0)
    assert empty.text_coverage == 0 and empty.median_gap is None


def test_published_record_starts(spark):
    kept = records.spaced(clusters_frame(spark)).orderBy("char_start").collect()
    assert [r.char_start for r in kept] == [a for a, _ in CLUSTERS[1:]]
    some = spark.createDataFrame([(1, i, s) for i, s in enumerate((2, 1248, 1260, 1300))], "doc_id long, boundary_id long, char_start long")
    assert [r.char_start for r in records.spaced(some).orderBy("char_start").collect()] == [1248, 1300]


def test_records_slice_and_drop(spark):
    docs = spark.createDataFrame([(1, " " * 60 + "header one  body text " + " " * 40 + "abc" + " body two")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0, 60, 72, 0.9), (1, 1, 122, 125, None)], "doc_id long, boundary_id long, char_start long, char_end long, max_prob double")
    rows = records.build_records(marks, docs).collect()
    assert [(r.id, r.header, r.body, r.char_end, r.confidence) for r in rows] == [(0, "header one", "body text", 81, 0.9)]
    totals = records.record_totals(records.build_records(marks.where("false"), docs)).first()
    assert totals.n_records == 0 and totals.avg_body == 0


def test_published_distances(spark):
    a = spark.createDataFrame([(1, p) for p in NEURAL], "key long, pos long")
    b = spark.createDataFrame([(1, p) for p in RULES], "key long, pos long")
    there, back = compare.distance_report(a, b).first(), compare.distance_report(b, a).first()
    pick = lambda r: (r.min, r.q25, r.median, r.q75, r.max, r.within_20, r.within_50, r.within_100, r.within_500)
    assert pick(there) == (0, 14, 44, 95, 390, 11, 14, 21, 26) and there["mean"] == pytest.approx(68.65384615384616)
    assert pick(back) == (0, 45, 96, 148, 384, 11, 17, 33, 63) and back["mean"] == pytest.approx(112.80952380952381)


def test_nearest_match(spark):
    frame = lambda x: spark.createDataFrame([(1, p) for p in x] or [], "key long, pos long")
    row = compare.tolerance_match(frame([0, 80, 161]), frame([0, 80])).first()
    assert (row.matches, row.precision, row.recall) == (2, 2 / 3, 1)
    assert compare.tolerance_match(frame([1]), frame([])).first().matches == 0
    random.seed(2)
    a, b = ([random.randrange(900) for _ in range(60)] for _ in range(2))
    got = sorted((r.pos, r.distance) for r in compare.nearest(frame(a), frame(b)).collect())
    assert got == sorted((x, min(abs(x - y) for y in b)) for x in a)


def restated_merge(rows):
    out = []
    for uid, s, e, h in sorted(rows, key=lambda r: (r[1], -r[2])):
        if out and s < out[-1][1]:
            last = out[-1]
            out[-1] = [last[0], max(last[1], e), h or last[2], last[3] + [uid]]
        else:
            out.append([s, e, h, [uid]])
    return [(s, e, h, ids if len(ids) > 1 else None) for s, e, h, ids in out]


def test_merge_intervals(spark):
    random.seed(1)
    rows = [(i, s := random.randrange(500), s + 1 + random.randrange(30), random.choice([None, f"h{i}"])) for i in range(80)]
    frame = spark.createDataFrame([(1, i, i, s, e, h) for i, s, e, h in rows], "doc_id long, unit_id long, ord long, char_start long, char_end long, header_text string")
    got = [(r.char_start, r.char_end, r.header_text, r.merged_from) for r in annotations.merge_intervals(frame).orderBy("unit_id").collect()]
    assert got == restated_merge(rows)


def test_dedup_passes_over_what_stands_between(spark):
    frame = spark.createDataFrame([(1, i, s, e, "h") for i, (s, e) in enumerate([(0, 100), (10, 300), (20, 110), (400, 500)])], "doc_id long, ord long, char_start long, char_end long, header_text string")
    assert sorted(r.ord for r in annotations.dedup_units(frame).collect()) == [0, 3]


def test_locating_and_replies(spark):
    rows = spark.createDataFrame([("a{} ". format("x" * 30) + "the end of it", "the end", 0), ("حَدَّثَ زيد", "حدث زيد", 0), ("abcdefgh tail", "abcdefzz", 0), ("ab", "ab", 0)], "t string, p string, s long")
    assert [r[0] for r in rows.select(annotations.locate_text(F.col("t"), F.col("p"), F.col("s"))).collect()] == [32, 0, 0, None]
    good = '{"units": [{"unit_id": 1, "text_start": "a", "has_isnad": true}]}'
    replies = spark.createDataFrame([(good,), (f"x\n```json\n{good}\n```",), (f"so {good} yes",), ("none",), (f"```\nbad\n``` {good}",), (None,)], "r string")
    got = [r[0] for r in replies.select(annotations.parse_reply(F.col("r"))).collect()]
    assert [x and x[0].unit_id for x in got] == [1, 1, 1, None, None, None]


def test_resolved_units(spark):
    docs = spark.createDataFrame([(1, "start of text " + "y" * 500)], "doc_id long, text string")
    units = spark.createDataFrame([(1, 0, 7, "start of", "text"), (1, 0, 8, None, "x"), (1, 0, 9, "start of", "missing end")], "doc_id long, chunk_start long, unit_id long, text_start string, text_end string")
    assert sorted((r.unit_id, r.char_start, r.char_end) for r in annotations.resolve_units(units, docs).collect()) == [(7, 0, 13), (9, 0, 400)]


def test_failing_client_is_no_reply(spark):
    def connect():
        def client(text):
            if "b" in text:
                raise OSError("down")
            return "ok"

        return client

    frame = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, chunk_id long, prompt string")
    assert sorted((r.chunk_id, r.reply) for r in annotations.call(frame, connect).collect()) == [(0, "ok"), (1, None)]


def test_scoring(spark):
    docs = spark.createDataFrame([(1, "one two, three " * 60)], "doc_id long, text string")
    tokens = scoring.token_table(scoring.score_chunks(chunks.fixed_chunks(docs), scoring.HashScorer))
    assert scoring.offset_accuracy(tokens, docs).first().accuracy == pytest.approx(99.0)
    stats = scoring.inference_stats(tokens).first()
    assert stats.total_tokens == tokens.count() and stats.boundary_tokens == scoring.boundary_tokens(tokens).count()
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(scoring.argmax(F.col("x")), scoring.softmax(F.col("x"))).first()
    assert row[0] == 1 and sum(row[1]) == pytest.approx(1)


def test_arrays_of_unlike_length(spark):
    raw = spark.createDataFrame([(1, (["a", "b"], [[0, 1], [2, 3]], [1], [0.5]))], "doc_id long, r struct<tokens:array<string>,offsets:array<array<bigint>>,predictions:array<bigint>,probabilities:array<double>>")
    assert [(r.token, r.char_start) for r in scoring.tokens_from_arrays(F.col("doc_id"), F.col("r"), raw).collect()] == [("a", 0)]
    assert raw.select(scoring.same_length(F.col("r"))).first()[0] is False


def test_report(spark):
    docs = spark.createDataFrame([(1, "ab<c>d\nefg"), (2, "plain")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0, 2, 5, 0.8, ["<t>"])], "doc_id long, boundary_id long, char_start long, char_end long, max_prob double, tokens array<string>")
    html = dict(report.highlight(marks, docs).collect())
    assert html[2] == "plain" and "&lt;c&gt;" in html[1] and 'class="low" data-prob="0.800"' in html[1] and "<t>" not in html[1]
    stats = report.confidence_stats(marks, docs.select("doc_id", F.length("text").alias("n"))).orderBy("doc_id").collect()
    assert (stats[0].high, stats[0].medium, stats[0].low, stats[1].n_boundaries) == (0, 1, 0, 0)
    page = dict(report.pages(marks, docs).collect())
    assert len(page) == 2 and report.COLORS[2] in page[1] and '<a href="#b0">' in page[1] and '<span class="bar medium" style="width: 90.0%">1</span>' in page[1]


def test_training(spark):
    rows = spark.createDataFrame([(1, [("a b", "isnad"), ("c", "matn")])], "id long, segments array<struct<text:string,type:string>>")
    assert rows.select(training.token_labels(F.col("segments"), most=6)).first()[0] == [0, 1, 1, 0, 0, 0]
    assert rows.select(training.token_labels(F.col("segments"), separator=1, most=6)).first()[0] == [0, 1, 1, 0, 0, 0]
    data = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "p int, a int")
    assert tuple(training.binary_metrics(data, "p", "a").first()) == (4, 0.5, 0.5, 0.5, 0.5)
    parts = [r[0] for r in spark.range(4000).select(training.hash_split(F.col("id"))).collect()]
    assert mean(p == "train" for p in parts) == pytest.approx(0.7, abs=0.03)


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "Book.v1.txt").write_bytes("a\r\nb\rc".encode())
    row = files.read_texts(spark, str(tmp_path / "t")).first()
    assert (row.name, row.text) == ("Book", "a\nb\nc")
    (tmp_path / "n.json").write_text("[1, 5, 9]")
    assert [r.pos for r in files.read_numbers(spark, str(tmp_path / "n.json")).orderBy("ord").collect()] == [1, 5, 9]
    (tmp_path / "c.json").write_text('{"metadata": {"x": 1}, "segments": [\n{"id": 0, "start": 3, "end": 9}]}')
    assert files.read_rows(spark, str(tmp_path / "c.json"), files.SEGMENTS).first().start == 3
    assert files.read_rows(spark, str(tmp_path / "c.json"), files.UNITS).count() == 0
    rows = spark.createDataFrame([(1, None), (0, "x")], "id long, note string")
    made = files.document(rows, "records", "id", [F.lit("m").alias("corpus")]).first().json
    assert '"note" : null' in made and made.index('"id" : 0') < made.index('"id" : 1')
    files.write_lines(rows, str(tmp_path / "lines"))
    assert files.read_lines(spark, str(tmp_path / "lines"), "id long, note string").count() == 2
    files.write_texts(spark.createDataFrame([("a", "one\ntwo"), ("b", "")], "name string, text string"), str(tmp_path / "out"))
    assert dict(spark.read.text(str(tmp_path / "out"), wholetext=True).select("name", "value").collect()) == {"a": "one\ntwo\n", "b": "\n"}


def test_names():
    assert files.find_folder(["Old_Book", "new-book"], "oldbook", {}) == "Old_Book"
    assert files.find_folder(["Old_Book"], "ob", {"ob": "Old_Book"}) == "Old_Book"
    with pytest.raises(FileNotFoundError):
        files.find_folder(["a"], "b", {})
    assert files.first_existing(["y_a.json"], ["x_{lower}.json", "y_{lower}.json"], "A") == "y_a.json"
    with pytest.raises(FileNotFoundError):
        files.first_existing([], ["x"], "A")


def test_stage_is_keyed_by_parameters(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    go = lambda n, **k: files.stage(spark, str(tmp_path), "s", {"n": n}, lambda: build(n), **k).count()
    assert (go(2), go(2), go(3), go(2, force=True)) == (2, 2, 3, 2) and calls == [2, 3, 2]


def test_stream(spark, tmp_path):
    from quillspark.streaming.files import segment_stream, write_segments

    spark.createDataFrame([(1, "that was so, the man with the cat said to all. " * 5)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = segment_stream(spark, str(tmp_path / "in"), segments.Segmenter(("that", "with"), "the", normalized=False))
    write_segments(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_annotator_lifecycle(spark):
    from quillspark.plans import lifecycles

    lines = [f"line {i} has {'some words ' * 8}and an end number {i * 7919}." for i in range(40)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = lifecycles.by_annotator(docs, lifecycles.ParagraphClient, 700, 200, 100).orderBy("unit_id").collect()
    assert got and got[0].char_start == 0 and got[-1].char_end == len(text)
    assert all(a.char_end <= b.char_start for a, b in zip(got, got[1:], strict=False))


def test_command_line(spark, tmp_path):
    from quillspark.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("#META#Header#End#\none\n~~ two", encoding="utf-8")
    main(["clean", str(tmp_path / "in"), str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value == "one two\n"
    main(["segment", str(tmp_path / "in"), str(tmp_path / "seg")])
    assert spark.read.parquet(str(tmp_path / "seg" / "units")).count() == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('{"khabar_boundaries": [{"boundary_id": 0, "char_start": 50, "char_end": 58, "max_prob": 0.9, "tokens": ["t"]}]}')
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "a.txt").write_text("x" * 50 + " header1 the body", encoding="utf-8")
    main(["records", str(tmp_path / "in2"), str(tmp_path / "rec"), str(tmp_path / "c")])
    assert spark.read.json(str(tmp_path / "rec")).first().body == "the body"
    main(["report", str(tmp_path / "in2"), str(tmp_path / "rep"), str(tmp_path / "c")])
    assert "header1" in spark.read.text(str(tmp_path / "rep"), wholetext=True).first().value
    for name, at in (("p", 10), ("g", 60)):
        (tmp_path / f"{name}.json").write_text(f'{{"narrative_units": [{{"unit_id": 0, "char_start": {at}}}]}}')
    main(["compare", str(tmp_path / "p.json"), str(tmp_path / "cmp"), str(tmp_path / "g.json")])
    assert spark.read.json(str(tmp_path / "cmp")).first().true_positives == 1


def test_kernels_agree_with_their_definitions():
    """The duplicate filter and the chunk walk against step-by-step versions."""

    def by_steps(rows, near):
        out, first = [], 0
        while first < len(rows):
            win, last, k = first, first, first + 1
            while k < len(rows) and rows[k][0] <= rows[win][0] + near:
                if abs(rows[k][1] - rows[win][1]) <= near:
                    last = k
                    win = k if rows[k][2] > rows[win][2] else win
                k += 1
            out.append(win)
            first = last + 1
        return out

    rng = random.Random(3)
    for n in range(60):
        rows = sorted((s := rng.randrange(400), s + rng.randrange(120), rng.randrange(4)) for _ in range(n))
        assert annotations.without_repeats([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]) == by_steps(rows, 50)
    for n in (0, 1, 99, 100, 101, 350, 1000):
        text = "".join(rng.choice("ab \n") if rng.random() < 0.1 else "x" for _ in range(n))
        bounds = chunks.smart_bounds(text, 100, 30, 20, ("\n", " "), 40)
        assert (not n and not bounds) or (bounds[-1][1] == n and all(b - a <= 100 for a, b in bounds))


def test_names_for_sql(spark):
    from quillspark.functions.register import register

    assert register(spark) == ["quill_normalize", "quill_chunks", "quill_segments"]
    assert spark.sql("select quill_normalize('أَب')").first()[0] == "اب"
    rows = spark.sql("select d.id, c.* from (select 1 as id, repeat('word ', 300) as t) d, lateral quill_chunks(d.t, 700, 100, 100) c order by start").collect()
    assert [tuple(r)[1:] for r in rows] == [(k, *b) for k, b in enumerate(chunks.smart_bounds("word " * 300, 700, 100, 100, ("\n", " ")))]
    assert spark.sql("select count(*) from quill_segments('حدثنا زيد قال كان هنا رجل')").first()[0] == 1


def test_chat_client(monkeypatch):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quillspark.operators.clients import ChatClient

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code = {1: 503, 2: 429}.get(len(seen), 200)
            self.send_response(code if seen[-1][1]["model"] != "none" else 404)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "done"}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("CHAT_API_KEY", "k")
    url = f"http://127.0.0.1:{server.server_port}/"
    assert ChatClient(url, "m", wait=0.01)("hi") == "done" and len(seen) == 3
    assert seen[0][0] == "Bearer k" and seen[0][1]["messages"][0]["content"] == "hi"
    with pytest.raises(OSError):
        ChatClient(url, "none", wait=0.01)("hi")
    assert len(seen) == 4
    server.shutdown()
    with pytest.raises(OSError):
        ChatClient(url, "m", wait=0.01, tries=2, timeout=0.5)("hi")


def test_command_line_stages(spark, tmp_path):
    import json

    from quillspark.__main__ import main

    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("A first line, and more words here.\n" * 40)
    main(["pipeline", str(tmp_path / "texts"), str(tmp_path / "out"), "--gap", "5"])
    names = sorted(p.name.split("-")[0] for p in (tmp_path / "out").iterdir())
    assert names == ["clean", "clusters", "records", "report"]
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").iterdir()}
    main(["pipeline", str(tmp_path / "texts"), str(tmp_path / "out"), "--gap", "5", "--skip", "report"])
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").iterdir()}
    main(["score", str(tmp_path / "texts"), str(tmp_path / "scored")])
    assert spark.read.parquet(str(tmp_path / "scored")).count() > 0
    raw = {"metadata": {"corpus": "c"}, "inference_results": {"total_tokens": 2, "tokens": ["a", "b"], "offsets": [[0, 1], [2, 3]], "predictions": [0, 1], "probabilities": [0.1, 0.9]}}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "r.json").write_text(json.dumps(raw))
    main(["convert", str(tmp_path / "raw"), str(tmp_path / "converted")])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "converted" / "tokens")).collect()] == [("r", 1, "b", 2)]
    assert spark.read.parquet(str(tmp_path / "converted" / "clusters")).count() == 1

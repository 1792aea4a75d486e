"""Every operator on odd rows and empty tables, and against SQL, brute force or a round trip."""

import collections
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import _bm25, _codec, _common, _hamming, _images, _kneser, chat, components, decontaminate, licenses, media, mixing, neardup, quality, registry, repeats, tokens, urls
from quillspark.llm import _text as T

from .conftest import near, prose

TABLES = ("documents", "pages", "labels", "conversations", "benchmark", "embeddings")


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same_as_sql(frame, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    want = con.sql(sql)
    assert sorted(frame.columns) == sorted(want.columns)
    assert cells(frame.columns, frame.collect()) == cells(want.columns, want.fetchall())


def arrow(frame, *columns):
    return frame.select(*columns).toArrow()


@pytest.mark.parametrize("name", [n for n in registry.queries() if n in registry.oracle_sql()])
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    rows, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    got = rows.collect()
    assert got and cells(rows.columns, got) == cells(want.columns, want.fetchall())


# 1 mixing


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix_report(odd).drop("source")
    same_as_sql(got, mixing.OP1_SQL, documents=arrow(odd, "doc_id", "text", "source"))
    rows = got.collect()
    assert all(r.taken <= 3 * r.size for r in rows) and len(rows) == odd.count()
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mix_report(odd.limit(0)).count() == 0 == mixing.mix_sources(odd.limit(0)).count()


def test_mix_comes_near_its_targets(spark):
    rows = [(i, prose(5 + i % 60, i), ("big" if i % 3 else "small") if i % 10 else "tiny") for i in range(3000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix_report(spark.createDataFrame(rows[::-1], got.select("doc_id").schema.add("text", "string").add("source", "string"))).collect()))


# 2 licenses


def restated_matches(text, templates, share):
    """(template, first byte, end byte, matched words) by full tables of edit distances."""
    split = lambda t: [(m.group().lower(), *m.span()) for m in re.finditer(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.encode())]
    words, out = split(text), []
    for name, (template, asked) in templates.items():
        t, most = [w for w, *_ in split(template)], int((1 - share) * len(split(template)) + 1e-9)
        table = [[0] * (len(words) + 1)]
        for a in t:
            now = [table[-1][0] + 1]
            for j, (b, *_) in enumerate(words):
                now.append(min(table[-1][j] + (a != b), table[-1][j + 1] + 1, now[-1] + 1))
            table.append(now)
        taken = []
        for cost, end in sorted((c, j) for j, c in enumerate(table[-1]) if c <= most and t):
            i, j, pairs = len(t), end, []
            while i:
                equal = j > 0 and t[i - 1] == words[j - 1][0]
                if j > 0 and table[i - 1][j - 1] + (not equal) == table[i][j]:
                    i, j = i - 1, j - 1
                    pairs += [(i, j)] * equal
                elif table[i - 1][j] + 1 == table[i][j]:
                    i -= 1
                else:
                    j -= 1
            first, last = pairs[-1][1], pairs[0][1] + 1
            if all(last <= x or y <= first for x, y in taken) and {w for w, *_ in split(asked)} <= {t[i] for i, _ in pairs}:
                taken.append((first, last))
                out.append((name, words[first][1], words[last - 1][2], len(pairs)))
    return sorted(out)


def test_license_scan(spark, odd):
    whole = {n: licenses.TEMPLATES[n][0] for n in licenses.TEMPLATES}
    notices = [n for n in whole if len(whole[n]) < 130]
    texts = [prose(20, 1) + " " + whole["MIT"] + " " + prose(12, 2), near(whole["ISC"], 12, 1), "licensed under the APACHE license version 2.0", whole["MIT"][: len(whole["MIT"]) // 2], prose(80, 3), None, "", "Released under this MIT License.", "Released under the Apache License."]
    texts += [" ".join(whole[n] for n in notices), near(whole["Zlib"], 9, 3).replace("software", "very good software"), "ü é " + whole["MIT-notice"] + " " + whole["MIT-notice"] * 3, near(whole["GPL-header"], 20, 5)]
    texts += [" ".join(w for k, w in enumerate(whole["MPL-2.0-header"].split()) if k % 6 != 1), re.sub(r"(\w+ \w+ \w+ \w+) ", r"\1 so ", whole["EPL-2.0-header"]), "4.0 cc by nc 4 x 0 licensed under cc by-nc 4.0 0 cc"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(frame).collect()
    want = {i: restated_matches(t, licenses.TEMPLATES, licenses.COVERAGE) for i, t in enumerate(texts) if t}
    assert len(got) > 25
    for i, matches in want.items():
        assert sorted((r.template, r.start, r.end, r.matched_words) for r in got if r.doc_id == i) == matches, texts[i]
    assert {n for n, *_ in want[7]} == {"MIT-notice"} and not want[8] and "MIT" in {n for n, *_ in want[0]}
    first = next(r for r in got if r.doc_id == 0 and r.template == "MIT")
    assert texts[0].encode()[first.start : first.end].decode() == whole["MIT"].rstrip(".") and first.coverage == 1
    assert licenses.scan_licenses(odd).count() == 0 == licenses.scan_licenses(frame.limit(0)).count()
    assert licenses.scan_licenses(frame, {"none": "..."}).count() == 0


def test_every_acceptable_edit_leaves_fingerprints():
    """Templates of each length against random edits at the limit, by the full tables."""
    rng = random.Random(8)
    for n in (1, 2, 4, 5, 6, 9, 10, 14, 15, 16, 20, 33, 60):
        words = [f"w{i % 40}" for i in rng.sample(range(400), n)]
        scanner = licenses.Scanner({"t": (" ".join(words), "")}, 0.8)
        for _ in range(25):
            some = list(words)
            for _ in range(licenses.edits(n, 0.8)):
                at, kind = rng.randrange(len(some)), rng.randrange(3)
                some[at : at + 1] = [] if kind == 0 and len(some) > 1 else [f"new{rng.randrange(9)}"] + ([some[at]] if kind == 1 else [])
            text = " ".join(["a", "b", *words[:2], *some, "c", *words[-1:]])
            assert [r[1:5] for r in scanner.scan(pa.array([text]))] == sorted(restated_matches(text, {"t": (" ".join(words), "")}, 0.8), key=lambda r: r[1]) or sorted(r[1:5] for r in scanner.scan(pa.array([text]))) == restated_matches(text, {"t": (" ".join(words), "")}, 0.8)


def test_templates_from_a_table(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SCAN_BYTES", 20)
    kinds = spark.createDataFrame([("a", "one two three four five", None), ("b", "six seven eight nine", "nine"), (None, "x", ""), ("c", None, "")], "name string, text string, asked string")
    docs = spark.createDataFrame([(1, "one two three 4 five six seven eight nine"), (2, "long " * 200_000 + "one two three four five")], "doc_id long, text string")
    got = licenses.scan_licenses(docs, kinds)
    assert sorted((r.doc_id, r.template, r.matched_words) for r in got.collect()) == [(1, "a", 4), (1, "b", 4), (2, "a", 5)]


# 3 repeats


def restated_removal(rows, length):
    seen = collections.Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "q"), [(200, 48), (30, 7)])
def test_repeats_against_brute_force(spark, odd_rows, length, q):
    passage = prose(60, 77)
    rows = [(r[0], r[1] if r[0] != 206 else prose(900, 5)) for r in odd_rows]
    rows += [(400 + i, prose(50, 400 + i) + passage + prose(20, 500 + i)) for i in range(25)] + [(500, "ab" * 300), (501, "Orre " * 90), (502, passage[:201]), (503, "é" * 150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, repeats.remove_repeats(frame, length, q).collect()), key=str) == restated_removal(rows, length)


def test_repeats_of_rows_without_an_id(spark):
    """Unlike texts that share a null id, and ones that share an id, keep their own results."""
    passage = prose(60, 77)
    rows = [(None if i % 2 else 5, prose(60, i) + (passage if i % 7 == 0 else "")) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, repeats.remove_repeats(frame).collect()), key=str) == restated_removal(rows, 200)


def test_pointers_name_their_bytes():
    raw = np.frombuffer(("abcab" * 80 + prose(200, 3)).encode(), np.uint8)
    for length, q in ((200, 48), (30, 7), (10, 10), (9, 1)):
        first, deep = repeats.pointers(raw, length, q)
        for got, n in ((first, q), (deep, length)):
            of = collections.defaultdict(set)
            for i in range(len(raw) - n + 1):
                of[raw[i : i + n].tobytes()].add(int(got[i]))
            assert len(got) == len(raw) - n + 1 and all(len(x) == 1 for x in of.values()) and len(of) == len(set.union(*of.values()))


def test_buckets_that_collide_are_parted_by_pointers(spark, monkeypatch):
    """With buckets of 4 bits nearly all segments collide; results are the same, as equal pointers are asked for too."""
    rows = [(i, prose(60, i) + prose(50, 1000 + i % 5)) for i in range(40)]
    made = spark.createDataFrame([(i, i, t) for i, t in rows], "did long, th long, text string")
    runs = made.mapInArrow(repeats._segments(200, 48), repeats.RUN)
    full, _ = repeats._refine(runs, "plain")
    forced, _ = repeats._refine(runs.withColumn("bucket", F.pmod("bucket", F.lit(16))), "forced")
    assert 0 < full.count() == forced.count() and full.exceptAll(forced).count() == 0


def test_repeats_keep_texts(spark, odd):
    rows = repeats.remove_repeats(odd, with_text=True)
    for r in rows.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


# 4 media


KIND = "id long, media binary"


def brute_copies(spark, queries, images):
    """Every corner of every query against every corner of every image, then the same vote."""
    corners = lambda rows: [(i, k, c) for i, m in rows for k, c in enumerate(_images.describe(_images.read_image(m)))]
    ask, known = corners(queries), corners(images)
    bits = lambda rows: np.frombuffer(b"".join(c[4] for *_, c in rows), "<u8").reshape(-1, 2)
    a, b = bits(ask), bits(known)
    pairs = []
    for n, row in enumerate(a):
        far = np.bitwise_count(b ^ row).sum(1)
        pairs += [(*ask[n][:2], *known[m][:2]) for m in np.flatnonzero(far <= media.DISTANCE).tolist()]
    frame = lambda rows: spark.createDataFrame([(i, k, *map(float, c[:4])) for i, k, c in rows], "id long, corner int, x double, y double, scale double, angle double")
    found = media.vote(spark.createDataFrame(pairs, "q long, qc int, r long, rc int"), frame(ask), frame(known))
    return {(r.q, r.r) for r in found.collect()}


def turned(image, angle, scale=1.0, noise=0.0, seed=0):
    """The middle of the image, turned by any angle, resized, with noise."""
    h, w = image.shape
    n, m = int(h * 0.7 * scale), int(w * 0.7 * scale)
    y, x = (np.mgrid[:n, :m] - np.array([n - 1, m - 1])[:, None, None] / 2) / scale
    fy, fx = np.cos(angle) * y - np.sin(angle) * x + (h - 1) / 2, np.sin(angle) * y + np.cos(angle) * x + (w - 1) / 2
    y0, x0 = np.clip(fy.astype(int), 0, h - 2), np.clip(fx.astype(int), 0, w - 2)
    dy, dx = np.clip(fy - y0, 0, 1), np.clip(fx - x0, 0, 1)
    value = (image[y0, x0] * (1 - dx) + image[y0, x0 + 1] * dx) * (1 - dy) + (image[y0 + 1, x0] * (1 - dx) + image[y0 + 1, x0 + 1] * dx) * dy
    return value + np.random.default_rng(seed).normal(0, noise, value.shape) if noise else value


def smooth_image(seed, size):
    rng = np.random.default_rng(seed)
    field = sum(_images.resize(rng.normal(size=(size // k, size // k)), k * 1.0)[: size // 8 * 8, : size // 8 * 8] * k**0.7 for k in (4, 8) if size % k == 0)
    return np.clip(128 + 45 * field / field.std(), 0, 255)


def test_copies_against_brute_force(spark):
    rng = np.random.default_rng(3)
    images = {i: _images.texture(rng.normal(size=32)) for i in range(60)} | {100 + i: smooth_image(i, 160) for i in range(16)}
    rows = [(i, _images.write_pgm(x)) for i, x in images.items()] + [(90, _images.write_pgm(images[3])), (91, None), (92, b"no image"), (93, b"P5 3 3 255\n123456789"), (None, _images.write_pgm(images[1]))]
    queries = [(i, _images.write_pgm(_images.edited(images[i], i))) for i in range(0, 60, 3)]
    queries += [(200 + 4 * i + k, _images.write_pgm(turned(images[100 + i], *e))) for i in range(16) for k, e in enumerate([(0.4, 1.0, 0.0), (0.0, 0.55, 0.0), (2.2, 0.8, 0.0), (0.1, 1.0, 4.0)])] + [(195, None), (196, b"")]
    extra = lambda r: spark.createDataFrame([(*x, "w", 1) for x in r], KIND + ", word string, parts int").repartition(5)
    found, members = media.find_copies(extra(queries), extra(rows))
    got = found.collect()
    pairs = {(r.query_id, r.match_id) for r in got}
    want = brute_copies(spark, queries, [r for r in rows if r[0] not in (90, None)])
    truth = {(i, i) for i in range(0, 60, 3)} | {(200 + 4 * i + k, 100 + i) for i in range(16) for k in range(4)}
    assert len(pairs & want) >= 0.9 * len(want) and not pairs - want
    assert len(pairs & truth) >= 0.9 * len(truth) and len(pairs - truth) <= 3
    assert next(r for r in got if r.match_id == 3).n_class == 2 and {r.id for r in members.where("class_id = 3").collect()} == {3, 90}
    for size in (1000, 2):
        lists = media.match_lists(found, size).collect()
        assert {(r.query_id, m) for r in lists for m in r.match_ids} == pairs and all(r.n_matches == sum(q == r.query_id for q, _ in pairs) for r in lists)
    assert media.find_copies(spark.createDataFrame([], KIND), extra(rows))[0].count() == 0 == media.find_copies(extra(queries), spark.createDataFrame([], KIND))[0].count()


def test_recall_among_look_alikes(spark):
    """Images like each other, so that many matches rest on few corners, and those far apart in bits."""
    rng = np.random.default_rng(11)
    bases = rng.normal(size=(6, 32))
    images = [_images.texture(bases[i % 6] + 0.2 * rng.normal(size=32)) for i in range(90)]
    rows = [(i, _images.write_pgm(x)) for i, x in enumerate(images)]
    queries = [(i, _images.write_pgm(_images.edited(images[i], i))) for i in range(0, 90, 5)]
    got = media.find_copies(spark.createDataFrame(queries, KIND), spark.createDataFrame(rows, KIND))[0].collect()
    pairs, want = {(r.query_id, r.match_id) for r in got}, brute_copies(spark, queries, rows)
    assert len(want) >= 50 and not pairs - want and len(pairs) >= 0.9 * len(want)


def test_corners_near_the_distance(spark, monkeypatch):
    """Every corner within DISTANCE bits meets, however its changed bits lie, and every match is found that brute force finds."""
    rng = np.random.default_rng(4)
    known = rng.integers(0, 2**64, (3000, 2), np.uint64)
    known[:200] = known[0]
    flips = np.zeros((600, 128), np.uint8)
    for i, row in enumerate(flips):
        row[rng.permutation(128)[: i % 24]] = 1
    asked = known[np.arange(600) % 300 + 100] ^ np.packbits(flips, axis=1).view("<u8")
    got = [pair for a, b in _hamming.Tables(known).near(asked, media.DISTANCE) for pair in zip(a.tolist(), b.tolist(), strict=True)]
    far = np.bitwise_count(asked[:, None] ^ known[None]).sum(2)
    assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= media.DISTANCE)), strict=True))
    bases = rng.normal(size=(5, 32))
    images = [_images.texture(bases[i % 5] + 0.2 * rng.normal(size=32)) for i in range(60)]
    rows = [(i, _images.write_pgm(x)) for i, x in enumerate(images)]
    queries = [(i, _images.write_pgm(_images.edited(images[i], i))) for i in range(0, 60, 4)]
    search = lambda: {(r.query_id, r.match_id): r.votes for r in media.find_copies(spark.createDataFrame(queries, KIND), spark.createDataFrame(rows, KIND))[0].collect()}
    whole = search()
    assert len(whole) >= 40 and set(whole) == brute_copies(spark, queries, rows)
    for name, size in (("PART", 300), ("ASKED", 60)):
        monkeypatch.setattr(media, name, size)
    assert search() == whole
    block = lambda data: media.Block(np.arange(len(data)), np.append(0, np.cumsum([len(x) for x in data])), np.concatenate(data))
    described = lambda rows: [np.array([(c[:4], np.frombuffer(c[4], "<u8")) for c in _images.describe(_images.read_image(m))], media.CORNER) for _, m in rows]
    ask, index = block(described(queries)), block(described(rows))
    votes = {(queries[q][0], r): n for q, r, n in media.block_copies(ask, index, index.tables())}
    monkeypatch.setattr(media, "MATCHED", 5)
    assert votes == whole == {(queries[q][0], r): n for q, r, n in media.block_copies(ask, index, index.tables())}


def test_words_that_many_images_share(spark, monkeypatch):
    """The same corners in every image, as of a logo, far over the size of a part; ids that repeat and ties."""
    rng = np.random.default_rng(9)
    logo, images = _images.texture(rng.normal(size=32)), {}
    for i in range(30):
        image = _images.texture(rng.normal(size=32), 96)
        image[:64, :64] = logo
        images[i] = _images.write_pgm(image)
    rows = [*images.items(), (3, images[3]), (4, images[5])]
    query = [(7, _images.write_pgm(logo))]
    search = lambda: sorted(map(tuple, media.find_copies(spark.createDataFrame(query, KIND), spark.createDataFrame(rows, KIND))[0].collect()))
    whole = search()
    monkeypatch.setattr(media, "PART", 3)
    want = {r for _, r in brute_copies(spark, query, list(images.items()))}
    assert search() == whole and len(want) >= 25 and len({r[1] for r in whole} & want) >= 0.9 * (len(want) - 1)


def test_unlike_images_with_one_thumbnail(spark):
    rng, slope = np.random.default_rng(5), np.linspace(-90, 90, 64)[:, None]
    images = {i: 128 + slope + (_images.texture(rng.normal(size=32)) - 128) * 0.25 for i in range(24)}
    rows = [(i, _images.write_pgm(x)) for i, x in images.items()]
    queries = [(i, _images.write_pgm(_images.edited(x, i))) for i, x in images.items()]
    got = media.find_copies(spark.createDataFrame(queries, KIND), spark.createDataFrame(rows, KIND))[0].collect()
    assert len({(r.query_id, r.match_id) for r in got if r.query_id == r.match_id}) >= 0.9 * len(images)


def png(image, colour=False, filters=(0,)):
    """Written by the rules of the format, a filter per row in turn."""
    rows = np.stack([image] * 3, 2) if colour else image[:, :, None]
    h, w, n = rows.shape
    rows, out, above = rows.astype(np.int32), b"", np.zeros((w, n), np.int32)
    for y in range(h):
        kind, line = filters[y % len(filters)], rows[y]
        left, corner = np.vstack([np.zeros((1, n), np.int32), line[:-1]]), np.vstack([np.zeros((1, n), np.int32), above[:-1]])
        base = left + above - corner
        a, b, c = abs(base - left), abs(base - above), abs(base - corner)
        guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
        out += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: len(d).to_bytes(4) + k + d + zlib.crc32(k + d).to_bytes(4)
    head = w.to_bytes(4) + h.to_bytes(4) + bytes([8, 2 if colour else 0, 0, 0, 0])
    return _images.PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_reading_images():
    image = np.random.default_rng(1).integers(0, 256, (23, 31))
    for filters in ((0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)):
        assert (_images.read_image(png(image, filters=filters)) == image).all()
        assert np.abs(_images.read_image(png(image, True, filters)) - image).max() < 0.01
    assert (_images.read_image(_images.write_pgm(image)) == image).all()
    good = png(image)
    for bad in (None, b"", b"P5", good[:40], good[:60] + b"x" * 9, _images.PNG, good.replace(b"IDAT", b"XDAT")):
        assert _images.read_image(bad) is None
    assert len(_images.describe(np.random.default_rng(2).integers(0, 256, (1400, 900)).astype(np.float32))) > 300


# 5 urls


def test_urls_of_odd_rows(spark):
    links = ["http://A.Example.net/en/x?q", "https://b.example.net/fr", "http://x.net", "http://org/fr/", "http://a.ORG/fr/1#t", "http://example.com/de/1", "nothing", None, "", "http://", "a://b://c/d", "http://anet/", "http://s.co.uk/x", "http://t.s.co.uk/x", "http://x.example.net:80/en/\n", "http://me:pw@x.co.nz:8080/", "http://y.gov.uk./", "http://" + "a." * 20_000 + "gov.uk/" + "p" * 50_000]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(links * 3)] + [(None, "http://q.com/", "k")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(30)] + [(3, 0, True), (None, 0, True), (4, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    rows = urls.judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))
    same_as_sql(rows, urls.OP5_SQL, pages=arrow(pages, "page_id", "url"), labels=arrow(labels, "doc_id", "quality", "toxic"))
    got = {r.page_id: r for r in rows.collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2].rule is None and got[3].rule == "org/fr/" == got[4].rule and got[11].rule is None and got[10].host == "b:"
    assert got[15].host == "me:pw@x.co.nz:8080"
    sites = spark.createDataFrame([("x.gov.uk",), ("gov.uk",), ("a.b.city.jp",), ("com",), ("",)], "site string")
    known = urls.suffix_table(spark).union(spark.createDataFrame([("b.city.jp",)], "suffix string"))
    assert {r.site: (r.suffix, r.domain) for r in urls.with_domains(sites, known).collect()} == {"x.gov.uk": ("gov.uk", "x.gov.uk"), "gov.uk": ("gov.uk", "gov.uk"), "a.b.city.jp": ("b.city.jp", "a.b.city.jp"), "com": ("com", "com"), "": ("", "")}
    assert urls.judge_urls(pages.limit(0), labels).count() == 0 and urls.judge_urls(pages, labels.limit(0)).count() == pages.count()


# 6 chat


def test_chat_of_odd_rows(spark):
    full = [("user", "a"), ("assistant", "b"), ("user", None), (None, "d")]
    rows = [(c, i, r, t) for c, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for i, (r, t) in enumerate(full[:n])]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "z"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, None, "user", ""), (None, 0, "user", "n"), (8, 0, "use", "ra")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = chat.collapse_and_render(frame)
    same_as_sql(got, chat.OP6_SQL, conversations=arrow(frame, "conv_id", "turn", "role", "text"))
    found = {r.conv_id: (r.n_turns, r.n_equal) for r in got.collect()}
    assert found[2] == (4, 2) and 1 not in found and 3 not in found and 4 not in found and None in found
    assert chat.collapse_and_render(frame.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "y" * 300_000), (2, 0, "user", "y" * 300_000), (2, 1, "user", "z")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, len(r.rendered)) for r in chat.collapse_and_render(long).collect()] == [(2, 300_000 + 1 + 2 * len("<|user|>\n<|end|>\n"))]


# 7 quality


def restated_bits(texts):
    """Interpolated modified Kneser-Ney by dictionaries: the cost of a symbol after its context."""
    A, order = _kneser.SYMBOLS, _kneser.ORDER
    counts = [None] * (order + 1)
    counts[order] = collections.Counter()
    for t in texts:
        s = [_kneser.START] * (order - 1) + restated_symbols(t)
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    tables = []
    for n in range(1, order + 1):
        cc = collections.Counter(counts[n].values())
        y = cc[1] / (cc[1] + 2 * cc[2]) if cc[1] else 0.5
        d = [0, *[max(0.05, min(k, k - (k + 1) * y * cc[k + 1] / cc[k] if cc[k] else 0.5 * k)) for k in (1, 2, 3)]]
        total, left = collections.Counter(), collections.Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        tables.append((counts[n], d, total, left))

    def p(gram):
        if not gram:
            return 1 / A
        seen, d, total, left = tables[len(gram) - 1]
        h = gram[:-1]
        lower = p(gram[1:])
        if not total[h]:
            return lower
        c = seen[gram]
        return (c - d[min(c, 3)]) / total[h] + left[h] / total[h] * lower if c else left[h] / total[h] * lower

    return lambda gram: -math.log2(p(gram))


def restated_symbols(text):
    return list((text or "").encode())


def restated_scores(texts, good, held):
    """(bytes, bits) of each text under the model of the good ones that aren't held out; texts by id."""
    cost, known = restated_bits([texts[i] for i in good if i not in held]), {}
    out = {}
    for i, text in texts.items():
        s = [_kneser.START] * (_kneser.ORDER - 1) + restated_symbols(text)
        grams = [tuple(s[k : k + _kneser.ORDER]) for k in range(len(s) - _kneser.ORDER + 1)]
        for g in grams:
            if g not in known:
                known[g] = cost(g)
        out[i] = (len(grams), sum(known[g] for g in grams))
    return out


def restated_limits(scores, lang, rated):
    """language -> (base, limit) from the scores of the held-out good documents ``rated``."""
    ratio = lambda m, n=0, b=0.0: (sum(scores[i][1] for i in m) + b) / max(1e-9, sum(scores[i][0] for i in m) + n)
    everywhere = ratio(rated)
    base = lambda x: ratio([i for i in rated if lang[i] == x], quality.FEW_BYTES, everywhere * quality.FEW_BYTES)
    over = {i: (scores[i][1] + base(lang[i]) * quality.PRIOR) / (scores[i][0] + quality.PRIOR) - base(lang[i]) for i in rated}
    high = lambda m: math.ceil(sorted(over[i] for i in m)[math.ceil(quality.HIGH * len(m)) - 1] * 1000) / 1000 if m else 0.0
    out = {}
    for x in set(lang.values()):
        m = [i for i in rated if lang[i] == x]
        out[x] = (base(x), base(x) + (len(m) * high(m) + quality.FEW * high(rated)) / (len(m) + quality.FEW))
    return out


def held_out(docs):
    return {r.doc_id for r in quality._keyed(docs).where(quality._held_out()).select("doc_id").collect()}


def test_quality_against_dictionaries(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 100_000)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, lang = dict(docs.select("doc_id", "text").collect()), dict(docs.select("doc_id", "lang").collect())
    good, held = {r.doc_id for r in labels.where("quality = 1").collect()}, held_out(docs)
    scores = restated_scores(texts, good, held)
    limits = restated_limits(scores, lang, [i for i in texts if i in good & held])
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        n, bits = scores[i]
        base, limit = limits[lang[i]]
        assert r.n_bytes == n and r.bits_per_byte == pytest.approx((bits + base * quality.PRIOR) / (n + quality.PRIOR), rel=1e-6) and r.limit == pytest.approx(limit, abs=0.0011)
        assert r.kept == (r.bits_per_byte <= r.limit)


def test_quality_of_labelled_documents(spark):
    """Documents with labels, of which a fifth has no part in the model: nearly all good ones stay; junk goes but for repeated words, which cost few bits."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge_quality(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.2


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(None, 1, 0), (15, 1, 0), (15, 0, 0), (999, 1, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows if r.n_bytes == 0) and not next(r for r in rows if r.doc_id == 205).kept
    assert quality.keep_good(odd, labels).columns == odd.columns and quality.keep_good(odd, labels).count() == sum(r.kept for r in rows)
    assert quality.judge_quality(odd.limit(0), labels).count() == 0 == quality.keep_good(odd.limit(0), labels).count()
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()
    dotted = odd.withColumnRenamed("key", "a.b").withColumnRenamed("rank", "h1")
    assert quality.keep_good(dotted, labels).columns == dotted.columns


def test_packing_holds_each_ngram_once(monkeypatch):
    """Pieces of a block that share their n-grams: memory grows with the distinct ones; a worker returns its memory at the end of a task."""
    ends, stub = [], type("", (), {"mapInArrow": lambda self, run, _: run})()
    monkeypatch.setattr(_common, "give_back", lambda: ends.append(1))
    monkeypatch.setattr(quality, "TaskContext", type("", (), {"get": lambda: type("", (), {"partitionId": lambda: 3})}))
    text = np.random.default_rng(8).integers(97, 123, 500_000, np.uint8).tobytes().decode()
    n = pa.array(range(24))
    rows = pa.RecordBatch.from_arrays([n, pa.array(["en"] * 24), n, n, pa.array([text] * 24)], ["doc_id", "lang", "h1", "h2", "text"])
    run = quality.pack_blocks(stub)
    tracemalloc.start()
    try:
        blocks = list(run(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(blocks) == 1 and ends == [1] and peak < 120e6
    block = blocks[0].to_pylist()[0]
    assert block["doc_id"] == list(range(24)) and block["sizes"] == [500_000] * 24 and pa.decompress(block["data"], 12_000_000, codec="zstd", asbytes=True) == text.encode() * 24
    assert (_kneser.unpack_keys(block["keys"]) == np.unique(_kneser.distinct(pa.array([text]))[0])).all()


def test_ngram_keys_of_texts():
    texts = pa.array(["abé", None, "", "x" * 9])
    data, offsets = T.utf8(texts)
    got, want = _kneser.keys(data, offsets).tolist(), []
    for t in texts.to_pylist():
        s = [_kneser.START] * (_kneser.ORDER - 1) + restated_symbols(t)
        want += [sum(x * _kneser.SYMBOLS ** (_kneser.ORDER - 1 - j) for j, x in enumerate(s[i : i + _kneser.ORDER])) for i in range(len(s) - _kneser.ORDER + 1)]
    assert got == want and sorted(set(want)) == _kneser.unpack_keys(_kneser.pack_keys(np.unique(got))).tolist()
    assert _kneser.unpack_keys(_kneser.pack_keys(np.zeros(0, np.int64))).tolist() == []


# 8 decontamination


def test_wand_against_all_scores():
    items = [prose(12 + i % 50, i) for i in range(120)]
    index = _bm25.Index(list(range(120)), items)
    for k in range(60):
        h = T.words(*T.utf8(pa.array([prose(70, 1000 + k) + " " + items[k] if k % 2 else near(items[k], 3, k)])), T.PUNCTUATION)[0]
        query = np.unique(h[-128:])
        scores = collections.Counter()
        for t in np.flatnonzero(np.isin(index.terms, query)):
            for u, x in zip(index.units[t], index.impacts[t], strict=True):
                scores[int(u)] += x
        want = {u: pytest.approx(s) for u, s in scores.items() if s >= index.threshold - 1e-9}
        assert dict(index.wand(query)) == want
        starts = {s for _, s in index._passages(h, np.array([0, len(h)]))}
        for a in range(0, max(1, len(h) - 64), 64):
            if index.wand(np.unique(h[a : a + 128])):
                assert a in starts


def test_shards_score_like_one_index(spark):
    items = [(i, prose(40 + i, 300 + i) + ". " + prose(8, 400 + i)) for i in range(30)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    texts = pa.array([near(t, 6, i) for i, t in items])
    cells = lambda index: [(r, i, round(s, 9)) for r, i, s, _, _ in index.search(texts)]
    shards = [b.value for b in decontaminate.index_shards(frame, shard_bytes=3000)]
    whole = cells(_bm25.Index(*zip(*items, strict=True)))
    assert len(shards) > 1 and whole and sorted(x for s in shards for x in cells(s)) == sorted(whole)


def restated_leaks(docs, items):
    """Every unit of every item against every passage of every document, by dictionaries."""
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    units = [(i, w[a : a + 64]) for i, t in items for w in [split(t)] for a in range(0, len(w), 64)]
    having, mean = collections.Counter(t for _, w in units for t in set(w)), sum(len(w) for _, w in units) / len(units)
    weight = {t: math.log(1 + (len(units) - n + 0.5) / (n + 0.5)) for t, n in having.items()}
    impacts = []
    for i, w in units:
        part = {t: weight[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in collections.Counter(w).items()}
        impacts.append((i, {t: x / sum(part.values()) for t, x in part.items()}))
    out = {}
    for d, text in docs:
        w = split(text)
        for a in range(0, max(1, len(w) - 64), 64):
            passage = set(w[a : a + 128])
            for i, part in impacts:
                score = sum(x for t, x in part.items() if t in passage)
                if score >= 0.6:
                    out[d, i] = max(out.get((d, i), 0.0), score)
    text_of, words_of = dict(items), {d: split(t) for d, t in docs}
    found = {}
    for (d, i), score in out.items():
        shares = []
        for part in _bm25.split_item(text_of[i]):
            p = split(part)
            n = min(3, max(1, len(p)))
            shares.append(len(runs(p, n) & runs(words_of[d], n)) / len(runs(p, n)) if p else None)
        question, answer = shares[0] or 0.0, shares[1] if shares[1] is not None else shares[0] or 0.0
        if question >= 0.7 and answer >= 0.5:
            found[d, i] = tuple(round(x, 6) for x in (score, question, answer))
    return found


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1500])
def test_leaks_against_brute_force(spark, monkeypatch, shard_bytes):
    scans = decontaminate._scans
    monkeypatch.setattr(decontaminate, "_scans", lambda b, t: scans(b, t, shard_bytes))
    items = [(i, prose(20 + 3 * i, 300 + i).replace(".", "") + ". " + prose(7, 400 + i)) for i in range(25)] + [(50, items_text := prose(90, 5)), (51, items_text), (None, prose(30, 6))]
    docs = [(i, prose(90, i) + " " + near(items[i][1], i % 9, i) + " " + prose(50, 70 + i)) for i in range(25)]
    docs += [(60, items_text), (61, prose(300, 9)), (62, ""), (63, None), (None, items[3][1]), (65, items[2][1]), (65, items[2][1]), (66, prose(9000, 3) + " " + items[5][1])]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    cell = lambda d, i, x: (str(d), str(i), x)
    want = restated_leaks(list(enumerate(t for _, t in docs)), list(dict(enumerate(t for _, t in items)).items()))
    want = [cell(docs[d][0], items[i][0], x) for (d, i), x in want.items()]
    assert len(want) > 15 and sorted(cell(r.doc_id, r.item_id, tuple(round(x, 6) for x in r[2:])) for r in got) == sorted(want)


def test_leaks(spark, odd):
    rare = lambda n, s: " ".join(f"w{(s * 977 + i * 31) % 5000}" for i in range(n))
    items = [(i, f"{rare(25, i)}? Yes. {rare(6, 900 + i)}.") for i in range(30)] + [(30, None), (31, ""), (32, rare(150, 77)), (33, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, prose(200, i) + (" " + items[i][1].upper() if i % 3 == 0 else "") + " " + prose(90, 50 + i)) for i in range(30)]
    docs += [(40, prose(70, 1) + " " + items[32][1] + " " + prose(5, 2)), (41, items[4][1][: len(items[4][1]) // 3]), (42, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got == {(i, i) for i in range(0, 30, 3)} | {(40, 32)}
    kept = {r.doc_id for r in decontaminate.keep_clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.keep_clean(odd, bench).count() == odd.count() and decontaminate.keep_clean(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0 and decontaminate.find_leaks(frame, bench.limit(0)).count() == 0
    small = list(decontaminate.index_shards(bench, shard_bytes=1000))
    assert len(small) > 2 and sum(len(s.value.ids) for s in small) == 33


# 9 tokens


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 700, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408])
def test_codec_round_trip(n, top):
    ids = np.random.default_rng(n).zipf(1.3, n) % top
    counts = np.array([n // 2, n - n // 2])
    block = _codec.write_block(np.array([3, -9]), np.array([False, True]), counts, ids)
    doc, null, back, got = _codec.read_block(block)
    assert (got == ids).all() and (back == counts).all() and doc.tolist() == [3, -9] and null.tolist() == [False, True]
    for at in (5, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError, match="damaged"):
            _codec.read_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])


def test_codec_compresses_and_limits():
    ids = np.tile(np.arange(50), 4000)
    assert len(_codec.write_block(np.array([0]), np.array([False]), np.array([len(ids)]), ids)) < len(ids) // 3
    with pytest.raises(ValueError, match="not supported"):
        _codec.encode_ids(np.array([1 << 20]))


def restated_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_tokenizer())
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, r[1] or ""))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_of_odd_rows(spark, odd, odd_rows, monkeypatch):
    texts = ["<|endoftext|>, x<|startoftext|>y It's IT'S é́t É.. «mot», mot…. İstanbul ΣΑΣ ab 1,5. a.b, ¡Hola! <|ENDOFTEXT|> #x# a\x1cb ﬁ ½. 3rd, don't. 'll x'll. ###", "CAFÉ! 10% 5$ $5 #tag a# A1. 1A. \u2028x\xa0y"]
    rows = [(r[0], r[1]) for r in odd_rows] + [(600 + i, t) for i, t in enumerate(texts)]
    frame = odd.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(600 + i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, size int"))
    got = sorted(map(tuple, tokens.token_round_trip(frame).collect()), key=lambda r: r[1])
    assert [r[1:] for r in got] == [r[1:] for r in restated_tokens(rows)] and [r[0] for r in got] == [r[0] for r in restated_tokens(rows)]
    assert tokens.token_round_trip(odd.limit(0)).count() == 0


def test_tokens_carry_ids(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    tokens.write_tokens(frame, str(tmp_path / "t"), tokens.word_tokenizer())
    rows = tokens.read_tokens(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2] and all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in rows)


# 10 near-duplicates


def test_near_duplicates_of_odd_rows(spark, odd, odd_rows):
    plain = odd.where("doc_id is not null and doc_id <> 7")
    same_as_sql(neardup.near_duplicates(plain), neardup.OP10_SQL, documents=arrow(plain, "doc_id", "text"))
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows) and all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id is null").count() == 2
    assert kept.where("doc_id between 100 and 199").count() < 10
    assert neardup.near_duplicates(odd.limit(0)).count() == 0 == neardup.deduplicate(odd.limit(0)).count()


def test_group_of_edited_copies(spark):
    """Copies that are similar to their base more than to each other, in a crowd far over a region's size."""
    rows = [(5000, prose(400, 9))] + [(i, near(prose(400, 9), 5, i)) for i in range(400)] + [(6000 + i, prose(120, 7000 + i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same_as_sql(neardup.near_duplicates(frame), neardup.OP10_SQL, documents=arrow(frame, "doc_id", "text"))


def test_twins_in_a_family_below_the_threshold(spark):
    form = [f"form{i}" for i in range(104)]
    text = lambda name, shared, other: " ".join(form + [f"{name}own{i}" for i in range(shared)] + [f"{name}{other}own{i}" for i in range(shared, 13)])
    rows = [(i, text(f"t{i}", 4, "a")) for i in range(60)] + [(5000 + i, text(f"t{i}", 4, "b")) for i in range(60)] + [(1000 + i, text(f"s{i}", 0, "a")) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same_as_sql(neardup.near_duplicates(frame), neardup.OP10_SQL, documents=arrow(frame, "doc_id", "text"))


def test_twins_around_a_large_group(spark):
    """Twins that are like each other and only less so like the base of a crowded group; ids in no order."""
    base, rng = prose(400, 9), random.Random(4)
    texts = [base] + [near(base, 1, i) for i in range(600)]
    for i in range(300):
        one = near(base, 5, 1000 + i)
        texts += [near(one, 3, 2000 + i), near(one, 3, 3000 + i)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    same_as_sql(neardup.near_duplicates(frame), neardup.OP10_SQL, documents=arrow(frame, "doc_id", "text"))


def test_texts_that_share_an_id(spark):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(1, a), (2, b), (2, near(a, 1, 1)), (3, near(b, 1, 2)), (3, c), (4, c), (2, b)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `a.b` string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(frame).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2), (3, 3), (4, 3)]
    kept = neardup.deduplicate(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (3, c)])


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (50, 50), (200, 3)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 90: 90, 95: 90, 100: 90}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# the rest


def test_text_kernels():
    texts = ["One  two\tTHREE", None, "", "é É", " x "]
    data, offsets = T.utf8(pa.array(texts))
    hashes, starts, ends, by_row = T.words(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["One", "two", "THREE", "é", "É", "x"] and by_row.tolist() == [0, 3, 3, 3, 5, 6]
    again = T.words(*T.utf8(pa.array(["zz one", "X"])))[0]
    assert again[1] == hashes[0] and again[2] == hashes[5]
    assert [len(s) for s in T.distinct_shingles(pa.array(["a b c d e f", "a b", "", "a a a a a a a"]))] == [2, 1, 0, 1]


def test_shared_folder_is_the_sessions(spark):
    from quillspark.llm import _common

    assert _common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_intermediates_can_be_dropped(spark):
    from quillspark.llm import _common

    kept = _common.materialize(spark.range(3), "x")
    path = _common._written[-1].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(path)
    before, _common._written[:] = _common._written[:-1], _common._written[-1:]
    _common.drop_intermediates(spark)
    _common._written[:] = before
    assert not os.path.exists(path)


def test_the_rest_does_not_need_this_folder():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['quillspark.llm'] = None; import quillspark.plans.registry as r; print(len(r.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 40

"""MinHash near-duplicates by an LSH forest.

A text's set is its distinct runs of k words; equal sets are one node, the smallest doc_id. Each node gets
TREES * DEPTH minimum hashes, cut into one label of DEPTH hashes per tree. Sorting a tree's labels puts texts that
agree on long prefixes beside each other. A region is a run of labels sharing the first ROOT hashes; in a small
region all pairs are candidates, in a crowded one at first sorted neighbours (the longest common prefixes)
and the region's hub, the node whose full labels coincide with most others over all trees, as the base text of a
group of edited copies does. Crowded regions that these leave in several components are searched by an exact prefix
join of their sets: similar enough sets share one of their first runs in any one order of all runs. Rare runs come first,
and the places of a shared run bound what two sets can have in common.

A neighbour pair whose minimum hashes agree too rarely for the wanted similarity, by over 4.5 standard deviations, is
let go; four bits of each hash, the sketch, are enough to see that. Other candidates are confirmed on the full sets. Hub links come first; a neighbour pair is looked at only if its ends
are still in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import drop_intermediates, materialize, small, table, whole_row, written
from .components import connected_components

TREES, DEPTH, ROOT = 16, 6, 3
#: Regions up to this size have all pairs as candidates.
SMALL = 8
#: A pair that is similar enough has agreeing sketches but for so many standard deviations.
DEVIATIONS = 4.5
#: Ids whose texts are asked for that may be broadcast; more are joined by a shuffle.
ASKED = 1_000_000
#: Links of one hub that go to a task of their own.
HUB_PART = 500
#: Counters, by the bits of a run's hash, that tell rare runs from common ones; any order of the runs is exact.
COUNTERS = 20


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): rows of one doc_id are told apart by a hash of their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, text) -> doc_id, th (a hash of the text), n_shingles, two digests of the set, and the minimum hashes and their sketch as bytes (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, TREES * DEPTH), dtype=np.uint64)
        seeds[0] |= np.uint64(1)
        for batch in batches:
            for part in T.pieces(batch, "text"):
                sets = T.distinct_shingles(part.column(2), k)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                digest = np.zeros((2, len(sets)), np.uint64)
                labels: list[bytes | None] = [None] * len(sets)
                sketches: list[bytes | None] = [None] * len(sets)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    least = np.empty((len(full), TREES * DEPTH), ">u4")
                    for j in range(TREES * DEPTH):
                        least[:, j] = np.minimum.reduceat((every * seeds[0, j] + seeds[1, j]) >> np.uint64(32), starts)
                    for j in range(2):
                        digest[j, full] = np.add.reduceat(T.mix(every ^ T.MULTIPLIERS[j]), starts)
                    low = (least & 15).astype(np.uint8)
                    low = low[:, ::2] << 4 | low[:, 1::2]
                    for row, i in enumerate(full):
                        labels[i], sketches[i] = least[row].tobytes(), low[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())],
                    ["doc_id", "th", "n_shingles", "d1", "d2", "label", "sketch"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, d1 long, d2 long, label binary, sketch binary")


def least_agreement(percent: int) -> int:
    """How many of the sketches' parts agree at least in a pair that is similar enough, but for DEVIATIONS."""
    n, share = TREES * DEPTH, percent / 100 + (1 - percent / 100) / 16
    return int(n * share - DEVIATIONS * (n * share * (1 - share)) ** 0.5)


def _neighbours(percent: int):
    """Sorted (tree, label, id, n, sketch) -> candidate pairs of rows near each other in a region."""
    width, root, least = 4 * DEPTH, 4 * ROOT, least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            label = T.utf8(batch.column(1).cast(pa.large_binary()))[0].reshape(-1, width)
            sketch = T.utf8(batch.column(4).cast(pa.large_binary()))[0].reshape(-1, TREES * DEPTH // 2)
            now = (batch.column(0).to_numpy(), label[:, :root].copy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), sketch)
            start = 0 if kept is None else len(kept[0])
            tree, region, ids, n, sketch = now if kept is None else tuple(np.concatenate([a, b]) for a, b in zip(kept, now, strict=True))
            same = lambda w: (tree[w:] == tree[:-w]) & (region[w:] == region[:-w]).all(1)  # noqa: E731, B023
            crowded = np.zeros(len(ids), bool)
            if len(ids) > SMALL:
                crowded[SMALL:] = same(SMALL)
            found = []
            for w in range(1, min(SMALL, len(ids))):
                second = np.arange(w, len(ids))
                ok = same(w) & (second >= start) & (ids[w:] != ids[:-w])
                if w > 2:
                    ok &= ~crowded[w:]
                second = second[ok]
                differ = sketch[second] ^ sketch[second - w]
                agree = ((differ & 15) == 0).sum(1) + ((differ >> 4) == 0).sum(1)
                second = second[agree >= least]
                found.append(np.stack([ids[second - w], ids[second], n[second - w], n[second]]))
            kept = tuple(x[-SMALL:].copy() for x in (tree, region, ids, n, sketch))
            if found:
                a, b, na, nb = np.concatenate(found, 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.maximum(a, b), np.minimum(a, b), na, nb)], ["a", "b", "na", "nb"])

    return run


def _fit(percent: int):
    """Sets of such different sizes can't be similar enough."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n, label, sketch) -> (hub pairs, neighbour pairs) as (a, b), each pair once, and the crowded regions as (tree, region, id).

    What is counted by region or label is written before it is joined back, so that Spark can split a skewed side.
    """
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("label", 4 * DEPTH * t + 1, 4 * DEPTH).alias("label")) for t in range(TREES)])).alias("t")
    rows = nodes.select("id", "n", "sketch", trees).select("id", "n", "sketch", "t.tree", "t.label", F.substring("t.label", 1, 4 * ROOT).alias("region"))
    shared = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = materialize(rows.join(materialize(shared, "regions"), ["tree", "region"]), "forest")
    crowd = rows.where(F.col("size") > SMALL)
    leaf = materialize(crowd.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "leaves")
    score = crowd.select("tree", "label", "id").join(leaf, ["tree", "label"]).groupBy("id").agg(F.sum("c").alias("score"))
    scored = crowd.select("tree", "region", "id", "n").join(score, "id")
    hubs = scored.groupBy("tree", "region").agg(F.max_by(F.struct("id", "n"), F.struct("score", -F.col("id"))).alias("hub"))
    hubs = materialize(hubs, "hubs")
    pairs = crowd.select("tree", "region", F.col("id").alias("a"), F.col("n").alias("na")).join(hubs, ["tree", "region"])
    pairs = pairs.select("a", F.col("hub.id").alias("b"), "na", F.col("hub.n").alias("nb")).where("a <> b").where(_fit(percent)).select("a", "b").distinct()
    parts = max(1, rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.select("tree", "label", "id", "n", "sketch").repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    near = spread.mapInArrow(_neighbours(percent), "a long, b long, na long, nb long").where(_fit(percent)).select("a", "b").distinct()
    return materialize(pairs, "hub-pairs"), materialize(near, "near-pairs"), crowd.select("tree", "region", "id")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` is (id, text). A b with many pairs is spread by salt."""
    load = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_PART).cast("int").alias("salts")), "hub-loads")
    left = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    right = load.join(texts, load["b"] == texts["id"]).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("tb"))
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(right, ["b", "salt"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            for part in T.pieces(batch, "ta"):
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                ok = np.zeros(len(a), bool)
                for i, mine in enumerate(T.distinct_shingles(part.column(2), k)):
                    if b[i] != last:
                        last, known = b[i], T.distinct_shingles(part.column(3).slice(i, 1), k)[0]
                    both = T.common(mine, known)
                    ok[i] = both > 0 and 100 * both >= percent * (len(mine) + len(known) - both)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _counters(k: int):
    """(text) -> how many sets hold a run, by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for part in T.pieces(batch, "text"):
                for mine in T.distinct_shingles(part.column(batch.schema.get_field_index("text")), k):
                    np.add.at(total, (mine >> np.uint64(64 - COUNTERS)).astype(np.int64), 1)
        held = np.flatnonzero(total)
        for start in range(0, len(held), 1 << 16):
            some = held[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["counter", "n"])

    return run


def _prefixes(counts: Broadcast, percent: int, k: int):
    """(id, c, text) -> the runs that come first in each set, and whether a smaller set of a similar enough pair must share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text"):
                ids, c = part.column(0).to_numpy(), part.column(1).to_numpy()
                runs, sizes, wanted = [], [], []
                for mine in T.distinct_shingles(part.column(2), k):
                    n = len(mine)
                    first = n + (-percent * n) // 100 + 1
                    order = np.lexsort((mine, counts.value[(mine >> np.uint64(64 - COUNTERS)).astype(np.int64)]))[:first]
                    runs.append(mine[order])
                    sizes.append(n)
                    wanted.append(n + (-2 * percent * n) // (100 + percent) + 1)
                if not runs:
                    continue
                each = np.array([len(r) for r in runs])
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                columns = [np.concatenate(runs).view(np.int64), np.repeat(ids, each), np.repeat(c, each), np.repeat(sizes, each), place, place < np.repeat(wanted, each)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["run", "id", "c", "n", "place", "indexed"])

    return run


def prefix_pairs(texts: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """(id, c, text) -> (a, b): no pair of unlike c whose sets are similar enough is missing.

    Of such a pair the larger set shares one of its first n - percent * n + 1 runs, the smaller one, whose number wanted in common
    is larger by its share, one of fewer. Runs that only one c has are dropped before the join.
    """
    total = texts.select("text").mapInArrow(_counters(k), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTERS, np.int64)
    counts[total.column("counter").to_numpy()] = total.column("n").to_numpy()
    order = texts.sparkSession.sparkContext.broadcast(counts)
    first = materialize(texts.select("id", "c", "text").mapInArrow(_prefixes(order, percent, k), "run long, id long, c long, n long, place long, indexed boolean"), "prefixes")
    mixed = first.groupBy("run").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("run")
    rows = materialize(first.join(materialize(mixed, "mixed-runs"), "run"), "mixed-prefixes")
    side = lambda c: rows.select("run", *[F.col(x).alias(x + c) for x in ("id", "c", "n", "place", "indexed")])
    enough = (100 + percent) * F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey")) >= percent * (F.col("nx") + F.col("ny"))
    larger = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("idx") > F.col("idy")))
    met = side("x").join(side("y").where("indexedy"), "run").where((F.col("cx") != F.col("cy")) & larger & enough)
    return met.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def _grouped(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(signatures without their hashes, sets): each distinct set with its first row as (doc_id, th) and the first row of its component as (group_id, group_th)."""
    mark = written()
    made = materialize(signatures(docs, k), "signatures")
    named = made.where("n_shingles > 0 and doc_id is not null")
    sets = named.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    sets = materialize(sets.select("d1", "d2", "n_shingles", "first.doc_id", "first.th", F.monotonically_increasing_id().alias("id")), "sets")
    nodes = named.select("doc_id", "th", "d1", "d2", F.col("n_shingles").alias("n"), "label", "sketch").join(sets.select("id", "doc_id", "th", "d1", "d2"), ["doc_id", "th", "d1", "d2"]).dropDuplicates(["id"])
    hubs, near, crowd = candidates(nodes.select("id", "n", "label", "sketch"), percent)

    def texts_of(ids: DataFrame, *columns: str) -> DataFrame:
        rows = small(materialize(ids.join(sets.select("id", "doc_id", "th"), "id"), "asked"), ASKED)
        return materialize(_keyed(docs).join(rows, ["doc_id", "th"]).dropDuplicates(["id"]).select("id", *columns, "text"), "texts")

    pairs = hubs.unionByName(near)
    texts = texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    links = connected_components(confirm(hubs, texts, percent, k))
    at = lambda c: links.select(F.col("id").alias(c), F.col("component_id").alias("c" + c))
    open_ = near.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = confirm(materialize(open_, "open-pairs"), texts, percent, k)
    stars = links.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    found = connected_components(materialize(more, "near-links").unionByName(stars))
    at = found.select("id", F.col("component_id").alias("c"))
    crowd = crowd.join(at, "id", "left").select("tree", "region", "id", F.coalesce("c", "id").alias("c"))
    split = crowd.groupBy("tree", "region").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("tree", "region")
    rest = materialize(crowd.join(materialize(split, "split-regions"), ["tree", "region"]).select("id", "c").distinct(), "split-nodes")
    if not rest.isEmpty():
        texts = texts_of(rest, "c")
        pairs = materialize(prefix_pairs(texts, percent, k), "prefix-pairs")
        more = materialize(confirm(pairs, texts.select("id", "text"), percent, k), "prefix-links")
        if not more.isEmpty():
            found = connected_components(more.unionByName(found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))))
    member = sets.join(found, "id", "left").select("d1", "d2", "n_shingles", "doc_id", "th", F.coalesce("component_id", "id").alias("c"))
    member = materialize(member, "members")
    group = materialize(member.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("first")).select("c", F.col("first.doc_id").alias("group_id"), F.col("first.th").alias("group_th")), "groups")
    drop_intermediates(docs.sparkSession, mark, (made, member, group))
    return made.drop("label", "sketch"), member.join(group, "c").drop("c")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    Two texts are linked if their sets of k-word runs (A-Z lower-cased, words split at ASCII white space) have
    100 * common >= percent * union. Defined cases: null text, empty text or one without words has the empty set and
    no link; fewer than k words are one run; equal sets are linked; rows with null doc_id have no link, a null
    component_id and are kept; rows that share a doc_id but not a text are linked by their own texts each; very long texts
    are one set like others; an empty table gives no row; extra columns are ignored.
    """
    made, sets = _grouped(docs, percent, k)
    rows = made.select("doc_id", "n_shingles", "d1", "d2").join(sets.select("d1", "d2", "n_shingles", "group_id"), ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component, F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest doc_id (and then text hash); columns as they are.

    Rows that share doc_id and text become one; rows that share a doc_id but not a text are documents of their own; rows with
    null doc_id, and documents without words but for repeated rows, stay. Very long texts are treated whole.
    """
    made, sets = _grouped(docs, percent, k)
    first = (F.col("doc_id") == F.col("group_id")) & (F.col("th") == F.col("group_th"))
    rows = made.where("doc_id is not null").join(sets.select("d1", "d2", "n_shingles", "group_id", "group_th"), ["d1", "d2", "n_shingles"], "left")
    gone = materialize(rows.where(~F.coalesce(first, F.lit(True))).select("doc_id", "th").distinct(), "near-duplicates")
    row = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    kept = row.where("doc_id is not null").join(gone, ["doc_id", "th"], "left_anti").dropDuplicates(["doc_id", "th"])
    return kept.select("row.*").unionByName(row.where("doc_id is null").select("row.*"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact links in plain SQL: every pair of texts that share a run of words, then the smallest reachable id.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
reps AS (SELECT h, min(doc_id) AS id FROM sets GROUP BY h),
rs AS (SELECT s.doc_id AS id, g FROM s JOIN reps ON s.doc_id = reps.id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM rs a JOIN rs b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS a, id AS c FROM reps UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b),
m AS (SELECT a AS id, min(c) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (h) LEFT JOIN m ON m.id = reps.id
"""

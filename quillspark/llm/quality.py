"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are runs of ORDER bytes of UTF-8, so no script or letter case is lumped together and nothing is out of vocabulary. The
n-grams of the trusted texts are counted by shards of the key, lower orders count distinct continuations, and the model is
these tables of counts, which grow with the trusted text; no task and no driver holds them.

Documents are scored by joins with those counts. Texts are packed into blocks, of which each names its distinct n-grams once. The
n-grams that any block names get their costs by joins with the model, from the lowest order up; the costs go back to the
blocks that asked, and each block adds them up by document. So what is shuffled is a few hundredths of the n-grams; the texts are
written once, compressed and bucketed by block.

A document's score is its bits per byte (the logarithm of its perplexity), shrunk to its language's mean by PRIOR bytes.
It is rejected above its language's limit, the quantile HIGH of the scores of trusted documents of that language that were
held out of the model, one of HELD_OUT. A language's mean and limit are shrunk to those of all languages, by FEW_BYTES bytes
and FEW documents, so that a language with few trusted documents passes into the others without a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kneser as K
from . import _text as T
from ._common import bucketed, drop_intermediates, materialize, returning, small, table, whole_row, written

HIGH, PRIOR, HELD_OUT = 0.995, 64, 5
FEW, FEW_BYTES = 25, 10_000
#: Bytes of text after which a block is closed, at the end of a document.
BLOCK_BYTES, LEVEL = 16 << 20, 9
#: Bytes of text whose n-grams are worked on at once, at some 100 bytes of memory each.
PIECE = 1 << 19
#: Keys beside the distinct ones of a block after which they are merged with these, if these are no more.
MERGED = 1 << 18
#: Ids of trusted documents, and texts that are rejected, that may be broadcast to a scan of the texts; more are joined by a shuffle.
TRUSTED = REJECTED = 1_000_000
BLOCK = "block long, doc_id array<long>, lang array<string>, h1 array<long>, h2 array<long>, sizes array<long>, data binary, keys binary"
SCORED = "doc_id long, lang string, h1 long, h2 long, n_bytes long, bits double"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that every label calls good."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Texts are known by two hashes; what is held out of the model goes by the first."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.col("text")).alias("h2"), *more)


def _held_out() -> Column:
    return F.pmod("h1", F.lit(HELD_OUT)) == 0


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(text) -> (key, c): how often each n-gram of the highest order comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text", PIECE):
                key, c = np.unique(K.keys(*T.utf8(part.column(0))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], ["key", "c"])

    return texts.select("text").mapInArrow(returning(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _context(key: str = "key") -> Column:
    return F.expr(f"{key} div {K.SYMBOLS}")


def _suffix(n: int) -> Column:
    return F.col("key") % F.lit(K.SYMBOLS**n)


def discounts(grams: DataFrame) -> tuple[float, float, float]:
    """Of counts of one, two, and more, from the counts of counts: four numbers come to the driver."""
    n = [0, *grams.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tuple(max(0.05, min(float(k), k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k)) for k in (1, 2, 3))


def fit_orders(counts: DataFrame) -> list[tuple[DataFrame, tuple[float, float, float]]]:
    """(key, c) of the highest order -> for each order from the lowest its counts (key, c) and discounts.

    Orders below the highest count distinct n-grams one symbol longer.
    """
    orders = [materialize(counts, "ngrams")]
    for n in range(K.ORDER - 1, 0, -1):
        orders.insert(0, materialize(orders[0].groupBy(_suffix(n).alias("key")).agg(F.count(F.lit(1)).alias("c")), "ngrams"))
    return [(grams, discounts(grams)) for grams in orders]


def pack_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, h1, h2, text) -> blocks of whole documents: their bytes, compressed, and their distinct n-grams."""
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        rows: list[pa.RecordBatch] = []
        texts = bytearray()
        sizes: list[np.ndarray] = []
        known, fresh = [np.zeros(0, np.int64)], 0

        def close() -> pa.RecordBatch:
            nonlocal number, size, texts, known, fresh
            joined = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined.column(k)) for k in range(4)]
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), pa.array(np.concatenate(sizes))))
            data = pa.Codec("zstd", compression_level=LEVEL).compress(texts, asbytes=True)
            key = K.pack_keys(np.unique(np.concatenate(known)))
            out = pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([data], pa.binary()), pa.array([key], pa.binary())], names)
            number, size, texts, known, fresh = number + 1, 0, bytearray(), [np.zeros(0, np.int64)], 0
            for x in (rows, sizes):
                x.clear()
            return out

        for batch in batches:
            for part in T.pieces(batch, "text", PIECE):
                key, data, n = K.distinct(part.column(4))
                rows.append(part.select([0, 1, 2, 3]))
                texts += data.data
                sizes.append(n)
                known.append(key)
                fresh += len(key)
                if fresh > max(MERGED, len(known[0])):  # most are known, so that the pieces' keys together would be many times the block's
                    known, fresh = [np.unique(np.concatenate(known))], 0
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield close()
        if rows:
            yield close()

    return docs.mapInArrow(returning(run), BLOCK)


def _asked(blocks: DataFrame) -> DataFrame:
    """(block, key) of the n-grams that the blocks name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key = K.unpack_keys(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key)], ["block", "key"])

    return blocks.select("block", "keys").mapInArrow(returning(run), "block long, key long")


def ngram_bits(model: list[tuple[DataFrame, tuple[float, float, float]]], asked: DataFrame) -> DataFrame:
    """(key) of distinct n-grams -> (key, bits), the interpolated cost of each under ``model`` (see ``fit_orders``).

    An n-gram's probability is its discounted share of its context, and what the context's discounts leave times the
    probability of the n-gram without its first symbol; an unseen context leaves all.
    """
    lower = None
    for n, (grams, (d1, d2, d3)) in enumerate(model, 1):
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = grams.groupBy(_context().alias("context")).agg(F.sum("c").alias("total"), (F.count_if(F.col("c") == 1) * d1 + F.count_if(F.col("c") == 2) * d2 + F.count_if(F.col("c") > 2) * d3).alias("off"))
        rows = asked if n == K.ORDER else asked.select(_suffix(n).alias("key")).distinct()
        rows = rows.join(grams.select("key", (F.col("c") - off).alias("rest")), "key", "left").withColumn("context", _context()).join(contexts, "context", "left")
        below = F.lit(1.0 / K.SYMBOLS)
        if lower is not None:
            rows, below = rows.withColumn("shorter", _suffix(n - 1)).join(lower, "shorter"), F.col("below")
        p = F.when(F.col("total").isNull(), below).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("off") * below) / F.col("total"))
        lower = materialize(rows.select(F.col("key").alias("shorter"), p.alias("below")), "ngram-costs")
    return lower.select(F.col("shorter").alias("key"), (-F.log2(F.greatest("below", F.lit(1e-30)))).alias("bits"))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their n-grams' costs -> one row per document."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, lang, h1, h2, sizes = (batch.column(k)[i].values for k in range(5))
            offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
            data = np.frombuffer(pa.decompress(batch.column(5)[i].as_py(), int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b"", np.uint8)
            costs = batch.column(6)[i].values
            known = [np.zeros(0, np.int64), np.zeros(0, np.float32)] if costs is None else [costs.field(k).to_numpy() for k in range(2)]
            yield pa.RecordBatch.from_arrays([ids, lang, h1, h2, sizes, pa.array(K.score(data, offsets, *known, PIECE))], [c.split()[0] for c in SCORED.split(", ")])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, two hashes of the text, n_bytes and bits under the model of the trusted documents."""
    mark = written()
    trusted = small(materialize(trusted_ids(labels), "trusted"), TRUSTED)
    texts = _keyed(docs, F.col("text")).join(trusted, "doc_id").where(~_held_out()).select("text")
    model = fit_orders(ngram_counts(texts))
    blocks = bucketed(pack_blocks(_keyed(docs, F.col("text"))), "quality-blocks", "block")
    bits = ngram_bits(model, materialize(_asked(blocks).select("key").distinct(), "ngrams-asked"))
    costs = _asked(blocks).join(bits, "key").groupBy("block").agg(F.collect_list(F.struct("key", F.col("bits").cast("float"))).alias("costs"))
    rows = blocks.drop("keys").join(costs, "block", "left").drop("block").mapInArrow(returning(_scores), SCORED)
    scored = materialize(rows, "scored")
    drop_intermediates(docs.sparkSession, mark, (scored,))
    return scored


def _bits_per_byte(base: Column) -> Column:
    return (F.col("bits") + base * PRIOR) / (F.col("n_bytes") + PRIOR)


def _quantiles(values: DataFrame, *by: str) -> DataFrame:
    """(by, x) -> by, n and the quantile HIGH, exact at thousandths of a bit, from counts, so that reruns agree."""
    cells = values.groupBy(*by, F.ceil(F.col("x") * 1000).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by)
    cells = cells.withColumn("upto", F.sum("n").over(whole.orderBy("cell"))).withColumn("all_n", F.sum("n").over(whole))
    return cells.groupBy(*by).agg(F.max("all_n").alias("n"), (F.min(F.when(F.col("upto") >= F.ceil(F.col("all_n") * HIGH), F.col("cell"))) / 1000).alias("high"))


def language_limits(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per language: lang, base (mean bits per byte), limit, n_trusted (held-out documents that both rest on)."""
    good = materialize(scored.where(_held_out()).join(trusted_ids(labels), "doc_id").select("lang", "n_bytes", "bits"), "trusted-scores")
    sums = [(F.sum(F.round(F.col("bits") * 1000).cast("long")) / 1000).alias("bits"), F.sum("n_bytes").alias("n_bytes")]
    whole = good.agg(*sums).select(F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).otherwise(0.0).alias("all_base"))
    whole = materialize(whole, "base")
    mean = (F.coalesce("bits", F.lit(0.0)) + F.col("all_base") * FEW_BYTES) / (F.coalesce("n_bytes", F.lit(0)) + FEW_BYTES)
    bases = good.groupBy("lang").agg(*sums).join(F.broadcast(whole)).select("lang", mean.alias("base"))
    bases = materialize(bases, "bases")
    of = lambda a, b: a["lang"].eqNullSafe(b["lang"])
    over = materialize(good.join(small(bases), of(good, bases)).select(good["lang"], (_bits_per_byte(F.col("base")) - F.col("base")).alias("x")), "rated")
    by_lang, of_all = _quantiles(over, "lang"), _quantiles(over).select(F.col("high").alias("all_high"))
    langs = scored.select("lang").distinct()
    rows = langs.join(bases, of(langs, bases), "left").select(langs["lang"], "base")
    rows = rows.join(by_lang, of(rows, by_lang), "left").select(rows["lang"], "base", "n", "high")
    rows = rows.join(F.broadcast(whole), how="left").join(F.broadcast(of_all), how="left")
    n = F.coalesce("n", F.lit(0))
    base = F.coalesce("base", "all_base", F.lit(0.0))
    high = (n * F.coalesce("high", F.lit(0.0)) + FEW * F.col("all_high")) / (n + FEW)
    return materialize(rows.select("lang", base.alias("base"), (base + high).alias("limit"), n.cast("long").alias("n_trusted")), "limits")


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, labels)
    limits = small(language_limits(scored, labels))
    rows = scored.join(limits, scored["lang"].eqNullSafe(limits["lang"])).select(scored["*"], "base", "limit", "n_trusted")
    rated = rows.withColumn("bits_per_byte", _bits_per_byte(F.col("base")))
    return rated.withColumn("kept", F.coalesce(F.col("bits_per_byte") <= F.col("limit"), F.lit(True)))


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, bits_per_byte, limit, n_trusted (documents behind the limit), kept.

    Defined cases: a null or empty text has the language's mean score and is kept, unless that language's limit is below its mean; a
    score that ties with the limit is kept; null is a language of its own; a language without trusted documents has
    mean and limit of all; without any trusted document everything is kept; labels of null doc_ids don't count, and a document
    is trusted if all its labels are; repeated rows are judged alike; very long texts are a block of their own and scored whole; an empty
    table gives no row; extra columns are ignored.
    """
    return _judged(docs, labels).select("doc_id", "lang", "n_bytes", "bits_per_byte", "limit", "n_trusted", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``judge_quality`` keeps, columns as they are; equal texts of a language share their verdict."""
    gone = _judged(docs, labels).where("not kept").select(F.col("lang").alias("of_lang"), F.col("h1").alias("of_h1"), F.col("h2").alias("of_h2")).distinct()
    gone = small(materialize(gone, "rejected"), REJECTED)
    rows = _keyed(docs, whole_row(docs).alias("row"))
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("h1") == F.col("of_h1")) & (F.col("h2") == F.col("of_h2"))
    return rows.join(gone, same, "left_anti").select("row.*")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

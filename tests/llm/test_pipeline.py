"""The whole pipeline against a plain-Python version of its stages."""

import duckdb
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from quillspark.llm import mixing, quality

from .test_operators import held_out, restated_limits, restated_scores, restated_tokens


def good_ones(docs, labels, held):
    """Documents within their language's limit, by dictionaries and sorted lists."""
    good = {d for d in labels if min(q for q, _ in labels[d]) == 1}
    lang = {d: x for d, _, x, *_ in docs}
    scores = restated_scores({d: t for d, t, *_ in docs}, good, held)
    limits = restated_limits(scores, lang, [d for d in lang if d in good & held])
    within = lambda d: (scores[d][1] + limits[lang[d]][0] * quality.PRIOR) / (scores[d][0] + quality.PRIOR) <= limits[lang[d]][1]
    return [r for r in docs if within(r[0])]


def one_of_each(docs):
    sets = {}
    for d, t, *_ in docs:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    ids = sorted(sets)
    for _ in ids:
        before = dict(group)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if group[a] != group[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    return [r for r in docs if group[r[0]] == r[0]]


def test_pipeline_against_python(spark, sf):
    con = duckdb.connect()
    read = lambda q: con.sql(q).fetchall()
    docs = read(f"select doc_id, text, lang, source from '{sf}/documents.parquet'")
    labels = {}
    for d, q, t in read(f"select doc_id, quality, toxic from '{sf}/labels.parquet'"):
        labels.setdefault(d, []).append((q, t))
    items = [t for (t,) in read(f"select text from '{sf}/benchmark.parquet'")]
    docs = one_of_each(good_ones(docs, labels, held_out(spark.read.parquet(f"{sf}/documents.parquet"))))
    docs = [r for r in docs if not any(t in r[1] for t in items)]
    con.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs], "source": [r[3] for r in docs]}))
    copies = {d: taken // size for d, size, taken in con.sql(f"select doc_id, size, taken from ({mixing.OP1_SQL})").fetchall() if size}
    want = restated_tokens([(r[0], r[1]) for r in docs for _ in range(copies.get(r[0], 0))])
    assert want and sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == want


def test_stages_keep_the_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)}

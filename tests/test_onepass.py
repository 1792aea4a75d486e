"""Scoring in one pass against the token tables' own windows, on odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import boundaries, chunks, onepass, scoring
from quillspark.plans import lifecycles, registry

#: Queries whose tokens stay in one kernel, and whether sums by doc_id follow.
ONE_PASS = {
    "offset_accuracy": False,
    "scored_tokens": False,
    "boundary_tokens": False,
    "boundary_positions": False,
    "scorer_lifecycle": False,
    "cluster_units": False,
    "clusters_in_context": False,
    "inference_stats": True,
}


class Tuples:
    """A scorer without arrays, whose tokens repeat places, lie outside the text and tie."""

    def __call__(self, texts):
        out = scoring.HashScorer()(texts)
        return [[*x, ("##" + t[:1], 0, 1, 0.0, 0.5), ("[UNK]", 1, 2, 0.0, 9.0), ("same", 2, 3, 0.0, 0.5), ("far", 700, 701, 0.0, 2.0), ("before", -900, 3, 0.0, 1.0), ("tie", 1, 2, 1.0, 1.0)] for x, t in zip(out, texts, strict=True)]


def odd_texts(n, seed=3):
    random.seed(seed)
    letters = "abZ19 \t\n\r\f\v[]#CLSEP.é漢😀\x00\x7f\x80ßİ٣       "
    return [*("", None, "x" * 1700, "a " * 1300, "[CLS] [SEP] ##a"), *("".join(random.choices(letters, k=random.choice((1, 7, 499, 500, 501, 550, 1600)))) for _ in range(n))]


@pytest.fixture(scope="module", params=["own", "shared"])
def docs(request, spark):
    rows = list(enumerate(odd_texts(40)))
    if request.param == "own":
        rows.append((None, "without an id. " * 40))
    else:  # equal texts, so that no order of theirs is open
        rows += [(k, t) for k, t in rows if k in (3, 9)] + [(10**6, t) for t in (None, "", "b c " * 10)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def bag(df, *skip):
    cell = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted([tuple(cell(r[c]) for c in sorted(df.columns) if c not in skip) for r in df.collect()])


def test_arrays_are_the_tuples():
    scorer, texts = scoring.HashScorer(), [t or "" for t in odd_texts(150)]
    for some in ([], [""], *(texts[k : k + 3] for k in range(len(texts)))):
        counts, *columns = scorer.columns(some)
        want = scorer(some)
        assert counts.tolist() == [len(x) for x in want]
        assert list(zip(*[c.tolist() for c in columns], strict=True)) == [t for x in want for t in x]


@pytest.mark.parametrize("load", [scoring.HashScorer, Tuples])
def test_against_windows(docs, load):
    tokens = scoring.token_table(scoring.score_chunks(chunks.fixed_chunks(docs), load)).cache()
    named = tokens.where("doc_id is not null")
    positions = boundaries.boundary_positions(named)
    clusters = boundaries.with_context(boundaries.gap_clusters(positions, 5), docs)
    repeats = docs.groupBy("doc_id").count().where("count > 1").count() > 0
    # which of two texts with one id a tied number goes to is open; all else of these tokens is not
    skip = ("tok_idx",) if repeats else ()
    assert bag(onepass.token_table(docs, load), *skip) == bag(tokens.drop("length"), *skip)
    assert bag(onepass.boundary_tokens(docs, load), *skip) == bag(scoring.boundary_tokens(tokens), *skip)
    assert bag(onepass.inference_stats(docs, load)) == bag(scoring.inference_stats(tokens))
    assert bag(onepass.boundary_positions(docs, load)) == bag(positions)
    assert bag(onepass.gap_clusters(docs, load, 5, lifecycles.CONTEXT)) == bag(clusters)
    assert bag(onepass.gap_clusters(docs, load, 5)) == bag(boundaries.gap_clusters(positions, 5))
    if not repeats:
        assert bag(onepass.offset_accuracy(docs, load)) == bag(scoring.offset_accuracy(tokens, docs))
    numbers = onepass.token_table(docs, load).groupBy("doc_id").agg(F.min("tok_idx"), F.max("tok_idx") + 1 - F.count("tok_idx"), F.count_distinct("tok_idx") - F.count("tok_idx"))
    assert all(tuple(r)[1:] == (0, 0, 0) for r in numbers.collect())
    tokens.unpersist()


def test_rounding_is_sparks(spark):
    values = [0.0, 1.0, 0.5, 1e-12, 0.1234567885, 0.1234567895, 0.0000000005, 0.9999999995, *(random.Random(1).random() for _ in range(2000)), *(k / 1e10 for k in range(1, 4000, 7))]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 9)).collect()]
    import numpy as np

    assert onepass.rounded(np.array(values), 9).tolist() == want


@pytest.mark.parametrize("name", list(ONE_PASS))
def test_tokens_stay_in_one_kernel(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Window" not in plan and "Join" not in plan
    assert plan.count("MapInArrow") == 1
    assert plan.count("hashpartitioning") == ONE_PASS[name]

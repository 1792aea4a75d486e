import random

import pytest

WORDS = "alpha beta gamma delta echo fox golf hotel india jazz kilo lima mike nova oscar papa quiz romeo sierra tango union victor west xray yoke zulu".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def near(text, edits, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, groups of copies."""
    base = prose(300, 1)
    rows = [(i, prose(40 + i, 100 + i), "en", f"s{i % 4}") for i in range(20)]
    rows += [(100 + i, base, "en", "s0") for i in range(12)] + [(120 + i, near(base, 2, i), "de", "s1") for i in range(30)]
    rows += [(200, None, "en", "s0"), (201, "", "en", None), (202, " \n\t ", None, None), (203, "one two", "fr", "é"), (204, "ONE two", "fr", "é"), (205, "x" * 5000, "en", "s2"), (206, prose(20_000, 5), "en", "s3")]
    rows += [(None, base, "en", "s0"), (None, None, None, None), (7, prose(47, 107), "en", "s3"), (300, "tie", "en", "s1"), (301, "tie", "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with extra columns whose names the operators use inside."""
    extra = [(*r, len(r[1] or ""), 1, "k", "r", 0.5, 2) for r in odd_rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, row string, rank double, copies int").repartition(5).cache()

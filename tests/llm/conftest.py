import random

import pytest
from pyspark.sql import functions as F

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    common = "the of and to in a is that for it".split()
    return " ".join(r.choice(common) if r.random() < 0.35 else "".join(r.choice("abcdefghilmnorstuéß") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null, empty, long, repeated and near-equal texts; null and repeated ids."""
    base, shared, rng = prose(1, 300), prose(2, 90), random.Random(5)
    words = base.split()

    def near(k, seed):
        r, w = random.Random(seed), list(words)
        for i in r.sample(range(len(w)), k):
            w[i] = f"changed{seed}x{i}"
        return " ".join(w)

    texts = [None, "", " ", "word", "two words", "a b c", "a b c d", base, base, base.upper(), near(1, 3), near(2, 4), near(3, 5), near(9, 6), near(40, 7)]
    texts += [prose(20 + i, 60) + "\n" + shared + "\n" + prose(40 + i, 50) for i in range(6)]
    texts += [prose(99, 12000), "x" * 3000, "é" * 900, "tick tock " * 300, "line one here\n" * 60, "\n\n \t\n", "ÄÖ 漢字 \U0001f600 zero\x00byte", "#*$%&|<> " * 30]
    texts += [prose(60 + i, rng.randint(1, 130)) for i in range(30)]
    out = [(i, t, ["en", "de", None, "xx"][i % 4], f"s{i % 3}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    out.append((3, "word", "en", "s0", 4))  # the same row once more
    out.append((None, prose(200, 80), None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    for name in ("rid", "key", "n", "node", "size", "token", "a", "c", "k0", "k", "g", "s", "y", "spans", "packed", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="session")
def lister():
    return listed

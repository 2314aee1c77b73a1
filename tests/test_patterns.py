"""The Spark rendering of the rules finds what the canonical patterns find."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskflow.functions import detect as D
from maskflow.functions import patterns as P

PARTS = [*"aZ0é_.%+-@ (),\n\x01", "555", "123", "4567", "555-123-4567", "(555) 123-4567"]
PARTS += ["856-45-6789", "com", "co.uk", "a@b.com", "@x.io", "+44 ", "..", "-", "É", "😀", "....a"]


@pytest.mark.parametrize(
    "entities", [None, ["US_SSN", "PHONE_NUMBER"], ["EMAIL_ADDRESS"], ["US_SSN"]]
)
def test_random_texts(spark, entities):
    rnd = random.Random(11)
    rows = [
        (i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 14)))) for i in range(8000)
    ]
    pattern = P.canonical_pattern(P.pick(entities))
    pdf = pd.DataFrame(rows, columns=["i", "t"])  # noqa: F841 (read by the SQL below)
    sql = f"""SELECT i, regexp_extract_all(t, '{pattern}') AS h,
              regexp_split_to_array(t, '{pattern}') AS g FROM pdf ORDER BY i"""
    want = duckdb.connect().execute(sql).fetchall()
    got = (
        spark.createDataFrame(rows, "i long, t string")
        .select(
            "i",
            D.hit_values(F.col("t"), entities),
            D.gaps(F.col("t"), entities),
            D.has_pii(F.col("t"), entities),
            D.detect(F.col("t"), entities),
        )
        .orderBy("i")
        .collect()
    )
    assert sum(len(w[1]) for w in want) > 500
    for (i, t), w, g in zip(rows, want, got):
        assert (g[1], g[2], g[3]) == (w[1], w[2], bool(w[1])), t
        assert [t[h.start : h.end] for h in g[4]] == w[1] == [h.value for h in g[4]]
        assert [h.pos for h in g[4]] == list(range(len(w[1])))


def test_long_texts_neither_overflow_nor_stall(spark):
    texts = ["a@" + "b.b" * 200_000 + ".com", "a@" + "1.1" * 200_000, "a." * 200_000]
    texts += ["555-" * 200_000, "a@" * 200_000, "a@b" + ".com-" * 200_000, "x" * 500_000 + "@b.co"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = df.select(F.size(D.hit_values(F.col("t")))).collect()
    assert [r[0] for r in got] == [1, 0, 0, 0, 0, 1, 1]


def test_unknown_entity():
    with pytest.raises(ValueError):
        P.pick(["CREDIT_CARD"])

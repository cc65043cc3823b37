import math
import os
from collections import Counter

import pytest

from folioscope.llm import encode, mixture
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no vocabularies here")
DOCS = "doc_id long, text string, source string, n_tokens int, bucket string"
TARGETS = "source string, target_share double, max_repeats int, extra int"


def docs(spark, sizes):
    data, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            data.append((i, "one two three four", source, 9, "clash"))
    return spark.createDataFrame(data, DOCS)


def test_shares_and_limits(spark):
    d = docs(spark, {"big": 600, "small": 20})
    t = spark.createDataFrame([("big", 0.8, 1, 0), ("small", 0.2, 3, 0), ("none", 0.1, 5, 0)], TARGETS)
    r = {x.source: x for x in mixture.shares(d, t).collect()}
    assert r["none"].mixed_tokens == 0 and r["none"].actual_share == 0.0
    assert r["small"].most_copies == 3 and r["small"].mixed_documents == 60
    assert abs(r["big"].actual_share / r["small"].actual_share - 4) < 0.05
    copies = Counter()
    for x in mixture.mix(d, t).collect():
        copies[x.source] += x.copies
        assert 1 <= x.copies <= {"big": 1, "small": 3}[x.source]
    assert copies["small"] == 60 and abs(copies["big"] - 240) <= 1


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_systematic_sampling_is_the_walk_over_integers(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixture, "BUCKETS", buckets)
    d = docs(spark, {"a": 37, "b": 11})
    t = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 4, 0)], TARGETS)
    s = mixture.sized(d, t)
    rate = mixture.rates(s, t)
    per = {r.source: (r.rate, r.offset) for r in rate.collect()}
    got = Counter()
    for r in mixture.draw(s, rate).collect():
        got[r.source] += r.copies
        assert math.floor(per[r.source][0]) <= r.copies <= math.ceil(per[r.source][0])
    for source, n in (("a", 37), ("b", 11)):
        assert got[source] == math.floor(per[source][0] * n + per[source][1]) - math.floor(per[source][1])


def test_a_given_size_is_limited_by_repeats(spark):
    d = docs(spark, {"a": 10, "b": 10})
    t = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 9, 0)], TARGETS)
    r = {x.source: x for x in mixture.shares(d, t, total_tokens=400).collect()}
    assert (r["a"].mixed_documents, r["b"].mixed_documents) == (10, 50)


def test_odd_rows_and_empty_tables(spark):
    data = [(1, None, "a", 0, ""), (2, "", "a", 0, ""), (3, "x", None, 0, ""), (4, "x", "other", 0, ""), (5, "one two", "a", 0, ""), (5, "one two", "a", 0, ""), (None, "x", "a", 0, "")]
    d = spark.createDataFrame(data, DOCS)
    t = spark.createDataFrame([("a", 1.0, 2, 0), (None, 0.5, 1, 0), ("z", None, None, 0)], TARGETS)
    assert rows(mixture.mix(d, t), "doc_id", "copies") == [(5, 2)]
    assert mixture.mix(d.where("false"), t).count() == 0
    assert rows(mixture.shares(d.where("false"), t), "source", "mixed_tokens", "actual_share") == [("a", 0, 0.0), ("z", 0, 0.0)]
    assert mixture.mix(d, t.where("false")).count() == 0

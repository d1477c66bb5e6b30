"""Exact order statistics and text facts against plain Python, and what their plans hold."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import frame, profile, ranks


def nearest(values, q):
    return sorted(values)[math.floor(q * (len(values) - 1) + 0.5)]


def linear(values, q):
    values, at = sorted(values), q * (len(values) - 1)
    low = values[math.floor(at)]
    return low + (values[math.ceil(at)] - low) * (at - math.floor(at))


@pytest.mark.parametrize("small", [ranks.SMALL, 40])
@pytest.mark.parametrize("q", [0.1, 0.5, 1.0])
def test_quantiles_of_groups(spark, q, small):
    pick = random.Random(3)
    rows = []
    for g in ("many", "few", "ties", None):
        for _ in range({"many": 9000, "few": 3, "ties": 4000, None: 500}[g]):
            a = {"many": pick.gauss(0, 1) * 10 ** pick.randrange(-200, 200), "few": pick.random(), "ties": float(pick.choice([1, 1, 1, 1, 2, 900])), None: -pick.random()}[g]
            rows.append((g, a, pick.choice([None, pick.randrange(10**6)])))
    rows.append(("nulls", None, None))
    df = spark.createDataFrame(rows, "g string, a double, b int").repartition(4)
    for how, want in (("nearest", nearest), ("linear", linear)):
        got = {(r.g, r.column): r.quantile for r in ranks.quantiles(df, ["g"], ["a", "b"], q, how, small).collect()}
        for g in ("many", "few", "ties", None):
            for k, c in ((1, "a"), (2, "b")):
                values = [r[k] for r in rows if r[0] == g and r[k] is not None]
                if values:
                    assert got.pop((g, c)) == pytest.approx(want(values, q), rel=1e-12), (g, c, how)
        assert not got


def test_quantiles_keep_their_type_and_refuse_nonsense(spark):
    df = spark.createDataFrame([(1, 5), (1, 7)], "g int, v bigint")
    assert ranks.quantiles(df, ["g"], ["v"], 0.5).schema["quantile"].dataType.simpleString() == "bigint"
    assert ranks.quantiles(df.limit(0), [], ["v"], 0.5).count() == 0
    for q, how in ((1.5, "nearest"), (0.5, "middle")):
        with pytest.raises(ValueError):
            ranks.quantiles(df, ["g"], ["v"], q, how)


def test_a_sketch_that_misses_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ACCURACY", 2)
    values = [float(k**3 % 1009) for k in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for q in (0.01, 0.37, 0.99):
        assert ranks.quantiles(df, [], ["v"], q).first()["quantile"] == nearest(values, q)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_aggregate_spreads_groups(spark):
    rows = [(k % 2 if k % 5 else None, k % 7, k % 11 if k % 3 else None) for k in range(700)]
    df = spark.createDataFrame(rows, "g int, a int, b int")
    out = frame.aggregate(df, ["g"], [F.sum("a").alias("s")], {"ma": "a", "mb": "b"}, {"da": "a", "db": "b"})
    groups = defaultdict(list)
    for g, a, b in rows:
        groups[g].append((a, b))
    for r in out.collect():
        a, b = [x for x, _ in groups[r.g]], [y for _, y in groups[r.g] if y is not None]
        assert (r.s, r.ma, r.mb, r.da, r.db) == (sum(a), linear(a, 0.5), linear(b, 0.5), len(set(a)), len(set(b)))
    assert "Expand" not in plan(out) and "percentile(" not in plan(out)


def test_text_facts(spark):
    pick = random.Random(2)
    long = ["z" * 80 + str(k) for k in range(3)] + ["é" * 64, "é" * 64 + "a"]
    rows = [(pick.choice(long), f"only {k}", None, pick.choice(["b", "a"]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "l string, u string, n string, s string, i int")
    got = {r["column"]: tuple(r)[1:] for r in profile.text_facts(df).collect()}
    for k, c in ((0, "l"), (1, "u"), (3, "s")):
        counts = Counter(r[k] for r in rows)
        top = min(counts, key=lambda v: (-counts[v], v.encode()))
        assert got[c] == (len(counts), top, counts[top], len(top))
    assert got["n"] == (0, None, None, None) and set(got) == {"l", "u", "n", "s"}
    assert profile.text_facts(df.select("i")).count() == 0 and {r.distinct for r in profile.text_facts(df.limit(0)).collect()} == {0}


def test_long_texts_stay_out_of_the_shuffle(spark):
    """No operator of the counting job that follows a shuffle holds the texts, and nothing multiplies rows for distinct counts."""
    df = spark.range(100).select(F.repeat(F.col("id").cast("string"), 5000).alias("t"), F.col("id").cast("string").alias("u"))
    counted = profile._hashes(df, ["t", "u"], F.substring("value", 1, profile.HEAD).alias("head")).groupBy("place", "h1", "h2").agg(F.count("*").alias("n"), F.min("head").alias("head"))
    counted.collect()
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "Expand" not in plan(profile.profile_columns(df))
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("value#" in line for line in shuffled)

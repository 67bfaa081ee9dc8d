"""Array, ordering and text helpers against plain Python."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from code_impact.functions import text
from code_impact.functions.arrays import sums_before
from code_impact.functions.ordered import element_at_share, ranked, slice_of, with_previous
from code_impact.functions.paths import glob_to_regex
from code_impact.operators.manifests import in_range


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-5, 5), max_size=40), min_size=1, max_size=20))
def test_sums_before(spark, arrays):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    found = {r["i"]: r["s"] for r in df.select("i", sums_before(F.col("a")).alias("s")).collect()}
    assert found == {i: [sum(a[:k]) for k in range(len(a))] for i, a in enumerate(arrays)}


def skewed(spark):
    """One key holds most rows, one holds a single row; values repeat."""
    rng = random.Random(7)
    rows = [("hot" if i % 10 else f"k{i % 7}", i, rng.randrange(40)) for i in range(2000)] + [("one", 5000, 1)]
    return rows, spark.createDataFrame(rows, "k string, at long, v long").repartition(8)


def test_ranked_and_previous(spark):
    rows, df = skewed(spark)
    expected_rank, expected_previous = {}, {}
    for key in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for n, row in enumerate(members):
            expected_rank[key, row[1]] = n + 1
            expected_previous[key, row[1]] = members[n - 1][2] if n else None
    found = ranked(df, ["k"], F.col("at"), [F.col("at")], "rank").collect()
    assert {(r["k"], r["at"]): r["rank"] for r in found} == expected_rank
    found = with_previous(df, ["k"], F.col("at"), [F.col("at")], "v", "before").collect()
    assert {(r["k"], r["at"]): r["before"] for r in found} == expected_previous


def test_element_at_share(spark):
    rows, df = skewed(spark)
    for share in (0.0, 0.5, 0.95):
        found = {r["k"]: r["x"] for r in element_at_share(df, ["k"], "v", share, "x").collect()}
        for key in {r[0] for r in rows}:
            values = sorted(r[2] for r in rows if r[0] == key)
            assert found[key] == values[int(len(values) * share)]


def hash_in_python(value: str) -> str:
    total = 0
    data = value.encode("utf-16-be")
    for i in range(0, len(data), 2):
        total = (total * 31 + int.from_bytes(data[i : i + 2], "big") + 2**31) % 2**32 - 2**31
    total, digits = abs(total), ""
    while total:
        total, d = divmod(total, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits or "0"


def test_text(spark):
    values = ["  a   b\n", "", "x" * 500, "emoji \U0001f600 <b>", "ñandú"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    t = F.col("t")
    rows = df.select("t", text.clean_text(t).alias("c"), text.truncate(t, 10).alias("s"), text.hash_key(t).alias("h")).collect()
    by = {r["t"]: r for r in rows}
    assert by[values[0]]["c"] == "a b"
    assert by["x" * 500]["s"] == "xxxxxxx..."
    assert all(r["h"] == hash_in_python(r["t"]) for r in rows)


def test_globs(spark):
    cases = {
        ("**/auth/**", "src/auth/a.ts"): True,
        ("**/auth/**", "auth/a.ts"): True,
        ("*.test.ts", "src/x.test.ts"): True,
        ("migrations/*", "migrations/1.sql"): True,
        ("migrations/*", "migrations/a/1.sql"): False,
    }
    df = spark.createDataFrame([(g, p) for g, p in cases], "g string, p string")
    for (glob, path), expected in cases.items():
        assert df.where((F.col("g") == glob) & (F.col("p") == path)).select(F.col("p").rlike(glob_to_regex(glob))).first()[0] == expected


def test_version_ranges(spark):
    cases = {("^4.9.0", "< 4.10.0"): True, ("4.10.0", "< 4.10.0"): False, ("2.0", ">= 2"): True, ("1.0.0", None): True, ("3.1", "= 3.1"): True}
    df = spark.createDataFrame(list(cases), "v string, a string")
    found = {(r["v"], r["a"]): r["x"] for r in df.select("v", "a", in_range(F.col("v"), F.col("a")).alias("x")).collect()}
    assert found == cases


def test_ordered_with_one_hot_value(spark):
    """A single axis value is cut along the tie key, and ranks stay exact."""
    df = spark.range(5000).select(F.lit("k").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("at"), (F.col("id") * 7919 % 5003).alias("t"))
    place = slice_of(df, F.col("at"), F.col("t"))
    largest = df.groupBy(place.alias("s")).count().agg(F.max("count")).first()[0]
    assert largest < 200
    found = ranked(df, ["k"], F.col("at"), [F.col("at"), F.col("t")], "rank", F.col("t")).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 5001))
    assert [(r["at"], r["t"]) for r in found] == sorted((r["at"], r["t"]) for r in found)
    before = with_previous(df, ["k"], F.col("at"), [F.col("at"), F.col("t")], "t", "before", F.col("t")).collect()
    order = sorted((r["at"], r["t"]) for r in before)
    last = dict(zip(order, [None, *[t for _, t in order]]))
    assert all(r["before"] == last[r["at"], r["t"]] for r in before)

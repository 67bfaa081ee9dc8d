"""Importance resampling, fill-in-the-middle and mixing against brute force, on tables with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from code_impact.llm import common, fim, importance, mixing

CLASH = {"id": "1", "h1": "2", "n": "3", "score": "4", "rank": "5", "place": "6", "size": "7", "target": "8", "__tie": "9", "__at": "0", "features": "1", "weight": "2", "form": "3", "output": "4"}
ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"Wort{k}-Ünd" for k in range(60_000))
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one two three"), (None, None), (5, LONG), (6, LONG), (7, "A b\nc  d\n\nA b"), (8, "É é <S>  x y  z"), (9, "\n"), (-3, "x" * 70_000 + " É")]


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


def lower(text):
    return text.encode().translate(common.ASCII_LOWER).decode()


def some_texts(seed, n, letters="aBc9é-_\n "):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def documents(spark, rows, sources=None):
    if sources is not None:
        rows = [(*r, s) for r, s in zip(rows, itertools.cycle(sources))]
    kind = "doc_id long, text string" + (", source string" if sources is not None else "")
    return spark.createDataFrame(rows, kind).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3)


# Importance resampling


def test_running_crcs_in_any_stretches():
    data = np.frombuffer(random.Random(2).randbytes(300_007), np.uint8)
    places = np.sort(np.random.default_rng(1).integers(0, len(data) + 1, 400))
    whole = importance.running_crcs(data, places)
    assert (whole == importance.running_crcs(data, places, most=10_007)).all()
    # The register, begun at 0: zlib begins at ones, which is the same as their shift by the bytes read.
    ones = importance.shifts()(np.full(len(places), 0xFFFFFFFF, np.uint32), places)
    assert [zlib.crc32(data[:p].tobytes()) for p in places[:50]] == (whole ^ ones ^ np.uint32(0xFFFFFFFF))[:50].tolist()


@pytest.mark.parametrize("most", [1, 3])
def test_crcs_of_all_runs(most):
    texts = [t or "" for _, t in EDGE] + some_texts(1, 200)
    n_words, crcs, owners = importance.ngram_crcs([t.encode() for t in texts], 1, most)
    words = [ASCII_WORD.findall(lower(t)) for t in texts]
    expected = [(zlib.crc32(" ".join(w[j : j + k]).encode()), i) for k in range(1, most + 1) for i, w in enumerate(words) for j in range(len(w) - k + 1)]
    assert list(zip(crcs.tolist(), owners.tolist(), strict=True)) == expected
    assert n_words.tolist() == [len(w) for w in words]


def resampled(rows, target, least, most, buckets, percent, min_words, seed):
    """(doc_id, n_features, weight, score, rank) by brute force; ids must differ."""
    grams = lambda text: [" ".join(w[j : j + k]) for w in [ASCII_WORD.findall(lower(text or ""))] for k in range(least, most + 1) for j in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = collections.Counter(bucket(g) for _, text in rows for g in grams(text))
    t = collections.Counter(bucket(g) for text in target for g in grams(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    found = []
    for i, text in rows:
        g = [gain(bucket(x)) for x in grams(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        able = len(ASCII_WORD.findall(lower(text or ""))) >= min_words
        found.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), able])
    first = sorted((r for r in found if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): k for k, r in enumerate(first[: len(first) * percent // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in found), key=repr)


@pytest.mark.parametrize(("least", "most", "buckets", "percent", "min_words"), [(1, 1, 10_000, 10, 20), (1, 3, 97, 50, 0), (2, 2, 100_000, 100, 5)])
def test_resampling_as_by_brute_force(spark, least, most, buckets, percent, min_words):
    rows = [r for k, r in enumerate(EDGE) if r not in EDGE[:k] and r != (None, None)] + [(100 + k, t) for k, t in enumerate(some_texts(5, 300))]
    target = [None, "", *some_texts(9, 30), LONG[:5000]]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    made = importance.resample(documents(spark, rows), aim, least=least, most=most, buckets=buckets, percent=percent, min_words=min_words)
    found = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in made.collect()), key=repr)
    assert found == resampled(rows, [t or "" for t in target], least, most, buckets, percent, min_words, 2024)


def test_resampling_of_repeats_and_nothing(spark):
    target = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = [(7, "same words " * 20)] * 40 + [(None, "other words " * 20)] * 40 + EDGE
    made = importance.resample(documents(spark, rows), target, percent=75).collect()
    assert len(made) == len(rows)
    ranks = sorted(r["rank"] for r in made if r["rank"])
    assert ranks == list(range(1, sum(r.n_words >= 20 for r in made) * 75 // 100 + 1))
    assert importance.resample(documents(spark, EDGE).limit(0), target).count() == 0
    none = importance.resample(documents(spark, [(1, None), (2, "a b")]), target.limit(0)).collect()
    assert [r["rank"] for r in none] == [None, None]


def test_places_in_any_number_of_ranges(spark):
    df = common.cut_lineage(spark.range(500).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b")))
    rows = common.numbered(df, [F.col("a").desc(), F.col("b").asc_nulls_last()], "k", rows_each=20).collect()
    assert sorted(r.k for r in rows) == list(range(500))
    order = [(-r.a, r.b is None, r.b or 0) for r in sorted(rows, key=lambda r: r.k)]
    assert order == sorted(order)
    assert common.numbered(df.limit(0), [F.col("a")], "k").count() == 0


# Fill in the middle


def rearranged(i, text, rate, spm, seed):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (i, len(units), "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (i, len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 100)])
def test_fill_in_middle_as_by_brute_force(spark, rate, spm):
    odd = ["a\r\nb\n\n", "\n\n\n", "end\n", "<P", "<P>", "S><S\n>", "<\nS>\n<M\n>", "é x\ny\x85z\n", "<<S\nM>>\n"]
    lines = ["\n".join(random.Random(k).choices(["", "x", "é é", "<", "P>", "long line " * 9, "\t"], k=random.Random(k).randint(0, 40))) for k in range(300)]
    rows = EDGE + [(1000 + k, t) for k, t in enumerate(odd + lines)] + [(5000, "line\n" * 200_000)]
    made = fim.fill_in_middle(documents(spark, rows), rate=rate, spm=spm)
    found = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(repr(tuple(r)[:6]) for r in found) == sorted(repr(rearranged(i, t, rate, spm, 7)) for i, t in rows)
    texts = collections.Counter((i, t or "") for i, t in rows)
    assert collections.Counter((r.doc_id, r.back) for r in found) == texts
    assert fim.fill_in_middle(documents(spark, EDGE).limit(0)).count() == 0


# Mixing


def shared_out(sizes, weights, percent, most):
    """Targets of the sources in order, by sharing the excess again and again."""
    total, full = sum(sizes) * percent / 100, set()
    while True:
        free = [k for k in range(len(sizes)) if k not in full]
        left = total - sum(most * sizes[k] for k in full)
        share = {k: weights[k % len(weights)] * left / sum(weights[j % len(weights)] for j in free) for k in free}
        over = {k for k in free if share[k] >= most * sizes[k]}
        if not over or over == set(free):
            return [most * sizes[k] if k in full | over else share[k] for k in range(len(sizes))]
        full |= over


def tilt_of(sizes, target, most):
    rate = lambda x, s: min(most, math.exp(min(x * s, 50)))
    low, high = -100.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(rate(mid, s) * s for s in sizes) > target else (mid, high)
    return lambda s: rate(low, s)


def mixed_rows(seed=4):
    rng = random.Random(seed)
    rows = [(k, "wort " * min(int(rng.paretovariate(0.9) * 4), 5000), rng.choice(["hot"] * 6 + ["a", "é", "z", "", None, "tiny"])) for k in range(3000)]
    rows = [(i, t if s != "tiny" else "w", s) for i, t, s in rows]
    return [*rows, (None, "a b", "a"), (None, None, None), (3001, None, "z"), (3002, "", "void"), (3003, "  x y\tz", "a"), *[(1, "the same text", "hot")] * 500]


def test_mix_as_by_brute_force(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    found = mixing.mix(docs.repartition(5)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(repr((r.doc_id, r.source, r.size)) for r in found) == sorted(repr((i, s, count(t))) for i, t, s in rows)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: [count(t) for _, t, x in rows if x == s] for s in names}
    targets = dict(zip(names, shared_out([sum(sizes[s]) for s in names], (1, 2, 3), 100, 3), strict=True))
    assert any(targets[s] == 3 * sum(sizes[s]) > 0 for s in names) and any(0 < targets[s] < 3 * sum(sizes[s]) for s in names)
    for s in names:
        own = [r for r in found if r.source == s]
        assert {r.source_size for r in own} == {sum(sizes[s])}
        assert all(math.isclose(r.target, targets[s], rel_tol=1e-12) for r in own)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 and math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in own)
        # Whole copies miss by less than the largest document whose rate is no whole number.
        assert abs(sum(r.taken for r in own) - targets[s]) <= max([r.size for r in own if r.rate % 1], default=0) + 1e-6 * targets[s]
        if 0 < targets[s] < 3 * sum(sizes[s]):
            rate = tilt_of(sizes[s], targets[s], 3)
            assert all(math.isclose(r.rate, rate(r.size), rel_tol=1e-5, abs_tol=1e-8) for r in own)
        # The copies of each size, by the walk from the largest size down.
        by_size = sorted({(r.size, round(r.rate * mixing.UNIT)) for r in own}, reverse=True)
        n = collections.Counter(r.size for r in own)
        made = collections.Counter()
        for r in own:
            made[r.size] += r.copies
        walks = []
        for k in range(16):
            passed, walk = mixing.UNIT * (2 * k + 1) // 32, {}
            for size, rate in by_size:
                walk[size] = (passed + n[size] * rate) // mixing.UNIT - passed // mixing.UNIT
                passed += n[size] * rate
            walks.append((abs(sum(size * c for size, c in walk.items()) - targets[s]), k, walk))
        assert made == collections.Counter(min(walks, key=lambda w: w[:2])[2])


def test_mix_does_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame(mixed_rows(8), "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        first = collections.Counter(mixing.mix(docs.repartition(2)).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert collections.Counter(mixing.mix(docs.repartition(9)).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mix_of_nothing(spark):
    docs = documents(spark, EDGE, ["a", None])
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(empty) == len(EDGE) and {(r.source_size, r.target, r.taken) for r in empty} == {(0, 0.0, 0)}
    one = mixing.mix(docs.withColumn("source", F.lit(None).cast("string"))).collect()
    assert {r.copies for r in one} == {1}

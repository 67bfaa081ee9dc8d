"""Secrets in texts: fixed patterns, and Markov models of random strings and ordinary identifiers; DataFrame operations only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.functions.arrays import let, sums_before, with_once
from code_impact.session import cut_lineage

# Kinds in the order in which spans with one start are listed, their patterns, and the group whose length must suffice.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "markov": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}",
}
BASE = ("assign", "access", "hex")
# Characters of a candidate. Numbers of characters begin at 1; 0 is the start of a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


def _located(text: Column, pattern: str) -> Column:
    """[(start, end, value)] of all matches of a pattern, in code points; no match, no work beyond the search."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(found["gaps"], found["values"], lambda g, v: g + F.coalesce(F.length(v), F.lit(0)))
        starts = F.zip_with(sums_before(steps), found["gaps"], lambda s, g: s + g)
        both = F.zip_with(found["values"], starts, lambda v, s: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))
        return F.filter(both, lambda m: m["value"].isNotNull())

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(F.struct(gaps.alias("gaps"), values.alias("values")), placed)).otherwise(none)


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, markov): arrays of (start, end, value). ``markov`` are the candidates outside the other spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = with_once(rows, "m", F.struct(*[_located(F.col("text"), p).alias(k) for k, p in KINDS.items()]))
    assign = F.filter("m.assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 6)
    rows = rows.select("doc_id", assign.alias("assign"), "m.access", "m.hex", F.col("m.markov").alias("candidates"))
    free = F.filter("candidates", lambda c: ~F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", "assign", "access", "hex", F.when(F.size("candidates") > 0, free).otherwise(F.col("candidates")).alias("markov"))


def rule_samples(found: DataFrame) -> DataFrame:
    """(value, secret): what the patterns hold is secret, candidates outside them are ordinary. All documents give samples."""
    values = F.concat(
        F.transform("assign", lambda m: F.struct(F.regexp_extract(m["value"], ASSIGN, 1).alias("value"), F.lit(1).alias("secret"))),
        F.transform(F.concat("access", "hex"), lambda m: F.struct(m["value"].alias("value"), F.lit(1).alias("secret"))),
        F.transform("markov", lambda m: F.struct(m["value"].alias("value"), F.lit(0).alias("secret"))),
    )
    return found.select(F.explode(values).alias("s")).select("s.value", "s.secret")


def train_ratio(samples: DataFrame, smoothing: float = 0.5, backoff: float = 8.0, uniform: float = 0.5) -> list[float]:
    """Log ratio of each transition's probability in secret and in ordinary strings, from labelled samples (value, secret).

    Characters outside the alphabet and null values are left out. Transitions are counted over all distinct samples, so that a
    string weighs once however often it is copied; only the counts of the alphabet's pairs go to the driver. Without samples of a class all its transitions are as likely. The model of secrets
    is mixed with ``uniform`` parts of a uniform one, so that random strings need not use the letters of those in the samples.
    """
    once = samples.where("value IS NOT NULL AND secret IN (0, 1)").select("value", "secret").distinct()
    # Only numbers leave a string's row.
    steps = once.select("secret", F.explode(transitions(F.col("value"))).alias("step")).where("step IS NOT NULL")
    size = len(ALPHABET) + 1
    counts = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    for row in steps.groupBy("secret", "step").count().collect():
        counts[row["secret"]][row["step"] // size][row["step"] % size] += row["count"]

    def model(found: list[list[float]]) -> list[list[float]]:
        """Transition probabilities that fall back on how often a character occurs at all where a row has few counts."""
        single = [sum(row[b] for row in found) for b in range(size)]
        single = [(n + smoothing) / (sum(single) + smoothing * size) for n in single]
        return [[(row[b] + backoff * single[b]) / (sum(row) + backoff) for b in range(size)] for row in found]

    ordinary, held = model(counts[0]), model(counts[1])
    flat = uniform / size
    ratio = [log(flat + (1 - uniform) * held[a][b]) - log(ordinary[a][b]) for a in range(size) for b in range(size)]
    return ratio


def transitions(value: Column) -> Column:
    """One number for each character and the one before it, null where either is outside the alphabet.

    The string is split once and each character looked up once, so the work grows with its length.
    """
    size = len(ALPHABET) + 1
    numbers = F.transform(F.split(value, ""), lambda c: F.nullif(F.position(c, F.lit(ALPHABET)), F.lit(0)))
    return let(numbers, lambda own: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(own, 1, F.size(own) - 1)), own, lambda before, c: before * size + c))


def log_ratio(value: Column, ratio: list[float]) -> Column:
    """Log-likelihood ratio of a string: secret against ordinary. Transitions outside the alphabet tell nothing."""
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratio)), ",").cast("array<double>")
    return F.aggregate(transitions(value), F.lit(0.0), lambda acc, step: acc + F.coalesce(F.get(table, step), F.lit(0.0)))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least_total: float = 12.0, least_mean: float = 0.5, least_distinct: int = 6) -> DataFrame:
    """(doc_id, spans: sorted array of (start, kind_no, end)), one row per input row; offsets are code points, ends exclusive.

    Kinds 0 to 2 are the fixed patterns. Kind 3 are runs of 16 or more characters of keys outside them whose log-likelihood
    ratio is at least ``least_total``, and ``least_mean`` per character; a random key has ``least_distinct`` different ones. ``samples`` (value, secret) train the models; without them
    the patterns label the corpus itself, in two rounds: strings outside the patterns that the first models find more like secrets
    than like the others are no ordinary samples of the second. A null text is empty, an empty one has no spans, repeated rows are scanned each.
    """
    # Stored, so that the texts are searched once for training and for scoring.
    found = cut_lineage(located(docs, id_col, text_col))

    def likely(value: Column, ratio: list[float]) -> Column:
        varied = F.size(F.array_distinct(F.split(value, ""))) >= least_distinct
        return varied & let(log_ratio(value, ratio), lambda r: (r >= least_total) & (r >= least_mean * F.length(value)))

    if samples is None:
        marked = cut_lineage(rule_samples(found).distinct())
        first = train_ratio(marked)
        ratio = train_ratio(marked.where((F.col("secret") == 1) | (log_ratio(F.col("value"), first) <= 0)))
    else:
        ratio = train_ratio(samples)

    def numbered(spans: Column | str, no: int) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end")))

    arrays = [numbered(k, no) for no, k in enumerate(BASE)]
    added = numbered(F.filter("markov", lambda c: likely(c["value"], ratio)), len(BASE))
    return found.select("doc_id", F.sort_array(F.concat(*arrays, added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from code_impact.llm import decontaminate, fim, importance, line_dedup, mixing, ngram_join, packing, quality, secrets, toxicity, url_filter, vector_neardup, warc
from code_impact.llm.common import table
from code_impact.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.cut_tokens(docs)
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces)


@query("op1_packing")
def op1_packing(spark, folder):
    return packed(table(spark, folder, "documents"))


@query("op2_quality")
def op2_quality(spark, folder):
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_toxicity")
def op4_toxicity(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


LINES = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, u.pos, ls[u.pos] AS line,
    translate(trim(ls[u.pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS pos) u),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.first AS gone FROM l LEFT JOIN r USING (key))
"""


@query(
    "op5_line_dedup",
    LINES + """SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
)
def op5_line_dedup(spark, folder):
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


PARTED = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@query(
    "op10_decontamination",
    f"""WITH b AS (SELECT item_id, {PARTED.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
    i AS (SELECT DISTINCT item_id, u.n AS size, array_to_string(ws[u.k:u.k + u.n - 1], ' ') AS win FROM b, LATERAL (
        SELECT least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k) u WHERE len(ws) > 0),
    d AS (SELECT doc_id, {PARTED.format("coalesce(text, '')")} AS ws FROM documents),
    s AS (SELECT doc_id, z.size, u.k, array_to_string(ws[u.k:u.k + z.size - 1], ' ') AS win FROM d, (SELECT DISTINCT size FROM i) z,
        LATERAL (SELECT unnest(range(1, greatest(len(ws) - z.size, -1) + 2)) AS k) u),
    h AS (SELECT DISTINCT s.doc_id, s.k, s.size, i.item_id FROM s JOIN i ON s.win = i.win AND s.size = i.size),
    p AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
    coalesce(p.n, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op10_decontamination(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(
    "op9_ngram_jaccard",
    r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[u.k:u.k + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k) u WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
    r(doc_id, root) AS (SELECT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.root),
    m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
)
def op9_ngram_jaccard(spark, folder):
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@query(
    "op7_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM q""",
)
def op7_warc(spark, folder):
    # The pages have no capture time: their ids, whatever their size, are spread over the seconds of the year 2024.
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id"), F.lit(366 * 86_400)))
    archives = scratch_path(spark, "warc")
    runs = warc.write_archives(table(spark, folder, "pages"), archives, time=time)
    return warc.read_archives(warc.merge_index(runs), archives)


@query(
    "op8_embedding_neardup",
    """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
    r(vec_id, root) AS (SELECT a, a FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.root),
    m AS (SELECT vec_id, min(root) AS root FROM r GROUP BY 1), c AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
    SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(m.root, e.vec_id) AS component_id, coalesce(m.root, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN m USING (vec_id)""",
)
def op8_embedding_neardup(spark, folder):
    return vector_neardup.near_vectors(table(spark, folder, "embeddings"))


@query("op6_secrets")
def op6_secrets(spark, folder):
    found = secrets.find_secrets(table(spark, folder, "documents"))
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        count(3).alias("n_markov"),
    )


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op3_url_filter")
def op3_url_filter(spark, folder):
    pages = table(spark, folder, "pages")
    # A page shows the document whose number ends its path, so it is as good or bad as that document's labels.
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"(?<![0-9])0*([0-9]{1,19})(?:\.[a-z]+)?/?$", 1)
    shown = pages.select("page_id", number.try_cast("long").alias("doc_id"))
    marks = table(spark, folder, "labels").select("doc_id", F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return url_filter.filter_urls(pages, shown.join(marks, "doc_id").select("page_id", "bad"), URL_RULES)


@query(
    "op11_importance",
    f"""WITH RECURSIVE t(n, crc, k) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256) UNION ALL
        SELECT n, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END, k + 1 FROM t WHERE k < 8),
    c AS (SELECT list(crc ORDER BY n) AS step FROM t WHERE k = 8),
    d AS (SELECT doc_id, {PARTED.format("coalesce(text, '')")} AS ws FROM documents),
    b AS (SELECT {PARTED.format("coalesce(text, '')")} AS ws FROM benchmark),
    dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w),
    bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
    v AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(w), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT)),
        lambda crc, x: xor(crc >> 8, step[(xor(crc, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw) CROSS JOIN c),
    s AS (SELECT bucket, sum(n) AS n FROM dw JOIN v USING (w) GROUP BY bucket),
    g AS (SELECT bucket, sum(n) AS n FROM bw JOIN v USING (w) GROUP BY bucket),
    a AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s, coalesce((SELECT sum(n) FROM g), 0) AS t),
    gain AS (SELECT r.range AS bucket, floor(1000 * ln((coalesce(g.n, 0) + 1) * (a.s + 10000) / ((coalesce(s.n, 0) + 1) * (a.t + 10000))))::BIGINT AS x
        FROM range(10000) r CROSS JOIN a LEFT JOIN s ON s.bucket = r.range LEFT JOIN g ON g.bucket = r.range),
    m AS (SELECT doc_id, floor(sum(n * x) / sum(n))::BIGINT AS weight FROM dw JOIN v USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
    o AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
    p AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM o)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM p WHERE able) * 10 // 100 THEN place END AS rank FROM p""",
)
def op11_importance(spark, folder):
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_fim",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
    n AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
        ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS o FROM d),
    p AS (SELECT doc_id, t, n, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 100 THEN 'plain' WHEN o < 50 THEN 'spm' ELSE 'psm' END AS form FROM n)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM p""",
)
def op12_fim(spark, folder):
    made = fim.fill_in_middle(table(spark, folder, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    shas = [sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *shas)


@query("op13_mixing")
def op13_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")

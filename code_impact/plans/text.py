"""Queries over text columns and rows."""

from pyspark.sql import functions as F

from code_impact.functions import text as fn
from code_impact.operators import text as ops
from code_impact.plans.registry import query

SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
TRIMMED = f"regexp_replace(regexp_replace(text, '^{SPACE}', ''), '{SPACE}$', '')"


@query(
    "validate_fields",
    """SELECT o_orderkey AS id, u.f[1] AS path, u.f[2] AS message FROM orders, LATERAL (SELECT unnest(CASE o_orderkey % 7
    WHEN 1 THEN [['job_id', 'Invalid UUID format']] WHEN 2 THEN [['repository', 'Invalid GitHub repository format']]
    WHEN 3 THEN [['sha', 'Invalid SHA format']] WHEN 4 THEN [['pr_number', 'PR number must be positive']]
    WHEN 5 THEN [['request_id', 'Invalid request ID']] WHEN 6 THEN [['sha', 'Invalid SHA format'], ['request_id', 'Invalid request ID']] ELSE [] END) AS f) u""",
)
def validate_fields(t):
    return ops.validate_fields(t["field_records"])


@query(
    "clean_text",
    f"SELECT doc_id, regexp_replace({TRIMMED}, '{SPACE}', ' ', 'g') AS clean, regexp_replace(regexp_replace({TRIMMED}, '{SPACE}', ' ', 'g'), '[<>]', '', 'g') AS safe FROM documents",
)
def clean_text(t):
    text = F.col("text")
    return t.spread("documents").select("doc_id", fn.clean_text(text).alias("clean"), fn.clean_markup(text).alias("safe"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS text FROM documents")
def truncate_text(t):
    return t["documents"].select("doc_id", fn.truncate(F.col("text"), 80).alias("text"))


@query(
    "safe_filenames",
    "SELECT url, lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._/-]', '_', 'g'), '_{2,}', '_', 'g')) AS name FROM pages",
)
def safe_filenames(t):
    return t["pages"].select("url", fn.safe_filename(F.col("url")).alias("name"))


RECORD = (
    "user string, apiToken string, nested struct<Password:string,list:array<struct<client_secret:string,ok:bigint>>>, "
    "headers map<string,string>"
)


@query(
    "redact_secrets",
    """SELECT event_id, '{"user":"u' || user_id || '","apiToken":"[REDACTED]","nested":{"Password":"[REDACTED]","list":[{"client_secret":"[REDACTED]","ok":' || event_id
    || '}]},"headers":{"Authorization":"[REDACTED]","X-Id":"1"}}' AS record FROM events""",
)
def redact_secrets(t):
    parsed = t["log_records"].withColumn("_r", F.from_json("record", RECORD))
    clean = fn.redact(F.col("_r"), parsed.schema["_r"].dataType)
    return parsed.select("event_id", F.to_json(clean).alias("record"))


@query(
    "mask_url_credentials",
    "SELECT page_id, 'https://***:***@' || regexp_replace(url, '^[a-z]+://', '') AS url FROM pages",
)
def mask_url_credentials(t):
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    with_secret = F.concat(F.lit("https://user"), F.col("page_id").cast("string"), F.lit(":pw@"), rest)
    return t["pages"].select("page_id", fn.mask_url_credentials(with_secret).alias("url"))


@query(
    "hash_keys",
    """SELECT page_id, lower(to_base(abs(list_reduce(list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT),
    lambda h, c: ((((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296) - 2147483648, 0::BIGINT)), 36)) AS key FROM pages""",
)
def hash_keys(t):
    return t["pages"].select("page_id", fn.hash_key(F.col("url")).alias("key"))


@query("job_expiry", "SELECT o_orderkey AS job_id, epoch(o_orderdate)::BIGINT + 90 * 86400 AS ttl FROM orders")
def job_expiry(t):
    return t["orders"].select(F.col("o_orderkey").alias("job_id"), ops.expires_at(F.col("o_orderdate")).alias("ttl"))


@query(
    "compact_json",
    """SELECT id, '{' || concat_ws(',', '"id":' || id, '"repository":"' || repository || '"', CASE WHEN sha IS NOT NULL THEN '"sha":"' || sha || '"' END) || '}' AS record FROM field_records""",
)
def compact_json(t):
    return t["field_records"].select("id", ops.compact_json([F.col("id"), F.col("repository"), F.col("sha")]).alias("record"))


@query(
    "batch_rows",
    """SELECT repository, pos, ((row_number() OVER (PARTITION BY repository ORDER BY pos) - 1) // 20)::BIGINT AS batch FROM file_listing""",
)
def batch_rows(t):
    return ops.batch_rows(t["file_listing"].select("repository", "pos"), ["repository"], "pos", 20)

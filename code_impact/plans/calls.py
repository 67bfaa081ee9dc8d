"""Queries over call sites. The SQL knows which class each name in a body stands for, and looks the methods up in the class tree."""

from pyspark.sql import functions as F

from code_impact.operators import calls as ops
from code_impact.operators import diff
from code_impact.plans.registry import query

SITES = """cls AS (SELECT DISTINCT p_partkey % 5 AS r, p_partkey // 5 AS k FROM part),
 anc(r, k, a, d) AS (SELECT r, k, k, 0 FROM cls UNION ALL SELECT anc.r, anc.k, anc.a // 3, d + 1 FROM anc JOIN cls ON cls.r = anc.r AND cls.k = anc.a WHERE anc.a > 0),
 has AS (SELECT r, k, 'run' || (k % 4) AS m FROM cls UNION ALL SELECT r, k, u.m FROM cls, LATERAL (SELECT unnest(['own', 'make']) AS m) u UNION ALL SELECT r, k, 'touch' FROM cls WHERE k < 3),
 home AS (SELECT anc.r, anc.k, has.m, arg_min(has.k, anc.d) AS owner FROM anc JOIN has ON has.r = anc.r AND has.k = anc.a GROUP BY 1, 2, 3),
 said AS (SELECT r, k, 'run' || (k % 4) AS caller, u.* FROM cls, LATERAL (SELECT unnest([6, 7, 7, 8, 9, 9, 9, 10]) AS line,
     unnest([(k * 7 + 3) % 40, (k * 3 + 2) % 40, (k * 3 + 2) % 40, k % 17, k, k, k % 11, (k * 5 + 1) % 40]) AS type,
     unnest(['run' || ((k + 1) % 4), 'run' || (k % 3), 'run2', 'touch', 'own', 'own', 'make', 'run3']) AS m) u
   UNION ALL SELECT cls.r, cls.k, 'run' || (cls.k % 4), 12, 1, 'touch' FROM cls JOIN anc ON anc.r = cls.r AND anc.k = cls.k AND anc.a = 0 JOIN cls z ON z.r = cls.r AND z.k = 0
   UNION ALL SELECT r, k, 'own', 15, k // 3, 'touch' FROM cls WHERE k > 0),
 sites AS (SELECT said.r, said.k, caller, line, said.m AS name, 'K' || home.owner AS declared_in FROM said JOIN home ON home.r = said.r AND home.k = said.type AND home.m = said.m
   UNION ALL SELECT c.r, c.k, 'run' || (c.k % 4), 8, 'K' || t.k, 'K' || t.k FROM cls c JOIN cls t ON t.r = c.r AND t.k = c.k % 17
   UNION ALL SELECT c.r, c.k, NULL, 4, 'K' || t.k, 'K' || t.k FROM cls c JOIN cls t ON t.r = c.r AND t.k = (c.k * 5 + 1) % 40),
 calls AS (SELECT 'org/calls' || r AS repository, 'src/K' || k || '.java' AS file, 'K' || k AS class, caller AS method, line, name, declared_in FROM sites)"""


def _sites(t):
    return t.stored("call-sites", lambda: ops.call_sites(t["call_files"], t.types("call_files")))


@query("call_sites", f"WITH RECURSIVE {SITES} SELECT * FROM calls")
def call_sites(t):
    return _sites(t)


@query(
    "edges_method_call",
    f"""WITH RECURSIVE {SITES} SELECT repository, class AS src, declared_in AS dst, 'method_call' AS type, any_value(file) AS file, min(line) AS line,
    string_agg(DISTINCT name, ',' ORDER BY name) AS usage, count(*) AS calls FROM calls GROUP BY 1, 2, 3""",
)
def edges_method_call(t):
    return ops.call_edges(_sites(t)).withColumn("usage", F.array_join("usage", ","))


@query(
    "breaking_call_sites",
    f"""WITH RECURSIVE {SITES},
    b AS (SELECT 'org/calls' || r AS repository, 'class_removed' AS type, 'K' || k AS class, NULL::VARCHAR AS method FROM cls WHERE k % 5 = 3
      UNION ALL SELECT 'org/calls' || r, 'method_removed', 'K' || k, 'run' || (k % 4) FROM cls WHERE k % 5 <> 3 AND k % 7 = 2),
    o AS (SELECT * FROM calls WHERE class <> declared_in)
    SELECT b.repository, b.type, b.class, b.method, count(o.class) AS call_sites, count(DISTINCT o.class) AS calling_classes, count(DISTINCT o.file) AS calling_files
    FROM b LEFT JOIN o ON o.repository = b.repository AND o.declared_in = b.class AND (b.method IS NULL OR o.name = b.method) GROUP BY 1, 2, 3, 4""",
)
def breaking_call_sites(t):
    breaking = diff.breaking_changes(t.types("call_files"), t.types("call_files_v2")).select("repository", "type", "class", "method")
    return ops.breaking_call_sites(breaking, _sites(t))

"""Queries over two versions of the same repositories."""

from pyspark.sql import functions as F

from code_impact.operators import diff as ops
from code_impact.operators import java
from code_impact.plans.java import PATH, REPO
from code_impact.plans.registry import query

REMOVED = f"""SELECT {REPO} AS repository, 'class_removed' AS type, 'critical' AS severity, 'Clase ''C' || p_partkey || ''' eliminada' AS description,
 'C' || p_partkey AS class, NULL::VARCHAR AS method, {PATH} AS file, 0 AS line FROM part WHERE p_partkey % 11 = 0"""
GONE = f"""SELECT {REPO} AS repository, 'method_removed' AS type, 'major' AS severity,
 'Método público ''m' || p_size || ''' eliminado de C' || p_partkey AS description, 'C' || p_partkey AS class, 'm' || p_size AS method, {PATH} AS file, 8 AS line
 FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 6 = 1"""
CHANGED = f"""SELECT {REPO} AS repository, 'signature_changed' AS type, 'major' AS severity,
 'Firma del método ''m' || p_size || ''' cambiada en C' || p_partkey AS description, 'C' || p_partkey AS class, 'm' || p_size AS method, {PATH} AS file, 4 AS line
 FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 6 <> 1 AND p_partkey % 7 = 2"""


def _sides(t):
    return t.types("code_files"), t.types("code_files_v2")


@query("diff_classes_removed", REMOVED)
def diff_classes_removed(t):
    return ops.classes_removed(*_sides(t))


@query("diff_methods_removed", GONE)
def diff_methods_removed(t):
    return ops.methods_removed(*_sides(t))


@query("diff_signature_changed", CHANGED)
def diff_signature_changed(t):
    return ops.signatures_changed(*_sides(t))


@query("diff_breaking_changes", f"{REMOVED} UNION ALL {GONE} UNION ALL {CHANGED}")
def diff_breaking_changes(t):
    return ops.breaking_changes(*_sides(t))


@query(
    "diff_new_methods",
    f"""SELECT {REPO} AS repository, 'C' || p_partkey AS class, 'n' || p_size AS method, 'void n' || p_size || '(Long id)' AS signature
    FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 6 = 1
    UNION ALL SELECT {REPO}, 'C' || p_partkey, 'm' || p_size, 'void m' || p_size || '(String id)'
    FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 6 <> 1 AND p_partkey % 7 = 2""",
)
def diff_new_methods(t):
    return ops.new_methods(*_sides(t)).select("repository", "class", "method", "signature")


@query(
    "diff_interface_changed",
    f"""SELECT {REPO} AS repository, 'A' || p_partkey AS class, 'send' AS method, 'void' AS old_return, 'CompletableFuture<Void>' AS new_return,
    'B' || p_partkey AS implementer FROM part WHERE p_partkey % 3 = 0""",
)
def diff_interface_changed(t):
    old = t.types("contracts_old")
    return ops.interface_changes(old, t.types("contracts_new"), java.edges(old)).select(
        "repository", "class", "method", "old_return", "new_return", "implementer"
    )

"""Input views over the given tables, shaped like the service's inputs. Each text runs in Spark SQL and in DuckDB."""

FIXTURES: dict[str, str] = {}

FIXTURES["code_files"] = r"""
SELECT 'org/repo' || CAST(p_partkey % 5 AS STRING) AS repository,
 'src/main/java/com/example/p' || CAST(p_size % 7 AS STRING) || '/C' || CAST(p_partkey AS STRING) || '.java' AS path,
 'package com.example.p' || CAST(p_size % 7 AS STRING) || ';' || chr(10) ||
 'import java.util.List;' || chr(10) ||
 'import com.example.base.C' || CAST(p_partkey % 50 AS STRING) || ';' || chr(10) ||
 'public class C' || CAST(p_partkey AS STRING) || ' extends C' || CAST(p_partkey % 50 AS STRING) || ' implements I' || CAST(p_size AS STRING) || ' {' || chr(10) ||
 '    private final C' || CAST((p_partkey * 7 + 3) % 97 AS STRING) || ' dep;' || chr(10) ||
 '    private List<String> names;' || chr(10) ||
 '    public C' || CAST(p_partkey AS STRING) || '(C' || CAST((p_partkey * 7 + 3) % 97 AS STRING) || ' dep) { this.dep = dep; }' || chr(10) ||
 '    public void m' || CAST(p_size AS STRING) || '(Long id) { }' || chr(10) ||
 '    // public void ghost() { }' || chr(10) ||
 '    private int hidden() { return 1; }' || chr(10) || '}' AS content
FROM part
"""

FIXTURES["code_files_v2"] = r"""
SELECT 'org/repo' || CAST(p_partkey % 5 AS STRING) AS repository,
 'src/main/java/com/example/p' || CAST(p_size % 7 AS STRING) || '/C' || CAST(p_partkey AS STRING) || '.java' AS path,
 'package com.example.p' || CAST(p_size % 7 AS STRING) || ';' || chr(10) ||
 'public class C' || CAST(p_partkey AS STRING) || ' {' || chr(10) ||
 '    public C' || CAST(p_partkey AS STRING) || '(C' || CAST((p_partkey * 7 + 3) % 97 AS STRING) || ' dep) { }' || chr(10) ||
 CASE WHEN p_partkey % 6 = 1 THEN '    public void n' || CAST(p_size AS STRING) || '(Long id) { }'
      WHEN p_partkey % 7 = 2 THEN '    public void m' || CAST(p_size AS STRING) || '(String id) { }'
      ELSE '    public void m' || CAST(p_size AS STRING) || '(Long id) { }' END || chr(10) || '}' AS content
FROM part WHERE p_partkey % 11 <> 0
"""

FIXTURES["file_changes"] = r"""
SELECT c.repository, c.pr_number,
 row_number() OVER (PARTITION BY c.pr_number ORDER BY c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, c.l_extendedprice, c.l_quantity, c.l_shipdate) AS file_no,
 CASE WHEN c.l_partkey % 10 = 0 THEN 'pom.xml' ELSE 'src/main/java/com/example/p' || CAST(p.p_size % 7 AS STRING) || '/C' || CAST(p.p_partkey AS STRING) || '.java' END AS filename,
 CASE c.l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS status,
 CAST(c.l_quantity AS BIGINT) AS additions, CAST(c.l_suppkey % 20 AS BIGINT) AS deletions,
 CASE WHEN c.l_partkey % 10 = 0 THEN '@@ -1,2 +1,2 @@' || chr(10) || '-<artifactId>old' || CAST(c.l_suppkey AS STRING) || '</artifactId>' || chr(10) || '+<artifactId>new' || CAST(c.l_suppkey AS STRING) || '</artifactId>'
      WHEN c.l_suppkey % 9 = 0 THEN NULL
      WHEN c.l_linenumber % 3 = 0 THEN '@@ -8,3 +8,3 @@' || chr(10) || ' class X {' || chr(10) || '-    public void m' || CAST(c.l_suppkey AS STRING) || '(Long id) {' || chr(10) || '+    public void m' || CAST(c.l_suppkey AS STRING) || '(String id) {'
      WHEN c.l_linenumber % 3 = 1 THEN '@@ -8,2 +8,1 @@' || chr(10) || '-    public void gone' || CAST(c.l_suppkey AS STRING) || '() {' || chr(10) || ' }'
      ELSE '--- public void trap() {' || chr(10) || '@@ -1,1 +1,2 @@' || chr(10) || ' // note' || chr(10) || '+    int x = 1;' || chr(10) || '@@ -20,2 +21,1 @@' || chr(10) || '-    int y = 2;' || chr(10) || ' }' END AS patch
FROM (SELECT b.*, 'org/repo' || CAST(b.pr_number % 5 AS STRING) AS repository, b.l_partkey - b.l_partkey % 5 + b.pr_number % 5 AS part_in_repo
      FROM (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN 1000000000 + CAST(floor(l_orderkey / 200) AS BIGINT) ELSE l_orderkey END AS pr_number FROM lineitem) b) c
JOIN part p ON p.p_partkey = c.part_in_repo
"""

FIXTURES["webhook_events"] = r"""
SELECT event_id, ts AS received_at,
 CASE WHEN event_id % 40 = 1 THEN 'GET' ELSE 'POST' END AS http_method,
 CASE WHEN event_id % 40 = 2 THEN NULL WHEN event_id % 40 = 3 THEN 'push' ELSE 'pull_request' END AS github_event,
 'd-' || CAST(event_id AS STRING) AS delivery_id,
 CASE WHEN event_id % 40 = 4 THEN '{"action": ' WHEN event_id % 40 = 6 THEN NULL
  ELSE '{"action":"' || CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'synchronize' WHEN 'signup' THEN 'ready_for_review' WHEN 'purchase' THEN 'closed' ELSE 'labeled' END ||
   '","number":' || CAST(event_id + 1 AS STRING) || ',"pull_request":{"number":' || CAST(event_id + 1 AS STRING) || '},"repository":{"full_name":"' ||
   CASE WHEN event_id % 40 = 5 THEN 'bad name' ELSE 'org/repo' || CAST(user_id % 5 AS STRING) END || '"}}' END AS body
FROM events
"""

FIXTURES["review_responses"] = r"""
SELECT o_orderkey AS job_id,
 CASE WHEN o_orderkey % 13 = 0 THEN 'sorry, no json' ELSE
  CASE WHEN o_orderkey % 2 = 0 THEN 'Here:' || chr(10) || '```json' || chr(10) ELSE '' END ||
  '{"summary":"s' || CAST(o_orderkey AS STRING) || '","issues":[{"type":"bug","severity":"' || CASE o_orderkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END ||
  '","file":"a.java","line":' || CAST(o_custkey + 1 AS STRING) || ',"description":"d"},{"type":"style","severity":"low","file":"b.java","description":"e"}],"suggestions":[{"type":"refactor","file":"a.java","line":3,"description":"f"}]}' ||
  CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '```' ELSE '' END END AS response
FROM orders
"""

FIXTURES["manifests"] = r"""
SELECT p_partkey AS project_id, 'package.json' AS path,
 '{"name":"app' || CAST(p_partkey AS STRING) || '","dependencies":{"express":"^4.' || CAST(p_size AS STRING) || '.0","lib' || CAST(p_partkey % 30 AS STRING) || '":"0.' || CAST(p_size AS STRING) || '.1"},"devDependencies":{"jest":"^29.0.0"}}' AS content,
 'const express = require("express");' || chr(10) || 'import { a } from "lib' || CAST(p_partkey % 31 AS STRING) || '/sub";' || chr(10) || 'import b from "./local";' AS source
FROM part
"""

FIXTURES["registry"] = r"""
SELECT 'lib' || CAST(n_nationkey AS STRING) AS name, n_name AS description,
 CASE n_regionkey % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'LGPL-3.0' WHEN 3 THEN 'GPL-3.0' ELSE NULL END AS license,
 n_nationkey % 6 = 0 AS is_deprecated
FROM nation
"""

FIXTURES["vulnerabilities"] = r"""
SELECT 'CVE-' || CAST(s_suppkey AS STRING) AS cve_id, 'lib' || CAST(s_suppkey % 30 AS STRING) AS package,
 CASE s_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
FROM supplier
"""

FIXTURES["file_listing"] = r"""
SELECT doc_id AS pos, 'org/' || source AS repository, n_chars AS size,
 CASE WHEN doc_id % 9 = 0 THEN 'node_modules/' WHEN doc_id % 10 = 0 THEN 'build/' ELSE 'src/' END || lang || '/f' || CAST(doc_id AS STRING) ||
 CASE doc_id % 16 WHEN 0 THEN '.java' WHEN 1 THEN '.ts' WHEN 2 THEN '.PY' WHEN 3 THEN '.go' WHEN 4 THEN '/Dockerfile' WHEN 5 THEN '/package.json' WHEN 6 THEN '/pom.xml' WHEN 7 THEN '.md'
  WHEN 8 THEN '.kt' WHEN 9 THEN '.java' WHEN 10 THEN '/yarn.lock' WHEN 11 THEN '.rs' WHEN 12 THEN '/Gemfile' WHEN 13 THEN '.bin' WHEN 14 THEN '.cpp' ELSE '.tsx' END AS path
FROM documents
"""

FIXTURES["job_events"] = r"""
SELECT event_id, user_id AS job_id, ts,
 CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status
FROM events
"""

FIXTURES["message_receives"] = r"""
SELECT l_orderkey AS message_id, l_shipdate AS received_at, CASE WHEN l_orderkey % 2 = 0 THEN 'index' ELSE 'process' END AS queue FROM lineitem
"""

FIXTURES["error_events"] = r"""
SELECT event_id, ts,
 CASE event_id % 8 WHEN 0 THEN 'ThrottlingException' WHEN 1 THEN 'ResourceNotFoundException' WHEN 2 THEN 'HttpError' WHEN 3 THEN 'SyntaxError' ELSE 'Error' END AS name,
 CASE event_id % 8 WHEN 2 THEN 'API rate limit exceeded' WHEN 3 THEN 'Unexpected token in JSON' WHEN 4 THEN 'Request timed out' WHEN 5 THEN 'connection reset' WHEN 6 THEN 'JavaScript heap out of memory' ELSE 'boom' END AS message,
 CASE WHEN event_id % 8 = 2 THEN 403 ELSE NULL END AS http_status
FROM events
"""

FIXTURES["index_snapshots"] = r"""
SELECT DISTINCT 'org/repo' || CAST(o_custkey % 20 AS STRING) AS repository, CAST(o_orderdate AS DATE) AS snapshot_date FROM orders
"""

FIXTURES["file_sizes"] = r"""
SELECT repository, path, pos, size * 20000 AS size FROM file_listing
"""

FIXTURES["review_paths"] = r"""
SELECT doc_id AS pos, 'org/' || source AS repository,
 CASE WHEN doc_id % 11 = 0 THEN 'migrations/' ELSE 'src/' || CASE doc_id % 5 WHEN 0 THEN 'auth/' WHEN 1 THEN 'controller/' WHEN 2 THEN 'user-service/' WHEN 3 THEN 'payment/' ELSE 'ui/' END END
 || 'f' || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 0 THEN '.test.ts' WHEN 1 THEN '.spec.ts' ELSE '.ts' END AS path
FROM documents
"""

FIXTURES["pr_records"] = r"""
SELECT 'org/repo' || CAST(o_custkey % 5 AS STRING) AS repository,
 '{"number":' || CAST(o_orderkey + 1 AS STRING) || ',"title":"t' || CAST(o_orderkey AS STRING) || '","body":null,"state":"open","html_url":"https://h/' || CAST(o_orderkey AS STRING) || '"'
 || CASE o_orderkey % 3 WHEN 0 THEN ',"user":{"id":' || CAST(o_custkey AS STRING) || ',"login":"u' || CAST(o_custkey AS STRING) || '","type":"Bot"}' WHEN 1 THEN ',"user":{"id":7,"login":""}' ELSE ',"user":null' END
 || ',"head":{"sha":"abc","ref":"feature","repo":' || CASE o_orderkey % 4 WHEN 0 THEN 'null' ELSE '{"id":5,"name":"n","full_name":"fork/n","private":true,"default_branch":"dev","owner":{"login":"own"}}' END || '}'
 || ',"base":{"sha":"def","ref":"main","repo":{"id":9,"full_name":""}},"changed_files":' || CAST(o_custkey % 9 AS STRING) || '}' AS record
FROM orders
"""

# Services: annotations, endpoints, generated accessors, nested classes, interfaces, traps in literals.
FIXTURES["service_files"] = r"""
SELECT 'org/repo' || CAST(p_partkey % 5 AS STRING) AS repository,
 'src/' || CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'main' END || '/S' || CAST(p_partkey AS STRING) || '.java' AS path,
 'package com.example.svc;' || chr(10) ||
 'import static org.lib.U' || CAST(p_partkey % 9 AS STRING) || '.*;' || chr(10) ||
 '@Service' || chr(10) ||
 CASE WHEN p_partkey % 2 = 0 THEN '@Data' ELSE '@Deprecated' END || chr(10) ||
 'public class S' || CAST(p_partkey AS STRING) || ' {' || chr(10) ||
 '    private Map<String, List<D' || CAST(p_partkey % 13 AS STRING) || '>> cache;' || chr(10) ||
 '    private D' || CAST(p_partkey % 13 AS STRING) || ' dep;' || chr(10) ||
 '    @GetMapping("/x/{id}")' || chr(10) ||
 '    String get' || CAST(p_size AS STRING) || '(@Path("id") Map<String, D' || CAST(p_partkey % 13 AS STRING) || '> in, int... more) {' || chr(10) ||
 '        return "} class Fake {"; // why' || chr(10) ||
 '    }' || chr(10) ||
 '    void hidden(int a) { }' || chr(10) ||
 '    static class N' || CAST(p_partkey AS STRING) || ' implements I' || CAST(p_size AS STRING) || '<D' || CAST(p_partkey % 13 AS STRING) || '> {' || chr(10) ||
 '        private E' || CAST(p_partkey % 5 AS STRING) || ' inner;' || chr(10) ||
 '    }' || chr(10) ||
 '}' || chr(10) ||
 'interface P' || CAST(p_partkey AS STRING) || ' {' || chr(10) ||
 '    void p' || CAST(p_size AS STRING) || '(' || chr(10) ||
 '        String a,' || chr(10) ||
 '        final int b);' || chr(10) ||
 '}' AS content
FROM part
"""

# Classes in a tree of superclasses whose bodies call each other, with calls in literals, comments and on unknown objects.
FIXTURES["call_files"] = r"""
SELECT 'org/calls' || CAST(r AS STRING) AS repository, 'src/K' || CAST(k AS STRING) || '.java' AS path,
 'package com.example.calls;' || chr(10) ||
 'public class K' || CAST(k AS STRING) || CASE WHEN k > 0 THEN ' extends K' || CAST(CAST(floor(k / 3) AS BIGINT) AS STRING) ELSE '' END || ' {' || chr(10) ||
 '    private final K' || CAST((k * 7 + 3) % 40 AS STRING) || ' dep;' || chr(10) ||
 '    private K' || CAST((k * 5 + 1) % 40 AS STRING) || ' part = new K' || CAST((k * 5 + 1) % 40 AS STRING) || '();' || chr(10) ||
 '    public void run' || CAST(k % 4 AS STRING) || '(K' || CAST((k * 3 + 2) % 40 AS STRING) || ' arg) {' || chr(10) ||
 '        dep.run' || CAST((k + 1) % 4 AS STRING) || '(null); // dep.make(1);' || chr(10) ||
 '        String s = "dep.make("; arg.run' || CAST(k % 3 AS STRING) || '(arg.run2(null));' || chr(10) ||
 '        if (s != null) { K' || CAST(k % 17 AS STRING) || ' loc = new K' || CAST(k % 17 AS STRING) || '(); loc.touch(); }' || chr(10) ||
 '        this.own(); own(); K' || CAST(k % 11 AS STRING) || '.make(s);' || chr(10) ||
 '        part.run3(' || chr(10) || '          null);' || chr(10) ||
 '        base.touch();' || chr(10) ||
 '        other.run1(null); part.dep.own(); s.length(); return;' || chr(10) ||
 '    }' || chr(10) ||
 '    private void own() { super.touch(); }' || chr(10) ||
 '    public static void make(String s) { }' || chr(10) ||
 CASE WHEN k < 3 THEN '    public void touch() { }' || chr(10) ELSE '' END ||
 CASE WHEN k = 0 THEN '    protected K1 base;' || chr(10) ELSE '' END || '}' AS content
FROM (SELECT p_partkey % 5 AS r, CAST(floor(p_partkey / 5) AS BIGINT) AS k FROM part) p
"""

FIXTURES["call_files_v2"] = r"""
SELECT 'org/calls' || CAST(r AS STRING) AS repository, 'src/K' || CAST(k AS STRING) || '.java' AS path,
 'public class K' || CAST(k AS STRING) || ' {' || chr(10) ||
 '    public void ' || CASE WHEN k % 7 = 2 THEN 'walk' ELSE 'run' END || CAST(k % 4 AS STRING) || '(K' || CAST((k * 3 + 2) % 40 AS STRING) || ' arg) { }' || chr(10) ||
 '    public static void make(String s) { }' || chr(10) ||
 CASE WHEN k < 3 THEN '    public void touch() { }' || chr(10) ELSE '' END || '}' AS content
FROM (SELECT p_partkey % 5 AS r, CAST(floor(p_partkey / 5) AS BIGINT) AS k FROM part) p WHERE k % 5 <> 3
"""

# Two copies of some classes under another path, to test that the last file wins.
FIXTURES["code_files_copies"] = r"""
SELECT repository, path, content FROM code_files
UNION ALL SELECT repository, 'zz/' || path AS path, content FROM code_files_v2 WHERE path LIKE '%4.java'
"""

FIXTURES["code_files_next"] = r"""
SELECT c.repository, c.path, CASE WHEN v.content LIKE '%public void n%' THEN v.content ELSE c.content END AS content
FROM code_files c JOIN code_files_v2 v ON c.repository = v.repository AND c.path = v.path
"""

# Interfaces with an old and a new return type, and the classes that implement them.
FIXTURES["contracts_old"] = r"""
SELECT 'org/repo' || CAST(p_partkey % 5 AS STRING) AS repository, 'src/A' || CAST(p_partkey AS STRING) || '.java' AS path,
 'interface A' || CAST(p_partkey AS STRING) || ' { void send(Event e); int size(); }' || chr(10) ||
 'class B' || CAST(p_partkey AS STRING) || ' implements A' || CAST(p_partkey AS STRING) || ' { public void send(Event e) { } }' AS content
FROM part
"""

FIXTURES["contracts_new"] = r"""
SELECT 'org/repo' || CAST(p_partkey % 5 AS STRING) AS repository, 'src/A' || CAST(p_partkey AS STRING) || '.java' AS path,
 'interface A' || CAST(p_partkey AS STRING) || ' { ' || CASE WHEN p_partkey % 3 = 0 THEN 'CompletableFuture<Void>' ELSE 'void' END || ' send(Event e); int size(); }' AS content
FROM part
"""

FIXTURES["index_documents"] = r"""
SELECT o_orderkey AS doc_id, 'org/repo' || CAST(o_custkey % 5 AS STRING) AS expected,
 CASE WHEN o_orderkey % 8 = 7 THEN '{"repository": ' ELSE
 '{' || CASE o_orderkey % 8 WHEN 1 THEN '' WHEN 2 THEN '"repository":"org/other",' ELSE '"repository":"org/repo' || CAST(o_custkey % 5 AS STRING) || '",' END ||
 CASE o_orderkey % 8 WHEN 3 THEN '' ELSE '"metadata":{"totalFiles":1},' END ||
 CASE o_orderkey % 8 WHEN 4 THEN '"other":1' WHEN 5 THEN '"index":{"classes":{}}' WHEN 6 THEN '"index":{"classes":{"A":{"name":"A"}},"dependencies":{},"files":null}' ELSE '"index":{"classes":{},"dependencies":{},"files":{}}' END || '}' END AS document
FROM orders
"""

# The class graph of ``code_files`` under folders whose names carry review weights.
FIXTURES["layered_files"] = r"""
SELECT 'org/repo' || CAST(p_partkey % 5 AS STRING) AS repository,
 'src/' || CASE p_partkey % 8 WHEN 0 THEN 'service' WHEN 1 THEN 'controller' WHEN 2 THEN 'repository' WHEN 3 THEN 'model' WHEN 4 THEN 'dto' WHEN 5 THEN 'entity' WHEN 6 THEN 'test' ELSE 'mock' END
 || '/c' || CAST(p_partkey % 20 AS STRING) || '/C' || CAST(p_partkey AS STRING) || '.java' AS path,
 'class C' || CAST(p_partkey AS STRING) || ' extends C' || CAST(p_partkey % 50 AS STRING) || ' {' || chr(10) || ' private C' || CAST((p_partkey * 7 + 3) % 97 AS STRING) || ' dep;' || chr(10) || '}' AS content
FROM part
"""

FIXTURES["layered_changes"] = r"""
SELECT repository, pr_number, file_no, status, additions, deletions, patch,
 CASE WHEN k IS NULL THEN filename ELSE 'src/' || CASE k % 8 WHEN 0 THEN 'service' WHEN 1 THEN 'controller' WHEN 2 THEN 'repository' WHEN 3 THEN 'model' WHEN 4 THEN 'dto' WHEN 5 THEN 'entity' WHEN 6 THEN 'test' ELSE 'mock' END
 || '/c' || CAST(k % 20 AS STRING) || '/C' || CAST(k AS STRING) || '.java' END AS filename
FROM (SELECT *, CASE WHEN filename = 'pom.xml' THEN NULL ELSE CAST(regexp_extract(filename, 'C([0-9]+)', 1) AS BIGINT) END AS k FROM file_changes) x
"""

# Changed manifests of the other two formats.
FIXTURES["manifest_changes"] = r"""
SELECT repository, pr_number, file_no, CASE additions % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'build.gradle' ELSE 'package.json' END AS filename, status, additions, deletions,
 CASE additions % 3 WHEN 0 THEN '@@ -1,2 +1,2 @@' || chr(10) || '+  "p' || CAST(additions AS STRING) || '": "^1.0.0",' || chr(10) || '-  "q": "1"'
  WHEN 1 THEN '@@ -1,2 +1,2 @@' || chr(10) || '+implementation ' || chr(39) || 'g:a:' || CAST(additions AS STRING) || chr(39)
  ELSE '@@ -1,2 +1,2 @@' || chr(10) || '+  "@scope/x": "^1.0.0"' END AS patch
FROM file_changes
"""

FIXTURES["related_code"] = r"""
SELECT doc_id AS pos, 'org/' || source AS repository, 'src/f' || CAST(doc_id % 40 AS STRING) || '.ts' AS path,
 CASE doc_id % 3 WHEN 0 THEN 'Parent class of X' WHEN 1 THEN 'Imported by Y' ELSE 'Uses modified file' END AS reason,
 CASE doc_id % 4 WHEN 0 THEN 'interface A' ELSE 'class B' END || CAST(doc_id % 40 AS STRING) || ' { and a long common head of the code that goes on ' || CAST(doc_id AS STRING) || ' }' AS code
FROM documents
"""

FIXTURES["field_records"] = r"""
SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 7 = 1 THEN 'not-a-uuid' ELSE '1b4e28ba-2fa1-11d2-883f-0016d3cca427' END AS job_id,
 CASE WHEN o_orderkey % 7 = 2 THEN 'no slash' ELSE 'org/repo' || CAST(o_custkey % 5 AS STRING) END AS repository,
 CASE WHEN o_orderkey % 7 = 3 THEN 'ABC' WHEN o_orderkey % 7 = 6 THEN NULL ELSE 'da39a3ee5e6b4b0d3255bfef95601890afd80709' END AS sha,
 CASE WHEN o_orderkey % 7 = 4 THEN 0 ELSE o_orderkey + 1 END AS pr_number,
 CASE WHEN o_orderkey % 7 IN (5, 6) THEN 'bad id!' ELSE 'req-' || CAST(o_orderkey AS STRING) END AS request_id
FROM orders
"""

FIXTURES["log_records"] = r"""
SELECT event_id, '{"user":"u' || CAST(user_id AS STRING) || '","apiToken":"t' || CAST(event_id AS STRING) || '","nested":{"Password":"p","list":[{"client_secret":"s","ok":' || CAST(event_id AS STRING) || '}]},"headers":{"Authorization":"Bearer x","X-Id":"1"}}' AS record
FROM events
"""

FIXTURES["process_messages"] = r"""
SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 9 = 8 THEN '{"requestId"' ELSE
 '{' || CASE o_orderkey % 9 WHEN 1 THEN '' ELSE '"requestId":"r1",' END ||
 '"timestamp":"' || CASE o_orderkey % 9 WHEN 2 THEN 'yesterday' ELSE '2024-01-15T10:30:00.000Z' END || '","source":"' || CASE o_orderkey % 9 WHEN 3 THEN 'indexer' ELSE 'pr-receptor' END || '"' ||
 CASE o_orderkey % 9 WHEN 4 THEN '' ELSE ',"payload":{"jobId":"' || CASE o_orderkey % 9 WHEN 5 THEN 'job-1' ELSE '1b4e28ba-2fa1-11d2-883f-0016d3cca427' END || '","repository":"org/a","prNumber":' || CAST(o_orderkey + 1 AS STRING) ||
  ',"action":"opened","sha":' || CASE o_orderkey % 9 WHEN 6 THEN 'null' ELSE '"da39a3ee5e6b4b0d3255bfef95601890afd80709"' END || ',"title":"' || CASE o_orderkey % 9 WHEN 6 THEN '' ELSE 't' END || '","author":"a","githubDeliveryId":null,"prUrl":"https://h/1"}' END ||
 CASE o_orderkey % 9 WHEN 7 THEN '' ELSE ',"metadata":{"retryCount":0,"correlationId":"c","extra":true}' END || '}' END AS body
FROM orders
"""

FIXTURES["metric_events"] = r"""
SELECT ts, 'svc' || CAST(user_id % 3 AS STRING) AS service, event_type AS metric, value FROM events
"""

FIXTURES["js_modules"] = r"""
SELECT 'org/js' || CAST(p_partkey % 5 AS STRING) AS repository,
 'src/m/f' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 7 = 0 THEN '/index.ts' ELSE '.ts' END AS path,
 'import { A' || CAST(p_partkey % 50 AS STRING) || ', missing as M } from "' || CASE WHEN p_partkey % 7 = 0 THEN '../f' ELSE './f' END || CAST(p_partkey % 50 AS STRING) || '";' || chr(10) ||
 'import def from "lodash/fp";' || chr(10) || 'import { gone } from "./nowhere/x' || CAST(p_partkey % 3 AS STRING) || '";' || chr(10) ||
 'export class A' || CAST(p_partkey AS STRING) || ' {}' || chr(10) || 'export default function run' || CAST(p_partkey AS STRING) || '() {}' || chr(10) || 'export const c' || CAST(p_partkey AS STRING) || ' = 1;' || chr(10) ||
 'const y = await import("@scope/pkg/sub");' AS content
FROM part
"""

# Pull requests that change one module each.
FIXTURES["js_changes"] = r"""
SELECT 'org/js' || CAST(p.p_partkey % 5 AS STRING) AS repository, o.o_orderkey AS pr_number, 1 AS file_no,
 'src/m/f' || CAST(p.p_partkey AS STRING) || CASE WHEN p.p_partkey % 7 = 0 THEN '/index.ts' ELSE '.ts' END AS filename, 'modified' AS status,
 CAST(1 AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions, '@@ -1,1 +1,1 @@' AS patch
FROM orders o JOIN part p ON p.p_partkey = o.o_custkey % 120
"""

FIXTURES["js_modules_v2"] = r"""
SELECT repository, path, CASE WHEN path LIKE '%4.ts' THEN replace(content, 'export const', 'const') ELSE content END AS content FROM js_modules
"""

FIXTURES["py_sources"] = r"""
SELECT p_partkey AS project_id, 'app/m' || CAST(p_partkey AS STRING) || '.py' AS path,
 'import os' || chr(10) || 'import numpy.linalg, sys' || chr(10) || 'from pkg' || CAST(p_partkey % 5 AS STRING) || '.sub import x' || chr(10) || 'from . import y' || chr(10) ||
 'def pub' || CAST(p_partkey AS STRING) || '():' || chr(10) || '    import json' || chr(10) || '    pass' || chr(10) || 'def _priv():' || chr(10) || '    pass' || chr(10) ||
 'class _Hidden:' || chr(10) || '    def inner(self):' || chr(10) || '        pass' || chr(10) || 'class Pub' || CAST(p_partkey AS STRING) || ':' || chr(10) || '    pass' AS source
FROM part
"""

FIXTURES["lock_files"] = r"""
SELECT p_partkey AS project_id, 'package-lock.json' AS path, CASE WHEN p_partkey % 3 = 0 THEN
 '{"name":"app' || CAST(p_partkey AS STRING) || '","dependencies":{"express":{"version":"4.' || CAST(p_size AS STRING) || '.2","integrity":"sha512-e"},"jest":{"version":"29.1.0","dev":true}}}' ELSE
 '{"name":"app' || CAST(p_partkey AS STRING) || '","packages":{"":{"version":"1.0.0"},"node_modules/express":{"version":"4.' || CAST(p_size AS STRING) || '.2","integrity":"sha512-e","dependencies":{"accepts":"~1.3.8"}},"node_modules/jest":{"version":"29.1.0","dev":true},"tools/x":{"version":"0.0.1","optional":true}}}' END AS content
FROM part
"""

FIXTURES["requirements_files"] = r"""
SELECT p_partkey AS project_id, 'requirements.txt' AS path,
 '# base' || chr(10) || chr(10) || '-r other.txt' || chr(10) || 'django>=' || CAST(p_size AS STRING) || '.0' || chr(10) || 'requests' || chr(10) || 'lib' || CAST(p_partkey % 30 AS STRING) || ' == 1.0' || chr(10) || 'celery[redis]==5.0' AS content
FROM part
"""

FIXTURES["pipfiles"] = r"""
SELECT p_partkey AS project_id, 'Pipfile' AS path,
 '[[source]]' || chr(10) || 'url = "x"' || chr(10) || '[packages]' || chr(10) || 'flask = "*"' || chr(10) || 'pinned = "==2.0"' || chr(10) || 'lib' || CAST(p_partkey % 30 AS STRING) || ' = "' || CAST(p_size AS STRING) || '.0"' || chr(10) ||
 '[dev-packages]' || chr(10) || 'pytest = "*"' || chr(10) || '[requires]' || chr(10) || 'python_version = "3.9"' AS content
FROM part
"""

FIXTURES["poetry_files"] = r"""
SELECT p_partkey AS project_id, 'pyproject.toml' AS path,
 '[tool.poetry]' || chr(10) || 'name = "x"' || chr(10) || '[tool.poetry.dependencies]' || chr(10) || 'python = "^3.' || CAST(p_size % 12 AS STRING) || '"' || chr(10) || '# note = "1"' || chr(10) || 'numpy = ">=1.' || CAST(p_size AS STRING) || '"' || chr(10) ||
 '[tool.poetry.dev-dependencies]' || chr(10) || 'black = "*"' || chr(10) || '[tool.poetry.extras]' || chr(10) || 'docs = ["sphinx", "lib' || CAST(p_partkey % 30 AS STRING) || '"]' || chr(10) || '[build-system]' || chr(10) || 'requires = "poetry"' AS content
FROM part
"""

FIXTURES["pom_files"] = r"""
SELECT p_partkey AS project_id, 'pom.xml' AS path,
 '<project><properties><lib.version>' || CAST(p_size AS STRING) || '.1</lib.version><enc>UTF-8</enc></properties><dependencies>' || chr(10) ||
 '<dependency><groupId>org.g</groupId><artifactId>lib' || CAST(p_partkey % 30 AS STRING) || '</artifactId><version>$' || '{lib.version}</version></dependency>' || chr(10) ||
 '<dependency>' || chr(10) || '<groupId>junit</groupId><artifactId>junit</artifactId><version>4.12</version><scope>test</scope></dependency>' || chr(10) ||
 '<dependency><groupId>com.google</groupId><artifactId>guava</artifactId><optional>true</optional></dependency>' || chr(10) || '<dependency><artifactId>nogroup</artifactId></dependency></dependencies></project>' AS content
FROM part
"""

FIXTURES["gradle_files"] = r"""
SELECT p_partkey AS project_id, 'build.gradle' AS path,
 'dependencies {' || chr(10) || ' implementation ' || chr(39) || 'org.g:lib' || CAST(p_partkey % 30 AS STRING) || ':' || CAST(p_size AS STRING) || '.0' || chr(39) || chr(10) || ' api "com.google:guava"' || chr(10) || ' testImplementation ' || chr(39) || 'junit:junit:4.12' || chr(39) || chr(10) || ' compile "local"' || chr(10) || '}' AS content
FROM part
"""

FIXTURES["go_files"] = r"""
SELECT p_partkey AS project_id, 'go.mod' AS path,
 'module example.com/m' || CAST(p_partkey AS STRING) || chr(10) || 'go 1.' || CAST(p_size % 22 AS STRING) || chr(10) || 'require github.com/single/one v0.1.0' || chr(10) || 'require (' || chr(10) || chr(9) || 'github.com/spf13/cobra v1.' || CAST(p_size AS STRING) || '.0' || chr(10) || chr(9) || 'golang.org/x/crypto v0.1.0 // indirect' || chr(10) || ')' || chr(10) ||
 'replace (' || chr(10) || chr(9) || 'a.b/c v1.0.0 => ../c' || chr(10) || ')' AS content
FROM part
"""

FIXTURES["csproj_files"] = r"""
SELECT p_partkey AS project_id, 'src/App.csproj' AS path,
 '<Project><ItemGroup><PackageReference Include="Newtonsoft.Json" Version="13.' || CAST(p_size AS STRING) || '" />' || chr(10) || '<PackageReference Include="Lib' || CAST(p_partkey % 30 AS STRING) || '" /><PackageReference Update="x" /></ItemGroup></Project>' AS content
FROM part
"""

FIXTURES["project_paths"] = r"""
SELECT 'org/r' || CAST(p_partkey AS STRING) AS repository, 'README.md' AS path FROM part
UNION ALL SELECT 'org/r' || CAST(p_partkey AS STRING), CASE p_partkey % 6 WHEN 0 THEN 'pyproject.toml' WHEN 1 THEN 'Pipfile' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'package.json' WHEN 4 THEN 'pom.xml' ELSE 'src/A.csproj' END FROM part
UNION ALL SELECT 'org/r' || CAST(p_partkey AS STRING), CASE p_partkey % 5 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'packages/a/package.json' WHEN 2 THEN 'lerna.json' WHEN 3 THEN 'mods/b/package.json' ELSE 'go.mod' END FROM part
"""

FIXTURES["root_manifests"] = r"""
SELECT 'org/r' || CAST(p_partkey AS STRING) AS repository,
 CASE p_partkey % 4 WHEN 0 THEN '{"name":"r","private":true}' WHEN 1 THEN '{"name":"r","workspaces":["packages/*","mods/**"]}' WHEN 2 THEN '{"name":"r","workspaces":{"packages":["packages/*/"]}}' ELSE '{"name":"r"}' END AS content
FROM part
"""

FIXTURES["package_names"] = r"""
SELECT p_partkey AS project_id, CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'maven' ELSE 'go' END AS ecosystem,
 CASE p_partkey % 12 WHEN 0 THEN 'express-x' WHEN 1 THEN 'Django-y' WHEN 2 THEN 'Spring-Boot-z' WHEN 3 THEN 'github.com/gin-gonic/gin' WHEN 4 THEN 'eslint-plugin-jest' WHEN 5 THEN 'pandas' WHEN 6 THEN 'junit:junit' WHEN 7 THEN 'github.com/spf13/cobra' WHEN 8 THEN 'left-pad' WHEN 9 THEN 'mysqlclient' WHEN 10 THEN 'aws-java-sdk' ELSE 'golang.org/x/tools' END || CAST(p_size AS STRING) AS name
FROM part
"""

FIXTURES["vulnerabilities_ranged"] = r"""
SELECT 'CVE-' || CAST(s_suppkey AS STRING) AS cve_id, 'lib' || CAST(s_suppkey % 30 AS STRING) AS package,
 CASE s_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
 CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '>= 0.' || CAST(s_suppkey % 50 AS STRING) || '.2' ELSE '< 0.' || CAST(s_suppkey % 50 AS STRING) || '.0' END AS affected, s_suppkey % 50 AS bound, s_suppkey % 5 AS kind
FROM supplier
"""

FIXTURES["vector_changes"] = r"""
SELECT CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE vec_id + 1000000000 END AS vec_id, embedding, label + 100 AS label FROM embeddings WHERE label < 4
"""

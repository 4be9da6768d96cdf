"""Scans of files at the edges of what is read: folders on disk, broken files beside good ones, and rarer forms. One file a supplier."""

from __future__ import annotations

import os
from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.session import Scratch
from ..sources.config_files import file_rows, read_config_files
from .scan import build_graph
from .scan_tables import EDGE_ROWS, LINES, NODE_ROWS, RESOURCES, WARNING_ROWS, case, entries, filled, graph_rows, reached_resources, text


def write_files(files: DataFrame, root: str) -> None:
    """Files (rel, data binary) below a folder that all executors share."""

    def write(rows: Iterable[Row]) -> None:
        for row in rows:
            path = os.path.join(root, row.rel)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as file:
                file.write(row.data)

    files.foreachPartition(write)


def more() -> Column:
    return F.concat_ws("|", text(F.col("source")), text(F.col("url")))


def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that is written and read back: dot-files, pruned folders, other suffixes, bytes that are no UTF-8, CRLF, a file that is too large."""
    rows = entries(spark, sf_dir)
    huge = F.col("k") % 600 == 5
    name = F.when(huge, filled("f{nn}/d{k}/big.yaml")).otherwise(case(6, *["f{nn}/d{k}/" + x for x in (".mcp.json", "node_modules/mcp.json", "notes.txt", "mcp.json", "deep/er/compose.yaml", ".vscode/mcp.json")]))
    server = '{"mcpServers": {"p{k}": {"command": "bash"}}}'
    body = case(6, server, server, server, '{"mcpServers": {\r\n"p{k}é": {"command": "bash"}}}', "name: q{k}\nservices:\n  s{k}: {privileged: true}\n", '{"servers": {"v{k}": {"url": "https://[2001:DB8::1]:443/x"}}}')
    data = F.when(huge, F.repeat(F.lit("#"), 2_000_001).cast("binary")).otherwise(F.encode(body, "ISO-8859-1"))
    with Scratch(spark) as scratch:
        root = f"{urlparse(scratch.root).path}/files"
        os.makedirs(root, exist_ok=True)
        # The table of keys may be one part, however many files come of it.
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
        write_files(rows.select(name.alias("rel"), data.alias("data")), root)
        return graph_rows(build_graph(read_config_files(spark, root)), more())


FOLDER_SQL = f"""WITH {LINES}, {RESOURCES},
 c AS (SELECT *, 'f' || nn || '/d' || k || '/' || ['.mcp.json', '', '', 'mcp.json', 'deep/er/compose.yaml', '.vscode/mcp.json'][(k % 6 + 1)::INT] AS rel FROM s WHERE k % 600 <> 5),
 m AS (SELECT *, 'agent:mcp:' || rel AS agent, CASE k % 6 WHEN 0 THEN 'p' || k WHEN 3 THEN 'p' || k || chr(65533) ELSE 'v' || k END AS name, CASE k % 6 WHEN 3 THEN 2 ELSE 1 END AS ln FROM c WHERE k % 6 IN (0, 3, 5)),
 e AS (
  SELECT agent AS src, 'mcp:' || rel || ':' || name AS dst, 'can call' AS rel, rel AS file, ln AS line, true AS passes FROM m
  UNION ALL SELECT 'mcp:' || rel || ':' || name, CASE k % 6 WHEN 5 THEN 'net:remote:2001:db8::1' ELSE 'cap:exec:shell' END, CASE k % 6 WHEN 5 THEN 'connects to' ELSE 'runs shell commands' END, rel, ln, k % 6 <> 5 FROM m
  UNION ALL SELECT 'compose:q' || k || '/s' || k, unnest(['cap:host:root', 'net:compose:q' || k || '/default']), unnest(['privileged', 'attached to']), rel, 3, true FROM c WHERE k % 6 = 4),
 v AS (
  SELECT agent AS id, 'agent' AS kind, CASE k % 6 WHEN 0 THEN 'Claude Code (' ELSE 'MCP client (' END || rel || ')' AS label, 0 AS severity, rel AS file, 1 AS line, 'mcp config|-' AS more FROM m
  UNION ALL SELECT 'mcp:' || rel || ':' || name, 'tool', name || ' (MCP server)', 0, rel, ln, 'mcp server|' || CASE k % 6 WHEN 5 THEN 'https://[2001:DB8::1]:443/x' ELSE '-' END FROM m
  UNION ALL SELECT 'compose:q' || k || '/s' || k, 'identity', 's' || k || ' (compose)', 0, rel, 3, '-|-' FROM c WHERE k % 6 = 4
  UNION ALL SELECT 'net:compose:q' || k || '/default', 'resource', 'network default (q' || k || ')', 2, NULL, NULL, '-|-' FROM c WHERE k % 6 = 4
  UNION ALL SELECT DISTINCT 'net:remote:2001:db8::1', 'resource', 'Remote MCP endpoint 2001:db8::1', 2, NULL, NULL::INT, '-|-' FROM m WHERE k % 6 = 5
  UNION ALL {reached_resources("-|-")}),
 w AS (SELECT 'f' || nn || '/d' || k || '/big.yaml: larger than 2000000 bytes, skipped' AS message FROM s WHERE k % 600 = 5)
 {EDGE_ROWS} UNION ALL {NODE_ROWS} UNION ALL {WARNING_ROWS}"""


def scan_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that say nothing, in part or at all, beside good ones: what is lost is one warning and no more."""
    name = case(10, *["x{nn}/d{k}/" + x for x in ("list.yaml", "pair.json", "twice.yaml", "merged.yaml", "tag.yaml", "compose.yaml", "compose.yml", "docker-compose.yml", "mcp.json", "items.yaml")])
    body = case(
        10, "a: 1\nb: [1\n", '{"a" "b"}\n', "agents:\n  - {name: a{k}, name: z{k}, tools: [bash]}\n", "base: &b {tools: [sql], name: no}\nagents:\n  - {<<: *b, name: m{k}}\n", "a: 1\nb: !!python/object/apply:os.system [x]\n", "- 1\n",
        "name: x\n", "name: q{k}\nservices:\n  bad: 3\n  s{k}: {pid: host}\n", '{"mcpServers": {"bad": 3,\n"p{k}": {"command": "bash"}}}', "apiVersion: v1\nkind: List\nitems:\n  - 7\n  - {kind: ServiceAccount, metadata: {name: sa{k}}}\n  - {kind: Odd}\n---\nnull\n---\n- no object\n",
    )
    rows = entries(spark, sf_dir).select(name.alias("rel"), body.alias("content"))
    return graph_rows(build_graph(file_rows(rows)), more())


BROKEN_SQL = f"""WITH {LINES}, {RESOURCES},
 c AS (SELECT *, (k % 10)::INT AS q, 'x' || nn || '/d' || k || '/' || ['list.yaml', 'pair.json', 'twice.yaml', 'merged.yaml', 'tag.yaml', 'compose.yaml', 'compose.yml', 'docker-compose.yml', 'mcp.json', 'items.yaml'][(k % 10 + 1)::INT] AS rel FROM s),
 a AS (SELECT *, CASE q WHEN 2 THEN 'z' ELSE 'm' END || k AS name, CASE q WHEN 2 THEN 'bash' ELSE 'sql' END AS tool, CASE q WHEN 2 THEN 2 ELSE 3 END AS ln FROM c WHERE q IN (2, 3)),
 e AS (
  SELECT 'agent:registry:' || rel || ':' || name AS src, 'tool:' || rel || ':' || tool AS dst, 'can call' AS rel, rel AS file, CASE q WHEN 2 THEN 2 ELSE 1 END AS line, true AS passes FROM a
  UNION ALL SELECT 'tool:' || rel || ':' || tool, CASE q WHEN 2 THEN 'cap:exec:shell' ELSE 'cap:data:sql' END, tool, rel, CASE q WHEN 2 THEN 2 ELSE 1 END, true FROM a
  UNION ALL SELECT 'compose:q' || k || '/s' || k, unnest(['cap:host:pid', 'net:compose:q' || k || '/default']), unnest(['pid: host', 'attached to']), rel, 4, true FROM c WHERE q = 7
  UNION ALL SELECT 'agent:mcp:' || rel, 'mcp:' || rel || ':p' || k, 'can call', rel, 2, true FROM c WHERE q = 8
  UNION ALL SELECT 'mcp:' || rel || ':p' || k, 'cap:exec:shell', 'runs shell commands', rel, 2, true FROM c WHERE q = 8),
 v AS (
  SELECT 'agent:registry:' || rel || ':' || name AS id, 'agent' AS kind, name AS label, 0 AS severity, rel AS file, ln AS line, 'tool registry|-' AS more FROM a
  UNION ALL SELECT 'tool:' || rel || ':' || tool, 'tool', tool, 0, rel, CASE q WHEN 2 THEN 2 ELSE 1 END, '-|-' FROM a
  UNION ALL SELECT 'compose:q' || k || '/s' || k, 'identity', 's' || k || ' (compose)', 0, rel, 4, '-|-' FROM c WHERE q = 7
  UNION ALL SELECT 'net:compose:q' || k || '/default', 'resource', 'network default (q' || k || ')', 2, NULL, NULL, '-|-' FROM c WHERE q = 7
  UNION ALL SELECT 'agent:mcp:' || rel, 'agent', 'MCP client (' || rel || ')', 0, rel, 1, 'mcp config|-' FROM c WHERE q = 8
  UNION ALL SELECT 'mcp:' || rel || ':p' || k, 'tool', 'p' || k || ' (MCP server)', 0, rel, 2, 'mcp server|-' FROM c WHERE q = 8
  UNION ALL SELECT 'k8s:sa:default/sa' || k, 'identity', 'sa default/sa' || k, 0, rel, 5, '-|-' FROM c WHERE q = 9
  UNION ALL {reached_resources("-|-")}),
 w AS (
  SELECT rel || ': ' || ['invalid YAML: expected '','' or '']'', but got ''<stream end>'' at line 3, skipped', 'invalid JSON: Expecting '':'' delimiter at line 1, skipped', '', '', 'invalid YAML: could not determine a constructor for the tag ''tag:yaml.org,2002:python/object/apply:os.system'' at line 2, skipped',
   'compose file is not a mapping, skipped', 'no ''services'' mapping, skipped', 'service ''bad'' is not a mapping, skipped', 'MCP server ''bad'' is not a mapping, skipped', ''][q + 1] AS message FROM c WHERE q IN (0, 1, 4, 5, 6, 7, 8)
  UNION ALL SELECT 'skipped unsupported Kubernetes kinds: Odd x' || count(*) FROM c WHERE q = 9 HAVING count(*) > 0)
 {EDGE_ROWS} UNION ALL {NODE_ROWS} UNION ALL {WARNING_ROWS}"""


def scan_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four places of MCP servers, further launch commands and addresses, and further workload kinds with init containers."""
    server = case(3, '{"command": "npx", "args": ["server-filesystem"]}', '{"command": "docker", "args": ["run", "--pid", "host", "--net=host", "--volume=/etc:/x:ro"]}', '{"url": "http://u:p@[::1]:8080/a"}')
    name = case(4, *["g{nn}/d{k}/" + x for x in ("settings.json", "conf.yaml", "mcp.json", "claude_desktop_config.json")])
    at = filled('"p{k}": ')
    body = F.concat(case(4, '{"mcp": {"servers": {', "mcp:\n  mcpServers:\n    ", '{"servers": {', '{"mcpServers": {'), at, server, case(4, "}}}", "\n", "}}", "}}"))
    rows = entries(spark, sf_dir)
    kinds = case(3, "StatefulSet", "ReplicaSet", "Job")
    work = F.concat(F.lit("apiVersion: v1\nkind: "), kinds, filled("\nmetadata: {name: w{k}, namespace: wn{n}}\nspec:\n  template:\n    spec:\n      initContainers:\n        - {env: [{name: INIT_TOKEN, value: x}]}\n      containers:\n        - {"), case(2, "securityContext: {privileged: true}", "name: c"), F.lit("}\n"))
    files = rows.select(name.alias("rel"), body.alias("content")).unionByName(rows.select(filled("h{nn}/w{k}.yaml").alias("rel"), work.alias("content")))
    return graph_rows(build_graph(file_rows(files)), more())


FORMS_SQL = f"""WITH {LINES}, {RESOURCES},
 f(id, label, severity) AS (SELECT * FROM r UNION ALL VALUES ('fs:write:.', 'Filesystem write: .', 8)),
 c AS (SELECT *, 'g' || nn || '/d' || k || '/' || ['settings.json', 'conf.yaml', 'mcp.json', 'claude_desktop_config.json'][(k % 4 + 1)::INT] AS rel, CASE k % 4 WHEN 1 THEN 3 ELSE 1 END AS ln FROM s),
 m AS (SELECT *, 'agent:mcp:' || rel AS agent, 'mcp:' || rel || ':p' || k AS tool FROM c),
 d AS (SELECT *, 'h' || nn || '/w' || k || '.yaml' AS rel, ['StatefulSet', 'ReplicaSet', 'Job'][(k % 3 + 1)::INT] AS knd, 'wn' || n AS ns FROM s),
 x AS (SELECT *, 'k8s:' || lower(knd) || ':' || ns || '/w' || k AS wid FROM d),
 e AS (
  SELECT agent AS src, tool AS dst, 'can call' AS rel, rel AS file, ln AS line, true AS passes FROM m
  UNION ALL SELECT tool, 'fs:write:.', 'filesystem root', rel, ln, true FROM m WHERE k % 3 = 0
  UNION ALL SELECT tool, unnest(['cap:host:pid', 'cap:host:network', 'hostpath:ro:/etc']), unnest(['docker --pid host', 'docker --network host', 'docker -v mount']), rel, ln, true FROM m WHERE k % 3 = 1
  UNION ALL SELECT tool, 'net:remote:::1', 'connects to', rel, ln, false FROM m WHERE k % 3 = 2
  UNION ALL SELECT wid, 'k8s:sa:' || ns || '/default', 'runs as (token mounted)', rel, 7, true FROM x
  UNION ALL SELECT wid, 'secret:env:INIT_TOKEN', 'holds', rel, 8, true FROM x
  UNION ALL SELECT wid, 'cap:host:root', 'privileged container', rel, 10, true FROM x WHERE k % 2 = 0),
 v AS (
  SELECT agent AS id, 'agent' AS kind, CASE k % 4 WHEN 3 THEN 'Claude Desktop (' ELSE 'MCP client (' END || rel || ')' AS label, 0 AS severity, rel AS file, 1 AS line, 'mcp config|-' AS more FROM m
  UNION ALL SELECT tool, 'tool', 'p' || k || ' (MCP server)', 0, rel, ln, 'mcp server|' || CASE k % 3 WHEN 2 THEN 'http://***@[::1]:8080/a' ELSE '-' END FROM m
  UNION ALL SELECT DISTINCT 'net:remote:::1', 'resource', 'Remote MCP endpoint ::1', 2, NULL, NULL::INT, '-|-' FROM m WHERE k % 3 = 2
  UNION ALL SELECT wid, 'identity', knd || ' ' || ns || '/w' || k, 0, rel, 1, '-|-' FROM x
  UNION ALL SELECT DISTINCT 'k8s:sa:' || ns || '/default', 'identity', 'sa ' || ns || '/default', 0, NULL, NULL::INT, '-|-' FROM x
  UNION ALL SELECT 'secret:env:INIT_TOKEN', 'secret', 'INIT_TOKEN', 5, min(rel), 8, 'env var|-' FROM x HAVING count(*) > 0
  UNION ALL SELECT id, 'resource', label, severity, NULL, NULL, '-|-' FROM f WHERE id IN (SELECT dst FROM e))
 {EDGE_ROWS} UNION ALL {NODE_ROWS}"""

QUERIES = {f.__name__: f for f in (scan_folder, scan_broken, scan_forms)}
SQL = {"scan_folder": FOLDER_SQL, "scan_broken": BROKEN_SQL, "scan_forms": FORMS_SQL}

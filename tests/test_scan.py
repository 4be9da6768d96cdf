"""Scans of config files of every format, in one folder with a few bad files in it."""

import json

import pytest
from pyspark.sql import functions as F

from emberline.functions import rules as R
from emberline.functions.values import COMPOSE_AGENT_LABEL, K8S_AGENT_LABEL
from emberline.plans.scan import rank_agents, scan
from emberline.report import messages, summary, to_dict, to_html, to_json, write_tables
from emberline.sources.config_files import file_rows, read_config_files

SECRET = "hunter2-planted-value"
FILES = {
    "stack/compose.yaml": f"""name: shop
services:
  web:
    image: web:1
    privileged: true
    cap_add: [CAP_SYS_ADMIN, NET_ADMIN]
    network_mode: host
    volumes:
      - /var/run/docker.sock:/s
      - /etc:/e:ro,z
      - named:/d
    environment:
      OPENAI_API_KEY: {SECRET}
      DB_URL: x
      KEY_FILE: /run/x
  db:
    environment: ["DB_PASSWORD=${{X}}"]
    secrets: [pg]
  bot:
    build: ./bot
    labels: {{{COMPOSE_AGENT_LABEL}: "true"}}
  odd: just text
secrets:
  pg: {{file: x}}
""",
    "stack/bot/main.py": f"""from langchain.agents import initialize_agent
open("/nowhere/{SECRET}", "w")
@tool
def run(cmd):
    return subprocess.run(cmd)
extra = [ShellTool()] + FileManagementToolkit(root_dir="/data").get_tools()
extra += load_tools(["requests_get", "other"])
bot = initialize_agent([run, *extra], llm)
runner = AgentExecutor(agent=bot, tools=[PythonREPLTool()])
""",
    "k8s/a.yaml": """apiVersion: v1
kind: ServiceAccount
metadata: {name: ci, namespace: ai}
automountServiceAccountToken: false
---
apiVersion: v1
kind: Secret
metadata: {name: tls, namespace: ai}
data: {b: x, a: y}
---
apiVersion: apps/v1
kind: Deployment
metadata: {name: app, namespace: ai, labels: {K8S_LABEL: "TRUE"}}
spec:
  template:
    spec:
      serviceAccountName: ci
      volumes:
        - hostPath: {path: /opt}
      containers:
        - env:
            - {name: API_TOKEN, value: x}
            - {name: X, valueFrom: {secretKeyRef: {name: tls, key: a}}}
---
apiVersion: v1
kind: ConfigMap
metadata: {name: c}
""".replace("K8S_LABEL", K8S_AGENT_LABEL),
    "k8s/b.yaml": """apiVersion: v1
kind: List
items:
  - kind: Role
    metadata: {name: reader, namespace: ai}
    rules:
      - {resources: [secrets], verbs: [get]}
      - {verbs: [get], nonResourceURLs: [/]}
  - kind: RoleBinding
    metadata: {name: rb, namespace: ai}
    subjects: [{kind: ServiceAccount, name: ci}, {kind: Group, name: "system:serviceaccounts:ai"}, {kind: User, name: u}]
    roleRef: {kind: Role, name: reader}
  - kind: ClusterRoleBinding
    metadata: {name: crb}
    subjects: [{kind: ServiceAccount, name: ci, namespace: ai}]
    roleRef: {kind: ClusterRole, name: cluster-admin}
  - kind: RoleBinding
    metadata: {name: lost}
    roleRef: {kind: Role, name: none}
""",
    ".mcp.json": json.dumps({"mcpServers": {
        "files": {"command": "npx", "args": ["server-filesystem", "/Users/me", "--x", f"--token={SECRET}", "--api-key", SECRET], "env": {"GH_TOKEN": SECRET, "HOME": "x"}},
        "box": {"command": "docker", "args": ["run", "-v", "/:/h:ro", "--network", "host", "--privileged"], "url": f"https://u:{SECRET}@API.example.com/x"}, "bad": 3}}),
    "agents.yaml": """agents:
  - name: triage
    runs_as: k8s:ai/app
    tools: [shell, {mcp: files}, {name: notes, type: fs_read, path: /home/x}]
  - name: lost
    runs_as: compose:none
    tools: []
  - {tools: []}
tools:
  - {name: shell, type: bash, credentials: [SHELL_KEY]}
""",
    "bad.yaml": "a: [1\n",
    "bad.json": "{\"a\": \t1,,}",
    "tag.yaml": "a: !!python/object:os.system x\n",
    "wrong/docker-compose.yml": "- a\n",
    "broken.py": "import langchain\ndef (:\n",
    "plain.py": "def (: not read",
    "node_modules/x.yaml": "a: [1\n",
    "notes.txt": "a: [1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("scan")
    for name, text in FILES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (folder / "big.json").write_text("[" + " " * 2_000_001 + "]")
    return folder


@pytest.fixture(scope="module")
def graph(spark, root):
    return scan(spark, str(root))


@pytest.fixture(scope="module")
def edges(graph):
    return {(r.src, r.dst): r for r in graph.edges.collect()}


@pytest.fixture(scope="module")
def nodes(graph):
    return {r.id: r for r in graph.nodes.collect()}


def test_compose(edges, nodes):
    web = "compose:shop/web"
    assert {d for s, d in edges if s == web} == {"cap:host:root", "cap:host:network", "cap:host:docker", "hostpath:ro:/etc", "secret:env:OPENAI_API_KEY"}
    assert nodes[web].cap_add == ["NET_ADMIN"] and nodes["hostpath:ro:/etc"].severity == 6 and nodes["secret:env:OPENAI_API_KEY"].inline_value_found
    assert edges[web, "cap:host:root"].line == 5 and edges[web, "cap:host:root"].file == "stack/compose.yaml"
    net = "net:compose:shop/default"
    assert not edges[net, "compose:shop/bot"].transitive and edges["compose:shop/db", net].rel == "attached to"
    assert nodes["secret:env:DB_PASSWORD"].inline_value_found is None and ("compose:shop/db", "secret:compose:shop/pg") in edges
    assert edges["agent:compose:shop/web", web].rel == "runs as"


def test_python_code(edges, nodes):
    agent = "agent:code:stack/bot/main.py:8"
    tools = {d for s, d in edges if s == agent}
    assert tools == {f"tool:stack/bot/main.py:{t}" for t in ("run", "ShellTool@6", "FileManagementToolkit@6", "requests_get@7", "PythonREPLTool@9")} | {"compose:shop/bot"}
    assert nodes[agent].label == "bot (initialize_agent)" and edges["tool:stack/bot/main.py:run", "cap:exec:shell"].rel == "calls subprocess.run()"
    assert ("tool:stack/bot/main.py:FileManagementToolkit@6", "fs:write:/data") in edges
    assert "agent:compose:shop/bot" not in nodes  # the code already runs as it


def test_kubernetes(edges, nodes):
    app, sa = "k8s:deployment:ai/app", "k8s:sa:ai/ci"
    assert edges[app, sa].rel == "assigned (token not mounted)" and not edges[app, sa].transitive
    assert edges[app, "secret:k8s:ai/tls"].rel == "mounts secret" and nodes["secret:k8s:ai/tls"]["keys"] == ["a", "b"]
    role, admin = "k8s:perm:ai:secrets:get:", "k8s:perm:cluster:*:*:"
    assert (nodes[role].severity, nodes[admin].severity) == (6, 9) and nodes[admin].label.endswith("(cluster-admin)")
    assert edges[sa, role].rel == "RoleBinding rb -> Role reader"
    assert edges[role, "secret:k8s:ai/tls"].rel == edges[admin, "secret:k8s:ai/tls"].rel == "can read"


def test_mcp_and_registry(edges, nodes):
    files, box = "mcp:.mcp.json:files", "mcp:.mcp.json:box"
    assert nodes["agent:mcp:.mcp.json"].label == "Claude Code (.mcp.json)"
    assert nodes[files].args == ["server-filesystem", "/Users/me", "--x", "--token=***", "***", "***"]  # a flag with its value inside masks the next argument too
    assert {d for s, d in edges if s == files} >= {"fs:write:/Users/me", "secret:env:GH_TOKEN"} and ("x", "HOME") not in edges
    assert {d for s, d in edges if s == box} == {"cap:host:root", "cap:host:network", "net:remote:api.example.com"}
    assert nodes[box].url == "https://***@API.example.com/x" and not edges[box, "net:remote:api.example.com"].transitive
    triage = "agent:registry:agents.yaml:triage"
    assert {d for s, d in edges if s == triage} == {"k8s:deployment:ai/app", files, "tool:agents.yaml:shell", "tool:agents.yaml:notes"}
    assert ("tool:agents.yaml:shell", "cap:exec:shell") in edges and ("tool:agents.yaml:shell", "secret:env:SHELL_KEY") in edges and nodes["fs:read:/home/x"].severity == 6


def test_warnings_name_every_bad_file(graph):
    said = [r.message for r in graph.warnings.orderBy("seq").collect()]
    for text in ("bad.yaml: invalid YAML", "bad.json: invalid JSON", "tag.yaml: invalid YAML", "wrong/docker-compose.yml: compose file is not a mapping", "broken.py: not valid Python (SyntaxError)",
                 "big.json: larger than 2000000 bytes", "service 'odd' is not a mapping", "MCP server 'bad' is not a mapping", "agent entry without a name", "skipped unsupported Kubernetes kinds: ConfigMap x1",
                 "RoleBinding lost references unknown Role none", "reference 'compose:none' did not match anything"):
        assert any(text in w for w in said), text
    assert not any("node_modules" in w or "plain.py" in w or "notes.txt" in w for w in said)


def test_reports_hold_no_secret_values(graph):
    data = to_dict(graph)
    page, text = to_html(data, "<t>"), to_json(data)
    assert SECRET not in page and SECRET not in text and "&lt;t&gt;" in page
    ranked = [r.id for r in rank_agents(graph).orderBy("rank").collect()]
    assert [a["id"] for a in data["agents"]] == ranked and len(ranked) == 5  # triage runs as the labelled deployment, which is thus no agent of its own
    best = data["agents"][0]
    assert best["score"] == sum(f["severity"] for f in best["findings"]) and best["findings"][0]["path"][0]["from"] == best["label"]
    said = summary(graph)
    assert best["label"][:20] in said and f"{len(data['nodes'])} nodes" in said and messages(graph)[0] == f"{len(data['warnings'])} warning(s):"
    assert SECRET not in said and SECRET not in str(messages(graph))
    assert all(n["degree"] == sum(n["id"] in (e["source"], e["target"]) for e in data["edges"]) for n in data["nodes"]) and "degree" not in text


def test_no_file_stops_a_scan(spark, tmp_path):
    """A surrogate in a key, a dangling link, a file that goes between listing and reading: each is one warning at most."""
    import os

    from emberline.sources.config_files import ConfigReader

    (tmp_path / ".mcp.json").write_text('{"mcpServers": {"\\ud800": {"command": "bash"}, "fine": {"command": "bash"}}}')
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.yaml")
    (tmp_path / "ok.yaml").write_text("agents:\n  - {name: a, tools: [bash]}\n")
    made = scan(spark, str(tmp_path))
    ids = {r.id for r in made.nodes.collect()}
    assert {"mcp:.mcp.json:fine", "agent:registry:ok.yaml:a", "cap:exec:shell"} <= ids
    said = [r.message for r in made.warnings.collect()]
    assert any(m == "gone.yaml: can't be read (FileNotFoundError), skipped" for m in said)
    reader = ConfigReader(str(tmp_path))
    parts = reader.partitions()
    (tmp_path / "ok.yaml").unlink()
    assert {r[0]: r[4] for p in parts for r in reader.read(p)}["ok.yaml"] == "can't be read (FileNotFoundError)"


def test_registry_nulls_hide_the_shared_definition(spark):
    text = """tools:
  - {name: shell, type: bash, credentials: [A_KEY]}
  - {name: disk, type: filesystem, path: /srv, env: [B_KEY]}
agents:
  - name: x
    tools: [shell, {name: disk}]
  - name: y
    tools: [{name: shell, type: null, credentials: null}, {name: disk, path: /etc}]
"""
    from emberline.plans.scan import build_graph

    rows = lambda t: file_rows(spark.createDataFrame([("r.yaml", t)], "rel string, content string"))
    both = build_graph(rows(text)).edges
    assert {r.dst for r in both.where("src = 'tool:r.yaml:disk'").collect()} == {"fs:write:/srv", "fs:write:/etc", "secret:env:B_KEY"}
    only_y = build_graph(rows(text.replace("tools: [shell, {name: disk}]", "tools: []"))).edges
    assert {r.dst for r in only_y.where("src = 'tool:r.yaml:shell'").collect()} == {"cap:exec:shell"}


def test_command_line_and_tables(spark, tmp_path, capsys, graph):
    from emberline import cli

    (tmp_path / "agents.yaml").write_text("agents:\n  - {name: triage, tools: [bash]}\n  - {tools: []}\n")
    page, doc, tables = tmp_path / "p.html", tmp_path / "g.json", tmp_path / "t"
    assert cli.main(["scan", str(tmp_path / "agents.yaml"), "-o", str(page), "--json", str(doc), "--tables", str(tables)]) == 0
    out = capsys.readouterr()
    assert "triage" in out.out and "1 warning(s):" in out.err and "<script>" in page.read_text()
    assert {a["label"] for a in json.loads(doc.read_text())["agents"]} == {"triage"}
    assert spark.read.parquet(str(tables / "edges")).count() == 2
    assert cli.main(["scan", str(tmp_path / "agents.yaml"), "-q"]) == 0 and "warning" not in capsys.readouterr().err
    with pytest.raises(SystemExit) as stop:
        cli.main(["scan", str(tmp_path / "none")])
    assert stop.value.code == 2 and "no such file" in capsys.readouterr().err
    write_tables(graph, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all/nodes")).count() == graph.nodes.count()


def test_single_file_and_rows(spark, root):
    assert [r.rel for r in read_config_files(spark, str(root / "notes.txt")).collect()] == ["notes.txt"]
    rows = file_rows(spark.createDataFrame([("a/x.yaml", "a\r\nb"), ("dist/y.yaml", ""), ("z.txt", ""), ("q.json", None)], "rel string, content string"))
    assert {(r.rel, r.content) for r in rows.collect()} == {("a/x.yaml", "a\nb"), ("q.json", "")}


@pytest.mark.parametrize(("arg", "want"), [("--api-key=abc", "--api-key=***"), ("plain", "plain"), ("postgres://u:p@h/d", "postgres://***@h/d"), ("aB3" * 9, "***"), ("/" + "aB3" * 9, "/" + "aB3" * 9)])
def test_redaction(spark, arg, want):
    assert spark.range(1).select(R.redact(F.lit(arg)).alias("x")).first().x == want

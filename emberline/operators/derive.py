"""Typed document rows to emissions of nodes, edges, references and warnings.

A document's facts become one array of emissions, exploded once: an emission may
hold a node, an edge to it, or both. All arrays are bounded by the document,
which is at most 2 MB of text. Only Kubernetes needs joins, because bindings,
accounts and roles meet across files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import values as V
from ..functions.session import cut_lineage
from .link import mesh
from .merge import ATTRS, FILE_KEY, NODE, PLACE, SEQ, make_seq, merge_nodes, place

EDGE = {"src": "string", "dst": "string", "rel": "string", "edge_file": "string", "edge_line": "int", "transitive": "boolean"}
FIELDS = {"step": "array<int>", **NODE, **{k: t for k, (t, _) in ATTRS.items()}, **EDGE, "ref": "string"}
EMISSION = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"
FILES, DECLARED, RUNNING, BOUND, REFS, INSIDE, PROMOTED = range(7)


@dataclass
class Emissions:
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame


@cache
def null(field: str) -> Column:
    return F.lit(None).cast(FIELDS[field]).alias(field)


def emit(step: list[Column | int], **fields: Column | str | int | bool | None) -> Column:
    """An emission struct; fields not named are null. step orders it inside its document."""
    given = {"transitive": True, **fields}
    given["step"] = F.array(*[s.cast("int") if isinstance(s, Column) else F.lit(s) for s in step])
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[as_column(given[k]).cast(t).alias(k) if given.get(k) is not None else null(k) for k, t in FIELDS.items()])


def give(step: list[Column | int], src: Column, target: Column, rel: Column | str, file: Column, line: Column | None) -> Column:
    """An edge to a resource struct, and the resource's node just before it."""
    return emit(step, id=target["id"], kind="resource", label=target["label"], severity=target["severity"], src=src, dst=target["id"], rel=rel, edge_file=file, edge_line=line)


def give_env(step: list[Column | int], src: Column, name: Column, inline: Column | None, file: Column, line: Column | None) -> Column:
    """A credential variable, one node by name wherever it occurs, and the edge that holds it."""
    id_ = F.concat(F.lit("secret:env:"), name)
    return emit(step, id=id_, kind="secret", label=name, severity=V.SECRET_SEVERITY, file=file, line=line, source="env var", inline_value_found=F.when(inline, True) if inline is not None else None, src=src, dst=id_, rel="holds", edge_file=file, edge_line=line)


def only(holds: Column, emission: Column) -> Column:
    return F.array(F.when(holds, emission))


def some(array: Column, make, holds=None) -> Column:
    """make(item, index) of every item of an array that may be null; null where holds says no."""
    full = F.transform(array, lambda x, i: F.when(holds(x), make(x, i)) if holds else make(x, i))
    return F.coalesce(full, F.array().cast(f"array<{EMISSION}>"))


def placed(rows: DataFrame, phase: int) -> DataFrame:
    """Emissions with their seq, from rows of file_key, doc, e (emission) and maybe sub (array of places)."""
    seq = make_seq(phase, F.col("file_key"), F.col("doc"), F.col("e.step"))
    if "sub" in rows.columns:
        seq = seq.withField("sub", F.col("sub"))
    return rows.where("e is not null").select("e.*", seq.alias("seq")).drop("step")


def split(emissions: DataFrame) -> Emissions:
    """Emissions as three tables: nodes, edges, references."""
    evidence = [F.col("edge_file").alias("file"), F.col("edge_line").alias("line")]
    nodes = emissions.where("id is not null").select(*NODE, *ATTRS, "seq")
    edges = emissions.where("src is not null and dst is not null").select("src", "dst", "rel", *evidence, "transitive", "seq")
    refs = emissions.where("src is not null and ref is not null").select("src", "ref", "rel", *evidence, "seq")
    return Emissions(nodes, edges, refs)


def exploded(rows: DataFrame, *arrays: Column) -> DataFrame:
    return rows.select("file_key", "doc", F.explode(F.concat(*arrays)).alias("e"))


def joined(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def derive_compose(docs: DataFrame) -> list[DataFrame]:
    top = docs.where("compose is not null").select("file_key", "doc", "rel", "compose.*")
    secret = lambda project, name: joined("secret:compose:", project, "/", name)
    label = lambda name: joined(name, " (compose secret)")
    rel = F.col("rel")
    declared = exploded(top, some(F.col("secrets"), lambda s, i: emit([0, i], id=secret(F.col("project"), s["name"]), kind="secret", label=label(s["name"]), severity=V.SECRET_SEVERITY, file=rel, line=s["line"], source="compose secret")))

    services = top.select("file_key", "doc", "rel", "project", F.posexplode("services").alias("i", "s")).withColumn("sid", joined("compose:", F.col("project"), "/", F.col("s.name")))
    s, sid, i = F.col("s"), F.col("sid"), F.col("i")
    at = lambda key: F.try_element_at(s["at"], F.lit(key))
    caps = F.transform(s["caps"], lambda c: F.regexp_replace(F.upper(c), "^CAP_", ""))
    plain_caps = F.filter(caps, lambda c: ~c.isin(*V.ESCAPE_CAPS))
    hint = s["labelled"] | F.exists(s["env"], lambda e: e["key"].isin(*V.LLM_KEYS))
    node = emit(
        [1, i, 0], id=sid, kind="identity", label=joined(s["name"], " (compose)"), severity=0, file=rel, line=s["line"], platform="docker-compose", image=s["image"],
        cap_add=F.when(F.size(plain_caps) > 0, plain_caps), aliases=F.array(joined("compose:", s["name"]), sid), agent_hint=F.when(hint, True), build_context=s["context"],
    )
    bound = F.transform(s["volumes"], lambda v: F.when(v["short"].isNotNull(), R.short_volume(v["short"], member=True)).otherwise(F.struct(v["source"].alias("source"), v["read_only"].alias("read_only"))))
    own_secret = lambda ref, k: emit(
        [1, i, 7, k], id=secret(F.col("project"), ref), kind="secret", label=label(ref), severity=V.SECRET_SEVERITY, file=rel, line=at("secrets"), source="compose secret",
        src=sid, dst=secret(F.col("project"), ref), rel="holds", edge_file=rel, edge_line=at("secrets"),
    )
    inside = exploded(
        services,
        F.array(node),
        only(s["privileged"], give([1, i, 1], sid, R.capability("host:root"), "privileged", rel, at("privileged"))),
        some(caps, lambda c, k: give([1, i, 2, k], sid, R.capability("host:root"), joined("cap_add ", c), rel, at("cap_add")), lambda c: c.isin(*V.ESCAPE_CAPS)),
        only(s["host_network"], give([1, i, 3], sid, R.capability("host:network"), "network_mode: host", rel, at("network_mode"))),
        only(s["host_pid"], give([1, i, 4], sid, R.capability("host:pid"), "pid: host", rel, at("pid"))),
        some(bound, lambda v, k: give([1, i, 5, k], sid, R.host_path(v["source"], F.coalesce(v["read_only"], F.lit(False))), "mounts", rel, at("volumes")), lambda v: v["source"].isNotNull()),
        some(s["env"], lambda e, k: give_env([1, i, 6, k], sid, e["key"], e["inline"], rel, at("environment")), lambda e: R.is_credential_name(e["key"])),
        some(s["secrets"], own_secret),
    )

    member = services.where("s.joins").select("file_key", "doc", "rel", "project", "sid", "i", F.posexplode("s.networks").alias("j", "net"), at("networks").alias("line"))
    shared = mesh(member.select(
        F.struct("file_key", "doc", "rel", joined("net:compose:", F.col("project"), "/", F.col("net")).alias("id"), joined("network ", F.col("net"), " (", F.col("project"), ")").alias("label")).alias("net"),
        F.col("sid").alias("member"), F.array("i", "j").alias("pos"), "line",
    ))
    net, pos = F.col("net"), [F.get(F.col("pos"), F.lit(0)), F.get(F.col("pos"), F.lit(1))]
    attach = emit([2, *pos, 0], id=net["id"], kind="resource", label=net["label"], severity=V.NETWORK_SEVERITY, src=F.col("member"), dst=net["id"], rel="attached to", edge_file=net["rel"], edge_line=F.col("line"))
    can_reach = emit([2, F.col("last"), *pos, 1], src=net["id"], dst=F.col("member"), rel="can reach", edge_file=net["rel"], edge_line=F.col("line"), transitive=False)
    meshed = shared.select("net.file_key", "net.doc", F.when(F.col("kind") == "attached", attach).otherwise(can_reach).alias("e"))
    return [placed(x, FILES) for x in (declared, inside, meshed)]


def derive_mcp(docs: DataFrame) -> list[DataFrame]:
    top = docs.where("mcp is not null").select("file_key", "doc", "rel", "mcp.*").withColumn("agent", joined("agent:mcp:", F.col("rel")))
    rel, agent = F.col("rel"), F.col("agent")
    client = F.coalesce(R.lookup(V.CLIENTS, R.base_name(rel)), F.lit("MCP client"))
    clients = exploded(top, F.array(emit([0], id=agent, kind="agent", label=joined(client, " (", rel, ")"), severity=0, file=rel, line=F.col("line"), source="mcp config")))
    servers = top.select("file_key", "doc", "rel", "agent", F.posexplode("servers").alias("i", "s")).withColumn("tool", joined("mcp:", rel, ":", F.col("s.name")))
    s, tool, i, line = F.col("s"), F.col("tool"), F.col("i"), F.col("s.line")
    masked = R.redact_args(s["args"])
    node = emit(
        [1, i, 0], id=tool, kind="tool", label=joined(s["name"], " (MCP server)"), severity=0, file=rel, line=line, source="mcp server", command=F.nullif(s["command"], F.lit("")),
        args=F.when(F.size(masked) > 0, masked), url=R.redact(s["url"]), aliases=F.array(joined("mcp:", s["name"])), src=agent, dst=tool, rel="can call", edge_file=rel, edge_line=line,
    )
    host = R.url_host(s["url"])
    remote = emit([1, i, 3], id=joined("net:remote:", host), kind="resource", label=joined("Remote MCP endpoint ", host), severity=V.NETWORK_SEVERITY, src=tool, dst=joined("net:remote:", host), rel="connects to", edge_file=rel, edge_line=line, transitive=False)
    found = R.classify(s["command"], s["args"], F.transform(s["env"], lambda e: e["key"]))
    inside = exploded(
        servers,
        F.array(node),
        some(s["env"], lambda e, k: give_env([1, i, 1, k], tool, e["key"], None, rel, e["line"]), lambda e: R.is_credential_name(e["key"]) | (e["key"] == "KUBECONFIG")),
        some(found, lambda r, k: give([1, i, 2, k], tool, r["target"], r["why"], rel, line)),
        only(s["url"].isNotNull(), remote),
    )
    return [placed(x, FILES) for x in (clients, inside)]


def derive_registry(docs: DataFrame) -> list[DataFrame]:
    """Agents of registries, and their tools, which the source has merged with the shared definitions."""
    rel = F.col("rel")
    agents = docs.where("registry is not null").select("file_key", "doc", "rel", F.posexplode("registry.agents").alias("i", "a")).withColumn("agent", joined("agent:registry:", rel, ":", F.col("a.name")))
    a, agent, i = F.col("a"), F.col("agent"), F.col("i")
    heads = exploded(
        agents,
        F.array(emit([i, 0], id=agent, kind="agent", label=a["name"], severity=0, file=rel, line=a["line"], source="tool registry")),
        only(a["runs_as"].isNotNull(), emit([i, 1], src=agent, ref=a["runs_as"], rel="runs as", edge_file=rel, edge_line=a["runs_line"])),
    )
    tools = agents.select("file_key", "doc", "rel", "agent", "i", F.posexplode("a.tools").alias("j", "t")).withColumn("tool", joined("tool:", rel, ":", F.col("t.name")))
    t, j, tool, line = F.col("t"), F.col("j"), F.col("tool"), F.col("t.line")
    kind = F.lower(F.coalesce(F.nullif(t["type"], F.lit("")), t["name"]))
    cap, writes = R.lookup(V.REGISTRY_TYPES, kind), R.lookup(V.REGISTRY_FILES, kind)
    is_mcp = t["mcp"].isNotNull()
    node = emit([i, 2, j, 0], id=tool, kind="tool", label=t["name"], severity=0, file=rel, line=line, type=t["type"], aliases=F.array(joined("tool:", t["name"])), src=agent, dst=tool, rel="can call", edge_file=rel, edge_line=line)
    inside = exploded(
        tools,
        only(is_mcp, emit([i, 2, j, 0], src=agent, ref=joined("mcp:", t["mcp"]), rel="can call", edge_file=rel, edge_line=line)),
        only(~is_mcp, node),
        only(~is_mcp & cap.isNotNull(), give([i, 2, j, 1], tool, R.capability(cap), kind, rel, line)),
        only(~is_mcp & cap.isNull() & writes.isNotNull(), give([i, 2, j, 1], tool, R.fs_path(t["path"], writes), kind, rel, line)),
        some(F.when(~is_mcp, t["creds"]), lambda c, k: give_env([i, 2, j, 2, k], tool, c, None, rel, line)),
    )
    return [placed(x, FILES) for x in (heads, inside)]


def derive_code(docs: DataFrame) -> list[DataFrame]:
    facts = docs.where("code is not null").select("file_key", "doc", "rel", "abspath", F.posexplode("code").alias("i", "c"))
    c, i, rel = F.col("c"), F.col("i"), F.col("rel")
    op, line = c["op"], c["line"]
    tool = lambda key: joined("tool:", rel, ":", key)
    agent = joined("agent:code:", rel, ":", c["key"])
    class_cap = R.lookup(V.TOOL_CLASSES, c["name"])
    class_target = F.when(class_cap.startswith("fs:"), R.fs_path(F.coalesce(c["label"], F.lit(".")), class_cap == "fs:write")).otherwise(R.capability(class_cap))
    made = lambda label, source: emit([i, 0], id=tool(c["key"]), kind="tool", label=label, severity=0, file=rel, line=line, source=source)
    calls = F.array(*[F.struct(F.lit(k).alias("prefix"), F.lit(v).alias("cap")) for k, v in V.BODY_CALLS.items()])
    factory_cap = R.lookup({k: v for k, v in V.FACTORIES.items() if v}, c["name"])
    inside = exploded(
        facts,
        only(op == "tool", made(c["label"], "python @tool")),
        some(F.when(op == "call", calls), lambda p, k: give([i, 1, k], tool(c["key"]), R.capability(p["cap"]), joined("calls ", c["name"], "()"), rel, line), lambda p: (c["name"] == p["prefix"]) | c["name"].startswith(joined(p["prefix"], "."))),
        only(op == "class", made(c["name"], "langchain tool")),
        only(op == "class", give([i, 1], tool(c["key"]), class_target, c["name"], rel, line)),
        only(op == "load", made(joined(c["name"], " (load_tools)"), None)),
        only(op == "load", give([i, 1], tool(c["key"]), R.capability(R.lookup(V.LOADED_TOOLS, c["name"])), "load_tools", rel, line)),
        only(op == "agent", emit([i, 0], id=agent, kind="agent", label=c["label"], severity=0, file=rel, line=line, source="python agent", code_path=F.col("abspath"))),
        only(op == "uses", emit([i, 0], src=agent, dst=tool(c["name"]), rel="can call", edge_file=rel, edge_line=line)),
        only((op == "factory") & factory_cap.isNotNull(), give([i, 0], agent, R.capability(factory_cap), c["name"], rel, line)),
    )
    return [placed(inside, FILES)]


def account_id(ns: Column, name: Column) -> Column:
    return joined("k8s:sa:", ns, "/", name)


def account(step: list[Column | int], ns: Column, name: Column, **more) -> Column:
    id_ = account_id(ns, name)
    return emit(step, id=id_, kind="identity", label=joined("sa ", ns, "/", name), severity=0, platform="kubernetes", namespace=ns, aliases=F.array(id_, joined("k8s:", ns, "/", name)), **more)


def secret_node(ns: Column, name: Column) -> dict:
    return {"id": joined("secret:k8s:", ns, "/", name), "kind": "secret", "label": joined(name, " (k8s secret, ", ns, ")"), "severity": V.SECRET_SEVERITY, "source": "kubernetes Secret"}


def spread_pairs(few: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Every row of few beside every row of many, where that is the result: cluster-wide grants by secrets or accounts.

    few is copied into parts and many is dealt by a hash of key, so it is an equi-join over that many tasks; there are as many parts as
    the session has shuffle partitions, and 64 at least.
    """
    parts = max(64, int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return copies.join(many.withColumn("_part", F.pmod(F.hash(key), F.lit(parts))), "_part").drop("_part")


def derive_k8s(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Emissions of all manifests, and warnings (message, seq) about bindings to unknown roles."""
    objects = docs.where("k8s is not null").select("file_key", "doc", "rel", F.posexplode("k8s").alias("i", "o"))
    o, i, rel, ns, name = F.col("o"), F.col("i"), F.col("rel"), F.col("o.ns"), F.col("o.name")
    kind = o["kind"]
    declared = placed(exploded(
        objects,
        only(kind == "ServiceAccount", account([i, 0], ns, name, file=rel, line=o["line"], automount=F.when(o["no_automount"], False))),
        only(kind == "Secret", emit([i, 0], **secret_node(ns, name), file=rel, line=o["line"], keys=o["keys"], type=o["secret_type"])),
    ), DECLARED)

    # Workloads. Whether an account's token is mounted may be said by the pod or by the account.
    closed = objects.where("o.no_automount").select(ns.alias("sa_ns"), name.alias("sa_name")).distinct().withColumn("closed", F.lit(True))
    work = objects.where(kind.isin(*V.WORKLOAD_KINDS)).join(closed, (ns == F.col("sa_ns")) & (o["account"] == F.col("sa_name")), "left")
    work = work.withColumn("wid", joined("k8s:", F.lower(kind), ":", ns, "/", name))
    wid, line, sa = F.col("wid"), o["line"], account_id(ns, o["account"])
    hint = o["labelled"] | F.exists(o["containers"], lambda c: F.exists(c["env"], lambda e: e["name"].isin(*V.LLM_KEYS)))
    mounted = F.coalesce(o["automount"], ~F.coalesce("closed", F.lit(False)))
    node = emit([i, 0], id=wid, kind="identity", label=joined(kind, " ", ns, "/", name), severity=0, file=rel, line=line, platform="kubernetes", namespace=ns, aliases=F.array(joined("k8s:", ns, "/", name), wid), agent_hint=F.when(hint, True))
    runs = account([i, 1], ns, o["account"], src=wid, dst=sa, rel=F.when(mounted, "runs as (token mounted)").otherwise("assigned (token not mounted)"), edge_file=rel, edge_line=F.when(mounted, o["account_line"]).otherwise(line), transitive=mounted)
    use = lambda step, secret, at: F.when(secret.isNotNull(), emit(step, **secret_node(ns, secret), src=wid, dst=joined("secret:k8s:", ns, "/", secret), rel="mounts secret", edge_file=rel, edge_line=at))

    def container(c: Column, k: Column) -> Column:
        root = c["privileged"] | F.arrays_overlap(c["caps"], R.texts(("SYS_ADMIN", "ALL")))
        held = lambda e: ~e["by_ref"] & R.is_credential_name(e["name"])
        return F.concat(
            only(root, give([i, 6, k, 0], wid, R.capability("host:root"), "privileged container", rel, c["line"])),
            some(c["env"], lambda e, n: F.when(e["by_ref"], use([i, 6, k, 1, n], e["ref"], e["line"])).when(held(e), give_env([i, 6, k, 1, n], wid, e["name"], e["has_value"], rel, e["line"]))),
            some(c["env_from"], lambda e, n: use([i, 6, k, 2, n], e["secret"], e["line"])),
        )

    running = placed(exploded(
        work,
        F.array(node, runs),
        only(o["host_network"], give([i, 2], wid, R.capability("host:network"), "hostNetwork", rel, o["host_network_line"])),
        only(o["host_pid"], give([i, 3], wid, R.capability("host:pid"), "hostPID", rel, o["host_pid_line"])),
        F.flatten(F.transform(o["volumes"], lambda v, k: F.array(
            F.when(v["path"].isNotNull(), give([i, 4, k, 0], wid, R.host_path(v["path"], F.lit(False)), "hostPath", rel, v["line"])), use([i, 4, k, 1], v["secret"], v["line"])))),
        F.flatten(F.transform(o["containers"], container)),
    ), RUNNING)

    # Bindings. A role of a later object replaces an earlier one; built-in cluster roles fill in.
    order = F.struct("file_key", "doc", "i")
    role_key = lambda k, scope, n: joined(k, ":", scope, "/", n)
    roles = objects.where(kind.isin("Role", "ClusterRole")).groupBy(role_key(kind, F.when(kind == "Role", ns).otherwise(""), name).alias("key")).agg(F.max_by("o.rules", order).alias("rules"))
    cluster_ref = F.coalesce(o["ref_kind"] == "ClusterRole", F.lit(False))
    bindings = objects.where(kind.isin(*V.BINDING_KINDS)).withColumns({
        "ref_name": F.coalesce(o["ref_name"], F.lit("None")), "ref_kind": F.coalesce(o["ref_kind"], F.lit("None")),
        "scope": F.when(kind == "ClusterRoleBinding", "cluster").otherwise(ns), "cluster_ref": cluster_ref,
    })
    bindings = bindings.withColumn("key", F.when(F.col("cluster_ref"), role_key(F.lit("ClusterRole"), F.lit(""), F.col("ref_name"))).otherwise(role_key(F.lit("Role"), ns, F.col("ref_name")))).join(roles, "key", "left")
    builtin = F.lit(None)
    for role, (verbs, resources) in V.BUILTIN_ROLES.items():
        rule = F.struct(R.texts(verbs).alias("verbs"), R.texts(resources).alias("resources"), F.array().cast("array<string>").alias("names"))
        builtin = F.when(F.col("cluster_ref") & (F.col("ref_name") == role), F.array(rule)).otherwise(builtin)
    bindings = bindings.withColumn("rules", F.coalesce("rules", builtin))
    unknown = bindings.where("rules is null").select(
        F.format_string("%s: %s %s references unknown %s %s", rel, kind, name, F.col("ref_kind"), F.col("ref_name")).alias("message"), make_seq(BOUND, F.col("file_key"), F.col("doc"), F.array("i")).alias("seq"))
    known = bindings.where("rules is not null")

    subjects = known.select("file_key", "doc", "rel", "i", "o", "ref_kind", "ref_name", "scope", "rules", F.posexplode("o.subjects").alias("n", "s")).select("*", F.col("s.kind").alias("s_kind"), F.coalesce("s.name", F.lit("None")).alias("s_name"), F.col("s.ns").alias("s_ns"))
    direct = subjects.where("s_kind = 'ServiceAccount'")
    direct_accounts = placed(exploded(direct, F.array(account([i, 0, F.col("n")], F.col("s_ns"), F.col("s_name")))), BOUND)
    # Groups hold the accounts known at that point: those first emitted before this subject.
    accounts = cut_lineage(declared.unionByName(running).unionByName(direct_accounts).where("id like 'k8s:sa:%'").select(*NODE, "namespace", "seq"))
    known_accounts = merge_nodes(accounts, {"namespace": ATTRS["namespace"]}).select(F.col("id").alias("subject"), F.col("namespace").alias("sa_ns"), F.col("seq").alias("sa_seq"))
    groups = subjects.where("s_kind = 'Group' and s_name like 'system:serviceaccounts%'").withColumns({
        "group_ns": F.when(F.size(F.split("s_name", ":")) == 3, F.get(F.split("s_name", ":"), F.lit(2))), "at": make_seq(BOUND, F.col("file_key"), F.col("doc"), F.array("i", F.lit(0), F.col("n")))})
    keep = ["file_key", "doc", "rel", "i", "o", "ref_kind", "ref_name", "scope", "rules", "subject"]
    local = groups.where("group_ns is not null").join(known_accounts, F.col("group_ns") == F.col("sa_ns")).where("sa_seq < at").select(keep)
    # The group of all accounts meets every account: the result itself is bindings times accounts.
    everyone = spread_pairs(groups.where("group_ns is null"), known_accounts, "subject").where("sa_seq < at").select(keep)
    bound_subjects = direct.withColumn("subject", account_id(F.col("s_ns"), F.col("s_name"))).select(keep).unionByName(local).unionByName(everyone)

    def ruled(df: DataFrame) -> DataFrame:
        rule = df.select("*", F.posexplode("rules").alias("r", "rule"))
        sorted_set = lambda c: F.array_sort(F.array_distinct(c))
        rule = rule.withColumns({"verbs": sorted_set(F.col("rule.verbs")), "resources": sorted_set(F.col("rule.resources")), "names": F.col("rule.names")})
        verb, what = R.starred(F.col("verbs")), R.starred(F.col("resources"))
        return rule.withColumns({"verb": verb, "what": what, "pid": joined("k8s:perm:", F.col("scope"), ":", what, ":", verb, ":", F.array_join("names", ","))})

    cluster = F.col("scope") == "cluster"
    where = F.when(cluster, "cluster-wide").otherwise(joined("in ", F.col("scope")))
    everything = (F.col("verb") == "*") & (F.col("what") == "*")
    label = F.when(everything, joined("ALL verbs on ALL resources ", where, F.when(cluster, " (cluster-admin)").otherwise(""))).otherwise(joined(F.col("verb"), " ", F.col("what"), " ", where))
    label = joined(label, F.when(F.size("names") > 0, joined(" (only ", F.array_join("names", ", "), ")")).otherwise(""))
    r = F.col("r")
    permissions = ruled(known)
    permitted = placed(exploded(permissions, F.array(emit([i, 1, r, 0], id=F.col("pid"), kind="resource", label=label, severity=R.permission_severity(cluster, F.col("verbs"), F.col("resources")), verbs=F.col("verbs"), resources=F.col("resources"), scope=F.col("scope"), role=F.col("ref_name")))), BOUND)

    pool = objects.where(kind == "Secret").groupBy(ns.alias("pool_ns"), name.alias("secret")).agg(F.min(order).alias("first"))
    heads = pool.groupBy("pool_ns").agg(F.min("first").alias("head"))
    pool = pool.join(heads, "pool_ns")
    readers = permissions.where(R.reads_secrets(F.col("verbs"), F.col("resources"))).groupBy("pid", "scope", "names").agg(F.min_by(F.struct("file_key", "doc", "i", "r"), F.struct("file_key", "doc", "i", "r")).alias("at"))
    named = (F.size("names") == 0) | F.array_contains(F.col("names"), F.col("secret"))
    in_scope = readers.where("scope <> 'cluster'").join(pool, F.col("scope") == F.col("pool_ns"))
    all_scopes = spread_pairs(readers.where("scope = 'cluster'"), pool, "secret")
    as_place = lambda c: place(make_seq(DECLARED, c["file_key"], c["doc"], F.array(c["i"])))
    read = in_scope.unionByName(all_scopes).where(named).select(
        "at.file_key", "at.doc", emit([F.col("at.i"), 1, F.col("at.r"), 1], src=F.col("pid"), dst=joined("secret:k8s:", F.col("pool_ns"), "/", F.col("secret")), rel="can read").alias("e"), F.array(as_place(F.col("head")), as_place(F.col("first"))).alias("sub"))
    granted = ruled(bound_subjects)
    why = joined(o["kind"], " ", o["name"], " -> ", F.col("ref_kind"), " ", F.col("ref_name"))
    bound = placed(exploded(granted, F.array(emit([i, 1, r, 2], src=F.col("subject"), dst=F.col("pid"), rel=why, edge_file=rel, edge_line=o["ref_line"]))), BOUND)
    return [declared, running, direct_accounts, permitted, placed(read, BOUND), bound], unknown


def skipped_kinds(docs: DataFrame) -> DataFrame:
    """One warning that counts manifest kinds which are not read: message, seq. None if there are none."""
    counts = docs.select(F.explode("skipped").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    listed = counts.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s x%d", "kind", "n"))), ", ").alias("kinds")).where("kinds <> ''")
    seq = make_seq(DECLARED, F.array().cast(FILE_KEY), F.lit(-1), F.array(F.lit(0)))
    return listed.select(joined("skipped unsupported Kubernetes kinds: ", F.col("kinds")).alias("message"), seq.alias("seq"))


def parse_warnings(docs: DataFrame) -> DataFrame:
    return docs.select("file_key", "doc", F.posexplode("warnings").alias("i", "message")).select("message", make_seq(FILES, F.col("file_key"), F.col("doc"), F.array("i")).alias("seq"))

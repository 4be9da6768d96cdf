"""Column builders: classification, severities, redaction and text helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def texts(items: Iterable[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """The value of a small fixed table at key, null where it has none."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def any_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def rating(severity: Column) -> Column:
    return F.when(severity >= 9, "critical").when(severity >= 7, "high").when(severity >= 4, "medium").otherwise("low")


def is_credential_name(name: Column) -> Column:
    """True for names that hold a credential word, in any case, unless their ending says otherwise."""
    return name.rlike(f"(?iu)({any_of(V.CREDENTIAL_WORDS)})") & ~name.rlike(f"(?iu)({any_of(V.NOT_CREDENTIAL_ENDINGS)})\\n?\\z")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def evidence(file: Column, line: Column) -> Column:
    """file:line, or the file alone where there is no line (or line 0 or an empty file)."""
    return F.when((file != "") & (line != 0), F.concat_ws(":", file, line.cast("string"))).otherwise(file)


def url_host(url: Column) -> Column:
    """The lower-case host of a URL, without user information, brackets and port; 'remote' where there is none."""
    authority = F.regexp_extract(url, r"^[^/?#]*?//([^/?#]*)", 1)
    host = F.regexp_extract(F.substring_index(authority, "@", -1), r"^(?:\[([^\]]*)\]|([^:\[]*))", 0)
    host = F.lower(F.regexp_replace(host, r"[\[\]]", ""))
    return F.when(F.coalesce(host, F.lit("")) == "", "remote").otherwise(host)


# Resources: structs of id, label and severity.


def resource(id_: Column, label: Column, severity: Column) -> Column:
    return F.struct(id_.alias("id"), label.alias("label"), severity.cast("int").alias("severity"))


def capability(name: Column | str) -> Column:
    if isinstance(name, str):
        label, severity = V.CAPABILITIES[name]
        return resource(F.lit(f"cap:{name}"), F.lit(label), F.lit(severity))
    label = lookup({k: v[0] for k, v in V.CAPABILITIES.items()}, name)
    severity = lookup({k: v[1] for k, v in V.CAPABILITIES.items()}, name)
    return resource(F.concat(F.lit("cap:"), name), label, severity)


def host_path_severity(path: Column, read_only: Column) -> Column:
    """4, or 8 below sensitive prefixes, less 2 if read-only. The prefix needs no path boundary."""
    sensitive = path.rlike(V.SENSITIVE_PATHS)
    return F.when(sensitive, 8).otherwise(4) - F.when(read_only, 2).otherwise(0)


def host_path_capability(path: Column) -> Column:
    """The capability that a mount of path amounts to, null for other paths."""
    socket = F.regexp_replace(path, "/+$", "").isin(*V.DOCKER_SOCKETS)
    return F.when(socket, "host:docker").when(path.isin(*V.HOST_ROOTS), "host:root")


def host_path(path: Column, read_only: Column) -> Column:
    mode = F.when(read_only, "ro").otherwise("rw")
    plain = resource(F.concat(F.lit("hostpath:"), mode, F.lit(":"), path), F.concat(F.lit("Host path "), path, F.lit(" ("), mode, F.lit(")")), host_path_severity(path, read_only))
    known = host_path_capability(path)
    return F.when(known == "host:docker", capability("host:docker")).when(known == "host:root", capability("host:root")).otherwise(plain)


def fs_severity(path: Column, write: Column) -> Column:
    broad = path.isin(*V.BROAD_ROOTS) | path.rlike(V.BROAD_ROOT)
    return F.when(write, 5).otherwise(3) + F.when(broad, 3).otherwise(0)


def fs_path(path: Column, write: Column) -> Column:
    mode = F.when(write, "write").otherwise("read")
    return resource(F.concat(F.lit("fs:"), mode, F.lit(":"), path), F.concat(F.lit("Filesystem "), mode, F.lit(": "), path), fs_severity(path, write))


def short_volume(text: Column, member: bool) -> Column:
    """source and read_only of a host:target[:mode] mount; a null source for named volumes.

    member: the mode says read-only only as a whole comma-separated word; else anywhere in it.
    """
    parts = F.split(text, ":", -1)
    mode = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    read_only = F.array_contains(F.split(mode, ",", -1), "ro") if member else mode.contains("ro")
    first = F.get(parts, F.lit(0))
    bound = (F.size(parts) >= 2) & F.substring(first, 1, 1).isin("/", ".", "~", "$")
    return F.struct(F.when(bound, first).alias("source"), read_only.alias("read_only"))


# Kubernetes permissions.


def permission_severity(cluster: Column, verbs: Column, resources: Column) -> Column:
    star_verb, star_resource = F.array_contains(verbs, "*"), F.array_contains(resources, "*")
    write = F.size(F.array_except(verbs, texts(("get", "list", "watch")))) > 0
    rbac = F.arrays_overlap(resources, texts(V.RBAC_RESOURCES)) | F.arrays_overlap(verbs, texts(V.RBAC_VERBS))
    escalating = F.arrays_overlap(resources, texts(V.ESCALATING_RESOURCES)) | star_resource
    reads = F.arrays_overlap(verbs, texts(V.READ_VERBS))
    return (
        F.when(star_verb & star_resource, F.when(cluster, 9).otherwise(7))
        .when(write & rbac, 8)
        .when(write & escalating, F.when(cluster, 7).otherwise(6))
        .when(F.array_contains(resources, "secrets") | star_resource, F.when(reads, 6).otherwise(4))
        .otherwise(F.when(write, 4).otherwise(2))
    )


def starred(items: Column) -> Column:
    return F.when(F.array_contains(items, "*"), "*").otherwise(F.array_join(items, ","))


def reads_secrets(verbs: Column, resources: Column) -> Column:
    return F.arrays_overlap(verbs, texts(V.READ_VERBS)) & F.arrays_overlap(resources, texts(("secrets", "*")))


# Redaction.


def redact(arg: Column) -> Column:
    """arg without user information in URLs, values of secret-like flags and long opaque tokens."""
    arg = F.regexp_replace(arg, V.URL_USER, "$1***@")
    opaque = arg.rlike(V.OPAQUE) & arg.rlike("[a-z]") & arg.rlike("[A-Z]") & arg.rlike("[0-9]") & ~arg.startswith("/")
    return F.when(arg.rlike(V.SECRET_FLAG), F.concat(F.regexp_extract(arg, V.SECRET_FLAG, 1), F.lit("***"))).when(opaque, "***").otherwise(arg)


def redact_args(args: Column) -> Column:
    """args, each redacted; what follows a credential-named flag is masked whole."""

    def one(all_: Column, arg: Column, i: Column) -> Column:
        before = F.coalesce(F.get(all_, i - 1), F.lit(""))
        named = F.replace(F.regexp_replace(before, "^-+", ""), F.lit("-"), F.lit("_"))
        return F.when(before.startswith("-") & is_credential_name(named), "***").otherwise(redact(arg))

    return bound(args, lambda all_: F.transform(all_, lambda arg, i: one(all_, arg, i)))


# Launch commands.


def reason(target: Column, why: str) -> Column:
    return F.struct(target.alias("target"), F.lit(why).alias("why"))


def docker_reason(args: Column, arg: Column, i: Column) -> Column:
    """What one argument of docker run gives, null for nothing. A flag's value may be the next argument."""
    value = F.coalesce(F.get(args, i + 1), F.lit(""))
    spec = F.when(arg.contains("="), F.regexp_extract(arg, r"(?s)^[^=]*=(.*)", 1)).otherwise(value)
    volume = short_volume(spec, member=False)
    mounts = arg.isin("-v", "--volume") | arg.startswith("-v=") | arg.startswith("--volume=")
    host = value == "host"
    return (
        F.when(mounts, F.when(volume["source"].isNotNull(), reason(host_path(volume["source"], volume["read_only"]), "docker -v mount")))
        .when(arg == "--privileged", reason(capability("host:root"), "docker --privileged"))
        .when((arg.isin("--network", "--net") & host) | arg.isin("--network=host", "--net=host"), reason(capability("host:network"), "docker --network host"))
        .when((arg == "--pid=host") | ((arg == "--pid") & host), reason(capability("host:pid"), "docker --pid host"))
    )


def classify(command: Column, args: Column, env_names: Column) -> Column:
    """What a launch command gives: array of (target, why), in a fixed order; several may hold."""
    read = F.struct(command.alias("command"), args.alias("args"), redact_args(args).alias("masked"))
    return bound(read, lambda r: reasons(r["command"], r["args"], r["masked"], env_names))


def reasons(command: Column, args: Column, masked: Column, env_names: Column) -> Column:
    text = F.lower(F.concat_ws(" ", command, args))
    program = F.lower(base_name(command))
    hinted = lambda words: text.rlike(any_of(words))
    inline = program.rlike("^(python|node)") & F.arrays_overlap(args, texts(("-c", "-e")))
    # Arguments after the one that names the server; none at all (or no such argument) means the working folder.
    at = F.array_position(F.transform(args, lambda a: a.contains("server-filesystem")), True)
    rest = F.when(at > 0, F.slice(args, (at + 1).cast("int"), F.greatest(F.size(args) - at, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<string>"))
    # A root is named as it is masked in the node's args, so that no secret becomes part of an id.
    plain = bound(at, lambda k: F.filter(F.transform(args, lambda a, i: F.when((i >= k) & ~a.startswith("-"), F.get(masked, i))), lambda a: a.isNotNull()))
    roots = F.when(F.size(rest) == 0, texts(["."])).otherwise(plain)
    one = lambda holds, cap, why: F.array(F.when(holds, reason(capability(cap), why)))
    found = F.concat(
        one(program.isin(*V.SHELLS) | hinted(V.SHELL_HINTS), "exec:shell", "runs shell commands"),
        one(inline, "exec:code", "runs inline code"),
        F.when(text.contains("server-filesystem"), F.transform(roots, lambda r: reason(fs_path(r, F.lit(True)), "filesystem root"))).otherwise(F.array().cast("array<struct<target:struct<id:string,label:string,severity:int>,why:string>>")),
        one(hinted(V.SQL_HINTS), "data:sql", "database access"),
        one(hinted(V.HTTP_HINTS), "net:http", "makes web requests"),
        one(hinted(V.K8S_HINTS) | F.array_contains(env_names, "KUBECONFIG"), "k8s:kubeconfig", "uses kubeconfig"),
        F.when(base_name(command) == "docker", F.transform(args, lambda a, i: docker_reason(args, a, i))).otherwise(F.array().cast("array<struct<target:struct<id:string,label:string,severity:int>,why:string>>")),
    )
    return F.filter(found, lambda r: r.isNotNull())

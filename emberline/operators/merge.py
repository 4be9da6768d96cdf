"""Upserts: many emissions of a node or edge become one row, in emission order.

Every emission carries seq, a struct that orders emissions globally without a
global sort: phase, file_key (array of folder flag and name, so that a folder's
files come before its sub-folders), document, step inside the document, and sub
for orders that come from other emissions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_KEY = "array<struct<is_dir:boolean,name:string>>"
PLACE = f"struct<phase:int,file_key:{FILE_KEY},doc:int,step:array<int>>"
SEQ = f"struct<phase:int,file_key:{FILE_KEY},doc:int,step:array<int>,sub:array<{PLACE}>>"

#: Attributes by the way later emissions change them. last: the last that is not null. union: the first
#: list, then what later lists add to those before. append: all values in order. ever: true once true.
ATTRS = {
    "platform": ("string", "last"), "image": ("string", "last"), "source": ("string", "last"), "namespace": ("string", "last"),
    "automount": ("boolean", "last"), "type": ("string", "last"), "scope": ("string", "last"), "role": ("string", "last"),
    "command": ("string", "last"), "url": ("string", "last"), "build_context": ("string", "last"), "code_path": ("string", "last"),
    "cap_add": ("array<string>", "append"), "keys": ("array<string>", "union"), "verbs": ("array<string>", "union"),
    "resources": ("array<string>", "union"), "args": ("array<string>", "union"), "aliases": ("array<string>", "union"),
    "inline_value_found": ("boolean", "ever"), "agent_hint": ("boolean", "ever"),
}
PRIVATE = ("aliases", "agent_hint", "build_context", "code_path")
NODE = {"id": "string", "kind": "string", "label": "string", "severity": "int", "file": "string", "line": "int"}


def place(seq: Column) -> Column:
    """A seq as an element of another seq's sub."""
    return F.struct(*[seq[k].alias(k) for k in ("phase", "file_key", "doc", "step")]).cast(PLACE)


def make_seq(phase: int, file_key: Column, doc: Column, step: Column, sub: list[Column] | None = None) -> Column:
    return F.struct(F.lit(phase).alias("phase"), file_key.alias("file_key"), doc.alias("doc"), step.alias("step"), F.array(*(sub or [])).alias("sub")).cast(SEQ)


def first_value(value: Column, seq: Column, where: Column) -> Column:
    return F.min_by(F.when(where, value), F.when(where, seq))


def merge_nodes(emissions: DataFrame, attrs: dict[str, tuple[str, str]] = ATTRS) -> DataFrame:
    """One row per id: id, kind, label, severity, file, line, the attributes, seq.

    The first emission gives kind, label and position, the highest severity counts, and the first
    emission with a file gives file and line. An empty input gives no rows; null ids are dropped.
    All but the ordered list attributes combine map-side; lists are gathered per node, which holds
    what one node owns (aliases, keys, verbs).
    """
    seq = F.col("seq")
    out = [
        F.min_by(F.struct("kind", "label"), seq).alias("first"), F.max("severity").alias("severity"),
        first_value(F.struct("file", "line"), seq, F.col("file").isNotNull()).alias("cited"), F.min("seq").alias("seq"),
    ]
    for name, (_, way) in attrs.items():
        value, present = F.col(name), F.col(name).isNotNull()
        if way == "last":
            merged = F.max_by(F.when(present, value), F.when(present, seq))
        elif way == "ever":
            merged = F.when(F.bool_or(value), True)
        else:
            parts = F.array_sort(F.collect_set(F.when(present, F.struct("seq", name))))
            unseen = F.aggregate(parts[name], F.array().cast(attrs[name][0]), lambda have, more: F.concat(have, F.filter(more, lambda x: ~F.array_contains(have, x))))
            merged = F.when(F.size(parts) > 0, unseen if way == "union" else F.flatten(parts[name]))
        out.append(merged.alias(name))
    merged = emissions.where("id is not null").groupBy("id").agg(*out)
    return merged.select("id", "first.kind", "first.label", "severity", "cited.file", "cited.line", *attrs, "seq")


def first_edges(emissions: DataFrame) -> DataFrame:
    """One row per (src, dst, rel): the first emission's evidence and transitivity. Self loops and null ends go."""
    best = emissions.where("src <> dst").groupBy("src", "dst", "rel").agg(F.min_by(F.struct("file", "line", "transitive"), F.col("seq")).alias("first"), F.min("seq").alias("seq"))
    return best.select("src", "dst", "rel", "first.file", "first.line", "first.transitive", "seq")

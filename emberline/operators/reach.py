"""First-discovery reachability from many starts at once, scores, findings and ranking.

Every start explores breadth first. A node counts for a start by the edge that
meets it first; it hands on its own access only if that edge is transitive.
First means: least level, then the parent met first, then the parent's earlier
edge. Nodes are numbered once. Edges get a number in the order of their source's edges, and the rows that
a level hands on get one in the order of discovery, both by range partitions and
without a window, so that a level is settled by fixed-width minimums. Names and evidence are joined at the end, to what is asked for alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.rules import evidence, rating
from ..functions.session import Scratch, cut_lineage

HOP = ("src", "dst", "rel", "file", "line")


def in_order(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a number that grows with the order; gaps are usual. It is settled once the rows are stored."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


@dataclass
class Numbered:
    """A graph in numbers, stored. ids: id, n, goes, weight. steps: src, dst, code, mark, fan, kind. edges: edge, at, and the edge's own columns; only with evidence.

    code orders the edges of a source. mark is 8 times the target's severity if positive, plus 4 if more than one step of CORE leads to
    the target, plus 2 if the edge is transitive, plus 1 if the search goes on from its target. A step the search does not go on from is of kind FAN where it is the only
    such step to its target, of kind LEAF where no step to its target is gone on from; all others are CORE. fan of a CORE step is the source of its target's FAN step.
    """

    ids: DataFrame
    steps: DataFrame
    edges: DataFrame | None


CORE, FAN, LEAF = 0, 1, 2
#: Places of a level begin at its number times so much, so that places of all levels are in the order of discovery.
LEVEL_BITS = 50
#: Rows of a table that may go to all tasks, and those of one of three numbers.
SMALL, SMALL_THIN = 100_000, 1_000_000


def spread(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, marked to go to all tasks if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbers(edges: DataFrame, starts: DataFrame, nodes: DataFrame | None, scratch: Scratch, number: Callable[[Column], Column] | None = None) -> tuple[DataFrame, Callable[[Column], Column]]:
    """ids and the number of an id: a hash, under the first seed for which no two ids meet. So edges get numbers without a join."""
    rows = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("goes")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("goes"))))).withColumn("weight", F.lit(0))
    rows = rows.unionByName(starts.where("start is not null").select(F.col("start").alias("id"), F.lit(False).alias("goes"), F.lit(0).alias("weight")))
    if nodes is not None:
        rows = rows.unionByName(nodes.where("severity > 0 and id is not null").select("id", F.lit(False).alias("goes"), F.col("severity").cast("int").alias("weight")))
    seed = 0
    while True:
        by = number or (lambda c, seed=seed: F.xxhash64(F.lit(seed), c))
        ids = scratch.store(rows.groupBy(by(F.col("id")).alias("n"), "id").agg(F.max("goes").alias("goes"), F.max("weight").alias("weight")))
        if ids.groupBy("n").count().where("count > 1").isEmpty():
            return ids, by
        number, seed = None, seed + 1


def number(edges: DataFrame, starts: DataFrame, nodes: DataFrame | None, scratch: Scratch, evidence: bool = True) -> Numbered:
    """Nodes get a number each, and the first edge of each source and target becomes a step; self loops are left out.

    Edges are dealt once, by target: there the first of a pair is found, the target's weight joined and its steps counted. Without
    evidence and where seq is a number, seq is the code as it is; else edges are numbered in order.
    """
    edges = edges.where("src <> dst")
    ids, by = numbers(edges, starts, nodes, scratch)
    direct = not evidence and isinstance(edges.schema["seq"].dataType, IntegralType)
    carried = [F.struct("rel", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), *[c for c in ("file", "line") if c in edges.columns]).alias("own")] if evidence else []
    dealt = edges.select(by(F.col("src")).alias("src"), by(F.col("dst")).alias("dst"), "seq", F.coalesce("transitive", F.lit(False)).alias("transitive"), *carried).repartition("dst")
    first = dealt.groupBy("dst", "src").agg(F.min_by("transitive", "seq").alias("transitive"), *[F.min_by("own", "seq").alias("own") for _ in carried], F.min("seq").alias("seq"))
    whole = first.join(ids.select(F.col("n").alias("dst"), "goes", "weight"), "dst").withColumn("onward", F.col("goes") & F.col("transitive"))
    to = Window.partitionBy("dst")
    whole = whole.withColumns({"dead_in": F.count_if(~F.col("onward")).over(to), "onward_in": F.count_if("onward").over(to), "dead_src": F.max(F.when(~F.col("onward"), F.col("src"))).over(to)})
    kind = F.when(F.col("onward"), CORE).when(F.col("dead_in") == 1, FAN).when(F.col("onward_in") == 0, LEAF).otherwise(CORE)
    again = F.col("onward_in") + F.when((F.col("dead_in") > 1) & (F.col("onward_in") > 0), F.col("dead_in")).otherwise(0) > 1
    bit = lambda c, by: F.when(c, by).otherwise(0)
    mark = F.col("weight").cast("long") * 8 + bit(again, 4) + bit(F.col("transitive"), 2) + bit(F.col("onward"), 1)
    steps = whole.select("src", "dst", "seq", mark.alias("mark"), F.when(F.col("onward") & (F.col("dead_in") == 1), F.col("dead_src")).alias("fan"), kind.alias("kind"), *["own" for _ in carried])
    if direct:
        return Numbered(ids, scratch.store(steps.withColumn("code", F.col("seq").cast("long")).drop("seq"), by="kind"), None)
    placed = scratch.store(in_order(scratch.store(steps), "code", "src", "seq").drop("seq"))
    told = placed.select(F.col("code").alias("edge"), F.col("src").alias("at"), (F.shiftright("mark", 1) % 2 == 1).alias("transitive"), "own.*").withColumnsRenamed({"src_id": "src", "dst_id": "dst"}) if evidence else None
    return Numbered(ids, placed.drop("own"), told)


class Search:
    """A search from many starts, made in the scratch of a with block; what its methods return is cut off from it.

    Levels hold steps of CORE alone. A FAN step adds no pair that its source does not tell: a start that hands on at the source reaches the target, unless a step
    of CORE met it before. So pairs of fans are made only where they are asked for one by one, and sums take them by fan; LEAF steps are settled once, after
    the levels, since nothing is hidden by them. A level costs two shuffles: the rows that hand on meet their steps, and what they meet is settled by
    (start, node) together with the pairs met before that may be met again. What a fan met before is dropped by a join of
    (start, source of the fan). Only rows that hand on are sorted. Levels are stored, so that a
    lost executor costs no earlier level again. AQE splits the join where many starts stand on one node.
    """

    def __init__(self, edges: DataFrame, starts: DataFrame, scratch: Scratch, nodes: DataFrame | None = None, evidence: bool = True) -> None:
        self.scratch, self.nodes, self.graph = scratch, nodes, number(edges, starts, nodes, scratch, evidence)
        own = self.graph.ids.join(starts.where("start is not null").select(F.col("start").alias("id")).distinct(), "id", "left_semi")
        self.starts = scratch.store(own.select(F.col("n").alias("start"), F.col("id").alias("name"), "weight"))
        self.levels: list[DataFrame] = []
        self.ahead: list[DataFrame] = []
        self.discover()

    def steps(self, kind: int) -> DataFrame:
        return self.graph.steps.where(F.col("kind") == kind).select("src", "dst", "code", "mark", "fan")

    def discover(self) -> None:
        """Levels of start, node, parent, code, mark, fan. (parent, code) is a start's order inside a level; parent is the place of the row that hands on."""
        steps = self.steps(CORE).select("src", F.col("dst").alias("next"), "code", "mark", "fan")
        hiding = self.scratch.store(steps.where("fan is not null").select(F.col("fan").alias("node")).distinct())
        hides = not hiding.isEmpty()
        frontier = self.starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("place"))
        seen = stood = None
        gone = F.lit(-1).cast("long")
        while True:
            if hides:
                here = frontier.select("start", "node", "place").join(hiding, "node", "left_semi").select("start", F.col("node").alias("fan"), F.col("place").alias("fanned"))
                stood = here if stood is None else stood.unionByName(here)
            met = frontier.select("start", "node", "place").join(self.steps_of(frontier, steps), F.col("node") == F.col("src")).where("next <> start").select("start", F.col("next").alias("node"), "place", "code", "mark", "fan")
            both = met if seen is None else met.unionByName(seen.select("start", "node", gone.alias("place"), gone.alias("code"), gone.alias("mark"), F.lit(None).cast("long").alias("fan")))
            first = both.groupBy("start", "node").agg(F.min("place").alias("parent"), F.min_by("code", "place").alias("code"), F.min_by("mark", "place").alias("mark"), F.max("fan").alias("fan")).where("parent >= 0")
            if hides and not stood.isEmpty():
                first = first.join(spread(stood, SMALL_THIN), ["start", "fan"], "left").where("fanned is null or fanned > parent").select("start", "node", "parent", "code", "mark", "fan")
            level = self.scratch.store(first)
            if level.isEmpty():
                return
            rest = level.where("mark % 2 = 0")
            if not rest.isEmpty():
                self.levels.append(self.scratch.store(rest))
            ahead = level.where("mark % 2 = 1")
            if ahead.isEmpty():
                return
            depth = len(self.ahead) + 1
            if depth >> (63 - LEVEL_BITS):
                raise ValueError("a search of more than 8191 levels")
            frontier = self.scratch.store(in_order(ahead, "place", "start", "parent", "code").withColumn("place", F.col("place") + depth * (1 << LEVEL_BITS)))
            self.scratch.drop(level)
            self.ahead.append(frontier)
            for one in [frontier, *self.levels[-1:]]:
                one = one.where("shiftright(mark, 2) % 2 = 1").select("start", "node")
                seen = one if seen is None else seen.unionByName(one)

    def steps_of(self, frontier: DataFrame, steps: DataFrame) -> DataFrame:
        """steps; where a frontier stands on few nodes, only the steps of those, which then go to all tasks if they are few."""
        nodes = frontier.select(F.col("node").alias("src")).distinct().limit(SMALL + 1)
        nodes = self.scratch.store(nodes)
        if nodes.count() > SMALL:
            return steps
        return spread(steps.join(F.broadcast(nodes), "src", "left_semi"))

    def standing(self) -> DataFrame:
        """start, node, place of all rows that hand on, the starts themselves at 0."""
        out = self.starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("place"))
        for rows in self.ahead:
            out = out.unionByName(rows.select("start", "node", "place"))
        return out

    def core(self) -> DataFrame:
        """start, node, parent, code, mark, fan of all pairs that steps of CORE settled."""
        none = self.starts.limit(0).select("start", *[F.col("start").alias(c) for c in ("node", "parent", "code", "mark", "fan")])
        for level in [*self.ahead, *self.levels]:
            none = none.unionByName(level.select(*none.columns))
        return none

    def leaves(self, chosen: str = "true") -> DataFrame:
        """start, node, parent, code, mark of all pairs by (chosen) steps of LEAF, each by the one met first."""
        met = self.standing().join(self.steps(LEAF).where(chosen), F.col("node") == F.col("src")).where("dst <> start").select("start", F.col("dst").alias("node"), "place", "code", "mark")
        return met.groupBy("start", "node").agg(F.min("place").alias("parent"), F.min_by("code", "place").alias("code"), F.min_by("mark", "place").alias("mark"))

    def fanned(self, fans: DataFrame, standing: DataFrame | None = None, heavy: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
        """start, node, parent, code, mark (and more columns of fans) of pairs by steps of FAN (fans; heavy: all have a weight), but those that CORE met before."""
        rows = self.standing() if standing is None else standing
        met = rows.join(fans, F.col("node") == F.col("src")).where("dst <> start").select("start", F.col("dst").alias("node"), F.col("place").alias("parent"), "code", "mark", *more)
        before = self.core().where("fan is not null and mark >= 8" if heavy else "fan is not null").select("start", "node")
        return met if before.isEmpty() else met.join(before, ["start", "node"], "left_anti")

    def pairs(self, *columns: str, heavy: bool = False) -> DataFrame:
        """All pairs with level; heavy: those with a weight alone."""
        weighs = F.col("mark") >= 8
        chosen = lambda df: df.where(weighs) if heavy else df
        names = ["start", "node", "parent", "code", "mark"]
        every = chosen(self.core().select(*names)).unionByName(self.leaves("mark >= 8" if heavy else "true")).unionByName(self.fanned(chosen(self.steps(FAN)), heavy=heavy))
        return every.select(*columns, (F.shiftright("parent", LEVEL_BITS) + 1).cast("int").alias("level"))

    def scores(self) -> DataFrame:
        """start, score, max_severity, rating of every start. Fans count by their sums, without a row for each of their nodes."""
        weight = F.shiftright("mark", 3)
        heavy = self.steps(FAN).where("mark >= 8")
        fans = self.scratch.store(heavy.groupBy("src").agg(F.sum(weight).alias("total"), F.max(weight).alias("peak")))
        few = spread(fans)
        # A start that stands in a fan it comes by is no finding of its own.
        own = self.scratch.store(heavy.join(self.starts.where("weight > 0"), F.col("dst") == F.col("start")).select("start", F.col("src").alias("node")))
        standing, parts = self.standing(), []
        if not own.isEmpty():
            apart = standing.join(own, ["start", "node"], "left_semi").join(heavy, F.col("node") == F.col("src")).where("dst <> start")
            parts.append(apart.select("start", weight.alias("total"), weight.alias("peak")))
            standing = standing.join(own, ["start", "node"], "left_anti")
        parts.append(standing.join(few, F.col("node") == F.col("src")).select("start", "total", "peak"))
        core = self.core().where("mark >= 8")
        parts.append(core.select("start", weight.alias("total"), weight.alias("peak")))
        twice = core.where("fan is not null")
        if not twice.isEmpty():
            # What CORE met first is in the sum of its fan too.
            met = twice.join(self.standing().select("start", F.col("node").alias("fan")), ["start", "fan"], "left_semi")
            parts.append(met.select("start", (-weight).alias("total"), weight.alias("peak")))
        leaf = self.standing().join(self.steps(LEAF).where("mark >= 8"), F.col("node") == F.col("src")).where("dst <> start")
        parts.append(leaf.groupBy("start", "dst").agg(F.max(weight).alias("total")).select("start", "total", F.col("total").alias("peak")))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        sums = every.groupBy("start").agg(F.sum("total").alias("score"), F.max("peak").alias("max_severity"))
        return cut_lineage(scored(self.starts.join(sums, "start", "left").select(F.col("name").alias("start"), "score", "max_severity")))

    def counts(self) -> DataFrame:
        """start, level, n_reached, n_stopped, first_node, last_node (by id); a fan counts as a whole where its first and last nodes are met by it."""
        order = self.scratch.store(in_order(self.graph.ids.select("n", "id"), "at", "id"))
        passes, level = F.shiftright("mark", 1) % 2, (F.shiftright("parent", LEVEL_BITS) + 1).cast("int").alias("level")
        spot = order.select(F.col("n").alias("node"), "at")
        told = lambda pairs: pairs.join(spot, "node").groupBy("start", level).agg(F.count("*").alias("n"), F.sum(1 - passes).alias("stopped"), F.min("at").alias("low"), F.max("at").alias("high"))
        steps = self.steps(FAN)
        fans = steps.join(order.select(F.col("n").alias("dst"), "at"), "dst").groupBy("src").agg(
            F.count("*").alias("size"), F.sum(1 - passes).alias("stopped"), F.min("at").alias("low"), F.max("at").alias("high"), F.min_by("dst", "at").alias("one"), F.max_by("dst", "at").alias("other"))
        fans = self.scratch.store(fans)
        few = spread(fans)
        # Nodes of fans that do not count: those that CORE met before, and starts themselves. Their fan steps are not transitive.
        inside = steps.join(self.starts, F.col("dst") == F.col("start")).select("start", F.col("dst").alias("node"), F.col("src").alias("fan"))
        left_out = self.core().where("fan is not null").select("start", "node", "fan").unionByName(inside)
        ends = left_out.join(few.select(F.col("src").alias("fan"), "one", "other"), "fan")
        lost = ends.groupBy("start", F.col("fan").alias("node")).agg(F.count("*").alias("lost"), F.bool_or((F.col("node") == F.col("one")) | (F.col("node") == F.col("other"))).alias("cut"))
        rows = self.scratch.store(self.standing().join(few, F.col("node") == F.col("src")).drop("src", "one", "other").join(lost, ["start", "node"], "left"))
        whole = rows.where("not coalesce(cut, false)").withColumn("parent", F.col("place"))
        whole = whole.select("start", level, (F.col("size") - F.coalesce("lost", F.lit(0))).alias("n"), (F.col("stopped") - F.coalesce("lost", F.lit(0))).alias("stopped"), "low", "high")
        parts = [told(self.core()), told(self.leaves()), whole]
        cut = rows.where("cut").select("start", "node", "place")
        if not cut.isEmpty():
            parts.append(told(self.fanned(steps, cut)))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        sums = self.scratch.store(every.groupBy("start", "level").agg(F.sum("n").alias("n_reached"), F.sum("stopped").alias("n_stopped"), F.min("low").alias("low"), F.max("high").alias("high")))
        name = lambda at, to: order.select(F.col("at").alias(at), F.col("id").alias(to))
        out = sums.join(name("low", "first_node"), "low").join(name("high", "last_node"), "high").join(self.starts.select("start", "name"), "start")
        return cut_lineage(out.select(F.col("name").alias("start"), "level", "n_reached", "n_stopped", "first_node", "last_node"))

    def by_kind(self) -> DataFrame:
        """start, kind, n_findings, weight, worst of what found() gives: worst is the first by severity, label, level and discovery. No name is joined to a pair."""
        heavy = self.nodes.where("severity > 0 and id is not null").select("id", "label", "kind", "severity")
        order = self.scratch.store(in_order(self.scratch.store(heavy.select("severity", "label").distinct()), "spot", F.desc("severity"), F.asc("label")))
        known = heavy.alias("h").join(order.alias("o"), F.expr("h.severity = o.severity and h.label <=> o.label")).select("h.*", "spot")
        known = self.scratch.store(known.join(self.graph.ids.select("id", F.col("n").alias("node")), "id").select("node", "kind", "severity", "spot"))
        fans = self.scratch.store(self.steps(FAN).where("mark >= 8").join(known.withColumnRenamed("node", "dst"), "dst"))
        few = spread(fans)
        names = ["start", "node", "parent", "code"]
        plain = self.core().where("mark >= 8").select(*names).unionByName(self.leaves("mark >= 8").select(*names)).join(known, "node")
        every = plain.unionByName(self.fanned(few, heavy=True, more=("kind", "severity", "spot")).drop("mark"))
        sums = every.groupBy("start", "kind").agg(F.count("*").alias("n_findings"), F.sum("severity").cast("long").alias("weight"), F.min(F.struct("spot", "parent", "code", "node")).alias("first"))
        sums = self.scratch.store(sums.select("start", "kind", "n_findings", "weight", F.col("first.node").alias("node")))
        out = sums.join(self.graph.ids.select(F.col("n").alias("node"), F.col("id").alias("worst")), "node").join(self.starts.select("start", "name"), "start")
        return cut_lineage(out.select(F.col("name").alias("start"), "kind", "n_findings", "weight", "worst"))

    def named(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Pairs with the names of start and node, and columns of the edge that met the node."""
        out = pairs.withColumn("edge", F.col("code")).join(self.starts.select("start", "name"), "start")
        if self.graph.edges is not None:
            out = out.join(self.graph.edges.select("edge", F.col("dst").alias("name_of_node"), *columns), "edge")
        else:
            out = out.join(self.graph.ids.select(F.col("n").alias("node"), F.col("id").alias("name_of_node")), "node")
        place, transitive = F.struct("parent", "edge").alias("place"), (F.shiftright("mark", 1) % 2 == 1).alias("transitive")
        more = [c for c in pairs.columns if c not in ("start", "node", "parent", "code", "mark", "level")]
        return out.select(F.col("name").alias("start"), F.col("name_of_node").alias("node"), *columns, "level", place, transitive, *more)

    def reached(self, evidence: bool = True) -> DataFrame:
        """start, node, (src, rel,) level, place, transitive."""
        return cut_lineage(self.named(self.pairs("start", "node", "parent", "code", "mark"), *(("src", "rel") if evidence else ())))

    def ways(self) -> DataFrame:
        """start, node, way (edge numbers) to every node that hands on: parent pointers, doubled in as many joins as the log of the depth."""
        by_edge = self.graph.edges.select("edge", "at")
        out = None
        for rows in self.ahead:
            own = rows.withColumn("edge", F.col("code")).join(by_edge, "edge").select("start", "node", F.array("edge").alias("way"), F.col("at").alias("anchor"))
            out = own if out is None else out.unionByName(own)
        if out is None:
            return self.starts.limit(0).select("start", F.col("start").alias("node"), F.array("start").alias("way"))
        for _ in range(max(0, (len(self.ahead) - 1).bit_length())):
            out = self.scratch.store(out)
            above = out.select("start", F.col("node").alias("anchor"), F.col("way").alias("before"), F.col("anchor").alias("higher"))
            out = out.join(above, ["start", "anchor"], "left").select("start", "node", F.concat(F.coalesce("before", F.array().cast("array<long>")), "way").alias("way"), F.coalesce("higher", "anchor").alias("anchor"))
        return out.select("start", "node", "way")

    def with_ways(self, pairs: DataFrame) -> DataFrame:
        """pairs with way: those of the nodes that handed on, and the last edge."""
        by_edge = self.graph.edges.select(F.col("edge").alias("last"), "at")
        before = self.ways().select("start", F.col("node").alias("at"), F.col("way").alias("before"))
        own = pairs.withColumn("last", F.col("code")).join(by_edge, "last").join(before, ["start", "at"], "left")
        return own.withColumn("way", F.concat(F.coalesce("before", F.array().cast("array<long>")), F.array("last"))).drop("last", "at", "before")

    def hops(self, pairs: DataFrame) -> DataFrame:
        """start, node, hops of pairs with ways: their edges in order."""
        step = pairs.select("start", "node", F.posexplode("way").alias("pos", "edge"))
        hop = F.struct(*[F.col(c) if c in self.graph.edges.columns else F.lit(None).cast("string").alias(c) for c in HOP])
        told = step.join(self.graph.edges, "edge").groupBy("start", "node").agg(F.array_sort(F.collect_list(F.struct("pos", hop.alias("hop")))).alias("hops"))
        return told.select("start", "node", F.transform("hops", lambda h: h["hop"]).alias("hops"))

    def explained(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Named pairs with hops."""
        known = self.scratch.store(self.with_ways(pairs))
        return self.named(known.drop("way").join(self.hops(known), ["start", "node"]), *columns)

    def found(self, hops: bool = False, evidence: bool = True) -> DataFrame:
        """Reached nodes of a positive severity alone, with label, kind and severity: chosen before anything is joined."""
        pairs = self.pairs("start", "node", "parent", "code", "mark", heavy=True)
        own = ("src", "rel") if evidence else ()
        return cut_lineage(weighted(self.explained(pairs, *own) if hops else self.named(pairs, *own), self.nodes))


def reach(edges: DataFrame, starts: DataFrame, hops: bool = False, evidence: bool = True) -> DataFrame:
    """One row per start and node reached: start, node, src, rel, level, place (parent, edge), transitive (and hops).

    edges: src, dst, rel, transitive, seq; seq orders the edges of a source and has any orderable type. The order
    of discovery of a start is (level, place). Without evidence src and rel are left out. With hops also file and line are needed, and the
    way to every node is added. starts: column start; repeated starts count once. Starts without edges reach
    nothing and have no rows; null starts are dropped.
    """
    with Scratch(edges.sparkSession) as scratch:
        search = Search(edges, starts, scratch, evidence=hops or evidence)
        if not hops:
            return search.reached(evidence)
        return cut_lineage(search.explained(search.pairs("start", "node", "parent", "code", "mark"), "src", "rel"))


def found(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: bool = False, evidence: bool = False) -> DataFrame:
    """The findings of starts: weighted(reach(...)), but nothing else is named or explained on the way."""
    with Scratch(edges.sparkSession) as scratch:
        return Search(edges, starts, scratch, nodes, hops or evidence).found(hops, evidence)


def kinds_from(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """start, kind, n_findings, weight, worst: what found() gives, summed without its rows being stored."""
    with Scratch(edges.sparkSession) as scratch:
        return Search(edges, starts, scratch, nodes, evidence=False).by_kind()


def counts_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, level, n_reached, n_stopped, first_node, last_node: what reach() gives, counted, without a row for each pair."""
    with Scratch(edges.sparkSession) as scratch:
        return Search(edges, starts, scratch, evidence=False).counts()


def weighted(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reached nodes of a positive severity, with their id, label, kind and severity."""
    heavy = nodes.where("severity > 0").select(F.col("id").alias("node"), "label", "kind", "severity")
    return reached.join(heavy, "node")


def scored(sums: DataFrame) -> DataFrame:
    severity = F.coalesce("max_severity", F.lit(0)).cast("int")
    return sums.select("start", F.coalesce("score", F.lit(0)).cast("long").alias("score"), severity.alias("max_severity"), rating(severity).alias("rating"))


def score(reached: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """start, score, max_severity, rating of every start; 0 and low where nothing of weight is reached."""
    sums = weighted(reached, nodes).groupBy("start").agg(F.sum("severity").alias("score"), F.max("severity").alias("max_severity"))
    return scored(starts.where("start is not null").select("start").distinct().join(sums, "start", "left"))


def scores_from(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """score() of starts straight from edges: only pairs of numbers are kept, no evidence."""
    with Scratch(edges.sparkSession) as scratch:
        return Search(edges, starts, scratch, nodes, evidence=False).scores()


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with 1, 2, ... in a total order, without gathering all rows in one task.

    Rows are dealt by ranges of the order, numbered inside each range, and shifted by the counts
    of the ranges before; only those counts, one a partition, meet in one place.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(shifts), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def rank(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """scores ordered by score, worst severity, label and node position, with rank from 1."""
    named = scores.join(nodes.select(F.col("id").alias("start"), "label", "seq"), "start")
    order = [F.desc("score"), F.desc("max_severity"), F.asc("label"), F.asc("seq"), F.asc("start")]
    return numbered(named, order).select("rank", F.col("start").alias("id"), "label", "score", "max_severity", "rating")


def findings(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flat findings, one row per start and weighted node; order by start, -severity, label, level, place."""
    return weighted(reached, nodes)


def path_steps(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence paths, one row per hop: start, node, step, from, to, rel, evidence. reached needs hops."""
    label = nodes.select("id", "label")
    hop = reached.select("start", "node", F.posexplode("hops").alias("pos", "hop")).select("start", "node", (F.col("pos") + 1).alias("step"), "hop.*")
    src = label.select(F.col("id").alias("src"), F.col("label").alias("from"))
    dst = label.select(F.col("id").alias("dst"), F.col("label").alias("to"))
    return hop.join(src, "src").join(dst, "dst").select("start", "node", "step", "from", "to", "rel", evidence(F.col("file"), F.col("line")).alias("evidence"))

"""All occurrences of a pattern, as joins of partial matches.

One pass over the edges leaves narrow rows (ids, times, and which events of the pattern a row can be), written once and
read for each event. A chain of the pattern is matched event by event; the chains' matches are then joined by the
planner's tree, in which both sides of every join share an entity.

A join's keys are the shared entities and a cell of time; order, window, distinct entities and distinct event ids are
its other conditions, so that they cut at every step. Only ids and times travel. Cells are a window wide: the right side
has one by its start, a row of the left side those in which what joins it can start, three at most. So an entity of very
many events is dealt over tasks, and pairs further apart are never formed.

Where a plan joins sides that share no entity (left_deep), its pairs may be many more than all else, so they are never
written: chains' matches that none of another chain with a common entity goes with are left out, the others are dealt once, by
the cells in which a match with them can start, all joins are done within such a cell, and the pairs of one go row by row
into the next, whose other side a task holds in memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.operators import candidates as cand
from edgeloom.operators import flow, frequency
from edgeloom.plans import planner
from edgeloom.plans.pattern import Pattern

#: Whether a join of several keys shuffles what is dealt by some of them.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class Part:
    """Partial matches of some events: start_ms, end_ms; for each event i ids_i, src_i, dst_i, s_i, t_i; for each entity j v_j."""

    df: DataFrame
    events: tuple[int, ...]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _extreme(pick, columns: list[Column]) -> Column:
    return pick(*columns) if len(columns) > 1 else columns[0]


def _cell(ms: Column, window_ms: int) -> Column:
    return F.floor(ms / window_ms)


def _columns(events: tuple[int, ...]) -> list[str]:
    return [f"{c}_{i}" for i in events for c in ("src", "dst", "s", "t", "ids")]


def _span(start: str, end: str) -> list[Column]:
    return [F.least("start_ms", start).alias("start_ms"), F.greatest("end_ms", end).alias("end_ms")]


class Matcher:
    """The joins of one pattern under one window and set of options."""

    def __init__(self, p: Pattern, window_ms: int, event_uniqueness: str = "global", flow_order: str = "all", flow_nodes: str = "any"):
        if window_ms <= 0:
            raise ValueError("the window must be positive")
        if event_uniqueness not in ("global", "chain"):
            raise ValueError(event_uniqueness)
        if flow_order not in ("all", "chain"):
            raise ValueError(flow_order)
        if flow_nodes not in ("any", "first"):
            raise ValueError(flow_nodes)
        self.first_only = flow_nodes == "first"
        self.p, self.window_ms = p.optimize(), window_ms
        self.chains = planner.decompose(self.p)
        self.chain_of = {i: n for n, c in enumerate(self.chains) for i in c}
        self.everywhere, self.strict = event_uniqueness == "global", flow_order == "all"

    def _plain(self, df: DataFrame, i: int) -> DataFrame:
        """df(src, dst, start_ms, end_ms, ids) with a part's columns."""
        e, cols = self.p.events[i], ["start_ms", "end_ms"]
        names = {"src": f"src_{i}", "dst": f"dst_{i}", "start_ms": f"s_{i}", "end_ms": f"t_{i}", "ids": f"ids_{i}"}
        own = {e.subject: "src", e.object: "dst"}
        return df.select(*cols, *[F.col(c).alias(n) for c, n in names.items()], *[F.col(c).alias(f"v_{v}") for v, c in own.items()])

    def table(self, edges: DataFrame, narrow: DataFrame, i: int, after: Part | None = None) -> DataFrame:
        """src, dst, start_ms, end_ms, ids of what event i can be bound to; a flow has no ids. after: partial matches that it must fit."""
        e = self.p.events[i]
        if e.kind == "flow":
            found = flow.reach(edges, self.window_ms, *cand.flow_ends(edges, self.p, i, self.first_only))
            return found.select("src", "dst", F.col("depart").alias("start_ms"), F.col("arrive").alias("end_ms"), F.array().cast("array<bigint>").alias("ids"))
        rows = cand.of_event(narrow, i)
        if e.kind == "frequency":
            return frequency.runs(self._fitting(rows, i, after), e.frequency, self.window_ms)
        return rows.select("src", "dst", F.col("ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), F.array("event_id").alias("ids"))

    def _fitting(self, rows: DataFrame, i: int, after: Part | None) -> DataFrame:
        """Candidate rows whose bound ends occur in the partial matches."""
        if after is None:
            return rows
        e, bound = self.p.events[i], planner.entities(self.p, after.events)
        keys = {f"v_{v}": c for v, c in {e.subject: "src", e.object: "dst"}.items() if v in bound}
        return rows.join(after.df.select(*[F.col(v).alias(c) for v, c in keys.items()]).distinct(), list(keys.values()), "left_semi")

    def _loose(self, a: int, b: int) -> bool:
        return not self.strict and self.p.events[b].kind == "flow" and self.chain_of[a] == self.chain_of[b]

    def _order(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[Column]:
        """What the pattern's order says between events of a and of b."""
        out = []
        for i, q in [*((i, q) for i in b for q in self.p.events[i].parents if q in a), *((i, q) for i in a for q in self.p.events[i].parents if q in b)]:
            out.append(F.col(f"t_{q}") <= F.col(f"t_{i}" if self._loose(q, i) else f"s_{i}"))
        return out

    def _unique(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[Column]:
        events, out = self.p.events, []
        for q in a:
            for i in b:
                if "flow" not in (events[q].kind, events[i].kind) and (self.everywhere or self.chain_of[q] == self.chain_of[i]):
                    one = events[q].kind == events[i].kind == "default"
                    out.append(F.col(f"ids_{q}")[0] != F.col(f"ids_{i}")[0] if one else ~F.arrays_overlap(f"ids_{q}", f"ids_{i}"))
        return out

    def _met(self, a: Part, b: tuple[int, ...], right: DataFrame, own: list[str], more: list[Column]) -> tuple[DataFrame, list[Column]]:
        """a's rows with those of right that share entities and lie near in time; right has partial matches of events b, in the columns ``own`` besides times and entities. Then the columns of the outcome but for its times."""
        p, w = self.p, self.window_ms
        low, high = [F.col("end_ms") - w], [F.col("start_ms") + w]
        if len(b) == 1:
            [i] = b
            low += [F.col(f"t_{q}") for q in p.events[i].parents if q in a.events and not self._loose(q, i)]
            high += [F.col(f"s_{c}") for c in p.children(i) if c in a.events and not self._loose(i, c)]
        low, high = _extreme(F.greatest, low), _extreme(F.least, high)
        left = a.df.where(low <= high).select("*", F.explode(F.sequence(_cell(low, w), _cell(high, w))).alias("cell"))
        return self._paired(a, b, left, self._right(b, right.withColumn("r_cell", _cell(F.col("start_ms"), w)), own), own, more)

    def _right(self, b: tuple[int, ...], rows: DataFrame, own: list[str]) -> DataFrame:
        """Of rows with r_cell, the columns that a join takes from its right side."""
        return rows.select(F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), *own, *[F.col(f"v_{v}").alias(f"r_{v}") for v in sorted(planner.entities(self.p, b))], "r_cell")

    def _paired(self, a: Part, b: tuple[int, ...], left: DataFrame, right: DataFrame, own: list[str], more: list[Column]) -> tuple[DataFrame, list[Column]]:
        """left, a's rows with their cells, with those of right of equal cells and entities; then the columns of the outcome but for its times."""
        bound, new = planner.entities(self.p, a.events), planner.entities(self.p, b)
        keys = [F.col(f"v_{v}") == F.col(f"r_{v}") for v in sorted(bound & new)]
        other = [F.col(f"v_{v}") != F.col(f"r_{x}") for v in sorted(bound - new) for x in sorted(new - bound)]
        out = left.join(right, _all([*keys, F.col("cell") == F.col("r_cell"), *other, *more]))
        columns = [F.col(c) for c in (*_columns(a.events), *own, *(f"v_{v}" for v in sorted(bound)))]
        return out, [*columns, *[F.col(f"r_{v}").alias(f"v_{v}") for v in sorted(new - bound)]]

    def _fits(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[Column]:
        """What rows of a and of b must meet besides entities."""
        span = F.greatest("end_ms", "r_end") - F.least("start_ms", "r_start") <= self.window_ms
        return [*self._order(a, b), span, *self._unique(a, b)]

    def join(self, a: Part, b: Part) -> Part:
        out, columns = self._met(a, b.events, b.df, _columns(b.events), self._fits(a.events, b.events))
        return Part(out.select(*_span("r_start", "r_end"), *columns), (*a.events, *b.events))

    def _linked(self, parts: list[Part], k: int) -> DataFrame:
        """Part k's rows without those that no row of some other part with a common entity, within a window of time, goes with."""
        w, mine = self.window_ms, planner.entities(self.p, parts[k].events)
        out = parts[k].df
        for j, o in enumerate(parts):
            common = sorted(mine & planner.entities(self.p, o.events))
            if j == k or not common:
                continue
            near = o.df.select(F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"), *[F.col(f"v_{v}").alias(f"o_{v}") for v in common], F.explode(F.sequence(_cell(F.col("end_ms") - w, w), _cell(F.col("start_ms") + w, w))).alias("o_cell"))
            span = F.greatest("end_ms", "o_end") - F.least("start_ms", "o_start") <= w
            out = out.join(near.hint("merge"), _all([_cell(F.col("start_ms"), w) == F.col("o_cell"), *[F.col(f"v_{v}") == F.col(f"o_{v}") for v in common], span]), "left_semi")
        return out

    def _dealt(self, df: DataFrame, name: str) -> DataFrame:
        """A row for each cell in which a match with it can start, dealt by these cells."""
        own = _cell(F.col("start_ms"), self.window_ms)
        return df.select("*", F.explode(F.array(own - 1, own)).alias(name)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), name)

    def within_cells(self, parts: list[Part], seen: list[Part] | None = None) -> Part:
        """The parts joined as they come, all in the cell in which the whole match starts.

        All joins find their sides dealt alike, so that nothing is shuffled between them; the left side is never gathered.
        A cell holds partial matches that start in the next one, too, as a later part may start before them; those that
        start in the cell itself are counted. The matches are written at once, as the setting that lets joins of several
        keys stay in their cells is for this plan only.
        """
        first, *rest = [Part(self._linked(parts, k), part.events) for k, part in enumerate(parts)]
        out, starts = Part(self._dealt(first.df, "cell"), first.events), _cell(F.col("start_ms"), self.window_ms) == F.col("cell")
        for k, b in enumerate(rest):
            own, more = _columns(b.events), self._fits(out.events, b.events)
            if k == len(rest) - 1:
                more.append(_cell(F.least("start_ms", "r_start"), self.window_ms) == F.col("cell"))
            df, columns = self._paired(out, b.events, out.df, self._right(b.events, self._dealt(b.df, "r_cell"), own).hint("shuffle_hash"), own, more)
            out = Part(df.select(*_span("r_start", "r_end"), *columns, "cell"), (*out.events, *b.events))
            if seen is not None and k < len(rest) - 1:
                seen.append(Part(out.df.where(starts).drop("cell"), out.events))
        conf = out.df.sparkSession.conf
        old = conf.get(CO_PARTITION)
        conf.set(CO_PARTITION, "false")
        try:
            out = self._written(out)
        finally:
            conf.set(CO_PARTITION, old)
        if seen is not None:
            seen.append(out)
        return out

    def _written(self, part: Part) -> Part:
        """The part by way of a file that has the columns which the others follow from."""
        events, vs = self.p.events, [f"v_{v}" for v in sorted(planner.entities(self.p, part.events))]
        times = {i: (f"s_{i}", f"s_{i}" if events[i].kind == "default" else f"t_{i}") for i in part.events}
        df, _ = scratch.save(part.df.select(*{c: None for i in part.events for c in (*times[i], f"ids_{i}")}, *vs), "matches")
        low, high = (_extreme(pick, [F.col(times[i][k]) for i in part.events]) for k, pick in ((0, F.least), (1, F.greatest)))
        each = [c for i in part.events for c in (F.col(f"v_{events[i].subject}").alias(f"src_{i}"), F.col(f"v_{events[i].object}").alias(f"dst_{i}"), F.col(f"s_{i}"), F.col(times[i][1]).alias(f"t_{i}"), F.col(f"ids_{i}"))]
        return Part(df.select(low.alias("start_ms"), high.alias("end_ms"), *each, *vs), part.events)

    def run_after(self, a: Part, narrow: DataFrame, i: int, used: list[int]) -> Part:
        """a extended by event i, a frequency between the entities of events ``used``, which leave out the ids of these."""
        e, w = self.p.events[i], self.window_ms
        taken = sum(self.p.events[q].frequency for q in used)
        near = frequency.near(self._fitting(cand.of_event(narrow, i), i, a), e.frequency, taken, w)
        ends = {e.subject: "src", e.object: "dst"}
        right = near.select("start_ms", F.col("start_ms").alias("end_ms"), F.col("src").alias(f"src_{i}"), F.col("dst").alias(f"dst_{i}"), F.col("start_ms").alias(f"s_{i}"), "near", *[F.col(c).alias(f"v_{v}") for v, c in ends.items()])
        before = [F.col(f"t_{q}") <= F.col(f"s_{i}") for q in e.parents if q in a.events]
        out, columns = self._met(a, (i,), right, [f"src_{i}", f"dst_{i}", f"s_{i}", "near"], before)
        out = out.select("start_ms", "end_ms", "r_start", *columns)
        out = out.withColumn(f"ids_{i}", frequency.ids_of(F.flatten(F.array(*[f"ids_{q}" for q in used])), e.frequency)).where(f"ids_{i} is not null")
        out = out.withColumn(f"t_{i}", frequency.end_of(f"ids_{i}"))
        out = out.where(_all([F.greatest("end_ms", f"t_{i}") - F.least("start_ms", "r_start") <= w, *self._order(a.events, (i,)), *self._unique(a.events, (i,))]))
        events = (*a.events, i)
        return Part(out.select(*_span("r_start", f"t_{i}"), *_columns(events), *[f"v_{v}" for v in sorted(planner.entities(self.p, events))]), events)

    def chain(self, edges: DataFrame, narrow: DataFrame, events: list[int]) -> Part:
        """Matches of a chain, event by event."""
        out: Part | None = None
        for i in events:
            if out is None:
                out = Part(self._plain(self.table(edges, narrow, i), i), (i,))
                continue
            if self.p.events[i].kind == "frequency" and len(out.events) > 1:
                out = Part(scratch.save(out.df, "chain")[0], out.events)  # read twice
            used = [q for q in out.events if self.p.events[q].kind != "flow" and planner.ends(self.p, q) == planner.ends(self.p, i)]
            if self.p.events[i].kind == "frequency" and used:
                out = self.run_after(out, narrow, i, used)
            else:
                out = self.join(out, Part(self._plain(self.table(edges, narrow, i, out), i), (i,)))
        return out

    def joined(self, parts: list[Part], left_deep: bool = False, counts: dict[int, int] | None = None, seen: list[Part] | None = None) -> Part:
        """The matches of the pattern from those of its chains. seen: gets the result of every join."""
        by = {p.events: p for p in parts}

        def of(node: planner.Node) -> Part:
            if node.left is None:
                return by[node.events]
            out = self.join(of(node.left), of(node.right))
            if seen is not None:
                seen.append(out)
            return out

        tree = planner.join_tree(self.p, left_deep, counts)
        if any(not planner.entities(self.p, n.left.events) & planner.entities(self.p, n.right.events) for n in tree.inner()):
            return self.within_cells([by[tuple(c)] for c in self.chains], seen)
        return of(tree)


def chain_matches(edges: DataFrame, p: Pattern, window_ms: int, event_uniqueness: str = "global", flow_order: str = "all", flow_nodes: str = "any") -> tuple[list[DataFrame], dict[int, int] | None]:
    """The matches of each chain of the pattern, as planner.decompose has them; and, where there are several orders of joining them, candidates by event."""
    m = Matcher(p, window_ms, event_uniqueness, flow_order, flow_nodes)
    bare = [i for i, e in enumerate(m.p.events) if e.kind != "flow"]
    narrow = cand.narrow(edges, m.p)
    if len(bare) > 1:
        narrow, _ = scratch.save(narrow, "candidates")
    counts = None
    if len(m.chains) > 2 and bare:
        counts = dict(zip(bare, narrow.agg(*[F.count_if(cand.can_be(i)) for i in bare]).first(), strict=True))
    return [m.chain(edges, narrow, c).df for c in m.chains], counts


def join_chains(matches: list[DataFrame], p: Pattern, window_ms: int, event_uniqueness: str = "global", flow_order: str = "all", left_deep: bool = False, counts: dict[int, int] | None = None, seen: list[Part] | None = None) -> DataFrame:
    """The matches of the pattern from those of its chains, which may come from anywhere."""
    m = Matcher(p, window_ms, event_uniqueness, flow_order)
    return m.joined([Part(df, tuple(c)) for df, c in zip(matches, m.chains, strict=True)], left_deep, counts, seen).df


def match(edges: DataFrame, p: Pattern, window_ms: int, event_uniqueness: str = "global", left_deep: bool = False, flow_order: str = "all", flow_nodes: str = "any", seen: list[Part] | None = None) -> DataFrame:
    """start_ms, end_ms, and for each event i: ids_i, src_i, dst_i, s_i, t_i; for each entity j: v_j.

    event_uniqueness: ``global``, no input event is used twice; ``chain``, not within a chain. flow_order: ``all``, what
    comes before a flow ends before the flow departs; ``chain``, within a chain only before it arrives. flow_nodes: ``any``,
    a node at a flow's end counts by every signature it has on some edge; ``first``, by that of its first edge. left_deep: see
    planner.join_tree; seen: gets the result of every join of chains.
    """
    m = Matcher(p, window_ms, event_uniqueness, flow_order, flow_nodes)
    planner.join_tree(m.p, left_deep)  # so that what can't be joined is told before anything runs
    matches, counts = chain_matches(edges, p, window_ms, event_uniqueness, flow_order, flow_nodes)
    return join_chains(matches, p, window_ms, event_uniqueness, flow_order, left_deep, counts, seen)

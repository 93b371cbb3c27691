"""Random patterns of all kinds of events on random graphs, against plain enumeration of what a match is."""

import itertools
import random
import re

import pytest

from edgeloom import api
from edgeloom.plans.pattern import Pattern
from edgeloom.sources import edges as src

EDGE = ", ".join(f"{c} {'string' if c.endswith('sig') else 'long'}" for c in src.EDGE)
WINDOW = 8


def flows(rows, window):
    """(src, dst, depart, arrive) that no other makes useless."""
    arcs = {(r[4], r[6], r[0]) for r in rows if r[4] != r[6]}
    every, more = set(), {(a, b, t, t) for a, b, t in arcs}
    while more:
        every |= more
        more = {(s, b, d, t) for s, v, d, at in more for a, b, t in arcs if a == v and b != s and t >= at and t - d <= window} - every
    return [r for r in every if not any(r[:2] == o[:2] and o[3] <= r[3] and o[2] >= r[2] and o != r for o in every)]


def bindings(p, i, rows, window):
    """(src, dst, start, end, ids) that event i can have by itself."""
    e = p.events[i]
    fits = lambda s, t: re.fullmatch(s, t) is not None
    subject, object_ = p.entities[e.subject], p.entities[e.object]
    if e.kind == "flow":
        named = {(r[4], r[5]) for r in rows} | {(r[6], r[7]) for r in rows}
        is_a = lambda n, sig: any(m == n and fits(sig, s) for m, s in named)
        return [(a, b, d, t, ()) for a, b, d, t in flows(rows, window) if is_a(a, subject) and is_a(b, object_)]
    ok = [r for r in rows if fits(e.signature, r[3]) and fits(subject, r[5]) and fits(object_, r[7]) and (r[4] == r[6]) == (e.subject == e.object)]
    if e.kind == "default":
        return [(r[4], r[6], r[0], r[0], (r[2],)) for r in ok]
    out = []
    for pair in {(r[4], r[6]) for r in ok}:
        own = sorted((r for r in ok if (r[4], r[6]) == pair), key=lambda r: (r[0], r[1], r[2]))
        for k, r in enumerate(own):
            ids = list(dict.fromkeys(x[2] for x in own[k:]))[: e.frequency]
            if len(ids) == e.frequency:
                end = next(x[0] for x in own[k:] if x[2] == ids[-1])
                if end - r[0] <= window:
                    out.append((*pair, r[0], end, tuple(ids)))
    return out


def enumerated(p, rows, window):
    out = set()
    for some in itertools.product(*(bindings(p, i, rows, window) for i in range(len(p.events)))):
        bound = {}
        if not all(bound.setdefault(v, n) == n for e, b in zip(p.events, some) for v, n in ((e.subject, b[0]), (e.object, b[1]))) or len(set(bound.values())) < len(bound):
            continue
        ids = [x for b in some for x in b[4]]
        if len(set(ids)) < len(ids) or max(b[3] for b in some) - min(b[2] for b in some) > window:
            continue
        if all(some[q][3] <= b[2] for e, b in zip(p.events, some) for q in e.parents):
            text = [f"({b[0]} -> {b[1]})" if e.kind == "flow" else f"({', '.join(map(str, b[4]))})" if e.kind == "frequency" else str(b[4][0]) for e, b in zip(p.events, some)]
            out.add(f"[{', '.join(text)}]")
    return out


#: Shapes: entities, events (subject, object, signature), order, what is a flow, what a frequency.
SHAPES = {
    "flow, then a run and an edge": (["a", "b", "a|c"], [(0, 1, ""), (2, 1, "x|y"), (1, 2, "y|x")], [(0, 1), (0, 2)], [0], {1: 2}),
    "run between two edges": (["a", ".*", "[bc]"], [(0, 1, "x"), (1, 2, ".*"), (2, 0, "y")], [(0, 1), (1, 2)], [], {1: 2}),
    "two flows that meet": (["a", "b", "c"], [(0, 2, ""), (1, 2, ""), (2, 0, "x")], [(0, 2)], [0, 1], {}),
    "star without an order": (["a|b", ".*", "c"], [(0, 1, "x"), (2, 1, "x|y"), (1, 0, "y")], [], [], {}),
    "ring and an edge to itself": (["a", "b"], [(0, 1, "x"), (1, 0, "y"), (0, 0, ".*")], [(0, 1)], [], {}),
    "edges side by side": (["a", "b", "c"], [(0, 1, "x|y"), (0, 1, "y"), (1, 2, "x")], [(1, 2)], [], {}),
}


@pytest.mark.parametrize("name", SHAPES)
def test_against_enumeration(spark, name):
    entities, events, order, are_flows, runs = SHAPES[name]
    p = Pattern.from_graph(entities, events)
    for a, b in order:
        p = p.before(a, b)
    for i in are_flows:
        p = p.flow(i)
    for i, k in runs.items():
        p = p.frequency(i, k)
    for seed in range(50):
        rnd, rows = random.Random(seed), []
        for _ in range(36):
            a, b, t = rnd.randrange(4), rnd.randrange(4), rnd.randrange(-6, 20)
            for at in sorted({t, t + rnd.choice((0, 0, 0, 3))}):  # some edges are intervals
                rows.append((at, len(rows), 100 + len(rows) if at == t else rows[-1][2], rnd.choice("xy") if at == t else rows[-1][3], a, "abca"[a], b, "abca"[b]))
        want = enumerated(p, rows, WINDOW)
        if len(want) > 4:
            break
    got = [r.events for r in api.match(spark.createDataFrame(rows, EDGE), p, WINDOW).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_first_seen_signatures(spark):
    """A node that changes its signature ends flows by the first one, if asked so."""
    rows = [(1, 0, 0, "x", 1, "a", 2, "b"), (2, 1, 1, "x", 2, "c", 3, "b"), (3, 2, 2, "x", 3, "c", 4, "c")]
    g, p = spark.createDataFrame(rows, EDGE), Pattern.from_graph(["a", "c"], [(0, 1, "")]).flow(0)
    found = lambda **how: sorted(r.events for r in api.match(g, p, 9, **how).collect())
    assert found() == ["[(1 -> 2)]", "[(1 -> 3)]", "[(1 -> 4)]"] and found(flow_nodes="first") == ["[(1 -> 4)]"]
    with pytest.raises(ValueError):
        found(flow_nodes="last")

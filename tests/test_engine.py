"""Small exact cases, random graphs against enumeration, planted patterns."""

import itertools
import json
import random
import re

import pytest

from edgeloom import api, measure
from edgeloom.operators import compose, flow, frequency, results
from edgeloom.operators.generate import planted
from edgeloom.plans.pattern import Pattern
from edgeloom.sources import edges as src

EDGE = "ts_ms long, seq long, event_id long, event_sig string, subject_id long, subject_sig string, object_id long, object_sig string"
CHAIN = Pattern.from_graph(["v0", "v1", "v2", "v3"], [(0, 1, "e0"), (1, 2, "e1"), (2, 3, "e2")], use_regex=False).chained()
FOREVER = 1 << 40


def graph(spark, rows):
    """rows: (ts, subject, object, event#subject#object[, id])"""
    return spark.createDataFrame([(r[0], k, r[4] if len(r) > 4 else k, (s := r[3].split("#"))[0], r[1], s[1], r[2], s[2]) for k, r in enumerate(rows)], EDGE)


def found(spark, rows, p, window=FOREVER, **how):
    return sorted(r.events for r in api.match(graph(spark, rows), p, window, **how).collect())


BASIC = [(0, 0, 1, "e0#v0#v1"), (1, 1, 2, "e1#v1#v2"), (2, 2, 3, "e2#v2#v3")]


def test_basic_and_window(spark):
    assert found(spark, BASIC, CHAIN) == ["[0, 1, 2]"]
    late = [BASIC[0], BASIC[1], (4, *BASIC[2][1:])]
    assert found(spark, late, CHAIN, 3) == [] and found(spark, late, CHAIN, 4) == ["[0, 1, 2]"]
    with pytest.raises(ValueError):
        api.match(graph(spark, BASIC), CHAIN, 0)


def test_same_time_in_any_order(spark):
    assert found(spark, [(5, *r[1:]) for r in reversed(BASIC)], CHAIN) == ["[2, 1, 0]"]


def test_uniqueness(spark):
    p = Pattern.from_graph(["v0", "v1", "v2"], [(0, 1, "e0"), (1, 2, "e1"), (1, 2, "e.")]).chained()
    assert found(spark, BASIC[:2], p) == []
    p = Pattern.from_graph(["v0", "v1", "v.", "v3"], [(0, 1, "e0"), (1, 2, "e1"), (1, 3, "e2")]).chained()
    assert found(spark, [BASIC[0], (1, 1, 2, "e1#v1#v3"), (2, 1, 2, "e2#v1#v3")], p) == []


def test_frequency(spark):
    rows = [BASIC[0], *[(t, 1, 2, "e1#v1#v2") for t in (1, 2, 3)], (4, 2, 3, "e2#v2#v3")]
    assert found(spark, rows, CHAIN.frequency(1, 3)) == ["[0, (1, 2, 3), 4]"]
    alone = Pattern.from_graph(["v1", "v2"], [(0, 1, "e1")], False).frequency(0, 2)
    assert found(spark, [(t, 1, 2, "e1#v1#v2") for t in range(4)], alone) == ["[(0, 1)]", "[(1, 2)]", "[(2, 3)]"]
    twice = spark.createDataFrame([(0, 0, 7, 1, 2), (1, 1, 7, 1, 2), (2, 2, 8, 1, 2), (3, 3, 8, 1, 2)], "ts_ms long, seq long, event_id long, src long, dst long")
    assert sorted((r.start_ms, r.end_ms, r.ids) for r in frequency.runs(twice, 2, 9).collect()) == [(0, 2, [7, 8]), (1, 2, [7, 8])]


def test_flow_in_chain(spark):
    rows = [BASIC[0], (1, 1, 2, "x#v1#vx"), (2, 2, 3, "x#vx#vy"), (3, 3, 4, "x#vy#v2"), (4, 4, 5, "e2#v2#v3")]
    assert found(spark, rows, CHAIN.flow(1)) == ["[0, (1 -> 4), 4]"]


def test_paper_example(spark):
    """The graph, the pattern and the result of a published example."""
    rows = [(5, 1, 2, "recvmsg#S#P"), (7, 2, 3, "fork#P#P"), (7, 4, 3, "read#F#P"), (9, 3, 4, "write#P#F"), (11, 4, 3, "read#F#P"), (11, 3, 4, "write#P#F")]
    p = Pattern.from_graph(["S", "P", "F"], [(0, 1, ""), (2, 1, "read"), (1, 2, "write")]).flow(0).frequency(1, 2).frequency(2, 2).before(0, 1).before(0, 2)
    rows = [(t * 1000, *r, k + 1) for k, (t, *r) in enumerate(rows)]
    assert [r.line for r in api.match(graph(spark, rows), p, 1_800_000, "text").collect()] == ["<5.000, 11.000>[(1 -> 3), (3, 5), (4, 6)]"]
    [n] = api.match(graph(spark, rows), p, 1_800_000, "nested").collect()
    assert n.events[1].event_ids == [3, 5] and [e.entity_id for e in n.entities] == [1, 3, 4]


def reached(arcs, window):
    """(src, dst, depart, arrive) of all time-respecting walks that don't come back to src, then those that no other makes useless."""
    every, more = set(), {(a, b, t, t) for a, b, t in arcs if a != b}
    while more:
        every |= more
        more = {(s, b, d, t) for s, v, d, at in more for a, b, t in arcs if a == v != b != s and t >= at and t - d <= window} - every
    return {(s, v, d, t) for s, v, d, t in every if not any((s, v) == (s2, v2) and t2 <= t and d2 >= d and (d2, t2) != (d, t) for s2, v2, d2, t2 in every)}


#: Arcs (start, end, time) by hand; windows are of 7.
GRAPHS = {
    "relay over the window's edge": [(1, 2, 0), (2, 3, 4), (3, 4, 7), (4, 5, 8), (5, 6, 15)],
    "one instant, against the order of rows": [(5, 6, 3), (4, 5, 3), (3, 4, 3), (2, 3, 3), (1, 2, 2)],
    "one instant, two rings that touch": [(1, 2, 6), (2, 3, 6), (3, 1, 6), (3, 4, 6), (4, 5, 6), (5, 3, 6), (9, 1, 5), (5, 8, 9)],
    "back to where it came from": [(1, 2, 1), (2, 1, 2), (1, 3, 3), (3, 1, 3), (2, 3, 9)],
    "a later departure by a longer way": [(1, 2, 1), (1, 3, 4), (3, 4, 5), (4, 2, 6), (2, 5, 6), (2, 6, 7)],
    "the same arc again and again": [(1, 2, t) for t in range(0, 30, 3)] + [(2, 3, 10), (2, 3, 20), (2, 3, 29)],
    "before time began": [(1, 2, -9), (2, 3, -7), (3, 4, -1), (4, 5, 0), (5, 6, 6)],
    "arcs to oneself": [(1, 1, 1), (1, 2, 2), (2, 2, 2), (2, 3, 4)],
}


@pytest.mark.parametrize("bounds", [{}, {"ARCS": 0}, {"ARCS": 6}], ids=["in cells", "fix-point", "both"])
def test_reachability(spark, monkeypatch, bounds):
    """All graphs at once, of ids of their own, and random ones, worked off in bounded cells, by rounds of joins, and cell by cell in either way."""
    for name, value in bounds.items():
        monkeypatch.setattr(flow, name, value)
    rnd, some = random.Random(8), list(GRAPHS.values())
    some += [[(rnd.randrange(6), rnd.randrange(6), rnd.randrange(16)) for _ in range(16)] for _ in range(40)]
    some.append([(0, 1, 3), (0, 4, 5), (4, 1, 8), (1, 2, 10), (2, 3, 12)])  # a later departure is found for a known arrival
    arcs = [(100 * n + a, 100 * n + b, t) for n, g in enumerate(some) for a, b, t in g]
    for window in (7, 20):
        got = [tuple(r) for r in flow.reach(graph(spark, [(t, a, b, "x#n#n") for a, b, t in arcs]), window).select("src", "dst", "depart", "arrive").collect()]
        want = set().union(*(reached([x for x in arcs if x[0] // 100 == n], window) for n in range(len(some))))
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("arcs", [200_000, 0])
def test_reachability_between_some(spark, monkeypatch, arcs):
    """Sources and targets only choose rows."""
    monkeypatch.setattr(flow, "ARCS", arcs)
    rnd = random.Random(4)
    g = graph(spark, [(rnd.randrange(40), rnd.randrange(12), rnd.randrange(12), "x#n#n") for _ in range(120)])
    ids = lambda *some: spark.createDataFrame([(i,) for i in some], "entity_id long")
    rows = lambda **ends: {tuple(r) for r in flow.reach(g, 9, **ends).select("src", "dst", "depart", "arrive").collect()}
    every = rows()
    assert rows(sources=ids(1, 2, 3)) == {r for r in every if r[0] in (1, 2, 3)}
    assert rows(targets=ids(4, 5)) == {r for r in every if r[1] in (4, 5)}
    assert rows(sources=ids(1, 2), targets=ids(2, 7)) == {r for r in every if r[0] in (1, 2) and r[1] in (2, 7)} != set()
    assert rows(sources=ids(77)) == set()


def test_runs_leave_out_what_the_match_uses(spark):
    """A run between the entities of an event before it, over rows that come twice, against enumeration."""
    rnd = random.Random(2)
    for k in (2, 3):
        rows = []
        for i in range(14):
            t = rnd.randrange(20)
            for at in sorted({t, t + rnd.choice((0, 0, 2, 5))}):
                rows.append((at, 5, 2, f"{rnd.choice('xy') if i else 'x'}#a#b", i))
        p = Pattern.from_graph(["a", "b"], [(0, 1, "x"), (0, 1, "x|y")]).before(0, 1).frequency(1, k)
        ordered = sorted((t, seq, i, s[0]) for seq, (t, _, _, s, i) in enumerate(rows))
        want = set()
        for t0, _, base, sig in ordered:
            for at, (t1, _, first, _) in enumerate(ordered):
                if sig == "x" and t1 >= t0 and first != base:
                    ids = list(dict.fromkeys(i for _, _, i, _ in ordered[at:] if i != base))[:k]
                    if len(ids) == k and next(t for t, _, i, _ in ordered[at:] if i == ids[-1]) - t0 <= 9:
                        want.add(f"[{base}, ({', '.join(map(str, ids))})]")
        assert want and set(found(spark, rows, p, 9)) == want


def test_hot_pair(spark):
    """Runs of one pair, which is dealt over parts by time, against one window over all of it."""
    rnd, rows, at = random.Random(1), [], 0
    for i in range(400):
        at += rnd.choice((0, 1, 1, 3, 8))
        rows.append((at - 300, i, i, 1, 2))
    got = frequency.runs(spark.createDataFrame(rows, "ts_ms long, seq long, event_id long, src long, dst long"), 4, 10).collect()
    want = [(rows[i][0], rows[i + 3][0], [i, i + 1, i + 2, i + 3]) for i in range(397) if rows[i + 3][0] - rows[i][0] <= 10]
    assert want and sorted((r.start_ms, r.end_ms, r.ids) for r in got) == want


def test_tree_of_joins(spark):
    """A plan by the tree and one by chains as they come give the same, the one through fewer partial matches."""
    rnd = random.Random(6)
    p = Pattern.from_graph(list("abcd"), [(0, 1, "x"), (2, 3, "y"), (1, 2, "z")], use_regex=False)
    rows = []
    for _ in range(180):
        k = rnd.randrange(3)
        a, b = ("ab", "cd", "bc")[k]
        rows.append((rnd.randrange(40), 10 * "abcd".index(a) + rnd.randrange(5), 10 * "abcd".index(b) + rnd.randrange(5), f"{'xyz'[k]}#{a}#{b}"))
    g = graph(spark, rows)
    tree, deep = measure.states(g, p, 6), measure.states(g, p, 6, left_deep=True)
    assert tree[-1][1] == deep[-1][1] > 20 and sum(n for _, n in tree[:-1]) < sum(n for _, n in deep[:-1])
    assert found(spark, rows, p, 6) == found(spark, rows, p, 6, left_deep=True)
    parts, _ = compose.chain_matches(g, p, 6)
    assert results.flat(compose.join_chains(parts, p, 6), p).count() == tree[-1][1]


def test_random_graphs(spark):
    rnd = random.Random(5)
    p = Pattern.from_graph(["[ab]", ".*", "b|c"], [(0, 1, "x"), (1, 2, "x|y"), (0, 2, "y")]).before(0, 2)
    rows = []
    for _ in range(60):
        a, b = rnd.randrange(6), rnd.randrange(6)
        rows.append((rnd.randrange(12), a, b, f"{rnd.choice('xy')}#{'abc'[a % 3]}#{'abc'[b % 3]}"))
    want = set()
    for trio in itertools.permutations(range(len(rows)), 3):
        e = [rows[i] for i in trio]
        ends = [(q.subject, q.object) for q in p.events]
        bound: dict = {}
        ok = all(bound.setdefault(v, n) == n for q, r in zip(ends, e) for v, n in zip(q, r[1:3])) and len(set(bound.values())) == len(bound)
        ok = ok and all(re.fullmatch(q.signature, r[3].split("#")[0]) and re.fullmatch(p.entities[q.subject], r[3].split("#")[1]) and re.fullmatch(p.entities[q.object], r[3].split("#")[2]) for q, r in zip(p.events, e))
        if ok and e[0][0] <= e[2][0] and max(r[0] for r in e) - min(r[0] for r in e) <= 6:
            want.add(f"[{trio[0]}, {trio[1]}, {trio[2]}]")
    assert want and set(found(spark, rows, p, 6)) == want and set(found(spark, rows, p, 6, left_deep=True)) == want


def test_planted(spark):
    p = Pattern.from_graph(["p", "f", "s"], [(0, 1, "read"), (0, 2, "send"), (2, 1, "wait")], False).before(0, 1).frequency(1, 2)
    assert api.match(planted(spark, p, 20), p, FOREVER).count() == 20


def test_csv(spark, tmp_path):
    lines = ["1.5,2.25,1,read,1,P::a,2,F::b", "3,3,2,read,1,P::a,2,F::b", "x,3,3,read,1,P::a,2,F::b", "1,1,4,read,1,P::a,2", "1640336879.895,bad,5,w,1,P,2,F", '1,1,6,"a,b",1,P,2,F']
    (tmp_path / "g.csv").write_text("\n".join(lines))
    raw = src.read_csv(spark, str(tmp_path / "g.csv"))
    assert sorted((r.ts_ms, r.event_id) for r in src.edges(raw).collect()) == [(1000, 6), (1500, 1), (2250, 1), (3000, 2), (1640336879895, 5)]
    assert sorted((r.malformed or "").count(",") for r in src.rejects(raw).collect()) == [0, 6]
    (tmp_path / "h.csv").write_text("9,9,7,read,1,P::a,2,F::b\n")
    both = src.edges(src.read_csv(spark, str(tmp_path)))
    assert [r.event_id for r in both.orderBy("seq").collect()] == [1, 1, 2, 5, 6, 7]
    numbered = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    assert [r.seq for r in src.odd_lines(numbered).orderBy("seq").collect()] == [3, 4, 5]


def test_imports(spark):
    six = spark.createDataFrame([("1.0,2.0,read#P::a#F::b,7,1,2",), ("1,2,a#b#P::x#F::y,8,1,2",), ("junk",)], "value string")
    assert sorted((r.event_id, r.event_sig, r.subject_sig, r.object_sig) for r in src.from_six_columns(six).collect()) == [("7", "read", "P::a", "F::b"), ("8", "a#b", "P::x", "F::y")]
    spade = '{"r":{"id":"1","properties":{"operation":"read","earliest":"1.5","lastest":"2.5"}},"m":{"id":"2","properties":{"type":"Process","name":"vi"}},"n":{"id":"3","properties":{"type":"Artifact","subtype":"file","path":"/x"}}}'
    [r] = src.from_spade(spark.createDataFrame([(spade,)], "value string")).collect()
    assert (r.start_time, r.end_time, r.subject_sig, r.object_sig, r.event_sig) == ("1.5", "2.5", "Process::vi", "Artifact::file::/x", "read")
    node = lambda **p: {"id": "2", "properties": p}
    line = lambda r, m, n: json.dumps({"r": {"id": "1", "properties": {"type": "EVENT_READ", **r}}, "m": m, "n": n})
    lines = [
        line({"time": 1523000000123456789}, node(type="SUBJECT_PROCESS", Subject_properties_map_name="vi"), node(NetFlowObject_baseObject_epoch=1, NetFlowObject_remoteAddress="1.2.3.4", NetFlowObject_remotePort=80)),
        line({"earliest": "1523000000999999999", "lastest": "1523000002000000001"}, node(type="SUBJECT_UNIT", Subject_properties_map_name="u"), node(UnnamedPipeObject_baseObject_epoch=1)),
        line({"time": 5}, node(type="FILE_OBJECT_DIR", path="/d"), node(uuid="x")),
        line({"time": 5}, node(type="SRCSINK_UNKNOWN", SrcSinkObject_pid=7), node(type="FILE_OBJECT_FILE")),
    ]
    got = [(r.start_time, r.end_time, r.subject_sig, r.object_sig) for r in src.from_darpa(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert got == [
        ("1523000000.123", "1523000000.123", "SUBJECT_PROCESS::vi", "OBJECT_SOCKET::1.2.3.4:80"), ("1523000000.999", "1523000002.000", "SUBJECT_UNIT::u", "OBJECT_UNNAMEPIPE::"),
        ("0.000", "0.000", "FILE_OBJECT_DIR::/d", "OTHER"), ("0.000", "0.000", "SRCSINK_UNKNOWN::7", None),
    ]


def test_answers(spark):
    lines = spark.createDataFrame([("<1.000, 2.000>[1, 2]",), ("<1.000, 2.000>[(3, 4), 5]",), ("Total number of matches: 2",)], "value string")
    answers = results.parse_answers(lines)
    got = spark.createDataFrame([("[1, 2]",), ("[1, 2]",), ("[9]",)], "events string")
    assert sorted((r.events, r.problem) for r in results.diff(got, answers).collect()) == [("[(3, 4), 5]", "missing"), ("[1, 2]", "duplicate"), ("[9]", "false positive")]
    small = results.repro(graph(spark, BASIC), spark.createDataFrame([([1, 2],)], "ids array<long>"))
    assert sorted((r.event_id, r.subject_id, r.object_id) for r in small.collect()) == [(0, 0, 1), (1, 1, 2)]

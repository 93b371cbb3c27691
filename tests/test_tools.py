"""Command line, importer of property graphs, run matrix, options."""

import json

import pytest

from edgeloom import __main__, api, measure
from edgeloom.functions import signatures
from edgeloom.operators.generate import planted
from edgeloom.plans import legacy
from edgeloom.plans.pattern import Pattern, UndefinedEntity
from edgeloom.sources import edges as src

NODES = ['{"node": {"id": "7", "properties": {"type": "Process", "name": "vi"}}}', '{"node": {"id": "9", "properties": {"type": "Artifact", "subtype": "file", "path": "/x"}}}']
ARC = '{"edge": {"id": "1", "start": {"id": "%s"}, "end": {"id": "%s"}, "properties": {"operation": "%s"}}}'
ORDER = '{"0": {"parents": ["root"], "children": [1]}, "1": {"parents": [0], "children": []}, "root": {"parents": [], "children": [0]}}'


def test_property_graph(tmp_path):
    arcs = [ARC % (7, 9, "open"), ARC % (9, 7, "read")]
    p = legacy.from_property_graph(NODES, arcs, ORDER)
    assert p.entities == ("Process::vi", "Artifact::file::/x") and [(e.signature, e.subject, e.object, e.parents) for e in p.events] == [("open", 0, 1, ()), ("read", 1, 0, (0,))]
    with pytest.raises(UndefinedEntity):
        legacy.from_property_graph(NODES, [ARC % (7, 8, "open")], ORDER)
    for name, text in (("p_regex_node", "\n".join(NODES)), ("p_regex_edge", "\n".join(arcs)), ("p_oRels", ORDER)):
        (tmp_path / f"{name}.json").write_text(text)
    assert legacy.read_property_graph(str(tmp_path / "p_regex")) == p


def test_node_signatures(spark):
    """The importer's are the sources' own."""
    some = [
        {"type": "Process", "name": "a"}, {"type": "Artifact", "subtype": "file", "path": "/p"}, {"type": "Artifact", "subtype": "directory", "path": "/d"}, {"type": "Artifact", "subtype": "network socket", "remote address": "1.2.3.4", "remote port": "80"},
        {"type": "Artifact", "subtype": "unnamed pipe"}, {"type": "Agent", "name": "root"}, {"type": "Process"}, {"type": "Artifact"}, {"type": "Process", "name": "b", "subtype": "file"},
        {"NetFlowObject_baseObject_epoch": "1", "NetFlowObject_remoteAddress": "h", "NetFlowObject_remotePort": "9", "type": "x"}, {"UnnamedPipeObject_baseObject_epoch": "1"}, {"path": "/q"}, {},
        {"type": "SUBJECT_UNIT", "Subject_properties_map_name": "n"}, {"type": "FILE_OBJECT_CHAR", "path": "/c"}, {"type": "SRCSINK_UNKNOWN", "SrcSinkObject_pid": "3"}, {"type": "SRCSINK_UNKNOWN"},
    ]

    def text(own, x):
        try:
            return own(x)
        except KeyError:
            return None

    lines = spark.createDataFrame([(json.dumps({"r": {"id": str(k), "properties": {"time": "1"}}, "m": {"id": "1", "properties": x}, "n": {"id": "2", "properties": x}}),) for k, x in enumerate(some)], "value string")
    for read, own in ((src.from_spade, signatures.spade_text), (src.from_darpa, signatures.darpa_text)):
        assert {int(r.event_id): r.subject_sig for r in read(lines).collect()} == {k: text(own, x) for k, x in enumerate(some)}


def test_json_round_trip():
    p = Pattern.from_graph(["a", "b", "c"], [(0, 1, "x"), (1, 2, "y"), (2, 0, "")]).chained().frequency(0, 3).flow(2)
    assert Pattern.parse(p.to_json()) == p


def test_command_line(spark, tmp_path, capsys):
    p = Pattern.from_graph(["a", "b"], [(0, 1, "x"), (1, 0, "y")], use_regex=False).chained()
    (tmp_path / "p.json").write_text(p.to_json())
    (tmp_path / "g.csv").write_text("1,1,5,x,1,a,2,b\n2,2,6,y,2,b,1,a\n9,9,7,y,2,b,1,a\n")
    found = lambda *more: __main__.main([str(tmp_path / "p.json"), str(tmp_path / "g.csv"), *more])
    assert found() == 2 and "Pattern Match: <1.000, 2.000>[5, 6]" in capsys.readouterr().out
    assert found("-w", "3", "-s") == 1 and "Pattern Match" not in capsys.readouterr().out
    assert found("-s", "--output", str(tmp_path / "out")) == 2 and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_matrix(spark):
    p = Pattern.from_graph(["a", "b"], [(0, 1, "x")], use_regex=False)
    rows = measure.averages(measure.run_matrix(spark, {"one": p}, {"g": planted(spark, p, 3)}, 10_000, repeats=2)).collect()
    assert sorted((r.pattern or "", r.graph, r.matches) for r in rows) == [("", "g", 3.0), ("one", "g", 3.0)]


EDGE = ", ".join(f"{c} {'string' if c.endswith('sig') else 'long'}" for c in src.EDGE)


def test_options(spark):
    """A flow that leaves before its parent ends counts by its arrival only; flows aside, matches can be the same."""
    rows = [(1, 0, 0, "m", 1, "b", 9, "h"), (3, 1, 1, "x", 5, "a", 1, "b"), (4, 2, 2, "m", 9, "h", 2, "c"), (5, 3, 3, "m", 9, "h", 3, "c")]
    g = spark.createDataFrame(rows, EDGE)
    p = Pattern.from_graph(["a", "b", "c"], [(0, 1, "x"), (1, 2, "")], use_regex=False).chained().flow(1)
    found = lambda **how: sorted(r.events for r in api.match(g, p, 100, **how).collect())
    assert found() == [] and found(flow_order="chain") == ["[1, (1 -> 2)]", "[1, (1 -> 3)]"]
    assert found(flow_order="chain", dedup_key="ids") == ["[1, (1 -> 2)]"]
    for wrong in ({"flow_order": "x"}, {"dedup_key": "x"}, {"event_uniqueness": "x"}):
        with pytest.raises(ValueError):
            found(**wrong)


def test_hot_entity_over_time(spark):
    """Matches at borders of cells, negative times included, against a plain join."""
    rows = [(t, k, k, "x" if k % 2 else "y", 1, "a", 2 + k % 3, "b") for k, t in enumerate(range(-50, 50, 3))]
    g = spark.createDataFrame(rows, EDGE)
    p = Pattern.from_graph(["a", "b", "b"], [(0, 1, "x"), (0, 2, "y")], use_regex=False)
    for q, ordered in ((p, False), (p.before(0, 1), True), (p.before(1, 0), None)):
        want = {f"[{x[2]}, {y[2]}]" for x in rows for y in rows if x[3] == "x" and y[3] == "y" and x[6] != y[6] and abs(x[0] - y[0]) <= 7 and (ordered is False or (x[0] <= y[0]) == bool(ordered))}
        assert {r.events for r in api.match(g, q, 7).collect()} == want


def test_signatures_without_regular_expressions(spark):
    """What is compared in other ways matches what the expression would."""
    import re

    texts = ["", "a", "ab", "a\n", "a\nb", "b", "view", "view\n", "viewer", "a.b", "a.*", "a|b", "|", "a\r", "xa"]
    some = ["a", "a.*", ".*", "a|b", "view|a", "|a", "a.*|b", "vie?w.*", "a.b", "v.*r", "ab*", "a{0,1}", "a\\.b", "(a|b).*", "a\r.*"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[signatures.matches(df["t"], s, True).alias(f"c{k}") for k, s in enumerate(some)]).collect()
    assert {(r.t, s): r[k + 1] for r in got for k, s in enumerate(some)} == {(t, s): re.fullmatch(s, t) is not None for t in texts for s in some}

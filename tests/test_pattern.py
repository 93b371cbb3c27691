import json
import random

import pytest

from edgeloom.plans import pattern as pt
from edgeloom.plans.pattern import Pattern
from edgeloom.plans.planner import decompose, ends, entities, join_order, join_tree


def spec(**more):
    return {"Version": "0.2.0", "Entities": [{"ID": 5, "Signature": "a"}, {"ID": 9, "Signature": "b"}], "Events": [{"ID": 3, "Signature": "x", "SubjectID": 5, "ObjectID": 9}, {"ID": 4, "Signature": "y", "SubjectID": 9, "ObjectID": 5, "Parents": [3]}]} | more


def test_parse():
    p = Pattern.parse(json.dumps(spec()))
    assert p.entities == ("a", "b") and p.use_regex and p.events[1].parents == (0,) and p.order() == [0, 1] and p.roots() == [0]


@pytest.mark.parametrize("kind", [None, "Default", "Frequency", "Flow", "default", "", 4])
@pytest.mark.parametrize("times", [None, -2, 0, 1, 7, 52, "7", 2.5, True])
def test_event_kinds(kind, times):
    """Every kind with every frequency: what is said of the kind wins, a frequency counts where it can."""
    e = {k: v for k, v in (("Type", kind), ("Frequency", times)) if v is not None}
    counts = kind == "Frequency" or kind is None and times is not None
    if kind not in (None, "Default", "Frequency", "Flow"):
        error = pt.UnknownEventType
    elif not counts:
        assert pt.event_kind(e) == ("flow" if kind == "Flow" else "default", 1)
        return
    elif times is None:
        error = pt.MissingKey
    elif type(times) is not int:
        error = pt.WrongType
    elif times < 1:
        error = pt.InvalidFrequency
    else:
        assert pt.event_kind(e) == ("frequency", times)
        return
    with pytest.raises(error):
        pt.event_kind(e)


def test_parents_and_empty_signatures():
    for wrong in (3, "3", {"3": 1}, [True], ["3"]):
        with pytest.raises(pt.WrongType):
            Pattern.parse(json.dumps(spec(Events=[{"ID": 3, "Signature": "x", "SubjectID": 5, "ObjectID": 9, "Parents": wrong}])))
    with pytest.warns(UserWarning, match="event 3"):
        Pattern.parse(json.dumps(spec(Events=[{"ID": 3, "Signature": "", "SubjectID": 5, "ObjectID": 9}])))


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"Version": "0.1.0"}, pt.UnsupportedVersion), ({"Events": []}, pt.NoEvents), ({"Entities": 3}, pt.WrongType), ({"Entities": [{"ID": 5}]}, pt.MissingKey), ({"Entities": [{"ID": 5, "Signature": "a"}]}, pt.UndefinedEntity),
        ({"Entities": [{"ID": 5, "Signature": "a"}] * 2}, pt.DuplicateId),
        ({"Events": [{"ID": 3, "Signature": "x", "SubjectID": 5, "ObjectID": 9, "Parents": [8]}]}, pt.UndefinedEvent),
        ({"Events": [{"ID": 3, "Signature": "x", "SubjectID": 5, "ObjectID": 9, "Parents": [3]}]}, pt.DependencyCycle),
        ({"Events": [{"ID": 3, "Signature": "x(?=y)", "SubjectID": 5, "ObjectID": 9}]}, pt.UnsupportedRegex),
    ],
)
def test_errors(change, error):
    with pytest.raises(error):
        Pattern.parse(json.dumps(spec(**change)))
    with pytest.raises(pt.PatternSyntaxError):
        Pattern.parse("{")


def test_upgrade_and_dot():
    old = {"Version": "0.1.0", "Events": [{"ID": 0, "Signature": "e#a#b", "SubjectID": 1, "ObjectID": 0, "Parents": []}]}
    p = Pattern.parse(pt.upgrade(json.dumps(old)))
    assert p.entities == ("b", "a") and p.events[0].signature == "e" and p.events[0].subject == 1
    assert "style=dashed" in p.flow(0).to_dot()
    assert pt.parse_order('{"0": {"parents": ["root"], "children": [1]}, "1": {"parents": [0]}, "root": {}}', 2) == {0: (), 1: (0,)}


def test_planning():
    p = Pattern.from_graph(list("abcde"), [(0, 1, "x"), (1, 2, "y"), (3, 4, "z"), (2, 3, "w")]).before(0, 1).before(2, 3)
    assert sorted(map(sorted, decompose(p))) == [[0, 1], [2, 3]]
    assert sorted(join_order(p)) == [0, 1, 2, 3]
    apart = Pattern.from_graph(list("abcd"), [(0, 1, "x"), (2, 3, "y")])
    for plan in (join_order, join_tree):
        with pytest.raises(pt.DisconnectedPattern):
            plan(apart)
    assert p.frequency(0, 1).optimize().events[0].kind == "default"


def test_sides_of_joins_share_an_entity():
    """In trees of random connected patterns; and trees are lower than chains of joins."""
    rnd, lower = random.Random(3), 0
    for _ in range(200):
        n = rnd.randrange(2, 12)
        edges = [(v, rnd.randrange(v), "x") for v in range(1, n)] + [(rnd.randrange(n), rnd.randrange(n), "x") for _ in range(rnd.randrange(4))]
        p = Pattern.from_graph(["v"] * n, edges)
        for _ in range(rnd.randrange(5)):
            a, b = sorted(rnd.sample(range(len(edges)), 2)) if len(edges) > 1 else (0, 0)
            p = p if a == b else p.before(a, b)
        chains = decompose(p)
        assert sorted(i for c in chains for i in c) == list(range(len(edges)))
        assert all(b in p.children(a) and ends(p, b) & entities(p, c[: k + 1]) for c in chains for k, (a, b) in enumerate(zip(c, c[1:])))
        tree = join_tree(p, counts={i: rnd.randrange(9) for i in range(len(edges))})
        assert all(entities(p, j.left.events) & entities(p, j.right.events) for j in tree.inner()) and sorted(tree.events) == list(range(len(edges)))
        assert len(tree.inner()) == len(chains) - 1 >= tree.height
        lower += tree.height < len(chains) - 1
    assert lower > 50


def test_longest_chains_against_enumeration():
    def every(p, left):
        out = []

        def walk(path):
            out.append(path)
            for j in p.children(path[-1]):
                if j in left and ends(p, j) & entities(p, path):
                    walk([*path, j])

        for i in left:
            walk([i])
        return max(map(len, out))

    rnd = random.Random(9)
    for _ in range(150):
        n = rnd.randrange(2, 9)
        p = Pattern.from_graph(["v"] * 5, [(rnd.randrange(5), rnd.randrange(5), "x") for _ in range(n)])
        for a in range(n):
            for b in range(a + 1, n):
                p = p.before(a, b) if rnd.random() < 0.4 else p
        left = frozenset(range(n))
        for c in decompose(p):
            assert len(c) == every(p, left)
            left -= frozenset(c)


def test_planning_of_a_dense_order():
    """Every event after all before it: found at once, though there are as many chains as there are subsets."""
    for n in (18, 40):
        p = Pattern.from_graph(["a", "b"], [(0, 1, "x")] * n)
        for b in range(n):
            for a in range(b):
                p = p.before(a, b)
        assert decompose(p) == [list(range(n))]

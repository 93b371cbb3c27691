"""Patterns from property graphs: JSON lines of nodes and edges, and a file of the order."""

from __future__ import annotations

import json
from collections.abc import Iterable

from edgeloom.functions import signatures
from edgeloom.plans.pattern import DuplicateId, Event, MissingKey, Pattern, UndefinedEntity, parse_order


#: Kind of graph to the signature of a node, and the property that holds an edge's.
KINDS = {"spade": (signatures.spade_text, "operation"), "darpa": (signatures.darpa_text, "type")}


def _parsed(lines: Iterable[str], key: str) -> list[dict]:
    rows = [json.loads(x) for x in lines if x.strip()]
    if any(key not in r for r in rows):
        raise MissingKey(key)
    return [r[key] for r in rows]


def from_property_graph(nodes: Iterable[str], edges: Iterable[str], order: str, kind: str = "spade", use_regex: bool = False) -> Pattern:
    """nodes: lines of {"node": {id, properties}}; edges: of {"edge": {start: {id}, end: {id}, properties}}, numbered by line; order: see parse_order."""
    signature, named = KINDS[kind]
    found: dict[int, str] = {}
    for n in _parsed(nodes, "node"):
        if (k := int(n["id"])) in found:
            raise DuplicateId(f"entity {k}")
        try:
            found[k] = signature(n.get("properties", {}))
        except KeyError as e:
            raise MissingKey(f"{e.args[0]} of entity {k}") from e
    place = {k: i for i, k in enumerate(found)}
    rows, events = _parsed(edges, "edge"), []
    parents = parse_order(order, len(rows))
    for i, e in enumerate(rows):
        ends = [int(e[x]["id"]) for x in ("start", "end")]
        if missing := [k for k in ends if k not in place]:
            raise UndefinedEntity(str(missing[0]))
        if named not in e.get("properties", {}):
            raise MissingKey(f"{named} of event {i}")
        events.append(Event(e["properties"][named], place[ends[0]], place[ends[1]], parents=parents.get(i, ())))
    return Pattern(tuple(found.values()), tuple(events), use_regex)


def read_property_graph(prefix: str, kind: str = "spade", use_regex: bool = False) -> Pattern:
    """From ``<prefix>_node.json``, ``<prefix>_edge.json`` and ``<prefix>_oRels.json``; a last ``_regex`` of the prefix isn't in the order's name."""
    names = (f"{prefix}_node.json", f"{prefix}_edge.json", f"{prefix.removesuffix('_regex')}_oRels.json")
    texts = []
    for name in names:
        with open(name, encoding="utf-8") as f:
            texts.append(f.read())
    return from_property_graph(texts[0].splitlines(), texts[1].splitlines(), texts[2], kind, use_regex)

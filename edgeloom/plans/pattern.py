"""Pattern graphs: entities, events between them, a partial order; read from JSON 0.2.0 or built in code."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, replace

VERSION = "0.2.0"


class PatternError(ValueError):
    """Something is wrong with a pattern."""


class PatternSyntaxError(PatternError):
    """Not JSON."""


class MissingKey(PatternError):
    """A needed key is absent."""


class WrongType(PatternError):
    """A value has another type than its key asks for."""


class NoEvents(PatternError):
    """A pattern without events."""


class UnsupportedVersion(PatternError):
    """A version other than 0.2.0; 0.1.0 can be upgraded."""


class UnknownEventType(PatternError):
    """A Type other than Default, Frequency and Flow."""


class UndefinedEntity(PatternError):
    """An event names an entity that isn't there."""


class UndefinedEvent(PatternError):
    """A parent that isn't there."""


class DuplicateId(PatternError):
    """Two entities or two events of one ID."""


class InvalidFrequency(PatternError):
    """A frequency that isn't a positive integer."""


class DependencyCycle(PatternError):
    """An event that would have to come before itself."""


class UnsupportedRegex(PatternError):
    """Look-around or back-references, which signatures don't have."""


class DisconnectedPattern(PatternError):
    """Parts that share no entity."""


@dataclass(frozen=True)
class Event:
    """An edge of the pattern between entities (by index). kind: default, frequency (k of them) or flow; parents by index."""

    signature: str
    subject: int
    object: int
    kind: str = "default"
    frequency: int = 1
    parents: tuple[int, ...] = ()


@dataclass(frozen=True)
class Pattern:
    entities: tuple[str, ...]
    events: tuple[Event, ...]
    use_regex: bool = True

    def __post_init__(self) -> None:
        if not self.events:
            raise NoEvents("a pattern needs an event")
        self.order()
        if self.use_regex:
            for s in [*self.entities, *(e.signature for e in self.events)]:
                if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!])|\\[1-9])", s):
                    raise UnsupportedRegex(s)

    def order(self) -> list[int]:
        """Event indices with every parent first, low indices first otherwise."""
        out: list[int] = []
        while len(out) < len(self.events):
            ready = [i for i, e in enumerate(self.events) if i not in out and all(p in out for p in e.parents)]
            if not ready:
                raise DependencyCycle(str([i for i in range(len(self.events)) if i not in out]))
            out.append(ready[0])
        return out

    def roots(self) -> list[int]:
        return [i for i, e in enumerate(self.events) if not e.parents]

    def children(self, i: int) -> list[int]:
        return [j for j, e in enumerate(self.events) if i in e.parents]

    def optimize(self) -> Pattern:
        """A frequency of one is a default event."""
        return replace(self, events=tuple(replace(e, kind="default") if e.kind == "frequency" and e.frequency == 1 else e for e in self.events))

    def frequency(self, i: int, k: int) -> Pattern:
        if not isinstance(k, int) or k < 1:
            raise InvalidFrequency(str(k))
        return self._with(i, kind="frequency", frequency=k)

    def flow(self, i: int) -> Pattern:
        return self._with(i, kind="flow", frequency=1)

    def before(self, a: int, b: int) -> Pattern:
        return self._with(b, parents=(*self.events[b].parents, a))

    def chained(self) -> Pattern:
        """Each event after the one before it."""
        return replace(self, events=tuple(replace(e, parents=(i - 1,) if i else ()) for i, e in enumerate(self.events)))

    def _with(self, i: int, **what) -> Pattern:
        return replace(self, events=tuple(replace(e, **what) if j == i else e for j, e in enumerate(self.events)))

    @classmethod
    def from_graph(cls, entities: list[str], events: list[tuple[int, int, str]], use_regex: bool = True) -> Pattern:
        """events: (subject, object, signature), unordered default ones."""
        for s, o, _ in events:
            if not (0 <= s < len(entities) and 0 <= o < len(entities)):
                raise UndefinedEntity(str((s, o)))
        return cls(tuple(entities), tuple(Event(sig, s, o) for s, o, sig in events), use_regex)

    @classmethod
    def parse(cls, text: str) -> Pattern:
        try:
            spec = json.loads(text)
        except json.JSONDecodeError as e:
            raise PatternSyntaxError(str(e)) from e
        if (v := _get(spec, "Version", str)) != VERSION:
            raise UnsupportedVersion(v)
        entities = {}
        for e in _get(spec, "Entities", list):
            if (k := _get(e, "ID", int)) in entities:
                raise DuplicateId(f"entity {k}")
            entities[k] = _get(e, "Signature", str)
        place, raw = {k: i for i, k in enumerate(entities)}, _get(spec, "Events", list)
        numbers: dict[int, int] = {}
        for e in raw:
            if (k := _get(e, "ID", int)) in numbers:
                raise DuplicateId(f"event {k}")
            numbers[k] = len(numbers)
        events = []
        for e in raw:
            kind, k = event_kind(e)
            ends = [_get(e, x, int) for x in ("SubjectID", "ObjectID")]
            if missing := [x for x in ends if x not in place]:
                raise UndefinedEntity(str(missing[0]))
            parents = e.get("Parents")
            parents = [] if parents is None else _get(e, "Parents", list)
            if any(not isinstance(p, int) or isinstance(p, bool) for p in parents):
                raise WrongType("Parents")
            if missing := [p for p in parents if p not in numbers]:
                raise UndefinedEvent(str(missing[0]))
            signature = e.get("Signature", "") if kind == "flow" else _get(e, "Signature", str)
            if not signature and kind != "flow":
                warnings.warn(f"event {e['ID']} has an empty signature, which edges without one match only", stacklevel=2)
            events.append(Event(signature, place[ends[0]], place[ends[1]], kind, k, tuple(numbers[p] for p in parents)))
        regex = spec.get("UseRegex", True)
        if not isinstance(regex, bool):
            raise WrongType("UseRegex")
        return cls(tuple(entities.values()), tuple(events), regex)

    @classmethod
    def read(cls, path: str) -> Pattern:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    def to_json(self) -> str:
        """As parse() reads it."""
        kinds = {"default": lambda e: {}, "frequency": lambda e: {"Type": "Frequency", "Frequency": e.frequency}, "flow": lambda e: {"Type": "Flow"}}
        entities = [{"ID": i, "Signature": s} for i, s in enumerate(self.entities)]
        events = [{"ID": i, "Signature": e.signature, "SubjectID": e.subject, "ObjectID": e.object, "Parents": list(e.parents)} | kinds[e.kind](e) for i, e in enumerate(self.events)]
        return json.dumps({"Version": VERSION, "UseRegex": self.use_regex, "Entities": entities, "Events": events}, indent=2)

    def to_dot(self) -> str:
        """Graphviz text; flows are dashed."""
        nodes = [f'  v{i} [label="{s}"];' for i, s in enumerate(self.entities)]
        label = lambda e: f"{e.signature} x{e.frequency}" if e.kind == "frequency" else e.signature
        edges = [f'  v{e.subject} -> v{e.object} [label="e{i} {label(e)}"{", style=dashed" if e.kind == "flow" else ""}];' for i, e in enumerate(self.events)]
        return "digraph {\n" + "\n".join(nodes + edges) + "\n}"


def _get(spec: dict, key: str, kind: type):
    if not isinstance(spec, dict) or key not in spec:
        raise MissingKey(key)
    if not isinstance(spec[key], kind) or isinstance(spec[key], bool) and kind is int:
        raise WrongType(key)
    return spec[key]


def event_kind(e: dict) -> tuple[str, int]:
    """Kind and frequency of a JSON event. Type wins over Frequency, which counts where Type is absent or Frequency."""
    kind = e.get("Type", "Frequency" if "Frequency" in e else "Default")
    if kind in ("Default", "Flow"):
        return kind.lower(), 1
    if kind != "Frequency":
        raise UnknownEventType(str(kind))
    k = _get(e, "Frequency", int)
    if k < 1:
        raise InvalidFrequency(str(k))
    return "frequency", k


def upgrade(text: str) -> str:
    """JSON 0.1.0, with signatures ``event#subject#object`` and no entities, as 0.2.0."""
    spec = json.loads(text)
    entities: dict[int, str] = {}
    events = []
    for e in spec["Events"]:
        parts = re.fullmatch(r"(?s)(.*?)#(.*?)#(.*)", e["Signature"])
        if parts is None:
            raise PatternError(f"no event#subject#object: {e['Signature']}")
        entities.setdefault(e["SubjectID"], parts[2])
        entities.setdefault(e["ObjectID"], parts[3])
        events.append(e | {"Signature": parts[1]})
    out = {"Version": VERSION, "UseRegex": spec.get("UseRegex", True), "Entities": [{"ID": k, "Signature": v} for k, v in sorted(entities.items())], "Events": events}
    return json.dumps(out, indent=2)


def parse_order(text: str, n: int) -> dict[int, tuple[int, ...]]:
    """Event to parents from an order file {"0": {"parents": [..], "children": [..]}, "root": {..}}."""
    spec = json.loads(text)
    return {int(k): tuple(p for p in map(_number, v.get("parents", [])) if p is not None and p < n) for k, v in spec.items() if k != "root"}


def _number(x) -> int | None:
    return int(x) if str(x).isdigit() else None

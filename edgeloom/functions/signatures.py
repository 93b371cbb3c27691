"""Signatures of nodes in provenance logs, as columns and, for patterns, in plain Python; and matching by signature.

A signature is ``type::`` or ``type::subtype::`` and the values of the properties that its kind of node is named by.
A node that lacks one of these has no signature (null; in a pattern, an error).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By type and, where that has any, subtype, the properties that name a node, joined by a colon.
SPADE = {
    ("Process", None): ("name",),
    ("Artifact", "file"): ("path",),
    ("Artifact", "directory"): ("path",),
    ("Artifact", "network socket"): ("remote address", "remote port"),
}
#: Types whose signatures have the subtype.
SPADE_SUBTYPED = ("Artifact",)
#: A property that tells a type by being there.
DARPA_TOLD = {"NetFlowObject_baseObject_epoch": "OBJECT_SOCKET", "UnnamedPipeObject_baseObject_epoch": "OBJECT_UNNAMEPIPE"}
#: By type, the properties that name a node, joined by a colon.
DARPA = {
    "SUBJECT_PROCESS": ("Subject_properties_map_name",),
    "SUBJECT_UNIT": ("Subject_properties_map_name",),
    "FILE_OBJECT_CHAR": ("path",),
    "FILE_OBJECT_FILE": ("path",),
    "FILE_OBJECT_DIR": ("path",),
    "OBJECT_SOCKET": ("NetFlowObject_remoteAddress", "NetFlowObject_remotePort"),
    "SRCSINK_UNKNOWN": ("SrcSinkObject_pid",),
}
#: Fixed value: the whole signature of a node without a type.
DARPA_OTHER = "OTHER"


def _joined(properties: Column, names: tuple[str, ...]) -> Column:
    parts = [c for n in names for c in (F.lit(":"), properties[n])][1:]
    return F.concat(*parts)


def spade(properties: Column) -> Column:
    """Of a map of properties."""
    kind, sub = properties["type"], properties["subtype"]
    start = F.when(kind.isin(*SPADE_SUBTYPED), F.concat(kind, F.lit("::"), sub, F.lit("::"))).otherwise(F.concat(kind, F.lit("::")))
    name = F.lit("")
    for (k, s), names in SPADE.items():
        name = F.when((kind == k) if s is None else (kind == k) & (sub == s), _joined(properties, names)).otherwise(name)
    return F.concat(start, name)


def darpa(properties: Column) -> Column:
    """Of a map of properties."""
    kind = properties["type"]
    for told, of in reversed(DARPA_TOLD.items()):
        kind = F.when(F.map_contains_key(properties, told), F.lit(of)).otherwise(kind)
    name = F.lit("")
    for k, names in DARPA.items():
        name = F.when(kind == k, _joined(properties, names)).otherwise(name)
    return F.when(properties.isNotNull() & kind.isNull(), F.lit(DARPA_OTHER)).otherwise(F.concat(kind, F.lit("::"), name))


def spade_text(properties: dict) -> str:
    """As spade, of a dict; KeyError where a property lacks."""
    kind, sub = properties["type"], properties.get("subtype")
    parts = [kind, properties["subtype"]] if kind in SPADE_SUBTYPED else [kind]
    names = SPADE.get((kind, sub if kind in SPADE_SUBTYPED else None), ())
    return "::".join([*parts, ":".join(str(properties[n]) for n in names)])


def darpa_text(properties: dict) -> str:
    """As darpa, of a dict; KeyError where a property lacks."""
    kind = next((of for told, of in DARPA_TOLD.items() if told in properties), properties.get("type"))
    if kind is None:
        return DARPA_OTHER
    return f"{kind}::" + ":".join(str(properties[n]) for n in DARPA.get(kind, ()))


_PLAIN = re.compile(r"[\w /:,=@#%&;<>~'\"!-]*")


def is_plain(signature: str) -> bool:
    """Whether a regular expression has no special characters."""
    return _PLAIN.fullmatch(signature) is not None


def matches(column: Column, signature: str, use_regex: bool) -> Column:
    """Whole text by the signature.

    What needs no regular expression gets none: plain text, alternatives of it, and plain text with any rest, a dot
    being anything but a line end. Plain starts are asked for besides, as Parquet can be asked for them.
    """
    if not use_regex or is_plain(signature):
        return column == signature
    if all(map(is_plain, some := signature.split("|"))):
        return column.isin(*some)
    plain = _PLAIN.match(signature)[0]
    rest = signature[len(plain) :]
    if rest == ".*":
        one_line = ~column.contains("\n")
        return column.startswith(plain) & one_line if plain else one_line
    if re.match(r"[*?{]", rest):
        plain = plain[:-1]
    full = column.rlike(rf"(?d)(?U)\A(?:{signature})\z")
    return column.startswith(plain) & full if plain and "|" not in signature else full

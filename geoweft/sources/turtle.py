"""Turtle text to triples and back, for the subset that metadata graphs use: prefixes, typed and plain literals, lists of objects and predicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Namespaces.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<iri><[^<>\s]*>)|(?P<prefix>@prefix|@base)|(?P<lang>@[A-Za-z-]+)|(?P<type>\^\^)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?=[\s;,.\])]))|(?P<bool>(?:true|false)\b)|(?P<name>[A-Za-z_][\w.-]*(?<!\.)?:[\w.%/-]*(?<!\.)|:[\w.%/-]*(?<!\.)|a(?=\s))|(?P<mark>[.;,\[\]()])''',
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "'": "'"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), s, flags=re.S)


def tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not Turtle at character {at}: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0]


def parse(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(subject, predicate, object, datatype); the datatype is null for IRIs."""
    stream = list(tokens(text))
    prefixes, at, base = {}, 0, ""

    def iri(kind: str, value: str) -> str:
        if kind == "iri":
            return value[1:-1] if ":" in value else base + value[1:-1]
        if value == "a":
            return RDF_TYPE
        head, _, tail = value.partition(":")
        if head not in prefixes:
            raise ValueError(f"unknown prefix {head}:")
        return prefixes[head] + tail

    while at < len(stream):
        kind, value = stream[at]
        if kind == "prefix":
            if value == "@prefix":
                prefixes[stream[at + 1][1][:-1]] = stream[at + 2][1][1:-1]
                at += 4
            else:
                base = stream[at + 1][1][1:-1]
                at += 3
            continue
        subject = iri(kind, value)
        at += 1
        while True:
            predicate = iri(*stream[at])
            at += 1
            while True:
                kind, value = stream[at]
                at += 1
                datatype = None
                if kind in ("text", "long"):
                    value, datatype = _unescape(value[3:-3] if kind == "long" else value[1:-1]), XSD + "string"
                    if at < len(stream) and stream[at][0] == "type":
                        datatype = iri(*stream[at + 1])
                        at += 2
                    elif at < len(stream) and stream[at][0] == "lang":
                        at += 1
                elif kind == "number":
                    datatype = XSD + ("integer" if re.fullmatch(r"[-+]?\d+", value) else "decimal" if "e" not in value.lower() else "double")
                elif kind == "bool":
                    datatype = XSD + "boolean"
                elif kind in ("iri", "name"):
                    value = iri(kind, value)
                else:
                    raise ValueError(f"an object was expected, not {value!r}")
                yield subject, predicate, value, datatype
                mark = stream[at][1] if at < len(stream) else "."
                at += 1
                if mark != ",":
                    break
            while mark == ";" and at < len(stream) and stream[at][1] == ";":
                at += 1
            if mark == ";" and at < len(stream) and stream[at][1] == ".":
                mark, at = ".", at + 1
            if mark == ".":
                break
            if mark != ";":
                raise ValueError(f"one of , ; . was expected, not {mark!r}")


def _literal(value: str, datatype: str | None) -> str:
    if datatype is None:
        return f"<{value}>"
    text = '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
    return text if datatype == XSD + "string" else f"{text}^^<{datatype}>"


def serialize(triples: list[tuple[str, str, str, str | None]]) -> str:
    """One block of each subject, everything in full."""
    out: dict[str, dict[str, list[str]]] = {}
    for s, p, o, d in sorted(set(triples), key=lambda t: tuple(x or "" for x in t)):
        out.setdefault(s, {}).setdefault(p, []).append(_literal(o, d))
    return "".join(f"<{s}> " + " ;\n    ".join(f"{'a' if p == RDF_TYPE else f'<{p}>'} " + ", ".join(objects) for p, objects in ps.items()) + " .\n\n" for s, ps in out.items())

"""Formats: detection, and text to plain values."""

from __future__ import annotations

import csv
import datetime
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from functools import cache

from ..errors import QueryError
from .hcl import parse_hcl
from .markdown import parse_markdown

FORMATS = ("json", "yaml", "toml", "hcl", "xml", "csv", "tsv", "markdown")
#: Fixed file endings of the formats.
ENDINGS = {
    "json": (".json",), "yaml": (".yaml", ".yml"), "toml": (".toml",), "hcl": (".tf", ".hcl"), "xml": (".xml", ".pom", ".csproj", ".svg"),
    "csv": (".csv",), "tsv": (".tsv", ".tab"), "markdown": (".md", ".markdown"),
}


def detect(path: str) -> str | None:
    """The format by a path's ending, in any case."""
    return next((f for f, ends in ENDINGS.items() if path.lower().endswith(ends)), None)


def sniff(text: str) -> str:
    """A guess from the content; the first rule that fits. The rules and their order are fixed values."""
    t = text.lstrip()
    rules = (
        ("json", t[:1] in ("{", "[") and t != ""),
        ("xml", t.startswith("<")),
        ("yaml", t.startswith("---") or ": " in t),
        ("toml", " = " in t and "{" not in t),
        ("hcl", " = " in t or " {" in t),
        ("markdown", t.startswith(("#", "- ", "* "))),
    )
    return next((f for f, fits in rules if fits), "json")


def plain(v):
    """Values as JSON has them: times become text, keys strings."""
    if isinstance(v, dict):
        return {k if isinstance(k, str) else json.dumps(plain(k)): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [plain(x) for x in v]
    if isinstance(v, (datetime.date, datetime.time)):
        return v.isoformat()
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    return v


#: Fixed patterns of YAML 1.2's core schema: a plain scalar's kind, and the characters that it can begin with.
CORE = (
    ("null", r"~|null|Null|NULL|", "~nN\0"),
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+.0123456789"),
)


@cache
def core_loader():
    """A YAML loader that reads plain scalars by version 1.2, where ``no``, ``012`` and dates aren't special."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    def whole(loader, node) -> int:
        text = loader.construct_scalar(node)
        return int(text, 8 if text.startswith("0o") else 16) if text[:2] in ("0o", "0x") else int(text)

    for kind, pattern, first in CORE:
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{kind}", re.compile(f"(?:{pattern})\\Z"), ["" if c == "\0" else c for c in first])
    Loader.add_constructor("tag:yaml.org,2002:int", whole)
    Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(loader.construct_scalar(node).lower().replace(".inf", "inf").replace(".nan", "nan")))
    return Loader


def parse_yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise QueryError("YAML needs the yaml package") from e
    try:
        return plain(yaml.load(text, core_loader()))  # noqa: S506  a safe loader
    except (yaml.YAMLError, ValueError) as e:
        raise QueryError(f"YAML parse error: {e}") from e


def _element(e: ET.Element):
    """A string if there is only text; else a map of @attributes, children (lists if repeated) and #text."""
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        name, v = child.tag.rpartition("}")[2], _element(child)
        if name not in out:
            out[name] = v
        elif isinstance(out[name], list):
            out[name].append(v)
        else:
            out[name] = [out[name], v]
    text = (e.text or "").strip()
    if not out:
        return text or None
    if text:
        out["#text"] = text
    return out


def parse_xml(text: str):
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError as e:
        raise QueryError(f"XML parse error: {e}") from e
    return {root.tag.rpartition("}")[2]: _element(root)}


def dialect(text: str) -> tuple[str, bool]:
    """The delimiter and whether the first row is a header."""
    lines = [x for x in text.splitlines() if x][:20]
    if not lines:
        return ",", False
    delimiter = max(",;\t|", key=lambda d: (min(x.count(d) for x in lines) > 0, lines[0].count(d)))
    rows = list(csv.reader(lines, delimiter=delimiter))

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    first = rows[0]
    header = len(rows) > 1 and all(c and not number(c) for c in first) and len(set(first)) == len(first)
    return delimiter, header


def parse_delimited(text: str, delimiter: str | None = None, header: bool | None = None):
    """Rows as maps by header (cut to the shorter of the two), or as lists; cells stay strings."""
    found, has = dialect(text)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter or found) if r]
    if not (has if header is None else header):
        return rows
    return [dict(zip(rows[0], r, strict=False)) for r in rows[1:]]


def parse(text: str, fmt: str):
    """The value of a text in a format."""
    try:
        if fmt == "json":
            return json.loads(text)
        if fmt == "toml":
            return plain(tomllib.loads(text))
    except ValueError as e:
        raise QueryError(f"{fmt.upper()} parse error: {e}") from e
    if fmt == "yaml":
        return parse_yaml(text)
    if fmt == "hcl":
        return parse_hcl(text)
    if fmt == "xml":
        return parse_xml(text)
    if fmt == "csv":
        return parse_delimited(text)
    if fmt == "tsv":
        return parse_delimited(text, "\t", True)
    if fmt == "markdown":
        return parse_markdown(text)
    raise QueryError(f"unknown format {fmt}")

"""Plain values to text in a format."""

from __future__ import annotations

import csv
import io
import json
import math
import re
import xml.etree.ElementTree as ET

from ..errors import QueryError
from ..functions.values import is_number, kind, text
from . import formats

OUTPUTS = ("json", "yaml", "toml", "xml", "csv", "tsv", "hcl")


def to_json(v, pretty: bool = True) -> str:
    try:
        return json.dumps(v, ensure_ascii=False, allow_nan=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
    except ValueError as e:
        raise QueryError(f"JSON output: {e}") from e


def to_yaml(v) -> str:
    import yaml

    class Dumper(yaml.SafeDumper):  # quotes what either version of YAML would read as something else
        yaml_implicit_resolvers = {k: list(x) for k, x in yaml.SafeDumper.yaml_implicit_resolvers.items()}

    for tag, pattern, first in formats.CORE:
        Dumper.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"(?:{pattern})\\Z"), ["" if c == "\0" else c for c in first])
    return yaml.dump(v, Dumper=Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False)


def _key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)


def _scalar(v) -> str:
    if isinstance(v, float) and not math.isfinite(v):
        return "nan" if v != v else "inf" if v > 0 else "-inf"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    return text(v)


def _toml_value(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(_toml_value(x) for x in v if x is not None) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_key(k)} = {_toml_value(x)}" for k, x in v.items() if x is not None) + "}"
    return _scalar(v)


def to_toml(v, path: tuple[str, ...] = ()) -> str:
    if not isinstance(v, dict):
        raise QueryError(f"a TOML document is a map; the result is {kind(v)}")
    tables = {k: x for k, x in v.items() if isinstance(x, dict)}
    lists = {k: x for k, x in v.items() if isinstance(x, list) and x and all(isinstance(y, dict) for y in x)}
    out = [f"{_key(k)} = {_toml_value(x)}\n" for k, x in v.items() if x is not None and k not in tables and k not in lists]
    for k, x in tables.items():
        out.append(("\n" if out else "") + f"[{'.'.join(map(_key, (*path, k)))}]\n" + to_toml(x, (*path, k)))
    for k, x in lists.items():
        for y in x:
            out.append(("\n" if out else "") + f"[[{'.'.join(map(_key, (*path, k)))}]]\n" + to_toml(y, (*path, k)))
    return "".join(out)


def _xml_name(k: str) -> str:
    k = re.sub(r"[^\w.-]", "_", k)
    return k if re.match(r"[A-Za-z_]", k) else f"_{k}"


def _fill(e: ET.Element, v) -> None:
    if isinstance(v, dict):
        for k, x in v.items():
            if k.startswith("@") and not isinstance(x, (dict, list)):
                e.set(_xml_name(k[1:]), text(x))
            elif k == "#text":
                e.text = text(x)
            else:
                for y in x if isinstance(x, list) else [x]:
                    _fill(ET.SubElement(e, _xml_name(k)), y)
    elif isinstance(v, list):
        for y in v:
            _fill(ET.SubElement(e, "item"), y)
    elif v is not None:
        e.text = text(v)


def to_xml(v) -> str:
    """A map of one key has that as its root; anything else stands under ``root``."""
    one = isinstance(v, dict) and len(v) == 1 and not isinstance(next(iter(v.values())), list)
    root = ET.Element(_xml_name(next(iter(v))) if one else "root")
    _fill(root, next(iter(v.values())) if one else v)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode") + "\n"


def to_delimited(v, delimiter: str) -> str:
    if not isinstance(v, list):
        raise QueryError(f"rows of CSV or TSV come from a list; the result is {kind(v)}")
    if not v:
        return ""
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    if isinstance(v[0], dict):
        head = list(v[0])
        w.writerow(head)
        w.writerows(["" if (r or {}).get(k) is None else text(r[k]) for k in head] for r in v)
    elif isinstance(v[0], list):
        w.writerows([text(c) for c in r] for r in v)
    else:
        w.writerows([text(x)] for x in v)
    return out.getvalue()


def _hcl_value(v, pad: str) -> str:
    if isinstance(v, dict):
        inner = "".join(f"{pad}  {_key(k)} = {_hcl_value(x, pad + '  ')}\n" for k, x in v.items())
        return "{\n" + inner + pad + "}"
    if isinstance(v, list):
        return "[" + ", ".join(_hcl_value(x, pad) for x in v) + "]"
    return _scalar(v)


def to_hcl(v, pad: str = "") -> str:
    if not isinstance(v, dict):
        raise QueryError(f"an HCL document is a map; the result is {kind(v)}")
    out = []
    for k, x in v.items():
        blocks = [x] if isinstance(x, dict) else x if isinstance(x, list) and x and all(isinstance(y, dict) for y in x) else None
        if blocks is None:
            out.append(f"{pad}{_key(k)} = {_hcl_value(x, pad)}\n")
            continue
        for b in blocks:
            labels = "".join(f" {json.dumps(s)}" for s in b.get("_labels", []))
            out.append(f"{pad}{_key(k)}{labels} {{\n{to_hcl({n: y for n, y in b.items() if n != '_labels'}, pad + '  ')}{pad}}}\n")
    return "".join(out)


def write(v, fmt: str, pretty: bool = True) -> str:
    """A value as text."""
    if fmt == "json":
        return to_json(v, pretty)
    if fmt in ("csv", "tsv"):
        return to_delimited(v, "," if fmt == "csv" else "\t")
    made = {"yaml": to_yaml, "toml": to_toml, "xml": to_xml, "hcl": to_hcl}
    if fmt not in made:
        raise QueryError(f"unknown output format {fmt}")
    return made[fmt](v)


def is_scalar(v) -> bool:
    return v is None or isinstance(v, (str, bool)) or is_number(v)

"""Markdown as a tree of maps: blocks first, then the inlines of each."""

from __future__ import annotations

import html
import re
from contextvars import ContextVar

_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}\Z")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)\Z")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( {1,4}|\t|\Z)(.*)\Z")
_QUOTE = re.compile(r" {0,3}> ?(.*)\Z")
_HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|\Z)|!--|\?|![A-Z])")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LINK = re.compile(r"""\(\s*(?:<([^>\n]*)>|([^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:"([^"]*)"|'([^']*)'|\(([^)]*)\)))?\s*\)""")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_TAG = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?|!--.*?--|\?.*?\?)>", re.S)
_DEFINITION = re.compile(r""" {0,3}\[((?:\\.|[^\[\]\\])+)\]: *(?:<([^<>]*)>|([^\s<]\S*))(?: +(?:"([^"]*)"|'([^']*)'|\(([^()]*)\)))? *""")
_references: ContextVar[dict[str, tuple[str, str | None]]] = ContextVar("references", default={})


def parse_markdown(text: str) -> dict:
    lines, found = _definitions(text.expandtabs(4).splitlines())
    before = _references.set(found)
    try:
        return {"type": "document", "children": blocks(lines)}
    finally:
        _references.reset(before)


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _definitions(lines: list[str]) -> tuple[list[str], dict[str, tuple[str, str | None]]]:
    """Lines without link definitions, and these by label; the first of a label counts. Fenced code and
    lines that continue a paragraph hold none."""
    kept: list[str] = []
    found: dict[str, tuple[str, str | None]] = {}
    fence, free = None, True
    for line in lines:
        m = _FENCE.match(line)
        if fence is None and m:
            fence = m[1]
        elif fence is not None and re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}} *", line):
            fence = None
        elif fence is None and free and (d := _DEFINITION.fullmatch(line)) and _label(d[1]):
            title = next((t for t in d.groups()[3:] if t is not None), None)
            found.setdefault(_label(d[1]), (html.unescape(d[2] if d[2] is not None else d[3]), title))
            continue
        free = not line.strip() or bool(_HEADING.match(line) or _RULE.match(line))
        kept.append(line)
    return kept, found


def _starts(line: str) -> bool:
    """Whether a line ends a paragraph by what it begins."""
    item = _ITEM.match(line)
    return bool(_RULE.match(line) or _HEADING.match(line) or _FENCE.match(line) or _QUOTE.match(line) or (item and item[4] and (not item[2][0].isdigit() or item[2][:-1] == "1")) or _HTML.match(line))


def blocks(lines: list[str]) -> list[dict]:
    out: list[dict] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.startswith("    "):
            code = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                code.append(lines[i][4:])
                i += 1
            while code and not code[-1].strip():
                code.pop()
            out.append({"type": "code_block", "code": "\n".join(code) + "\n"})
        elif _RULE.match(line):
            out.append({"type": "thematic_break"})
            i += 1
        elif m := _HEADING.match(line):
            out.append({"type": "heading", "level": len(m[1]), "children": inlines((m[2] or "").strip())})
            i += 1
        elif m := _FENCE.match(line):
            fence, info, code = m[1], m[2].strip(), []
            i += 1
            while i < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", lines[i]):
                code.append(lines[i])
                i += 1
            i += 1
            out.append({"type": "code_block", **({"language": info.split()[0]} if info else {}), "code": "".join(c + "\n" for c in code)})
        elif _QUOTE.match(line):
            inner = []
            while i < len(lines) and (m := _QUOTE.match(lines[i])):
                inner.append(m[1])
                i += 1
                while i < len(lines) and inner[-1].strip() and lines[i].strip() and not _QUOTE.match(lines[i]) and not _starts(lines[i]):
                    inner.append(lines[i])
                    i += 1
            out.append({"type": "blockquote", "children": blocks(inner)})
        elif _ITEM.match(line):
            block, i = _list(lines, i)
            out.append(block)
        elif _HTML.match(line):
            raw = []
            while i < len(lines) and lines[i].strip():
                raw.append(lines[i])
                i += 1
            out.append({"type": "html_block", "html": "\n".join(raw) + "\n"})
        else:
            para = [line.lstrip()]
            i += 1
            level = 0
            while i < len(lines) and lines[i].strip():
                if m := _SETEXT.match(lines[i]):
                    level = 1 if m[1][0] == "=" else 2
                    i += 1
                    break
                if _starts(lines[i]):
                    break
                para.append(lines[i].lstrip())
                i += 1
            children = inlines("\n".join(para).rstrip())
            out.append({"type": "heading", "level": level, "children": children} if level else {"type": "paragraph", "children": children})
    return out


def _list(lines: list[str], i: int) -> tuple[dict, int]:
    first = _ITEM.match(lines[i])
    ordered = first[2][0].isdigit()
    items, tight = [], True
    while i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == first[2][-1] and m[2][0].isdigit() == ordered and not _RULE.match(lines[i]):
        indent = len(m[1]) + len(m[2]) + (len(m[3]) if m[4] else 1)
        inner, gap = [m[4]], False
        i += 1
        while i < len(lines):
            if not lines[i].strip():
                gap = True
                inner.append("")
            elif lines[i].startswith(" " * indent):
                if gap:
                    tight = False
                gap = False
                inner.append(lines[i][indent:])
            elif not gap and not _starts(lines[i]) and not _ITEM.match(lines[i]):
                inner.append(lines[i])
            else:
                break
            i += 1
        if gap and i < len(lines) and (n := _ITEM.match(lines[i])) and n[2][-1] == first[2][-1]:
            tight = False
        items.append({"type": "list_item", "children": blocks(inner)})
    return {"type": "list", "ordered": ordered, **({"start": int(first[2][:-1])} if ordered else {}), "tight": tight, "items": items}, i


def inlines(text: str) -> list[dict]:
    nodes: list = []  # dicts, and [char, count, opens, closes] for runs that may be emphasis
    run: list[str] = []

    def flush() -> None:
        if run:
            nodes.append({"type": "text", "text": html.unescape("".join(run))})
            run.clear()

    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            if text[i + 1] == "\n":
                flush()
                nodes.append({"type": "hard_break"})
                i += 2
                continue
            run.append(text[i + 1] if text[i + 1] in _PUNCTUATION else c + text[i + 1])
            i += 2
        elif c == "\n":
            hard = "".join(run).endswith("  ")
            if run:
                run[:] = ["".join(run).rstrip(" ")]
            flush()
            nodes.append({"type": "hard_break" if hard else "soft_break"})
            i += 1
        elif c == "`":
            ticks = re.match("`+", text[i:])[0]
            end = re.search(rf"(?<!`){ticks}(?!`)", text[i + len(ticks) :])
            if not end:
                run.append(ticks)
                i += len(ticks)
                continue
            flush()
            code = text[i + len(ticks) : i + len(ticks) + end.start()].replace("\n", " ")
            if code.startswith(" ") and code.endswith(" ") and code.strip():
                code = code[1:-1]
            nodes.append({"type": "code", "code": code})
            i += len(ticks) + end.end()
        elif c == "<" and (m := _AUTO.match(text, i)):
            flush()
            nodes.append({"type": "link", "href": ("mailto:" if "@" in m[1] and ":" not in m[1] else "") + m[1], "children": [{"type": "text", "text": m[1]}]})
            i = m.end()
        elif c == "<" and (m := _TAG.match(text, i)):
            flush()
            nodes.append({"type": "html_inline", "html": m[0]})
            i = m.end()
        elif (c == "[" or text.startswith("![", i)) and (found := _bracketed(text, i + (c == "!"))):
            inner, m = found
            flush()
            href, title = html.unescape(m[1] if m[1] is not None else m[2]), next((t for t in m.groups()[2:] if t is not None), None)
            extra = {"title": title} if title is not None else {}
            if c == "!":
                nodes.append({"type": "image", "src": href, "alt": "".join(_plain(inlines(inner))), **extra})
            else:
                nodes.append({"type": "link", "href": href, **extra, "children": inlines(inner)})
            i = m.end()
        elif (c == "[" or text.startswith("![", i)) and (known := _referenced(text, i + (c == "!"))):
            inner, (href, title), i_after = known
            flush()
            extra = {"title": title} if title is not None else {}
            if c == "!":
                nodes.append({"type": "image", "src": href, "alt": "".join(_plain(inlines(inner))), **extra})
            else:
                nodes.append({"type": "link", "href": href, **extra, "children": inlines(inner)})
            i = i_after
        elif c in "*_":
            flush()
            signs = re.match(re.escape(c) + "+", text[i:])[0]
            before, after = text[i - 1 : i] if i else " ", text[i + len(signs) : i + len(signs) + 1] or " "
            left = not after.isspace() and (after not in _PUNCTUATION or before.isspace() or before in _PUNCTUATION)
            right = not before.isspace() and (before not in _PUNCTUATION or after.isspace() or after in _PUNCTUATION)
            opens = left and (c == "*" or not right or before in _PUNCTUATION)
            closes = right and (c == "*" or not left or after in _PUNCTUATION)
            nodes.append([c, len(signs), opens, closes])
            i += len(signs)
        else:
            run.append(c)
            i += 1
    flush()
    return _emphasised(nodes)


def _closing(text: str, at: int) -> int:
    """Where the bracket at ``at`` is closed, or -1."""
    depth, k = 0, at
    while k < len(text):
        if text[k] == "\\":
            k += 1
        elif text[k] == "[":
            depth += 1
        elif text[k] == "]":
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def _bracketed(text: str, at: int):
    k = _closing(text, at)
    m = _LINK.match(text, k + 1) if k >= 0 else None
    return (text[at + 1 : k], m) if m else None


def _referenced(text: str, at: int):
    """A link by its label: [text][label], [label][] or [label]."""
    k = _closing(text, at)
    if k < 0 or not _references.get():
        return None
    inner, end = text[at + 1 : k], k + 1
    label = inner
    if text.startswith("[", end) and (stop := _closing(text, end)) >= 0:
        label, end = text[end + 1 : stop] or inner, stop + 1
    known = _references.get().get(_label(label))
    return (inner, known, end) if known else None


def _emphasised(nodes: list) -> list[dict]:
    k = 0
    while k < len(nodes):
        n = nodes[k]
        if isinstance(n, list) and n[3] and n[1]:
            o = next((j for j in range(k - 1, -1, -1) if isinstance(nodes[j], list) and nodes[j][0] == n[0] and nodes[j][2] and nodes[j][1]), None)
            if o is not None:
                use = 2 if n[1] >= 2 and nodes[o][1] >= 2 else 1
                made = {"type": "strong" if use == 2 else "emphasis", "children": _emphasised(nodes[o + 1 : k])}
                nodes[o][1] -= use
                n[1] -= use
                nodes[o + 1 : k] = [made]
                k = o + 2
                continue
        k += 1
    out: list[dict] = []
    for n in nodes:
        n = {"type": "text", "text": n[0] * n[1]} if isinstance(n, list) else n
        if n.get("type") == "text" and out and out[-1]["type"] == "text":
            out[-1] = {"type": "text", "text": out[-1]["text"] + n["text"]}
        elif n.get("text") != "":
            out.append(n)
    return out


def _plain(nodes: list[dict]) -> list[str]:
    return [n.get("text") or n.get("code") or n.get("alt") or "".join(_plain(n.get("children", []))) for n in nodes]

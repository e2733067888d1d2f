"""HCL: attributes and blocks as maps, lists and scalars.

A block's labels stand under ``_labels``; a block type that comes once is a map,
one that repeats is a list. Expressions that aren't literals stay text."""

from __future__ import annotations

import re

from ..errors import QueryError

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r]+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<nl>\n)|(?P<heredoc><<-?\s*(?P<tag>\w+)\n(?P<body>.*?)\n\s*(?P=tag)(?=\n|\Z))"""
    r"""|(?P<string>"(?:\\.|\$\{[^}]*\}|[^"\\])*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w-]*)|(?P<sign>=>|==|!=|<=|>=|&&|\|\||\.\.\.|[{}\[\]()=,:.?*/%+<>!&|-])""",
    re.S | re.X,
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"HCL parse error: unexpected {text[at : at + 10]!r}")
            kind = m.lastgroup if m.lastgroup not in ("tag", "body") else "heredoc"
            if m["heredoc"] is not None:
                kind = "heredoc"
            if kind != "skip":
                self.tokens.append((kind, m["body"] + "\n" if kind == "heredoc" else m[0], m.start(), m.end()))
            at = m.end()
        self.tokens.append(("end", "", at, at))
        self.at = 0

    def peek(self, k: int = 0) -> tuple:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def next(self) -> tuple:
        self.at += 1
        return self.tokens[self.at - 1]

    def lines(self) -> None:
        while self.peek()[0] == "nl":
            self.at += 1

    def expect(self, sign: str) -> None:
        if self.next()[1] != sign:
            raise QueryError(f"HCL parse error: expected {sign!r}, got {self.tokens[self.at - 1][1]!r}")

    def body(self, end: str) -> dict:
        out: dict = {}
        repeated: set[str] = set()
        while True:
            self.lines()
            kind, word, _, _ = self.peek()
            if word == end or (kind == "end" and not end):
                return out
            if kind not in ("name", "string"):
                raise QueryError(f"HCL parse error: unexpected {word!r}")
            self.next()
            name = self.unquoted(word) if kind == "string" else word
            if self.peek()[1] in ("=", ":"):
                self.next()
                out[name] = self.expression()
                continue
            labels = []
            while self.peek()[0] in ("string", "name"):
                k, w, _, _ = self.next()
                labels.append(self.unquoted(w) if k == "string" else w)
            self.expect("{")
            block = {"_labels": labels} if labels else {}
            block |= self.body("}")
            self.expect("}")
            if name not in out:
                out[name] = block
            elif name in repeated:
                out[name].append(block)
            else:
                out[name] = [out[name], block]
                repeated.add(name)

    def unquoted(self, s: str) -> str:
        return re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[0]), s[1:-1])

    def expression(self):
        start = self.at
        value, literal = self.simple()
        if literal and self.peek()[0] in ("nl", "end") or self.peek()[1] in (",", "}", "]"):
            if literal:
                return value
        depth = 0  # not a literal: its text, up to the line's end outside of brackets
        self.at = start
        first = self.peek()[2]
        last = first
        while True:
            kind, word, _, end = self.peek()
            if kind == "end" and depth > 0:
                raise QueryError("HCL parse error: a bracket isn't closed")
            if kind == "end" or (depth == 0 and (kind == "nl" or word in (",", "}", "]"))):
                return self.text[first:last]
            depth += (word in "([{") - (word in ")]}") if kind == "sign" else 0
            last = end
            self.next()

    def simple(self):
        kind, word, _, _ = self.next()
        if kind == "string":
            return self.unquoted(word), True
        if kind == "heredoc":
            return word, True
        if kind == "number":
            return (int(word) if re.fullmatch(r"-?\d+", word) else float(word)), True
        if kind == "name" and word in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word], True
        if word == "[":
            out = []
            self.lines()
            if self.peek()[1] == "for" and self.peek()[0] == "name":
                return None, False
            while self.peek()[1] != "]":
                out.append(self.expression())
                self.lines()
                if self.peek()[1] == ",":
                    self.next()
                    self.lines()
                elif self.peek()[1] != "]":
                    return None, False
            self.next()
            return out, True
        if word == "{":
            made: dict = {}
            self.lines()
            while self.peek()[1] != "}":
                kind, key, _, _ = self.next()
                if kind not in ("string", "name", "number") or self.peek()[1] not in ("=", ":"):
                    return None, False
                self.next()
                made[self.unquoted(key) if kind == "string" else key] = self.expression()
                self.lines()
                if self.peek()[1] == ",":
                    self.next()
                    self.lines()
            self.next()
            return made, True
        return None, False


def parse_hcl(text: str) -> dict:
    return _Reader(text).body("")

"""Callables of Rust sources, by a lexer: the token tier.

Two bodies hash alike when their parameters and bodies have the same tokens; layout, comments
and the function's own name don't count, renamed locals do.
"""

from __future__ import annotations

import regex

from ...functions.hashing import fnv1a_bytes

TOKEN = regex.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&block))*\*/)
      |(?P<text>b?r(?P<h>\#*)".*?"(?P=h)|[bc]?"(?:[^"\\]|\\.)*"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\])')
      |(?P<life>'[\p{L}_][\p{L}\p{N}_]*)
      |(?P<number>\d[\w.]*(?<!\.)(?:(?<=[eE])[+-]\d+)?)
      |(?P<word>(?:r\#)?[\p{L}_][\p{L}\p{N}_]*)
      |(?P<mark>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||<<=|>>=|[-+*/%^&|=!<>]=|.)
      (?(DEFINE)(?P<block>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&block))*\*/))""",
    regex.X | regex.S,
)
CLOSING = {"(": ")", "[": "]", "{": "}"}


def lex(src: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of each token; comments and white space are left out."""
    out, line = [], 1
    for m in TOKEN.finditer(src):
        text, kind = m[0], next(k for k in ("skip", "text", "life", "number", "word", "mark") if m[k] is not None)
        if kind != "skip":
            out.append((kind, text, line))
        line += text.count("\n")
    return out


class _Reader:
    def __init__(self, src: str) -> None:
        self.t = lex(src)
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        self.broken = False
        for i, (kind, text, _) in enumerate(self.t):
            if kind != "mark":
                continue
            if text in CLOSING:
                stack.append(i)
            elif text in ")]}":
                if stack and CLOSING[self.t[stack[-1]][1]] == text:
                    self.pair[stack.pop()] = i
                else:
                    self.broken = True
        self.broken |= bool(stack)
        self.out: list[dict] = []

    def is_mark(self, i: int, text: str) -> bool:
        return i < len(self.t) and self.t[i][0] == "mark" and self.t[i][1] == text

    def word(self, i: int) -> str | None:
        return self.t[i][1] if i < len(self.t) and self.t[i][0] == "word" else None

    def until(self, i: int, end: int, marks: str) -> int:
        """The next of some marks outside brackets, or the end."""
        while i < end:
            if self.t[i][0] == "mark":
                if self.t[i][1] in marks:
                    return i
                if self.t[i][1] in CLOSING:
                    i = self.pair.get(i, end)
            i += 1
        return end

    def angles(self, i: int, end: int) -> int:
        """Past a list of generics that begins here, if one does."""
        if not self.is_mark(i, "<"):
            return i
        depth = 0
        while i < end:
            text = self.t[i][1] if self.t[i][0] == "mark" else ""
            depth += {"<": 1, ">": -1, "<<": 2, ">>": -2}.get(text, 0)
            i += 1
            if depth <= 0:
                break
        return i

    def walk(self, i: int, end: int, owner: str) -> None:
        first = i
        while i < end:
            w = self.word(i)
            if w == "fn" and self.word(i + 1):
                i = self.function(i, first, end, owner)
                continue
            if w in ("mod", "trait") and self.word(i + 1) or w == "impl" and (i == first or not self.is_mark(i - 1, ":") and not self.is_mark(i - 1, "->") and not self.is_mark(i - 1, "<") and not self.is_mark(i - 1, "(") and not self.is_mark(i - 1, ",") and not self.is_mark(i - 1, "&")):
                brace = self.until(i, end, "{;")
                if self.is_mark(brace, "{") and brace in self.pair:
                    name = self.word(i + 1) if w != "impl" else self.impl_type(i + 1, brace)
                    self.walk(brace + 1, self.pair[brace], "::".join(x for x in (owner, name) if x))
                    i = self.pair[brace] + 1
                    continue
            i += 1

    def impl_type(self, i: int, end: int) -> str:
        """The plain name of the type of an impl: after `for` if there is one, without path and generics."""
        i = self.angles(i, end)
        stop = next((k for k in range(i, end) if self.word(k) == "where"), end)
        for k in range(i, stop):
            if self.word(k) == "for" and not self.is_mark(k + 1, "<"):
                i = k + 1
        name = ""
        while i < stop:
            if self.t[i][0] == "word" and self.t[i][1] not in ("dyn", "mut", "const"):
                name = self.t[i][1]
                if not self.is_mark(i + 1, "::"):
                    break
            i += 1
        return name

    def function(self, i: int, first: int, end: int, owner: str) -> int:
        name = self.word(i + 1)
        start, public = i, "private"
        while start > first:  # back over the modifiers
            t = self.t[start - 1]
            if t[0] == "word" and t[1] in ("pub", "const", "async", "unsafe", "extern", "default") or t[0] == "text":
                start -= 1
            elif t[1] == ")":
                opening = next((k for k in range(start - 2, max(first, start - 12), -1) if self.pair.get(k) == start - 1), None)
                if opening is None or self.word(opening - 1) != "pub":
                    break
                start = opening
            else:
                break
            if self.word(start) == "pub":
                public = "protected" if self.is_mark(start + 1, "(") else "public"
        at = self.angles(i + 2, end)
        if not self.is_mark(at, "(") or at not in self.pair:
            return i + 2
        close = self.pair[at]
        stop = self.until(close + 1, end, "{;")
        params, has_self, k = [], False, at + 1
        while k < close:
            comma = self.until_comma(k, close)
            words = [self.t[x][1] for x in range(k, comma) if self.t[x][0] == "word"]
            colon = next((x for x in range(k, comma) if self.is_mark(x, ":")), comma)
            before = [self.t[x][1] for x in range(k, colon)]
            if "self" in before:
                has_self = True
            elif words and colon < comma:
                params.append({"kind": "req", "name": "".join(x if x not in ("mut", "ref") else x + " " for x in before)})
            k = comma + 1
        body = self.is_mark(stop, "{") and stop in self.pair
        last = self.pair[stop] if body else min(stop, len(self.t) - 1)
        h = nodes = None
        if body:
            h = fnv1a_bytes(b"rust")
            for x in [*range(at, close + 1), *range(stop, last + 1)]:
                h = fnv1a_bytes(b"\xff", fnv1a_bytes(self.t[x][1].encode(), h))
            nodes = sum(self.t[x][0] != "mark" or self.t[x][1] in CLOSING for x in range(stop + 1, last))
        self.out.append({
            "lang": "rust", "name": name, "owner": owner, "singleton": not has_self, "visibility": public, "params": params, "via": None, "line": self.t[start][2], "end_line": self.t[last][2] + self.t[last][1].count("\n"),
            "norm_hash": None if h is None else f"{h:016x}", "nodes": nodes,
        })
        if body:
            self.walk(stop + 1, last, owner)
        return last + 1

    def until_comma(self, i: int, end: int) -> int:
        depth = 0
        while i < end:
            kind, text, _ = self.t[i]
            if kind == "mark":
                if text in CLOSING:
                    i = self.pair.get(i, end)
                elif text == "," and depth <= 0:
                    return i
                else:
                    depth += {"<": 1, ">": -1, "<<": 2, ">>": -2}.get(text, 0)
            i += 1
        return end


def units(src: str) -> tuple[list[dict], int, int]:
    """(units, lines, parse errors) of one source; brackets that don't match are one error."""
    r = _Reader(src)
    r.walk(0, len(r.t), "")
    return r.out, src.count("\n") + 1 if src else 0, int(r.broken)



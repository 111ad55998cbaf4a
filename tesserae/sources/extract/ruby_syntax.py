"""A reader of Ruby source: tokens, and a tree of the constructs that units are made of.

This is a tier of its own, not Ruby's parser: it knows the usual constructs, recovers at the
next line from what it doesn't know, and counts that as a parse error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = frozenset("alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__ BEGIN END".split())
#: After these a value begins, so a slash begins a pattern and a bracket an array.
OPENERS = frozenset("and begin case do else elsif ensure if in module not or rescue return then unless until when while yield class".split())
OPERATORS = sorted("**= <=> === ... <<= >>= &&= ||= ** == != >= <= && || << >> += -= *= /= %= |= &= ^= =~ !~ .. :: -> => &. ! = < > + - * / % & | ^ ~ ? : , . ( ) [ ] { } ;".split(), key=len, reverse=True)
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "s": " ", "0": "\0", "e": "\x1b", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*")
NAME = re.compile(r"[^\W\d]\w*[?!]?(?<!\?\?)")


@dataclass
class Tok:
    kind: str
    val: object
    line: int
    space: bool  # white space before it
    last: int = 0  # the line it ends on
    after: bool = False  # white space behind it


@dataclass
class Node:
    tag: str
    atoms: tuple = ()
    kids: list[Node] = field(default_factory=list)
    line: int = 0
    last: int = 0


class Lexer:
    def __init__(self, src: str, line: int = 1) -> None:
        self.s, self.i, self.line, self.out, self.docs = src, 0, line, [], []

    def value_before(self) -> bool:
        t = self.out[-1] if self.out else None
        if t is None or t.kind in ("nl", "label"):
            return False
        if t.kind == "kw":
            return t.val not in OPENERS
        return t.kind != "op" or t.val in (")", "]", "}")

    def put(self, kind: str, val: object, line: int, space: bool) -> None:
        self.out.append(Tok(kind, val, line, space, self.line, self.s[self.i : self.i + 1] in " \t\n"))

    def body(self, close: str, opening: str = "", plain: bool = False) -> list:
        """The parts of a literal up to its end: texts, and the tokens of interpolations."""
        parts, text, depth, s = [], [], 0, self.s
        while self.i < len(s):
            c = s[self.i]
            if c == "\\":
                n = s[self.i + 1 : self.i + 2]
                text.append(("\\" + n if n not in (close, "\\", opening) else n) if plain else ESCAPES.get(n, n))
                self.line += n == "\n"
                self.i += 2
                continue
            if c == close and not depth:
                self.i += 1
                break
            if not plain and c == "#" and s[self.i + 1 : self.i + 2] == "{":
                parts.append("".join(text))
                text.clear()
                self.i += 2
                sub = Lexer(s, self.line)
                sub.i = self.i
                parts.append(sub.run(until_brace=True))
                self.i, self.line = sub.i, sub.line
                continue
            depth += (c == opening) - (c == close and depth > 0)
            self.line += c == "\n"
            text.append(c)
            self.i += 1
        parts.append("".join(text))
        return [p for p in parts if p != ""]

    def heredocs(self) -> None:
        """The bodies of here-documents that began on the line that just ended."""
        for tok, name, plain, squiggly in self.docs:
            lines = []
            while self.i < len(self.s):
                end = self.s.find("\n", self.i)
                end = len(self.s) if end < 0 else end
                row, self.i = self.s[self.i : end], min(end + 1, len(self.s))
                self.line += 1
                if row.strip() == name:
                    break
                lines.append(row)
            if squiggly:
                indent = min((len(r) - len(r.lstrip()) for r in lines if r.strip()), default=0)
                lines = [r[indent:] for r in lines]
            text = "".join(r + "\n" for r in lines)
            tok.val = [text] if plain and text else Lexer(text + "\0", tok.line).body("\0")
        self.docs.clear()

    def run(self, until_brace: bool = False) -> list[Tok]:
        s, depth = self.s, 0
        while self.i < len(s):
            c, line, space = s[self.i], self.line, self.i > 0 and s[self.i - 1] in " \t\n\\"
            if c == "\n":
                self.i += 1
                self.put("nl", "\n", line, space)
                self.line += 1
                if self.docs:
                    self.heredocs()
                if s.startswith("=begin", self.i):
                    end = re.compile(r"^=end.*$", re.M).search(s, self.i)
                    stop = end.end() if end else len(s)
                    self.line += s.count("\n", self.i, stop)
                    self.i = stop
                elif s.startswith("__END__\n", self.i):
                    break
                continue
            if c in " \t\r\f\0":
                self.i += 1
                continue
            if c == "\\" and s[self.i + 1 : self.i + 2] == "\n":
                self.i += 2
                self.line += 1
                continue
            if c == "#":
                end = s.find("\n", self.i)
                self.i = len(s) if end < 0 else end
                continue
            if until_brace and c == "}" and not depth:
                self.i += 1
                break
            value = self.value_before()
            command = value and bool(self.out) and self.out[-1].kind == "id" and space and s[self.i + 1 : self.i + 2] not in (" ", "=", "\n", "")
            m = NUMBER.match(s, self.i) if c.isdigit() else None
            if m:
                self.i = m.end()
                text = m[0].replace("_", "").lower()
                self.put("num", str(int(text, 0)) if re.fullmatch(r"0[xbo][0-9a-f]+|[1-9]\d*|0", text) else text, line, space)
                continue
            if c in "\"`":
                self.i += 1
                parts = self.body(c)
                if s[self.i : self.i + 1] == ":" and s[self.i + 1 : self.i + 2] != ":" and c == '"':
                    self.i += 1
                    self.put("label", "".join(p for p in parts if isinstance(p, str)), line, space)
                else:
                    self.put("str" if c == '"' else "xstr", parts, line, space)
                continue
            if c == "'":
                self.i += 1
                self.put("str", self.body("'", plain=True), line, space)
                continue
            if c == ":" and s[self.i + 1 : self.i + 2] == '"':
                self.i += 2
                self.put("sym", "".join(p for p in self.body('"') if isinstance(p, str)), line, space)
                continue
            if c == ":" and (m := re.compile(r":([^\W\d]\w*[?!=]?(?!=|~|>)|[^\W\d]\w*|@{1,2}\w+|\$\w+|\[\]=?|<=>|===?|=~|!=|[+\-*/%<>!~^&|]=?)").match(s, self.i)) and s[self.i + 1] != ":" and not (value and not space and s[self.i - 1] == "?"):
                self.i = m.end()
                self.put("sym", m[1], line, space)
                continue
            if c in "@$" and (m := re.compile(r"@{1,2}\w+|\$(?:\w+|[^\s\w])").match(s, self.i)):
                self.i = m.end()
                self.put("ivar", m[0], line, space)
                continue
            if c == "%" and (not value or command) and (m := re.compile(r"%([wWiIqQrsx]?)([^\w\s])").match(s, self.i)):
                self.i = m.end()
                close = PAIRS.get(m[2], m[2])
                parts = self.body(close, m[2] if m[2] in PAIRS else "", m[1] in ("w", "i", "q", "s"))
                if m[1] and m[1] in "wWiI":
                    self.put("words", (m[1].lower(), "".join(p for p in parts if isinstance(p, str)).split()), line, space)
                elif m[1] == "r":
                    self.flags()
                    self.put("regex", parts, line, space)
                else:
                    self.put("sym" if m[1] == "s" else "str", parts if m[1] != "s" else "".join(map(str, parts)), line, space)
                continue
            if c == "/" and (not value or command):
                self.i += 1
                parts = self.body("/", plain=False)
                parts.append(self.flags())
                self.put("regex", parts, line, space)
                continue
            if c == "<" and (not value or command) and (m := re.compile(r"<<([~-]?)(?:\"([^\"\n]+)\"|'([^'\n]+)'|([A-Z_]\w*))").match(s, self.i)):
                self.i = m.end()
                self.put("str", [], line, space)
                self.docs.append((self.out[-1], m[2] or m[3] or m[4], m[3] is not None, m[1] == "~"))
                continue
            if c == "?" and not value and (m := re.compile(r"\?(\\?\S)(?!\w)").match(s, self.i)):
                self.i = m.end()
                self.put("str", [m[1]], line, space)
                continue
            if m := NAME.match(s, self.i):
                word = m[0]
                if word[-1] in "?!" and s[m.end() : m.end() + 1] == "=" and s[m.end() : m.end() + 2] not in ("==", "=~", "=>"):
                    word = word[:-1]
                end = self.i + len(word)
                dotted = bool(self.out) and self.out[-1].kind == "op" and self.out[-1].val in (".", "&.")
                after_def = bool(self.out) and self.out[-1].kind == "kw" and self.out[-1].val == "def"
                if s[end : end + 1] == ":" and s[end + 1 : end + 2] != ":" and not dotted and not (self.out and self.out[-1].val == "?" and self.out[-1].kind == "op" and s[end + 1 : end + 2] == " " and False):
                    ternary = self.open_ternary()
                    if not ternary or not s[end - 1].isspace() and s[end : end + 2] == ": " and self.out[-1].val in ("(", ",", "{", "|") :
                        self.i = end + 1
                        self.put("label", word, line, space)
                        continue
                self.i = end
                if word == "defined" and s[self.i : self.i + 1] == "?":
                    self.i += 1
                    word = "defined?"
                if word in KEYWORDS and not dotted and not (after_def and word not in ("self",)):
                    self.put("kw", word, line, space)
                else:
                    self.put("const" if word[0].isupper() else "id", word, line, space)
                continue
            op = next((o for o in OPERATORS if s.startswith(o, self.i)), None)
            if op is None:
                self.i += 1
                continue
            self.i += len(op)
            if until_brace:
                depth += (op == "{") - (op == "}")
            self.put("op", op, line, space)
        self.put("nl", "\n", self.line, False)
        return self.out

    def flags(self) -> str:
        m = re.compile(r"[imxounse]*").match(self.s, self.i)
        self.i = m.end()
        return m[0]

    def open_ternary(self) -> bool:
        """Whether a '?' on this line still waits for its ':'."""
        open_ = 0
        for t in reversed(self.out):
            if t.kind == "nl":
                break
            if t.kind == "op":
                open_ += (t.val == "?") - (t.val == ":")
        return open_ > 0


class SyntaxIssue(Exception):
    pass


BINARY = [("..", "..."), ("||",), ("&&",), ("<=>", "==", "===", "!=", "=~", "!~"), ("<", "<=", ">", ">="), ("|", "^"), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
LEVEL = {op: i for i, ops in enumerate(BINARY) for op in ops}
ASSIGN = frozenset("= += -= *= /= %= **= |= &= ^= <<= >>= &&= ||=".split())
VALUE_KINDS = frozenset("id const ivar num str xstr sym words regex label".split())
VALUE_WORDS = frozenset("nil true false self not defined? super yield case if unless begin def __FILE__ __LINE__ __method__ while proc lambda".split())


class Parser:
    def __init__(self, tokens: list[Tok]) -> None:
        self.t, self.i, self.errors, self.locals = tokens, 0, 0, [set()]

    # -- tokens
    @property
    def now(self) -> Tok:
        return self.t[min(self.i, len(self.t) - 1)]

    def peek(self, n: int = 1) -> Tok:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def done(self) -> bool:
        return self.i >= len(self.t)

    def op(self, *vals: str) -> bool:
        return not self.done() and self.now.kind == "op" and self.now.val in vals

    def kw(self, *vals: str) -> bool:
        return not self.done() and self.now.kind == "kw" and self.now.val in vals

    def next(self) -> Tok:
        if self.done():
            raise SyntaxIssue("end of input")
        self.i += 1
        return self.t[self.i - 1]

    def want(self, val: str) -> Tok:
        if self.now.val != val or self.now.kind not in ("op", "kw") or self.done():
            raise SyntaxIssue(f"{val} expected")
        return self.next()

    def lines(self) -> None:
        while not self.done() and (self.now.kind == "nl" or self.op(";")):
            self.i += 1

    def node(self, tag: str, start: Tok, atoms: tuple = (), kids: list[Node] | None = None) -> Node:
        return Node(tag, atoms, kids or [], start.line, self.t[max(0, min(self.i, len(self.t)) - 1)].last)

    # -- statements
    def block_of(self, *ends: str, closing: str = "") -> Node:
        start, kids = self.now, []
        self.lines()
        while not self.done() and not self.kw(*ends) and not (closing and self.op(closing)):
            at = self.i
            try:
                kids.append(self.statement())
                if not (self.done() or self.now.kind == "nl" or self.op(";") or self.kw(*ends) or closing and self.op(closing)):
                    raise SyntaxIssue(f"unexpected {self.now.val}")
            except SyntaxIssue:
                self.errors += 1
                self.i = max(self.i, at + 1)
                while not self.done() and self.now.kind != "nl":
                    self.i += 1
            self.lines()
        return self.node("stmts", start, (), kids)

    def statement(self) -> Node:
        start = self.now
        out = self.words_expression()
        while self.kw("if", "unless", "while", "until", "rescue"):
            word = self.next().val
            out = self.node({"if": "if", "unless": "unless"}.get(word, word), start, (), [self.words_expression(), out] if word != "rescue" else [out, self.words_expression()])
        return out

    def words_expression(self) -> Node:
        start = self.now
        left = self.node("not", self.next(), (), [self.words_expression()]) if self.kw("not") else self.expression_list()
        while self.kw("and", "or"):
            word = self.next().val
            self.lines()
            right = self.node("not", self.next(), (), [self.expression_list()]) if self.kw("not") else self.expression_list()
            left = self.node(word, start, (), [left, right])
        return left

    def expression_list(self) -> Node:
        """An expression, or several assigned at once."""
        start, at = self.now, self.i
        if self.op("*") or self.now.kind in ("id", "ivar", "const") or self.op("("):
            targets = self.many_targets()
            if targets:
                self.next()
                self.lines()
                values = [self.splat_or_expression()]
                while self.op(","):
                    self.next()
                    self.lines()
                    values.append(self.splat_or_expression())
                return self.node("masgn", start, (), [*targets, Node("array", (), values, start.line, start.line)])
            self.i = at
        return self.expression()

    def many_targets(self) -> list[Node]:
        """The targets of `a, b = ...`, standing at the '='; empty if this isn't one."""
        out, commas = [], 0
        while True:
            star = self.op("*")
            if star:
                self.next()
            if self.now.kind == "id" and not self.peek().val == "(" and self.peek().val not in (".", "&.", "["):
                out.append(Node("lwrite", (("name", self.now.val),), [], self.now.line, self.now.line))
                self.next()
            elif self.now.kind in ("ivar", "const"):
                out.append(Node("iwrite", (("value", self.now.val),), [], self.now.line, self.now.line))
                self.next()
            elif not star:
                return []
            if self.op(","):
                commas += 1
                self.next()
                continue
            if self.op("=") and (commas or star):
                for n in out:
                    if n.tag == "lwrite":
                        self.locals[-1].add(n.atoms[0][1])
                return out
            return []

    def splat_or_expression(self) -> Node:
        start = self.now
        if self.op("*", "**", "&") and not self.now.after:
            mark = self.next().val
            return self.node("splat", start, (("value", mark),), [self.expression()] if not self.op(")", ",") else [])
        return self.expression()

    def expression(self) -> Node:
        start = self.now
        left = self.ternary()
        if self.op(*ASSIGN):
            mark = self.next().val
            self.lines()
            kids = []
            if left.tag in ("lread", "call") and not left.kids and len(left.atoms) == 1:
                name = left.atoms[0][1]
                self.locals[-1].add(name)
                tag, atoms = "lwrite", (("name", name), *((("value", mark),) if mark != "=" else ()))
            else:
                tag, atoms, kids = "assign", (("value", mark),), [left]
            right = self.expression() if not self.op("*") else self.splat_or_expression()
            if self.op(",") and mark == "=" and self.flat_right:
                items = [right]
                while self.op(","):
                    self.next()
                    self.lines()
                    items.append(self.splat_or_expression())
                right = Node("array", (), items, start.line, start.line)
            if self.kw("rescue"):
                self.next()
                right = self.node("rescue", start, (), [right, self.expression()])
            return self.node(tag, start, atoms, [*kids, right])
        return left

    flat_right = False

    def ternary(self) -> Node:
        start = self.now
        cond = self.binary(0)
        if self.op("?"):
            self.next()
            self.lines()
            yes = self.ternary_arm()
            self.lines()
            if self.now.kind == "label":
                raise SyntaxIssue("ternary")
            self.want(":")
            self.lines()
            return self.node("if", start, (), [cond, yes, self.ternary_arm()])
        return cond

    def ternary_arm(self) -> Node:
        return self.expression()

    def binary(self, level: int) -> Node:
        start = self.now
        if level == len(BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while not self.done() and self.now.kind == "op" and LEVEL.get(self.now.val) == level:
            mark = self.next().val
            self.lines()
            if level == 0 and (self.done() or self.op(")", "]") or self.now.kind == "nl"):
                return self.node("binary", start, (("value", mark),), [left])
            left = self.node("binary", start, (("value", mark),), [left, self.binary(level + 1)])
        return left

    def unary(self) -> Node:
        start = self.now
        if self.op("!", "-", "+", "~", "&", "*", "**") and not self.done():
            mark = self.next().val
            if mark == "-" and self.now.kind == "num" and not self.now.space:
                n = self.next()
                return self.postfix(self.node("num", start, (("value", "-" + n.val),)))
            return self.node("unary", start, (("value", mark),), [self.unary()])
        if self.kw("defined?"):
            self.next()
            return self.node("defined", start, (), [self.unary()])
        out = self.postfix(self.primary())
        if self.op("**"):
            self.next()
            self.lines()
            out = self.node("binary", start, (("value", "**"),), [out, self.unary()])
        return out

    # -- calls
    def starts_argument(self) -> bool:
        if self.done() or not self.now.space:
            return False
        t = self.now
        if t.kind in VALUE_KINDS:
            return True
        if t.kind == "kw":
            return t.val in VALUE_WORDS and t.val not in ("if", "unless", "while")
        return t.kind == "op" and (t.val in ("->", "!", "::", "~") and not t.after or t.val in ("[", "-", "*", "&", "**", ":") and not t.after or t.val == "..." and False)

    def arguments(self, closing: str = "") -> list[Node]:
        out: list[Node] = []
        pairs: list[Node] = []
        if closing:
            self.lines()
        while not (closing and self.op(closing)):
            start = self.now
            if start.kind == "label":
                self.next()
                self.lines() if closing else None
                bare = self.op(",", closing or ",") or self.now.kind == "nl"
                key = Node("sym", (("value", start.val),), [], start.line, start.line)
                pairs.append(self.node("pair", start, (), [key] if bare else [key, self.argument_value()]))
            else:
                v = self.splat_or_expression() if not closing or True else self.expression()
                if closing and self.kw("if", "unless") and False:
                    pass
                if self.op("=>"):
                    self.next()
                    self.lines()
                    pairs.append(self.node("pair", start, (), [v, self.argument_value()]))
                else:
                    out.append(v)
            if closing:
                self.lines()
            if not self.op(","):
                break
            self.next()
            self.lines()
        if closing:
            self.want(closing)
        if pairs:
            out.append(Node("hash", (), pairs, pairs[0].line, pairs[-1].last))
        return out

    def argument_value(self) -> Node:
        return self.expression() if not self.kw("not") else self.words_expression()

    def maybe_block(self, braces: bool = True) -> list[Node]:
        if braces and self.op("{") or self.kw("do") and not self.no_do:
            start = self.next()
            self.locals.append(set(self.locals[-1]))
            kept, self.no_do = self.no_do, False
            params = []
            if self.op("|"):
                self.next()
                params = self.parameters("|")
            elif self.op("||"):
                self.next()
            body = self.block_of(closing="}") if start.val == "{" else self.body_with_rescue()
            self.want("}" if start.val == "{" else "end")
            self.no_do = kept
            self.locals.pop()
            return [self.node("block", start, (), [Node("params", (), params, start.line, start.line), body])]
        return []

    no_do = False

    def postfix(self, out: Node) -> Node:
        while not self.done():
            start_line = out.line
            if self.now.kind == "nl":
                k = self.i
                while k < len(self.t) and self.t[k].kind == "nl":
                    k += 1
                if k < len(self.t) and self.t[k].kind == "op" and self.t[k].val in (".", "&.") :
                    self.i = k
                else:
                    return out
            if self.op(".", "&."):
                mark = self.next().val
                self.lines()
                if self.op("("):
                    name = "call"
                else:
                    name = str(self.next().val)
                    if self.t[self.i - 1].kind == "label":  # a.b ? c.d: e is rare; treat as a name
                        raise SyntaxIssue("label after a dot")
                args, had = [], False
                if self.op("(") and not self.now.space:
                    self.next()
                    args, had = self.inside(lambda: self.arguments(")")), True
                elif self.starts_argument() and not self.op("[", "-", "*", "&", ":") or self.op("*", "&", "-", "[") and self.starts_argument() and self.op("*", "&"):
                    args = self.arguments()
                block = self.maybe_block()
                out = Node("call", (("value", name), ("value", mark), ("flag", had)), [out, *args, *block], start_line, self.t[self.i - 1].last)
            elif self.op("::") and not (self.now.space and not self.now.after):
                self.next()
                t = self.next()
                if t.kind == "const" and not (self.op("(") and not self.now.space):
                    out = Node("colon", (("value", t.val),), [out], start_line, t.last)
                else:
                    args = []
                    if self.op("(") and not self.now.space:
                        self.next()
                        args = self.inside(lambda: self.arguments(")"))
                    out = Node("call", (("value", str(t.val)), ("value", "::"), ("flag", True)), [out, *args, *self.maybe_block()], start_line, self.t[self.i - 1].last)
            elif self.op("[") and not self.now.space:
                self.next()
                out = Node("index", (), [out, *self.inside(lambda: self.arguments("]"))], start_line, self.t[self.i - 1].last)
            else:
                return out
        return out

    def inside(self, f):
        """Within brackets a `do` belongs to what is inside."""
        kept, self.no_do = self.no_do, False
        out = f()
        self.no_do = kept
        return out

    def identifier(self, t: Tok) -> Node:
        name = t.val
        if name in self.locals[-1] and not (self.op("(") and not self.now.space):
            return self.node("lread", t, (("name", name),))
        args, had = [], False
        if self.op("(") and not self.now.space:
            self.next()
            args, had = self.inside(lambda: self.arguments(")")), True
        elif self.starts_argument():
            args = self.arguments()
        block = self.maybe_block()
        atoms = (("value", name),) if not args and not had and not block else (("value", name), ("value", ""), ("flag", had))
        return self.node("call" if args or had or block or True else "", t, atoms, [*args, *block])

    # -- values
    def parts(self, tag: str, t: Tok) -> Node:
        kids = []
        for p in t.val:
            if isinstance(p, str):
                kids.append(Node("text", (("value", p),), [], t.line, t.line))
            else:
                sub = Parser(p)
                sub.locals = self.locals
                kids.append(sub.block_of())
                self.errors += sub.errors
        if len(kids) <= 1 and all(k.tag == "text" for k in kids):
            return self.node(tag, t, (("value", kids[0].atoms[0][1] if kids else ""),))
        return self.node("d" + tag, t, (), kids)

    def primary(self) -> Node:
        t = self.now
        if self.done() or t.kind == "nl":
            raise SyntaxIssue("a value expected")
        if t.kind in ("str", "xstr", "regex"):
            self.next()
            out = self.parts(t.kind, t)
            while not self.done() and self.now.kind == "str" and t.kind == "str":  # adjacent literals
                out = self.node("dstr", t, (), [out, self.parts("str", self.next())])
            return out
        if t.kind in ("num", "sym", "ivar"):
            self.next()
            return self.node(t.kind, t, (("value", t.val),))
        if t.kind == "words":
            self.next()
            return self.node("array", t, (), [Node("sym" if t.val[0] == "i" else "str", (("value", w),), [], t.line, t.line) for w in t.val[1]])
        if t.kind == "id":
            self.next()
            return self.identifier(t)
        if t.kind == "const":
            self.next()
            if self.op("(") and not self.now.space or not self.done() and self.now.kind == "str" and self.now.space:
                return self.identifier(t)
            return self.node("const", t, (("value", t.val),))
        if t.kind == "label":
            return self.node("hash", t, (), self.arguments())
        if t.kind == "op":
            return self.bracketed(t)
        return self.keyword(t)

    def bracketed(self, t: Tok) -> Node:
        if t.val == "(":
            self.next()
            body = self.inside(lambda: self.block_of(closing=")"))
            self.want(")")
            return body.kids[0] if len(body.kids) == 1 else body
        if t.val == "[":
            self.next()
            return self.node("array", t, (), self.inside(lambda: self.arguments("]")))
        if t.val == "{":
            self.next()
            kids = self.inside(lambda: self.arguments("}"))
            return self.node("hash", t, (), kids[0].kids if len(kids) == 1 and kids[0].tag == "hash" else kids)
        if t.val == "->":
            self.next()
            self.locals.append(set(self.locals[-1]))
            params = []
            if self.op("("):
                self.next()
                params = self.parameters(")")
            elif self.now.kind in ("id", "label"):
                params = self.parameters("")
            kept, self.no_do = self.no_do, False
            block = self.maybe_block()
            self.no_do = kept
            self.locals.pop()
            return self.node("lambda", t, (), [Node("params", (), params, t.line, t.line), *block])
        if t.val == "::":
            self.next()
            return self.node("colon", t, (("value", self.next().val),))
        if t.val in ("..", "..."):
            self.next()
            return self.node("binary", t, (("value", t.val),), [self.binary(1)])
        raise SyntaxIssue(f"unexpected {t.val}")

    def keyword(self, t: Tok) -> Node:
        word = self.next().val
        if word in ("nil", "true", "false", "self", "__FILE__", "__LINE__", "__method__", "redo", "retry"):
            return self.node(word, t)
        if word in ("return", "break", "next"):
            args = self.arguments() if not (self.done() or self.now.kind == "nl" or self.op(";", "}", ")") or self.kw("if", "unless", "end", "while", "until", "and", "or")) else []
            return self.node(word, t, (), args)
        if word in ("super", "yield"):
            args, had = [], False
            if self.op("(") and not self.now.space:
                self.next()
                args, had = self.inside(lambda: self.arguments(")")), True
            elif self.starts_argument():
                args, had = self.arguments(), True
            return self.node(word if had else "z" + word, t, (), [*args, *self.maybe_block()])
        if word == "if" or word == "unless":
            return self.conditional(t, word)
        if word in ("while", "until"):
            cond = self.head()
            if self.kw("do"):
                self.next()
            body = self.block_of("end")
            self.want("end")
            return self.node(word, t, (), [cond, body])
        if word == "for":
            targets = [self.target()]
            while self.op(","):
                self.next()
                targets.append(self.target())
            self.want("in")
            over = self.head()
            if self.kw("do"):
                self.next()
            body = self.block_of("end")
            self.want("end")
            return self.node("for", t, (), [*targets, over, body])
        if word == "case":
            return self.case(t)
        if word == "begin":
            body = self.body_with_rescue()
            self.want("end")
            return self.node("begin", t, (), [body])
        if word == "def":
            return self.definition(t)
        if word in ("class", "module"):
            return self.container(t, word)
        if word in ("alias", "undef"):
            names = [str(self.next().val)]
            if word == "alias":
                names.append(str(self.next().val))
            return self.node(word, t, tuple(("value", n) for n in names))
        if word == "not":
            return self.node("not", t, (), [self.expression()])
        if word in ("BEGIN", "END"):
            return self.node(word, t, (), self.maybe_block())
        raise SyntaxIssue(f"unexpected {word}")

    def target(self) -> Node:
        n = self.next()
        self.locals[-1].add(n.val)
        return Node("lwrite", (("name", n.val),), [], n.line, n.line)

    def head(self) -> Node:
        """A condition before a body: its `do` begins the body."""
        kept, self.no_do = self.no_do, True
        out = self.statement_head()
        self.no_do = kept
        return out

    def statement_head(self) -> Node:
        return self.words_expression()

    def conditional(self, t: Tok, word: str) -> Node:
        cond = self.head()
        if self.kw("then"):
            self.next()
        kids = [cond, self.block_of("elsif", "else", "end")]
        if self.kw("elsif"):
            kids.append(self.conditional(self.next(), "if"))
            return self.node(word, t, (), kids)
        if self.kw("else"):
            self.next()
            kids.append(self.block_of("end"))
        self.want("end")
        return self.node(word, t, (), kids)

    def case(self, t: Tok) -> Node:
        kids = [self.words_expression()] if self.now.kind != "nl" else []
        self.lines()
        while self.kw("when", "in"):
            start = self.next()
            tests = self.arguments()
            if self.kw("then"):
                self.next()
            kids.append(self.node("when", start, (), [*tests, self.block_of("when", "in", "else", "end")]))
        if self.kw("else"):
            self.next()
            kids.append(self.block_of("end"))
        self.want("end")
        return self.node("case", t, (), kids)

    def body_with_rescue(self) -> Node:
        start = self.now
        kids = [self.block_of("rescue", "else", "ensure", "end")]
        while self.kw("rescue", "else", "ensure"):
            at = self.next()
            tests = []
            if at.val == "rescue" and self.now.kind != "nl" and not self.kw("then"):
                if not self.op("=>"):
                    kept, self.rescuing = getattr(self, "rescuing", False), True
                    tests = [self.splat_or_binary()]
                    while self.op(","):
                        self.next()
                        self.lines()
                        tests.append(self.splat_or_binary())
                    self.rescuing = kept
                if self.op("=>"):
                    self.next()
                    tests.append(self.target())
            if self.kw("then"):
                self.next()
            kids.append(self.node(at.val, at, (), [*tests, self.block_of("rescue", "else", "ensure", "end")]))
        return kids[0] if len(kids) == 1 else self.node("guarded", start, (), kids)

    def splat_or_binary(self) -> Node:
        return self.binary(1)

    def container(self, t: Tok, word: str) -> Node:
        if word == "class" and self.op("<<"):
            self.next()
            kids = [self.expression()]
            tag = "sclass"
        else:
            first = self.primary()
            kids, tag = [self.postfix(first)], word
            if word == "class" and self.op("<"):
                self.next()
                kids.append(self.expression())
        self.locals.append(set())
        kids.append(self.body_with_rescue())
        self.locals.pop()
        self.want("end")
        return self.node(tag, t, (), kids)

    def definition(self, t: Tok) -> Node:
        n = self.next()
        name, on = n.val, ""
        if self.op(".") or n.kind == "kw" and n.val == "self":
            self.want(".")
            on, n = str(name), self.next()
            name = n.val
        if n.kind == "op":
            name = str(n.val)
            if name == "[" :
                self.want("]")
                name = "[]"
            elif self.op("@"):
                self.next()
        if n.kind == "label":  # def a:  can't be; treat as an error
            raise SyntaxIssue("a name expected")
        if n.kind == "ivar":
            raise SyntaxIssue("a name expected")
        if self.op("=") and not self.now.space and (self.peek().val == "(" or self.peek().kind == "id" and self.peek().space) and n.kind in ("id", "const") or name == "[]" and self.op("=") and not self.now.space:
            self.next()
            name = f"{name}="
        elif n.kind == "op" and name in ("=", "!") and self.op("="):
            self.next()
        self.locals.append(set())
        params = []
        if self.op("("):
            self.next()
            params = self.parameters(")")
        elif self.now.kind != "nl" and not self.op(";", "="):
            params = self.parameters("")
        kept, self.no_do = self.no_do, False
        if self.op("="):
            self.next()
            self.lines()
            body = self.statement()
        else:
            body = self.body_with_rescue()
            self.want("end")
        self.no_do = kept
        self.locals.pop()
        return self.node("def", t, (("value", str(name)), ("value", on)), [Node("params", (), params, t.line, t.line), body])

    def parameters(self, closing: str) -> list[Node]:
        out: list[Node] = []
        seen_rest = False
        self.lines() if closing else None
        while not (closing and self.op(closing)):
            t = self.now
            kind, name, kids = "req", "", []
            if self.op("*", "**", "&", "..."):
                mark = self.next().val
                if self.now.kind == "id":
                    name = self.next().val
                elif self.kw("nil"):
                    self.next()
                    mark = "nokey"
                kind = {"*": "rest", "**": "keyrest", "&": "block", "...": "rest", "nokey": "nokey"}[mark]
                seen_rest |= kind == "rest"
            elif t.kind == "label":
                name = self.next().val
                kind = "keyreq"
                if not (self.op(",", closing or ",") or self.now.kind == "nl"):
                    kind, kids = "key", [self.ternary() if closing != "|" else self.binary(6)]
            elif t.kind == "id":
                name = self.next().val
                if self.op("="):
                    self.next()
                    kind, kids = "opt", [self.ternary() if closing != "|" else self.binary(6)]
                elif seen_rest or any(p.atoms[0][1] == "opt" for p in out):
                    kind = "post" if closing != "|" else "req"
            elif self.op("("):
                self.next()
                inner = self.parameters(")")
                out.append(self.node("param", t, (("kind", "req"), ("name", "")), inner))
                name = None
            elif self.op(";"):
                self.next()
                continue
            else:
                raise SyntaxIssue("a parameter expected")
            if name is not None:
                if name:
                    self.locals[-1].add(name)
                out.append(self.node("param", t, (("kind", kind), ("name", name)), kids))
            self.lines() if closing else None
            if self.op(";") and closing == "|":
                continue
            if not self.op(","):
                break
            self.next()
            self.lines()
        if closing:
            self.want(closing)
        return out


def parse(src: str) -> tuple[Node, int]:
    """The tree of a source, and how many places weren't understood."""
    p = Parser(Lexer(src).run())
    try:
        out = p.block_of()
    except (SyntaxIssue, RecursionError):
        return Node("stmts"), p.errors + 1
    if not p.done():
        p.errors += 1
    return out, p.errors

"""Callables of Ruby sources, their signatures, and the constants they read.

Bodies hash by structure: layout, comments, quoting, number spelling and the names of locals
don't count; calls, literals and the order of locals do.  A signature is the set of shapes
of five nodes and more, each with the shape around it.
"""

from __future__ import annotations

import hashlib

from .ruby_syntax import Node, parse

MIN_NODES = 5
MAX_DEPTH = 200

#: What each macro defines for a literal name. {n} is the name, {s} its singular,
#: {p} its plural; a leading '.' marks a class method.
DSL = {
    "has_many": ("{n}", "{n}=", "{s}_ids", "{s}_ids="),
    "has_and_belongs_to_many": ("{n}", "{n}=", "{s}_ids", "{s}_ids="),
    "has_one": ("{n}", "{n}=", "build_{n}", "create_{n}", "create_{n}!", "reload_{n}"),
    "belongs_to": ("{n}", "{n}=", "build_{n}", "create_{n}", "create_{n}!", "reload_{n}"),
    "scope": (".{n}",),
    "class_attribute": (".{n}", ".{n}=", ".{n}?", "{n}", "{n}=", "{n}?"),
    "mattr_reader": (".{n}", "{n}"), "cattr_reader": (".{n}", "{n}"),
    "mattr_writer": (".{n}=", "{n}="), "cattr_writer": (".{n}=", "{n}="),
    "mattr_accessor": (".{n}", ".{n}=", "{n}", "{n}="), "cattr_accessor": (".{n}", ".{n}=", "{n}", "{n}="),
    "attribute": ("{n}", "{n}="), "store_accessor": ("{n}", "{n}="),
    "define_model_callbacks": (".before_{n}", ".around_{n}", ".after_{n}"),
}
COLUMN_TYPES = frozenset("string text integer bigint float decimal numeric datetime timestamp time date binary boolean json jsonb uuid inet hstore citext".split())


def singular(word: str) -> str:
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith(("sses", "xes", "zes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def plural(word: str) -> str:
    if word.endswith(("s", "x", "z", "ch", "sh")):
        return word + "es"
    if word.endswith("y") and word[-2:-1] not in tuple("aeiou"):
        return word[:-1] + "ies"
    return word + "s"


def class_of_table(table: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in singular(table).split("_"))


# -- hashes


def digest(*parts: object) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(str(p).encode())
        h.update(b"\xff")
    return int.from_bytes(h.digest(), "big") or 1


class Fold:
    """Hashes of a body's shapes, from the leaves up."""

    def __init__(self, name: str) -> None:
        self.locals: dict[str, int] = {}
        self.enclosing = name
        self.shapes: list[list] = []  # hash, nodes, parent

    def node(self, n: Node) -> tuple[int, int]:
        parts: list[object] = [n.tag]
        if n.tag in ("super", "zsuper"):
            parts.append(self.enclosing)
        keyword = n.tag == "param" and n.atoms[0][1] in ("key", "keyreq")
        for kind, val in n.atoms:
            if kind == "flag":
                continue
            if kind == "name" and not keyword:
                parts.append(f"L{self.locals.setdefault(str(val), len(self.locals))}")
            else:
                parts.append(f"v{val}")
        parts.append(len(n.kids))
        outer = self.enclosing
        if n.tag == "def":
            self.enclosing = str(n.atoms[0][1])
        before, size = len(self.shapes), 1
        for k in n.kids:
            h, s = self.node(k)
            parts.append(h)
            size += s
        self.enclosing = outer
        h = digest(*parts)
        if size >= MIN_NODES:
            for s in self.shapes[before:]:
                s[2] = s[2] or h
            self.shapes.append([h, size, 0])
        return h, size


def body_hash(n: Node) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(hash, nodes, signature) of a def."""
    fold = Fold(str(n.atoms[0][1]))
    params, body = n.kids
    p = fold.node(params)[0] if params.kids else "()"
    at = len(fold.shapes)
    for s in fold.shapes[:at]:
        s[2] = s[2]
    b, size = fold.node(body) if body.kids or body.tag != "stmts" else ("{}", 0)
    first: dict[int, tuple[int, int, int]] = {}
    for h, k, parent in fold.shapes:
        first.setdefault(h, (h, k, parent))
    return digest("ruby", p, b), size, list(first.values())


# -- units


def literal(n: Node) -> str | None:
    """The name that a symbol or a plain string stands for."""
    return str(n.atoms[0][1]) if n.tag in ("sym", "str") and n.atoms else None


def literal_list(n: Node) -> list[str] | None:
    if n.tag == "array" and n.kids and all(literal(k) is not None for k in n.kids):
        return [str(literal(k)) for k in n.kids]
    return None


def const_name(n: Node) -> str | None:
    if n.tag == "const":
        return str(n.atoms[0][1])
    if n.tag == "colon":
        left = const_name(n.kids[0]) if n.kids else ""
        return None if left is None else f"{left}::{n.atoms[0][1]}".removeprefix("::")
    return None


def options(args: list[Node]) -> dict[str, Node]:
    """The literal keys of a trailing hash of arguments."""
    if args and args[-1].tag == "hash":
        return {str(literal(p.kids[0])): p.kids[-1] for p in args[-1].kids if p.tag == "pair" and literal(p.kids[0])}
    return {}


class Scope:
    def __init__(self, kind: str) -> None:
        self.kind, self.visibility, self.module_function = kind, "public", False
        self.arrays: dict[str, list[str]] = {}


class Extractor:
    def __init__(self) -> None:
        self.units: list[dict] = []
        self.signatures: dict[str, list[tuple[int, int, int]]] = {}
        self.reads: list[dict] = []
        self.nesting: list[str] = []
        self.scopes = [Scope("top")]
        self.in_def = 0
        self.each: dict[str, list[str]] = {}
        self.in_included = 0

    @property
    def scope(self) -> Scope:
        return self.scopes[-1]

    @property
    def owner(self) -> str:
        return "::".join(x for x in self.nesting if x)

    def unit(self, name: str, at: Node, *, singleton: bool | None = None, visibility: str = "", via: str | None = None, params: list | None = None, owner: str | None = None, body: Node | None = None) -> None:
        inside = self.scope.kind == "sclass"
        single = inside if singleton is None else singleton
        where = self.owner if owner is None else owner
        if self.in_included and single and owner is None and via:
            where, single = "::".join(x for x in (where, "ClassMethods") if x), False
        h = nodes = None
        if body is not None:
            value, nodes, signature = body_hash(body)
            h = f"{value:016x}"
            self.signatures[h] = signature
        visible = visibility or ("public" if single and not inside else self.scope.visibility)
        self.units.append({"lang": "ruby", "name": name, "owner": where, "singleton": single, "visibility": visible, "params": params or [], "via": via, "line": at.line, "end_line": at.last, "norm_hash": h, "nodes": nodes})

    def walk(self, n: Node) -> None:
        getattr(self, f"on_{n.tag}", self.children)(n)

    def children(self, n: Node) -> None:
        for k in n.kids:
            self.walk(k)

    def enter(self, names: str, kind: str, body: Node) -> None:
        kept, self.in_def, included, self.in_included = self.in_def, 0, self.in_included, 0
        self.nesting.append(names)
        self.scopes.append(Scope(kind))
        self.walk(body)
        self.scopes.pop()
        self.nesting.pop()
        self.in_def, self.in_included = kept, included

    def on_class(self, n: Node) -> None:
        name = const_name(n.kids[0])
        for k in n.kids[1:-1]:
            self.walk(k)
        self.enter(name or "", "class", n.kids[-1])

    def on_module(self, n: Node) -> None:
        self.enter(const_name(n.kids[0]) or "", "module", n.kids[-1])

    def on_sclass(self, n: Node) -> None:
        self.enter("" if n.kids[0].tag == "self" else const_name(n.kids[0]) or "", "sclass", n.kids[-1])

    def on_def(self, n: Node, visibility: str = "") -> None:
        name, on = str(n.atoms[0][1]), str(n.atoms[1][1])
        params = [{"kind": str(p.atoms[0][1]), "name": str(p.atoms[1][1])} for p in n.kids[0].kids]
        if self.scope.module_function and not on and not visibility:
            self.unit(name, n, singleton=True, visibility="public", params=params, body=n)
            self.unit(name, n, singleton=False, visibility="private", params=params, body=n)
        else:
            own = visibility or ("private" if name == "initialize" and not on else "")
            self.unit(name, n, singleton=True if on else None, visibility="public" if on and not visibility else own, params=params, body=n)
        self.in_def += 1
        self.children(n)
        self.in_def -= 1

    def on_const(self, n: Node) -> None:
        self.reads.append({"name": str(n.atoms[0][1]), "nesting": self.owner, "line": n.line})

    def on_colon(self, n: Node) -> None:
        name = const_name(n)
        if name:
            self.reads.append({"name": name, "nesting": self.owner, "line": n.line})
        self.children(n)

    def on_assign(self, n: Node) -> None:
        left = n.kids[0]
        if left.tag == "const":
            values = literal_list(n.kids[1]) or (literal_list(n.kids[1].kids[0]) if n.kids[1].tag == "call" and n.kids[1].kids and n.kids[1].atoms[0][1] == "freeze" else None)
            if values:
                self.scope.arrays[str(left.atoms[0][1])] = values
            self.walk(n.kids[1])
        else:
            self.children(n)

    def on_alias(self, n: Node) -> None:
        self.unit(str(n.atoms[0][1]).lstrip(":"), n, via="alias")

    def on_call(self, n: Node) -> None:
        name = str(n.atoms[0][1])
        dotted = len(n.atoms) > 1 and n.atoms[1][1] in (".", "&.", "::")
        if dotted and n.kids[0].tag != "self":
            if name == "each" and len(n.kids) == 2 and n.kids[1].tag == "block":
                values, params = literal_list(n.kids[0]), n.kids[1].kids[0].kids
                if values and len(params) == 1:
                    self.each[str(params[0].atoms[1][1])] = values
                    self.children(n)
                    del self.each[str(params[0].atoms[1][1])]
                    return
            if name == "create_table":
                self.create_table(n)
            self.children(n)
            return
        args = [k for k in n.kids[1 if dotted else 0 :] if k.tag != "block"]
        block = n.kids[-1] if n.kids and n.kids[-1].tag == "block" else None
        handled = False if self.in_def else self.macro(name, args, block, n)
        if not handled:
            self.children(n)

    def names(self, args: list[Node]) -> list[str]:
        out: list[str] = []
        for a in args:
            if literal(a) is not None:
                out.append(str(literal(a)))
            elif a.tag == "splat" and a.kids and a.kids[0].tag == "const":
                out += next((s.arrays[str(a.kids[0].atoms[0][1])] for s in reversed(self.scopes) if str(a.kids[0].atoms[0][1]) in s.arrays), [])
        return out

    def macro(self, name: str, args: list[Node], block: Node | None, n: Node) -> bool:
        """Whether a bare call was one that defines or changes something; then its arguments are done."""
        if name in ("public", "protected", "private", "module_function", "private_class_method", "public_class_method"):
            return self.visibility(name, args, n)
        if name in ("attr_reader", "attr_writer", "attr_accessor", "attr"):
            writes = name in ("attr_writer", "attr_accessor") or name == "attr" and any(a.tag == "true" for a in args)
            for x in self.names(args):
                if name != "attr_writer":
                    self.unit(x, n, via=name)
                if writes:
                    self.unit(f"{x}=", n, via=name, params=[{"kind": "req", "name": "value"}])
            return True
        if name in ("define_method", "define_singleton_method") and args:
            for x in self.interpolated(args[0]):
                params = [{"kind": str(p.atoms[0][1]), "name": str(p.atoms[1][1])} for p in block.kids[0].kids] if block else []
                self.unit(x, n, singleton=True if name == "define_singleton_method" else None, via=name, params=params)
            return False
        if name == "alias_method" and len(args) == 2 and literal(args[0]):
            self.unit(str(literal(args[0])), n, via=name)
            return True
        if name == "alias_attribute" and len(args) == 2 and literal(args[0]):
            for x in ("{}", "{}=", "{}?"):
                self.unit(x.format(literal(args[0])), n, via=name)
            return True
        if name == "class_methods" and block and not args:
            self.enter("ClassMethods", "module", block.kids[-1])
            return True
        if name == "concerning" and block and args and (literal(args[0]) or "")[:1].isupper():
            self.enter(str(literal(args[0])), "module", block.kids[-1])
            return True
        if name == "included" and block and not args:
            self.in_included += 1
            self.walk(block.kids[-1])
            self.in_included -= 1
            return True
        if name == "delegate":
            return self.delegate(args, n)
        if name == "enum":
            return self.enum(args, n)
        if name == "create_table":
            self.create_table(n)
            return False
        if name in DSL:
            known = options(args)
            for x in self.names(args)[: None if name not in ("scope", "has_many", "has_one", "belongs_to", "has_and_belongs_to_many", "attribute", "store_accessor") else 1] if name != "store_accessor" else self.names(args)[1:]:
                only = literal_list(known["only"]) if name == "define_model_callbacks" and "only" in known and known["only"].tag == "array" else [literal(known["only"])] if name == "define_model_callbacks" and "only" in known else None
                for form in DSL[name]:
                    if only and form[1:].split("_")[0] not in only:
                        continue
                    made = form.lstrip(".").format(n=x, s=singular(x), p=plural(x))
                    self.unit(made, n, singleton=True if form.startswith(".") else None, via=name)
            return False
        return False

    def visibility(self, name: str, args: list[Node], n: Node) -> bool:
        if name == "module_function" and not args:
            self.scope.module_function = True
            return True
        if not args:
            self.scope.visibility, self.scope.module_function = name, False
            return True
        for a in args:
            if a.tag == "def":
                if name == "module_function":
                    kept, self.scope.module_function = self.scope.module_function, True
                    self.on_def(a)
                    self.scope.module_function = kept
                else:
                    self.on_def(a, visibility=name.removesuffix("_class_method"))
            elif literal(a) is not None or literal_list(a):
                for x in literal_list(a) or [str(literal(a))]:
                    self.unit(x, n, singleton=True if name.endswith("_class_method") else None, visibility=name.removesuffix("_class_method"), via=name)
            else:
                self.walk(a)
        return True

    def interpolated(self, n: Node) -> list[str]:
        """The names of an interpolated literal with one bare read of a block parameter bound to literals."""
        if n.tag not in ("dstr", "dsym"):
            return []
        holes = [k for k in n.kids if k.tag == "stmts"]
        if len(holes) != 1 or len(holes[0].kids) != 1 or holes[0].kids[0].tag != "lread":
            return []
        values = self.each.get(str(holes[0].kids[0].atoms[0][1]))
        return ["".join(str(k.atoms[0][1]) if k.tag == "text" else v for k in n.kids) for v in values or []]

    def delegate(self, args: list[Node], n: Node) -> bool:
        known = options(args)
        to = literal(known["to"]) if "to" in known else None
        if "to" not in known:
            return False
        prefix = ""
        if "prefix" in known:
            p = known["prefix"]
            prefix = f"{to}_" if p.tag == "true" and to else f"{literal(p)}_" if literal(p) else ""
        for x in self.names(args):
            self.unit(prefix + x, n, via="delegate")
        return True

    def enum(self, args: list[Node], n: Node) -> bool:
        if not args:
            return False
        pairs: list[tuple[str, Node]] = []
        known = options(args)
        if literal(args[0]) and len(args) > 1:
            pairs = [(str(literal(args[0])), args[1])]
        elif args[0].tag == "hash":
            pairs = [(str(literal(p.kids[0])), p.kids[1]) for p in args[0].kids if p.tag == "pair" and literal(p.kids[0]) and p.kids[1].tag in ("hash", "array")]
        affixed = any(k in known for k in ("prefix", "suffix", "_prefix", "_suffix"))
        for attribute, values in pairs:
            self.unit(plural(attribute), n, singleton=True, via="enum")
            members = literal_list(values) if values.tag == "array" else [str(literal(p.kids[0])) for p in values.kids if p.tag == "pair" and literal(p.kids[0]) and str(literal(p.kids[0])) not in ("prefix", "suffix", "_prefix", "_suffix", "default", "scopes")]
            for m in [] if affixed else members or []:
                self.unit(f"{m}?", n, singleton=False, via="enum")
                self.unit(f"{m}!", n, singleton=False, via="enum")
                self.unit(m, n, singleton=True, via="enum")
        return bool(pairs)

    def create_table(self, n: Node) -> None:
        args = [k for k in n.kids if k.tag in ("sym", "str")]
        block = n.kids[-1] if n.kids and n.kids[-1].tag == "block" else None
        if not args or block is None or not block.kids[0].kids:
            return
        owner, var = class_of_table(str(literal(args[0]))), str(block.kids[0].kids[0].atoms[1][1])
        for call in block.kids[-1].kids:
            if call.tag != "call" or len(call.atoms) < 2 or not call.kids or call.kids[0].tag != "lread" or call.kids[0].atoms[0][1] != var:
                continue
            kind = str(call.atoms[0][1])
            cols = self.names(call.kids[1:])
            if kind == "timestamps":
                cols = ["created_at", "updated_at"]
            elif kind in ("references", "belongs_to"):
                cols = [c for x in cols for c in (f"{x}_id", x)]
            elif kind == "column":
                cols = cols[:1]
            elif kind not in COLUMN_TYPES:
                continue
            for c in cols:
                for made in (c, f"{c}=", f"{c}?"):
                    self.unit(made, call, singleton=False, visibility="public", via="schema", owner=owner)


def units(src: str) -> tuple[list[dict], dict[str, list[tuple[int, int, int]]], int, int]:
    """(units, signatures by norm_hash, lines, parse errors) of one source."""
    tree, errors = parse(src)
    x = Extractor()
    try:
        x.walk(tree)
    except RecursionError:
        errors += 1
    order = sorted(range(len(x.units)), key=lambda i: (x.units[i]["line"], i))
    return [x.units[i] for i in order], x.signatures, src.count("\n") + 1 if src else 0, errors


def const_reads(src: str) -> list[dict]:
    """(name, nesting, line) of each constant read; a read of A::B is one of A::B and of A."""
    x = Extractor()
    x.walk(parse(src)[0])
    return x.reads

"""A tolerant recursive-descent parser of C functions, and the graphs that follow from its tree.

Node kinds have the names that tree queries of C use. What cannot be parsed becomes an ERROR node of one token, and parsing goes
on. The control flow has a block for each simple statement and each condition, with break, continue, goto and fall-through as C
has them; a definition counts from the end of its expression on, so that `x = x + 1` reads the value before.
All functions here are plain Python over one text; `graphs.py` applies them to columns in Arrow batches.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from dataclasses import dataclass, field

from . import tokens as T

SPECIFIERS = frozenset("auto const extern register static volatile inline restrict signed unsigned struct union enum typedef long short".split())
TYPE_WORDS = frozenset(T.TYPES) - {"NULL"} | SPECIFIERS
_BINARY = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]
_LEVEL = {op: k for k, ops in enumerate(_BINARY) for op in ops}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_TOKEN = re.compile(T.TOKEN, re.A)
MOST_DEPTH = 400  # deeper nesting of expressions and statements is an ERROR node


@dataclass
class Node:
    kind: str
    start: int  # code points
    end: int
    children: list["Node"] = field(default_factory=list)


class _Parser:
    def __init__(self, code: str) -> None:
        self.code = code
        found = [(m[0], *m.span()) for m in _TOKEN.finditer(code)]
        self.comments = [Node("comment", s, e) for t, s, e in found if t[:2] in ("//", "/*")]
        self.preproc = [Node("preproc_directive", s, e) for t, s, e in found if t[0] == "#"]
        self.t = [x for x in found if x[0][:2] not in ("//", "/*") and x[0][0] != "#"]
        self.i = self.depth = 0

    # -- tokens
    def at(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if 0 <= self.i + k < len(self.t) else ""

    def here(self) -> int:
        return self.t[self.i][1] if self.i < len(self.t) else len(self.code)

    def last(self) -> int:
        return self.t[min(self.i, len(self.t)) - 1][2] if self.i and self.t else 0

    def node(self, kind: str, start: int, children: list[Node]) -> Node:
        return Node(kind, start, max(self.last(), start), [c for c in children if c is not None])

    def error(self) -> Node:
        start = self.here()
        self.i = min(self.i + 1, len(self.t))
        return self.node("ERROR", start, [])

    def take(self, text: str) -> bool:
        if self.at() == text:
            self.i += 1
            return True
        return False

    def need(self, text: str, out: list[Node]) -> None:
        if not self.take(text):
            out.append(Node("ERROR", self.here(), self.here()))  # missing

    @staticmethod
    def name(t: str) -> bool:
        return bool(t) and (t[0].isalpha() or t[0] == "_")

    def word(self, kind: str) -> Node:
        start = self.here()
        self.i = min(self.i + 1, len(self.t))
        return self.node(kind, start, [])

    # -- top level
    def unit(self) -> Node:
        items = []
        while self.i < len(self.t):
            before = self.i
            items.append(self.external())
            if self.i == before:
                items.append(self.error())
        return Node("translation_unit", 0, len(self.code), items)

    def external(self) -> Node:
        if self.function_ahead():
            start, kids = self.here(), []
            self.specifiers(kids)
            kids.append(self.declarator())
            kids.append(self.compound())
            return self.node("function_definition", start, kids)
        return self.statement()

    def function_ahead(self) -> bool:
        """Whether words, stars and one parameter list come before a brace."""
        k, named = 0, 0
        while self.name(self.at(k)) or self.at(k) in ("*", "::", "~", "&"):
            if self.at(k) in ("if", "while", "for", "switch", "return", "do", "else", "goto", "case"):
                return False
            named += self.name(self.at(k))
            k += 1
        if self.at(k) != "(" or not named:
            return False
        depth = 0
        while self.at(k):
            depth += (self.at(k) == "(") - (self.at(k) == ")")
            k += 1
            if not depth:
                break
        while self.name(self.at(k)):
            k += 1
        return self.at(k) == "{" and named > 0

    # -- declarations
    def specifiers(self, out: list[Node]) -> None:
        while True:
            t = self.at()
            if t in ("struct", "union", "enum"):
                start = self.here()
                self.i += 1
                kids = [self.word("type_identifier")] if self.name(self.at()) else []
                if self.at() == "{":
                    kids.append(self.fields())
                out.append(self.node(f"{t}_specifier", start, kids))
            elif t in TYPE_WORDS:
                out.append(self.word("primitive_type"))
            elif self.name(t) and (self.name(self.at(1)) or self.at(1) == "*" or self.at(1) == "::") and not any(c.kind.endswith(("type", "_specifier", "type_identifier")) and c.kind != "qualifier" for c in out if self.code[c.start : c.end] not in SPECIFIERS):
                out.append(self.word("type_identifier"))
                while self.take("::"):
                    out.append(self.word("type_identifier"))
            else:
                return

    def fields(self) -> Node:
        start, kids = self.here(), []
        self.i += 1
        while self.i < len(self.t) and self.at() != "}":
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.error())
        self.need("}", kids)
        return self.node("field_declaration_list", start, kids)

    def declarator(self) -> Node:
        start = self.here()
        if self.at() in ("*", "&") and self.i < len(self.t):
            self.i += 1
            while self.at() in ("const", "volatile", "restrict"):
                self.i += 1
            return self.node("pointer_declarator", start, [self.declarator()])
        if self.take("("):
            kids = [self.declarator()]
            self.need(")", kids)
            inner = self.node("parenthesized_declarator", start, kids)
        elif self.name(self.at()):
            inner = self.word("identifier")
            while self.take("::"):
                inner = self.word("identifier") if self.name(self.at()) else inner
        else:
            return Node("ERROR", self.here(), self.here())
        while self.at() in ("[", "("):
            if self.take("["):
                kids = [inner]
                if self.at() != "]":
                    kids.append(self.expression())
                self.need("]", kids)
                inner = self.node("array_declarator", start, kids)
            else:
                inner = self.node("function_declarator", start, [inner, self.parameters()])
        return inner

    def parameters(self) -> Node:
        start, kids = self.here(), []
        self.i += 1
        while self.i < len(self.t) and self.at() not in (")", "{", ";"):
            begin, own = self.here(), []
            if self.at() == "...":
                own.append(self.word("variadic_parameter"))
            else:
                self.specifiers(own)
                if not own and self.name(self.at()):
                    own.append(self.word("type_identifier"))
                if self.at() not in (",", ")"):
                    own.append(self.declarator())
            kids.append(self.node("parameter_declaration", begin, own))
            if not self.take(",") and self.at() != ")":
                kids.append(self.error())
        self.need(")", kids)
        return self.node("parameter_list", start, kids)

    def declaration_ahead(self) -> bool:
        t = self.at()
        if t in TYPE_WORDS:
            return True
        if not self.name(t) or t in T.KEYWORDS:
            return False
        k = 1
        while self.at(k) == "::" and self.name(self.at(k + 1)):
            k += 2
        if self.name(self.at(k)) and self.at(k) not in ("sizeof",):
            return True
        stars = 0
        while self.at(k) == "*":
            k, stars = k + 1, stars + 1
        return stars > 0 and self.name(self.at(k)) and self.at(k + 1) in ("=", ";", ",", "[")

    def declaration(self) -> Node:
        start, kids = self.here(), []
        self.specifiers(kids)
        while self.i < len(self.t) and self.at() not in (";", "}"):
            begin, one = self.here(), self.declarator()
            if self.take("="):
                one = self.node("init_declarator", begin, [one, self.initializer()])
            kids.append(one)
            if not self.take(","):
                break
        if self.at() not in (";", "}"):
            while self.i < len(self.t) and self.at() not in (";", "}", "{"):
                kids.append(self.error())
        self.need(";", kids)
        return self.node("declaration", start, kids)

    def initializer(self) -> Node:
        if self.at() != "{":
            return self.assignment()
        start, kids = self.here(), []
        self.i += 1
        while self.i < len(self.t) and self.at() != "}":
            before = self.i
            kids.append(self.initializer())
            self.take(",")
            if self.i == before:
                kids.append(self.error())
        self.need("}", kids)
        return self.node("initializer_list", start, kids)

    # -- statements
    def compound(self) -> Node:
        start, kids = self.here(), []
        self.i += 1
        while self.i < len(self.t) and self.at() != "}":
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.error())
        self.need("}", kids)
        return self.node("compound_statement", start, kids)

    def condition(self) -> Node:
        start, kids = self.here(), []
        self.need("(", kids)
        if self.at() != ")":
            kids.append(self.expression())
        self.need(")", kids)
        return self.node("parenthesized_expression", start, kids)

    def statement(self) -> Node:
        self.depth += 1
        try:
            return self.error() if self.depth > MOST_DEPTH else self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> Node:
        t, start, kids = self.at(), self.here(), []
        if t == "{":
            return self.compound()
        if t == "if":
            self.i += 1
            kids = [self.condition(), self.statement()]
            if self.at() == "else":
                begin = self.here()
                self.i += 1
                kids.append(self.node("else_clause", begin, [self.statement()]))
            return self.node("if_statement", start, kids)
        if t in ("while", "switch"):
            self.i += 1
            return self.node(f"{t}_statement", start, [self.condition(), self.statement()])
        if t == "for":
            self.i += 1
            self.need("(", kids)
            kids.append(self.statement() if self.at() != ";" else self.word("empty"))
            for end in (";", ")"):
                if self.at() != end:
                    kids.append(self.expression())
                self.need(end, kids)
            return self.node("for_statement", start, [*kids, self.statement()])
        if t == "do":
            self.i += 1
            kids = [self.statement()]
            if self.take("while"):
                kids.append(self.condition())
                self.take(";")
            return self.node("do_statement", start, kids)
        if t in ("case", "default") and not (t == "default" and self.at(1) not in (":",)):
            self.i += 1
            if t == "case":
                kids.append(self.ternary())
            self.need(":", kids)
            while self.i < len(self.t) and self.at() not in ("case", "default", "}"):
                before = self.i
                kids.append(self.statement())
                if self.i == before:
                    kids.append(self.error())
            return self.node("case_statement", start, kids)
        if t in ("break", "continue"):
            self.i += 1
            self.take(";")
            return self.node(f"{t}_statement", start, [])
        if t == "goto":
            self.i += 1
            kids = [self.word("statement_identifier")] if self.name(self.at()) else []
            self.take(";")
            return self.node("goto_statement", start, kids)
        if t == "return":
            self.i += 1
            if self.at() not in (";", "}", ""):
                kids.append(self.expression())
            self.take(";")
            return self.node("return_statement", start, kids)
        if self.name(t) and self.at(1) == ":" and t not in T.KEYWORDS:
            kids = [self.word("statement_identifier")]
            self.i += 1
            if self.at() not in ("}", ""):
                kids.append(self.statement())
            return self.node("labeled_statement", start, kids)
        if self.take(";"):
            return self.node("expression_statement", start, [])
        if self.declaration_ahead():
            return self.declaration()
        kids = [self.expression()]
        while self.i < len(self.t) and self.at() not in (";", "}", "{"):
            kids.append(self.error())
        self.take(";")
        return self.node("expression_statement", start, kids)

    # -- expressions
    def expression(self) -> Node:
        start, one = self.here(), self.assignment()
        while self.take(","):
            one = self.node("comma_expression", start, [one, self.assignment()])
        return one

    def assignment(self) -> Node:
        self.depth += 1
        try:
            if self.depth > MOST_DEPTH:
                return self.error()
            start, left = self.here(), self.ternary()
            if self.at() in _ASSIGN:
                self.i += 1
                return self.node("assignment_expression", start, [left, self.initializer()])
            return left
        finally:
            self.depth -= 1

    def ternary(self) -> Node:
        start, one = self.here(), self.binary(0)
        if self.take("?"):
            kids = [one, self.expression()]
            self.need(":", kids)
            return self.node("conditional_expression", start, [*kids, self.assignment()])
        return one

    def binary(self, level: int) -> Node:
        start, left = self.here(), self.unary()
        # one loop over operators, binding by level
        while self.at() in _LEVEL and _LEVEL[self.at()] >= level:
            own = _LEVEL[self.at()]
            self.i += 1
            left = self.node("binary_expression", start, [left, self.binary(own + 1)])
        return left

    def cast_ahead(self) -> bool:
        k = 1
        if self.at(k) not in TYPE_WORDS and not (self.name(self.at(k)) and self.at(k + 1) == "*"):
            return False
        while self.name(self.at(k)):
            k += 1
        while self.at(k) == "*":
            k += 1
        return self.at(k) == ")"

    def unary(self) -> Node:
        t, start = self.at(), self.here()
        if t in ("*", "&"):
            self.i += 1
            return self.node("pointer_expression", start, [self.deeper(self.unary)])
        if t in ("!", "~", "-", "+"):
            self.i += 1
            return self.node("unary_expression", start, [self.deeper(self.unary)])
        if t in ("++", "--"):
            self.i += 1
            return self.node("update_expression", start, [self.deeper(self.unary)])
        if t == "sizeof":
            self.i += 1
            if self.at() == "(" and self.cast_ahead():
                return self.node("sizeof_expression", start, [self.type_name()])
            return self.node("sizeof_expression", start, [self.deeper(self.unary)])
        if t == "new":
            self.i += 1
            return self.node("new_expression", start, [self.deeper(self.unary)])
        if t == "(" and self.cast_ahead():
            return self.node("cast_expression", start, [self.type_name(), self.deeper(self.unary)])
        return self.postfix()

    def deeper(self, parse) -> Node:
        self.depth += 1
        try:
            return self.error() if self.depth > MOST_DEPTH else parse()
        finally:
            self.depth -= 1

    def type_name(self) -> Node:
        start, kids = self.here(), []
        self.i += 1
        while self.i < len(self.t) and self.at() != ")":
            kids.append(self.word("type_identifier" if self.name(self.at()) else "abstract_pointer_declarator"))
        self.take(")")
        return self.node("type_descriptor", start, kids)

    def postfix(self) -> Node:
        start, one = self.here(), self.primary()
        while True:
            t = self.at()
            if t == "(":
                begin, kids = self.here(), []
                self.i += 1
                while self.i < len(self.t) and self.at() not in (")", ";", "}"):
                    before = self.i
                    kids.append(self.assignment())
                    self.take(",")
                    if self.i == before:
                        kids.append(self.error())
                self.need(")", kids)
                one = self.node("call_expression", start, [one, self.node("argument_list", begin, kids)])
            elif t == "[":
                self.i += 1
                kids = [one]
                if self.at() != "]":
                    kids.append(self.expression())
                self.need("]", kids)
                one = self.node("subscript_expression", start, kids)
            elif t in (".", "->"):
                self.i += 1
                one = self.node("field_expression", start, [one, self.word("field_identifier") if self.name(self.at()) else None])
            elif t in ("++", "--"):
                self.i += 1
                one = self.node("update_expression", start, [one])
            else:
                return one

    def primary(self) -> Node:
        t = self.at()
        if t == "(":
            start, kids = self.here(), []
            self.i += 1
            if self.at() != ")":
                kids.append(self.deeper(self.expression))
            self.need(")", kids)
            return self.node("parenthesized_expression", start, kids)
        if self.name(t):
            if t in ("NULL", "nullptr"):
                return self.word("null")
            one = self.word("identifier")
            while self.at() == "::" and self.name(self.at(1)):
                self.i += 1
                one = self.word("identifier")
            return one
        if t[:1] == '"':
            one = self.word("string_literal")
            while self.at()[:1] == '"':
                one = Node("string_literal", one.start, self.word("string_literal").end)
            return one
        if t[:1] == "'":
            return self.word("char_literal")
        if t[:1].isdigit() or (t[:1] == "." and t[1:2].isdigit()):
            return self.word("number_literal")
        return Node("ERROR", self.here(), self.here()) if t in (";", ")", "}", "]", "", ",") else self.error()


def parse(code: str) -> Node | None:
    """The tree of a text; None if it is blank."""
    if not code or not code.strip():
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # here, as workers get functions and not the module
    p = _Parser(code)
    root = p.unit()
    extra = sorted(p.comments + p.preproc, key=lambda n: n.start)
    if extra:
        root.children = sorted(root.children + [n for n in extra], key=lambda n: n.start)
    return root


def walk(root: Node):
    """(node, parent's number, depth) in preorder; numbers are places in this order."""
    stack, k = [(root, -1, 0)], 0
    while stack:
        node, parent, depth = stack.pop()
        yield node, parent, depth
        stack += [(c, k, depth + 1) for c in reversed(node.children)]
        k += 1


class Lines:
    """Line (from 1) and column (from 0) of a place."""

    def __init__(self, code: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def col(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1]


def nodes(code: str) -> list[tuple]:
    """(idx, kind, text, start_line, start_col, end_line, start, end, parent, depth, leaf) of every node."""
    root = parse(code)
    if root is None:
        return []
    at = Lines(code)
    return [(k, n.kind, code[n.start : n.end][:200], at.line(n.start), at.col(n.start), at.line(max(n.end - 1, n.start)), n.start, n.end, p, d, not n.children) for k, (n, p, d) in enumerate(walk(root))]


def calls(code: str) -> list[str]:
    """The names called, one for each call whose callee is a name."""
    root = parse(code)
    return [] if root is None else [_text(code, n.children[0]) for n, _, _ in walk(root) if n.kind == "call_expression" and n.children[0].kind == "identifier"]


def _text(code: str, n: Node) -> str:
    return code[n.start : n.end]


def nodes_over(code: str, lines: list[int]) -> list[tuple[int, int, str | None]]:
    """(line, number of nodes over it, kind of the smallest statement or declaration over it) of each line that has nodes."""
    root = parse(code) if lines else None
    if root is None:
        return []
    at, found = Lines(code), {x: [0, None, None] for x in lines}
    for n, parent, _ in walk(root):
        if n.kind in ("comment", "ERROR"):
            continue
        first, last, size = at.line(n.start), at.line(max(n.end - 1, n.start)), n.end - n.start
        whole = parent >= 0 and ("statement" in n.kind or n.kind.endswith("declaration"))
        for x, held in found.items():
            if first <= x <= last:
                held[0] += 1
                if whole and (held[1] is None or size < held[1]):  # of equal ones the first
                    held[1:] = size, n.kind
    return [(x, held[0], held[2]) for x, held in found.items() if held[0]]


# ---- control flow ---------------------------------------------------------------------------------------------------------------


@dataclass
class Flow:
    """blocks: (start_line, end_line, type, label); edges: (src, dst, type). Block 0 is the entry, block 1 the exit."""

    blocks: list[list] = field(default_factory=list)
    edges: dict[tuple[int, int, str], None] = field(default_factory=dict)


def control_flow(code: str, root: Node | None) -> Flow:
    f, at = Flow(), Lines(code)
    if root is None:
        return f
    body = next((c for n, _, _ in walk(root) if n.kind == "function_definition" for c in n.children if c.kind == "compound_statement"), root)
    end = at.line(max(body.end - 1, body.start))
    f.blocks = [[at.line(body.start), at.line(body.start), "entry", ""], [end, end, "exit", ""]]
    labels: dict[str, int] = {}
    gotos: list[tuple[int, str]] = []
    breaks: list[list] = []
    continues: list[list] = []

    def block(first: int, last: int, kind: str, outs: list[tuple[int, str]], label: str = "") -> int:
        f.blocks.append([at.line(first), at.line(max(last - 1, first)), kind, label])
        b = len(f.blocks) - 1
        for src, how in outs:
            f.edges[src, b, how] = None
        return b

    def sequence(items: list[Node], outs: list) -> list:
        for n in items:
            outs = flow(n, outs)
        return outs

    def flow(n: Node, outs: list) -> list:
        """The open ends (block, edge type) behind a statement that the open ends `outs` lead to."""
        if n.kind in ("compound_statement", "translation_unit"):
            return sequence(n.children, outs)
        if n.kind == "else_clause":
            return sequence(n.children, outs)
        if n.kind in ("comment", "preproc_directive", "function_definition"):
            return outs
        if n.kind == "if_statement":
            cond = n.children[0]
            b = block(n.start, cond.end, "condition", outs)
            after = flow(n.children[1], [(b, "TRUE_BRANCH")])
            other = n.children[2:]
            return after + (sequence(other, [(b, "FALSE_BRANCH")]) if other else [(b, "FALSE_BRANCH")])
        if n.kind in ("while_statement", "for_statement"):
            head = n.children[0] if n.kind == "while_statement" else n.children[-2] if len(n.children) > 1 else n
            b = block(n.start, max(head.end, n.start + 1), "loop_header", outs)
            breaks.append([])
            continues.append([])
            for src, how in flow(n.children[-1], [(b, "TRUE_BRANCH")]):
                f.edges[src, b, "LOOP_BACK" if how == "SEQUENTIAL" else how] = None
            for src, _ in continues.pop():
                f.edges[src, b, "CONTINUE"] = None
            return [(b, "LOOP_EXIT"), *breaks.pop()]
        if n.kind == "do_statement":
            breaks.append([])
            continues.append([])
            begin = len(f.blocks)
            after = flow(n.children[0], outs)
            cond = n.children[-1]
            b = block(cond.start, cond.end, "loop_header", [*after, *continues.pop()])
            f.edges[b, begin, "LOOP_BACK"] = None
            return [(b, "LOOP_EXIT"), *breaks.pop()]
        if n.kind == "switch_statement":
            b = block(n.start, n.children[0].end, "condition", outs)
            breaks.append([])
            fall, default = [], False
            cases = n.children[-1].children if n.children[-1].kind == "compound_statement" else [n.children[-1]]
            for c in cases:
                if c.kind == "case_statement":
                    is_default = code[c.start : c.start + 7] == "default"
                    default |= is_default
                    head = c.children[0].end if not is_default and c.children else c.start + 8
                    k = block(c.start, head, "case", [*fall, (b, "SWITCH_DEFAULT" if is_default else "SWITCH_CASE")])
                    fall = sequence(c.children[0 if is_default else 1 :], [(k, "SEQUENTIAL")])
                else:
                    fall = flow(c, fall)
            return [*fall, *breaks.pop(), *([] if default else [(b, "FALSE_BRANCH")])]
        if n.kind == "labeled_statement":
            name = code[n.children[0].start : n.children[0].end]
            labels[name] = block(n.start, n.children[0].end, "normal", outs, name)
            return sequence(n.children[1:], [(labels[name], "SEQUENTIAL")])
        b = block(n.start, n.end, "normal", outs)
        if n.kind == "return_statement":
            f.edges[b, 1, "RETURN"] = None
            return []
        if n.kind == "goto_statement":
            gotos.append((b, code[n.children[0].start : n.children[0].end] if n.children else ""))
            return []
        if n.kind == "break_statement" and breaks:
            breaks[-1].append((b, "BREAK"))
            return []
        if n.kind == "continue_statement" and continues:
            continues[-1].append((b, "CONTINUE"))
            return []
        return [(b, "SEQUENTIAL")]

    for src, how in sequence(body.children, [(0, "SEQUENTIAL")]):
        f.edges[src, 1, how] = None
    for src, name in gotos:
        if name in labels:
            f.edges[src, labels[name], "GOTO"] = None
    return f


# ---- accesses and data flow ---------------------------------------------------------------------------------------------------------


def accesses(code: str, root: Node | None) -> list[tuple]:
    """(name, line, pos, type, context) ordered by pos; pos of a definition is the end of its expression."""
    if root is None:
        return []
    at, out = Lines(code), []
    text = lambda n: code[n.start : n.end]

    def name_in(n: Node) -> Node | None:
        while n.kind != "identifier":
            if not n.children:
                return None
            n = n.children[0]
        return n

    def add(n: Node | None, kind: str, context: str, pos: int | None = None) -> None:
        if n is not None and (kind in ("def", "param") or not text(n).isupper()):
            out.append((text(n), at.line(n.start), n.start if pos is None else pos, kind, context))

    stack: list[tuple[Node, str, str]] = [(root, "use", "expression")]
    while stack:
        n, kind, context = stack.pop()
        k = n.children
        if n.kind == "identifier":
            add(n, kind, context)
        elif n.kind == "parameter_declaration":
            add(name_in(k[-1]) if k and k[-1].kind in ("identifier", "pointer_declarator", "array_declarator") else None, "param", "parameter")
        elif n.kind == "declaration":
            for c in k:
                if c.kind == "init_declarator":
                    add(name_in(c.children[0]), "def", "declaration", c.end)
                    stack.append((c.children[1], "use", "initializer"))
                elif c.kind in ("identifier", "pointer_declarator", "array_declarator"):
                    add(name_in(c), "def", "declaration", c.end)
        elif n.kind == "assignment_expression" and len(k) == 2:
            add(name_in(k[0]), "def", "assignment", n.end)
            if k[0].kind != "identifier":
                stack.append((k[0], "use", "place"))
            elif not code[k[0].end : k[1].start].strip().startswith("="):
                add(k[0], "use", "compound")
            stack.append((k[1], "use", "rhs"))
        elif n.kind == "update_expression" and k:
            target = name_in(k[0])
            add(target, "use", "update")
            add(target, "def", "update", n.end)
        elif n.kind == "return_statement":
            stack += [(c, "return", "return") for c in k]
        elif n.kind == "pointer_expression" and k:
            target = name_in(k[0])
            add(target, "address" if code[n.start] == "&" else "deref", "pointer")
            if k[0].kind != "identifier":
                stack += [(c, "use", context) for c in k[0].children if target is None or c is not target]
        elif n.kind == "call_expression":
            called = name_in(k[0])
            f = text(called) if called is not None else ""
            if k[0].kind != "identifier":
                stack.append((k[0], "use", "callee"))
            stack += [(c, "call_arg", f"call:{f}") for c in k[1].children]
        elif n.kind == "function_declarator":
            stack += [(c, "use", "expression") for c in k[1:]]
        elif n.kind == "field_expression":
            stack.append((k[0], kind, context))
        elif n.kind not in ("type_descriptor", "statement_identifier", "struct_specifier", "union_specifier", "enum_specifier"):
            stack += [(c, kind, context) for c in k]
    return sorted(set(out), key=lambda x: (x[2], x[3], x[0]))


def data_edges(found: list[tuple]) -> list[tuple[int, int, str]]:
    """def-use (the latest definition before a use) and ptr-flow (an address to dereferences on later lines)."""
    out, held, addresses = [], {}, []
    for k, (name, line, _, kind, _) in enumerate(found):
        if kind in ("def", "param"):
            held[name] = k
        else:
            if name in held:
                out.append((held[name], k, "def-use"))
            if kind == "deref":
                out += [(a, k, "ptr-flow") for a in addresses if found[a][1] < line]
            if kind == "address":
                addresses.append(k)
    return out


# ---- slices -------------------------------------------------------------------------------------------------------------------------


def _reach(start: set[int], edges: dict[int, list[int]]) -> set[int]:
    seen, todo = set(start), list(start)
    while todo:
        for n in edges.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def post_dominators(flow: Flow) -> list[int]:
    """The immediate post-dominator of each block (-1: none), by intersection along the reverse order of a walk from the exit."""
    n = len(flow.blocks)
    succ, pred = {}, {}
    for a, b, _ in flow.edges:
        succ.setdefault(a, []).append(b)
        pred.setdefault(b, []).append(a)
    order, seen, stack = [], set(), [(1, iter(pred.get(1, ())))] if n > 1 else []
    seen.add(1)
    while stack:
        node, it = stack[-1]
        for m in it:
            if m not in seen:
                seen.add(m)
                stack.append((m, iter(pred.get(m, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    rank = {b: k for k, b in enumerate(order)}  # the exit has the highest
    idom = {1: 1}
    changed = True
    while changed:
        changed = False
        for b in reversed(order):
            if b == 1:
                continue
            new = None
            for s in succ.get(b, ()):
                if s in idom:
                    x, y = s, new
                    while y is not None and x != y:
                        if rank[x] < rank[y]:
                            x = idom[x]
                        else:
                            y = idom[y]
                    new = x
            if new is not None and idom.get(b) != new:
                idom[b], changed = new, True
    return [idom.get(b, -1) if b != 1 else -1 for b in range(n)]


def control_dependents(flow: Flow, block: int, ipdom: list[int]) -> set[int]:
    """What a branch decides: from each successor along immediate post-dominators up to the branch's own."""
    out = set()
    succ: dict[int, list[int]] = {}
    for a, b, _ in flow.edges:
        succ.setdefault(a, []).append(b)
    if len(succ.get(block, ())) < 2:
        return out
    for s in succ[block]:
        todo = [s]
        while todo:
            x = todo.pop()
            if x < 0 or x in out or x == ipdom[block]:
                continue
            out.add(x)
            todo += succ.get(x, ())
    return out


class Slicer:
    """Slices of one text, which is parsed once."""

    def __init__(self, code: str) -> None:
        self.root, self.n_lines = parse(code), code.count("\n") + 1
        if self.root is None:
            return
        self.flow, self.found = control_flow(code, self.root), accesses(code, self.root)
        self.edges = data_edges(self.found)
        self.control, self.kinds = {}, {}
        for a, b, _ in self.flow.edges:
            self.control.setdefault(b, []).append(a)

    def _of(self, kind: str) -> tuple[dict[int, list[int]], list[int]]:
        """(data dependences in the slice's direction, immediate post-dominators for forward ones)."""
        if kind not in self.kinds:
            data = {}
            for a, b, _ in self.edges:
                a, b = (b, a) if kind == "backward" else (a, b)
                data.setdefault(a, []).append(b)
            self.kinds[kind] = data, post_dominators(self.flow) if kind == "forward" else []
        return self.kinds[kind]

    def slice(self, criteria: list[int], kind: str, rounds: int = 5) -> list[int]:
        """The lines that a backward, forward or both-way slice of some lines has; rounds of data and control dependences."""
        ok = [c for c in criteria if 1 <= c <= self.n_lines] or criteria[:1] or [1]
        if self.root is None:
            return sorted(set(ok))
        if kind == "both":
            return sorted(set(self.slice(ok, "backward", rounds)) | set(self.slice(ok, "forward", rounds)))
        data, ipdom = self._of(kind)
        lines = set(ok)
        for _ in range(rounds):
            new = {self.found[k][1] for k in _reach({k for k, x in enumerate(self.found) if x[1] in lines}, data)}
            held = {b for b, (s, e, *_) in enumerate(self.flow.blocks) if b > 1 and any(s <= x <= e for x in lines)}
            if kind == "backward":
                chosen = {b for b in _reach(held, self.control) if self.flow.blocks[b][2] in ("condition", "loop_header", "case")}
            else:
                chosen = set(held)
                for b in held:
                    chosen |= control_dependents(self.flow, b, ipdom) - {1}
            for b in chosen:
                new.update(range(self.flow.blocks[b][0], self.flow.blocks[b][1] + 1))
            if new <= lines:
                break
            lines |= new
        return sorted(x for x in lines if x <= self.n_lines)


def graph_slice(code: str, criteria: list[int], kind: str, rounds: int = 5) -> list[int]:
    return Slicer(code).slice(criteria, kind, rounds)


def dependency_slices(code: str, sinks: frozenset[str], memory: frozenset[str], most: int = 6) -> list[tuple[int, str, int, list[int]]]:
    """(slice, kind, seed, lines): backward from each seed line in order of priority (calls of `sinks`, of `memory`, dereferences
    and subscripts), then forward, then pieces of 20 lines, up to `most` in all."""
    s, at, seeds = Slicer(code), Lines(code), {}
    for n, _, _ in walk(s.root) if s.root is not None else ():
        if n.kind == "call_expression":
            name = _text(code, n.children[0]) if n.children[0].kind == "identifier" else ""
            p = 1 if name in sinks else 2 if name in memory else 0
        else:
            p = 3 * (n.kind in ("pointer_expression", "subscript_expression"))
        if p:
            line = at.line(n.start)
            seeds[line] = min(p, seeds.get(line, p))
    held = sorted(seeds, key=lambda x: (seeds[x], x))[:most]
    wanted = [("backward", x) for x in held] + [("forward", x) for x in held] + [("even", k) for k in range(most)]
    even = lambda k: [i for i in range(20 * k + 1, 20 * k + 21) if i <= s.n_lines]
    return [(i, kind, x, even(x) if kind == "even" else s.slice([x], kind)) for i, (kind, x) in enumerate(wanted[:most])]


def blanked(code: str) -> str:
    """Comments as spaces; length and lines stay."""
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else m[0], code)

"""A small sandboxed template language for conversations, compiled to Python closures.

``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in list %}``,
``{% generation %} ... {% endgeneration %}`` and ``{# comments #}``. Expressions know strings, whole
numbers, true, false, none, names, ``a.b``, ``a['b']``, ``==``, ``!=``, ``in``, ``not``, ``and``,
``or``, ``~`` (joins texts) and ``| filter``. A template sees only the values and filters it is given:
there are no calls, no Python attributes and no access to modules.

``parse`` gives a syntax tree of tuples, ``fold`` replaces constant parts by their value, and
``compile_nodes`` turns it into closures that append texts and generation spans to an ``Output``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.\[\]()|~]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}

Filters = Mapping[str, Callable[[object], object]]


class TemplateError(ValueError):
    pass


class Output:
    """Rendered text in parts, with the spans (in code points) that a model is to learn."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(next((kind, m[i]) for i, kind in ((1, "text"), (2, "number"), (3, "name"), (4, "sign")) if m[i] is not None))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def next(self, *kinds: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise TemplateError(f"expected {' or '.join(kinds)}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take("and")
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take("not")
            return ("not", self.negated())
        node = self.joined()
        if self.peek("==", "!=", "in"):
            node = (self.take("==", "!=", "in"), node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.value()
        while self.peek("~"):
            self.take("~")
            node = ("~", node, self.value())
        return node

    def value(self) -> tuple:
        kind, word = self.next("text", "number", "name", "sign")
        if kind == "text":
            node = ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "number":
            node = ("const", int(word))
        elif word == "(":
            node = self.either()
            self.take(")")
        elif kind == "name":
            node = ("const", CONSTANTS[word]) if word in CONSTANTS else ("name", word)
        else:
            raise TemplateError(f"unexpected {word!r}")
        while self.peek(".", "[", "|"):
            sign = self.take(".", "[", "|")
            if sign == "[":
                node = ("item", node, self.either())
                self.take("]")
            else:
                word = self.next("name")[1]
                node = ("item", node, ("const", word)) if sign == "." else ("filter", word, node)
        return node


def parse(source: str) -> list[tuple]:
    """The syntax tree: text, show, if, for and generation nodes."""
    root: list[tuple] = []
    stack: list[tuple[str, list[tuple], list]] = [("", root, [])]
    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("show", _Expression(m[1]).whole()))
        elif m[2] is not None:
            _statement(m[2].strip(), stack)
    if at < len(source):
        stack[-1][1].append(("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return root


def _statement(words: str, stack: list) -> None:
    word, _, rest = words.partition(" ")
    kind, body, info = stack[-1]
    if word == "if":
        stack.append(("if", [], [(_Expression(rest).whole(), [])]))
        stack[-1] = ("if", stack[-1][2][0][1], stack[-1][2])
    elif word in ("elif", "else") and kind == "if" and info[-1][0] is not None:
        info.append((_Expression(rest).whole() if word == "elif" else None, []))
        stack[-1] = ("if", info[-1][1], info)
    elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
        stack.append(("for", [], [m[1], _Expression(m[2]).whole()]))
    elif word == "generation" and not rest:
        stack.append(("generation", [], []))
    elif word == f"end{kind}" and kind and not rest:
        stack.pop()
        node = ("if", info) if kind == "if" else ("for", info[0], info[1], body) if kind == "for" else ("generation", body)
        stack[-1][1].append(node)
    else:
        raise TemplateError(f"unexpected {words!r}")


def _truth(value: object) -> bool:
    return bool(value)


def _shown(value: object) -> str:
    return "" if value is None else str(value)


BINARY: dict[str, Callable[[object, object], object]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: b is not None and a in b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def fold_expression(node: tuple, filters: Filters) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"no filter {node[1]!r}")
        inner = fold_expression(node[2], filters)
        return ("const", filters[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    parts = [fold_expression(x, filters) for x in node[1:]]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if _truth(parts[0][1]) == (kind == "and") else parts[0]
    if all(x[0] == "const" for x in parts) and kind != "item":
        return ("const", not parts[0][1] if kind == "not" else BINARY[kind](parts[0][1], parts[1][1]))
    return (kind, *parts)


def fold(nodes: list[tuple], filters: Filters) -> list[tuple]:
    """Constant expressions become text, branches that cannot run go, neighbouring texts become one."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "show":
            inner = fold_expression(node[1], filters)
            put(("text", _shown(inner[1])) if inner[0] == "const" else ("show", inner))
        elif node[0] == "if":
            branches = []
            for test, body in node[1]:
                test = ("const", True) if test is None else fold_expression(test, filters)
                if test[0] != "const" or _truth(test[1]):
                    branches.append((test, fold(body, filters)))
                if test[0] == "const" and _truth(test[1]):
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    put(inner)
            elif branches:
                put(("if", branches))
        elif node[0] == "for":
            put(("for", node[1], fold_expression(node[2], filters), fold(node[3], filters)))
        elif node[0] == "generation":
            put(("generation", fold(node[1], filters)))
        else:
            put(node)
    return out


Values = dict[str, object]


def _compile_expression(node: tuple, filters: Filters) -> Callable[[Values], object]:
    kind = node[0]
    if kind == "const":
        return lambda values, value=node[1]: value
    if kind == "name":
        return lambda values, name=node[1]: values.get(name)
    if kind == "filter":
        apply, inner = filters[node[1]], _compile_expression(node[2], filters)
        return lambda values: apply(inner(values))
    parts = [_compile_expression(x, filters) for x in node[1:]]
    if kind == "not":
        return lambda values: not parts[0](values)
    if kind == "and":
        return lambda values: parts[0](values) and parts[1](values)
    if kind == "or":
        return lambda values: parts[0](values) or parts[1](values)
    if kind == "item":

        def item(values: Values) -> object:
            held, key = parts[0](values), parts[1](values)
            return held.get(key) if isinstance(held, dict) else held[key] if isinstance(held, list) and isinstance(key, int) and key < len(held) else None

        return item
    return lambda values, apply=BINARY[kind]: apply(parts[0](values), parts[1](values))


def compile_nodes(nodes: list[tuple], filters: Filters) -> Callable[[Values, Output], None]:
    """A closure that renders the nodes."""
    steps = [_compile_node(node, filters) for node in nodes]

    def run(values: Values, out: Output) -> None:
        for step in steps:
            step(values, out)

    return run


def _compile_node(node: tuple, filters: Filters) -> Callable[[Values, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda values, out, text=node[1]: out.add(text)
    if kind == "show":
        show = _compile_expression(node[1], filters)
        return lambda values, out: out.add(_shown(show(values)))
    if kind == "if":
        branches = [(_compile_expression(test, filters), compile_nodes(body, filters)) for test, body in node[1]]

        def choose(values: Values, out: Output) -> None:
            for test, body in branches:
                if _truth(test(values)):
                    body(values, out)
                    return

        return choose
    if kind == "for":
        items, body = _compile_expression(node[2], filters), compile_nodes(node[3], filters)

        def loop(values: Values, out: Output) -> None:
            for item in items(values) or []:
                body({**values, node[1]: item}, out)

        return loop
    inner = compile_nodes(node[1], filters)

    def generate(values: Values, out: Output) -> None:
        start = out.length
        inner(values, out)
        out.spans.append((start, out.length))

    return generate


def compile_template(source: str, filters: Filters) -> Callable[[Values], Output]:
    """Render a whole conversation: ``compile_template(...)({"messages": [...]})``."""
    render = compile_nodes(fold(parse(source), filters), filters)

    def run(values: Values) -> Output:
        out = Output()
        render(values, out)
        return out

    return run


def split_at_messages(source: str, filters: Filters, name: str = "messages") -> tuple[list[tuple], str, list[tuple], list[tuple]]:
    """The folded nodes before the loop over messages, the loop's variable, its body, and what follows."""
    nodes = fold(parse(source), filters)
    loops = [i for i, node in enumerate(nodes) if node[0] == "for" and node[2] == ("name", name)]
    if len(loops) != 1 or name in _names(nodes[: loops[0]] + nodes[loops[0] + 1 :] + nodes[loops[0]][3]):
        raise TemplateError(f"a template that is rendered turn by turn has one outer loop over {name}, and names it nowhere else")
    i = loops[0]
    return nodes[:i], nodes[i][1], nodes[i][3], nodes[i + 1 :]


def _names(tree: object) -> set[str]:
    if isinstance(tree, tuple) and len(tree) == 2 and tree[0] == "name":
        return {tree[1]}
    return set().union(*map(_names, tree)) if isinstance(tree, (tuple, list)) else set()

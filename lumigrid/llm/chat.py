"""Chat formatting with a compiled, sandboxed template language (operator 4).

The language: text, ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set name = expression %}`` and ``{% generation %}``, whose output the loss mask covers. Expressions have
literals, names, ``a.b``/``a['b']`` (keys of mappings only), ``+``, comparisons, ``and/or/not`` and filters from
a fixed list; nothing reaches Python attributes or calls. A template is parsed into a syntax tree, constant
expressions and branches are folded, neighbouring text is joined, and each node becomes a Python closure.

The template in use marks turns with control strings. ``escape`` makes texts free of them: a backslash is
doubled and one is put behind a control string's first character, so ``unescape`` gives every text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The control strings.
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_MARK = re.compile(r"\\(.?)", re.S)

TEMPLATE = (
    "{% for turn in messages %}"
    "{% if turn.role == 'assistant' %}<s>{{ turn.role | escape }}\n{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>"
    "{% else %}[INST]{{ turn.role | escape | line }}\n{{ turn.text | escape }}[/INST]{% endif %}"
    "{% endfor %}"
)


def escape(s: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], s)


def unescape(s: str) -> str:
    # an inserted backslash never stands before a backslash or an n; "\n" stands for a line end in a role
    return _MARK.sub(lambda m: "\\" if m[1] == "\\" else "\n" if m[1] == "n" else m[1], s)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": lambda s: s.replace("\n", "\\n"), "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# --- syntax tree: tuples (kind, ...); ("const", value) folds ---------------------------------------------
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>|.()\[\],]))")
_BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "in": lambda a, b: a in b}
_LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent: or < and < not < comparison < + < filter < member < atom."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"bad expression: {source!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            return self.tokens[self.at][1]
        return None

    def take(self, *values: str) -> str | None:
        found = self.peek(*values)
        self.at += found is not None
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value}")

    def parse(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError("trailing tokens in an expression")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("binary", op, node, self.added())
        return node

    def added(self):
        node = self.filtered()
        while self.take("+"):
            node = ("binary", "+", node, self.filtered())
        return node

    def filtered(self):
        node = self.member()
        while self.take("|"):
            node = ("filter", self.name(FILTERS), node)
        return node

    def name(self, among=None) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or among is not None and value not in among:
            raise TemplateError(f"unknown or missing name: {value!r}")
        self.at += 1
        return value

    def member(self):
        node = self.atom()
        while op := self.take(".", "["):
            if node == ("name", "messages"):
                raise TemplateError("messages are read once and in order: they have no members to name")
            if op == ".":
                node = ("member", node, ("const", self.name()))
            else:
                node = ("member", node, self.either())
                self.need("]")
        return node

    def atom(self):
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", float(value) if "." in value else int(value))
        if kind == "name":
            return ("const", _LITERALS[value]) if value in _LITERALS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def _fold(node):
    kind, *rest = node
    if kind in ("const", "name"):
        return node
    rest = [_fold(x) if isinstance(x, tuple) else x for x in rest]
    parts = [x for x in rest if isinstance(x, tuple)]
    if kind in ("and", "or") and rest[0][0] == "const":
        return rest[1] if bool(rest[0][1]) == (kind == "and") else rest[0]
    if all(x[0] == "const" for x in parts):
        return ("const", _evaluate((kind, *rest))({}))
    return (kind, *rest)


def _evaluate(node) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind, *rest = node
    if kind == "const":
        return lambda scope, v=rest[0]: v
    if kind == "name":
        return lambda scope, n=rest[0]: scope.get(n)
    if kind == "not":
        inner = _evaluate(rest[0])
        return lambda scope: not inner(scope)
    if kind == "filter":
        f, inner = FILTERS[rest[0]], _evaluate(rest[1])
        return lambda scope: f(_shown(inner(scope)))
    if kind == "binary":
        op, a, b = _BINARY[rest[0]], _evaluate(rest[1]), _evaluate(rest[2])
        return lambda scope: op(a(scope), b(scope))
    a, b = _evaluate(rest[0]), _evaluate(rest[1])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: x.get(b(scope)) if isinstance(x := a(scope), dict) else None


def _shown(value: object) -> str:
    return "" if value is None else str(value)


def parse(source: str) -> list[tuple]:
    """The folded syntax tree of a template: nodes text, out, for, if, set, generation."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pos = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal pos
        body: list[tuple] = []

        def add(node):
            if node[0] == "text" and body and body[-1][0] == "text":
                node = ("text", body.pop()[1] + node[1])
            if node[0] != "text" or node[1]:
                body.append(node)

        while pos < len(pieces):
            kind, value = pieces[pos]
            pos += 1
            if kind == "text":
                add((kind, value))
                continue
            if kind == "out":
                e = _fold(_Expression(value).parse())
                add(("text", _shown(e[1])) if e[0] == "const" else ("out", e))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return body, value
            if word == "for":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    raise TemplateError(f"bad for: {value!r}")
                over = _fold(_Expression(m[2]).parse())
                add(("for", m[1], over, block("endfor")[0]))
            elif word == "if":
                branches, otherwise = [], []
                test, (inner, end) = rest, block("elif", "else", "endif")
                while True:
                    branches.append((_fold(_Expression(test).parse()), inner))
                    if end.startswith("elif"):
                        test, (inner, end) = end.partition(" ")[2], block("elif", "else", "endif")
                        continue
                    if end == "else":
                        otherwise = block("endif")[0]
                    break
                kept = []
                for test, inner in branches:
                    if test[0] == "const":
                        if test[1]:
                            otherwise = inner
                            break
                    else:
                        kept.append((test, inner))
                if kept:
                    add(("if", kept, otherwise))
                else:
                    for node in otherwise:
                        add(node)
            elif word == "set":
                name, eq, e = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError(f"bad set: {value!r}")
                add(("set", name.strip(), _fold(_Expression(e).parse())))
            elif word == "generation":
                add(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag: {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    return block()[0]


Piece = tuple[str, bool]  # text, whether the loss mask covers it


def _compile(body: list[tuple], masked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(node, masked) for node in body]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: tuple, masked: bool) -> Callable[[dict], Iterable[Piece]]:
    kind, *rest = node
    if kind == "text":
        piece = [(rest[0], masked)]
        return lambda scope: piece
    if kind == "out":
        value = _evaluate(rest[0])
        return lambda scope: [(_shown(value(scope)), masked)]
    if kind == "generation":
        return _compile(rest[0], True)
    if kind == "set":
        value = _evaluate(rest[1])

        def assign(scope, name=rest[0]):
            scope[name] = value(scope)
            return ()

        return assign
    if kind == "if":
        branches, otherwise = [(_evaluate(t), _compile(b, masked)) for t, b in rest[0]], _compile(rest[1], masked)
        return lambda scope: next((b for t, b in branches if t(scope)), otherwise)(scope)
    name, over, inner = rest[0], _evaluate(rest[1]), _compile(rest[2], masked)

    def loop(scope: dict) -> Iterator[Piece]:
        # items may come from a stream: one is looked ahead, for loop.last
        own, items, index = dict(scope), iter(over(scope) or ()), 0
        item = next(items, loop)
        while item is not loop:
            after = next(items, loop)
            own[name], own["loop"] = item, {"index0": index, "index": index + 1, "first": index == 0, "last": after is loop}
            yield from inner(own)
            item, index = after, index + 1

    return loop


@lru_cache(maxsize=64)
def compiled(source: str) -> Callable[[dict], Iterator[Piece]]:
    return _compile(parse(source), False)


def render(source: str, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask (code points)."""
    out, spans, at = [], [], 0
    for text, masked in compiled(source)({"messages": messages}):
        if masked and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


_TURN = re.compile(r"(<s>|\[INST\])(.*?)\n(.*?)(</s>|\[/INST\])", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns in a formatted conversation."""
    return [(unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


class Reader:
    """Reads a formatted conversation from its characters alone, as they come; holds what isn't a whole turn yet.

    ``feed`` takes the next characters and which of them (start, end, from the beginning of all) the loss mask covers, and yields
    (role, text, text under the mask) of every turn that they end. Characters that are no turn raise ``ValueError``.
    """

    def __init__(self):
        self.buffer, self.begin, self.spans = "", 0, []

    def feed(self, text: str, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[str, str, str]]:
        self.buffer += text
        self.spans += spans
        at = 0
        while m := _TURN.match(self.buffer, at):
            at, end, under, later = m.end(), self.begin + m.end(), [], []
            for a, b in self.spans:
                under.append(self.buffer[a - self.begin : min(b, end) - self.begin])
                if b > end:
                    later.append((max(a, end), b))
            self.spans = later
            yield unescape(m[2]), unescape(m[3]), unescape("".join(under))
        self.buffer, self.begin = self.buffer[at:], self.begin + at

    def close(self) -> None:
        if self.buffer or self.spans:
            raise ValueError(f"not a turn: {self.buffer[:80]!r}")


FORMATTED = "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order (ties by role and text); nulls first, null role or text: empty."""
    common.ship(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Conversations as streams of turns, from sorted batches; a long conversation isn't held whole."""
    rows = ((c, {"role": r, "text": t}) for part in common.chunks(batches) for c, r, t in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
    head = next(rows, None)
    while head is not None:
        key = head[0]

        def turns():
            nonlocal head
            while head is not None and head[0] == key:
                now = head[1]
                head = next(rows, None)
                yield now

        stream = turns()
        yield key, stream
        for _ in stream:  # what the template didn't read
            pass


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: the formatted text and the loss spans. An empty table gives no rows, a null conv_id is a conversation of its own."""
    out = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, turns in _groups(batches):
            text, spans = render(template, turns)
            yield common.batch_of(out, [key], [text], [[a for a, _ in spans]], [[b for _, b in spans]])

    return ordered(conversations).mapInArrow(run, FORMATTED)


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formats, reads the formatted characters back and digests what was read; memory holds one turn.

    The reader sees characters and loss offsets, not where the template's pieces end; it gets them when a control string may be complete.
    Ties of (conv_id, turn) go by role and text, repeated rows are turns of their own. An empty table gives no rows. A null conv_id is a
    conversation of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in _DIGESTS]
        program = compiled(template)
        for key, turns in _groups(batches):
            n, chars, loss_chars, whole, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            reader, held, spans = Reader(), [], []

            def read():
                nonlocal n, loss_chars
                for role, text, under in reader.feed("".join(held), spans):
                    n += 1
                    whole.update(f"{role}\n{text}\n".encode())
                    loss_chars += len(under)
                    loss.update(under.encode())
                held.clear()
                spans.clear()

            tail = ""
            for text, masked in program({"messages": turns}):
                held.append(text)
                if masked and text:
                    spans.append((chars, chars + len(text)))
                chars += len(text)
                tail = tail[-6:] + text
                if "</s>" in tail or "[/INST]" in tail:
                    read()
                    tail = ""
            read()
            reader.close()
            for column, value in zip(rows, (key, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True):
                column.append(value)
            if len(rows[0]) >= 4096:
                yield common.batch_of(_DIGESTS, *rows)
                rows = [[] for _ in _DIGESTS]
        if rows[0]:
            yield common.batch_of(_DIGESTS, *rows)

    return ordered(conversations).mapInArrow(run, DIGESTS)


#: The conversation that the contract adds.
ADDED = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    return digests(table.unionByName(more))

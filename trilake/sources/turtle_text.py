"""Turtle text cut into statements and statements without brackets, in plain Python.

Chunks of lines go through here in order, in one look at their text. What depends on other
chunks is left open: the statements that a chunk starts or ends within come out as pieces,
and names whose prefix (or base) is bound before the chunk come out with them.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from trilake.sources.ntriples import IRI, LANG, LITERAL_BODY
from trilake.vocab import RDF

# Executors need not have this package: what runs there is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = r"""(?:[^\s;,"'<>\[\](){}@#\\.]++|\\.|\.(?=[^\s;,"'<>\[\](){}@#.]))++"""
SUFFIX = rf"(?:\^\^(?:{IRI}|{NAME})|{LANG})?+"
SINGLE_BODY = LITERAL_BODY.replace('"', "\0").replace("'", '"').replace("\0", "'")
CLOSE = {1: r'(?:[^"\\]++|\\.|"(?!""))*+"""', 2: r"(?:[^'\\]++|\\.|'(?!''))*+'''"}
LONG = rf'(?:"""{CLOSE[1]}|\'\'\'{CLOSE[2]})'
#: Tokens, each with what stands before it.
TOKEN = (
    r"(?s)(?:\s|#[^\n]*+)*+"
    rf"({LONG}{SUFFIX}|{LITERAL_BODY}{SUFFIX}|{SINGLE_BODY}{SUFFIX}|{IRI}|[;,.]|{NAME}|\S|$)"
)
QUOTED = r"(?s)^(\"\"\"|'''|')(.*)\1([^\"']*)$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: A token that is a term, or may be one.
TERM = r"""(?:[^\n,;.'"\[\](){}@][^\n]*+|\.[^\n]++|"[^\n]++)"""
#: Stands for the place of a statement in its file, in labels of nodes; no token starts so.
PLACE = "_:<"

# Lines are joined here, so strings must end where their line does.
_ESCAPED = r"\\[^\n\r\x85\u2028\u2029]"
_LONG_LINES = LONG.replace(r"\\.", r"\\[\s\S]")
_WORD = NAME.replace(r"\\.", _ESCAPED)
_SKIP = (
    rf"(?:\s++|#[^\n]*+|{_LONG_LINES}|\"(?!\"\")(?:[^\"\\\n]++|{_ESCAPED})*+\"|'(?!'')(?:[^'\\\n]++|{_ESCAPED})*+'"
    rf"|{IRI}|{_WORD}|(?!\"\"\"|''')[^.])"
)
_END = re.compile(rf"{_SKIP}*+\.", re.ASCII)
_CLOSED = {state: re.compile(close.replace(r"\\.", r"\\[\s\S]"), re.ASCII) for state, close in CLOSE.items()}
_TOKENS = re.compile(TOKEN, re.ASCII)
# Full stops that are tokens, but may belong to a name for `_END`.
_IN_NAME = r"""(?=[^\s;,"'<>\[\](){}@#.])"""
_AFTER_MARK = re.compile(r"""\.(?<=[\s;,"'<>\[\](){}@#.]\.)""" + _IN_NAME, re.ASCII)
_AFTER_LANG = re.compile(r"@[A-Za-z0-9-]+\." + _IN_NAME, re.ASCII)
_ONE_LINE = re.compile(QUOTED, re.ASCII)
_UNESCAPED = re.compile(r'(?s)((?:\\.|[^"\\])*+)"')
_ABSOLUTE = re.compile("<" + SCHEME[1:], re.ASCII)
_TERM = re.compile(TERM, re.ASCII)
_SCHEMED = re.compile(SCHEME, re.ASCII)
_PREFIX = re.compile(r"[^\s:<]*:", re.ASCII)
_PLAIN_NAME = re.compile(r"[^/?#:.][^/?#:]*+", re.ASCII)
_BRACKETS = frozenset("[]()")
_FIRST, _REST, _NIL = (f"<{RDF}{name}>" for name in ("first", "rest", "nil"))

#: Characters of text that are cut at once, about, and rows of a batch that goes out.
TEXT_SIZE, BATCH_ROWS = 1 << 20, 5_000

DIRECTIVES = pa.list_(pa.struct([("kind", pa.string()), ("prefix", pa.string()), ("iri", pa.string()), ("k", pa.int64()), ("i", pa.int32())]))
#: Kinds of rows: a statement that is complete but for names bound before its chunk, one
#: that depends on a base from there, a piece of a statement, and what a chunk has in all.
STATEMENT, LATE, PIECE, CHUNK = range(4)
CUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("k", pa.int64()), ("lined", pa.list_(pa.string())),
                 ("own", pa.string()), ("base", pa.string()), ("opens", pa.string()), ("found", DIRECTIVES)])
CUT_DDL = "file string, block long, chunk long, kind int, k long, lined array<string>, own string, base string, opens string, found array<struct<kind:string,prefix:string,iri:string,k:long,i:int>>"
WHOLE_DDL = "file string, n long, lined array<string>, opens string, found array<struct<kind:string,prefix:string,iri:string,k:long,i:int>>"


# ---------------------------------------------------------------- IRIs


def _without_dots(path: str) -> str:
    parts, done = path.split("/"), []
    for part in parts:
        if part == "..":
            if len(done) > 1:
                done.pop()
        elif part != ".":
            done.append(part)
    return "/".join(done) + ("/" if parts[-1] in (".", "..") else "")


@lru_cache(1 << 12)
def _base_parts(base: str) -> tuple[str, str, str, str]:
    """Scheme, root, path, and what comes before a plain name."""
    scheme = _SCHEMED.match(base)
    if not scheme:
        raise ValueError("a base is absolute")
    root = re.match(rf"{SCHEME}(?://[^/?#]*)?", base, re.ASCII)[0]
    path = re.match("[^?#]*", base[len(root) :])[0]
    folder = "/" if path == "" and "//" in root else path[: path.rfind("/") + 1]
    return scheme[0], root, path, folder


@lru_cache(1 << 12)
def _before_names(base: str) -> str:
    _, root, _, folder = _base_parts(base)
    return root + _without_dots(folder + "x")[:-1]


@lru_cache(1 << 12)
def _resolved_again(base: str, reference: str) -> str:
    """For references that come again and again, as those of directives do."""
    return resolved(base, reference)


def resolved(base: str, reference: str) -> str:
    """An IRI reference against an absolute base; as `turtle_lines.resolve` has it for columns."""
    if _PLAIN_NAME.fullmatch(reference):
        return _before_names(base) + reference
    if _SCHEMED.match(reference):
        return reference
    scheme, root, path, folder = _base_parts(base)
    if reference.startswith("//"):
        return scheme + reference
    if reference == "" or reference[0] == "#":
        return base.partition("#")[0] + reference
    if reference[0] == "?":
        return root + path + reference
    own = re.match("[^?#]*", reference)[0]
    tail = reference[len(own) :]
    return root + _without_dots(own if own[0] == "/" else folder + own) + tail


# ---------------------------------------------------------------- statements


def _unsure(text: str) -> bool:
    """Tokens may end a statement elsewhere than `_END` does, as for strings that go on."""
    if '"""' in text or "'''" in text or "\\\n" in text or text[:1] == ".":
        return True
    return bool(_AFTER_MARK.search(text) or _AFTER_LANG.search(text))


def _cut(text: str, state: int) -> tuple[list[tuple[str, list[str] | None]], str]:
    """The statements that end in a text which starts in a state, and what is left.

    A statement comes with its tokens if those were found on the way.
    """
    if not state and not _unsure(text):
        tokens = _TOKENS.findall(text)
        if '"' not in tokens and "'" not in tokens:
            found, start = [], 0
            try:
                while True:
                    end = tokens.index(".", start) + 1
                    found.append(("", tokens[start:end]))
                    start = end
            except ValueError:
                pass
            # what is left has the same tokens if each gets a line of its own
            return found, "".join([f"{t}\n" for t in tokens[start:] if t])
    found, start, at = [], 0, 0
    if state:
        closed = _CLOSED[state].match(text)
        if not closed:
            return found, text
        at = closed.end()
    while end := _END.match(text, at):
        at = end.end()
        found.append((text[start:at], None))
        start = at
    return found, text[start:]


def _one_line(token: str) -> str:
    """A string as a short one in double quotes."""
    if len(token) > 1 and (token[0] == "'" or token.startswith('"""')):
        parts = _ONE_LINE.match(token)
        inner, suffix = (parts[2], parts[3]) if parts else ("", "")
        out, at = [], 0
        while quote := _UNESCAPED.match(inner, at):
            out.append(quote[1] + '\\"')
            at = quote.end()
        return f'"{"".join(out)}{inner[at:]}"{suffix}'.replace("\n", "\\n").replace("\r", "\\r")
    return token


def _tokens(text: str, tokens: list[str] | None) -> list[str]:
    found = _TOKENS.findall(text) if tokens is None else tokens
    while found and not found[-1]:
        found.pop()
    return [_one_line(t) if t[0] == "'" or t[:3] == '"""' else t for t in found]


def _directive(tokens: list[str], at: int) -> tuple[int, tuple[str, str, str]] | None:
    """A directive at a place among tokens, and the place after it."""
    n = len(tokens)
    i = at + (at < n and tokens[at] == "@")
    kind = tokens[i] if i < n else ""
    prefix = ""
    if kind.lower() == "prefix":
        i += 1
        name = tokens[i] if i < n else ""
        if not _PREFIX.fullmatch(name):
            return None
        prefix = name[:-1]
    elif kind.lower() != "base":
        return None
    i += 1
    iri = tokens[i] if i < n else ""
    if len(iri) < 2 or iri[0] != "<" or iri[-1] != ">":
        return None
    i += 1
    return i + (i < n and tokens[i] == "."), (kind, prefix, iri[1:-1])


def _head(tokens: list[str]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """The directives that a statement starts with, and what else it has."""
    found, at = [], 0
    while at < len(tokens) and tokens[at][0] in "@pPbB" and (one := _directive(tokens, at)):
        at, directive = one
        found.append(directive)
    return found, tokens[at:] if at else tokens


def _shown(token: str) -> str:
    """What a token has of names: itself, the datatype of a literal, or nothing."""
    if token[0] != '"':
        return token
    suffix = token.rpartition('"')[2]
    return suffix[2:] if suffix.startswith("^^") else ""


def _names(tokens: list[str]) -> list[str]:
    """Keys of what tokens need: ``:`` and a prefix, or ``base``."""
    keys = {}
    for token in tokens:
        shown = _shown(token)
        if shown[:1] == "<":
            if not _ABSOLUTE.match(shown):
                keys["base"] = None
        elif ":" in shown:
            prefix = shown.partition(":")[0]
            if prefix != "_":
                keys[":" + prefix] = None
    return list(keys)


def _flat(tokens: list[str], sound: re.Pattern) -> list[str]:
    """A statement's tokens one a line; several statements without brackets for one with such.

    A statement with brackets that do not match, or with a part that is not sound, is
    refused as a whole. Nodes are named after the place of their bracket.
    """
    if len(tokens) > 1 and tokens[-1] == ".":
        tokens = tokens[:-1]
    if _BRACKETS.isdisjoint(tokens):
        return ["\n".join(tokens) + "\n"]
    groups: list[tuple[str, str, list[str]]] = [("", "", [])]  # kind, node, terms
    inside, refused, alone = [groups[0]], ["[\n"], False
    last = len(tokens) - 1
    for at, token in enumerate(tokens):
        if token not in _BRACKETS:
            inside[-1][2].append(token)
        elif token == "[" or token == "(":
            filled = at < last and tokens[at + 1] not in ("]", ")")
            node = f"{PLACE}{at}"
            if len(inside) == 1:
                alone = filled and token == "["
            inside[-1][2].append(node if filled or token == "[" else _NIL)
            inside.append((token, node, []))
            groups.append(inside[-1])
        elif inside.pop()[0] != ("[" if token == "]" else "("):
            return refused
    if len(inside) > 1:
        return refused
    parts: list[str] = []
    for kind, node, terms in groups:
        if not terms or not kind and alone and len(terms) == 1:
            continue
        if kind == "(":
            cell, n = node, 0
            for term in terms:
                if not _TERM.fullmatch(term):
                    return refused
                n += 1
                rest = f"{node}c{n}" if n < len(terms) else _NIL
                parts += f"{cell}\n{_FIRST}\n{term}\n", f"{cell}\n{_REST}\n{rest}\n"
                cell = rest
            continue
        part = "\n".join(terms) + "\n"
        if kind:
            part = f"{node}\n{part}"
        if not sound.search(part):
            return refused
        parts.append(part)
    return parts


# ---------------------------------------------------------------- chunks


class _Chunk:
    """What is known within a chunk, and its rows."""

    def __init__(self, key: tuple[str, int, int], state: int, sound: re.Pattern):
        self.key, self.state, self.sound = key, state, sound
        self.ends = 0  # of statements so far
        self.text, self.lines, self.size, self.wait = "", [], 0, TEXT_SIZE
        self.bound: dict[str, str] = {}  # by key, as for names
        self.last: dict[str, tuple] = {}  # the directives that hold at the end
        self.all: list[tuple] = []  # every directive as it is written
        self.late = False
        self.opens: dict[str, None] = {}
        self.rows: list[tuple] = []

    def add(self, lines: list[bytes]) -> None:
        at, n = 0, len(lines)
        while at < n:
            size, to = self.size, at
            while to < n and size < self.wait:
                size += len(lines[to]) + 1
                to += 1
            self.lines += lines[at:to]
            self.size, at = size, to
            if size >= self.wait:
                self.cut()

    def cut(self) -> None:
        text = b"\n".join([*self.lines, b""]).decode("utf-8", "replace")
        found, left = _cut(self.text + text, self.state)
        if found or self.ends:
            self.state = 0
        self.lines, self.text, self.size = [], left, len(left)
        self.wait = 2 * len(left) + TEXT_SIZE  # a long statement is not looked at again and again
        for piece, tokens in found:
            if self.ends:
                self.statement(_tokens(piece, tokens))
            else:
                self.rows.append((PIECE, 0, [piece if tokens is None else "\n".join(tokens)], None, None, None))
            self.ends += 1

    def bind(self, i: int, kind: str, prefix: str, iri: str) -> None:
        self.all.append((kind, prefix, iri, self.ends, i))
        key, base = ("base" if kind.lower() == "base" else ":" + prefix), self.bound.get("base")
        if not _SCHEMED.match(iri):
            if base is None:
                self.late = True
                return
            iri = _resolved_again(base, iri)
        self.bound[key] = iri
        self.last[key] = (kind, prefix, iri, self.ends, i)

    def statement(self, tokens: list[str]) -> None:
        found, body = _head(tokens)
        for i, directive in enumerate(found):
            self.bind(i, *directive)
        if not body:
            return
        keys = _names(body)
        if self.late:
            self.rows.append((LATE, self.ends, _flat(body, self.sound), None, None, "\n".join(keys)))
            return
        bound = self.bound
        base = bound.get("base")
        if "base" in keys and base is not None:
            body = [
                f"<{resolved(base, t[1:-1])}>" if t[0] == "<" and t[-1] == ">" and len(t) > 1 and not _ABSOLUTE.match(t) else t for t in body
            ]
        opens = [k for k in keys if k not in bound]
        for k in opens:
            self.opens[k] = None
        own = "\n".join([f"{k[1:]}\t{bound[k]}" for k in keys if k in bound and k != "base"])
        self.rows.append((STATEMENT, self.ends, _flat(body, self.sound), own or None, base if "base" in keys else None, "\n".join(opens) if opens else None))

    def done(self) -> list[tuple]:
        """What is left of the chunk, and the row that stands for it."""
        if self.lines:
            self.cut()
        if self.text.strip() or self.state and not self.ends:
            # without the feed after the last line: pieces are joined with one
            self.rows.append((PIECE, self.ends, [self.text.removesuffix("\n")], None, None, None))
        found = self.all if self.late else [*self.last.values()]
        return [(CHUNK, self.ends, None, None, None, "\n".join(self.opens) if self.opens else None, _rows(found))]


def _rows(found: list[tuple]) -> list[dict]:
    return [dict(zip(("kind", "prefix", "iri", "k", "i"), x)) for x in found]


def _batch(key: tuple[str, int, int], rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    file, block, chunk = key
    kind, k, lined, own, base, opens = [*zip(*rows)][:6]
    found = pa.array([rows[0][6]], DIRECTIVES) if len(rows[0]) > 6 else pa.nulls(n, DIRECTIVES)
    columns = [pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.repeat(pa.scalar(chunk, pa.int64()), n)]
    columns += [pa.array(kind, pa.int32()), pa.array(k, pa.int64()), _lists(lined), *[pa.array(v, pa.string()) for v in (own, base, opens)]]
    return pa.RecordBatch.from_arrays([*columns, found], schema=CUT)


def _lists(values: list[list[str] | None]) -> pa.ListArray:
    ends = [0, *accumulate([len(v or ()) for v in values])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([*chain.from_iterable([v or () for v in values])], pa.string()))


def cut_chunks(sound: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (file, block, chunk, state, line), in order, to batches of `CUT`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(sound, re.ASCII)
        chunk: _Chunk | None = None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            if chunk is None:
                return
            ended = chunk.done() if last else []
            if chunk.rows and (last or len(chunk.rows) >= BATCH_ROWS):
                rows, chunk.rows = chunk.rows, []
                for at in range(0, len(rows), BATCH_ROWS):
                    yield _batch(chunk.key, rows[at : at + BATCH_ROWS])
            if ended:
                yield _batch(chunk.key, ended)

        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.select(["file", "block", "chunk"])
            ends = sorted({end for column in places.columns for end in pc.run_end_encode(column).run_ends.to_pylist()})
            at = 0
            for end in ends:
                key = tuple(column[at].as_py() for column in places.columns)
                if chunk is None or chunk.key != key:
                    yield from out(True)
                    chunk = _Chunk(key, batch["state"][at].as_py(), pattern)
                chunk.add(batch["line"].slice(at, end - at).to_pylist())
                yield from out(False)
                at = end
        yield from out(True)

    return run


def parse_statements(sound: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (file, n, text) of single statements to batches (file, n, lined, opens, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(sound, re.ASCII)
        for batch in batches:
            lined, opens, founds = [], [], []
            for text in batch["text"].to_pylist():
                found, body = _head(_tokens(text, None))
                lined.append(_flat(body, pattern) if body else [])
                opens.append("\n".join(_names(body)) or None)
                founds.append(_rows([(*d, 0, i) for i, d in enumerate(found)]))
            columns = [batch["file"], batch["n"], _lists(lined), pa.array(opens, pa.string()), pa.array(founds, DIRECTIVES)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "n", "lined", "opens", "found"])

    return run

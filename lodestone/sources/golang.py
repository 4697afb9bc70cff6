"""Go source text to records, in pure Python for use inside Arrow batches: a lexer, a statement splitter, extractors.

Texts that do not parse give one file record with the purpose ``parse error``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"(?P<nl>\n)|(?P<ws>[ \t\r]+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<str>\"(?:[^\"\\\n]|\\.)*\")|(?P<chr>'(?:[^'\\\n]|\\.)+')|"
    r"(?P<num>\d[\w.]*(?:[eEpP][+-]?\d+)?|\.\d[\w]*)|(?P<id>[^\W\d]\w*)|(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])",
    re.S,
)
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class ParseError(ValueError):
    """The text is no Go source."""


@dataclass
class Tok:
    kind: str
    text: str
    line: int
    doc: str = ""


def lex(src: str) -> list[Tok]:
    """Tokens with automatic semicolons; a token carries the comment lines directly above it."""
    out: list[Tok] = []
    at, line, doc, blank = 0, 1, [], True
    while at < len(src):
        m = TOKEN.match(src, at)
        if not m:
            raise ParseError(f"line {line}")
        k, t = m.lastgroup, m[0]
        if k == "nl" or (k == "block" and "\n" in t):
            if out and out[-1].text != "\n" and (out[-1].kind in ("str", "raw", "chr", "num") or out[-1].text in _ENDS or (out[-1].kind == "id" and out[-1].text not in KEYWORDS)):
                out.append(Tok("op", ";", line))
        if k == "nl":
            doc = [] if blank else doc
            blank = True
        elif k == "line":
            doc, blank = ([*doc, t[2:].strip()] if blank else doc), False
        elif k == "block":
            doc, blank = [*doc, *(x.strip(" *\t") for x in t[2:-2].split("\n"))], False
        elif k != "ws":
            out.append(Tok(k, t, line, "\n".join(doc).strip()))
            doc, blank = [], False
        line += t.count("\n")
        at = m.end()
    if out and out[-1].text != ";":
        out.append(Tok("op", ";", line))
    return out


def match(ts: list[Tok], i: int) -> int:
    """Index of the bracket that closes the one at i."""
    want = []
    for j in range(i, len(ts)):
        t = ts[j].text if ts[j].kind == "op" else ""
        if t in _CLOSE:
            want.append(_CLOSE[t])
        elif t in (")", "]", "}"):
            if not want or want.pop() != t:
                raise ParseError(f"line {ts[j].line}")
            if not want:
                return j
    raise ParseError(f"line {ts[i].line}: not closed")


def split(ts: list[Tok], sep: str) -> list[list[Tok]]:
    """Token runs between separators at depth 0."""
    out, depth, cur = [], 0, []
    for t in ts:
        if t.kind == "op" and t.text in _CLOSE:
            depth += 1
        elif t.kind == "op" and t.text in (")", "]", "}"):
            depth -= 1
        if depth == 0 and t.kind == "op" and t.text == sep:
            out.append(cur)
            cur = []
        else:
            cur.append(t)
    return [*out, cur] if cur or out else out


def type_text(ts: list[Tok]) -> str:
    """Text of a type expression: interfaces, functions and unknown forms are shortened."""
    if not ts:
        return ""
    a = ts[0].text
    if a == "*":
        return "*" + type_text(ts[1:])
    if a == "...":
        return "..." + type_text(ts[1:])
    if a == "[":
        j = match(ts, 0)
        return "[" + "".join(t.text for t in ts[1:j]) + "]" + type_text(ts[j + 1 :])
    if a == "map":
        j = match(ts, 1)
        return "map[" + type_text(ts[2:j]) + "]" + type_text(ts[j + 1 :])
    if a == "chan" or a == "<-":
        return "chan " + type_text([t for t in ts if t.text not in ("chan", "<-")])
    if a == "interface":
        return "interface{}"
    if a == "func":
        return "func(...)"
    if a == "(":
        return type_text(ts[1 : match(ts, 0)])
    if all(t.kind == "id" or t.text == "." for t in ts):
        return "".join(t.text for t in ts)
    if ts[0].kind in ("str", "raw", "num", "chr") and len(ts) == 1:
        return a
    return "..."


def _fields(ts: list[Tok]) -> list[tuple[str, str]]:
    """(name, type) of a parameter list; unnamed ones get ``_``."""
    groups = [g for g in split(ts, ",") if g]
    named = any(len(g) > 1 and g[0].kind == "id" and g[0].text not in KEYWORDS and g[1].text != "." and not (g[1].text == "[" and len(g) == match(g, 1) + 1) for g in groups)
    if not named:
        return [("_", type_text(g)) for g in groups]
    out, waiting = [], []
    for g in groups:
        if len(g) == 1:
            waiting.append(g[0].text)
        else:
            t = type_text(g[1:])
            out += [(n, t) for n in [*waiting, g[0].text]]
            waiting = []
    return out


@dataclass
class Stmt:
    """A statement: its kind, the tokens of its head, and its blocks."""

    kind: str
    head: list[Tok]
    blocks: list[list[Stmt]] = field(default_factory=list)

    @property
    def line(self) -> int:
        return self.head[0].line if self.head else 0


def _head_end(ts: list[Tok], i: int) -> int:
    """Index of the brace that opens the block of an if, for, switch or select at i (composite literals need brackets there)."""
    depth = 0
    j = i
    while j < len(ts):
        t = ts[j]
        if t.kind == "op":
            if t.text in "([":
                depth += 1
            elif t.text in ")]":
                depth -= 1
            elif t.text == "{" and depth == 0:
                if j > i and (ts[j - 1].text in ("struct", "interface")):
                    j = match(ts, j)
                else:
                    return j
        elif t.text == "func" and depth == 0:
            k = j + 1
            while ts[k].text != "{":
                k = match(ts, k) + 1 if ts[k].text == "(" else k + 1
            j = match(ts, k)
        j += 1
    raise ParseError(f"line {ts[i].line}: no block")


def statements(ts: list[Tok]) -> list[Stmt]:
    """Statements of a block's tokens."""
    out, i = [], 0
    while i < len(ts):
        t = ts[i].text
        if t == ";":
            i += 1
            continue
        if t in ("if", "for", "switch", "select"):
            b = _head_end(ts, i + 1)
            e = match(ts, b)
            head = ts[i + 1 : b]
            kind = t
            if t == "for" and any(x.text == "range" for x in head):
                kind = "range"
            if t == "switch" and any(a.text == "." and c.text == "(" and d.text == "type" for a, c, d in zip(head, head[1:], head[2:])):
                kind = "typeswitch"
            s = Stmt(kind, [ts[i], *head], [statements(ts[b + 1 : e])] if t in ("if", "for") else _clauses(ts[b + 1 : e]))
            out.append(s)
            i = e + 1
            while kind == "if" and i < len(ts) and ts[i].text == "else":
                if ts[i + 1].text == "if":
                    rest = statements(ts[i + 1 :])
                    s.blocks.append(rest[:1])
                    return [*out, *rest[1:]]
                e = match(ts, i + 1)
                s.blocks.append(statements(ts[i + 2 : e]))
                i = e + 1
            continue
        if t == "{":
            e = match(ts, i)
            out.append(Stmt("block", [ts[i]], [statements(ts[i + 1 : e])]))
            i = e + 1
            continue
        j, depth = i, 0
        while j < len(ts) and not (depth == 0 and ts[j].text == ";" and ts[j].kind == "op"):
            depth += (ts[j].kind == "op") * ((ts[j].text in _CLOSE) - (ts[j].text in (")", "]", "}")))
            j += 1
        run = ts[i:j]
        kind = t if t in ("return", "defer", "go", "var", "const", "type", "break", "continue", "goto", "fallthrough") else "expr"
        if kind == "expr" and any(x.kind == "op" and x.text in (":=", "=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=") for x in _flat(run)):
            kind = "assign"
        out.append(Stmt(kind, run))
        i = j + 1
    return out


def _flat(ts: list[Tok]) -> list[Tok]:
    """Tokens at depth 0."""
    out, depth = [], 0
    for t in ts:
        close = t.kind == "op" and t.text in (")", "]", "}")
        depth -= close
        if depth == 0 and not close and not (t.kind == "op" and t.text in _CLOSE):
            out.append(t)
        depth += t.kind == "op" and t.text in _CLOSE
    return out


def _clauses(ts: list[Tok]) -> list[list[Stmt]]:
    out, i, n = [], 0, len(ts)
    starts, depth = [], 0
    for j, t in enumerate(ts):
        depth += (t.kind == "op") * ((t.text in _CLOSE) - (t.text in (")", "]", "}")))
        if depth == 0 and t.text in ("case", "default") and t.kind == "id":
            starts.append(j)
    for a, b in zip(starts, [*starts[1:], n]):
        k, depth = a, 0
        while not (depth == 0 and ts[k].text == ":" and ts[k].kind == "op"):
            depth += (ts[k].kind == "op") * ((ts[k].text in _CLOSE) - (ts[k].text in (")", "]", "}")))
            k += 1
        out.append([Stmt("case", ts[a:k]), *statements(ts[k + 1 : b])])
        i = b
    return out


@dataclass
class Call:
    """A call: callee, receiver if it is one plain name, arguments, where."""

    name: str
    recv: str
    chained: bool
    args: list[list[Tok]]
    line: int
    start: int
    paren: int


def calls(ts: list[Tok]) -> list[Call]:
    """Calls of a token run, outer before inner, in source order."""
    out = []
    for i, t in enumerate(ts):
        if t.kind != "op" or t.text != "(" or i == 0:
            continue
        f = ts[i - 1]
        if f.kind != "id" or f.text in KEYWORDS:
            continue
        j, recv, chained = i - 1, "", False
        if j >= 1 and ts[j - 1].text == "]":
            continue  # a conversion to a slice or map type
        if j >= 1 and ts[j - 1].text == "func":
            continue
        if j >= 2 and ts[j - 1].text == ".":
            recv = ts[j - 2].text if ts[j - 2].kind == "id" else ""
            chained = ts[j - 2].kind != "id" or (j >= 3 and ts[j - 3].text == ".")
            while j >= 2 and ts[j - 1].text == ".":
                j -= 2
                while ts[j].text in (")", "]", "}") and ts[j].kind == "op":
                    j = _open(ts, j)
                    if j >= 1 and (ts[j - 1].kind == "id" and ts[j - 1].text not in KEYWORDS or ts[j - 1].text in (")", "]")):
                        j -= 1
                    elif j >= 2 and ts[j - 1].text == ".":
                        break
                    else:
                        break
        e = match(ts, i)
        out.append(Call(f.text, "" if chained else recv, chained, [a for a in split(ts[i + 1 : e], ",") if a], ts[max(j, 0)].line, j, i))
    return sorted(out, key=lambda c: (c.start, -c.paren))


def _open(ts: list[Tok], i: int) -> int:
    depth = 0
    for j in range(i, -1, -1):
        if ts[j].kind == "op":
            depth += (ts[j].text in (")", "]", "}")) - (ts[j].text in _CLOSE)
            if depth == 0:
                return j
    raise ParseError(f"line {ts[i].line}")


def sole_call(ts: list[Tok]) -> Call | None:
    """The call that a token run as a whole is."""
    if len(ts) < 3 or ts[-1].text != ")" or _open(ts, len(ts) - 1) == 0:
        return None
    p = _open(ts, len(ts) - 1)
    return next((c for c in calls(ts) if c.paren == p and c.start == 0), None)


def literal_bodies(ts: list[Tok]) -> list[list[Tok]]:
    """Bodies of the function literals in a token run."""
    out, i = [], 0
    while i < len(ts):
        if ts[i].text == "func" and ts[i].kind == "id":
            k = i + 1
            try:
                while ts[k].text != "{":
                    k = match(ts, k) + 1 if ts[k].text == "(" else k + 1
                    if ts[k].text in (",", ";", ")"):
                        raise IndexError
                e = match(ts, k)
                out.append(ts[k + 1 : e])
                i = e
            except IndexError:
                pass
        i += 1
    return out


def walk(block: list[Stmt]):
    """All statements of a block, outer first, those of function literals included."""
    for s in block:
        yield s
        if s.kind in ("if", "switch", "typeswitch", "for"):
            parts = split(s.head[1:], ";")
            if len(parts) > 1 and parts[0]:
                yield from walk(statements(parts[0]))
        for body in literal_bodies(s.head):
            yield from walk(statements(body))
        for b in s.blocks:
            yield from walk(b)


@dataclass
class Func:
    """A function declaration."""

    name: str
    receiver: str
    params: list[tuple[str, str]]
    returns: list[str]
    doc: str
    line_start: int
    line_end: int
    body: list[Tok] | None
    n_results: int = 0

    @property
    def block(self) -> list[Stmt]:
        return statements(self.body or [])


@dataclass
class File:
    """What a source file declares."""

    package: str = ""
    doc: str = ""
    imports: list[tuple[str, str]] = field(default_factory=list)
    funcs: list[Func] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    consts: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)

    @property
    def aliases(self) -> dict[str, str]:
        return {a or p.rsplit("/", 1)[-1]: p for a, p in self.imports}


def is_exported(name: str) -> bool:
    return name[:1].isascii() and name[:1].isupper()


def _func(ts: list[Tok], f: File) -> None:
    i, receiver = 1, ""
    if ts[i].text == "(":
        e = match(ts, i)
        r = _fields(ts[i + 1 : e])
        receiver = r[0][1] if r else ""
        i = e + 1
    name = ts[i].text
    i += 1
    if ts[i].text == "[":
        i = match(ts, i) + 1
    e = match(ts, i)
    params = _fields(ts[i + 1 : e])
    i, b = e + 1, len(ts)
    for j in range(i, len(ts)):
        if ts[j].text == "{" and ts[j - 1].text not in ("interface", "struct"):
            b = j
            break
    res = ts[i:b]
    if res and res[0].text == "(" and match(res, 0) == len(res) - 1:
        returns = [t for _, t in _fields(res[1:-1])]
    else:
        returns = [type_text(res)] if res else []
    body = ts[b + 1 : match(ts, b)] if b < len(ts) else None
    f.funcs.append(Func(name, receiver, params, returns, ts[0].doc, ts[0].line, ts[match(ts, b)].line if b < len(ts) else ts[-1].line, body, len(returns)))


def _type(ts: list[Tok], doc: str, f: File) -> None:
    name, line = ts[0].text, ts[0].line
    i = 1
    if len(ts) > 2 and ts[1].text == "[" and ts[2].kind == "id" and match(ts, 1) > 2 and match(ts, 1) + 1 < len(ts):
        i = match(ts, 1) + 1
    alias = i < len(ts) and ts[i].text == "="
    body = ts[i + alias :]
    d = {"name": name, "kind": "alias", "description": doc, "is_public": is_exported(name), "line_start": line, "line_end": ts[-1].line, "fields": [], "methods": []}
    if body and body[0].text == "struct":
        d["kind"] = "struct"
        for run in split(body[2 : match(body, 1)], ";"):
            tag = run[-1].text if run and run[-1].kind in ("str", "raw") else ""
            run = run[:-1] if tag else run
            if not run:
                continue
            names, k = [], 0
            if run[0].kind == "id" and len(run) > 1 and run[1].text != ".":
                names, k = [run[0].text], 1
                while k + 1 < len(run) and run[k].text == ",":
                    names.append(run[k + 1].text)
                    k += 2
            t = type_text(run[k:])
            d["fields"] += [{"name": n, "type": t, "tag": tag, "is_public": is_exported(n)} for n in names or [t]]
    elif body and body[0].text == "interface":
        d["kind"] = "interface"
        d["methods"] = [r[0].text for r in split(body[2 : match(body, 1)], ";") if len(r) > 1 and r[0].kind == "id" and r[1].text == "("]
    f.types.append(d)


def _values(ts: list[Tok], kind: str, f: File) -> None:
    eq = next((j for j, t in enumerate(ts) if t.text == "="), len(ts))
    left, values = ts[:eq], split(ts[eq + 1 :], ",")
    names, k = [left[0]], 1
    while k + 1 < len(left) and left[k].text == ",":
        names.append(left[k + 1])
        k += 2
    t = type_text(left[k:])
    for j, n in enumerate(names):
        value = type_text(values[j]) if j < len(values) else ""
        if kind == "const":
            f.consts.append({"name": n.text, "type": t, "value": value, "is_public": is_exported(n.text), "line_start": n.line})
        if is_exported(n.text):
            f.exports.append({"name": n.text, "kind": kind, "signature": t})


def parse(src: str) -> File:
    """Declarations of a source text; raises :class:`ParseError`."""
    ts = lex(src)
    if len(ts) < 2 or ts[0].text != "package" or ts[1].kind != "id":
        raise ParseError("no package")
    f = File(ts[1].text, ts[0].doc)
    try:
        for run in split(ts[2:], ";"):
            if not run:
                continue
            k = run[0].text
            if k == "func":
                _func(run, f)
            elif k in ("import", "const", "var", "type"):
                if len(run) < 2:
                    raise ParseError(f"line {run[0].line}")
                groups = split(run[2 : match(run, 1)], ";") if run[1].text == "(" else [run[1:]]
                for g in filter(None, groups):
                    if k == "import":
                        f.imports.append((g[0].text if len(g) > 1 else "", g[-1].text.strip('"`')))
                    elif k == "type":
                        _type(g, g[0].doc or run[0].doc, f)
                    else:
                        _values(g, k, f)
            else:
                raise ParseError(f"line {run[0].line}")
    except IndexError as e:
        raise ParseError("ends too early") from e
    return f

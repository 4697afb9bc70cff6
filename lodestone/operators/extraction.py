"""Records from source files: functions with behaviour, calls, effects, errors and API flow; types, constants, routes.

:func:`extract` runs the parser in Arrow batches over (repo_id, path, content) and gives one row per file with nested
lists; :func:`functions`, :func:`types` and the like explode them. A file that does not parse, or of another language,
keeps its row, with a purpose told by its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import golang as G
from ..sources.files import language, purpose

# fixed values: verbs of name prefixes, in order of precedence
VERBS = (
    ("get", "Get"), ("set", "Set"), ("create", "Create"), ("delete", "Delete"), ("update", "Update"), ("validate", "Validate"), ("parse", "Parse"), ("build", "Build"), ("init", None),
    ("new", "Create new"), ("handle", "Handle"), ("process", "Process"), ("send", "Send"), ("read", "Read"), ("write", "Write"), ("load", "Load"), ("save", "Save"), ("fetch", "Fetch"),
    ("convert", "Convert"), ("format", "Format"), ("check", "Check"), ("is", "Check if"), ("has", "Check has"), ("can", "Check can"),
)
# fixed values: descriptions of standard library calls by package; the first entry of each names what is not listed
STDLIB = {
    "http": ("HTTP", {"Get": "HTTP GET request", "Post": "HTTP POST request", "NewRequest": "Create HTTP request", "ListenAndServe": "Start HTTP server", "HandleFunc": "Register HTTP handler", "Do": "Execute HTTP request"}),
    "json": ("JSON", {"Marshal": "Encode to JSON", "Unmarshal": "Decode from JSON", "NewEncoder": "Create JSON encoder", "NewDecoder": "Create JSON decoder", "Encode": "Write JSON", "Decode": "Read JSON"}),
    "fmt": ("Format", {"Printf": "Print output", "Println": "Print output", "Print": "Print output", "Sprintf": "Format string", "Errorf": "Create formatted error", "Fprintf": "Write formatted output"}),
    "os": ("OS", {"Open": "Open file", "Create": "Create file", "Remove": "Delete file", "Mkdir": "Create directory", "Getenv": "Read environment variable", "Exit": "Exit program", "ReadFile": "Read file contents", "WriteFile": "Write file contents"}),
    "io": ("IO", {"Copy": "Copy data stream", "ReadAll": "Read all data", "WriteString": "Write string"}),
    "strings": ("String", {"Contains": "Check string contains", "Split": "Split string", "Join": "Join strings", "TrimSpace": "Trim whitespace", "ToLower": "Convert to lowercase", "ToUpper": "Convert to uppercase", "Replace": "Replace in string", "HasPrefix": "Check string prefix", "HasSuffix": "Check string suffix"}),
    "log": ("Log", {"Printf": "Log message", "Println": "Log message", "Print": "Log message", "Fatal": "Log fatal error and exit", "Fatalf": "Log fatal error and exit", "Panic": "Log and panic", "Panicf": "Log and panic"}),
    "context": ("Context", {"Background": "Create background context", "WithCancel": "Create cancellable context", "WithTimeout": "Create context with timeout", "WithDeadline": "Create context with deadline", "WithValue": "Create context with value"}),
    "time": ("Time", {"Now": "Get current time", "Sleep": "Sleep/wait", "Parse": "Parse time", "Since": "Calculate duration", "After": "Wait for duration"}),
    "sql": ("Database", {"Query": "Execute SQL query", "QueryRow": "Execute SQL query", "Exec": "Execute SQL command", "Prepare": "Prepare SQL statement", "Begin": "Begin transaction", "Commit": "Commit transaction", "Rollback": "Rollback transaction", "Scan": "Read query result", "Close": "Close database connection"}),
    "errors": ("Error", {"New": "Create error", "Is": "Check error type", "As": "Cast error", "Wrap": "Wrap error with context", "Unwrap": "Unwrap error"}),
}
# fixed values: effects by receiver or import path and callee, in order; an empty set of callees stands for any
EFFECTS = (
    ("http_call", ("http",), ("http",), {"Get", "Post", "Put", "Delete", "Do", "NewRequest"}),
    ("file_io", ("os", "ioutil", "io"), (), {"Create", "Open", "OpenFile", "WriteFile", "ReadFile", "Remove", "Mkdir"}),
    ("io_operation", ("os", "ioutil", "io"), (), {"Write", "WriteString", "Read", "ReadAll", "Copy"}),
    ("db_query", ("db", "sql"), ("database", "sql"), {"Query", "QueryRow", "Exec", "Prepare"}),
    ("db_transaction", ("db", "sql"), ("database", "sql"), {"Begin", "Commit", "Rollback"}),
    ("logging", ("log", "logger"), ("log",), set()), ("redis_call", (), ("redis",), set()), ("kafka_call", (), ("kafka",), set()), ("grpc_call", (), ("grpc",), set()),
    ("context_management", ("context",), (), {"WithCancel", "WithTimeout", "WithDeadline"}), ("time_delay", ("time",), (), {"Sleep"}),
)
HTTP_VERBS = frozenset("GET POST PUT DELETE PATCH HEAD OPTIONS ANY".split())

CALL = "struct<function:string,package:string,line:int,type:string>"
FUNCTION = (
    "struct<name:string,receiver:string,signature:string,description:string,is_public:boolean,line_start:int,line_end:int,complexity:int,parameters:array<struct<name:string,type:string>>,returns:array<string>,"
    f"uses_imports:array<string>,calls:array<{CALL}>,side_effects:array<string>,behavior:struct<summary:string,steps:array<string>,patterns:array<string>,input_usage:map<string,string>,output_source:string>,"
    "error_handling:struct<returns_error:boolean,wraps_errors:boolean,logs_errors:boolean,panics_on_error:boolean,propagates_error:boolean,error_checks:int,error_types:array<string>>,"
    "api_flow:struct<is_http_handler:boolean,request_type:string,response_type:string,steps:array<struct<step:int,line:int,action:string,type:string,output:string>>,validations:array<string>,"
    "db_queries:array<struct<operation:string,method:string,table:string,raw_query:string,line:int>>,external_calls:array<struct<method:string,url:string,line:int>>>>"
)
TYPE = "struct<name:string,kind:string,description:string,is_public:boolean,line_start:int,line_end:int,fields:array<struct<name:string,type:string,tag:string,is_public:boolean>>,methods:array<string>>"
FILE = (
    "repo_id string, path string, language string, package string, purpose string, imports array<struct<alias:string,path:string>>, concepts array<string>, parse_error boolean, "
    f"functions array<{FUNCTION}>, types array<{TYPE}>, constants array<struct<name:string,type:string,value:string,is_public:boolean,line_start:int>>, exports array<struct<name:string,kind:string,signature:string>>, "
    "routes array<struct<method:string,path:string,handler:string,line:int,middleware:array<string>>>"
)


def camel(name: str) -> list[str]:
    """Words of a name, cut before each ASCII capital."""
    return [w for w in re.split(r"(?=[A-Z])", name) if w]


def describe_name(name: str) -> str:
    """What a plain function's name says it does."""
    low = name.lower()
    for prefix, verb in VERBS:
        if low.startswith(prefix):
            return "Initialize" if verb is None else f"{verb} {' '.join(camel(name[len(prefix) :])).lower()}"
    return f"Call {name}"


def describe_call(c: G.Call, aliases: dict[str, str]) -> str:
    """What a call does; empty for chained calls."""
    if c.chained:
        return ""
    if not c.recv:
        return describe_name(c.name)
    path = aliases.get(c.recv, "")
    key = "sql" if c.recv == "db" else c.recv
    if key not in STDLIB and ("database" in path or "sql" in path):
        key = "sql"
    if key in STDLIB:
        label, known = STDLIB[key]
        return known.get(c.name, f"{label}: {c.name}")
    for part, label in (("redis", "Redis"), ("kafka", "Kafka"), ("grpc", "gRPC")):
        if part in path:
            return f"{label}: {c.name}"
    return f"{c.recv}.{c.name}"


def _operands(cond: list[G.Tok]) -> tuple[list[G.Tok], str, list[G.Tok]] | None:
    """Sides of a condition's outermost binary operator: the last one of lowest precedence."""
    best, depth = None, 0
    level = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
    for i, t in enumerate(cond):
        if t.kind == "op":
            if depth == 0 and t.text in level and i and (cond[i - 1].kind != "op" or cond[i - 1].text in (")", "]", "}")) and (best is None or level[t.text] <= best[0]):
                best = (level[t.text], i)
            depth += (t.text in "([{") - (t.text in ")]}")
    return (cond[: best[1]], cond[best[1]].text, cond[best[1] + 1 :]) if best else None


def _condition(s: G.Stmt) -> list[G.Tok]:
    parts = G.split(s.head[1:], ";")
    return parts[-1] if parts else []


def _is_err(side: list[G.Tok], exact: bool) -> bool:
    if len(side) != 1 or side[0].kind != "id":
        return False
    low = side[0].text.lower()
    return side[0].text == "err" if exact else low.endswith(("err", "error"))


def error_check(s: G.Stmt, exact: bool = False) -> bool:
    o = _operands(_condition(s))
    return bool(o) and (_is_err(o[0], exact) or _is_err(o[2], exact))


def _nil_check(s: G.Stmt) -> bool:
    o = _operands(_condition(s))
    names = [x[0].text for x in (o[0], o[2]) if len(x) == 1 and x[0].kind == "id"] if o else []
    return len(names) == 2 and names.count("nil") == 1


def _assigned(s: G.Stmt) -> tuple[list[str], list[list[G.Tok]]]:
    """(plain names on the left, expressions on the right)."""
    depth = 0
    for i, t in enumerate(s.head):
        if t.kind == "op":
            if depth == 0 and t.text.endswith("=") and t.text not in ("==", "!=", "<=", ">="):
                left = [x[0].text for x in G.split(s.head[:i], ",") if len(x) == 1 and x[0].kind == "id"]
                return left, G.split(s.head[i + 1 :], ",")
            depth += (t.text in "([{") - (t.text in ")]}")
    return [], []


def steps(block: list[G.Stmt], aliases: dict[str, str]) -> list[str]:
    """Numbered behaviour steps of the statements at the top."""
    out: list[str] = []

    def add(text: str) -> None:
        if text:
            out.append(f"{len(out) + 1}. {text}")

    for s in block:
        if s.kind == "assign":
            add(next((a for e in _assigned(s)[1] if (c := G.sole_call(e)) and (a := describe_call(c, aliases))), ""))
        elif s.kind == "expr" and (c := G.sole_call(s.head)):
            add(describe_call(c, aliases))
        elif s.kind == "if" and not error_check(s, True) and _nil_check(s):
            add("Validate input is not nil")
        elif s.kind == "for":
            add("Loop iteration")
        elif s.kind == "range":
            at = next(i for i, t in enumerate(s.head) if t.text == "range")
            over = s.head[at + 1 :]
            add("Iterate over " + (over[0].text if len(over) == 1 and over[0].kind == "id" else "collection"))
        elif s.kind == "return" and len(s.head) > 1:
            add("Return result")
        elif s.kind in ("defer", "go") and (c := G.sole_call(s.head[1:])):
            d = describe_call(c, aliases)
            add(d and ("Defer: " if s.kind == "defer" else "Spawn goroutine: ") + d)
        elif s.kind == "switch":
            add("Switch on condition")
    return out


def summary(name: str, steps_: list[str]) -> str:
    """The first three steps without their numbers."""
    return ", then ".join(x.split(". ", 1)[1] for x in steps_[:3]) or describe_name(name)


def patterns(name: str, n_results: int, steps_: list[str]) -> list[str]:
    """Patterns that a name's beginning or end, or the words of the steps, tell."""
    n, text = name.lower(), " ".join(steps_).lower()
    rules = (
        ("create", n.startswith(("create", "add", "insert"))), ("read", n.startswith(("get", "find", "fetch", "read"))), ("update", n.startswith(("update", "modify", "edit"))), ("delete", n.startswith(("delete", "remove"))),
        ("handler", n.startswith("handle") or n.endswith("handler")), ("validation", n.startswith(("validate", "check", "is"))), ("factory", n.startswith(("new", "create")) and n_results > 0),
        ("builder", "build" in text), ("http-client", "http" in text), ("database", any(w in text for w in ("database", "query", "sql"))), ("async", "goroutine" in text),
    )
    return [p for p, ok in rules if ok]


def call_refs(f: G.Func, aliases: dict[str, str]) -> list[dict]:
    """Calls of a function, each callee and package once, in order."""
    marked: dict[tuple[int, int], str] = {}
    body = f.body or []
    for i, t in enumerate(body):
        if t.kind == "id" and t.text in ("go", "defer") and i + 1 < len(body):
            c = next((c for c in G.calls(body) if c.start == i + 1), None)
            if c:
                marked[c.start, c.paren] = t.text
    out: dict[tuple[str, str], dict] = {}
    for c in G.calls(body):
        path = aliases.get(c.recv)
        kind = "method" if c.chained or (c.recv and path is None) else "internal" if not c.recv else "external" if "." in path else "stdlib"
        out.setdefault((c.name, c.recv), {"function": c.name, "package": c.recv, "line": c.line, "type": marked.get((c.start, c.paren), kind)})
    return list(out.values())


def side_effects(f: G.Func, aliases: dict[str, str]) -> list[str]:
    """Distinct effects of a function's calls, sorted."""
    out = set()
    for c in G.calls(f.body or []):
        if c.chained:
            continue
        if not c.recv:
            out |= {"panic"} if c.name == "panic" else {"console_output"} if c.name in ("print", "println") else set()
            continue
        path = aliases.get(c.recv, "")
        e = next((e for e, names, parts, callees in EFFECTS if (c.recv in names or any(p in path for p in parts)) and (not callees or c.name in callees)), None)
        out |= {e} if e else set()
    return sorted(out)


def error_handling(f: G.Func) -> dict:
    """How a function deals with errors."""
    block = f.block
    every = list(G.walk(block))
    checks = [s for s in every if s.kind == "if" and error_check(s)]
    found = G.calls(f.body or [])
    wraps = any((c.recv == "fmt" and c.name == "Errorf" and c.args and c.args[0][0].kind in ("str", "raw") and "%w" in c.args[0][0].text) or (c.recv == "errors" and c.name in ("Wrap", "Wrapf")) for c in found)
    kinds: list[str] = []
    returned = False
    for s in checks:
        for r in G.walk(s.blocks[0] if s.blocks else []):
            if r.kind == "return":
                returned = True
                kinds += [k for e in G.split(r.head[1:], ",") if (k := _error_kind(e)) and k not in kinds]
    gives = "error" in f.returns
    return {
        "returns_error": gives, "wraps_errors": wraps, "logs_errors": any(c.recv in ("log", "logger", "zap", "logrus") for c in found),
        "panics_on_error": any(not c.recv and not c.chained and c.name == "panic" for c in found), "propagates_error": gives and bool(checks), "error_checks": len(checks), "error_types": kinds if returned else [],
    }


def _error_kind(e: list[G.Tok]) -> str:
    if len(e) == 1 and e[0].text == "err":
        return "propagated_error"
    if len(e) > 2 and e[0].text == "&" and e[1].kind == "id" and e[2].text == "{":
        return e[1].text
    c = G.sole_call(e)
    if c and not c.chained:
        if c.recv == "fmt" and c.name == "Errorf":
            return "formatted_error"
        if c.recv == "errors":
            return {"New": "simple_error", "Wrap": "wrapped_error", "Wrapf": "wrapped_error"}.get(c.name, "")
        if not c.recv and c.name.startswith("New") and "error" in c.name.lower():
            return c.name
    return ""


def input_usage(f: G.Func) -> dict[str, str]:
    """The first call in order that each parameter is passed to by itself."""
    out: dict[str, str] = {}
    names = {n for n, _ in f.params}
    for c in G.calls(f.body or []):
        for a in c.args:
            if len(a) == 1 and a[0].text in names and not c.chained:
                out.setdefault(a[0].text, "Passed to " + (f"{c.recv}.{c.name}" if c.recv else c.name))
    return out


def output_source(block: list[G.Stmt]) -> str:
    """Where the first result of the last return comes from."""
    out = ""
    for s in G.walk(block):
        if s.kind != "return" or len(s.head) < 2:
            continue
        e = G.split(s.head[1:], ",")[0]
        c = G.sole_call(e)
        if len(e) == 1 and e[0].kind == "id":
            out = f"Returns {e[0].text}"
        elif c and not c.chained:
            out = f"Returns result of {c.recv + '.' if c.recv else ''}{c.name}"
        elif len(e) > 1 and e[0].kind == "id" and e[1].text == "{":
            out = f"Returns new {e[0].text}"
    return out


def is_handler(params: list[tuple[str, str]]) -> bool:
    """Whether parameters are those of an HTTP handler."""
    ts = [t for _, t in params]
    return any(x in t for t in ts for x in ("gin.Context", "echo.Context", "fiber.Ctx")) or any("ResponseWriter" in a and "Request" in b for a, b in zip(ts, ts[1:]))


def _flow_kind(c: G.Call) -> str:
    p, m = c.recv.lower(), c.name.lower()
    if not c.recv:
        return "internal"
    rules = (("database", p == "db" or "repo" in p or "store" in p), ("http_client", p in ("http", "client")), ("serialization", p == "json"), ("logging", "log" in p), ("validation", "valid" in m), ("context", p in ("ctx", "c")))
    return next((k for k, ok in rules if ok), "internal")


def _flow_action(c: G.Call) -> str:
    p, m = c.recv.lower(), c.name.lower()
    if not c.recv and not c.chained:
        return f"Call {c.name}()"
    if p == "db" or "repo" in p or "store" in p:
        for starts, text in ((("find", "get"), "Query database: "), (("create", "insert"), "Insert into database: "), (("update",), "Update database: "), (("delete", "remove"), "Delete from database: ")):
            if m.startswith(starts):
                return text + c.name
        if m in ("query", "queryrow", "exec"):
            return "Execute SQL statement" if m == "exec" else "Execute SQL query"
    fixed = {
        **{("http", v): f"HTTP {v.upper()} request" for v in ("get", "post", "put", "delete")}, ("http", "do"): "Execute HTTP request", ("json", "marshal"): "Serialize to JSON", ("json", "unmarshal"): "Deserialize from JSON",
        ("json", "encode"): "Encode response as JSON", ("json", "decode"): "Decode JSON request body", ("ctx", "json"): "Send JSON response", ("ctx", "bind"): "Bind request body to struct", ("ctx", "shouldbind"): "Bind request body to struct",
        ("ctx", "param"): "Get URL parameter", ("ctx", "params"): "Get URL parameter", ("ctx", "query"): "Get query parameter", ("ctx", "set"): "Set context value", ("ctx", "get"): "Get context value",
    }
    group = "http" if p == "client" else "ctx" if p == "c" or "ctx" in p else p
    if (group, m) in fixed:
        return fixed[group, m]
    if "log" in p:
        return f"Log: {c.name}"
    return "Create/handle error" if "error" in m else f"{c.recv}.{c.name}()"


def _string(e: list[G.Tok]) -> str | None:
    return e[0].text.strip("\"'`") if len(e) == 1 and e[0].kind in ("str", "raw") else None


def sql_table_of(query: str) -> str:
    up = query.upper()
    m = next((m for p in (r"FROM\s+(\w+)", r"INSERT\s+INTO\s+(\w+)", r"UPDATE\s+(\w+)") if (m := re.search(p, up))), None)
    return m[1].lower() if m else ""


def db_query(c: G.Call) -> dict | None:
    """Query that a call on a database-like receiver makes; ``exec`` counts as an insert."""
    p, m = c.recv.lower(), c.name.lower()
    if not c.recv or not (p == "db" or any(x in p for x in ("repo", "store", "sql"))):
        return None
    op = "SELECT" if m in ("query", "queryrow", "select") or m.startswith(("find", "get")) else "INSERT" if m in ("exec", "insert") or m.startswith("create") else "UPDATE" if m.startswith("update") else "DELETE" if m.startswith(("delete", "remove")) else "UNKNOWN"
    raw = next((s for a in c.args if (s := _string(a)) is not None), "")
    return {"operation": op, "method": c.name, "table": sql_table_of(raw), "raw_query": raw, "line": c.line}


def external_call(c: G.Call) -> dict | None:
    """HTTP request that a call on a client makes."""
    p, m = c.recv.lower(), c.name.lower()
    if not c.recv or not (p == "http" or "client" in p) or m not in ("get", "post", "put", "delete", "patch", "do"):
        return None
    return {"method": m.upper(), "url": next((s for a in c.args if (s := _string(a)) is not None), ""), "line": c.line}


def validation(s: G.Stmt) -> str:
    """The last check of its kind in a condition."""
    cond, out = _condition(s), ""
    for i, (a, op, b) in enumerate(zip(cond, cond[1:], cond[2:])):
        if op.text in ("==", "!=") and a.kind == "id" and (i == 0 or cond[i - 1].text != ".") and b.text in ('""', "0"):
            out = f"Validate {a.text} is not empty" if b.text == '""' else f"Validate {a.text} is not zero"
    for c in G.calls(cond):
        if (c.recv or c.chained) and "valid" in c.name.lower():
            out = f"Run validation: {c.name}"
    return out


def api_flow(f: G.Func) -> dict:
    """Steps, validations, queries and requests of a function, and what a handler takes and gives."""
    flow, checks = [], []
    request = response = ""
    for s in G.walk(f.block):
        got: tuple | None = None
        if s.kind == "assign":
            names, right = _assigned(s)
            for e in right:
                if c := G.sole_call(e):
                    got = (_flow_action(c), _flow_kind(c), ", ".join(names))
                    break
                if len(e) > 1 and e[0].kind == "id" and e[1].text == "{":
                    got = (f"Create {e[0].text} struct", "struct_creation", "")
                    if any(x in e[0].text.lower() for x in ("req", "input")):
                        request = e[0].text
                    break
        elif s.kind == "expr" and (c := G.sole_call(s.head)):
            got = (_flow_action(c), _flow_kind(c), "")
        elif s.kind == "if" and (v := validation(s)):
            checks.append(v)
        if got:
            flow.append({"step": len(flow) + 1, "line": s.line, "action": got[0], "type": got[1], "output": got[2]})
    handler, found = is_handler(f.params), G.calls(f.body or [])
    for c in found:
        if c.name in ("Decode", "Bind", "ShouldBind", "ShouldBindJSON", "BindJSON", "ReadJSON") and c.args and len(c.args[0]) == 2 and c.args[0][0].text == "&":
            request = c.args[0][1].text
        if c.name in ("Encode", "JSON", "WriteJSON", "SendJSON") and (c.recv or c.chained):
            for a in c.args:
                response = a[0].text if a[0].kind == "id" and (len(a) == 1 or a[1].text == "{") else f"{x.name}()" if (x := G.sole_call(a)) and x.recv else response
    return {
        "is_http_handler": handler, "request_type": request if handler else "", "response_type": response if handler else "", "steps": flow, "validations": checks,
        "db_queries": [q for c in found if (q := db_query(c))], "external_calls": [q for c in found if (q := external_call(c))],
    }


def _argument(e: list[G.Tok]) -> str:
    """Text of a route argument: a literal, a variable as ``${name}``, or their concatenation; empty if unknown."""
    parts = G.split(e, "+")
    texts = [s if (s := _string(p)) is not None else "${%s}" % p[0].text if len(p) == 1 and p[0].kind == "id" else "" for p in parts]
    return "".join(texts) if texts and all(texts) else ""


def _handler(e: list[G.Tok]) -> str:
    """Name of a handler argument; of a wrapped one, the wrapper."""
    if e and e[0].text == "func":
        return "<anonymous>"
    if c := G.sole_call(e):
        return f"{c.recv}.{c.name}" if c.recv else c.name
    names = [t.text for t in e if t.kind == "id"]
    return ".".join(names[-2:]) if names and all(t.kind == "id" or t.text == "." for t in e) else ""


def routes(src_calls: list[G.Call]) -> list[dict]:
    """Routes that calls register: verbs as method names in any letter case, ``HandleFunc`` and ``Handle``."""
    out = []
    for c in src_calls:
        verb = c.name.upper()
        known = verb in HTTP_VERBS
        if not (c.recv or c.chained) or len(c.args) < 2 or not (known or c.name in ("HandleFunc", "Handle")):
            continue
        path = _argument(c.args[0])
        if path:
            out.append({"method": verb if known else "ANY", "path": path, "handler": _handler(c.args[-1] if known else c.args[1]), "line": c.line, "middleware": [h for a in c.args[1:-1] if (h := _handler(a))] if known else []})
    return out


def signature(f: G.Func) -> str:
    r = f.returns
    tail = "" if not r else f" {r[0]}" if len(r) == 1 else f" ({', '.join(r)})"
    return (f"({f.receiver}) " if f.receiver else "") + f"{f.name}({', '.join(f'{n} {t}' for n, t in f.params)}){tail}"


def complexity(f: G.Func) -> int:
    """One, plus branches, loops, switches, their clauses and logical operators."""
    return 1 + sum((t.kind == "id" and t.text in ("if", "for", "switch", "select", "case", "default")) or (t.kind == "op" and t.text in ("&&", "||")) for t in f.body or [])


def purpose_of(f: G.File) -> str:
    """First sentence or line of the package comment, at most 200 characters; without one the package's name."""
    t = f.doc
    if not t:
        return f"Package {f.package}"
    dot, nl = t.find("."), t.find("\n")
    return t[: dot + 1] if 0 < dot < 200 else t[:nl] if nl > 0 else t[:200] + "..." if len(t) > 200 else t


def go_file(src: str) -> dict:
    """All records of one source text; raises :class:`lodestone.sources.golang.ParseError`."""
    f = G.parse(src)
    aliases, funcs, found = f.aliases, [], []
    for fn in f.funcs:
        block = fn.block
        st = steps(block, aliases)
        body = fn.body or []
        used = {aliases[a.text] for i, (a, dot) in enumerate(zip(body, body[1:])) if a.kind == "id" and dot.text == "." and a.text in aliases and (i == 0 or body[i - 1].text != ".")}
        found += G.calls(body)
        funcs.append(
            {
                "name": fn.name, "receiver": fn.receiver, "signature": signature(fn), "description": fn.doc, "is_public": G.is_exported(fn.name), "line_start": fn.line_start, "line_end": fn.line_end, "complexity": complexity(fn),
                "parameters": [{"name": n, "type": t} for n, t in fn.params], "returns": fn.returns, "uses_imports": sorted(used), "calls": call_refs(fn, aliases), "side_effects": side_effects(fn, aliases),
                "behavior": {"summary": summary(fn.name, st), "steps": st, "patterns": patterns(fn.name, fn.n_results, st), "input_usage": input_usage(fn), "output_source": output_source(block)},
                "error_handling": error_handling(fn), "api_flow": api_flow(fn),
            }
        )
    concepts = {t["name"].lower() for t in f.types} | {w.lower() for fn in f.funcs for w in camel(fn.name) if len(w) > 2}
    exports = f.exports + [{"name": t["name"], "kind": "type", "signature": t["kind"]} for t in f.types if t["is_public"]] + [{"name": x["name"], "kind": "function", "signature": x["signature"]} for x in funcs if x["is_public"]]
    return {"package": f.package, "purpose": purpose_of(f), "imports": [{"alias": a, "path": p} for a, p in f.imports], "concepts": sorted(concepts), "parse_error": False, "functions": funcs, "types": f.types, "constants": f.consts, "exports": exports, "routes": routes(found)}


#: Analysers by language; others get a record told by the path.
ANALYZERS = {"go": go_file}
_EMPTY = {"package": "", "imports": [], "concepts": [], "parse_error": False, "functions": [], "types": [], "constants": [], "exports": [], "routes": []}


def _extract(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for repo, path, lang, why, content in zip(*(b.column(c).to_pylist() for c in ("repo_id", "path", "language", "purpose", "content"))):
            base = {"repo_id": repo, "path": path, "language": lang, "purpose": why, **_EMPTY}
            text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
            if lang in ANALYZERS and isinstance(text, str):
                try:
                    base |= ANALYZERS[lang](text)
                except (G.ParseError, RecursionError):
                    base |= {"purpose": "parse error", "parse_error": True}
            for f in base["functions"]:
                f["behavior"]["input_usage"] = list(f["behavior"]["input_usage"].items())
            if not base["concepts"]:
                base["concepts"] = [p.lower() for p in (path or "").split("/") if len(p) > 2]
            rows.append(base)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def extract(files: DataFrame) -> DataFrame:
    """Records of source files (repo_id, path, content): one row a file with nested functions, types, routes and so on.

    Null contents give a record told by the path. No shuffle.
    """
    lang = language(F.col("path"))
    ready = files.select("repo_id", "path", lang.alias("language"), purpose(F.col("path"), lang).alias("purpose"), "content")
    schema = to_arrow_schema(T.StructType.fromDDL(FILE))
    return ready.mapInArrow(lambda batches: _extract(batches, schema), FILE)


def functions(extracted: DataFrame) -> DataFrame:
    return extracted.select("repo_id", "path", "package", F.explode("functions").alias("f")).select("repo_id", "path", "package", "f.*")


def types(extracted: DataFrame) -> DataFrame:
    return extracted.select("repo_id", "path", F.explode("types").alias("t")).select("repo_id", "path", "t.*")


def call_table(extracted: DataFrame) -> DataFrame:
    """Call references in the columns of the call operators."""
    c = functions(extracted).select("repo_id", F.col("path").alias("caller_path"), F.col("name").alias("caller"), F.explode("calls").alias("c"))
    return c.select("repo_id", "caller_path", "caller", F.col("c.function").alias("callee"), F.col("c.package").alias("callee_package"), F.lit(None).cast("string").alias("callee_file"), F.col("c.line").alias("line"), F.col("c.type").alias("call_type"))


def route_table(extracted: DataFrame) -> DataFrame:
    return extracted.select("repo_id", "path", F.explode("routes").alias("r")).select("repo_id", "path", F.col("r.method").alias("method"), F.col("r.path").alias("route"), F.col("r.handler").alias("handler"), F.col("r.line").alias("line"), F.col("r.middleware").alias("middleware"))


def _tag(tag: Column, key: str) -> Column:
    return F.regexp_extract(tag, key + ':"([^"]*)"', 1)


def struct_details(type_rows: DataFrame) -> DataFrame:
    """Structs with JSON and column names, validation and whether required, per field, and a category by name and tags."""
    detail = F.transform(
        "fields",
        lambda f: F.struct(
            f["name"].alias("name"), f["type"].alias("type"), F.regexp_replace(F.regexp_extract(_tag(f["tag"], "json"), "^([^,]*)", 1), "^-$", "").alias("json_name"), F.regexp_replace(F.regexp_extract(_tag(f["tag"], "db"), "^([^,]*)", 1), "^-$", "").alias("db_column"),
            _tag(f["tag"], "validate").alias("validation"), ((f["tag"] != "") & (~F.contains(_tag(f["tag"], "json"), F.lit("omitempty")) | F.contains(_tag(f["tag"], "validate"), F.lit("required")))).alias("required"), f["is_public"].alias("is_exported"),
        ),
    )
    n = F.lower("name")
    category = (
        F.when(n.rlike("(request|req)$"), "request").when(n.rlike("(response|resp)$"), "response").when(n.endswith("input"), "input").when(n.endswith("output"), "output")
        .when(F.exists("details", lambda d: d["db_column"] != "") | n.rlike("(model|entity)$"), "model").when(n.rlike("config|options|settings"), "config").when(n.endswith("dto"), "dto").otherwise("struct")
    )
    return type_rows.where("kind = 'struct'").withColumn("details", detail).select("repo_id", "path", "name", "details", category.alias("category"))

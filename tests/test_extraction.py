"""The Go parser and what is extracted from its results."""

import pytest

from lodestone.operators import extraction as E
from lodestone.sources import golang as G

SRC = '''// Package users serves users. More.
package users

import (
	"context"
	db "database/sql"
	"fmt"
)

// CreateUserRequest is a payload.
type CreateUserRequest struct {
	ID, Age int `json:"id,omitempty" db:"id" validate:"required"`
	*Base
	Tags map[string][]string `json:"-"`
}

type Store interface {
	Get(ctx context.Context, id string) (*User, error)
	io.Closer
}

type Alias = map[string]int

const (
	MaxAge, min = 10, "x"
)

var Registry = map[string]func(int) error{"a": func(i int) error { return nil }}

// GetUser loads.
func (s *Svc) GetUser(ctx context.Context, a, b string, ids ...int) (*User, error) {
	if len(ids) == 0 && ctx != nil || a == "" {
		return nil, fmt.Errorf("no: %w", err)
	}
	rows, err := s.db.Query(ctx, "SELECT * FROM users").Scan(&x)
	if err != nil {
		log.Printf("bad")
		return nil, err
	} else if x {
		panic("no")
	}
	if b == nil {
		b = "z"
	}
	for i, r := range rows {
		switch v := r.(type) {
		case int:
			go work(func() { db.Exec("INSERT INTO t VALUES (1)", []byte(v)) })
		default:
		}
	}
	for i := 0; i < 3; i++ {
		validate(b)
	}
	select {
	case <-ctx.Done():
	}
	defer rows.Close()
	client.Get("https://x/y")
	return &User{ID: 1}, nil
}

func routes(r *gin.Engine, base string) {
	r.GET(base+"/users/:id", auth, h.List)
	http.HandleFunc("/x", func(w http.ResponseWriter, r *http.Request) {})
	r.Group("/g")
	app.Post("/y", wrap(handler))
}
'''


@pytest.fixture(scope="module")
def rec():
    return E.go_file(SRC)


def test_declarations(rec):
    assert (rec["package"], rec["purpose"]) == ("users", "Package users serves users.")
    t = {x["name"]: x for x in rec["types"]}
    assert [(f["name"], f["type"], f["is_public"]) for f in t["CreateUserRequest"]["fields"]] == [("ID", "int", True), ("Age", "int", True), ("*Base", "*Base", False), ("Tags", "map[string][]string", True)]
    assert t["CreateUserRequest"]["description"] == "CreateUserRequest is a payload." and t["Store"]["methods"] == ["Get"] and t["Alias"]["kind"] == "alias"
    assert [(c["name"], c["value"], c["is_public"]) for c in rec["constants"]] == [("MaxAge", "10", True), ("min", '"x"', False)]
    assert {(e["name"], e["kind"]) for e in rec["exports"]} == {("MaxAge", "const"), ("Registry", "var"), ("CreateUserRequest", "type"), ("Store", "type"), ("Alias", "type"), ("GetUser", "function")}
    assert {"createuserrequest", "store", "alias", "get", "user", "routes"} == set(rec["concepts"])


def test_function(rec):
    f = rec["functions"][0]
    assert f["signature"] == "(*Svc) GetUser(ctx context.Context, a string, b string, ids ...int) (*User, error)" and f["description"] == "GetUser loads."
    assert f["complexity"] == 1 + 4 + 2 + 2 + 1 + 2 + 2  # ifs, loops, type switch and select with clauses, logical operators
    assert f["uses_imports"] == ["context", "database/sql", "fmt"] or f["uses_imports"] == ["database/sql", "fmt"]
    c = {(x["function"], x["package"]): x["type"] for x in f["calls"]}
    assert c["Errorf", "fmt"] == "stdlib" and c["len", ""] == "internal" and c["Query", ""] == "method" and c["work", ""] == "go" and c["Close", "rows"] == "defer" and c["Exec", "db"] == "stdlib" and ("byte", "") not in c
    assert f["side_effects"] == ["db_query", "logging", "panic"]
    e = f["error_handling"]
    assert (e["returns_error"], e["wraps_errors"], e["logs_errors"], e["panics_on_error"], e["propagates_error"], e["error_checks"], e["error_types"]) == (True, True, True, True, True, 1, ["propagated_error"])
    assert f["behavior"]["steps"] == ["1. Validate input is not nil", "2. Iterate over rows", "3. Loop iteration", "4. Defer: rows.Close", "5. client.Get", "6. Return result"]
    assert f["behavior"]["summary"] == "Validate input is not nil, then Iterate over rows, then Loop iteration" and f["behavior"]["patterns"] == ["read"]
    a = f["api_flow"]
    assert a["db_queries"] == [{"operation": "INSERT", "method": "Exec", "table": "t", "raw_query": "INSERT INTO t VALUES (1)", "line": a["db_queries"][0]["line"]}]
    assert a["external_calls"][0]["method"] == "GET" and a["external_calls"][0]["url"] == "https://x/y" and "Validate a is not empty" in a["validations"] and not a["is_http_handler"]


def test_routes(rec):
    assert [(r["method"], r["path"], r["handler"], r["middleware"]) for r in rec["routes"]] == [("GET", "${base}/users/:id", "h.List", ["auth"]), ("ANY", "/x", "<anonymous>", []), ("POST", "/y", "wrap", [])]


@pytest.mark.parametrize("name,want", [("getUserName", "Get user name"), ("InitAll", "Initialize"), ("newThing", "Create new thing"), ("isReady", "Check if ready"), ("run", "Call run")])
def test_name_descriptions(name, want):
    assert E.describe_name(name) == want


def test_handlers():
    f = G.parse("package p\nfunc H(w http.ResponseWriter, r *http.Request) {\n\tvar q Req\n\tjson.NewDecoder(r.Body).Decode(&q)\n\tc.JSON(200, Resp{A: 1})\n}\nfunc G(c *gin.Context) {}\nfunc N(a int) {}").funcs
    flow = E.api_flow(f[0])
    assert (flow["is_http_handler"], flow["request_type"], flow["response_type"]) == (True, "q", "Resp")
    assert E.is_handler(f[1].params) and not E.is_handler(f[2].params)


@pytest.mark.parametrize("src", ["", "not go", "package", "package p\nfunc (", "package p\nfunc f() {", "package p\n}{", "package p\nx y z", "package p\nconst\n", "package p\nfunc f() { \"unclosed }"])
def test_broken_sources(src):
    with pytest.raises(G.ParseError):
        G.parse(src)


def test_frame(spark):
    data = [("r", "a/u.go", bytearray(SRC.encode())), ("r", "b.go", bytearray(b"broken")), ("r", "README.md", bytearray(b"# x")), ("r", "n.go", None), (None, "e.go", bytearray(b"\xff\xfe"))]
    e = E.extract(spark.createDataFrame(data, "repo_id string, path string, content binary")).cache()
    got = {r["path"]: r for r in e.collect()}
    assert got["b.go"]["parse_error"] and got["b.go"]["purpose"] == "parse error" and got["README.md"]["purpose"] == "Project documentation" and got["n.go"]["functions"] == []
    assert E.functions(e).count() == 2 and E.call_table(e).where("callee = 'work'").first()["call_type"] == "go" and E.route_table(e).count() == 3
    d = E.struct_details(E.types(e)).first()
    assert d["category"] == "request" and [(x["name"], x["json_name"], x["db_column"], x["required"]) for x in d["details"]][:1] == [("ID", "id", "id", True)] and d["details"][3]["json_name"] == ""
    assert E.extract(spark.createDataFrame([], "repo_id string, path string, content binary")).count() == 0

"""Behaviour of the reference operators on small hand-made tables: edges, nulls, ties, empties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import changes, compare, embedding, graph, impact, org, rank, router, search
from lodestone.operators import usage as U
from lodestone.plans import compose
from lodestone.sources import files as S


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")


# --- vectors ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a,b,want", [((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((1, 2, 3), (1, 2), 0), ((), (), 0), ((0, 0), (1, 1), 0), ((1, 1), (2, 2), 1)])
def test_cosine(spark, a, b, want):
    assert one(spark, V.cosine(arr(*a), arr(*b))) == pytest.approx(want)


def test_vector_rules(spark):
    assert one(spark, V.euclidean(arr(0, 0), arr(3, 4))) == 5 and one(spark, V.euclidean(arr(1), arr(1, 2))) > 1e308
    assert one(spark, V.dot(arr(1, 2), arr(3, 4))) == 11 and one(spark, V.dot(arr(1), arr(1, 2))) == 0
    assert one(spark, V.normalize(arr(3, 4))) == [0.6, 0.8] and one(spark, V.normalize(arr(0, 0))) == [0, 0]
    assert one(spark, V.add(arr(1, 2), arr(3, 4))) == [4, 6] and one(spark, V.add(arr(1), arr(1, 2))) is None
    assert one(spark, V.scale(arr(1, 2), 2)) == [2, 4]


def test_mean_divides_by_all(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([3.0, 5.0],), ([9.0],), (None,)], "v array<double>")
    assert rows(embedding.mean_vector(df, "v", 2)) == [(0, 1.0), (1, 2.0)]


def test_search_order_ties_and_blocks(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, [1.0]), (7, []), (8, None), (9, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 2.0]), (12, None), (13, [0.0, 0.0]), (14, [1.0, 1.0, 1.0])], "query_id long, query array<double>")
    for block in (1, 100):
        got = {(r["query_id"], r["rank"]): (r["key"], round(r["similarity"], 4)) for r in embedding.search(df, "id", "v", q, 2, block).collect()}
        assert got == {(10, 1): (1, 1.0), (10, 2): (3, 1.0), (11, 1): (4, 1.0), (11, 2): (2, 0.7071)}
    assert embedding.search(df.limit(0), "id", "v", q, 2).count() == 0 and embedding.search(df, "id", "v", q.limit(0), 2).count() == 0


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "getUserName user"), (2, "get_user_name"), (3, ""), (4, None), (5, "the of a"), (6, "zebra")], "id long, t string")
    vocab = embedding.vocabulary(docs.where("id < 6"), "t", 10, 16)
    v = {r["key"]: r["vector"] for r in embedding.embed(docs, "id", "t", vocab, 16).collect()}
    assert all(len(x) == 16 for x in v.values())
    norm = lambda x: math.sqrt(sum(a * a for a in x))
    assert [round(norm(v[i]), 4) for i in range(1, 7)] == [1, 1, 0, 0, 0, 1]  # unknown words are hashed
    assert sum(a * b for a, b in zip(v[1], v[2])) >= 0.5
    assert embedding.vocabulary(docs, "t", 2).count() == 2


def test_polynomial_hash(spark):
    df = spark.createDataFrame([("ab",), ("é",), ("x" * 40,), (None,)], "w string")
    got = [r[0] for r in df.select(X.polynomial_hash("w")).collect()]
    assert got[0] == (ord("a") + 0) * 31 + ord("b") + 1 and got[1] == 0xE9 and got[2] is not None and got[3] is None


# --- text ---------------------------------------------------------------------------------------------------------------


def test_keywords(spark):
    assert one(spark, X.search_keywords(F.lit("Find the (User) handler, a b!"))) == ["find", "user", "handler"]
    assert one(spark, X.search_keywords(F.lit("the a"))) == ["the", "a"]
    assert one(spark, X.search_keywords(F.lit(""))) == []
    assert one(spark, X.ask_keywords(F.lit("How does the login go?"))) == ["login"]
    k = F.array(F.lit("us"), F.lit("na"))
    assert one(spark, X.matches_all(F.lit("UserName"), k)) and not one(spark, X.matches_all(F.lit("User"), k))
    assert not one(spark, X.matches_all(F.lit("x"), F.array().cast("array<string>"))) and not one(spark, X.matches_all(F.lit(None).cast("string"), k))


def test_tokens_names_paths(spark):
    assert one(spark, X.code_tokens(F.lit("getUser_name::parse the HTTPServer.go x"))) == ["get", "user", "name", "parse", "httpserver", "go"]
    assert one(spark, X.token_estimate(F.lit("é" * 4))) == 2 and one(spark, X.token_estimate(F.lit(None).cast("string"))) == 0 and one(spark, X.token_estimate(F.lit("abcd"), -1)) == 1
    assert [one(spark, X.dirname(F.lit(p))) for p in ("a/b/c.go", "c.go", "/c.go")] == ["a/b", "", ""]
    assert one(spark, X.base_type(F.lit("[]*pkg.User"))) == "User" and one(spark, X.base_type(F.lit("map[string][]*x.Y"))) == "Y" and one(spark, X.base_type(F.lit("...int"))) == "int"
    assert one(spark, X.repo_id_of_url(F.lit("git@host.io:a/b.git"))) == "host.io/a/b" and one(spark, X.repo_id_of_url(F.lit("https://h/a/b"))) == "h/a/b"
    assert one(spark, X.clean_type_for_index(F.lit("*[]User"))) == "user" and one(spark, X.clean_type_for_index(F.lit("map[string]int"))) == "string]int"
    assert one(spark, X.sql_table(F.lit("insert into Users (a)"))) == "users" and one(spark, X.sql_table(F.lit("nothing"))) is None
    assert one(spark, X.ellipsis(F.lit("x" * 101), 100)) == "x" * 97 + "..." and one(spark, X.dot_text(F.lit('a"\\b'))) == 'a\\"\\\\b'
    r = one(spark, X.doc_routes(F.lit("@Router /a/{id} [get]\n@Router /b [post]")))
    assert [(x["path"], x["method"]) for x in r] == [("/a/{id}", "GET"), ("/b", "POST")]


# --- sources ------------------------------------------------------------------------------------------------------------


def test_scan(spark, tmp_path):
    for p, text in {"src/a.go": "package a\n", "src/vendor/b.go": "x", ".git/config": "x", ".github/w.yml": "x", "Makefile": "all:", "big.txt": "x" * 3000, "docs/c.md": "# hi\n\n", "logs/run.py": "x"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = {r["path"]: (r["language"], r["hash"][:4]) for r in S.scan(spark, str(tmp_path), ["**/vendor", "*.md"], 2000, hidden=[".github"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {"src/a.go": "go", ".github/w.yml": "yaml", "Makefile": "makefile", "logs/run.py": "python"}
    assert {r["path"] for r in S.scan_local(spark, str(tmp_path)).collect()} == {"src/a.go"}
    assert "docs/c.md" in {r["path"] for r in S.scan_local(spark, str(tmp_path), include_all=True).collect()}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("r1", 1), ("r2", 2)], "repo_id string, v int")
    S.replace_partitions(a, str(tmp_path / "t"))
    S.replace_partitions(spark.createDataFrame([("r2", 9)], "repo_id string, v int"), str(tmp_path / "t"))
    assert {(r["repo_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("r1", 1), ("r2", 9)}
    up = S.upsert(a, spark.createDataFrame([("r2", 5), ("r2", 7), ("r3", 1)], a.schema), ["repo_id"])
    assert rows(up) == [("r1", 1), ("r2", 7), ("r3", 1)]
    assert rows(S.without(a, a.where("v = 1"), ["repo_id"])) == [("r2", 2)]
    S.write_documents(a, str(tmp_path / "j"))
    assert S.read_documents(spark, str(tmp_path / "j"), a.schema).count() == 2


def test_split_diff(spark):
    diff = "diff --git a/x.go b/x.go\nnew file mode 100644\n@@\n+a\ndiff --git a/old.go b/new.go\r\nrename from old.go\n@@\n-b\n"
    df = S.split_diff(spark.createDataFrame([(1, diff), (2, None), (3, "no header"), (4, "")], "id long, d string"), "id", "d")
    assert [(r["position"], r["old_path"], r["file_path"]) for r in df.orderBy("position").collect()] == [(0, "x.go", "x.go"), (1, "old.go", "new.go")]
    assert [r[0] for r in df.orderBy("position").select(S.patch_status(F.col("patch"))).collect()] == ["added", "renamed"]


# --- usage, changes, organisations --------------------------------------------------------------------------------------

_U = "id long, tool string, input_tokens int, output_tokens int, duration_ms long, success boolean, timestamp timestamp"


def test_usage(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, "a", 100, 1000, 10, True, t), (2, "a", 150, 500, 30, True, t + dt.timedelta(days=2)), (3, "b", 40, 100, 5, False, t), (4, "c", None, None, None, True, None)], _U)
    assert rows(U.totals(df)) == [(4, 290, 1600)] and rows(U.totals(df.limit(0))) == [(0, 0, 0)]
    a = U.per_tool(df).where("tool = 'a'").first()
    assert (a["calls"], a["successes"], a["failures"], a["avg_input_tokens"], a["min_ms"], a["max_ms"]) == (2, 2, 0, 125.0, 10, 30)
    assert one(spark, U.success_rate(F.lit(0), F.lit(0))) == 0 and one(spark, U.success_rate(F.lit(1), F.lit(4))) == 25
    assert [r["id"] for r in U.recent(df, 2).collect()] == [2, 3] and U.recent(df, 5000).count() == 4
    cut = F.lit(t + dt.timedelta(days=1))
    assert U.expired(df, cut).first()[0] == 2 and U.retained(df, cut).count() == 1 and U.since(df, cut).count() == 1
    assert U.with_default_time(df, cut).where("timestamp is null").count() == 0


def test_changes(spark):
    cur = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "2"), ("r", "new", "3")], "repo_id string, file_path string, hash string")
    old = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "1"), ("r", "gone", "1")], cur.schema)
    assert {(r["file_path"], r["status"]) for r in changes.file_changes(cur, old).collect()} == {("same", "unchanged"), ("mod", "modified"), ("new", "new"), ("gone", "deleted")}
    assert rows(changes.change_counts(cur, old)) == [("r", 3, 1, 1, 1, 1)]
    assert {r["file_path"] for r in changes.changed(cur, old).collect()} == {"mod", "new"} and changes.changed(cur.limit(0), old).count() == 0
    assert changes.cleanup(old, cur.limit(0)).count() == 0 and {r["file_path"] for r in changes.cleanup(old, cur).collect()} == {"same", "mod"}
    table = spark.createDataFrame([("r", "same", "f"), ("r", "mod", "old"), ("r", "gone", "old")], "repo_id string, file_path string, name string")
    fresh = spark.createDataFrame([("r", "mod", "new1"), ("r", "new", "new2"), ("r", "same", "ignored")], table.schema)
    assert {(r["file_path"], r["name"]) for r in changes.refresh(table, fresh, changes.file_changes(cur, old)).collect()} == {("same", "f"), ("mod", "new1"), ("new", "new2")}


def test_orgs(spark, tmp_path):
    orgs = spark.createDataFrame([("o1", ["a", "b"], 100), ("o2", None, 50)], "id string, exclude_patterns array<string>, max_file_size long")
    m = spark.createDataFrame([("o1", "r1"), ("o1", "r2")], "org_id string, repo_id string")
    assert rows(org.listing(orgs, m)) == [("o1", 2), ("o2", 0)]
    assert org.add(m, m).count() == 2 and org.remove(m, m.limit(1)).count() == 1
    assert rows(org.register(m, spark.createDataFrame([("o1", "r9"), ("o1", "r9"), ("", "x")], m.schema))) == [("o1", "r9")]
    o = spark.createDataFrame([("o1", "r1", (["b", "c"], 0)), ("o1", "r2", (None, 7)), ("o2", "r3", None)], "org_id string, repo_id string, override struct<exclude_patterns:array<string>,max_file_size:long>")
    assert {(r[1], tuple(r[2]), r[3]) for r in org.effective(orgs, o).collect()} == {("r1", ("a", "b", "c"), 100), ("r2", ("a", "b"), 7), ("r3", (), 50)}
    (tmp_path / "o.json").write_text('{"x": {"repo_ids": ["a", "b", "a"]}, "y": {"repo_ids": []}}')
    a, b = org.import_json(spark, str(tmp_path / "o.json"))
    assert rows(a) == [("x",), ("y",)] and rows(b) == [("x", "a"), ("x", "b")]


# --- comparison ---------------------------------------------------------------------------------------------------------

_F = "repo_id string, path string, name string, signature string, line_start int"


def test_comparison(spark):
    f = spark.createDataFrame([("t", "a", "Same", "s", 1), ("t", "a", "Diff", "d error", 2), ("s1", "a", "Same", "s", 1), ("s1", "b", "Diff", "d", 1), ("s1", "b", "Miss", "m", 3), ("s2", "b", "Miss", "m", 3), ("s2", "c", "Only", None, 3)], _F)
    assert {(r["name"], r["n_repos"]) for r in compare.duplicates(f).collect()} == {("Same", 2), ("Diff", 2), ("Miss", 2)} and compare.duplicate_instances(f).count() == 6
    c = compare.conflicts(f, "t").collect()
    assert [(r["name"], r["repo_id"], r["severity"]) for r in c] == [("Diff", "s1", "high")]
    assert {(r["name"], r["n_sources"], r["priority"]) for r in compare.gaps(f, "t").collect()} == {("Miss", 2, "medium"), ("Only", 1, "low")}
    x = spark.createDataFrame([("t", "d/a", "1"), ("s1", "d/a", "1"), ("s1", "e/b", "1"), ("s2", "e/b", None), ("s2", "z", "1")], "repo_id string, path string, hash string")
    assert rows(compare.unified_stats(x)) == [(5, 1, 2, 3)] and rows(compare.file_overlap(x)) == [("d/a", 2, True), ("e/b", 2, False)]
    assert compare.structure_consistency(x).first()["issues"] == 2
    n = compare.naming_consistency(f.unionByName(f.withColumn("name", F.concat("name", F.lit("_x"))))).first()
    assert (n["mix"], n["score"]) == (0.5, 0.8) and compare.naming_consistency(f.limit(0)).first()["score"] == 1.0
    m = spark.createDataFrame([(9, 0, 1, 0.9, 0)], "duplicates long, high_conflicts long, high_gaps long, overall double, differing_files long")
    assert compare.recommendations(m).count() == 2 and compare.recommendations(m.select(*[F.lit(0).alias(c) if c != "overall" else F.lit(1.0).alias(c) for c in m.columns])).count() == 1


# --- graph, search, ranking ---------------------------------------------------------------------------------------------


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "a"), ("d", None)], "from_id string, to_id string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.bfs(e, start, 2)) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)] and graph.bfs(e, start, 99).count() == 4 and graph.bfs(e, start, 0).count() == 2
    assert {(r[0], r[1]) for r in graph.neighbourhood(e, "a", 1).collect()} == {("a", "b"), ("x", "a"), ("c", "a")}
    assert {(r["node"], r["level"], r["parent"]) for r in graph.call_tree(e, "a", 2).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 2, "b")}
    assert graph.mermaid(e.where("to_id = 'd'")).first()[0].endswith('["d"]')
    f = spark.createDataFrame([("r", "p1", "f"), ("r", "p2", "f"), ("r", "p3", "g"), ("q", "p1", "f")], "repo_id string, path string, name string")
    c = spark.createDataFrame([("r", "p3", "g", "f", None, None, 3, None), ("r", "p3", "g", "f", "fmt", None, 4, "stdlib"), ("r", "p3", "g", "zz", None, None, 5, "internal")], "repo_id string, caller_path string, caller string, callee string, callee_package string, callee_file string, line int, call_type string")
    assert {(r["to_id"], r["call_type"]) for r in graph.resolve_calls(c, f).collect()} == {("p1:f", "direct"), ("p2:f", "direct")} and graph.resolve_calls(c, f, "first").count() == 1
    assert graph.callers(c, "f").count() == 1 and graph.callers(c, "f", distinct=False).count() == 2
    assert {(r["path"], r["n_callers"]) for r in graph.called_by(c, f).where("repo_id = 'r'").collect()} == {("p1", 1), ("p2", 1), ("p3", 0)}


def test_search(spark):
    f = spark.createDataFrame([("r", "h/u.go", "GetUser", "func GetUser()", "loads", 1), ("r", "h/u.go", "user", None, None, 2), ("r", "m/x.go", "Run", "(u User)", None, 3)], "repo_id string, path string, name string, signature string, description string, line_start int")
    assert [r["name"] for r in search.like_functions(f, "user").collect()] == ["user", "GetUser", "Run"] and search.like_functions(f, "g_t").count() == 1
    i = search.build_index(f)
    assert rows(i.where("term = 'user'").select("kind", "name").distinct()) == [("name", "GetUser"), ("name", "user")] and search.lookup(i, "concept", "CRUD").count() == 1
    assert [r["name"] for r in search.lookup_functions(i, "USER").collect()] == ["user", "GetUser"]
    t = spark.createDataFrame([("r", "m", "UserDTO", "struct", [("A", "*Time")], 1)], "repo_id string, path string, name string, kind string, fields array<struct<name:string,type:string>>, line_start int")
    assert {(r["kind"], r["term"]) for r in search.build_type_index(t).collect()} == {("type", "userdto"), ("type", "time"), ("concept", "struct"), ("concept", "user")}
    ro = spark.createDataFrame([("r", "m", "GET", "/users/:id/{name}", "h", 5)], "repo_id string, path string, method string, route string, handler string, line int")
    assert {r["term"] for r in search.build_route_index(ro).collect()} == {"get", "users", "id", "name"} and search.lookup(search.build_route_index(ro), "route", "ser").count() == 1
    assert one(spark, search.query_concepts(F.lit("Login to the API"))) == ["authentication", "handler"] and one(spark, search.concept_name(F.lit("DB"))) == "database"
    assert one(spark, search.step_concepts(F.array(F.lit("1. Encode to JSON")))) == ["json", "serialization"]
    a = spark.createDataFrame([("p", "x", 1, 1), ("p", "y", 2, 2)], "path string, name string, line_start int, pos int")
    b = spark.createDataFrame([("p", "y", 2, 1), ("p", "z", 3, 2)], a.schema)
    assert [r["name"] for r in search.hybrid(a, b).collect()] == ["x", "y", "z"]


def test_rank_and_budgets(spark):
    n = F.lit("")
    s = lambda q, name, pub=False: one(spark, rank.keyword_score(F.lit(q), F.lit(name), n, F.lit("the user"), n, F.lit(pub)))
    assert s("user", "GetUser") == 4.5 and s("user", "GetUser", True) == pytest.approx(5.4) and s("", "x") == 0 and s("of", "of") == 0
    assert one(spark, rank.relevance(F.array(F.lit("user"), F.lit("zz")), F.lit("GetUser"), n, n, n)) == 0.75 and one(spark, rank.relevance(F.array().cast("array<string>"), n, n, n, n)) == 0
    assert [one(spark, rank.query_type(F.lit(q))) for q in ("the Design?", "a vs b", "how do I", "find x", "hello")] == ["architecture", "compare", "explain", "search", "general"]
    assert one(spark, rank.question_file_score(F.lit("login"), F.lit("vendor/login.go"), n, F.array(F.lit("x")))) == 0 and one(spark, rank.question_file_score(F.lit("login"), F.lit("login_test.go"), n, F.array(F.lit("Login")))) == 1.5
    assert one(spark, rank.question_type_score(F.lit("user"), F.lit("User"), n, F.array(F.lit("user_id")), F.array(*[F.lit(m) for m in "abcd"]), F.lit(True), F.lit("interface"))) == 6.0
    c = spark.createDataFrame([("q", 1, 9.0, 60, 60), ("q", 2, 8.0, 50, 45), ("q", 3, 7.0, 30, 30), ("q", 4, 6.0, 20, 5), ("p", 9, 1.0, 500, 500)], "q string, k long, s double, c long, m long")
    assert [(r["k"], r["form"], r["used"]) for r in rank.pack(c, "q", "k", "s", "c", 100).orderBy("used").collect()] == [(1, "full", 60), (3, "full", 90)]
    assert [(r["k"], r["form"]) for r in rank.pack(c, "q", "k", "s", "c", 100, "m").orderBy("used").collect()] == [(1, "full"), (3, "full"), (4, "summary")]
    assert rank.pack(c, "q", "k", "s", "c", 0).count() == 0 and rank.pack(c, "q", "k", "s", "c", 100, most=1).count() == 1
    assert [r["k"] for r in rank.prefix_budget(c.where("q = 'q'"), ["q"], ["k"], "c", 120).collect()] == [1, 2]


def test_impact(spark):
    f = spark.createDataFrame([("r", "a", "Changed", True), ("r", "b", "Caller", True), ("r", "a", "Own", False)], "repo_id string, path string, name string, is_public boolean")
    c = spark.createDataFrame([("r", "b", "Caller", "Changed", 5), ("r", "b", "Caller", "Own", 3), ("r", "a", "Own", "Changed", 1)], "repo_id string, caller_path string, caller string, callee string, line int")
    ch = f.where("path = 'a'").select("repo_id", "path")
    assert rows(impact.affected_functions(c, f, ch)) == [("r", "b", "Caller", "Own", True)]
    ro = spark.createDataFrame([("r", "b", "Caller"), ("r", "a", "x"), ("r", "b", "Other")], "repo_id string, path string, handler string")
    assert {r["handler"] for r in impact.affected_routes(ro, c, f, ch).collect()} == {"Caller", "x"}
    assert [one(spark, impact.risk(F.lit(a), F.lit(b), F.lit(p))) for a, b, p in ((0, 0, 0), (0, 1, 0), (4, 0, 0), (11, 0, 0), (1, 0, 1))] == ["low", "medium", "medium", "high", "high"]
    g = spark.createDataFrame([("r", "a", "F", ["*User", "int"], ["[]x.Order"])], "repo_id string, path string, name string, param_types array<string>, returns array<string>")
    t = spark.createDataFrame([("r", "a", "User"), ("r", "a", "Order"), ("r", "a", "Other"), ("r", "b", "int")], "repo_id string, path string, name string")
    assert {r["name"] for r in impact.related_types(g, t).collect()} == {"User", "Order"} and impact.type_usage(g, t).count() == 3
    s = spark.createDataFrame([("critical",), ("important",), ("minor",)], "severity string")
    assert [impact.severity_filter(s, x).count() for x in ("critical", "important", "all", "bogus")] == [1, 2, 3, 0]
    assert rows(impact.summary(f, ch)) == [(1, 2, 1, 1)]


@pytest.mark.parametrize(
    "q,intent,arg",
    [("What does GetUser do?", "function", "getuser"), ("what is the project structure", "type", "project"), ("show database calls", "side_effect", "db_query"), ("where is CreateUser used", "concept", "create"), ("who calls Foo", "callers", "foo"), ("dependencies of Foo", "calls", "foo"), ("trace Foo", "flow", "foo"), ("request flow", "flow", ""),
     ("files in pkg/a structure", "package", "pkg/a"), ("architecture please", "architecture", ""), ("hello", "general", ""), ("", "general", "")],
)
def test_router(spark, q, intent, arg):
    r = one(spark, router.classify(F.lit(q)))
    assert (r["intent"], r["argument"]) == (intent, arg)


def test_chains(spark):
    log, store = [], {}

    def outer(call):
        def run(step, ctx):
            log.append("outer")
            return call(step, ctx)

        return run

    add = compose.Step("add", lambda x, y: x + y, {"x": "{{a}}", "y": 2}, store="b")
    ctx = compose.Chain(add, compose.Step("skip", lambda: 1 / 0, when=lambda c: False), compose.Step("use", lambda v: v * 10, {"v": "{{b}}"}, transform=lambda v: v + 1)).use(outer, compose.timing, compose.cached(store)).run(a=1)
    assert ctx.last_data == 31 and log == ["outer", "outer"] and compose.summarize(ctx)["successes"] == 2 and len(store) == 2
    bad = compose.Chain(compose.Step("boom", lambda: 1 / 0), add).run(a=1)
    assert not bad.last.ok and len(bad.results) == 1
    tries = []
    compose.Chain(compose.Step("r", lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else 5))).use(compose.retry(3)).run()
    assert len(tries) == 3
    df = spark.createDataFrame([("abcdefgh",)], "t string")
    assert compose.Chain(compose.Step("t", lambda: df)).use(compose.budget(10)).run().last.tokens == 2 and not compose.Chain(compose.Step("t", lambda: df)).use(compose.budget(1)).run().last.ok
    assert compose.substitute({"a": {"b": "{{v}}"}, "l": ["{{v}}"], "t": "x {{v}}"}, {"v": 1}) == {"a": {"b": 1}, "l": ["{{v}}"], "t": "x {{v}}"}


def test_middleware_and_builder(caplog):
    import logging

    boom = lambda: 1 / 0
    metrics, seen = compose.Metrics(), []
    chain = compose.Chain().use(compose.measured(metrics), compose.logged(logging.getLogger("chain")), compose.stored("got")).call("a", lambda x: x + 1, x="{{n}}").call_into("b", "b", lambda x: x * 2, x="{{got_a}}").call_if(lambda c: False, "no", boom)
    with caplog.at_level(logging.INFO, "chain"):
        ctx = chain.run(n=1)
    assert ctx.last_data == 4 and ctx.variables["b"] == 4 and metrics.calls == metrics.successes == 2 and len(caplog.records) == 4
    ctx = compose.Chain().use(compose.on_error(lambda s, e: bool(seen.append(e)))).call("x", boom).call("y", lambda: 1).run()
    assert ctx.stopped and len(ctx.results) == 1 and "division" in seen[0]
    assert compose.Chain().use(compose.transformed(lambda r: compose.Result(r.step, True, 7))).call("x", lambda: 1).run().last_data == 7
    import time as clock

    assert "timeout" in compose.Chain().use(compose.within(0.05)).call("x", lambda: clock.sleep(0.5)).run().last.error
    assert [compose.backoff(i, 1, 2, 5) for i in range(4)] == [1, 2, 4, 5] and all(0.5 <= compose.backoff(0, 1, jitter=0.5) <= 1.5 for _ in range(20))
    b = compose.TokenBudget(10)
    assert b.use(6) and not b.use(5) and b.fits(4) and b.percent == 60.0 and compose.TokenBudget(0).percent == 0.0
    b.reset()
    assert b.remaining == 10


def _small_store(spark):
    f = spark.createDataFrame([("r", "a.go", "GetUser", 1, ["db_query"], "p", True), ("r", "b.go", "HandleUser", 2, ["http_call"], "p", True), ("s", "c.go", "GetUser", 3, [], "q", False)], "repo_id string, path string, name string, line_start long, side_effects array<string>, package string, is_public boolean")
    c = spark.createDataFrame([("r", "b.go", "HandleUser", "GetUser", None, "a.go", 5, "internal"), ("r", "a.go", "GetUser", "Query", "db", None, 6, "method")], "repo_id string, caller_path string, caller string, callee string, callee_package string, callee_file string, line int, call_type string")
    t = spark.createDataFrame([("r", "a.go", "User", "struct")], "repo_id string, path string, name string, kind string")
    return compose.Store(f, c, t, f.select("repo_id", "path").distinct())


def test_patterns_and_quick_chains(spark):
    st = _small_store(spark)
    ctx = compose.search_with_context(st, "user").run()
    assert {r["relation"] for r in ctx.last_data.collect()} == {"caller", "callee"} and len(ctx.results) == 2
    assert len(compose.search_with_context(st, "nothing").run().results) == 1
    assert {(r["repo_id"], r["name"]) for r in compose.multi_repo_search(st, ["r", "s"], "user").run().last_data.collect()} == {("r", "GetUser"), ("r", "HandleUser"), ("r", "User"), ("s", "GetUser")}
    ctx = compose.database_operations(st).run()
    assert ctx.variables["db_reads"].count() == 1 and ctx.variables["db_writes"].count() == 0
    ctx = compose.http_endpoints(st).run()
    assert ctx.variables["handlers"].count() == 1 and ctx.variables["http_calls"].count() == 1
    assert compose.analyze_function(st, "r", "a.go", "GetUser").run().variables["callers"].count() == 1
    assert set(compose.PATTERNS) == {"find_and_expand", "search_with_context", "impact_analysis", "multi_repo_search"}


def test_answers_without_rows(spark):
    st = _small_store(spark)
    a = compose.answer(st, "what does Nothing do")
    assert (a.intent, a.confidence(False), a.confidence(), a.needs_ai, a.rows.count()) == ("function", 0.5, 0.95, False, 0)
    a = compose.answer(st, "hello")
    assert a.needs_ai and a.rows.count() == 0 and a.confidence() == 0.3
    assert compose.answer(st, "find authentication").confidence(False) == 0.8
    assert compose.answer(compose.Store(st.functions.drop("side_effects"), st.calls, st.types, st.files), "which functions do database work").rows.count() == 0


def test_analysis_helpers(spark):
    tries = []

    def analyze(x):
        tries.append(x)
        if x == "gone":
            raise FileNotFoundError(x)
        if tries.count(x) == 1:
            raise OSError("busy")
        return x

    got = compose.analyze_each(["a", "gone"], analyze, at_once=99)
    assert got["a"].ok and not got["gone"].ok and tries.count("a") == 2 and tries.count("gone") == 1
    tables = {"t": spark.range(0)}
    assert compose.get_or_analyze(lambda: tables["t"], lambda: tables.update(t=spark.range(3))).count() == 3
    rows_ = []
    assert compose.captured(rows_, "tool", lambda x: "y" * 40)(x=1) and rows_[0][0] == "tool" and rows_[0][2] == 10 and rows_[0][4]
    with pytest.raises(ZeroDivisionError):
        compose.captured(rows_, "bad", lambda: 1 / 0)()
    assert not rows_[1][4] and "division" in rows_[1][5]
    assert compose.skills(spark, "security").count() == 1 and compose.hints(spark, "DUPLICATE").first()["name"] == "find_duplicates" and compose.hints(spark).count() == 29


def test_upsert_of_any_columns(spark):
    from lodestone import schemas
    from lodestone.sources.files import upsert

    a = spark.createDataFrame([("1", "r", None, "function", "f", "p", [1.0], {"a": "x"}), ("2", "r", None, "function", "g", "p", None, None)], schemas.TABLES["vectors"])
    b = spark.createDataFrame([("1", "r", None, "function", "late", "p", [2.0], {"a": "z"}, 5), ("1", "r", None, "function", "old", "p", [9.0], {"z": "z"}, 4), ("3", "r", None, "type", "t", "p", [], {}, None)], schemas.TABLES["vectors"] + ", at int")
    got = {r["id"]: r["name"] for r in upsert(a, b, ["id"], order="at").collect()}
    assert got == {"1": "late", "2": "g", "3": "t"} and upsert(schemas.empty(spark, "vectors"), b, ["id"], order="at").columns == a.columns
    repos = schemas.empty(spark, "repos")
    assert upsert(repos, repos, ["id"]).count() == 0 and upsert(repos, repos, ["id"], order="analyzed_at").count() == 0


def test_budget_clamps_and_pack(spark):
    from lodestone.operators import context

    assert [context.clamp_budget(x) for x in (None, 0, -1, 7, 99_999)] == [4000, 4000, 4000, 7, 32_000]
    df = spark.createDataFrame([("q", 1, 3.0, 60, 20), ("q", 2, 2.0, 50, 45), ("q", 3, 2.0, 30, 10), ("q", 4, 1.0, 20, 20), (None, 5, 1.0, 20, 20), ("r", 6, None, 1, 1), ("r", 7, 1.0, 1000, 999)], "q string, k int, s double, c int, m int")
    got = {(r["q"], r["k"], r["form"], r["used"]) for r in rank.pack(df, "q", "k", "s", "c", 100).collect()}
    assert got == {("q", 1, "full", 60), ("q", 3, "full", 90), (None, 5, "full", 20)}
    got = {(r["q"], r["k"], r["form"], r["used"]) for r in rank.pack(df, "q", "k", "s", "c", 100, "m").collect()}
    assert got == {("q", 1, "full", 60), ("q", 3, "full", 90), (None, 5, "full", 20)} and rank.pack(df.limit(0), "q", "k", "s", "c", 100).count() == 0


def test_ranks_of_a_vocabulary_with_many_equal_counts(spark):
    words = [(f"w{i:04}", 5 if i < 3 else 1) for i in range(1000)]
    v = embedding.ranked_vocabulary(spark.createDataFrame(words, "word string, df long").repartition(4), 10, 16)
    want = [w for w, _ in sorted(words, key=lambda x: (-x[1], x[0]))]
    assert [r["word"] for r in v.orderBy("rank").collect()] == want and {r["rank"] for r in v.collect()} == set(range(1000))


def test_scan_of_a_root_with_pattern_characters(spark, tmp_path):
    from lodestone.sources.files import scan

    root = tmp_path / "a+b (1)"
    (root / "x").mkdir(parents=True)
    (root / "x" / "m.go").write_text("package m")
    assert [r["path"] for r in scan(spark, str(root)).collect()] == ["x/m.go"]


def test_settings(spark):
    from lodestone.settings import Settings, settings

    assert settings(spark).max_file_size == 1 << 20
    spark.conf.set("spark.lodestone.max_tokens", "7")
    spark.conf.set("spark.lodestone.concurrent_files", "-2")
    try:
        got = settings(spark)
        assert (got.max_tokens, got.concurrent_files) == (7, 1)
        for bad in (Settings(storage_path=""), Settings(max_tokens=0), Settings(temperature=1.5), Settings(max_file_size=0)):
            with pytest.raises(ValueError):
                bad.validate()
    finally:
        spark.conf.unset("spark.lodestone.max_tokens")
        spark.conf.unset("spark.lodestone.concurrent_files")


def test_embedder_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gammaDelta"), (3, None)], "id int, t string")
    e = embedding.Embedder.fit(docs.where("t IS NOT NULL"), "id", "t", 3, 16)
    e.save(str(tmp_path / "m"))
    again = embedding.Embedder.load(spark, str(tmp_path / "m"), 16)
    assert rows(e.embed(docs, "id", "t")) == rows(again.embed(docs, "id", "t")) and e.embed(docs, "id", "t").count() == 3


def test_refresh_states(spark):
    from lodestone.operators import context

    df = spark.createDataFrame([("a", "text"), ("b", None), ("c", "")], "repo_id string, summary string")
    assert [r["state"] for r in context.to_refresh(df).orderBy("repo_id").collect()] == ["skip", "update", "update"] and context.to_refresh(df, True).where("state = 'update'").count() == 3


def test_type_usage_broadcasts_no_names(spark, tmp_path):
    f = spark.createDataFrame([("r", "a", "F", ["*User"], ["[]x.Order"])], "repo_id string, path string, name string, param_types array<string>, returns array<string>")
    spark.createDataFrame([("r", "User"), ("r", "User"), ("s", "Order")], "repo_id string, name string").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))  # files have an estimate
    used = impact.type_usage(f, t)
    assert "Broadcast" not in used._jdf.queryExecution().executedPlan().toString() and [(r["function"], r["name"]) for r in used.collect()] == [("F", "User")]


def test_store_of_contexts(spark, tmp_path):
    from lodestone.sources.stores import ContextStore, schema

    old = ContextStore(spark, str(tmp_path / "s"), version=1)
    old.put("repos", spark.createDataFrame([("a/b", "main"), ("c", None)], "id string, branch string"))
    now = ContextStore(spark, old.folder)
    assert "build_system" in now.get("repos").columns and now.get("repos", "a/b").first()["branch"] == "main"
    now.delete("a/b", ("repos",))
    now.delete("nothing", ("repos", "files"))
    assert [r["id"] for r in now.get("repos").collect()] == ["c"] and len(schema("repos", 1)) + 1 == len(schema("repos"))


def _functions_with_wide_lines(spark, repos, each):
    """``each`` functions of each of so many repositories, with keys beyond 32 bits, spread over all tasks."""
    return spark.range(repos * each, numPartitions=8).select(F.concat(F.lit("r"), F.col("id") % repos).alias("repo_id"), F.lit("a.go").alias("path"), F.concat(F.lit("F"), "id").alias("name"), F.lit(True).alias("is_public"), (F.col("id") + 3_200_000_000).alias("line_start"))


def test_store_keeps_lines_beyond_32_bits(spark, tmp_path):
    from lodestone.sources.stores import ContextStore

    ContextStore(spark, str(tmp_path / "s")).put("functions", _functions_with_wide_lines(spark, 2, 2))
    assert rows(ContextStore(spark, str(tmp_path / "s")).get("functions").select("repo_id", "line_start")) == [("r0", 3_200_000_000), ("r0", 3_200_000_002), ("r1", 3_200_000_001), ("r1", 3_200_000_003)]
    old = str(tmp_path / "old")
    spark.createDataFrame([("f", 7, "r")], "name string, line_start int, repo_id string").write.partitionBy("repo_id").parquet(f"{old}/functions")
    assert rows(ContextStore(spark, old).get("functions").select("name", "line_start")) == [("f", 7)]  # of a store with narrow lines


def test_queries_of_stores_with_lines_beyond_32_bits(spark, tmp_path):
    import __spark_entry__ as entry
    from conftest import DATA

    nodes = spark.read.parquet(f"{DATA}/graph_nodes.parquet")
    nodes.withColumn("node_key", F.col("node_key") + 3_200_000_000).write.parquet(str(tmp_path / "graph_nodes.parquet"))
    q = entry.queries()
    assert rows(q["s_store"](spark, str(tmp_path))) == rows(q["s_store"](spark, str(DATA)))
    one = q["s_one_repository"](spark, str(DATA)).withColumn("line_start", F.col("line_start") + 3_200_000_000)
    assert rows(q["s_one_repository"](spark, str(tmp_path))) == rows(one)


def test_replaced_repositories_without_rows_and_rows_without_repository(spark, tmp_path, duck):
    import __spark_entry__ as entry
    from conftest import DATA

    nodes = spark.read.parquet(f"{DATA}/graph_nodes.parquet").cache()
    first, *_, last = (r[0] for r in nodes.select("repo_id").distinct().orderBy("repo_id").collect())
    cases = {
        "no_public": nodes.withColumn("is_public", F.col("is_public") & (F.col("repo_id") != last)),
        "no_repository": nodes.withColumn("repo_id", F.when(F.col("node_key") % 3 > 0, F.col("repo_id"))),
        "empty": nodes.withColumn("repo_id", F.when(F.col("repo_id") == first, "").otherwise(F.col("repo_id"))),
        "one": nodes.withColumn("repo_id", F.lit(first)),
        "nothing": nodes.limit(0),
    }
    for name, df in cases.items():
        df.coalesce(1).write.parquet(str(tmp_path / name / "graph_nodes.parquet"))
        sql = entry.oracle_sql()["s_store"].replace("graph_nodes", f"read_parquet('{tmp_path}/{name}/graph_nodes.parquet/*.parquet')")
        got, want = rows(entry.queries()["s_store"](spark, str(tmp_path / name))), duck.execute(sql).fetchall()
        assert got == sorted(want, key=lambda t: tuple((x is not None, str(x)) for x in t)), name
    nodes.unpersist()


def test_store_writes_files_by_repository(spark, tmp_path):
    from lodestone.sources.stores import ContextStore

    store = ContextStore(spark, str(tmp_path / "s"))
    store.put("functions", _functions_with_wide_lines(spark, 40, 50))
    assert len(list((tmp_path / "s/functions").rglob("*.parquet"))) == 40 and store.get("functions").count() == 2000
    one = store.get("functions", "r7")
    assert one.count() == 50 and all("repo_id=r7/" in p for p in one.inputFiles()) and one.columns == store.get("functions").columns
    assert store.get("functions", "nothing").count() == 0 and store.get("functions", "").count() == 0
    odd = "a/b=c {x}*[1]%2F?"
    store.put("functions", _functions_with_wide_lines(spark, 1, 3).withColumn("repo_id", F.lit(odd)))
    assert store.get("functions", odd).count() == 3 and store.get("functions").count() == 2003


def test_prefix_budget_of_a_group_in_many_ranges(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.lit(3000) - F.col("id")).alias("o"), (F.col("id") % 3).alias("c")).repartition(6)
    want = {}
    for r in sorted(df.collect(), key=lambda r: r["o"]):
        used, out, ended = want.setdefault(r["g"], [0, [], False])
        if not ended and used + r["c"] <= 300:
            want[r["g"]][0] += r["c"]
            out.append(r["o"])
        else:
            want[r["g"]][2] = True
    got = {}
    for r in rank.prefix_budget(df, ["g"], ["o"], "c", 300).orderBy("o").collect():
        got.setdefault(r["g"], []).append(r["o"])
    assert got == {g: out for g, (_, out, _) in want.items() if out}
    assert rank.prefix_budget(df.limit(0), ["g"], ["o"], "c", 300).count() == 0

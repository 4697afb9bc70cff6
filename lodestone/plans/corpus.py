"""Queries over a code corpus with known contents: one generated source file per function of the call graph.

The number k of a function decides what its file holds (branches, loops, effects, calls, errors, routes, types), so that
SQL can state what must be extracted from every file. The queries run the parser over all of them and, on what it
extracts, the indexes, the answers to questions and the contexts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, extraction, impact, search
from ..session import cut
from . import bindings as B
from . import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FN = "(SELECT line_start AS k, repo_id, name FROM " + B.SQL["fn"] + ")"


def query(sql: str | None = None):
    """Register a query under its function's name; ``{fn}`` stands for (k, repo_id, name) of all functions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{fn}", _FN)
        return f

    return add


_KINDS = ("Request", "Response", "Config", "DTO", "Model", "")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, path, content): a file ``<k>.go`` per function; every 97th is broken off."""
    k = F.col("k")
    s = lambda c: c.cast("string")
    part = lambda cond, *text: F.when(cond, F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text])).otherwise("")
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 6 + 1).cast("int"))
    head = F.concat(
        F.lit("// Package p"), s(k % 7), F.lit(" keeps part "), s(k % 7), F.lit(". More.\npackage p"), s(k % 7),
        F.lit('\n\nimport (\n\t"context"\n\t"fmt"\n\t"log"\n\t"net/http"\n)\n\n// T'), s(k), F.lit(" is a record.\ntype T"), s(k), kind, F.lit(' struct {\n\tID int `json:"id" validate:"required"`\n\tnote string\n'),
        part(k % 3 == 0, '\tRow string `json:"row,omitempty" db:"row_', s(k % 10), '"`\n'), F.lit("}\n\nconst Max"), s(k), F.lit(" = "), s(k % 100), F.lit("\n\n// "), F.col("name"), F.lit(" does work.\n"),
    )
    body = F.concat(
        F.lit("func (s *Store) "), F.col("name"), F.lit("(ctx context.Context, a string, in *T"), s(k), kind, F.lit(") (string, error) {\n"),
        part(k % 2 == 1, '\tif a == "" {\n\t\treturn "", fmt.Errorf("no: %w", err)\n\t}\n'),
        F.repeat(F.lit("\tfor i := 0; i < 9; i++ {\n\t\twork(a)\n\t}\n"), (k % 3).cast("int")),
        part(k % 4 == 1, '\trows, err := db.Query("SELECT id FROM table', s(k % 10), '")\n\tif err != nil {\n\t\tlog.Printf("x")\n\t\treturn "", err\n\t}\n'),
        part(k % 4 == 2, '\thttp.Get("https://x/', s(k % 10), '")\n'),
        part(k % 4 == 3, "\tswitch n {\n\tcase 1:\n\tcase 2:\n\tdefault:\n\t}\n"),
        part(k % 5 == 0, "\tgo spawn(a)\n"), part(k % 5 == 1, '\tpanic("no")\n'), F.lit("\treturn a, nil\n}\n\n"),
    )
    routes = F.concat(F.lit('func routes(r *gin.Engine) {\n\tr.GET("/items'), s(k % 10), F.lit('/:id", auth, h.List)\n\thttp.HandleFunc("/x'), s(k % 10), F.lit('", serve)\n}\n'))
    content = F.when(k % 97 == 0, F.concat(head, F.lit("func broken("))).otherwise(F.concat(head, body, routes))
    # parsing costs far more than its small rows tell: all cores take part
    f = B.functions(spark, d).select(F.col("line_start").alias("k"), "repo_id", "name").repartition(2 * spark.sparkContext.defaultParallelism)
    return f.select("repo_id", F.concat(s(k), F.lit(".go")).alias("path"), content.cast("binary").alias("content"))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract(sources(spark, d))


def functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions that the files are named after; the helper ``routes`` aside."""
    return _functions(extracted(spark, d))


def _functions(e: DataFrame) -> DataFrame:
    return extraction.functions(e).where("name <> 'routes'").withColumn("k", _key("path"))


def _key(path: str) -> Column:
    return F.regexp_extract(path, r"^(-?\d+)", 1).cast("long")


# --- extraction ---------------------------------------------------------------------------------------------------------

_OK = "k % 97 <> 0"
_TYPE = "'T' || k || (['Request', 'Response', 'Config', 'DTO', 'Model', ''])[k % 6 + 1]"


@query("""SELECT k, CASE WHEN k % 97 = 0 THEN '' ELSE 'p' || (k % 7) END AS package, CASE WHEN k % 97 = 0 THEN 'parse error' ELSE 'Package p' || (k % 7) || ' keeps part ' || (k % 7) || '.' END AS purpose, k % 97 = 0 AS parse_error,
  CASE WHEN k % 97 = 0 THEN 0 ELSE 4 END AS n_imports, CASE WHEN k % 97 = 0 THEN 0 ELSE 1 END AS n_constants, CASE WHEN k % 97 = 0 THEN 0 ELSE 3 END AS n_exports FROM {fn}""")
def x_code_files(spark, d):
    """What is told of every file; broken ones keep a row."""
    e = extracted(spark, d)
    public = F.size(F.filter("exports", lambda x: x["kind"] != "function"))
    return e.select(_key("path").alias("k"), "package", "purpose", "parse_error", F.size("imports").alias("n_imports"), F.size("constants").alias("n_constants"), F.when(F.col("parse_error"), 0).otherwise(public + F.greatest(F.lit(1), F.size(F.filter("exports", lambda x: x["kind"] == "function")))).alias("n_exports"))


_LIST = "list_filter([%s], lambda x: x IS NOT NULL)"
_EFFECTS = _LIST % "CASE WHEN k % 4 = 1 THEN 'db_query' END, CASE WHEN k % 4 = 2 THEN 'http_call' END, CASE WHEN k % 4 = 1 THEN 'logging' END, CASE WHEN k % 5 = 1 THEN 'panic' END"


@query(f"""SELECT k, name, '*Store' AS receiver, '(*Store) ' || name || '(ctx context.Context, a string, in *' || {_TYPE} || ') (string, error)' AS signature, name || ' does work.' AS description, regexp_matches(name, '^[A-Z]') AS is_public,
  CAST(1 + CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END + k % 3 + CASE k % 4 WHEN 1 THEN 1 WHEN 3 THEN 4 ELSE 0 END AS INT) AS complexity, array_to_string({_EFFECTS}, ',') AS effects,
  array_to_string({_LIST % "CASE WHEN k % 2 = 1 THEN 'fmt' END, CASE WHEN k % 4 = 1 THEN 'log' END, CASE WHEN k % 4 = 2 THEN 'net/http' END"}, ',') AS uses FROM {{fn}} WHERE {_OK}""")
def x_code_functions(spark, d):
    """Every function with signature, complexity, effects and the imports it uses."""
    return functions(spark, d).select("k", "name", "receiver", "signature", "description", "is_public", "complexity", F.array_join("side_effects", ",").alias("effects"), F.array_join("uses_imports", ",").alias("uses"))


_STEPS = _LIST % "CASE WHEN k % 3 > 0 THEN 'Loop iteration' END, CASE WHEN k % 3 > 1 THEN 'Loop iteration' END, CASE WHEN k % 4 = 1 THEN 'Execute SQL query' END, CASE WHEN k % 4 = 2 THEN 'HTTP GET request' END, CASE WHEN k % 4 = 3 THEN 'Switch on condition' END, CASE WHEN k % 5 = 0 THEN 'Spawn goroutine: Call spawn' END, CASE WHEN k % 5 = 1 THEN 'Call panic' END, 'Return result'"
_PATTERNS = _LIST % "CASE WHEN regexp_matches(lower(name), '^(create|add|insert)') THEN 'create' END, CASE WHEN regexp_matches(lower(name), '^(get|find|fetch|read)') THEN 'read' END, CASE WHEN regexp_matches(lower(name), '^(update|modify|edit)') THEN 'update' END, CASE WHEN regexp_matches(lower(name), '^(delete|remove)') THEN 'delete' END, CASE WHEN regexp_matches(lower(name), '^handle|handler$') THEN 'handler' END, CASE WHEN regexp_matches(lower(name), '^(validate|check|is)') THEN 'validation' END, CASE WHEN regexp_matches(lower(name), '^(new|create)') THEN 'factory' END, CASE WHEN k % 4 = 2 THEN 'http-client' END, CASE WHEN k % 4 = 1 THEN 'database' END, CASE WHEN k % 5 = 0 THEN 'async' END"


@query(f"""SELECT k, array_to_string(list_transform(s, lambda x, i: i || '. ' || x), '|') AS steps, array_to_string(s[1:3], ', then ') AS summary, array_to_string({_PATTERNS}, ',') AS patterns, 'Returns a' AS output_source, CASE WHEN k % 3 > 0 THEN 'Passed to work' WHEN k % 5 = 0 THEN 'Passed to spawn' END AS input_a
  FROM (SELECT *, {_STEPS} AS s FROM {{fn}} WHERE {_OK})""")
def x_code_behavior(spark, d):
    """Steps, summary, patterns, use of inputs and source of the output."""
    b = F.col("behavior")
    return functions(spark, d).select("k", F.array_join(b["steps"], "|").alias("steps"), b["summary"].alias("summary"), F.array_join(b["patterns"], ",").alias("patterns"), b["output_source"].alias("output_source"), F.try_element_at(b["input_usage"], F.lit("a")).alias("input_a"))


@query(f"SELECT k, true AS returns_error, k % 2 = 1 AS wraps_errors, k % 4 = 1 AS logs_errors, k % 5 = 1 AS panics_on_error, k % 4 = 1 AS propagates_error, CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS error_checks, CASE WHEN k % 4 = 1 THEN 'propagated_error' ELSE '' END AS error_types FROM {{fn}} WHERE {_OK}")
def x_code_errors(spark, d):
    """How every function deals with errors."""
    return functions(spark, d).select("k", "error_handling.*").withColumn("error_types", F.coalesce(F.array_join("error_types", ","), F.lit("")))


_CALLS = """SELECT k, unnest(list_filter([CASE WHEN k % 2 = 1 THEN 'fmt.Errorf stdlib' END, CASE WHEN k % 3 > 0 THEN '.work internal' END, CASE WHEN k % 4 = 1 THEN 'db.Query method' END, CASE WHEN k % 4 = 1 THEN 'log.Printf stdlib' END, CASE WHEN k % 4 = 2 THEN 'http.Get stdlib' END, CASE WHEN k % 5 = 0 THEN '.spawn go' END, CASE WHEN k % 5 = 1 THEN '.panic internal' END], lambda x: x IS NOT NULL)) AS call FROM {fn} WHERE k % 97 <> 0"""


@query(_CALLS)
def x_code_calls(spark, d):
    """Calls of every function with package and kind, each once."""
    return functions(spark, d).select("k", F.explode("calls").alias("c")).select("k", F.concat(F.coalesce("c.package", F.lit("")), F.lit("."), "c.function", F.lit(" "), "c.type").alias("call"))


@query(f"""SELECT k, false AS is_http_handler, CASE WHEN k % 4 = 1 THEN 'SELECT Query table' || (k % 10) || ' SELECT id FROM table' || (k % 10) ELSE '' END AS queries, CASE WHEN k % 4 = 2 THEN 'GET https://x/' || (k % 10) ELSE '' END AS requests, CASE WHEN k % 2 = 1 THEN 'Validate a is not empty' ELSE '' END AS validations FROM {{fn}} WHERE {_OK}""")
def x_code_flow(spark, d):
    """Queries, requests and validations of every function."""
    a = F.col("api_flow")
    return functions(spark, d).select(
        "k", a["is_http_handler"].alias("is_http_handler"), F.array_join(F.transform(a["db_queries"], lambda q: F.concat_ws(" ", q["operation"], q["method"], q["table"], q["raw_query"])), "|").alias("queries"),
        F.array_join(F.transform(a["external_calls"], lambda q: F.concat_ws(" ", q["method"], q["url"])), "|").alias("requests"), F.array_join(a["validations"], "|").alias("validations"),
    )


@query(f"""SELECT k, {_TYPE} AS name, 'struct' AS kind, 'T' || k || ' is a record.' AS description, array_to_string(CASE WHEN k % 3 = 0 THEN ['ID:int', 'note:string', 'Row:string'] ELSE ['ID:int', 'note:string'] END, '|') AS fields FROM {{fn}} WHERE {_OK}""")
def x_code_types(spark, d):
    """Types with their fields."""
    t = extraction.types(extracted(spark, d))
    return t.select(_key("path").alias("k"), "name", "kind", "description", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"])), "|").alias("fields"))


@query(f"""SELECT k, CASE k % 6 WHEN 0 THEN 'request' WHEN 1 THEN 'response' WHEN 4 THEN 'model' WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 'model' ELSE 'config' END WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'model' ELSE 'dto' END ELSE CASE WHEN k % 3 = 0 THEN 'model' ELSE 'struct' END END AS category,
  CASE WHEN k % 3 = 0 THEN 'id::required:true|:::false|row:row_' || (k % 10) || '::false' ELSE 'id::required:true|:::false' END AS details FROM {{fn}} WHERE {_OK}""")
def x_code_structs(spark, d):
    """Tags of every field and the category of every struct."""
    s = extraction.struct_details(extraction.types(extracted(spark, d)))
    one = lambda f: F.concat_ws(":", f["json_name"], f["db_column"], f["validation"], f["required"].cast("string"))
    return s.select(_key("path").alias("k"), "category", F.array_join(F.transform("details", one), "|").alias("details"))


@query(f"SELECT k, 'Max' || k AS name, CAST(k % 100 AS VARCHAR) AS value, true AS is_public FROM {{fn}} WHERE {_OK}")
def x_code_constants(spark, d):
    """Constants with their values."""
    return extracted(spark, d).select(_key("path").alias("k"), F.explode("constants").alias("c")).select("k", "c.name", "c.value", "c.is_public")


_ROUTES = f"SELECT k, 'GET' AS method, '/items' || (k % 10) || '/:id' AS route, 'h.List' AS handler, 'auth' AS middleware FROM {{fn}} WHERE {_OK} UNION ALL SELECT k, 'ANY', '/x' || (k % 10), 'serve', '' FROM {{fn}} WHERE {_OK}"


@query(_ROUTES)
def x_code_routes(spark, d):
    """Routes that the code registers."""
    return extraction.route_table(extracted(spark, d)).select(_key("path").alias("k"), "method", "route", "handler", F.array_join("middleware", ",").alias("middleware"))


# --- indexes ------------------------------------------------------------------------------------------------------------


def indexed(f: DataFrame) -> DataFrame:
    """Functions in the columns of the index."""
    kinds = F.array_distinct(F.concat("error_handling.error_types", F.when(F.col("error_handling.wraps_errors"), F.array(F.lit("wrapped"))).otherwise(F.array().cast("array<string>"))))
    return f.select(
        "repo_id", "path", "name", F.col("k").alias("line_start"), F.transform("parameters", lambda p: p["type"]).alias("param_types"), "returns", "side_effects",
        F.col("behavior.steps").alias("steps"), F.col("behavior.patterns").alias("patterns"), F.coalesce(kinds, F.array().cast("array<string>")).alias("error_kinds"),
    )


@query(f"SELECT e AS term, count(*) AS n FROM (SELECT unnest({_EFFECTS}) AS e FROM {{fn}} WHERE {_OK}) GROUP BY 1")
def q_index_effects(spark, d):
    """Postings of the effect index."""
    return search.build_index(indexed(functions(spark, d))).where("kind = 'effect'").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lower(t) AS term, count(*) AS n FROM (SELECT unnest(['context.context', 'string', {_TYPE}, 'string', 'error']) AS t FROM {{fn}} WHERE {_OK}) GROUP BY 1")
def q_index_types(spark, d):
    """Q1: postings of the type index, parameters and returns."""
    return search.build_index(indexed(functions(spark, d))).where("kind = 'type'").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(['get', 'items' || (k % 10), 'id', 'any', 'x' || (k % 10)]) AS term FROM {{fn}} WHERE {_OK}) GROUP BY 1")
def q_index_routes(spark, d):
    """Q1: postings of the route index."""
    return search.build_route_index(extraction.route_table(extracted(spark, d))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, lower(t) AS term, count(*) AS n FROM (SELECT 'type' AS kind, unnest([{_TYPE}, 'int', 'string'] || CASE WHEN k % 3 = 0 THEN ['string'] ELSE [] END) AS t FROM {{fn}} WHERE {_OK} UNION ALL SELECT 'concept', 'struct' FROM {{fn}} WHERE {_OK} UNION ALL SELECT 'concept', unnest(list_filter(string_split(trim(regexp_replace({_TYPE}, '([A-Z])', ' \\1', 'g')), ' '), lambda w: strlen(w) >= 3)) FROM {{fn}} WHERE {_OK}) GROUP BY ALL")
def q_index_type_names(spark, d):
    """Q1: postings of types, by their own names, the types of their fields, kinds and camel words."""
    return search.build_type_index(extraction.types(extracted(spark, d)).withColumn("line_start", _key("path"))).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, t AS term, count(*) AS n FROM (SELECT 'name' AS kind, lower(name) AS t FROM {{fn}} WHERE {_OK} UNION ALL SELECT 'effect', unnest({_EFFECTS}) FROM {{fn}} WHERE {_OK} UNION ALL SELECT 'concept', unnest({_PATTERNS}) FROM {{fn}} WHERE {_OK} UNION ALL SELECT 'error', unnest({_LIST % "CASE WHEN k % 4 = 1 THEN 'propagated_error' END, CASE WHEN k % 2 = 1 THEN 'wrapped' END"}) FROM {{fn}} WHERE {_OK}) GROUP BY ALL")
def q_index_local(spark, d):
    """Q2: the smaller index: whole names, effects, patterns and kinds of errors."""
    return search.build_local_index(indexed(functions(spark, d))).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'effect' AS kind, k FROM {{fn}} WHERE {_OK} AND k % 4 = 2 UNION ALL SELECT 'error', k FROM {{fn}} WHERE {_OK} AND k % 4 = 1 UNION ALL SELECT 'type', k FROM {{fn}} WHERE {_OK} AND k = (SELECT max(k) FROM {{fn}} WHERE {_OK}) UNION ALL SELECT 'concept', k FROM {{fn}} WHERE {_OK} AND k % 4 = 1")
def q_lookup_kinds(spark, d):
    """Q3, K2, F8: functions looked up by effect, error, type and concept."""
    f = cut(functions(spark, d))
    known = indexed(f)
    i = search.build_index(known).unionByName(search.build_local_index(known).where("kind = 'error'"))
    last = f.select(F.max_by(F.element_at("parameters", 3)["type"], "k")).first()[0] or ""
    parts = [search.lookup(i, kind, term) for kind, term in (("effect", "http_call"), ("error", "propagated_error"), ("type", last.removeprefix("*")), ("concept", "database"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", F.col("line_start").alias("k")).distinct()


@query(f"SELECT DISTINCT k, '/items' || (k % 10) || '/:id' AS route FROM {{fn}} WHERE {_OK} AND k % 10 = 3")
def q_lookup_routes(spark, d):
    """Q3: routes by a part of a path segment."""
    r = extraction.route_table(extracted(spark, d))
    hit = search.lookup(search.build_route_index(r), "route", "ITEMS3").select("path", F.col("name").alias("handler"), F.col("line_start").alias("line"))
    return r.join(hit.distinct(), ["path", "handler", "line"], "left_semi").select(_key("path").alias("k"), "route").distinct()


# --- effects, types, histograms -------------------------------------------------------------------------------------------


@query(f"SELECT repo_id, e AS effect, count(*) AS n FROM (SELECT repo_id, unnest({_EFFECTS}) AS e FROM {{fn}} WHERE {_OK}) GROUP BY ALL")
def a_effect_histogram(spark, d):
    """Functions by effect and repository."""
    return functions(spark, d).select("repo_id", F.explode("side_effects").alias("effect")).groupBy("repo_id", "effect").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k FROM (SELECT k FROM {{fn}} WHERE {_OK} AND k % 4 = 1 ORDER BY CAST(k AS VARCHAR) || '.go', k LIMIT 100)")
def f_by_effect(spark, d):
    """Functions of one effect, the first hundred by path."""
    f = indexed(functions(spark, d))
    labels = f.select("repo_id", "path", "name", "line_start", F.explode("side_effects").alias("effect"))
    return search.by_label(labels, f, "effect", "DB_QUERY").select(F.col("line_start").alias("k"))


@query(f"SELECT k, {_TYPE} AS type FROM {{fn}} WHERE {_OK}")
def j_related_types(spark, d):
    """Types of a function's own file that it takes or gives."""
    e = _kept(spark, d)
    return impact.related_types(indexed(_functions(e)), extraction.types(e)).select(_key("path").alias("k"), F.col("name").alias("type"))


@query(f"SELECT repo_id, {_TYPE} AS type, count(*) AS n FROM {{fn}} WHERE {_OK} GROUP BY ALL")
def j_type_usage(spark, d):
    """Functions that use each type."""
    e = _kept(spark, d)
    return impact.type_usage(indexed(_functions(e)), extraction.types(e)).groupBy("repo_id", F.col("name").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k, m AS method FROM (SELECT k, unnest(['GET', 'ANY']) AS m FROM {{fn}} WHERE {_OK}) WHERE k % 11 = 0")
def j_affected_routes(spark, d):
    """Routes that a change set touches: those of changed files."""
    e = cut(extracted(spark, d))
    f = extraction.functions(e)
    gone = f.where(_key("path") % 11 == 0).select("repo_id", "path").distinct()
    hit = impact.affected_routes(extraction.route_table(e), extraction.call_table(e).where("caller <> 'routes' AND callee = 'nothing'"), f, gone)
    return hit.select(_key("path").alias("k"), "method")


# --- contexts -----------------------------------------------------------------------------------------------------------


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """What is extracted, without the helper ``routes``."""
    return cut(extracted(spark, d).withColumn("functions", F.filter("functions", lambda f: f["name"] != "routes")))


@query(f"SELECT repo_id, count(*) AS n_files, count(*) FILTER ({_OK}) AS n_functions, count(*) FILTER ({_OK}) AS n_types, count(*) FILTER (regexp_matches(name, '^[A-Z]') AND {_OK}) AS n_public, CAST(sum(CASE WHEN {_OK} THEN 1 + CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END + k % 3 + CASE k % 4 WHEN 1 THEN 1 WHEN 3 THEN 4 ELSE 0 END ELSE 0 END) AS BIGINT) AS complexity FROM {{fn}} GROUP BY 1")
def a_overview(spark, d):
    """Overview of every repository."""
    return context.overview(_kept(spark, d))


@query(f"SELECT repo_id, CAST(k AS VARCHAR) || '.go' AS path, 'p' || (k % 7) AS package, 'Package p' || (k % 7) || ' keeps part ' || (k % 7) || '.' AS purpose, name || ' ' || '(*Store) ' || name || '(ctx context.Context, a string, in *' || {_TYPE} || ') (string, error)' AS functions, {_TYPE} || ' struct' AS types FROM {{fn}} WHERE {_OK}")
def f_file_summary(spark, d):
    """Files in short form: signatures and names of types."""
    s = context.summarize_files(_kept(spark, d)).where("functions IS NOT NULL AND size(functions) > 0")
    return s.select("repo_id", "path", "package", "purpose", F.array_join(F.transform("functions", lambda f: F.concat_ws(" ", f["name"], f["signature"])), "|").alias("functions"), F.array_join(F.transform("types", lambda t: F.concat_ws(" ", t["name"], t["kind"])), "|").alias("types"))


@query(f"SELECT k, name, name || ' does work.' AS description, array_to_string({_STEPS.replace('k %', 'k %')}, '|') <> '' AS has_summary, array_to_string({_EFFECTS}, ',') AS effects FROM {{fn}} WHERE {_OK}")
def f_function_summary(spark, d):
    """functions in short form: no steps, calls or flow."""
    s = context.summarize_functions(functions(spark, d))
    return s.select(_key("path").alias("k"), "name", "description", (F.col("summary") != "").alias("has_summary"), F.array_join("side_effects", ",").alias("effects"))


@query(f"SELECT repo_id, {_TYPE} AS name, 'struct' AS kind, CAST(k AS VARCHAR) || '.go' AS path FROM {{fn}} WHERE {_OK}")
def f_types_resource(spark, d):
    """the types resource: public types of every repository."""
    return context.public_types(_kept(spark, d)).select("repo_id", "name", "kind", "path")


@query(f"SELECT repo_id, 'p' || (k % 7) AS package, count(*) AS n_files, count(*) FILTER (regexp_matches(name, '^[A-Z]')) AS n_public FROM {{fn}} WHERE {_OK} GROUP BY ALL")
def f_architecture_resource(spark, d):
    """The architecture resource: packages with their files and public functions."""
    return context.architecture(_kept(spark, d))


_SCORE = "(CASE WHEN contains(t, 'plan') THEN 1.0 + 0.5 * contains(lower(name), 'plan')::INT ELSE 0 END + CASE WHEN contains(t, 'loop') THEN 1.0 ELSE 0 END) / 2"


@query(
    f"""WITH s AS (SELECT repo_id, k, name, {_STEPS} AS st FROM {{fn}} WHERE {_OK}), x AS (SELECT *, lower(name || ' ' || name || ' does work. ' || '(*Store) ' || name || '(ctx context.Context, a string, in *' || {_TYPE} || ') (string, error) ' || array_to_string(st[1:3], ', then ')) AS t FROM s),
y AS (SELECT repo_id, k, {_SCORE} AS score FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, k) AS place FROM y WHERE score > 0) SELECT repo_id, k FROM r WHERE place <= 15"""
)
def q_budgeted_context(spark, d):
    """Functions relevant to a question that fit its budget less the reserve; every one costs 100 here."""
    f = functions(spark, d).withColumn("summary", F.col("behavior.summary"))
    return context.budgeted(f, "plan loop", F.lit(100).cast("long"), 2000, key="k").select("repo_id", "k")


@query(f"""WITH f AS (SELECT repo_id, '(*Store) ' || name || '(ctx context.Context, a string, in *' || {_TYPE} || ') (string, error)' AS s, row_number() OVER (PARTITION BY repo_id ORDER BY name, k || '.go') AS r FROM {{fn}} WHERE {_OK} AND regexp_matches(name, '^[A-Z]')),
t AS (SELECT repo_id, {_TYPE} AS n, row_number() OVER (PARTITION BY repo_id ORDER BY {_TYPE}, k || '.go') AS r FROM {{fn}} WHERE {_OK}), p AS (SELECT repo_id, count(DISTINCT k % 7) AS n_packages, count(*) AS n_files FROM {{fn}} WHERE {_OK} GROUP BY 1)
SELECT p.repo_id, n_packages, n_files, (SELECT string_agg(s, '|' ORDER BY r) FROM f WHERE f.repo_id = p.repo_id AND r <= 5) AS functions, (SELECT string_agg(n, '|' ORDER BY r) FROM t WHERE t.repo_id = p.repo_id AND r <= 5) AS types FROM p""")
def q_summary_request(spark, d):
    """What a summary of every repository is asked from."""
    r = context.summary_request(_kept(spark, d), 5)
    return r.select("repo_id", "n_packages", "n_files", F.array_join("functions", "|").alias("functions"), F.array_join("types", "|").alias("types"))


# --- answers ------------------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, d: str) -> compose.Store:
    e = cut(extracted(spark, d))
    f = _functions(e).withColumn("line_start", F.col("k"))
    return compose.Store(f, extraction.call_table(e).where("caller <> 'routes'"), extraction.types(e).withColumn("line_start", _key("path")), e.where("NOT parse_error").select("repo_id", "path", "package", "language", "purpose"))


def _first_name(spark: SparkSession, d: str) -> str:
    return B.functions(spark, d).where("line_start % 97 <> 0").agg(F.min("name")).first()[0] or "none"


_NAME = f"(SELECT min(name) FROM {{fn}} WHERE {_OK})"


@query(f"SELECT repo_id, k FROM {{fn}} WHERE {_OK} AND lower(name) = lower({_NAME})")
def q_answer_function(spark, d):
    """Q6: what a function does."""
    return compose.answer(_store(spark, d), f"what does {_first_name(spark, d)} do").rows.select("repo_id", F.col("line_start").alias("k"))


@query(f"SELECT repo_id, {_TYPE} AS name, 2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n_fields FROM {{fn}} WHERE {_OK} AND k = (SELECT max(k) FROM {{fn}} WHERE {_OK})")
def q_answer_type(spark, d):
    """Q6: what a type is: types, not functions."""
    s = _store(spark, d)
    last = s.types.agg(F.max_by("name", "line_start")).first()[0] or "none"
    return compose.answer(s, f"what is the struct {last}").rows.select("repo_id", "name", F.size("fields").alias("n_fields"))


@query(f"SELECT repo_id, k FROM {{fn}} WHERE {_OK} AND k % 4 = 1")
def q_answer_side_effect(spark, d):
    """Q6: which functions do database work."""
    return compose.answer(_store(spark, d), "which functions do database work").rows.select("repo_id", F.col("line_start").alias("k"))


@query(f"SELECT repo_id, k FROM {{fn}} WHERE {_OK} AND k % 4 = 2")
def q_answer_http(spark, d):
    """Q6: functions that call other services."""
    return compose.answer(_store(spark, d), "find http calls").rows.select("repo_id", F.col("line_start").alias("k"))


@query(f"SELECT repo_id, k FROM {{fn}} WHERE {_OK} AND regexp_matches(lower(name), '{search.STORE_PATTERNS['crud'].replace(' ', '|')}')")
def q_answer_concept(spark, d):
    """Functions of a concept, its words mapped."""
    return compose.answer(_store(spark, d), "where do we create things").rows.select("repo_id", F.col("line_start").alias("k"))


@query(f"SELECT repo_id, k FROM {{fn}} WHERE {_OK} AND k % 3 > 0")
def q_answer_callers(spark, d):
    """Q6: who calls a function."""
    return compose.answer(_store(spark, d), "who calls work").rows.select("repo_id", _key("caller_path").alias("k"))


@query("WITH c AS (" + _CALLS + f"), f AS (SELECT repo_id, k FROM {{fn}} WHERE lower(name) = lower({_NAME})) SELECT f.repo_id, c.k, regexp_extract(call, '\\.(\\w+) ', 1) AS callee, CASE WHEN ends_with(call, ' internal') THEN 'internal' WHEN ends_with(call, ' stdlib') THEN 'stdlib' ELSE 'external' END AS origin FROM c JOIN f USING (k)")
def q_answer_calls(spark, d):
    """Q6: what a function calls, by origin."""
    return compose.answer(_store(spark, d), f"dependencies of {_first_name(spark, d)}").rows.select("repo_id", _key("caller_path").alias("k"), "callee", "origin")


@query("WITH c AS (" + _CALLS + f"), f AS (SELECT repo_id, k FROM {{fn}} WHERE lower(name) = lower({_NAME})) SELECT f.repo_id, c.k, regexp_extract(call, '\\.(\\w+) ', 1) AS callee FROM c JOIN f USING (k) WHERE ends_with(call, ' internal')")
def q_answer_flow(spark, d):
    """Q6: flow of a function: the calls inside the repository, with their summaries."""
    return compose.answer(_store(spark, d), f"trace {_first_name(spark, d)}").rows.select("repo_id", _key("path").alias("k"), "callee")


@query(f"SELECT repo_id, CAST(k AS VARCHAR) || '.go' AS path, 'p' || (k % 7) AS package FROM {{fn}} WHERE {_OK} AND contains(CAST(k AS VARCHAR) || '.go', '7.go')")
def q_answer_file(spark, d):
    """Q6: what files whose path holds a text are."""
    return compose.handle(_store(spark, d), "file", "7.go").select("repo_id", "path", "package")


@query("SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS dir, path, count(*) AS n_functions, count(*) FILTER (is_public) AS n_public FROM " + B.SQL["fn"] + " WHERE contains(path, 'corelib/errs') GROUP BY ALL")
def q_answer_package(spark, d):
    """Files of a package with their functions."""
    f = B.functions(spark, d)
    empty = spark.createDataFrame([], "repo_id string, path string, name string, kind string, line_start long")
    store = compose.Store(f, B.calls(spark, d), empty, f.select("repo_id", "path", "package").distinct())
    return compose.answer(store, "structure of the corelib/errs package").rows.select("dir", "path", "n_functions", "n_public")

"""Search over functions, files, types: pattern search, inverted index, hybrid merge, multi-repository keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import camel_words, clean_type_for_index, matches_all, package_of_path, search_keywords

# fixed values: synonyms of concepts, concepts of query words, prefixes and patterns of names, words of steps
SYNONYMS = {"auth": "authentication", "login": "authentication", "validate": "validation", "db": "database", "sql": "database", "api": "handler", "endpoint": "handler", "route": "handler"}
QUERY_CONCEPTS = {
    "auth": "authentication", "login": "authentication", "logout": "authentication", "validate": "validation", "check": "validation", "verify": "validation",
    "database": "database", "db": "database", "sql": "database", "query": "database", "http": "http", "api": "handler", "endpoint": "handler", "handler": "handler",
    "error": "error", "exception": "error", "cache": "cache", "store": "cache", "create": "crud", "read": "crud", "update": "crud", "delete": "crud", "get": "crud",
    "set": "crud", "list": "crud", "find": "crud", "middleware": "middleware", "intercept": "middleware",
}
NAME_PREFIXES = tuple("get set create delete update find handle process validate parse build new is has can".split())
INDEX_PATTERNS = {
    "authentication": "login logout auth authenticate token", "authorization": "authorize permission role access", "validation": "validate verify check is has can",
    "crud": "create read update delete get set add remove", "handler": "handle handler serve process", "middleware": "middleware interceptor filter",
    "transformation": "convert transform parse format encode decode", "initialization": "init setup configure new start", "cleanup": "close cleanup shutdown dispose teardown",
    "notification": "notify send emit publish broadcast", "subscription": "subscribe listen watch observe",
}
STORE_PATTERNS = {
    "authentication": "auth login logout session token", "validation": "valid check verify sanitize", "handler": "handler handle serve endpoint",
    "crud": "create read update delete get set list find", "middleware": "middleware intercept filter", "error": "error err fail panic",
    "database": "db query insert select repository repo", "http": "http request response api rest", "cache": "cache memo store", "config": "config setting option env",
}
STEP_CONCEPTS = (
    ("http", ("http",)), ("request", ("request",)), ("response", ("response",)), ("database query sql", ("database",)), ("file read write", ("file_io",)),
    ("json encode decode", ("json", "serialization")), ("validate check", ("validation",)), ("error", ("error_handling",)), ("auth token permission", ("authentication",)),
    ("log", ("logging",)), ("cache redis", ("caching",)), ("goroutine async concurrent", ("async", "concurrency")),
)


def _holds_any(text: Column, words: str) -> Column:
    out = F.lit(False)
    for w in words.split():
        out = out | F.contains(text, F.lit(w))
    return out


def _array_of(pairs: list[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds."""
    return F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]), lambda x: x.isNotNull())


def name_concepts(name: Column, taxonomy: str = "index") -> Column:
    """Concepts that occur in a name, by the taxonomy of the index or of the store."""
    low = F.lower(name)
    return _array_of([(_holds_any(low, words), c) for c, words in (INDEX_PATTERNS if taxonomy == "index" else STORE_PATTERNS).items()])


def step_concepts(steps: Column) -> Column:
    """Concepts that the words of behaviour steps tell; null steps tell none."""
    text = F.lower(F.concat_ws("\n", F.coalesce(steps, F.array().cast("array<string>"))))
    return F.array_distinct(_array_of([(_holds_any(text, words), c) for words, cs in STEP_CONCEPTS for c in cs]))


def query_concepts(query: Column) -> Column:
    """Distinct concepts of the words contained in a query."""
    low = F.lower(query)
    return F.array_sort(F.array_distinct(_array_of([(F.contains(low, F.lit(w)), c) for w, c in QUERY_CONCEPTS.items()])))


def concept_name(concept: Column) -> Column:
    """Canonical name of a concept, synonyms resolved; lower case."""
    low = F.lower(concept)
    out = low
    for a, c in SYNONYMS.items():
        out = F.when(low == a, c).otherwise(out)
    return out


def like_functions(functions: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Name, signature or description like ``%query%`` without regard to case; wildcards in the query work.

    Exact names first, then names that begin so, then by name; ties by path and line.
    """
    p = f"%{query}%"
    hit = F.col("name").ilike(p) | F.coalesce(F.col("signature").ilike(p), F.lit(False)) | F.coalesce(F.col("description").ilike(p), F.lit(False))
    rank = F.when(F.lower("name") == query.lower(), 0).when(F.col("name").ilike(f"{query}%"), 1).otherwise(2)
    return functions.where(hit).withColumn("rank", rank).orderBy("rank", "name", "path", "line_start").limit(limit)


def like_files(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    p = f"%{query}%"
    hit = F.lit(False)
    for c in ("path", "purpose", "package"):
        hit = hit | F.coalesce(F.col(c).ilike(p), F.lit(False))
    return files.where(hit).orderBy("path").limit(limit)


def like_types(types: DataFrame, query: str, limit: int = 50) -> DataFrame:
    p = f"%{query}%"
    return types.where(F.coalesce(F.col("name").ilike(p), F.lit(False)) | F.coalesce(F.col("description").ilike(p), F.lit(False))).orderBy("name", "path").limit(limit)


def by_label(labels: DataFrame, functions: DataFrame, column: str, value: str, limit: int = 100) -> DataFrame:
    """Functions with an effect or concept (equal, lower case), by path and line."""
    hit = labels.where(F.col(column) == value.lower()).select("repo_id", "path", "name", "line_start")
    return functions.join(hit, ["repo_id", "path", "name", "line_start"], "left_semi").orderBy("path", "line_start").limit(limit)


def hybrid(primary: DataFrame, secondary: DataFrame, limit: int = 50) -> DataFrame:
    """Primary results, then secondary ones, each place (path, name, line) once, at most ``limit``.

    Both have path, name, line_start and pos, the place in their own order.
    """
    both = primary.withColumn("source", F.lit(0)).unionByName(secondary.withColumn("source", F.lit(1)))
    w = Window.partitionBy("path", "name", "line_start").orderBy("source", "pos")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").orderBy("source", "pos", "path", "name").limit(limit)


def build_index(functions: DataFrame, taxonomy: str = "index") -> DataFrame:
    """Inverted index of functions: repo_id, kind, term, path, name, line_start.

    Kinds: name (whole and camel words of three letters or more), concept (prefixes, name patterns, steps, patterns),
    effect, type (parameters, returns), package. Columns that are absent count as empty.
    """
    have = set(functions.columns)
    none = F.array().cast("array<string>")
    opt = lambda c: F.coalesce(F.col(c), none) if c in have else none
    low = F.lower("name")
    terms = lambda kind, a: F.transform(a, lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(t).alias("term")))
    prefixes = _array_of([(low.startswith(p), p + "_operation") for p in NAME_PREFIXES])
    every = F.concat(
        terms("name", F.concat(F.array(low), F.filter(camel_words("name"), lambda w: F.octet_length(w) >= 3))),
        terms("concept", F.concat(prefixes, name_concepts(F.col("name"), taxonomy), step_concepts(opt("steps")), opt("patterns"))),
        terms("effect", opt("side_effects")),
        terms("type", F.transform(F.concat(opt("param_types"), opt("returns")), clean_type_for_index)),
        terms("package", F.array(package_of_path("path"))),
    )
    return functions.select("repo_id", "path", "name", "line_start", F.explode(every).alias("t")).where(F.col("t.term") != "").select("repo_id", "t.kind", "t.term", "path", "name", "line_start")


def build_local_index(functions: DataFrame) -> DataFrame:
    """The smaller index of a local project: whole names, effects, patterns (as concepts) and kinds of errors.

    ``functions``: repo_id, path, name, line_start, side_effects, patterns, error_kinds.
    """
    none = F.array().cast("array<string>")
    terms = lambda kind, a: F.transform(a, lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(t).alias("term")))
    every = F.concat(terms("name", F.array("name")), terms("effect", F.coalesce("side_effects", none)), terms("concept", F.coalesce("patterns", none)), terms("error", F.coalesce("error_kinds", none)))
    return functions.select("repo_id", "path", "name", "line_start", F.explode(every).alias("t")).where(F.col("t.term") != "").select("repo_id", "t.kind", "t.term", "path", "name", "line_start")


def build_type_index(types: DataFrame) -> DataFrame:
    """Index terms of types: own name and field types (type), kind and camel words of three letters or more (concept)."""
    terms = lambda kind, a: F.transform(a, lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(t).alias("term")))
    every = F.concat(
        terms("type", F.concat(F.array("name"), F.transform(F.transform(F.col("fields"), lambda f: f["type"]), clean_type_for_index))),
        terms("concept", F.concat(F.array("kind"), F.filter(camel_words("name"), lambda w: F.octet_length(w) >= 3))),
    )
    return types.select("repo_id", "path", "name", "line_start", F.explode(every).alias("t")).where(F.col("t.term") != "").select("repo_id", "t.kind", "t.term", "path", "name", "line_start")


def build_route_index(routes: DataFrame) -> DataFrame:
    """Index terms of routes: method and path segments of two bytes or more, without ``:`` and braces."""
    segs = F.transform(F.split("route", "/"), lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, r"^:?\{?", ""), r"\}$", "")))
    every = F.concat(F.array(F.lower("method")), F.filter(segs, lambda s: F.octet_length(s) >= 2))
    return routes.select("repo_id", "path", F.col("handler").alias("name"), F.col("line").alias("line_start"), F.explode(every).alias("term")).select("repo_id", F.lit("route").alias("kind"), "term", "path", "name", "line_start")


def lookup_functions(index: DataFrame, query: str) -> DataFrame:
    """Functions by exact or partial name term or by concept; exact names first, each (path, name) once, last line holds."""
    q = query.lower()
    hit = index.where(((F.col("kind") == "name") & F.contains("term", F.lit(q))) | ((F.col("kind") == "concept") & (F.col("term") == q)))
    return hit.groupBy("repo_id", "path", "name").agg(F.max("line_start").alias("line_start")).orderBy(F.desc(F.lower("name") == q), "name", "path", "repo_id")


def lookup(index: DataFrame, kind: str, term: str) -> DataFrame:
    """Entries of one kind with a term; routes match by substring."""
    t = F.contains("term", F.lit(term.lower())) if kind == "route" else F.col("term") == term.lower()
    return index.where((F.col("kind") == kind) & t)


def keyword_search(functions: DataFrame, types: DataFrame, files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Functions, types and files of which one field holds all keywords; ordered by kind, repository, path, name.

    At most 100 rows; 20 unless asked otherwise.
    """
    kws = search_keywords(F.lit(query))
    n = 20 if limit <= 0 else min(limit, 100)

    def of(df: DataFrame, kind: str, name: str, *fields: str) -> DataFrame:
        hit = F.lit(False)
        for f in fields:
            hit = hit | matches_all(f, kws)
        return df.where(hit).select(F.lit(kind).alias("kind"), "repo_id", "path", F.col(name).alias("name"))

    all_ = of(functions, "function", "name", "name", "description", "signature").unionByName(of(types, "type", "name", "name", "description")).unionByName(of(files, "file", "path", "path", "purpose"))
    return all_.orderBy(F.when(F.col("kind") == "function", 0).when(F.col("kind") == "type", 1).otherwise(2), "repo_id", "path", "name").limit(n)

"""Queries of the reference operators (sources, filters, joins, aggregates, search, graph, comparison, ranking) with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import changes, compare, embedding, extraction, graph, impact, org, rank, router, search
from ..operators import usage as U
from ..session import table
from ..sources import files as S
from . import bindings as B
from . import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``{fn}`` and the like in its SQL stand for the bound views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            out = sql
            for k, v in B.SQL.items():
                out = out.replace("{" + k + "}", v)
            SQL[f.__name__] = out
        return f

    return add


# --- sources ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, CASE WHEN text IS NULL THEN 1 ELSE strlen(text) - strlen(replace(text, chr(10), '')) + 1 END AS line_count FROM documents")
def s_content_hash(spark, d):
    """Whole SHA-256 and line count of every text."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("hash"), S.line_count(t).cast("long").alias("line_count"))


@query("""SELECT language, count(*) AS n FROM (SELECT DISTINCT file_path, CASE lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript'
  WHEN 'yaml' THEN 'yaml' WHEN 'json' THEN 'json' WHEN 'sql' THEN 'sql' WHEN 'sh' THEN 'shell' ELSE 'unknown' END AS language FROM (SELECT file_path FROM graph_nodes UNION ALL SELECT file_path FROM pr_files)) GROUP BY 1""")
def a_language_breakdown(spark, d):
    """Files by language."""
    p = table(spark, d, "graph_nodes").select("file_path").unionByName(table(spark, d, "pr_files").select("file_path")).distinct()
    return p.groupBy(S.language(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT repo_id, path FROM {fn} WHERE NOT (contains(path, 'handlers') OR ends_with(path, 'handlers')) AND NOT ends_with(path, '.ts') AND NOT starts_with(path, 'corelib/errs') AND NOT regexp_matches(path, '(^|/)\\.git(/|$)')""")
def s_scan_kept(spark, d):
    """Files that the exclude patterns keep."""
    return B.functions(spark, d).where(~S.excluded(F.col("path"), ["**/handlers", "*.ts", "corelib/errs/**", "nothing"])).select("repo_id", "path").distinct()


@query("""SELECT DISTINCT file_path AS path, CASE WHEN contains(lower(file_path), 'readme') THEN 'Project documentation' WHEN contains(lower(file_path), 'license') THEN 'License file' WHEN contains(lower(file_path), 'dockerfile') THEN 'Docker container definition'
  WHEN contains(lower(file_path), 'makefile') THEN 'Build automation' WHEN contains(lower(file_path), 'config') THEN 'Configuration file' WHEN contains(lower(file_path), 'test') THEN 'Test file' WHEN regexp_matches(lower(file_path), '\\.ya?ml$') THEN 'YAML configuration'
  WHEN ends_with(lower(file_path), '.json') THEN 'JSON data/configuration' WHEN ends_with(lower(file_path), '.sql') THEN 'SQL database script' WHEN ends_with(lower(file_path), '.sh') THEN 'Shell script' ELSE 'x source file' END AS purpose FROM pr_files""")
def x_file_purpose(spark, d):
    """Purpose of files that no parser knows."""
    return table(spark, d, "pr_files").select(F.col("file_path").alias("path"), S.purpose(F.col("file_path"), F.lit("x")).alias("purpose")).distinct()


@query("""WITH p AS (SELECT pr_id, regexp_extract_all(diff, '(?m)^diff --git a/.*? b/([^\\n\\r]*)', 1) AS f FROM pull_requests WHERE diff IS NOT NULL)
SELECT pr_id, CAST(unnest(range(len(f))) AS INT) AS position, unnest(f) AS file_path FROM p""")
def s_split_diff(spark, d):
    """Files of every unified diff, in order."""
    return S.split_diff(table(spark, d, "pull_requests"), "pr_id", "diff").select("pr_id", "position", "file_path")


@query("""SELECT repo_id, max(analyzed_at) AS analyzed_at FROM repo_snapshots WHERE analyzed_at >= TIMESTAMP '2025-06-01' - INTERVAL 30 DAY GROUP BY 1""")
def s_fresh_contexts(spark, d):
    """Repositories analysed in the last 30 days before a given time."""
    t = S.fresh(table(spark, d, "repo_snapshots").withColumn("analyzed_at", F.col("analyzed_at").cast("timestamp_ntz")), F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00")), 30 * 86400)
    return t.groupBy("repo_id").agg(F.max("analyzed_at").alias("analyzed_at"))


@query("SELECT vec_id, label FROM embeddings WHERE label >= 5 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE label < 5")
def s_vector_upsert(spark, d):
    """Rows put in place by key."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    return S.upsert(v, v.where("label < 5").withColumn("label", (F.col("label") + 100).cast(v.schema["label"].dataType)), ["vec_id"])


@query("SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (1, 3) GROUP BY 1")
def s_vector_delete(spark, d):
    """Scopes deleted, the rest counted."""
    v = table(spark, d, "embeddings")
    return S.without(v, v.where(F.col("label").isin(1, 3)), ["label"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT pr_id, string_split(chr(10) || diff, chr(10) || 'diff --git a/')[2:] AS f FROM pull_requests WHERE diff IS NOT NULL)
SELECT pr_id, CAST(i - 1 AS INT) AS position, CAST(length(f[i]) + 13 + CASE WHEN i < len(f) THEN 1 ELSE 0 END AS INT) AS n_chars FROM (SELECT pr_id, f, unnest(range(1, len(f) + 1)) AS i FROM p)""")
def s_diff_patches(spark, d):
    """The patch of every file, to its last character."""
    return S.split_diff(table(spark, d, "pull_requests"), "pr_id", "diff").select("pr_id", "position", F.length("patch").alias("n_chars"))


@query("SELECT pr_file_id, CASE WHEN regexp_matches(patch, '(?m)^new file mode ') THEN 'added' WHEN regexp_matches(patch, '(?m)^deleted file mode ') THEN 'removed' WHEN regexp_matches(patch, '(?m)^rename from ') THEN 'renamed' ELSE 'modified' END AS status FROM (SELECT DISTINCT pr_file_id, patch FROM pr_files WHERE patch IS NOT NULL)")
def s_patch_status(spark, d):
    """Kind of change by the lines of a patch."""
    return table(spark, d, "pr_files").where("patch IS NOT NULL").select("pr_file_id", "patch").distinct().select("pr_file_id", S.patch_status(F.col("patch")).alias("status"))


@query("SELECT repo_id, snapshot_no, analyzed_at, row_number() OVER (ORDER BY analyzed_at DESC, repo_id, snapshot_no) AS place FROM (SELECT DISTINCT repo_id, snapshot_no, analyzed_at FROM repo_snapshots) QUALIFY place <= 100")
def s_listing(spark, d):
    """Contexts, the latest analysed first, a page of a hundred."""
    r = table(spark, d, "repo_snapshots").select("repo_id", "snapshot_no", "analyzed_at").distinct()
    w = Window.orderBy(F.desc("analyzed_at"), "repo_id", "snapshot_no")
    return S.listing(r, ["repo_id", "snapshot_no"], 100).withColumn("place", F.row_number().over(w).cast("long"))


@query("SELECT DISTINCT id, name, total, version FROM (SELECT 'v' || (vec_id % 500) AS id, max(vec_id) AS m, 'n' || max(vec_id) AS name, map(['label'], [CAST(arg_max(label, vec_id) AS VARCHAR)])['label'] AS total, 'new' AS version FROM embeddings WHERE vec_id % 3 > 0 GROUP BY 1 UNION ALL SELECT 'v' || (vec_id % 500), max(vec_id), 'n' || max(vec_id), map(['label'], [CAST(arg_max(label, vec_id) AS VARCHAR)])['label'], 'old' FROM embeddings WHERE vec_id % 3 = 0 AND 'v' || (vec_id % 500) NOT IN (SELECT 'v' || (vec_id % 500) FROM embeddings WHERE vec_id % 3 > 0) GROUP BY 1)")
def s_store_upsert(spark, d):
    """Rows with maps and arrays put in place by key; of several the last by order holds."""
    v = table(spark, d, "embeddings")
    row = lambda df, version: df.select(F.concat(F.lit("v"), F.col("vec_id") % 500).alias("id"), F.concat(F.lit("n"), "vec_id").alias("name"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.col("embedding").alias("vector"), F.col("vec_id").alias("at"), F.lit(version).alias("version"))
    held = S.upsert(row(v.where("vec_id % 3 = 0"), "old").where(F.lit(False)), row(v.where("vec_id % 3 = 0"), "old"), ["id"], order="at")
    return S.upsert(held, row(v.where("vec_id % 3 > 0"), "new"), ["id"], order="at").select("id", "name", F.col("metadata")["label"].alias("total"), "version")


# --- text ---------------------------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_|\\.|/|::', ' ', 'g')), '[^\\p{L}\\p{Nd}]+'), lambda t: strlen(t) >= 2 AND NOT list_contains([%s], t))" % ", ".join(f"'{w}'" for w in dict.fromkeys(X.EMBED_STOP))


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens FROM documents WHERE text IS NOT NULL")
def c_code_tokens(spark, d):
    """Number of embedding tokens of every text."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(X.code_tokens("text")).cast("long").alias("n_tokens"))


@query("SELECT doc_id, CAST(floor(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS tokens FROM documents")
def c_token_estimate(spark, d):
    """Tokens estimated from bytes."""
    return table(spark, d, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS df FROM w GROUP BY 1")
def a_document_frequency(spark, d):
    """Documents that have each word."""
    return embedding.document_frequency(table(spark, d, "documents"), "text")


_VOCAB = f"WITH w AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS word FROM documents WHERE text IS NOT NULL), f AS (SELECT word, count(*) AS df FROM w GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), v AS (SELECT word, df, row_number() OVER (ORDER BY df DESC, word) - 1 AS rank FROM f)"


@query(_VOCAB + " SELECT word, df, rank, rank % 256 AS slot, round(ln((n + 1) / (df + 1)), 6) AS idf FROM v, n WHERE rank < 2000")
def w_vocabulary(spark, d):
    """Vocabulary with ranks, slots and idf."""
    return embedding.vocabulary(table(spark, d, "documents"), "text", 2000).select("word", "df", F.col("rank").cast("long").alias("rank"), F.col("slot").cast("long").alias("slot"), F.round("idf", 6).alias("idf"))


@query(
    _VOCAB
    + f""", x AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, word, count(*) AS c FROM x GROUP BY ALL)
SELECT doc_id, CAST(rank % 256 AS INT) AS slot, round(sum((1 + ln(c)) * CASE WHEN ln((n + 1) / (df + 1)) = 0 THEN 1 ELSE ln((n + 1) / (df + 1)) END), 6) AS weight FROM tf JOIN v USING (word), n GROUP BY ALL"""
)
def c_term_weights(spark, d):
    """Weight of every slot of every text, over the whole vocabulary."""
    docs = table(spark, d, "documents")
    terms = embedding.term_counts(docs.where("text IS NOT NULL"), "doc_id", "text")
    vocab = embedding.ranked_vocabulary(embedding.frequencies(terms), docs.count())
    return embedding.weights(terms, vocab).select(F.col("key").alias("doc_id"), "slot", F.round("weight", 6).alias("weight"))


@query()
def q_embed(spark, d):
    """Unit vectors of all texts, all slots that hold something."""
    v, _ = embedding.index(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return v.select(F.col("key").alias("doc_id"), F.posexplode(F.transform("vector", lambda x: F.round(x, 6))).alias("slot", "x")).where("x <> 0")


def _kw_sql(stop: tuple, trim: str, least: int) -> str:
    words = f"list_transform(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> ''), lambda w: trim(w, '{trim.replace(chr(39), chr(39) * 2)}'))"
    return f"list_filter({words}, lambda w: strlen(w) >= {least} AND NOT list_contains([{', '.join(repr(w) for w in dict.fromkeys(stop))}], w))"


@query(f"SELECT pr_id, array_to_string(CASE WHEN len({_kw_sql(X.SEARCH_STOP, X.TRIM, 2)}) > 0 THEN {_kw_sql(X.SEARCH_STOP, X.TRIM, 2)} ELSE {_kw_sql((), X.TRIM, 1).replace('AND NOT list_contains([], w)', '')} END, '|') AS keywords FROM {{titles}}")
def f_search_keywords(spark, d):
    """search keywords of queries."""
    return B.titles(spark, d).select("pr_id", F.array_join(X.search_keywords("query"), "|").alias("keywords"))


@query(f"SELECT pr_id, array_to_string({_kw_sql(X.ASK_STOP, X.ASK_TRIM, 3)}, '|') AS keywords FROM {{titles}}")
def f_ask_keywords(spark, d):
    """keywords of questions."""
    return B.titles(spark, d).select("pr_id", F.array_join(X.ask_keywords("query"), "|").alias("keywords"))


@query("SELECT line_start, CASE WHEN regexp_matches(lower(name), '^(get|list|fetch)') THEN 'GET' WHEN regexp_matches(lower(name), '^(create|post|add)') THEN 'POST' WHEN regexp_matches(lower(name), '^(update|put|edit)') THEN 'PUT' WHEN regexp_matches(lower(name), '^(delete|remove)') THEN 'DELETE' WHEN starts_with(lower(name), 'handle') THEN 'ANY' ELSE '' END AS verb FROM {fn}")
def x_verb_guess(spark, d):
    """HTTP verbs that names suggest."""
    return B.functions(spark, d).select("line_start", X.verb_of_name("name").alias("verb"))


@query("SELECT line_start, lower(trim(regexp_replace(name, '([A-Z])', ' \\1', 'g'))) AS words FROM {fn}")
def x_camel_words(spark, d):
    """Words of camel-case names."""
    return B.functions(spark, d).select("line_start", F.array_join(X.camel_words("name"), " ").alias("words"))


@query("""WITH l AS (SELECT pr_file_id, unnest(string_split(patch, chr(10))) AS line FROM (SELECT DISTINCT pr_file_id, patch FROM pr_files WHERE patch IS NOT NULL)), u AS (SELECT pr_file_id, upper(line) AS u FROM l),
t AS (SELECT pr_file_id, lower(coalesce(nullif(regexp_extract(u, 'FROM\\s+(\\w+)', 1), ''), nullif(regexp_extract(u, 'INSERT\\s+INTO\\s+(\\w+)', 1), ''), nullif(regexp_extract(u, 'UPDATE\\s+(\\w+)', 1), ''))) AS t FROM u) SELECT t AS table_name, count(DISTINCT pr_file_id) AS n FROM t WHERE t IS NOT NULL GROUP BY 1""")
def x_sql_tables(spark, d):
    """Tables that SQL in patches names, with the number of patches."""
    p = table(spark, d, "pr_files").where("patch IS NOT NULL").select("pr_file_id", "patch").distinct()
    lines = p.select("pr_file_id", F.explode(F.split("patch", "\n")).alias("line"))
    return lines.select("pr_file_id", X.sql_table("line").alias("table_name")).where("table_name IS NOT NULL").groupBy("table_name").agg(F.count_distinct("pr_file_id").alias("n"))


@query("SELECT line_start, CASE WHEN regexp_matches(path, '^.+/[^/]*$') THEN regexp_extract(path, '^(.+)/[^/]*$', 1) ELSE '' END AS dir, string_split(path, '/')[-1] AS base, coalesce(string_split(path, '/')[-2], '') AS package FROM {fn}")
def c_path_functions(spark, d):
    """Directory, base name and package of paths."""
    return B.functions(spark, d).select("line_start", X.dirname("path").alias("dir"), X.basename("path").alias("base"), X.package_of_path("path").alias("package"))


@query("SELECT DISTINCT repo_id, replace(replace(repo_id, '/', '_'), ':', '_') AS file_name FROM graph_nodes")
def k_file_names(spark, d):
    """Names of repositories that are safe for files."""
    return table(spark, d, "graph_nodes").select("repo_id", X.file_safe("repo_id").alias("file_name")).distinct()


# --- filters and search -------------------------------------------------------------------------------------------------


@query("SELECT line_start FROM {fn} WHERE (contains(lower(name), 'order') AND contains(lower(name), 'a')) OR (contains(lower(signature), 'order') AND contains(lower(signature), 'a'))")
def f_all_keywords(spark, d):
    """functions of which the name or the signature holds all keywords."""
    k = F.array(F.lit("order"), F.lit("a"))
    return B.functions(spark, d).where(X.matches_all("name", k) | X.matches_all("signature", k)).select("line_start")


@query("SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND (contains(lower(text), 'cache') OR contains(lower(text), 'stale'))")
def f_any_word(spark, d):
    """texts with any longer word of a query."""
    return table(spark, d, "documents").where("text IS NOT NULL").where(X.matches_any("text", F.lit("is the cache stale"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, path, line_start FROM {fn} WHERE name ILIKE '%plan%' OR signature ILIKE '%plan%' ORDER BY CASE WHEN lower(name) = 'plan' THEN 0 WHEN name ILIKE 'plan%' THEN 1 ELSE 2 END, name, path, line_start LIMIT 50")
def f_like_functions(spark, d):
    """Pattern search over functions, ranked, the first 50."""
    return search.like_functions(B.functions(spark, d).withColumn("description", F.lit(None).cast("string")), "plan").select("name", "path", "line_start")


@query("SELECT DISTINCT path FROM {fn} WHERE path ILIKE '%models%' ORDER BY path LIMIT 50")
def f_like_files(spark, d):
    """pattern search over files."""
    f = B.functions(spark, d).select("path").distinct().withColumn("purpose", F.lit(None).cast("string")).withColumn("package", F.lit(None).cast("string"))
    return search.like_files(f, "models").select("path")


@query("SELECT p_name AS name, p_brand AS path FROM part WHERE p_name ILIKE '%a%' ORDER BY 1, 2 LIMIT 50")
def f_like_types(spark, d):
    """pattern search over types (parts by name)."""
    t = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.lit(None).cast("string").alias("description"))
    return search.like_types(t, "a").select("name", "path")


_SC = " + ".join(f"CASE WHEN regexp_matches(lower(query), '{'|'.join(w for w, c in search.QUERY_CONCEPTS.items() if c == k)}') THEN ['{k}'] ELSE [] END" for k in sorted(set(search.QUERY_CONCEPTS.values()))).replace(" + ", " || ")


@query(f"SELECT pr_id, array_to_string({_SC}, '|') AS concepts FROM {{titles}}")
def f_query_concepts(spark, d):
    """concepts of queries."""
    return B.titles(spark, d).select("pr_id", F.array_join(search.query_concepts(F.col("query")), "|").alias("concepts"))


def _concepts(spark, d, taxonomy):
    return B.functions(spark, d).select("line_start", F.explode(search.name_concepts(F.col("name"), taxonomy)).alias("concept"))


def _concept_sql(patterns: dict) -> str:
    return " UNION ALL ".join(f"SELECT line_start, '{c}' AS concept FROM {{fn}} WHERE regexp_matches(lower(name), '{'|'.join(w.split())}')" for c, w in patterns.items())


@query(f"SELECT concept, count(*) AS n FROM ({_concept_sql(search.INDEX_PATTERNS)}) GROUP BY 1")
def a_concept_histogram(spark, d):
    """Functions by concept, index taxonomy."""
    return _concepts(spark, d, "index").groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT concept, count(*) AS n FROM ({_concept_sql(search.STORE_PATTERNS)}) GROUP BY 1")
def a_concept_histogram_store(spark, d):
    """Functions by concept, store taxonomy."""
    return _concepts(spark, d, "store").groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT f.path, f.name, f.line_start FROM {{fn}} f JOIN (SELECT * FROM ({_concept_sql(search.STORE_PATTERNS)}) WHERE concept = 'authentication') c USING (line_start) ORDER BY 1, 3 LIMIT 100")
def j_by_concept(spark, d):
    """Functions of a concept asked by its synonym."""
    f = B.functions(spark, d)
    labels = f.select("repo_id", "path", "name", "line_start", F.explode(search.name_concepts(F.col("name"), "store")).alias("concept"))
    return search.by_label(labels, f, "concept", search.SYNONYMS["login"]).select("path", "name", "line_start")


@query("SELECT line_start FROM {fn} WHERE regexp_matches(name, '^[A-Z]') AND lower(package) = 'handlers'")
def f_public(spark, d):
    """public functions of a package named without regard to case."""
    return B.functions(spark, d).where(X.is_public_name("name") & (F.lower("package") == "HANDLERS".lower())).select("line_start")


@query("SELECT min(path) AS path FROM {fn} WHERE ends_with(path, '.go') OR contains(path, 'x')")
def f_path_match(spark, d):
    """one file for a part of a path, always the smallest."""
    return B.functions(spark, d).where(F.col("path").endswith(".go") | F.contains("path", F.lit("x"))).agg(F.min("path").alias("path"))


@query("SELECT array_to_string(string_split(path, '/')[1:2], '/') AS package, count(DISTINCT path) AS n_files, count(*) AS n_functions FROM {fn} WHERE contains(path, 'handlers') GROUP BY 1")
def f_package_structure(spark, d):
    """files of packages by their two leading path segments."""
    return B.functions(spark, d).where(F.contains("path", F.lit("handlers"))).groupBy(F.substring_index("path", "/", 2).alias("package")).agg(F.count_distinct("path").alias("n_files"), F.count(F.lit(1)).alias("n_functions"))


@query("SELECT line_start, 'func:' || repo_id || ':' || path || ':' || name AS detail_ref, CASE WHEN length(signature) > 100 THEN substr(signature, 1, 97) || '...' ELSE signature END AS summary FROM {fn}")
def f_compact_refs(spark, d):
    """references and cut summaries."""
    return B.functions(spark, d).select("line_start", F.concat(F.lit("func:"), "repo_id", F.lit(":"), "path", F.lit(":"), "name").alias("detail_ref"), X.ellipsis("signature", 100).alias("summary"))


@query("SELECT repo_id, name, signature, path FROM {fn} WHERE is_public")
def f_public_resource(spark, d):
    """public functions as a resource."""
    return B.functions(spark, d).where("is_public").select("repo_id", "name", "signature", "path")


@query("SELECT DISTINCT repo_id, 'repo://' || repo_id || '/' || k AS uri FROM graph_nodes, (VALUES ('overview'), ('architecture'), ('functions'), ('types')) v(k)")
def k_resources(spark, d):
    """Four resources per repository."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("overview", "architecture", "functions", "types")]))
    return table(spark, d, "graph_nodes").select("repo_id").distinct().select("repo_id", kinds.alias("k")).select("repo_id", F.concat(F.lit("repo://"), "repo_id", F.lit("/"), "k").alias("uri"))


@query("""WITH a AS (SELECT path, name, line_start, 0 AS source, row_number() OVER (ORDER BY name, path, line_start) AS pos FROM {fn} WHERE contains(lower(name), 'order')), b AS (SELECT path, name, line_start, 1 AS source, row_number() OVER (ORDER BY path, line_start) AS pos FROM {fn} WHERE contains(lower(name), 'auth')),
m AS (SELECT *, row_number() OVER (PARTITION BY path, name, line_start ORDER BY source, pos) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT path, name, line_start FROM m WHERE r = 1 ORDER BY source, pos, path, name LIMIT 50""")
def u_hybrid(spark, d):
    """Two searches merged, each place once, the first 50."""
    f = B.functions(spark, d).select("path", "name", "line_start")
    # 50 rows at most of each can appear, so only they are numbered
    a = f.where(F.contains(F.lower("name"), F.lit("order"))).orderBy("name", "path", "line_start").limit(50).withColumn("pos", F.row_number().over(Window.orderBy("name", "path", "line_start")))
    b = f.where(F.contains(F.lower("name"), F.lit("auth"))).orderBy("path", "line_start").limit(100).withColumn("pos", F.row_number().over(Window.orderBy("path", "line_start")))
    return search.hybrid(a, b).select("path", "name", "line_start")


_IDX = """WITH t AS (SELECT repo_id, path, name, line_start, 'name' AS kind, lower(name) AS term FROM {fn} UNION ALL
SELECT repo_id, path, name, line_start, 'name', unnest(list_filter(string_split(lower(trim(regexp_replace(name, '([A-Z])', ' \\1', 'g'))), ' '), lambda w: strlen(w) >= 3)) FROM {fn} UNION ALL
SELECT repo_id, path, name, line_start, 'package', coalesce(string_split(path, '/')[-2], '') FROM {fn})"""


@query(_IDX + " SELECT kind, term, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL")
def q_index_names(spark, d):
    """Q1, Q2: postings of the name and package indexes."""
    return search.build_index(B.functions(spark, d)).where(F.col("kind").isin("name", "package")).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT line_start, unnest([" + ", ".join(f"CASE WHEN starts_with(lower(name), '{p}') THEN '{p}_operation' END" for p in search.NAME_PREFIXES) + f"]) AS concept FROM {{fn}} UNION ALL {_concept_sql(search.INDEX_PATTERNS)}) SELECT concept AS term, count(*) AS n FROM c WHERE concept IS NOT NULL GROUP BY 1")
def q_index_concepts(spark, d):
    """Q1: postings of the concept index."""
    return search.build_index(B.functions(spark, d)).where("kind = 'concept'").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(_IDX + " SELECT repo_id, path, name, max(line_start) AS line_start FROM t WHERE kind = 'name' AND contains(term, 'ledger') GROUP BY ALL")
def q_lookup(spark, d):
    """Lookup of a term in the index."""
    return search.lookup_functions(search.build_index(B.functions(spark, d)), "ledger")


@query("""SELECT kind, repo_id, path, name FROM (SELECT 0 AS o, 'function' AS kind, repo_id, path, name FROM {fn} WHERE contains(lower(name), 'shard') OR contains(lower(signature), 'shard') UNION ALL
SELECT 1, 'type', p_brand, p_type, p_name FROM part WHERE contains(lower(p_name), 'shard') UNION ALL SELECT DISTINCT 2, 'file', repo_id, path, path FROM {fn} WHERE contains(lower(path), 'shard')) ORDER BY o, repo_id, path, name LIMIT 100""")
def q_keyword_search(spark, d):
    """Keywords over functions and files of all repositories."""
    none = F.lit(None).cast("string")
    f = B.functions(spark, d).withColumn("description", none)
    types = table(spark, d, "part").select(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("path"), F.col("p_name").alias("name"), none.alias("description"))
    files = f.select("repo_id", "path").distinct().withColumn("purpose", none)
    return search.keyword_search(f, types, files, "the shard", 100)


@query("SELECT pr_id, CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{w}') THEN '{k}'" for k, w in (("architecture", "architecture|structure|design|pattern|layer|module|component|organized|layout"), ("compare", "compare|difference|different|versus|vs|between|similar"), ("explain", "how does|how do|explain|what does|why does|describe|works"), ("search", "where is|find|locate|which file|search|looking for"))) + " ELSE 'general' END AS kind FROM {titles}")
def q_question_kind(spark, d):
    """Q7: kinds of questions."""
    return B.titles(spark, d).select("pr_id", rank.query_type(F.col("query")).alias("kind"))


# --- joins and graph ----------------------------------------------------------------------------------------------------


@query("SELECT f.line_start, x.line_count FROM {fn} f JOIN {files} x ON f.repo_id = x.repo_id AND regexp_replace(f.path, '^[^/]*/', '') = x.path")
def j_functions_files(spark, d):
    """Functions with their files."""
    f = B.functions(spark, d).withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    return f.join(B.files(spark, d), ["repo_id", "path"]).select("line_start", "line_count")


@query("SELECT DISTINCT c.repo_id, c.caller_path, c.caller, c.callee FROM {calls} c JOIN {fn} f ON f.name = c.callee AND f.repo_id = c.repo_id")
def j_callers(spark, d):
    """Callers of every known name."""
    c, f = B.calls(spark, d), B.functions(spark, d)
    return c.join(f.select("repo_id", F.col("name").alias("callee")).distinct(), ["repo_id", "callee"]).select("repo_id", "caller_path", "caller", "callee").distinct()


@query("SELECT repo_id, caller, count(*) AS n_calls, count(DISTINCT callee) AS n_callees, min(line) AS first_line FROM {calls} GROUP BY ALL")
def j_callees(spark, d):
    """What every function calls, counted."""
    return B.calls(spark, d).groupBy("repo_id", "caller").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("callee").alias("n_callees"), F.min("line").alias("first_line"))


_INT = "(coalesce(callee_package, '') = '' OR coalesce(call_type, '') IN ('', 'internal'))"


@query(f"SELECT DISTINCT c.repo_id, concat_ws(':', c.caller_path, c.caller) AS from_id, f.path || ':' || f.name AS to_id, c.line, coalesce(c.call_type, 'direct') AS call_type FROM {{calls}} c JOIN {{fn}} f ON f.repo_id = c.repo_id AND f.name = c.callee WHERE {_INT}")
def j_resolve_all(spark, d):
    """Internal calls linked with every file that has the name."""
    return graph.resolve_calls(B.calls(spark, d), B.functions(spark, d))


@query(f"SELECT DISTINCT c.repo_id, concat_ws(':', c.caller_path, c.caller) AS from_id, f.path || ':' || f.name AS to_id, c.line, coalesce(c.call_type, 'direct') AS call_type FROM {{calls}} c JOIN (SELECT repo_id, name, min(path) AS path FROM {{fn}} GROUP BY ALL) f ON f.repo_id = c.repo_id AND f.name = c.callee WHERE {_INT}")
def j_resolve_first(spark, d):
    """Internal calls linked with the smallest path that has the name."""
    return graph.resolve_calls(B.calls(spark, d), B.functions(spark, d), "first")


@query(f"SELECT f.repo_id, f.path, f.name, count(c.callee) AS n_callers FROM (SELECT DISTINCT repo_id, path, name FROM {{fn}}) f LEFT JOIN (SELECT * FROM {{calls}} WHERE {_INT}) c ON c.repo_id = f.repo_id AND c.callee = f.name GROUP BY ALL")
def j_called_by(spark, d):
    """Callers of every function, counted."""
    return graph.called_by(B.calls(spark, d), B.functions(spark, d))


@query("SELECT DISTINCT repo_id, caller_path, callee, coalesce(callee_package, '') AS callee_package FROM {calls}")
def k_file_calls(spark, d):
    """K8: distinct calls of every file."""
    return graph.file_calls(B.calls(spark, d))


_START = "SELECT min(from_id) AS node FROM {edges}"


@query(f"""WITH RECURSIVE r AS (SELECT node, 0 AS level FROM ({_START}) UNION SELECT e.to_id, r.level + 1 FROM r JOIN {{edges}} e ON e.from_id = r.node WHERE r.level < 3) SELECT node, min(level) AS level FROM r GROUP BY 1""")
def q_bfs(spark, d):
    """Q17: functions reached from the smallest id within three calls."""
    e = B.edges(spark, d)
    return graph.bfs(e, e.agg(F.min("from_id").alias("node")), 3)


@query(f"""WITH RECURSIVE r AS (SELECT node, 0 AS level FROM ({_START}) UNION SELECT e.to_id, r.level + 1 FROM r JOIN {{edges}} e ON e.from_id = r.node WHERE r.level < 2), l AS (SELECT node, min(level) AS level FROM r GROUP BY 1)
SELECT l.node, l.level, min(e.from_id) AS parent FROM l LEFT JOIN (SELECT e.from_id, e.to_id, p.level FROM {{edges}} e JOIN l p ON p.node = e.from_id) e ON e.to_id = l.node AND e.level = l.level - 1 GROUP BY ALL""")
def q_call_tree(spark, d):
    """Call tree of the smallest id, two levels."""
    e = B.edges(spark, d)
    return graph.call_tree(e, e.agg(F.min("from_id")).first()[0] or "", 2)


@query("""SELECT '  "' || replace(replace(from_id, '\\', '\\\\'), '"', '\\"') || '" -> "' || replace(replace(to_id, '\\', '\\\\'), '"', '\\"') || '";' AS line FROM {edges}""")
def q_dot(spark, d):
    """Q19, C17: DOT lines of all edges."""
    return graph.dot(B.edges(spark, d))


@query("""SELECT '    ' || regexp_replace(from_id, '[^A-Za-z0-9_]', '_', 'g') || '["' || replace(replace(from_id, '"', '#quot;'), chr(10), ' ') || '"] --> ' || regexp_replace(to_id, '[^A-Za-z0-9_]', '_', 'g') || '["' || replace(replace(to_id, '"', '#quot;'), chr(10), ' ') || '"]' AS line FROM {edges}""")
def q_mermaid(spark, d):
    """Q19, C17: Mermaid lines of all edges."""
    return graph.mermaid(B.edges(spark, d))


@query(f"""WITH RECURSIVE r AS (SELECT (SELECT max(to_id) FROM {{edges}}) AS node, 0 AS level UNION SELECT e.from_id, r.level + 1 FROM r JOIN {{edges}} e ON e.to_id = r.node WHERE r.level < 2), l AS (SELECT node, min(level) AS level FROM r GROUP BY 1)
SELECT l.node, l.level, min(e.to_id) AS parent FROM l LEFT JOIN (SELECT e.from_id, e.to_id, p.level FROM {{edges}} e JOIN l p ON p.node = e.to_id) e ON e.from_id = l.node AND e.level = l.level - 1 GROUP BY ALL""")
def q_caller_tree(spark, d):
    """Callers of the largest id, two levels."""
    e = B.edges(spark, d)
    return graph.call_tree(e, e.agg(F.max("to_id")).first()[0] or "", 2, callers=True)


@query("SELECT (SELECT count(*) FROM {edges} e JOIN (SELECT min(from_id) AS n FROM {edges}) m ON e.from_id = m.n OR e.to_id = m.n) AS n_edges")
def q_neighbourhood(spark, d):
    """Q17, K9: edges from and to one function."""
    e = B.edges(spark, d)
    return graph.neighbourhood(e, e.agg(F.min("from_id")).first()[0] or "", 1).agg(F.count(F.lit(1)).alias("n_edges"))


@query("SELECT repo_id, caller_path, caller, min(line) AS line FROM {calls} WHERE callee = (SELECT max(callee) FROM {calls}) GROUP BY ALL")
def j_callers_of(spark, d):
    """Who calls one function, each once."""
    c = B.calls(spark, d)
    return graph.callers(c, c.agg(F.max("callee")).first()[0] or "")


@query("SELECT repo_id, caller_path, caller, line FROM {calls} WHERE callee = (SELECT max(callee) FROM {calls})")
def j_every_call_of(spark, d):
    """Every call of one function."""
    c = B.calls(spark, d)
    return graph.callers(c, c.agg(F.max("callee")).first()[0] or "", distinct=False)


@query("SELECT repo_id, callee, callee_package, line, call_type FROM {calls} WHERE caller = (SELECT max(caller) FROM {calls})")
def j_callees_of(spark, d):
    """What one function calls."""
    c = B.calls(spark, d)
    return graph.callees(c, c.agg(F.max("caller")).first()[0] or "")


@query("SELECT r_name AS id, count(n_nationkey) AS repo_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def j_org_listing(spark, d):
    """Organisations with their numbers of repositories."""
    o = table(spark, d, "region").select(F.col("r_name").alias("id"), "r_regionkey")
    m = table(spark, d, "nation").join(o, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("id").alias("org_id"), F.col("n_name").alias("repo_id"))
    return org.listing(o.select("id"), m)


@query("SELECT DISTINCT owner_name AS org_id, repo_id FROM pull_requests WHERE owner_name <> 'team-chunk' OR repo_name < 'm'")
def u_org_members(spark, d):
    """Membership added twice and partly removed."""
    m = table(spark, d, "pull_requests").select(F.col("owner_name").alias("org_id"), "repo_id", "repo_name").distinct()
    gone = m.where((F.col("org_id") == "team-chunk") & (F.col("repo_name") >= "m"))
    m = m.drop("repo_name")
    return org.remove(org.add(m, m), gone.drop("repo_name"))


@query("SELECT owner_name AS org_id, repo_id, list_sort(list_distinct(['vendor/**', base_branch] || CASE WHEN repo_name < 'm' THEN ['*.lock'] ELSE [] END)) AS p, CASE WHEN repo_name < 'm' THEN 500 ELSE 1000 END AS max_file_size FROM (SELECT owner_name, repo_id, repo_name, min(base_branch) AS base_branch FROM pull_requests GROUP BY ALL)".replace("base_branch]", "'main']"))
def j_effective_config(spark, d):
    """Organisation settings under repository overrides."""
    m = table(spark, d, "pull_requests").select(F.col("owner_name").alias("org_id"), "repo_id", "repo_name").distinct()
    override = F.when(F.col("repo_name") < "m", F.struct(F.array(F.lit("*.lock"), F.lit("main")).alias("exclude_patterns"), F.lit(500).alias("max_file_size"))).otherwise(F.struct(F.array(F.lit("main")).alias("exclude_patterns"), F.lit(0).alias("max_file_size")))
    orgs = m.select(F.col("org_id").alias("id")).distinct().select("id", F.array(F.lit("vendor/**")).alias("exclude_patterns"), F.lit(1000).alias("max_file_size"))
    return org.effective(orgs, m.select("org_id", "repo_id", override.alias("override"))).select("org_id", "repo_id", F.array_sort("exclude_patterns").alias("p"), "max_file_size")


# --- changes ------------------------------------------------------------------------------------------------------------

_CH = f"""WITH c AS (SELECT * FROM {B.files_sql(6)}), s AS (SELECT * FROM {B.files_sql(5)}),
x AS (SELECT coalesce(c.repo_id, s.repo_id) AS repo_id, coalesce(c.path, s.path) AS file_path, CASE WHEN s.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN c.hash IS NOT DISTINCT FROM s.hash THEN 'unchanged' ELSE 'modified' END AS status FROM c FULL JOIN s ON c.repo_id = s.repo_id AND c.path = s.path)"""


def _sides(spark, d):
    return tuple(B.files(spark, d, n).withColumnRenamed("path", "file_path") for n in (6, 5))


@query(_CH + " SELECT repo_id, file_path, status FROM x")
def j_file_changes(spark, d):
    """Status of every file between two snapshots."""
    return changes.file_changes(*_sides(spark, d)).select("repo_id", "file_path", "status")


@query(_CH + " SELECT repo_id, file_path FROM x WHERE status IN ('new', 'modified')")
def j_changed(spark, d):
    """Files that need analysis."""
    return changes.changed(*_sides(spark, d)).select("repo_id", "file_path")


@query(_CH + " SELECT repo_id, count(*) FILTER (status <> 'new') AS tracked, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'unchanged') AS unchanged FROM x GROUP BY 1")
def a_change_counts(spark, d):
    """Files by status and repository."""
    return changes.change_counts(*_sides(spark, d))


@query(_CH + " SELECT repo_id, file_path, status <> 'unchanged' AS stale FROM x WHERE status <> 'deleted'")
def q_staleness(spark, d):
    """Q26: whether each current file is stale."""
    return changes.is_stale(*_sides(spark, d))


@query(f"SELECT c.repo_id, c.path AS file_path, c.hash FROM {B.files_sql(5)} c SEMI JOIN {B.files_sql(6)} x ON c.repo_id = x.repo_id AND c.path = x.path")
def f_cleanup(spark, d):
    """tracked files that still exist."""
    now, before = _sides(spark, d)
    return changes.cleanup(before, now).select("repo_id", "file_path", "hash")


@query(f"WITH c AS (SELECT * FROM {B.files_sql(6)}), s AS (SELECT * FROM {B.files_sql(5)}) SELECT repo_id, path AS file_path, hash FROM c UNION ALL SELECT s.repo_id, s.path, s.hash FROM s ANTI JOIN c ON c.repo_id = s.repo_id AND c.path = s.path")
def s_track(spark, d):
    """Stored hashes with the current ones put in place."""
    now, before = (x.select("repo_id", "file_path", "hash") for x in _sides(spark, d))
    return changes.track(before, now)


@query("SELECT repo_id, max(analyzed_at) AS last_analyzed FROM repo_snapshots GROUP BY 1 HAVING max(analyzed_at) < TIMESTAMP '2025-05-31 12:00:00'")
def f_stale(spark, d):
    """repositories last analysed before a time."""
    r = table(spark, d, "repo_snapshots").groupBy("repo_id").agg(F.max("analyzed_at").alias("last_analyzed"))
    return changes.stale(r, F.to_timestamp_ntz(F.lit("2025-05-31 12:00:00")))


# --- comparison ---------------------------------------------------------------------------------------------------------


def _target(spark, d):
    return B.functions(spark, d).agg(F.min("repo_id")).first()[0] or ""


_T = "(SELECT min(repo_id) FROM graph_nodes)"


@query("SELECT (SELECT count(DISTINCT repo_id) FROM {files}) AS total_repos, CAST(sum(n) AS BIGINT) AS total_files, count(*) FILTER (r = 1) AS unique_files, count(*) FILTER (r > 1) AS overlapping_files FROM (SELECT path, count(*) AS n, count(DISTINCT repo_id) AS r FROM {files} GROUP BY 1)")
def a_unified_stats(spark, d):
    """Files over all repositories."""
    return compare.unified_stats(B.files(spark, d))


@query("SELECT path, count(DISTINCT repo_id) AS n_repos, count(DISTINCT hash) = 1 AS identical FROM {files} GROUP BY 1 HAVING count(DISTINCT repo_id) > 1")
def a_file_overlap(spark, d):
    """A10: paths in several repositories."""
    return compare.file_overlap(B.files(spark, d))


@query("SELECT name, count(*) AS n_instances, count(DISTINCT repo_id) AS n_repos, 1.0::DOUBLE AS similarity FROM {fn} GROUP BY 1 HAVING count(DISTINCT repo_id) > 1")
def a_duplicates(spark, d):
    """Names in several repositories."""
    return compare.duplicates(B.functions(spark, d))


@query(f"""WITH t AS (SELECT name, arg_max(struct_pack(p := path, l := line_start, s := signature), (path, line_start)) AS t FROM {{fn}} WHERE repo_id = {_T} GROUP BY 1)
SELECT f.name, f.repo_id, f.path, f.line_start, f.signature, t.p AS target_path, t.l AS target_line_start, t.s AS target_signature, CASE WHEN contains(f.signature, 'error') <> contains(t.s, 'error') THEN 'high' ELSE 'medium' END AS severity
FROM {{fn}} f JOIN t USING (name) WHERE f.repo_id <> {_T} AND f.signature IS DISTINCT FROM t.s""")
def j_conflicts(spark, d):
    """Functions that the target has with another signature."""
    return compare.conflicts(B.functions(spark, d), _target(spark, d))


@query(f"SELECT name, count(*) AS n_sources, max(path) AS file_path, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS priority FROM {{fn}} f WHERE repo_id <> {_T} AND name NOT IN (SELECT name FROM {{fn}} WHERE repo_id = {_T}) GROUP BY 1")
def j_gaps(spark, d):
    """Functions that the target lacks."""
    return compare.gaps(B.functions(spark, d), _target(spark, d))


@query("SELECT p_name AS name, p_brand AS repo_id, p_type AS path, p_size AS n_fields, t.p AS target_path, t.n AS target_n_fields, 'medium' AS severity FROM part JOIN (SELECT p_name, arg_max(struct_pack(p := p_type, n := p_size), (p_type, p_partkey)) AS t FROM part WHERE p_brand = 'Brand#1' GROUP BY 1) USING (p_name) WHERE p_brand <> 'Brand#1' AND p_size <> t.n")
def j_type_conflicts(spark, d):
    """Types (parts) whose number of fields (size) differs from the target's."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line_start"), F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: i.cast("string")).alias("fields"))
    return compare.type_conflicts(p, "Brand#1")


@query("SELECT count(*) AS total, count(*) FILTER (contains(name, '_')) AS snake, count(*) FILTER (NOT contains(name, '_')) AS camel, round(least(count(*) FILTER (contains(name, '_')), count(*) FILTER (NOT contains(name, '_'))) / count(*), 6) AS mix, CASE WHEN least(count(*) FILTER (contains(name, '_')), count(*) FILTER (NOT contains(name, '_'))) / count(*) > 0.2 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS score FROM {fn}")
def a_naming(spark, d):
    """Naming consistency."""
    return compare.naming_consistency(B.functions(spark, d)).withColumn("mix", F.round("mix", 6))


_STR = "SELECT count(*) FILTER (n > 1 AND n < (SELECT count(DISTINCT repo_id) FROM {files})) AS issues FROM (SELECT regexp_extract(path, '^(.+)/[^/]*$', 1) AS dir, count(DISTINCT repo_id) AS n FROM {files} GROUP BY 1 HAVING dir <> '')"


@query(f"SELECT issues, greatest(0.5::DOUBLE, 1.0 - issues * 0.1::DOUBLE) AS score FROM ({_STR})")
def a_structure(spark, d):
    """Directory consistency."""
    return compare.structure_consistency(B.files(spark, d))


@query(f"SELECT 1.0::DOUBLE AS naming, 0.8::DOUBLE AS pattern, round(greatest(0.5::DOUBLE, 1.0 - issues * 0.1::DOUBLE), 6) AS structure, round((1.0 + 0.8 + greatest(0.5::DOUBLE, 1.0 - issues * 0.1::DOUBLE)) / 3, 6) AS overall FROM ({_STR})")
def a_consistency(spark, d):
    """All consistency scores."""
    c = compare.consistency(B.functions(spark, d), B.files(spark, d))
    return c.select("naming", "pattern", F.round("structure", 6).alias("structure"), F.round("overall", 6).alias("overall"))


@query()
def a_recommendations(spark, d):
    """Advice from the comparison's metrics."""
    f, x, t = B.functions(spark, d), B.files(spark, d), _target(spark, d)
    m = compare.duplicates(f).agg(F.count(F.lit(1)).alias("duplicates")).crossJoin(compare.conflicts(f, t).agg(F.count_if(F.col("severity") == "high").alias("high_conflicts")))
    m = m.crossJoin(compare.gaps(f, t).agg(F.count_if(F.col("priority") == "high").alias("high_gaps"))).crossJoin(compare.consistency(f, x).select("overall"))
    return compare.recommendations(m.crossJoin(compare.file_overlap(x).agg(F.count_if(~F.col("identical")).alias("differing_files"))))


@query("SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.n, 0) AS file_count, coalesce(b.n, 0) AS function_count FROM (SELECT repo_id, count(*) AS n FROM {files} GROUP BY 1) a FULL JOIN (SELECT repo_id, count(*) AS n FROM {fn} GROUP BY 1) b ON a.repo_id = b.repo_id")
def a_repo_summary(spark, d):
    """Files and functions by repository."""
    return compare.repo_summary(B.files(spark, d), B.functions(spark, d))


@query("SELECT repo_id, coalesce(nullif(regexp_extract(path, '^(.+)/[^/]*$', 1), ''), 'root') AS module, count(*) AS n_files, sum(line_count) AS n_lines FROM {files} GROUP BY ALL")
def a_modules(spark, d):
    """Files by directory."""
    return B.files(spark, d).groupBy("repo_id", F.coalesce(F.nullif(X.dirname("path"), F.lit("")), F.lit("root")).alias("module")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("line_count").alias("n_lines"))


@query("SELECT string_split(path, '/')[1] AS top, count(*) AS n FROM {files} GROUP BY 1")
def a_top_directories(spark, d):
    """Files by first path segment."""
    return B.files(spark, d).groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count(F.lit(1)).alias("n"))


# --- usage --------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total_calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM {usage}")
def a_usage_totals(spark, d):
    """A1: calls and tokens."""
    return U.totals(B.usage(spark, d))


_PT = "tool, count(*) AS calls, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, max(timestamp) AS last_used"


def _rounded(df):
    return df.withColumn("avg_input_tokens", F.round("avg_input_tokens", 6)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"SELECT {_PT} FROM {{usage}} GROUP BY tool")
def a_usage_by_tool(spark, d):
    """A2: use by tool."""
    return _rounded(U.per_tool(B.usage(spark, d)))


@query(f"SELECT {_PT} FROM {{usage}} WHERE timestamp >= TIMESTAMP '2024-01-20' GROUP BY tool")
def a_usage_since(spark, d):
    """A3: use by tool since a time."""
    return _rounded(U.per_tool(U.since(B.usage(spark, d), F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))))


@query("SELECT tool, round(count(*) FILTER (success) / count(*) * 100, 6) AS rate FROM {usage} GROUP BY 1")
def a_success_rate(spark, d):
    """A4: percent of successes by tool."""
    return U.per_tool(B.usage(spark, d)).select("tool", F.round(U.success_rate(F.col("successes"), F.col("calls")), 6).alias("rate"))


@query("SELECT id, tool FROM {usage} ORDER BY timestamp DESC, id DESC LIMIT 20")
def t_recent(spark, d):
    """The 20 latest calls."""
    return U.recent(B.usage(spark, d)).select("id", "tool")


@query("SELECT count(*) AS deleted FROM {usage} WHERE timestamp < TIMESTAMP '2024-01-10'")
def s_retention(spark, d):
    """Number of records that retention deletes."""
    return U.expired(B.usage(spark, d), F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")))


@query("SELECT id FROM {usage} WHERE timestamp >= TIMESTAMP '2024-01-10'")
def s_retained(spark, d):
    """Records that retention keeps."""
    return U.retained(B.usage(spark, d), F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))).select("id")


@query("SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS day, tool, count(*) AS calls FROM {usage} GROUP BY ALL")
def a_usage_daily(spark, d):
    """A2 by day, the batch form of the windowed stream."""
    return B.usage(spark, d).groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day"), "tool").agg(F.count(F.lit(1)).alias("calls"))


# --- vectors ------------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS key, {_COS} AS s FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM s WHERE s > 0) SELECT query_id, key, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10")
def q_semantic_search(spark, d):
    """Ten most similar vectors to each vector whose id 50 divides."""
    e = table(spark, d, "embeddings")
    asked = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return embedding.search(e, "vec_id", "embedding", asked, 10).select("query_id", "key", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT a.vec_id, round({_COS}, 6) AS cosine, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance, round(sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS norm FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) b")
def c_vector_math(spark, d):
    """Cosine, dot product, distance and norm against one vector."""
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    a, b = F.col("embedding"), F.col("q")
    return e.join(q).select("vec_id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.dot(a, b), 6).alias("dot"), F.round(V.euclidean(a, b), 6).alias("distance"), F.round(V.magnitude(a), 6).alias("norm"))


@query(f"SELECT a.vec_id FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) b WHERE {_COS} >= 0.1")
def f_threshold(spark, d):
    """F16: vectors with at least a similarity."""
    e = table(spark, d, "embeddings")
    return e.join(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))).where(embedding.at_least(V.cosine(F.col("embedding"), F.col("q")), 0.1)).select("vec_id")


@query("WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS x FROM x GROUP BY ALL")
def a_mean_vector(spark, d):
    """Mean vector of every label."""
    return embedding.mean_vector(table(spark, d, "embeddings"), "embedding", 64, ["label"]).select("label", "i", F.round("x", 6).alias("x"))


# --- ranking ------------------------------------------------------------------------------------------------------------


@query("SELECT line_start, round((3.0 * contains(lower(name), 'order')::INT + contains(lower(signature), 'order')::INT + 3.0 * contains(lower(name), 'plan')::INT + contains(lower(signature), 'plan')::INT) * CASE WHEN is_public THEN 1.2 ELSE 1 END, 6)::DOUBLE AS score FROM {fn}")
def q_keyword_score(spark, d):
    """Q9: scores of all functions for a query."""
    n = F.lit("")
    return B.functions(spark, d).select("line_start", F.round(rank.keyword_score(F.lit("order of plan"), F.col("name"), F.col("signature"), n, n, F.col("is_public")), 6).alias("score"))


@query("SELECT line_start, round((CASE WHEN contains(lower(name || ' ' || signature), 'order') THEN 1 + 0.5 * contains(lower(name), 'order')::INT ELSE 0 END + CASE WHEN contains(lower(name || ' ' || signature), 'plan') THEN 1 + 0.5 * contains(lower(name), 'plan')::INT ELSE 0 END) / 2, 6)::DOUBLE AS score FROM {fn}")
def q_relevance(spark, d):
    """Q10: relevance of all functions to keywords."""
    n = F.lit("")
    return B.functions(spark, d).select("line_start", F.round(rank.relevance(F.array(F.lit("order"), F.lit("plan")), F.col("name"), n, F.col("signature"), n), 6).alias("score"))


_QKW = " + ".join(f"3.0 * contains(lower(name), '{k}')::INT + contains(lower(signature), '{k}')::INT" for k in ("graph", "design"))


@query(f"SELECT line_start, ({_QKW} + is_public::INT + CASE WHEN lower(name) = 'main' THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(name), 'handler|server|init|new') THEN 1.5 ELSE 0 END)::DOUBLE AS score FROM {{fn}}")
def q_question_score(spark, d):
    """Q8: scores of all functions for a question about architecture; its keywords are "graph" and "design"."""
    return B.functions(spark, d).select("line_start", rank.question_function_score(F.lit("what is the graph design?"), F.col("name"), F.lit(""), F.col("signature"), F.col("is_public")).alias("score"))


@query("""SELECT path, CASE WHEN regexp_matches(lower(path), 'vendor/|node_modules/') THEN 0.0 ELSE (2.0 * contains(lower(path), 'order')::INT + 1.5 * contains(lower(path), 'order')::INT + CASE WHEN contains(lower(path), 'main') THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'config|server') THEN 1.5 ELSE 0 END
  + 2.0 * contains(lower(path), 'layout')::INT + 1.5 * contains(lower(path), 'layout')::INT) * CASE WHEN ends_with(path, '_test.go') THEN 0.5 ELSE 1 END END::DOUBLE AS score FROM (SELECT DISTINCT path FROM {fn})""")
def q_file_score(spark, d):
    """Scores of all files for a question."""
    f = B.functions(spark, d).select("path").distinct()
    return f.select("path", rank.question_file_score(F.lit("order layout"), F.col("path"), F.col("path"), F.array().cast("array<string>")).alias("score"))


@query("SELECT p_partkey, (3.0 * contains(lower(p_name), 'a1')::INT + 1.5 * contains(lower(p_type), 'a1')::INT + 3.0 * contains(lower(p_name), 'steel')::INT + 1.5 * contains(lower(p_type), 'steel')::INT + 0.5 * (contains(lower(p_brand), 'steel')::INT + contains(lower(p_brand), 'a1')::INT) + (p_size > 20)::INT + (p_size > 40)::INT)::DOUBLE AS score FROM part")
def q_type_score(spark, d):
    """Scores of types (parts) for a question."""
    t = table(spark, d, "part")
    none = F.array().cast("array<string>")
    s = rank.question_type_score(F.lit("steel a1x a1"), F.col("p_name"), F.col("p_type"), F.array("p_brand"), none, F.col("p_size") > 20, F.when(F.col("p_size") > 40, "interface").otherwise("struct"))
    return t.select("p_partkey", s.alias("score"))


@query("WITH x AS (SELECT repo_id, line_start, sum(CAST(floor(strlen(signature) / 4.0) AS BIGINT)) OVER (PARTITION BY repo_id ORDER BY path, line_start) AS used FROM {fn}) SELECT repo_id, line_start, CAST(used AS BIGINT) AS used FROM x WHERE used <= 400")
def q_prefix_budget(spark, d):
    """Functions of each repository until their budget ends."""
    f = B.functions(spark, d).withColumn("cost", X.token_estimate("signature"))
    return rank.prefix_budget(f, ["repo_id"], ["path", "line_start"], "cost", 400).select("repo_id", "line_start", "used")


@query()
def q_pack(spark, d):
    """Q11, Q12, Q14: greedy selection of each repository's best functions, in short form where the full one is too long."""
    n = F.lit("")
    f = B.functions(spark, d)
    s = rank.keyword_score(F.lit("order plan graph"), F.col("name"), F.col("signature"), n, n, F.col("is_public"))
    c = f.select("repo_id", "line_start", s.alias("score"), (X.token_estimate("signature") + 10).alias("cost"), F.lit(10).cast("long").alias("short")).where("score > 0")
    return rank.pack(c, "repo_id", "line_start", "score", "cost", 500, "short")


@query("SELECT path, min(CASE WHEN regexp_matches(lower(path), 'handler|controller') THEN 1 WHEN regexp_matches(lower(path), 'model|entity') THEN 2 ELSE 3 END) AS priority FROM {fn} GROUP BY 1")
def t_file_priority(spark, d):
    """Priority of files."""
    return B.functions(spark, d).select("path", rank.file_priority(F.col("path")).alias("priority")).distinct()


# --- impact -------------------------------------------------------------------------------------------------------------


def _changed(spark, d):
    return B.functions(spark, d).where(F.col("path").endswith("_order.go")).select("repo_id", "path").distinct()


_AF = """WITH ch AS (SELECT DISTINCT repo_id, path FROM {fn} WHERE ends_with(path, '_order.go')), nm AS (SELECT DISTINCT f.repo_id, f.name FROM {fn} f JOIN ch USING (repo_id, path)),
h AS (SELECT c.repo_id, c.caller_path AS path, c.caller AS name, min((coalesce(c.line, 0), c.callee)) AS m FROM {calls} c JOIN nm ON nm.repo_id = c.repo_id AND nm.name = c.callee GROUP BY ALL),
a AS (SELECT h.repo_id, h.path, h.name, m[2] AS calls, coalesce(f.p, false) AS is_public FROM h LEFT JOIN (SELECT repo_id, path, name, bool_or(is_public) AS p FROM {fn} GROUP BY ALL) f USING (repo_id, path, name) ANTI JOIN ch ON ch.repo_id = h.repo_id AND ch.path = h.path)"""


@query(_AF.replace("m[2]", "m.c") .replace("min((coalesce(c.line, 0), c.callee))", "min(struct_pack(l := coalesce(c.line, 0), c := c.callee))") + " SELECT * FROM a")
def j_impact(spark, d):
    """Functions that call changed ones."""
    return impact.affected_functions(B.calls(spark, d), B.functions(spark, d), _changed(spark, d))


@query(_AF.replace("m[2]", "m.c").replace("min((coalesce(c.line, 0), c.callee))", "min(struct_pack(l := coalesce(c.line, 0), c := c.callee))") + " SELECT count(*) AS n_functions, count(*) FILTER (is_public) AS n_public, CASE WHEN count(*) FILTER (is_public) > 0 OR count(*) > 10 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS risk FROM a")
def a_risk(spark, d):
    """Risk of the change set."""
    a = impact.affected_functions(B.calls(spark, d), B.functions(spark, d), _changed(spark, d)).agg(F.count(F.lit(1)).alias("n_functions"), F.count_if("is_public").alias("n_public"))
    return a.select("n_functions", "n_public", impact.risk(F.col("n_functions"), F.lit(0), F.col("n_public")).alias("risk"))


@query("WITH ch AS (SELECT DISTINCT repo_id, path FROM {fn} WHERE ends_with(path, '_order.go')) SELECT (SELECT count(*) FROM ch) AS n_files, count(*) AS n_functions, count(*) FILTER (is_public) AS n_public, count(*) FILTER (NOT is_public) AS n_internal FROM {fn} f SEMI JOIN ch ON ch.repo_id = f.repo_id AND ch.path = f.path")
def a_change_summary(spark, d):
    """What the change set holds."""
    return impact.summary(B.functions(spark, d), _changed(spark, d))


@query("WITH x AS (SELECT DISTINCT repo_id, path, regexp_extract(path, '^(.+)/[^/]*$', 1) AS dir FROM {fn}), ch AS (SELECT * FROM x WHERE ends_with(path, '_order.go')) SELECT repo_id, path FROM x SEMI JOIN ch ON ch.repo_id = x.repo_id AND ch.dir = x.dir WHERE NOT ends_with(path, '_order.go') ORDER BY 1, 2 LIMIT 10")
def j_neighbours(spark, d):
    """Files beside the changed ones."""
    return impact.neighbours(B.functions(spark, d).select("repo_id", "path").distinct(), _changed(spark, d)).select("repo_id", "path")


@query(f"""WITH t AS (SELECT name, arg_max(signature, (path, line_start)) AS s FROM {{fn}} WHERE repo_id = {_T} GROUP BY 1) SELECT f.line_start FROM {{fn}} f JOIN t USING (name) WHERE f.repo_id <> {_T} AND f.signature IS DISTINCT FROM t.s AND contains(f.signature, 'error') <> contains(t.s, 'error')""")
def f_severity(spark, d):
    """conflicts of the highest severity."""
    c = compare.conflicts(B.functions(spark, d), _target(spark, d)).withColumn("severity", F.when(F.col("severity") == "high", "critical").otherwise("important"))
    return impact.severity_filter(c, "critical").select("line_start")


# --- extraction ---------------------------------------------------------------------------------------------------------

# every signature that the language's grammar allows: blanks, receivers
_SIG = "regexp_matches(signature, '^\\s*func\\s*(\\([^()]*\\)\\s*)?\\w+\\s*\\(')"


def _sources(spark, d):
    """One small source text per function, made of its signature."""
    sig = F.regexp_replace("signature", r"\s*\{?\s*$", "")
    return B.functions(spark, d).where(F.col("signature").rlike(r"^\s*func\s*(\([^()]*\)\s*)?\w+\s*\(")).select("line_start", "repo_id", F.concat(F.col("line_start").cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit("package p\n\n"), sig, F.lit(" {\n\tx.Run()\n}\n")).cast("binary").alias("content"))


@query(f"SELECT line_start, regexp_extract(signature, '^\\s*func\\s*(?:\\([^()]*\\)\\s*)?(\\w+)', 1) AS name, regexp_matches(signature, '^\\s*func\\s*(\\([^()]*\\)\\s*)?[A-Z]') AS is_public, CASE WHEN regexp_matches(signature, '\\w\\s*\\(\\s*ctx\\s+context\\s*\\.\\s*Context') THEN 'context.Context' ELSE '' END AS first_context FROM {{fn}} WHERE {_SIG}")
def x_extract(spark, d):
    """Functions parsed from source texts."""
    e = extraction.functions(extraction.extract(_sources(spark, d)))
    first = F.get("parameters", F.lit(0))
    ctx = F.when(first["type"] == "context.Context", "context.Context").otherwise("")
    return e.select(F.regexp_extract("path", "^(-?[0-9]+)", 1).cast("long").alias("line_start"), "name", "is_public", ctx.alias("first_context"))


@query()
def x_extract_detail(spark, d):
    """Complexity, calls, effects, errors and behaviour of parsed functions."""
    e = extraction.functions(extraction.extract(_sources(spark, d)))
    return e.groupBy("behavior.output_source", "error_handling.returns_error", "complexity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("calls")).alias("n_calls"), F.sum(F.size("side_effects")).alias("n_effects"))


@query("SELECT doc_id, string_split(p, ' ')[1] AS route, upper(regexp_extract(p, '\\[(\\w+)\\]', 1)) AS method FROM (SELECT doc_id, unnest(['/docs/' || doc_id || ' [get]', '/sources/' || coalesce(source, 'none') || ' [post]']) AS p FROM documents)")
def x_doc_routes(spark, d):
    """Routes in comments, all of each text."""
    c = F.concat(F.lit("// @Router /docs/"), "doc_id", F.lit(" [get]\n// text\n// @Router /sources/"), F.coalesce("source", F.lit("none")), F.lit(" [post]\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.explode(X.doc_routes(c)).alias("r")).select("doc_id", F.col("r.path").alias("route"), F.col("r.method").alias("method"))


# --- questions ----------------------------------------------------------------------------------------------------------


@query("SELECT line_start, CASE line_start % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'callers' WHEN 2 THEN 'calls' ELSE 'flow' END AS intent, lower(name) AS argument FROM {fn}")
def q_router(spark, d):
    """Intents and arguments of questions about every function."""
    n = F.col("name")
    kind = F.col("line_start") % 4
    text = F.when(kind == 0, F.concat(F.lit("What does "), n, F.lit(" do?"))).when(kind == 1, F.concat(F.lit("who calls "), n)).when(kind == 2, F.concat(F.lit("dependencies of "), n)).otherwise(F.concat(F.lit("trace "), n))
    return B.functions(spark, d).select("line_start", router.classify(text).alias("c")).select("line_start", "c.intent", "c.argument")


@query()
def q_titles_router(spark, d):
    """Q5: intents of pull requests' titles."""
    return B.titles(spark, d).select(router.classify(F.col("query")).alias("c")).groupBy("c.intent").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT package, count(*) AS n_functions, count(DISTINCT path) AS n_files FROM {fn} GROUP BY 1")
def q_answer(spark, d):
    """Q6: rows that answer a question about the architecture."""
    f = B.functions(spark, d)
    types = spark.createDataFrame([], "repo_id string, path string, name string, kind string")
    return compose.answer(compose.Store(f, B.calls(spark, d), types, f.select("repo_id", "path", "package").distinct()), "show the project layout").rows


@query("SELECT f.repo_id, f.path, f.name, count(c.callee) AS n_callers FROM (SELECT DISTINCT repo_id, path, name, line_start FROM {fn} WHERE contains(lower(name), 'ledger') OR contains(lower(signature), 'ledger') ORDER BY repo_id, path, name LIMIT 20) f LEFT JOIN {calls} c ON c.repo_id = f.repo_id AND c.callee = f.name GROUP BY f.repo_id, f.path, f.name, f.line_start")
def q_find_and_expand(spark, d):
    """Functions found and expanded with their callers."""
    ctx = compose.Chain(compose.Step("find", compose.find_and_expand, {"functions": "{{functions}}", "calls": "{{calls}}", "query": "ledger"}, store="found")).use(compose.timing).run(functions=B.functions(spark, d), calls=B.calls(spark, d))
    return ctx.last_data


@query("SELECT * FROM (VALUES ('tiny', 'free', 1, 0), ('small', 'free', 4, 0), ('small', 'cheap', 3, 0), ('small', 'expensive', 2, 1), ('medium', 'free', 7, 0), ('medium', 'cheap', 4, 0), ('medium', 'expensive', 3, 3), ('large', 'cheap', 4, 0), ('large', 'expensive', 1, 1), ('skills', 'development', 3, 10)) t(output_size, cost_level, n, n_ai)")
def k_hints(spark, d):
    """Tools by size and cost, how many of them need a model; skills of one category with their tools."""
    tools = compose.hints(spark).groupBy("output_size", "cost_level").agg(F.count(F.lit(1)).alias("n"), F.count_if("requires_ai").alias("n_ai"))
    of = compose.skills(spark, "development").agg(F.lit("skills").alias("output_size"), F.lit("development").alias("cost_level"), F.count(F.lit(1)).alias("n"), F.sum(F.size("uses_tools")).alias("n_ai"))
    return tools.unionByName(of).select("output_size", "cost_level", F.col("n").cast("int").alias("n"), F.col("n_ai").cast("int").alias("n_ai"))


# --- further helpers ----------------------------------------------------------------------------------------------------


@query("SELECT pr_id, owner_name AS owner, repo_name AS repo, CAST(pr_number AS BIGINT) AS number FROM pull_requests")
def k_pr_url(spark, d):
    """Parts of pull requests' addresses."""
    url = F.concat(F.lit("https://host.test/"), "owner_name", F.lit("/"), "repo_name", F.lit("/pull/"), "pr_number", F.lit("/files?x=1"))
    return table(spark, d, "pull_requests").select("pr_id", X.pr_of_url(url).alias("u")).select("pr_id", "u.*")


@query("SELECT pr_id, count(*) AS n_files, sum(additions) AS additions, sum(deletions) AS deletions, count(*) FILTER (change_status = 'added') AS n_added, count(*) FILTER (change_status = 'removed') AS n_removed FROM (SELECT DISTINCT pr_file_id, pr_id, additions, deletions, change_status FROM pr_files) GROUP BY 1")
def a_pr_summary(spark, d):
    """Files and lines that each pull request changes."""
    f = table(spark, d, "pr_files").dropDuplicates(["pr_file_id"])
    s = F.col("change_status")
    return f.groupBy("pr_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count_if(s == "added").alias("n_added"), F.count_if(s == "removed").alias("n_removed"))


@query("SELECT repo_id, max(snapshot_no) AS last_snapshot, arg_max(lower(commit_hash), (snapshot_no, ingested_at)) AS commit_hash, max(analyzed_at) AS analyzed_at FROM repo_snapshots WHERE files IS NOT NULL GROUP BY 1")
def s_metadata(spark, d):
    """One row per repository in place of its whole documents."""
    r = table(spark, d, "repo_snapshots").where("files IS NOT NULL")
    return r.groupBy("repo_id").agg(F.max("snapshot_no").alias("last_snapshot"), F.max_by(F.lower("commit_hash"), F.struct("snapshot_no", "ingested_at")).alias("commit_hash"), F.max("analyzed_at").alias("analyzed_at"))


@query("SELECT repo_id, count(DISTINCT package) AS n_packages, count(*) FILTER (lower(name) LIKE '%init%' OR name = 'main') AS entry_points, count(*) FILTER (is_public) AS n_public, count(*) AS n_functions FROM {fn} GROUP BY 1")
def a_architecture(spark, d):
    """Packages and entry points by repository."""
    f = B.functions(spark, d)
    entry = F.lower("name").contains("init") | (F.col("name") == "main")
    return f.groupBy("repo_id").agg(F.count_distinct("package").alias("n_packages"), F.count_if(entry).alias("entry_points"), F.count_if("is_public").alias("n_public"), F.count(F.lit(1)).alias("n_functions"))


@query("SELECT package, line_start, place FROM (SELECT package, line_start, s, row_number() OVER (PARTITION BY package ORDER BY s DESC, line_start) AS place FROM (SELECT package, line_start, (3.0 * contains(lower(name), 'order')::INT + contains(lower(signature), 'order')::INT) * CASE WHEN is_public THEN 1.2 ELSE 1 END AS s FROM {fn}) WHERE s > 0) WHERE (package = 'handlers' AND place <= 10) OR (package = 'models' AND place <= 15)")
def t_top_per_category(spark, d):
    """Best functions of each package, each with its own limit."""
    n = F.lit("")
    s = rank.keyword_score(F.lit("order"), F.col("name"), F.col("signature"), n, n, F.col("is_public"))
    return rank.top_per_category(B.functions(spark, d).withColumn("s", s), "package", "s", ["line_start"], {"handlers": 10, "models": 15}).select("package", "line_start", F.col("place").cast("long").alias("place"))


@query("SELECT count(*) > 30 AS has_more, CASE WHEN count(*) > 30 THEN 30 ELSE 0 END AS next_offset FROM {fn}")
def t_page(spark, d):
    """Whether a page of functions has a successor."""
    return rank.page(B.functions(spark, d), ["line_start"], 20, 10)[1]


@query("SELECT line_start, name FROM {fn} ORDER BY line_start LIMIT 20 OFFSET 10")
def t_page_rows(spark, d):
    """The page itself."""
    return rank.page(B.functions(spark, d), ["line_start"], 20, 10)[0].select("line_start", "name")


@query("WITH c AS (SELECT repo_id, caller_path, caller, min(line) AS line FROM {calls} WHERE callee = (SELECT max(callee) FROM {calls}) GROUP BY ALL) SELECT c.*, f.signature FROM c LEFT JOIN (SELECT repo_id, path, name, min(signature) AS signature FROM {fn} GROUP BY ALL) f ON f.repo_id = c.repo_id AND f.path = c.caller_path AND f.name = c.caller")
def j_caller_details(spark, d):
    """Callers with their signatures."""
    c = B.calls(spark, d)
    return graph.caller_details(c, B.functions(spark, d), c.agg(F.max("callee")).first()[0] or "")


@query("WITH f AS (SELECT repo_id, caller_path, caller FROM {calls} ORDER BY 1, 2, 3 LIMIT 1) SELECT DISTINCT 'caller' AS relation, c.caller_path AS path, c.caller AS name, c.line FROM {calls} c, f WHERE c.repo_id = f.repo_id AND c.callee = f.caller UNION SELECT 'callee', c.callee_file, c.callee, c.line FROM {calls} c, f WHERE c.repo_id = f.repo_id AND c.caller = f.caller AND c.caller_path = f.caller_path")
def q_function_context(spark, d):
    """Q4: callers and callees of one function."""
    c = B.calls(spark, d)
    one = c.orderBy("repo_id", "caller_path", "caller").select("repo_id", "caller_path", "caller").first()
    return graph.function_context(c, *(one or ("", "", "")))


@query("SELECT line_start, repo_id || ':func:' || path || ':' || name AS vector_id FROM {fn}")
def k_vector_ids(spark, d):
    """Identities of function vectors."""
    return B.functions(spark, d).select("line_start", X.vector_id(F.col("repo_id"), "func", F.col("path"), F.col("name")).alias("vector_id"))


_PRC = _AF.replace("m[2]", "m.c").replace("min((coalesce(c.line, 0), c.callee))", "min(struct_pack(l := coalesce(c.line, 0), c := c.callee))")


@query("""WITH ch AS (SELECT DISTINCT repo_id, path FROM {fn} WHERE ends_with(path, '_order.go')), f AS (SELECT f.* FROM {fn} f JOIN ch USING (repo_id, path)),
up AS (SELECT f.repo_id, f.path, count(DISTINCT (c.caller_path, c.caller)) AS n FROM (SELECT DISTINCT repo_id, path, name FROM f) f JOIN {calls} c ON c.repo_id = f.repo_id AND c.callee = f.name AND c.caller_path <> f.path GROUP BY ALL),
down AS (SELECT c.repo_id, c.caller_path AS path, count(DISTINCT c.callee) AS n FROM {calls} c JOIN ch ON ch.repo_id = c.repo_id AND ch.path = c.caller_path GROUP BY ALL)
SELECT ch.repo_id, ch.path, count(f.name) AS n_functions, count(f.name) FILTER (f.is_public) AS n_public, coalesce(any_value(up.n), 0) AS n_callers, coalesce(any_value(down.n), 0) AS n_callees FROM ch LEFT JOIN f USING (repo_id, path) LEFT JOIN up USING (repo_id, path) LEFT JOIN down USING (repo_id, path) GROUP BY ALL""")
def q_pr_context(spark, d):
    """Q20: changed files with their functions, callers and callees."""
    return impact.change_context(B.calls(spark, d), B.functions(spark, d), _changed(spark, d))


@query(f"""WITH t AS (SELECT name, arg_max(signature, (path, line_start)) AS s FROM {{fn}} WHERE repo_id = {_T} GROUP BY 1), m AS (SELECT
(SELECT count(*) FROM (SELECT name FROM {{fn}} GROUP BY 1 HAVING count(DISTINCT repo_id) > 1)) AS duplicates,
(SELECT count(*) FROM {{fn}} f JOIN t USING (name) WHERE f.repo_id <> {_T} AND f.signature IS DISTINCT FROM t.s AND contains(f.signature, 'error') <> contains(t.s, 'error')) AS high_conflicts,
(SELECT count(*) FROM (SELECT name FROM {{fn}} WHERE repo_id <> {_T} AND name NOT IN (SELECT name FROM {{fn}} WHERE repo_id = {_T}) GROUP BY 1 HAVING count(*) >= 3)) AS high_gaps,
(SELECT count(*) FROM (SELECT path FROM {{files}} GROUP BY 1 HAVING count(DISTINCT repo_id) > 1 AND count(DISTINCT hash) > 1)) AS differing_files,
(SELECT round((1.0 + 0.8 + greatest(0.5::DOUBLE, 1.0 - issues * 0.1::DOUBLE)) / 3, 6) FROM ({_STR})) AS overall)
SELECT *, coalesce(nullif(array_to_string(list_filter([CASE WHEN duplicates > 5 THEN 'Create a shared library for common functions' END, CASE WHEN high_conflicts > 0 THEN 'Resolve severe conflicts before a merge' END, CASE WHEN high_gaps > 0 THEN 'Migrate functions of high priority to the target' END,
  CASE WHEN overall < 0.7 THEN 'Improve consistency to ease maintenance' END, CASE WHEN differing_files > 0 THEN 'Review files that differ between repositories' END], lambda x: x IS NOT NULL), '|'), ''), 'Repositories are well aligned') AS advice FROM m""")
def q_compare(spark, d):
    """The comparison of all repositories with one, and its advice."""
    m = compare.compare(B.functions(spark, d), B.files(spark, d), _target(spark, d))
    return m.select("duplicates", "high_conflicts", "high_gaps", "differing_files", F.round("overall", 6).alias("overall"), F.array_join("advice", "|").alias("advice"))


@query("SELECT repo_id, file_path, hash, CASE WHEN status IN ('new', 'modified') THEN 'fresh' ELSE 'kept' END AS origin FROM (" + _CH + " SELECT x.repo_id, x.file_path, x.status, coalesce(c.hash, s.hash) AS hash FROM x LEFT JOIN c ON c.repo_id = x.repo_id AND c.path = x.file_path LEFT JOIN s ON s.repo_id = x.repo_id AND s.path = x.file_path) WHERE status <> 'deleted'")
def q_refresh(spark, d):
    """Q24, Q25: a derived table after a change set: rows of changed files are made anew, those of deleted ones go."""
    now, before = (x.select("repo_id", "file_path", "hash") for x in _sides(spark, d))
    ch = changes.file_changes(now, before)
    return changes.refresh(before.withColumn("origin", F.lit("kept")), now.withColumn("origin", F.lit("fresh")), ch)


@query("SELECT owner_name AS org_id, count(DISTINCT repo_id) AS n FROM pull_requests WHERE owner_name <> 'team-chunk' GROUP BY 1 UNION ALL SELECT 'team-chunk', count(DISTINCT repo_id) FROM pull_requests WHERE owner_name = 'team-chunk' AND repo_name < 'm' HAVING count(*) > 0")
def u_register(spark, d):
    """Q27, K6: an organisation registered anew has just the repositories named, whatever it had."""
    m = table(spark, d, "pull_requests").select(F.col("owner_name").alias("org_id"), "repo_id", "repo_name").distinct()
    rows = m.where((F.col("org_id") == "team-chunk") & (F.col("repo_name") < "m")).drop("repo_name")
    held = m.drop("repo_name").where((F.col("org_id") != "team-chunk") | F.lit(False)).unionByName(m.drop("repo_name").where(F.col("org_id") == "team-chunk").join(rows.select("org_id").distinct(), "org_id", "left_semi"))
    return org.register(held, rows).groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, coalesce(timestamp, TIMESTAMP '2024-02-01') AS timestamp FROM (SELECT id, CASE WHEN success THEN timestamp END AS timestamp FROM {usage})")
def s_default_time(spark, d):
    """Records without a time get one."""
    u = B.usage(spark, d).withColumn("timestamp", F.when(F.col("success"), F.col("timestamp")))
    return U.with_default_time(u, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))).select("id", "timestamp")


@query("SELECT DISTINCT 'https://host.test/' || repo_id || '.git' AS url, 'host.test/' || repo_id AS id FROM graph_nodes")
def k_repo_ids(spark, d):
    """Repository ids of addresses."""
    u = table(spark, d, "graph_nodes").select(F.concat(F.lit("https://host.test/"), "repo_id", F.lit(".git")).alias("url")).distinct()
    return u.select("url", X.repo_id_of_url("url").alias("id"))


@query("SELECT n_name AS concept, CASE lower(n_name) WHEN 'auth' THEN 'authentication' ELSE lower(n_name) END AS name FROM nation UNION ALL SELECT * FROM (VALUES ('Login', 'authentication'), ('SQL', 'database'), ('endpoint', 'handler'), ('Cache', 'cache'))")
def f_concept_name(spark, d):
    """names of concepts, synonyms resolved."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("concept"))
    more = spark.createDataFrame([("Login",), ("SQL",), ("endpoint",), ("Cache",)], "concept string")
    return n.unionByName(more).select("concept", search.concept_name(F.col("concept")).alias("name"))

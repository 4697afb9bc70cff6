"""Directory scans, documents and tables as sources; partition-wise sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files larger than this are left out of a scan by default.
MAX_FILE_BYTES = 1 << 20

# fixed values: languages by file name and by extension
LANGUAGE_BY_NAME = {"dockerfile": "dockerfile", "makefile": "makefile", "go.mod": "go-mod", "go.sum": "go-mod", "package.json": "json", ".gitignore": "gitignore"}
LANGUAGE_BY_EXTENSION = {
    "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "cs": "csharp", "md": "markdown",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss",
    "sql": "sql", "sh": "shell", "bash": "shell", "proto": "protobuf",
}
# fixed values: directories that a local project scan leaves out, besides those that start with a dot, and code extensions
LOCAL_SKIPPED = tuple("node_modules vendor dist target __pycache__ coverage bin obj venv env tmp temp logs".split())
CODE_EXTENSIONS = tuple("go js ts jsx tsx py java rs rb php c cpp h hpp cs swift kt scala ex exs erl clj sql sh bash zsh yaml yml json xml proto graphql gql".split())


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is left out: ``**/x`` anywhere, ``x/**`` below a directory, ``*.ext``, else exact or below.

    Git's own directory is always left out; names that merely begin like it are not.
    """
    hit = path.rlike(r"(?:^|/)\.git(?:/|$)")
    for p in patterns:
        if p.startswith("**/"):
            rest = p[3:]
            hit = hit | F.contains(path, F.lit(rest)) | path.endswith(rest.removesuffix("/**"))
        elif p.endswith("/**"):
            hit = hit | path.startswith(p[:-3])
        elif p.startswith("*."):
            hit = hit | path.endswith(p[1:])
        else:
            hit = hit | (path == p) | path.startswith(p + "/")
    return hit


def language(path: Column) -> Column:
    """Language by file name, else by extension, else ``unknown``; case-insensitive."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(LANGUAGE_BY_NAME), name), F.try_element_at(table(LANGUAGE_BY_EXTENSION), ext), F.lit("unknown"))


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES, hidden: list[str] | None = None) -> DataFrame:
    """Files below a directory: path (relative), size, mod_time, language, hash (whole SHA-256), content.

    One distributed listing and read; excluded and too large files are dropped by the path and length of the scan.
    Spark's listing leaves out names that begin with a dot or an underscore; ``hidden`` names such paths to be read too.
    """
    base = root.rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([root, *(base + h for h in hidden or [])])
    whole = F.regexp_replace("path", "^file:/*", "/")
    # the root is no pattern: it is cut off by its length
    rel = F.when(whole.startswith(base), F.substr(whole, F.lit(len(base) + 1))).otherwise(whole)
    return df.where(F.col("length") <= max_bytes).select(
        rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content"
    ).where(~excluded(F.col("path"), exclude or [])).select("path", "size", "mod_time", language(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), "content")


def scan_local(spark: SparkSession, root: str, include_all: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """A project directory: code only (or all with ``include_all``), no dot directories, no directories of tools."""
    df = scan(spark, root, [], max_bytes)
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    kept = df.where(~F.exists(dirs, lambda d: d.startswith(".") | d.isin(*LOCAL_SKIPPED)))
    return kept if include_all else kept.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*CODE_EXTENSIONS))


def purpose(path: Column, lang: Column) -> Column:
    """What a file that no parser knows is for: the first rule that holds."""
    p = F.lower(path)
    has, ends = (lambda x: F.contains(p, F.lit(x))), (lambda *x: p.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in x) + ")$"))
    return (
        F.when(has("readme"), "Project documentation").when(has("license"), "License file").when(has("dockerfile"), "Docker container definition")
        .when(has("makefile"), "Build automation").when(has("config"), "Configuration file").when(has("test"), "Test file").when(ends(".md"), "Documentation")
        .when(ends(".yaml", ".yml"), "YAML configuration").when(ends(".json"), "JSON data/configuration").when(ends(".sql"), "SQL database script")
        .when(ends(".sh"), "Shell script").when(has(".github/workflows"), "GitHub Actions workflow").otherwise(F.concat(lang, F.lit(" source file")))
    )


def path_concepts(path: Column) -> Column:
    """Lower-case parts of a path longer than two bytes."""
    return F.filter(F.transform(F.split(path, "/"), F.lower), lambda x: F.octet_length(x) > 2)


def line_count(content: Column) -> Column:
    """Line feeds plus one."""
    return F.size(F.split(content.cast("string"), "\n", -1))


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of repositories, one a file, with a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_partitions(df: DataFrame, path: str, by: str = "repo_id") -> None:
    """Write rows so that only the partitions of the keys present are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table with ``rows`` put in place of those with the same keys, columns of any type.

    Of several rows with equal keys the last by the column ``order`` holds (ties: either, they have one time); without
    one, the largest by all columns but maps. Rows of the table whose keys come in ``rows`` give way even to older ones: what is put is meant.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        last = rows.distinct()
    elif order:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"), F.first(F.struct(*rest)).alias("__f")).select(*keys, F.coalesce("__r", "__f").alias("__r")).select(*keys, "__r.*")
    else:
        sortable = [c for c in rest if "map<" not in rows.schema[c].dataType.simpleString()] or [F.lit(0)]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sortable)).alias("__r")).select(*keys, "__r.*")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*table.columns))


def listing(repos: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    """Contexts, the latest analysed first, ties by key; a page of ``limit``."""
    return repos.orderBy(F.desc("analyzed_at"), *keys).limit(limit)


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose keys are in ``gone`` (deletion with cascade, table by table)."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def fresh(repos: DataFrame, now: Column, max_age_seconds: int = 0) -> DataFrame:
    """Contexts not older than the limit; 0 is no limit."""
    return repos if max_age_seconds <= 0 else repos.where(F.col("analyzed_at") >= now - F.make_dt_interval(secs=F.lit(max_age_seconds)))


def split_diff(pulls: DataFrame, key: str, diff: str) -> DataFrame:
    """Per-file patches of unified diffs: key, position, old_path, file_path, patch (from the header line on).

    Null and headerless diffs have no file.
    """
    parts = F.split(F.col(diff), r"(?m)(?=^diff --git )")
    head = F.regexp_extract_all("part", F.lit(r"^diff --git a/(.*?) b/([^\n\r]*)"), F.lit(1))
    rows = pulls.select(key, F.posexplode(F.filter(parts, lambda p: p.startswith("diff --git "))).alias("position", "part"))
    return rows.where(F.size(head) > 0).select(
        key, "position", F.regexp_extract("part", r"^diff --git a/(.*?) b/([^\n\r]*)", 1).alias("old_path"), F.regexp_extract("part", r"^diff --git a/(.*?) b/([^\n\r]*)", 2).alias("file_path"), F.col("part").alias("patch")
    )


def patch_status(patch: Column) -> Column:
    """Kind of change that a patch's header lines tell."""
    return F.when(patch.rlike(r"(?m)^new file mode "), "added").when(patch.rlike(r"(?m)^deleted file mode "), "removed").when(patch.rlike(r"(?m)^rename from "), "renamed").otherwise("modified")

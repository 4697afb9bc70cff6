"""Partitioned Parquet stores of the code-knowledge tables: schema versions, replacement by repository, nested reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES

#: Columns added by later schema versions: (version, table, column, type); missing ones read as null.
ADDED = ((2, "functions", "error_types", "array<string>"), (2, "files", "doc_comment", "string"), (3, "repos", "build_system", "string"))
VERSION = max(v for v, *_ in ADDED)


def schema(table: str, version: int = VERSION) -> T.StructType:
    """Schema of a table at a version."""
    more = "".join(f", {c} {t}" for v, name, c, t in ADDED if name == table and v <= version)
    return T.StructType.fromDDL(TABLES[table] + more)


class ContextStore:
    """Tables below a folder, partitioned by repository.

    Rows are written in the schema of the store's version and read in that of any later one, so that a migration adds
    columns without touching files.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int = VERSION):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def put(self, table: str, rows: DataFrame) -> None:
        """Replace the rows of just the repositories that come in ``rows``; columns that are absent become null.

        Rows are gathered by repository first, so that the number of files follows the repositories and not their product
        with the tasks; large repositories are split.
        """
        kinds = schema(table, self.version)
        have = set(rows.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]
        rows.select(*cols).hint("rebalance", _partition(table)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_partition(table)).parquet(self._path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows as they are."""
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table, self.version)]).write.mode("append").parquet(self._path(table))

    def get(self, table: str, repo_id: str | None = None) -> DataFrame:
        """A table, or one repository's partition of it."""
        read = self.spark.read.schema(schema(table, self.version))
        if repo_id is None:
            return read.parquet(self._path(table))
        fs, at = self._at(table, repo_id)
        # the other repositories' folders are not even listed
        df = read.option("basePath", self._path(table)).parquet(at.toString()) if fs.exists(at) else read.parquet(self._path(table))
        return df.where(F.col(_partition(table)) == repo_id)

    def delete(self, repo_id: str, tables: tuple[str, ...]) -> None:
        """Remove a repository from tables; one that is not there is no error."""
        for t in tables:
            fs, at = self._at(t, repo_id)
            fs.delete(at, True)

    def _at(self, table: str, repo_id: str):
        """File system and path of a repository's partition."""
        jvm = self.spark._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo_id)
        at = jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/{_partition(table)}={name}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at


def _partition(table: str) -> str:
    return "id" if table in ("repos", "orgs") else "repo_id"


def nested(files: DataFrame, functions: DataFrame, types: DataFrame) -> DataFrame:
    """One row per file with its functions and types as lists: the document form of a repository, file by file.

    Lists are as long as a file has functions; repositories are never gathered into one row.
    """
    keys = ["repo_id", "path"]
    f = functions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "signature", "is_public"))).alias("functions"))
    t = types.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "kind"))).alias("types"))
    return files.join(f, keys, "left").join(t, keys, "left").withColumn("functions", F.coalesce("functions", F.array())).withColumn("types", F.coalesce("types", F.array()))

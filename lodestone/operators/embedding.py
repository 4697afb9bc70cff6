"""TF-IDF embeddings with a persisted vocabulary, and exact similarity search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens, polynomial_hash
from ..session import cut

#: Queries of a similarity search that are broadcast at once.
QUERY_BLOCK = 4096


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(word, df): number of documents that have the word."""
    return docs.select(F.explode(F.array_distinct(code_tokens(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(docs: DataFrame, text: str, limit: int = 10_000, dimension: int = 256) -> DataFrame:
    """(word, df, rank, slot, idf) of the ``limit`` most frequent words, ties by word.

    Only ``limit`` rows are ranked: a distributed top-k precedes the window, so the window's one task is bounded.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    top = document_frequency(docs, text).orderBy(F.desc("df"), "word").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "word")) - 1)
    return ranked.crossJoin(n).select("word", "df", "rank", (F.col("rank") % dimension).alias("slot"), F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their partition and place in it."""
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], [*b.schema.names, "part", "place"])
        n += b.num_rows


def ranked_vocabulary(df: DataFrame, n: int, dimension: int = 256) -> DataFrame:
    """(word, df, rank, slot, idf) of all words of a written frequency table, by df (most first), then word.

    The words are range-partitioned in that order and numbered within their partitions; only the partitions' sizes are
    summed up, so that no task ranks more than its range, even where most words occur once.
    """
    numbered = cut(df.select("word", "df").repartitionByRange(F.desc("df"), F.asc("word")).sortWithinPartitions(F.desc("df"), "word").mapInArrow(_numbered, "word string, df long, part int, place long"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    before = numbered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    rank = F.col("place") + F.col("before")
    return numbered.join(F.broadcast(before), "part").select("word", "df", rank.alias("rank"), (rank % dimension).alias("slot"), F.ln((F.lit(n) + 1) / (F.col("df") + 1)).alias("idf"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n) of all tokens, written once for all that follows."""
    return cut(docs.select(F.col(key).alias("key"), F.explode(code_tokens(text)).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n")))


def frequencies(terms: DataFrame) -> DataFrame:
    """(word, df) of a table of term counts, written."""
    return cut(terms.groupBy("word").agg(F.count(F.lit(1)).alias("df")))


def weights(terms: DataFrame, vocab: DataFrame, dimension: int = 256) -> DataFrame:
    """(key, slot, weight): log-normalised term frequency times idf, summed by slot; unknown words go to a hashed slot.

    An idf of zero counts as one, as for unknown words. Only distinct unknown words are hashed.
    """
    known = vocab.select("word", F.col("slot").cast("int").alias("slot"), F.when(F.col("idf") == 0, 1.0).otherwise(F.col("idf")).alias("idf"))
    strange = terms.select("word").distinct().join(known.select("word"), "word", "left_anti")
    hashed = strange.select("word", F.pmod(polynomial_hash("word"), F.lit(dimension)).cast("int").alias("slot"), F.lit(1.0).alias("idf"))
    j = terms.join(known.unionByName(hashed), "word")
    return j.select("key", "slot", ((1 + F.ln("n")) * F.col("idf")).alias("w")).groupBy("key", "slot").agg(F.sum("w").alias("weight"))


def term_weights(docs: DataFrame, key: str, text: str, vocab: DataFrame, dimension: int = 256) -> DataFrame:
    """:func:`weights` of texts."""
    return weights(term_counts(docs, key, text), vocab, dimension)


def _vectors(keys: DataFrame, w: DataFrame, dimension: int) -> DataFrame:
    cells = w.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    slots = F.sequence(F.lit(0), F.lit(dimension - 1))
    filled = F.transform(slots, lambda i: F.coalesce(F.element_at(F.col("m"), i) / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0)))
    zero = F.array_repeat(F.lit(0.0), dimension)
    return keys.join(cells, "key", "left").select("key", F.coalesce(filled, zero).alias("vector"))


def embed(docs: DataFrame, key: str, text: str, vocab: DataFrame, dimension: int = 256) -> DataFrame:
    """(key, vector) of unit length by a vocabulary made before; a document without tokens has the zero vector."""
    return _vectors(docs.select(F.col(key).alias("key")).distinct(), term_weights(docs, key, text, vocab, dimension), dimension)


def index(docs: DataFrame, key: str, text: str, limit: int = 10_000, dimension: int = 256) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) of a corpus: its texts are tokenised once, for the vocabulary and for the vectors.

    The vocabulary is a written table of at most ``limit`` rows, the model of this corpus for queries to come
    (:func:`embed`).
    """
    terms = term_counts(docs, key, text)
    n = docs.count()
    top = frequencies(terms).orderBy(F.desc("df"), "word").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("df"), "word")) - 1
    vocab = cut(top.withColumn("rank", rank).select("word", "df", "rank", (F.col("rank") % dimension).alias("slot"), F.ln((F.lit(n) + 1) / (F.col("df") + 1)).alias("idf")))
    return _vectors(docs.select(F.col(key).alias("key")).distinct(), weights(terms, vocab, dimension), dimension), vocab


#: Candidates of a block that a task gathers before it keeps the best of each query.
HELD = 1 << 18


def _best(t: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each query (q, s, key), ties to the smaller key."""
    t = t.combine_chunks()
    order = pc.sort_indices(t, sort_keys=[("q", "ascending"), ("s", "descending"), ("key", "ascending")])
    q = t["q"].take(order).to_numpy()
    first = np.ones(len(q), bool)
    first[1:] = q[1:] != q[:-1]
    place = np.arange(len(q)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(q))))
    return t.take(order.filter(pa.array(place < k)))


def _nearest(blocks, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best ``k`` of one partition for each query of the blocks, by matrix products of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = blocks.value  # (query ids, unit vectors) by length of vectors
        held: list[pa.Table | None] = [None] * len(sent)
        for b in batches:
            lists = b.column("v")
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            for j, (_, unit) in enumerate(sent):
                at = np.flatnonzero(lengths == unit.shape[1])
                if not len(at):
                    continue
                rows = lists.take(pa.array(at))
                m = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), unit.shape[1])
                norm = np.sqrt((m * m).sum(1))
                sim = (m / np.where(norm > 0, norm, 1)[:, None]) @ unit.T
                # all that reach the k-th best of the batch, so that ties are settled by key, not by place
                floor = np.partition(sim, -k, axis=0)[-k] if len(at) > k else np.full(unit.shape[0], -np.inf)
                r, q = np.nonzero((sim > 0) & (sim >= floor))
                t = pa.table({"q": pa.array(q), "s": pa.array(sim[r, q]), "key": b.column("key").take(pa.array(at[r]))})
                held[j] = t if held[j] is None else pa.concat_tables([held[j], t])
                if held[j].num_rows > max(HELD, 2 * k * unit.shape[0]):
                    held[j] = _best(held[j], k)
        for (ids, _), t in zip(sent, held):
            if t is not None and t.num_rows:
                t = _best(t, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(t["q"].combine_chunks()), t["key"].combine_chunks(), t["s"].combine_chunks()], ["query_id", "key", "similarity"])

    return run


def search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, similarity, rank) of the ``k`` most similar vectors with positive similarity to each query.

    Exact, in blocks of at most ``block`` queries: each is broadcast (its size is fixed), meets every row in one scan by
    matrix products, and leaves a written table of its best, so that neither the driver nor the plan holds more than a
    block, however many there are. A task keeps a running ``k`` best per query. No pair of vectors becomes a row of its
    own otherwise. Vectors of another length, empty, null or zero ones are similar to nothing. Ties go to the smaller key.
    """
    spark = vectors.sparkSession
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {vectors.schema[key].dataType.simpleString()}, similarity double"
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    parts: list[DataFrame] = []

    def add(ids: list, found: list[list[float]], last: bool) -> None:
        sent = []
        for n in {len(v) for v in found if v}:
            of = [i for i, v in enumerate(found) if v and len(v) == n]
            m = np.array([found[i] for i in of], np.float64)
            norm = np.sqrt((m * m).sum(1))
            good = np.flatnonzero(norm > 0)
            if len(good):
                sent.append(([ids[of[i]] for i in good], m[good] / norm[good][:, None]))
        if sent:
            scored = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(sent), k), kinds)
            best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            parts.append(best if last and not parts else cut(best))

    ids, found = [], []
    for r in queries.select("query_id", "query").toLocalIterator():
        if r["query"] is None:
            continue
        if len(ids) == block:
            add(ids, found, False)
            ids, found = [], []
        ids.append(r["query_id"])
        found.append(list(r["query"]))
    add(ids, found, True)
    if not parts:
        return spark.createDataFrame([], kinds + ", rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_vector(vectors: DataFrame, vector: str, dimension: int, by: list[str] | None = None) -> DataFrame:
    """Element-wise sum of the vectors of the given dimension by the count of all vectors, those skipped included."""
    by = by or []
    counted = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    cells = vectors.where(F.size(vector) == dimension).select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    joined = cells.join(counted, by) if by else cells.crossJoin(counted)
    return joined.select(*by, "i", (F.col("s") / F.col("n")).alias("x"))


def at_least(similarity: Column, threshold: float) -> Column:
    return similarity >= F.lit(threshold)


def function_document(name: str = "name", signature: str = "signature", description: str = "description", summary: str = "summary", steps: str = "steps", path: str = "path", effects: str = "side_effects") -> Column:
    """Text of a function for embedding; nulls and empties are skipped."""
    texts = [F.nullif(F.col(c), F.lit("")) for c in (name, signature, description, summary)]
    return F.concat_ws(" ", *texts, F.col(steps), F.nullif(F.col(path), F.lit("")), F.col(effects))


def type_document(name: str = "name", kind: str = "kind", description: str = "description", fields: str = "fields", path: str = "path") -> Column:
    """Text of a type for embedding; empties are skipped."""
    texts = [F.nullif(F.col(c), F.lit("")) for c in (name, kind, description)]
    return F.concat_ws(" ", *texts, F.transform(fields, lambda f: F.concat_ws(" ", f["name"], f["type"])), F.nullif(F.col(path), F.lit("")))


class Embedder:
    """Strategy that turns texts into vectors: the vocabulary of one corpus with its dimension; others may take its place."""

    def __init__(self, vocab: DataFrame, dimension: int = 256):
        self.vocab, self.dimension = vocab, dimension

    @classmethod
    def fit(cls, docs: DataFrame, key: str, text: str, limit: int = 10_000, dimension: int = 256) -> Embedder:
        return cls(index(docs, key, text, limit, dimension)[1], dimension)

    def embed(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector) of texts; code is text whose identifiers are cut into words."""
        return embed(docs, key, text, self.vocab, self.dimension)

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, dimension: int = 256) -> Embedder:
        return cls(spark.read.parquet(path), dimension)

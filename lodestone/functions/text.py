"""Scalar text functions over columns: keyword extraction, code tokens, names, paths, token estimates, hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: stop words of search queries, of questions and of embeddings
SEARCH_STOP = tuple("the a an and or in on at to for of with by from as is are was were".split())
ASK_STOP = tuple(
    "what where how why when is are the a an in on at to for of with by from as this that these those it its and or but do does did will would "
    "can could should must i me my we our you your they their find show get list tell".split()
)
EMBED_STOP = tuple(
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might "
    "this that these those it its if then else var let const func function".split()
)
TRIM = ".,;:!?\"'()[]{}"
ASK_TRIM = ".,?!;:'\"()[]{}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(query: Column, trim: str) -> Column:
    fields = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    return F.transform(fields, lambda w: F.btrim(w, F.lit(trim)))


def search_keywords(query: Column | str) -> Column:
    """Keywords of a search: lower case, edges trimmed, at least two bytes, no stop word; all words if none is left."""
    words = _words(_col(query), TRIM)
    kept = F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*SEARCH_STOP))
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(words, lambda w: w != ""))


def ask_keywords(query: Column | str) -> Column:
    """Keywords of a question: longer than two bytes and no stop word; no fallback."""
    return F.filter(_words(_col(query), ASK_TRIM), lambda w: (F.octet_length(w) > 2) & ~w.isin(*ASK_STOP))


def matches_all(text: Column | str, keywords: Column) -> Column:
    """Whether a text contains all keywords; false without keywords or text."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return (F.size(keywords) > 0) & F.forall(keywords, lambda k: F.contains(low, k))


def matches_any(text: Column | str, query: Column | str) -> Column:
    """Whether a text contains any query word longer than three bytes."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.exists(F.split(F.lower(_col(query)), r"\s+"), lambda w: (F.octet_length(w) > 3) & F.contains(low, w))


def code_tokens(text: Column | str, least: int = 2) -> Column:
    """Tokens of code and prose for embeddings: camel case, ``_ . / ::`` apart, lower case, stop words out, in order with repeats."""
    apart = F.regexp_replace(F.regexp_replace(_col(text), "([a-z])([A-Z])", "$1 $2"), "_|\\.|/|::", " ")
    parts = F.split(F.lower(apart), r"[^\p{L}\p{Nd}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= least) & ~t.isin(*EMBED_STOP))


def camel_words(name: Column | str) -> Column:
    """Lower-case words of a name, cut before each ASCII capital."""
    return F.transform(F.filter(F.split(_col(name), "(?=[A-Z])"), lambda w: w != ""), F.lower)


def token_estimate(text: Column | str, ratio: float = 4.0) -> Column:
    """Estimated tokens: bytes by ratio, rounded down; a ratio that isn't positive counts as 4."""
    return F.floor(F.coalesce(F.octet_length(_col(text)), F.lit(0)) / F.lit(ratio if ratio > 0 else 4.0)).cast("long")


def ellipsis(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots where cut."""
    c = _col(text)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def dirname(path: Column | str) -> Column:
    """Directory of a path; empty without a slash or with only a leading one."""
    return F.regexp_extract(_col(path), "^(.+)/[^/]*$", 1)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def package_of_path(path: Column | str) -> Column:
    """Name of the directory that holds a file; empty at the top."""
    return F.coalesce(F.try_element_at(F.split(_col(path), "/"), F.lit(-2)), F.lit(""))


def is_public_name(name: Column | str) -> Column:
    return F.coalesce(_col(name).rlike("^[A-Z]"), F.lit(False))


def clean_type_for_index(t: Column | str) -> Column:
    """Lower case, without one leading ``*``, then one ``[]``, then one ``map[``."""
    return F.regexp_replace(F.lower(_col(t)), r"^\*?(?:\[\])?(?:map\[)?", "")


def related_type_name(t: Column | str) -> Column:
    """Type name without one ``*``, one ``[]``, one ``map[`` with all up to its bracket, and all up to the first dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(t), r"^\*?(?:\[\])?(?:map\[)?", ""), r"^[^\]]*\]", ""), r"^[^.]*\.", "")


def change_type_name(t: Column | str) -> Column:
    """Type name without one prefix of each kind, then without all up to the first dot or, without one, the first bracket."""
    u = F.regexp_replace(_col(t), r"^\*?(?:\[\])?(?:map\[)?", "")
    return F.when(u.rlike(r"^[^.]+\."), F.regexp_replace(u, r"^[^.]*\.", "")).when(u.rlike(r"^[^\]]+\]"), F.regexp_replace(u, r"^[^\]]*\]", "")).otherwise(u)


def camel_parts(name: Column | str) -> Column:
    """Parts of a name as they are, cut before each capital of any script."""
    return F.filter(F.split(_col(name), r"(?=\p{Lu})"), lambda w: w != "")


def spaced_words(name: Column | str) -> Column:
    """Words of a name in lower case, joined by blanks."""
    return F.array_join(camel_words(name), " ")


def base_type(t: Column | str) -> Column:
    """Type name without pointers, slices, maps, variadic dots and package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(t), r"^(?:\.\.\.|\*|\[\d*\])+", ""), r"^map\[[^\]]*\](?:\*|\[\])*", ""), r"^.*\.", "")


def repo_id_of_url(url: Column | str) -> Column:
    """Repository id: no scheme, no ``git@``, no ``.git``, a colon as a slash."""
    u = F.regexp_replace(F.regexp_replace(_col(url), r"\.git$", ""), r"^(?:https?://|ssh://|git@)+", "")
    return F.replace(u, F.lit(":"), F.lit("/"))


def file_safe(repo_id: Column | str) -> Column:
    return F.regexp_replace(_col(repo_id), "[/:]", "_")


def polynomial_hash(word: Column | str) -> Column:
    """h = h * 31 + code point + byte offset in 64 bits with wraparound, made non-negative by ``pmod`` of the caller.

    Needs arithmetic that wraps, which ANSI SQL refuses; so an Arrow UDF.
    """

    @F.pandas_udf("long")
    def run(words: pd.Series) -> pd.Series:
        def one(w: str | None) -> int | None:
            if w is None:
                return None
            h = at = 0
            for ch in w:
                h = (h * 31 + ord(ch) + at) & 0xFFFFFFFFFFFFFFFF
                at += len(ch.encode("utf-8", "replace"))
            h -= (h >> 63) << 64
            return -h if -(2**63) < h < 0 else h

        return words.map(one).astype("Int64")

    return run(_col(word))


def mermaid_text(c: Column | str) -> Column:
    return F.replace(F.replace(_col(c), F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" "))


def dot_text(c: Column | str) -> Column:
    return F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def node_id(c: Column | str) -> Column:
    """Letters and digits of a name, all else as ``_``."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_]", "_")


# fixed values: SQL verbs and what follows them
_TABLES = (r"FROM\s+(\w+)", r"INSERT\s+INTO\s+(\w+)", r"UPDATE\s+(\w+)", r"DELETE\s+FROM\s+(\w+)")


def sql_table(sql: Column | str) -> Column:
    """Table named first after FROM, else INSERT INTO, UPDATE, DELETE FROM; lower case, null without one."""
    up = F.upper(_col(sql))
    return F.lower(F.coalesce(*[F.nullif(F.regexp_extract(up, p, 1), F.lit("")) for p in _TABLES]))


def verb_of_name(name: Column | str) -> Column:
    """HTTP verb that a handler's name suggests; empty without a hint."""
    n = F.lower(_col(name))
    starts = lambda *p: n.rlike("^(?:" + "|".join(p) + ")")
    return (
        F.when(starts("get", "list", "fetch"), "GET").when(starts("create", "post", "add"), "POST").when(starts("update", "put", "edit"), "PUT")
        .when(starts("delete", "remove"), "DELETE").when(starts("handle"), "ANY").otherwise("")
    )


def doc_routes(comment: Column | str) -> Column:
    """Routes of ``@Router path [verb]`` comments: array of structs (path, method), method in upper case."""
    c = _col(comment)
    pattern = F.lit(r"@Router\s+(\S+)\s+\[(\w+)\]")
    return F.zip_with(F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2)), lambda p, m: F.struct(p.alias("path"), F.upper(m).alias("method")))


def pr_of_url(url: Column | str) -> Column:
    """struct(owner, repo, number) of a pull request's address; null where it is none."""
    c = F.regexp_replace(_col(url), "[?#].*$", "")
    p = r"^https?://[^/]+/([^/]+)/([^/]+)/pull/(\d+)(?:/.*)?$"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("owner"), F.regexp_extract(c, p, 2).alias("repo"), F.regexp_extract(c, p, 3).cast("long").alias("number")))


def vector_id(repo_id: Column, kind: str, path: Column, name: Column) -> Column:
    """Identity of a function's or type's vector; equal names of one file share it."""
    return F.concat_ws(":", repo_id, F.lit(kind), path, name)

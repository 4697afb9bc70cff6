"""Chains of lazy steps: variables, conditions, middleware, canned patterns; the answers of routed questions."""

from __future__ import annotations

import logging
import random
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as LateError
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import graph, search
from ..operators.router import CONFIDENCE, DEFAULT_CONFIDENCE, NOT_FOUND, classify


@dataclass
class Result:
    """Outcome of one step."""

    step: str
    ok: bool
    data: Any = None
    error: str = ""
    seconds: float = 0.0
    tokens: int = 0


@dataclass
class Context:
    """State of a chain: results so far and variables."""

    variables: dict[str, Any] = field(default_factory=dict)
    results: list[Result] = field(default_factory=list)
    stopped: bool = False

    @property
    def last(self) -> Result | None:
        return self.results[-1] if self.results else None

    @property
    def last_data(self) -> Any:
        return next((r.data for r in reversed(self.results) if r.ok), None)


def substitute(value: Any, variables: dict[str, Any]) -> Any:
    """``{{name}}`` as a whole text by the variable, also within mappings; other texts and lists stay."""
    if isinstance(value, dict):
        return {k: substitute(v, variables) for k, v in value.items()}
    m = re.fullmatch(r"\{\{\s*(\w+)\s*\}\}", value) if isinstance(value, str) else None
    return variables.get(m[1], value) if m else value


@dataclass
class Step:
    """A named operation with parameters, an optional condition and transformation, and a variable for its result."""

    name: str
    run: Callable[..., Any]
    params: dict[str, Any] = field(default_factory=dict)
    when: Callable[[Context], bool] | None = None
    transform: Callable[[Any], Any] | None = None
    store: str = ""


class Chain:
    """Steps in order, each through the middleware; the first failure ends it. What was added first is outermost."""

    def __init__(self, *steps: Step):
        self.steps, self.middleware = list(steps), []

    def use(self, *middleware) -> Chain:
        self.middleware += middleware
        return self

    def then(self, step: Step) -> Chain:
        self.steps.append(step)
        return self

    def call(self, name: str, run: Callable[..., Any], /, **params: Any) -> Chain:
        """Add a step by its parts."""
        return self.then(Step(name, run, params))

    def call_if(self, when: Callable[[Context], bool], name: str, run: Callable[..., Any], /, **params: Any) -> Chain:
        """Add a step that runs only if the condition holds then."""
        return self.then(Step(name, run, params, when=when))

    def call_into(self, into: str, name: str, run: Callable[..., Any], /, **params: Any) -> Chain:
        """Add a step whose result goes to a variable."""
        return self.then(Step(name, run, params, store=into))

    def run(self, **variables: Any) -> Context:
        ctx = Context(dict(variables))
        for s in self.steps:
            if ctx.stopped:
                break
            if s.when and not s.when(ctx):
                continue
            call = lambda step, c: Result(step.name, True, step.run(**substitute(step.params, c.variables)))
            for m in reversed(self.middleware):
                call = m(call)
            try:
                r = call(s, ctx)
            except Exception as e:  # a step's failure is a result
                r = Result(s.name, False, error=str(e))
            if r.ok and s.transform:
                r.data = s.transform(r.data)
            ctx.results.append(r)
            if not r.ok:
                break
            if s.store:
                ctx.variables[s.store] = r.data
        return ctx


def timing(call):
    def run(step, ctx):
        t = time.monotonic()
        r = call(step, ctx)
        r.seconds = time.monotonic() - t
        return r

    return run


def backoff(attempt: int, initial: float, multiplier: float = 2.0, most: float = 60.0, jitter: float = 0.0) -> float:
    """Seconds before a further attempt: growing by the multiplier, capped, moved by at most the jitter's share."""
    wait = min(initial * multiplier**attempt, most)
    return wait + wait * jitter * random.uniform(-1, 1) if jitter > 0 else wait


def retry(times: int, wait: float = 0.0, most: float = 60.0, jitter: float = 0.0):
    """Try again after failures, waiting by :func:`backoff`."""

    def wrap(call):
        def run(step, ctx):
            for i in range(times + 1):
                try:
                    return call(step, ctx)
                except Exception:
                    if i == times:
                        raise
                    time.sleep(backoff(i, wait, most=most, jitter=jitter))

        return run

    return wrap


def logged(logger: logging.Logger):
    """Write each call and its outcome to a logger."""

    def wrap(call):
        def run(step, ctx):
            logger.info("call %s", step.name)
            try:
                r = call(step, ctx)
            except Exception as e:
                logger.warning("failed %s: %s", step.name, e)
                raise
            logger.info("done %s", step.name) if r.ok else logger.warning("failed %s: %s", step.name, r.error)
            return r

        return run

    return wrap


def on_error(handler: Callable[[Step, str], bool]):
    """Ask a handler after a failure whether to go on; if not, the chain stops."""

    def wrap(call):
        def run(step, ctx):
            try:
                r = call(step, ctx)
            except Exception as e:
                r = Result(step.name, False, error=str(e))
            if not r.ok and not handler(step, r.error):
                ctx.stopped = True
            return r

        return run

    return wrap


def transformed(change: Callable[[Result], Result]):
    """Put each result through a function."""
    return lambda call: lambda step, ctx: change(call(step, ctx))


def stored(prefix: str):
    """Keep each successful result under ``<prefix>_<step>``."""

    def wrap(call):
        def run(step, ctx):
            r = call(step, ctx)
            if r.ok and r.data is not None:
                ctx.variables[f"{prefix}_{step.name}"] = r.data
            return r

        return run

    return wrap


def within(seconds: float):
    """Fail a step that takes longer; what it began is left to end by itself."""

    def wrap(call):
        def run(step, ctx):
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(call, step, ctx).result(seconds)
            except LateError:
                return Result(step.name, False, error=f"timeout after {seconds} s")
            finally:
                pool.shutdown(wait=False)

        return run

    return wrap


@dataclass
class Metrics:
    """Counts over all calls of a chain."""

    calls: int = 0
    successes: int = 0
    failures: int = 0
    tokens: int = 0
    seconds: float = 0.0


def measured(metrics: Metrics):
    """Add each call to the metrics."""

    def wrap(call):
        def run(step, ctx):
            t, ok, tokens = time.monotonic(), False, 0
            try:
                r = call(step, ctx)
                ok, tokens = r.ok, r.tokens
                return r
            finally:
                metrics.calls += 1
                metrics.successes += ok
                metrics.failures += not ok
                metrics.tokens += tokens
                metrics.seconds += time.monotonic() - t

        return run

    return wrap


@dataclass
class TokenBudget:
    """A token allocation."""

    total: int
    used: int = 0

    @property
    def remaining(self) -> int:
        return self.total - self.used

    def fits(self, tokens: int) -> bool:
        return tokens <= self.remaining

    def use(self, tokens: int) -> bool:
        """Take tokens if they fit; says whether they did."""
        ok = self.fits(tokens)
        self.used += tokens * ok
        return ok

    def reset(self) -> None:
        self.used = 0

    @property
    def percent(self) -> float:
        return 100.0 * self.used / self.total if self.total else 0.0


def cached(store: dict):
    """Keep successful results by step name and parameters; frames stay lazy."""

    def wrap(call):
        def run(step, ctx):
            key = (step.name, repr(sorted(substitute(step.params, ctx.variables).items(), key=lambda x: x[0])))
            if key not in store:
                r = call(step, ctx)
                if not r.ok:
                    return r
                store[key] = r
            return store[key]

        return run

    return wrap


def budget(limit: int, ratio: float = 4.0):
    """Fail a step after whose texts the chain would exceed a token budget; frames count by one aggregate of their text columns."""

    def wrap(call):
        def run(step, ctx):
            r = call(step, ctx)
            if isinstance(r.data, DataFrame):
                texts = [c for c, t in r.data.dtypes if t == "string"]
                r.tokens = int(r.data.agg(F.sum(sum((token_estimate(c, ratio) for c in texts), F.lit(0)))).first()[0] or 0) if texts else 0
            else:
                r.tokens = int(len(str(r.data or "").encode()) / ratio)
            if sum(x.tokens for x in ctx.results) + r.tokens > limit:
                return Result(step.name, False, error="token budget exceeded", tokens=r.tokens)
            return r

        return run

    return wrap


def summarize(ctx: Context) -> dict[str, Any]:
    """Steps, successes, seconds and tokens of a run."""
    return {"steps": len(ctx.results), "successes": sum(r.ok for r in ctx.results), "seconds": sum(r.seconds for r in ctx.results), "tokens": sum(r.tokens for r in ctx.results)}


@dataclass
class Store:
    """The tables that questions are answered from; functions may also have side_effects, behavior and summaries."""

    functions: DataFrame
    calls: DataFrame
    types: DataFrame
    files: DataFrame

    def of(self, *repos: str) -> Store:
        """The same for some repositories only."""
        return Store(*(t.where(F.col("repo_id").isin(*repos)) for t in (self.functions, self.calls, self.types, self.files)))


def _search(store: Store, query: str, limit: int) -> DataFrame:
    """Keywords over functions, types and files; missing texts count as null."""
    filled = lambda df, *cols: df.select("*", *[F.lit(None).cast("string").alias(c) for c in cols if c not in df.columns])
    return search.keyword_search(filled(store.functions, "description", "signature"), filled(store.types, "description"), filled(store.files, "purpose"), query, limit)


def find_and_expand(functions: DataFrame, calls: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Functions found by keywords with the number of their callers."""
    none = F.lit(None).cast("string")
    found = search.keyword_search(functions.withColumn("description", none), functions.where(F.lit(False)).withColumn("description", none), functions.where(F.lit(False)).withColumn("purpose", none), query, limit)
    n = calls.groupBy("repo_id", F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("n_callers"))
    return found.join(n, ["repo_id", "name"], "left").select("repo_id", "path", "name", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def impact_analysis(functions: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """Callers of a function with their own callers counted."""
    direct = graph.callers(calls, name)
    n = calls.groupBy("repo_id", F.col("callee").alias("caller")).agg(F.count(F.lit(1)).alias("n_callers"))
    return direct.join(n, ["repo_id", "caller"], "left").select("repo_id", "caller_path", "caller", "line", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def search_with_context(store: Store, query: str, limit: int = 20) -> Chain:
    """Search, then the callers and callees of the first function found; no second step if nothing was found."""

    def first(ctx: Context) -> bool:
        row = ctx.last_data.where("kind = 'function'").select("repo_id", "path", "name").first()
        ctx.variables["first"] = row
        return row is not None

    return Chain().call_into("search_results", "search", _search, store=store, query=query, limit=limit).call_if(first, "context", lambda at: graph.function_context(store.calls, *at), at="{{first}}")


def multi_repo_search(store: Store, repos: list[str], query: str, limit: int = 20) -> Chain:
    """Search one repository after the other, all results together at the end: one plan, ``limit`` rows of each."""
    chain = Chain()
    for repo in repos:
        chain.call(f"search {repo}", _search, store=store.of(repo), query=query, limit=limit)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return chain.then(Step("all", union, {"parts": "{{parts}}"}, when=lambda c: bool(c.variables.__setitem__("parts", [r.data for r in c.results if r.ok]) or c.results)))


# fixed values: canned patterns
PATTERNS = {
    "find_and_expand": ("Find functions and expand the best with callers", find_and_expand), "search_with_context": ("Search functions and give them with their context", search_with_context),
    "impact_analysis": ("Who would be touched by a change of a function", impact_analysis), "multi_repo_search": ("Search over several repositories", multi_repo_search),
}


def _with_effect(store: Store, effect: str) -> DataFrame:
    return store.functions.where(F.array_contains("side_effects", effect))


def _with_concept(store: Store, concept: str) -> DataFrame:
    return store.functions.where(F.array_contains(search.name_concepts(F.col("name"), "store"), concept))


def analyze_function(store: Store, repo_id: str, path: str, name: str) -> Chain:
    """A function's context, then its callers."""
    chain = Chain().use(timing).call_into("function_context", "context", graph.function_context, calls=store.calls, repo_id=repo_id, path=path, name=name)
    return chain.call_into("callers", "callers", graph.callers, calls=store.calls.where(F.col("repo_id") == repo_id), name=name)


def database_operations(store: Store) -> Chain:
    """Functions that read and that write databases; no extractor tells writes apart, so their list is empty."""
    return Chain().use(timing).call_into("db_reads", "reads", _with_effect, store=store, effect="db_query").call_into("db_writes", "writes", _with_effect, store=store, effect="db_write")


def http_endpoints(store: Store) -> Chain:
    """Handlers and the functions that call other services."""
    return Chain().use(timing).call_into("handlers", "handlers", _with_concept, store=store, concept="handler").call_into("http_calls", "calls", _with_effect, store=store, effect="http_call")


# fixed values: concepts of the words that questions use, where the word isn't the concept's own name
CONCEPT_OF = {"auth": "authentication", "login": "authentication", "validate": "validation", "endpoint": "handler", "route": "handler", "exception": "error", "caching": "cache", "create": "crud", "read": "crud", "update": "crud", "delete": "crud"}


@dataclass
class Answer:
    """Lazy rows that answer a question, with the confidence if there are any and whether a model would be needed."""

    intent: str
    argument: str
    rows: DataFrame
    needs_ai: bool = False

    def confidence(self, found: bool = True) -> float:
        return CONFIDENCE[self.intent] if found else NOT_FOUND.get(self.intent, DEFAULT_CONFIDENCE)


def handle(store: Store, intent: str, argument: str = "") -> DataFrame:
    """Rows of one intent; none for a general question."""
    low = argument.lower()
    named = F.lower("name") == low
    if intent == "function":
        return store.functions.where(named)
    if intent == "type":
        return store.types.where(named)
    if intent == "side_effect":
        return _with_effect(store, low or "db_query") if "side_effects" in store.functions.columns else store.functions.where(F.lit(False))
    if intent == "concept":
        return _with_concept(store, CONCEPT_OF.get(low, low))
    if intent == "callers":
        return store.calls.where(F.lower("callee") == low)
    kind = F.coalesce("call_type", F.lit(""))
    made = store.calls.where(F.lower("caller") == low)
    if intent == "calls":
        return made.withColumn("origin", F.when(kind.isin("internal", "stdlib"), kind).otherwise("external")).orderBy("repo_id", "caller_path", "line", "callee")
    if intent == "flow" and low:
        told = store.functions.select("repo_id", F.col("name").alias("callee"), (F.col("behavior.summary") if "behavior" in store.functions.columns else F.lit(None).cast("string")).alias("summary"))
        told = told.groupBy("repo_id", "callee").agg(F.min("summary").alias("summary"))
        steps = made.where(kind == "internal").select("repo_id", F.col("caller_path").alias("path"), F.col("caller").alias("name"), "line", "callee")
        return steps.join(told, ["repo_id", "callee"], "left").orderBy("repo_id", "path", "line", "callee")
    if intent == "file":
        return store.files.where(F.contains("path", F.lit(argument)))
    if intent == "package":
        part = argument.strip("/")
        inner = F.split(F.substr("path", F.instr("path", part)), "/")
        folder = F.when(F.size(inner) > 2, F.concat_ws("/", F.get(inner, F.lit(0)), F.get(inner, F.lit(1)))).otherwise(F.get(inner, F.lit(0)))
        return store.functions.where(F.contains("path", F.lit(part))).groupBy("repo_id", folder.alias("dir"), "path").agg(F.count(F.lit(1)).alias("n_functions"), F.count_if("is_public").alias("n_public")).orderBy("dir", "repo_id", "path")
    if intent in ("architecture", "flow"):
        return store.functions.groupBy("package").agg(F.count(F.lit(1)).alias("n_functions"), F.count_distinct("path").alias("n_files"))
    return store.functions.where(F.lit(False))


def answer(store: Store, question: str) -> Answer:
    """Intent, argument and lazy rows for a question. A question that names nothing where a name is needed needs a model."""
    row = store.functions.sparkSession.range(1).select(classify(F.lit(question)).alias("c")).first()["c"]
    intent, arg = row["intent"], row["argument"] or ""
    blank = intent == "general" or not arg and intent in ("function", "type", "concept", "callers", "calls", "file", "package")
    return Answer(intent, arg, handle(store, "general" if blank else intent, arg), blank)


def get_or_analyze(lookup: Callable[[], DataFrame], analyze: Callable[[], Any]) -> DataFrame:
    """What a lookup gives; if nothing, the same after an analysis."""
    found = lookup()
    if found.limit(1).count():
        return found
    analyze()
    return lookup()


def analyze_each(items: list[Any], analyze: Callable[[Any], Any], at_once: int = 3, final: Callable[[Exception], bool] = lambda e: isinstance(e, (FileNotFoundError, ValueError))) -> dict[Any, Result]:
    """Start the analyses of several repositories, at most ten at once; each is tried twice unless its failure is final."""

    def one(item: Any) -> Result:
        for attempt in range(2):
            try:
                return Result(str(item), True, analyze(item))
            except Exception as e:
                failed = Result(str(item), False, error=str(e))
                if final(e):
                    break
        return failed

    with ThreadPoolExecutor(max(1, min(at_once, 10))) as pool:
        return dict(zip(items, pool.map(one, items)))


def captured(rows: list[tuple], tool: str, call: Callable[..., Any], clock: Callable[[], float] = time.time) -> Callable[..., Any]:
    """A tool whose use is recorded: (tool, tokens in and out by length, milliseconds, success, message, time).

    The rows go to the usage table in batches by the caller; a failure is recorded and raised again.
    """

    def run(**params: Any) -> Any:
        began, ok, message, out = clock(), False, "", None
        try:
            out = call(**params)
            ok = True
            return out
        except Exception as e:
            message = str(e)
            raise
        finally:
            rows.append((tool, len(str(params)) // 4, 0 if out is None or isinstance(out, DataFrame) else len(str(out)) // 4, int((clock() - began) * 1000), ok, message, began))

    return run


# fixed values: tools with the size and cost of their answers, whether they need a model, and what they are used for
HINTS = (
    ("analyze_repo", "small", "expensive", False, "initial setup; index new repository"), ("analyze_local", "small", "cheap", False, "analyze local codebase; index project on disk"),
    ("get_context", "large", "cheap", False, "get full repo overview; understand repository structure"), ("list_repos", "small", "free", False, "see available repositories; check what's analyzed"),
    ("search_context", "medium", "free", False, "find functions by name; search for types"), ("search_by_concept", "medium", "free", False, "find authentication code; locate validation logic; find handlers"),
    ("search_by_side_effect", "medium", "free", False, "find database queries; locate HTTP calls; find file I/O"), ("get_callers", "small", "free", False, "find who calls a function; understand dependencies"),
    ("smart_query", "medium", "free", False, "natural language questions; quick lookups"), ("get_function_context", "medium", "free", False, "understand function behavior; see what a function does"),
    ("compare_repos", "large", "cheap", False, "compare repositories; find differences"), ("find_duplicates", "medium", "cheap", False, "find duplicate code; identify copy-paste"),
    ("find_conflicts", "medium", "cheap", False, "find conflicting implementations; pre-merge analysis"), ("find_gaps", "medium", "cheap", False, "find missing functionality; gap analysis"),
    ("generate_ai_summary", "medium", "expensive", True, "get AI-generated overview; understand unfamiliar repo"), ("generate_ai_arch_analysis", "medium", "expensive", True, "get AI architecture analysis; understand system design"),
    ("ask", "medium", "expensive", True, "ask questions about code; get AI explanations"), ("refresh_ai_context", "small", "expensive", True, "update AI summaries; regenerate AI context"),
    ("review_pr", "large", "expensive", True, "review pull request; get code review feedback"), ("get_pr_context", "large", "cheap", False, "understand PR changes; pre-review analysis"),
    ("refresh_file", "tiny", "free", False, "update single file after edit; keep context fresh"), ("refresh_changed", "small", "cheap", False, "update all changed files; sync after refactoring"),
    ("list_skills", "small", "free", False, "see available skills; find specialized prompts"), ("get_skill", "medium", "free", False, "get skill prompt; use specialized guidance"),
    ("semantic_search", "medium", "cheap", False, "find similar code; semantic code search; find conceptually related functions"), ("index_repository", "small", "cheap", False, "enable semantic search; create vector embeddings"),
    ("get_context_budgeted", "medium", "free", False, "get context within token limit; fit context in prompt; efficient context retrieval"), ("execute_pattern", "large", "cheap", False, "automate tool workflows; chain tool calls; complex analysis"),
    ("list_patterns", "small", "free", False, "see available patterns; discover workflows"),
)
# fixed values: skills with category, tags and the tools they use
SKILLS = (
    ("go-expert", "development", "go golang best-practices code-review", "ask search_context get_context"), ("pr-review", "code-review", "pr pull-request code-review github", "review_pr ask search_context get_context compare_repos"),
    ("code-analysis", "analysis", "analysis architecture patterns dependencies", "ask get_context search_context compare_repos"), ("security-review", "security", "security vulnerabilities owasp authentication", "review_pr ask search_context"),
    ("performance-review", "performance", "performance optimization memory latency", "review_pr ask search_context"), ("test-generation", "development", "testing unit-tests integration-tests tdd", "ask search_context get_context"),
    ("refactoring", "development", "refactoring clean-code technical-debt patterns", "ask search_context get_context compare_repos"), ("documentation", "documentation", "documentation godoc readme api-docs", "ask get_context search_context"),
)


def skills(spark, category: str | None = None) -> DataFrame:
    """Static frame of skills: name, category, tags, uses_tools; of one category if asked."""
    df = spark.createDataFrame(SKILLS, "name string, category string, tags string, tools string").select("name", "category", F.split("tags", " ").alias("tags"), F.split("tools", " ").alias("uses_tools"))
    return df.where(F.col("category") == category) if category else df


def hints(spark, use: str | None = None) -> DataFrame:
    """Static frame of tools: name, output_size, cost_level, requires_ai, use_cases; those for a use if one is named."""
    df = spark.createDataFrame(HINTS, "name string, output_size string, cost_level string, requires_ai boolean, uses string").withColumn("use_cases", F.split("uses", "; ")).drop("uses")
    return df.where(F.exists("use_cases", lambda u: F.contains(F.lower(u), F.lit(use.lower())))) if use else df


def render(df: DataFrame, title: str, limit: int = 20) -> str:
    """A small result as a Markdown table; ``limit`` rows at most."""
    rows = df.limit(limit + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:limit]]
    return "\n".join([*lines, ""] + (["More rows follow."] if len(rows) > limit else []))

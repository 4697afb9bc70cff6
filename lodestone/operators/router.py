"""Questions in natural language to intents: rules in a fixed order, for one question or a column of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "[\"`]?(\\w+)[\"`]?"
# fixed values: intents with their patterns, in order of precedence; a group gives the argument
PATTERNS = (
    ("function", (f"what does (?:the )?(?:function )?{_W} do", f"how does (?:the )?(?:function )?{_W} work", f"explain (?:the )?(?:function )?{_W}", f"find (?:the )?function {_W}", f"show (?:me )?(?:the )?function {_W}", f"describe (?:the )?function {_W}")),
    ("type", (f"what is (?:the )?(?:type |struct )?{_W}", f"show (?:me )?(?:the )?(?:type |struct )?{_W} fields", f"describe (?:the )?(?:type |struct )?{_W}")),
)
LATER = (
    ("callers", (f"who calls {_W}", f"what calls {_W}", f"callers of {_W}", f"where is {_W} called", f"where is {_W} used")),
    ("calls", (f"what does {_W} call", f"what functions does {_W} use", f"dependencies of {_W}")),
    ("flow", (f"trace (?:the )?(?:flow |execution )?(?:of |from )?{_W}", f"flow of {_W}")),
)
FILES = ("file", (r"show (?:me )?(?:the )?file [\"`]?([^\s\"]+\.[a-z]+)[\"`]?", r"explain [\"`]?([^\s\"]+\.(?:go|js|ts|py))[\"`]?"))
PACKAGES = (
    "package",
    (
        r"structure of (?:the )?[\"`]?([^\s\"]+)[\"`]? (?:package|folder|directory|dir)", r"(?:package|folder|directory|dir) structure (?:of |for )?[\"`]?([^\s\"]+)[\"`]?", r"what(?:'s| is)(?: the)? (?:structure|layout) (?:of )?(?:the )?[\"`]?([^\s\"]+)[\"`]?",
        r"show (?:me )?(?:all )?files in [\"`]?([^\s\"]+)[\"`]?", r"what(?:'s| is) in (?:the )?[\"`]?([^\s\"/]+(?:/[^\s\"/]+)+)[\"`]?", r"files (?:and|&) (?:their )?purposes? in [\"`]?([^\s\"]+)[\"`]?", r"list files in [\"`]?([^\s\"]+)[\"`]?",
        r"(?:describe|explain) (?:the )?[\"`]?([^\s\"/]+(?:/[^\s\"/]+)+)[\"`]? (?:package|folder|directory)",
    ),
)
EFFECTS = (("database", "db_query"), ("db", "db_query"), ("sql", "db_query"), ("query", "db_query"), ("http", "http_call"), ("api call", "http_call"), ("external", "http_call"), ("file", "file_io"), ("read file", "file_io"), ("write file", "file_io"), ("log", "logging"), ("logging", "logging"))
EFFECT_VERBS, CONCEPT_VERBS = "find|show|which|what|list", "how|where|find|show"
CONCEPTS = tuple("authentication auth login validation validate handler endpoint route middleware error exception cache caching crud create read update delete".split())
ARCHITECTURE = "architecture|project structure|codebase structure|overview|project layout"


def classify(question: Column) -> Column:
    """struct(intent, argument) of a question; ties between words go to the first in the lists."""
    q = F.lower(F.coalesce(question, F.lit("")))
    made = lambda intent, arg: F.struct(F.lit(intent).alias("intent"), arg.cast("string").alias("argument"))
    rules: list[tuple[Column, Column]] = []

    def add(group) -> None:
        rules.extend((q.rlike(p), made(group[0], F.regexp_extract(q, p, 1))) for p in group[1])

    for g in PATTERNS:
        add(g)
    rules += [(F.contains(q, F.lit(w)) & q.rlike(EFFECT_VERBS), made("side_effect", F.lit(e))) for w, e in EFFECTS]
    rules += [(F.contains(q, F.lit(c)) & q.rlike(CONCEPT_VERBS), made("concept", F.lit(c))) for c in CONCEPTS]
    for g in LATER:
        add(g)
    rules.append((q.rlike("flow|trace"), made("flow", F.lit(""))))
    add(FILES)
    add(PACKAGES)
    word = F.coalesce(F.get(F.filter(F.split(q, r"\s+"), lambda w: F.contains(w, F.lit("/"))), F.lit(0)), F.lit(""))
    rules.append((q.rlike("structure|files") & F.contains(q, F.lit("/")), made("package", F.btrim(word, F.lit("\"'`?.,")))))
    rules.append((q.rlike(ARCHITECTURE), made("architecture", F.lit(""))))
    out = made("general", F.lit(""))
    for cond, value in reversed(rules):
        out = F.when(cond, value).otherwise(out)
    return out


# fixed values: confidence of the answer by intent
CONFIDENCE = {"function": 0.95, "type": 0.95, "side_effect": 0.9, "concept": 0.85, "callers": 0.95, "calls": 0.95, "flow": 0.9, "file": 0.95, "package": 0.95, "architecture": 0.8, "general": 0.3}
# fixed values: where nothing is found: these intents, and the default of all others
NOT_FOUND, DEFAULT_CONFIDENCE = {"function": 0.5, "type": 0.5, "package": 0.5, "general": 0.3}, 0.8

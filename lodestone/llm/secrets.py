"""Credentials embedded in source code: find and redact.

1. Every text is scanned for literals in credential positions (known formats, URLs, headers, assignments, flags, login
   lines, private keys); the literals of the whole corpus are indexed by value with the number of their owners.
2. A value with many owners is a placeholder that is copied around and is suppressed, unless it proves itself (whole
   keys, token formats, random strings); such a value and a rare one are confirmed.
3. Every text is scanned again for the confirmed values, wherever they stand, with an automaton. A text gets only the
   values whose longest run of letters and digits occurs in it (matched by hash; by a broadcast join while the values
   are few, else behind a filter whose size follows their number). Values without such a run are matched by four of
   their characters in the same way. Only texts with such a match are taken up again, so that no text is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A weak value that more owners than this have in common, and more than this share of all, is a placeholder.
MOST_OWNERS, OWNER_SHARE = 5, 1 / 12
#: Up to this many confirmed values (or texts to be searched for them) are broadcast, some 100 bytes each.
BROADCAST_VALUES, BROADCAST_TEXTS = 500_000, 100_000
#: Buckets of a filter over anchors: 16 for each value within these powers of two (8 KB to 16 MB).
FILTER_BITS = (16, 27)
#: Parts of an anchor that stands in very many texts, where values and texts are joined by shuffles.
SALT = 16
#: Characters by which a value without an anchor is matched, and characters of a text that are hashed at once.
GRAM, GRAM_BLOCK = 4, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
MASK = "[REDACTED]"

# fixed values: published formats of access tokens
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|"
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{12,}|AIza[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|"
    r"sk-[A-Za-z0-9_-]{20,}|pypi-[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,})(?![A-Za-z0-9_-])"
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_LINE = re.compile(r"\n[-+ ]?[ \t]*(?:[A-Za-z0-9+/=]{8,}|[A-Za-z-]+: [^\n]*|)[ \t]*\r?(?=\n|$)")
KEY_TEXT = re.compile(r"(?:\\[nr]|[A-Za-z0-9+/=])*\r?")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`<>]*:([^\s/\"'`<>]+)@(?=[\w.\[-])")
HEADER = re.compile(r"(?i)\b(?:authorization|x-api-key|x-auth-token|private-token)[\"']?\s*[:=,]\s*[\"']?(?:(basic|bearer|token|apikey)\s+)?([A-Za-z0-9+/=_.~-]{8,})")
ASSIGN = re.compile(r"(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,80})(?P<q>[\"']?)\]?(?P<op>[ \t]*(?::=|=>|=|:)[ \t]*)(?P<value>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s\"'`]\S*)(?P<more>(?:[ \t]*[+.][ \t]*[\"'][^\"'\n]*[\"'])*)")
LOGIN = re.compile(r"(?i)(?:\blogin\s+\S+\s+|\buser(?:name)?\s+\S+\s+|[/,|]\s*)(?:password|passwd|pass|pwd|pw)[:=]?\s+(\S+)")
FLAG = re.compile(r"(?i)(?<![\w-])--?(?:[a-z-]*(?:token|password|passwd|secret|api-?key|access-key))[= ]\s*(\"[^\"\n]*\"|'[^'\n]*'|\S+)")
CURL_USER = re.compile(r"(?<!\S)(?:-u|--user)[= ]\s*[\"']?[\w.-]+:([^\s\"']+)")
WEBHOOK = re.compile(r"https://(?:hooks\.[\w.-]+/services/|[\w.-]+/api/webhooks/)([A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*)")
#: Values behind a name in a string of settings (user=a;password=b) or in the query of an address.
SETTING = re.compile(r"(?i)(?:[;?&,\"']|^)[ \t]*(?P<name>password|pwd|(?:shared)?access_?key|account_?key|shared_?secret|api_?key|access_?token|auth_?token|client_?secret|secret_?key)[ \t]*=[ \t]*(?P<value>[^;&\s\"'`<>]+)(?=[;&\"'`\s]|$)")
#: A name and its value as arguments of a call that stores them, and the value as that of a method named after it.
STORED = re.compile(r"(?i)\b(?:put|set\w*|add\w*|header|setenv|env|option|config|define|property|insert|with\w*)\(\s*[\"'](?P<name>[\w.-]+)[\"']\s*,\s*[\"'](?P<value>[^\"'\n]+)[\"']\s*\)")
SETTER = re.compile(r"(?:\b(?:set|with|use)_?|\.)(?P<name>[A-Za-z]\w*)\(\s*[\"'](?P<value>[^\"'\n]+)[\"']\s*\)")
ELEMENT = re.compile(r"<(?P<name>[\w.:-]+)(?:\s[^<>]*)?>(?P<value>[^<>\s]+)</(?P=name)>")
ATTRIBUTE = re.compile(r"(?i)\b(?:key|name|id)=[\"'](?P<name>[\w.:-]+)[\"'][^<>\n]*?\bvalue=[\"'](?P<value>[^\"'\n]+)[\"']")
IDENTIFIED = re.compile(r"(?i)\b(?:identified\s+(?:with\s+\S+\s+)?by|with\s+password|password\s*\()\s*(?:password\s*)?['\"]([^'\"\n]+)['\"]")
CONNECT = re.compile(r"(?i)\b\w*(?:connect|login|log_in|dial|authenticate|basic_?auth)\w*\(\s*(?:[\"'][^\"'\n]*[.:/][^\"'\n]*[\"']\s*,\s*)?[\"'][\w.@-]+[\"']\s*,\s*[\"']([^\"'\n]+)[\"']")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# fixed values: last words of names that hold credentials, and words of values that hold none
PASSWORDS = frozenset("password passwd pass pwd pw passphrase passcode".split())
KEY_OWNERS = frozenset("api access account secret auth signing encryption master private client service".split())
TOKENS = frozenset("token secret apikey authtoken credential credentials auth pat".split())
PHRASE_WORDS = frozenset("a an the is are be must should may can not no your enter please for from with of to in and or if password passphrase".split())
# fixed values: parts of a line without which it holds no named credential; the second ones as whole words
NAMES = "pass identified connect login dial pwd secret token key auth cred --user".split()
SHORT_NAMES = "pw pat -u".split()
NOT_LITERAL = re.compile(
    r"(?i)^(?:[$@&<{\[]|%[sdvqr(]\W*$|%\(|%\w+%$|(?-i:\*[a-z_-]*$)|.*(?:\$\{|\{\{|\$\(|%\(|<[a-z]|\*{3}|\.{3}|…)|(?:null|none|nil|true|false|undefined|empty|string|str|required|optional)(?:[,;)]|$)|"
    r"example(?![a-z])|.*(?:redacted|change[-_ ]?me|placeholder|[-_. ]example|example[-_. ]|example(?:key|token|secret|pass|password)?$|your[-_ ]|dummy|fake[-_]|todo[-_:]|insert[-_ ]|replace[-_ ]me|getenv|environ|process\.env|vault[:/.]|secretsmanager|arn:|ref\+|op://))"
)
#: Names in camel or snake case, which only look random.
NAMELIKE = re.compile(r"(?:[A-Z]?[a-z]{3,}+|[A-Z]{2,}+)+|[a-z]+(?:[_.-][a-z]+)+")
REFERENCE = re.compile(r"^[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*(?:\(.*|\[.*)$|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")
EDGE = re.compile(r"[A-Za-z0-9]")


def placeholder(v: str) -> bool:
    """Whether a value stands for another: a reference, a known sample, or largely a run of the letter x."""
    return bool(NOT_LITERAL.search(v)) or any(len(m) * 3 >= len(v) for m in re.findall("(?i)x{4,}", v))


def entropy(v: str) -> float:
    """Bits per character."""
    n = len(v)
    return -sum(c / n * log2(c / n) for c in Counter(v).values()) if n else 0.0


def _varied(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z0-9]"))


def plausible_password(v: str) -> bool:
    """A literal that can be a password: no reference, no placeholder, no plain word."""
    if len(v) < 5 or re.search(r"\s", v) or placeholder(v) or len(set(v)) < 4:
        return False
    return bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) or (bool(re.search("[a-z]", v)) and bool(re.search(r"[A-Z]", v[1:])) and len(v) >= 6) or _varied(v) >= 3


def proven(v: str) -> bool:
    """Whether a value is a credential by itself, however many hold it: a whole key, a token format or a random string.
    Documented samples, series like 0123456789abcdef and repeated characters aren't."""
    if v.startswith(("key:", "sample:")):
        return v.startswith("key:")
    if placeholder(v) or entropy(v) < 3.0 or sum(abs(ord(a) - ord(b)) == 1 for a, b in zip(v, v[1:])) * 2 > len(v):
        return False
    return bool(FORMATS.fullmatch(v)) or len(v) >= 20 and entropy(v) >= 3.3 and plausible_token(v, True)


def searched(v: str) -> bool:
    """Whether a confirmed value is looked for everywhere: all but whole keys, which are found by their frame, and short
    plain words ("pass" in an address) and scraps of joined literals, which mean nothing elsewhere."""
    if v.startswith(("key:", "sample:")) or len(v) < GRAM:
        return False
    return len(v) >= 6 or bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) or _varied(v) >= 3


def plausible_phrase(v: str) -> bool:
    """Words of a passphrase: several, and none of those that only a message about one has."""
    words = v.split()
    return len(words) >= 4 and not placeholder(v) and all(re.fullmatch(r"[A-Za-z0-9'-]+", w) for w in words) and not PHRASE_WORDS & {w.lower() for w in words}


def plausible_bare(v: str) -> bool:
    """A literal without quotes, spaced from its name: no identifier has such a mixture of digits and letters."""
    return plausible_password(v) and len(v) >= 8 and len(re.findall(r"\d", v)) >= 2 and _varied(v) >= 3 and not re.search(r"[A-Za-z]{4}|[()\[\]]", v)


def plausible_token(v: str, generic: bool) -> bool:
    """A literal that can be a token or key; under a generic name ("...Key") only if it looks random."""
    if not plausible_password(v) or "://" in v:
        return False
    if not generic:
        return len(v) >= 6 and not re.fullmatch(r"[\w-]+(?:/[\w.-]+)+", v) or entropy(v) > 4
    return len(v) >= 16 and bool(re.fullmatch(r"[A-Za-z0-9+/=_.~-]+", v)) and entropy(v) >= 3.0 and (bool(re.search(r"\d", v)) or (len(v) >= 20 and _varied(v) >= 2 and entropy(v) >= 3.7 and not NAMELIKE.fullmatch(v))) and not re.search(r"(?:^|[/_.-])[a-z]{3,}[/_.-][a-z]{3,}(?:[/_.-]|$)", v)


def _basic(v: str) -> bool:
    try:
        user, sep, password = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return bool(sep) and len(password) >= 4 and not placeholder(password)


def _unquoted(v: str) -> tuple[str, int]:
    """(literal, offset of its first character)."""
    if len(v) >= 2 and v[0] in "\"'`" and v[-1] == v[0]:
        return v[1:-1], 1
    return v, 0


def _kind(name: str) -> str | None:
    """What a name says its value is: password, token or generic (a key that may be of any sort); None if no credential."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if not words or "public" in words:
        return None
    last, before = words[-1], words[-2:-1]
    if last in ("key", "keys"):
        return "token" if before and before[0] in KEY_OWNERS else "generic"
    if last in PASSWORDS:
        return "phrase" if last == "passphrase" else "password"
    return "token" if last in TOKENS else None


def _plausible(kind: str, v: str) -> bool:
    if kind == "phrase" and plausible_phrase(v):
        return True
    return plausible_password(v) if kind in ("password", "phrase") else plausible_token(v, kind == "generic")


def _assigned(m: re.Match, text: str) -> tuple[str, int, int] | None:
    """(value, start, end) of an assignment to a credential name."""
    kind = _kind(m["name"])
    if not kind:
        return None
    raw, quoted = m["value"], m["value"][0] in "\"'`"
    start, more = m.start("value"), m["more"]
    if not quoted:
        # a bare value counts where configuration has one: directly after = or : at the line's first name
        line = text.rfind("\n", 0, m.start()) + 1
        before = text[line : m.start()].lstrip("+- \t").lstrip("/#;*").strip().strip("\"'")
        spaced = m["op"].strip() in ("=", ":=") and m["op"] != m["op"].strip()
        if spaced:
            v = raw.rstrip(",;")
            ends = re.compile(r"[ \t\r;]*(?:\n|$)").match(text, m.end())
            ok = not before and ends and m["op"].strip() == "=" and not REFERENCE.match(v) and plausible_bare(v)
            return (v, start, start + len(v)) if ok else None
        if (before and not re.fullmatch(r"(?:export|ARG|ENV|set|-D|-e|--env|env|//[\w./:-]*)", before) and not before.startswith("//") and "/:" not in before):
            return None
        raw = raw.rstrip(",;)")
        if m["op"].strip() == ":" and not m["op"].endswith((" ", "\t")) and not m["q"]:
            return None
        v, off = raw, 0
        if REFERENCE.match(v):
            return None
    else:
        v, off = _unquoted(raw)
        # a literal that starts a call's text or a sentence is none
        if more:
            parts = re.findall(r"[\"']([^\"'\n]*)[\"']", more)
            joined = v + "".join(parts)
            ok = _plausible(kind, joined)
            return (v, start + 1, m.end()) if ok else None
    ok = _plausible(kind, v)
    return (v, start + off, start + off + len(v)) if ok else None


def _named(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Literals of one line in positions that a name marks."""
    for m in HEADER.finditer(text, start, end):
        v = m[2]
        if _basic(v) if (m[1] or "").lower() == "basic" else plausible_token(v, False):
            yield m.start(2), m.end(2), v
    for m in ASSIGN.finditer(text, start, end):
        if a := _assigned(m, text):
            yield a[1], a[2], a[0]
    for p in (LOGIN, CURL_USER, IDENTIFIED, CONNECT):
        for m in p.finditer(text, start, end):
            if plausible_password(m[1].strip("\"'")):
                yield m.start(1), m.end(1), m[1]
    for m in FLAG.finditer(text, start, end):
        v, off = _unquoted(m[1])
        if plausible_token(v, False):
            yield m.start(1) + off, m.start(1) + off + len(v), v
    for p in (SETTING, STORED, SETTER, ELEMENT, ATTRIBUTE):
        for m in p.finditer(text, start, end):
            kind, v = _kind(m["name"]), m["value"]
            if kind == "generic" and p is SETTING:
                kind = "token"
            if kind and _plausible(kind, v) and (p is SETTING or not REFERENCE.match(v)):
                yield m.start("value"), m.end("value"), v


_names = ahocorasick.Automaton()
for _w in (*NAMES, *SHORT_NAMES):
    _names.add_word(_w, (_w, _w in SHORT_NAMES))
_names.make_automaton()


def _named_lines(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines that may hold a named credential: one walk over the text with all names at once."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    done = -1
    for end, (w, whole) in _names.iter(low):
        if end < done:
            continue
        if whole:
            a, b = end - len(w), end + 1
            if a >= 0 and (low[a].isalnum() or low[a] == "_" or w[0] == "-" and not low[a].isspace()) or b < len(low) and (low[b].isalnum() or low[b] == "_"):
                continue
        line, done = text.rfind("\n", 0, end) + 1, text.find("\n", end)
        done = done if done >= 0 else len(text)
        yield line, done


def _key_body(text: str, start: int, end: int) -> bool:
    """Whether what stands between the marks of a key looks like one: a key's lines have no blanks but at their margins."""
    lines = text[start:end].split("\n")
    return sum(len(re.findall(r"\S[ \t]+\S", x)) for x in lines) <= 2 * len(lines) + 4


def literals(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of the literals in credential positions, in order, without overlaps."""
    got: list[tuple[int, int, str]] = []
    for m in PRIVATE_KEY.finditer(text) if "PRIVATE KEY" in text else ():
        end = KEY_END.search(text, m.end())
        nxt = PRIVATE_KEY.search(text, m.end())
        if end and (not nxt or end.start() < nxt.start()) and _key_body(text, m.end(), end.start()):
            stop = end.end()
        else:  # cut off: as far as lines look like a key
            stop = KEY_TEXT.match(text, m.end()).end()
            while k := KEY_LINE.match(text, stop):
                stop = k.end()
        body = re.sub(r"[^A-Za-z0-9+/=]|\\[nr]", "", text[m.end() : stop])
        if len(body) >= 8 or stop >= len(text.rstrip()):
            got.append((m.start(), stop, ("sample:" if placeholder(body) else "key:") + hashlib.blake2b(body.encode(), digest_size=16).hexdigest()))
    got += [(m.start(), m.end(), m[0]) for m in FORMATS.finditer(text)]
    if "://" in text:
        got += [(m.start(1), m.end(1), m[1]) for m in URL.finditer(text) if len(m[1]) >= 4 and not placeholder(m[1]) and not m[1].isdigit()]
        got += [(m.start(1), m.end(1), m[1]) for m in WEBHOOK.finditer(text) if len(m[1]) >= 30 and not placeholder(m[1])]
    for line, end in _named_lines(text):
        got += _named(text, line, end)
    out: list[tuple[int, int, str]] = []
    for s in sorted(got, key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans replaced, overlapping ones as one. A span over several lines keeps its line breaks and
    each line's margin."""
    whole: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if whole and s < whole[-1][1]:
            whole[-1] = (whole[-1][0], max(e, whole[-1][1]))
        else:
            whole.append((s, e))
    out, at = [], 0
    for s, e in whole:
        lines = text[s:e].split("\n")
        masked = [MASK]
        for x in lines[1:]:
            margin = re.match(r"[-+ ]?[ \t]*", x)[0] if not x.startswith("-----") else ""
            masked.append(margin + MASK * bool(x[len(margin) :].strip()) + "\r" * x.endswith("\r"))
        if len(lines) > 1 and lines[0].endswith("\r"):
            masked[0] += "\r"
        out += [text[at:s], "\n".join(masked)]
        at = e
    return "".join([*out, text[at:]])


def occurrences(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Spans of the automaton's values that stand by themselves."""
    out = []
    for end, value in automaton.iter(text):
        s, e = end - len(value) + 1, end + 1
        if (s == 0 or not (EDGE.match(text[s]) and EDGE.match(text[s - 1]))) and (e == len(text) or not (EDGE.match(text[e]) and EDGE.match(text[e - 1]))):
            out.append((s, e))
    return out


_FOUND = "table_name string, row_id long, text_id long, owner string, line_no int, s int, e int, value string"
_HITS = "table_name string, row_id long, text_id long, line_no int, s int, e int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t, r, i, o, text in zip(*(b.column(c).to_pylist() for c in ("table_name", "row_id", "text_id", "owner", "text"))):
            at = line = 0
            for s, e, v in literals(text):
                line += text.count("\n", at, s)
                at = s
                rows.append((t, r, i, o, line + 1, s, e, v))
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["table_name", "row_id", "text_id", "owner", "line_no", "s", "e", "value"])


def _runs(text: Column) -> Column:
    """Distinct runs of at least four letters and digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]{4,})"), F.lit(1)))


def _anchor(value: Column) -> Column:
    """The run of letters and digits of a value by which texts are matched with it: one with a digit or capital if there
    is any (words are everywhere), the longest of these; null under four characters."""
    weight = lambda r: F.length(r) + F.when(r.rlike("[0-9]|[a-z][A-Z]"), 1000).otherwise(0)
    return F.get(F.array_sort(_runs(value), lambda a, b: weight(b) - weight(a)), F.lit(0))


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all runs of GRAM characters, block by block."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes) - GRAM + 1, GRAM_BLOCK):
        c = codes[at : at + GRAM_BLOCK + GRAM - 1].astype(np.uint64)
        h = np.zeros(len(c) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = (h + c[k : k + len(h)]) * _MIX
        yield h


def _gram(value: str) -> int:
    """Hash of the run of GRAM characters with the most letters and digits, then with the most different ones."""
    runs = [value[i : i + GRAM] for i in range(len(value) - GRAM + 1)]
    return int(next(_hashes(max(runs, key=lambda r: (len(EDGE.findall(r)), len(set(r)))))).view(np.int64)[0])


def _rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One automaton for the values of a batch's texts: a confirmed value counts wherever it stands."""
    for b in batches:
        automaton = ahocorasick.Automaton()
        for v in set(b.column("values").flatten().to_pylist()):
            automaton.add_word(v, v)
        if not len(automaton):
            continue
        automaton.make_automaton()
        rows = []
        for t, r, i, text in zip(*(b.column(c).to_pylist() for c in ("table_name", "row_id", "text_id", "text"))):
            rows += [(t, r, i, text.count("\n", 0, s) + 1, s, e) for s, e in occurrences(text, automaton)]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["table_name", "row_id", "text_id", "line_no", "s", "e"])


def _filter(confirmed: DataFrame, n: int):
    """Broadcast bit field of the hashes of ``n`` confirmed values, 16 buckets for each within FILTER_BITS."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * n - 1).bit_length()))
    known = np.zeros(1 << bits, bool)
    for r in confirmed.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("k")).distinct().toLocalIterator():  # at most 2**bits rows
        known[r["k"]] = True
    return confirmed.sparkSession.sparkContext.broadcast((bits, np.packbits(known)))


_KEYS = ["table_name", "row_id", "text_id"]


def _passing(field, hashes):
    """Arrow function: (keys, h) of the hashes of a batch's texts that pass the bit field (any hash, if it is None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if field is not None:
            bits, packed = field.value
            known = np.unpackbits(packed).astype(bool)
        for b in batches:
            at, h = hashes(b)
            if field is not None:
                ok = known[(h >> np.uint64(64 - bits)).astype(np.int64)]
                at, h = at[ok], h[ok]
            if len(at):
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in _KEYS), pa.array(h.view(np.int64))], [*_KEYS, "h"])

    return run


def _listed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column("hs")
    offsets = lists.offsets.to_numpy()
    return np.repeat(np.arange(b.num_rows), np.diff(offsets)), lists.flatten().to_numpy().view(np.uint64)


def _grams(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    got = [np.unique(np.concatenate(list(_hashes(t)) or [np.zeros(0, np.uint64)])) for t in b.column("text").to_pylist()]
    return np.repeat(np.arange(len(got)), [len(h) for h in got]), np.concatenate(got)


_ASKED = "table_name string, row_id long, text_id long, h long"


def _met(asked: DataFrame, confirmed: DataFrame, few: bool) -> DataFrame:
    """(keys, value) of the texts that hold a value's hash. Where both sides are shuffled, each hash is spread over SALT
    parts, so that an anchor that stands in a third of the texts is no single task."""
    if few:
        return asked.join(F.broadcast(confirmed), "h").select(*_KEYS, "value")
    salted = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return asked.withColumn("salt", F.pmod(F.xxhash64(*_KEYS), F.lit(SALT)).cast("int")).join(salted, ["h", "salt"]).select(*_KEYS, "value")


def credentials(texts: DataFrame, most_owners: int = MOST_OWNERS, owners: DataFrame | None = None, broadcast_values: int = BROADCAST_VALUES, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """Spans of credentials: table_name, row_id, text_id, line_no (from 1), s, e (characters from 0).

    ``texts``: table_name, row_id, owner, text. ``owners``, if given, names the owners: owner (as in ``texts``), name;
    only what is found is joined with it, not the texts. Null and empty texts hold none; a null owner counts as one
    owner; rows that repeat give their spans once; different texts of one row are kept apart by ``text_id``.
    """
    kept = texts.where(F.col("text").isNotNull() & (F.col("text") != ""))
    kept = kept.select("table_name", "row_id", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), "text", F.xxhash64("text").alias("text_id"))
    found = kept.mapInArrow(_scan, _FOUND)
    named = texts.select(F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("name"))
    if owners is not None:
        named = owners.select(F.col("owner").cast("string").alias("owner"), F.coalesce("name", F.lit("")).alias("name"))
        found = found.join(named.groupBy("owner").agg(F.min("name").alias("name")), "owner", "left").drop("owner").withColumn("owner", F.coalesce("name", F.lit("")))
    found = cut(found)
    most = max(most_owners, int(named.select("name").distinct().count() * OWNER_SHARE))

    @F.pandas_udf("boolean")
    def proves(values):
        return values.map(proven)

    @F.pandas_udf("boolean")
    def wanted(values):
        return values.map(searched)

    @F.pandas_udf("bigint")
    def gram(values):
        return values.map(_gram)

    held = found.groupBy("value").agg(F.count_distinct("owner").alias("owners"))
    rare = cut(held.where((F.col("owners") <= most) | proves("value")).select("value", wanted("value").alias("search"), _anchor(F.col("value")).alias("anchor")))
    sure = found.join(rare.select("value"), "value")
    confirmed = rare.where("search and anchor is not null").select("value", F.xxhash64("anchor").alias("h"))
    bare = rare.where("search and anchor is null").select("value", gram("value").alias("h"))
    n, n_bare = confirmed.count(), bare.count()
    tokens = kept.select(*_KEYS, F.transform(_runs(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    if n <= broadcast_values:
        asked = _met(tokens.select(*_KEYS, F.explode("hs").alias("h")), confirmed, True)
    else:
        asked = _met(tokens.mapInArrow(_passing(_filter(confirmed, n), _listed), _ASKED), confirmed, False)
    if n_bare:
        grams = kept.select(*_KEYS, "text").mapInArrow(_passing(_filter(bare, n_bare), _grams), _ASKED)
        asked = asked.unionByName(_met(grams, bare, n_bare <= broadcast_values))
    routed = cut(asked.groupBy(*_KEYS).agg(F.collect_set("value").alias("values")))
    # no text moves while those to be searched are few; else Spark filters the texts before it moves them
    few = routed.count() <= broadcast_texts and routed.select(F.sum(F.size("values"))).first()[0] or 0
    again = kept.join(F.broadcast(routed) if 0 < few <= broadcast_values else routed, _KEYS).select(*_KEYS, "text", "values")
    hits = again.mapInArrow(_rescan, _HITS)
    cols = [*_KEYS, "line_no", "s", "e"]
    return sure.select(*cols).unionByName(hits.select(*cols)).distinct()


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, spans = b.column("text").to_pylist(), b.column("spans").to_pylist()
        done = [t if not s else redact(t, [(x["s"], x["e"]) for x in s]) for t, s in zip(texts, spans)]
        yield pa.RecordBatch.from_arrays([b.column("table_name"), b.column("row_id"), pa.array(done, pa.string()), pa.array([len(s or ()) for s in spans], pa.int32())], ["table_name", "row_id", "text", "n_spans"])


def redacted(texts: DataFrame, spans: DataFrame, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """(table_name, row_id, text, n_spans) of all texts, each once, with the spans' characters replaced.

    Line structure and everything outside the spans stay as they were; null and empty texts come out as they are. Only
    texts that come several times are moved to be made one; spans and the keys of those texts are broadcast while few.
    """
    kept = texts.select("table_name", "row_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_id"))
    side = lambda df, c: cut(df.select(*[F.col(k).alias(f"__{k}") for k in _KEYS], c))
    per = side(spans.groupBy(*_KEYS).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    often = side(kept.groupBy(*_KEYS).count().where(F.col("count") > 1).withColumn("often", F.lit(True)), "often")

    def beside(df: DataFrame, other: DataFrame) -> DataFrame:
        """Left join by the keys, null equal to null."""
        same = F.lit(True)
        for k in _KEYS:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return df.join(F.broadcast(other) if other.count() <= broadcast_texts else other, same, "left").drop(*[f"__{k}" for k in _KEYS])

    marked = beside(kept, often)
    once = marked.where(F.col("often").isNull()).unionByName(marked.where(F.col("often").isNotNull()).dropDuplicates(_KEYS))
    return beside(once, per).select("table_name", "row_id", "text", "spans").mapInArrow(_redact, "table_name string, row_id long, text string, n_spans int")

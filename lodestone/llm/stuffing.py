"""Keyword-stuffed and link-list pages, by how their terms recur.

A text becomes one sequence of terms in windows of some forty; code, logs, encoded lines and values are set aside by
their form. Nothing is known of any language. Natural sentences differ from stuffing in how terms recur:

- *Gaps.* Apart from the short terms that keep coming back (the grammar of a text, found by their length against the
  text's own terms), few terms recur within the next forty. In stuffing most do.
- *Order.* Where terms of sentences do recur, because sentences or their frames are repeated, their successors recur
  with them. In stuffing a term is followed by whatever its frequency makes likely: the share of equal successors is
  that of chance, which the terms' own frequencies give.
- *Regularity.* Lists with a frame ("best A best B", one product a line) bring terms back at equal distances: the
  autocorrelation over a range of lags rises above chance, while no sentence ends.
- *Lists of nouns.* Terms that are almost all distinct, none of them short and recurring, and no sentence ends.

Windows with these signs are stuffed; a page is spam if its stuffed words and links outweigh the rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASCII_WORD = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)*")
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}\p{M}]+)*")
CAMEL = re.compile(r"(?<=[a-zß-ÿ0-9])(?=[A-ZÀ-Þ])")
ASCII_CAMEL = re.compile(r"([a-z0-9])(?=[A-Z])")
#: Scripts that set no blanks between words.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
LINK = re.compile(r"(?:https?://|www\.)[^\s<>()\[\]\"']+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|net|org|info|biz|ru|cn|io)\b(?:/[^\s<>()\[\]\"']*)?", re.I)
DOMAIN = re.compile(r"www\.|\.(?:example|test|invalid|com|net|org|info|biz|ru|cn|io)\b", re.I)
MARKUP = re.compile(r"<!--|-->|</?[a-zA-Z][^<>]{0,200}>|&[a-z]+;|!?\[|\]\(|[*_`~]{1,3}")
MARKS = re.compile(r"[<>&\[\]*_`~]")
MARKED = re.compile(r"<!--|-->|</?[a-zA-Z][^<>]{0,200}>|\]\(")
#: Ends of sentences; in scripts without blanks nothing need follow.
SENTENCE_END = re.compile(r"[.!?…]+(?=[\s\"'»”)\]*`_]|$)|[。!?؟।॥።။]")
LINES = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
LOG = re.compile(r"^\W*(?:\[?\d{4}\W\d\d\W\d\d[T ]|\d\d:\d\d:\d\d|(?:INFO|WARN|ERROR|DEBUG|TRACE)\b)", re.I)
CODE = re.compile(
    r"[{}]\s*$|;\s*$|:=|\w\(\S*.*\)|\)\s*[{:]|^\s*\)\s*$|(?:^|\s)[({]\s*$|^\s*(?i:module|package|import|from|require|use|go)\s+[\w./\"(-]+\s*$|"
    r"^\s*(?:func|def|class|return|raise|var|let|const|type|struct|public|private|SELECT|INSERT|UPDATE|DELETE|ALTER|CREATE|echo|cd|export)\s.*[\s(){}=$/\"';_]|"
    r"^\s*(?:if|for|else|elif|try|catch|while|switch|case)\b.*[:;{\]]\s*(?:then|do)?\s*$|^\s*(?:fi|done|else|end|esac|then|do|return\s+\w+|pass)\s*$|"
    r"^\s*[\w.\"-]+\s*[=:]\s*(?:[\"'\d\[{]|true\b|false\b|null\b)|^\s*(?://|#!|--\s|\$ )|^\s*[\w./-]+(?:\s+--?[\w-]+(?:[ =]\S+)?)+\s*$|"
    r"^\s*[A-Za-z_][A-Za-z0-9_.]*=\S*\s*$|^\s*[\w./-]+\s+[vV]\d+\.\d+|^\s*\"[^\"]+\"[,:]?\s*$|^\s*\w+:\s*$|^\s+[\w-]+:\s\S+\s*$"
)
FENCE = re.compile(r"^\s*(?:```|~~~)")
#: Lines without any of these are no code, unless they are short.
SYMBOL = re.compile(r"[{}()\[\]=;<>|#$\\\"]|//|^\W*\d|--")
ZERO_WIDTH = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
JOINED = re.compile(r"[,;|#/]+")
#: A piece of a joined line that looks like a term: letters of one word, a compound or a camel case name.
TERM = re.compile(r"[^\W\d_]{2,20}(?:[-_'’.][^\W\d_]{2,20}){0,3}")
#: A page with fewer stuffed words than this is a short note.
LEAST_WORDS = 25
#: Terms of a window, and the shortest window that is judged.
WINDOW, LEAST_WINDOW = 40, 12
#: Distance, in terms other than grammar, within which a term counts as recurring; distance over which successors are compared.
NEAR, BACK = 40, 400
#: Lags of the autocorrelation, and terms around a window that it looks at.
LAGS, AROUND = 10, 60
#: A recurring term is grammar if it is at most so long, measured by the mean length of the text's terms.
SHORT = 0.7
#: ... and grammar follows itself in at most so large a share of the cases that chance would give.
REPEL = 0.3
#: Shares from which a window is stuffed: of recurring terms (where sentences show, and where not), and of the
#: autocorrelation above chance; shares of equal successors from which an order is kept, in both cases, above chance
#: and two standard errors.
RECURRING, REGULAR, ORDERED = (0.6, 0.52), 0.13, (0.08, 0.5)
#: Signs of sentences: at least so large a share of grammar, or an end within so many terms but not so few.
GRAMMAR, SENTENCE, SHORTEST = 0.2, 30, 5
#: A list of nouns: at least so many distinct terms, hardly any grammar, and no more sentence ends than one in so many.
DISTINCT, NO_GRAMMAR, UNENDING = 0.8, 0.08, 40
#: Numbers among the terms of a list at most, and of anything stuffed.
NUMBERS, VALUES = 0.15, 0.4
#: Words that a link stands for, and words a link in a line without other text: its name.
LINK_WORDS, ANCHOR_WORDS = 3, 6


def words_of(text: str) -> list[str]:
    """Terms in lower case, compounds in camel case apart.

    Runs of scripts without blanks are one term if they are as short as a word, else all their pieces of two characters
    (four letters in alphabetic scripts).
    """
    out: list[str] = []
    if text.isascii():
        return ASCII_WORD.findall((ASCII_CAMEL.sub(r"\1 ", text) if ASCII_CAMEL.search(text) else text).lower())
    if not UNSPACED.search(text):
        return WORD.findall(CAMEL.sub(" ", text).lower())
    for w in WORD.findall(text):
        at = 0
        for m in UNSPACED.finditer(w):
            if m.start() > at:
                out.append(w[at : m.start()].lower())
            run = m[0]
            k = 2 if run[0] >= "\u2e80" else 4
            out += [run] if len(run) <= 2 * k else [run[i : i + k] for i in range(len(run) - k + 1)]
            at = m.end()
        if at < len(w):
            out += [x.lower() for x in CAMEL.split(w[at:])]
    return out


def joined_terms(line: str) -> list[str]:
    """Terms of a line that joins them by one of , ; | # / without blanks; none if its pieces don't look like words.

    Encoded bytes also hold slashes, but their pieces mix cases and digits; paths begin or end like paths.
    """
    pieces = [x for x in JOINED.split(line.strip()) if x]
    if len(pieces) < 3:
        return []
    words = sum(bool(TERM.fullmatch(x)) and (x.islower() or x.isupper() or x.istitle() or len(CAMEL.split(x)) * 3 <= len(x)) for x in pieces)
    only_path = not re.search(r"[,;|#]", line)
    if words * 10 < 9 * len(pieces) or (only_path and (len(pieces) < 8 or re.match(r"[./~]", line))):
        return []
    return pieces


class Page(NamedTuple):
    """Terms of a text in order, windows (first term, one past the last, sentence ends), words that stand in links (a link
    stands for some of its own) and words set aside."""

    terms: list[str]
    windows: list[tuple[int, int, float]]
    linked: int
    solid: int


def page(text: str) -> Page:
    if not text.isascii():
        text = ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text))
    lines = [x for x in LINES.split(text) if x and not x.isspace()]
    kept: list[str] = []
    solid = coded = 0
    fenced = False
    for line in lines:
        n = len(line.split())
        if n >= 8 and not fenced and not SYMBOL.search(line):
            kept.append(line)
            continue
        if FENCE.match(line):
            fenced = not fenced
            continue
        marked = MARKED.search(line)
        linked = "://" in line
        closed = line.rstrip().endswith(";") and not marked and not fenced and not linked
        if (n == 1 and len(line) >= 20 or closed) and not marked and not fenced and not linked and not re.search(r"[=(){}\"$<>]", line):
            pieces = joined_terms(re.sub(r"\s*([,;|#/])\s*", r"\1", line) if closed else line)
            if pieces:
                kept.append(" ".join(pieces))
                continue
        if (n == 1 and len(line) >= 20 and not marked and not linked and not UNSPACED.search(line)) or LOG.match(line) or (not marked and CODE.search(line)) or (fenced and not marked and not linked):
            solid += n
            coded += 1
            continue
        kept.append(line)
    code_around = coded * 2 >= len(kept) and coded >= 3  # short lines among code or values belong to it
    terms: list[str] = []
    windows: list[tuple[int, int, float]] = []
    links, anchors, start, ends = 0, 0, 0, 0.0
    for line in kept:
        urls = LINK.findall(line) if "://" in line or DOMAIN.search(line) else []
        if code_around and not urls and len(line) < 200 and not MARKED.search(line) and len(line.split()) <= 6:
            solid += len(line.split())
            continue
        rest = LINK.sub(" ", line) if urls else line
        found = words_of(MARKUP.sub(" ", rest) if MARKS.search(rest) else rest)
        here = len(SENTENCE_END.findall(rest)) / len(found) if found else 0.0
        links += len(urls)
        if urls and len(found) <= ANCHOR_WORDS * len(urls):  # what is left are the names of the links
            anchors += len(found)
            continue
        for i in range(0, len(found), WINDOW):
            part = found[i : i + WINDOW]
            if len(terms) - start >= LEAST_WINDOW and len(terms) - start + len(part) > WINDOW * 3 // 2:
                windows.append((start, len(terms), ends))
                start, ends = len(terms), 0.0
            terms += part
            ends += here * len(part)
            if len(terms) - start >= WINDOW:
                windows.append((start, len(terms), ends))
                start, ends = len(terms), 0.0
    if len(terms) > start:
        windows.append((start, len(terms), ends))
    return Page(terms, windows, LINK_WORDS * links + anchors, solid)


def grammar(terms: list[str]) -> set[str]:
    """The terms of a text that recur and are short by the measure of its own terms; none of scripts without blanks.

    In no language does such a term follow itself but by accident: if they do so about as often as by chance (the
    autocorrelation at lag 1), they are short keywords and no grammar.
    """
    counts = Counter(terms)
    kinds = [w for w in counts if not w.isdigit() and not (w[0] > "\u0dff" and UNSPACED.match(w))]
    limit = SHORT * sum(map(len, kinds)) / max(1, len(kinds))
    short = {w for w in kinds if len(w) <= limit and counts[w] > 1}
    chance = sum(counts[w] ** 2 for w in short) / max(1, len(terms))
    if chance >= 2 and sum(a == b and a in short for a, b in zip(terms, terms[1:])) > REPEL * chance:
        return set()
    return short


def recurring(terms: list[str], start: int, end: int, short: set[str]) -> float:
    """Share of a window's terms, without grammar and numbers, that occur again within NEAR of them."""
    other = lambda xs: [w for w in xs if w not in short and not w.isdigit()]
    before, own, after = other(terms[max(0, start - 2 * NEAR) : start])[-NEAR:], other(terms[start:end]), other(terms[end : end + 2 * NEAR])[:NEAR]
    counts = Counter(before + own + after)
    return sum(counts[w] > 1 for w in own) / len(own) if own else 0.0


def autocorrelation(terms: list[str]) -> float:
    """Highest share of equal terms over lags 1..LAGS, above the chance that the terms' frequencies give."""
    n = len(terms)
    if n <= LAGS + 1:
        return 0.0
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in terms])
    p = np.bincount(codes) / n
    chance = float((p * p).sum())
    peak = max(float((codes[k:] == codes[:-k]).mean()) for k in range(1, LAGS + 1))
    return (peak - chance) / (1 - chance) if chance < 1 else 1.0


def order_kept(terms: list[str], start: int, end: int) -> tuple[float, float]:
    """(share of the recurring terms whose successor is that of their last occurrence, above chance; its standard error)."""
    last: dict[str, int] = {}
    for i in range(max(0, start - BACK), start):
        last[terms[i]] = i
    same = met = 0
    for i in range(start, min(end, len(terms) - 1)):
        j = last.get(terms[i])
        if j is not None:
            met += 1
            same += terms[i + 1] == terms[j + 1]
        last[terms[i]] = i
    n = end - start
    chance = sum(c * c for c in Counter(terms[start:end]).values()) / (n * n)
    if not met or chance >= 1:
        return 0.0, 0.0
    return (same / met - chance) / (1 - chance), (chance / (1 - chance) / met) ** 0.5


def stuffed_window(terms: list[str], start: int, end: int, ends: float, short: set[str]) -> bool:
    """Whether a window's terms recur as in stuffing, or are a list of nouns."""
    own, n = terms[start:end], end - start
    if n < LEAST_WINDOW:
        return False
    numbers = len({w for w in own if w.isdigit()}) / n
    if numbers >= VALUES:
        return False
    share = sum(w in short for w in own) / n
    ended = ends * SENTENCE >= n >= ends * SHORTEST
    sentences = ended or share >= GRAMMAR
    if recurring(terms, start, end, short) >= RECURRING[not sentences]:
        order, error = order_kept(terms, max(0, start - AROUND), min(len(terms), end + AROUND))
        if order < ORDERED[not sentences] + 2 * error:
            return True
    if ended:
        return False
    if autocorrelation(terms[max(0, start - AROUND) : end + AROUND]) > REGULAR:
        return True
    if share >= NO_GRAMMAR or ends * UNENDING >= n or len(set(own)) < DISTINCT * n or numbers >= NUMBERS or n < WINDOW:
        return False
    # pieces of running text in a script without blanks overlap; the terms of a list don't
    return sum(len(a) > 1 and a[1:] == b[:-1] for a, b in zip(own, own[1:])) * 2 < n


def plain_sentences(text: str) -> tuple[int, int]:
    """(words in lines of sentences whose words hardly recur, all words with those that links stand for): a first look."""
    told = words = 0
    for line in text.split("\n"):
        own = line.lower().split()
        n = len(own)
        words += n + LINK_WORDS * line.count("://")
        if n < LEAST_WINDOW or "://" in line:
            continue
        ends = line.count(". ") + line.count("? ") + line.count("! ") + (own[-1][-1] in ".?!")
        if ends * SENTENCE >= n >= ends * SHORTEST and all(len(set(own[i : i + WINDOW])) * 10 >= 8 * len(own[i : i + WINDOW]) for i in range(0, n, WINDOW)):
            told += n
    return told, words


def stuffing(text: str | None) -> tuple[int, int]:
    """(stuffed words, all words) of a text; 0 stuffed as soon as they can't be the greater part."""
    if not text:
        return 0, 0
    told, words = plain_sentences(text)
    if told * 2 >= words:
        return 0, words
    terms, windows, linked, solid = page(text)
    total = solid + len(terms) + linked
    # sentences whose terms hardly recur need no further look
    doubtful = [(s, e, x) for s, e, x in windows if not x * SENTENCE >= e - s >= x * SHORTEST or len(set(terms[s:e])) * 10 < 8 * (e - s)]
    if (sum(e - s for s, e, _ in doubtful) + linked) * 2 <= total:
        return 0, total
    short = grammar(terms)
    stuffed = sum(e - s for s, e, x in doubtful if stuffed_window(terms, s, e, x, short))
    return stuffed + linked, total


def is_stuffed(text: str | None) -> bool:
    stuffed, total = stuffing(text)
    return stuffed >= LEAST_WORDS and stuffed * 2 > total


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flags = pa.array([is_stuffed(t) for t in b.column(1).to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(flags)], ["key"])


def stuffed_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the rows whose text is keyword stuffing or a list of links; one pass, no shuffle.

    Null, empty and very short texts are never spam; repeated rows come out repeated.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(_flag, f"key {kind}")

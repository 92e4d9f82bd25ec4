"""Where terms and topics stand in texts: character spans by one pass of a multi-pattern automaton over each text.

Places are code points of the text as given, ends exclusive. Terms ignore case, and a blank in a term stands for any run of white
space. ``locate_terms`` and ``topic_spans`` are table functions: rows of a table joined laterally with the spans of their texts, so
that texts never move between tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

BEFORE, AFTER = 65, 95  #: characters of a quote on either side of a term
NEAR = 80  #: characters on either side of an alias in which its context words count
SENTENCE = 180  #: characters that a topic and its context may span without the end of a sentence
_ENDS = re.compile("[.!?\n]|[。！？]")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
MOST_PATTERNS = 100_000  #: of a catalog, which goes to every task; larger ones are an error


def flat(text: str) -> tuple[str, list[int] | None]:
    """``text`` in lower case with every run of white space as one blank, and the place of each of its characters, None if all kept theirs.

    A character whose lower case is longer stays as it is.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    if not re.search(r"\s\s|[^\S ]", low):
        return low, None
    out, at, blank = [], [], False
    for i, c in enumerate(low):
        if not c.isspace():
            out.append(c)
        elif not blank:
            out.append(" ")
        else:
            continue
        blank = c.isspace()
        at.append(i)
    at.append(len(low))
    return "".join(out), at


def _bounded(low: str, start: int, end: int, ends: tuple[bool, bool], word: frozenset) -> bool:
    """Whether no character of ``word`` stands before the start and behind the end, each only where ``ends`` asks for it."""
    before, after = low[start - 1 : start] if start else "", low[end : end + 1]
    return not (ends[0] and before in word) and not (ends[1] and after in word)


class Terms:
    """An automaton over terms.

    With ``by_ends`` an ASCII letter or digit that begins or ends a term asks for a boundary there, and _ counts as a letter; else terms
    that are all ASCII ask for one at both ends.
    """

    def __init__(self, terms, by_ends: bool = False):
        self.word = _LETTERS | {"_"} if by_ends else _LETTERS
        self.machine = ahocorasick.Automaton()
        keys: dict[str, list] = {}
        for term in dict.fromkeys(t for t in terms if t and t.strip()):
            key = flat(" ".join(term.split()))[0]
            ends = (key[0] in _LETTERS, key[-1] in _LETTERS) if by_ends else (term.isascii(),) * 2
            keys.setdefault(key, []).append((term, ends))
        if len(keys) > MOST_PATTERNS:
            raise ValueError(f"a catalog of more than {MOST_PATTERNS} terms")
        for key, owners in keys.items():
            self.machine.add_word(key, (len(key), owners))
        if keys:
            self.machine.make_automaton()
        self.empty = not keys

    def all(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of every match; those of one term do not overlap, the leftmost first."""
        if self.empty or not text:
            return []
        low, at = flat(text)
        found, reach = [], {}
        for last, (size, owners) in self.machine.iter(low):
            start, end = last + 1 - size, last + 1
            for term, ends in owners:
                if start >= reach.get(term, 0) and _bounded(low, start, end, ends, self.word):
                    reach[term] = end
                    found.append((start, end, term) if at is None else (at[start], at[end - 1] + 1, term))
        return found

    def longest(self, text: str) -> list[tuple[int, int, str]]:
        """Matches that do not overlap: from left to right, of those that begin together the longest."""
        out, reach = [], -1
        for start, end, term in sorted(self.all(text), key=lambda m: (m[0], -m[1])):
            if start >= reach:
                out.append((start, end, term))
                reach = end
        return out


@lru_cache(maxsize=64)
def _machine(terms: tuple) -> Terms:
    return Terms(terms)


SPAN = "term string, start_char long, end_char long, matched string, quote string, quote_start long, quote_end long"


@udtf(returnType=SPAN)
class LocateTerms:
    """``locate_terms(text, terms)``: a row for each span of a term, with the text around it. Null texts and terms give none."""

    def eval(self, text: str, terms: list[str]):
        for start, end, term in _machine(tuple(t for t in terms or () if t)).longest(text or ""):
            a, b = max(0, start - BEFORE), min(len(text), end + AFTER)
            yield term, start, end, text[start:end], text[a:b], a, b


def locate_terms(rows: DataFrame, text: str, terms) -> DataFrame:
    """``rows`` without ``text``, once for every span of a term: ``terms`` is a list, or a column of the row's own terms."""
    listed = F.array(*[F.lit(t) for t in terms]) if isinstance(terms, (list, tuple)) else F.col(terms).outer()
    return rows.lateralJoin(LocateTerms(F.col(text).outer(), listed)).drop(text)


def check_catalog(catalog: list[dict]) -> list[dict]:
    """``catalog`` if ids are unique, labels there, no alias missing or in two topics, and pairs never to merge known; else ValueError."""
    ids, owner = [t.get("id") for t in catalog], {}
    if not all(ids) or len(set(ids)) < len(ids) or not all(t.get("label") for t in catalog):
        raise ValueError("topics need ids of their own and labels")
    for topic in catalog:
        if not topic.get("aliases"):
            raise ValueError(f"topic {topic['id']} has no alias")
        for alias in topic["aliases"]:
            key = flat(" ".join(alias["text"].split()))[0]
            if not key or owner.setdefault(key, topic["id"]) != topic["id"]:
                raise ValueError(f"alias {alias['text']!r} is empty or in two topics")
    return catalog


class Topics:
    """Aliases of a catalog with the words that must, and those that must not, stand near them."""

    def __init__(self, catalog: list[dict]):
        self.aliases = [(t["id"], a["text"], tuple(a.get("context_any", ())), tuple(a.get("exclude_any", ()))) for t in check_catalog(catalog) for a in t["aliases"]]
        self.terms = Terms([a for _, a, _, _ in self.aliases] + [p for *_, need, _ in self.aliases for p in need], by_ends=True)
        self.excluded = {x: Terms(x, by_ends=True) for *_, x in self.aliases if x}

    def spans(self, text: str) -> list[tuple]:
        """(topic, alias, start, end, contexts): in the order of topics, aliases and places."""
        at: dict[str, list[tuple[int, int]]] = {}
        for start, end, term in self.terms.all(text):
            at.setdefault(term, []).append((start, end))
        out = []
        for topic, alias, need, exclude in self.aliases:
            near = sorted({span for p in need for span in at.get(p, ())})
            begins = [s for s, _ in near]
            for start, end in at.get(alias, ()):
                left, right = max(0, start - NEAR), min(len(text), end + NEAR)
                held = sum(e <= right for _, e in near[bisect_left(begins, left) : bisect_right(begins, right)])
                if need and not held:
                    continue
                if exclude and self.excluded[exclude].all(text[left:right]):
                    continue
                out.append((topic, alias, start, end, held))
        return out


def topic_spans(rows: DataFrame, text: str, catalog: list[dict]) -> DataFrame:
    """``rows`` without ``text``, once for every span of an alias whose context holds: topic, alias, place, matched text, context words."""
    topics = Topics(catalog)

    @udtf(returnType="topic_id string, alias string, start_char long, end_char long, matched string, contexts long")
    class Find:
        def eval(self, body: str):
            for topic, alias, start, end, held in topics.spans(body or ""):
                yield topic, alias, start, end, body[start:end], held

    return rows.lateralJoin(Find(F.col(text).outer())).drop(text)


def together(text: str, topic: list[tuple], context: list[tuple]) -> bool:
    """Whether a topic and a context term stand within 180 characters and no sentence ends between. Only neighbours need a look:
    whatever lies farther spans more."""
    begins = [c[0] for c in context]
    for start, end, *_ in topic:
        i = bisect_left(begins, start)
        for other in context[max(0, i - 1) : i + 1]:
            left, right = min(start, other[0]), max(end, other[1])
            if right - left <= SENTENCE and not _ENDS.search(text[left:right]):
                return True
    return False


def context_rows(rows: DataFrame, text: str, topic: list[str], context: list[str], timed: str | None = None) -> DataFrame:
    """``rows`` without ``text`` and with topic_hits, context_hits and same_context.

    Context terms that are aliases of the topic do not count. Where the boolean column ``timed`` holds, the text is one timed segment, so
    standing in it is enough; else both must stand in one sentence. A null text has no hits.
    """
    own = {t.casefold() for t in topic}
    context = [t for t in context if t.casefold() not in own]

    @udtf(returnType="topic_hits long, context_hits long, same_context boolean")
    class Find:
        def eval(self, body: str, is_timed: bool):
            hits, near = _machine(tuple(topic)).longest(body or ""), _machine(tuple(context)).longest(body or "")
            yield len(hits), len(near), bool(hits and near) and (bool(is_timed) or together(body, hits, near))

    flag = F.col(timed).outer() if timed else F.lit(False)
    return rows.lateralJoin(Find(F.col(text).outer(), flag)).drop(text)


def context_status(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, topic_hits, context_hits, status, reason) of the rows of ``context_rows`` that belong together, such as segments of a text."""
    g = found.groupBy(*by).agg(F.sum("topic_hits").alias("topic_hits"), F.sum("context_hits").alias("context_hits"), F.bool_or("same_context").alias("same"))
    status = F.when(F.col("topic_hits") == 0, "unclear").when(F.col("same"), "context_present").otherwise("keyword_only")
    reason = (
        F.when(F.col("topic_hits") == 0, "topic_not_detected").when(F.col("same"), "same_segment_or_sentence")
        .when(F.col("context_hits") == 0, "no_nearby_context_evidence").otherwise("context_found_elsewhere")
    )
    return g.select(*by, "topic_hits", "context_hits", status.alias("status"), reason.alias("reason"))


_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]*|[^\W_]+")
_TAG = re.compile(r"(?<!\w)#([^\W_]\w*)")
MOST_TOKENS = 5


def candidates(title: str, known: frozenset, stop: frozenset, breaks: frozenset, calendar: frozenset) -> dict[str, tuple[int, int, str]]:
    """Phrases of up to five tokens and hashtags that may name a topic: by normal form the first place, a hashtag before others.

    A phrase neither begins nor ends with a stop word, is no known alias and no date, has 2 to 80 characters and a word with a letter; a
    single ASCII token has three. Break words and punctuation other than ' and - end a phrase.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(title)]
    out: dict[str, tuple[int, int, str]] = {}

    def offer(start: int, end: int, words: list[str], kind: str) -> None:
        key = " ".join(title[start:end].casefold().split())
        letters = set(re.findall("[a-z]+", key))
        if (letters and letters <= calendar) or key in known or key in stop or not words or not 2 <= len(key) <= 80 or {words[0], words[-1]} & stop:
            return
        if not any(any(c.isalpha() for c in w) and w not in stop for w in words) or (len(words) == 1 and key.isascii() and len(key) < 3):
            return
        if key not in out or kind == "hashtag":
            out[key] = (start, end, kind)

    norm = [title[a:b].casefold() for a, b in tokens]
    for m in _TAG.finditer(title):
        a, b = m.span(1)
        offer(a, b, [w for (x, y), w in zip(tokens, norm) if a <= x and y <= b], "hashtag")
    for i in range(len(tokens)):
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            if norm[j] in breaks or (j > i and re.search(r"[^\s'-]", title[tokens[j - 1][1] : tokens[j][0]])):
                break
            offer(tokens[i][0], tokens[j][1], norm[i : j + 1], "phrase" if j > i else "word")
    return out


def candidate_phrases(rows: DataFrame, text: str, catalog: list[dict], stop, breaks, calendar) -> DataFrame:
    """``rows`` without ``text``, once for every candidate phrase: normal form, kind and place."""
    known = frozenset(" ".join(a["text"].casefold().split()) for t in catalog for a in t["aliases"])
    stop, breaks, calendar = frozenset(stop), frozenset(breaks), frozenset(calendar)

    @udtf(returnType="phrase string, kind string, start_char long, end_char long")
    class Find:
        def eval(self, body: str):
            for key, (start, end, kind) in candidates(body or "", known, stop, breaks, calendar).items():
                yield key, kind, start, end

    return rows.lateralJoin(Find(F.col(text).outer())).drop(text)

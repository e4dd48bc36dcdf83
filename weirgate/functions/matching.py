"""Many rules over a text at once: one automaton over their literals, patterns only where a literal stands.

What a pattern's every match must hold (`needed`) goes into an Aho-Corasick automaton, which one pass over the
folded text runs through whatever the number of rules; only rules whose literal it meets, and the few without
any, run their pattern. Rules are data: they travel to the tasks, which build the automaton once and compile a
pattern when it is first wanted.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.text import SPANS, SYSTEM_PROMPT_LEAK, WordHashes
from weirgate.sources.rules import ODD_LETTERS, Rule, compiles, needed

FOLD = str.maketrans(ODD_LETTERS, "iisk")
#: Literals shorter than that meet most texts; a plain search for each is cheaper than its hits in the automaton.
SHORT = 3


def fold(text: str) -> str:
    if not text.isascii() and any(c in text for c in ODD_LETTERS):
        text = text.translate(FOLD)
    return text.lower()


def beginnings(pattern: str) -> re.Pattern | None:
    """A pattern of one character with which every match begins; None unless that is digits and marks only, which few texts are full of."""
    try:
        from re import _constants as c
        from re import _parser
    except ImportError:
        return None

    class Unknown(Exception):
        pass

    def of(items) -> tuple[str, bool]:
        """(members of a character class, whether the items may match nothing)."""
        members = ""
        for op, arg in items:
            if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
                continue
            empty = False
            if op is c.LITERAL and arg < 128:
                members += re.escape(chr(arg))
            elif op is c.IN:
                for kind, x in arg:
                    if kind is c.LITERAL and x < 128:
                        members += re.escape(chr(x))
                    elif kind is c.RANGE and x[1] < 128:
                        members += f"{re.escape(chr(x[0]))}-{re.escape(chr(x[1]))}"
                    elif kind is c.CATEGORY and x is c.CATEGORY_DIGIT:
                        members += r"\d"
                    else:
                        raise Unknown
            elif op is c.BRANCH:
                parts = [of(x) for x in arg[1]]
                members, empty = members + "".join(m for m, _ in parts), any(e for _, e in parts)
            elif op is c.SUBPATTERN:
                part, empty = of(arg[-1])
                members += part
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
                part, empty = of(arg[2])
                members, empty = members + part, empty or arg[0] == 0
            else:
                raise Unknown
            if not empty:
                return members, False
        return members, True

    try:
        members, empty = of(_parser.parse(pattern))
    except Unknown:
        return None
    if empty or not members:
        return None
    found = re.compile(f"[{members}]")
    return None if any(found.match(x) for x in string.ascii_letters + "_ \n\u00e9\u212a") else found


def normalised(text: str) -> str:
    """As rules of layer 1 read a text: NFKC, white space to single spaces, stripped."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


class Matcher:
    """Rules in the order in which they count. `keywords`: patterns of KEYWORD rules are plain text, not regular expressions."""

    def __init__(self, rules: list[Rule], keywords: bool = True):
        import ahocorasick

        self.rules, self.keywords = rules, keywords
        self.patterns: list[tuple[re.Pattern, re.Pattern | None] | None] = [None] * len(rules)
        self.always: list[int] = []
        self.short: dict[str, list[int]] = {}
        long: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            words = ([rule.pattern] if rule.pattern.isascii() else []) if self._plain(rule) else needed(rule.pattern)[0]
            if not words or not all(words):
                self.always.append(i)
            for word in {fold(w) for w in words if w}:
                (self.short if len(word) < SHORT else long).setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, ids in long.items():
            self.automaton.add_word(word, ids)
        if long:
            self.automaton.make_automaton()
        self.long = bool(long)

    def _plain(self, rule: Rule) -> bool:
        return self.keywords and rule.rule_type == "KEYWORD"

    def candidates(self, text: str) -> list[int]:
        """Rules that may match, in order; every rule that matches is among them."""
        low, found = fold(text), set(self.always)
        for word, ids in self.short.items():
            if word in low:
                found.update(ids)
        if self.long:
            for _, ids in self.automaton.iter(low):
                found.update(ids)
        return sorted(found)

    def matches(self, i: int, text: str) -> Iterator[re.Match]:
        """What finditer gives; where matches begin with digits or marks, the pattern is tried at these only."""
        if self.patterns[i] is None:
            self.patterns[i] = re.compile(self.rules[i].pattern), beginnings(self.rules[i].pattern)
        pattern, first = self.patterns[i]
        if first is None:
            yield from pattern.finditer(text)
            return
        at = 0
        for begin in first.finditer(text):
            if begin.start() >= at and (match := pattern.match(text, begin.start())):
                yield match
                at = match.end()

    def first(self, text: str) -> int | None:
        """The first rule that matches the normalised text."""
        for i in self.candidates(text):
            rule = self.rules[i]
            if rule.pattern.lower() in text.lower() if self._plain(rule) else next(self.matches(i, text), None):
                return i
        return None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Merged spans of all rules; none that touches an ASCII digit outside it, and of card rules only what passes the Luhn check."""
        found = []
        for i in self.candidates(text):
            rule = self.rules[i]
            for match in self.matches(i, text):
                start, end = match.span()
                if start < end and not is_digit(text[start - 1 : start]) and not is_digit(text[end : end + 1]) and (not rule.is_card or luhn(match[0])):
                    found.append((start, end, "SECRET_LEAK" if rule.is_secret else "PII_LEAK"))
        return merged(found)


def is_digit(c: str) -> bool:
    return c.isascii() and c.isdigit()


def luhn(text: str) -> bool:
    """Whether the ASCII digits of the text pass the Luhn check; false without any."""
    digits = [int(c) for c in text if is_digit(c)]
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return bool(digits) and total % 10 == 0


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping or touching spans joined; the category of the first one stays."""
    out: list[tuple[int, int, str]] = []
    for start, end, category in sorted(spans, key=lambda s: s[:2]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, category))
    return out


class OwnLeaks:
    """Where a text repeats `k` words in a row of another one: sorted 128-bit hashes of one, looked up for the other."""

    def __init__(self, k: int):
        self.k, self.hashes = max(1, k), WordHashes()

    def spans(self, said: str, told: str) -> list[tuple[int, int, str]]:
        if not said or not told:
            return []
        _, _, known = self.hashes.runs(told, self.k)
        start, end, found = self.hashes.runs(said, self.k)
        if not known.shape[1] or not len(start):
            return []
        order = np.lexsort(known[::-1])
        first, second = known[0][order], known[1][order]
        low, high = np.searchsorted(first, found[0], "left"), np.searchsorted(first, found[0], "right")
        hit = np.zeros(len(start), bool)
        for step in range(int((high - low).max(initial=0))):  # more than one only if two first hashes agree
            at = np.minimum(low + step, len(first) - 1)
            hit |= (low + step < high) & (second[at] == found[1])
        i = np.flatnonzero(hit)
        if not len(i):
            return []
        begins = np.concatenate([[0], np.flatnonzero(np.diff(i) > self.k) + 1])
        lows, highs = np.minimum.reduceat(start[i], begins), np.maximum.reduceat(end[i], begins)
        return [(int(s), int(e), SYSTEM_PROMPT_LEAK) for s, e in zip(lows, highs, strict=True)]


FIRST = T.StructType().add("rule_id", T.StringType()).add("category", T.StringType()).add("severity", T.StringType())


def first_match(rules: list[Rule], text: Column) -> Column:
    """struct(rule_id, category, severity) of the first rule, in the given order, that the text matches once normalised; null without one.

    Rules that do not compile are skipped.
    """
    usable = [r for r in rules if r.rule_type == "KEYWORD" or r.rule_type == "REGEX" and compiles(r.pattern)]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(usable)
        for batch in batches:
            hits = [matcher.first(normalised(t or "")) for t in batch]
            rows = [(None, None, None) if i is None else (usable[i].rule_id, usable[i].category, usable[i].severity) for i in hits]
            yield pd.DataFrame(rows, columns=FIRST.names, index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, FIRST)(text)
    return F.when(found["rule_id"].isNotNull(), found)


def rule_spans(rules: list[Rule], text: Column) -> Column:
    """Merged spans of all rules' matches in the text as it stands; null text has none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(rules, keywords=False)
        for batch in batches:
            yield pd.Series([[dict(zip(("start", "end", "category"), s, strict=True)) for s in matcher.spans(t or "")] for t in batch], index=batch.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SPANS)(text)


def own_leaks(said: Column, told: Column, min_words: int) -> Column:
    """Spans of `said` that repeat min_words words of `told` of the same row: no row leaves its task for that."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        leaks = OwnLeaks(min_words)
        for a, b in batches:
            yield pd.Series([[dict(zip(("start", "end", "category"), s, strict=True)) for s in leaks.spans(x or "", y or "")] for x, y in zip(a, b, strict=True)], index=a.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SPANS)(said, told)

"""Scalar text functions over Columns: offsets of matches, spans, redaction, normalisation, words.

Spans are arrays of struct<start int, end int, category string>, half-open, in code points.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = T.ArrayType(T.StructType().add("word", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
SPANS = "array<struct<start:int,end:int,category:string>>"
#: Texts of ASCII and common letters and marks that NFKC leaves as they are.
STABLE = r"^[\x00-\x7f¡§©«¬®°±¶·»¿\xc0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u048a-\u052f\u2013\u2014\u2018-\u201e]*+$"
#: White space as Python's \s has it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PLACEHOLDER = "[REDACTED:{category}]"
SYSTEM_PROMPT_LEAK = "SYSTEM_PROMPT_LEAK"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def once(column: Column) -> Column:
    """The column as a generator of one row, which no later filter or projection evaluates again. For withColumn."""
    return F.explode_outer(F.array(column))


def unicode_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def match_spans(text: Column, pattern: str, category: str) -> Column:
    """Spans of all matches of a Java pattern, in order; empty matches are left out.

    The pieces between matches and the matches themselves alternate, so their lengths give the offsets.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        span = F.struct(s.alias("start"), (s + x["h"]).alias("end"), F.lit(category).alias("category"))
        return F.struct((s + x["h"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(pairs, start, step, lambda acc: F.filter(acc["spans"], lambda s: s["end"] > s["start"]))
    return F.when(text.rlike(pattern), spans).otherwise(no_spans())


def merge_spans(spans: Column, length: Column) -> Column:
    """Clipped to [0, length), overlapping or touching spans joined; the category of the first one stays."""
    bound = lambda x: F.greatest(F.lit(0), F.least(x, F.greatest(F.lit(0), length)))
    # The position keeps spans of one range in their order.
    clipped = F.filter(
        F.transform(spans, lambda s, i: F.struct(bound(s["start"]).alias("start"), bound(s["end"]).alias("end"), i.alias("i"), s["category"].alias("category"))),
        lambda s: s["end"] > s["start"],
    )

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["category"].alias("category"))
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(F.array_sort(clipped), no_spans(), step)


def redact(text: Column, spans: Column, placeholder: str = PLACEHOLDER) -> Column:
    """text with each merged span replaced by the placeholder of its category."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.replace(F.lit(placeholder), F.lit("{category}"), s["category"])).alias("out"))

    return F.aggregate(merge_spans(spans, F.length(text)), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def luhn_ok(digits: Column) -> Column:
    """ASCII digits only; `luhn_check` alone would take other digits too."""
    return digits.rlike(r"^[0-9]+$") & F.call_function("luhn_check", digits)


def neutralize_formula(value: Column) -> Column:
    """A leading quote before what a spreadsheet would take for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


class Folding:
    """Texts as scanners read them: NFKC by character cluster, lower case, no format characters, single spaces.

    What one code point becomes is looked up in pages of 256, which are made when a text first needs them; only clusters (a character
    and the combining marks after it) are normalised one by one, and each different one once.
    """

    CLUSTERS = 1 << 16

    def __init__(self):
        self.known = np.zeros(0x1100, bool)
        self.one: np.ndarray | None = None  # what a code point becomes, if one other
        self.odd: np.ndarray | None = None  # code points that become none or several, and combining marks
        self.clusters: dict[str, np.ndarray] = {}

    def __reduce__(self):
        return Folding, ()  # tables are made anew where they are needed

    @staticmethod
    def folded(cluster: str) -> np.ndarray:
        low = unicodedata.normalize("NFKC", cluster).lower()
        kept = "".join(" " if c.isspace() else c for c in low if c.isspace() or unicodedata.category(c) != "Cf")
        return np.frombuffer(kept.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _page(self, p: int) -> None:
        if self.one is None:
            self.one, self.odd = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(p << 8, (p + 1) << 8):
            to = self.folded(chr(c))
            if len(to) == 1 and not unicodedata.combining(chr(c)):
                self.one[c] = to[0]
            else:
                self.odd[c] = True
        self.known[p] = True

    def _cluster(self, cluster: str) -> np.ndarray:
        if (to := self.clusters.get(cluster)) is None:
            to = self.folded(cluster)
            if len(self.clusters) < self.CLUSTERS and len(cluster) < 16:
                self.clusters[cluster] = to
        return to

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, and where in the text the cluster of each begins and ends)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.uint32), points, points
        for p in np.flatnonzero(np.bincount(points >> 8, minlength=len(self.known)).astype(bool) & ~self.known).tolist():
            self._page(p)
        out, odd = self.one[points], np.flatnonzero(self.odd[points])
        if len(odd):
            begin, end = self._odd_clusters(points, odd)
            made = [self._cluster(text[s:e]) for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            size = np.ones(len(points), np.int64)
            size[odd] = 0
            size[begin] = sizes
            starts = np.repeat(np.arange(len(points)), size)
            out, ends = out[starts], starts + 1
            first = begin + np.cumsum(sizes - (end - begin)) - (sizes - (end - begin))
            where = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            out[where], ends[where] = np.concatenate(made), np.repeat(end, sizes)
        else:
            starts = np.arange(len(points))
            ends = starts + 1
        blank = out == 0x20
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        kept = np.flatnonzero(keep)
        keep[kept[-1:]] = ~blank[kept[-1:]]  # a text ends with no blank
        return (out, starts, ends) if keep.all() else (out[keep], starts[keep], ends[keep])

    def _odd_clusters(self, points: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the clusters begin and end that are not one code point which becomes one."""
        few, which = np.unique(points[odd], return_inverse=True)
        mark = np.array([unicodedata.combining(chr(c)) > 0 for c in few.tolist()])[which] & (odd > 0)
        begin = np.where(mark, -1, odd)
        # A run of marks belongs to what stands before it.
        heads = mark.copy()
        heads[1:] &= ~(mark[:-1] & (odd[1:] == odd[:-1] + 1))
        begin[heads] = odd[heads] - 1
        begin = np.unique(begin[begin >= 0])
        end = begin + 1
        at = np.searchsorted(begin, odd[mark], side="right") - 1
        np.maximum.at(end, at, odd[mark] + 1)
        return begin, end


_folding = Folding()


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalised_with_ranges(text: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The text's code points as scanners read them, and each one's range in the original; None: no character moves."""
    if text.isascii():  # runs of white space stay, which no word notices
        return np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32), None, None
    return _folding(text)


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@F.pandas_udf(WORDS)
def _words_of_any(texts: pd.Series) -> pd.Series:
    def words(text: str | None) -> list[dict]:
        points, starts, ends = normalised_with_ranges(text or "")
        ranges = ((m[0], *m.span()) for m in re.finditer(r"\w+", as_text(points)))
        return [{"word": w, "start": s if starts is None else int(starts[s]), "end": e if ends is None else int(ends[e - 1])} for w, s, e in ranges]

    return texts.map(words)


class WordHashes:
    """128-bit hashes of the words of texts, and of runs of them, in numpy."""

    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self):
        self.inside = np.zeros(0x110000, bool)
        self.inside[[c for c in range(0x30000) if chr(c).isalnum()]] = True  # what \w+ has; no letters lie beyond
        self.inside[ord("_")] = True
        self.powers = np.ones((4, 1), np.uint64)

    def _upto(self, n: int) -> np.ndarray:
        """Powers of the bases and of their inverses."""
        if self.powers.shape[1] < n:
            of = np.array([*self.BASES, *(pow(b, -1, 1 << 64) for b in self.BASES)], np.uint64)
            steps = np.repeat(of[:, None], max(n, 1 << 14), axis=1)
            steps[:, 0] = 1
            self.powers = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.powers

    def runs(self, text: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, two hashes) of each run of k words of the normalised text, in ranges of the original."""
        points, starts, ends = normalised_with_ranges(text)
        edges = np.flatnonzero(np.diff(self.inside[points].astype(np.int8), prepend=0, append=0))
        first, last = edges[::2], edges[1::2]
        n = max(0, len(first) - k + 1)
        powers = self._upto(len(points) + 1)
        out = np.zeros((2, n), np.uint64)
        for i in range(2):
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[i, : len(points)], out=sums[1:])
            words = (sums[last] - sums[first]) * powers[2 + i, first]
            words ^= words >> np.uint64(29)
            words *= np.uint64(self.BASES[1 - i])
            words ^= words >> np.uint64(32)
            for j in range(k):
                out[i] = out[i] * np.uint64(self.BASES[i]) + words[j : j + n]
        begin, end = first[:n], last[k - 1 :]
        return (begin, end, out) if starts is None else (starts[begin], ends[end - 1], out)


def _only(column: Column, condition: Column) -> Column:
    """The value where the condition holds, else null: what a Python function must not see costs it nothing."""
    return F.when(condition, column)


def normalise_for_rules(text: Column) -> Column:
    """NFKC, white space to single spaces, stripped; null is empty. Only texts that NFKC may change meet Python."""
    text = F.coalesce(text, F.lit(""))
    folded = F.coalesce(_nfkc(_only(text, ~text.rlike(STABLE))), text)
    return F.trim(F.regexp_replace(folded, SPACE + "+", " "))


def ascii_words(text: Column) -> Column:
    """Words of an ASCII text, lower case, with their ranges."""
    gaps = F.transform(F.split(text, r"\w+", -1), F.length)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.struct(g.alias("g"), w.alias("w")))
    typed = "array<struct<word:string,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(typed).alias("words"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        word = F.struct(x["w"].alias("word"), s.alias("start"), (s + F.length(x["w"])).alias("end"))
        return F.struct(word["end"].alias("at"), F.concat(acc["words"], F.array(word)).alias("words"))

    return F.aggregate(pairs, start, step, lambda acc: acc["words"])


def words(text: Column) -> Column:
    """Array of (word, start, end): normalised words with ranges in the original text."""
    return _words_of_any(F.coalesce(text, F.lit("")))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; null where a logit is not finite."""
    bad = F.exists(logits, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(~bad, F.transform(logits, lambda x: F.exp(x - top) / total))


def sigmoid(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), 1 / (1 + F.exp(-x)))


def head_and_tail(items: Column, most: int) -> Column:
    """An array cut to `most` items: the first half of them, and the rest from the end."""
    head = most // 2
    tail = most - head
    return F.when(F.size(items) <= most, items).otherwise(F.concat(F.slice(items, F.lit(1), F.lit(head)), F.slice(items, F.lit(-tail), F.lit(tail))))



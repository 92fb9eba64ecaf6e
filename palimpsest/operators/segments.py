"""Operators that SQL can't express: best source window, character ratio, and the section filter. Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.pieces import struct_of

_WORD = re.compile(r"\w+")


def char_ratio(query: str | None, source: str | None) -> float:
    """difflib ratio of two lower-cased texts; shared words over the larger set if one has over 1000 characters."""
    a, b = query or "", source or ""
    if max(len(a), len(b)) > 1000:
        x, y = set(a.lower().split()), set(b.lower().split())
        return len(x & y) / max(len(x), len(y)) if x and y else 0.0
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def char_similarity(query: Column, source: Column) -> Column:
    @F.pandas_udf("double")
    def of(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([char_ratio(a, b) for a, b in zip(q, s, strict=True)], dtype=float)

    return of(query, source)


def base_ratio(query: str | None, source: str | None) -> float:
    """difflib ratio of two lower-cased texts of any length."""
    return SequenceMatcher(None, (query or "").lower(), (source or "").lower()).ratio()


def base_similarity(query: Column, source: Column) -> Column:
    @F.pandas_udf("double")
    def of(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([base_ratio(a, b) for a, b in zip(q, s, strict=True)], dtype=float)

    return of(query, source)


class _Window:
    """Counts of a window's tokens and n-grams that also occur in the query, kept while it slides."""

    def __init__(self, query: list[str], source: list[str], n: int = 5):
        self.n, self.words = n, set(query)
        self.grams = {tuple(query[i : i + n]) for i in range(len(query) - n + 1)}
        self.source = source
        self.seen_words: Counter = Counter()
        self.seen_grams: Counter = Counter()
        self.at = (0, 0)

    def score(self, start: int, end: int) -> tuple[float, int, float]:
        self._to(start, end)
        overlap = len(self.seen_words) / len(self.words) if self.words else 0.0
        phrases = len(self.seen_grams)
        return 0.6 * overlap + 0.4 * (phrases / len(self.grams) if self.grams else 0.0), phrases, overlap

    def _to(self, start: int, end: int) -> None:
        if start >= self.at[1] or start < self.at[0] or end < self.at[1]:
            self.seen_words.clear()
            self.seen_grams.clear()
            self.at = (start, start)
        for k in range(self.at[0], start):
            self._count(self.seen_words, self.source[k], -1)
            if k + self.n <= self.at[1]:
                self._count(self.seen_grams, tuple(self.source[k : k + self.n]), -1)
        for k in range(self.at[1], end):
            self._count(self.seen_words, self.source[k], 1)
            if k - self.n + 1 >= start:
                self._count(self.seen_grams, tuple(self.source[k - self.n + 1 : k + 1]), 1)
        self.at = (start, end)

    def _count(self, seen: Counter, item, by: int) -> None:
        if item in (self.words if isinstance(item, str) else self.grams):
            seen[item] += by
            if not seen[item]:
                del seen[item]


def best_segment(query: str | None, source: str | None) -> tuple[float, int, float, int, int, str]:
    """(lexical, phrases, overlap, start, end, segment) of the source window most like the query.

    Windows of the query's length, then of 1.2 times that, every tenth of it (five tokens at least); the first
    of equals stays. A source no longer than the query is its own window.
    """
    q, s = _WORD.findall((query or "").lower()), _WORD.findall((source or "").lower())
    if not q or not s:
        return 0.0, 0, 0.0, 0, 0, ""
    spans = [(0, len(s))]
    if len(s) > len(q):
        step = max(5, len(q) // 10)
        spans = [(k, k + size) for size in (len(q), min(int(1.2 * len(q)), len(s))) for k in range(0, len(s) - size + 1, step)]
    w, best = _Window(q, s), None
    for start, end in spans:
        found = (*w.score(start, end), start, end)
        if best is None or found[0] > best[0]:
            best = found
    return (*best, " ".join(s[best[3] : best[4]]))


def verified(query: Column, source: Column) -> Column:
    """Struct of the best segment, for candidates that survived the shingle join."""

    @F.pandas_udf("lexical double, phrases int, overlap double, start int, end int, segment string")
    def of(q: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_segment(a, b) for a, b in zip(q, s, strict=True)], columns=["lexical", "phrases", "overlap", "start", "end", "segment"])

    return of.asNondeterministic()(query, source)


# Headings that begin sections to leave out, and headings that resume content.
EXCLUDED_HEADINGS = {
    "references": [r"references?", r"bibliography", r"literature\s+cited", r"works?\s+cited", r"cited\s+literature", r"\d+\.\s*references?"],
    "authors": [r"authors?:?", r"author\s+information", r"about\s+the\s+authors?"],
    "affiliations": [r"affiliations?:?", r"author\s+affiliations?"],
    "contributions": [r"author\s+contributions?:?", r"contributions?:?", r"author\s+roles?", r"credit\s+authorship.*"],
    "acknowledgements": [r"acknowledge?ments?:?"],
    "funding": [r"funding", r"financial\s+support", r"grant\s+support", r"funding\s+sources?"],
    "conflicts": [r"conflicts?\s+of\s+interests?", r"competing\s+interests?", r"declaration\s+of\s+interests?", r"disclosures?"],
    "copyright": [r"copyright", r"©\s*\d{4}.*", r"all\s+rights\s+reserved"],
    "data_availability": [r"data\s+availability", r"data\s+access", r"availability\s+of\s+data", r"code\s+availability"],
    "supplementary": [r"supplementary\s+(?:material|information|data)", r"supporting\s+information"],
    "ethics": [r"ethics\s+(?:statement|approval|declaration)", r"ethical\s+approval"],
}
CONTENT_HEADINGS = [r"abstract", r"introduction", r"background", r"methods?", r"materials?\s+and\s+methods?", r"experimental", r"results?", r"discussion", r"conclusions?", r"summary"]
# Text to delete inside lines, in this order.
INLINE_DELETES = [
    r"\S+@\S+\.\S+",
    r"orcid\.org/[\d\-]+",
    r"ORCID:?\s*[\d\-]+",
    r"©\s*\d{4}[^.]*",
    r"All rights reserved\.?\s*No reuse allowed without permission\.?",
    r"certified by peer review\) is the author/funder[^.]*\.",
    r"who has granted (?:bioRxiv|medRxiv|arXiv) a license to display the preprint in perpetuity\.",
    r"The copyright holder for this preprint \(which was not[^)]*\)",
    r"this version posted [A-Za-z]+ \d+, \d{4}\.",
    r"doi:\s*(?:https?://)?(?:doi\.org/)?10\.\d{4,}/[^\s]+",
    r"https://doi\.org/10\.\d{4,}/[^\s]+",
    r"(?:This\s+)?(?:preprint|manuscript)\s+(?:was\s+)?(?:posted|submitted|uploaded)\s+(?:to|on)\s+(?:bioRxiv|medRxiv|arXiv)[^.]*\.?",
    r"NOTE:\s*This preprint reports new research[^.]*\.",
    r"not been certified by peer review and should not be used to guide clinical practice\.?",
    r"Author contributions?:\s*[^.]+(?:\.[^.]+){0,5}\.",
    r"Study concept and design \([^)]+\);[^.]+\.",
    r"\([A-Z]{2,3}(?:,\s*[A-Z]{2,3})*\)\s*;",
    r"Affiliations?:\s*\d+[^.]+(?:;\s*\d+[^.]+)*",
    r"\d+[A-Za-z\s]+(?:UMC|University|Institute|Hospital|Center|Centre)[^;.]*[;.]",
    r"[§*#]+\s*(?:Corresponding|Shared corresponding)\s+authors?:?[^.]*",
    r"Correspondence[^.]+should be addressed to[^.]+\.",
    r"Sources? of funding:\s*[^.]+\.",
    r"This work was supported by[^.]+\.",
    r"funded by[^.]+\.",
    r"Disclosures?:\s*[^.]+\.",
    r"No conflicts? of interest to declare\.?",
    r"The authors? declare[^.]+no (?:competing )?(?:conflicts? of )?interests?\.?",
    r"Tel:\s*\+?[\d\s\-]+;?\s*Fax:\s*\+?[\d\s\-]+;?",
    r"Email:\s*\S+@\S+",
    r"Word [Cc]ount:\s*\d+",
    r"RUNNING HEAD:[^.]+",
    r"Keywords?:\s*[^.]+\.",
    r"LIST OF ABBREVIATIONS",
    r"\*\s*These (?:first )?authors contributed equally",
    r"[§#]\s*(?:Shared|List of)[^.]+",
    r"on behalf of the [A-Z]+ working group[#*]?",
    r"List of working group members appears at the end of this manuscript",
]
PHRASE_DELETES = [
    r"the\s+authors?\s+declare\s+(?:that\s+)?(?:they\s+have\s+)?no\s+(?:competing\s+)?(?:conflicts?\s+of\s+)?interests?",
    r"all\s+authors?\s+(?:have\s+)?read\s+and\s+(?:approved|agreed)",
    r"this\s+work\s+was\s+supported\s+by",
    r"the\s+authors?\s+would\s+like\s+to\s+(?:thank|acknowledge)",
    r"we\s+(?:would\s+like\s+to\s+)?thank\s+[\w\s,]+\s+for\s+(?:their\s+)?(?:helpful|valuable)",
    r"the\s+funders?\s+had\s+no\s+role\s+in",
    r"data\s+(?:are|is)\s+available\s+(?:upon|on)\s+(?:reasonable\s+)?request",
    r"correspondence\s+(?:and\s+requests?\s+for\s+materials?\s+)?should\s+be\s+addressed\s+to",
    r"contributed\s+equally\s+to\s+this\s+work",
    r"these\s+authors?\s+contributed\s+equally",
    r"certified by peer review",
    r"granted (?:bioRxiv|medRxiv) a license",
    r"display the preprint in perpetuity",
    r"no reuse allowed without permission",
    r"all rights reserved",
]
HEADER_ENDS = [r"\n\s*abstract\s*(?:\n|$|[:.])", r"\n\s*(?:objective|background|purpose):\s"]
# Where the front matter ends in a text without an abstract; case counts, the first pattern found holds.
FALLBACK_ENDS = [r"\n\s*Keywords?:", r"\n\s*Disclosures?:", r"\n\s*Sources? of [Ff]unding:", r"\n\s*INTRODUCTION\s*\n", r"\n\s*Introduction\s*\n"]

_EXCLUDED = [(name, re.compile(rf"\s*(?:{'|'.join(p)})\s*", re.I)) for name, p in EXCLUDED_HEADINGS.items()]
_CONTENT = re.compile(rf"\s*(?:{'|'.join(CONTENT_HEADINGS)})\s*", re.I)
_NUMBERED = re.compile(r"\s*\d+\.\s+\w+")
_DELETES = [re.compile(p, re.I) for p in INLINE_DELETES + PHRASE_DELETES]
_HEADERS = [re.compile(p, re.I) for p in HEADER_ENDS] + [re.compile(p) for p in FALLBACK_ENDS]


def filter_sections(text: str | None, aggressive: bool = False, numbered_resume: bool = True) -> tuple[str, list[str], float]:
    """(kept text, removed sections, removed percentage).

    Front matter before the abstract, or without one before a later mark, goes, then inline deletes, then lines from an excluded heading until a
    content heading; with ``numbered_resume`` a numbered line resumes too, which lets numbered references in.
    """
    source = text or ""
    out, removed = source, []
    for p in _HEADERS:
        if m := p.search(out):
            if m.start() > 0:
                removed.append("header_block")
            out = out[m.start() :]
            break
    for p in _DELETES:
        out = p.sub("", out)
    kept, skipping = [], False
    for line in out.split("\n"):
        if not line.strip():
            continue
        name = next((n for n, p in _EXCLUDED if (n != "ethics" or aggressive) and p.fullmatch(line)), None)
        if name:
            skipping = True
            if name not in removed:
                removed.append(name)
        elif skipping and (_CONTENT.fullmatch(line) or (numbered_resume and _NUMBERED.match(line))):
            skipping = False
        if not skipping:
            kept.append(line)
    final = "\n".join(kept).strip()
    return final, removed, round(100 * (1 - len(final) / len(source)), 2) if source else 0.0


def section_filter(text: Column | str) -> Column:
    return struct_of(filter_sections, "text string, removed array<string>, removed_percentage double", F.col(text) if isinstance(text, str) else text)


def _section_sizes(text: str | None) -> tuple[int, list[str], float]:
    kept, removed, share = filter_sections(text)
    return len(kept), removed, share


def section_sizes(text: Column | str) -> Column:
    """As :func:`section_filter`, with the number of characters kept instead of the text, which stays in the worker."""
    return struct_of(_section_sizes, "n_chars int, removed array<string>, removed_percentage double", F.col(text) if isinstance(text, str) else text)

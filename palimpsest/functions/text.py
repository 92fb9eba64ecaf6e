"""Text functions as native columns: tokens, n-grams, sentences, cleaning, flags, chunks and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .pieces import struct_of


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens_a(text: Column | str) -> Column:
    """Lower-cased words of two or more characters; whatever is no letter, digit, underscore or white space splits."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_\s]", " ")), r"\s+"), lambda x: F.length(x) > 1)


def tokens_b(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores, single characters included."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ngram_list(tokens: Column, n: int) -> Column:
    """All n-grams in order, repeats included; none for fewer tokens than n."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.array_distinct(ngram_list(tokens, n))


def _different_grams(tokens: str | None, sizes: tuple[int, ...]) -> tuple[int, ...]:
    t = tokens.split(" ") if tokens else []
    return tuple(len(set(zip(*(t[k:] for k in range(n)), strict=False))) for n in sizes)


def ngram_numbers(text: Column | str, sizes: tuple[int, ...]) -> Column:
    """Struct of the numbers of different n-grams of :func:`tokens_b`, ``n3`` for size 3 and so on; 0 for null.

    Tokens are found in the JVM and cross over as one text; a token holds no space, so that tuples differ where joined n-grams do.
    """
    joined = F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", " "))
    return struct_of(lambda t: _different_grams(t, sizes), ", ".join(f"n{n} int" for n in sizes), joined)


def sentences(text: Column | str) -> Column:
    """Trimmed sentences of over 20 characters; a full stop, ! or ?, then white space and a capital A-Z ends one."""
    return F.filter(F.transform(F.split(_col(text), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 20)


def clean(text: Column | str) -> Column:
    """Without invisible characters; runs of spaces to one, line ends to LF, three or more LF to two."""
    out = F.translate(_col(text), K.INVISIBLE, "")
    for pattern, to in ((" +", " "), ("\r\n|\r", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return out


def _any(text: Column, patterns: list[str], prefix: str = "") -> Column:
    return text.rlike(prefix + "|".join(f"(?:{p})" for p in patterns))


def is_boilerplate(text: Column | str, enhanced: bool = True) -> Column:
    return _any(F.lower(_col(text)), K.BOILERPLATE_ENHANCED if enhanced else K.BOILERPLATE_BASE)


def has_common_phrase(text: Column | str) -> Column:
    return _any(F.lower(_col(text)), K.COMMON_PHRASES)


def has_citation(text: Column | str) -> Column:
    return _any(_col(text), K.CITATIONS, "(?i)")


def citation_type(text: Column | str) -> Column:
    """numbered, author_year, author_reference or contextual; null without a citation."""
    t = _col(text)
    kind = F.when(t.rlike(r"\[\s*\d+"), "numbered").when(t.rlike(r"\(\s*\d{4}\s*\)"), "author_year").when(t.rlike(r"(?i)et\s+al"), "author_reference").otherwise("contextual")
    return F.when(has_citation(t), kind)


def words(text: Column | str) -> Column:
    """White-space separated words, without the empty one."""
    return F.filter(F.split(_col(text), r"\s+"), lambda x: F.length(x) > 0)


def once(value: Column, then) -> Column:
    """``then`` of a value that is computed once per row, however often ``then`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def chunks_sized(w: Column, size: int, step: int, least: int) -> Column:
    """(start, words) of windows that hold at least ``least`` words, starts every ``step``."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step)), lambda s: F.least(F.lit(size), F.size(w) - s) >= least)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size), F.size(w) - s).alias("n_words"), F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("chunk")))


def chunks_query(text: Column | str, size: int = 200, overlap: float = 0.5, least: int = 50) -> Column:
    """Query side: a text of up to ``size`` words is one chunk as it stands; else windows until one is short."""

    def cut(w: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.size(w).alias("n_words"), _col(text).alias("chunk")))
        return F.when(F.size(w) <= size, whole).otherwise(chunks_sized(w, size, int(size * (1 - overlap)), least))

    return once(words(text), cut)


def chunks_index(text: Column | str) -> Column:
    """Index side: 200 words every 100, each of at least 100."""
    return once(words(text), lambda w: chunks_sized(w, 200, 100, 100))


def chunks_bulk(text: Column | str) -> Column:
    """Bulk script: 512 words every 462, each of at least 50."""
    return once(words(text), lambda w: chunks_sized(w, 512, 462, 50))


def paper_id(server: Column, doi: Column) -> Column:
    """server + _ + the DOI's suffix with . and / as _."""
    return F.concat_ws("_", F.lower(server), F.regexp_replace(F.element_at(F.split(doi, "/", 2), -1), r"[./]", "_"))


def chunk_id(paper: Column, index: Column) -> Column:
    return F.concat(paper, F.lit("_chunk_"), index.cast("string"))


def figure_id(paper: Column, page: Column, index: Column) -> Column:
    return F.concat(paper, F.lit("_fig_p"), page.cast("string"), F.lit("_"), index.cast("string"))


def table_id(paper: Column, page: Column, index: Column) -> Column:
    return F.concat(paper, F.lit("_tbl_p"), page.cast("string"), F.lit("_"), index.cast("string"))


def subfigure_id(figure: Column, label: Column) -> Column:
    return F.concat(figure, F.lit("_"), F.lower(label))


def id_kind(x: Column) -> Column:
    return F.when(x.contains("_fig_p"), "figure").when(x.contains("_tbl_p"), "table").when(x.contains("_chunk_"), "chunk").otherwise("paper")


def doi_from_paper_id(paper: Column) -> Column:
    """Back to a DOI; underscores become dots (lossy for legacy suffixes), parts after the fourth are dropped."""
    return F.concat(F.lit("10.1101/"), F.array_join(F.slice(F.split(F.regexp_replace(paper, r"^[^_]*_", ""), "_"), 1, 4), "."))


def short_digest(x: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 of bytes or text: ids of tables and images without one."""
    return F.substring(F.md5(x), 1, 8)


def doi_date(doi: Column) -> Column:
    """(year, month, day) of a dated DOI suffix, or null for a legacy one."""
    parts = F.split(F.element_at(F.split(doi, "/"), -1), r"\.")
    return F.when((F.size(parts) >= 4) & F.element_at(parts, 1).rlike(r"^\d{4}$"), F.struct(parts[0].alias("year"), parts[1].alias("month"), parts[2].alias("day")))


def doi_from_filename(name: Column) -> Column:
    """All separators after the first to dots; uuid names stay as they are."""
    stem = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    return F.when(stem.startswith("uuid_"), stem).otherwise(F.regexp_replace(F.regexp_replace(stem, "^([^_]+)_", "$1/"), "_", "."))


def abstract(text: Column | str) -> Column:
    """Text after an abstract or else a summary heading up to the introduction, white space to one space, at most 3000 characters."""
    def after(head: str) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(_col(text), head, 1), r"\s+", " ")), F.lit(""))

    found = F.coalesce(after(r"(?is)abstract[:\s]*\n(.*?)(?:\n\s*(?:introduction|background|keywords|1\.)|$)"), after(r"(?is)(?:^|\n)\s*summary\s*\n(.*?)(?=\n\s*(?:introduction|keywords|1\.))"))
    return F.substring(found, 1, 3000)


def title_guess(text: Column | str) -> Column:
    """Longest of the first ten lines with 20 to 300 characters and none of the stop words; of equals the greatest."""
    stop = "abstract|introduction|keywords|doi:|http"
    lines = F.filter(F.transform(F.slice(F.split(_col(text), "\n"), 1, 10), lambda s: F.trim(s)), lambda s: (F.length(s) > 20) & (F.length(s) < 300) & ~F.lower(s).rlike(stop))
    return F.array_max(F.transform(lines, lambda s: F.struct(F.length(s).alias("n"), s.alias("line"))))["line"]


def author_list(authors: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(authors), r";|,| and |&"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def excluded_section(name: Column | str) -> Column:
    return F.lower(_col(name)).rlike("|".join(K.EXCLUDED_SECTION_WORDS))


def month_key(label: Column | str) -> Column:
    """Month_YYYY as a date to sort by; unknown labels sort first."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(_col(label), "_", " "), F.lit("MMMM yyyy")).cast("date"), F.lit("0001-01-01").cast("date"))

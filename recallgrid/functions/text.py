"""Text functions as columns.  Only Unicode normalisation and boundary-seeking chunks need Python, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words of queries.
STOP_WORDS = [
    "find", "show", "me", "the", "a", "an", "my", "that", "this", "one", "screenshot", "screenshots", "image", "images", "picture", "pictures",
    "where", "i", "saw", "saved", "with", "about", "containing", "which", "was", "is", "for", "of", "on", "in", "to", "from",
]
# Stop words of keywords.
KEYWORD_STOP_WORDS = ["the", "and", "for", "that", "this", "with", "from", "you", "your", "are", "was", "have", "has", "but", "not", "www", "http", "https"]
# Patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
#: White space and mail addresses as RE2, so SQL, takes them: word ends are those of ASCII letters, digits and _, whatever the release of Java.
ASCII_SPACE = r"[\t\n\f\r ]+"
_ASCII_END = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ASCII_EMAIL = EMAIL.replace(r"\b", _ASCII_END)
URL = r"(?i)\b(?:https?://|www\.)[^\s<>]+"
PHONE = r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)"
MONEY = r"(?i)(?:₹\s?\d[\d,]*(?:\.\d+)?|Rs\.?\s?\d[\d,]*(?:\.\d+)?|INR\s?\d[\d,]*(?:\.\d+)?|\$\s?\d[\d,]*(?:\.\d+)?|€\s?\d[\d,]*(?:\.\d+)?|£\s?\d[\d,]*(?:\.\d+)?)"
#: Money in the four commonest ways of writing it, with white space and letter case as RE2, so SQL, takes them.
COMMON_MONEY = r"(?i)(?:R[sſ]\.?|₹|INR|\$)[\t\n\f\r ]?\d[\d,]*(?:\.\d+)?"
QUERY_TOKEN = r"[A-Za-z0-9₹$€£]+(?:[._+#-][A-Za-z0-9₹$€£]+)*"
DOC_TOKEN = r"[a-zA-Z0-9₹$@._-]+"
RERANK_TOKEN = r"[a-z0-9₹$€£]+(?:[._+#@:/-][a-z0-9₹$€£]+)*"

RERANK_CHARS = 50_000


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def normalize(c: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalize_ws(c: Column, keep_lines: bool = True) -> Column:
    """One line, or lines trimmed with blanks collapsed and at most one empty line between."""
    if not keep_lines:
        return collapse(c)
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?m)^ +| +$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_invisible(c: Column) -> Column:
    """Without zero-width and control characters, but tab and line ends."""
    return F.regexp_replace(c, "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def strip_ocr_artifacts(c: Column) -> Column:
    """Without leading bullets and rule lines; runs of six or more equal characters become three."""
    c = F.regexp_replace(c, r"(?m)^[ \t]*[•●▪■◆*]+[ \t]+", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*[-_=~|]{3,}[ \t]*$", "")
    return F.regexp_replace(c, r"(.)\1{5,}", "$1$1$1")


def normalize_unicode(c: Column, form: str = "NFKC") -> Column:
    """Normal form, in Python only for texts that are not ASCII."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), normal(F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), c))).otherwise(c)


def clean_text(c: Column, keep_lines: bool = True, unicode: bool = True) -> Column:
    c = normalize_unicode(c) if unicode else c
    return normalize_ws(strip_ocr_artifacts(strip_invisible(c)), keep_lines)


def normalize_for_search(c: Column, unicode: bool = True) -> Column:
    c = F.replace(F.lower(clean_text(c, False, unicode)), F.lit("ß"), F.lit("ss"))
    return collapse(F.regexp_replace(c, r"(?U)[^\w\s@.+#%₹$€£:/_-]", " "))


def normalize_query(c: Column, most: int = 1000) -> Column:
    return F.trim(F.substring(collapse(c), 1, most))


def tokenize_query(c: Column) -> Column:
    return F.array_distinct(found(F.lower(normalize_query(c)), QUERY_TOKEN))


def tokenize_doc(c: Column) -> Column:
    """Tokens of the normalised text; white space is in none, so it need not be collapsed first."""
    return found(F.lower(F.coalesce(c, F.lit(""))), DOC_TOKEN)


def tokenize_rerank(c: Column) -> Column:
    return F.array_distinct(found(normalize(F.substring(F.coalesce(c, F.lit("")), 1, RERANK_CHARS)), RERANK_TOKEN))


def meaningful_tokens(c: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokenize_doc(c), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def tokenize_words(c: Column) -> Column:
    return found(F.coalesce(c, F.lit("")), r"(?U)\b[\w'-]+\b")


def unique_words(c: Column) -> Column:
    return F.array_distinct(F.transform(tokenize_words(c), lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss"))))


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def split_paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def truncate_text(c: Column, most: int, suffix: str = "…") -> Column:
    """At most ``most`` characters, cut at the last space if that is not far back."""
    text, room = collapse(c), most - len(suffix)
    head = F.substring(text, 1, room)
    space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(space >= int(room * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit(suffix)))


def prepare_for_embedding(c: Column, most: int, unicode: bool = True) -> Column:
    return F.substring(clean_text(c, False, unicode), 1, most)


def is_meaningful(c: Column, chars: int = 3, alnum: int = 2) -> Column:
    text = collapse(c)
    return (F.length(text) >= chars) & (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= alnum)


def is_structured_query(c: Column) -> Column:
    return F.rlike(c, F.lit(r"[0-9?$@.]")) | F.rlike(c, F.lit(r"(?i)\b[A-Z]{2,}\d{2,}\b"))


def extract_emails(c: Column) -> Column:
    return F.array_distinct(found(c, EMAIL))


def extract_urls(c: Column) -> Column:
    return F.array_distinct(found(c, URL))


def extract_phones(c: Column) -> Column:
    return F.array_distinct(F.transform(found(c, PHONE), lambda s: F.trim(s)))


def extract_money(c: Column, pattern: str = MONEY, repeats: bool = False) -> Column:
    amounts = found(c, pattern)
    return amounts if repeats else F.array_distinct(amounts)


def keywords_plain(c: Column, most: int = 25) -> Column:
    """Words of three or more characters that are no stop words, in order."""
    words = F.transform(found(F.lower(c), r"[A-Za-z0-9][A-Za-z0-9_+#.-]{2,}"), lambda w: F.regexp_replace(w, r"^[.]+|[.]+$", ""))
    stop = F.array(*map(F.lit, KEYWORD_STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))), 1, most)


def keywords_symbols(c: Column, most: int = 30) -> Column:
    words = F.transform(found(F.lower(c), r"[A-Za-z0-9₹$@#._-]+"), lambda w: F.regexp_replace(w, r"^[._-]+|[._-]+$", ""))
    stop = F.array(*map(F.lit, KEYWORD_STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))), 1, most)


def keywords_split(c: Column, most: int = 30) -> Column:
    """White-space words of four or more characters that are not numbers."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~F.rlike(w, F.lit(r"^\d+$")))), 1, most)


def text_statistics(df: DataFrame, name: str, space: str = r"\s+", email: str = EMAIL) -> DataFrame:
    """Counts and flags of text column ``name``, one pass of each pattern; ``space`` and ``email``: the patterns of white space and of mail addresses."""
    t = F.coalesce(F.col(name), F.lit(""))
    words = tokenize_words(t)
    return df.withColumn("__words", words).withColumns({
        "characters": F.length(t), "characters_no_spaces": F.length(F.regexp_replace(t, space, "")), "words": F.size("__words"),
        "lines": F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\n\z", ""), "\n"))),
        "sentences": F.size(split_sentences(t)), "paragraphs": F.size(split_paragraphs(t)),
        "unique_words": F.size(F.array_distinct(F.transform("__words", F.lower))),
        "average_word_length": F.when(F.size("__words") == 0, 0.0).otherwise(F.round(F.aggregate("__words", F.lit(0), lambda a, w: a + F.length(w)) / F.size("__words"), 2)),
        "has_numbers": F.rlike(t, F.lit(r"\d")), "has_email": F.rlike(t, F.lit(email)), "has_url": F.rlike(t, F.lit(URL)), "has_phone": F.rlike(t, F.lit(PHONE)), "has_money": F.rlike(t, F.lit(MONEY)),
    }).drop("__words")


def chunk_spans(text: str, size: int = 1500, overlap: int = 150) -> Iterator[tuple[int, int, int]]:
    """(index, start, end) of overlapping chunks that end at a line, sentence or word where one ends late enough."""
    start = index = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = max(text.rfind(mark, start, end) for mark in ("\n", ". ", " "))
            if at >= start + int(size * 0.55):
                end = at + 1 if text.startswith(". ", at) else at
        part = text[start:end]
        if part.strip():
            first = start + len(part) - len(part.lstrip())
            yield index, first, first + len(part.strip())
            index += 1
        if end >= len(text):
            return
        start = end - overlap if end - overlap > start else end


def chunk_text(df: DataFrame, key: str, name: str, size: int = 1500, overlap: int = 150) -> DataFrame:
    """(key, chunk_index, chunk_start, chunk_end, chunk) of text column ``name``, white space normalised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(batch["k"], batch["t"]) for i, a, b in chunk_spans(t, size, overlap)]
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "chunk_start", "chunk_end", "chunk"])

    kind = dict(df.dtypes)[key]
    given = df.select(F.col(key).alias("k"), normalize_ws(F.col(name)).alias("t"))
    return given.mapInPandas(run, f"key {kind}, chunk_index int, chunk_start int, chunk_end int, chunk string").withColumnRenamed("key", key)


def token_intersection(query: Column, text: Column) -> Column:
    """Distinct tokens of letters and digits that both have, whatever their case."""
    low = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_intersect(low(text), low(query))

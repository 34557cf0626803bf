"""Table functions: one text to many rows, for SQL and for lateral joins.

    register(spark)
    spark.sql("SELECT doc_id, s.* FROM documents, LATERAL entity_spans(text) AS s")
    documents.lateralJoin(EntitySpans(F.col("text").outer()))

Positions of all occurrences are what built-in functions don't tell, so these are Python, in Arrow batches.  Null and empty texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.classify import ENTITY_PATTERNS
from .keywords import automaton
from .text import chunk_spans

#: What a text must hold for a pattern to have a match.
NEEDS = {"EMAIL": "@", "USERNAME": "@", "PHONE": "0-9", "MONEY": "0-9", "DATE": "0-9", "TIME": ":"}


#: What every telephone number holds, told without a look back at each character.
TEN_DIGITS = re.compile(r"[0-9](?:[\s.-]?[0-9]){9}", re.ASCII)
KINDS = {word: [key for key, words in rules.DICTIONARIES.items() if word in words] for words in rules.DICTIONARIES.values() for word in words}


def _words(words: list[str]) -> str:
    """Plain words between word boundaries, words with signs anywhere; the longest that starts at a place."""
    return "|".join(rf"(?<!\w){w}(?!\w)" if w.isalnum() else re.escape(w) for w in sorted(words, key=len, reverse=True))


def _standing(low: str) -> dict[tuple[str, float], list[tuple[int, int]]]:
    """(start, end) of the dictionaries' words by kind and place, as ``_words`` finds them, from one pass for all words."""
    hits = []
    inside = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    for last, word in automaton(tuple(KINDS)).iter(low):
        first = last + 1 - len(word)
        if not (word.isalnum() and (inside(first - 1) or inside(last + 1))):
            hits.append((first, -len(word), word))
    found: dict[tuple[str, float], list[tuple[int, int]]] = {key: [] for key in rules.DICTIONARIES}
    for first, less, word in sorted(hits):
        for key in KINDS[word]:
            if not found[key] or found[key][-1][1] <= first:
                found[key].append((first, first - less))
    return found


def spans(text: str) -> Iterator[tuple[str, str, int, int, float, str]]:
    """(type, text, start, end, confidence, source) of every entity in ``text``, by kind and place; of one kind, spans don't overlap."""
    for kind, (pattern, confidence) in ENTITY_PATTERNS.items():
        if (kind not in NEEDS or re.search(f"[{NEEDS[kind]}]", text)) and (kind != "PHONE" or TEN_DIGITS.search(text)):
            for m in re.finditer(pattern, text, re.ASCII):
                whole = m.group(0)
                first = m.start() + len(whole) - len(whole.lstrip())
                yield kind, whole.strip(), first, first + len(whole.strip()), confidence, "regex"
    low = text.lower()
    if len(low) == len(text):  # else lower case has moved the places
        for (kind, confidence), places in _standing(low).items():
            for first, after in places:
                yield kind, text[first:after], first, after, confidence, "dictionary"
    else:
        for (kind, confidence), words in rules.DICTIONARIES.items():
            for m in re.finditer(_words(words), text, re.IGNORECASE):
                yield kind, m.group(0), m.start(), m.end(), confidence, "dictionary"


@F.udtf(returnType="type string, text string, start int, end int, confidence double, source string", useArrow=True)
class EntitySpans:
    """entity_spans(text): every entity with its place, end exclusive, in characters."""

    def eval(self, text: str):
        if text:
            yield from spans(text)


@F.udtf(returnType="chunk_index int, chunk_start int, chunk_end int, chunk string", useArrow=True)
class ChunkText:
    """chunk_text(text, size, overlap): overlapping chunks that end at a line, sentence or word where one ends late enough."""

    def eval(self, text: str, size: int, overlap: int):
        for i, first, after in chunk_spans(text or "", size, overlap):
            yield i, first, after, text[first:after]


def register(spark: SparkSession) -> None:
    """Make entity_spans and chunk_text known to SQL in this session."""
    spark.udtf.register("entity_spans", EntitySpans)
    spark.udtf.register("chunk_text", ChunkText)

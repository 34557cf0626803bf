"""Derived fields of a memory, and the whole enrichment of a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keywords import once
from ..functions.ids import first_non_empty
from ..sources.staging import staged
from . import classify, stats
from .joins import bounded

# Words that make a text a receipt, and that make a line an address.
RECEIPT_TERMS = ["bill", "receipt", "invoice", "subtotal", "total", "tax", "gst", "hotel", "restaurant", "amount", "payment"]
ADDRESS_TERMS = ["road", "street", "nagar", "colony", "avenue", "main", "salem", "chennai", "coimbatore", "tamil nadu", "district", "pin"]
# The keys of an analysis.
ANALYSIS = "category string, subcategory string, title string, summary string, confidence double, keywords array<string>, products array<string>, organizations array<string>"


# Fields of concepts that an analysis has.
CONCEPT_FIELDS = ["visual_concepts", "objects", "actions", "relationships", "food_concepts", "product_concepts", "document_concepts", "technology_concepts", "coding_concepts", "ui_concepts", "location_concepts", "activity_concepts", "topic_concepts", "general_concepts", "scene", "environment"]


def generate_title(title: Column, text: Column, most: int = 80) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = lambda own: F.when(F.length(own) > most, F.concat(F.rtrim(F.substring(own, 1, most - 1)), F.lit("…"))).otherwise(F.coalesce(own, F.lit("Untitled Memory")))
    return once(once(F.get(lines, F.lit(0)), lambda line: first_non_empty(title, line)), short)


def summarize(category: Column, text: Column, least: int = 5, most: int = 140) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: T.collapse(x)), lambda x: F.length(x) >= least)
    name = F.initcap(F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("other")))
    return F.when(F.size(lines) > 0, F.concat(name, F.lit(" screenshot: "), F.substring(F.get(lines, F.lit(0)), 1, most))).otherwise(F.concat(name, F.lit(" screenshot")))


def generate_tags(*values: Column, most: int = 50) -> Column:
    tags = F.transform(F.filter(F.array(*values), lambda v: F.trim(v) != ""), lambda v: F.substring(F.regexp_replace(F.lower(F.trim(v)), r"\s+", "_"), 1, most))
    return F.array_distinct(tags)


def search_document(**parts: Column) -> Column:
    """Labelled lines of the parts that are there."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k.replace('_', ' ').title()}: "), F.nullif(F.trim(v), F.lit(""))) for k, v in parts.items()])


def embedding_text(title: Column, category: Column, intent: Column, entities: Column, tags: Column, content: Column, most: int | None = None) -> Column:
    """The layout for embeddings; entities (type, text) and tags are lists.  Parts that are empty are left out."""
    named = F.array_join(F.transform(entities, lambda e: F.concat(e["type"], F.lit(": "), e["text"])), ", ")
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.nullif(c, F.lit(""))) for n, c in (("Title", title), ("Category", category), ("Intent", intent), ("Entities", named), ("Tags", F.array_join(tags, ", ")), ("Content", content))])
    return F.substring(text, 1, most) if most else text


def search_text(title: Column, summary: Column, labels: dict[str, Column], visual: Column, ocr: Column, lists: dict[str, Column]) -> Column:
    """The parser's layout: plain lines where there are any, and named lines for labels and lists, there or not."""
    plain = lambda c: F.nullif(c, F.lit(""))
    named = [F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit(""))) for n, c in labels.items()]
    listed = [F.concat(F.lit(f"{n}: "), F.coalesce(F.array_join(c, ", "), F.lit(""))) for n, c in lists.items()]
    return T.clean_text(F.concat_ws("\n", plain(title), plain(summary), *named, plain(visual), plain(ocr), *listed))


def indexed_document(filename: Column, category: Column, summary: Column, entities: Column, ocr: Column) -> Column:
    """The indexer's layout: five named lines, there or not."""
    parts = {"Filename": filename, "Category": category, "Summary": summary, "Entities": F.array_join(entities, ", "), "Visible text": ocr}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit(""))) for n, c in parts.items()])


def plain_document(*parts: Column) -> Column:
    """The upload's layout: lines of the texts and of the lists, joined by spaces, that are not empty."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in parts])


def non_ocr_text(*fields: Column) -> Column:
    """What a memory says beside its read text: the fields that are not blank, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in fields])


def _json_texts(json: Column, *paths: str) -> Column:
    """The values of an object at ``paths`` (name, or name.name) as text: scalars and the elements of lists, in order; what is empty is left out.

    The object is parsed once for all paths.
    """
    inner: dict[str, list[str]] = {}
    for path in dict.fromkeys(paths):
        name, _, below = path.partition(".")
        inner.setdefault(name, []).extend([below] if below else [])
    schema = ", ".join(f"`{name}` " + (f"struct<{', '.join(f'`{x}`: string' for x in below)}>" if below else "string") for name, below in inner.items())

    def texts(value: Column) -> Column:
        return F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))

    def found(parsed: Column) -> Column:
        values = F.transform(F.array(*[reduce(lambda c, name: c[name], path.split("."), parsed) for path in paths]), lambda v: F.coalesce(texts(v), F.array().cast("array<string>")))
        return F.filter(F.flatten(values), lambda x: F.trim(x) != "")

    return once(F.from_json(json, schema), found)


def visual_text(json: Column) -> Column:
    """What a memory (JSON) says about what is seen: its own and its analysis's descriptions, then both sides' concepts."""
    own = ["visual_description", *[f"vision_analysis.{n}" for n in ("visual_description", "summary", "subcategory", "products", "keywords")]]
    return F.array_join(_json_texts(json, *own, *CONCEPT_FIELDS, *[f"vision_analysis.{n}" for n in CONCEPT_FIELDS]), " ")


def collection_text(json: Column) -> Column:
    """What collections are told by, in lower case."""
    own = ["filename", "category", "summary", "visual_description", "ocr_text", "keywords", "entities"]
    seen = [f"vision_analysis.{n}" for n in ("objects", "visual_concepts", "food_concepts", "products", "organizations", "locations")]
    return F.lower(F.array_join(_json_texts(json, *own, *seen), " "))


def captured_at(given: Column, other: Column, pattern: str = "yyyy:MM:dd HH:mm:ss") -> Column:
    """A camera's time stamp; what is not one gives way to ``other``."""
    return F.coalesce(F.try_to_timestamp(given, F.lit(pattern)), other)


def flatten_json(json: Column) -> Column:
    """Keys and scalar values of any JSON as text."""
    return T.collapse(F.regexp_replace(json, r'[{}\[\]",:]+', " "))


def parse_analysis(raw: Column) -> Column:
    """The analysis in an analyser's answer: code fences go; what does not parse is searched for its first balanced object."""

    @F.pandas_udf("string")
    def salvage(answers: pd.Series) -> pd.Series:
        def first(s: str | None) -> str | None:
            depth, start, quoted, skip = 0, None, False, False
            for i, c in enumerate(s or ""):
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"' and depth:
                    quoted = True
                elif c == "{":
                    start, depth = (i, 1) if not depth else (start, depth + 1)
                elif c == "}" and depth:
                    depth -= 1
                    if not depth:
                        return s[start : i + 1]
            return None

        return answers.map(first)

    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    whole = F.when(F.try_parse_json(bare).isNotNull(), bare)
    return F.from_json(F.coalesce(whole, salvage(F.when(whole.isNull(), bare))), ANALYSIS)


def receipt_fields(df: DataFrame, text: str) -> DataFrame:
    """merchant, address, receipt_date, total, phone, email and gstin of texts that look like receipts."""
    low = F.lower(text)
    hit = classify._any(low, RECEIPT_TERMS)
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: T.collapse(x)), lambda x: x != "")
    df = df.withColumn("__l", F.when(hit, lines))
    money = F.regexp_extract_all(text, F.lit(r"(?i)(?:₹|rs\.?|inr)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"), F.lit(1))
    total = F.regexp_extract(text, r"(?i)(?:grand\s*total|net\s*(?:amount|total)|total\s*(?:amount)?|amount\s*paid)\s*[:\-]?\s*(?:₹|rs\.?|inr)?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1)
    one = lambda c: F.when(hit, F.nullif(c, F.lit("")))
    return df.withColumns({
        "merchant": F.when(hit, F.substring(F.get("__l", F.lit(0)), 1, 120)),
        "address": one(F.array_join(F.slice(F.filter("__l", lambda x: classify._any(F.lower(x), ADDRESS_TERMS)), 1, 4), ", ")),
        "receipt_date": one(F.regexp_extract(text, r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", 0)),
        "total": F.when(hit, F.coalesce(F.nullif(total, F.lit("")), F.try_element_at(money, F.lit(-1)))),
        "phone": one(F.regexp_extract(F.regexp_replace(text, r"[\s-]+", ""), r"(?<!\d)(?:\+91)?[6-9]\d{9}(?!\d)", 0)),
        "email": one(F.regexp_extract(text, r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", 0)),
        "gstin": one(F.regexp_extract(F.upper(text), r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b", 0)),
    }).drop("__l")


def ocr_quality(text: Column) -> Column:
    """Length and printable share less the share of stray signs, 0 to 1."""
    n = F.length(text)
    printable = (n - F.regexp_count(text, F.lit(r"\p{C}"))) / n
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    signs = lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: (F.length(w) == 1) & ~F.rlike(w, F.lit(r"[\p{L}\p{N}]")))) / F.size(ws)).otherwise(0.0)
    stray = once(words, signs)
    q = 0.45 * F.least(n / 100, F.lit(1.0)) + 0.55 * printable - F.least(stray, F.lit(0.5))
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))).otherwise(0.0)


def vision_confidence(success: Column, fallback: Column, category: Column, description: Column, entities: Column) -> Column:
    points = 0.5 + F.when(F.trim(category) != "", 0.2).otherwise(0.0) + F.when(F.trim(description) != "", 0.2).otherwise(0.0) + F.when(F.size(entities) > 0, 0.1).otherwise(0.0)
    return F.when(success & ~fallback, points).otherwise(0.0)


def enrich(df: DataFrame, text: str = "ocr_text", unicode: bool = False) -> DataFrame:
    """Text to category, entities, keywords, intent, document, confidence and status: one narrow pass, nothing shuffles."""
    df = df.withColumn("clean_text", T.clean_text(F.col(text), True, unicode)).withColumn("inside", classify.substrings(F.col("clean_text")))
    df = df.withColumn("words", classify.word_tokens(F.lower("clean_text")))
    kept = [c for c in ("category", "intent", "title") if c in df.columns]
    df = df.withColumnsRenamed({c: f"given_{c}" for c in kept})
    given = lambda c: f"given_{c}" if c in kept else None
    df = df.withColumns({"entities": F.concat(classify.pattern_entities(F.col("clean_text")), classify.dictionary_entities(F.col("clean_text"), F.col("inside"), F.col("words"))), "keywords": T.keywords_plain(F.col("clean_text")), "__empty": F.lit("")})
    df = classify.classify(df, "clean_text", "__empty" if not given("title") else given("title"), given("category") or "__empty", given("intent") or "__empty", "inside", "words")
    df = classify.detect_intent(df, "clean_text", "entities", given("intent"), inside="inside")
    title = generate_title(F.col(given("title")) if given("title") else F.lit(None).cast("string"), F.col("clean_text"))
    df = df.withColumn("title", title)
    df = df.withColumn("search_document", search_document(title=F.col("title"), category=F.col("category"), intent=F.col("intent"), entities=classify.entity_text(F.col("entities")), keywords=F.array_join("keywords", ", "), text=F.col("clean_text")))
    entity_mean = F.when(F.size("entities") > 0, F.aggregate("entities", F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size("entities"))
    df = df.withColumn("__quality", ocr_quality(F.col("clean_text")))  # the sum below names it several times
    signals = {"classification": (F.col("category_confidence"), 0.2), "intent": (F.col("intent_confidence"), 0.2), "entities": (entity_mean, 0.2), "vision": (F.lit(None).cast("double"), 0.25), "ocr": (F.col("__quality"), 0.15)}
    return df.withColumns({"confidence": F.round(stats.weighted_confidence(signals), 6), "status": F.when(F.col("clean_text") == "", "failed").otherwise("ready"), "content_hash": F.sha2("clean_text", 256)}).drop("__empty", "__quality", "inside", "words", *[f"given_{c}" for c in kept])


def update_memory(table: DataFrame, updates: DataFrame, key: str = "memory_id") -> DataFrame:
    """The table with the updates' columns taken over where they are not null, and the version raised; deleting is an update too."""
    names = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__hit"))
    joined = table.join(u, key, "left")
    out = [F.coalesce(f"__{c}", c).alias(c) if c in names else (F.col("version") + F.when(F.col("__hit"), 1).otherwise(0)).alias("version") if c == "version" else F.col(c) for c in table.columns]
    return joined.select(*out)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all, by longest common blocks; in Python, for the few pairs that a cheaper test leaves."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, s, t).ratio() if s is not None and t is not None else None for s, t in zip(x, y)], dtype="float64")

    return ratio(a, b)


def numbered_pairs(token: Column) -> Column:
    """Pairs of neighbouring characters, each with how often it was there before, so that equal ones stay apart."""
    letters = F.split(token, "")
    pairs = F.transform(F.sequence(F.lit(0), F.size(letters) - 2), lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1)))
    return once(pairs, lambda p: F.transform(p, lambda x, i: F.concat(x, F.size(F.filter(F.slice(p, F.lit(1), i), lambda y: y == x)).cast("string"))))


def fuzzy_tokens(queries: DataFrame, tokens: DataFrame, least: float = 0.84) -> DataFrame:
    """(q, token, ratio) for query tokens of four or more characters without an exact match.

    Of m matching characters in blocks, m less the blocks are pairs that both tokens have, and each block but the first costs a character that does not match:
    so 3 m - a - b - 1 pairs at least, for lengths a and b.  A query token shows all but so many of its pairs, the rarest, and one of these must be in
    the other token, which is met by an equi-join on the pair and the length.

    Tokens are made once; only those with a pair of the queries are kept by pairs, and only those near enough by edits shuffle as pairs of tokens.
    """
    tokens = staged(tokens.select("token").distinct())
    asked = queries.select(F.col("token").alias("q")).distinct().where(F.length("q") >= 4)
    exact = tokens.withColumnRenamed("token", "q").join(bounded(asked), "q")
    q = staged(asked.join(exact, "q", "left_anti"))
    low = least / (2 - least)
    a, b = F.length("q"), F.col("n")
    sized = q.select("q", F.explode(F.sequence(F.ceil(a * low).cast("int"), F.floor(a / low).cast("int"))).alias("n"))
    sized = sized.withColumn("shown", a - 1 - F.greatest(F.lit(1), 3 * F.ceil(least / 2 * (a + b) - 1e-9).cast("int") - a - b - 1) + 1)
    longest = sized.agg(F.max("n")).first()[0] or 0
    t = tokens.where(F.length("token").between(2, longest)).withColumn("n", F.length("token"))
    pairs = staged(q.select("q", F.explode(numbered_pairs(F.col("q"))).alias("pair")))
    index = t.select("token", "n", F.explode(numbered_pairs(F.col("token"))).alias("pair"))
    index = staged(index.join(bounded(pairs.select("pair").distinct()), "pair"))
    frequency = index.groupBy("pair").agg(F.count(F.lit(1)).alias("df"))
    ranked = pairs.join(frequency, "pair", "left").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.coalesce("df", F.lit(0)), "pair")))
    probes = staged(ranked.join(sized, "q").where("r <= shown").select("q", "pair", "n"))
    edits = F.ceil((F.length("q") + F.length("token")) * (1 - least))
    near = index.join(bounded(probes, 1_000_000), ["pair", "n"]).where(F.levenshtein("q", "token") <= edits).select("q", "token").distinct()
    return near.select("q", "token", fuzzy_ratio(F.col("q"), F.col("token")).alias("ratio")).where(F.col("ratio") >= least)


def analyze_with(df: DataFrame, key: str, text: str, analyse) -> DataFrame:
    """(key, analysis) of a user's function from texts to JSON strings, one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "raw": analyse(batch[text].tolist())})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, raw string").withColumn("analysis", parse_analysis(F.col("raw")))

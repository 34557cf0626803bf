"""Category, intent and entities of texts.

Every keyword is a literal in one pass over the text: no shuffle, no join, and as many rows in one task as Spark likes.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import constant_list, constant_map, keywords_in, once
from . import rules


def _any(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _is_phrase(word: str) -> bool:
    """Phrases and words with signs are looked for anywhere, plain words among the tokens."""
    return not word.isalnum()


def _split(words: Iterable[str]) -> tuple[list[str], list[str]]:
    """(plain words, phrases), each once."""
    known = sorted(set(words))
    return [w for w in known if not _is_phrase(w)], [w for w in known if _is_phrase(w)]


#: Words whose places in a text do not matter, for any of the rules: a text is read once for all of them.
SUBSTRINGS = sorted({w for ws in rules.INTENT_KEYWORDS.values() for w in ws} | {w for ws in [*rules.CATEGORY_KEYWORDS.values(), *rules.DICTIONARIES.values()] for w in ws if _is_phrase(w)})


def substrings(text: Column) -> Column:
    """Those of SUBSTRINGS that stand in ``text``: give it to the functions below as ``inside``, if more than one of them needs it."""
    return keywords_in(F.lower(text), SUBSTRINGS)


def keyword_points(hits: Column, words: dict[str, float]) -> Column:
    """Sum of the weights of the keywords among ``hits``, each once."""
    weights = constant_map(words)
    return F.aggregate(hits, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))


def word_tokens(c: Column) -> Column:
    return F.array_distinct(F.split(c, r"(?U)[^\w]+"))


def _winner(scores: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Entries by score, ties in order, and their sum."""
    entries = F.array(*[F.struct((-s).alias("neg"), F.lit(o).alias("o"), F.lit(n).alias("name")) for o, (n, s) in enumerate(scores)])
    return F.array_sort(entries), reduce(lambda a, b: a + b, [s for _, s in scores])


def classify(df: DataFrame, ocr: str, described: str, llm: str, intent: str, inside: str | None = None, words: str | None = None) -> DataFrame:
    """Add category, category_confidence, margin and alternatives by keyword points of the whole and again of each part.

    A keyword of the read text counts in the whole and in its part, so twice; a known label counts 4, the intent's keywords 2.5 times.
    words: ``word_tokens`` of the read text in lower case, if they are there already.
    """
    parts = {"__whole": F.concat_ws(" ", ocr, described), "__ocr": F.col(ocr), "__ai": F.col(described), "__intent": F.col(intent)}
    plain, phrases = _split(w for words in rules.CATEGORY_KEYWORDS.values() for w in words)
    lows = {name: F.lower(F.coalesce(c, F.lit(""))) for name, c in parts.items()}
    standing = {name: F.col(inside) if inside and name == "__ocr" else keywords_in(low, phrases) for name, low in lows.items()}
    df = df.withColumns({f"{name}_p": F.array_intersect(c, constant_list(phrases)) for name, c in standing.items()})
    tokens = {name: word_tokens(low) for name, low in lows.items() if name not in ("__whole", "__ocr")}
    tokens["__ocr"] = F.col(words) if words else word_tokens(lows["__ocr"])
    df = df.withColumns({f"{name}_t": F.array_intersect(c, constant_list(plain)) for name, c in tokens.items()})
    df = df.withColumn("__whole_t", F.array_union("__ocr_t", "__ai_t"))  # a space parts the two, so no word is of both
    df = df.withColumns({name: F.concat(f"{name}_t", f"{name}_p") for name in parts})
    points = {}
    for category, words in rules.CATEGORY_KEYWORDS.items():
        p = reduce(lambda a, b: a + b, [keyword_points(F.col(name), words) for name in ("__whole", "__ocr", "__ai")])
        p = p + rules.INTENT_WEIGHT * keyword_points(F.col("__intent"), words) + F.when(F.lower(F.trim(llm)) == category, rules.LLM_WEIGHT).otherwise(0.0)
        points[category] = p
    df = df.withColumns({f"__p_{category}": p for category, p in points.items()})
    entries, total = _winner([(category, F.col(f"__p_{category}")) for category in points])
    df = df.withColumns({"__e": entries, "__total": total})
    top, second = -F.get("__e", F.lit(0))["neg"], -F.get("__e", F.lit(1))["neg"]
    known = F.col("__total") > 0
    df = df.withColumns({
        "category": F.when(known, F.get("__e", F.lit(0))["name"]).otherwise("other"),
        "category_confidence": F.when(known, F.round(0.7 * top / F.col("__total") + 0.3 * F.least(F.lit(1.0), (top - second) / F.greatest(top, F.lit(1.0))), 6)).otherwise(0.20),
        "margin": F.when(known, top - second).otherwise(0.0),
        "alternatives": F.transform(F.filter(F.slice("__e", 2, 3), lambda e: e["neg"] < 0), lambda e: e["name"]),
    })
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def classify_simple(text: Column) -> Column:
    """The category with the most keywords in the text, the first of equals."""

    def named(hits: Column) -> Column:
        entries, total = _winner([(n, F.size(F.array_intersect(hits, constant_list(words)))) for n, words in rules.SIMPLE_KEYWORDS.items()])
        return F.when(total > 0, F.get(entries, F.lit(0))["name"]).otherwise("other")

    return once(keywords_in(F.lower(text), [w for words in rules.SIMPLE_KEYWORDS.values() for w in words]), named)


def classify_fallback(label: Column, text: Column) -> Column:
    """The label if it is known and says something, else the first rule with a word in the text."""
    low, clean = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(clean.isin(*[x for x in rules.FALLBACK_LABELS if x != "other"]), clean)
    for name, words in rules.FALLBACK_KEYWORDS.items():
        out = out.when(_any(low, words), name)
    return out.otherwise("other")


def _weighed(entities: Column, weights: Column) -> Column:
    """Sum of the entities' confidences by the weights of their types."""
    return F.aggregate(entities, F.lit(0.0), lambda a, e: a + e["confidence"] * F.coalesce(F.element_at(weights, e["type"]), F.lit(0.0)))


def detect_intent(df: DataFrame, text: str, entity_types: str, llm: str | None = None, keywords: dict[str, list[str]] = rules.INTENT_KEYWORDS, inside: str | None = None) -> DataFrame:
    """Add intent, intent_confidence and intents (the first five): words .7, phrases 1, entities by weight and confidence, a given label 2.5.

    entity_types: array<struct<type, confidence>>.  inside: ``substrings`` of the text, if it is there already.
    """
    found = keywords_in(F.lower(text), [w for words in keywords.values() for w in words]) if inside is None else F.col(inside)
    df = df.withColumn("__found", found)
    scores = {}
    for intent in rules.INTENTS[:-1]:
        s = keyword_points(F.col("__found"), {w: 1.0 if " " in w else 0.7 for w in keywords[intent]})
        weights = {t: w[intent] for t, w in rules.ENTITY_SIGNALS.items() if intent in w}
        if weights:
            s = s + _weighed(F.col(entity_types), constant_map(weights))
        if llm:
            s = s + F.when(F.upper(F.trim(llm)) == intent, 2.5).otherwise(0.0)
        scores[intent] = F.round(s, 6)
    df = df.withColumns({f"__s_{intent}": s for intent, s in scores.items()})
    entries, total = _winner([(intent, F.col(f"__s_{intent}")) for intent in scores])
    df = df.withColumns({"__e": entries, "__total": total})
    top, name = -F.get("__e", F.lit(0))["neg"], F.get("__e", F.lit(0))["name"]
    agrees = (F.upper(F.trim(llm)) == name) if llm else F.lit(False)
    confident = F.least(F.lit(1.0), F.lit(1.0) + F.when(agrees, 0.05).otherwise(0.0))
    confident = F.when((top < 0.8) & ~F.coalesce(agrees, F.lit(False)), F.least(confident, F.lit(0.72))).otherwise(confident)
    out = df.withColumns({
        "intent": F.when(F.col("__total") > 0, name).otherwise("OTHER"), "intent_confidence": F.when(F.col("__total") > 0, confident).otherwise(0.35),
        "intents": F.transform(F.slice(F.filter("__e", lambda e: e["neg"] < 0), 1, 5), lambda e: e["name"]),
    })
    return out.drop(*[c for c in out.columns if c.startswith("__")])


# Typed patterns of entities with their confidence.
ENTITY_PATTERNS = {
    "EMAIL": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.99), "URL": (r"(?i)\b(?:https?://|www\.)[^\s<>()]+", 0.98), "PHONE": (r"(?<!\d)(?:\+91[\s.-]?)?(?:\d[\s.-]?){10}(?!\d)", 0.90),
    "MONEY": (r"(?i)(?<!\w)(?:₹|rs\.?|inr|\$|usd|€|eur|£|gbp)\s*\d[\d,]*(?:\.\d{1,2})?(?!\w)", 0.95),
    "DATE": (r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*(?:\s+\d{2,4})?|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2}(?:,\s*|\s+)\d{2,4})\b", 0.90),
    "TIME": (r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b", 0.88), "ORDER_ID": (r"(?i)\b(?:order|ord|order-id)[\s:#-]*[A-Z0-9][A-Z0-9_-]{4,}\b", 0.92), "INVOICE_ID": (r"(?i)\b(?:invoice|inv)[\s:#-]*[A-Z0-9][A-Z0-9_-]{2,}\b", 0.92), "USERNAME": (r"(?<![\w@])@[A-Za-z0-9_.]{2,30}\b", 0.88),
}


def normalize_entity(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"^[ .,;:!?()\[\]{}<>\"']+|[ .,;:!?()\[\]{}<>\"']+$", ""))


def _named(texts: Column, kind: str, conf: float, shown=lambda x: x, normal=lambda x: x) -> Column:
    return F.transform(texts, lambda x: F.struct(F.lit(kind).alias("type"), shown(x).alias("text"), normal(x).alias("normalized"), F.lit(conf).alias("confidence")))


def pattern_entities(text: Column) -> Column:
    """array<struct<type, text, normalized, confidence>> of all patterns, each text once a type.

    A pattern that needs a sign or a digit is not tried on texts without it, which one look for digits tells for four of them.
    """
    has = lambda sign: F.contains(text, F.lit(sign))
    none = F.array().cast("array<struct<type:string,text:string,normalized:string,confidence:double>>")

    def typed(kinds: list[str], needed: Column | None = None) -> Column:
        each = []
        for kind in kinds:
            pattern, conf = ENTITY_PATTERNS[kind]
            found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
            each.append(_named(found, kind, conf, F.trim, normalize_entity))
        return F.concat(*each) if needed is None else F.when(needed, F.concat(*each)).otherwise(none)

    low = F.lower(text)
    return F.concat(
        typed(["EMAIL"], has("@")), typed(["URL"], has("://") | F.contains(low, F.lit("www."))), typed(["PHONE", "MONEY", "DATE"], F.rlike(text, F.lit("[0-9]"))), typed(["TIME"], F.rlike(text, F.lit("[0-9]:[0-9]"))),
        typed(["ORDER_ID"], F.contains(low, F.lit("ord"))), typed(["INVOICE_ID"], F.contains(low, F.lit("inv"))), typed(["USERNAME"], has("@")),
    )


def dictionary_entities(text: Column, inside: Column | None = None, words: Column | None = None) -> Column:
    """Entities of the dictionaries: words between word boundaries, phrases anywhere (``inside``: the text's substrings, ``words``: its word_tokens in lower case)."""
    low = F.lower(text)
    plain, phrases = _split(w for words in rules.DICTIONARIES.values() for w in words)

    def typed(hits: Column) -> Column:
        each = []
        for (kind, conf), words in rules.DICTIONARIES.items():
            own = [w for w in words if not _is_phrase(w)] + [w for w in words if _is_phrase(w)]
            each.append(_named(F.array_intersect(hits, constant_list(own)), kind, conf))
        return F.concat(*each)

    standing = F.array_intersect(inside, constant_list(phrases)) if inside is not None else F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in phrases])) if phrases else constant_list([])
    return once(F.concat(F.array_intersect(word_tokens(low) if words is None else words, constant_list(plain)), standing), typed)


def parsed_entities(json: Column) -> Column:
    """Entities of an analyser's JSON list: objects under several names, confidence .80 by default."""
    maps = F.from_json(json, "array<map<string,string>>")
    first = lambda m, *names: F.coalesce(*[F.nullif(F.trim(F.element_at(m, n)), F.lit("")) for n in names])
    typed = F.transform(maps, lambda m: F.struct(F.upper(F.coalesce(first(m, "type", "label", "category"), F.lit("UNKNOWN"))).alias("type"), first(m, "text", "name", "value").alias("text"), normalize_entity(first(m, "text", "name", "value")).alias("normalized"), F.coalesce(first(m, "confidence", "score").try_cast("double"), F.lit(0.80)).alias("confidence")))
    none = F.array().cast("array<struct<type:string,text:string,normalized:string,confidence:double>>")
    return F.coalesce(F.filter(typed, lambda e: e["text"].isNotNull()), none)


def extract_entities(df: DataFrame, key: str, text: str, json: str | None = None) -> DataFrame:
    """(key, type, text, normalized, confidence): the best of each row's types and normalised forms, the first of equal ones.

    A row's entities are sorted within the row, so nothing shuffles; keys that repeat are rows of their own.
    """
    lists = [pattern_entities(F.col(text)), dictionary_entities(F.col(text))] + ([parsed_entities(F.col(json))] if json else [])
    ordered = F.array_sort(F.transform(F.concat(*lists), lambda e, i: F.struct(e["type"].alias("type"), e["normalized"].alias("normalized"), (-e["confidence"]).alias("less"), i.alias("pos"), e["text"].alias("text"))))
    rows = df.select(key, ordered.alias("l"))

    def first(e: Column, i: Column) -> Column:
        before = F.get("l", i - 1)
        return (i == 0) | (e["type"] != before["type"]) | (e["normalized"] != before["normalized"])

    kept = rows.select(key, F.explode(F.filter("l", first)).alias("e")).where("e.normalized <> ''")
    return kept.select(key, "e.type", "e.normalized", "e.text", (-F.col("e.less")).alias("confidence"))


def entity_text(entities: Column) -> Column:
    return F.array_join(F.transform(entities, lambda e: F.concat(e["type"], F.lit(": "), e["text"])), " | ")


def build_entities(lists: dict[str, Column]) -> Column:
    """(type, text) of typed lists, in their order, each pair once; null and blank texts are left out."""

    def typed(kind: str, texts: Column) -> Column:
        named = F.transform(F.filter(texts, lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x).alias("text")))
        return F.coalesce(named, F.array().cast("array<struct<type:string,text:string>>"))

    return F.array_distinct(F.concat(*[typed(kind, texts) for kind, texts in lists.items()]))


def normalize_label(c: Column, aliases: dict[str, str], known: list[str], other: str = "other") -> Column:
    """A label or its alias, if it is known."""
    low = F.lower(F.trim(c))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in aliases.items() for x in p]), low), low) if aliases else low
    return F.when(named.isin(*known), named).otherwise(F.lit(other))

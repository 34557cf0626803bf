"""Canonical categories and intents of the services that name them, each with its own aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse
from .rules import INTENTS

# The known labels of each service, and what other labels stand for.
CLASSIFIER_CATEGORIES = ["shopping", "finance", "education", "work", "travel", "food", "entertainment", "social", "communication", "technology", "health", "documents", "productivity", "personal", "other"]
CLASSIFIER_ALIASES = {
    "shopping": ["purchase", "purchases", "ecommerce", "e-commerce", "product", "products", "store", "stores", "retail"],
    "finance": ["bank", "banking", "money", "payment", "payments", "invoice", "billing", "bill", "transaction"],
    "education": ["college", "school", "study", "studies", "learning", "course", "exam", "assignment", "class"],
    "work": ["job", "office", "professional", "career", "meeting", "project", "employee"],
    "travel": ["vacation", "trip", "tour", "hotel", "flight", "airport", "train", "bus", "booking"],
    "food": ["restaurant", "recipe", "recipes", "menu", "cafe", "food-order", "food-ordering"],
    "entertainment": ["movie", "movies", "music", "game", "gaming", "series", "netflix"],
    "communication": ["message", "messages", "chat", "email", "mail"],
    "technology": ["software", "computer", "programming", "coding", "python", "android", "flutter", "github"],
    "health": ["medical", "medicine", "doctor", "hospital", "healthcare"],
    "documents": ["pdf", "document", "documents", "report", "certificate"],
    "productivity": ["todo", "task", "tasks", "calendar", "reminder"],
}
PARSER_CATEGORIES = ["shopping", "finance", "education", "travel", "food", "work", "personal", "social", "communication", "technology", "entertainment", "health", "documents", "other"]
PARSER_ALIASES = {
    "shopping": ["shopping_products", "product", "products"], "finance": ["money", "banking"], "education": ["school", "college", "university"], "work": ["job", "career"],
    "food": ["restaurant", "food_order"], "travel": ["places", "trip"], "health": ["medical"], "documents": ["document"], "technology": ["tech"],
}
MEMORY_CATEGORIES = ["shopping", "travel", "food", "finance", "learning", "work", "communication", "social", "entertainment", "health", "document", "technology", "event", "location", "reminder", "reference", "payment", "booking", "tracking", "other"]
MEMORY_ALIASES = {
    "shopping": ["shop", "purchase", "product", "buy", "buying"], "travel": ["trip", "tourism"], "food": ["restaurant", "meal"], "payment": ["payments"], "finance": ["financial", "banking"],
    "learning": ["study", "education"], "technology": ["tech", "technical"], "document": ["documents", "pdf"], "communication": ["message", "email"], "entertainment": ["media"],
    "work": ["business"], "health": ["fitness"], "event": ["events"], "location": ["place"], "booking": ["reservation"], "tracking": ["delivery"],
}
VISION_ALIASES = {
    "food": ["food image", "food photo", "foods", "meal", "restaurant"], "shopping": ["product", "products", "shopping item", "shopping product", "purchase"],
    "technology": ["tech", "electronics", "electronic", "device"], "learning": ["education", "school", "academic", "study"], "document": ["documents", "paper", "pdf"],
    "payment": ["payments", "upi"], "finance": ["banking", "financial"], "communication": ["chat", "messaging", "message"], "social": ["social media"],
    "booking": ["reservation", "hotel booking"], "tracking": ["delivery", "delivery tracking"], "location": ["place", "map"], "event": ["events"],
}
INTENT_ALIASES = {
    "BUY": ["PURCHASE", "BUYING"], "SHOPPING": ["SHOP", "PRODUCT_SEARCH", "PRODUCT"], "TRAVEL": ["TRIP", "FLIGHTS"], "BOOKING": ["RESERVE", "RESERVATION"], "FOOD": ["FOOD_ORDER"],
    "PAYMENT": ["TRANSACTION"], "TRACKING": ["DELIVERY"], "LEARNING": ["STUDY", "EDUCATION"], "TECHNOLOGY": ["TECH", "TECHNICAL"], "COMMUNICATION": ["CONTACT", "MESSAGE"],
    "DOCUMENT": ["DOC"], "INFORMATION": ["INFO"], "REMINDER": ["REMIND"], "PLANNING": ["PLAN"],
}
PARSER_INTENTS = ["buy", "sell", "save", "remember", "learn", "compare", "contact", "travel", "track", "schedule", "read", "reference", "unknown"]
PARSER_INTENT_ALIASES = {
    "buy": ["purchase", "shopping"], "save": ["save_for_later", "bookmark"], "learn": ["study", "learning"], "read": ["read_later"], "remember": ["reminder"],
    "reference": ["reference_material"], "unknown": ["unknown_intent"],
}

#: Of each service: aliases, known labels (none: any), what joins words and what it replaces, and the label of the rest.
CATEGORIES = {
    "classifier": (CLASSIFIER_ALIASES, CLASSIFIER_CATEGORIES, "-", "_", None),
    "parser": (PARSER_ALIASES, PARSER_CATEGORIES, "_", "-", "other"),
    "memory": (MEMORY_ALIASES, MEMORY_CATEGORIES, "_", "-", "other"),
    "vision": (VISION_ALIASES, MEMORY_CATEGORIES, " ", "_-", "other"),
}
INTENTS_OF = {
    "service": (INTENT_ALIASES, INTENTS, "", "", "OTHER"),
    "parser": (PARSER_INTENT_ALIASES, PARSER_INTENTS, "_", "-", "unknown"),
    "memory": (INTENT_ALIASES, None, "", "", "OTHER"),
}


def _canonical(c: Column, aliases: dict[str, list[str]], known: list[str] | None, joint: str, replaced: str, other: str | None) -> Column:
    for mark in replaced:
        c = F.replace(c, F.lit(mark), F.lit(joint))
    named = F.element_at(F.create_map(*[F.lit(x) for label, words in aliases.items() for w in words for x in (w, label)]), c)
    return F.coalesce(named, F.when(c.isin(*known) if known else c != "", c), F.lit(other))


def normalize_category(c: Column, service: str = "classifier") -> Column:
    """The service's category for any label; a null or unknown one is null for the classifier, else other."""
    return _canonical(F.lower(collapse(c)), *CATEGORIES[service])


def normalize_intent(c: Column, service: str = "service") -> Column:
    """The service's intent for any label; the memory service keeps labels that it does not know."""
    return _canonical((F.lower if service == "parser" else F.upper)(collapse(c)), *INTENTS_OF[service])

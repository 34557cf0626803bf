"""Keyword tables of classification and intent, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keywords of each category with their weights, categories in order of preference.
CATEGORY_KEYWORDS = {
    "shopping": {"buy": 2.0, "bought": 2.0, "purchase": 2.5, "price": 2.0, "discount": 2.5, "offer": 2.0, "sale": 2.0, "cart": 2.5, "checkout": 3.0, "product": 1.5, "amazon": 2.5, "flipkart": 2.5, "myntra": 2.5, "meesho": 2.5, "adidas": 1.5, "nike": 1.5, "shoes": 1.5, "shirt": 1.5, "dress": 1.5, "order": 1.0},
    "finance": {"bank": 2.5, "account": 1.5, "balance": 3.0, "transaction": 3.0, "payment": 2.5, "paid": 2.0, "amount": 2.0, "invoice": 3.0, "bill": 2.0, "upi": 3.0, "gpay": 2.5, "phonepe": 2.5, "paytm": 2.5, "credit": 2.0, "debit": 2.0, "salary": 2.5, "₹": 1.5, "usd": 1.5, "refund": 2.5},
    "education": {"student": 2.0, "college": 3.0, "school": 3.0, "university": 3.0, "assignment": 3.0, "exam": 3.0, "semester": 2.5, "subject": 2.0, "question": 1.0, "questionnaire": 1.0, "marks": 2.0, "grade": 2.0, "cgpa": 3.0, "course": 2.0, "lecture": 2.0, "notes": 2.0, "homework": 3.0, "professor": 2.5, "teacher": 2.5, "class": 2.0},
    "work": {"office": 2.5, "work": 2.0, "meeting": 3.0, "deadline": 3.0, "employee": 2.5, "manager": 2.5, "client": 2.5, "company": 1.5, "project": 2.0, "presentation": 2.0, "interview": 2.5, "resume": 2.5, "salary": 1.5, "task": 1.5},
    "travel": {"flight": 3.5, "airport": 3.0, "hotel": 3.0, "booking": 2.5, "ticket": 2.5, "train": 2.5, "bus": 2.5, "travel": 3.0, "trip": 3.0, "tour": 2.5, "vacation": 3.0, "passport": 3.0, "boarding": 3.0, "departure": 2.5, "arrival": 2.5},
    "food": {"restaurant": 3.0, "menu": 3.0, "food": 3.0, "recipe": 3.0, "cooking": 2.5, "cafe": 2.5, "coffee": 2.0, "pizza": 2.0, "burger": 2.0, "dosa": 2.0, "biryani": 2.0, "lunch": 2.0, "dinner": 2.0, "breakfast": 2.0, "zomato": 3.0, "swiggy": 3.0},
    "entertainment": {"movie": 3.0, "cinema": 3.0, "music": 2.5, "song": 2.0, "game": 2.5, "gaming": 3.0, "netflix": 3.0, "youtube": 1.5, "series": 2.5, "episode": 2.5, "concert": 3.0},
    "social": {"instagram": 3.0, "facebook": 3.0, "social": 2.5, "post": 1.5, "story": 2.0, "followers": 2.5, "follow": 2.0, "like": 1.5, "comment": 1.5, "profile": 1.5},
    "communication": {"message": 3.0, "messages": 3.0, "chat": 3.0, "whatsapp": 3.5, "telegram": 3.0, "email": 3.0, "gmail": 3.0, "sms": 3.0, "call": 2.0, "conversation": 2.5},
    "technology": {"python": 3.0, "javascript": 3.0, "typescript": 3.0, "flutter": 3.0, "android": 3.0, "kotlin": 3.0, "github": 2.5, "git": 2.0, "code": 2.0, "coding": 3.0, "programming": 3.0, "software": 2.5, "api": 2.5, "database": 2.5, "ai": 2.5, "machine learning": 3.0, "artificial intelligence": 3.0, "terminal": 2.0},
    "health": {"doctor": 3.0, "hospital": 3.0, "medicine": 3.0, "medical": 3.0, "health": 3.0, "tablet": 2.0, "prescription": 3.0, "symptom": 3.0, "appointment": 1.5, "clinic": 3.0, "blood": 2.5, "diagnosis": 3.0},
    "documents": {"document": 3.0, "pdf": 3.0, "certificate": 3.0, "report": 2.5, "form": 2.0, "application form": 2.5, "receipt": 2.5, "letter": 2.0, "official": 1.5},
    "productivity": {"todo": 3.0, "task": 2.5, "reminder": 3.0, "calendar": 3.0, "schedule": 3.0, "deadline": 2.0, "notes": 1.5, "checklist": 3.0, "plan": 2.0},
    "personal": {"birthday": 3.0, "anniversary": 3.0, "family": 2.5, "friend": 2.0, "personal": 2.5, "memories": 2.5, "love": 2.0, "relationship": 2.5},
}
# Weight of each kind of evidence.
LLM_WEIGHT, INTENT_WEIGHT, ENTITY_WEIGHT = 4.0, 2.5, 1.5

# Intents, and what each entity type says of them.
INTENTS = ["SHOPPING", "BUY", "COMPARE", "TRAVEL", "BOOKING", "FOOD", "PAYMENT", "TRACKING", "LEARNING", "REFERENCE", "DOCUMENT", "COMMUNICATION", "SOCIAL", "ENTERTAINMENT", "WORK", "FINANCE", "HEALTH", "EVENT", "LOCATION", "TECHNOLOGY", "REMINDER", "INFORMATION", "PLANNING", "OTHER"]
ENTITY_SIGNALS = {
    "MONEY": {"SHOPPING": 0.8, "BUY": 0.7, "PAYMENT": 0.9, "FINANCE": 0.6}, "BRAND": {"SHOPPING": 0.7, "BUY": 0.4}, "PRODUCT": {"SHOPPING": 0.9, "BUY": 0.7, "COMPARE": 0.5}, "ORDER_ID": {"BUY": 0.7, "TRACKING": 1.0, "PAYMENT": 0.5},
    "INVOICE_ID": {"PAYMENT": 0.9, "DOCUMENT": 0.8, "FINANCE": 0.6}, "LOCATION": {"TRAVEL": 0.6, "LOCATION": 0.8}, "ADDRESS": {"LOCATION": 1.0, "TRAVEL": 0.5}, "DATE": {"EVENT": 0.5, "BOOKING": 0.5, "TRAVEL": 0.4, "REMINDER": 0.4, "PLANNING": 0.3},
    "DATETIME": {"BOOKING": 0.7, "EVENT": 0.7, "REMINDER": 0.6, "PLANNING": 0.5}, "TIME": {"BOOKING": 0.5, "EVENT": 0.4, "REMINDER": 0.4}, "EMAIL": {"COMMUNICATION": 0.8}, "PHONE": {"COMMUNICATION": 0.8}, "URL": {"REFERENCE": 0.4, "INFORMATION": 0.3},
    "TECHNOLOGY": {"TECHNOLOGY": 1.0, "LEARNING": 0.5}, "DOCUMENT": {"DOCUMENT": 1.0, "REFERENCE": 0.6},
}
# Keywords of intents: the default of a parameter; a caller may pass any table (intent, keyword).
INTENT_KEYWORDS = {
    "SHOPPING": ["shop", "product", "item", "store", "cart", "wishlist", "price", "deal", "discount", "sale"], "BUY": ["buy", "purchase", "order", "checkout", "add to cart", "place order"], "COMPARE": ["compare", "comparison", "versus", "difference", "cheaper", "alternative", "which one"],
    "TRAVEL": ["travel", "trip", "journey", "flight", "train", "airport", "hotel", "destination", "vacation"], "BOOKING": ["book", "reserve", "reservation", "ticket", "appointment", "confirm booking"], "FOOD": ["food", "restaurant", "menu", "meal", "lunch", "dinner", "recipe", "pizza"],
    "PAYMENT": ["payment", "paid", "pay", "transaction", "upi", "card", "receipt", "amount paid"], "TRACKING": ["track", "delivery", "shipped", "dispatch", "order status"], "LEARNING": ["learn", "tutorial", "course", "lesson", "study", "exam", "guide", "how to"], "REFERENCE": ["reference", "documentation", "manual", "specification"],
    "DOCUMENT": ["document", "pdf", "invoice", "certificate", "report", "form", "letter"], "COMMUNICATION": ["message", "email", "mail", "chat", "reply", "contact", "call"], "SOCIAL": ["instagram", "facebook", "twitter", "social", "post", "profile"], "ENTERTAINMENT": ["movie", "film", "series", "song", "music", "game"],
    "WORK": ["work", "office", "meeting", "project", "task", "deadline"], "FINANCE": ["bank", "salary", "investment", "stock", "loan", "tax", "budget"], "HEALTH": ["health", "medicine", "doctor", "hospital", "clinic"], "EVENT": ["event", "birthday", "wedding", "conference", "concert"],
    "LOCATION": ["location", "address", "map", "place", "nearby", "route"], "TECHNOLOGY": ["python", "programming", "software", "api", "database", "machine learning", "ai"], "REMINDER": ["remember", "reminder", "remind", "due", "tomorrow"], "INFORMATION": ["information", "info", "details", "fact", "news", "update"], "PLANNING": ["plan", "schedule", "roadmap", "strategy", "checklist"],
}

# Keywords of the simple classifier, categories in order of preference.
SIMPLE_KEYWORDS = {
    "recipe": ["recipe", "ingredients", "ingredient", "calories", "cooking", "cook", "bake", "baking", "masala", "chicken", "biryani", "curry", "food", "sauce"], "receipt": ["receipt", "subtotal", "total", "tax", "invoice", "bill", "amount", "payment", "cash", "gst"],
    "shopping": ["buy", "cart", "wishlist", "price", "₹", "$", "add to cart", "checkout", "shop", "amazon", "flipkart", "product"], "address": ["address", "street", "road", "avenue", "pin code", "pincode", "zip code", "location", "latitude", "longitude"],
    "coding": ["python", "javascript", "typescript", "java", "error", "exception", "traceback", "stack trace", "terminal", "console", "code", "github", "fastapi", "react", "sql", "debug"], "education": ["college", "university", "student", "timetable", "schedule", "exam", "semester", "subject", "assignment", "marks", "course", "class"],
    "finance": ["bank", "account", "transaction", "balance", "debit", "credit", "upi", "salary", "investment", "statement"], "travel": ["flight", "boarding", "hotel", "booking", "train", "ticket", "airport", "trip", "travel", "reservation"],
    "social": ["instagram", "facebook", "whatsapp", "telegram", "twitter", "linkedin", "comment", "message", "followers"], "entertainment": ["movie", "film", "song", "music", "netflix", "youtube", "series", "episode", "game"],
    "document": ["certificate", "document", "application", "form", "identity", "aadhaar", "passport", "license", "signature", "official"],
}
# Labels and rules of the fallback classifier, in order.
FALLBACK_LABELS = ["receipt", "recipe", "food", "address", "product", "shopping", "document", "ticket", "travel", "finance", "message", "social", "code", "education", "note", "screenshot", "other"]
FALLBACK_KEYWORDS = {
    "receipt": ["total", "subtotal", "invoice", "tax", "receipt"], "recipe": ["ingredients", "recipe", "instructions", "preheat"], "address": ["street", "road", "avenue", "pincode", "pin code", "address"], "product": ["buy now", "add to cart", "price", "₹", "$", "product"],
    "education": ["assignment", "exam", "question", "lecture", "college"], "code": ["python", "javascript", "typescript", "java", "function", "class ", "import "],
}

# Dictionaries of entities with their confidence.
DICTIONARIES = {
    ("BRAND", 0.88): ["adidas", "nike", "puma", "apple", "samsung", "oneplus", "xiaomi", "realme", "boat", "sony", "hp", "dell", "lenovo", "asus", "acer", "amazon", "flipkart", "myntra", "meesho", "zomato", "swiggy", "netflix", "spotify", "youtube", "instagram", "facebook", "whatsapp", "telegram", "google", "microsoft", "github", "openai"],
    ("COMPANY", 0.90): ["google", "microsoft", "amazon", "apple", "meta", "openai", "infosys", "tcs", "wipro", "accenture", "zoho", "freshworks", "github"],
    ("LOCATION", 0.89): ["india", "chennai", "salem", "coimbatore", "madurai", "bangalore", "bengaluru", "hyderabad", "mumbai", "delhi", "new delhi", "kolkata", "pune", "kerala", "tamil nadu", "karnataka", "andhra pradesh", "telangana", "new york", "london", "paris", "tokyo", "dubai", "singapore"],
    ("TECHNOLOGY", 0.91): ["python", "java", "javascript", "typescript", "kotlin", "swift", "dart", "flutter", "android", "ios", "react", "react native", "node.js", "nodejs", "fastapi", "django", "flask", "tensorflow", "pytorch", "numpy", "pandas", "scikit-learn", "sklearn", "faiss", "sql", "sqlite", "postgresql", "mysql", "mongodb", "firebase", "docker", "kubernetes", "git", "github", "linux", "aws", "azure", "gcp", "gemini", "openai"],
}


def frame(spark: SparkSession, rules: dict, name: str) -> DataFrame:
    """(o, name, keyword, weight) from a table of this module."""
    rows = [(o, label, k, float(words[k]) if isinstance(words, dict) else 1.0) for o, (label, words) in enumerate(rules.items()) for k in words]
    return spark.createDataFrame(rows, f"o int, {name} string, keyword string, weight double")

"""Word lists, patterns and thresholds that results depend on.

Everything in this module is a fixed value: it states what the compatible
results need and holds no logic.
"""

# --- Personal data: kind -> pattern, in the order in which redaction applies them.
PII = {
    "email": r"[\w\.-]+@[\w\.-]+\.\w+",
    "phone": r"\b(\+\d{1,3}[\s-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "date_of_birth": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
}

# --- Attempts to override instructions; the look-ahead forms of two of them are in LOOKAHEAD.
JAILBREAK = (
    r"ignore (all |previous |prior )?instructions", r"disregard (your |all |previous )?instructions", r"pretend (you are|to be)", r"forget (your |all )?rules", r"bypass (your |all )?restrictions",
    r"jailbreak", r"dan mode", r"developer mode", r"do anything now", r"no restrictions", r"override (safety|guidelines|rules)", r"system prompt", r"<\|.*?\|>", r"\[inst\]", r"###\s*(instruction|system)",
)
LOOKAHEAD = (r"you are now (a |an )?(?!assistant)", r"act as (if you are|a|an) (?!assistant)")
INJECTION = (r"ignore the above", r"ignore previous", r"new instruction", r"---\s*instruction", r"human:\s*ignore", r"assistant:\s*sure")
JAILBREAK_CONFIDENCE = 0.3

# --- Moderation.
UNSAFE_WORDS = ("kill", "murder", "suicide", "bomb", "weapon", "explosive", "hack", "exploit", "malware", "ransomware", "phishing", "drug", "cocaine", "heroin", "meth")
SENSITIVE_TOPICS = ("self-harm", "violence", "terrorism", "child abuse", "illegal weapons", "drug trafficking")

# --- Compliance: rule -> (severity, phrases).
COMPLIANCE = {
    "no_financial_advice": ("medium", ("invest in", "buy stock", "sell stock", "guaranteed return", "financial advice")),
    "no_medical_diagnosis": ("high", ("you have", "you are diagnosed", "your diagnosis", "take this medication")),
    "no_legal_advice": ("medium", ("you should sue", "file a lawsuit", "legal action against", "your legal rights are")),
}

# --- Fraud.
FRAUD = (
    r"wire transfer", r"send money", r"bitcoin|crypto payment", r"gift card", r"western union", r"money gram", r"urgent transfer", r"lottery winner", r"inheritance claim",
    r"advance fee", r"nigerian prince", r"verify your (account|bank|card)", r"click (here|this link) to (verify|confirm|update)",
)
FRAUD_POINTS = 25.0
RISK_WEIGHTS = {"fraud": 0.3, "abuse": 0.25, "pii": 0.2, "leakage": 0.15, "cost": 0.1}
RISK_BANDS = ((80.0, "critical"), (60.0, "high"), (30.0, "medium"))
ESCALATION_SCORE = 70.0

# --- Grounding of answers.
CONTRAST_WORDS = (" however, ", " but ", " although ", " whereas ", " on the contrary", " yet ")
NEGATIONS = ((" is ", " is not "), (" can ", " cannot "), (" will ", " will not "), (" does ", " does not "))
OVERCONFIDENT = ("always", "never", "definitely", "certainly", "absolutely", "guaranteed", "100%")
HEDGES = ("may be", "could be", "might be", "perhaps", "apparently", "possibly")

# --- Requests: class -> phrases, in the order in which the classes are tried.
GREETINGS = ("hi", "hello", "hey", "good morning", "good evening", "howdy", "greetings", "sup", "yo")
SMALL_TALK = ("love you", "i love you", "how are you", "who are you", "what are you", "are you there", "you there", "thank you", "thanks", "ok", "okay", "cool", "nice", "great", "awesome")
IDENTITY = ("your name", "who are you", "what are you", "are you a bot", "are you ai", "are you human")
REQUEST_CLASSES = {
    "business": ("product", "service", "policy", "return", "refund", "delivery", "order", "account", "feature", "document", "report", "data", "company", "our", "we offer", "you offer"),
    "support": ("error", "issue", "problem", "not working", "broken", "fix", "bug", "fail", "crash", "trouble"),
    "pricing": ("price", "cost", "pricing", "plan", "subscription", "fee", "charge", "billing", "pay", "discount"),
    "summarization": ("summarize", "summary", "tldr", "brief", "overview", "recap", "shorten"),
    "reasoning": ("analyze", "reason", "compare", "evaluate", "assess", "pros and cons", "difference", "versus", "vs", "better", "recommend", "should i"),
    "faq": ("what", "how", "why", "when", "where", "who", "which", "explain", "define", "tell me", "describe", "capital", "meaning"),
}

# --- Product questions.
COMPARISON = r"vs\.?|versus|compare|difference|better|which is|between"
POLICY_WORDS = ("policy", "policies", "terms", "condition", "rule", "guideline", "return", "refund", "exchange", "shipping", "delivery", "warranty")
SUPPORT_WORDS = ("not working", "broken", "issue", "problem", "error", "help", "wrong", "damaged", "missing", "complaint", "defect")
PRICE_WORDS = "price|cost|how much|rate"
STOCK_WORDS = "available|in stock|stock|availability"
SHOP_WORDS = "show|find|search|looking for|want|need|buy|get"
QUESTION_WORDS = "what|how|why|when|where|explain|tell me"
PRICE_MAX = r"(?:under|below|less than|max|maximum|within)\s*(?:tk\.?|bdt\.?|৳|\$)?\s*(\d[\d,]*)"
PRICE_MIN = r"(?:above|over|more than|min|minimum|at least)\s*(?:tk\.?|bdt\.?|৳|\$)?\s*(\d[\d,]*)"
SIZES = "xs|s|m|l|xl|xxl|xxxl|small|medium|large|extra large"
COLORS = "black|white|red|blue|green|yellow|grey|gray|navy|pink|purple|orange|brown"
ATTRIBUTES = ("availability", "care", "color", "colour", "cost", "delivery", "dimension", "fabric", "feature", "material", "price", "return", "shipping", "size", "specification", "stock", "warranty", "wash", "weight")
CATEGORIES = ("shirt", "tshirt", "t-shirt", "hoodie", "sweatshirt", "pant", "trouser", "shorts", "jacket", "coat", "dress", "saree", "kurta", "panjabi", "shoe", "sneaker", "sandal", "bag", "backpack", "wallet", "cap", "hat", "sock", "underwear", "bra", "legging", "jogger", "polo", "vest")
BRANDS = ("adidas", "nike", "puma", "reebok", "h&m", "zara", "uniqlo", "levis", "wrangler", "gap")
PLACES = ("dhaka", "chittagong", "ctg", "sylhet", "khulna", "rajshahi", "gulshan", "dhanmondi", "mirpur", "bashundhara", "uttara", "motijheel", "narayanganj", "gazipur", "wari", "old dhaka")
SKU = r"\b([A-Z]{2,6}\d{4,12}(?:-[A-Z0-9]+)?)\b"
PRONOUN_ONLY = r"^(it|this|that|these|those|the product|this product|the item|that item)\s*\??$"
TOO_SHORT = r"^\s*\w{1,3}\s*\??$"
MULTI_MEANING = {"polo": "polo shirt", "fit": "fit size", "free": "free shipping"}
TYPOS = {
    "shiping": "shipping", "shpping": "shipping", "delivry": "delivery",
    "deliveri": "delivery", "returnn": "return", "refundd": "refund", "availble": "available", "availabel": "available", "avaliable": "available", "prodcut": "product", "prodect": "product", "materail": "material",
    "materiel": "material", "colur": "color", "colour": "color", "sizee": "size", "prise": "price", "prce": "price", "waranty": "warranty", "warrenty": "warranty", "guarentee": "guarantee", "guarntee": "guarantee",
    "discont": "discount", "discound": "discount", "exchagne": "exchange", "exchnage": "exchange", "polcy": "policy", "plicy": "policy", "tshrit": "tshirt", "tshit": "tshirt", "hoddie": "hoodie", "hoodei": "hoodie",
    "trousser": "trouser", "snekar": "sneaker", "sneker": "sneaker", "backpak": "backpack",
}

# --- Pages and addresses.
PRODUCT_SIGNALS = (r"\$\d+", "price", "buy now", "add to cart", "checkout", "product", "sku", "in stock", "out of stock", "shipping")
PRICING_SIGNALS = ("per month", "per year", "/mo", "/yr", "pricing", "plan", "subscription", "free trial", "upgrade")
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "sort", "filter", "session", "replytocom", "ref", "_ga", "mc_cid", "mc_eid")
SKIPPED_ADDRESSES = (
    "/cart", "/checkout", "/account", "/login", "/register", "/wishlist", "/compare", "/cdn/", "/customer_authentication", "/tag/", "/order/", "/user/", "/search", "/wp-login", "/wp-admin", "/feed/",
    ".xml", ".pdf", ".zip", ".txt", ".md", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".css", ".js", ".ico", ".woff", ".woff2", ".ttf", ".mp4", ".mp3",
)
ADDRESS_PRIORITY = {
    "product": 0, "products": 0, "service": 0, "services": 0, "pricing": 0, "price": 0, "docs": 0, "documentation": 0, "faq": 5, "policy": 5, "policies": 5, "about": 5, "contact": 5,
    "blog": 10, "article": 10, "news": 10, "post": 10, "collection": 15, "collections": 15, "category": 15, "tag": 50,
}
DEFAULT_PRIORITY = 25
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}

# --- Entities: what a source's word is worth, and the shares of a product record's completeness.
SOURCE_PRIORITY = {"shopify_json": 100, "graphql": 90, "xhr_api": 80, "jsonld": 70, "hydration": 60, "dom": 40, "og_meta": 20, "llm": 10}
COMPLETENESS = {"core_fields": 0.30, "sku_coverage": 0.20, "variant_coverage": 0.20, "attribute_coverage": 0.15, "logistics": 0.10, "content_quality": 0.05}
COMPLETE_FROM = 0.72
FULL_FROM, PARTIAL_FROM = 0.85, 0.75

# --- Evaluation and service levels.
RECALL_FROM, NO_RESULT_TO, SIMILARITY_FROM = 0.70, 0.10, 0.40
SIMILARITY_THRESHOLD = 0.35
SLA_MS = {"fast": 500, "cached": 200, "full": 3000}

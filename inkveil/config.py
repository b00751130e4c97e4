"""Fixed values of the privacy model: categories, patterns, weights and decision tables.

Patterns are spelled once, with `\\b` for an ASCII word boundary; `java()` gives the form for Spark, whose own `\\b` follows
Unicode. Letter case is spelled out in classes, as case folding differs between engines.
"""

from __future__ import annotations

import re

# --- fixed values: these must equal what users of the model rely on ---
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d[\d(). -]{7,}\d)"
CARD = r"(?:\d[ -]*?){13,19}"
ACCOUNT_ID = r"\b(?:[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}|[Aa][Cc][Cc]-[A-Za-z0-9]{6,12})\b"
PERSON_NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
ADDRESS = r"\b\d{1,5}\s+[A-Za-z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln)\b"
STRICT_PHONE = r"(?:(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\b[6-9]\d{9}\b|\b\d{10}\b)"
STRICT_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{13,19}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
STRICT_ACCOUNT_ID = r"\b(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|ACC-[A-Z0-9]{6,12})\b"
LABELLED_CARD = r"\b(?i:Card|Credit Card|Card Number)\s*:\s*([0-9 -]{13,19})"
LABELLED_NAME = r"\b(?i:Name|Full Name|Customer Name|User Name)\s*:\s*([A-Za-z]+(?:\s+[A-Za-z]+)*)"
LABELLED_ID = r"\b(?i:ID|User ID|Customer ID|Account ID)\s*:\s*([A-Za-z0-9_#-]+)"
GREETING = r"\b(?i:Dear|Hello|Hi|Hey)\s+([A-Za-z][a-zA-Z0-9_-]+(?:\s+[a-zA-Z0-9_-]+){0,2})"
OTP_AFTER = r"\b(?i:otp|code|pin|verification\s+code|login\s+code|security\s+code|passcode|one-time\s+password)\b[^A-Za-z0-9_\n\r]{0,10}\b([0-9]{4,8})\b"
OTP_BEFORE, OTP_FOLLOWS = r"\b([0-9]{4,8})\b", r"[^A-Za-z0-9_\n\r]{0,10}(?i:is\s+your|was\s+your|-\s*your|-\s*login\s+code|login\s+code|verification\s+code|security\s+code)"
NO_NAMES = ["customer", "user", "investor", "sir", "madam", "all", "team", "member", "there", "friend", "everyone", "viewer", "guest", "subscriber"]
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
URL_SECRET = r"([?&](?:token|password|secret|key|apiKey|access_token|auth)=)[^&]+"
INLINE_SECRET = r"((?:password|passwd|pwd|passcode|pass|secret|pin|cvv|cvc|otp|token|key|bearer|auth)[^A-Za-z0-9_\n\r]{0,5}[:=]\s*)([^\s,;]+)"

SENTINEL = r"\b(?i:TEST_TELEMETRY|PHASE6_AUDIT|PHASE6_SECRET|PHASE6_EMAIL|PHASE6_PASSWORD)_[A-Za-z0-9_]+\b"
SPOKEN_SECRET = (
    r"((?i:password|passwd|pwd|passcode|pass|secret|pin|cvv|cvc|otp|token|key|bearer|auth)[^A-Za-z0-9_\n\r]{0,5}[:=]\s*)([^\s,;]+)"
    r"|((?i:with|using|is|and|the)\s+(?i:password|passwd|pwd|passcode|pass|secret|pin|cvv|cvc|otp|code|token|key)\s+)([^\s,;]+)"
    r"|(\b(?i:otp|pass|password|pin)\s+)([A-Za-z0-9_!@#$%^&*+=~-]+)"
)
URL_PARAMETER = r"([?&](?i:token|password|secret|key|apiKey|access_token|auth)=)[^&]+"
LONG_ADDRESS = r"\b[0-9]{1,5}\s+[A-Za-z0-9.,\s-]+\s+(?i:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct)\b"
STREET_WORD = r"\s(?i:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct)\b"
REMOTE_EMAIL, REMOTE_DIGITS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"(?:[0-9][ -]*?){13,19}"
REMOTE_KEYS = ["value", "rawvalue", "password", "otp", "cardnumber", "creditcard", "secret", "phonenumber", "emailaddress"]
SENSITIVE_KEYS = [
    "password", "passwd", "pwd", "secret", "secret_?value", "raw_?value", "cvv", "cvc", "security_?code", "otp",
    "passcode", "api_?key", "token_?secret", "auth_?header", "credit_?card", "card_?number", "session_?secret", "private_?key", "user_?input", "raw_?input",
]
RAW_PAGE_KEYS, RAW_IMAGE_KEYS = ["rawDom", "rawHtml", "html"], ["screenshotBuffer", "rawScreenshot"]
RAW_PAGE, RAW_IMAGE, PROTECTED, PROTECTED_MAPPING = "[RAW_DOM_REDACTED_FROM_TELEMETRY]", "[RAW_SCREENSHOT_REDACTED_FROM_TELEMETRY]", "[PROTECTED_SECRET]", "[PROTECTED_SECRET_MAPPING]"
TOKEN_PREFIX, MOST_PAYLOAD_BYTES, MOST_TASK_CHARS = "PII_TOKEN_", 524_288, 500
RETRYABLE, NEVER_RETRIED = [408, 429, 500, 502, 503, 504], [400, 401, 403, 422]

BASE_CONFIDENCE = {
    "email": 0.98, "phone": 0.92, "payment_card": 0.95, "password_field": 0.95, "otp": 0.85,
    "person_name": 0.45, "address": 0.50, "account_identifier": 0.50,
}
EVIDENCE_BOOST = {"CHECKSUM": 0.15, "DOM_SEMANTIC": 0.12, "OCR_VISUAL": 0.10, "HEURISTIC_SYNTAX": 0.08}
OTHER_BASE, OTHER_BOOST, LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.50, 0.05, 0.10, 0.98
OVERLAP_SHARE, NEAR_PX = 0.25, 20

CRITICAL = ["password_field", "password", "otp", "payment_card", "credit_card", "payment_card_field"]
HIGH = ["address", "account_identifier"]
PUBLIC = ["product_title", "product", "price", "brand", "color", "specification", "public_label", "safe_context", "public_text"]
CARDS = ["payment_card", "credit_card", "payment_card_field"]
SECRETS = ["password_field", "password", "otp", "cvv", "cvc", "security_code"]
TOKENIZABLE = ["email", "email_field", "phone", "phone_field", "person_name", "address", "account_identifier", *CARDS]
LOCAL = ["LOCAL_BROWSER", "LOCAL_EXTENSION"]
REMOTE = ["REMOTE_REASONING", "REMOTE_SERVICE"]
LEAST_POLICY_CONFIDENCE = 0.60

INTENTS = [
    ("FIND_INFORMATION", "find|get|show|lookup|fetch|display|where is|what is my", 0.88),
    ("READ_INFORMATION", "read|browse|view article|open page|examine", 0.90),
    ("ENTER_INFORMATION", "enter|type|fill|input|put|insert", 0.88),
    ("SUBMIT_FORM", "submit|send|complete form|form", 0.85),
    ("LOGIN", r"log\s*in|login|sign\s*in|authenticate", 0.92),
    ("SIGNUP", r"sign\s*up|signup|register|create account", 0.92),
    ("CHECKOUT", "checkout|buy|purchase|place order", 0.90),
    ("VERIFY_IDENTITY", "otp|verify|verification|2fa|passcode|confirm identity", 0.94),
    ("SEARCH", "search|find product|lookup product", 0.88),
    ("CONTACT", "contact|reach out|get in touch|email support", 0.88),
    ("PAYMENT", "pay|payment|credit card|charge", 0.90),
]
NEGATION = r"\b(?:do\s*not|don't|without|exclude|skip|no|never|omit|except)\s+([a-z0-9_\s,-]+)"
CATEGORY_WORDS = {
    "email": "email|e-mail|mail|email address",
    "phone": "phone|mobile|telephone|cell|phone number|contact number",
    "password_field": "password|passcode|secret",
    "payment_card": "credit card|debit card|payment card|card number|cvv",
    "otp": "otp|one time code|verification code|2fa|passcode",
    "person_name": "name|first name|last name|full name|person name",
    "address": "address|street|postal code|zip code|location",
    "account_identifier": "account|account number|account id|iban|customer id",
}
CATEGORY_PARTS = [
    ("email", "email"), ("phone", "phone"), ("payment", "payment_card"), ("card", "payment_card"), ("password", "password_field"), ("otp", "otp"), ("name", "person_name"), ("address", "address"), ("account", "account_identifier"),
]
ROLE_WORDS = {
    "secret": r"\b(?:passcode|otp|2fa|verification code|pin|secret)\b",
    "billing": "billing|cvv|cvc|card|payment",
    "shipping": r"\b(?:shipping|delivery|ship_to|shipment|street|postal|zip)\b",
    "recipient": "recipient|send_to|sendto|to_email|to_address|receiver|client",
    "sending": r"\b(?:to|send|message)\b",
    "account": r"\b(?:username|user_id|login_email|account_id)\b",
    "product": r"\b(?:product|price|title|specs|brand|model)\b",
    "search": r"\b(?:search|query|find|lookup)\b",
}
KIND_CONFIDENCE = {"email": 0.98, "phone": 0.92, "card": 0.95, "labelled_card": 0.95, "ip": 0.90, "account": 0.85, "name": 0.92, "id": 0.90, "otp": 0.95, "greeting": 0.90}
KIND_TYPE = {"email": "EMAIL", "phone": "PHONE", "card": "CREDIT_CARD", "labelled_card": "CREDIT_CARD", "ip": "ID", "account": "ID", "name": "NAME", "id": "ID", "otp": "OTP", "greeting": "NAME"}
SCREEN_LABELS = [(3, "pay|card|checkout|billing"), (2, "login|register|password|email")]
FULL_URL = r"(?i:https?://[^\s]+)"
NAMED_SITE = r"\b(?:go to|navigate to|visit|open(?:\s+website)?)\s+([a-z0-9-]+\.(?:com|org|net|in|io|co|gov|edu|ai|app|dev))\b"
ROOT_VERB = r"^(?:go to|navigate to|visit)\s+([a-z0-9.-]+)\b"
OPEN_AND, OPEN_SITE = r"^open\s+([a-z0-9.-]+)\s+(?:and|then|to)\s+", r"^open\s+([a-z0-9-]+)$"
NO_SITE_AND = ["first", "second", "third", "latest", "newest", "last", "top", "the", "a", "an", "this", "my", "all", "mail", "email", "message", "tab", "link", "page", "file", "document", "chat", "post", "ticket", "issue"]
NO_SITE = ["mail", "email", "message", "tab", "link", "file", "document", "chat", "post", "ticket", "issue", "cart"]
ORDINALS = [
    ("first", 0, r"\b(?:first|1st|top|latest|newest)\b"), ("second", 1, r"\b(?:second|2nd)\b"), ("third", 2, r"\b(?:third|3rd)\b"),
    ("fourth", 3, r"\b(?:fourth|4th)\b"), ("fifth", 4, r"\b(?:fifth|5th)\b"), ("last", -1, r"\b(?:last|bottom|oldest)\b"),
]
EVERY = r"\b(?:all|every|each)\b"
DOMAIN_WORDS = {
    "form": r"\b(?:fill out|fill in|complete form|registration form|signup form|contact form|survey|application form|enter name|enter email)\b",
    "change": r"\b(?:change|update|replace|modify|edit|set|fill)\s+(?:the\s+)?(?:[a-zA-Z0-9_\-\s]{2,30}?)\s+(?:to|with|=|as)\b",
    "put": r"\b(?:enter|type|put|insert|fill)\s+.+?\s+(?:in|into|to|inside)\s+(?:the\s+)?[a-zA-Z0-9_\-\s]{2,30}\b",
    "field": r"\b(?:change|update|replace|modify|edit|set|enter|fill)\s+(?:the\s+)?(?:email|phone|otp|password|code|two factor|2fa|name|address|input|field|message|details)\b",
    "paper": r"\b(?:form|sign up|register|survey|application|registration|employee form)\b",
    "goods": r"\b(?:buy|shop|shoes?|sneakers?|laptops?)\b",
    "stay": r"\b(?:buy|shop|cart|checkout|fill|register)\b",
    "travel": r"\b(?:flight|hotel|airbnb|booking|ticket|reservation|train|bus)\b",
    "fault": r"\b(?:issue|bug|support ticket)\b",
    "shop": r"\b(?:buy|shop|cart|product|price|shoes?|sneakers?|jackets?|clothes?|laptops?|phones?|discount|cost|winter jacket)\b",
    "order": r"\border\b",
    "ordering": r"\b(?:confirm order|place order|cancel order|submit order|order form)\b",
    "learn": r"\b(?:read|article|paper|summary|extract|search for|look up|research|info|information|docs|documentation|learn about)\b",
}
CLICK = r"(?:click\s+(?:on\s+)?|press\s+(?:on\s+)?|tap\s+(?:on\s+)?|select\s+|activate\s+)(?:the\s+)?([a-zA-Z0-9_\-\s]+?)"
CLICK_LATER = r"\b(?:and|then|to)\s+" + CLICK + r"(?:[,\.]|\s+(?:with|after|before)|$)"
CLICK_NOW = r"\b" + CLICK + r"(?:[,\.]|\s+(?:and|then|with|after|before)|$)"
COMMAND = r"\b(confirm\s+order|place\s+order|submit\s+form|confirm|submit|continue|cancel|save|proceed|checkout)\b"
NO_TARGET = ["it", "this", "that", "first", "second", "item", "result"]
CART = r"\b(?:add to cart|add to bag|add to basket|buy now)\b"
ACT_LATER = r"\b(?:and|then|to)\s+(?:click\s+(?:on\s+)?)?(subscribe|follow|star|like|bookmark|download|share|pin|play|favorite|join|install|upvote|vote|fork|enroll|listen|watch|unfollow|unsubscribe|archive|delete|approve|merge|reply|confirm|continue|submit|save|proceed|cancel)\b"
ACT_NOW = r"\b(?:click\s+(?:on\s+)?)?(subscribe|follow|star|bookmark|download|upvote|fork|archive|approve|confirm|continue|proceed|cancel)\b"
ABOUT = r"\b(?:search|find|read)\s+about\b"
GOAL_SIGNS = {
    "search": r"\b(?:search|find|look for|query)\b",
    "filter": r"\b(?:filter|sort|under|color|brand|price|size)\b",
    "press": r"\b(?:click|press|tap)\b",
    "look": r"\b(?:inspect|check|view|details|look at|examine|open first|review)\b",
    "compare": r"\b(?:compare|options|few options|which is better|best of)\b",
    "fill": r"\b(?:fill|enter|input|type|change|update|replace|modify|set|edit)\b",
    "send": r"\b(?:submit|apply|register|sign up|book now|complete form|confirm|continue|checkout|place order|send message|save|cancel)\b",
    "cart": r"\b(?:add to cart|add to bag|buy now|buy|cart)\b",
    "extract": r"\b(?:extract|summarize|get info|information)\b",
    "press_or_send": r"\b(?:click|press|tap|submit|confirm|continue|cancel|checkout|place order|add to cart)\b",
    "any_search": r"search|query|find\s+information",
    "any_fill": r"fill|complete form|enter|type|input",
    "any_cart": r"add to cart|add to bag|add to basket",
    "submit": r"\b(?:submit|confirm|place order|register|checkout|save)\b",
}
SEARCHED = r"(?i:(?:search\s+(?:on|in)\s+[a-z0-9.-]+\s+for|search\s+[a-z0-9.-]+\s+for|search\s+for|look\s+up|find\s+information\s+(?:on|about)|read\s+about|learn\s+about)\s+(.+?)(?:\s+(?:and\s+.*|under\s+.*|below\s+.*|with\s+.*))?$)"
ITEM = r"(?i:^(?:open|read|view|select|click|inspect|check|review|book|download|forward|find|get|show|send)\s+(?:me\s+)?(?:a\s+|an\s+|the\s+)?(?:first|second|third|latest|newest|last|top|1st|2nd|3rd)?\s*([a-zA-Z0-9_\-#\s]+?)(?:[,\.]|\s+(?:from|by|to|for|on|in|under|with|and)|\s*$))"
NO_ITEM = ["the", "a", "an", "this", "that", "it", "item", "result"]
GOAL_PREFIX = r"(?i:^(?:find me a|find me|find a|find|search for|search on\s+[a-z0-9.-]+\s+for|search in\s+[a-z0-9.-]+\s+for|search|look for|look up|open|go to|show me|compare|buy|get me|review|book|download|inspect|check|view|select|click|forward|send)\s+)"
BEFORE_ACTION = r"\s+(?:and|then|to)?\s*"
GOAL_LIMITS = r"(?i:\s+(?:under|below|less than|above|over|priced|max)\s+.*$)"
NO_ENTITY = {"ecommerce": "item", "research": "topic", "": "target"}
NO_FILTER = ["url", "candidate_count", "sender", "author"]
BROWSER_PAGES = ["chrome://", "about:", "chrome-extension://"]
MODAL = r"\b(?:cookie policy|we use cookies|privacy preferences|sign up for|subscribe to our newsletter|accept all cookies|cookie consent)\b"
MODAL_CLOSE = r"\b(?:close|dismiss|agree|accept all|accept cookies|got it|not now|skip|continue without|decline)\b"
NOTHING_FOUND = r"\b(?:no results found|0 results|did not match any products|no matches found|try checking your spelling)\b"
CHOOSE_CATEGORY = r"\b(?:select a category|choose category|all departments|select department)\b"
MOST_REPLANS = 5
REPLAN_TASKS = {
    "modal_overlay": ("close_modal", "Inserted immediate task to dismiss modal dialog via "),
    "zero_results": ("search", "Zero search results detected. Inserted refined search task without relaxing constraints."),
    "category_selector": ("select_category", "Inserted task to select required product category."),
    "consecutive_failures": ("scroll", "Recovering from consecutive failures by scrolling viewport."),
}
MIXED_CONTENT = [
    ("item_pub_title", "product_title", 0.99, "public_product_attribute", "REQUIRED", "CONTEXTUAL_REFERENCE", "REMOTE_REASONING", "Active Noise-Cancelling Over-Ear Headphones"),
    ("item_pub_price", "price", 0.98, "public_product_attribute", "REQUIRED", "CONTEXTUAL_REFERENCE", "REMOTE_REASONING", "$199.99"),
    ("item_pub_spec", "specification", 0.97, "public_product_attribute", "OPTIONAL", "CONTEXTUAL_REFERENCE", "REMOTE_REASONING", "Midnight Black, 40h Battery, Bluetooth 5.3"),
    ("item_email_recipient", "email", 0.96, "recipient", "REQUIRED", "REMOTE_REASONING_REQUIRED", "REMOTE_REASONING", "delivery-contact@example.test"),
    ("item_phone_unneeded", "phone", 0.95, "account_identifier", "IRRELEVANT", "UNNECESSARY", "REMOTE_REASONING", "+1-555-0199"),
    ("item_auth_password", "password_field", 0.99, "authentication_secret", "REQUIRED", "LOCAL_EXECUTION_ONLY", "LOCAL_BROWSER", "UserSecretPassword#2026"),
    ("item_auth_otp", "otp", 0.98, "authentication_secret", "REQUIRED", "LOCAL_EXECUTION_ONLY", "LOCAL_BROWSER", "849201"),
]
SHOWN = {
    "TOKENIZE": ("Masked (Solid Black Fill)", "Stored Locally in PrivacyVault (Token Map)"),
    "LOCAL_ONLY": ("Masked (Solid Black Fill)", "Stored Locally in PrivacyVault (Purpose Isolated)"),
    "REDACT": ("Masked (Solid Black Fill)", "Not Stored (Minimized)"),
    "ALLOW": ("Clear / Visible (Safe Context)", "Not Stored (Public)"),
}
SOURCE_COMMENTS = [r"/\*[\s\S]*?\*/", r"//.*", r"/\(.*?\)[/i]+"]
SOURCE_RULES = {
    "execution_primitives": r"(?i:\beval\s*\(|\bnew\s+Function\s*\()",
    "hardcoded_endpoints": r"(?i:https://example\.com|https://api\.production)",
    "hardcoded_credentials": r"(?i:api_key_secret|bearer_token_production|super_secret_key)",
}
VIOLATIONS = {
    "allow_dom": "ALLOW item must not be masked in DOM",
    "allow_screenshot": "ALLOW item must not be masked in screenshot",
    "token": "TOKENIZE decision must provide a token",
    "token_payload": "TOKENIZE remote payload must match token exactly",
    "screenshot": " item must have sensitive pixels masked",
    "redact_payload": "REDACT remote payload must be [REDACTED]",
    "local_payload": "LOCAL_ONLY secret must never appear in remote payload",
}
# --- end of fixed values ---

_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

_END = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\$")


def java(pattern: str) -> str:
    """The pattern as Spark's regular expressions read it, with ASCII word boundaries, and `$` for the end alone, not before a last newline."""
    return _END.sub(lambda m: r"\z" if m[0] == "$" else m[0], pattern).replace(r"\b", _BOUNDARY)


# --- fixed values: the grammar of goals, first match of each ---
_MONEY = r"\s*(?:[₹$€£]|rs\.?|inr|usd)?\s*([\d,]+(?:\.\d+)?)\s*(k\b|thousand\b)?"
MOST_PRICE = rf"(?i:(?:under|below|less than|max|up to|<=?){_MONEY})"
LEAST_PRICE = rf"(?i:(?:above|over|more than|at least|>=?){_MONEY})"
COLOR_WORD = r"\b(?i:(white|black|blue|red|green|yellow|grey|gray|pink|purple|orange|brown|silver|gold))\b"
BRAND_WORD = r"\b(?i:(nike|adidas|puma|reebok|apple|samsung|sony|dell|hp|lenovo|asus|bose|logitech))\b"
RATING_WORD = r"(?i:(\d(?:\.\d)?)\s*(?:stars?|rating|\+?\s*stars?))"
SIZE_WORD = r"\b(?i:size\s*(?::|=|\s)?\s*([0-9A-Z]+))\b"
COUNT_BEFORE, COUNT_AFTER = r"\b(?i:(?:top|compare|select from|best)\s*(\d+))\b", r"\b(?i:(\d+)\s*(?:options|candidates|laptops|phones|items))\b"
SPEC_WORD = r"\b(?i:(\d+\s*(?:gb|tb)\s*(?:ram|ssd|storage|rom)?))\b"
URL_WORD = r"(?i:https?://[^\s]+|(?<!@)\b[a-zA-Z0-9-]+\.(?:org|com|net|edu|gov|io)\b[^\s,.]*)"
MODIFIES = r"\b(?i:change|update|replace|modify|set|enter|type|put|insert|fill in|fill)\b"
EMAIL_FIELD, EMAIL_ANYWHERE = r"(?i:(?:email|e-mail)\s*(?:as|is|to|=|:)?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}))", r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"
NAME_FIELD = r"(?i:(?:name|full\s*name|first\s*name)\s*(?:as|is|to|=|:)?\s*([a-zA-Z\s]{2,35}?)(?=[,\.]|\band\b|\bemail\b|\bphone\b|\bwith\b|$))"
PHONE_FIELD = r"(?i:(?:phone|mobile|tel|contact(?:\s*number)?)\s*(?:as|is|to|=|:)?\s*(\+?[\d\s-]{7,15}))"
MESSAGE_FIELD = r"""(?i:(?:message|comment|feedback|query|notes?)\s*(?:as|is|to|=|:)\s*(["'][^"']+["']|[^,\.]+))"""
_FIELD_END = r"(?=(?:\s+(?:and|then|click|confirm|submit|with|after)\b|(?:\.\s+)|\.$|$))"
CHANGE_FIELD = rf"\b(?i:(?:change|update|replace|modify|set|enter|fill in|fill)\s+(?:the\s+)?([a-zA-Z0-9_\-\s]{{2,35}}?)\s+(?:to|with|=|as|is)\s+([^,;\n]+?){_FIELD_END})"
ENTER_FIELD = rf"\b(?i:(?:enter|type|put|insert|fill)\s+([^,;\n]+?)\s+(?:in|into|to|inside)\s+(?:the\s+)?([a-zA-Z0-9_\-\s]{{2,35}}?){_FIELD_END})"
NO_FIELD_CHANGED, NO_FIELD_ENTERED = r"\b(?i:first|second|top|options|candidates)\b", r"\b(?i:first|second|top|options|candidates|cart|bag)\b"
_ENTITY = r"\s+([a-zA-Z0-9._%+-]+(?:\s+[a-zA-Z0-9._%+-]+)?)"
ENTITY_RULES = [  # preposition, what ends its entity, words that are none, roles
    ("from", "and|then|to|under|below|with|for|by|on|in|subject|about", "here|now|the|a|an|scratch", ["sender", "source", "author", "origin", "filter_constraint"]),
    ("by", "and|then|to|under|below|with|for|from|on|in", "now|then|default|clicking|typing", ["author", "brand", "creator", "filter_constraint"]),
    ("to", "and|then|under|below|with|for|from|by|on|in", "cart|bag|basket|buy|the|a|an|my|this", ["recipient", "target_entity", "destination"]),
    ("for", "and|then|under|below|with|from|by|on|in", "sale|free|me|us|them|the|a|an", ["search_query", "target_entity", "recipient"]),
    ("on|in", "and|then|under|below|with|for|from|by", "the|a|an|this|my|stock|sale|black|white|blue|red|green|yellow", ["platform_scope", "category", "folder", "location"]),
]


def entity_pattern(preposition: str, ends: str) -> str:
    return rf"\b(?i:({preposition}){_ENTITY}(?=[,\.]|\s+(?:{ends})|\s*$))"


# --- end of fixed values ---

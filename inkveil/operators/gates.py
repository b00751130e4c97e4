"""Guards as ordered `when` chains: fields, payloads, responses, actions, vault entries, tasks, targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t

# --- fixed values ---
FIELD_RULES = [
    ("password_field", "password", "password|current-password|new-password"),
    ("email", "email", "email"),
    ("phone", "tel", "phone|tel|mobile"),
    ("payment_card", None, "cc-number|card.?number|credit.?card"),
    ("otp", None, "one-time-code|otp|verification.?code"),
    ("name", None, r"person-name|full-name|first-name|last-name|\bname\b"),
    ("address", None, "street-address|address-line|postal-code|zip-code"),
    ("id", None, r"account-id|account-number|customer-id|\bid\b"),
]
SEMANTIC_RULES = [
    ("password_field", "password", r"password|current\s*password|new\s*password"),
    ("email", "email", r"email|e\s*mail|mail\s*address"),
    ("payment_card", None, r"cc\s*number|card\s*number|credit\s*card|cardholder|cvv|cvc|expir"),
    ("phone", "tel", r"phone|tel|mobile|cellphone|contact\s*number"),
    ("otp", None, r"one\s*time\s*code|otp|verification\s*code|2fa|passcode|security\s*code"),
    ("person_name", None, r"given\s*name|family\s*name|full\s*name|first\s*name|last\s*name|author\s*name|customer\s*name"),
    ("address", None, r"street\s*address|address\s*line|postal\s*code|zip\s*code|billing\s*address|shipping\s*address|pincode"),
    ("account_identifier", None, r"account\s*(id|number|num|ref)|customer\s*id|member\s*id|iban"),
]
ACTIONS = ["CLICK", "TYPE", "CLEAR", "SELECT", "CHECK", "UNCHECK", "PRESS_KEY", "FILL", "SUBMIT", "SCROLL", "NAVIGATE", "GO_BACK", "WAIT"]
# --- end of fixed values ---


def first_rule(rules: list, kind: Column, text: Column) -> Column:
    out = None
    for name, type_, pattern in rules:
        test = text.rlike(c.java(pattern)) if type_ is None else (F.coalesce(kind, F.lit("")) == type_) | text.rlike(c.java(pattern))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def field_text(*attributes: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.when(a != "", a) for a in attributes]))


def field_category(kind: Column, *others: Column) -> Column:
    return first_rule(FIELD_RULES, kind, field_text(kind, *others))


def field_semantics(kind: Column, autocomplete: Column, *others: Column) -> Column:
    text = F.regexp_replace(field_text(kind, autocomplete, *others), r"[._-]", " ")
    rules = [(n, k, p) for n, k, p in SEMANTIC_RULES]
    named = F.coalesce(autocomplete, F.lit("")).contains("name")
    early, late = first_rule(rules[:6], kind, text), first_rule(rules[6:], kind, text)
    return F.coalesce(early, F.when(named, "person_name"), late)


def payload_reason(v: Column) -> Column:
    """Why a string may not be sent, or null: the first rule that holds."""
    masked = v.contains("[REDACTED]") | v.contains("{{TOKEN_") | v.contains("[LOCAL_ONLY")
    d = t.digits(v)
    return (
        F.when(v.rlike(r"<[sS][cC][rR][iI][pP][tT](?![A-Za-z0-9_])|[eE][vV][aA][lL]\(|[jJ][aA][vV][aA][sS][cC][rR][iI][pP][tT]:"), "SCRIPT")
        .when(v.rlike(r"^[dD][aA][tT][aA]:[iI][mM][aA][gG][eE]/"), "IMAGE_DATA")
        .when(v.rlike(c.CARD) & t.luhn(v), "CARD")
        .when(v.rlike(c.java(c.EMAIL)) & ~masked, "EMAIL")
        .when(v.rlike(c.PHONE) & ~masked & ~v.rlike(r"^[hH][tT][tT][pP][sS]?://") & (F.length(d) >= 10) & ~v.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~v.rlike(c.java(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")), "PHONE")
    )


def response_reason(json: Column, most_actions: int = 10) -> Column:
    ok, status = F.get_json_object(json, "$.ok"), F.get_json_object(json, "$.status")
    actions = F.get_json_object(json, "$.recommendedActions")
    n = F.json_array_length(actions)
    return (
        F.when(ok.isNull() | ~F.coalesce(ok, F.lit("")).isin("true", "false") | status.isNull(), "SHAPE")
        .when(actions.isNotNull() & n.isNull(), "NOT_AN_ARRAY")
        .when(n > most_actions, "TOO_MANY_ACTIONS")
        .when(actions.rlike(r"<[sS][cC][rR][iI][pP][tT]|[eE][vV][aA][lL]\(|[jJ]avascript:"), "SCRIPT")
        .when(actions.rlike("vaultSecret|rawPassword|rawCard|rawOtp"), "VAULT_SECRET")
        .when(actions.rlike("executeDirectly|directDomCall"), "DIRECT_EXECUTION")
    )


def protocol_allowed(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).isin("http", "https")


def action_code(kind: Column, destination: Column, has_target: Column, url: Column, parameters: Column) -> Column:
    return (
        F.when(~F.coalesce(kind.isin(ACTIONS), F.lit(False)), "DENIED_INVALID_ACTION")
        .when(~F.coalesce(destination.isin(c.LOCAL), F.lit(False)), "DENIED_REMOTE_DESTINATION")
        .when(~has_target, "DENIED_INVALID_TARGET")
        .when((kind == "NAVIGATE") & ~F.coalesce(protocol_allowed(url), F.lit(False)), "DENIED_UNSAFE_ACTION")
        .when(F.coalesce(parameters, F.lit("")).rlike(r"[eE]val\(|[fF]unction\(|[jJ]avascript:|[sS]cript\s*>"), "DENIED_UNSAFE_ACTION")
        .otherwise("VALID")
    )


def store_code(category: Column, pii_id: Column, length: Column, purpose_ok: Column, destination: Column, authorized: Column, policy: Column, most: int = 10_000) -> Column:
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return (
        F.when(blank(category) | blank(pii_id) | (F.coalesce(length, F.lit(0)) == 0) | (length > most) | ~purpose_ok, "DENIED_INVALID_REQUEST")
        .when(~F.coalesce(destination.isin(c.LOCAL), F.lit(False)), "DENIED_REMOTE_DESTINATION")
        .when(authorized == F.lit(False), "DENIED_UNAUTHORIZED")
        .when(policy == "REDACT", "DENIED_INVALID_REQUEST")
        .otherwise("GRANTED")
    )


def relevance(category: Column, intent: Column, negated: Column, named: Column, field_exists: Column, contact_info: Column) -> Column:
    """struct<relevance, confidence> by the first of eight rules."""

    def out(r: str, x: float) -> Column:
        return F.struct(F.lit(r).alias("relevance"), F.lit(x).alias("confidence"))

    public, contact = category.isin(c.PUBLIC), category.isin("email", "phone", "address")
    reading, forms = intent.isin("READ_INFORMATION", "SEARCH"), intent.isin("LOGIN", "SIGNUP", "CHECKOUT", "VERIFY_IDENTITY", "PAYMENT")
    return (
        F.when(F.array_contains(negated, category), out("IRRELEVANT", 0.95))
        .when(F.array_contains(named, category) & field_exists, out("REQUIRED", 0.96))
        .when(F.array_contains(named, category), out("REQUIRED", 0.92))
        .when(reading & public, out("REQUIRED", 0.90))
        .when(reading, out("IRRELEVANT", 0.90))
        .when(contact_info & contact & field_exists, out("REQUIRED", 0.88))
        .when(contact_info & contact, out("OPTIONAL", 0.75))
        .when(forms & field_exists, out("REQUIRED", 0.90))
        .when((intent == "VERIFY_IDENTITY") & (category == "otp"), out("REQUIRED", 0.92))
        .when(forms, out("OPTIONAL", 0.70))
        .when(intent.isin("SUBMIT_FORM", "ENTER_INFORMATION") & field_exists, out("OPTIONAL", 0.75))
        .when(intent.isin("SUBMIT_FORM", "ENTER_INFORMATION"), out("UNKNOWN", 0.60))
        .when(F.size(named) > 0, out("IRRELEVANT", 0.88))
        .otherwise(out("UNKNOWN", 0.50))
    )


# --- fixed values ---
CONCEPTS = {
    "email": ["email", "mail", "e-mail", "address"],
    "phone": ["phone", "tel", "telephone", "mobile", "cell", "contact"],
    "name": ["name", "fullname", "firstname", "lastname"],
    "password": ["password", "pass", "pwd"],
    "otp": ["otp", "code", "pin", "token", "2fa", "two-factor", "auth", "verification"],
    "message": ["message", "comment", "feedback", "notes", "query", "description", "inquiry"],
    "address": ["address", "street", "city", "location", "shipping", "billing", "delivery"],
    "submit": ["submit", "send", "save", "apply", "register", "signup", "proceed", "continue", "finish", "complete"],
    "confirm": ["confirm", "place", "order", "accept", "agree", "verify", "ok", "yes"],
    "cancel": ["cancel", "dismiss", "close", "back", "abort", "reject", "no"],
}
STOP_WORDS = ["the", "a", "an", "please", "to", "on", "in", "into", "for", "with", "of", "at", "by"]
# --- end of fixed values ---


def target_score(target: Column, shown: Column, code: Column, kind: Column) -> Column:
    """How well an element (shown text, code text, type; lower case) matches a target description."""
    low = F.lower(F.trim(target))
    words = F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+"), lambda x: (x != "") & ~x.isin(STOP_WORDS))
    joined = [code.contains(F.regexp_replace(low, r"\s+", sep)) for sep in ("_", "-", "")]
    phrase = F.when(shown.contains(low), 120).when(joined[0] | joined[1] | joined[2], 90).otherwise(0)
    each = F.aggregate(words, F.lit(0), lambda a, w: a + F.when(shown.contains(w), 30).when(code.contains(w), 20).otherwise(0))
    all_ = F.when((F.size(words) > 1) & F.forall(words, lambda w: shown.contains(w) | code.contains(w)), 50).otherwise(0)
    concept = F.lit(0)
    for name, s in CONCEPTS.items():
        typed = (kind == name) | ((kind == "tel") if name == "phone" else F.lit(False))
        seen = F.exists(F.array(*map(F.lit, s)), lambda x: shown.contains(x) | code.contains(x))
        points = F.when(typed, 80).otherwise(0) + F.when(seen, 40).otherwise(0)
        concept = concept + F.when(F.arrays_overlap(words, F.array(*map(F.lit, s))), points).otherwise(0)
    return F.when(F.size(words) == 0, 0).otherwise(phrase + each + all_ + concept)

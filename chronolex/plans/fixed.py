"""Fixed values of the oracles: phrases, patterns and weights of the rules, written apart from the modules that they check."""

from __future__ import annotations

# fixed values: phrases before a date from which a text is in force
EFFECTIVE = (
    r"(?:effective|comes?\s+into\s+force|shall\s+come\s+into\s+force)(?:\s+on)?(?:\s+the)?\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
    r"(?:effective|comes?\s+into\s+force|shall\s+come\s+into\s+force)(?:\s+on)?(?:\s+the)?\s*([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})",
    r"with\s+effect\s+from\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
    r"w\.e\.f\.?\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
)
# fixed values: before one until which it is
EXPIRY = (
    r"(?:expires?|ceases?\s+to\s+have\s+effect|valid\s+until)(?:\s+on)?(?:\s+the)?\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
    r"(?:expires?|ceases?\s+to\s+have\s+effect|valid\s+until)(?:\s+on)?(?:\s+the)?\s*([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})",
    r"shall\s+remain\s+in\s+force\s+until\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
)
# fixed values: before one of publication
PUBLICATION = (
    r"published\s+(?:on\s+)?(?:the\s+)?([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
    r"gazette\s+(?:dated\s+)?([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
    r"notification\s+(?:dated\s+)?([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
)
# fixed values: before the name of a later text
SUPERSEDED_BY = (
    r"superseded\s+by\s+([A-Z0-9\s,./()-]+?)(?:\s+dated|\s+of|\.|$)",
    r"replaced\s+by\s+([A-Z0-9\s,./()-]+?)(?:\s+dated|\s+of|\.|$)",
    r"substituted\s+by\s+([A-Z0-9\s,./()-]+?)(?:\s+dated|\s+of|\.|$)",
)
# fixed values: before the names of earlier ones
SUPERSEDES = (
    r"(?:supersedes?|replaces?|substitutes?)\s+([A-Z0-9\s,./()-]+?)(?:\s+dated|\s+of|\.|$)",
    r"in\s+supersession\s+of\s+([A-Z0-9\s,./()-]+?)(?:\s+dated|\s+of|\.|$)",
)
# fixed values: words of a status, in the order they are tried
STATUS = (
    ("active", "in force|current|valid|effective"),
    ("repealed", "repealed|revoked|superseded|replaced"),
    ("suspended", "suspended|stayed|postponed"),
    ("amended", "amended|modified|updated"),
)
# fixed values: words of a kind of document
DOCUMENT_TYPES = (
    ("constitution", r"\bconstitution\b"),
    ("act", r"\bact\b|\bstatute\b"),
    ("rule", r"\brules?\b|\bregulations?\b"),
    ("notification", r"\bnotification\b|\bgazette\b"),
    ("circular", r"\bcircular\b|\bmemorandum\b"),
    ("guideline", r"\bguidelines?\b|\bdirectives?\b"),
    ("order", r"\border\b|\bdecision\b"),
    ("advisory", r"\badvisory\b|\bguidance\b"),
)
# fixed values: words of a kind of claim
CLAIM_TYPES = (
    ("obligation", "shall|must|required"),
    ("permission", "may|can|permitted"),
    ("prohibition", "prohibited|not"),
    ("quantitative", "rate|amount|percentage|%"),
)
# fixed values: weights of the kinds of documents
WEIGHTS = {"constitution": 10.0, "act": 8.0, "rule": 6.0, "regulation": 5.0, "notification": 4.0, "circular": 3.0, "guideline": 2.0, "order": 1.5, "advisory": 1.0}
# fixed values: words of a factual claim
FACTUAL = "shall|must|will|is|are|was|were|according to|as per|under|pursuant to|provided that|subject to|in case of"
# fixed values: words that TF-IDF leaves out
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")

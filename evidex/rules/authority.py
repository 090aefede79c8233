"""Authority classes of evidence."""

# Class, rank (higher is more authoritative) and attribution phrase.
AUTHORITIES = {
    "constitution": (100, "The Constitution provides..."),
    "statute": (95, "The statute provides..."),
    "rules": (90, "The rules provide..."),
    "supreme_court": (88, "The Supreme Court held..."),
    "high_court": (80, "The High Court held..."),
    "tribunal": (70, "The tribunal decided..."),
    "official_legal": (65, "The available authorities indicate..."),
    "legal_corpus": (60, "The available authorities indicate..."),
    "web_official": (55, "The official website states..."),
    "matter_document": (30, "The matter document states..."),
    "conversation_document": (28, "The uploaded document states..."),
    "uploaded_document": (26, "The uploaded document states..."),
    "article_commentary": (20, "The article argues..."),
    "web_search": (15, "An internet source states..."),
    "unknown": (10, "The available evidence indicates..."),
}

# Words that mark a class.
COMMENTARY_WORDS = ("article", "commentary", "opinion")
STATUTE_WORDS = ("statute", "act", "ordinance", "code", "ppc", "crpc", "cpc")
RULE_WORDS = ("rule", "regulation", "sro")
TRIBUNAL_WORDS = ("tribunal", "commission")
OFFICIAL_SITE_WORDS = ("gov.pk", "supremecourt", "pakistan code", "official")
JUDGMENT_WORDS = ("judgment", "case", "precedent")

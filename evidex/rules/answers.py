"""Patterns and word lists for checking and cleaning answers."""

# Source markers; any number of sources may share one marker.
MARKER = r"(?i)\[Sources?\s+\d+(?:\s*(?:,|and|&)\s*(?:Source\s+)?\d+)*\]"

# What counts as a claim.
SECTION = r"\b(?:(?:section|sec\.?|u/s)\s+([0-9A-Za-z\-]+)|article\s+([0-9]+[A-Za-z\-]*|[IVXLCDM]+))\b"
CASE = r"\b(?:PLD|SCMR|MLD|YLR|CLC|PCr\.LJ)\s+\d{4}\s+[A-Za-z]+\s+\d+"
QUOTE = "\"([^\"]{20,})\"|'([^']{20,})'"
ASSERTION = (
    r"the (?:statute|law|court|judgment|act|ordinance|section|article)|section\s+[0-9A-Za-z\-]+|"
    r"(?:pld|scmr|mld|ylr|clc|pcr\.lj)\s+\d{4}"
)
HOLDING = (
    r"\b(?:the court held|the supreme court held|the high court held|it was held that|"
    r"the judgment (?:held|established|laid down)|binding precedent|ratio decidendi)\b"
)
RELATIONS = (
    "injunction", "interim injunction", "double jeopardy", "discretion", "clog", "bail", "appeal", "limitation",
    "prevent", "prohibit", "mandatory", "immunity", "deposit", "natural justice", "unreasonable", "holding",
    "conviction", "acquittal",
)
PARAPHRASE_IGNORED = ("article", "author", "argues", "according", "document", "uploaded")
NOT_CLAIMS = ("note:", "i don't have enough")
UNVERIFIED = "[citation not verified in evidence]"

# Notices once put in front of answers.
PREAMBLES = (
    "No matching document or corpus passage fully supports every legal proposition below. Treat this as provisional "
    "guidance and verify against primary authorities before reliance.",
    "Note: Retrieved authorities may reflect conflicting positions. The analysis below identifies uncertainty where "
    "present.",
    "No matching document or corpus passage was found for this question. The following is general legal guidance only "
    "— not grounded in retrieved authorities or uploaded files — and should be verified by counsel against primary "
    "sources before reliance.",
    "Note: The available retrieved sources provide only partial support for this answer. The following should be "
    "verified against primary legal authority.",
    "Note: Retrieved sources are limited and may not include authoritative legal material on this point. The following "
    "is based on available documents only and should not be treated as definitive legal authority.",
    "Note: Some quoted passages could not be matched exactly to the retrieved document text. The summary below is based "
    "on available excerpts.",
)
OPEN_PREAMBLE = (
    "Note: Some legal propositions in this answer could not be fully verified against retrieved evidence"
)

# Source lists and markers removed for display, applied in this order.
DISPLAY_PATTERNS = (
    r"(?im)\n+\s*(?:#{1,3}\s*)?(?:Sources?|References?|Citations?)\s*:?\s*"
    r"(?:\n\s*(?:[-*•]\s*)?(?:\[Sources?\s+[^\]]+\]|\(Sources?\s+[^)]+\)|[^\n]*))*\s*$",
    r"(?i)\n+\s*(?:#{1,3}\s*)?(?:Sources?|References?|Citations?)\s*:?\s*"
    r"\n(?:\s*(?:[-*•]\s*)?(?:\[Sources?\s+[^\]]+\]|\(Sources?\s+[^)]+\)|[^\S\n]*)\s*\n?)+",
    r"(?i)\n+\s*(?:#{1,3}\s*)?(?:Sources?|References?|Citations?)\s*:?\s*(?:\n\s*[-*•]\s*)*\s*$",
    r"(?i)\s*\[Sources?\s+\d+(?:\s*(?:,|and|&)\s*(?:Source\s+)?\d+)+\]",
    r"(?i)\s*\(Sources?\s+\d+(?:\s*(?:,|and|&)\s*(?:Source\s+)?\d+)*\)",
    r"(?i)\s*\[Source\s+\d+\]",
    r"(?im)(?:^|\n)\s*(?:#{1,3}\s*)?(?:Sources?|References?|Citations?)\s*:?\s*$",
)

# Small words that are never part of a split word, and known halves of split words.
WHOLE_WORDS = """a an the to of in on or is be by as at if it for and not no so do we he she they me my our you your can
may did was are has had but who how why any all""".split()
KNOWN_HALVES = (
    ("opt", "ion"), ("app", "eal"), ("pe", "titi"), ("titi", "on"), ("le", "ave"), ("ha", "ve"), ("ans", "wer"),
    ("a", "nswe"), ("answe", "r"), ("nswe", "r"), ("s", "upp"), ("supp", "orting"), ("eviden", "ce"), ("evi", "denc"),
    ("denc", "e"), ("evidenc", "e"), ("den", "ce"), ("ev", "i"), ("rel", "ati"), ("ati", "ve"), ("ve", "s"),
    ("victi", "m"), ("sec", "tion"), ("arti", "cle"), ("t", "o"),
)

# Tags around hidden reasoning, and headings of internal analysis.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
ANALYSIS_HEADER = r"(?i)(?:^|\n)\s*(?:EVIDENCE ANALYSIS|INTERNAL ANALYSIS|REASONING NOTES?)\s*:?\s*\n"

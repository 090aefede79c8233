"""Word lists used when grading evidence."""

# Concepts a question may ask about.
CONCEPTS = (
    "double jeopardy", "injunction", "temporary injunction", "judicial discretion", "clog", "bail",
    "appeal", "limitation", "specific performance", "negligence", "murder", "contract", "arbitration",
    "maintenance", "defamation", "possession", "recovery", "precedent", "constitutional petition",
    "contempt", "inheritance",
)

# Words ignored when matching a question's terms.
QUESTION_STOPWORDS = """what when where which who whom whose why how can could should would will is are was
were the a an in on at to for of and or this that these those it be been being do does did under about with
from by as if pakistani pakistan law legal""".split()

# Wordings that oppose each other.
OPPOSING = (
    ("shall not", "may"), ("prohibited", "permitted"), ("mandatory", "discretionary"), ("cannot", "can"),
    ("must", "may"), ("invalid", "valid"), ("allowed", "not allowed"),
)

# Tasks and words that call for legal authority.
AUTHORITY_TASKS = ("legal_qa", "case_search", "statute_search", "legal_research")
AUTHORITY_MARKERS = (
    "section", "statute", "act", "law", "case", "court", "appeal", "limitation", "bail", "contract",
    "constitution", "plaint", "judgment", "precedent", "ordinance", "regulation",
)

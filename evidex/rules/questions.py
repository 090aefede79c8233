"""Word lists and maps for understanding questions."""

# --- routing ------------------------------------------------------------------
# Phrases per kind of request; containment in the normalised question counts.
ROUTE_PHRASES = {
    "notice": ("legal notice", "notice", "demand notice", "send notice"),
    "plaint": ("plaint", "recovery suit", "civil suit", "draft plaint", "prepare plaint"),
    "review_table": (
        "review table", "diligence table", "extraction table", "extract clauses from all", "across all documents",
        "across all contracts", "compare all contracts", "compare these contracts", "vault review",
    ),
    "playbook": (
        "playbook review", "run playbook", "apply playbook", "against playbook", "playbook check",
        "score against playbook", "off-playbook", "off playbook",
    ),
    "redline": (
        "redline", "red line", "show redline", "compare drafts", "compare versions", "diff the contracts",
        "markup the contract",
    ),
    "contract": (
        "contract", "agreement", "nda", "lease", "employment contract", "sale agreement", "review contract",
        "contract risk", "contract analysis", "agreement review", "agreement analysis", "extract clauses",
        "clause extraction", "key terms",
    ),
    "case_analysis": (
        "analyze case", "analyse case", "case analysis", "legal strategy", "strength", "weakness", "risk",
    ),
    "case_search": (
        "judgment", "judgement", "case law", "precedent", "citation", "find case", "find judgment",
    ),
    "statute": (
        "section", "article", "ordinance", "act", "rule", "ppc", "crpc", "cpc", "constitution", "qanun", "دفعہ", "دفعه",
        "dafa", "dafaa",
    ),
    "summary": ("summarize", "summary", "summarise", "tl;dr", "brief"),
    "upload_content": (
        "problem", "issue", "identify", "identified", "author", "article", "according to", "this article",
        "the article", "the document", "this document", "in the document", "in this document", "uploaded", "attached",
        "clog", "discretion", "discusses", "argues", "contends", "what does", "what is the", "what are the",
    ),
    "general_law": (
        "what is the law", "what does the law", "under pakistan law", "under the act", "statute provides",
        "legal position", "binding authority", "case law", "precedent", "what is section", "define section",
    ),
    "mixed": (
        "reflect pakistani law", "reflect the law", "consistent with the law", "consistent with pakistani law",
        "compare with the law", "compare to the law", "compare with pakistani", "does the argument",
        "does this argument", "is this argument", "is the argument", "is the author's argument", "author's argument",
        "legally correct", "legally accurate", "binding law", "authoritative law", "actual law", "what the law says",
        "under pakistani law", "under the law",
    ),
    "mixed_subject": ("document", "article", "uploaded", "author"),
    "mixed_law": (
        "pakistani law", "the law", "statute", "binding", "precedent", "case law", "legally correct",
        "legally accurate", "correct under",
    ),
    "draft": (
        "draft a", "draft the", "drafting", "prepare a document", "prepare document", "write a notice",
        "write a plaint", "write an affidavit", "draft the document",
    ),
    "hearing": (
        "prepare for hearing", "hearing note", "hearing notes", "oral submissions", "arguments for hearing",
        "prepare arguments", "court hearing", "hearing preparation",
    ),
    "compare": (
        "compare section", "compare article", "compare provisions", "compare the provisions",
        "compare legal provisions", "compare laws", "side by side", "difference between section",
        "distinction between section",
    ),
    "web": (
        "search the internet", "search internet", "search online", "search the web", "web search", "look online",
        "look it up online", "from the internet", "on the internet", "google this", "latest judgment",
        "recent judgment", "recent case law", "current law", "latest amendment",
    ),
    "document": (
        "this document", "uploaded document", "uploaded file", "attached file", "attached document",
        "this agreement", "this contract", "this pdf", "attached agreement", "attached contract", "review this",
        "analyze this", "analyse this", "what are the issues", "find problems",
    ),
    "legal": (
        "law", "legal", "court", "judge", "lawyer", "advocate", "justice", "hearing", "judgment", "judgement",
        "fir", "fard", "challan", "remand", "bail", "anticipatory bail", "pre arrest bail", "post arrest bail",
        "arrest", "offence", "crime", "criminal", "murder", "theft", "fraud", "ضمانت", "مقدمہ", "عدالت", "قانون", "فوجداری",
        "zamanat", "zamaanat", "qanoon", "muqadma", "muqadama", "civil", "recovery", "injunction",
        "specific performance", "damages", "negligence", "limitation", "property", "tenant", "landlord",
        "inheritance", "succession", "appeal", "petition", "writ", "revision", "stay order", "katcheri", "thana",
        "wakalatnama", "evidence", "arbitration", "contract", "agreement",
    ),
}
STATUTE_PATTERN = r"\bsection\s+\d+|\barticle\s+\d+|\bs\.\s*\d+|دفعہ\s*[0-9A-Za-z\-]+|\bdafaa?\s+[0-9A-Za-z\-]+"
UPLOAD_SECTION_PATTERN = r"\bsection\s+[0-9A-Za-z\-]+"
UPLOAD_SECTION_WORDS = ("problem", "issue", "identify", "author", "article", "document")
QUESTION_OPENERS = ("what", "how", "when", "whether", "can", "is")

# Fixed actions: id, slug, title, task, web search, opening of the canned prompt.
ACTIONS = (
    (1, "draft_document", "Draft the Document", "document_draft", False,
     "Help me draft a legal document. Ask what type I need (notice, plaint, petition, affidavit, contract, or other), "
     "the parties, the material facts, and the relief sought, then draft it in professional Pakistani legal form."),
    (2, "find_authorities", "Find Legal Authorities", "case_search", True,
     "Find the governing Pakistani legal authorities for my issue. Search statutes, rules, and case law, and cite "
     "what you find. Ask me the issue, jurisdiction, and any section or citation I already have if that is missing."),
    (3, "summarize_document", "Summarize Document", "summarization", False,
     "Summarize the uploaded document. Give the key points, parties or author position, and any legal issues it "
     "raises. If no document is attached, ask me to upload one."),
    (4, "analyze_contract", "Analyze a Contract", "contract_review", False,
     "Analyze the uploaded contract. Identify material clauses, obligations, termination, liability, and legal risks "
     "under Pakistani law. Extract key terms as structured clause cards. If no contract is attached, ask me to upload "
     "one or paste the clauses to review."),
    (5, "prepare_hearing", "Prepare for Hearing", "hearing_prep", False,
     "Help me prepare for a hearing. Build a structured note with the issues, facts to prove, supporting authorities, "
     "likely objections, and oral submissions. Ask for the forum, stage, and my client's position if those are missing."),
    (6, "compare_provisions", "Compare Legal Provisions", "compare_provisions", True,
     "Compare the legal provisions I name side by side. Explain overlap, differences, which provision prevails, and "
     "how a Pakistani court would apply them. Ask which sections, articles, or statutes to compare if I have not named "
     "them yet."),
    (7, "review_table", "Review Table", "review_table", False,
     "Build a review table across every uploaded contract in this matter. Extract parties, dates, governing law, "
     "liability, termination, and the other standard terms into a grid, one row per document."),
    (8, "playbook_review", "Playbook Review", "playbook_review", False,
     "Run a playbook review on the uploaded contract using the standard Pakistani commercial positions. Flag missing, "
     "off-playbook, and fallback terms, and suggest language."),
    (9, "redline", "Redline", "redline", False,
     "Build a redline. If two documents are uploaded, compare the newer against the older. If only one is uploaded, "
     "redline it against the playbook suggested language."),
)
# Further titles that name an action.
ACTION_ALIASES = {
    "find legal authorties": "find_authorities", "sumarized document": "summarize_document",
    "summarized document": "summarize_document", "compare laws side by side": "compare_provisions",
    "compare laws": "compare_provisions", "build a review table": "review_table", "diligence table": "review_table",
    "extract clauses from all documents": "review_table", "run playbook": "playbook_review",
    "apply playbook": "playbook_review", "show redline": "redline", "compare drafts": "redline",
}
PROMPT_TAILS = (" ask me ", " ask for ", " if no document", " if no contract", " if those are missing")

# --- complexity -----------------------------------------------------------------
# Fixed values.
SIMPLE_PATTERNS = (
    r"^what is section\s+[0-9A-Za-z\-]+\??$", r"^define section\s+[0-9A-Za-z\-]+\??$",
    r"^what does section\s+[0-9A-Za-z\-]+\s+(?:say|provide|state)\??$", r"^explain section\s+[0-9A-Za-z\-]+\.?$",
    r"^summarize (?:this|the) (?:document|article|clause)\.?$",
)
COMPLEX_MARKERS = (
    "double jeopardy", "conflict", "contradict", "compare", "legally correct", "reflect pakistani law",
    "reflect the law", "consistent with", "clog on judicial discretion", "judicial discretion",
    "can it be challenged", "can this be challenged", "whether the argument", "is the argument", "does the argument",
    "multiple sources", "conflicting", "exception", "exceptions", "in the context of", "where the consumer",
    "where the plaintiff", "where the defendant",
)
RESEARCH_MARKERS = (
    "effect of", "impact of", "application of", "apply to", "apply in", "prevent", "allow", "bar", "permit",
    "scope of", "interpretation", "interpret", "relationship between", "distinction between", "difference between",
    "when can", "when does", "under what circumstances", "how does", "what is the effect", "what is the law on",
    "what is the legal position", "legal assessment", "legal position",
)
FOLLOW_UP_PHRASES = ("can it", "can this", "what about", "how about", "does that", "does this")
COMPLEXITY_CONCEPTS = (
    "injunction", "double jeopardy", "bail", "appeal", "limitation", "discretion", "clog", "contract", "negligence",
    "murder", "precedent", "judgment", "statute", "constitution", "specific performance", "arbitration", "maintenance",
    "defamation", "possession", "recovery", "ضمانت", "zamanat",
)
COMPLEXITY_SECTION = r"(?:\b(?:section|article|u/s)\s+|دفعہ\s*)([0-9A-Za-z\-]+)"
COMPLEX_TASKS = (
    "case_analysis", "mixed_qa", "contract_review", "hearing_prep", "compare_provisions", "review_table",
    "playbook_review", "redline",
)

# --- plan -----------------------------------------------------------------------
# Fixed values.
SECTION_PATTERN = r"(?:\b(?:section|sec\.?|u/s|article)\s+|دفعہ\s*|\bdafaa?\s+)([0-9A-Za-z\-]+)"
CASE_PATTERN = r"\b(?:PLD|SCMR|MLD|YLR|CLC|PCr\.LJ)\s+\d{4}\s+[A-Za-z]+\s+\d+"
COURT_PATTERN = (
    r"\b(?:supreme court|lahore high court|sindh high court|islamabad high court|peshawar high court|"
    r"balochistan high court|federal shariat court)\b"
)
AREAS = {
    "criminal": ("bail", "fir", "murder", "ppc", "crpc", "criminal", "ضمانت", "zamanat", "zamaanat"),
    "civil": ("injunction", "specific performance", "cpc", "civil", "recovery"),
    "constitutional": ("constitution", "writ", "fundamental rights"),
    "family": ("maintenance", "inheritance", "family", "nikah"),
    "commercial": ("contract", "arbitration", "company", "banking"),
    "energy": ("electricity", "wapda", "54-c", "54 c"),
}
JURISDICTIONS = ("punjab", "sindh", "khyber pakhtunkhwa", "balochistan", "islamabad", "pakistan")
ENTITY_WORDS = (
    "double jeopardy", "injunction", "discretion", "clog", "bail", "appeal", "limitation", "ضمانت", "zamanat", "zamaanat",
)
STATUTES = (
    ("electricity act", "Electricity Act, 1910"), ("pakistan penal code", "Pakistan Penal Code"),
    ("ppc", "Pakistan Penal Code"), ("crpc", "Code of Criminal Procedure"), ("cpc", "Code of Civil Procedure"),
    ("constitution", "Constitution of Pakistan"), ("limitation act", "Limitation Act"),
    ("contract act", "Contract Act"),
)
ANSWER_MODES = {
    "summarization": "summarization", "mixed_qa": "mixed_legal_analysis", "document_qa": "document_qa",
    "legal_notice": "drafting", "plaint": "drafting", "contract_review": "drafting", "document_draft": "drafting",
    "hearing_prep": "hearing_prep", "compare_provisions": "compare_provisions", "review_table": "review_table",
    "playbook_review": "playbook_review", "redline": "redline", "legal_qa": "legal_research",
    "case_search": "legal_research", "statute_search": "legal_research", "case_analysis": "legal_research",
}
PINNABLE_TASKS = (
    "summarization", "document_qa", "mixed_qa", "contract_review", "review_table", "playbook_review", "redline",
)
UPLOAD_MODES = ("document_qa", "summarization", "review_table", "playbook_review", "redline")
AUTHORITY_MODES = (
    "legal_research", "mixed_legal_analysis", "general_legal_qa", "hearing_prep", "compare_provisions",
)

# --- rewrite ----------------------------------------------------------------------
# Applied in this order.
ABBREVIATIONS = (
    ("ppc", "Pakistan Penal Code"), ("crpc", "Code of Criminal Procedure"), ("cpc", "Code of Civil Procedure"),
    ("qso", "Qanun-e-Shahadat Order"), ("ica", "Contract Act"), ("limitation act", "Limitation Act"),
    ("constitution", "Constitution of Pakistan"), ("cp", "Constitution Petition"),
)
FILTER_COURTS = (
    "supreme court", "lahore high court", "sindh high court", "islamabad high court", "balochistan high court",
    "peshawar high court", "federal shariat court",
)
LEGAL_TERMS = (
    "murder", "theft", "bail", "contract", "negligence", "inheritance", "appeal", "injunction", "recovery",
    "specific performance", "arbitration", "limitation", "constitutional petition",
)
TASK_KEYWORDS = {
    "legal_qa": "Pakistan law statutes legal provisions case law",
    "case_search": "judgment precedent court decision case law",
    "statute_search": "act ordinance statute section legal provision",
    "plaint": "cause of action jurisdiction relief prayer",
    "legal_notice": "formal notice demand notice legal communication",
    "document_draft": "legal draft format parties facts relief prayer",
    "hearing_prep": "hearing issues oral submissions authorities objections",
    "compare_provisions": "compare sections articles provisions difference",
    "contract_review": "contract clause risk obligation termination liability",
    "summarization": "key points summary issues parties",
}

# --- conversation -------------------------------------------------------------------
# Fixed values.
CONTEXT_SECTION = r"\b(?:section|sec\.?|u/s|article)\s+([0-9A-Za-z\-]+)"
CONTEXT_STATUTE = (
    r"\b(?:[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+Act(?:,?\s*\d{4})?|PPC|CrPC|CPC|Qanun-e-Shahadat)\b"
)
CONTEXT_ISSUE = (
    r"\b(clog|discretion|double jeopardy|injunction|bail|limitation|appeal|negligence|contract|inheritance|unreasonableness)\b"
)
CONTEXT_DOCUMENT = r"\b(?:[A-Za-z0-9_\- ]+\.(?:txt|pdf|docx)|CLOG ON DISCRETION)\b"
FOLLOW_UP_OPENING = (
    r"^(?:what about|how about|and what|does this apply|what if|which section|show me where|compare this|and for|"
    r"does that apply|what happens if|can it be|can this be|can that be|is it|is this|"
    r"what(?:'s| is| are| was| were)? (?:this|that|it|these|those)|what does (?:this|that|it) mean|what do you mean|"
    r"explain (?:this|that|it|more|further)|tell me more|clarify|elaborate|in (?:simple|plain) words|simplify|same for|"
    r"and (?:this|that)|yeh? kya hai|ye kia hai|iska matlab|uska matlab|aur batao|thora detail)\b"
)
EXPLICIT_INTENT = (
    r"\b(?:under the|pursuant to|according to|in punjab|in sindh|in khyber|in balochistan|limitation act|penal code|"
    r"constitution of pakistan|code of criminal procedure|code of civil procedure|contract act|family law|"
    r"specific performance|qanun-e-shahadat)\b"
)
TOPIC_PATTERN = (
    r"\b(?:section|article|u/s)\s+[0-9A-Za-z\-]+|\b(?:limitation|appeal|bail|murder|contract|negligence|inheritance|"
    r"injunction|recovery|arbitration|constitutional petition|specific performance|limitation period|double jeopardy|"
    r"discretion|unreasonableness|clog|54-c|54 c|sections?|articles?|clauses?|provisions?|statute|legislation)\b"
)
POINTING_WORDS = r"\b(?:this|that|it|these|those|above|previous|yeh?|ye|woh|iska|uska|matlab)\b"
EXPLAIN_OPENING = (
    r"^(?:what(?:'s| is| are| was| were)? (?:this|that|it)\b|what does (?:this|that|it) mean|explain (?:this|that|it)|"
    r"yeh? kya hai|ye kia hai|iska matlab)"
)

# --- titles -----------------------------------------------------------------------------
# Fixed values.
TITLE_PREFIXES = (
    "what is", "what are", "how to", "how do i", "how can i", "can i", "can you", "could you", "would you", "please",
    "kindly", "tell me", "explain", "give me", "show me", "help me",
)
TITLE_STOPWORDS = "a an the of about regarding please kindly me my is are was were".split()
TITLE_TERMS = {
    "ppc": "PPC", "crpc": "CrPC", "cpc": "CPC", "qso": "QSO", "fir": "FIR", "firs": "FIRs",
    "constitution": "Constitution",
}

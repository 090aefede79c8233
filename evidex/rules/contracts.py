"""Clause fields and the standard playbook."""

# Key, label and question of the default fields.
FIELDS = (
    ("parties", "Parties", "Who are the contracting parties (legal names and roles)?"),
    ("effective_date", "Effective date", "What is the effective date or commencement date?"),
    ("term", "Term", "What is the term or duration of the agreement?"),
    ("governing_law", "Governing law", "Which law governs the agreement?"),
    ("dispute_resolution", "Dispute resolution", "How are disputes resolved (court, arbitration, seat, forum)?"),
    ("payment", "Payment", "What are the payment, fee, or consideration terms?"),
    ("liability_cap", "Liability cap", "Is there a limitation of liability or cap on damages?"),
    ("indemnity", "Indemnity", "What indemnity or hold-harmless obligations exist, and who bears them?"),
    ("termination", "Termination", "How can the agreement be terminated, and on what notice?"),
    ("renewal", "Renewal", "Is there renewal or auto-renewal, and on what terms?"),
    ("confidentiality", "Confidentiality", "What confidentiality or non-disclosure obligations apply?"),
    ("assignment", "Assignment", "Can rights or obligations be assigned, and with whose consent?"),
)
MAX_CUSTOM_FIELDS = 8
REVIEW_DOCUMENTS = 20
# Statuses of an extracted clause, and spellings of an empty value.
STATUSES = ("found", "missing", "unclear", "error")
EMPTY_VALUES = ("", "null", "none", "n/a", "na", "-")

# The standard playbook.
PLAYBOOK = (
    {"key": "parties", "required": True, "severity": "blocker", "notes": "Must identify both contracting parties.",
     "suggested": "This Agreement is made between [Party A], a company incorporated in Pakistan (“Party A”), and "
                  "[Party B] (“Party B”)."},
    {"key": "effective_date", "required": True, "severity": "warning",
     "suggested": "This Agreement takes effect on [date] (the “Effective Date”)."},
    {"key": "term", "required": True, "severity": "warning",
     "suggested": "This Agreement shall continue for a term of [period] from the Effective Date, unless terminated "
                  "earlier in accordance with its terms."},
    {"key": "governing_law", "required": True, "severity": "blocker",
     "accept": ["pakistan", "islamic republic of pakistan"],
     "reject": ["delaware", "england and wales", "laws of england", "new york", "singapore law", "california"],
     "notes": "Foreign exclusive governing law is off-playbook.",
     "suggested": "This Agreement shall be governed by and construed in accordance with the laws of Pakistan."},
    {"key": "dispute_resolution", "required": True, "severity": "blocker",
     "accept": ["pakistan", "islamabad", "lahore", "karachi", "sindh", "punjab", "high court", "supreme court",
                "arbitration in pakistan"],
     "fallback": ["arbitration", "mediation"],
     "reject": ["exclusive jurisdiction of the courts of england", "courts of new york", "delaware courts"],
     "suggested": "Any dispute arising out of this Agreement shall be referred to the competent courts at [Islamabad / "
                  "Lahore / Karachi], or to arbitration seated in Pakistan under the Arbitration Act, 1940."},
    {"key": "payment", "required": True, "severity": "warning",
     "suggested": "In consideration of the services, [paying party] shall pay [amount] within [days] days of invoice, "
                  "in Pakistani Rupees, without set-off except as required by law."},
    {"key": "liability_cap", "required": True, "severity": "blocker",
     "accept": ["cap", "capped", "limited to", "not exceed", "maximum", "limitation of liability"],
     "reject": ["unlimited liability", "uncapped", "no limitation of liability", "liability shall be unlimited"],
     "notes": "Unlimited liability is off-playbook.",
     "suggested": "Subject to liability that cannot be limited by law, each party’s aggregate liability under this "
                  "Agreement shall not exceed the fees paid in the [twelve] months preceding the claim."},
    {"key": "indemnity", "required": False, "severity": "warning",
     "reject": ["unlimited indemnity", "indemnify for all losses whatsoever", "without limit"],
     "suggested": "Each party shall indemnify the other against third-party claims arising from its breach or "
                  "negligence, subject to the limitation of liability in this Agreement."},
    {"key": "termination", "required": True, "severity": "warning", "accept": ["terminate", "termination", "notice"],
     "suggested": "Either party may terminate this Agreement for convenience on [30] days’ written notice, and "
                  "immediately for material breach that remains unremedied [15] days after notice."},
    {"key": "renewal", "required": False, "severity": "warning",
     "reject": ["automatic renewal without notice", "auto-renew without notice", "perpetual"],
     "suggested": "This Agreement shall not renew automatically. Any renewal requires a written instrument signed by "
                  "both parties."},
    {"key": "confidentiality", "required": True, "severity": "warning",
     "accept": ["confidential", "non-disclosure", "non disclosure", "nda"],
     "suggested": "Each party shall keep the other’s confidential information in confidence for [three] years after "
                  "expiry or termination, and use it only to perform this Agreement."},
    {"key": "assignment", "required": False, "severity": "warning",
     "accept": ["prior written consent", "written consent", "consent of the other", "shall not assign"],
     "reject": ["freely assign", "assign without consent", "may assign this agreement without"],
     "suggested": "Neither party may assign this Agreement without the prior written consent of the other, except to "
                  "an affiliate or in connection with a solvent reorganization."},
)

# Reasons given with a verdict.
REASONS = {
    "no_card": "This term could not be extracted.",
    "unclear": "Extraction was unclear; lawyer review required.",
    "missing": "Required term is not in the document.",
    "absent": "Optional term is absent.",
    "rejected": "Contains language the playbook rejects.",
    "preferred": "Aligns with the preferred position.",
    "fallback": "Uses an acceptable fallback, not the preferred position.",
    "other": "Present, but does not match preferred or fallback language.",
    "present": "Term is present.",
}

# Fixed patterns: reasoning a model puts before its output, and an object in a code fence.
REASONING = r"(?is)<think>.*?</think>"
FENCED_OBJECT = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"

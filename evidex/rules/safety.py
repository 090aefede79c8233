"""Wordings the screening rules look for."""

# Patterns are matched ignoring case on the normalised message.
PROGRAMMING_LANGUAGE = (
    r"\b(?:python|javascript|typescript|nodejs|node\.js|java|golang|c\+\+|c#|csharp|ruby|php|rust|kotlin|swift|"
    r"scala|perl|haskell|matlab|django|flask|fastapi|laravel)\b"
)
CODE_REQUEST = (
    r"\b(?:write|generate|create|debug|fix|implement|compile|refactor|optimize)\b.{0,40}\b(?:code|script|function|"
    r"algorithm|source code|computer program|snippet|regex|unit test)\b"
    r"|\b(?:code|script|function|algorithm|source code|computer program|snippet)\b.{0,40}\b"
    r"(?:write|generate|create|debug|fix|implement)\b"
    r"|\b(?:leetcode|hackerrank|programming assignment|coding challenge|pull request)\b"
    r"|```(?:python|javascript|js|ts|typescript|java|cpp|c\+\+|go|rust|ruby|php|bash|sh|sql|html|css|json)\b"
)
LANGUAGE_CODE_REQUEST = (
    r"\b(?:write|generate|create|debug|fix|implement|run)\b.{0,30}\b(?:python|javascript|typescript|java|golang|ruby|"
    r"php|rust|kotlin|swift|sql|html|css|react|django|flask)\b"
    r"|\b(?:python|javascript|typescript|java|golang|ruby|php|rust|kotlin|swift)\b.{0,30}\b"
    r"(?:code|script|function|program|class|snippet)\b"
    r"|\bin (?:python|javascript|typescript|java|golang|c\+\+|rust|php|ruby|sql)\b"
)
LEGAL_CODE = (
    r"\b(?:penal code|pakistan penal code|code of civil procedure|code of criminal procedure|criminal procedure code|"
    r"civil procedure code|qanun[\-\s]?e[\-\s]?shahadat|building bye[\-\s]?laws|code of conduct|ppc|crpc|cpc|qso)\b"
)
CRIME_HELP = (
    r"\bhow (?:to|do i|can i|would i|could i) (?:kill|murder|poison|shoot|stab|strangle)(?! (?:a |the )?case)\b"
    r"|\b(?:kill|murder|poison) (?:him|her|them|someone|somebody|a person|people|my (?:wife|husband|neighbour|neighbor))\b"
    r"|\bhow .{0,50}get away with (?:murder|it|the crime|this)\b"
    r"|\bhow .{0,50}without (?:getting )?caught\b"
    r"|\bhow .{0,50}hide (?:the )?body\b"
    r"|\bhow .{0,50}(?:destroy|tamper with) (?:the )?(?:evidence|cctv)\b"
    r"|\b(?:make|build|assemble) (?:a |an )?(?:bomb|explosive|ied|molotov)\b"
    r"|\bhow (?:to|do i|can i) hack\b"
    r"|\bhack into\b"
    r"|\bhow (?:to|do i|can i) (?:steal|rob|kidnap|launder|counterfeit|evade (?:the )?police)\b"
    r"|\b(?:write|create|draft) (?:a |an )?(?:fake|forged|false) (?:fir|affidavit|passport|cnic|degree)\b"
    r"|\b(?:file|register|lodge) (?:a |an )?(?:fake|false|forged) (?:fir|case|complaint)\b"
    r"|\bhow (?:to|do i|can i) launder (?:money|funds|cash)\b"
    r"|\bkisi ko (?:kaise )?maar|\bqatl kaise\b|\bbaghair pakr|\bbina pakde\b|\bbina pakray\b"
)
OVERRIDE = (
    r"\bignore (?:all |your |the )?(?:previous |prior |above )?instructions\b"
    r"|\byou are now\b.{0,40}\b(?:dan|jailbreak|unfiltered|unrestricted)\b"
    r"|\b(?:developer mode|jailbreak|dan mode)\b"
    r"|\bpretend (?:you are|you're) (?:not )?(?:a |an )?(?:legal|lawyer)\b"
    r"|\breveal (?:your )?(?:system )?prompt\b"
    r"|\bdo not follow (?:your )?(?:rules|guidelines|restrictions)\b"
    r"|\bignore (?:your |the )?(?:rules|restrictions|safety)\b"
    r"|\b(?:pehle|purani) (?:instructions|hidayaat) ignore\b"
    r"|\binstructions ignore karo\b"
    r"|\bpretend (?:you are|you're) (?:a |an )?(?:dan|hitman|criminal|unfiltered|unrestricted)(?: (?:ai|bot|model))?\b"
    r"|\brole[\s\-]?play (?:as |being )?(?:a |an )?(?:dan|hitman|criminal|unfiltered)\b"
    r"|\bact as (?:if you (?:are|were) )?(?:a |an )?(?:dan|jailbreak|unfiltered|unrestricted)\b"
)
OFF_TOPIC = (
    r"\b(?:weather|forecast|temperature today|rain today)\b"
    r"|\b(?:recipe|cook|cooking|ingredients for)\b"
    r"|\b(?:cricket score|football score|match score|who won the|premier league|psl score|world cup)\b"
    r"|\b(?:netflix|movie recommendation|tell me a joke|tell a joke|riddle|horoscope|zodiac)\b"
    r"|\b(?:write (?:a |me )?(?:poem|song|story|novel|essay on))\b"
    r"|\b(?:solve (?:this )?(?:equation|integral|derivative)|calculus homework|math homework)\b"
    r"|\b(?:bitcoin price|crypto price|stock price of)\b"
)
GREETING = (
    r"^\s*(?:hi|hello|hey|salam|salaam|assalam|assalamu alaikum|aoa|thanks|thank you|shukriya|ok|okay|yes|no|continue|"
    r"who are you|what (?:can|do) you (?:do|help with)|help|help me)[\s!.?]*$"
)
FOLLOW_UP = (
    r"^\s*(?:and(?: then)?\??|what about.{0,80}|explain(?: more)?|more detail(?:s)?|continue|go on|yes|please explain|"
    r"in (?:punjab|sindh|islamabad|kpk|balochistan|pakistan)\??|aur\??|phir\??|mazid|مزید|اور کیا|پھر کیا)\s*$"
)
SHORT_REPLIES = ("ok", "okay", "yes", "continue", "go ahead", "do it")
POINTING = (
    r"\bwhat(?:'s|\s+is|\s+are|\s+was|\s+were)?\s+(?:this|that|it|these|those)\b"
    r"|\bwhat\s+does\s+(?:this|that|it)\s+mean\b|\bwhat\s+do\s+you\s+mean\b"
    r"|\bexplain\s+(?:this|that|it|more|further)\b|\bclarify(?:\s+(?:this|that|it))?\b"
    r"|\belaborate(?:\s+(?:on\s+)?(?:this|that|it))?\b|\btell\s+me\s+more\b|\bin\s+(?:simple|plain)\s+words\b"
    r"|\bsimplify(?:\s+(?:this|that|it))?\b|\bsame\s+for\b|\band\s+(?:this|that)\b|\b(?:this|that|it|these|those)\b"
    r"|\b(?:yeh?|ye)\s+kya\s+hai\b|\b(?:is|iska|uska)\s+(?:ka\s+)?matlab\b|\baur\s+batao\b"
    r"|\bthora\s+(?:aur\s+)?(?:detail|samjhao)\b|\bmazid\b|\b(?:فوق|یہ کیا ہے|اس کا مطلب)\b"
)
POINTING_VERBS = r"\b(?:what|why|how|explain|clarify|mean|matlab|kya|simplify|elaborate)\b"
CITED_SECTION = r"\b(?:section|sec\.?|article|u/s|دفعہ)\s+[0-9a-z\-]+|\bdafaa?\s+[0-9a-z\-]+"
CITED_CASE = r"\b(?:PLD|SCMR|MLD|YLR|CLC|PCr\.LJ)\s+\d{4}\b"
CONCEPT_QUESTION = (
    r"\b(?:what\s+(?:is|are|does|do)|what(?:'s| is)\s+meant|meaning\s+of|difference\s+between|explain|define|"
    r"definition\s+of)\b.{0,80}\b(?:section|sections|article|articles|clause|clauses|provision|provisions|statute|"
    r"statutes|act|acts|ordinance|code|codes|law|laws|schedule|chapter|preamble|legislation)\b"
)
FENCED_CODE_OUTPUT = (
    r"```(?:python|javascript|js|ts|typescript|java|cpp|c\+\+|go|rust|ruby|php|bash|sh|sql|html|css)\b"
)
CODE_LINE_OUTPUT = (
    r"(?:^|\n)(?:def |async def |function |import |from \w+ import |public static void |console\.log\(|SELECT \*|DROP TABLE )"
)
SECRET_OUTPUT = (
    r"sk-[A-Za-z0-9]{12,}|AIza[0-9A-Za-z\-_]{20,}|api[_-]?key\s*[:=]\s*\S+|SECRET_KEY\s*[:=]\s*\S+|Bearer [A-Za-z0-9\-._]{20,}"
)
INJECTION_LINE = (
    r"^[ \t]*(?:ignore (?:all |previous |prior )?(?:instructions|rules).*|you are now .{0,80}"
    r"|reveal (?:your )?(?:system )?prompt.*|developer mode.*|do not follow (?:your )?(?:rules|guidelines).*)"
)
INJECTION_NOTICE = "[instruction omitted from evidence]"

# Urdu phrases.
URDU_CODE = ("کوڈ لکھو", "پروگرام لکھو", "پائتھن", "پائيثن")
URDU_CRIME = ("قتل کیسے", "بم کیسے", "ہیک کیسے", "کسے ماروں", "کسی کو مار")
URDU_OFF_TOPIC = ("موسم کیسا", "کھانا کیسے", "جوک سناؤ")

# Words that make a message legal.
LEGAL_WORDS = """law legal laws rights liability jurisdiction tribunal pakistan pakistani ppc crpc cpc qanoon qanun
court judge lawyer advocate justice hearing judgment judgement statute section sections article articles clause clauses
provision provisions subsection sub-section schedule chapter preamble legislation legislative statutory enactment
regulation regulations by-law bylaw bye-law jurisprudence doctrine ordinance constitution precedent citation citations
gazette notification codified uncodified penal procedural substantive plaint petition appeal revision writ injunction
limitation contract agreement affidavit vakalatnama wakalatnama notice fir challan remand bail arrest offence offense
accused complainant plaintiff defendant respondent petitioner witness evidence testimony prosecution defence defense
conviction acquittal sentence punishment damages arbitration mediation inheritance succession tenant landlord property
divorce khula talaq maintenance custody dowry mehr waqf pre-emption shufa qisas diyat hudood estoppel habeas mandamus
certiorari prohibition replication katcheri thana qso pld scmr mld ylr clc peca infructuous parties muqadma muqadama
zamanat zamaanat dafa dafaa kachehri vakalat case""".split()
LEGAL_PHRASES = (
    "stay order", "title deed", "sale deed", "gift deed", "power of attorney", "double jeopardy", "res judicata",
    "mens rea", "actus reus", "quo warranto", "natural justice", "locus standi", "cause of action", "class action",
    "written statement", "issues framed", "pakistan penal code", "penal code", "civil procedure", "criminal procedure",
    "cyber crime", "money laundering", "anti money laundering", "this case", "my case", "this matter", "the case",
    "the matter", "uploaded document", "this document", "the document", "the article", "the plaint", "the fir",
    "kill a case", "next date", "next hearing",
    "قانون", "عدالت", "مقدمہ", "ضمانت", "دفعہ", "فوجداری", "دیوانی", "وکالت",
)
# Words that make a message about the facts of a case.
FACT_WORDS = """plaintiff defendant accused complainant petitioner respondent witness party parties fir hearing facts
incident allegation uploaded attached filed suit claim prayer""".split()
FACT_PHRASES = (
    "next date", "this case", "my case", "this matter", "the document", "the article", "the plaint", "according to",
    "relief sought", "cause of action",
)

# Keys whose values are never logged.
SENSITIVE_KEYS = (
    r"(?i)password|passwd|secret|token|authorization|api[_-]?key|refresh[_-]?token|access[_-]?token|credential|"
    r"private[_-]?key|password_hash|client_secret"
)
REDACTED = "[REDACTED]"

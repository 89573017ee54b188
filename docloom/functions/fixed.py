"""Tables and patterns that results depend on, as given."""

# Fixed values: (pattern, language), first match wins, else DEFAULT_LANGUAGE.
LANGUAGE_PATTERNS = (
    (r"[_\-](ENG)\b", "en"),
    (r"[_\-](Spanish|SP|ES)\b", "es"),
    (r"[_\-](CHINESE|CHN|CH)\b", "zh"),
    (r"[_\-](KOREAN|KO|KR|K)\b", "ko"),
    (r"[_\-](TAGALOG|TGL|TG|TL)\b", "tl"),
    (r"[_\-](VIETNAMESE|VIE|VT|VI)\b", "vi"),
    (r"[_\-](PUNJABI|PA)\b", "pa"),
    (r"[_\-](ARABIC)\b", "ar"),
    (r"[_\-](FARSI)\b", "fa"),
    (r"[_\-](HMONG)\b", "hmn"),
    (r"[_\-](MIXTECO)\b", "mix"),
    (r"[_\-](Armenian)\b", "hy"),
    (r"[_\-](Hindi)\b", "hi"),
    (r"[_\-](Japanese)\b", "ja"),
    (r"[_\-](Khmer)\b", "km"),
    (r"[_\-](Russian)\b", "ru"),
    (r"[_\-](Thai)\b", "th"),
)
DEFAULT_LANGUAGE = "en"

# Characters replaced before anything else is cleaned.
CHARACTERS = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2013": "-",
    "\u2014": " - ",
    "\u2026": "...",
    "\u00a0": " ",
    "\u200b": "",
    "\ufeff": "",
}
# UTF-8 read in the wrong encoding.
MOJIBAKE = {
    "\xc3\xa2\xe2\x82\xac\xe2\x84\xa2": "'",
    "\xc3\xa2\xe2\x82\xac\xe2\x80\x9c": "-",
    "\xc3\xa2\xe2\x82\xac\xc5\x93": '"',
}
# Boilerplate removed by default.
BOILERPLATE = (
    r"(?i)Skip to (?:Main )?Content\s*",
    r"(?m)^\s*Search\s*$",
    r"(?m)^\s*Menu\s*$",
    r"(?m)^\s*Close\s*$",
    r"(?im)(?:Sacramento|CA\s+\d{5})[\s\S]*?(?:800-884-1684|contact\.center@calcivilrights\.ca\.gov)[\s\S]*?(?:711|relay\s+service).*$",
    r"(?im)(?:We use cookies|cookie policy|privacy policy).*$",
)

# Words of which a text must have one for a pattern to match; small letters stand for either case.
BOILERPLATE_WORDS = dict(zip(BOILERPLATE, (("skip to ",), ("Search",), ("Menu",), ("Close",), ("800-884-1684", "contact.center@calcivilrights.ca.gov"), ("we use cookies", "cookie policy", "privacy policy"))))
# Ranges (of a pattern's class) of characters that NFC neither changes, nor moves, nor joins to the one before.
NFC_SAFE = r"\x{0}-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{2002}-\x{20CF}\x{3001}-\x{3029}\x{3030}-\x{3098}\x{309B}-\x{9FFF}\x{AC00}-\x{D7A3}\x{1F000}-\x{1FAFF}"

# Signs of an attempt to override instructions, first match wins.
INJECTION = (
    r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|directions?)",
    r"(?i)ignore\s+everything\s+(above|before|previously)",
    r"(?i)disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|directions?)",
    r"(?i)forget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|directions?)",
    r"(?i)you\s+are\s+now\s+(a|an|the)\s+",
    r"(?i)new\s+(system\s+)?instructions?:\s*",
    r"(?i)system\s*:\s*you\s+are",
    r"(?i)\bDAN\s+mode\b",
    r"(?i)\bjailbreak\b",
    r"(?i)do\s+anything\s+now",
    r"(?i)(reveal|show|print|output|repeat|display)\s+(me\s+)?(your|the)\s+(system\s+)?(prompt|instructions?|rules?)",
    r"(?i)what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?)",
)

# Citations in a question, first pattern wins; groups are named by the pair (code, section).
QUERY_CITATIONS = (
    (r"(?i)(?:Cal\.?\s+)?(Lab(?:or)?|Gov(?:ernment)?|Bus(?:iness)?(?:\s+(?:&|and)\s+Prof(?:essions)?)?|Civ(?:il)?(?:\s+Proc(?:edure)?)?|Unemp(?:loyment)?(?:\s+Ins(?:urance)?)?|CCP|UIC|BPC)\.?\s*(?:Code)?\s*(?:§+|[Ss]ec(?:tion)?\.?)\s*([\d]+(?:\.\d+)?(?:\([a-z0-9]+\))*)", 1, 2),
    (r"(?i)[Ss]ec(?:tion)?\.?\s+([\d]+(?:\.\d+)?(?:\([a-z0-9]+\))*)", 0, 1),
    (r"(?i)§+\s*([\d]+(?:\.\d+)?(?:\([a-z0-9]+\))*)", 0, 1),
    (r"(?i)\b(?:FEHA|feha)\b", 0, 0),
    (r"(?i)\b12940\b", 0, 0),
)
# Names of codes in questions.
CODE_NAMES = {
    "lab": "Lab. Code",
    "labor": "Lab. Code",
    "gov": "Gov. Code",
    "government": "Gov. Code",
    "bus": "Bus. & Prof. Code",
    "business": "Bus. & Prof. Code",
    "bpc": "Bus. & Prof. Code",
    "civ": "CCP",
    "civil": "CCP",
    "ccp": "CCP",
    "unemp": "Unemp. Ins. Code",
    "unemployment": "Unemp. Ins. Code",
    "uic": "Unemp. Ins. Code",
}

# Factors of a score by category, in the mode for professionals.
CATEGORY_BOOSTS = {
    "statutory_code": 1.2,
    "jury_instruction": 1.3,
    "regulation": 1.2,
    "case_law": 1.25,
    "opinion_letter": 1.15,
    "enforcement_manual": 1.1,
    "federal_guidance": 1.1,
}
CITATION_BOOST = 2.0
EXACT_CITATION_BOOST = 2.0

# Fixed values: (claim type, ordinal, name, entity, days, months, years).
DEADLINES = (
    ("feha_discrimination", 0, "CRD Complaint", "Civil Rights Department (CRD)", None, None, 3),
    ("feha_discrimination", 1, "EEOC Charge", "EEOC", 300, None, None),
    ("feha_discrimination", 2, "Civil Suit (Right-to-Sue)", "Superior Court", None, None, 4),
    ("wage_theft", 0, "DLSE / Labor Commissioner Claim", "Labor Commissioner (DLSE)", None, None, 3),
    ("wage_theft", 1, "Court Action — Oral Agreement", "Superior Court", None, None, 2),
    ("wage_theft", 2, "Court Action — Written Agreement", "Superior Court", None, None, 4),
    ("wage_theft", 3, "UCL (Unfair Business Practices)", "Superior Court", None, None, 4),
    ("wage_theft", 4, "PAGA Notice (Wage Violations)", "LWDA", None, None, 1),
    ("wrongful_termination", 0, "Tort Claim (Public Policy)", "Superior Court", None, None, 2),
    ("wrongful_termination", 1, "Breach of Oral Contract", "Superior Court", None, None, 2),
    ("wrongful_termination", 2, "Breach of Written Contract", "Superior Court", None, None, 4),
    ("retaliation_whistleblower", 0, "Court Action (Lab. Code §1102.5)", "Superior Court", None, None, 3),
    ("retaliation_whistleblower", 1, "DLSE Retaliation Complaint", "Labor Commissioner (DLSE)", None, 6, None),
    ("paga", 0, "LWDA Notice", "LWDA", None, None, 1),
    ("paga", 1, "Court Filing After LWDA Notice", "Superior Court", 430, None, None),
    ("cfra_family_leave", 0, "CRD Complaint", "Civil Rights Department (CRD)", None, None, 3),
    ("cfra_family_leave", 1, "EEOC Charge (FMLA Cross-File)", "EEOC", 300, None, None),
    ("government_employee", 0, "Government Tort Claim", "Government Agency", None, 6, None),
    ("government_employee", 1, "Court Action After Claim Denial", "Superior Court", None, 12, None),
    ("misclassification", 0, "DLSE Misclassification Complaint", "Labor Commissioner (DLSE)", None, None, 3),
    ("misclassification", 1, "Court Action — Unpaid Wages", "Superior Court", None, None, 3),
    ("misclassification", 2, "UCL (Unfair Business Practices)", "Superior Court", None, None, 4),
)

# Headings of numbered requests by kind; a pattern's group is the number. Each fits one line.
REQUEST_HEADINGS = {
    "interrogatories": (
        r"(?i)^\s*(?:SPECIAL\s+)?INTERROGATOR(?:Y|IES)\s+(?:NO\.?\s*)?(\d+)\s*(?:[:.)\s]|$)",
        r"(?i)^\s*SROG\s+(?:NO\.?\s*)?(\d+)\s*(?:[:.)\s]|$)",
    ),
    "rfps": (
        r"(?i)^\s*(?:REQUEST\s+FOR\s+PRODUCTION\s+(?:OF\s+DOCUMENTS?\s+)?|DEMAND\s+(?:FOR\s+(?:INSPECTION|PRODUCTION)\s+(?:OF\s+DOCUMENTS?\s+)?)?)(?:NO\.?\s*)?(\d+)\s*(?:[:.)\s]|$)",
        r"(?i)^\s*(?:RFP|RFPD|DEMAND)\s+(?:NO\.?\s*)?(\d+)\s*(?:[:.)\s]|$)",
        r"(?i)^\s*REQUEST\s+(?:NO\.?\s*)?(\d+)\s*(?:[:.)\s]|$)",
    ),
    "rfas": (
        r"(?i)^\s*REQUEST\s+FOR\s+ADMISSION\s+(?:NO\.?\s*)?(\d+)\s*(?:[:.)\s]|$)",
        r"(?i)^\s*(?:RFA|ADMISSION)\s+(?:NO\.?\s*)?(\d+)\s*(?:[:.)\s]|$)",
    ),
}
BARE_NUMBER = r"^\s*(\d+)\s*[.):\s]\s+\S"
RESPONSE_HEADING = r"(?i)^\s*RESPONSE\s+TO\s+(?:SPECIAL\s+)?(?:INTERROGATOR(?:Y|IES)|REQUEST|DEMAND|RFA|RFP)\s+(?:FOR\s+(?:PRODUCTION|ADMISSION)\s+(?:OF\s+DOCUMENTS?\s+)?)?(?:NO\.?\s*)?(\d+)\s*[:.)\s]"
# Titles by kind.
REQUEST_TITLES = {
    "rfps": r"(?i)REQUEST\S?\s+FOR\s+PRODUCTION|DEMAND\s+FOR\s+(?:INSPECTION|PRODUCTION)",
    "rfas": r"(?i)REQUEST\S?\s+FOR\s+ADMISSION",
    "interrogatories": r"(?i)(?:SPECIAL\s+)?INTERROGATOR(?:Y|IES)",
}
# Headings of sections without requests.
SKIPPED_SECTIONS = {
    "definitions": r"(?i)^\s*DEFINITIONS?\s*$",
    "instructions": r"(?i)^\s*INSTRUCTIONS?\s*$",
    "preliminary_statement": r"(?i)^\s*PRELIMINARY\s+STATEMENT\s*$",
    "pos": r"(?i)^\s*PROOF\s+OF\s+SERVICE\b",
}
# Capitals that are no defined terms.
COMMON_CAPITALS = (
    "THE", "AND", "FOR", "NOT", "ALL", "ANY", "YOU", "YOUR", "THIS", "THAT", "WITH", "FROM",
    "EACH", "SUCH", "HAS", "WAS", "ARE", "WERE", "HAVE", "BEEN", "WILL", "DOES",
)

# Codes and how texts name them.
EMPLOYMENT_CODES = {
    "Labor Code": (r"Cal\.\s*Lab\.\s*Code", r"Labor\s+Code", r"Lab\.\s*Code"),
    "Government Code (FEHA)": (r"Cal\.\s*Gov\.\s*Code", r"Government\s+Code", r"Gov\.\s*Code"),
    "Unemployment Insurance Code": (r"Cal\.\s*Unemp\.\s*Ins\.\s*Code", r"Unemployment\s+Insurance\s+Code", r"Unemp\.\s*Ins\.\s*Code"),
    "Business & Professions Code": (r"Cal\.\s*Bus\.\s*&\s*Prof\.\s*Code", r"Business\s+and\s+Professions\s+Code", r"Bus\.\s*&?\s*Prof\.\s*Code"),
    "Code of Civil Procedure": (r"Cal\.\s*Civ\.\s*Proc\.\s*Code", r"Code\s+of\s+Civil\s+Procedure", r"Civ\.\s*Proc\.\s*Code", r"C\.C\.P\."),
}
# Sections that are about employment.
EMPLOYMENT_SECTIONS = (
    "12900", "12920", "12921", "12926", "12940", "12941", "12942", "12943", "12944", "12945", "12945.2", "12945.5", "12945.6", "12950", "12950.1", "12960", "12965",
    "98", "98.6", "200", "201", "202", "203", "204", "210", "226", "226.7", "232", "510", "512", "1021.5",
    "1024.5", "1024.6", "1098", "1098.5", "1099", "1102.5", "1102.6", "2698", "2699", "2699.3",
)
# Terms of which two say that a text is about employment.
EMPLOYMENT_TERMS = (
    "wrongful termination", "employment discrimination", "feha", "fair employment and housing", "sexual harassment", "hostile work environment", "retaliation", "whistleblower",
    "wage and hour", "unpaid wages", "overtime", "meal break", "rest period", "paga", "private attorneys general", "workers' compensation",
)

# Reporters of the state. Fixed values.
STATE_REPORTERS = (
    "Cal.", "Cal. 2d", "Cal. 3d", "Cal. 4th", "Cal. 5th",
    "Cal. App.", "Cal. App. 2d", "Cal. App. 3d", "Cal. App. 4th", "Cal. App. 5th",
    "Cal. App. Supp.", "Cal. App. Supp. 2d", "Cal. App. Supp. 3d", "Cal. App. Supp. 4th", "Cal. App. Supp. 5th",
    "Cal. Rptr.", "Cal. Rptr. 2d", "Cal. Rptr. 3d", "Cal. Comp. Cases", "Cal. Unrep.",
)
# Reporters that case links may name: the state's, their spellings without a space before the series, federal ones.
CASE_REPORTERS = (*STATE_REPORTERS, "Cal.2d", "Cal.3d", "Cal.4th", "Cal.5th", "Cal.App.2d", "Cal.App.3d", "Cal.App.4th", "Cal.App.5th", "U.S.", "F.2d", "F.3d", "F.4th")

# Categories of each tier of sources. Fixed values.
TIER_CATEGORIES = {
    "statutory": ("statutory_code",),
    "regulatory": ("regulation", "jury_instruction"),
    "persuasive": ("opinion_letter", "enforcement_manual", "federal_guidance"),
    "agency": ("agency_guidance", "fact_sheet", "faq", "legal_aid_resource", "poster"),
    "caselaw": ("case_law",),
}

# Sections of the general form that only one side asks, and those of persons, entities and vehicles. Fixed values.
PLAINTIFF_ONLY = tuple(f"16.{i}" for i in range(1, 11))
ENTITY_SECTIONS = tuple(f"3.{i}" for i in range(1, 8))
VEHICLE_SECTIONS = tuple(f"20.{i}" for i in range(1, 12))
# Number words of sets. Fixed values.
SET_WORDS = ("One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten")

"""Regular expressions of the text jobs, for the JVM regex engine. All fixed values.

Unbounded repetitions of groups are possessive (``*+``): the JVM matches those in a loop instead of one
stack frame per repetition, so a very long list cannot exhaust a task's stack. ``(?U)`` makes ``\\s``,
``\\w``, ``\\d`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

from typing import NamedTuple

U = "(?U)"

# --- Fixed values: rule-number shapes --------------------------------------------------------------
_PAREN = r"\([a-zA-Z0-9]{1,4}\)"
_JOIN = r"(?:\s*,\s*|\s+and\s+|\s+or\s+)"
SUBSECTION = rf"(?:{_PAREN})*+(?:{_JOIN}{_PAREN}(?:{_PAREN})*+)*+"
_SUBSECTION_GIVING_BACK = rf"(?:{_PAREN})*(?:{_JOIN}{_PAREN}(?:{_PAREN})*)*"
NO_DIGIT_OR_DASH = r"(?![-\d])"
# before a "not followed by a dash or digit" check the last "(a)" may have to be given back
SUBSECTION_CHECKED = rf"(?:{SUBSECTION}{NO_DIGIT_OR_DASH}|{_SUBSECTION_GIVING_BACK})"
DESCRIPTION_BODY = r"\((?=[^)]*\s)[^()]{2,80}\)"
DESCRIPTION = rf"(?:\s*{DESCRIPTION_BODY})?"
SEPARATOR = r"(?:\s*,\s*(?:and\s+|or\s+)?|\s+and\s+|\s+or\s+)"

NUM_FINRA = rf"(?:IM-\d{{4,5}}(?:-\d+)?|\d{{4,5}}[A-C]?(?:\.\d{{2}})?){SUBSECTION}"
NUM_IM = rf"IM-\d{{4,5}}(?:-\d+)?{SUBSECTION}"
NUM_SEC = rf"\d{{1,2}}[a-z]{{1,2}}\d?-\d{{1,2}}[a-z]?{SUBSECTION}"
NUM_MSRB = rf"[A-G]-\d{{1,2}}{SUBSECTION}"
NUM_SECTION = rf"\d{{1,2}}[A-Z]?{SUBSECTION}"
NUM_THREE = rf"\d{{3}}{SUBSECTION}"
NUM_REG_M = rf"10[0-5]{SUBSECTION}"
NUM_EXCHANGE = rf"\d{{1,4}}(?:\.\d{{1,2}})?[A-Z]?{SUBSECTION}"
NUM_NMS_6 = rf"6\d\d{SUBSECTION}"
NUM_NMS_6_CHECKED = rf"6\d\d{SUBSECTION_CHECKED}"
NUM_REG_M_CHECKED = rf"10[0-5]{SUBSECTION_CHECKED}"
NUM_REG_SHO_CHECKED = rf"20[0-4]{SUBSECTION_CHECKED}"

# --- Fixed values: names of rulebooks, acts and exchanges ------------------------------------------
EXCHANGES = (r"(?:NASDAQ|Nasdaq|NYSE(?:\s+(?:Arca|American|MKT))?|Cboe|CBOE|BATS|Phlx|PHLX|ISE|MIAX|BOX|IEX)")
ACT = (r"(?:the\s+)?(?:Securities\s+(?:and\s+)?Exchange\s+Act(?:\s+of\s+1934)?|Exchange\s+Act"
       r"|Securities\s+Act(?:\s+of\s+1933)?)")
EXCHANGE_ACT = r"(?:Securities\s+(?:and\s+)?Exchange\s+Act(?:\s+of\s+1934)?|Exchange\s+Act|SEA)"
SECTION_SIGN = r"(?:\bSections?\s+|§§?\s*)"
FINRA_NAME = r"(?:FIN\s?RA|F[A-Za-z0-9?!|\[\]]{1,4}(?:RA|NA))"
NASD_NAME = r"NAS[DO](?:\s*Cond\S*)?(?:\s+Membership\s+(?:and\s+)?Registration)?"


def _list(number: str, after: str = "") -> str:
    item = f"{number}{DESCRIPTION}{after}"
    return f"{item}(?:{SEPARATOR}{item})*+"


class CitationPattern(NamedTuple):
    family: str
    head: str      # up to the number list
    numbers: str   # the number list
    tail: str      # what follows the list and belongs to the citation
    one: str       # one number of the list
    needs: tuple[tuple[str, ...], ...]  # the text has at least one literal of each group, or no match

    @property
    def regex(self) -> str:
        """Three groups: head, number list, tail."""
        return f"{U}({self.head})({self.numbers})({self.tail})"


def _p(family, head, number, needs, tail="", one=None, after=""):
    groups = tuple(tuple(group.split("|")) for group in needs.split())
    return CitationPattern(family, head, _list(number, after), tail, U + (one or number), groups)


# --- Fixed values: the citation patterns; their order is their priority ---------------------------
# the letter first, here and below: a word boundary or a letter of either case costs more at every character
_RULES = r"(?=R)\bRules?\s+"
CITATION_PATTERNS: tuple[CitationPattern, ...] = (
    _p("EXCHANGE", rf"(?=[NCBPIM])\b{EXCHANGES}\s+Rules?\s+", NUM_EXCHANGE, "Rule NASDAQ|Nasdaq|NYSE|Cboe|CBOE|BATS|Phlx|PHLX|ISE|MIAX|BOX|IEX"),
    _p("FINRA", rf"(?=F){FINRA_NAME}\s*Rules?\s+(?:Series\s+)?", NUM_FINRA, "Rule F RA|NA"),
    _p("NASD", rf"{NASD_NAME}\s*(?:Rules?\s+|(?=IM-))", NUM_FINRA, "NAS Rule|IM-"),
    _p("FINRA", r"(?=I)\b", NUM_IM, "IM- FINRA", r"\s+of\s+(?:the\s+)?FINRA", one=NUM_FINRA),
    _p("MSRB", r"(?=M)\bMSRB\)?\s+Rules?\s+", NUM_MSRB, "MSRB Rule"),
    _p("SEC_RULE", rf"(?=[SE])\b{EXCHANGE_ACT}\s+Rules?\s+", NUM_SEC, "Rule Exchange|SEA -"),
    _p("SEC_SECTION", rf"(?=[SE])\b{EXCHANGE_ACT}\s*{SECTION_SIGN}", NUM_SECTION, "Section|§ Exchange|SEA"),
    _p("SECTION_OF_ACT", rf"(?=[S§]){SECTION_SIGN}", NUM_SECTION, "Section|§ Act", rf"\s+of\s+{ACT}"),
    _p("REG_NMS", r"(?=R)\bRegulation\s+NMS\s+Rules?\s+", NUM_THREE, "Rule Regulation NMS"),
    _p("REG_NMS", _RULES, NUM_THREE, "Rule Regulation NMS", r"\s+of\s+Regulation\s+NMS"),
    _p("REG_SHO", r"(?=R)\bRegulation\s+SHO\s+Rules?\s+", NUM_THREE, "Rule Regulation SHO"),
    _p("REG_SHO", _RULES, NUM_THREE, "Rule Regulation SHO", r"\s+of\s+Regulation\s+SHO"),
    _p("REG_NMS", r"(?=[SE])\b(?:Exchange\s+Act|SEC)\s+Rules?\s+", NUM_NMS_6_CHECKED, "Rule Exchange|SEC 6", one=NUM_THREE, after=NO_DIGIT_OR_DASH),
    _p("REG_NMS", _RULES, NUM_NMS_6, "Rule Act 6", rf"\s+(?:under|of)\s+{ACT}", one=NUM_THREE),
    _p("REG_M", r"(?=R)\bRegulation\s+M\s+Rules?\s+", NUM_REG_M, "Rule Regulation 10"),
    _p("REG_M", _RULES, NUM_REG_M, "Rule Regulation 10", r"\s+of\s+Regulation\s+M\b"),
    _p("REG_M", r"(?=S)\bSEC\s+Rules?\s+", NUM_REG_M_CHECKED, "Rule SEC 10", one=NUM_REG_M, after=NO_DIGIT_OR_DASH),
    _p("FUNDING_PORTAL", r"(?=F)\bFundin\S?\s+Portal\s+Rules?\s+", NUM_THREE, "Rule Fundin Portal"),
    _p("REG_CF", _RULES, NUM_THREE, "Rule Regulation Crowdfunding", r"\s+of\s+(?:SEC\s+)?Regulation\s+Crowdfunding"),
    _p("REG_CF", r"(?=R)\bRegulation\s+Crowdfunding\s+Rules?\s+", NUM_THREE, "Rule Regulation Crowdfunding"),
    _p("SEC_RULE", _RULES, NUM_SEC, "Rule -"),
    _p("REG_NMS", _RULES, NUM_NMS_6_CHECKED, "Rule 6", one=NUM_THREE, after=NO_DIGIT_OR_DASH),
    _p("REG_SHO", _RULES, NUM_REG_SHO_CHECKED, "Rule 20", one=NUM_THREE, after=NO_DIGIT_OR_DASH),
    _p("MSRB", _RULES, NUM_MSRB, "Rule -"),
    _p("BARE", r"(?=R)\bRules?\s+(?:Series\s+)?", NUM_FINRA, "Rule"),
)
# every citation pattern needs one of these, so a text without them has no citation
CITATION_GATE = "Rule|Section|§|IM-"

# --- Fixed values: masking and leaks ----------------------------------------------------------------
MASK_TOKEN = "[RULE]"
_ITEM = r"\(?\d[0-9A-Za-z().\-]*"
LEFTOVER_NUMBER = (
    rf"{U}(?=[RS§IG\d])(?:\b(?:Rules?|Sections?)\s*{_ITEM}(?:(?:\s*,\s*|\s+and\s+|\s+or\s+){_ITEM})*+|§§?\s*{_ITEM}"
    r"|\bIM-\d[\d\-]*|\bG-\d{1,2}\b(?:\([a-z0-9]{1,3}\))*+|\b\d{1,2}[a-z]{1,2}\d?-\d{1,2}[a-z]?\b)"
)
LEAK = rf"{U}\b(?:Rules?|Sections?|IM-)\s*\(?\d|§|\bG-\d{{1,2}}\b|\b\d{{1,2}}[a-z]{{1,2}}\d?-\d\b"
MIN_TITLE_CHARS = 12

# --- Fixed values: numbers OCR split or misread ------------------------------------------------------
OCR_GLUED = rf"{U}(\d{{4}})(and|or)(\d{{4}})"
OCR_TEN_B = rf"{U}\b[l1I]\s?[O0o]b-(\d)"
OCR_SPLIT_NUMBER = rf"{U}((?:Rules?|and|or|,)\s+)((?:[\dIlO]\s?){{3,6}}?)((?=[\s,.;:)(]|$))"
OCR_BOOK_BEFORE = "RA|NAS"

# --- Fixed values: sentences of a case document ------------------------------------------------------
SENTENCE_END = r"(?U)\.(?!\d)"
VIOLATION = r"(?iU)\b(?:violated|violation|violations|in contravention of)\b"
VIOLATION_THEN_PERIOD = r"(?isU)\b(?:violated|violation|violations|in contravention of)\b.*\."
WAIVER_HEADING = r"(?U)(?=[Ww])(?i)WAIVER\s+OF\s+PROCEDURAL\s+RIGHTS"
WAIVE = r"(?iU)\bwaive[sd]?\b"
PRIOR_CASE = (
    r"(?iU)DISCIPLINARY\s+HISTORY|accepted an AWC|In an AWC|entry of an AWC|consented to (?:a|the) (?:censure|fine)"
    r"|in which (?:it|the firm|he|she|Respondent) was (?:censured|fined|suspended|barred)|filed a complaint against"
    r"|entered into an AWC|issued a Letter of Acceptance|Prior Matter|consented to violations of"
    r"|\bwas censured and fined|\bincluded fines? of|\bin that proceeding|consented to findings that"
)

# --- Fixed values: facts sections ---------------------------------------------------------------------
FACTS_HEADINGS = (
    ("facts and violative conduct", r"(?U)FACTS\s+AND\s+VIOLATIVE\s+CONDUCT"),
    ("findings of fact", r"(?U)FINDINGS\s+OF\s+FACTS?|Findings\s+of\s+Fact\b"),
    ("facts", r"(?U)(?=[IVXA-HF])\b(?:[IVX]+\.\s*|[A-H]\.\s*)?(?:FACTS|Facts)\b(?=\s+[A-Z])"),
)
FACTS_END = (
    r"(?=[tfOIaCSVX])(?:\bto\s*th[ec]\s*\w{1,3}position\s*of\b|\bf\w{2}lowing\s*sanctions?\b|OTHER\s+FACTORS|"
    r"In\s+determining\s+the\s+(?:appropriate\s+)?sanctions?|the\s+sanctions?\s+hereby\s+imposed|"
    r"agrees?\s*to\s*pay\s*the\s*\w*onetary|CONCLUSIONS?\s+OF\s+LAW|Sanction\s+Guidelines|"
    r"\b(?:[IVX]+\.\s*)?SANCTIONS\b|\b(?:[IVX]+\.\s*)?Sanctions\s+(?:[A-Z]\.|FINRA|The|In|Enforcement))"
)
FACTS_END_FROM = 40
DANGLING_LETTER = r"(?U)\s+(?:[A-Z]|[IVX]+)\.$"
SUBHEAD = r"(?iU)\(\s*(?:Alleged\s+)?Violations?\s+of\b.{0,300}?\)"
STATED = (r"(?U)(?=[vVbBiI\u0130\u0131])(?i)(?:\bviolat\w*|\bviola\S{0,3}d\b|\biolat\w*|\bin contravention of\b|"
          r"\bby reason of th\w forcgoing|\bby reason of the foregoing)")
SANCTION_SENTENCE = (r"(?U)(?=[sS\u017FfFbBwW])(?i)(?:\bsanction|\bfine of\b|barred or suspended from associat|"
                     r"\bwe (?:suspend|bar|fine|censure|affirm)\b)")
SANCTION_LEFT = r"(?iU)sanction|\bfine of\b|statutory disqualification"
RULE_REFERENCE = (r"(?iU)\[RULE\]|\b(?:FINRA|NASD|MSRB|SEC) rules?\b|\b(?:Exchange|Securities) Act\s*(?:Rule|§|Section)|"
                  r"§|C\.\s*F\.\s*R\b")
EXPLAINS = (r"(?iU)\b(?:requires?|required|requiring|provides?|prohibit(?:s|ed)?|states?|mandates?|obligates?|"
            r"defines?|imposes?|appl(?:y|ies)|establish(?:es)?|governs?|must|shall|in pertinent part|"
            r"is (?:designed|intended)|means|violat\w*|constitut\w*|inconsistent with)\b|[\"“”]")
GUIDANCE = r"(?iU)Regulatory Notice|Notice to Members|Supplementary Material|BrokerCheck"
NARRATIVE_SPLIT = (r"(?U)(?<=[.!?\"”])(?:(?:(?<=[.!?])|(?<=[.!?][\"”]))\s+(?=[A-Z\"“(\[])|(?<=[a-z][.!?])(?=[A-Z]))")

# --- Fixed values: monthly reports ---------------------------------------------------------------------
CASE_END = r"(?U)\(\s*FINRA\s+Case\s*#\s*(\d{8,14})\s*\)"
PAGE_HEADER = (r"(?mU)^\s*(?:\d+\s+)?Disciplinary\s+(?:and|&)\s+Other\s+FINRA\s+Actions"
               r"(?:\s*\|\s*[A-Z][a-z]+\s+\d{4})?\s*\d*\s*$")
HYPHEN_BREAK = r"(?U)(\w)-\n(\w)"
LINE_BREAK = r"\R|[\x1c-\x1e]"
ALL_DIGITS = r"(?U)^\d+$"
SECTION_HEADING = (r"(?U)^(?:Firms?|Individuals?|Firms?\s+and\s+Individuals?|Complaints?\s+Filed|Decisions?\s+Issued)"
                   r"\b[^.\n]{0,200}$")
SECTION_MAX_CHARS = 160
CRD_MARK = "(CRD"
RESPONDENT = r"(?U)^(.+?)\s*\(CRD\s*#"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
ACTION_DATE = rf"(?U)(?=[JFMASOND])\b((?:{_MONTH})\s+\d{{1,2}},\s+\d{{4}})\s*[–—-]"
MONTH_YEAR = rf"(?iU)({_MONTH})[\s_-]+(\d{{4}})"
NAME_MONTH = (r"(?iU)(?<![a-z])(january|february|march|april|may|june|july|august|september|october|november|december"
              r"|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)(?![a-z])")
NAME_YEAR = r"(?<!\d)(20\d\d)(?!\d)"
FOLDER_MONTH = r"/files/(\d{4})-(\d{2})/"
REPORT_LINK = (r"(?i)disc?iplinary[-_ %20]*actions?.*\.pdf$|/monthly-disciplinary-actions-[a-z]+-\d{4}/?$"
               r"|/disciplinary-actions/[a-z]+-\d{4}/?$")
REPORT_LINK_SKIP = "(?i)quarterly"
PDF_ANCHOR = "(?i)disc?iplin"

# --- Fixed values: rulebook pages and listings ------------------------------------------------------
RULE_LINK = r"(?i)/rules-guidance/rulebooks/finra-rules/(\d{4,5}(?:\.\d{2})?|IM-\d{4}-\d+)/?$"
PAGE_TABS = r"(?U)^(?:The Rule\s+)?(?:Notices\s+)?(?:Guidance\s+)?(?:News Releases\s+)?(?:FAQs\s+)?"
RULE_HISTORY = (r"(?:Amended|Adopted|Redesignated|Renumbered|Approved)(?: and \w+)? by SR-|"
                r"Selected Notices?:|No Results Found")
PAGE_FOOTERS = ("Rulebook Search", "Related Topics", "Sign Up for Newsletters", "©")
FOOTER_FROM_WITHOUT_TITLE = 200
SERIES_PAGE = r"^(?:0100|\d000)$"
TITLE_NUMBER = r"(?U)^\s*(?:IM-)?[\d.\-]+\.?\s*"
CASE_IN_FILE_NAME = r"^(\d{11,14})\b"
LISTING_CELLS = {
    "file": "views-field-field-fda-attachment-file-media",
    "doc_type": "views-field-field-fda-document-type-tax",
    "respondent": "views-field-views-conditional-field-3",
    "action_date": "views-field-field-core-official-dt",
}

# --- Fixed values: search queries and answers ---------------------------------------------------------
QUERY_SANCTION = (
    r"(?iU)\b(?:censur\w*|fined|fines?|suspen(?:ded|sions?)|barred|bar|sanction\w*|restitution|disgorg\w*|AWC|"
    r"Acceptance, Waiver|in effect|appeal\w*|Hearing Panel|National Adjudicatory|Hearing Officers?|FINRA Case|"
    r"default decision|requalify|ordered to pay)\b"
)
QUERY_FINDINGS = r"(?isU)\bfindings that\s+(.*)"
QUERY_SENTENCE_SPLIT = r"(?U)(?<=[.!?])\s+(?=[A-Z(\[])"
CITED_RULE_NUMBER = r"IM-\d{4}-\d+|\d{4,5}"
SEARCH_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*+"
CLASSIFIER_TOKEN = r"[\p{L}\p{N}_]{2,}"
WHITESPACE = r"(?U)\s+"

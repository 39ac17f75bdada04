"""Lines of a leadership page: titles by a closed list, personal names, and labels that only look like either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of this module: sizes, words that are no part of a name, patterns of names, prose and documents, titles in the order of their rules.
MAX_TITLE, MAX_NAME = 90, 48
NAME_STOP_WORDS = (
    "INC", "LLC", "LTD", "CORP", "CORPORATION", "COMPANY", "COMPANIES", "GROUP",
    "HOLDINGS", "PARTNERS", "ASSOCIATES", "ENTERPRISES", "INDUSTRIES", "SERVICES",
    "SOLUTIONS", "SYSTEMS", "TEAM", "LEADERSHIP", "MANAGEMENT", "EXECUTIVE", "BOARD",
    "DIRECTORS", "OFFICERS", "ABOUT", "CONTACT", "CAREERS", "HOME", "NEWS", "BLOG",
    "PRIVACY", "POLICY", "TERMS", "LOGIN", "SEARCH", "MENU", "SHARE", "READ", "MORE",
    "VIEW", "LEARN", "OUR", "OUR TEAM", "MEET", "STAFF", "PEOPLE", "HISTORY", "MISSION",
    "VALUES", "SERVICE", "PRODUCTS", "PROJECTS", "LOCATIONS", "SAFETY", "QUALITY",
    "CONSTRUCTION", "LOGISTICS", "TRANSPORT", "TRANSPORTATION", "MANUFACTURING",
    "ALL", "RIGHTS", "RESERVED", "COPYRIGHT", "EMAIL", "PHONE", "ADDRESS", "LINKEDIN",
    "FACEBOOK", "TWITTER", "YOUTUBE", "INSTAGRAM", "SKIP", "CONTENT", "NAVIGATION",
    "CORPORATE", "GOVERNANCE", "GUIDELINES", "GUIDELINE", "CODE", "ETHICS", "CHARTER",
    "COMMITTEE", "COMPLIANCE", "POLICIES", "BYLAWS", "AUDIT", "REPORT", "REPORTS",
    "PLAN", "PROGRAM", "STATEMENT", "NOTICE", "DISCLOSURE", "INVESTOR", "INVESTORS",
    "ANNUAL", "PROXY", "FILINGS", "CONDUCT", "WHISTLEBLOWER", "NOMINATING", "COMPENSATION",
)
FUNCTION_WORDS = (
    "HOW", "WE", "OUR", "THE", "WHAT", "WHY", "WHEN", "WHERE", "WHO", "WHICH", "THIS",
    "THAT", "THESE", "THOSE", "WITH", "YOUR", "YOU", "IT", "ITS", "IN", "ON", "AT", "FOR",
    "AND", "OR", "BUT", "IF", "SO", "AS", "BY", "TO", "FROM", "OF", "IS", "ARE", "WAS",
    "WERE", "BE", "BEEN", "HAS", "HAVE", "HAD", "DO", "DOES", "DID", "CAN", "WILL",
    "EVERY", "MORE", "MOST", "LEARN", "GET", "READ", "SEE", "VIEW", "CONTACT", "JOIN",
    "FIND", "LET", "MAKE", "BUILD", "MEET", "NEW", "NOW", "HERE", "THERE", "WHY", "LET",
    "WORK", "WORKS", "WORKING", "BUILDING", "MOVING", "DRIVEN", "TRUSTED", "PROVEN",
    "TOGETHER", "BEYOND", "ABOVE", "FIRST", "NEXT", "ONE", "TWO", "YEARS", "YEAR",
    "TODAY", "TOMORROW", "FUTURE", "STORY", "STORIES", "CASE", "STUDY", "STUDIES",
    "A", "AN", "BECOME", "BECOMING", "DISCOVER", "EXPLORE", "START", "BEGIN", "CREATE",
    "DESIGN", "DELIVER", "DELIVERING", "SERVE", "SERVING", "GROW", "GROWING", "PARTNER",
    "PARTNERING", "SUPPORT", "CHOOSE", "REQUEST", "SUBMIT", "DOWNLOAD", "SUBSCRIBE",
    "FOLLOW", "SHOP", "CALL", "CLICK", "CONTINUE", "CONTINUING", "CONNECT", "APPLY",
)
NAME_SUFFIX = r"(?i),?\s+(?:M\.?D\.?|Ph\.?D\.?|D\.?O\.?|J\.?D\.?|C\.?P\.?A\.?|P\.?E\.?|R\.?N\.?|MBA|CFA|PMP|Esq\.?|Jr\.?|Sr\.?|II|III|IV)\.?$"
NAME_TOKEN = r"(?:[A-Z][a-z]*(?:['’\-][A-Z]?[a-z]+)*|[A-Z]\.?|(?:Mc|Mac|De|Van|Von|Der|La|Le|Di|Du)[A-Z][a-z]+)"
NAME = rf"^{NAME_TOKEN}(?:\s+{NAME_TOKEN}){{1,3}}$"
PROSE_MARKERS = (
    r"(?i)\b(is the|is our|was the|has been|joined|serves as|leads the|brings|holds a|received|earned|graduated|oversees|began|started|prior to|before joining|"
    r"responsible for|he |she |they |his |her |their )"
)
DOCUMENT_MARKERS = (
    r"(?i)\b(code of|guidelines?|charter|policy|policies|bylaws?|committee|plan document|terms of|statement of|report|agreement|disclosure|form \d|"
    r"certificate|amendment)\b"
)
_RANK = r"(?:senior |executive |group |corporate |global )?(?:vice president|VP|SVP|EVP|director)\s*(?:of |for |[,\-–—:|]\s*)*"
TITLE_RULES = (
    ("ceo", "primary", r"(?i)\b(chief executive officer|CEO)\b"),
    ("coo", "primary", r"(?i)\b(chief operating officer|chief operations officer|COO)\b"),
    ("cio_cto", "primary", r"(?i)\b(chief information officer|chief technology officer|chief digital officer|chief information and technology officer|chief technical officer|CIO|CTO|CDO)\b"),
    ("chief_transformation", "primary", r"(?i)\bchief (transformation|innovation|supply chain|manufacturing|operating and technology) officer\b"),
    ("vp_operations", "primary", rf"(?i)\b({_RANK}(?:\w+ ){{0,2}}operations?)\b"),
    ("vp_supply_chain", "primary", rf"(?i)\b({_RANK}(?:\w+ ){{0,2}}(?:supply chain|logistics|procurement|distribution))\b"),
    ("vp_manufacturing", "primary", rf"(?i)\b({_RANK}(?:\w+ ){{0,2}}(?:manufacturing|production|engineering|continuous improvement))\b"),
    ("vp_it", "primary", rf"(?i)\b({_RANK}(?:information technology|IT|technology|digital|systems|information systems))\b"),
    ("president", "primary", r"(?i)^(?:group |division |corporate |company )?president\b"),
    ("cfo", "secondary", r"(?i)\b(chief financial officer|CFO)\b"),
    ("owner_founder", "secondary", r"(?i)\b(founder|co-founder|(?<!employee[- ])owner|chairman|chairwoman|chair of the board|managing partner|managing director|principal)\b"),
    ("other_chief", "secondary", r"(?i)\bchief [a-z ]{3,30}officer\b"),
    ("other_vp", "secondary", r"(?i)\b(vice president|VP|SVP|EVP)\b"),
)
# What a title outside of the list must look like, and words of labels that stand in no name.
ROLE_SHAPED = (
    r"(?i)\b(director|manager|head|lead|officer|estimat\w*|superintendent|controller|engineer|counsel|analyst|coordinator|supervisor|specialist|partner|principal|chief|"
    r"president|vp|vice|executive|foreman|administrator|architect|planner|scheduler|buyer|purchasing|treasurer|secretary|founder|owner|chairman|chair|general|associate|"
    r"assistant|senior|junior|regional|division|department|group)\b"
)
DOMAIN_WORDS = (
    "REGION", "REGIONS", "PROGRAM", "PROGRAMS", "SERVICE", "SERVICES", "SOLUTION",
    "SOLUTIONS", "ONLINE", "IMPACT", "EXPERTISE", "LEADERS", "INQUIRIES", "RECRUITING",
    "OFFICE", "OFFICES", "MODEL", "DEVELOPMENT", "NEGOTIATIONS", "INTELLIGENCE",
    "PROCUREMENT", "PROCESSING", "FABRICATION", "REUSE", "SCIENCE", "SCIENCES", "GOODS",
    "SALES", "PROJECT", "PROJECTS", "INTERNAL", "ADVISORY", "MODERNIZATION", "LEASING",
    "INDUSTRIAL", "COMMERCIAL", "RESIDENTIAL", "HEALTHCARE", "EDUCATION", "ENERGY",
    "WHOLESALE", "RETAIL", "FEATURED", "WEEKLY", "CAREER", "CAREERS", "COMMUNITY",
    "STUDENT", "STUDENTS", "COLLEGE", "UNIVERSITY", "INFRASTRUCTURE", "TECHNOLOGY",
    "FACILITIES", "FACILITY", "OPERATIONS", "STRATEGY", "STRATEGIC", "MARKETING", "FINANCE",
    "QUALITY", "SAFETY", "SUSTAINABILITY", "INNOVATION", "GLOBAL", "NATIONAL", "CENTRAL",
    "NORTH", "SOUTH", "EAST", "WEST", "NORTHEAST", "SOUTHEAST", "MIDWEST", "MOUNTAIN",
    "PACIFIC", "ATLANTIC", "TEXAS", "FLORIDA", "CALIFORNIA", "STATES", "CONTRACT",
    "CONTRACTING", "DELIVERY", "SUPPLY", "CHAIN", "LOGISTICS", "TRANSPORT", "FREIGHT",
    "BROKERAGE", "TANK", "NATURAL", "GAS", "LIFE", "DURABLE", "CONSUMER", "BASELINE",
    "COST", "RATE", "BUSINESS", "INDUSTRY", "OVERVIEW", "HISTORY", "MISSION", "VALUES",
    "SHIPPING", "COUNTRY", "MEXICO", "CANADA", "HUMAN", "RESOURCE", "RESOURCES",
)
#: Name and title on one line stand around one of these.
JOINED = r"\s*(?:,|–|—|\||•|\s-\s)\s*"


def title_key(line: Column) -> Column:
    """Struct (key, relevance) of the first title rule that fits, else other and excluded."""
    return F.coalesce(*[F.when(line.rlike(rx), F.struct(F.lit(k).alias("key"), F.lit(r).alias("relevance"))) for k, r, rx in TITLE_RULES], F.struct(F.lit("other").alias("key"), F.lit("excluded").alias("relevance")))


def _label(line: Column) -> Column:
    """A short line that is neither prose nor a document's title."""
    plain = ~line.rlike(PROSE_MARKERS) & ~line.rlike(DOCUMENT_MARKERS) & ~F.endswith(line, F.lit(".")) & ~F.contains(line, F.lit("?")) & ~F.contains(F.lower(line), F.lit("http"))
    return F.coalesce(F.length(line).between(1, MAX_TITLE) & plain, F.lit(False))


def is_title(line: Column) -> Column:
    """A label with a title of the list."""
    return _label(line) & (title_key(line)["key"] != "other")


def is_title_shaped(line: Column) -> Column:
    """A label of eight words or fewer, whether or not its title is on the list."""
    return _label(line) & line.rlike("[A-Za-z]") & (F.size(F.split(F.trim(line), r"\s+")) <= 8)


def bare_name(line: Column) -> Column:
    """A name as written, without the degrees and generations behind it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, NAME_SUFFIX, "")), "^,+|,+$", ""))


def _words(name: Column) -> Column:
    return F.transform(F.split(name, r"\s+"), lambda w: F.regexp_replace(F.upper(w), r"^\.+|\.+$", ""))


def is_name(line: Column, company_words: Column) -> Column:
    """Two to four capitalised words that are no label, no phrase, not the company's name and no title."""
    name = bare_name(line)
    words = _words(name)
    company = (F.size(company_words) > 0) & (F.size(F.array_except(words, company_words)) == 0)
    good = name.rlike(NAME) & ~F.exists(words, lambda w: w.isin(*NAME_STOP_WORDS) | w.isin(*FUNCTION_WORDS)) & ~company & (title_key(name)["key"] == "other")
    return F.coalesce(F.length(line).between(1, MAX_NAME) & good, F.lit(False))


def is_label(name: Column) -> Column:
    """What has the shape of a name and is an entry of a menu: a word of business or of a role stands in it."""
    words = F.transform(F.split(name, r"\s+"), lambda w: F.regexp_replace(F.upper(w), r"^[.,]+|[.,]+$", ""))
    return F.exists(words, lambda w: w.isin(*DOMAIN_WORDS)) | name.rlike(ROLE_SHAPED)


def person_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")

"""Results depend on these exact words, numbers and patterns.

Patterns are in Java regex syntax with explicit character classes, because
Java's ``\\w``, ``\\s`` and ``\\d`` are ASCII-only.
"""

# --- fixed values: numbers -------------------------------------------------
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
MIN_CHUNK_CHARS = 80
DEDUP_THRESHOLD = 0.92
DEDUP_WINDOW = 50
OCR_CHAR_THRESHOLD = 50
OCR_DPI = 200
OCR_MIN_CONFIDENCE = 0.6
EMBED_BATCH = 32
EMBED_MODEL = "BAAI/bge-base-en-v1.5"
LOW_CONFIDENCE = 0.35
HEAD_CHARS = 1000
TOP_K = 3

# --- fixed values: whitespace ----------------------------------------------
# the characters Unicode calls white space, plus the four ASCII separators
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\s\x1c-\x1f\x85\p{Z}"            # inside a character class
WORD = r"\p{L}\p{N}_"                    # inside a character class

# --- fixed values: text cleaning -------------------------------------------
LIGATURES = {
    "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi",
    "\ufb04": "ffl", "\ufb00": "ff", "\ufb05": "st",
}
TYPOGRAPHIC = {
    "\u2019": "'", "\u2018": "'", "\u201c": '"', "\u201d": '"',
    "\u2013": "-", "\u2014": "-", "\u00a0": " ",
}
INVISIBLE = "\u00ad\u200b\ufeff"
BULLETS = "●•◦▪▸►➔✓✔✗✘◆◇○□■⬛⬜★☆→⇒≫»·‣⁃–"
TABLE_MARKER = "<!-- TABLE -->"
TABLE_OPEN, TABLE_CLOSE = "[TABLE]", "[/TABLE]"
SPLIT_SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""]

# --- fixed values: table labels --------------------------------------------
GENERIC_HEADERS = [
    "DESCRIPTION", "SKU", "URL", "VALUE", "FEATURE", "SPECIFICATION",
    "SPECIFICATIONS", "MODEL", "MODEL NUMBER", "PART NUMBER", "PRODUCT",
    "PRODUCT FAMILY", "ITEM", "NOTES", "ORDER INFORMATION", "ORDERING INFORMATION",
]
# the model extractor does not know this one
GENERIC_TABLE_ONLY = ["ORDER INFORMATION"]
SECTION_LABELS = [
    "PERFORMANCE", "CAPACITY", "INTERFACES", "HARDWARE", "SYSTEM",
    "DIMENSIONS", "POWER", "ENVIRONMENT", "COMPLIANCE", "CERTIFICATIONS",
]
BLANK_VALUES = ["", "-", "--", "n/a", "na", "n.a.", "none", "tbd", "nan", "not available"]
WORDED_VALUES = ["YES", "NO", "SUPPORTED", "OPTIONAL", "INCLUDED"]

# --- fixed values: product codes -------------------------------------------
FAMILY_DESIGNATORS = ["FG-7000F", "PA-3200"]
_D = r"\p{Nd}"
_LB, _RB = rf"(?<![{WORD}])", rf"(?![{WORD}])"
_TAIL_CODES = (
    rf"PA-{_D}{{3,5}}[A-Z]{{0,2}}"
    rf"|(?:BIG-IP[{WS}]+)?[ir]{_D}{{4,5}}"
    rf"|[A-Z]{{2,6}}-{_D}{{3,5}}[A-Z]{{0,3}}(?:-DC)?"
)
CODE_ALTERNATIVES = rf"F[GPIM]{{1,3}}-{_D}{{3,5}}[A-Z]{{0,4}}(?:-{_D}{{1,2}})?(?:-DC)?|{_TAIL_CODES}"
CODE = rf"(?i){_LB}({CODE_ALTERNATIVES}){_RB}"
CODE_FULL = rf"(?i)^(?:{CODE_ALTERNATIVES})$"
CODE_IN_CELL = (
    rf"(?i)(?<![A-Z0-9-])(FG-{_D}{{3,5}}[A-Z]{{0,4}}(?:-{_D}{{1,2}})?(?:-DC)?|{_TAIL_CODES})(?![A-Z0-9-])"
)
COMPONENT = rf"(?i)^F(?:IM|PM|AN|AC|SW)-{_D}{{3,5}}[A-Z]{{0,3}}(?:-{_D}{{1,2}})?(?:-DC)?$"
# a code that opens a document id such as XX-100-DS-...; no white space in it
DOC_ID = (
    rf"(?i){_LB}([A-Z]{{2,6}}-{_D}{{3,5}}[A-Z]{{0,4}})"
    r"-(?:DAT|DS|WP|PB|TB|RN|IG|AG|HW|SW|UG)-"
)
PORT_TYPES = ["Q?SFP", "BIDI", "LR", "SR", "ER", "ZR", "DAC", "AOC", "CR", "CWDM", "DWDM"]
PART_TYPES = ["TPM", "BLE", "SSD"]
# prefix match unless an alternative ends in $
BLOCKED_MODEL = (
    r"(?i)^(?:" + "|".join([
        rf"{_D}{{1,4}}[WV]$",
        rf"EN[{WS}]?{_D}+",
        rf"IEC[{WS}]?{_D}+",
        rf"[A-Z]{{1,3}}[{WS}]{_D}{{5}}",
        rf"[A-Z]{{2,3}}{_D}{{6,}}",
        rf"AES[-{WS}]?{_D}+",
        rf"SHA[-{WS}]?{_D}+",
        rf"NAT{_D}{{2}}",
        r"RS-232",
        rf"ICES-{_D}+",
        rf"HTTP[{WS}]?{_D}+",
        rf"{_D}+[GK]$",
        *PORT_TYPES,
        *PART_TYPES,
        rf"DAT[-{WS}]?R?{_D}+",
    ]) + ")"
)
BLOCKED_CELL = (
    rf"(?i)^(?:(?:AES|SHA)[-{WS}]?{_D}+$|{_D}+[GK]$|{_D}{{1,4}}[WV]$|(?:EN|IEC)[{WS}]?{_D}+)"
)
# the word after a code has to fit into the next 24 characters
FAMILY_TAIL = (
    rf"(?=[{WS}]{{0,17}}(?:series|family){_RB}|[{WS}]{{18}}(?:series|family)"
    rf"|[{WS}]{{0,15}}platform{_RB}|[{WS}]{{16}}platform)"
)

# --- fixed values: vendor and family ---------------------------------------
VENDOR_NOISE = [
    "Gartner", "Magic Quadrant", "ICSA", "NSS Labs", "Wi-Fi", "Bluetooth", "NSS", "IDC",
    "Forrester", "VMware", "AWS", "Amazon", "Microsoft", "Google", "Azure", "CrowdStrike",
]
VENDOR_WEIGHTS = {"pipe_by": 15, "pipe_mark": 12, "by": 12, "copyright": 16, "mark": 8, "possessive": 10}
PIPE_HEADER = rf"(?d)^(.+?)[{WS}]*\|[{WS}]*(.+?)[{WS}]*\|[{WS}]*(.+)$"
BY = rf"(?md){_LB}by[{WS}]+([A-Z][A-Za-z0-9 &.]{{3,40}}?)(?:[{WS}]*\||[{WS}]*$|[{WS}]*\n)"
TRADEMARK = rf"{_LB}([A-Z][A-Za-z0-9]{{1,20}})®"
POSSESSIVE = (
    rf"(?i){_LB}([A-Z][A-Za-z0-9]{{2,25}})'s[{WS}]+"
    r"(?:patented|proprietary|award|product|solution|platform|appliance|technology)"
)
COPYRIGHT = (
    rf"©[{WS}]*(?:20{_D}{{2}})?[{WS}]*([A-Z][A-Za-z0-9 ,.&]{{2,40}}?)"
    rf"(?:,?[{WS}]*Inc\.|,?[{WS}]*Ltd\.|,?[{WS}]*LLC\.?|,?[{WS}]*Networks?|\.|[{WS}]*All[{WS}]+rights)"
)
PRODUCT_TITLE = (
    rf"^[A-Z][A-Za-z0-9®\-.]{{1,30}}(?:[{WS}]+[A-Z0-9][A-Za-z0-9®\-.]{{0,20}}){{0,4}}"
    rf"(?:[{WS}]*(?:Series|Platform|Suite|System|Firewall|WAF|Gateway|Controller|Switch|Router"
    r"|Appliance|Cloud|VE))?$"
)
FAMILY_SUFFIX = (
    rf"(?id)[{WS}]*[|\-][{WS}]*(?:Feature Overview|Whitepaper|Data Sheet|Datasheet|Tech Spec.*"
    r"|Overview|Technical Specifications?|Product Brief|Solution Brief).*$"
)
FAMILY_IN_TEXT = [
    rf"(?i){_LB}(FortiGate[{WS}]+{_D}{{3,5}}[A-Z]?[{WS}]+Series){_RB}",
    rf"(?i){_LB}(PA-{_D}{{3,5}}[{WS}]+Series){_RB}",
    rf"(?i){_LB}(FG-{_D}{{3,5}}[A-Z]?[{WS}]+Series){_RB}",
]
FAMILY_IN_STEM = [
    (rf"{_LB}pa-({_D}{{3,5}})-series{_RB}", "PA-"),
    (rf"{_LB}fortigate-({_D}{{3,5}}[a-z]?)-series{_RB}", "FortiGate "),
]
MARKETING_HEADINGS = [
    "HIGHLIGHTS", "OVERVIEW", "PRODUCT OVERVIEW", "FEATURES", "BENEFITS",
    "SPECIFICATIONS", "TECHNICAL SPECIFICATIONS", "ORDERING INFORMATION",
]
GENERIC_TITLES = [
    "datasheet", "data sheet", "whitepaper", "technical", "overview", "series",
    "platform", "product", "specifications", "tech specs",
]
STEM_STOPWORDS = ["series", "datasheet", "data", "sheet"]
STEM_VENDORS = [("palo-alto", "Palo Alto"), ("fortigate", "Fortinet"), ("fortinet", "Fortinet"),
                ("opentext", "OpenText"), ("open-text", "OpenText")]

# --- fixed values: retrieval probes ----------------------------------------
PROBE_QUERIES = [
    "Supports TLS 1.3 inspection",
    "Threat protection throughput above 500 Gbps",
    "Zero Trust Network Access support",
    "SSL inspection throughput",
]

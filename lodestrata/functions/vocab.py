"""Fixed vocabularies. Every function that uses one takes it as a parameter; these are the defaults."""

from __future__ import annotations

# The department list, in lookup order.
DEPARTMENTS = (
    "General Administration", "Home", "Finance", "Urban Development", "Water Resources", "Water Supply & Sanitation", "Industries", "Information Technology",
    "Higher & Technical Education", "Public Works", "Health", "Agriculture", "Rural Development", "Energy", "Chief Minister's Office",
)
# Shorthands that name a department where no full name does, in lookup order.
DEPARTMENT_SHORTHANDS = (("gad", "General Administration"), ("general administration", "General Administration"), ("cmo", "Chief Minister's Office"))

UNCATEGORISED = "Uncategorised"
# Trigger substrings of each category, in lookup order.
CATEGORY_HINTS = {
    "CM Meetings": ("cm meeting", "chief minister meeting", "मुख्यमंत्री बैठक"),
    "Announcements": ("announcement", "घोषणा", "जाहीर", "उद्घाटन"),
    "Cabinet Decisions": ("cabinet", "मंत्रिमंडळ", "कॅबिनेट", "मंत्रिमंडल"),
    "War Room": ("war room", "वॉर रूम", "वॉररूम"),
    "100/150 Days": ("100 days", "150 days", "100 दिवस", "150 दिवस"),
    "CEGIS": ("cegis",),
    "SAMAGRA": ("samagra", "समग्र"),
    "Databases": ("database", "dataset", "डेटाबेस", "डेटा"),
    "Conferences": ("conference", "summit", "परिषद", "संमेलन"),
    "Key Districts": ("district", "जिल्हा", "जिल्हे"),
    "PS Meetings": ("ps meeting", "principal secretary", "प्रधान सचिव"),
}
TAXONOMY = (*CATEGORY_HINTS, UNCATEGORISED)
SOURCE_TYPES = ("tracker", "letter", "minutes", "deck", "report", "scan", "unknown")

# Groups of equivalent terms in English, Marathi and Hindi.
LEXICON = (
    ("quantum", "क्वांटम", "क्वाण्टम"),
    ("semiconductor", "अर्धवाहक", "सेमीकंडक्टर", "सेमीकन्डक्टर"),
    ("manufacturing", "उत्पादन", "निर्माण", "विनिर्माण"),
    ("president", "राष्ट्रपती", "राष्ट्रपति"),
    ("prime minister", "पंतप्रधान", "प्रधानमंत्री"),
    ("chief minister", "मुख्यमंत्री"),
    ("governor", "राज्यपाल"),
    ("minister", "मंत्री"),
    ("letter", "पत्र", "पत्रव्यवहार"),
    ("meeting", "बैठक", "सभा"),
    ("water supply", "पाणीपुरवठा", "जलापूर्ति", "जल आपूर्ति"),
    ("water", "पाणी", "जल"),
    ("cabinet", "मंत्रिमंडळ", "मंत्रिमंडल", "कॅबिनेट"),
    ("decision", "निर्णय"),
    ("announcement", "घोषणा", "जाहीर"),
    ("inauguration", "उद्घाटन"),
    ("scheme", "योजना"),
    ("policy", "धोरण", "नीति"),
    ("district", "जिल्हा", "जिला"),
    ("road", "रस्ता", "सड़क", "मार्ग"),
    ("power", "वीज", "बिजली", "ऊर्जा"),
    ("electricity", "वीज", "बिजली"),
    ("investment", "गुंतवणूक", "निवेश"),
    ("industry", "उद्योग"),
    ("agriculture", "शेती", "कृषी", "कृषि"),
    ("farmer", "शेतकरी", "किसान"),
    ("health", "आरोग्य", "स्वास्थ्य"),
    ("education", "शिक्षण", "शिक्षा"),
    ("data centre", "डेटा सेंटर", "डेटा केंद्र"),
    ("summit", "परिषद", "शिखर परिषद"),
    ("war room", "वॉर रूम", "वॉररूम"),
)

# Words that tell Marathi and Hindi apart.
MARATHI_MARKERS = ("आणि", "आहे", "आहेत", "यांची", "यांच्या", "साठी", "मध्ये", "नाही", "व", "बैठक")
HINDI_MARKERS = ("और", "है", "हैं", "के", "की", "में", "नहीं", "पत्र", "को")

# Words that are no query terms.
STOPWORDS = tuple(
    "the a an to in on of for and or is are was were be with at by from as that this "
    "show me all everything about what which who list give find get letter letters regarding request please "
    "व आणि मध्ये साठी आहे यांना का की के में और को है पत्र".split()
)

# The gazetteer, in output order.
PLACES = (
    "Mumbai", "Pune", "Nagpur", "Nashik", "Aurangabad", "Chhatrapati Sambhajinagar", "Thane", "Amravati", "Solapur", "Kolhapur", "Ratnagiri", "Gadchiroli",
    "New Delhi", "Delhi", "मुंबई", "पुणे", "नागपूर", "नाशिक", "दिल्ली",
)

# Header words that name a column's role, in order of preference.
CATEGORY_COLUMNS = ("प्रवर्ग", "वर्ग", "category", "प्रकार", "type")
RECIPIENT_COLUMNS = ("addressed", "recipient", "to ", "नाव", "name", "प्रति")
SUBJECT_COLUMNS = ("subject", "विषय", "तपशील", "घोषणा", "particulars", "title", "स्थळ", "place", "description")
TITLE_COLUMNS = ("subject", "title", "विषय", "तपशील", "घोषणा", "particulars", "description", "recipient", "name", "नाव")

# The months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def month_numbers() -> dict[str, int]:
    """Spellings of the months: full names, their first three letters, and sept."""
    return {name: k for k, full in enumerate(MONTHS, 1) for name in (full, full[:3])} | {"sept": 9}


def alias_index(lexicon: tuple[tuple[str, ...], ...] = LEXICON) -> dict[str, list[str]]:
    """Each lower-cased term with the members of all groups that hold it, itself included."""
    terms = {term.lower() for group in lexicon for term in group}
    return {t: sorted({m for group in lexicon if t in map(str.lower, group) for m in group}) for t in sorted(terms)}

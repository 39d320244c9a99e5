"""Fixed values of the analyses: word lists, prefixes, patterns and default parameters."""

# The base stop list.
STOP_BASE = (
    "the is a an and or but in on at to for of with by from as was were been be have has had do does did will would could should "
    "it its this that these those not he she they we you i me my are am also can may so than then who which what where when how all "
    "each every both few more most other some such no nor only own same about up out if into through during before after above below "
    "between because until while just over under again further once here there any very too being"
).split()

# What search leaves out besides.
STOP_SEARCH = STOP_BASE + (
    "known used one two three first new time year years made since many however although often several much well within among upon "
    "like including refer refers reference references see called name named based part nbsp ref cite http https www org com jpg png svg pdf"
).split()

# Abbreviations that don't end a first sentence.
ABBREVIATIONS = (
    "u.s u.k mr mrs ms dr jr sr st prof sen rep rev gen ph.d b.c a.d e.g i.e etc vs inc ltd co corp no"
).split()

# Title prefixes of pages that a dump scan skips.
DUMP_PREFIXES = [
    "Wikipedia:", "User:", "Talk:", "User talk:", "File:", "File talk:", "Template:", "Template talk:", "Category:", "Category talk:",
    "Portal:", "Portal talk:", "Draft:", "Draft talk:", "Module:", "Module talk:", "MediaWiki:", "MediaWiki talk:", "Help:", "Help talk:",
    "Book:", "Book talk:", "TimedText:", "TimedText talk:",
]

# Title prefixes and patterns of pages that a crawl doesn't follow, and headings that end an article's body.
CRAWL_PREFIXES = [
    "Wikipedia:", "User:", "Talk:", "File:", "Template:", "Category:", "Portal:", "Draft:", "Module:", "MediaWiki:", "Help:", "Book:",
    "TimedText:", "Special:",
]
CRAWL_PATTERNS = [
    "^List of ", "^Lists of ", "^Outline of ", "^Index of ", "^Glossary of ", "^Comparison of ", "^Comparisons of ", "^Timeline of ",
    "^Chronology of ", r"\(disambiguation\)$",
]
STOP_HEADINGS = ["references", "notes", "citations", "sources", "further reading", "external links", "see also"]

# Default parameters.
SEGMENT_SIZE = 50
CORPUS_SIZE, POSTINGS_CAP, SEARCH_LIMIT = 2400, 25, 10
WINDOW, MIN_LENGTH, MAX_TOKENS, MAX_NEIGHBOURS, NEIGHBOURS = 3, 5, 5000, 30, 10
DIMENSION, EMBED_NEIGHBOURS, TOP_FEATURES, NN_LIMIT = 64, 80, 12, 10
TOP_WORDS = 10
FIRST_YEAR, LAST_YEAR = 2000, 2026
MAX_REVISIONS, HISTORY_LIMIT = 50, 2000
CRAWL_BATCH, CRAWL_ROUNDS, CRAWL_PAGES, CRAWL_DEPTH, STALE_MINUTES = 300, 10, 100, 2, 5
EXCERPT = 500

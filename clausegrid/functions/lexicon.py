"""Word lists, character sets and patterns that define results."""

# Letters left behind by wrong decoding.
SPECIAL_CHARACTERS = "å¼«¥ª°©ð±§µæ¹¢³¿®ä£"

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Number words, in the order in which they are removed.
NUMBER_WORDS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty",
]

# The common list of English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn "
    "doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Words that mark an obligation or a right.
MODALS = ["shall", "must", "may", "will", "should", "can"]

# Fixed patterns: blanks in the Unicode sense (Java's ASCII class leaves most of them out).
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_BLANK = "[^" + BLANK[1:]
# the same characters as a plain string
BLANK_CHARS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)

# Fixed patterns: list markers such as "(a) ", " 1. " and " iv) ".
BULLET = rf"(?:\(|{BLANK})[0-9a-zA-Z][.)]{BLANK}+|(?:\(|{BLANK})[ivxIVX]+[.)]{BLANK}+"
URL = rf"(www|http){NON_BLANK}+"

# Fixed patterns: paragraphs that open like a tariff line, a table row or a page number.
NOISE_PARAGRAPHS = [r"^\d+\.\d+", r"^\d+(?: -)+", r"^\d+ *$", r"^\d{2}", rf"^{BLANK}*$"]

# Fixed patterns: article headings, applied one after the other.
ARTICLE_HEADINGS = [
    r"(?i)\n *(?:rule|article) \d+ *?\n",
    r"(?i)\n *(?:rule|article)\d+ *?\n",
    r"(?i)\n *(?:rule|article) \d+\.\d+ *?\n",
    r"(?i)\n *(?:rule|article) \d+\.\d+ *:",
    r"(?i)\n *(?:rule|article) \d+ *:",
]

# Fixed patterns: clause numbers, applied one after the other.
CLAUSE_MARKS = [r"\n\d+\. +\n", r"\n\d+\. +", r"\. +\d+\."]

# Fixed pattern: clause numbers of running text.
INLINE_CLAUSE_MARK = r"\. +\d+\."

# Fixed pattern: blank-line paragraph break.
PARAGRAPH_BREAK = r"(?: \n){2,}"

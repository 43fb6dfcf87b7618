"""Column expressions for text: stripping, tokenizers, stopwords, clean text.

Every function here returns a `Column`; nothing leaves the JVM.  The
tokenizers are built from `regexp_extract_all` + higher-order array
functions, so they run inside Spark's expression engine on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
# Stopword list the word statistics must use, exactly as given (English
# function words and contractions, then abstract-section words).  The
# contractions can never match an alphanumeric token; they are kept so the
# list stays the same set.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "aren't", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "can't", "cannot", "could", "couldn't",
    "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during",
    "each",
    "few", "for", "from", "further",
    "had", "hadn't", "has", "hasn't", "have", "haven't", "having", "he", "he'd", "he'll", "he's",
    "her", "here", "here's",
    "hers", "herself", "him", "himself", "his", "how", "how's",
    "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its",
    "itself",
    "let's",
    "me", "more", "most", "mustn't", "my", "myself",
    "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "ought", "our", "ours",
    "ourselves", "out", "over", "own",
    "same", "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some",
    "such",
    "than", "that", "that's", "the", "their", "theirs", "them", "themselves", "then", "there",
    "there's", "these", "they",
    "they'd", "they'll", "they're", "they've", "this", "those", "through", "to", "too",
    "under", "until", "up",
    "very",
    "was", "wasn't", "we", "we'd", "we'll", "we're", "we've", "were", "weren't", "what", "what's",
    "when", "when's", "where",
    "where's", "which", "while", "who", "who's", "whom", "why", "why's", "with", "won't", "would",
    "wouldn't",
    "you", "you'd", "you'll", "you're", "you've", "your", "yours", "yourself", "yourselves",
    "background", "methods", "method", "results", "conclusions", "conclusion", "objective",
    "objectives", "aim", "aims",
    "study", "studies", "based", "using", "use", "used",
    "paper", "however", "therefore", "thus", "may", "also", "could", "within", "among",
)
STOPWORD_SET = tuple(sorted(set(STOPWORDS)))

# Word pattern of the word statistics, and of the coherence tokenizer.
COHERENCE_PATTERN = "[a-z0-9-]+"
COHERENCE_MIN_LEN = 3
# Characters a Python-style strip() removes (str.isspace), as a regex class.
WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Null spellings a pandas CSV reader turns into missing values.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# ---------------------------------------------------------------------------


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of WHITESPACE_CLASS.
WHITESPACE_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
                    + "".join(map(chr, range(0x2000, 0x200B))))


def py_strip(c) -> Column:
    """strip() with Python's whitespace set (not just U+0020 like trim).

    Only the ends are looked at, so neither a long text nor a long inner run of
    whitespace costs time.
    """
    return F.btrim(col_of(c), F.lit(WHITESPACE_CHARS))


def is_blank(c) -> Column:
    """Empty after a Python-style strip: no character outside its whitespace set (stops at the first one)."""
    return ~col_of(c).rlike(r"[^" + WHITESPACE_CLASS[1:])


def collapse_ws(c) -> Column:
    """Collapse whitespace runs to one space, then strip."""
    return py_strip(F.regexp_replace(col_of(c), f"{WHITESPACE_CLASS}+", " "))


def join_text(a, b) -> Column:
    """strip(a + ' ' + b) on null-filled strings."""
    return py_strip(F.concat(F.coalesce(col_of(a), F.lit("")), F.lit(" "),
                             F.coalesce(col_of(b), F.lit(""))))


# An alphanumeric run holding at least one letter: anchored at a run start (the
# look-behind), leading digits taken possessively, then a letter and the rest of
# the run.  It yields exactly "runs of [A-Za-z0-9], pure digits dropped" in one
# linear regex pass (no per-token test, no backtracking on long digit runs).
ALNUM_WITH_LETTER = "(?<![A-Za-z0-9])[0-9]*+[A-Za-z][A-Za-z0-9]*"


def tokens_prefilter(c) -> Column:
    """Alphanumeric runs, pure digit tokens dropped, lower-cased (order kept)."""
    raw = F.regexp_extract_all(F.coalesce(col_of(c), F.lit("")), F.lit(ALNUM_WITH_LETTER), 0)
    return F.transform(raw, lambda t: F.lower(t))


def drop_stopwords(tokens, stopwords=STOPWORD_SET) -> Column:
    """Remove exact stopwords, keeping duplicates and order (unlike array_except).

    `isin` with many literals is rewritten by the optimizer into a hash set
    lookup, so the cost per token is constant.
    """
    stop = list(stopwords)
    return F.filter(col_of(tokens), lambda t: ~t.isin(stop))


def tokens_alnum(c, stopwords=STOPWORD_SET) -> Column:
    return drop_stopwords(tokens_prefilter(c), stopwords)


def clean_text(c, stopwords=STOPWORD_SET) -> Column:
    return F.array_join(tokens_alnum(c, stopwords), " ")


def tokens_coherence(c, min_len: int = COHERENCE_MIN_LEN) -> Column:
    """Lower-case, keep runs of [a-z0-9-], drop tokens shorter than `min_len`."""
    # a run is taken whole or not at all: the match is greedy, and what is left of a short run is shorter
    return F.regexp_extract_all(F.lower(F.coalesce(col_of(c), F.lit(""))),
                                F.lit(f"{COHERENCE_PATTERN[:-1]}{{{min_len},}}"), 0)


def tokens_whitespace(c) -> Column:
    """Non-empty pieces of a whitespace split."""
    return F.filter(F.split(F.coalesce(col_of(c), F.lit("")), f"{WHITESPACE_CLASS}+"),
                    lambda t: t != "")

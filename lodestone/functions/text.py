"""Text analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no search meaning in a question (the fallback list of the keyword builder).
QUESTION_STOPWORDS = """
a an the and or but if then else when at by for with about against between into through during before after above below
to from up down in out on off over under again further than once here there all any both each few more most other some
such no nor not only own same so too very can will just should now of is are was were be been being have has had do does
did as it its their them they this that these those what which who whom why how please list tr pt within pattern
""".split()

#: The common list of English stop words; those with an apostrophe never are single tokens.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

#: Stop classes of the index lexer beyond the default English list.
INDEX_STOPWORDS = ["show", "want", "please", "column", "table", "view"]

LEXER = r"[^\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), LEXER), lambda w: w != "")


def index_terms(c: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens without stop words and plain numbers."""
    stop = stopwords if stopwords is not None else QUESTION_STOPWORDS + INDEX_STOPWORDS
    # One filter for empty words, plain numbers (nothing is left behind their digits) and stop words: it runs for every token. Most tokens
    # do not begin with a digit, so digits are looked for in few.
    return F.filter(F.split(F.lower(c), LEXER), lambda w: ((w >= ":") | (F.ltrim(w, F.lit("0123456789")) != "")) & ~w.isin(stop))


def keyword_query(c: Column) -> Column:
    """Distinct upper-case words of a question joined by OR, in order of appearance; null if only stop words are left."""
    words = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.lower(w))
    kept = F.array_distinct(F.filter(words, lambda w: ~w.isin(QUESTION_STOPWORDS)))
    return let(F.array_join(F.transform(kept, lambda w: F.upper(w)), " OR "), lambda x: F.when(x != "", x))


#: Words that hold one of these are dropped by the token-wise keyword builder.
KEYWORD_TABOO = ["tr", "pt", "within", "pattern"]


def keyword_query_tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """keyword_query over word tokens: only tokens of letters count, without stop words and words that hold an operator's name."""
    stop = stopwords if stopwords is not None else ENGLISH_STOPWORDS
    bare = F.regexp_replace(F.lower(c), r"n't\b|'(s|re|ve|ll|d|m)\b", " ")
    words = F.split(bare, r"[^\p{L}\p{N}_'-]+")
    kept = F.filter(words, lambda w: w.rlike(r"^\p{L}+$") & ~w.isin(stop) & ~w.rlike("|".join(KEYWORD_TABOO)))
    return let(F.array_join(F.transform(F.array_distinct(kept), lambda w: F.upper(w)), " OR "), lambda x: F.when(x != "", x))


def chunks(words: Column, size: int = 100, overlap: int = 10) -> Column:
    """Windows of words; each starts `size - overlap` words after the one before it."""
    step = size - overlap

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(step))
        return F.filter(F.transform(starts, lambda i: F.slice(w, i + 1, size)), lambda c: F.size(c) > 0)

    return let(words, cut)


#: A sentence: what leads up to marks that end one, or marks alone.
SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"


def recursive_chunks(text: Column, size: int = 100, overlap: int = 10) -> Column:
    """Chunks of at most `size` words, as arrays of words: paragraphs (lines) that are short enough; of others the sentences that are;
    of other sentences windows of words that overlap. What has no words is no chunk."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    none = F.array().cast("array<array<string>>")
    windows = lambda w: F.when(F.size(w) <= size, F.array(w)).otherwise(chunks(w, size, overlap))
    sentences = lambda c: F.flatten(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), lambda s: let(words(s), windows)))
    paragraph = lambda c: let(words(c), lambda w: F.when(F.size(w) <= size, F.array(w)).otherwise(sentences(c)))
    parts = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), paragraph))
    return F.coalesce(F.filter(parts, lambda c: F.size(c) > 0), none)


def annotation_text(pairs: Column, raw: Column) -> Column:
    """`name: value` (or the value alone) of each pair, joined; the collapsed raw text if nothing is left; null for null."""
    parts = F.filter(
        F.transform(pairs, lambda a: F.when(a["value"].isNotNull() & a["name"].isNotNull(), F.concat(collapse(a["name"]), F.lit(": "), collapse(a["value"]))).otherwise(collapse(a["value"]))),
        lambda x: x.isNotNull(),
    )
    return F.when(raw.isNotNull(), F.coalesce(F.nullif(F.array_join(parts, "; "), F.lit("")), collapse(raw)))


def clean_description(c: Column, most: int = 3900) -> Column:
    """Collapsed text cut to `most` characters with an ellipsis; null if it says nothing."""

    def cut(flat: Column) -> Column:
        says = flat.isNotNull() & (flat != "") & ~F.lower(flat).isin("<comment>", "comment", "null", "none", "n/a")
        return F.when(says, F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat))

    return let(collapse(c), cut)


def short_identifier(c: Column, most: int = 100) -> Column:
    """Long names are cut and end with six digits of their SHA-1."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 7), F.lit("_"), F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 6)))


def prompt(question: Column, evidence: Column) -> Column:
    return F.trim(F.concat_ws(" ", question, evidence))


def fuzzy_equal(a: Column, b: Column, most: int = 1) -> Column:
    """Words within an edit distance."""
    return F.levenshtein(a, b, most) >= 0


def strip_tags(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, common entities are decoded, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return collapse(bare)

"""The vocabulary of a keyword index: English stems, and look-up of terms by a part of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shape of a stem as runs of consonants and vowels; y is a consonant where a word or a run of vowels lets it be one.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MORE_THAN_0 = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
MORE_THAN_1 = MORE_THAN_0 + VOWELS + CONSONANTS
EXACTLY_1 = f"{MORE_THAN_0}({VOWELS})?$"
HAS_VOWEL = f"^({CONSONANTS})?[aeiouy]"
SHORT_END = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

#: The suffix rules of the English stemmer (Porter, 1980), step by step. A rule: suffix, replacement, what the stem must match.
#: Of the suffixes that end a word only the longest counts, whether its stem matches or not.
PLURALS = [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]
STEP_2 = """
ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate,
ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble
"""
STEP_3 = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
STEP_4 = "al, ance, ence, er, ic, able, ible, ant, ement, ment, ent, ou, ism, ate, iti, ous, ive, ize"


def _rules(text: str, condition: str) -> list[tuple[str, str, str]]:
    pairs = [x.split() for x in text.split(",")]
    return [(p[0], "" if len(p) == 1 or p[1] == "-" else p[1], condition) for p in pairs]


#: The steps after the participles, each a list of rules.
LATER_STEPS = [
    [("y", "i", HAS_VOWEL)],
    _rules(STEP_2, MORE_THAN_0),
    _rules(STEP_3, MORE_THAN_0),
    [*_rules(STEP_4, MORE_THAN_1), ("sion", "s", MORE_THAN_1), ("tion", "t", MORE_THAN_1)],
]


def _shortest_last(rules: list) -> list:
    return sorted(rules, key=lambda r: -len(r[0]))


def _step(word: Column, rules: list) -> Column:
    """The word after the rule of its longest suffix."""
    out = None
    for suffix, new, condition in _shortest_last(rules):
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        # What is left of `s` and `t` belongs to the stem where the rule for `ion` asks for it.
        tested = F.concat(stem, F.lit(new)) if suffix in ("sion", "tion") and condition == MORE_THAN_1 else stem
        fits = tested.rlike(condition) if condition else F.lit(True)
        then = F.when(fits, F.concat(stem, F.lit(new))).otherwise(word)
        case = word.endswith(suffix)
        out = F.when(case, then) if out is None else out.when(case, then)
    return out.otherwise(word)


def stemmed(terms: DataFrame, term: str = "term", out: str = "stem") -> DataFrame:
    """Adds the English stem of each term: lower-case words of three letters and more change, others stay.

    Give it distinct terms. Each step is a column of its own, so that no rule's test is made more than once for a word.
    """
    steps = "_stem"
    word = lambda: F.col(steps)
    df = terms.withColumn(steps, F.col(term)).withColumn(steps, _step(word(), PLURALS))
    # Participles: `eed` loses its last letter; `ed` and `ing` go from stems with a vowel, whose end is then mended.
    cut = lambda n: F.substring(word(), F.lit(1), F.length(word()) - n)
    ed, ing = word().endswith("ed") & cut(2).rlike(HAS_VOWEL), word().endswith("ing") & cut(3).rlike(HAS_VOWEL)
    df = df.withColumn("_bare", F.when(word().endswith("eed"), F.lit(None)).when(ed, cut(2)).when(ing, cut(3)))
    bare = F.col("_bare")
    mended = (
        F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike(DOUBLE), F.substring(bare, F.lit(1), F.length(bare) - 1))
        .when(bare.rlike(EXACTLY_1) & bare.rlike(SHORT_END), F.concat(bare, F.lit("e"))).otherwise(bare)
    )
    agreed = F.when(word().endswith("eed") & cut(3).rlike(MORE_THAN_0), cut(1)).otherwise(word())
    df = df.withColumn(steps, F.when(bare.isNotNull(), mended).otherwise(agreed)).drop("_bare")
    for rules in LATER_STEPS:
        df = df.withColumn(steps, _step(word(), rules))
    drop_e = word().endswith("e") & (cut(1).rlike(MORE_THAN_1) | (cut(1).rlike(EXACTLY_1) & ~cut(1).rlike(SHORT_END)))
    df = df.withColumn(steps, F.when(drop_e, cut(1)).otherwise(word()))
    df = df.withColumn(steps, F.when(word().endswith("ll") & word().rlike(MORE_THAN_1), cut(1)).otherwise(word()))
    changes = F.col(term).rlike("^[a-z]{3,}$")
    return df.withColumn(out, F.when(changes, word()).otherwise(F.col(term))).drop(steps)


#: Letters of the longest grams; patterns shorter than this are looked up by grams of their own length.
GRAM = 3


def grams(text: Column, sizes: Column) -> Column:
    """The distinct runs of letters of the given lengths."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.when(F.length(text) >= n, of(n)).otherwise(F.array().cast("array<string>")))))


def gram_postings(terms: DataFrame, term: str = "term") -> DataFrame:
    """(gram, term): every distinct term under each of its grams of one to GRAM letters. Stored, this is the substring index."""
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    return terms.select(F.col(term).alias("term")).where("term <> ''").distinct().select(F.explode(grams(F.col("term"), sizes)).alias("gram"), "term")


def containing(patterns: DataFrame, postings: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, term): the terms that hold each distinct pattern, other than an empty one.

    Of a pattern's grams the rarest picks the terms that are looked at; these are verified. A pattern with a gram that no term has
    finds nothing, and terms under other grams are not looked at.
    """
    asked = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    wanted = asked.select("pattern", F.explode(grams(F.col("pattern"), F.array(F.least(F.length("pattern"), F.lit(GRAM))))).alias("gram"))
    used = wanted.select("gram").distinct()
    sizes = postings.join(used, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    known = wanted.join(sizes, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).where("rarest.n > 0")
    met = known.select("pattern", F.col("rarest.gram").alias("gram")).join(postings, "gram")
    return met.where(F.contains("term", "pattern")).select("pattern", "term")

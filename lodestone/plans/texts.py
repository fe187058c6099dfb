"""Text analysis over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search, wordlist
from lodestone.operators.frozen import frozen
from lodestone.operators.ranking import top_n
from lodestone.plans.retrieval import terms_sql
from lodestone.sources import readers


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def keywords_text_contains(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", T.keyword_query(F.col("text")).alias("keywords"))


def tokenise_stoplist(spark, d):
    terms = T.index_terms(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.array_join(terms, " ").alias("terms"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


def normalise_whitespace(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


def clean_description(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.clean_description(F.col("text")).alias("description"))


def prompt_concat(spark, d):
    c = _table(spark, d, "conversations")
    pair = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("evidence"))
    return pair.select("conv_id", T.prompt(F.col("question"), F.col("evidence")).alias("prompt"))


def question_normalise(spark, d):
    c = _table(spark, d, "conversations")
    raw = c.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("SQL"), F.when(F.col("role") != "user", F.col("text")).alias("query"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return raw.select("conv_id", place.alias("question_id"), F.coalesce("SQL", "query").alias("SQL"))


def prompt_dump_tables(spark, d):
    """Prompt dumps that offer a page's links as tables, with parts that must not count: the first message, notes, what follows the user's."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    message = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("content"))
    create = lambda name: F.concat(F.lit('Offer: CREATE TABLE "SITE"."'), name, F.lit('" ("A" NUMBER)'))
    links = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    one = lambda kind, name: F.array(part(kind, create(F.lit(name))))
    offered = F.transform(links, lambda x: part("TEXT", create(x)))
    dump = F.to_json(F.array(message("SYSTEM", one("TEXT", "first")), message("system", offered), message("SYSTEM", one("NOTE", "note")), message("USER", one("TEXT", "asked")), message("SYSTEM", one("TEXT", "late"))))
    pages = _table(spark, d, "pages").select("page_id", dump.alias("payload"))
    return readers.prompt_dumps(pages).select("page_id", F.array_join("tables", ",").alias("names"))


def html_text(spark, d):
    return _table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def annotation_formatter(spark, d):
    """Events' types and values as annotation pairs, with pairs that lack a name, a value or both."""
    e = _table(spark, d, "events")
    pair = F.struct(F.when(F.col("value") > 5, F.col("event_type")).alias("name"), F.when(F.col("value") < 60, F.col("props")).alias("value"))
    return e.select("event_id", T.annotation_text(F.array(pair), F.col("props")).alias("annotation"))


def fuzzy_terms(spark, d):
    """Pairs of label words of parts within one edit."""
    words = _table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    a, b = words.select(F.col("w").alias("a")), words.select(F.col("w").alias("b"))
    # Words within one edit share a key: a word with a gap in place of a letter, or with a gap put in at any place, the end included (there both keys are the same).
    half = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.array(F.concat(F.substring(c, F.lit(1), i), F.lit("*"), F.substring(c, i + 2, F.length(c))), F.concat(F.substring(c, F.lit(1), i), F.lit("*"), F.substring(c, i + 1, F.length(c))))))))
    left, right = a.withColumn("k", half(F.col("a"))), b.withColumn("k", half(F.col("b")))
    near = left.join(right, "k").where("a < b").select("a", "b").distinct()
    return near.where(T.fuzzy_equal(F.col("a"), F.col("b")))


def _vocabulary(spark, d):
    return _table(spark, d, "documents").select(F.explode(T.index_terms(F.col("text"))).alias("term")).distinct()


def stemmed_terms(spark, d):
    """The English stem of every term of the documents."""
    return wordlist.stemmed(_vocabulary(spark, d)).select("term", "stem")


def substring_terms(spark, d):
    """The documents' terms that hold each pattern; patterns are two to four letters from within the names of parts."""
    names = _table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"), (F.col("p_partkey") % 3 + 2).cast("int").alias("n"))
    patterns = names.select(F.substring("w", F.lit(2), F.col("n")).alias("pattern"))
    return wordlist.containing(patterns, frozen(wordlist.gram_postings(_vocabulary(spark, d))))


def _chunk_search(aggregator):
    def query(spark, d):
        asked = _table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
        found = search.chunk_search(asked, _table(spark, d, "documents"), aggregator=aggregator)
        best = top_n(found, ["query_id"], [F.desc("score"), F.asc("id")], 20)
        return best.select("query_id", "id", "score", "n_chunks", "rank", F.array_join(F.transform("chunks", lambda c: c["chunk"].cast("string")), ",").alias("chunks"))

    return query


def json_turns(spark, d):
    """Conversations as JSON documents, read back as rows of turns and of their words, with the places of both."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    turn = F.struct("turn", F.col("role").alias("from"), F.struct(words.alias("words")).alias("said"))
    document = F.to_json(F.struct(F.struct(F.count("*").alias("turns")).alias("head"), F.array_sort(F.collect_list(turn)).alias("items")))
    docs = _table(spark, d, "conversations").groupBy("conv_id").agg(document.alias("document"))
    words = readers.Nested("said.words", {"word": ("", "string")}, "word_nr")
    rows = readers.json_table(docs, "document", {"n_turns": ("head.turns", "bigint")}, readers.Nested("items", {"role": ("from", "string")}, "item_nr", words))
    return rows.groupBy("conv_id", "n_turns", "item_nr", "role").agg(F.count("word").alias("n_words"), F.max("word_nr").alias("last_nr"), F.max_by("word", "word_nr").alias("last_word"))


QUERIES = {
    f.__name__: f
    for f in (keywords_text_contains, tokenise_stoplist, normalise_whitespace, clean_description, prompt_concat, question_normalise, prompt_dump_tables, html_text, annotation_formatter, fuzzy_terms, stemmed_terms, substring_terms, json_turns)
} | {"chunk_search_max": _chunk_search("MAX"), "chunk_search_avg": _chunk_search("AVG")}
_stop = ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS)
_first = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_words = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)), lambda w: NOT list_contains([{_stop}], w))"
_flat = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_html = "html"
for _a, _b in (("(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), ("(?s)<!--.*?-->", " "), ("(?s)<[^>]*>", " ")):
    _html = f"regexp_replace({_html}, '{_a}', '{_b}', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _html = f"replace({_html}, '{_a}', '{_b}')"

ORACLES = {
    "keywords_text_contains": f"WITH w AS (SELECT conv_id, turn, {_words} AS w FROM conversations), u AS (SELECT conv_id, turn, {_first.format(x='w')} AS w FROM w) SELECT conv_id, turn, nullif(upper(array_to_string(w, ' OR ')), '') AS keywords FROM u",
    "tokenise_stoplist": f"SELECT doc_id, array_to_string({terms_sql('text')}, ' ') AS terms, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))::INT AS n_tokens FROM documents",
    "normalise_whitespace": f"SELECT doc_id, {_flat.format('text')} AS text FROM documents",
    "clean_description": f"SELECT doc_id, CASE WHEN t <> '' AND lower(t) NOT IN ('<comment>', 'comment', 'null', 'none', 'n/a') THEN CASE WHEN length(t) > 3900 THEN t[1:3900] || '...' ELSE t END END AS description FROM (SELECT doc_id, {_flat.format('text')} AS t FROM documents)",
    "prompt_concat": "SELECT conv_id, trim(concat_ws(' ', arg_min(text, turn), arg_max(text, turn))) AS prompt FROM conversations GROUP BY conv_id",
    "question_normalise": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS question_id, text AS SQL FROM conversations",
    "prompt_dump_tables": """WITH p AS (SELECT page_id, list_filter(regexp_extract_all(html, 'href="/([^"]*)"', 1), lambda x: x <> '') AS w FROM pages)
SELECT page_id, array_to_string(list_filter(w, lambda v, i: list_position(list_transform(w, lambda x: lower(x)), lower(v)) = i), ',') AS names FROM p""",
    "html_text": f"SELECT page_id, {_flat.format(_html)} AS text FROM pages",
    "annotation_formatter": """SELECT event_id, CASE WHEN props IS NOT NULL THEN CASE WHEN NOT value < 60 OR value IS NULL THEN p WHEN value > 5 THEN e || ': ' || p ELSE p END END AS annotation
FROM (SELECT *, trim(regexp_replace(props, '\\s+', ' ', 'g')) AS p, trim(regexp_replace(event_type, '\\s+', ' ', 'g')) AS e FROM events)""",
    "fuzzy_terms": "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w WHERE levenshtein(a.w, b.w) <= 1",
}


def _stem_sql() -> str:
    """The steps of the stemmer as nested queries over the distinct terms."""

    def step(rules):
        cases = []
        for suffix, new, condition in sorted(rules, key=lambda r: -len(r[0])):
            stem = f"w[:length(w) - {len(suffix)}]"
            tested = f"{stem} || '{new}'" if suffix in ("sion", "tion") and condition == wordlist.MORE_THAN_1 else stem
            fits = f"regexp_matches({tested}, '{condition}')" if condition else "true"
            cases.append(f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {fits} THEN {stem} || '{new}' ELSE w END")
        return f"CASE {' '.join(cases)} ELSE w END"

    cut = lambda n: f"w[:length(w) - {n}]"
    has = lambda c, x: f"regexp_matches({c}, '{x}')"
    bare = f"CASE WHEN w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' AND {has(cut(2), wordlist.HAS_VOWEL)} THEN {cut(2)} WHEN w LIKE '%ing' AND {has(cut(3), wordlist.HAS_VOWEL)} THEN {cut(3)} END"
    mended = f"""CASE WHEN b IS NULL THEN CASE WHEN w LIKE '%eed' AND {has(cut(3), wordlist.MORE_THAN_0)} THEN {cut(1)} ELSE w END WHEN {has('b', '(at|bl|iz)$')} THEN b || 'e'
      WHEN {has('b', wordlist.DOUBLE)} THEN b[:length(b) - 1] WHEN {has('b', wordlist.EXACTLY_1)} AND {has('b', wordlist.SHORT_END)} THEN b || 'e' ELSE b END"""
    query = f"SELECT term, {step(wordlist.PLURALS)} AS w FROM (SELECT term, term AS w FROM v)"
    query = f"SELECT term, {mended} AS w FROM (SELECT term, w, {bare} AS b FROM ({query}))"
    drop_e = f"w LIKE '%e' AND ({has(cut(1), wordlist.MORE_THAN_1)} OR ({has(cut(1), wordlist.EXACTLY_1)} AND NOT {has(cut(1), wordlist.SHORT_END)}))"
    for value in [*map(step, wordlist.LATER_STEPS), f"CASE WHEN {drop_e} THEN {cut(1)} ELSE w END", f"CASE WHEN w LIKE '%ll' AND {has('w', wordlist.MORE_THAN_1)} THEN {cut(1)} ELSE w END"]:
        query = f"SELECT term, {value} AS w FROM ({query})"
    return f"SELECT term, CASE WHEN regexp_matches(term, '^[a-z]{{3,}}$') THEN w ELSE term END AS stem FROM ({query})"


_vocabulary_sql = f"v AS (SELECT DISTINCT unnest({terms_sql('text')}) AS term FROM documents)"
_sql_words = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_pieces = (
    r"flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: CASE WHEN len({p}) <= 100 THEN [{p}] ELSE flatten(list_transform(regexp_extract_all(p, '[^.!?]+[.!?]*|[.!?]+'),"
    r" lambda s: CASE WHEN len({s}) <= 100 THEN [{s}] ELSE list_transform(range(0, greatest(len({s}) - 10, 1), 90), lambda i: {s}[i + 1:i + 100]) END)) END))"
).format(p=_sql_words.format("p"), s=_sql_words.format("s"))


def _chunk_sql(aggregator: str) -> str:
    score = "max(s)" if aggregator == "MAX" else "round(avg(s), 6)"
    return f"""WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
pieces AS (SELECT doc_id, list_filter({_pieces}, lambda c: len(c) > 0) AS p FROM documents),
chunks AS (SELECT doc_id AS id, unnest(range(len(p))) AS chunk, unnest(p) AS words FROM pieces),
d AS (SELECT id, chunk, {terms_sql("array_to_string(words, ' ')")} AS w FROM chunks), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
c AS (SELECT id, chunk, len, term, count(*) AS tf FROM (SELECT id, chunk, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT query_id, id, chunk, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS s
  FROM c JOIN f USING (term) JOIN asked USING (term), n GROUP BY query_id, id, chunk),
r AS (SELECT query_id, id, {score} AS score, count(*) AS n_chunks, array_to_string(list(chunk ORDER BY s DESC, chunk)[1:3], ',') AS chunks FROM s GROUP BY query_id, id)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM r QUALIFY rank <= 20"""


ORACLES |= {
    "stemmed_terms": f"WITH {_vocabulary_sql} {_stem_sql()}",
    "substring_terms": f"""WITH {_vocabulary_sql}, w AS (SELECT unnest(string_split(p_name, ' ')) AS w, p_partkey % 3 + 2 AS n FROM part),
p AS (SELECT DISTINCT w[2:1 + n] AS pattern FROM w WHERE w[2:1 + n] <> '') SELECT pattern, term FROM p JOIN v ON contains(term, pattern)""",
    "chunk_search_max": _chunk_sql("MAX"),
    "chunk_search_avg": _chunk_sql("AVG"),
    "json_turns": f"""SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS n_turns, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS item_nr, role, len(w) AS n_words,
nullif(len(w), 0)::INT AS last_nr, w[-1] AS last_word FROM (SELECT *, {_sql_words.format('text')} AS w FROM conversations)""",
}

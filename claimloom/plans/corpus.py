"""Queries from the corpus to claims: sentences, tokens, matches, topics, offsets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import matching as M
from ..session import small_batches
from .fixture import Fixture, with_fixtures

DETERMINERS = ["the", "a", "an", "der", "die", "das", "la", "le", "el", "los"]
PREPOSITIONS = ["of", "in", "on", "to", "with", "for", "from", "by", "de", "von", "mit", "en", "par"]
BE = ["is", "was", "are", "be", "est", "ist", "es"]

#: Patterns over general prose, of the shape that domain patterns have.
PROSE_PATTERNS = json.dumps(
    {
        "X of Y": [[{"POS": {"IN": ["NOUN", "DET"]}}, {"TEXT": {"IN": ["of", "de", "von"]}}, {"POS": "DET", "OP": "?"}, {"POS": "NOUN"}]],
        "X is Y": [[{"POS": "DET"}, {"POS": "NOUN", "OP": "+"}, {"LEMMA": "be"}, {"POS": "ADP", "OP": "?"}, {"POS": "NOUN"}]],
        "Y in X": [[{"POS": "NOUN"}, {"LEMMA": "in"}, {"POS": "ADP", "OP": "*"}, {"TEXT": {"IN": ["the", "that", "an"]}}]],
    }
)
TOPICS = Fixture(
    "topics", "ord int, id string, subtopic string, topic string, template string",
    [(0, "ID", "subtopic", "topic", "Template"), (1, "C1", "Part", "Relations", "X of Y"), (2, "C2", "Nature", "Relations", "X is Y"), (3, "C3", "Old place", "Places", "Y in X "), (4, "C4", "Place", "Places", "y in x"), (5, "C5", "Unused", "Other", "Z")],
)


def tagger(w: Column) -> tuple[Column, Column, Column]:
    low = F.lower(w)
    pos = F.when(low.isin(DETERMINERS), "DET").when(low.isin(PREPOSITIONS), "ADP").when(low.isin(BE), "VERB").otherwise("NOUN")
    return F.when(low.isin(BE), "be").otherwise(low), pos, F.lit("")


#: The tagger's words, for matching.
LEXICON = M.Lexicon({w: (w, "DET") for w in DETERMINERS} | {w: (w, "ADP") for w in PREPOSITIONS} | {w: ("be", "VERB") for w in BE}, "NOUN")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def _matches(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    units = M.worded(_docs(spark, sf_dir).select("doc_id", "text"))
    return M.matches(units, M.load_patterns(PROSE_PATTERNS), keep=list(keep), lexicon=LEXICON)


def flagship_topic_counts(spark, sf_dir):
    found = C.assign_topics(_matches(spark, sf_dir, "doc_id"), TOPICS.df(spark))
    return found.groupBy("topic", "subtopic").agg(F.count("*").alias("n_claims"), F.countDistinct("doc_id").alias("n_docs"))


def claim_matches(spark, sf_dir):
    words = F.array_join(F.slice("tokens", F.col("first") + 1, F.col("last") - F.col("first")), " ")
    m = _matches(spark, sf_dir, "doc_id", "sent_id", "tokens").withColumn("claim_text", words)
    return m.select("doc_id", "sent_id", "template", F.col("first").alias("first_token"), F.col("last").alias("last_token"), "claim_text", T.short_id(F.col("doc_id").cast("string"), F.col("sent_id").cast("string"), F.col("first").cast("string"), F.col("last").cast("string"), F.col("template")).alias("claim_id"))


def claim_topics(spark, sf_dir):
    found = C.assign_topics(_matches(spark, sf_dir, "doc_id"), TOPICS.df(spark))
    return found.groupBy("template", "topic", "subtopic").agg(F.count("*").alias("n_claims"))


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_SENTENCES = r"""
s AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS sent_id, unnest(l) AS sentence
  FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
)"""
_TOKENS = _SENTENCES + r""",
t AS (SELECT doc_id, sent_id, sentence, regexp_extract_all(sentence, '[\p{L}\p{N}]+') AS w FROM s),
tok AS (SELECT doc_id, sent_id, sentence, w FROM t WHERE len(w) > 0)"""
#: One class letter for a word: d determiner, o of, i in, p other preposition, b be, T that, n other.
_CLASS = f"""CASE WHEN lower(x) IN ('de', 'von', 'of') THEN CASE WHEN x IN ('of', 'de', 'von') THEN 'o' ELSE 'p' END
  WHEN lower(x) = 'in' THEN 'i'
  WHEN lower(x) IN {_in(DETERMINERS)} THEN CASE WHEN x IN ('the', 'an') THEN 'e' ELSE 'd' END
  WHEN lower(x) IN {_in(PREPOSITIONS)} THEN 'p' WHEN lower(x) IN {_in(BE)} THEN 'b'
  WHEN x = 'that' THEN 'T' ELSE 'n' END"""
_FOUND = _TOKENS + f""",
c AS (SELECT doc_id, sent_id, w, array_to_string(list_transform(w, lambda x: {_CLASS}), '') AS cls FROM tok),
p(template, steps) AS (VALUES ('X of Y', '[nTde]o[de]?[nT]'), ('X is Y', '[de][nT]+b[oip]?[nT]'), ('Y in X', '[nT]i[oip]*[eT]')),
i AS (SELECT *, unnest(range(0, length(cls))) AS a FROM c),
l AS (SELECT i.*, template, steps, length(regexp_extract(substring(cls, a + 1), '^(?:' || steps || ')')) AS longest FROM i CROSS JOIN p),
j AS (SELECT *, unnest(range(a + 1, a + longest + 1)) AS b FROM l WHERE longest > 0),
m AS (SELECT doc_id, sent_id, w, a, b, template FROM j WHERE regexp_full_match(substring(cls, a + 1, b - a), steps))"""
_TOPIC = "topic_of AS (SELECT lower(trim(template)) AS k, arg_max(topic, ord) AS topic, arg_max(subtopic, ord) AS subtopic FROM topics WHERE ord > 0 GROUP BY 1)"

ORACLE = {
    "flagship_topic_counts": f"{with_fixtures(TOPICS)}, {_FOUND}, {_TOPIC} SELECT topic, subtopic, count(*) AS n_claims, count(DISTINCT doc_id) AS n_docs FROM m LEFT JOIN topic_of ON k = lower(trim(m.template)) GROUP BY 1, 2",
    "claim_topics": f"{with_fixtures(TOPICS)}, {_FOUND}, {_TOPIC} SELECT m.template, topic, subtopic, count(*) AS n_claims FROM m LEFT JOIN topic_of ON k = lower(trim(m.template)) GROUP BY 1, 2, 3",
    "claim_matches": f"WITH {_FOUND} SELECT doc_id, sent_id::INT AS sent_id, template, a::INT AS first_token, b::INT AS last_token, array_to_string(w[a + 1:b], ' ') AS claim_text, substr(md5(concat_ws('|', doc_id, sent_id, a, b, template)), 1, 8) AS claim_id FROM m",
}


def corpus_doc_ids(spark, sf_dir):
    d = _docs(spark, sf_dir)
    name = F.concat(F.lit("/in/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".rsd").otherwise(""), F.lit(".txt"))
    return d.select("doc_id", T.stem_of_file(name).alias("stem"), T.source_of(T.last_segment(name)).alias("source_name"), T.last_segment(name).alias("file_name"))


ORACLE["corpus_doc_ids"] = """WITH n AS (SELECT doc_id, 'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.rsd' ELSE '' END AS s FROM documents)
SELECT doc_id, 'doc' || doc_id AS stem, s AS source_name, s || '.txt' AS file_name FROM n"""


def sentence_split(spark, sf_dir):
    return M.tokenised(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "sent_id", F.size("tokens").alias("n_tokens"), F.char_length("sentence").alias("n_chars"))


ORACLE["sentence_split"] = f"WITH {_TOKENS} SELECT doc_id, sent_id::INT AS sent_id, len(w)::INT AS n_tokens, length(sentence)::INT AS n_chars FROM tok"


def token_offsets(spark, sf_dir):
    t = M.tokenised(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "sent_id", F.posexplode("tokens").alias("tok_id", "t"))
    out = M.running_offsets(t.select("doc_id", "sent_id", "tok_id", F.col("t.text").alias("token"), F.lit(True).alias("space")))
    return out.select("doc_id", "sent_id", "tok_id", "token", "start", "stop")


ORACLE["token_offsets"] = f"""WITH {_TOKENS}, u AS (SELECT doc_id, sent_id, generate_subscripts(w, 1) - 1 AS tok_id, unnest(w) AS token FROM tok),
o AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, sent_id::INT AS sent_id, tok_id::INT AS tok_id, token, start::INT AS start, (start + length(token) - 1)::INT AS stop FROM o"""


def search_forward_offsets(spark, sf_dir):
    t = M.tokenised(_docs(spark, sf_dir).select("doc_id", "text"))
    found = t.select("doc_id", "sent_id", F.posexplode(M.search_offsets(F.col("sentence"), F.transform("tokens", lambda x: x["text"]))).alias("tok_id", "x"))
    return found.select("doc_id", "sent_id", "tok_id", "x.*")


ORACLE["search_forward_offsets"] = f"""WITH {_TOKENS}, u AS (SELECT doc_id, sent_id, sentence, generate_subscripts(w, 1) - 1 AS tok_id, unnest(w) AS token FROM tok),
o AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS low FROM u),
f AS (SELECT *, instr(substring(sentence, low + 1), token) AS pos FROM o)
SELECT doc_id, sent_id::INT AS sent_id, tok_id::INT AS tok_id, token, CASE WHEN pos = 0 THEN -1 ELSE low + pos - 1 END::INT AS start, (CASE WHEN pos = 0 THEN -1 ELSE low + pos - 1 END + length(token) - 1)::INT AS stop FROM f"""

REFINE = Fixture("lines", "id int, line string", [(1, 'He said ("no") today [twice] — then; left.'), (2, "one two three four five six , seven . eight"), (3, ""), (4, 'a(b)c "d"'), (5, "- , x y z ! w")])


def refine_tokens(spark, sf_dir):
    return REFINE.df(spark).select("id", F.array_join(T.refine_tokens(F.filter(F.split("line", " "), lambda t: t != ""), 3), "|").alias("refined"))


ORACLE["refine_tokens"] = f"""{with_fixtures(REFINE)}, t AS (SELECT id, list_filter(string_split(line, ' '), lambda x: x <> '') AS l FROM lines),
r AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(array_to_string(l, ' '), '([()\\[\\]"—])', ' \\1 ', 'g'), ' +'), lambda x: x <> '') AS l FROM t),
q AS (SELECT id, list_transform(l, lambda x: CASE WHEN x = '"' THEN '''' ELSE x END) AS l FROM r),
p AS (SELECT id, l, list_min(list_filter(range(0, len(l)), lambda i: i >= 3 AND l[i + 1] IN ('!', '?', '.', ':', ';', '—', ',', '-'))) AS stop FROM q)
SELECT id, array_to_string(CASE WHEN stop IS NULL THEN l ELSE l[1:stop + 1] END, '|') AS refined FROM p"""


def stopword_clip(spark, sf_dir):
    t = M.tokenised(_docs(spark, sf_dir).select("doc_id", "text"))
    w = F.transform("tokens", lambda x: x["text"])
    return t.select("doc_id", "sent_id", F.array_join(T.clip(w), " ").alias("clipped"), T.clip_short(w).alias("short"))


#: The stop words without apostrophes, which the words here never have, in the order of the alphabet.
_STOPS = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d did didn do does doesn doing don down during each few for from further had hadn has hasn "
    "have haven having here hers herself himself his how i if in into is isn its itself just like ll m ma mightn more most mustn my myself needn no nor not now o of off on once only or other ourselves out over own re s same shan "
    "should shouldn so some such t than that the their theirs themselves then there these this those through to too under until up ve very was wasn were weren what when where which while who whom why will with won wouldn y yours "
    "yourself yourselves"
).split()
ORACLE["stopword_clip"] = f"""WITH {_TOKENS}, k AS (SELECT doc_id, sent_id, w, list_filter(range(1, len(w) + 1), lambda i: lower(w[i]) NOT IN {_in(_STOPS)}) AS pos FROM tok),
c AS (SELECT doc_id, sent_id, CASE WHEN len(pos) = 0 THEN [] ELSE w[pos[1]:pos[-1]] END AS l FROM k)
SELECT doc_id, sent_id::INT AS sent_id, array_to_string(l, ' ') AS clipped, CASE WHEN len(l) > 4 THEN '' ELSE array_to_string(l, ' ') END AS short FROM c"""


def offsets_for_text(spark, sf_dir):
    """The last sentence words and the first ones, as offsets of a text: its first and its last word."""
    t = M.tokenised(_docs(spark, sf_dir).select("doc_id", "text"))
    off = M.search_offsets(F.col("sentence"), F.transform("tokens", lambda x: x["text"]))
    o = t.select("doc_id", "sent_id", off.alias("o"))
    first, last = F.element_at("o", 1), F.element_at("o", -1)
    span = M.span_of_text(F.transform(F.filter("o", lambda x: x["token"] == first["token"]), lambda x: x["start"]), F.transform(F.filter("o", lambda x: x["token"] == last["token"]), lambda x: x["stop"]))
    return o.select("doc_id", "sent_id", span.alias("s")).select("doc_id", "sent_id", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))


ORACLE["offsets_for_text"] = f"""WITH {_TOKENS}, u AS (SELECT doc_id, sent_id, sentence, w, generate_subscripts(w, 1) - 1 AS tok_id, unnest(w) AS token FROM tok),
o AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS low FROM u),
f AS (SELECT *, CASE WHEN instr(substring(sentence, low + 1), token) = 0 THEN -1 ELSE low + instr(substring(sentence, low + 1), token) - 1 END AS start FROM o),
g AS (SELECT doc_id, sent_id, list(start) FILTER (WHERE token = w[1]) AS fs, list(start + length(token) - 1) FILTER (WHERE token = w[-1]) AS ls FROM f GROUP BY 1, 2),
h AS (SELECT doc_id, sent_id, ls, list_max(list_filter(fs, lambda x: x < list_max(ls))) AS start FROM g)
SELECT doc_id, sent_id::INT AS sent_id, start::INT AS start, CASE WHEN start IS NULL THEN NULL ELSE list_min(list_filter(ls, lambda e: e > start)) END::INT AS stop FROM h"""

DOMAIN_PATTERNS = json.dumps(
    {
        "no X against it": [[{"LOWER": {"IN": ["no", "any"]}}, {"POS": "ADJ", "OP": "*"}, {"POS": "NOUN"}, {"LEMMA": {"IN": ["against", "for"]}, "OP": "?"}, {"TEXT": {"IN": "CORONA_NAME_VARIATIONS"}}]],
        "it rose by X": [[{"TEXT": {"IN": "CORONA_NAME_VARIATIONS"}}, {"POS": "NOUN", "OP": "?"}, {"LEMMA": {"IN": ["rise", "fall"]}}, {"ENT_TYPE": {"IN": ["PERCENT", "CARDINAL"]}, "OP": "+"}, {"LOWER": "yesterday", "OP": "?"}]],
    }
)
DOMAIN_TOKENS = Fixture(
    "toks", "sent int, i int, text string, lemma string, pos string, ent_type string",
    [
        (1, 0, "There", "there", "PRON", ""), (1, 1, "is", "be", "VERB", ""), (1, 2, "No", "no", "DET", ""), (1, 3, "proven", "proven", "ADJ", ""), (1, 4, "cheap", "cheap", "ADJ", ""), (1, 5, "cure", "cure", "NOUN", ""), (1, 6, "for", "for", "ADP", ""), (1, 7, "SARS-CoV-2", "sars-cov-2", "NOUN", ""),
        (2, 0, "Coronavirus", "coronavirus", "NOUN", None), (2, 1, "cases", "case", "NOUN", None), (2, 2, "fell", "fall", "VERB", None), (2, 3, "about", "about", "ADV", "PERCENT"), (2, 4, "9", "9", "NUM", "PERCENT"), (2, 5, "%", "%", "SYM", "PERCENT"), (2, 6, "Yesterday", "yesterday", "NOUN", "DATE"),
        (3, 0, "any", "any", "DET", ""), (3, 1, "mask", "mask", "NOUN", ""), (3, 2, "flu", "flu", "NOUN", ""), (4, 0, "covid-19", "covid-19", "NOUN", None), (4, 1, "rose", "rise", "VERB", None), (4, 2, "twice", "twice", "ADV", "CARDINAL"),
        (5, 0, "any", "any", "DET", ""), (5, 1, "test", "test", "NOUN", ""), (5, 2, "covid-19", "covid-19", "PROPN", ""), (5, 3, "rose", "rise", "VERB", ""), (5, 4, "up", "up", "ADV", ""),
    ],
)


def claim_matches_domain(spark, sf_dir):
    units = DOMAIN_TOKENS.df(spark).groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("i", "text", "lemma", "pos", "ent_type"))).alias("tokens"))
    m = M.matches(units, M.load_patterns(DOMAIN_PATTERNS))
    text = F.array_join(F.transform(F.slice("tokens", F.col("first") + 1, F.col("last") - F.col("first")), lambda t: t["text"]), " ")
    return m.select("sent", "template", F.col("first").alias("first_token"), F.col("last").alias("last_token"), text.alias("claim_text"))


#: Letters of a token: h no or any, a adjective, n noun, N noun that is a name, V other name, p preposition, r rise or fall, q number, y yesterday.
ORACLE["claim_matches_domain"] = f"""{with_fixtures(DOMAIN_TOKENS)}, v AS (SELECT *, text IN ('COVID-19', 'Coronavirus', 'SARS-CoV-2', 'coronavirus', 'corona virus', 'covid-19', 'covid 19') AS nm FROM toks),
k AS (SELECT sent, i, text, CASE WHEN lower(text) IN ('no', 'any') THEN 'h' WHEN pos = 'ADJ' THEN 'a' WHEN nm AND pos = 'NOUN' THEN 'N' WHEN nm THEN 'V' WHEN lower(text) = 'yesterday' THEN 'y' WHEN pos = 'NOUN' THEN 'n' WHEN lemma IN ('against', 'for') THEN 'p' WHEN lemma IN ('rise', 'fall') THEN 'r' WHEN ent_type IN ('PERCENT', 'CARDINAL') THEN 'q' ELSE 'z' END AS c FROM v),
r AS (SELECT x.sent, x.i AS a, y.i + 1 AS b, (SELECT string_agg(text, ' ' ORDER BY i) FROM k WHERE k.sent = x.sent AND k.i >= x.i AND k.i <= y.i) AS claim_text, (SELECT string_agg(c, '' ORDER BY i) FROM k WHERE k.sent = x.sent AND k.i >= x.i AND k.i <= y.i) AS s FROM k x JOIN k y ON x.sent = y.sent AND y.i >= x.i)
SELECT sent, 'no X against it' AS template, a AS first_token, b AS last_token, claim_text FROM r WHERE regexp_full_match(s, 'ha*[nNy]p?[NV]')
UNION ALL SELECT sent, 'it rose by X', a, b, claim_text FROM r WHERE regexp_full_match(s, '[NV][nNy]?rq+y?')"""


def topic_by_similarity(spark, sf_dir):
    """Embeddings as sentence vectors, those of the first twelve ids as templates: the nearest template."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return C.nearest_template(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id < 12").select(F.col("vec_id").alias("template_id"), F.col("embedding").alias("t")), 12)


ORACLE["topic_by_similarity"] = """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS template_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM n a, n b WHERE b.vec_id < 12)
SELECT id, template_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, template_id) AS k FROM p) WHERE k = 1"""


def template_containment(spark, sf_dir):
    from ..operators.spans import contained_texts

    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("needle"))
    return contained_texts(_docs(spark, sf_dir).select("doc_id", "text"), b, "doc_id", "item_id")


ORACLE["template_containment"] = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def valid_claim_fraction(spark, sf_dir):
    d = _docs(spark, sf_dir)
    q = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return C.valid_fraction(d.join(q, "doc_id", "left").select(F.when(F.col("quality") == 0, "").otherwise(F.col("text")).alias("claim_span_text"), "lang"), "lang")


ORACLE["valid_claim_fraction"] = """SELECT lang, count(*) AS n_claims, count(*) FILTER (WHERE t <> '') AS n_valid, round(avg((t IS NOT NULL AND t <> '')::INT), 6) AS valid_share
FROM (SELECT lang, CASE WHEN quality = 0 THEN '' ELSE text END AS t FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1"""


def markup_reject(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return C.usable_sentences(p.select("page_id", title.alias("claim_sentence"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("claim_text"), F.col("html").alias("raw")), "raw", "<table").select("page_id", F.size(T.words(F.col("claim_sentence"))).alias("n_tokens"))


ORACLE["markup_reject"] = r"""WITH p AS (SELECT page_id, html, regexp_extract(html, '<title>(.*?)</title>', 1) AS s, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS c FROM pages),
t AS (SELECT *, len(regexp_extract_all(s, '[\p{L}\p{N}]+')) AS n, len(regexp_extract_all(c, '[\p{L}\p{N}]+')) AS k FROM p)
SELECT page_id, n::INT AS n_tokens FROM t WHERE NOT contains(html, '<table') AND n > 1 AND k > 1"""


def claims_sorted(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.short_id(F.col("doc_id").cast("string"), F.col("source")).alias("claim_id"), F.to_json(F.struct(F.col("lang"), F.col("source"))).alias("body"))
    return d.orderBy("doc_id", "claim_id")


ORACLE["claims_sorted"] = """SELECT doc_id, substr(md5(doc_id || '|' || source), 1, 8) AS claim_id, to_json({'lang': lang, 'source': source})::VARCHAR AS body FROM documents ORDER BY 1, 2"""

QUERIES = {n: globals()[n] for n in ORACLE}

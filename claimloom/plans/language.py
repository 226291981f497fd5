"""Queries over the language of the documents: tokens without loss, abbreviations, claims of whole documents, edits, tags."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.tokens import tokenised_documents
from ..operators import borders as B
from ..operators import documents as D
from ..operators import inflection as I
from ..operators import matching as M
from ..operators import tagging as G
from ..session import written
from . import workflow
from .corpus import LEXICON, PREPOSITIONS, _docs, tagger

ORACLE: dict[str, str] = {}


def token_rebuild(spark, sf_dir):
    """Every document put together from its tokens, with what the tokens say of its length."""
    out = tokenised_documents(_docs(spark, sf_dir).select("doc_id", "text"), workflow.tokenizer()).withColumn("again", D.text_of(F.col("tokens")))
    ends = F.transform("tokens", lambda t: t["start"] + F.char_length(t["text"]) + t["space"].cast("int"))
    return out.select("doc_id", F.md5(F.col("again").cast("binary")).alias("text_md5"), F.coalesce(F.array_max(ends), F.when(F.col("again").isNotNull(), 0)).alias("n_chars"))


ORACLE["token_rebuild"] = "SELECT doc_id, md5(text) AS text_md5, length(text)::INT AS n_chars FROM documents"

_PLAIN = [
    [{"POS": {"IN": ["NOUN", "DET"]}}, {"LEMMA": "{}", "OP": "+"}, {"POS": "ADP", "OP": "*"}, {"POS": "NOUN", "OP": "?"}, {"POS": "NOUN"}],
    [{"POS": "DET"}, {"POS": "NOUN", "OP": "*"}, {"LEMMA": "be"}, {"POS": "ADP", "OP": "?"}, {"LOWER": "{}"}],
]
#: 28 patterns as a domain's catalogue has them, with general words in place of the domain's. Nearly every word counts as a
#: noun here, so they are not open at both ends, where their matches would be the square of a sentence.
CATALOGUE = json.dumps({f"{w} {k}": [json.loads(json.dumps(p).replace("{}", w))] for w in [*PREPOSITIONS[:12], "and", "on"] for k, p in enumerate(_PLAIN)})


def document_claims(spark, sf_dir):
    """Matches of all 28 patterns over whole documents, punctuation included, counted by pattern and length."""
    found = D.text_matches(_docs(spark, sf_dir).select("doc_id", "text"), M.load_patterns(CATALOGUE), MARKED, ["template", "first", "last", "span_start", "span_stop"], workflow.tokenizer())
    return found.groupBy("template", (F.col("last") - F.col("first")).alias("n_tokens")).agg(F.count("*").alias("n_claims"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("span_stop") - F.col("span_start")).alias("n_chars"))


#: The tags of ``_marked``, for matching.
MARKED = M.Lexicon(LEXICON.entries, LEXICON.pos, "PUNCT")


def _marked(w):
    """The lexicon's tags; what has no letter is punctuation."""
    lemma, pos, ent = tagger(w)
    return lemma, F.when(w.rlike(r"[\p{L}\p{N}]"), pos).otherwise("PUNCT"), ent


def learned_abbreviations(spark, sf_dir):
    """Words of the documents with their stops, and the score of those that are abbreviations."""
    counts = written(B.word_counts(_docs(spark, sf_dir).select("text"), workflow.tokenizer()))  # it is read three times
    scored = B.abbreviations(counts).select("word", F.round("score", 6).alias("score"))
    return counts.where("n_stop > 0").join(scored, "word", "left")


#: Endings of forms and of lemmas, in the test corpus' languages.
KINDS = {"ing": ("ing", "ed"), "er": ("er", "en"), "tion": ("tion", "t"), "es": ("es", "e"), "ly": ("ly", "th")}


def edit_rules(spark, sf_dir):
    """The edit that most pairs of words with an ending have, in both directions, with its pairs."""
    counts = I.edit_counts(I.lemma_counts(_docs(spark, sf_dir).select("text"), KINDS))
    return counts.join(I.best_edits(counts), ["direction", "kind", "ending", "fall", "put"])


ORACLE["edit_rules"] = f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS form FROM documents), f AS (SELECT form, count(*) AS n FROM w GROUP BY 1),
k(kind, a, b) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in KINDS.items())}),
p AS (SELECT kind, form, form[1:length(form) - length(a)] || b AS lemma, n FROM f, k WHERE form LIKE '%' || a AND length(form) > length(a) + 1),
q AS (SELECT * FROM p WHERE lemma IN (SELECT form FROM f)),
d AS (SELECT 'lemma' AS direction, kind, form AS x, lemma AS y, n FROM q UNION ALL SELECT 'form', kind, lemma, form, n FROM q),
s AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[1:i] = y[1:i])), 0) AS same FROM d),
e AS (SELECT direction, kind, right('^' || x, j) AS ending, x[same + 1:] AS fall, y[same + 1:] AS put, sum(n)::BIGINT AS n FROM s, range(0, 6) AS r(j) WHERE j <= length(x) + 1 GROUP BY ALL)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY direction, kind, ending ORDER BY n DESC, length(fall), put DESC, fall DESC) = 1"""


def learned_tags(spark, sf_dir):
    """Tags of a model that was fitted on 4,000 sentences with the lexicon's tags, against the lexicon's, over all documents."""
    docs, lexicon = _docs(spark, sf_dir).select("doc_id", "text"), lambda w: _marked(w)[1]
    model = G.fit_on_texts(docs, lexicon, workflow.tokenizer(), sentences=4000, epochs=2)
    rows = G.tag_counts(docs, model, workflow.tokenizer()).select(lexicon(F.col("text")).alias("lexicon"), F.coalesce("tag", F.lit("")).alias("learned"), "n")
    return rows.groupBy("lexicon", "learned").agg(F.sum("n").alias("n"))


QUERIES = {n: globals()[n] for n in ("token_rebuild", "document_claims", "learned_abbreviations", "edit_rules", "learned_tags")}

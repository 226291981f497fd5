"""Knowledge-base nodes for a description of an event or for a name: what is asked, what comes back, what is chosen.

Tables: queries(query, context), tokens(query, ord, text, lemma, pos) of each query's cleaned text as a tagger gives them,
cache(cache_key, ord, qnode, label, alias, description, score) of candidates that a service gave for a request. Options
have a list: "options" are the best candidates, "other" the best of a fixed list of nodes, "all" every candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stems import stemmed
from ..session import written
from .candidates import THRESHOLD, lookup, participle

OPTION = ["query", "list", "ord", "qnode", "name", "definition", "score", "from_query"]


def with_same_stem(words: DataFrame, stems: DataFrame) -> DataFrame:
    """(word, k, form) from (word) and a stem table (stem, words): the forms of the word's stem, else, if that has more than
    four letters, of the stem without its last letter, else without its last two.
    """
    s = words.select("word").distinct().withColumn("stem", stemmed(F.col("word")))
    long = F.char_length("stem") > 4
    cut = lambda n: F.when(long, F.left("stem", F.char_length("stem") - n))
    tries = s.select("word", F.posexplode(F.array(F.col("stem"), cut(1), cut(2))).alias("k", "stem")).where("stem IS NOT NULL")
    hit = tries.join(stems, "stem").groupBy("word").agg(F.min_by("words", "k").alias("words"))
    return hit.select("word", F.posexplode("words").alias("k", "form"))


def verb_requests(tokens: DataFrame, verbs: DataFrame, stems: DataFrame | None = None, inflect: Callable[[Column], Column] = participle) -> DataFrame:
    """(query, ord, request, weight): for each verb its lemma, its present participle and the forms of its stem.

    Verbs are the tokens tagged so, then others that are verb forms (form) as they stand or as lemmas, these with weight
    0.9; both in the order of the text, repeats included.
    """
    forms = verbs.select(F.lower("form").alias("form")).distinct()
    t = tokens.withColumn("tagged", F.col("pos") == "VERB")
    known = t.where("NOT tagged").select("query", "ord", F.explode(F.array(F.lower("text"), F.lower("lemma"))).alias("form")).join(forms, "form", "left_semi").select("query", "ord").distinct()
    chosen = t.where("tagged").select("query", "ord", "lemma", F.lit(0).alias("part")).unionByName(t.where("NOT tagged").join(known, ["query", "ord"], "left_semi").select("query", "ord", "lemma", F.lit(1).alias("part")))
    weight = F.when(F.col("part") == 0, 1.0).otherwise(0.9)
    asked = chosen.select("query", F.struct("part", "ord", F.lit(0).alias("kind"), F.lit(0).alias("k")).alias("at"), F.col("lemma").alias("request"), weight.alias("weight"))
    asked = asked.unionByName(chosen.select("query", F.struct("part", "ord", F.lit(1).alias("kind"), F.lit(0).alias("k")).alias("at"), inflect(F.col("lemma")).alias("request"), weight.alias("weight")))
    if stems is not None:
        more = chosen.join(with_same_stem(chosen.select(F.col("lemma").alias("word")), stems), F.col("lemma") == F.col("word"))
        asked = asked.unionByName(more.select("query", F.struct("part", "ord", F.lit(2).alias("kind"), "k").alias("at"), F.col("form").alias("request"), weight.alias("weight")))
    return _in_order(asked.where("request IS NOT NULL"))


def name_requests(queries: DataFrame, tokens: DataFrame, stems: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a name asks for, and what it asks for if nothing comes of that, both (query, ord, request, weight).

    First the cleaned text; of a single word also its lemma, if that is another word, and the forms of its stem. Else the
    lemma of each token.
    """
    q = queries.select("query", T.query_text(F.col("query")).alias("clean")).distinct()
    at = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("k")).alias("at")
    one = F.lit(1.0).alias("weight")
    asked = q.select("query", at(0, F.lit(0)), F.col("clean").alias("request"), one)
    single = q.where(F.size(F.split(F.trim("clean"), r"\s+")) < 2)
    lemma = single.join(tokens.where("ord = 0").select("query", "lemma"), "query").where("lemma <> clean")
    asked = asked.unionByName(lemma.select("query", at(1, F.lit(0)), F.col("lemma").alias("request"), one))
    if stems is not None:
        more = single.join(with_same_stem(single.select(F.col("clean").alias("word")), stems), F.col("clean") == F.col("word"))
        asked = asked.unionByName(more.select("query", at(2, F.col("k")), F.col("form").alias("request"), one))
    return _in_order(asked), _in_order(tokens.select("query", at(0, F.col("ord").cast("int")), F.col("lemma").alias("request"), one))


def _in_order(asked: DataFrame) -> DataFrame:
    w = Window.partitionBy("query").orderBy("at")  # a query asks for some dozen words
    return asked.withColumn("ord", F.row_number().over(w) - 1).select("query", "ord", "request", "weight")


def candidates_of(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(query, pos, request, weight, qnode, label, description): candidates in the order of requests and of each answer."""
    hits, _ = lookup(requests.select(F.col("request").alias("query")), cache)
    c = requests.join(hits.withColumnRenamed("query", "request").withColumnRenamed("ord", "c_ord"), "request")
    w = Window.partitionBy("query").orderBy("ord", "c_ord")
    return c.withColumn("pos", F.row_number().over(w) - 1).select("query", "pos", "request", "weight", "qnode", "label", "description")


def _name(c: str = "label") -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def options_of(queries: DataFrame, candidates: DataFrame, score: Callable[[Column, Column], Column], k: int = 3, threshold: float = THRESHOLD, listed: DataFrame | None = None) -> DataFrame:
    """OPTION rows of each query.

    Of equal name and definition the first candidate is scored, against the context, or the cleaned query if that is empty;
    the ``k`` best with the threshold's score are its options. listed: (ord, qnode, label, description) of nodes that every
    query is scored against too, in a table of a few hundred; the best that are no options are the other ones.
    """
    text = F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.col("context")).otherwise(T.query_text(F.col("query")))
    q = queries.select("query", text.alias("said")).distinct()
    said = lambda: F.concat_ws(": ", F.col("name"), F.when(F.col("definition") != "", F.col("definition")))
    c = candidates.select("query", "pos", F.col("request").alias("from_query"), "qnode", _name().alias("name"), _name("description").alias("definition"))
    first = F.row_number().over(Window.partitionBy("query", "name", "definition").orderBy("pos")) == 1
    c = written(c.withColumn("first", first).join(q, "query").withColumn("score", F.when(F.col("first"), score(F.col("said"), said()))))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "pos")
    top = c.where("first").withColumn("ord", F.row_number().over(best) - 1).where((F.col("ord") < k) & (F.col("score") >= threshold))
    shape = lambda df, name: df.withColumn("list", F.lit(name)).select(OPTION)
    out = shape(top, "options").unionByName(shape(c.withColumn("ord", F.col("pos")), "all"))
    if listed is not None:
        few = listed.agg(F.array_sort(F.collect_list(F.struct("ord", "qnode", _name().alias("name"), _name("description").alias("definition")))).alias("few"))
        o = q.withColumn("few", few.scalar()).select("query", "said", F.explode("few").alias("x")).select("query", "said", "x.*").withColumn("pos", F.col("ord"))
        o = o.withColumn("score", score(F.col("said"), said())).withColumn("ord", F.row_number().over(best) - 1).where((F.col("ord") < k) & (F.col("score") >= threshold))
        o = o.join(top.select("query", "qnode").distinct(), ["query", "qnode"], "left_anti").withColumn("from_query", F.lit(None).cast("string"))
        out = out.unionByName(shape(o, "other"))
    return out


def disambiguated_verbs(queries: DataFrame, tokens: DataFrame, verbs: DataFrame, cache: DataFrame, score: Callable, stems: DataFrame | None = None, k: int = 3, listed: DataFrame | None = None) -> DataFrame:
    """OPTION rows for descriptions of events, by their verbs."""
    return options_of(queries, candidates_of(verb_requests(tokens, verbs, stems), cache), score, k, listed=listed)


def disambiguated_names(queries: DataFrame, tokens: DataFrame, cache: DataFrame, score: Callable, stems: DataFrame | None = None, k: int = 3, listed: DataFrame | None = None) -> DataFrame:
    """OPTION rows for names; those for which nothing is found are asked for by token."""
    whole, parts = name_requests(queries, tokens, stems)
    c = written(candidates_of(whole, cache))
    rest = parts.join(c.select("query").distinct(), "query", "left_anti")
    return options_of(queries, c.unionByName(candidates_of(rest, cache)), score, k, listed=listed)


def combined(names: DataFrame, verbs: DataFrame) -> DataFrame:
    """The options of both, those of names first."""
    both = names.withColumn("part", F.lit(0)).unionByName(verbs.withColumn("part", F.lit(1)))
    w = Window.partitionBy("query", "list").orderBy("part", "ord")
    return both.withColumn("ord", F.row_number().over(w) - 1).select(OPTION)


def chosen_option(options: DataFrame) -> DataFrame:
    """(query, qnode, name, definition, confidence): the first option, else the first other one, else of all candidates the one
    with the highest score over 0, ties in order. The confidence is that score, and 1 for the others.
    """
    rank = F.when(F.col("list") == "options", 0).when(F.col("list") == "other", 1).otherwise(2)
    score = F.coalesce("score", F.lit(0.0))
    usable = options.where((F.col("list") != "all") | (score > 0)).withColumn("rank", rank).withColumn("by", F.when(rank == 2, -score).otherwise(0.0))
    best = usable.groupBy("query").agg(F.min_by(F.struct("qnode", "name", "definition", F.when(F.col("rank") == 2, score).otherwise(1.0).alias("confidence")), F.struct("rank", "by", "ord")).alias("b"))
    return best.select("query", "b.*")

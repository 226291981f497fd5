"""Stages from files to files, as the command line runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..functions.tokens import ABBREVIATIONS, Tokenizer, token_words, tokenised_documents
from ..operators import aif, amr
from ..operators import claims as C
from ..operators import documents as D
from ..operators import edl as E
from ..operators import graph as G
from ..operators import matching as M
from ..operators import qnodes as Q
from ..operators import semantics as S
from ..operators import spans as P
from ..operators.borders import learn_borders
from ..operators.tagging import SequenceTagger, tag_documents
from ..session import written
from ..sources import corpus, turtle
from ..sources import tokens as token_store


def tokenizer() -> Tokenizer:
    """The tokenizer that keeps the names whole that patterns ask for."""
    return Tokenizer([*ABBREVIATIONS, *[n for n in M.NAME_VARIATIONS if " " not in n]])


def tokenise(spark: SparkSession, texts: str, learn: bool = False) -> DataFrame:
    """Documents of a folder of text files with their tokens; learn: sentence borders by the abbreviations of these texts."""
    docs = corpus.read_texts(spark, texts)
    return tokenised_documents(docs, tokenizer(), learn_borders(docs, tokenizer()) if learn else None)


def detect(spark: SparkSession, texts: str | None, patterns: str, topics: str, most_tokens: int | None = None, tagger=None, tokens: str | None = None, kind: str = "parquet") -> DataFrame:
    """Claims of a folder of text files, or of a table of tagged tokens: template, topic, text, sentence and place of each match.

    Patterns are matched over all tokens of a document, punctuation included, over sentence borders too. span_start and
    span_stop count characters of the document, the stop being past the claim; sent_start is where the sentence begins that
    the claim begins in. texts are tagged by ``tagger`` (see documents.tagged); tokens bring their own lemmas, parts of
    speech and entity types (see sources.tokens).
    """
    if (texts is None) == (tokens is None):
        raise ValueError("either texts or tokens")
    learned = isinstance(tagger, SequenceTagger)
    docs = token_store.read_tokens(spark, tokens, kind) if tokens else D.tagged(tokenise(spark, texts).drop("text"), None if learned else tagger)
    docs = tag_documents(docs, tagger) if learned else docs
    m = D.document_matches(docs, M.load_patterns(corpus.read_whole(spark, patterns)), most_tokens)
    out = m.select(
        T.short_id(F.col("doc_id"), F.col("sent_id").cast("string"), F.col("first").cast("string"), F.col("last").cast("string"), F.col("template")).alias("claim_id"),
        "doc_id", "sent_id", "claim_text", "claim_sentence", "sent_start", "span_start", "span_stop", "template",
    )
    return C.assign_topics(out, corpus.read_topics(spark, topics))


def external_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Claims of another system with a span text, and the share of those."""
    c = corpus.read_claims(spark, path)
    return c.where("claim_span_text <> ''"), C.valid_fraction(c)


def entity_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions with their entities, mentions without one, entities."""
    f = E.split_lines(corpus.read_lines(spark, path))
    ents = E.entities(f)
    return *E.with_entities(E.mentions(f), ents), ents


def link_mentions(mentions: DataFrame, edl_mentions: DataFrame, contained: bool = True) -> DataFrame:
    """Mentions (m_id, doc_id, start, stop) with the entity that stands at their place, exactly or inside.

    Documents meet by their id up to the first dot.
    """
    head = F.substring_index("doc_id", ".", 1)
    m = mentions.select("m_id", head.alias("doc"), F.col("start").alias("m_start"), F.col("stop").alias("m_stop"))
    s = edl_mentions.withColumn("doc", head).select(F.struct("ord", "ent_id").alias("s_id"), "doc", F.col("start").alias("s_start"), F.col("stop").alias("s_stop"))
    return P.linked_spans(m, s, contained).select("m_id", "s_id.ent_id", "how")


def nearest_topics(claims: DataFrame, topics: DataFrame, encode=None) -> DataFrame:
    """Claims without a template of their own, with that of the nearest vector to their sentence, its topic, and the score.

    encode: a function of a text column to a vector column; by default hashed words (functions.models).
    """
    encode = encode or models.encoder()
    t = written(topics.where("ord > 0").select(F.col("ord").alias("template_id"), "template", "topic", "subtopic"))
    best = C.nearest_template(claims.select(F.col("claim_id").alias("id"), encode(F.col("claim_sentence")).alias("v")), t.select("template_id", encode(F.col("template")).alias("t")))
    found = best.join(t, "template_id").select(F.col("id").alias("claim_id"), "template", "topic", "subtopic", F.col("score").alias("template_score"))
    return claims.drop("template", "topic", "subtopic", "template_score").join(found, "claim_id", "left")


def parser_tokens(text, most: int = 50):
    """A text's tokens as a graph parser gets them: brackets, quotes and dashes apart, cut after a stop mark at or past ``most``."""
    return T.refine_tokens(token_words(text, tokenizer()), most)


def parser_input(claims: DataFrame, most: int = 50) -> DataFrame:
    """(graph_id, tokens) of the different sentences and texts of usable claims, for adapters.parse_graphs."""
    c = C.usable_sentences(claims)
    words = c.select(F.explode(F.array("claim_sentence", "claim_text")).alias("s")).select(parser_tokens(F.col("s"), most).alias("tokens")).distinct()
    return words.select(F.md5(F.array_join("tokens", " ").cast("binary")).alias("graph_id"), "tokens")


#: Tables of a set of graphs.
GRAPH_TABLES = ["graphs", "nodes", "edges", "tokens", "alignments"]


def graphs_of_claims(claims: DataFrame, tables: dict[str, DataFrame], text: str) -> dict[str, DataFrame]:
    """The graphs of the claims' texts, a copy for each claim, its id in place of the graph's.

    tables: GRAPH_TABLES by name; graphs have the tokens joined by blanks as token_text. Claims without a graph have no rows.
    """
    of = claims.select("claim_id", F.array_join(parser_tokens(F.col(text)), " ").alias("words"))
    ids = written(amr.graphs_by_tokens(of, tables["graphs"].select("graph_id", "token_text"), "words").where("graph_id IS NOT NULL").select("graph_id", "claim_id"))
    return {n: tables[n].join(ids, "graph_id").withColumn("graph_id", F.col("claim_id")).drop("claim_id") for n in GRAPH_TABLES}


def places_of(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """(m_id, start, stop): where texts (m_id, claim_id, text) stand in the sentence of their claim, in the document's
    characters, by their first and last word; without row if nowhere.
    """
    c = claims.select("claim_id", "claim_sentence", "sent_start", token_words(F.col("claim_sentence"), tokenizer()).alias("w"))
    c = c.select("claim_id", "sent_start", M.search_offsets(F.col("claim_sentence"), F.col("w")).alias("o"))
    j = texts.select("m_id", "claim_id", F.filter(F.split("text", " "), lambda w: w != "").alias("t")).where(F.size("t") > 0).join(c, "claim_id")
    of = lambda word, at: F.transform(F.filter("o", lambda x: x["token"] == word), lambda x: x[at])
    span = M.span_of_text(of(F.element_at("t", 1), "start"), of(F.element_at("t", -1), "stop"))
    return j.select("m_id", "sent_start", span.alias("s")).where("s IS NOT NULL").select("m_id", (F.col("sent_start") + F.col("s.start")).alias("start"), (F.col("sent_start") + F.col("s.stop")).alias("stop"))


def nodes_of_mentions(mentions: DataFrame, graph: dict[str, DataFrame], chosen: DataFrame, *stages: DataFrame) -> DataFrame:
    """(m_id, qnode, name) of mentions (m_id, graph_id, text): by the roleset of the mention's last word, else by the first of
    the stages (query, qnode, name), such as entity names and looked-up nodes, that knows one of its queries.
    """
    label = S.mention_labels(mentions, graph["nodes"], graph["tokens"], graph["alignments"]).withColumnRenamed("label", "pb")
    by_label = label.join(chosen.select("pb", "qnode", "name"), "pb").select("m_id", "qnode", "name")
    rest = mentions.join(by_label, "m_id", "left_anti")
    named = None
    for s in stages:
        named = s.select("qnode", "name") if named is None else named.unionByName(s.select("qnode", "name"))
    if named is None:
        return by_label
    by_name = Q.cascade(Q.mention_queries(rest), *stages).join(named.groupBy("qnode").agg(F.min("name").alias("name")), "qnode")
    return by_label.unionByName(by_name.select("m_id", "qnode", "name"))


def annotate(claims: DataFrame, sentences: dict[str, DataFrame], texts: dict[str, DataFrame], words: DataFrame, pos: DataFrame, verbs: DataFrame, chosen: DataFrame, roles: DataFrame, stages: list[DataFrame], ents: DataFrame | None = None, role_words: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims with claimer and open variable, their events, and the events' arguments, as aif.claim_triples takes them.

    sentences, texts: graphs of the claims' sentences and of their own texts. words (claim_id, i, lemma) of the claim's
    text, pos (claim_id, token, pos) of its sentence, verbs (verb) of statements, chosen (pb, qnode, name, score), roles
    (qnode, role), stages (query, qnode, name). ents (claim_id, ent_type): where given, variables are found by entity kinds
    instead of by the templates of a domain. role_words: arguments of the templates and of the claims by a role labeller,
    for variables that no graph gives. Claims without a graph, and those of markup or one word, stay as they are.
    """
    usable = written(C.usable_sentences(claims))
    sent, text = graphs_of_claims(usable, sentences, "claim_sentence"), graphs_of_claims(usable, texts, "claim_text")
    sent, text = ({n: written(t) for n, t in g.items()} for g in (sent, text))
    by_graph = lambda df: df.withColumnRenamed("claim_id", "graph_id")
    strings, own = written(amr.node_strings(sent["tokens"], sent["alignments"])), written(amr.node_strings(text["tokens"], text["alignments"]))
    heads = amr.claim_nodes(sent["nodes"], sent["edges"], by_graph(words), verbs)
    who = amr.claimers(sent["nodes"], sent["edges"], sent["tokens"], strings, heads, by_graph(pos)).groupBy("graph_id").agg(F.min("claimer").alias("text"))
    asked = by_graph(usable.select("claim_id", "template"))
    if ents is None:
        x = amr.open_variables(asked, text["graphs"], text["nodes"], text["edges"], text["tokens"], own)
    else:
        x = amr.general_variables(asked, text["nodes"], text["edges"], text["tokens"], own, by_graph(ents))
    x = x.select("graph_id", F.col("x_text").alias("text"))
    if role_words is not None:
        more = C.variable_from_roles(*role_words).select(F.col("claim_id").alias("graph_id"), F.col("x_text").alias("text"))
        x = x.unionByName(more.join(x.select("graph_id"), "graph_id", "left_anti"))
    events, args = S.claim_events(sent["nodes"], sent["edges"], strings, chosen.select("pb", "qnode", "score"), roles)
    events, args = written(events), written(args)

    slot = lambda df, kind: df.select(F.struct(F.col("graph_id").alias("claim_id"), F.lit(kind).alias("slot"), F.lit("").alias("event"), F.lit("").alias("role")).alias("m_id"), "graph_id", "text")
    of_args = args.select(F.struct(F.col("graph_id").alias("claim_id"), F.lit("argument").alias("slot"), F.col("event"), F.col("role")).alias("m_id"), "graph_id", "text")
    mentions = written(slot(who, "claimer").unionByName(slot(x, "x")).unionByName(of_args))
    nodes = nodes_of_mentions(mentions, sent, chosen, *stages)
    placed = mentions.join(places_of(usable, mentions.withColumnRenamed("graph_id", "claim_id")), "m_id", "left").join(nodes, "m_id", "left")
    node = F.struct(F.col("qnode").alias("qnode_id"), F.coalesce("name", "text").alias("text"), "start", "stop", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("entity"))
    placed = written(placed.withColumn("node", F.when(F.col("qnode").isNotNull(), node)))
    none = F.lit(None).cast(aif.NODE)

    def side(kind: str) -> DataFrame:
        return placed.where(F.col("m_id.slot") == kind).select("m_id.claim_id", F.col("text").alias(f"{kind}_text"), F.col("start").alias(f"{kind}_start"), F.col("stop").alias(f"{kind}_stop"), F.col("node").alias(f"{kind}_type"), none.alias(f"{kind}_identity"))

    out = claims.join(side("x"), "claim_id", "left").join(side("claimer"), "claim_id", "left").withColumns({"start": F.col("span_start"), "stop": F.col("span_stop"), "location": F.lit(None).cast("string")})
    named = chosen.groupBy("pb").agg(F.min_by("name", "qnode").alias("name"))
    at = places_of(usable, events.select(F.struct("graph_id", "ord").alias("m_id"), F.col("graph_id").alias("claim_id"), "text"))
    told = events.withColumn("m_id", F.struct("graph_id", "ord")).join(at, "m_id", "left").join(named, "pb", "left")
    key = lambda e: F.concat_ws("/", F.col("claim_id"), e)
    told = told.withColumnRenamed("graph_id", "claim_id").join(claims.select("claim_id", "doc_id"), "claim_id")
    # the arguments of a node go with the first event that stands at it
    first = F.row_number().over(Window.partitionBy("claim_id", "node_id").orderBy("ord")) == 1
    told = written(told.withColumn("event_id", F.when(first, key(F.col("node_id"))).otherwise(key(F.concat_ws("#", "node_id", "ord")))))
    event_rows = told.select("claim_id", "doc_id", "ord", "event_id", F.col("qnode").alias("qnode_id"), F.col("start").alias("span_start"), F.col("stop").alias("span_stop"), F.coalesce("name", "text").alias("text"), "confidence")
    arg_rows = placed.where("m_id.slot = 'argument' AND node IS NOT NULL").select("m_id.claim_id", "m_id.event", "m_id.role", F.col("node").alias("type"))
    arg_rows = arg_rows.select(key(F.col("event")).alias("event_id"), "claim_id", F.lit(0).alias("ord"), "role", "type", none.alias("identity"))
    return out, event_rows, arg_rows


def link_claims(claims: DataFrame, arguments: DataFrame, edl_mentions: DataFrame, known: DataFrame, contained: bool = False) -> tuple[DataFrame, DataFrame]:
    """Claims and arguments after open variables, claimers and arguments were matched with entities (see edl.promoted).

    claims: as annotate gives them, with x_text, x_start, x_stop, claimer_text and so on; arguments with their claim_id.
    edl_mentions: mentions with their entities; known: (qnode, name).
    """
    key = lambda slot, event="", role="": F.struct(F.col("claim_id"), F.lit(slot).alias("slot"), (F.col(event) if event else F.lit("")).alias("event"), (F.col(role) if role else F.lit("")).alias("role")).alias("m_id")
    docs = claims.select("claim_id", "doc_id")
    rows = None
    for s in ("x", "claimer"):
        one = claims.where(F.col(f"{s}_text").isNotNull()).select(key(s), "doc_id", F.col(f"{s}_start").alias("start"), F.col(f"{s}_stop").alias("stop"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_identity").alias("identity"))
        rows = one if rows is None else rows.unionByName(one)
    of_args = arguments.where("type IS NOT NULL").join(docs, "claim_id").select(key("argument", "event_id", "role"), "doc_id", F.col("type.start").alias("start"), F.col("type.stop").alias("stop"), "type", "identity")
    rows = written(rows.unionByName(of_args))
    hit = link_mentions(rows.where("start IS NOT NULL"), edl_mentions, contained).where("ent_id IS NOT NULL").select("m_id", "ent_id")
    ents = edl_mentions.select("ent_id", "ent_type", "ent_link", "type_link").distinct()
    slots = rows.join(hit.join(ents, "ent_id"), "m_id", "left").withColumnRenamed("m_id", "slot_id")
    done = written(E.promoted(slots, known))
    for s in ("x", "claimer"):
        one = done.where(F.col("slot_id.slot") == s).select("slot_id.claim_id", F.col("type").alias("__t"), F.col("identity").alias("__i"), F.lit(True).alias("__had"))
        claims = claims.join(one, "claim_id", "left").withColumns({f"{s}_type": F.when(F.col("__had"), F.col("__t")).otherwise(F.col(f"{s}_type")), f"{s}_identity": F.when(F.col("__had"), F.col("__i")).otherwise(F.col(f"{s}_identity"))}).drop("__t", "__i", "__had")
    one = done.where("slot_id.slot = 'argument'").select(F.col("slot_id.event").alias("event_id"), F.col("slot_id.role").alias("role"), F.col("type").alias("__t"), F.col("identity").alias("__i"), F.lit(True).alias("__had"))
    arguments = arguments.join(one, ["event_id", "role"], "left").withColumns({"type": F.when(F.col("__had"), F.col("__t")).otherwise(F.col("type")), "identity": F.when(F.col("__had"), F.col("__i")).otherwise(F.col("identity"))}).drop("__t", "__i", "__had")
    return claims, arguments


def claims_with_events(claims: DataFrame, events: DataFrame, arguments: DataFrame) -> DataFrame:
    """Claims with claim_semantics: an array of events, each with its arguments, as the JSON of a run has them."""
    a = arguments.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "type", "identity"))).alias("args"))
    e = events.join(a, "event_id", "left").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("ord", "event_id", "qnode_id", "text", "span_start", "span_stop", "confidence", "args"))).alias("claim_semantics"))
    return claims.join(e, "claim_id", "left")


def events_of(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and arguments of what ``claims_with_events`` made."""
    e = claims.select("claim_id", "doc_id", F.explode("claim_semantics").alias("e")).select("claim_id", "doc_id", "e.*")
    return e.drop("args"), e.select("claim_id", "event_id", F.explode("args").alias("a")).select("claim_id", "event_id", "a.*")


def write_claim_graphs(claims: DataFrame, out: str) -> None:
    """Claims with claim_semantics as Turtle, a folder for each document."""
    turtle.write_turtle(aif.claim_triples(claims, *events_of(claims)), out)


def graphs_by_document(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a folder of Turtle, the graph named by the document that its text justifications name; others go."""
    t = turtle.with_document(turtle.read_turtle(spark, path))
    return t.withColumn("graph_id", F.col("document")).drop("document").distinct()


def merge(spark: SparkSession, first: str, second: str, out: str) -> DataFrame:
    """Two folders of Turtle merged into a third, a folder for each document; returns the merged triples.

    Graphs of the second folder are written under the document that their justifications name as their source document;
    those that name none are left out, as there is no name to write them under.
    """
    b = written(graphs_by_document(spark, second))
    m = written(G.merge_stores(written(graphs_by_document(spark, first)), b))
    named = m.join(G.document_of(b, "aida:sourceDocument"), "graph_id").withColumn("graph_id", F.col("doc")).drop("doc")
    turtle.write_turtle(named, out)
    return m

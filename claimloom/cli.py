"""Command line: python -m claimloom.cli STAGE --option value …; each stage reads and writes folders.

detect and run take texts (--input) or a table of tagged tokens (--tokens, --token-format parquet, json or csv). Texts get
their parts of speech from a tagger that fit-tagger has learned (--tagger), if one is given.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analysis, documents, tagging
from .operators import claims as C
from .plans import workflow
from .sources import corpus, tokens

#: Options of each stage; those with a question mark may be left out.
STAGES = {
    "run": ("texts or tagged tokens to Turtle: detect, annotate, link, to-json, to-turtle", "input? tokens? token-format? tagger? patterns topics graphs tables entities known out most-tokens? domain? role-words? include-contains?"),
    "tokenise": ("a folder of texts as a table of tokens, for a tagger", "input out learn-borders?"),
    "fit-tagger": ("a tagger of parts of speech from a table of tagged tokens", "tokens token-format? out"),
    "detect": ("claims of a folder of texts, or of a table of tagged tokens", "input? tokens? token-format? tagger? patterns topics out most-tokens?"),
    "ingest-claims": ("claims of another system", "input out"),
    "topics-by-similarity": ("the nearest template of each claim's sentence", "input topics out"),
    "ingest-entities": ("tagged entity lines to mentions", "input out"),
    "parser-input": ("sentences and claims as tokens for a graph parser", "input out"),
    "annotate": ("claimers, open variables and events, from graphs", "input graphs tables out domain? role-words?"),
    "link": ("annotated claims matched with entities", "input entities known out include-contains?"),
    "to-json": ("a claim store as JSON lines", "input out"),
    "to-turtle": ("annotated JSON lines as Turtle", "input out"),
    "merge": ("two folders of Turtle", "first second out"),
    "merge-report": ("what a merge has added", "input marker out"),
    "topics": ("claims by topic and subtopic", "input out"),
    "frames": ("shares of claims with variables, claimers and their nodes", "input out"),
    "overlap": ("equal spans and sentences of two claim stores", "first second"),
}
FLAGS = {"include-contains", "learn-borders"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimloom")
    s = p.add_subparsers(dest="stage", required=True)
    for name, (text, options) in STAGES.items():
        a = s.add_parser(name, help=text)
        for o in options.split():
            if o.rstrip("?") in FLAGS:
                a.add_argument(f"--{o.rstrip('?')}", action="store_true")
            else:
                a.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"), type=int if o == "most-tokens?" else str)
    return p


def detect(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tagger = tagging.load_tagger(spark, a.tagger) if a.tagger else None
    return workflow.detect(spark, a.input, a.patterns, a.topics, a.most_tokens, tagger, tokens=a.tokens, kind=a.token_format or "parquet")


def _tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def annotate(spark: SparkSession, claims: DataFrame, graphs: str, tables: str, domain: str | None, role_words: str | None = None) -> DataFrame:
    """graphs: folders sentences and texts with GRAPH_TABLES, and words, pos and, unless the domain is given, ents; tables:
    verbs, chosen, roles and names; role_words: what a role labeller found, templates and claims, each (claim_id, tag, i,
    word), for variables that no graph gives; all Parquet.
    """
    tagged = [C.join_arguments(t, "claim_id") for t in _tables(spark, role_words, ["templates", "claims"]).values()] if role_words else None
    g = {n: _tables(spark, f"{graphs}/{n}", workflow.GRAPH_TABLES) for n in ("sentences", "texts")}
    t = _tables(spark, tables, ["verbs", "chosen", "roles", "names"])
    w = _tables(spark, graphs, ["words", "pos"] + ([] if domain else ["ents"]))
    return workflow.claims_with_events(*workflow.annotate(claims, g["sentences"], g["texts"], w["words"], w["pos"], t["verbs"], t["chosen"], t["roles"], [t["names"]], w.get("ents"), tuple(tagged) if tagged else None))


def link(spark: SparkSession, claims: DataFrame, entities: str, known: str, contained: bool) -> DataFrame:
    events, args = workflow.events_of(claims)
    linked, args = workflow.link_claims(claims.drop("claim_semantics"), args, spark.read.parquet(entities), spark.read.parquet(known), contained)
    return workflow.claims_with_events(linked, events, args)


def frames(claims: DataFrame) -> DataFrame:
    """One row: the shares of slots and nodes, and how entities spread over slots."""
    flat = claims.withColumnsRenamed({"x_text": "x", "claimer_text": "claimer"})
    known = lambda c: F.from_json(F.col(f"{c}.entity"), "ent_id string")["ent_id"].alias("ent_id")
    args = claims.select(F.explode("claim_semantics").alias("e")).select(F.explode("e.args").alias("a")).select("a.identity")
    slots = claims.where("x_text IS NOT NULL").select(known("x_identity")).unionByName(claims.where("claimer_text IS NOT NULL").select(known("claimer_identity"))).unionByName(args.select(known("identity")))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(analysis.slot_ratios(flat, ["x", "claimer"], ["identity", "type"])).join(one(analysis.entity_histogram(slots)), "k").drop("k")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("claimloom").getOrCreate()
    load, save = (lambda p: corpus.load_claims(spark, p)), corpus.save_claims
    if a.stage == "run":
        step = {n: f"{a.out}/{n}" for n in ("claims", "annotated", "mentions", "linked", "json", "turtle")}
        save(detect(spark, a), step["claims"])
        save(annotate(spark, load(step["claims"]), a.graphs, a.tables, a.domain, a.role_words), step["annotated"])
        save(workflow.entity_tables(spark, a.entities)[0], step["mentions"])
        save(link(spark, load(step["annotated"]), step["mentions"], a.known, a.include_contains), step["linked"])
        corpus.write_claims(load(step["linked"]), step["json"])
        workflow.write_claim_graphs(corpus.read_annotated(spark, step["json"]), step["turtle"])
    elif a.stage == "detect":
        save(detect(spark, a), a.out)
    elif a.stage == "fit-tagger":
        table = documents.token_table(tokens.read_tokens(spark, a.tokens, a.token_format or "parquet"))
        tagging.save_tagger(spark, tagging.fit_tagger(table), a.out)
    elif a.stage == "tokenise":
        tokens.write_tokens(workflow.tokenise(spark, a.input, a.learn_borders), a.out)
    elif a.stage == "ingest-claims":
        claims, share = workflow.external_claims(spark, a.input)
        save(claims, a.out)
        share.show()
    elif a.stage == "topics-by-similarity":
        save(workflow.nearest_topics(load(a.input), corpus.read_topics(spark, a.topics)), a.out)
    elif a.stage == "ingest-entities":
        save(workflow.entity_tables(spark, a.input)[0], a.out)
    elif a.stage == "parser-input":
        save(workflow.parser_input(load(a.input)), a.out)
    elif a.stage == "annotate":
        save(annotate(spark, load(a.input), a.graphs, a.tables, a.domain, a.role_words), a.out)
    elif a.stage == "link":
        save(link(spark, load(a.input), a.entities, a.known, a.include_contains), a.out)
    elif a.stage == "to-json":
        corpus.write_claims(load(a.input), a.out)
    elif a.stage == "to-turtle":
        workflow.write_claim_graphs(corpus.read_annotated(spark, a.input), a.out)
    elif a.stage == "merge":
        workflow.merge(spark, a.first, a.second, a.out)
    elif a.stage == "merge-report":
        corpus.write_distribution(analysis.merge_report(workflow.graphs_by_document(spark, a.input), a.marker), a.out)
    elif a.stage == "topics":
        corpus.write_distribution(load(a.input).groupBy("topic", "subtopic").count(), a.out)
    elif a.stage == "frames":
        corpus.write_distribution(frames(load(a.input)), a.out)
    else:
        one = lambda p: load(p).selectExpr("doc_id", "span_start as start", "span_stop as stop", "claim_sentence as sentence")
        analysis.overlap_counts(one(a.first), one(a.second)).show()


if __name__ == "__main__":
    main()

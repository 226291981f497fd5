"""Triples (graph_id, s, p, o) of the interchange ontology: patterns, updates, reachable parts, and the merge of two stores.

Predicates and types are full IRIs; functions take short names such as aida:Claim. Further columns of the triples, such
as the kind and datatype of the object, are kept where a triple is copied.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import TYPE, iri
from ..session import Stash, written
from .spans import near_spans


def kinds_agree(cluster: Column, found: Column) -> Column:
    return (cluster.contains("entity") & found.contains("entities")) | (cluster.contains("event") & found.contains("events"))


def objects(triples: DataFrame, predicate: str, name: str, subject: str = "s") -> DataFrame:
    """(graph_id, subject, name) of one predicate."""
    return triples.where(F.col("p") == iri(predicate)).select("graph_id", F.col("s").alias(subject), F.col("o").alias(name))


def of_type(triples: DataFrame, *kinds: str) -> DataFrame:
    """(graph_id, s) of the subjects of any of these types."""
    return triples.where((F.col("p") == TYPE) & F.col("o").isin([iri(k) for k in kinds])).select("graph_id", "s").distinct()


def spans_of(triples: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(graph_id, s, start, stop, source, confidence): justified places of subjects; the confidence may be missing."""
    j = objects(triples, "aida:justifiedBy", "j")
    key = ["graph_id", "j"]
    out = j.join(objects(triples, "aida:startOffset", "start", "j"), key).join(objects(triples, "aida:endOffsetInclusive", "stop", "j"), key).join(objects(triples, "aida:source", "source", "j"), key)
    conf = objects(triples, "aida:confidence", "c", "j").join(objects(triples, "aida:confidenceValue", "confidence", "c"), ["graph_id", "c"]).drop("c")
    out = out.join(conf, key, "left").drop("j")
    if types:
        out = out.join(of_type(triples, *types), ["graph_id", "s"], "left_semi")
    return out.withColumns({"start": F.col("start").cast("int"), "stop": F.col("stop").cast("int")})


def insert_where(triples: DataFrame, new: DataFrame, predicate: str) -> DataFrame:
    """The triples and those new ones whose subject has the predicate already, each once."""
    ready = triples.where(F.col("p") == iri(predicate)).select("graph_id", "s").distinct()
    return triples.unionByName(new.join(ready, ["graph_id", "s"], "left_semi").select(triples.columns)).distinct()


def replace_values(triples: DataFrame, mapping: DataFrame, predicate: str | None = None) -> DataFrame:
    """Values, of one predicate or of all, replaced by (graph_id, old, new), each triple once."""
    m = mapping.select(F.col("graph_id").alias("__g"), F.col("old").alias("__old"), F.col("new").alias("__new"))
    on = (F.col("graph_id") == F.col("__g")) & (F.col("o") == F.col("__old"))
    j = triples.join(m, on & (F.col("p") == iri(predicate)) if predicate else on, "left")
    return j.withColumn("o", F.coalesce("__new", "o")).select(triples.columns).distinct()


def document_of(triples: DataFrame, predicate: str = "aida:source") -> DataFrame:
    """(graph_id, doc): the smallest document that any text justification names."""
    return of_type(triples, "aida:TextJustification").join(objects(triples, predicate, "doc"), ["graph_id", "s"]).groupBy("graph_id").agg(F.min("doc").alias("doc"))


def reachable(triples: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, start, s): every node that a start (graph_id, start) leads to, itself included; cycles end.

    Only what starts lead to is followed (see ``closure``).
    """
    subjects = triples.select("graph_id", F.col("s").alias("b")).distinct()
    step = triples.select("graph_id", F.col("s").alias("a"), F.col("o").alias("b")).join(subjects, ["graph_id", "b"], "left_semi").where("a <> b").distinct()
    return closure(step, starts.select("graph_id", "start"))


#: Steps of a graph that one task follows by itself; a larger graph is followed in rounds by all.
TASK_STEPS = 200_000


def _followed(starts: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """All that the starts of one graph lead to."""
    after: dict = {}
    for a, b in zip(steps["a"], steps["b"], strict=True):
        after.setdefault(a, []).append(b)
    rows = []
    for graph, start in dict.fromkeys(zip(starts["graph_id"], starts["start"], strict=True)):
        met, front = {start}, [start]
        while front:
            front = [b for b in dict.fromkeys(b for a in front for b in after.get(a, ())) if b not in met]
            met.update(front)
        rows += [(graph, start, s) for s in met]
    return pd.DataFrame(rows, columns=["graph_id", "start", "s"])


def closure(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, start, s) from steps (graph_id, a, b) and (graph_id, start): all that starts lead to, and themselves.

    A graph of up to TASK_STEPS steps is followed from its starts within one task. Larger ones are followed in rounds: what
    the last round met is joined with the steps, and what was met before goes by an anti join. Cycles end either way.
    """
    stash = Stash(steps.sparkSession)
    steps, starts = stash(steps.select("graph_id", "a", "b")), stash(starts.select("graph_id", "start").distinct())
    large = stash(steps.groupBy("graph_id").count().where(F.col("count") > TASK_STEPS).select("graph_id"))
    some = starts.join(large, "graph_id", "left_anti")
    schema = starts.schema.add("s", starts.schema["start"].dataType)
    near = steps.join(some.select("graph_id").distinct(), "graph_id", "left_semi")
    out = some.groupBy("graph_id").cogroup(near.groupBy("graph_id")).applyInPandas(_followed, schema)
    if large.isEmpty():
        return stash(out)
    rest = steps.join(large, "graph_id", "left_semi").withColumnRenamed("a", "s")
    front = seen = stash(starts.join(large, "graph_id", "left_semi").select("graph_id", "start", F.col("start").alias("s")))
    while True:
        new = front.join(rest, ["graph_id", "s"]).select("graph_id", "start", F.col("b").alias("s")).distinct()
        front = stash(new.join(seen, ["graph_id", "start", "s"], "left_anti"))
        if front.isEmpty():
            return stash(out.unionByName(seen))
        seen = stash(seen.unionByName(front))
        stash.keep_only(steps, starts, large, seen, front)  # the rounds before are done with


#: Predicates that lead to justifications.
JUSTIFIES = ["aida:justifiedBy", "aida:informativeJustification"]


def merge_stores(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second store with what the first one knows of the same claims; both with o_kind and o_type or both without.

    A claim of the first store meets the claim of the same graph in the second whose name after the last # is its own name
    after the last /. Each semantics cluster of it is linked to the second's claim, under claimSemantics and associatedKEs,
    where that has any. Where the cluster's event or entity has a span that the second store has too, at the first of the
    nine places that any event or entity there stands at, and of the same kind, the cluster is copied with the one found as
    its prototype; else the cluster and all it leads to is copied, justifications with the document that the second's
    claim names. Statements of the first store are copied with what was found in place of what it stands for, if their
    subject then is an event of the result. Graphs of the second store without a partner stay.
    """
    a = of_type(first, "aida:Claim").select("graph_id", F.substring_index("s", "/", -1).alias("cid"), F.col("s").alias("claim_a"))
    b = of_type(second, "aida:Claim").select("graph_id", F.substring_index("s", "#", -1).alias("cid"), F.col("s").alias("claim_b"))
    pairs = a.join(b, ["graph_id", "cid"])
    clusters = written(pairs.join(objects(first, "aida:claimSemantics", "cluster", "claim_a"), ["graph_id", "claim_a"]).select("graph_id", "claim_b", "cluster").distinct())
    named = first.where(F.col("o").contains("events") | F.col("o").contains("entities")).select("graph_id", F.col("s").alias("cluster"), F.col("o").alias("ent"))
    proto = clusters.select("graph_id", "cluster").distinct().join(named, ["graph_id", "cluster"]).groupBy("graph_id", "cluster").agg(F.min("ent").alias("ent"))
    span_a = spans_of(first).groupBy("graph_id", F.col("s").alias("ent")).agg(F.min(F.struct("start", "stop")).alias("x"))
    mention = proto.join(span_a, ["graph_id", "ent"]).select(F.struct("graph_id", "cluster", "ent").alias("m_id"), F.col("graph_id").alias("doc"), F.col("x.start").alias("m_start"), F.col("x.stop").alias("m_stop"))
    known = spans_of(second, ["aida:Entity", "aida:Event"]).select(F.col("s").alias("s_id"), F.col("graph_id").alias("doc"), F.col("start").alias("s_start"), F.col("stop").alias("s_stop")).distinct()
    hit = written(near_spans(mention, known).select("m_id.*", F.col("s_id").alias("found")).where(kinds_agree(F.col("cluster"), F.col("found"))))

    def shaped(df: DataFrame) -> DataFrame:
        """As the second store's columns; what has no kind is an IRI."""
        more = {c: F.lit("iri") if c == "o_kind" else F.lit(None).cast("string") for c in second.columns if c not in df.columns}
        return df.withColumns(more).select(second.columns)

    out = second
    for predicate in ("aida:claimSemantics", "aida:associatedKEs"):
        link = clusters.select("graph_id", F.col("claim_b").alias("s"), F.lit(iri(predicate)).alias("p"), F.col("cluster").alias("o"))
        out = insert_where(out, shaped(link), predicate)
    same = hit.select("graph_id", F.col("cluster").alias("s"), "found")
    body = first.where(F.col("p") != iri("aida:prototype")).join(same.select("graph_id", "s"), ["graph_id", "s"], "left_semi")
    stands = shaped(same.select("graph_id", "s", F.lit(iri("aida:prototype")).alias("p"), F.col("found").alias("o")))
    lone = clusters.select("graph_id", "claim_b", F.col("cluster").alias("start")).join(hit.select("graph_id", F.col("cluster").alias("start")), ["graph_id", "start"], "left_anti")
    parts = written(reachable(first, lone.select("graph_id", "start").distinct()).join(lone, ["graph_id", "start"]).select("graph_id", "claim_b", "s").distinct())
    copied = first.join(parts.select("graph_id", "s").distinct(), ["graph_id", "s"], "left_semi")
    # the document that the second's claim names, else the one that its graph names
    of_claim = objects(second, "aida:justifiedBy", "j", "claim_b").join(objects(second, "aida:sourceDocument", "doc", "j"), ["graph_id", "j"]).groupBy("graph_id", "claim_b").agg(F.min("doc").alias("doc"))
    of_graph = document_of(second, "aida:sourceDocument").withColumnRenamed("doc", "graph_doc")
    shown = first.where(F.col("p").isin([iri(p) for p in JUSTIFIES])).join(parts, ["graph_id", "s"]).select("graph_id", "claim_b", F.col("o").alias("s")).distinct()
    told = shown.join(of_claim, ["graph_id", "claim_b"], "left").join(of_graph, "graph_id", "left").select("graph_id", "s", F.lit(iri("aida:sourceDocument")).alias("p"), F.coalesce("doc", "graph_doc").alias("o")).where("o IS NOT NULL")
    if "o_kind" in second.columns:
        told = told.withColumns({"o_kind": F.lit("literal"), "o_type": F.lit(iri("xsd:string"))})
    out = written(out.unionByName(body.select(second.columns)).unionByName(stands).unionByName(copied.select(second.columns)).unionByName(shaped(told)).distinct())
    said = first.join(of_type(first, "rdf:Statement"), ["graph_id", "s"], "left_semi")
    said = written(replace_values(said, hit.select("graph_id", F.col("ent").alias("old"), F.col("found").alias("new"))))
    about = objects(said, "rdf:subject", "about").join(of_type(out, "aida:Event").withColumnRenamed("s", "about"), ["graph_id", "about"], "left_semi").select("graph_id", "s").distinct()
    return out.unionByName(said.join(about, ["graph_id", "s"], "left_semi").select(second.columns)).distinct()

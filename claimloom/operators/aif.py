"""Claims to triples of the interchange ontology: names, ids, clusters, justifications, statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions.vocabulary import EX, TYPE, XSD, System, iri
from ..session import dense_ids, written
from .claims import valid_semantics

#: A knowledge-base node as a claim, an event or an argument has it; entity: what an entity linker knows of it, as text.
NODE = "struct<qnode_id:string,text:string,start:int,stop:int,confidence:double,entity:string>"
#: The claimer of a claim that names none: a human, standing nowhere.
AUTHOR = ("Q5", "human")
AUTHOR_ENTITY = "EN_Entity_EDL_ENG_0000000"


def with_author(claims: DataFrame) -> DataFrame:
    """``claims`` with ``by_author``: a claim without a claimer type (NODE) is its author's, of type human, without identity."""
    none = F.col("claimer_type").isNull()
    human = F.struct(F.lit(AUTHOR[0]).alias("qnode_id"), F.lit(AUTHOR[1]).alias("text"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("entity"))
    return claims.withColumns({"by_author": none, "claimer_identity": F.when(~none, F.col("claimer_identity")), "claimer_type": F.when(none, human).otherwise(F.col("claimer_type"))})


def zero_filled(n: Column, width: int) -> Column:
    """A number in ``width`` digits or more."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def event_ids(events: DataFrame) -> DataFrame:
    """``events`` with ``event_name``: consecutive from 0 over claims in order, in six digits."""
    return dense_ids(events, "n", "doc_id", "claim_id", "ord", first=0).withColumn("event_name", F.concat(F.lit("EN_Event_"), zero_filled(F.col("n"), 6))).drop("n")


def confidence(value: Column) -> Column:
    """Scientific notation with two decimals; nothing or 0 counts as 1. Halves of the last digit go up, in decimal."""
    v = F.when(value.isNull() | (value == 0), F.lit(1.0)).otherwise(value)
    e = F.floor(F.log10(F.abs(v))).cast("int")
    m = F.round(v / F.pow(F.lit(10.0), e), 2)
    up = F.abs(m) >= 10
    return F.concat(F.format_number(F.when(up, m / 10).otherwise(m), 2), F.lit("E"), F.when(e + up.cast("int") < 0, "-").otherwise("+"), F.lpad(F.abs(e + up.cast("int")).cast("string"), 2, "0"))


def _object(value, kind: str, datatype: str | None = None) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.struct(value.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_type"))


def node(value) -> Column:
    """An IRI or blank node as an object; a string is a short name."""
    value = F.lit(iri(value)) if isinstance(value, str) else value
    return F.struct(value.alias("o"), F.when(value.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))


def string(value) -> Column:
    return _object(value, "literal", XSD + "string")


def integer(value) -> Column:
    return _object(value, "literal", XSD + "int")


def blank(subject: Column, what: str) -> Column:
    """The name of a subject's blank node."""
    return F.concat(F.lit("_:b"), F.substring(F.md5(F.concat(subject, F.lit("|" + what)).cast("binary")), 1, 16))


#: Rows that one projection makes; more would outgrow what the JVM compiles as one method.
EMIT_ROWS = 12


def emit(df: DataFrame, *rows: tuple[Column, str, Column]) -> DataFrame:
    """(graph_id, s, p, o, o_kind, o_type) of a written table with the graph in ``g``; a triple without subject or object is left out."""
    out = None
    for i in range(0, len(rows), EMIT_ROWS):
        made = F.array(*[F.struct(s.alias("s"), F.lit(TYPE if p == "a" else iri(p)).alias("p"), o["o"].alias("o"), o["o_kind"].alias("o_kind"), o["o_type"].alias("o_type")) for s, p, o in rows[i : i + EMIT_ROWS]])
        part = df.select(F.col("g").alias("graph_id"), F.explode(made).alias("t")).select("graph_id", "t.*").where("o IS NOT NULL AND s IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


class Writer:
    """Triples of one system's claims."""

    def __init__(self, system: System):
        self.sys = system
        self.by = node(F.lit(system.base))

    def typed(self, s: Column, *kinds: str) -> list[tuple[Column, str, Column]]:
        return [*[(s, "a", node(k)) for k in kinds], (s, "aida:system", self.by)]

    def sure(self, s: Column, value: Column) -> list[tuple[Column, str, Column]]:
        """A confidence node below the subject."""
        b = blank(s, "confidence")
        return [(s, "aida:confidence", node(b)), *self.typed(b, "aida:Confidence"), (b, "aida:confidenceValue", _object(confidence(value), "literal", XSD + "double"))]

    def private(self, s: Column, text: Column) -> list[tuple[Column, str, Column]]:
        b = F.when(s.isNotNull() & text.isNotNull(), blank(s, "private"))
        return [(s, "aida:privateData", node(b)), *self.typed(b, "aida:PrivateData"), (b, "aida:jsonContent", string(N.unquoted(N.squeezed(text))))]

    def place(self, s: Column, source: Column, start: Column, stop: Column, value: Column) -> list[tuple[Column, str, Column]]:
        return [*self.typed(s, "aida:TextJustification"), *self.sure(s, value), (s, "aida:startOffset", integer(start)), (s, "aida:endOffsetInclusive", integer(stop)), (s, "aida:source", string(source))]

    def entity(self, ent: Column, data: Column, linked: Column, kind: Column | str, number: Column | str) -> list[tuple[Column, str, Column]]:
        """An entity with its link and the place it stands at."""
        j = F.when(data["start"].isNotNull() & data["stop"].isNotNull(), self.sys.name(F.col("g"), kind, "entityjustification", number, data["start"], data["stop"]))
        link = F.when(linked & data["qnode_id"].isNotNull(), blank(ent, "link"))
        return [
            *self.typed(ent, "aida:Entity"), (ent, "aida:justifiedBy", node(j)), (ent, "aida:link", node(link)), *self.typed(link, "aida:LinkAssertion"), (link, "aida:linkTarget", string(data["qnode_id"])),
            *self.sure(link, data["confidence"]), *self.private(ent, data["entity"]), *self.place(j, F.col("g"), data["start"], data["stop"], data["confidence"]),
        ]

    def cluster(self, name: Column, prototype: Column) -> list[tuple[Column, str, Column]]:
        return [*self.typed(name, "aida:SameAsCluster"), (name, "aida:prototype", node(prototype))]

    def statement(self, s: Column, kind: str, subject: Column, predicate: Column, value: Column) -> list[tuple[Column, str, Column]]:
        return [*self.typed(s, "rdf:Statement", kind), (s, "rdf:subject", node(subject)), (s, "rdf:predicate", predicate), (s, "rdf:object", value)]


def _told(data: Column) -> Column:
    """What private data say of a node."""
    return F.to_json(F.struct(data["qnode_id"].alias("qnode_id"), data["text"].alias("text")))


def usable_arguments(arguments: DataFrame) -> DataFrame:
    """Those whose type has a node and a place; without a type, whose identity has."""
    ok = lambda n: F.col(n)["qnode_id"].isNotNull() & F.col(n)["start"].isNotNull()
    return arguments.where(F.when(F.col("type").isNotNull(), ok("type")).otherwise(ok("identity")))


def numbered(claims: DataFrame, events: DataFrame, arguments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims with valid events, those events, and their usable arguments, with the names that count over all documents.

    Claims come in the order of doc_id and claim_id. Events count from 0. Entities count from 1: of each claim its
    arguments, then its open variable if it has one, then its claimer.
    """
    ev = written(valid_semantics(events).withColumn("g", T.source_of(F.col("doc_id"))))
    arg = usable_arguments(arguments).drop("claim_id").join(ev.select("event_id", "claim_id", F.col("ord").alias("e_ord")), "event_id")
    c = with_author(claims).withColumn("g", T.source_of(F.col("doc_id"))).join(ev.groupBy("claim_id").agg(F.count("*").alias("n_events")), "claim_id")
    c = c.join(arg.groupBy("claim_id").agg(F.count("*").alias("n_args")), "claim_id", "left").withColumns({"n_args": F.coalesce("n_args", F.lit(0)), "has_x": F.col("x_type").isNotNull().cast("int")})
    c = dense_ids(c, "entity_base", "doc_id", "claim_id", first=1, step=F.col("n_args") + F.col("has_x") + 1)
    c = written(dense_ids(c, "event_base", "doc_id", "claim_id", first=0, step=F.col("n_events")))
    place = lambda *order: F.row_number().over(Window.partitionBy("claim_id").orderBy(*order)) - 1  # noqa: E731  a claim has few
    e = ev.join(c.select("claim_id", "event_base"), "claim_id").withColumn("event_name", F.concat(F.lit("EN_Event_"), zero_filled(F.col("event_base") + place("ord"), 6)))
    a = arg.join(c.select("claim_id", "entity_base"), "claim_id").withColumn("arg_name", F.concat(F.lit("EN_Entity_EDL_ENG_"), zero_filled(F.col("entity_base") + place("e_ord", "ord", "role"), 7)))
    a = a.join(e.select("event_id", "g", "event_name", F.col("text").alias("event_text")), "event_id")
    return c, e, a


def claim_triples(claims: DataFrame, events: DataFrame, arguments: DataFrame, system: System | None = None) -> DataFrame:
    """(graph_id, s, p, o, o_kind, o_type) of claims with at least one valid event; the graph is the document.

    claims: claim_id, doc_id, claim_text, start, stop, topic, subtopic, template, location, and x_type, x_identity,
    claimer_type, claimer_identity (NODE). events: claim_id, doc_id, ord, event_id, qnode_id, span_start, span_stop, text,
    confidence. arguments: event_id, ord, role, and type and identity (NODE). The identity of a component or argument
    counts if it has a node, else its type; a component without an identity gets a NIL id of its type's text. An argument
    without a type has no type statement.
    """
    sys = system or System.of(claims.sparkSession)
    w, g, claim = Writer(sys), F.col("g"), F.col("claim_id")
    c, e, a = numbered(claims, events, arguments)
    author = sys.name("clusters", sys.owner, "entity", g, AUTHOR_ENTITY), sys.name("entities", sys.owner, g, AUTHOR_ENTITY)
    names = {"uri": sys.name(g, "claim_id", claim), "j": sys.name("claims", "justifications", g, F.col("start"), F.col("stop")), "place": N.xml_safe_iri(F.concat(F.lit(iri("aida:")), F.col("location")))}
    slots = {}
    for var, part, kind, same, number, has, own in (("x_variable", "_X", "x_type", "x_identity", F.col("entity_base") + F.col("n_args"), F.col("has_x") == 1, F.lit(False)), ("claimer", "_claimer", "claimer_type", "claimer_identity", F.col("entity_base") + F.col("n_args") + F.col("has_x"), F.lit(True), F.col("by_author"))):
        linked = F.coalesce(F.col(same)["qnode_id"].isNotNull(), F.lit(False))
        names |= {
            f"{var}_name": F.when(has, N.xml_safe_iri(F.concat(F.lit(EX + "claim_"), g, F.lit("_"), claim, F.lit(part)))),
            f"{var}_cluster": F.when(own, author[0]).when(has, sys.name("clusters", sys.owner, "entity", g, claim, var, number)),
            f"{var}_ent": F.when(own, author[1]).when(has, sys.name(g, "claim", claim, var, "entity", number)),
            f"{var}_linked": linked, f"{var}_data": F.when(has, F.when(linked, F.col(same)).otherwise(F.col(kind))), f"{var}_nil": F.when(has, F.when(linked, F.col(same)["qnode_id"]).otherwise(T.nil_id(F.col(kind)["text"]))),
        }
        slots[var] = (*[F.col(f"{var}_{x}") for x in ("name", "cluster", "ent", "linked", "data", "nil")], F.col(kind))
    c = written(c.withColumns(names))
    uri, j, place = F.col("uri"), F.col("j"), F.col("place")
    rows = [
        (F.lit(sys.base), "a", node("aida:System")), *w.typed(uri, "aida:Claim"), (uri, "aida:sourceDocument", string(F.col("doc_id"))), (uri, "aida:claimId", string(claim)), (uri, "aida:topic", string(F.col("topic"))),
        (uri, "aida:subtopic", string(F.col("subtopic"))), (uri, "aida:claimTemplate", string(F.col("template"))), (uri, "aida:naturalLanguageDescription", string(N.unquoted(N.squeezed(F.col("claim_text"))))),
        (uri, "aida:xVariable", node(F.col("x_variable_name"))), (uri, "aida:claimer", node(F.col("claimer_name"))), (uri, "aida:claimLocation", node(place)), *w.typed(place, "aida:ClaimComponent"), (place, "aida:componentName", string(F.col("location"))),
        (uri, "aida:justifiedBy", node(j)), *w.place(j, g, F.col("start"), F.col("stop"), F.lit(1.0)),
    ]
    for var, (name, cluster, ent, linked, data, nil, kind) in slots.items():
        rows += [
            (uri, "aida:associatedKEs", node(cluster)), *w.cluster(cluster, ent), *w.typed(name, "aida:ClaimComponent"), (name, "aida:componentName", string(F.replace(data["text"], F.lit("\\"), F.lit("_")))),
            (name, "aida:componentType", string(kind["qnode_id"])), (name, "aida:componentIdentity", string(nil)), (name, "aida:componentKE", node(ent)), *w.private(name, _told(data)), *w.entity(ent, data, linked, var, "0"),
        ]
    out = emit(c, *rows)

    at, words = (F.col("event_name"), g, F.col("span_start"), F.col("span_stop")), F.replace("text", F.lit(" "), F.lit("_"))
    names = {
        "uri": sys.name(g, "claim_id", claim), "event": sys.name("events", sys.owner, g, F.col("event_name")), "cluster": sys.name("clusters", sys.owner, "events", g, F.col("event_name")),
        "informs": sys.name("assertions", sys.owner, "event_informative_justification", *at), "shows": sys.name("assertions", sys.owner, "eventjustification", *at),
        "kind": sys.name("assertions", sys.owner, "eventtype", g, F.col("event_name"), words, F.concat(F.lit("EventType-"), F.col("qnode_id"))), "told": _told(F.struct("qnode_id", "text")),
    }
    e = written(e.withColumns(names))
    event, cluster, told = F.col("event"), F.col("cluster"), F.col("told")
    rows = [(uri, "aida:claimSemantics", node(cluster)), (uri, "aida:associatedKEs", node(cluster)), *w.cluster(cluster, event), *w.typed(event, "aida:Event"), *w.sure(event, F.col("confidence")), *w.private(event, told)]
    for s, p in ((F.col("informs"), "aida:informativeJustification"), (F.col("shows"), "aida:justifiedBy")):
        rows += [(event, p, node(s)), *w.place(s, g, F.col("span_start"), F.col("span_stop"), F.col("confidence")), *w.private(s, told)]
    rows += w.statement(F.col("kind"), "aida:TypeStatement", event, node("rdf:type"), string(F.col("qnode_id")))
    out = out.unionByName(emit(e, *rows))

    linked = F.coalesce(F.col("identity")["qnode_id"].isNotNull(), F.lit(False))
    role = F.concat(F.replace("event_text", F.lit(" "), F.lit("_")), F.lit("."), F.col("role"))
    a = a.withColumns({"linked": linked, "data": F.when(linked, F.col("identity")).otherwise(F.col("type"))})
    names = {
        "uri": sys.name(g, "claim_id", claim), "event": sys.name("events", sys.owner, g, F.col("event_name")), "ent": sys.name("entities", sys.owner, g, F.col("arg_name")), "cluster": sys.name("clusters", sys.owner, "entity", g, F.col("arg_name")),
        "filled": sys.name("assertions", sys.owner, "eventarg", g, F.col("event_name"), role, F.concat(F.lit("EventArgument-"), F.col("data")["qnode_id"])),
        "kind": F.when(F.col("type").isNotNull(), sys.name("assertions", sys.owner, "entitytype", g, F.col("arg_name"), F.replace(F.col("type")["text"], F.lit(" "), F.lit("_")), F.col("type")["qnode_id"])),
    }
    a = written(a.withColumns(names))
    ent, kind = F.col("ent"), F.col("kind")
    rows = [
        (uri, "aida:claimSemantics", node(cluster)), (uri, "aida:associatedKEs", node(cluster)), *w.cluster(cluster, ent), *w.entity(ent, F.col("data"), F.col("linked"), F.col("role"), F.col("arg_name")),
        *w.statement(F.col("filled"), "aida:ArgumentStatement", event, string(F.col("role")), node(ent)), *w.statement(kind, "aida:TypeStatement", ent, node("rdf:type"), string(F.col("type")["qnode_id"])),
    ]
    return out.unionByName(emit(a, *rows)).distinct()

"""Entity tables of an external linker: facts and mentions from tagged lines, and what a matched entity brings to a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default knowledge-base node by the first part of an entity's type (fixed values).
TYPE_QNODES = {
    "COM": ("Q223557", "physical object"),
    "PER": ("Q5", "human"),
    "LOC": ("Q2221906", "geographic location"),
    "GPE": ("Q52110228", "geopolitical group"),
    "ORG": ("Q43229", "organization"),
    "FAC": ("Q13226383", "facility"),
    "VEH": ("Q42889", "vehicle"),
    "MHI": ("Q2057971", "health problem"),
    "WEA": ("Q728", "weapon"),
}


def split_lines(lines: DataFrame) -> DataFrame:
    """(ord, f): the tab-separated fields of each line that has three or five."""
    return lines.select("ord", F.split("line", "\t").alias("f")).where(F.size("f").isin(3, 5))


def entities(fields: DataFrame) -> DataFrame:
    """One row for each entity: of type, link and type link the last value that is usable.

    A link counts if it starts with Q; a type is what follows the # up to white space. An entity without any usable value
    still has its row.
    """
    f = fields.where(F.size("f") == 3).select("ord", F.col("f")[0].alias("ent_id"), F.col("f")[1].alias("k"), F.col("f")[2].alias("v"))
    kind = F.regexp_extract("v", r"#(\S+)", 1)
    value = {
        "ent_type": F.when((F.col("k") == "type") & (kind != ""), kind),
        "ent_link": F.when((F.col("k") == "link") & F.col("v").startswith("Q"), F.col("v")),
        "type_link": F.when((F.col("k") == "typelink") & F.col("v").startswith("Q"), F.col("v")),
    }
    return f.groupBy("ent_id").agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("ord"))).alias(n) for n, v in value.items()])


def mentions(fields: DataFrame) -> DataFrame:
    """One row for each (doc_id, start, stop), the last line's: text without quotes, mention type, entity."""
    f = fields.where(F.size("f") == 5)
    where = F.split(F.col("f")[3], ":")
    span = F.split(F.element_at(where, -1), "-")
    m = f.select(
        "ord", F.col("f")[0].alias("ent_id"), F.col("f")[1].alias("mention_type"), F.regexp_replace(F.col("f")[2], '^"|"$', "").alias("text"),
        F.element_at(where, 1).alias("doc_id"), F.element_at(span, 1).cast("int").alias("start"), F.element_at(span, 2).cast("int").alias("stop"), F.col("f")[4].cast("double").alias("confidence"),
    )
    last = F.max_by(F.struct("text", "mention_type", "ent_id", "confidence", "ord"), "ord").alias("m")
    return m.groupBy("doc_id", "start", "stop").agg(last).select("doc_id", "start", "stop", "m.*")


def with_entities(ments: DataFrame, ents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with their entity, and those whose entity is missing."""
    return ments.join(ents, "ent_id"), ments.join(ents, "ent_id", "left_anti")


def default_type(ent_type: Column) -> Column:
    """(qnode, name) for the part of the type before its first dot; null for others."""
    head = F.substring_index(ent_type, ".", 1)
    out = F.lit(None).cast("struct<qnode:string,name:string>")
    for k, (q, n) in TYPE_QNODES.items():
        out = F.when(head == k, F.struct(F.lit(q).alias("qnode"), F.lit(n).alias("name"))).otherwise(out)
    return out


def promote(slots: DataFrame, known: DataFrame) -> DataFrame:
    """Slots (slot_id, old_type, s_id, ent_type, ent_link, type_link) with identity and type after a match.

    A match moves the old type to the identity. A link replaces the identity by the node it names, a type link the type;
    a named node that isn't known leaves null, even over an earlier value. Without a type link the entity's own type
    decides. Without a match the old type stays.
    """
    found = F.col("s_id").isNotNull()
    a = known.select(F.col("qnode").alias("link_q"), F.col("name").alias("link_name"))
    b = known.select(F.col("qnode").alias("type_q"), F.col("name").alias("type_name"))
    j = slots.join(a, F.col("ent_link") == F.col("link_q"), "left").join(b, F.col("type_link") == F.col("type_q"), "left")
    identity = F.when(found & F.col("ent_link").isNotNull(), F.col("link_q")).when(found, F.col("old_type"))
    kind = F.when(found & F.col("type_link").isNotNull(), F.col("type_q")).when(found, F.coalesce(default_type(F.col("ent_type"))["qnode"], F.lit(None))).otherwise(F.col("old_type"))
    return j.select("slot_id", identity.alias("identity_qnode"), kind.alias("type_qnode"))


def promoted(slots: DataFrame, known: DataFrame) -> DataFrame:
    """Slots (slot_id, type, identity) after their mention was matched with an entity; both are nodes (aif.NODE).

    slots also have ent_id, ent_type, ent_link and type_link, null without a match, which leaves the slot as it was. known:
    (qnode, name). The rules are those of ``promote``; nodes stand where the old type stands, but one that only the entity's
    type gives stands nowhere.
    """
    found = F.col("ent_id").isNotNull()
    a = known.select(F.col("qnode").alias("link_q"), F.col("name").alias("link_name"))
    b = known.select(F.col("qnode").alias("type_q"), F.col("name").alias("type_name"))
    j = slots.join(a, F.col("ent_link") == F.col("link_q"), "left").join(b, F.col("type_link") == F.col("type_q"), "left")
    old, entity = F.col("type"), F.to_json(F.struct("ent_id", "ent_type", "ent_link", "type_link"))
    none = F.lit(None)

    def node(q: Column, text: Column, placed: bool = True, confidence: Column = none, ent: Column = entity) -> Column:
        at = (old["start"], old["stop"]) if placed else (none, none)
        return F.when(q.isNotNull(), F.struct(q.alias("qnode_id"), text.alias("text"), at[0].cast("int").alias("start"), at[1].cast("int").alias("stop"), confidence.cast("double").alias("confidence"), ent.cast("string").alias("entity")))

    kind = default_type(F.col("ent_type"))
    identity = F.when(F.col("ent_link").isNotNull(), node(F.col("link_q"), F.col("link_name"))).otherwise(node(old["qnode_id"], old["text"], True, old["confidence"]))
    typed = F.when(F.col("type_link").isNotNull(), node(F.col("type_q"), F.col("type_name"))).otherwise(node(kind["qnode"], kind["name"], False, none, none))
    return j.select("slot_id", F.when(found, typed).otherwise(old).alias("type"), F.when(found, identity).otherwise(F.col("identity")).alias("identity"))

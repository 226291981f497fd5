"""Names in knowledge-base tables, and strings for markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constraint(text: Column) -> Column:
    """(name, wd_node) of a constraint name_Q123, without plus signs; null for "None"."""
    name = F.replace(F.regexp_replace(text, "_?[^_]*$", ""), F.lit("+"), F.lit(""))
    return F.when(text != "None", F.struct(name.alias("name"), F.element_at(F.split(text, "_"), -1).alias("wd_node")))


def master_role(key: Column) -> Column:
    """(role, text_role) of A0-x-y: what is before the first hyphen, and the rest."""
    parts = F.split(key, "-")
    return F.struct(F.element_at(parts, 1).alias("role"), F.array_join(F.slice(parts, 2, F.size(parts)), "-").alias("text_role"))


def overlay_role(name: Column) -> Column:
    """(role, text_role) of an overlay argument: the part before the first underscore, or the next one after AM, Ax or mnr;
    the text is always from the third part on.
    """
    parts = F.split(name, "_")
    role = F.when(F.element_at(parts, 1).isin("AM", "Ax", "mnr"), F.get(parts, F.lit(1))).otherwise(F.element_at(parts, 1))
    return F.struct(role.alias("role"), F.array_join(F.slice(parts, 3, F.size(parts)), "-").alias("text_role"))


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unquoted(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(""))


def xml_safe(text: Column) -> Column:
    """For a URI: letters, digits, and . _ - stay, anything else becomes an underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def xml_safe_iri(iri: Column) -> Column:
    """An IRI with the characters that markup and Turtle give a meaning to replaced by underscores."""
    return F.regexp_replace(iri, "[\\s<>\"{}|\\\\^`&']", "_")


def is_valid_mention(span_start: Column, span_stop: Column) -> Column:
    """A mention counts if its place is known."""
    return span_start.isNotNull() & span_stop.isNotNull()

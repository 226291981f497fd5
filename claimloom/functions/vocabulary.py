"""Names of the interchange ontology that claim graphs are written in, and the names that a system gives to its own nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .names import xml_safe_iri

# The namespaces of the data.
AIDA = "https://raw.githubusercontent.com/NextCenturyCorporation/AIDA-Interchange-Format/master/java/src/main/resources/com/ncc/aif/ontologies/InterchangeOntology#"
EX = "https://www.caci.com/claim-example#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PREFIXES = {"aida": AIDA, "ex": EX, "rdf": RDF, "xsd": XSD}


def iri(short: str) -> str:
    """prefix:name in full."""
    prefix, _, name = short.partition(":")
    return PREFIXES[prefix] + name if prefix in PREFIXES else short


TYPE = iri("rdf:type")


@dataclass(frozen=True)
class System:
    """Who writes the graphs: the IRI of the system, and the short name of its owner inside IRIs."""

    base: str = "urn:claims"
    owner: str = "own"

    @staticmethod
    def of(spark: SparkSession) -> System:
        """Set by spark.claimloom.system and spark.claimloom.owner."""
        return System(spark.conf.get("spark.claimloom.system", System.base), spark.conf.get("spark.claimloom.owner", System.owner))

    def name(self, *parts: str | Column) -> Column:
        """An IRI below the system's, its parts divided by slashes."""
        return xml_safe_iri(F.concat_ws("/", F.lit(self.base), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))

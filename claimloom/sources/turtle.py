"""Turtle files: triples to text, a folder for each graph, and text to triples."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

TERM = re.compile(
    r"""\s+|\#[^\n\r]*|<(?P<iri>(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*)>
    |"{3}(?P<long>(?:"{0,2}(?:[^"\\]|\\.))*)"{3}|'{3}(?P<long1>(?:'{0,2}(?:[^'\\]|\\.))*)'{3}|"(?P<lit>(?:[^"\\\n\r]|\\.)*)"|'(?P<lit1>(?:[^'\\\n\r]|\\.)*)'
    |(?P<type>\^\^)|@(?P<word>[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|_:(?P<bnode>\w(?:[\w.-]*[\w-])?)|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))
    |(?P<mark>[.;,\[\]()])|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%]))?)?|[a-zA-Z]+)""",
    re.S | re.X,
)
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
XSD = "http://www.w3.org/2001/XMLSchema#"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def unescaped(s: str) -> str:
    """Escapes of a literal or IRI undone; an unknown one is an error."""

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "uU" and len(e) > 1:
            return chr(int(e[1:], 16))
        if e not in ESCAPES:
            raise ValueError(f"no escape: {m[0]!r}")
        return ESCAPES[e]

    return _ESCAPE.sub(one, s) if "\\" in s else s


def _escaped(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def term(value: Column, kind: Column, datatype: Column | None = None) -> Column:
    """The text of an IRI, blank node (whose name begins with _:) or literal; a datatype that begins with @ is a language."""
    literal = F.concat(F.lit('"'), _escaped(value), F.lit('"'))
    typed = literal if datatype is None else F.when(datatype.startswith("@"), F.concat(literal, datatype)).when(datatype.isNotNull(), F.concat(literal, F.lit("^^<"), datatype, F.lit(">"))).otherwise(literal)
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", value).otherwise(typed)


def subject_kind(s: Column) -> Column:
    return F.when(s.startswith("_:"), "bnode").otherwise("iri")


def render(triples: DataFrame) -> DataFrame:
    """(graph_id, s, line) from (graph_id, s, p, o, o_kind, o_type): a statement block for each subject."""
    pair = F.concat(F.lit("<"), F.col("p"), F.lit("> "), term(F.col("o"), F.col("o_kind"), F.col("o_type")))
    head = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))
    blocks = triples.groupBy("graph_id", "s").agg(F.array_join(F.array_sort(F.collect_set(pair)), " ;\n    ").alias("body"))
    return blocks.select("graph_id", "s", F.concat(head, F.lit(" "), F.col("body"), F.lit(" .")).alias("line"))


#: Statement blocks of a graph that go to one file; a larger graph has a file for each so many.
FILE_BLOCKS = 100_000


def write_turtle(triples: DataFrame, path: str) -> None:
    """A folder graph_id=… for each graph, with one file; a graph of more than FILE_BLOCKS subjects has several."""
    r = written(render(triples))
    files = r.groupBy("graph_id").agg(F.ceil(F.count("*") / FILE_BLOCKS).alias("files"))
    dealt = r.join(files, "graph_id").withColumn("file", F.pmod(F.xxhash64("s"), F.col("files")))
    dealt.repartition("graph_id", "file").sortWithinPartitions("graph_id", "file", "s").select("graph_id", "line").write.partitionBy("graph_id").text(path)


def parse(text: str, named: str = "", unnamed: str = "", base: str = "") -> list[tuple[str, str, str, str, str | None]]:
    """(s, p, o, o_kind, o_type) of a Turtle text: the whole grammar of the recommendation.

    o_type of a literal is its datatype's IRI, or @ and its language. named, unnamed: what the names of blank nodes with and
    without a label begin with. base: the IRI that relative ones refer to until the text names another; without one they
    stay as they are. Whatever isn't Turtle raises ValueError.
    """
    return Reader(text, named, unnamed, base).read()


class Reader:
    def __init__(self, text: str, named: str, unnamed: str, base: str):
        self.named, self.unnamed, self.base = named, unnamed, base
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple[str, str, str, str, str | None]] = []
        self.blanks = 0
        self.tokens = self.split(text)
        self.kind, self.value = next(self.tokens)

    @staticmethod
    def split(text: str) -> Iterator[tuple[str, str]]:
        pos = 0
        while pos < len(text):
            m = TERM.match(text, pos)
            if not m:
                raise ValueError(f"no Turtle at {text[pos : pos + 40]!r}")
            pos = m.end()
            if m.lastgroup:
                yield m.lastgroup, m[m.lastgroup]
        while True:
            yield "end", ""

    def take(self) -> tuple[str, str]:
        was = self.kind, self.value
        self.kind, self.value = next(self.tokens)
        return was

    def mark(self, *marks: str) -> bool:
        return self.kind == "mark" and self.value in marks

    def expect(self, *marks: str) -> None:
        if not self.mark(*marks):
            raise ValueError(f"{self.value!r} where {' or '.join(marks)} should be")
        self.take()

    def read(self) -> list[tuple[str, str, str, str, str | None]]:
        while self.kind != "end":
            word = self.value.lower() if self.kind in ("word", "name") else ""
            if word in ("prefix", "base") and (self.kind == "word" or ":" not in self.value):
                at = self.take()[0] == "word"
                if word == "prefix":
                    kind, name = self.take()
                    if kind != "name" or not name.endswith(":"):
                        raise ValueError(f"no prefix: {name!r}")
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if at:
                    self.expect(".")
                continue
            if self.mark("["):
                s, alone = self.blank()
                if not (alone and self.mark(".")):
                    self.predicates(s)
            else:
                s, kind, _ = self.node()
                if kind == "literal":
                    raise ValueError(f"a literal as subject: {s!r}")
                self.predicates(s)
            self.expect(".")
        return self.out

    def iri(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            value = unescaped(value)
            return urljoin(self.base, value) if self.base else value
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"no prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"{value!r} where an IRI should be")

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.unnamed}b{self.blanks}"

    def blank(self) -> tuple[str, bool]:
        """The name of [...], and whether anything stands in it."""
        self.expect("[")
        name, some = self.fresh(), not self.mark("]")
        if some:
            self.predicates(name)
        self.expect("]")
        return name, some

    def node(self) -> tuple[str, str, str | None]:
        if self.mark("["):
            return self.blank()[0], "bnode", None
        if self.mark("("):
            return self.collection()
        if self.kind == "bnode":
            return f"_:{self.named}{self.take()[1]}", "bnode", None
        if self.kind in ("lit", "lit1", "long", "long1"):
            value = unescaped(self.take()[1])
            if self.kind == "type":
                self.take()
                return value, "literal", self.iri()
            if self.kind == "word":
                return value, "literal", "@" + self.take()[1]
            return value, "literal", None
        if self.kind == "num":
            value = self.take()[1]
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")
        if self.kind == "name" and self.value in ("true", "false"):
            return self.take()[1], "literal", XSD + "boolean"
        return self.iri(), "iri", None

    def collection(self) -> tuple[str, str, str | None]:
        self.expect("(")
        first = last = None
        while not self.mark(")"):
            cell = self.fresh()
            if last:
                self.out.append((last, RDF + "rest", cell, "bnode", None))
            first, last = first or cell, cell
            self.out.append((cell, RDF + "first", *self.node()))
        self.take()
        if not last:
            return RDF + "nil", "iri", None
        self.out.append((last, RDF + "rest", RDF + "nil", "iri", None))
        return first, "bnode", None

    def predicates(self, subject: str) -> None:
        while True:
            if self.kind == "name" and self.value == "a":
                self.take()
                p = RDF_TYPE
            else:
                p = self.iri()
            while True:
                self.out.append((subject, p, *self.node()))
                if not self.mark(","):
                    break
                self.take()
            if not self.mark(";"):
                return
            while self.mark(";"):
                self.take()
            if self.mark(".", "]") or self.kind == "end":
                return


def _decoded(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, s, p, o, o_kind, o_type) of files; the graph is the folder graph_id=…, or else the file's name.

    A file that isn't Turtle gives no triple and doesn't end the job: ``turtle_errors`` names it. A file is one document's
    graph, or a part of it. The names of blank nodes begin with a hash of the file, so that those
    of two files differ; labels in a folder graph_id=…, whose files share them, stay.
    """
    return _parsed(spark, path).where("error IS NULL").select(F.explode("triples").alias("t"), "graph_id").select("graph_id", "t.*")


def turtle_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of the files under a path that aren't Turtle."""
    return _parsed(spark, path).where("error IS NOT NULL").select("file", "error")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    # the folder name is escaped once by the writer and once as a path
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, "/graph_id=([^/]+)/", 1)
    graph = F.when(name != "", _decoded(_decoded(name))).otherwise(F.regexp_replace(T.last_segment(F.col("_metadata.file_name")), r"\.ttl$", ""))
    scope = F.substring(F.md5(file.cast("binary")), 1, 12)
    files = whole.select(file.alias("file"), graph.alias("graph_id"), F.when(name != "", "").otherwise(F.concat(F.lit("f"), scope)).alias("named"), F.concat(F.lit("u"), scope).alias("unnamed"), "value")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for f, g, a, b, text in df[["file", "graph_id", "named", "unnamed", "value"]].itertuples(index=False):
                try:
                    out.append((f, g, [dict(zip(_TRIPLE, t, strict=True)) for t in parse(text.removeprefix("\ufeff"), a, b)], None))
                except ValueError as e:
                    out.append((f, g, [], str(e)))
            yield pd.DataFrame(out, columns=["file", "graph_id", "triples", "error"])

    kind = ",".join(f"{c}:string" for c in _TRIPLE)
    return files.mapInPandas(rows, f"file string, graph_id string, triples array<struct<{kind}>>, error string")


_TRIPLE = ["s", "p", "o", "o_kind", "o_type"]


def with_document(triples: DataFrame) -> DataFrame:
    """Graphs whose text justifications name a document, with it as ``document``; others are left out."""
    from ..operators.graph import document_of

    return triples.join(document_of(triples).withColumnRenamed("doc", "document"), "graph_id")

"""Secrets in documents, and who else holds them: a value found with many owners is a copied example, one that only few
owners hold looks live. DataFrame functions only.

A document is taken as a repository and its source as the owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, free_name

#: The base kinds in their order: pattern, group of the value, least length of the value (fixed values).
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: What a document must hold for the pattern to be tried.
GATE = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}"}
#: Further candidates: tokens of known issuers, and long tokens of several character classes (fixed values).
WIDER = r"((?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|[A-Za-z0-9+/_-]{28,})(?![A-Za-z0-9_-]))"
#: Owners up to which a value is taken as theirs.
FEW_OWNERS = 2

SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


#: Matches that one step of the running sum appends to an array of; more make several arrays.
BLOCK = 256


def spans_of(text: Column, pattern: str, group: int, rank: int, least: int) -> Column:
    """Matches from left to right as (start, rank, stop, value), in code points; those with a shorter value are left out.

    Places are running sums of the lengths between and of the matches, block by block, as an array that grows by one
    element is copied each time.
    """
    whole = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.char_length)
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), values.alias("value"))
    none = f"cast(array() as {SPAN})"

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        stop = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.when(F.char_length(x["value"]) >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def blocks(x: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.expr(none).alias("out"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), begin, step))

    def shifted(s: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda v: F.struct((v["start"] + s["at"]).alias("start"), v["rank"].alias("rank"), (v["stop"] + s["at"]).alias("stop"), v["value"].alias("value")))
        return F.struct((s["at"] + block["at"]).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
    # within the lambda the steps are a value, made once
    return F.element_at(F.transform(F.array(steps), lambda x: F.flatten(F.aggregate(blocks(x), begin, shifted)["out"])), 1)


def find_candidates(text: Column) -> tuple[Column, Column]:
    """Base spans in order, and wider candidates that touch none of them."""
    none = F.expr(f"cast(array() as {SPAN})")
    base = [F.when(text.rlike(GATE[k]), spans_of(text, p, g, i, n)).otherwise(none) for i, (k, (p, g, n)) in enumerate(BASE.items())]
    wide = F.when(text.rlike("[A-Za-z0-9+/_-]{28}|(?:gh[pousr]|sk_live|AIza|eyJ)[A-Za-z0-9_-]{10}|xox[abprs]-"), spans_of(text, WIDER, 1, len(BASE), 16)).otherwise(none)
    return F.array_sort(F.concat(*base)), wide


def looks_random(value: Column) -> Column:
    """Several character classes, and few repeated characters."""
    classes = value.rlike("[0-9]").cast("int") + value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int")
    return (classes >= 2) & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan_secrets(docs: DataFrame, few: int = FEW_OWNERS) -> DataFrame:
    """``docs`` without text, with ``base`` and ``spans``: arrays of (kind, start, stop, owners, repositories, live).

    base: what the base patterns find. spans: those, and wider candidates (kind "live") that look random and that at most
    ``few`` owners hold. live is false for a value that more owners hold. Positions are code points, stop exclusive.
    Owners and repositories are counted over all documents; a null source or doc_id is an owner or repository of its own
    kind, "null". Null and empty texts hold nothing; equal rows are one repository. An empty table gives an empty result.
    Values leave the operator only as hashes. Columns named base or spans are replaced.
    """
    stash = Stash(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in ("text", "base", "spans")]
    rid, base, wide, owner, repo, found_spans, other = free_name(docs, "rid", "found", "wider", "owner", "repo", "all_spans", "rid_2")
    text = F.coalesce(F.col("text"), F.lit(""))
    b, x = find_candidates(text)
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), F.sha2(s["value"].cast("binary"), 256).alias("h")))
    source = F.col("source").cast("string") if "source" in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    found = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(source, F.lit("null")).alias(owner), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(repo), b.alias(base), F.filter(x, lambda s: looks_random(s["value"])).alias(wide))
    free = F.filter(wide, lambda s: ~F.exists(base, lambda t: (t["start"] < s["stop"]) & (s["start"] < t["stop"])))
    rows = stash(found.withColumn(wide, hashed(free)).withColumn(base, hashed(F.col(base))).withColumn(rid, F.monotonically_increasing_id()))
    some = rows.where((F.size(base) > 0) | (F.size(wide) > 0)).select(rid, owner, repo, F.explode(F.concat(base, wide)).alias("s")).select(rid, owner, repo, "s.*")
    # each step combines before it shuffles, so that a value found everywhere costs a row for each task
    held = some.groupBy("h", owner, repo).agg(F.lit(1).alias("one")).groupBy("h", owner).agg(F.count("*").alias("repos")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))
    counts = stash(held.withColumnRenamed("h", "value_hash"))
    candidates = stash(some)
    told = candidates.join(counts, F.col("h") == F.col("value_hash")).select(
        rid, F.struct("start", "rank", "stop", "owners", "repositories", (F.col("owners") <= few).alias("live")).alias("s"),
    )
    by_row = told.groupBy(rid).agg(F.array_sort(F.collect_list("s")).alias(found_spans)).withColumnRenamed(rid, other)
    kinds = F.array(*[F.lit(k) for k in (*BASE, "live")])
    out = lambda a: F.transform(a, lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["owners"].alias("owners"), s["repositories"].alias("repositories"), s["live"].alias("live")))
    s = F.coalesce(F.col(found_spans), F.expr("cast(array() as array<struct<start:int,rank:int,stop:int,owners:bigint,repositories:bigint,live:boolean>>)"))
    joined = rows.select(rid, *[F.col(f"`{c}`") for c in keep]).join(by_row, F.col(rid) == F.col(other), "left").withColumn(found_spans, s)
    return joined.select(*[F.col(f"`{c}`") for c in keep], out(F.filter(found_spans, lambda v: v["rank"] < len(BASE))).alias("base"), out(F.filter(found_spans, lambda v: (v["rank"] < len(BASE)) | v["live"])).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

"""The batch operators on streams: claims as documents arrive, counted in windows, and the latest mention of a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import matching as M


def stream_matches(docs: DataFrame, patterns: list[M.Pattern], tagger=None, most_tokens: int | None = None) -> DataFrame:
    """Matches of a stream of (doc_id, text, ts): the same rows as for a table, with the time of their document."""
    return M.matches(M.tokenised(docs.select("doc_id", "text", "ts"), tagger), patterns, most_tokens=most_tokens)


def windowed_topic_counts(matches: DataFrame, topics: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, topic, subtopic, n): counts by event time; rows later than ``late`` are not counted."""
    m = C.assign_topics(matches.withWatermark("ts", late), topics)
    return m.groupBy(F.window("ts", window), "topic", "subtopic").agg(F.count("*").alias("n"))


def first_mentions(mentions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A mention (doc_id, start, stop, …, ts) the first time that its place is seen within the watermark."""
    return mentions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "start", "stop"])

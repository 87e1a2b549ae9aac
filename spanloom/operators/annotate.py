"""Content types, and the one place where a caller's model comes in: annotate(requests) -> responses.

Requests are rows (content_type, stream_id, phase, request, lo, hi, text): a
number that tells a phase's requests of a stream apart, the segments it shows,
and what to ask, the transcript first, so that requests share their beginnings.
annotate is any function from that DataFrame to one with the first four columns
and raw, a text for each; a request without a row is one without an answer.
Indices in answers are those of the whole stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.scalars import transcript_line
from spanloom.operators import responses as rs
from spanloom.operators.review import enabled_types
from spanloom.sources.checkpoints import dealt

REQUEST = ["content_type", "stream_id", "phase", "request"]
Annotate = Callable[[DataFrame], DataFrame]


def members_of(responses: DataFrame) -> DataFrame:
    """(content_type, stream_id, phase, request, pos, match_ord, title, confidence, idx) of what the answers name, in order of request and place."""
    items = rs.items(responses, REQUEST)
    order = Window.partitionBy("content_type", "stream_id", "phase").orderBy("request", "pos")
    rows = items.withColumn("match_ord", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(*REQUEST, "pos", "match_ord", "title", "confidence", F.explode("indices").alias("idx"))


def as_they_are(members: DataFrame, segments: DataFrame) -> DataFrame:
    return members


@dataclass(frozen=True)
class ContentType:
    """What is looked for: how it is asked, how answers are read, and what is done with the matches.

    parse goes from responses to members with the columns of members_of, compose
    from members (stream_id, match_ord, title, confidence, idx) and segments to
    members.
    """

    name: str
    instructions: str = ""
    lines: int = 20
    parse: Callable[[DataFrame], DataFrame] = members_of
    compose: Callable[[DataFrame, DataFrame], DataFrame] = as_they_are


class ContentTypes:
    """Content types by name."""

    def __init__(self, *types: ContentType):
        self._types: dict[str, ContentType] = {}
        for t in types:
            self.register(t)

    def register(self, kind: ContentType) -> None:
        if kind.name in self._types:
            raise ValueError(f"content type {kind.name!r} is registered already")
        self._types[kind.name] = kind

    def get(self, name: str) -> ContentType:
        if name not in self._types:
            raise KeyError(f"no content type {name!r}; there are {', '.join(self.names()) or 'none'}")
        return self._types[name]

    def names(self) -> list[str]:
        return sorted(self._types)

    def enabled(self, config: dict) -> list[ContentType]:
        """Those that the settings switch on, in the settings' order."""
        return [self.get(name) for name in enabled_types(config)]


def _lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, lines) of segments grouped by keys."""
    line = transcript_line(F.col("idx"), F.col("start_s"), F.col("end_s"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("idx", line.alias("line"))))
    return rows.groupBy(*keys).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"))


def transcript_requests(segments: DataFrame, kind: ContentType, phase: str = "main") -> DataFrame:
    """Requests for whole streams, ``lines`` segments each."""
    rows = _lines(segments.withColumn("request", F.floor(F.col("idx") / kind.lines).cast("long")), ["stream_id", "request"])
    text = F.concat_ws("\n\n", "lines", F.lit(kind.instructions))
    return rows.select(F.lit(kind.name).alias("content_type"), "stream_id", F.lit(phase).alias("phase"), "request", "lo", "hi", text.alias("text"))


def range_requests(ranges: DataFrame, segments: DataFrame, kind: ContentType, phase: str) -> DataFrame:
    """Requests for ranges (stream_id, request, lo, hi, note); note, what else the annotator is told (JSON, say), comes last and may be null."""
    shown = ranges.select("stream_id", "request", F.explode(F.sequence("lo", "hi")).alias("idx")).join(segments, ["stream_id", "idx"])
    rows = _lines(shown, ["stream_id", "request"]).join(ranges.select("stream_id", "request", "note"), ["stream_id", "request"])
    text = F.concat_ws("\n\n", "lines", F.lit(kind.instructions), "note")
    return rows.select(F.lit(kind.name).alias("content_type"), "stream_id", F.lit(phase).alias("phase"), "request", "lo", "hi", text.alias("text"))


def ask(requests: DataFrame, annotate: Annotate) -> DataFrame:
    """Requests with their answers, (content_type, stream_id, phase, request, lo, hi, raw); raw is null without one.

    The caller's function is called once and its rows are kept (an eager action),
    so that what is read later is what was answered. Answers to nothing drop out;
    of several to one request the least text counts.
    """
    asked = dealt(requests)
    said = annotate(asked)
    if missing := {*REQUEST, "raw"} - set(said.columns):
        raise ValueError(f"annotate gives no {', '.join(sorted(missing))}")
    once = said.groupBy(*REQUEST).agg(F.min("raw").alias("raw"))
    return dealt(asked.select(*REQUEST, "lo", "hi").join(once, REQUEST, "left"))


def annotated(segments: DataFrame, types: list[ContentType], annotate: Annotate) -> DataFrame:
    """Matches of several content types, (content_type, stream_id, match_ord, title, confidence, idx): all asked at once, each read and composed by its own rules."""
    if not types:
        raise ValueError("no content types")
    requests = transcript_requests(segments, types[0])
    for kind in types[1:]:
        requests = requests.union(transcript_requests(segments, kind))
    said = ask(requests, annotate)
    out = None
    for kind in types:
        members = kind.parse(said.where(F.col("content_type") == kind.name)).select("stream_id", "match_ord", "title", "confidence", "idx")
        rows = kind.compose(members, segments).select(F.lit(kind.name).alias("content_type"), "stream_id", "match_ord", "title", "confidence", "idx")
        out = rows if out is None else out.union(rows)
    return out

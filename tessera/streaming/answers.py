"""A model's answers for sections as the events that tell of them, and what a reader of such events knows of each document.

Events: file_id, seq (their order in the document), event, section_number, section_name, specs, status, message. For each section a request, a response
and what was processed; at the end complete with all specs, or at the first answer without fences an error, after which nothing comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import identity
from ..functions import text as T

# The fences of an answer, the status and message of an answer without them.
FENCED = r"(?is)#specs#(.*?)#specs#"
BAD_STATUS, BAD_MESSAGE = 502, "LLM returned unexpected format for section "
SPECS = "array<struct<spec_id:string,section_id:string,spec_text:string>>"
EVENTS = f"file_id string, seq long, event string, section_number string, section_name string, specs {SPECS}, status int, message string"
#: What a reader knows of a document.
KNOWN = "file_id string, state string, message string, requested long, responded long, processed long, n_events long, specs array<string>"
STEPS = 3


def events_of(answers: DataFrame) -> DataFrame:
    """The events of ``answers`` (file_id, position, section_number, section_name, response): one exchange by document. A null answer has no fences."""
    number, name = (F.coalesce(c, F.lit("")) for c in ("section_number", "section_name"))
    said = F.filter(F.transform(T.lines(F.regexp_extract("response", FENCED, 1)), T.strip), lambda x: (x != "") & (F.upper(x) != "NONE"))
    bare = F.filter(F.transform(said, lambda x: F.when(x.startswith("-"), T.strip(F.substr(x, F.lit(2)))).otherwise(x)), lambda x: x != "")
    # Generators: what is read of an answer is made once, however often the events name it.
    bound = answers.select("file_id", "position", "section_number", "section_name", F.explode(F.array("response")).alias("response"))
    facts = F.struct(
        F.coalesce(F.col("response").rlike(FENCED), F.lit(False)).alias("good"), identity.header_section_id(F.col("file_id"), number, name).alias("section_id"), bare.alias("lines")
    )
    read = bound.select("file_id", "position", "section_number", "section_name", F.inline(F.array(facts)))
    spec = F.transform("lines", lambda x: F.struct(identity.section_line_id(F.col("section_id"), x).alias("spec_id"), F.col("section_id").alias("section_id"), x.alias("spec_text")))
    specs = F.when(F.col("good"), spec).otherwise(F.array().cast(SPECS))
    row = F.struct("position", specs.alias("specs"), "section_number", "section_name", "good")
    documents = read.groupBy("file_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min(F.when(~F.col("good"), F.col("position"))).alias("failed"))
    # A document's answers are made once: its last event, which has all specs, comes from the same row as the others.
    told = documents.select("file_id", "failed", F.filter("rows", lambda x: F.col("failed").isNull() | (x["position"] <= F.col("failed"))).alias("rows"))
    none = F.lit(None).cast("string")

    def event(seq, kind, number=none, name=none, specs=F.lit(None).cast(SPECS), status=None, message=none):
        values = {"seq": seq, "event": kind, "section_number": number, "section_name": name, "specs": specs, "status": F.lit(status).cast("int"), "message": message}
        return F.struct(*(v.alias(c) for c, v in values.items()))

    def steps(x):
        at = x["position"].cast("long") * STEPS
        of_section = (x["section_number"], x["section_name"])
        done = event(at + 2, F.lit("processed"), *of_section, x["specs"])
        bad = event(at + 2, F.lit("error"), status=BAD_STATUS, message=F.concat(F.lit(BAD_MESSAGE), F.coalesce(x["section_number"], F.lit(""))))
        return F.array(event(at, F.lit("request"), *of_section), event(at + 1, F.lit("response"), *of_section), F.when(x["good"], done).otherwise(bad))

    last = F.array_max(F.transform("rows", lambda x: x["position"])).cast("long")
    complete = event((last + 1) * STEPS, F.lit("complete"), specs=F.flatten(F.transform("rows", lambda x: x["specs"])))
    each = F.concat(F.flatten(F.transform("rows", steps)), F.filter(F.array(complete), lambda _: F.col("failed").isNull()))
    return told.select("file_id", F.inline(each))


def known(events: DataFrame) -> DataFrame:
    """What a reader knows of each document once it has read all ``events``: ``KNOWN``.

    A section's first event of each kind counts, repeats change nothing. Processed specs are gathered in order; those of complete take their place.
    """
    closing = F.col("event").isin("complete", "error")
    kinds = (("request", "requested"), ("response", "responded"), ("processed", "processed"))
    firsts = events.groupBy("file_id", "event", "section_number").agg(
        F.min_by(F.struct("seq", "specs"), "seq").alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.when(closing, F.struct("seq", "event", "message", "specs"))).alias("end")
    )
    of_section = F.col("section_number").isNotNull()
    processed = of_section & (F.col("event") == "processed") & F.col("first.specs").isNotNull()
    rows = F.array_sort(F.collect_list(F.when(processed, F.struct("first.seq", "first.specs"))))
    ends = firsts.groupBy("file_id").agg(
        *(F.count_if(of_section & (F.col("event") == kind)).alias(name) for kind, name in kinds),
        F.flatten(F.transform(rows, lambda x: F.transform(x["specs"], lambda s: s["spec_text"]))).alias("gathered"),
        F.sum("n").alias("n_events"),
        F.min("end").alias("end"),
    )
    final = F.when(F.col("end.event") == "complete", F.transform("end.specs", lambda s: s["spec_text"]))
    zero = F.lit(0).cast("long")
    return ends.select(
        "file_id",
        F.when(F.col("end.event") == "complete", "complete").when(F.col("end.event") == "error", "failed").otherwise("running").alias("state"),
        F.col("end.message").alias("message"),
        *(F.coalesce(c, zero).alias(c) for c in ("requested", "responded", "processed")),
        "n_events",
        F.coalesce(final, "gathered", F.array().cast("array<string>")).alias("specs"),
    )


class _Reader(StatefulProcessor):
    """``known``, kept for each document as events arrive, in any order and repeatedly, until its end has come."""

    KINDS = ("request", "response", "processed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event string, section string", "seq long")
        self.specs = handle.getMapState("specs", "section string", "seq long, texts array<string>")
        self.status = handle.getValueState("status", "state string, message string, request long, response long, processed long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, message, *counts = self.status.get() if self.status.exists() else ("running", None, 0, 0, 0, 0)
        if state != "running":
            return
        counts, end = dict(zip((*self.KINDS, "n"), counts, strict=True)), None
        for pdf in rows:
            for seq, event, section, specs, said in zip(pdf["seq"], pdf["event"], pdf["section_number"], pdf["specs"], pdf["message"], strict=True):
                counts["n"] += 1
                if event in ("complete", "error"):
                    end = min(end, (seq, event, said, specs), key=lambda x: x[0]) if end else (seq, event, said, specs)
                elif event in self.KINDS and section is not None:
                    key_of = (event, section)
                    new = not self.seen.containsKey(key_of)
                    if new or seq < self.seen.getValue(key_of)[0]:  # of a section's events the first in the document counts, whenever it comes
                        self.seen.updateValue(key_of, (int(seq),))
                        if event == "processed":
                            self._gather(section, seq, specs)
                    counts[event] += new
        if end:
            state, message = ("complete", None) if end[1] == "complete" else ("failed", end[2])
            if state == "complete" and end[3] is not None:
                self.specs.clear()
                self._gather("", end[0], end[3])
        self.status.update((state, message, *counts.values()))
        parts = sorted((seq, list(texts)) for seq, texts in self.specs.values()) if self.specs.exists() else []
        gathered = [text for _, texts in parts for text in texts]
        yield pd.DataFrame([(key[0], state, message, *counts.values(), gathered)], columns=[c.split()[0] for c in KNOWN.split(", ")])

    def _gather(self, section: str, seq, specs) -> None:
        self.specs.updateValue((section,), (int(seq), [s["spec_text"] for s in (specs if specs is not None else [])]))

    def close(self) -> None:
        pass


def followed(stream: DataFrame) -> DataFrame:
    """``known`` for a stream of events, a row for each document that a micro-batch told of, in update mode. Events after a document's end are ignored.

    Needs the RocksDB state store.
    """
    return stream.groupBy("file_id").transformWithStateInPandas(_Reader(), KNOWN, "Update", "None")

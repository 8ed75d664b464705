"""Table functions for SQL: SELECT * FROM normalized_records(TABLE(t)) makes examples of records of any layout, one to many.

The layout is read from the table itself: columns that a record may have are taken as they are there, others are passed over; a layout that can't
hold a record is an error before anything runs. The examples are those of api.normalized."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

MESSAGES = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("role", T.StringType())]))
OUT = T.StructType([T.StructField("category", T.StringType()), T.StructField("prompt", MESSAGES), T.StructField("completion", MESSAGES), T.StructField("example_hash", T.StringType())])
#: What a record's request and reply may be called, the first that isn't empty counts.
ASKS, REPLIES = ("instruction", "question"), ("output", "answer", "reference_answer")


def messages(value: object) -> list[tuple[str | None, str | None]] | None:
    return [(m["content"], m["role"]) for m in value if m is not None] if isinstance(value, list) else None


def example(category: str | None, prompt: list[tuple], completion: list[tuple]) -> tuple:
    shown = lambda side: [{k: v for k, v in zip(("content", "role"), m, strict=True) if v is not None} for m in side]
    text = json.dumps({"completion": shown(completion), "prompt": shown(prompt)}, ensure_ascii=False, separators=(",", ":"))
    return category, prompt, completion, hashlib.sha256(text.encode()).hexdigest()


class NormalizedRecords:
    @staticmethod
    def analyze(records: AnalyzeArgument) -> AnalyzeResult:
        names = set(records.dataType.names) if records.isTable else set()
        if not ("messages" in names or {"prompt", "completion"} <= names or (names & {*ASKS} and names & {*REPLIES})):
            raise ValueError("a record has messages, a prompt and a completion, or a request and a reply")
        return AnalyzeResult(OUT)

    def eval(self, row: Row) -> Iterator[tuple]:
        given = row.asDict()
        category = None if given.get("category") is None else str(given["category"])
        if (talk := messages(given.get("messages"))) is not None:
            talk = [(content or "", role) for content, role in talk if role is not None]
            for k, one in enumerate(talk):
                if k and one[1] == "assistant":
                    yield example(category, talk[:k], [one])
            return
        prompt, completion = messages(given.get("prompt")), messages(given.get("completion"))
        if prompt is not None and completion is not None:
            yield example(category, prompt, completion)
        first = lambda names: next((given[n] for n in names[:-1] if given.get(n)), given.get(names[-1]))
        ask, reply = first(ASKS), first(REPLIES)
        if ask is None or reply is None:
            text = lambda v: v if isinstance(v, str) else None
            ask, reply = text(given.get("prompt")), text(given.get("completion"))
        if ask is not None and reply is not None:
            yield example(category, [(ask, "user")], [(reply, "assistant")])


def register(spark: SparkSession) -> None:
    spark.udtf.register("normalized_records", F.udtf(NormalizedRecords))

"""Answers as they grow, and answers to questions as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.api import Models, ask_batch
from millrace.config import Answers
from millrace.operators import retrieval


def chat(
    spark: SparkSession, vectors: DataFrame, message: str, history: list[dict] | None = None, top_k: int = 3, use_reranking: bool = True, models: Models = Models()
) -> Iterator[list[dict]]:
    """The history with the answer as it grows, word by word, then with its sources as a status message."""
    said = [*(history or []), {"role": "user", "content": message, "metadata": None}]
    settings = Answers(final_k=max(1, int(top_k)), use_reranking=use_reranking)
    asked = spark.createDataFrame([(0, message)], "query_id long, question string")
    got = ask_batch(asked, vectors, models, settings).select("answer", "sources").first()
    say = lambda text, meta=None: {"role": "assistant", "content": text, "metadata": meta}
    if got["sources"] is None:
        yield [*said, say(retrieval.NOTHING_FOUND)]
        return
    words = got["answer"].split(" ")
    for n in range(1, len(words) + 1):
        yield [*said, say(" ".join(words[:n]))]
    yield [*said, say(got["answer"]), say(got["sources"], {"title": "sources"})]


def answer_stream(questions: DataFrame, vectors: DataFrame, path: str, checkpoint: str, models: Models = Models(), settings: Answers = Answers(), **trigger) -> StreamingQuery:
    """Answer a stream of questions (query_id, question), batch by batch, into ``path``/batch=N.

    A batch that is run again after a failure replaces its own folder, so no
    answer is lost or doubled.  ``trigger`` is that of the stream writer
    (``availableNow=True`` to work off what is there).
    """

    def one(batch: DataFrame, number: int) -> None:
        ask_batch(batch, vectors, models, settings).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = questions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(**trigger) if trigger else writer).start()

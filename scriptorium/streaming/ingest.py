"""Streaming forms: continuous ingest, and the last turns of a chat as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators.chunks import chunk_pages, kept_chunks, with_ids
from scriptorium.sources.papers import append_chunks, pages_from_documents


def stream_ingest(spark: SparkSession, source: str, schema, store: str, checkpoint: str) -> None:
    """Chunk and filter the document files that are new in ``source`` and append them to the store, then stop.

    The same columns as in batch; a chunk is appended once. The store's ledger names the
    micro-batches of this checkpoint, so one that is repeated costs nothing.
    """
    docs = spark.readStream.schema(schema).parquet(source)
    chunks = with_ids(kept_chunks(chunk_pages(pages_from_documents(docs))))
    append = lambda df, number: append_chunks(df, store, batch=f"{checkpoint}#{number}")
    query = chunks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Memory(StatefulProcessor):
    """A conversation's turns in order, whatever order they come in.

    ``place`` is the number of the next turn, the question that is still without an answer,
    the last messages that were answered, and turns that came before one of their
    predecessors. A turn is worked on when all before it were, or when ``patience``
    milliseconds passed without the missing one.

    A call to the state costs far more than a turn's own work, so most conversations read and
    write ``place`` once a micro-batch. Early turns beyond ``few`` (or ``chars`` of text) go to
    ``filed`` one by one, and a task holds no more than ``held`` turns of a conversation.
    """

    def __init__(self, most: int, patience: int, few: int = 64, chars: int = 100_000, held: int = 1000):
        self.most, self.patience, self.few, self.chars, self.held = most, patience, few, chars, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next bigint, waiting string, open boolean, last array<string>, filed boolean, turns array<bigint>, roles array<string>, texts array<string>")
        self.filed = handle.getMapState("filed", "turn bigint", "role string, text string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator[Row]:
        talk = _Talk(self.place.get())
        for r in rows:
            if r.turn >= talk.turn:
                talk.early[r.turn] = (r.role, r.text)
            if len(talk.early) >= self.held:
                yield from self._advance(key, talk)
                self._file(talk)
        yield from self._advance(key, talk)
        self._keep(talk)
        if self.patience and (talk.early or talk.filed):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The missing turns did not come: go on with the earliest that did."""
        talk = _Talk(self.place.get())
        for turn in sorted({*talk.early, *(k[0] for k in self.filed.keys())} if talk.filed else talk.early):
            if turn >= talk.turn:
                talk.turn = turn
                yield from self._advance(key, talk)
        self._keep(talk)

    def _advance(self, key, talk: _Talk) -> Iterator[Row]:
        """Work on turns as far as none is missing."""
        while True:
            came = talk.early.pop(talk.turn, None)
            if talk.filed and (filed := self.filed.getValue((talk.turn,))) is not None:
                self.filed.removeKey((talk.turn,))
                came = came or filed
            if came is None:
                return
            role, text = came
            if role == "user":
                yield Row(conv_id=key[0], turn=talk.turn, n_history=len(talk.last), history="\n".join(x for x in talk.last if x is not None))
                talk.waiting, talk.open = text, True
            elif role == "assistant":
                answered = [("user", talk.waiting)] * talk.open + [("assistant", text)]
                talk.last = (talk.last + [None if x is None else f"{r}: {x}" for r, x in answered])[-self.most :]
                talk.waiting, talk.open = None, False
            talk.turn += 1

    def _file(self, talk: _Talk) -> None:
        """Early turns that are too many for ``place``, one by one into the state."""
        if len(talk.early) > self.few or sum(len(text or "") for _, text in talk.early.values()) > self.chars:
            for turn, came in talk.early.items():
                self.filed.updateValue((turn,), came)
            talk.early, talk.filed = {}, True

    def _keep(self, talk: _Talk) -> None:
        self._file(talk)
        talk.filed = talk.filed and self.filed.exists()
        roles, texts = [c[0] for c in talk.early.values()], [c[1] for c in talk.early.values()]
        self.place.update((talk.turn, talk.waiting, talk.open, talk.last, talk.filed, list(talk.early), roles, texts))

    def close(self) -> None:
        pass


class _Talk:
    """What a task has in hand of one conversation: its ``place``, with early turns by number."""

    def __init__(self, place):
        self.turn, self.waiting, self.open, self.last, self.filed, turns, roles, texts = place or (0, None, False, [], False, [], [], [])
        self.early = dict(zip(turns, zip(roles, texts)))


def stream_chat_memory(turns: DataFrame, most: int = 6, patience: int = 0) -> DataFrame:
    """(conv_id, turn, n_history, history) of each user turn of a stream of conversation rows.

    turns: conv_id, turn (numbered from 0 in each conversation), role, text. Turns may come
    in any order and in any micro-batch; a question is answered with its history once all
    turns before it have come. With ``patience`` (milliseconds), a gap is given up after
    that long. A turn that comes again is passed over. State is kept in RocksDB, which the
    session is set to.
    """
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "conv_id long, turn long, n_history int, history string"
    return turns.groupBy("conv_id").transformWithState(Memory(most, patience), schema, "Append", "ProcessingTime" if patience else "None")

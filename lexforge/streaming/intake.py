"""Terms that arrive as a stream, added to a termbase batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexforge.operators import termbase as ops
from lexforge.schemas import EDITABLE
from lexforge.sources.store import Conflict, Termbase


def add_batch(base: Termbase, rows: DataFrame, stream: str, number: int, order: Sequence[str] = ("word", "translation"), dedup: bool = True) -> int:
    """Add a batch's rows (EDITABLE columns, or some of them) unless the termbase has this stream's batch of that
    number, or a later one; the number of rows added. Rows and number are one commit, so a batch that is run again
    changes nothing, whether the first run ended before or after it. With dedup only terms that are new are added."""
    clean = ops.normalise_import(rows).select(*EDITABLE)
    while True:
        state = base._state()
        if state["batches"].get(stream, -1) >= number:
            return 0
        try:
            new = ops.new_rows(base._rows("terms", state), clean, list(order), dedup)
            return base.add_rows(new, list(order), (stream, number), state if dedup else None)
        except Conflict:
            continue


def add_stream(base: Termbase, rows: DataFrame, stream: str, checkpoint: str, dedup: bool = True, **trigger) -> StreamingQuery:
    """Start a query that adds all rows of a stream to the termbase. The checkpoint knows which input is in which
    batch; the termbase knows which batches it has."""
    write = rows.writeStream.foreachBatch(lambda df, n: add_batch(base, df, stream, n, dedup=dedup) and None)
    return write.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_term_stream(spark, folder: str) -> DataFrame:
    """CSV files with a header, as they arrive: word, translation, domain."""
    schema = "word string, translation string, domain string"
    return spark.readStream.schema(schema).option("header", True).csv(folder).withColumn("domain", F.coalesce("domain", F.lit("")))

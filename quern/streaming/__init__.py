"""Streams into tables: an extension; the dialect itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.errors import EngineError
from quern.functions.expressions import SPARK_TYPES
from quern.session import Session
from quern.sources.catalog import RID


def append(session: Session, table_name: str, batch: DataFrame, source: tuple[str, int] | None = None) -> int:
    """Add the rows of a DataFrame to a stored table as one segment, under the table's constraints; gives their number.

    `source` names a stream and numbers the batch: one that the table has already is not added again.
    """
    engine = session.engine
    with engine.writing:
        space = session.space()
        before = space.writable(table_name)
        sources = dict(before.sources)
        if source is not None:
            if source[1] <= sources.get(source[0], -1):
                return 0
            sources[source[0]] = source[1]
        table = engine.store.settled(before).changed(sources=tuple(sources.items()))
        there = {c.lower() for c in batch.columns}
        missing = [c for c in table.columns if c.name.lower() not in there]
        if any(c.not_null and not c.has_default for c in missing):
            raise EngineError(316)
        columns = [(F.lit(c.default) if c in missing else F.col(f"`{c.name}`")).cast(SPARK_TYPES[c.type]).alias(c.field) for c in table.columns]
        rows = batch.select(F.monotonically_increasing_id().alias(RID), *columns)
        segment = engine.store.write(table, rows.withColumn(RID, F.col(RID) + table.next_rid))
        made = session.engine.spark.read.schema(table.schema()).parquet(segment.path)
        try:
            engine.mutations.check_rows(table, made, list(table.columns))
        except Exception:
            engine.store.drop(segment.path)
            raise
        if segment.rows:
            high = made.agg(F.max(RID)).first()[0]
            table = table.changed(segments=(*table.segments, segment), next_rid=high + 1, slots=table.slots + segment.rows)
        else:
            engine.store.drop(segment.path)
        if segment.rows or source is not None:
            session.publish(session.catalog.with_namespace(space.with_table(table)))
        return segment.rows


def follow(session: Session, table_name: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every micro-batch of a stream to a table; each batch is one commit, and one that is played again adds nothing."""

    def one(batch: DataFrame, number: int) -> None:
        append(session, table_name, batch, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

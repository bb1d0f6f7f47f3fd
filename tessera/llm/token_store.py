"""Token-ID output as directly addressable codes, in ascending document order.

Documents are dealt by range of doc_id, sorted and encoded; every task writes its ids as a run of DAC files of
about ``SEGMENT_IDS`` ids. The files are rows of one uncompressed Parquet table in the shared folder (place, ids of the
task's files before it, document bounds, bytes), so they are committed by Spark's writer, survive the loss of an
executor and are readable on any store. A document's ids are read by direct addressing of their positions alone
(``read_store``), and so is any single id (``token_at``). A document's global start is the ids of the tasks before its
own, one broadcast row a partition of the writing job, and those of the task's files before it.

Null text is empty; each document ends with id 0. Repeated doc_ids each keep a place, in text order. Rows without
doc_id have no place and are left out. Other columns are ignored. An empty table writes an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import dac
from tessera.llm.shared import Workspace, partitions, prepare, tidy
from tessera.llm.textops import chunks
from tessera.llm.token_encode import KEPT, default_tokenizer, encoder

END_ID = 0
SEGMENT_IDS = 2_000_000
#: Bytes of text encoded at once, to keep the workers small.
ENCODE_BYTES = 1 << 19
STORE = "part int, segment int, before long, n_ids long, doc_ids binary, bounds binary, data binary"


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, segment, before, held, docs, ids = encoder(path), None, 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            every = np.concatenate(ids)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<i8")
            cells = [part, segment, before, len(every), np.array(docs, "<i8").tobytes(), bounds.tobytes(), dac.encode(every)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [f.split()[0] for f in STORE.split(", ")])

        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            if len(doc):
                part = batch.column("part")[0].as_py()
            for a, b, buf, off in chunks(batch.column("text"), ENCODE_BYTES):
                got, bounds = enc.encode(buf, off)
                for d, x, y in zip(doc[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    docs.append(d)
                    ids.append(np.append(got[x:y], np.uint32(END_ID)))
                    held += y - x + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        segment, before, held, docs, ids = segment + 1, before + held, 0, [], []
        if docs:
            yield flush()

    return run


def write_store(docs: DataFrame, work: Workspace, tokenizer: str | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the DAC files; returns the store as it lies in the shared folder."""
    spark = prepare(docs.sparkSession)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = docs.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return work.write(dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(tidy(_write(tokenizer or default_tokenizer()), KEPT), STORE), "tokens", compression="none")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader = dac.Reader(row["data"])
            doc, bounds = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["bounds"], "<i8")
            crc = [zlib.crc32(reader.slice(x, y).astype("<u4")) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(store: DataFrame) -> DataFrame:
    """The files with ``start``, the ids of all files before each; one small row a partition of the writing job is broadcast."""
    order = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    return store.join(F.broadcast(parts), "part").withColumn("start", (F.col("ahead") + F.col("before")).cast("long"))


def read_store(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return _placed(store).select("doc_ids", "bounds", "data", "start").mapInArrow(tidy(_read, KEPT), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(store: DataFrame, places: DataFrame) -> DataFrame:
    """(place, doc_id, id) for every requested global position (place long) within the store, by direct addressing.

    Positions beyond the store give no row; repeated ones are answered each. Requests are dealt to the files by a
    range join on blocks of ``SEGMENT_IDS`` positions, and each file answers its own.
    """
    files = _placed(store).where("n_ids > 0").select("part", "segment", "start", "n_ids")
    cover = files.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_IDS), F.floor((F.col("start") + F.col("n_ids") - 1) / SEGMENT_IDS))))
    asked = places.where("place >= 0").select("place", F.floor(F.col("place") / SEGMENT_IDS).alias("block"))
    asked = asked.join(cover, "block").where("place >= start and place < start + n_ids").groupBy("part", "segment", "start").agg(F.collect_list(F.col("place") - F.col("start")).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, at = dac.Reader(row["data"]), np.array(row["at"], np.int64)
                doc = np.frombuffer(row["doc_ids"], "<i8")[np.searchsorted(np.frombuffer(row["bounds"], "<i8"), at, side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(at + row["start"]), pa.array(doc), pa.array([reader[i] for i in at.tolist()], pa.int64())], ["place", "doc_id", "id"])

    return store.join(asked, ["part", "segment"]).select("start", "doc_ids", "bounds", "data", "at").mapInArrow(read, "place long, doc_id long, id long")

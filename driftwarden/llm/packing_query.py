"""op6: ``documents`` packed into sequences of 1024 ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftwarden.llm import packing
from driftwarden.llm.tables import table

DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            raw = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4").view(np.uint8)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            columns = [pa.array(crc, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces.mapInArrow(summed, DIGEST)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}

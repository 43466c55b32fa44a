"""Bounded samples of labelled training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import written

#: Labelled rows, and bytes of their texts, that a classifier is fitted on at most, about.
TRAINING_ROWS, TRAINING_BYTES = 30_000, 256 << 20


def held_out(doc_id: str) -> F.Column:
    """Rows whose labels no fit may see: crc32 of the id as text has remainder 1 by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y, part) of labelled rows that aren't held out: at most about ``most`` rows, and texts of about
    ``most_bytes``, chosen by a hash of the id. ``part`` deals them into five; part 0 sets curves, the others are fitted.

    Rows without a label or an id are not used; where an id has several labels, the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = known.count()
    if n > most:
        share = most / n
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = F.broadcast(known)  # at most about ``most`` rows of an id and a label
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = written(source.join(known, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int")), "training")
    weight = found.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if weight > most_bytes:
        found = found.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(most_bytes / weight * (1 << 20)))
    return found

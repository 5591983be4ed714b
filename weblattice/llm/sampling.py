"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window, functions as F

from weblattice.sources.tables import table

#: Labelled rows that a classifier is fitted on, at most; each language has an equal part of them.
TRAIN_ROWS = 1000


def labelled(spark: SparkSession, d: str, most: int | None = TRAIN_ROWS) -> list[tuple[str, str]]:
    """(language, text) of the labelled samples: all of them, if most is None or there are no more, or of each language an equal part with the least hashes.

    Rows with a null count for nothing. The result doesn't depend on the order of the table.
    """
    rows = table(spark, d, "lang_samples", "lang", "text").dropna()
    if most is None:
        return [(r.lang, r.text) for r in rows.orderBy("lang", F.xxhash64("text"), "text").collect()]
    languages = rows.agg(F.greatest(F.count_distinct("lang"), F.lit(1))).scalar()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    kept = rows.withColumn("place", place).where(F.col("place") <= F.greatest(F.floor(F.lit(most) / languages), F.lit(1)))
    return [(r.lang, r.text) for r in kept.orderBy("lang", "place").collect()]

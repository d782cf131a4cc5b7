"""Files for analysts: the flat CSV and the report tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .functions.expr import csv_safe


def csv_frame(scored: DataFrame, sources: DataFrame) -> DataFrame:
    """The twenty export columns in order, text guarded against spreadsheet formulas."""
    joined = scored.join(sources.select("source_id", "source_name"), "source_id", "left")
    texts = {"ID": "id", "Titolo": "title", "Comune": "city", "Micro-zona": "zone", "Tipologia": "property_type", "Fonte": "source_name",
             "URL": "url", "Valuta": "currency", "Disponibilità": "availability"}
    values = {"Prezzo": "price", "Superficie mq": "surface", "Prezzo/mq": "price_sqm", "Benchmark min": "benchmark_min",
              "Benchmark max": "benchmark_max", "Sconto %": "discount", "Score economico": "score", "Completezza %": "completeness",
              "Priorità verifica": "priority_score"}
    columns = []
    for header in rules.CSV_HEADERS:
        if header == "Motore":
            columns.append(F.lit("rules").alias(header))
        elif header == "Rilevato il":
            columns.append(F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss").alias(header))
        elif header in texts:
            columns.append(csv_safe(texts[header]).alias(header))
        else:
            columns.append(F.col(values[header]).alias(header))
    return joined.select(*columns)


def sink_csv(frame: DataFrame, path: str) -> None:
    """Semicolon files, each starting with a byte-order mark before its header."""
    first = frame.columns[0]
    (frame.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("sep", ";")
     .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each report table as Parquet in its own folder."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Kept raw pages, partitioned by source."""
    snapshots.write.mode("append").partitionBy("source_id").parquet(path)

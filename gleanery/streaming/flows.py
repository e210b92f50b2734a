"""Streaming forms: weekly counts over event time, and versions of articles as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def weekly_counts(events: DataFrame, days: int, as_of: str, lateness: str = "14 days", key: str = "event_type") -> DataFrame:
    """Counts in tumbling windows of ``days`` days whose last one ends with the day ``as_of``; late rows are taken in
    for ``lateness``. ``ts`` is the event time."""
    from datetime import date

    offset = ((date.fromisoformat(as_of) - date(1970, 1, 1)).days + 1) % days
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    window = F.window("ts", f"{days} days", startTime=f"{offset} days")
    return timed.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.to_date("w.start").alias("from"),
        F.date_sub(F.to_date("w.end"), 1).alias("to"),
        key,
        "n",
    )


def unique_urls(candidates: DataFrame, at: str = "ts", lateness: str = "14 days") -> DataFrame:
    """Each canonical URL once within the lateness allowed."""
    return candidates.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["url"])


class Versions(StatefulProcessor):
    """Per article its last version (number, hash, whether it was read, profile); a row for every arrival with what it
    changed, by the rules of ``versions.change_types``."""

    OUTPUT = "key string, place long, version int, change_type string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version int, hash string, read boolean, profile string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, known, read, profile = self.last.get() if self.last.exists() else (0, None, False, None)
        out = []
        arrivals = pd.concat(list(rows)).sort_values("place")
        for place, digest, ok, method in zip(arrivals["place"], arrivals["hash"], arrivals["ok"], arrivals["profile"]):
            kind = "unchanged"
            if version == 0 or (ok and digest != known):
                kind = "new" if version == 0 else "extraction_changed" if read and method != profile else "content_changed"
                version, known, read, profile = version + 1, digest if ok else None, bool(ok), method
            out.append((str(key[0]), place, version, kind))
        self.last.update((int(version), known, read, profile))
        yield pd.DataFrame(out, columns=["key", "place", "version", "change_type"])

    def close(self) -> None:
        pass


def versions(arrivals: DataFrame) -> DataFrame:
    """``arrivals``: ``key, place, hash, ok, profile``; needs the RocksDB state store."""
    return arrivals.groupBy("key").transformWithStateInPandas(Versions(), outputStructType=Versions.OUTPUT, outputMode="Append", timeMode="None")


def caught_up(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is into Parquet below ``folder`` and read it.

    In ``update`` mode each batch is a folder of its own, and of the rows with equal ``keys`` the one of the latest
    batch counts: state stays bounded by the watermark, and a batch that is run again replaces its folder."""
    spark = stream.sparkSession
    out = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.option("basePath", out).schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return latest.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*stream.columns)

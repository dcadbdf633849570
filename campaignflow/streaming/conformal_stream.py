"""Online interval calibration as a Structured Streaming operator."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from campaignflow.operators.conformal import Controller
from campaignflow.sources.workdir import scratch

OUTPUT = ("series string, seq bigint, level double, correction double, low double, high double, covered boolean, "
          "n_late bigint")
STATE = ("level double, integral double, smooth double, total double, seen bigint, scores array<double>, "
         "gram array<double>, moment array<double>, last_seq bigint, n_late bigint")


def calibrate_stream(sequence: DataFrame, method: str = "adaptive", window: int | None = None, **options) -> DataFrame:
    """Calibrated interval per arriving (series, seq, low, high, y) row, with the controller kept as state.

    A series remembers all its scores, as in the batch, unless ``window`` bounds them. Rows must arrive in ``seq``
    order across triggers; a row at or before the last one handled comes out without an interval, counted in
    ``n_late``.
    """

    def handle(key, chunks, state: GroupState):
        controller, last, late = Controller(method, window=window, **options), None, 0
        if state.exists:
            *kept, last, late = state.get
            controller.load(tuple(kept))
        pdf = pd.concat(list(chunks)).sort_values("seq")
        out = []
        for seq, low, high, y in zip(pdf["seq"], pdf["low"], pdf["high"], pdf["y"]):
            if last is not None and seq <= last:
                late += 1
                out.append((key[0], seq, None, None, None, None, None, late))
                continue
            out.append((key[0], seq, *controller.step(low, high, y), late))
            last = int(seq)
        if window is not None:
            controller.scores = controller.scores[-(window + 1):]
        state.update((*controller.dump(), last, late))
        yield pd.DataFrame(out, columns=["series", "seq", "level", "correction", "low", "high", "covered", "n_late"])

    return sequence.groupBy("series").applyInPandasWithState(
        handle, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly_sequence(events: DataFrame, per_event: float = 50.0, spread: float = 0.5) -> DataFrame:
    """Event value per type and hour, with a band around ``per_event`` times the hour's count.

    Aggregating to hours first bounds a series by time instead of by its event count, and combines hot keys on
    the map side.
    """
    hours = events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum("value").alias("y"), F.count(F.lit(1)).alias("n"))
    centre = F.col("n") * per_event
    return hours.select(
        F.col("event_type").alias("series"), F.unix_timestamp("hour").alias("seq"),
        (centre * (1 - spread)).alias("low"), (centre * (1 + spread)).alias("high"), "y")


def replay(sequence: DataFrame, method: str = "adaptive", days_per_trigger: int = 5, **options) -> DataFrame:
    """Run the stream over a stored sequence, one span of days arriving after another, and return all it emitted.

    The sequence, the stream's checkpoint and its output live in the shared folder.
    """
    spark = sequence.sparkSession
    source, state, sink = (scratch(spark, f"conformal-{n}") for n in ("in", "state", "out"))
    span = F.floor(F.col("seq") / (86400 * days_per_trigger))
    stored = sequence.withColumn("span", span).persist()
    # The spans are a short list bounded by the calendar; rows never pass through the driver.
    spans = [r["span"] for r in stored.select("span").distinct().orderBy("span").collect()]
    for s in spans:
        stored.where(F.col("span") == s).drop("span").write.mode("append").parquet(source)
        stream = spark.readStream.schema(sequence.schema).parquet(source)
        query = (
            calibrate_stream(stream, method, **options).writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", state).trigger(availableNow=True).start(sink))
        query.awaitTermination()
    stored.unpersist()
    return spark.read.schema(OUTPUT).parquet(sink)

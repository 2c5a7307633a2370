"""Sequential replay of observations: quality, change flag, next-day forecast, proposed action.

Two forms with the same results: a batch plan of windows, and a stateful stream that keeps
the previous row and at most seven valid readings for each series. Both hand on the readings
that a forecast may use, and the forecast is one set of column expressions over these.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.numbers import cyclic_calendar
from millrace.operators.ml import Fitted
from millrace.sources.scratch import delete_at_exit, shared_folder

NEEDED = 7
OUTPUT = (
    "series string, seq long, observation_date date, level_cm double, quality string, delta_cm double,"
    " statistical_flag boolean, target_date date, recent array<double>, proposed_action string"
)
STATE = "prev_date date, prev_level double, recent array<double>"


def typed(observations: DataFrame) -> DataFrame:
    """(series, seq, date, level): text that is no date or number becomes null, NaN and infinities too."""
    level = F.expr("try_cast(level AS double)")
    level = F.when(~F.isnan(level) & (F.abs(level) != F.lit(float("inf"))), level)
    date = F.expr("try_cast(date AS date)")
    return observations.select(F.col("series").cast("string").alias("series"), F.col("seq").cast("long").alias("seq"), date.alias("date"), level.alias("level"))


def past_features(recent: Column, target: Column) -> dict[str, Column]:
    """The features of the day after seven consecutive readings, those of series.island_features and the calendar."""
    at = lambda k: F.get(recent, F.lit(NEEDED - k))
    mean = lambda k: sum((at(i) for i in range(1, k + 1)), F.lit(0.0)) / k
    out = {"value_lag1": at(1), "mean_change7": (at(1) - at(7)) / 6}
    out |= {f"delta_lag{k}": at(k) - at(k + 1) for k in (1, 2, 3)}
    out |= {f"deviation_mean{k}": at(1) - mean(k) for k in (3, 7)}
    return out | cyclic_calendar(target)


def forecast(rows: DataFrame, model: str | Fitted) -> DataFrame:
    """prediction in place of recent: by persistence, drift, or a fitted model of the change to the next day."""
    ready = F.col("recent").isNotNull()
    last, before = (F.get("recent", F.lit(NEEDED - k)) for k in (1, 2))
    if isinstance(model, Fitted):
        features = {f"_{k}": v for k, v in past_features(F.col("recent"), F.col("target_date")).items()}
        # the model's feature names may be columns of the rows: those are kept aside
        wide = rows.select(F.struct("*").alias("_row"), *[v.alias(k.removeprefix("_")) for k, v in features.items()])
        rows = model.predict(wide, "_change").select("_row.*", "_change")
        value = last + F.col("_change")
    elif model in ("persistence", "drift"):
        value = last if model == "persistence" else 2 * last - before
    else:
        raise ValueError(f"no such model: {model}")
    names = [c for c in rows.columns if c not in ("recent", "_change")]
    at = names.index("proposed_action")
    return rows.select(*names[:at], F.when(ready, value).alias("prediction"), *names[at:])


def replay_batch(observations: DataFrame, threshold: float | Column, model: str | Fitted = "persistence") -> DataFrame:
    """Replay each series in the order of seq (unique within a series); see replay_stream for the columns.

    A day needs a valid date one day after a valid date of the previous row to continue a
    run; a row that does not, or has no valid level, starts the run of readings anew. The
    order given is kept: a late row is a date gap.
    """
    order = Window.partitionBy("series").orderBy("seq")
    rows = typed(observations).withColumns(
        {"has_prev": F.row_number().over(order) > 1, "prev_date": F.lag("date").over(order), "prev_level": F.lag("level").over(order)}
    )
    next_day = F.coalesce(F.datediff("date", "prev_date") == 1, F.lit(False))
    rows = rows.withColumn("next_day", next_day).withColumn(
        "quality",
        F.when(F.col("date").isNull(), "invalid_date")
        .when(F.col("level").isNull(), "missing_or_invalid")
        .when(F.col("has_prev") & ~F.col("next_day"), "date_gap")
        .otherwise("valid"),
    )
    anew = ~F.col("next_day") | F.col("level").isNull() | F.col("date").isNull()
    rows = rows.withColumn("run", F.sum(anew.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("series", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("held", F.count(F.when(F.col("date").isNotNull(), F.col("level"))).over(in_run))
    rows = rows.withColumn("delta_cm", F.when(F.col("next_day"), F.col("level") - F.col("prev_level")))
    ready = (F.col("quality") == "valid") & (F.col("held") >= NEEDED)
    last = Window.partitionBy("series", "run").orderBy("seq").rowsBetween(1 - NEEDED, 0)
    rows = rows.withColumn("recent", F.collect_list("level").over(last))
    flag = F.coalesce((F.col("quality") == "valid") & (F.abs("delta_cm") > threshold), F.lit(False))
    rows = rows.withColumn("statistical_flag", flag)
    action = F.when(F.col("statistical_flag"), "check_measurement_and_context_manually")
    action = action.when(F.col("quality") == "valid", "routine_observation").otherwise("check_missing_or_invalid_record")
    rows = rows.select(
        "series",
        "seq",
        F.col("date").alias("observation_date"),
        F.col("level").alias("level_cm"),
        "quality",
        "delta_cm",
        "statistical_flag",
        F.date_add("date", 1).alias("target_date"),
        F.when(ready, F.col("recent")).alias("recent"),
        action.alias("proposed_action"),
    )
    return forecast(rows, model)


def _step(prev: tuple | None, recent: list[float], date, level: float | None, threshold: float) -> tuple[dict, list[float]]:
    """One observation against the state; prev is (date, level) of the row before, if any."""
    next_day = prev is not None and prev[0] is not None and date is not None and (date - prev[0]).days == 1
    if date is None:
        quality = "invalid_date"
    elif level is None:
        quality = "missing_or_invalid"
    elif prev is not None and not next_day:
        quality = "date_gap"
    else:
        quality = "valid"
    if not next_day or level is None:
        recent = []
    if level is not None and date is not None:
        recent = [*recent, level][-NEEDED:]
    delta = level - prev[1] if next_day and level is not None and prev[1] is not None else None
    flag = quality == "valid" and delta is not None and abs(delta) > threshold
    ready = recent if quality == "valid" and len(recent) == NEEDED else None
    action = "check_measurement_and_context_manually" if flag else "routine_observation" if quality == "valid" else "check_missing_or_invalid_record"
    return {"quality": quality, "delta_cm": delta, "statistical_flag": flag, "recent": ready, "proposed_action": action}, recent


def replay_stream(observations: DataFrame, threshold: float, model: str | Fitted = "persistence") -> DataFrame:
    """The replay as a stateful stream: observations is a streaming frame (series, seq, date, level).

    Rows of one micro-batch are taken in the order of seq: those of one series meet in one
    task, so the source's trigger options bound them; for back-fills there is the batch twin.
    The state of a series is its previous row and at most seven readings. The fitted model
    is applied to the stream's rows, not within the state. Returns (series, seq,
    observation_date, level_cm, quality, delta_cm, statistical_flag, target_date, prediction, proposed_action).
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev, recent = None, []
        if state.exists:
            d, v, r = state.get
            prev, recent = (d, v), list(r)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, date, level in zip(rows["seq"], rows["date"], rows["level"], strict=True):
            date = None if pd.isna(date) else pd.Timestamp(date).date()
            level = None if level is None or math.isnan(level) else float(level)
            result, recent = _step(prev, recent, date, level, threshold)
            target = None if date is None else (pd.Timestamp(date) + pd.Timedelta(days=1)).date()
            out.append({"series": key[0], "seq": seq, "observation_date": date, "level_cm": level, "target_date": target} | result)
            prev = (date, level)
        state.update((prev[0], prev[1], recent))
        yield pd.DataFrame(out)[[c.strip().split(" ")[0] for c in OUTPUT.split(",")]]

    rows = typed(observations).groupBy("series").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return forecast(rows, model)


def replay_files(observations: DataFrame, threshold: float, model: str | Fitted = "persistence", batches: int = 2) -> DataFrame:
    """Replay a table as a stream: its rows in so many micro-batches by seq, read from files of the shared folder.

    Each series is cut at the same seq numbers. Runs until all is read; returns the written actions.
    """
    spark = observations.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    last = observations.agg(F.max("seq")).first()[0] or 0
    step = last // batches + 1
    plain = observations.select("series", "seq", "date", "level")
    for n in range(batches):
        # one file a micro-batch, in the order of their times
        plain.filter(F.col("seq").between(n * step, (n + 1) * step - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rows = replay_stream(stream, threshold, model)
    run = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    delete_at_exit(spark, folder)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def daily_stream(readings: DataFrame, time: str, keys: list[str], value: str, late: str = "2 days") -> DataFrame:
    """Daily means of a stream of readings; days close when the watermark passes them."""
    rows = readings.withWatermark(time, late)
    days = rows.groupBy(F.window(time, "1 day"), *keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    return days.select(F.to_date("window.start").alias("day"), *keys, "mean_value", "n")


def summary(actions: DataFrame) -> DataFrame:
    """One row: observations, forecasts, flags and rows that are not valid."""
    return actions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("prediction").alias("predictions"),
        F.count_if("statistical_flag").alias("flags"),
        F.count_if(F.col("quality") != "valid").alias("quality_failures"),
    )


def parity(batch: DataFrame, stream: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows on both sides and how many of them differ in quality, flag or forecast."""
    a = batch.select("series", "seq", F.struct("quality", "statistical_flag").alias("a"), F.col("prediction").alias("pa"))
    b = stream.select("series", "seq", F.struct("quality", "statistical_flag").alias("b"), F.col("prediction").alias("pb"))
    both = a.join(b, ["series", "seq"], "full")
    same = (F.col("a") == F.col("b")) & (F.col("pa").eqNullSafe(F.col("pb")) | (F.abs(F.col("pa") - F.col("pb")) <= tolerance))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differences"))

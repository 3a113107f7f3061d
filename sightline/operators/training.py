"""Training runs: metric comparison, summaries and progress read from log lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import format_elapsed
from .ordered import Chunks

# Words that mark a preparation line or the start of training.
PREPARING_WORDS = (
    "scanning", "loading", "cache", "labels", "dataset", "images", "caching", "reading",
    "found", "missing", "empty", "checking",
)
STARTING_WORDS = (
    "starting training", "train:", "starting epoch", "beginning training", "training started",
    "optimizer:", "lr0=", "momentum=", "ultralytics yolo", "python train.py", "model summary:",
    "freezing", "amp:", "epochs:", "image sizes", "starting training for",
    "training parameters:", "wandb:", "tensorboard:",
)
# Line formats of the training log. The pair ``n/m`` is one group, split later.
EPOCH_FORMATS = (
    r"(?i)Epoch\s+(\d+/\d+)",
    r"(?i)(\d+/\d+).*?epochs?",
    r"^(\d+/\d+)\s+",
)
BATCH_FORMAT = r"(\d+)%.*?(\d+/\d+)"
SPEED_FORMAT = r"\d+%.*?\d+/\d+.*?\[[\d:]+<[\d:]+,\s*([\d.]+)it/s\]"
BAR_FORMATS = (r"\|.*?\|.*?\d+/\d+", r"\d+/\d+.*?\[.*?\]")


def compare_runs(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics of two runs side by side by epoch; ``delta`` is run minus baseline."""
    keys = ["metric", "epoch"]
    a = run.select(*keys, F.col("value").alias("value"))
    b = baseline.select(*keys, F.col("value").alias("baseline"))
    return a.join(b, keys, "full").withColumn("delta", F.col("value") - F.col("baseline"))


def metrics_long(wide: DataFrame, id_columns=("run_id", "epoch")) -> DataFrame:
    """Wide epoch rows → ``(run_id, epoch, metric, value)``; missing values are dropped."""
    names = [c for c in wide.columns if c not in id_columns]
    values = wide.select(*id_columns, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])
    return values.unpivot(list(id_columns), names, "metric", "value").filter(
        F.col("value").isNotNull()
    )


def run_summary(
    metrics: DataFrame, lower_is_better: str = "loss", patience: int = 50
) -> DataFrame:
    """Best and last epoch per run and metric, and epochs since the best against ``patience``."""
    falls = F.col("metric").contains(lower_is_better)
    goodness = F.when(falls, -F.col("value")).otherwise(F.col("value"))
    d = metrics.groupBy("run_id", "metric").agg(
        F.max(F.struct(goodness.alias("g"), (-F.col("epoch")).alias("e"), "value")).alias("best"),
        F.max(F.struct("epoch", "value")).alias("last"),
        F.count("*").alias("epochs"),
    )
    out = d.select(
        "run_id", "metric", "epochs",
        (-F.col("best.e")).cast("bigint").alias("best_epoch"),
        F.col("best.value").alias("best_value"),
        F.col("last.epoch").cast("bigint").alias("last_epoch"),
        F.col("last.value").alias("last_value"),
    )
    gap = F.col("last_epoch") - F.col("best_epoch")
    return out.withColumns({"epochs_since_best": gap, "stop_due": gap >= patience})


def _has_any(line: Column, words) -> Column:
    """True where the line holds one of the words: one pattern, to keep generated code small."""
    return line.rlike("(?i)" + "|".join(re.escape(w) for w in words))


def _numbers(text: Column, sep: str, *names: str) -> Column:
    parts = [F.split_part(text, F.lit(sep), F.lit(i + 1)) for i in range(len(names))]
    # A failing cast is slow inside Spark, so the common empty text is nulled before it.
    return F.struct(
        *[F.nullif(p, F.lit("")).try_cast("bigint").alias(n) for p, n in zip(parts, names)]
    )


def parse_training_log(log: DataFrame, total_epochs: int = 100, parity: bool = False) -> DataFrame:
    """Read phase, epoch, batch, speed and overall percent off each line of a run's log.

    ``epoch`` and ``total_epochs`` carry the last epoch seen forward. A batch line
    is read before the looser progress-bar check; ``parity`` puts that check
    first, which hides the batch figures of every line without a preparation word.
    """
    keys, order = ["run_id"], ["line_no"]
    line = F.trim("line")
    total = F.lit(total_epochs).cast("bigint")
    # Every format is matched once per line; later steps work on the short texts it caught.
    pairs = F.array(*[F.regexp_extract(line, pattern, 1) for pattern in EPOCH_FORMATS])
    pairs = F.transform(pairs, lambda text: _numbers(text, "/", "e", "t"))
    limit = total
    found = F.get(
        F.filter(
            pairs, lambda p: p["e"].between(F.lit(1), F.when(p["t"] > 0, p["t"]).otherwise(limit))
        ),
        F.lit(0),
    )
    batch = F.regexp_extract(line, BATCH_FORMAT, 0)
    bar = F.length(batch) > 0
    for pattern in BAR_FORMATS:
        bar = bar | line.rlike(pattern)
    c = Chunks(log.filter(F.length(line) > 0), keys, order)
    d = c.rows.withColumns(
        {
            "__prep": _has_any(line, PREPARING_WORDS),
            "__start": _has_any(line, STARTING_WORDS),
            "__found": found,
            "__bar": bar,
            "__batch": batch,
        }
    )
    upto = c.inside.rowsBetween(W.unboundedPreceding, 0)
    # Training opens with a starting line, or a progress bar outside the preparation.
    opens = F.col("__start") | (F.col("__bar") & ~F.col("__prep"))
    d = d.withColumn("__open", F.max(opens).over(upto))
    # Until a first epoch counts, starting lines, and preparation lines before the opening, do not.
    able = F.col("__found").isNotNull() & ~F.col("__start")
    n = F.col("line_no")
    s = c.summary(
        d,
        F.max("__open").alias("open"),
        F.min(F.when(able, n)).alias("first_open"),
        F.min(F.when(able & (~F.col("__prep") | F.col("__open")), n)).alias("first_closed"),
        F.min_by("ts", F.when(able, n)).alias("ts_open"),
        F.min_by("ts", F.when(able & (~F.col("__prep") | F.col("__open")), n)).alias("ts_closed"),
        F.max_by("__found", F.when(F.col("__found").isNotNull(), n)).alias("last"),
        F.min("ts").alias("started_at"),
    )
    s = s.withColumn("__begun", F.coalesce(F.max("open").over(c.earlier), F.lit(False)))
    s = s.withColumn(
        "__first", F.when(F.col("__begun"), F.col("first_open")).otherwise(F.col("first_closed"))
    )
    seen = F.coalesce(F.max(F.col("__first").isNotNull()).over(c.earlier), F.lit(False))
    s = s.withColumn("__seen", seen)
    s = s.withColumn("__last", F.when(F.col("__seen") | F.col("__first").isNotNull(), F.col("last")))
    s = s.withColumn("__carried", F.last("__last", ignorenulls=True).over(c.earlier))
    whole = W.partitionBy(*keys)
    first_ts = F.when(F.col("__begun"), F.col("ts_open")).otherwise(F.col("ts_closed"))
    s = s.withColumns(
        {
            "started_at": F.min("started_at").over(whole),
            "training_at": F.min(first_ts).over(whole),
        }
    )
    s = s.select(
        *keys, "__chunk", "__begun", "__first", "__seen", "__carried", "started_at", "training_at"
    )
    d = d.join(s, [*keys, "__chunk"], "left")
    begun = F.col("__begun") | F.col("__open")
    counts = F.col("__seen") | F.coalesce(n >= F.col("__first"), F.lit(False))
    d = d.withColumn("__now", F.when(counts, F.col("__found")))
    before = c.inside.rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn(
        "__past", F.coalesce(F.last("__now", ignorenulls=True).over(before), F.col("__carried"))
    )
    past = F.coalesce(F.col("__past.e"), F.lit(0))
    stated = F.when(F.col("__now.t") > 0, F.col("__now.t"))
    d = d.withColumns(
        {
            "epoch": F.coalesce(F.col("__now.e"), past).cast("bigint"),
            "total_epochs": F.coalesce(
                stated, F.when(F.col("__past.t") > 0, F.col("__past.t")), total
            ),
            "is_epoch_line": F.coalesce(F.col("__now.e") != past, F.lit(False)),
        }
    )
    epoch, total = F.col("epoch"), F.col("total_epochs")
    batch_line = (F.length("__batch") > 0) & (epoch > 0) & ~F.col("is_epoch_line")
    if parity:
        batch_line = batch_line & ~(F.col("__bar") & ~F.col("__prep"))
    done = _numbers(F.regexp_extract("__batch", r"\d+/\d+$", 0), "/", "n", "of")
    share = _numbers(F.col("__batch"), "%", "n")["n"]
    overall = (epoch - 1) / total * 100 + share / 100 * (F.lit(1.0) / total) * 100
    phase = (
        F.when(epoch > 0, "training")
        .when(begun, "starting")
        .when(F.col("__prep"), "preparing")
        .otherwise("unknown")
    )
    return d.select(
        "run_id", "line_no", "ts", "line", phase.alias("phase"),
        "epoch", "total_epochs", "is_epoch_line",
        F.when(batch_line, done["n"]).alias("batch"),
        F.when(batch_line, done["of"]).alias("batches"),
        F.when(
            batch_line,
            F.nullif(F.regexp_extract(line, SPEED_FORMAT, 1), F.lit("")).try_cast("double"),
        ).alias("its_per_sec"),
        F.when(F.col("is_epoch_line"), F.floor(epoch / total * 100))
        .when(batch_line, F.least(F.lit(100), F.floor(overall)))
        .cast("bigint").alias("percent"),
        "started_at", F.when(epoch > 0, F.col("training_at")).alias("training_at"),
    )


def training_eta(
    elapsed: Column, training_elapsed: Column, epoch: Column, total: Column,
    its_per_sec: Column, batch: Column, batches: Column, percent: Column,
) -> Column:
    """Seconds left: from the mean epoch, else from batches per second, else from percent."""
    known = (epoch > 0) & (total > 0)
    by_epoch = training_elapsed / epoch * (total - epoch)
    by_speed = ((batches - batch) + (total - epoch) * batches) / its_per_sec
    by_percent = elapsed / percent * (F.lit(100) - percent)
    return (
        F.when(known & (training_elapsed > 0), F.when(by_epoch > 0, by_epoch))
        .when(known & (its_per_sec > 0), by_speed)
        .when(percent > 5, by_percent)
    )


def log_eta(parsed: DataFrame) -> DataFrame:
    """Elapsed and remaining time at each line of a parsed log."""
    def since(start):
        return (F.unix_micros(F.col("ts").cast("timestamp"))
                - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(1e6)

    running = F.coalesce(since("training_at"), F.lit(0.0))
    eta = training_eta(
        since("started_at"), running, F.col("epoch"), F.col("total_epochs"),
        F.col("its_per_sec"), F.col("batch"), F.col("batches"), F.col("percent"),
    )
    return parsed.withColumns(
        {"elapsed_s": since("started_at"), "training_s": running, "remaining_s": eta}
    ).withColumns(
        {"elapsed": format_elapsed(F.col("elapsed_s")),
         "remaining": format_elapsed(F.col("remaining_s"))}
    )

"""Job progress from log lines: sums with one plan for batch and stream, and the open cell by order of lines or by state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GRID_CELLS = 60

# what a line may tell: (words it must hold, number beside them, type)
FIELDS = {
    "planned": ("granules to download", r"(\d+) granules to download", "long"),
    "skipped": ("already done", r"(\d+) already done", "long"),
    "gb": ("download size", r"download size: ([0-9.]+)", "double"),
    "chips": ("chips written", r"(\d+) chips", "long"),
    "granules": ("granules processed", r"(\d+) granules processed", "long"),
    "cell_seconds": ("granules processed", r"done in ([0-9.]+)", "double"),
}


# what a line tells of the cell that is open
OPEN_FIELDS = {
    "todo": ("granules to download", r"(\d+) granules to download", "long"),
    "skipped": ("already done", r"(\d+) already done", "long"),
    "downloaded": ("] downloaded ", r"\[(\d+)/\d+\] downloaded", "long"),
    "download_seconds": ("] downloaded ", r"files, ([0-9.]+)s", "double"),
    "chips": ("chips written", r"(\d+) chips", "long"),
}
OPEN_COLUMNS = "seq long, current_cell string, todo long, skipped long, downloaded long, chips long, last_download_seconds double, last_extract_chips long, all_done boolean"


def parse_lines(lines: DataFrame, fields: dict = FIELDS) -> DataFrame:
    """Typed fields of each line; an expression only runs on lines that hold its words.

    They go through a one-element explode, so that each is matched once per
    line however often the aggregates use its field.
    """
    typed = [F.when(F.col("line").contains(words), F.regexp_extract("line", number, 1).try_cast(kind)).alias(name)
              for name, (words, number, kind) in fields.items()]
    packed = F.explode(F.array(F.struct(*typed, F.col("line").contains("ALL CELLS DONE").alias("all_done"))))
    return lines.select("*", packed.alias("_f")).select(*lines.columns, "_f.*")


def progress_metrics(lines: DataFrame, by: list[str]) -> DataFrame:
    """Planned, skipped, chips, granules, seconds, granules left and end mark per shard; sums only, so the
    same plan is incremental on a stream."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = parse_lines(lines).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("planned").alias("cells_seen"), zero("planned").alias("planned"),
        zero("skipped").alias("skipped"), zero("chips").alias("chips"), F.count("granules").alias("cells_done"),
        zero("granules").alias("granules"), F.coalesce(F.sum("cell_seconds"), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.sum("gb"), F.lit(0.0)).alias("gb"), F.count("gb").alias("n_sizes"), F.coalesce(F.bool_or("all_done"), F.lit(False)).alias("all_done"))
    return out.withColumn("remaining", F.greatest(F.col("planned") - F.col("granules"), F.lit(0)))


def extrapolate(metrics: DataFrame, grid_cells: int = GRID_CELLS) -> DataFrame:
    """Totals over shards, extended to the cells not seen yet."""
    t = metrics.agg(*[F.sum(c).alias(c) for c in ("cells_seen", "planned", "granules", "chips", "gb", "n_sizes")])
    per_cell = F.coalesce(F.try_divide(F.col("planned"), F.col("cells_seen")), F.lit(0.0))
    per_granule = F.coalesce(F.try_divide(F.col("gb"), F.col("n_sizes")), F.lit(0.0))
    total = F.col("planned") + F.greatest(F.lit(0), F.lit(grid_cells) - F.col("cells_seen")) * per_cell
    return t.withColumns({"avg_per_cell": per_cell, "estimated_granules": total, "estimated_gb": total * per_granule})


def stream_progress(spark, folder: str, name: str):
    """The same metrics over log files as they arrive (shard = file name)."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("shard"))
    return progress_metrics(lines, ["shard"]).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


# --- the open cell ---------------------------------------------------------------
def open_lines(lines: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Lines that tell something of the open cell, typed; ``cell`` is set on a line that opens one."""
    opens = F.col("line").contains("CELL ") & ~F.col("line").contains("done") & ~F.col("line").contains("DONE")
    out = parse_lines(lines, OPEN_FIELDS).withColumn("cell", F.when(opens, F.nullif(F.regexp_extract("line", r"CELL ([A-Z]{2}-\d{4})", 1), F.lit(""))))
    told = F.coalesce(F.col("cell"), *[F.col(c).cast("string") for c in OPEN_FIELDS]).isNotNull() | F.col("all_done")
    return out.where(told).select(*by, F.col(seq).cast("long").alias("seq"), "cell", *OPEN_FIELDS, "all_done")


def _with_left(state: DataFrame) -> DataFrame:
    """Granules the open cell still wants; none where no cell is open."""
    left = F.greatest(F.coalesce("todo", F.lit(0)) - F.col("downloaded"), F.lit(0))
    return state.withColumn("left", F.when(F.col("current_cell").isNotNull(), left).otherwise(0))


def open_cells(lines: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """Per shard the cell opened last and what followed it: granules to do, skipped, place of the last download, chips; and, over all
    lines, the last download's seconds, the last extract's chips and the end mark.

    Two combined aggregates, the first for the line that opens the last cell, so that a long log is never sorted. ``seq``, unique in a
    shard, orders its lines. Shards without such lines do not appear.
    """
    told = open_lines(lines, by, seq)
    heads = told.groupBy(*by).agg(F.max(F.when(F.col("cell").isNotNull(), F.struct("seq", "cell"))).alias("head"))
    after = F.col("head").isNull() | (F.col("seq") > F.col("head.seq"))
    last = lambda c, when=None: F.max_by(c, F.when(F.col(c).isNotNull() & (F.lit(True) if when is None else when), F.col("seq")))
    out = told.join(heads, by).groupBy(*by).agg(
        F.max("seq").alias("seq"), F.max("head.cell").alias("current_cell"), last("todo", after).alias("todo"), last("skipped", after).alias("skipped"),
        F.coalesce(last("downloaded", after), F.lit(0)).alias("downloaded"), F.coalesce(F.sum(F.when(after, F.col("chips"))), F.lit(0)).alias("chips"),
        last("download_seconds").alias("last_download_seconds"), last("chips").alias("last_extract_chips"), F.bool_or("all_done").alias("all_done"))
    return _with_left(out)


class _OpenCell(StatefulProcessor):
    """State of a shard: the open cell's fields and the number of the last line taken."""

    FIELDS = [f.split()[0] for f in OPEN_COLUMNS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cell", OPEN_COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        now = dict(zip(self.FIELDS, self.state.get())) if self.state.exists() else {"seq": -1, "current_cell": None, "todo": None, "skipped": None, "downloaded": 0,
                                                                                     "chips": 0, "last_download_seconds": None, "last_extract_chips": None, "all_done": False}
        new = pd.concat(parts).sort_values("seq")
        new = new[new["seq"] > now["seq"]]  # a line that comes again is not counted again
        if len(new):
            opens = new["cell"].notna().to_numpy().nonzero()[0]
            after = new
            if len(opens):
                after = new.iloc[opens[-1] + 1:]
                now.update(current_cell=new["cell"].iloc[opens[-1]], todo=None, skipped=None, downloaded=0, chips=0)
            for c, of, kind in (("todo", after, int), ("skipped", after, int), ("downloaded", after, int), ("download_seconds", new, float), ("chips", new, int)):
                known = of[c].dropna()
                if len(known):
                    now[{"download_seconds": "last_download_seconds", "chips": "last_extract_chips"}.get(c, c)] = kind(known.iloc[-1])
            now["chips"] += int(after["chips"].fillna(0).sum())
            now["all_done"] = bool(now["all_done"] or new["all_done"].any())
            now["seq"] = int(new["seq"].iloc[-1])
            self.state.update(tuple(now[f] for f in self.FIELDS))
        yield pd.DataFrame([[*key, *(now[f] for f in self.FIELDS)]], columns=[*self.by, *self.FIELDS])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """State stores of queries started inside are RocksDB's, which keyed state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_open_cells(lines: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """``open_cells`` of a stream, kept as state: each trigger gives the shards it touched as they stand after it.

    Lines of a shard must not come in a later trigger than their followers, as those of a log that grows; inside a trigger any order will do, and
    a task holds a shard's telling lines of one trigger (bound it by the source's files per trigger). Start the query under ``keyed_state``.
    """
    told = open_lines(lines, by, seq)
    kinds = ", ".join(f"`{c}` {dict(told.dtypes)[c]}" for c in by)
    processor = _OpenCell()
    processor.by = by
    return _with_left(told.groupBy(*by).transformWithStateInPandas(processor, f"{kinds}, {OPEN_COLUMNS}", "Update", "None"))

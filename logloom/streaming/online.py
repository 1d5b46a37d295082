"""Online mode: Structured Streaming over incoming log files.

Generators without state run as they are. The others keep their miner's state per group in the state store, so a restart resumes from
the checkpoint. Rows of a micro-batch are sorted by (file, line) within the handler, since a state handler gets them in no order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..functions.variables import DIGITS, VariableRules
from ..operators import cluster
from ..operators.cluster import Saved
from ..sources.formats import LogFormat
from ..sources.parse import number_lines, parse_lines
from ..store import LogStore


def stream_lines(spark: SparkSession, path: str, fmt: LogFormat, files_per_trigger: int = 100) -> DataFrame:
    """Parsed lines of a growing folder; file and row tell the order within a micro-batch."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    named = raw.select(T.valid_text(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return parse_lines(named, fmt).where("words is not null")


def mined_stream(lines: DataFrame, group: Column, miner: Callable[[], Saved]) -> DataFrame:
    """cid, tpl and the position of each line (column ``at``, any sortable text) by ``miner``, with its whole state per group.

    lines: at and words. The state is what the miner's dump() gives, so a restarted stream goes on where it stopped.
    """
    keyed = lines.select(group.cast("string").alias("g"), "at", "words")

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = miner()
        if state.exists:
            own.load(state.get[0])
        rows = pd.concat(list(frames)).sort_values("at")  # one group of one micro-batch
        out = []
        for at, words in zip(rows["at"], rows["words"], strict=True):
            cid, tpl = own.add(list(words))
            out.append((at, f"{key[0]}/{cid}", list(tpl)))
        state.update((own.dump(),))
        yield pd.DataFrame(out, columns=["at", "cid", "tpl"])

    return keyed.groupBy("g").applyInPandasWithState(handle, "at string, cid string, tpl array<string>", "state string", "append", GroupStateTimeout.NoTimeout)


def drain_stream(lines: DataFrame, threshold: float = 0.3, depth: int = 3, rules: VariableRules = DIGITS) -> DataFrame:
    """Drain with state per leaf."""
    masked = lines.select("at", rules.template(F.col("words")).alias("words"))
    return mined_stream(masked, cluster.drain_leaf(F.col("words"), depth), lambda: cluster.Drain(threshold))


def lenma_stream(lines: DataFrame, threshold: float = 0.9, n_same: int = 3, head_rule: bool = True) -> DataFrame:
    """Word-length clusters with state per number of words."""
    return mined_stream(lines, F.size("words"), lambda: cluster.Lenma(threshold, n_same, head_rule))


def shiso_stream(lines: DataFrame, threshold: float = 0.9, max_child: int = 4) -> DataFrame:
    """The search tree: one state, as the method has no independent parts."""
    return mined_stream(lines, F.lit("all"), lambda: cluster.Shiso(threshold, max_child))


def tree_stream(lines: DataFrame, max_child: int = 6, cut_depth: int = 3, message_type: str = "length") -> DataFrame:
    """Frequent-word trees with state per message type, each with the counts of its own words."""
    return mined_stream(lines, cluster.tree_of(message_type), lambda: cluster.CountingTree(max_child, cut_depth))


def counts_by_window(lines: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Lines per host and window, with a watermark for late ones; dt is cast, as watermarks need a zoned time."""
    timed = lines.withColumn("ts", F.col("dt").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "host").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "host", "n")


def ingest(lines: DataFrame, store: LogStore, generator, checkpoint: str, available_now: bool = True):
    """Append every micro-batch to ``store`` with templates of ``generator`` (lines -> lines with tpl); ids follow the store's.

    A batch that is run again after a failure is left out if the store has it already: its id comes in with its lines and templates. Line
    ids follow the order of files and of the lines in them.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        store.recover()
        if batch.isEmpty() or store.has_batch(batch_id):
            return
        numbered = number_lines(batch.withColumn("seq", F.monotonically_increasing_id()), F.struct("file", "block"), F.col("seq"))
        store.add_lines(generator(numbered).select("lid", "dt", "host", "words", "symbols", "tpl"), batch_id=batch_id)

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

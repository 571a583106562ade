"""State kept every so many sequences, so that a read as of any sequence sees one kept state and the tail after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.materialize import KEY, latest

#: Of a row kept for several states: the numbers of the first and the last, and the one it lies at.
FIRST, END, NODE = "__first", "__end", "__node"


class StateCheckpoints:
    """A log and its states under a folder, so that a read as of a sequence sees the state of the last ``every`` sequences'
    end before it, and the entries after that.

    ``write`` keeps a whole log at once, in files sorted by part (``every`` entries of each stream).  A row that an entry
    leaves stays the same in all states until the row's next entry, so it is kept once, with the numbers of the first
    and the last of these states: as many rows as the log has at most, however many states.  It lies at the number between them
    that the highest power of two divides; the rows of one state lie at one number for each power, so a read asks for few
    numbers, all of whose rows some one state holds together.

    ``extend`` adds a part, in a folder of its own, with the state after it; parts and states that were added this way count
    in place of those that ``write`` kept.

    ``schema`` is the log's (``stream_id, sequence, op, table_name, pk`` and what a row carries)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, every: int):
        self.spark, self.path, self.schema, self.every = spark, path.rstrip("/"), schema, every

    def write(self, log: DataFrame) -> None:
        """Keep a log and all its states, in place of what was kept.  Of a row, only the last entry in each part counts, so a
        row that is written very often makes no large task."""
        for name in ("log", "states"):
            folder, files = self._files(name)
            files.delete(folder, True)
        cut = log.select(*self.schema.names).withColumn("part", F.floor((F.col("sequence") - 1) / self.every).cast("long"))
        self._put_whole(cut, "log", "part", "stream_id", "sequence")
        last = latest(cut, [*KEY, "part"], F.desc("sequence"))
        until = F.lead("part").over(Window.partitionBy(*KEY).orderBy("part"))
        whole = log.groupBy("stream_id").agg(F.floor(F.max("sequence") / self.every).cast("long").alias("__whole"))
        kept = last.withColumn("__until", until).where("op = 'putRow'").join(whole, "stream_id")
        kept = kept.withColumns({FIRST: F.col("part") + 1, END: F.coalesce(F.col("__until"), F.col("__whole"))}).where(F.col(FIRST) <= F.col(END))
        power = f"length(bin(({FIRST} - 1) ^ {END})) - 1"
        node = F.expr(f"shiftleft(shiftright({END}, {power}), {power})")
        self._put_whole(kept.select(*self.schema.names, FIRST, END, node.alias(NODE)), "states", NODE, *KEY)

    def extend(self, part: DataFrame, number: int) -> None:
        """Keep the entries of part ``number``, whole or not, and, of the streams for which it is whole, the state
        after it.  The same part again takes its place."""
        cut = part.select(*self.schema.names)
        self._put(cut.withColumn("part", F.lit(number).cast("long")), "log", "part")
        streams = cut.groupBy("stream_id").agg(F.max("sequence").alias("head")).where(F.col("head") == (number + 1) * self.every).select("stream_id")
        state = latest(self._state(number).unionByName(cut), KEY, F.desc("sequence")).where("op = 'putRow'")
        self._put(state.join(streams, "stream_id").select(*self.schema.names).withColumn("at", F.lit(number + 1).cast("long")), "states", "at")

    def at(self, sequence: int) -> DataFrame:
        """The rows that each stream's entries up to a sequence leave (of a shorter one, all its entries)."""
        number = sequence // self.every
        tail = self._part(number).where(F.col("sequence") <= sequence)
        if number == 0:
            return latest(tail, KEY, F.desc("sequence")).where("op = 'putRow'")
        # A stream that ended before has no state at this number: its last one and what follows count.
        held = self._state(number)
        short = self._ended(number)
        rows = held.unionByName(tail) if short is None else held.unionByName(tail).unionByName(short)
        return latest(rows, KEY, F.desc("sequence")).where("op = 'putRow'")

    def _ended(self, number: int) -> DataFrame | None:
        added = self._added("log")
        ends = self._whole("log", "part bigint").where((F.col("part") < number) & ~F.col("part").isin(added)).select("stream_id", "sequence")
        if added:
            ends = ends.unionByName(self._read("log", "part").where(F.col("part") < number).select("stream_id", "sequence"))
        heads = ends.groupBy("stream_id").agg(F.max("sequence").alias("head")).where(F.col("head") < number * self.every)
        found = heads.collect()  # a row a stream that ended before
        out = None
        for part in sorted({(r.head - 1) // self.every for r in found}):
            some = [r.stream_id for r in found if (r.head - 1) // self.every == part]
            rows = self._part(part).unionByName(self._state(part)).where(F.col("stream_id").isin(some))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _part(self, number: int) -> DataFrame:
        """A part's entries."""
        rows = self._read("log", "part") if number in self._added("log") else self._whole("log", "part bigint")
        return rows.where(F.col("part") == number).drop("part")

    def _state(self, number: int) -> DataFrame:
        """The rows that the entries before part ``number`` leave, of the streams that have them all."""
        if number in self._added("states"):
            return self._read("states", "at").where(F.col("at") == number).drop("at")
        rows = self._whole("states", f"{FIRST} bigint, {END} bigint, {NODE} bigint")
        # Conditions one by one: a long list of values would be pushed down as their least and greatest only.
        of = [number] + [(number >> (h + 1) << (h + 1)) + (1 << h) for h in range(62) if number and number % (1 << (h + 1))]
        asked = reduce(Column.__or__, (F.col(NODE) == n for n in of))
        return rows.where(asked & (F.col(FIRST) <= number) & (F.col(END) >= number)).drop(FIRST, END, NODE)

    def _whole(self, name: str, more: str) -> DataFrame:
        """What ``write`` kept; nothing where it wasn't called."""
        folder, files = self._files(f"whole/{name}")
        schema = StructType([*self.schema.fields, *StructType.fromDDL(more).fields])
        reader = self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/whole/{name}") if files.exists(folder) else self.spark.createDataFrame([], schema)

    def _read(self, name: str, by: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(by, "long")).parquet(f"{self.path}/{name}")

    def _added(self, name: str) -> list[int]:
        """The numbers of the folders that ``extend`` made."""
        folder, files = self._files(name)
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def _files(self, name: str) -> tuple:
        """A folder and its file system."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put_whole(self, rows: DataFrame, name: str, *order: str) -> None:
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.write.mode("overwrite").parquet(f"{self.path}/whole/{name}")

    def _put(self, rows: DataFrame, name: str, by: str) -> None:
        dealt = rows.repartition(by, "stream_id").sortWithinPartitions(by, "stream_id", "sequence")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")

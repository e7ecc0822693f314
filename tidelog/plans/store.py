"""A durable log: sorted Parquet files, an edit table that says which are live, and compaction.

All data moves through Spark jobs; the driver handles catalogue rows only.  A
commit claims its edit number (a file that can be made only once), writes files
into a folder of that number, then appends one edit: readers see the edit or
nothing.  A writer whose number was taken by another one gets ``Busy`` before it
writes, and must open the store anew.  Files of an unfinished commit are invisible;
its claim keeps others out until the store is opened with ``recover``.

Files are folders of Parquet files, named by their number.  Where memtables are far
smaller than ``PACK_BYTES``, consecutive files of an edit share the folder named by
the first number that may be in it, and its rows say which file they are of
(``file_id``); it is deleted when none of its files is referred to.  So the number of
folders follows the bytes, not the memtables.

What was put is written once to a shared scratch folder and flushed when it fills
the memtables of a batch; what was put but not flushed is lost when the store is
closed, as there is no write-ahead log.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.entries import payload_bytes
from tidelog.model import EDIT, LOG, MIB, Config
from tidelog.operators import compaction, ordering, reads, tables, writes
from tidelog.sources import folders, manifest


#: Bytes of files that share a folder; a file of as many has its own.
PACK_BYTES = 32 * MIB
#: Runs of file numbers up to which they are a filter that reaches the scan.
RUNS = 100
_STORED = LOG + ", file_id long"


class Busy(RuntimeError):
    """Another writer has taken the next edit."""


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), recover: bool = False):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self._remember(spark.createDataFrame([], LOG), 0)
        try:
            edits = self.edits()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            self._append(0, 0, 0, [], [])
            edits = self.edits()
        last, self.next_id, self.seq = edits.agg(F.max("edit_id")).crossJoin(manifest.counters(edits)).first()  # a row each
        self.edit_id = last + 1
        if recover:
            for name in folders.names(spark, f"{self.path}/claims"):
                if name.isdigit() and int(name) > last:
                    folders.delete(spark, f"{self.path}/claims/{name}")

    # -- manifest ----------------------------------------------------------

    def edits(self) -> DataFrame:
        return self.spark.read.schema("edit_id long, " + EDIT).json(f"{self.path}/manifest")

    def _append(self, edit_id: int, next_id: int, seq: int, new: list, gone: list) -> None:
        row = [(edit_id, next_id, seq, new or None, gone or None)]
        self.spark.createDataFrame(row, "edit_id long, " + EDIT).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def catalogue(self, version: int | None = None) -> DataFrame:
        """The live files and the edits that added them, now or after edit ``version``."""
        return manifest.live(self.edits(), version)

    def manifest_json(self) -> list[str]:
        """The edits as JSON documents, in order: what ``manifest.literal_edits`` reads."""
        lists = lambda x: [f.asDict() for f in x or []]
        return [manifest.edit_json(e.next_table_id, e.sequence_number, lists(e.new_files), lists(e.delete_files))
                for e in self.edits().orderBy("edit_id").collect()]

    def _read(self, files: DataFrame) -> DataFrame:
        """The rows of some catalogue rows."""
        wanted = [(r.edit_id, r.sst_id) for r in files.select("edit_id", "sst_id").distinct().collect()]
        if not wanted:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(_STORED).parquet(*sorted(self._folders(wanted)))
        runs: list[list[int]] = []
        for i in sorted(i for _, i in wanted):
            if runs and i == runs[-1][1] + 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        file_id = F.col("file_id")
        if len(runs) <= RUNS:
            # a folder without numbers is one file
            rows = rows.where(reduce(Column.__or__, (file_id.between(a, b) for a, b in runs), file_id.isNull()))
        else:
            own = self.spark.createDataFrame([(i,) for _, i in wanted], "own long")
            rows = rows.join(own, F.coalesce(file_id, F.lit(wanted[0][1])) == F.col("own"), "left_semi")
        return rows.drop("file_id")

    def _folders(self, files: list[tuple]) -> dict[str, list[int]]:
        """The folders that hold some files (edit, number), each with those numbers."""
        by_edit, out = defaultdict(list), defaultdict(list)
        for edit, i in files:
            by_edit[edit].append(i)
        for edit, own in by_edit.items():
            folder = f"{self.path}/data/edit={edit}"
            starts = sorted(int(n.removeprefix("sst_id=")) for n in folders.names(self.spark, folder) if n.startswith("sst_id="))
            for i in own:
                at = bisect_right(starts, i)
                if at:  # else it was vacuumed
                    out[f"{folder}/sst_id={starts[at - 1]}"].append(i)
        return out

    def _write(self, rows: DataFrame, file_no: str, level: int) -> list[tuple]:
        """Sorted files of ``rows`` by ``file_no`` in the folder of this edit; their catalogue entries, read back from it.

        What an unfinished commit left there is overwritten.
        """
        folder = f"{self.path}/data/edit={self.edit_id}"
        own = rows.select("key", "value", "op", "seq", (F.col(file_no) + self.next_id).cast("long").alias("file_id"))
        together = max(1, PACK_BYTES // self.config.memtable_bytes)
        own = own.withColumn("sst_id", F.floor(F.col("file_id") / together) * together)
        own = own.repartition("sst_id").sortWithinPartitions("sst_id", "file_id", "key", F.desc("seq"))
        own.write.mode("overwrite").partitionBy("sst_id").parquet(folder)
        if not any(n.startswith("sst_id=") for n in folders.names(self.spark, folder)):
            return []
        written = self.spark.read.schema(_STORED).parquet(folder)
        files = sorted(tables.catalogue(written, "file_id").collect(), key=lambda f: f.sst_id)
        self.next_id = max(f.sst_id for f in files) + 1
        return [(int(f.sst_id), level, f.n_bytes, f.smallest_key, f.largest_key) for f in files]

    def _commit(self, rows: DataFrame, file_no: str, level: int, gone: list) -> None:
        claim = f"{self.path}/claims/{self.edit_id}"
        if not folders.claim(self.spark, claim):
            raise Busy(f"edit {self.edit_id} of {self.path} is taken by another writer; open the store anew, "
                       "or with recover if that writer is gone")
        try:
            new = self._write(rows, file_no, level)
            self._append(self.edit_id, self.next_id, self.seq, new, gone)
        except BaseException:
            folders.delete(self.spark, claim)
            raise
        self.edit_id += 1

    # -- writing -----------------------------------------------------------

    def put(self, batch: DataFrame) -> None:
        """``batch``: (ordinal, key, value), ordinals dense from 0; an empty value deletes."""
        self._take(writes.put, batch)

    def delete(self, batch: DataFrame) -> None:
        """``batch``: (ordinal, key)."""
        self._take(writes.delete, batch)

    def _remember(self, rows: DataFrame, n_bytes: int) -> None:
        self.memory, self.memory_bytes = rows, n_bytes

    def _take(self, how, batch: DataFrame) -> None:
        """The batch is run once, into a scratch folder; full memtables are flushed when they make a batch."""
        new = folders.written(how(self.spark.createDataFrame([], LOG), batch, self.seq))
        n, n_bytes = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(payload_bytes()), F.lit(0))).first()
        self.seq += n
        self._remember(reads.merged(self.memory, new), self.memory_bytes + n_bytes)
        if self.memory_bytes >= self.config.memtable_bytes * self.config.memtables_per_flush:
            self._flush(whole_batches=True)

    def flush(self) -> None:
        """Write all memtables as level-0 files, in order of age, and compact while that is due."""
        if not self.memory.isEmpty():
            self._flush(whole_batches=False)

    def _flush(self, whole_batches: bool) -> None:
        cut = folders.written(tables.memtables(self.memory, self.config.memtable_bytes))
        until = cut.agg(F.max("memtable_id")).first()[0] + 1
        if whole_batches:  # the last memtable is still written to
            until = (until - 1) // self.config.memtables_per_flush * self.config.memtables_per_flush
        if not until:
            return
        self._commit(cut.where(F.col("memtable_id") < until), "memtable_id", 0, [])
        rest = cut.where(F.col("memtable_id") >= until).drop("memtable_id")
        self._remember(rest, rest.agg(F.coalesce(F.sum(payload_bytes()), F.lit(0))).first()[0])
        while compaction.pick_level(compaction.scores(self.catalogue(), self.config.level0_trigger)).first().due:
            self.compact()

    def compact(self) -> None:
        """Merge the oldest level-0 file and all that overlap it, here and in level 1, into new level-1 files."""
        files = folders.written(self.catalogue())  # read in every round of the closure
        upper = compaction.overlap_closure(files)
        inputs = upper.unionByName(compaction.next_level(files, upper))
        gone = [(r.sst_id, r.level) for r in inputs.select("sst_id", "level").collect()]
        if not gone:
            return
        deeper = files.join(inputs.select("sst_id"), "sst_id", "left_anti")
        merged = compaction.split(folders.written(compaction.merge(self._read(inputs), deeper)), self.config.memtable_bytes)
        self._commit(merged, "file_no", 1, gone)

    def vacuum(self, retained_from: int | None = None) -> list[int]:
        """Delete files that no version from ``retained_from`` (the newest if not given) refers to, and what unfinished commits left.

        Returns the numbers of the former.  Those that share a folder with a file that is referred to stay in it
        until a vacuum finds none such.
        """
        gone = manifest.obsolete(self.edits(), self.edit_id - 1 if retained_from is None else retained_from)
        rows = {(r.edit_id, r.sst_id) for r in gone.select("sst_id", "edit_id").distinct().collect()}
        edits = sorted({e for e, _ in rows})
        beside = manifest.added(self.edits().where(F.col("edit_id").isin(edits))).select("edit_id", "sst_id").collect()
        for folder, own in self._folders([tuple(r) for r in beside]).items():
            edit = int(folder.rsplit("/", 2)[1].removeprefix("edit="))
            if all((edit, i) in rows for i in own):
                folders.delete(self.spark, folder)
        known = {f"edit={r.edit_id}" for r in self.edits().select("edit_id").distinct().collect()}
        claimed = {f"edit={n}" for n in folders.names(self.spark, f"{self.path}/claims")}
        for name in folders.names(self.spark, f"{self.path}/data"):
            if name.startswith("edit=") and name not in known | claimed:
                folders.delete(self.spark, f"{self.path}/data/{name}")
        return sorted(i for _, i in rows)

    # -- reading -----------------------------------------------------------

    def _where(self, covers: Column) -> DataFrame:
        """Every version in the files whose range ``covers`` what is asked for, flushed or not."""
        return reads.merged(self._read(self.catalogue().where(covers)), self.memory)

    def log(self) -> DataFrame:
        """Every version there is, flushed or not."""
        return self._where(F.lit(True))

    def get(self, key: str) -> DataFrame:
        """(key, status, value); only files whose range covers the key are opened."""
        return reads.get(self._where((F.col("smallest_key") <= key) & (F.col("largest_key") >= key)), key)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        files = self.catalogue()
        own = files.join(tables.candidates(probes, files).select("sst_id").distinct(), "sst_id", "left_semi")
        return reads.multi_get(reads.merged(self._read(own), self.memory), probes)

    def seek(self, key: str | None = None, last: bool = False) -> DataFrame:
        """The first entry in (key, newest first) at or after ``key``; the first or last of all without one."""
        return reads.seek(self._where(F.lit(True) if key is None else F.col("largest_key") >= key), key, last)

    def prefix(self, start: str, newest_only: bool = False) -> DataFrame:
        """Versions whose key starts with ``start``: all of them, or the live ones."""
        meets = (F.col("largest_key") >= start) & (F.substring("smallest_key", 1, len(start)) <= start)
        return reads.prefix(self._where(meets), start, newest_only)

    def scan(self, start: str | None = None, reverse: bool = False) -> DataFrame:
        """All entries from ``start`` on with their ``position``: keys ascending, newest first; or exactly the other way."""
        own = reads.key_range(self._where(F.lit(True) if start is None else F.col("largest_key") >= start), start)
        return ordering.positions(own, reverse=reverse).orderBy("position")

    def snapshot(self, version: int) -> DataFrame:
        """Every flushed version as of edit ``version``; its files stay until a vacuum that does not retain it."""
        return self._read(self.catalogue(version))

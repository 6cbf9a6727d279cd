"""Tables written exactly once per batch (S10, T2): stage, then publish by one atomic rename.

A batch writes its rows of one or more tables into folders of its own attempt, which no reader
sees. Publishing puts one small manifest file, named after the batch id, in place by a rename that
fails where the file exists. Readers list the manifests and read the folders that they name, so

* a killed write leaves folders that nothing refers to (``vacuum`` deletes them);
* a batch that runs again after it was published changes nothing;
* all tables of a batch appear together.

``read`` gives all batches of an append table, ``latest`` the newest batch of a snapshot table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CommitLog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.base}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def batches(self) -> list[int]:
        """Ids of the published batches, in order."""
        fs, folder = self._fs(), self._path("commits")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def has(self, batch_id: int) -> bool:
        return bool(self._fs().exists(self._path(f"commits/{batch_id:020d}.json")))

    def manifest(self, batch_id: int) -> dict[str, str]:
        """Table -> folder of a published batch."""
        stream = self._fs().open(self._path(f"commits/{batch_id:020d}.json"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return json.loads(raw.decode())

    def stage(self, df: DataFrame, table: str) -> str:
        """Write rows where no reader looks; the folder goes into ``publish``."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.base}/{folder}")
        return folder

    def publish(self, batch_id: int, tables: dict[str, str]) -> bool:
        """Make the staged folders visible; False where the batch had been published before."""
        fs = self._fs()
        draft, final = self._path(f"commits/.{uuid.uuid4().hex}"), self._path(f"commits/{batch_id:020d}.json")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(tables).encode()))
        finally:
            stream.close()
        no_options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, no_options)
        except Exception:
            fs.delete(draft, False)
            if not fs.exists(final):
                raise
            return False
        return True

    def append(self, batch_id: int, df: DataFrame, table: str = "events") -> bool:
        """One batch of one append table; False where it had been published before."""
        return False if self.has(batch_id) else self.publish(batch_id, {table: self.stage(df, table)})

    def _load(self, folders: list[str], schema: StructType | str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{f}" for f in folders])

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """All published rows of an append table."""
        manifests = [self.manifest(b) for b in self.batches()]
        return self._load([m[table] for m in manifests if table in m], schema)

    def latest(self, table: str, schema: StructType | str) -> DataFrame:
        """The newest published batch of a snapshot table (empty before the first one)."""
        for batch in reversed(self.batches()):
            manifest = self.manifest(batch)
            if table in manifest:
                return self._load([manifest[table]], schema)
        return self._load([], schema)

    def vacuum(self) -> int:
        """Delete staged folders that no manifest names (run it when no batch is being written)."""
        fs, kept, gone = self._fs(), {f for b in self.batches() for f in self.manifest(b).values()}, 0
        root = self._path("data")
        for table in (fs.listStatus(root) if fs.exists(root) else []):
            for folder in fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{folder.getPath().getName()}" not in kept:
                    fs.delete(folder.getPath(), True)
                    gone += 1
        return gone

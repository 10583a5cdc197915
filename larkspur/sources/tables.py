"""Tables of a store below a root folder: each is a list of Parquet folders, and a commit names all tables' lists."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "wings": "id long, name string, type string, keywords string",
    "drawers": "drawer_id long, content string, content_hash string, wing string, room string, hall string, source_file string, source_type string",
    "embeddings": "drawer_id long, vector array<float>, seq long",
    "postings": "term string, drawer_id long, tf double",
    "entities": "entity_id string, name string, type string, properties string",
    "triples": "triple_id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double",
}


#: A table that is appended to is rewritten as one part beyond so many.
MOST_PARTS = 20


class Tables:
    """Reads and writes by name. Data goes to new folders, which nobody reads yet; a commit file, put in place by one
    rename, makes the parts of any number of tables count at once. So readers of the old state aren't disturbed, an
    append writes what is new only, and a write that fails half way leaves nothing that counts. Of two writers that
    start from one state the second fails. A column that older parts lack is null there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the last commit, and each table's parts."""
        folder = self.path(f"{self.root}/_commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        last = max((int(x[:-5]) for x in names if x.endswith(".json")), default=0)
        if not last:
            return 0, {}
        # One row whose value is the whole file; read by Spark, so that any file system will do.
        row = self.spark.read.text(f"{self.root}/_commits/{last:012d}.json", wholetext=True).first()
        return last, json.loads(row[0])

    def read(self, name: str) -> DataFrame:
        return self.parts(name, self.state()[1].get(name, []))

    def parts(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame, sort: str | None = None) -> str:
        """Writes a part that doesn't count yet; returns its folder."""
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        out = df.select(*columns)
        if sort:
            out = out.repartitionByRange(sort).sortWithinPartitions(sort)
        folder = f"{name}/{uuid.uuid4().hex}"
        out.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, since: int, changes: dict[str, list[str]]) -> None:
        """Makes lists of parts count, if no other commit has come since that number."""
        last, state = self.state()
        target = self.path(f"{self.root}/_commits/{since + 1:012d}.json")
        draft = self.path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(state | changes).encode()))
        out.close()
        if last != since or self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise RuntimeError("another writer was faster; try again")

    def replace(self, name: str, df: DataFrame, sort: str | None = None) -> None:
        since, _ = self.state()
        self.commit(since, {name: [self.write(name, df, sort)]})

    def append(self, name: str, df: DataFrame, sort: str | None = None) -> None:
        since, _ = self.state()
        self.commit(since, {name: self.longer(name, self.write(name, df, sort), sort)})

    def longer(self, name: str, part: str, sort: str | None = None) -> list[str]:
        """A table's parts with one more, rewritten as one if they are many."""
        parts = [*self.state()[1].get(name, []), part]
        return parts if len(parts) <= MOST_PARTS else [self.write(name, self.parts(name, parts), sort)]

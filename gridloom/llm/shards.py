"""Size-tiered sharding with a versioned manifest (operator 2).

Arrivals are appended as small immutable shards (Parquet files written once, never changed). Shards are
grouped by size tier (powers of ``growth``); a tier that has gathered ``fanout`` shards is merged, in
runs of about ``target_bytes``, into larger shards, up to files of the target size, which are final.
Each append and each merge commits a manifest: a JSON file with the next number, created whole and only
if that number is free, so a reader sees a version or the one before and a writer that lost the race
plans again. Only the shards' names and sizes pass through the driver. Data files of a failed attempt
are in no manifest and are never read; ``expire`` removes what no kept version names.

A merge reads a group's files as they are and writes them from one task into one file, so documents are
not shuffled and a new shard holds the rows of exactly one planned group; groups are merged side by side.

``expire`` removes only folders that have been there for ``GRACE`` seconds, so that a write in flight keeps
its files, and a commit looks up its files before it publishes them.

Defined cases: nulls, empty and long texts are stored as they are; repeated rows are all stored; an
append of no rows commits a version without new shards; extra columns are stored with the others, and a
column that a later append brings is null in the rows before it (a column of another type is an error).
"""

from __future__ import annotations

import json
import math
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shared import age, delete, exists, list_files, list_names, publish_text, read_json, scratch_path

TARGET_BYTES, FANOUT, GROWTH = 128 << 20, 4, 4
#: Seconds for which a folder that no version names may belong to a write in flight; groups merged at a time.
GRACE, MERGES = 86_400, 8


class ShardSet:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, growth: int = GROWTH):
        self.spark, self.root, self.target, self.fanout, self.growth = spark, root.rstrip("/"), target_bytes, fanout, growth

    # versions

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in list_names(self.spark, f"{self.root}/manifest") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "shards": [], "schema": None}
        return read_json(self.spark, f"{self.root}/manifest/{version or known[-1]:012d}.json")

    def _commit(self, base: dict, shards: list, schema, note: str) -> bool:
        known = {s[0] for s in base["shards"]}
        if gone := [s[0] for s in shards if s[0] not in known and not exists(self.spark, s[0])]:
            raise FileNotFoundError(f"{len(gone)} new shards are no longer there: {gone[0]}")
        new = {"version": base["version"] + 1, "parent": base["version"], "shards": shards, "schema": schema, "note": note}
        return publish_text(self.spark, f"{self.root}/manifest/{new['version']:012d}.json", json.dumps(new))

    # writing

    def _written(self, rows: DataFrame) -> list[list]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return [[path, size] for path, size in list_files(self.spark, folder, ".parquet")]

    def append(self, rows: DataFrame) -> int:
        """Store rows as new shards, one for each of their partitions; the number of the version."""
        new = self._written(rows)
        while True:
            base = self.manifest()
            schema = _united(base["schema"], rows.schema)
            if self._commit(base, base["shards"] + new, schema, "append"):
                return base["version"] + 1

    def tier(self, size: int) -> int:
        """0 for the smallest shards; shards of half the target or more are final (-1)."""
        if size >= self.target // 2:
            return -1
        return max(0, int(math.log(max(1, size) / 4096, self.growth)))

    def plan(self, shards: list) -> list[list]:
        """Groups of similarly sized shards to merge, each of about the target size at most."""
        tiers: dict[int, list] = {}
        for s in shards:
            if (t := self.tier(s[1])) >= 0:
                tiers.setdefault(t, []).append(s)
        groups = []
        for t in sorted(tiers):
            if len(tiers[t]) < self.fanout:
                continue
            group, held = [], 0
            for s in sorted(tiers[t], key=lambda s: (s[1], s[0])):
                if group and held + s[1] > self.target:
                    groups.append(group)
                    group, held = [], 0
                group, held = [*group, s], held + s[1]
            if group:
                groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier has ``fanout`` shards; the number of the last version."""
        while True:  # every round makes fewer shards
            base = self.manifest()
            groups = self.plan(base["shards"])
            if not groups:
                break
            with ThreadPoolExecutor(MERGES) as pool:
                new = [s for made in pool.map(lambda g: self._merged(g, base["schema"]), groups) for s in made]
            gone = {s[0] for g in groups for s in g}
            while not self._commit(base, [s for s in base["shards"] if s[0] not in gone] + new, base["schema"], "compact"):
                base = self.manifest()
                if not gone <= {s[0] for s in base["shards"]}:
                    break  # somebody else has merged them; what was written here is in no manifest
        return self.manifest()["version"]

    def _merged(self, group: list, schema) -> list[list]:
        """One job of one task: it reads the group's files and writes one."""
        rows = self.spark.read.schema(_schema(schema)).parquet(*[s[0] for s in group])
        return self._written(rows.coalesce(1))

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["shards"]:
            return self.spark.createDataFrame([], _schema(m["schema"]) if m["schema"] else "doc_id long")
        return self.spark.read.schema(_schema(m["schema"])).parquet(*[s[0] for s in m["shards"]])

    def expire(self, keep: int = 1, grace: float = GRACE) -> None:
        """Forget all but the last ``keep`` versions and remove the files that none of them names, unless
        they are younger than ``grace`` seconds (0 only where nobody else writes)."""
        known = self.versions()
        kept = {s[0] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        for v in known[:-keep]:
            delete(self.spark, f"{self.root}/manifest/{v:012d}.json")
        for folder in list_names(self.spark, f"{self.root}/data"):
            if not any(f"/data/{folder}/" in path for path in kept) and age(self.spark, f"{self.root}/data/{folder}") >= grace:
                delete(self.spark, f"{self.root}/data/{folder}")


def _schema(value):
    from pyspark.sql.types import StructType

    return StructType.fromJson(value)


def _united(known, arriving):
    """The schema of the shards so far with the new fields of an append."""
    if not known:
        return arriving.jsonValue()
    fields = {f.name: f for f in _schema(known).fields}
    for f in arriving.fields:
        if f.name in fields and f.dataType != fields[f.name].dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, f)
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()]).jsonValue()


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Append all documents in two arrivals, compact, and read the last version back: what each row holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = ShardSet(spark, scratch_path(spark, "shards"))
    early = F.xxhash64("doc_id", "text") < 0
    for arrival in (early, ~early):  # never null: the hash of nulls is one
        shards.append(docs.where(arrival))
    shards.compact()
    shards.expire(grace=0)
    text = F.coalesce(F.col("text"), F.lit(""))
    return shards.read().select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"))


ORACLE_SQL = {
    "op2_sharding": "SELECT doc_id, lang, source, n_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM documents"
}

"""Maintenance packets: several tables of one packet become visible at once.

A packet's tables are written below a folder of the attempt, which nobody reads; one small manifest,
put in place by a rename that fails if its name is taken, then makes all of them visible. A packet that
is committed again changes nothing, and one whose second table fails leaves no trace but files. When
more than ``MOST_OPEN`` manifests stand after the last snapshot, a snapshot folds them: it holds one
table for each name and the ids of the packets inside, so that a read touches a bounded number of
folders. One writer at a time commits or folds; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.relational import union_all

MOST_OPEN = 8


class PacketStore:
    """Tables of packets below ``root``; ``schemas`` names each table's columns."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], most_open: int = MOST_OPEN) -> None:
        self.spark, self.root, self.schemas, self.most_open = spark, root.rstrip("/"), schemas, most_open
        self._jvm = spark._jvm

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _put(self, path: str, content: dict) -> bool:
        """Write a manifest under its final name; false if that name is taken."""
        fs, final = self._fs(path)
        if fs.exists(final):
            return False
        _, draft = self._fs(f"{path}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        return bool(fs.rename(draft, final))

    def _manifests(self, kind: str) -> list[tuple[int, dict]]:
        """Numbered manifests of a kind, in order."""
        fs, folder = self._fs(f"{self.root}/{kind}")
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json"):
                text = self.spark.read.text(status.getPath().toString(), wholetext=True).first()
                found.append((int(name.removesuffix(".json")), json.loads(text["value"])))
        return sorted(found, key=lambda x: x[0])

    def _state(self) -> tuple[dict | None, list[tuple[int, dict]]]:
        """The newest snapshot and the packets committed after it."""
        snapshots = self._manifests("snapshots")
        base = snapshots[-1][1] if snapshots else None
        return base, [(n, m) for n, m in self._manifests("packets") if base is None or n > base["upto"]]

    def committed(self, packet_id: str) -> bool:
        base, later = self._state()
        if any(m["packet_id"] == packet_id for _, m in later):
            return True
        return base is not None and not self.spark.read.parquet(f"{base['path']}/_ids").filter(F.col("packet_id") == packet_id).isEmpty()

    def folders(self, table: str) -> list[str]:
        """Folders that a read of ``table`` touches: the snapshot's and one for each later packet."""
        base, later = self._state()
        return ([f"{base['path']}/{table}"] if base else []) + [f"{m['path']}/{table}" for _, m in later]

    def read(self, table: str) -> DataFrame:
        """Rows of all visible packets, with ``packet_id``."""
        schema = f"packet_id string, {self.schemas[table]}"
        paths = self.folders(table)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, packet_id: str, tables: dict[str, DataFrame]) -> bool:
        """Make the packet visible with all its tables; false if it already is.

        Any failure to write a table leaves the packet invisible and can be tried again.
        """
        if set(tables) != set(self.schemas):
            raise ValueError(f"a packet has the tables {sorted(self.schemas)}")
        if self.committed(packet_id):
            return False
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            columns = [f.name for f in self.spark.createDataFrame([], self.schemas[name]).schema.fields]
            rows.select(F.lit(packet_id).alias("packet_id"), *columns).write.parquet(f"{path}/{name}")
        base, later = self._state()
        number = (later[-1][0] if later else base["upto"] if base else -1) + 1
        if not self._put(f"{self.root}/packets/{number:012d}.json", {"packet_id": packet_id, "path": path}):
            raise RuntimeError("another writer committed at the same time")
        if len(later) + 1 > self.most_open:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold the snapshot and the packets after it into a new snapshot."""
        base, later = self._state()
        if not later:
            return
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        for name in self.schemas:
            self.read(name).write.parquet(f"{path}/{name}")
        ids = self.spark.createDataFrame([(m["packet_id"],) for _, m in later], "packet_id string")
        if base:
            ids = union_all([self.spark.read.parquet(f"{base['path']}/_ids"), ids])
        ids.coalesce(1).write.parquet(f"{path}/_ids")
        upto = later[-1][0]
        self._put(f"{self.root}/snapshots/{upto:012d}.json", {"upto": upto, "path": path})


STALE_TABLES = {
    "transitions": "source_id string, old_hash string, new_hash string, affected_pages bigint, reason string",
    "stale_pages": "page_id string, changed_sources bigint, first_source_id string, last_source_id string",
    "source_map": "page_id string, source_id string, hash string",
}


def stale_packet(previous: DataFrame, current: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables of a stale-dependency packet: transitions, stale pages, and the sources of each page.

    ``previous`` and ``current`` are ``(source_id, content_hash)``, ``edges (source_id, page_id)``.
    """
    from corvane.operators import lineage

    changed = lineage.transitions(previous, current)
    links = lineage.stale_links(changed, edges)
    hashes = current.select("source_id", F.col("content_hash").alias("hash"))
    return {
        "transitions": lineage.transition_counts(changed, links), "stale_pages": lineage.stale_pages(links),
        "source_map": links.join(hashes.hint(lineage.SHUFFLED), "source_id").select("page_id", "source_id", "hash"),
    }

"""Versioned catalog store: each build is a generation of its own, and one pointer says which is read.

Layout under the base folder: cases/<generation>/<version>/bucket=…, documents/<generation>/<version>/bucket=…,
staged/<generation>/batch_id=…, index/<generation>/… (see term_index), states/<generation>.json, ACTIVE, BUILDING. Cases lie in hash buckets
of their collections, document records in those of their ids; a small file says which version of each bucket counts, so a
change rewrites the buckets that it touches and shows when they are whole. States and the
pointer are small files, written aside and renamed, so a reader sees the old or the new one. BUILDING names the one build
there may be; it is made by a call that fails where it exists, so of two builders that begin at once one does not.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieve
from .term_index import TermIndex

STATUSES = ("building", "ready", "failed", "discarded", "superseded")


@dataclass(frozen=True)
class Generation:
    generation_id: str
    parser_version: int
    status: str = "building"
    started_at: str = ""
    finished_at: str | None = None
    activated_at: str | None = None
    heartbeat_at: str | None = None
    documents_seen: int = 0
    documents_indexed: int = 0
    documents_failed: int = 0
    cases_indexed: int = 0
    covered_subjects: int = 0
    total_subjects: int = 0
    last_error: str | None = None


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


class CatalogStore:
    #: A build that has not shown life for so long no longer blocks others.
    LEASE = timedelta(hours=6)
    #: Hash buckets of a generation's document records, if not set otherwise; fixed by its first records.
    BUCKETS = 64

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _write(self, name: str, text: str) -> None:
        aside, fs = self._path(f"{name}.{uuid.uuid4().hex}"), self._fs()
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(aside), fs.makeQualified(self._path(name)), options)

    def _read(self, name: str) -> str | None:
        """A small file's text; null if there is none. Where a file system replaces files in two steps, it is looked for again."""
        for attempt in range(4):
            try:
                stream = self._fs().open(self._path(name))
            except Py4JJavaError as e:
                if "FileNotFound" not in e.java_exception.getClass().getName():
                    raise
                if attempt < 3:
                    time.sleep(0.02 * attempt)
                continue
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        return None

    def _remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def states(self) -> list[Generation]:
        """All generations, the latest first."""
        if not self._fs().exists(self._path("states")):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("states"))]
        found = (self._read(f"states/{n}") for n in names if n.endswith(".json"))
        rows = [Generation(**json.loads(x)) for x in found if x]
        return sorted(rows, key=lambda g: (g.started_at, g.generation_id), reverse=True)

    def _put(self, g: Generation) -> Generation:
        self._write(f"states/{g.generation_id}.json", json.dumps(asdict(g)))
        return g

    def _claim(self, owner: str) -> bool:
        """Make BUILDING with an owner; False if it is there."""
        fs, path = self._fs(), self._path("BUILDING")
        fs.mkdirs(self._path(""))
        try:
            if fs.getScheme() == "file":
                self._jvm.java.nio.file.Files.createFile(self._jvm.java.io.File(path.toUri().getPath()).toPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.attribute.FileAttribute, 0))
            out = fs.create(path, fs.getScheme() == "file")
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(owner.encode()))
        out.close()
        return True

    def _release(self, owner: str | None) -> bool:
        """Take BUILDING from an owner; False if it is not its any more. The rename has one winner."""
        if self._read("BUILDING") != owner:
            return False
        aside = f"BUILDING.{uuid.uuid4().hex}"
        if not self._fs().rename(self._path("BUILDING"), self._path(aside)):
            return False
        self._remove(aside)
        return True

    def begin(self, parser_version: int) -> Generation:
        """A new generation; ValueError while another one is being built and its lease runs."""
        g = Generation(uuid.uuid4().hex, parser_version, started_at=_now(), heartbeat_at=_now())
        now = datetime.now(timezone.utc)
        live = lambda x: x.status == "building" and datetime.fromisoformat(x.heartbeat_at or x.started_at) > now - self.LEASE
        for _ in range(3):
            states = self.states()
            if busy := next((x for x in states if live(x)), None):
                raise ValueError(f"{busy.generation_id} is being built")
            if self._claim(g.generation_id):
                for x in states:
                    if x.status == "building":
                        self._put(replace(x, status="failed", finished_at=_now(), last_error="lease ran out"))
                return self._put(g)
            owner = self._read("BUILDING")
            known = next((x for x in self.states() if x.generation_id == owner), None)
            if known is None or live(known):  # it has just begun
                age = self._fs().getFileStatus(self._path("BUILDING")).getModificationTime() if self._fs().exists(self._path("BUILDING")) else 0
                if known is not None or datetime.fromtimestamp(age / 1000, timezone.utc) > now - self.LEASE:
                    raise ValueError(f"{owner or 'another generation'} is being built")
            self._release(owner)
        raise ValueError("another generation is being built")

    def heartbeat(self, g: Generation) -> Generation:
        """Show life; a generation that has ended stays as it is."""
        state = next((x for x in self.states() if x.generation_id == g.generation_id), g)
        return self._put(replace(state, heartbeat_at=_now())) if state.status == "building" else state

    @contextmanager
    def alive(self, g: Generation, every: timedelta = LEASE / 36) -> Iterator[None]:
        """Heartbeats while the block runs, so that a long build keeps its lease."""
        done = threading.Event()

        def beat() -> None:
            while not done.wait(every.total_seconds()):
                self.heartbeat(g)

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()

    def _buckets(self, name: str) -> dict | None:
        """{buckets: their number, versions: {bucket: its version}} of a generation's table; null if it has none."""
        found = self._read(f"{name}/BUCKETS.json")
        return json.loads(found) if found else None

    def _rows(self, name: str, versions: dict[str, str] | None) -> DataFrame | None:
        if not versions:
            return None
        paths = [f"{self.base}/{name}/{v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.option("mergeSchema", len(set(versions.values())) > 1).parquet(*paths)

    def _replace(self, name: str, rows: DataFrame, key: str, gone: DataFrame | None = None) -> int:
        """Rows of a table in hash buckets of a key; what the keys of ``gone`` (else of the rows) had before is replaced, the rest
        stays. Returns the number of buckets rewritten.

        Until the new buckets are whole, readers see the old ones; a write that fails leaves them as they were. A generation
        has one builder, so one call at a time."""
        known = self._buckets(name) or {"buckets": self.BUCKETS, "versions": {}}
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(known["buckets"])).cast("string")
        old: dict[str, str] = {}
        if known["versions"]:
            keys = (rows if gone is None else gone).select(key).distinct()
            touched = {r[0] for r in keys.select(bucket).distinct().collect()}  # at most the number of buckets
            old = {b: v for b, v in known["versions"].items() if b in touched}
            if old:
                rows = self._rows(name, old).join(keys, key, "left_anti").unionByName(rows, allowMissingColumns=True)
        version = uuid.uuid4().hex
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.base}/{name}/{version}")
        written = [s.getPath().getName().partition("=")[2] for s in self._fs().listStatus(self._path(f"{name}/{version}")) if s.getPath().getName().startswith("bucket=")]
        left = {b: v for b, v in known["versions"].items() if b not in old}
        self._write(f"{name}/BUCKETS.json", json.dumps(known | {"versions": left | dict.fromkeys(written, version)}))
        for b, v in old.items():
            self._remove(f"{name}/{v}/bucket={b}")
        return len(written)

    def write_documents(self, g: Generation, documents: DataFrame) -> int:
        """Records (document_id, …, case_count) of a generation's documents: new ones replace those of their id, others stay; a
        count is not below zero, and of an id that is given twice one record counts. Returns the number of buckets rewritten."""
        new = documents.withColumn("case_count", F.greatest(F.lit(0), F.coalesce("case_count", F.lit(0)))).dropDuplicates(["document_id"])
        return self._replace(f"documents/{g.generation_id}", new, "document_id")

    def documents(self, generation_id: str) -> DataFrame | None:
        """Records of a generation's documents; null if it has none."""
        known = self._buckets(f"documents/{generation_id}")
        return self._rows(f"documents/{generation_id}", known and known["versions"])

    def indexed(self, g: Generation, wanted: DataFrame) -> DataFrame:
        """Those of the documents (document_id) that the generation has a record of."""
        own = self.documents(g.generation_id)
        return wanted.limit(0) if own is None else wanted.join(own, "document_id", "left_semi")

    def texts(self, generation_id: str) -> DataFrame | None:
        """(catalog_key, text) of a generation's cases."""
        own = self.cases(generation_id)
        return None if own is None else own.select("catalog_key", "text")

    def replace_collection(self, g: Generation, collection_id: str, cases: DataFrame) -> int:
        """All cases of a collection at once, also none; rows of another collection: ValueError."""
        if not cases.where(F.col("collection_id") != collection_id).isEmpty():
            raise ValueError(f"cases of another collection than {collection_id}")
        name = f"cases/{g.generation_id}"
        gone = self.spark.createDataFrame([(collection_id,)], "collection_id string")
        self._replace(name, cases.drop("generation_id"), "collection_id", gone)
        own = self.cases(g.generation_id)
        return 0 if own is None else own.where(F.col("collection_id") == collection_id).count()

    def write_cases(self, g: Generation, cases: DataFrame) -> None:
        """Cases of many collections in one job; collections that have rows are replaced, others stay."""
        self._replace(f"cases/{g.generation_id}", cases.drop("generation_id"), "collection_id")

    def stage(self, g: Generation, cases: DataFrame, batch_id: int) -> bool:
        """Cases (collection_id, catalog_key, …) of one batch of an incremental build, for seal(). A batch that is recorded is not
        taken again: False. One that was cut off left no record, and its replay overwrites what it wrote."""
        base = f"staged/{g.generation_id}"
        if self._fs().exists(self._path(f"{base}/done/{batch_id}")):
            return False
        cases.write.mode("overwrite").parquet(f"{self.base}/{base}/batch_id={batch_id}")
        self._record(g, batch_id)
        return True

    def _record(self, g: Generation, batch_id: int) -> None:
        self._write(f"staged/{g.generation_id}/done/{batch_id}", _now())

    def staged(self, g: Generation) -> DataFrame | None:
        """The cases of the recorded batches, with batch_id; null without any."""
        base = f"staged/{g.generation_id}"
        if not self._fs().exists(self._path(f"{base}/done")):
            return None
        done = [s.getPath().getName() for s in self._fs().listStatus(self._path(f"{base}/done"))]
        paths = [f"{self.base}/{base}/batch_id={n}" for n in done if n.isdigit()]
        return self.spark.read.option("basePath", f"{self.base}/{base}").option("mergeSchema", True).parquet(*paths) if paths else None

    def build_from(self, g: Generation, cases: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start staging a stream of cases, batch by batch, until what is there has been read."""
        return cases.writeStream.foreachBatch(lambda df, batch_id: self.stage(g, df, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def seal(self, g: Generation, gate: Callable[[DataFrame], str | None] = lambda cases: None) -> Generation:
        """End an incremental build: of a key that several batches hold the case of the last one counts, in any collection. gate
        gives the reason against the cases, or null; then the generation is promoted, else it has failed and what was read is
        read on. ValueError without cases."""
        rows = self.staged(g)
        if rows is None:
            raise ValueError("a generation without cases can't be promoted")
        latest = rows.groupBy("catalog_key").agg(F.max("batch_id").alias("batch_id"))
        one = rows.join(latest, ["catalog_key", "batch_id"], "left_semi").drop("batch_id").dropDuplicates(["catalog_key"])
        self.write_cases(g, one)
        own = self.cases(g.generation_id)
        if own is None:
            raise ValueError("a generation without cases can't be promoted")
        if why := gate(own):
            return self.finish(g, "failed", why)
        out = self.promote(self.finish(g, "building", cases_indexed=own.count()))
        self._remove(f"staged/{g.generation_id}")
        return out

    def cases(self, generation_id: str) -> DataFrame | None:
        """A generation's cases; null if it has none."""
        known = self._buckets(f"cases/{generation_id}")
        own = self._rows(f"cases/{generation_id}", known and known["versions"])
        return None if own is None else own.withColumn("generation_id", F.lit(generation_id))

    def index_terms(self, g: Generation) -> None:
        """Write the posting table of a generation's cases (with normalized_text), for search()."""
        if (own := self.cases(g.generation_id)) is None:
            raise ValueError("a generation without cases can't be indexed")
        TermIndex(self.spark, f"{self.base}/index/{g.generation_id}").write(own)

    def search(self, terms: list[str], preferred: tuple[str, ...] = (), limit: int = 20, recall_cap: int | None = None) -> DataFrame | None:
        """retrieve.search over the generation that is read, by its posting table if it has one; null if none is read."""
        if (g := self.active()) is None:
            return None
        path = f"index/{g.generation_id}"
        if self._fs().exists(self._path(f"{path}/grams/_SUCCESS")):
            return TermIndex(self.spark, f"{self.base}/{path}").search(terms, preferred, limit, recall_cap)
        return retrieve.search(self.cases(g.generation_id), terms, preferred, limit, recall_cap)

    def finish(self, g: Generation, status: str, error: str | None = None, **counters: int) -> Generation:
        """Record how a build ended, or its counters so far."""
        if status not in ("building", "failed", "discarded"):
            raise ValueError(f"a build can't become {status} here")
        ended = None if status == "building" else _now()
        own = {k: max(0, int(v)) for k, v in counters.items()}
        out = self._put(replace(g, status=status, finished_at=ended, last_error=error[:1000] if error else None, **own))
        if ended:
            self._release(g.generation_id)
        return out

    def promote(self, g: Generation) -> Generation:
        """Make a build the one that is read; ValueError if it is no build or has no cases. The pointer moves last."""
        state = next((x for x in self.states() if x.generation_id == g.generation_id), None)
        own = self.cases(g.generation_id)
        if state is None or state.status != "building":
            raise ValueError("only a generation that is being built can be promoted")
        if own is None or own.isEmpty():
            raise ValueError("a generation without cases can't be promoted")
        ready = self._put(replace(g, status="ready", finished_at=_now(), activated_at=_now()))
        self._write("ACTIVE", g.generation_id)
        for other in self.states():
            if other.status == "ready" and other.generation_id != g.generation_id:
                self._put(replace(other, status="superseded"))
        self._release(g.generation_id)
        return ready

    def active(self, parser_version: int | None = None) -> Generation | None:
        """The generation that is read; null if there is none, it is not ready, or another parser made it."""
        own = self._read("ACTIVE")
        g = next((x for x in self.states() if x.generation_id == own), None) if own else None
        return g if g and g.status == "ready" and parser_version in (None, g.parser_version) else None

    def backup(self, folder: str, keep: int = 5, at: datetime | None = None) -> str:
        """A copy of what is read, under a name with the time; all but the newest ``keep`` (one at least) go. ValueError if nothing
        is read. The generation does not change, so its copy is of one moment; it appears when it is whole."""
        g = self.active()
        if g is None:
            raise ValueError("no generation is read")
        name = f"catalog-{(at or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}"
        fs, jvm_path = self._fs(), self._jvm.org.apache.hadoop.fs.Path
        base, aside = folder.rstrip("/"), f"{folder.rstrip('/')}/.{name}"
        self.cases(g.generation_id).write.mode("overwrite").parquet(f"{aside}/cases")
        if (records := self.documents(g.generation_id)) is not None:
            records.write.mode("overwrite").parquet(f"{aside}/documents")
        fs.rename(jvm_path(aside), jvm_path(f"{base}/{name}"))
        names = sorted((s.getPath().getName() for s in fs.listStatus(jvm_path(base)) if s.getPath().getName().startswith("catalog-")), reverse=True)
        for old in names[max(1, keep) :]:
            fs.delete(jvm_path(f"{base}/{old}"), True)
        return f"{base}/{name}"

    def cleanup(self, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` of each inactive status; never the active one or a build."""
        active, gone, kept = self._read("ACTIVE"), [], {}
        for g in sorted(self.states(), key=lambda g: g.finished_at or g.started_at, reverse=True):
            if g.generation_id == active or g.status in ("building", "ready"):
                continue
            kept[g.status] = kept.get(g.status, 0) + 1
            if kept[g.status] > keep:
                for name in (f"cases/{g.generation_id}", f"documents/{g.generation_id}", f"staged/{g.generation_id}", f"index/{g.generation_id}", f"states/{g.generation_id}.json"):
                    self._remove(name)
                gone.append(g.generation_id)
        return gone

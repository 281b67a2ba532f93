"""Versioned index store on any Hadoop-compatible file system.

Layout under ``root`` (a shared folder on a cluster):

    versions/vNNNNNN.json   segments, n_docs, bucket counts; the highest
                            number is the published version
    segments/sNNNNNN-*/     one segment per indexing run
        documents/          partitioned by db (hash bucket of id)
        postings/           partitioned by field, tb; files sorted by term, a row
                            holding postings of one term
        term_stats/         (field, tb, term, df); df deltas of this run,
                            negative for postings the run tombstoned
        tombstones/         ids removed from *earlier* segments
    manifest/vNNNNNN-*/     (path, last_indexed): a base written by the first
                            run and by rebasing
    manifest/dNNNNNN-*/     per-run deltas (path, last_indexed, op put/del)
    ledger/                 append-only run ledger

An update writes only the changed documents: a new segment holds their
documents and postings; ids that changed or disappeared become tombstones of
the earlier segments, and their postings' document frequencies are recorded
as negative deltas.  Reading a version unions the segments, anti-joins each
with the tombstones of later segments, and sums term-statistics deltas.
``compact`` rewrites the live rows as one segment.

Publishing is atomic: every table of a version is written first, then its
version file is written beside and renamed to its final name.  Readers take
the highest complete version, so there is no moment without one.  A version
file that exists already means another writer published it meanwhile; the run
then fails and its tables are never read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from quarry import schema as S
from quarry.config import (
    PROGRESS_COMPLETE,
    PROGRESS_FAILED,
    PROGRESS_STEP_CLEANED,
    PROGRESS_STEP_LISTED,
    IndexConfig,
)
from quarry.functions.paths import is_index_text
from quarry.operators import listing as L
from quarry.operators.analysis import build_blocks, build_term_stats, posting_rows
from quarry.operators.extract import assemble_documents
from quarry.operators.match import IndexTables, among_candidates, candidate_filter

# Stored documents carry the hash bucket of their id.
DOCUMENTS_B = T.StructType(S.DOCUMENTS.fields + [T.StructField("db", T.IntegerType(), True)])
DOC_COLUMNS = [f.name for f in S.DOCUMENTS.fields]
MANIFEST_DELTA = "path string, last_indexed timestamp, op string"

# Tombstone sets up to this many ids (about 20 MB of paths) are broadcast in the
# read-side anti join.
TOMBSTONE_BROADCAST_ROWS = 100_000


# Files sorted by term have short pages, so that a look-up of a few terms reads
# the pages that hold them and skips the others by the file's column index.
TERM_LAYOUT = {"parquet.page.row.count.limit": "1000", "parquet.block.size": str(32 << 20), "compression": "zstd"}


@dataclass
class Version:
    number: int
    segments: list[str] = field(default_factory=list)
    n_docs: int = 0
    term_buckets: int = 16
    doc_buckets: int = 8
    manifest: str | None = None
    manifest_deltas: list = field(default_factory=list)  # delta dirs, oldest first
    manifest_delta_rows: int = 0
    tombstones: dict = field(default_factory=dict)  # segment -> tombstone count


class ConcurrentUpdate(RuntimeError):
    """Another writer published a version since this run began."""


class _FS:
    """Minimal file operations through the Hadoop FileSystem of the session."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._root = self._Path(root)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def path(self, rel: str):
        return self._Path(self._root, rel)

    def exists(self, rel: str) -> bool:
        return bool(self._fs.exists(self.path(rel)))

    def read_text(self, rel: str) -> str:
        stream = self._fs.open(self.path(rel))
        try:
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            lines = []
            line = reader.readLine()
            while line is not None:
                lines.append(line)
                line = reader.readLine()
            return "\n".join(lines)
        finally:
            stream.close()

    def write_text(self, rel: str, text: str) -> None:
        out = self._fs.create(self.path(rel), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def names(self, rel: str) -> list[str]:
        if not self.exists(rel):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self.path(rel))]

    def publish(self, rel: str, text: str) -> None:
        """Writes a file that must not exist yet; it appears whole or not at all."""
        beside = f"{rel}.{uuid.uuid4().hex}.tmp"
        self.write_text(beside, text)
        if self.exists(rel) or not self._fs.rename(self.path(beside), self.path(rel)):
            self._fs.delete(self.path(beside), False)
            raise ConcurrentUpdate(f"{rel} was published by another writer")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, config: IndexConfig = IndexConfig()):
        self.timings: dict[str, float] = {}
        self.spark = spark
        self.root = root.rstrip("/")
        self.config = config
        self.fs = _FS(spark, self.root)

    # -- versions ---------------------------------------------------------
    def current(self) -> Version | None:
        """The published version, or None for a new index."""
        complete = [n for n in self.fs.names("versions") if re.fullmatch(r"v\d+\.json", n)]
        if not complete:
            return None
        name = max(complete, key=lambda n: int(n[1:-5]))
        return Version(**json.loads(self.fs.read_text(f"versions/{name}")))

    def _publish(self, v: Version) -> None:
        self.fs.publish(f"versions/v{v.number:06d}.json", json.dumps(v.__dict__))

    @staticmethod
    def _new_name(kind: str, number: int) -> str:
        """A folder name that no other writer uses."""
        return f"{kind}{number:06d}-{uuid.uuid4().hex[:8]}"

    def _p(self, rel: str) -> str:
        return f"{self.root}/{rel}"

    # -- reading ------------------------------------------------------------
    def _seg_read(self, seg: str, table: str, sch) -> DataFrame:
        return self.spark.read.schema(sch).parquet(self._p(f"segments/{seg}/{table}"))

    def _live(self, v: Version, table: str, sch, key: str, only=lambda rows: rows) -> DataFrame:
        """Union of what ``only`` takes of a table over segments, each minus later tombstones.

        Where the tombstones are too many to broadcast, their Bloom filter is:
        only rows in it, the removed and a few others, are shuffled.
        """
        out = None
        tomb_schema = "doc_id string"
        for i, seg in enumerate(v.segments):
            df = only(self._seg_read(seg, table, sch))
            later = v.segments[i + 1 :]
            if later:
                tomb = None
                for s2 in later:
                    t = self.spark.read.schema(tomb_schema).parquet(self._p(f"segments/{s2}/tombstones"))
                    tomb = t if tomb is None else tomb.unionByName(t)
                tomb = tomb.withColumnRenamed("doc_id", key)
                n_tomb = sum(int(v.tombstones.get(s2, TOMBSTONE_BROADCAST_ROWS + 1)) for s2 in later)
                if n_tomb <= TOMBSTONE_BROADCAST_ROWS:
                    df = df.join(F.broadcast(tomb), key, "left_anti")
                else:
                    bits = candidate_filter(tomb, (key,))
                    kept = among_candidates(df, bits, (key,), others=True)
                    df = kept.unionByName(among_candidates(df, bits, (key,)).join(tomb, key, "left_anti"))
            out = df if out is None else out.unionByName(df)
        return out

    def documents(self, v: Version | None = None, only=lambda rows: rows) -> DataFrame:
        v = v or self.current()
        if v is None or not v.segments:
            return self.spark.createDataFrame([], S.DOCUMENTS)
        sch = DOCUMENTS_B
        return self._live(v, "documents", sch, "id", only)

    def postings(self, v: Version | None = None) -> DataFrame:
        v = v or self.current()
        if v is None or not v.segments:
            return self.spark.createDataFrame([], S.POSTINGS)
        return self._live(v, "postings", S.BLOCKS, "doc_id", posting_rows)

    def term_stats(self, v: Version | None = None) -> DataFrame:
        v = v or self.current()
        if v is None or not v.segments:
            return self.spark.createDataFrame([], S.TERM_STATS)
        if len(v.segments) == 1:
            return self._seg_read(v.segments[0], "term_stats", S.TERM_STATS)
        parts = [self._seg_read(s, "term_stats", S.TERM_STATS) for s in v.segments]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        return u.groupBy("field", "tb", "term").agg(F.sum("df").alias("df")).filter(F.col("df") > 0)

    def manifest(self, v: Version | None = None) -> DataFrame:
        """Base manifest with the per-run deltas applied (latest op wins)."""
        v = v or self.current()
        if v is None or v.manifest is None:
            return self.spark.createDataFrame([], S.MANIFEST)
        base = self.spark.read.schema(S.MANIFEST).parquet(self._p(f"manifest/{v.manifest}"))
        if not v.manifest_deltas:
            return base
        d = None
        for i, name in enumerate(v.manifest_deltas):
            t = self.spark.read.schema(MANIFEST_DELTA).parquet(self._p(f"manifest/{name}")).withColumn("seq", F.lit(i))
            d = t if d is None else d.unionByName(t)
        # Groups are per path and hold one row per delta at most.
        w = Window.partitionBy("path").orderBy(F.col("seq").desc())
        latest = d.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
        touched = latest.select("path")
        if v.manifest_delta_rows <= TOMBSTONE_BROADCAST_ROWS:
            touched = F.broadcast(touched)
        puts = latest.filter(F.col("op") == "put").select("path", "last_indexed")
        return base.join(touched, "path", "left_anti").unionByName(puts)

    def rebase_manifest(self) -> Version | None:
        """Write the folded manifest as a new base and drop the deltas."""
        v = self.current()
        if v is None or not v.manifest_deltas:
            return v
        name = self._new_name("v", v.number + 1)
        self.manifest(v).write.mode("overwrite").parquet(self._p(f"manifest/{name}"))
        nv = Version(**{**v.__dict__, "number": v.number + 1, "manifest": name, "manifest_deltas": [],
                        "manifest_delta_rows": 0})
        self._publish(nv)
        return nv

    def open_index(self) -> IndexTables:
        v = self.current()
        tb = v.term_buckets if v else self.config.term_buckets
        return IndexTables(
            documents=self.documents(v).select(*DOC_COLUMNS, "db") if v else self.documents(v),
            postings=self.postings(v),
            term_stats=self.term_stats(v),
            n_docs=v.n_docs if v else 0,
            term_buckets=tb,
            doc_buckets=v.doc_buckets if v else 0,
        )

    def doc_count(self) -> int:
        """S13."""
        v = self.current()
        return v.n_docs if v else 0

    # -- writing --------------------------------------------------------------
    def _write_documents(self, seg: str, docs: DataFrame, doc_buckets: int) -> DataFrame:
        """Writes a segment's documents by id bucket and reads them back.

        Each task writes its rows of every bucket: texts are not shuffled for
        the layout, and there are at most tasks x buckets files.
        """
        base = self._p(f"segments/{seg}/documents")
        with_db = docs.select(*DOC_COLUMNS, self._db(F.col("id"), doc_buckets).alias("db"))
        with_db.sortWithinPartitions("db", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("db").parquet(base)
        return self.spark.read.schema(DOCUMENTS_B).parquet(base)

    def _write_index(self, seg: str, written: DataFrame, term_buckets: int, gone: DataFrame | None) -> None:
        """Postings and term statistics of written documents; ``gone``: statistics to subtract."""
        base = self._p(f"segments/{seg}")
        self._write_postings(base, build_blocks(written.select(*DOC_COLUMNS), term_buckets))
        ts = build_term_stats(self.spark.read.schema(S.BLOCKS).parquet(f"{base}/postings"))
        if gone is not None:
            ts = ts.unionByName(gone).groupBy("field", "tb", "term").agg(F.sum("df").alias("df"))
        self._write_term_stats(base, ts)

    def _gone_stats(self, v: Version, seg: str, removed: DataFrame, n_removed: int) -> tuple[DataFrame | None, int]:
        """Negative document frequencies of live documents that are removed, and their number.

        The removed documents' own texts are tokenised again; only they, and
        where they are many the few others that their Bloom filter lets through,
        are shuffled.
        """
        if not v.segments:
            return None, 0
        gone = removed.withColumnRenamed("doc_id", "id")
        if n_removed <= TOMBSTONE_BROADCAST_ROWS:
            old = self.documents(v, lambda rows: rows.join(F.broadcast(gone), "id", "left_semi"))
        else:
            bits = candidate_filter(gone, ("id",))
            old = self.documents(v, lambda rows: among_candidates(rows, bits, ("id",))).join(gone, "id", "left_semi")
        # Written, as both the statistics and the number are taken from them.
        path = self._p(f"segments/{seg}/gone")
        old.select(*DOC_COLUMNS).write.mode("overwrite").option("compression", "zstd").parquet(path)
        old = self.spark.read.schema(S.DOCUMENTS).parquet(path)
        stats = build_term_stats(build_blocks(old, v.term_buckets))
        return stats.withColumn("df", -F.col("df")), old.count()

    @staticmethod
    def _write_postings(base: str, blocks: DataFrame) -> None:
        # One shuffle by bucket; Spark splits buckets that are large (a hot term
        # may fill one) and joins small ones by their bytes.  Each file is
        # sorted by term for row-group statistics.
        (
            blocks.hint("rebalance", F.col("field"), F.col("tb"))
            .sortWithinPartitions("field", "tb", "term")
            .write.mode("overwrite")
            .options(**TERM_LAYOUT)
            .partitionBy("field", "tb")
            .parquet(f"{base}/postings")
        )

    @staticmethod
    def _write_term_stats(base: str, ts: DataFrame) -> None:
        (
            ts.hint("rebalance", F.col("field"), F.col("tb"))
            .sortWithinPartitions("field", "tb", "term")
            .write.mode("overwrite")
            .options(**TERM_LAYOUT)
            .partitionBy("field", "tb")
            .parquet(f"{base}/term_stats")
        )

    @staticmethod
    def _db(id_col, doc_buckets: int):
        return F.pmod(F.xxhash64(id_col), F.lit(doc_buckets)).cast("int")

    def _ledger(self, run_id: str, status: int, n_done: int, n_total: int, batch: int) -> None:
        row = [(run_id, batch, n_done, n_total, status, datetime.now(timezone.utc).replace(tzinfo=None))]
        self.spark.createDataFrame(row, S.RUN_LEDGER).coalesce(1).write.mode("append").parquet(self._p("ledger"))

    def ledger(self) -> DataFrame:
        if not self.fs.exists("ledger"):
            return self.spark.createDataFrame([], S.RUN_LEDGER)
        return self.spark.read.schema(S.RUN_LEDGER).parquet(self._p("ledger"))

    def update(
        self,
        raw_listing: DataFrame,
        root: str,
        excludes: Sequence[str] = (),
        run_id: str | None = None,
        run_ts: datetime | None = None,
    ) -> dict:
        """Incremental index of ``root`` from a file listing.

        ``raw_listing`` is the unfiltered listing (paths, sizes, times,
        content); content is read only for changed files.  ``run_ts`` is the
        run's timestamp, taken at scan start by the caller (defaults to now).
        """
        run_ts = run_ts or datetime.now(timezone.utc).replace(tzinfo=None)
        run_id = run_id or run_ts.strftime("run-%Y%m%dT%H%M%S%f")
        try:
            return self._update(raw_listing, root, excludes, run_id, run_ts)
        except Exception:
            self._ledger(run_id, PROGRESS_FAILED, 0, 0, 0)
            raise

    def _update(self, raw_listing: DataFrame, root: str, excludes: Sequence[str], run_id: str, run_ts: datetime) -> dict:
        self.timings = {}
        t0 = time.time()
        v = self.current()
        # A store keeps the bucket counts that it began with.
        term_buckets = v.term_buckets if v else self.config.term_buckets
        doc_buckets = v.doc_buckets if v else self.config.doc_buckets
        self._ledger(run_id, PROGRESS_STEP_LISTED, 0, 0, 0)

        # Metadata only: one full outer join with the manifest, written to the
        # store, so the tree is listed once and later steps see one snapshot.
        cdir = self._p(f"runs/{run_id}/changes")
        facts = raw_listing.drop("content")
        L.change_set(facts, self.manifest(v), root, excludes).write.mode("overwrite").parquet(cdir)
        changes = self.spark.read.parquet(cdir)
        counts = {r["status"]: int(r["n"]) for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        n_changed = counts.get("new", 0) + counts.get("changed", 0)
        changed = changes.filter(F.col("status").isin("new", "changed")).drop("status", "last_indexed")
        deleted = L.truly_deleted(changes)
        n_deleted = deleted.count() if counts.get("deleted", 0) else 0
        self.timings["detect"] = time.time() - t0
        if n_changed == 0 and n_deleted == 0:
            self._ledger(run_id, PROGRESS_COMPLETE, 0, 0, 1)
            return {"run_id": run_id, "changed": 0, "deleted": 0, "n_docs": v.n_docs if v else 0, "published": False}

        if "content" in raw_listing.columns:
            texts = raw_listing.select("path", "content")
            if n_changed <= TOMBSTONE_BROADCAST_ROWS:
                changed = texts.join(F.broadcast(changed), "path")
            else:
                texts = among_candidates(texts, candidate_filter(changed, ("path",)), ("path",))
                changed = changed.join(texts, "path")
        else:
            # Read the changed text files now (S8), errors isolated.
            from quarry.sources.files import with_content

            want = is_index_text(F.col("name")) & ~F.col("is_dir")
            changed = with_content(changed, want, self.config.content_cap_bytes)
        number = (v.number + 1) if v else 1
        seg = self._new_name("s", number)
        # Written documents are the files processed: a file that could not be
        # read is not among them, keeps its old document and is tried again.
        written = self._write_documents(seg, assemble_documents(changed, self.config.content_cap_bytes), doc_buckets)
        processed = written.select(F.col("id").alias("path"))
        n_added = processed.count()
        self.timings["documents"] = time.time() - t0
        removed = processed.unionByName(deleted).select(F.col("path").alias("doc_id"))
        gone, n_removed_live = self._gone_stats(v, seg, removed, n_added + n_deleted) if v else (None, 0)
        self._ledger(run_id, PROGRESS_STEP_CLEANED, 0, n_changed, 0)
        self.timings["cleaned"] = time.time() - t0
        self._write_index(seg, written, term_buckets, gone)
        removed.write.mode("overwrite").parquet(self._p(f"segments/{seg}/tombstones"))
        self.timings["segment"] = time.time() - t0

        # S15 + S16: deleted paths leave the manifest; processed files are
        # stamped with the run time.  The first run writes a base; later runs
        # write only a delta of this run's rows.
        stamp = F.to_timestamp(F.lit(run_ts.strftime("%Y-%m-%d %H:%M:%S.%f")))
        if v is None or v.manifest is None:
            mname, mdeltas, mrows = self._new_name("v", number), [], 0
            processed.withColumn("last_indexed", stamp).write.mode("overwrite").parquet(self._p(f"manifest/{mname}"))
        else:
            dname = self._new_name("d", number)
            delta = processed.select("path", stamp.alias("last_indexed"), F.lit("put").alias("op")).unionByName(
                deleted.select("path", F.lit(None).cast("timestamp").alias("last_indexed"), F.lit("del").alias("op"))
            )
            delta.write.mode("overwrite").parquet(self._p(f"manifest/{dname}"))
            mname, mdeltas = v.manifest, v.manifest_deltas + [dname]
            mrows = v.manifest_delta_rows + n_added + n_deleted

        n_docs = (v.n_docs if v else 0) - n_removed_live + n_added
        nv = Version(
            number=number,
            segments=(v.segments if v else []) + [seg],
            n_docs=n_docs,
            term_buckets=term_buckets,
            doc_buckets=doc_buckets,
            manifest=mname,
            manifest_deltas=mdeltas,
            manifest_delta_rows=mrows,
            tombstones={**(v.tombstones if v else {}), seg: n_added + n_deleted},
        )
        self._publish(nv)
        self._ledger(run_id, PROGRESS_COMPLETE, n_added, n_changed, 1)
        self.timings["published"] = time.time() - t0
        return {"run_id": run_id, "changed": n_changed, "deleted": n_deleted, "n_docs": n_docs, "published": True}

    def maintain(self) -> Version | None:
        """Merges segments and manifest deltas where there are more than ``max_segments``."""
        v = self.current()
        if v and len(v.segments) > self.config.max_segments:
            v = self.merge_tail()
        if v and len(v.manifest_deltas) > self.config.max_segments:
            v = self.rebase_manifest()
        return v

    def merge_tail(self) -> Version | None:
        """Fold every segment after the first into one.

        The base segment is left alone, so the cost is that of the
        increments: their live documents are copied and tokenised again, which
        costs less than copying postings row by row, their term-statistics deltas are summed (negative
        deltas still apply to the base), and their tombstones are united.
        """
        v = self.current()
        if v is None or len(v.segments) <= 2:
            return v
        head, tail = v.segments[:1], v.segments[1:]
        tv = Version(
            number=v.number,
            segments=tail,
            term_buckets=v.term_buckets,
            doc_buckets=v.doc_buckets,
            tombstones=v.tombstones,
        )
        number = v.number + 1
        seg = self._new_name("s", number)
        base = self._p(f"segments/{seg}")
        written = self._write_documents(seg, self._live(tv, "documents", DOCUMENTS_B, "id"), v.doc_buckets)
        self._write_postings(base, build_blocks(written.select(*DOC_COLUMNS), v.term_buckets))
        parts = [self._seg_read(s2, "term_stats", S.TERM_STATS) for s2 in tail]
        u = parts[0]
        for p2 in parts[1:]:
            u = u.unionByName(p2)
        ts = u.groupBy("field", "tb", "term").agg(F.sum("df").alias("df")).filter(F.col("df") != 0)
        self._write_term_stats(base, ts)
        tombs = None
        for s2 in tail:
            t = self.spark.read.schema("doc_id string").parquet(self._p(f"segments/{s2}/tombstones"))
            tombs = t if tombs is None else tombs.unionByName(t)
        tombs.distinct().write.mode("overwrite").parquet(f"{base}/tombstones")
        n_tomb = self.spark.read.schema("doc_id string").parquet(f"{base}/tombstones").count()
        nv = Version(
            number=number,
            segments=head + [seg],
            n_docs=v.n_docs,
            term_buckets=v.term_buckets,
            doc_buckets=v.doc_buckets,
            manifest=v.manifest,
            manifest_deltas=v.manifest_deltas,
            manifest_delta_rows=v.manifest_delta_rows,
            tombstones={**{h: v.tombstones.get(h, 0) for h in head}, seg: n_tomb},
        )
        self._publish(nv)
        return nv

    def compact(self) -> Version | None:
        """Rewrite the live rows of the current version as one segment."""
        v = self.current()
        if v is None or len(v.segments) <= 1:
            return v
        number = v.number + 1
        seg = self._new_name("s", number)
        written = self._write_documents(seg, self.documents(v), v.doc_buckets)
        self._write_index(seg, written, v.term_buckets, None)
        empty = self.spark.createDataFrame([], "doc_id string")
        empty.write.mode("overwrite").parquet(self._p(f"segments/{seg}/tombstones"))
        nv = Version(
            number=number,
            segments=[seg],
            n_docs=v.n_docs,
            term_buckets=v.term_buckets,
            doc_buckets=v.doc_buckets,
            manifest=v.manifest,
            manifest_deltas=v.manifest_deltas,
            manifest_delta_rows=v.manifest_delta_rows,
            tombstones={seg: 0},
        )
        self._publish(nv)
        return nv


def progress(ledger: DataFrame) -> DataFrame:
    """Latest status per run (the status endpoint)."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy(F.col("ts").desc(), F.col("status").desc())
    return ledger.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")

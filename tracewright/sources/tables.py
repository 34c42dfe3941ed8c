"""Tables, schemas, epochs, archives."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import canonical


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Where it is unset, a folder below the warehouse, on one machine only:
    a cluster must name a folder that all its machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


FIELDS = "ARRAY<STRUCT<name: STRING, value: STRING>>"
#: Schemas are declared, never inferred.
DDL: dict[str, str] = {
    "traces": f"tenant_id STRING, trace_id STRING, client_trace_id STRING, harness STRING, harness_version STRING, task STRING, environment {FIELDS}, content_hash STRING, schema_version STRING",
    "events": f"tenant_id STRING, trace_id STRING, event_id STRING, position INT, client_event_id STRING, occurred_at STRING, kind STRING, tool_name STRING, tool_version STRING, fields {FIELDS}, result STRUCT<state: STRING, exit_code: INT, evidence: {FIELDS}>",
    "evidence": "tenant_id STRING, outcome_id STRING, evidence_id STRING, class STRING, verdict STRING, predicate STRING, verifier STRING, observed_at TIMESTAMP",
    "documents": "tenant_id STRING, version_id STRING, procedure_id STRING, epoch BIGINT, task STRING, intent STRING, effect STRING, contracts ARRAY<STRING>, environment STRING, harness STRING, harness_version STRING, lifecycle STRING, superseded_by STRING, observed BOOLEAN, verification_strength INT, unsafe BIGINT, validated_at TIMESTAMP, validation_policy STRING, recall BOOLEAN, region STRING, risk INT, content_hash STRING",
    "queue": "tenant_id STRING, job_id STRING, kind STRING, state STRING, available_at BIGINT, created_at BIGINT, owner STRING, generation INT, lease_expires_at BIGINT, attempts INT",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all: it is written aside and moved, which fails (False) if the name is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:  # without the option to overwrite
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        fs.delete(aside, False)
        return False
    return True


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class ReadersHold(RuntimeError):
    """Folders that were replaced are still held by readers' pins."""


class Catalog:
    """Immutable, epoch-versioned Parquet tables below one folder.

    A write adds data folders and then publishes them by one small commit file, which names every (table, epoch, folder)
    of the write: what one commit holds, also of several tables, becomes visible together or not at all. A commit file is
    moved to its number, which fails if another writer was there first; a crash before that leaves nothing a reader can
    see. A reader pins the commits it saw. An as-of read opens the folders up to its epoch and no others, in one scan.

    Rows of tenants that are fenced (table `_fences`) pass no write, and a write that began before a fence was set cannot
    be published after it: a folder's name ends with the number of fences its writer knew."""

    def __init__(self, spark: SparkSession, root: str, before: int | None = None, pinned: str | None = None):
        self.spark, self.root, self.before, self.pinned = spark, root.rstrip("/"), before, pinned
        self._known: dict[int, list[tuple[str, int, str]]] = {}  # commit files never change

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        """Names in one of the catalog's own folders of small files or of a table's data folders."""
        if not self._fs().exists(self._path(folder)):
            return []
        return sorted(n for n in (x.getPath().getName() for x in self._fs().listStatus(self._path(folder))) if not n.startswith("."))

    def _lines(self) -> list[tuple[int, str, int, str]]:
        """(commit, table, epoch, folder), in the order of the commits."""
        fresh = [n for n in map(int, self._names("_commits")) if n not in self._known]
        if len(fresh) <= 16:
            texts = {n: get_text(self.spark, f"{self.root}/_commits/{n}") for n in fresh}
        else:  # read by tasks
            rows = self.spark.read.text([f"{self.root}/_commits/{n}" for n in fresh], wholetext=True).select(F.col("_metadata.file_name").cast("int").alias("n"), "value")
            texts = {r.n: r.value for r in rows.collect()}  # one short text per commit
        self._known |= {n: [(table, int(epoch), name) for table, epoch, name in (x.split("\t") for x in text.splitlines())] for n, text in texts.items()}
        return sorted((n, *line) for n, lines in self._known.items() for line in lines if self.before is None or n < self.before)

    def _commits(self) -> tuple[int, dict[tuple[str, int], str]]:
        """The number of the next commit, and the folder of each table and epoch: that of the last commit naming it."""
        lines = self._lines()
        return max((n for n, *_ in lines), default=-1) + 1, {(table, epoch): name for _, table, epoch, name in lines}

    def _publish(self, number: int, names: dict[tuple[str, int], str]) -> bool:
        """False if another writer has this commit number already."""
        return put_once(self.spark, f"{self.root}/_commits/{number}", "".join(f"{table}\t{epoch}\t{name}\n" for (table, epoch), name in sorted(names.items())))

    @staticmethod
    def _last(names: dict[tuple[str, int], str], table: str) -> int:
        return max((epoch for t, epoch in names if t == table), default=-1)

    def head(self, table: str) -> int:
        """The greatest published epoch, -1 if there is none."""
        return self._last(self._commits()[1], table)

    def heads(self, *tables: str) -> dict[str, int]:
        """The heads of several tables as of one moment: what a commit that depends on them all must expect."""
        names = self._commits()[1]
        return {t: self._last(names, t) for t in tables}

    def fences(self) -> DataFrame:
        """tenant_id (as text), request_id of the tenants that are erased or being erased."""
        return self.read("_fences", schema=T.StructType.fromDDL("tenant_id STRING, request_id STRING")).select("tenant_id", "request_id")

    def unfenced(self, rows: DataFrame) -> DataFrame:
        """rows without those of fenced tenants."""
        if "tenant_id" not in rows.columns:
            return rows
        gone = self.fences().select(F.col("tenant_id").alias("__fenced")).distinct()
        return rows.join(gone, rows["tenant_id"].cast("string") == F.col("__fenced"), "left_anti")

    def commit(self, tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> dict[str, int]:
        """Write rows as the next epoch of each table, all published at once. `expected` are the heads that the writer
        read: compare and set. The rows of a writer that loses stay unpublished."""
        number, names = self._commits()
        heads = {t: self._last(names, t) for t in tables} | (expected or {})
        fences = self._last(names, "_fences")
        folders = {t: f"{heads[t] + 1}-{uuid.uuid4().hex}-{fences + 1}" for t in tables}
        if wrong := {t: self._last(names, t) for t in heads if self._last(names, t) != heads[t]}:
            raise RuntimeError(f"heads are {wrong}, not {heads}")
        for t, rows in tables.items():
            passed = self.unfenced(rows) if fences >= 0 and not t.startswith("_") else rows
            passed.write.parquet(f"{self.root}/{t}/data/{folders[t]}")
        while True:
            number, names = self._commits()
            if any(self._last(names, t) != heads[t] for t in heads):
                raise RuntimeError(f"another writer has moved the heads {heads}")
            if self._last(names, "_fences") != fences and "_fences" not in tables:
                raise RuntimeError("a tenant was fenced since this write began: repeat it")
            if self._publish(number, {(t, heads[t] + 1): folder for t, folder in folders.items()}):
                return {t: heads[t] + 1 for t in tables}

    def append(self, table: str, rows: DataFrame, expected: int | None = None) -> int:
        return self.commit({table: rows}, None if expected is None else {table: expected})[table]

    def read(self, table: str, as_of: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """All rows published up to an epoch, with their epoch."""
        paths = [f"{self.root}/{table}/data/{name}" for (t, epoch), name in sorted(self._commits()[1].items()) if t == table and (as_of is None or epoch <= as_of)]
        if not paths:
            return self.spark.createDataFrame([], T.StructType(list(schema.fields) if schema is not None else []).add("epoch", "long"))
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read.option("mergeSchema", "true")
        epoch = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+)-[0-9a-f-]+/", 1).cast("long")
        return reader.parquet(*paths).withColumn("epoch", epoch)

    # --- pins ---

    def pin(self, until: int) -> Catalog:
        """A view of the catalog as it is now. Its folders stay on disk until `unpin`, or until the time `until`."""
        while True:
            number = self._commits()[0]
            name = f"{number}-{until}-{uuid.uuid4().hex}"
            put_once(self.spark, f"{self.root}/_pins/{name}", "")
            if self._commits()[0] == number:  # what is published from now on sees the pin before it deletes anything
                return Catalog(self.spark, self.root, number, name)
            self._fs().delete(self._path(f"_pins/{name}"), False)

    def unpin(self) -> None:
        if self.pinned:
            self._fs().delete(self._path(f"_pins/{self.pinned}"), False)

    def _held(self, now: int) -> int:
        """The least commit number that a living pin was taken before, or a number above all."""
        return min((int(n.split("-")[0]) for n in self._names("_pins") if int(n.split("-")[1]) > now), default=1 << 62)

    # --- migrations ---

    def migrate(self, migrations: list[tuple[int, str, str]]) -> list[int]:
        """Apply migrations (version, table, DDL) in order, each once: from then on `read_migrated` shows the table with
        the columns of its last migration. A migration that was applied must still have the text it was applied with;
        numbers must be 1, 2, ...; a column keeps its type once it has one."""
        if [m[0] for m in migrations] != list(range(1, len(migrations) + 1)):
            raise ValueError("migrations must be numbered from 1 without gaps")
        done = {r.version: r.checksum for r in self._migrations().collect()}  # one row per migration
        fresh, types = [], {}
        for version, table, ddl in migrations:
            checksum = canonical.identity({"ddl": ddl, "table": table, "version": version})
            for f in T.StructType.fromDDL(ddl).fields:
                if types.setdefault((table, f.name), f.dataType) != f.dataType:
                    raise ValueError(f"migration {version} changes the type of {table}.{f.name}")
            if version in done:
                if done[version] != checksum:
                    raise ValueError(f"migration {version} was changed after it was applied")
            else:
                fresh.append((version, checksum, table, ddl))
        if fresh:
            self.append("_migrations", self.spark.createDataFrame(fresh, "version INT, checksum STRING, table STRING, ddl STRING"), expected=self.head("_migrations"))
        return [v for v, *_ in fresh]

    def _migrations(self) -> DataFrame:
        return self.read("_migrations", schema=T.StructType.fromDDL("version INT, checksum STRING, table STRING, ddl STRING"))

    def read_migrated(self, table: str, as_of: int | None = None) -> DataFrame:
        """A table with the columns of its last migration: what older epochs lack is null, what it dropped is not read."""
        last = self._migrations().where(F.col("table") == table).orderBy(F.desc("version")).first()
        if last is None:
            raise ValueError(f"{table} has no migration")
        return self.read(table, as_of, T.StructType.fromDDL(last.ddl))

    # --- erasure ---

    def tables(self) -> list[str]:
        return sorted({t for t, _ in self._commits()[1] if not t.startswith("_")})

    def erase(self, table: str, column: str, value: str) -> int:
        """Erase one tenant's rows; the number of rows that went."""
        return sum(r["rows"] for r in self.erase_all(table, column, self.spark.range(1).select(F.lit(value).alias(column))).collect())

    def erase_all(self, table: str, column: str, values: DataFrame) -> DataFrame:
        """Rewrite the epochs of a table that hold rows of the given tenants, without them -> column, rows, receipt: what
        went, with a hash over both. As-of reads keep their history. A crash on the way is mended by the next call."""
        self.finish_rewrites()
        total = self.rewrite(uuid.uuid4().hex, [table], column, values).groupBy(column).agg(F.sum("rows").alias("rows"))
        self.finish_rewrites()
        return total.withColumn("receipt", F.sha2(F.concat_ws(":", column, "rows"), 256))

    def rewrite(self, name: str, tables: list[str], column: str, values: DataFrame) -> DataFrame:
        """Publish, in one commit, the epochs of the tables that hold rows of the given tenants, without those rows ->
        table, epoch, column, rows: what went. Which folder takes which one's place is written down before the commit, so
        that `finish_rewrites` can always tell what must go."""
        gone = checkpoint(values.select(F.col(column).alias("__gone")).distinct())
        own = F.col(column).eqNullSafe(F.col("__gone"))
        none = self.spark.createDataFrame([], T.StructType([T.StructField("table", T.StringType()), T.StructField("epoch", T.LongType()), T.StructField(column, gone.schema["__gone"].dataType), T.StructField("rows", T.LongType())]))
        lines, before = self._lines(), self._commits()[1]
        counts = []
        for table in tables:
            rows = self.read(table)
            if column in rows.columns:
                counts.append(rows.join(gone, own, "left_semi").groupBy(F.lit(table).alias("table"), "epoch", column).agg(F.count("*").alias("rows")))
        counted = checkpoint(reduce(DataFrame.unionByName, counts)) if counts else none
        tag = sum(t == "_fences" for _, t, _, _ in lines)
        moves = [(r.table, r.epoch, before[(r.table, r.epoch)], f"{r.epoch}-{uuid.uuid4().hex}-{tag}") for r in counted.select("table", "epoch").distinct().collect()]  # one row per epoch
        if not moves:
            return counted
        put_once(self.spark, f"{self.root}/_rewrites/{name}", "".join("\t".join(map(str, m)) + "\n" for m in sorted(moves)))
        for table, _, old, new in moves:
            held = self.spark.read.parquet(f"{self.root}/{table}/data/{old}")
            held.join(gone, own, "left_anti").write.parquet(f"{self.root}/{table}/data/{new}")
        while True:
            number, now = self._commits()
            if any(now[(table, epoch)] != old for table, epoch, old, _ in moves):
                raise RuntimeError("an epoch was rewritten by another writer")
            if self._publish(number, {(table, epoch): new for table, epoch, _, new in moves}):
                return counted

    def finish_rewrites(self, now: int = 1 << 62) -> int:
        """Delete what rewrites have replaced, or, where one was never published, what it had written. Folders that a pin
        still holds at `now` stay, with their note; the number of such notes is returned."""
        lines, waiting = self._lines(), 0
        published = {(t, name): n for n, t, _, name in lines}
        held = self._held(now)
        for note in self._names("_rewrites"):
            moves = [m.split("\t") for m in (get_text(self.spark, f"{self.root}/_rewrites/{note}") or "").splitlines()]
            late = False
            for table, _, old, new in moves:
                at = published.get((table, new))
                late |= at is not None and held <= at
                if at is None or held > at:
                    self._fs().delete(self._path(f"{table}/data/{new if at is None else old}"), True)
            waiting += late
            if not late:
                self._fs().delete(self._path(f"_rewrites/{note}"), False)
        return waiting

    def drop_unpublished(self, fence: int) -> int:
        """Delete data folders that no commit names and whose writers knew no more than `fence` fences: they can no longer
        be published."""
        known, n = {(t, name) for _, t, _, name in self._lines()}, 0
        noted = {(m.split("\t")[0], m.split("\t")[3]) for note in self._names("_rewrites") for m in (get_text(self.spark, f"{self.root}/_rewrites/{note}") or "").splitlines()}
        for table in self._names(""):
            for name in self._names(f"{table}/data"):
                if (table, name) not in known | noted and int(name.rsplit("-", 1)[1]) <= fence:
                    n += self._fs().delete(self._path(f"{table}/data/{name}"), True)
        return n


# --- archive -----------------------------------------------------------------------------------------------------


def archive_put(batches: DataFrame, root: str) -> DataFrame:
    """Write batches(tenant_id, schema_version, content_hash, body) below canonical/<tenant>/<schema>; returns
    (content_hash, reused). Bodies must match their hashes; hashes already there are not written again."""
    spark = batches.sparkSession
    wrong = batches.where(F.sha2("body", 256) != F.col("content_hash"))
    if not wrong.isEmpty():
        raise ValueError("a body does not match its hash")
    tagged = batches.dropDuplicates(["content_hash"]).withColumn("tenant8", F.substring(F.sha2("tenant_id", 256), 1, 8))
    try:
        known = spark.read.parquet(f"{root}/canonical").select("content_hash")
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "content_hash string")
    known = checkpoint(known)
    tagged.join(known, "content_hash", "left_anti").write.mode("append").partitionBy("tenant8", "schema_version").parquet(f"{root}/canonical")
    return tagged.join(known.withColumn("reused", F.lit(True)), "content_hash", "left").select("content_hash", F.coalesce("reused", F.lit(False)).alias("reused"))


def archive_get(spark: SparkSession, root: str, hashes: DataFrame, most_bytes: int) -> DataFrame:
    """content_hash, body of the archived objects, those over the size bound or with a wrong hash left out."""
    found = spark.read.parquet(f"{root}/canonical").join(hashes.select("content_hash"), "content_hash", "left_semi")
    return found.where((F.octet_length("body") <= most_bytes) & (F.sha2("body", 256) == F.col("content_hash"))).select("content_hash", "body")


def _archived(spark: SparkSession, root: str, tenant_id: str):
    tenant8 = spark.range(1).select(F.substring(F.sha2(F.lit(tenant_id), 256), 1, 8)).first()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/canonical/tenant8={tenant8}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def archive_count(spark: SparkSession, root: str, tenant_id: str) -> int:
    fs, path = _archived(spark, root, tenant_id)
    return spark.read.parquet(path.toString()).count() if fs.exists(path) else 0


def archive_wipe(spark: SparkSession, root: str, tenant_id: str) -> bool:
    """Delete a tenant's archived objects and look again; True if nothing is left."""
    fs, path = _archived(spark, root, tenant_id)
    fs.delete(path, True)
    return not fs.exists(path)


def journal(spark: SparkSession, path: str, entry_id: str, body: dict) -> bool:
    """Write an intent before acting on it, once: False if it was there already with the same body; a different body
    under the same id is an error."""
    text = canonical.dumps(body)
    if put_once(spark, f"{path}/{entry_id}.json", text):
        return True
    if get_text(spark, f"{path}/{entry_id}.json") != text:
        raise ValueError(f"{entry_id} is in the journal with another body")
    return False


def journaled(spark: SparkSession, path: str, entry_id: str) -> dict | None:
    found = get_text(spark, f"{path}/{entry_id}.json")
    return None if found is None else json.loads(found)


def load_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Strict scan: declared schema, malformed input fails."""
    return spark.read.schema(DDL[table]).option("mode", "FAILFAST").json(path)


def build_batch(tenant_id: str, trace: dict, events: list[dict]) -> dict:
    """A canonical batch with its identities: the trace's over the tenant and the trace without id, then each event's
    over the tenant, the trace's id and the event without id."""
    trace = trace | {"id": ""}
    trace["id"] = canonical.identity({"tenant_id": tenant_id, "trace": trace}, "tr_")
    out = []
    for position, e in enumerate(events):
        e = e | {"id": "", "position": position}
        e["id"] = canonical.identity({"event": e, "tenant_id": tenant_id, "trace_id": trace["id"]}, "ev_")
        out.append(e)
    return {"events": out, "tenant_id": tenant_id, "trace": trace}


def credentials(spark: SparkSession, path: str) -> DataFrame:
    """token_hash -> tenant, scopes, consent, region; joined on sha2(token, 256), tokens are never stored."""
    return spark.read.schema("token_hash STRING, tenant_id STRING, scopes ARRAY<STRING>, consent STRING, region STRING").option("mode", "FAILFAST").json(path)


def authorize(requests: DataFrame, known: DataFrame, scope: str) -> DataFrame:
    """requests(token, ...) of principals that hold the scope."""
    return requests.withColumn("token_hash", F.sha2("token", 256)).join(known, "token_hash").where(F.array_contains("scopes", scope)).drop("token", "token_hash")

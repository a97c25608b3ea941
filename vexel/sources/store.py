"""Collections on a file system that Spark reads: a Parquet mutation log, base versions with their indexes, snapshots.

Everything is written through Hadoop's file systems, into folders that never change. Manifests are numbered; one names the
base version, the log folders after it in their order, and the index. A commit puts the next number in place by a rename
that fails if another writer was first, and is then tried again on that writer's manifest: readers see one state or the
other, and no commit is lost.

A base version holds the points, with plain columns of the payload fields that the collection indexes, and the postings of
its sparse vectors and texts. Readers take it as it is, without the ids that the log names, and fold the log alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, lexical, mutations
from ..plans.filters import index_columns, payload_variant
from ..types import POINT_SCHEMA, CollectionConfig, CollectionExists, CollectionNotFound, InvalidRequest, PointNotFound

LOG_SCHEMA = f"place long, op string, {POINT_SCHEMA}"
#: Commits that are tried while other writers are first, and manifests that are kept behind the newest.
TRIES, KEPT = 50, 20


def text_of(payload, field: str):
    """The text field of a payload: the key as it stands, else as a dotted path."""
    v = payload_variant(payload)
    quoted = lambda part: "['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.coalesce(F.try_variant_get(v, "$" + quoted(field), "string"), F.try_variant_get(v, "$" + "".join(map(quoted, field.split("."))), "string"))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), conf)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _read(self, *parts: str) -> dict:
        stream = self._fs.open(self._path(*parts))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put(self, what: dict, *parts: str) -> bool:
        """Writes a new file, whole or not at all; False if there is one."""
        target, fresh = self._path(*parts), self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(fresh, target, no_options)
        except Exception:
            self._fs.delete(fresh, False)
            if self._fs.exists(target):
                return False
            raise
        return True

    def create(self, config: CollectionConfig) -> None:
        config.validate()
        if self._fs.exists(self._path(config.name, "config.json")):
            raise CollectionExists(config.name)
        self._fs.mkdirs(self._path(config.name, "manifests"))
        if not self._put(config.to_dict(), config.name, "config.json"):
            raise CollectionExists(config.name)

    def drop(self, name: str) -> None:
        """Idempotent."""
        self._fs.delete(self._path(name), True)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if self._fs.exists(self._path(s.getPath().getName(), "config.json")))

    def config(self, name: str) -> CollectionConfig:
        if not self._fs.exists(self._path(name, "config.json")):
            raise CollectionNotFound(name)
        return CollectionConfig.from_dict(self._read(name, "config.json"))

    def _numbers(self, name: str) -> list[int]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(name, "manifests")))
        return sorted(int(x.removesuffix(".json")) for x in found if x.endswith(".json") and not x.startswith("."))

    def manifest(self, name: str) -> dict:
        self.config(name)
        numbers = self._numbers(name)
        return self._read(name, "manifests", f"{numbers[-1]}.json") if numbers else {"number": 0, "base": None, "logs": [], "done": [], "index": None, "checkpoint": None}

    def commit(self, name: str, change: Callable[[dict], dict | None]) -> dict | None:
        """The manifest that `change` makes of the newest one; nothing happens if it gives None."""
        for _ in range(TRIES):
            now = self.manifest(name)
            new = change(now)
            if new is None:
                return None
            number = now["number"] + 1
            if self._put(new | {"number": number}, name, "manifests", f"{number}.json"):
                self._fs.delete(self._path(name, "manifests", f"{number - KEPT}.json"), False)
                return new
        raise InvalidRequest(f"{name} has too many writers")

    def append(self, name: str, op: str, rows: DataFrame, order: str | None = None, batch: str | None = None) -> int:
        """Adds mutations; of one id the last in `order` wins, or in that of the rows. `batch` names a batch whose second arrival is ignored."""
        config = self.config(name)
        if batch and batch in self.manifest(name)["done"]:
            return 0
        folder = f"log/{uuid.uuid4().hex}"
        for c, kind in (("values", "array<float>"), ("payload", "string"), ("sparse", "struct<indices:array<bigint>,values:array<float>>")):
            rows = rows.withColumn(c, (F.col(c) if c in rows.columns else F.lit(None)).cast(kind))
        if op == "upsert":
            rows = rows.withColumn("values", F.when(F.assert_true(F.size("values") == config.dimension, F.lit(f"vectors of {name} have {config.dimension} numbers")).isNull(), F.col("values")))
        place = F.col(order).cast("long") if order else F.monotonically_increasing_id()
        rows.select(place.alias("place"), F.lit(op).alias("op"), F.col("id").cast("string").alias("id"), "values", "payload", "sparse").write.parquet(str(self._path(name, folder)))

        def add(now):
            if batch and batch in now["done"]:
                return None
            return now | {"logs": [*now["logs"], folder], "done": [*now["done"], *([batch] if batch else [])]}

        if self.commit(name, add) is None:
            return 0
        return self.spark.read.schema(LOG_SCHEMA).parquet(str(self._path(name, folder))).count()

    def delete(self, name: str, ids: list[str]) -> int:
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        missing = wanted.join(self.points(name).select("id"), "id", "left_anti").limit(1).collect()
        if missing:
            raise PointNotFound(missing[0].id)
        return self.append(name, "delete", wanted)

    def _logged(self, name: str, folders: list[str]) -> DataFrame:
        """Mutations with seq, their batch and their place in it: batches stand as the manifest lists them."""
        if not folders:
            return self.spark.createDataFrame([], LOG_SCHEMA).select(F.struct(F.lit(0).alias("batch"), "place").alias("seq"), "op", "id", "values", "payload", "sparse")
        rows = self.spark.read.schema(LOG_SCHEMA).parquet(*[str(self._path(name, p)) for p in folders])
        order = self.spark.createDataFrame([(k, p.split("/")[-1]) for k, p in enumerate(folders)], "batch int, folder string")
        named = rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/[^/]*$", 1))
        return named.join(F.broadcast(order), "folder").select(F.struct("batch", "place").alias("seq"), "op", "id", "values", "payload", "sparse")  # a row a folder

    def _base(self, name: str, manifest: dict, part: str = "points") -> DataFrame:
        return self.spark.read.parquet(str(self._path(name, manifest["base"], part)))

    def points(self, name: str, ids: list[str] | None = None) -> DataFrame:
        """id, values, payload, sparse of the live points, or of those among ids, and the index columns."""
        return self._points(name, self.manifest(name), ids)

    def _points(self, name, manifest, ids=None) -> DataFrame:
        config = self.config(name)
        log = self._logged(name, manifest["logs"])
        if ids is not None:
            log = log.where(F.col("id").isin(ids))
        fresh = mutations.fold(log)
        if config.payload_indexes:
            fresh = fresh.withColumns(index_columns(payload_variant(F.col("payload")), config.payload_indexes))
        if not manifest["base"]:
            return fresh
        base = self._base(name, manifest)
        base = base if ids is None else base.where(F.col("id").isin(ids))
        if not manifest["logs"]:
            return base
        return base.join(log.select("id").distinct(), "id", "left_anti").unionByName(fresh)

    def get(self, name: str, id: str):
        found = self.points(name, [id]).select("id", "values", "payload", "sparse").collect()
        return found[0] if found else None

    def scroll(self, name: str, cursor: str = "", limit: int = 256) -> tuple[list, str]:
        """Rows after the cursor by id, and the next cursor, empty at the end."""
        limit = max(1, limit)
        rows = self.points(name).where(F.col("id") > cursor).select("id", "values", "payload", "sparse").orderBy("id").limit(limit + 1).collect()
        return rows[:limit], rows[limit - 1].id if len(rows) > limit else ""

    def compact(self, name: str) -> dict:
        """The live points as a new base with its postings; what was logged meanwhile stays in the log."""
        config, manifest = self.config(name), self.manifest(name)
        before = self._logged(name, manifest["logs"]).count() + (self._base(name, manifest).count() if manifest["base"] else 0)
        base = f"base/{uuid.uuid4().hex}"
        at = lambda part: str(self._path(name, base, part))
        live = self._points(name, manifest)
        by = [c for c in live.columns if c.startswith("ix") and c.endswith("_low")]
        # rows that are alike in the first indexed field share files, which a filter on it can skip
        (live.repartitionByRange(*by).sortWithinPartitions(*by) if by else live).write.parquet(at("points"))
        written = self.spark.read.parquet(at("points"))
        if config.sparse_enabled:
            lexical.sparse_postings(written).repartitionByRange("idx").sortWithinPartitions("idx").write.parquet(at("sparse"))
        if config.bm25_text_field:
            texts = written.select("id", text_of(F.col("payload"), config.bm25_text_field).alias("text"))
            lexical.term_postings(texts).repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(at("terms"))
            lexical.lengths(texts).write.parquet(at("lengths"))
        self.commit(name, lambda now: None if now["base"] != manifest["base"] else now | {"base": base, "logs": [x for x in now["logs"] if x not in manifest["logs"]]})
        if manifest["index"]:
            self.reindex(name, manifest["index"]["lists"])
        return {"entries_before": before, "entries_after": written.count()}

    def _changed(self, name, manifest, part) -> tuple[DataFrame, DataFrame | None]:
        """The live points outside the base, and a table of the base without the ids that the log names; None without a base."""
        log = self._logged(name, manifest["logs"])
        fresh = mutations.fold(log)
        if not manifest["base"]:
            return fresh, None
        kept = self._base(name, manifest, part)
        return fresh, kept.join(log.select("id").distinct(), "id", "left_anti") if manifest["logs"] else kept

    def sparse_postings(self, name: str) -> DataFrame:
        """id, idx, weight of the live points."""
        fresh, kept = self._changed(name, self.manifest(name), "sparse")
        new = lexical.sparse_postings(fresh)
        return new if kept is None else kept.select("id", "idx", "weight").unionByName(new)

    def term_postings(self, name: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All postings of the terms, and the one row of stats, over the live points' texts."""
        manifest, field = self.manifest(name), self.config(name).bm25_text_field
        fresh, kept = self._changed(name, manifest, "terms")
        texts = fresh.select("id", text_of(F.col("payload"), field).alias("text"))
        new, lengths = lexical.wanted_postings(texts, terms), lexical.lengths(texts)
        if kept is not None:
            new = kept.join(terms.select("term").distinct(), "term", "left_semi").select(*new.columns).unionByName(new)
            lengths = self._changed(name, manifest, "lengths")[1].select("id", "length").unionByName(lengths)
        return new, lexical.length_stats(lengths)

    def reindex(self, name: str, lists: int) -> int:
        """Writes inverted lists of the live points, by list, for approximate search; the number of points."""
        config, manifest = self.config(name), self.manifest(name)
        points = self._points(name, manifest).select("id", "values")
        folder = f"index/{uuid.uuid4().hex}"
        index = dense.Ivf.build(points, lists, config.metric)
        index.save(str(self._path(name, folder)))
        self._put({"centroids": index.centroids.tolist()}, name, folder, "centroids.json")
        # later changes of these points are in log folders that come after, or in a base made of them
        self.commit(name, lambda now: now | {"index": {"folder": folder, "lists": lists, "covered": manifest["logs"], "base": manifest["base"]}})
        return self.spark.read.parquet(str(self._path(name, folder, "lists"))).select("id").distinct().count()

    def index(self, name: str):
        """The inverted lists, the ids that changed since, and the live points among them; None without lists of this base."""
        manifest = self.manifest(name)
        own = manifest["index"]
        if not own or own["base"] != manifest["base"]:
            return None
        since = [x for x in manifest["logs"] if x not in own["covered"]]
        log = self._logged(name, since)
        lists = dense.Ivf.load(self.spark, str(self._path(name, own["folder"])), self._read(name, own["folder"], "centroids.json")["centroids"], self.config(name).metric)
        return lists, log.select("id").distinct(), mutations.fold(log)

    def checkpoint(self, name: str, id: str) -> None:
        """Marks that the log before this point is in the snapshot `id`."""
        self.commit(name, lambda now: now | {"checkpoint": id})

    def snapshot(self, name: str) -> str:
        """Folders never change, so a snapshot is the manifest of the moment."""
        id = f"snap-{int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}"
        self._put(self.manifest(name) | {"id": id, "created_at_ms": int(time.time() * 1000)}, name, "snapshots", f"{id}.json")
        return id

    def snapshots(self, name: str) -> list[dict]:
        """Newest first."""
        place = self._path(name, "snapshots")
        if not self._fs.exists(place):
            return []
        files = (s.getPath().getName() for s in self._fs.listStatus(place))
        found = [self._read(name, "snapshots", f) for f in files if f.endswith(".json") and not f.startswith(".")]
        return sorted(found, key=lambda s: (-s["created_at_ms"], s["id"]))

    def delete_snapshot(self, name: str, id: str) -> None:
        self._fs.delete(self._path(name, "snapshots", f"{id}.json"), False)

    def restore(self, name: str, id: str) -> int:
        if not self._fs.exists(self._path(name, "snapshots", f"{id}.json")):
            raise InvalidRequest(f"no snapshot {id} of {name}")
        kept = self._read(name, "snapshots", f"{id}.json")
        self.commit(name, lambda now: now | {k: kept[k] for k in ("base", "logs", "done", "index")})
        return self.points(name).count()

    def copy(self, name: str, target: Store) -> bool:
        """The collection's live points in another store; False if it has a collection of this name."""
        if name in target.names():
            return False
        target.create(self.config(name))
        target.append(name, "upsert", self.points(name).select("id", "values", "payload", "sparse"))
        return True


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points from JSON lines: id, vector or values, payload (object), sparse (an object of index to weight, or indices and values)."""
    raw = spark.read.schema("id string, vector array<float>, values array<float>, payload string, sparse string").json(path)
    lists = F.from_json("sparse", "struct<indices:array<bigint>, values:array<float>>")
    pairs = F.map_entries(F.from_json("sparse", "map<string,float>"))
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(p["key"].cast("long").alias("index"), p["value"].alias("weight"))))
    by_index = F.struct(F.transform(ordered, lambda p: p["index"]).alias("indices"), F.transform(ordered, lambda p: p["weight"]).alias("values"))
    sparse = F.when(F.get_json_object("sparse", "$.indices").isNotNull(), lists).when(F.col("sparse").isNotNull(), by_index)
    return raw.select("id", F.coalesce("values", "vector").alias("values"), "payload", sparse.alias("sparse"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """id, title, topic, text of each .md file: the first line is the title, the file's name the topic."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1)
    rows = files.select(name.alias("id"), F.trim(F.regexp_replace(F.split("value", "\n")[0], r"^#+", "")).alias("title"), F.regexp_replace(name, "[-_]+", " ").alias("topic"), F.col("value").alias("text"))
    return rows.where(~F.col("id").rlike("^[._]") & (F.trim("text") != ""))

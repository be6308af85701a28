"""Readers and writers of the dataset's file layout: <location>_<sublocation>/<uid>/<year>/<uid>_<year>..."""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from ..operators.resample import STRATEGIES
from ..session import ship

KEYS = ["location", "sublocation", "uid", "year"]
CHANNELS = ["GCC", "RCC", "BCC"]
#: Tasks that list the folders of a root.
LISTERS = 64
#: Tasks that write small files.
WRITERS = 64
_FOLDER = r"/([^/_]+)_([^/]+)/([^/]+)/([^/]+)/[^/]+$"


def folder_keys(path: Column) -> list[Column]:
    """location, sublocation, uid and year from a file's folders."""
    return [F.regexp_extract(path, _FOLDER, i).alias(k) for i, k in enumerate(KEYS, 1)]


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders below a root are listed by a stated number of tasks; Spark's own bound makes a task of nearly each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(int(old), max(LISTERS, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _load(spark: SparkSession, kind: str, paths: str | list[str], **options) -> DataFrame:
    """Files of a kind, however deep below the paths."""
    with _listing(spark):
        return spark.read.format(kind).options(recursiveFileLookup=True, **options).load(paths)


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``keys, path, body``: whole files of a name below the root; folders without "_" are no sites."""
    files = _load(spark, "text", str(root), wholetext=True, pathGlobFilter=name)
    path = F.col("_metadata.file_path")
    return files.select(*folder_keys(path), F.element_at(F.split(path, "/"), -1).alias("file"), F.col("value").alias("body")).where(F.col("location") != "")


def _csv(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``path, header, fields``: one row a line of the CSV files of a name below the root, with its file's own header.

    Files of one name may differ in their columns and in the order of these; :func:`named` takes a field by its name.
    Fields are numbers, dates and words: none is quoted over a comma. A file without a line has one row of null fields.
    """
    files = _load(spark, "text", str(root), wholetext=True, pathGlobFilter=name)
    lines = F.filter(F.split(F.col("value"), "\r?\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.transform(F.split(line, ",", -1), lambda x: F.trim(F.trim(x), F.lit('"')))
    parted = files.select(F.col("_metadata.file_path").alias("path"), lines.alias("lines")).where(F.size("lines") > 0)
    parted = parted.select("path", cells(F.col("lines")[0]).alias("header"), F.explode_outer(F.slice("lines", 2, F.size("lines"))).alias("line"))
    return parted.select("path", "header", cells(F.col("line")).alias("fields"))


def named(column: str) -> Column:
    """The field below a header's name; null where the file has no such column or the field is empty."""
    place = F.array_position("header", F.lit(column)).cast("int")
    return F.nullif(F.when(place > 0, F.get("fields", place - 1)), F.lit(""))


def number(text: Column) -> Column:
    """Text as a double; NaN and what is no number as null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def channel_columns(suffix: str | None) -> dict[str, str]:
    """Channel -> its column for a region suffix."""
    return {c: f"{c}_s{suffix}" if suffix else c for c in CHANNELS}


def read_observations(spark: SparkSession, root: str, suffixes: tuple[str | None, ...] = (None, "33")) -> DataFrame:
    """``keys, ts, header`` and for each suffix GCC, RCC, BCC and brightness, by the names in each file's header.

    What a file lacks is null; ``header`` tells what it has. A file without observations has one row without a time.
    """
    columns = [f"{c}_s{s}" if s else c for s in dict.fromkeys(suffixes) for c in [*CHANNELS, "brightness"]]
    rows = _csv(spark, root, "*_raw-cc-data.csv")
    time = F.try_to_timestamp(F.get("fields", F.lit(0)), F.lit("yyyy-MM-dd_HHmm")).cast("timestamp_ntz")  # the index comes first
    return rows.select(*folder_keys(F.col("path")), time.alias("ts"), "header", *[number(named(c)).alias(c) for c in columns]).where(F.col("location") != "")


def read_json_maps(spark: SparkSession, root: str, ending: str, kind: str = "map<string,string>") -> DataFrame:
    """``keys, file, fields``: JSON objects of files that end so, as text (nested values stay JSON) or, with
    ``map<string,variant>``, as values that know their types."""
    return _texts(spark, root, f"*{ending}").withColumn("fields", F.from_json("body", kind)).drop("body")


def read_product(spark: SparkSession, root: str, channel: str, window: str, kind: str = "product", columns: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """``keys, date, doy, header`` and ``columns`` of product (or smoothed) files of a channel and window, by name."""
    rows = _csv(spark, root, f"*-{channel}-{window}-{kind}.csv")
    date = F.get("fields", F.lit(0)).try_cast("date")
    rows = rows.select(*folder_keys(F.col("path")), date.alias("date"), F.dayofyear(date).alias("doy"), "header", *[number(named(c)).alias(c) for c in columns])
    return rows.where((F.col("location") != "") & F.col("date").isNotNull())


def read_profiles(spark: SparkSession, root: str, window: str = "3D", strategy: str = "p90", channel: str = "GCC") -> DataFrame:
    """``keys, doy, value`` of smoothed files: the first of the names that a strategy's column has had which a file has."""
    # Names of a smoothed column in older and newer files.
    names = (f"{channel}-{window}-{strategy}_model", f"{channel}-{window}-{strategy}", strategy)
    rows = read_product(spark, root, channel, window, "smoothed", names)
    value = None
    for n in names:
        has = F.array_contains("header", n)
        value = F.when(has, F.col(f"`{n}`")) if value is None else value.when(has, F.col(f"`{n}`"))
    return rows.select(*KEYS, "doy", value.alias("value")).where(F.col("value").isNotNull())


def read_snow(spark: SparkSession, root: str) -> DataFrame:
    """``location, date, snow`` of all daily flags."""
    rows = _csv(spark, root, "*-daily_snow_flag.csv")
    place = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return rows.select(place.alias("location"), F.get("fields", F.lit(0)).try_cast("date").alias("date"), number(named("snow")).cast("int").alias("snow")).where(F.col("date").isNotNull())


def _table(spark: SparkSession, path: str, **kinds: str) -> DataFrame:
    """A CSV table by its header: the named columns cast, in this order."""
    read = spark.read.option("header", True).csv(str(path))
    return read.select(*[F.nullif(F.trim(f"`{c}`"), F.lit("")).try_cast(k).alias(c) if k != "string" else F.col(f"`{c}`") for c, k in kinds.items()])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records table: identity and other words as strings, ``year`` as an integer, metrics (their names hold a "-") as doubles."""
    read = spark.read.option("header", True).csv(str(path))
    kind = lambda c: number(F.col(f"`{c}`")) if "-" in c else F.col(f"`{c}`").try_cast("int") if c == "year" else F.col(f"`{c}`")
    return read.select(*[kind(c).alias(c) for c in read.columns])


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """``ID`` (a string, whatever it looks like), ``Location, Elevation`` of the sites."""
    return _table(spark, path, ID="string", Location="string", Elevation="double")


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Means of the observers' network: ``species, year, elevation_band, spn_up, spn_down``."""
    return _table(spark, path, species="string", year="int", elevation_band="string", spn_up="double", spn_down="double")


def read_visual(spark: SparkSession, path: str) -> DataFrame:
    """``full_name`` and the day of each visual phase, the columns that end in "_mid"."""
    names = [c for c in spark.read.option("header", True).csv(str(path)).columns if c.endswith("_mid")]
    return _table(spark, path, full_name="string", **dict.fromkeys(names, "double"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(str(path)).select(F.col("uid").cast("string"), F.col("year").cast("int")).distinct()


def read_uids(spark: SparkSession, path: str) -> DataFrame:
    """``annotation_id, uid``."""
    body = spark.read.text(str(path), wholetext=True)
    return body.select(F.explode(F.from_json("value", "map<string,string>")).alias("annotation_id", "uid"))


# The fields of a region in polygon files.
_ROI = "map<string,struct<name:string,coords:array<array<double>>,category:string,genus:string,species:string,mix:string,type:string>>"


def read_polygons(spark: SparkSession, config: str, folder: str, hashes: dict[str, str] | None = None) -> DataFrame:
    """One row a region: ``location, sublocation, year, annotation_id`` and its fields.

    ``config`` maps sites and years to polygon files; entries whose file is missing have no rows. Sites that are no
    stations are renamed through ``hashes`` (name -> folder), their sublocation then is 1.
    """
    listed = spark.read.text(str(config), wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("site", "years"))
    listed = listed.select("site", F.explode("years").alias("year", "file"))
    bodies = spark.read.option("pathGlobFilter", "*.json").text(str(folder), wholetext=True)
    bodies = bodies.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", _ROI).alias("rois"))
    rows = listed.join(bodies, "file").select("site", "year", F.explode("rois").alias("annotation_id", "roi"))
    renamed = None
    for name, folder_name in (hashes or {}).items():
        hit = (F.col("site") == name) & ~X.is_station(F.col("site"))
        renamed = F.when(hit, F.lit(f"{folder_name}_1")) if renamed is None else renamed.when(hit, F.lit(f"{folder_name}_1"))
    site = F.col("site") if renamed is None else renamed.otherwise(F.col("site"))
    place = F.split(site, "_", 2)
    return rows.select(place[0].alias("location"), F.get(place, 1).alias("sublocation"), "year", "annotation_id", "roi.*")


#: Pictures as files, before any is opened; and decoded.
_LISTED = "location string, sublocation string, year string, path string, ts timestamp_ntz"
_PICTURES = f"{_LISTED}, height int, width int, data binary"


def folders(spark: SparkSession, root: str, units: DataFrame) -> list[str]:
    """The folders <location>/<sublocation>/<year> below the root that the units have and that exist: looked for one by one
    in tasks, so that nothing else of the archive is listed. One row a site-year comes to the driver."""
    ship(spark)
    root = str(root)

    def there(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = open_store(root)
        for batch in batches:
            found = [store.get_file_info(f"{base}/{f}").type == fs.FileType.Directory for f in batch.folder]
            yield batch[found]

    named = units.select(F.concat_ws("/", "location", "sublocation", "year").alias("folder")).distinct()
    return sorted(r.folder for r in named.mapInPandas(there, "folder string").collect())


def _below(root: str, only: list[str] | None) -> list[str]:
    """Paths to load: the root, or folders below it; signs with a meaning in patterns are taken as they are."""
    return [str(root)] if only is None else [f"{root}/{re.sub(r'([][{}*?])', lambda m: chr(92) + m[1], f)}" for f in only]


def list_pictures(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """``location, sublocation, year, path, ts`` of all pictures, from their paths alone: no file is opened.

    The archive is <location>/<sublocation>/<year>/<month>/<day>/<file>. Files of other kinds and names without a time
    have no row. With ``only``, folders <location>/<sublocation>/<year>, these alone are listed, many of them by a job.
    """
    if only is not None and not only:
        return spark.createDataFrame([], _LISTED)
    files = _load(spark, "binaryFile", _below(root, only)).select("path", F.col("_metadata.file_path").alias("file"))
    rows = files.where(X.is_picture(F.col("path"))).select(*_archive_keys(F.col("path")), F.col("file").alias("path"), X.picture_time(F.col("path")).alias("ts"))
    return rows.where(F.col("ts").isNotNull())


def _archive_keys(path: Column) -> list[Column]:
    parts = F.split(path, "/")
    return [F.try_element_at(parts, F.lit(-i)).alias(k) for k, i in (("location", 6), ("sublocation", 5), ("year", 4))]


def read_pictures(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """``location, sublocation, year, path, ts, height, width, data`` of all readable pictures (BGR bytes, row by row).

    As :func:`list_pictures`, and unreadable files have no row. With ``only``, files elsewhere are neither listed, opened
    nor decoded.
    """
    if only is not None and not only:
        return spark.createDataFrame([], _PICTURES)
    raw = _load(spark, "image", _below(root, only), dropInvalid=True)
    file, path = F.col("_metadata.file_path"), F.col("image.origin")
    rows = raw.where(X.is_picture(file) & (F.col("image.nChannels") == 3))
    rows = rows.select(*_archive_keys(path), file.alias("path"), X.picture_time(path).alias("ts"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data"))
    return rows.where(F.col("ts").isNotNull())


def shape_of(head: bytes) -> tuple[int, int] | None:
    """Height and width that the first bytes of a JPEG, PNG or JPEG 2000 file tell; none if they tell none."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        width, height = struct.unpack_from(">II", head, 16)
        return height, width
    if head[4:8] == b"jP  " and (at := head.find(b"ihdr")) >= 0 and len(head) >= at + 12:
        return struct.unpack_from(">II", head, at + 4)
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(head) and head[at] == 0xFF:
        mark = head[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # start of a frame
            return struct.unpack_from(">HH", head, at + 5)
        at += 1 if mark == 0xFF else 2 + struct.unpack_from(">H", head, at + 2)[0]
    return None


#: Bytes of a picture that are read to learn its shape; all of it if they don't tell.
HEAD_BYTES = 64 << 10


def with_shapes(pictures: DataFrame) -> DataFrame:
    """Adds ``height`` and ``width`` to rows with a ``path``, from the files' first bytes; files that tell none have no row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pictures.schema) + ", height int, width int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = []
            for path in batch.path:
                store, name = open_store(path)
                try:
                    with store.open_input_file(name) as f:
                        head = f.read(HEAD_BYTES)
                        shapes.append(shape_of(head) or shape_of(head + f.read()) or (0, 0))
                except (OSError, struct.error):
                    shapes.append((0, 0))
            out = batch.assign(height=[h for h, _ in shapes], width=[w for _, w in shapes])
            yield out[(out.height > 0) & (out.width > 0)]

    ship(pictures.sparkSession)
    return pictures.mapInPandas(run, schema)


def open_store(root: str):
    """The file system of a path or URI, and the path in it: local, HDFS or an object store, on driver and workers alike."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", root):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root).replace(" ", "%20"))
    return fs.LocalFileSystem(), os.path.abspath(root)


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, as Spark's own readers and writers see it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return bool(system.exists(found))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, written by the driver."""
    found, system = _path(spark, path)
    stream = system.create(found, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """``df`` as one CSV file with a header, rows in order; null is an empty field, quotes are doubled."""
    _write_one(df.orderBy(*order), path, "csv", header=True, nullValue="", emptyValue="", escape='"')


def write_lines(df: DataFrame, path: str) -> None:
    """The one column of ``df`` as the sorted lines of a text file."""
    _write_one(df.orderBy(df.columns[0]), path, "text")


def _write_one(ordered: DataFrame, path: str, kind: str, **options) -> None:
    """Sorted and written by all tasks, in parts, which one task then copies into one file, piece by piece: neither it nor
    the driver holds the table. The file appears whole or not at all."""
    spark = ship(ordered.sparkSession)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    ordered.write.format(kind).options(**options).save(draft)
    folder, system = _path(spark, draft)
    parts = sorted(str(x.getPath().toString()) for x in system.listStatus(folder) if x.getPath().getName().startswith("part-"))
    target, _ = _path(spark, path)
    whole = f"{draft}/whole"
    header = bool(options.get("header"))

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names in batch.parts:
                store, name = open_store(whole)
                with store.open_output_stream(name) as out:
                    for i, part in enumerate(names):
                        source, at = open_store(part)
                        with source.open_input_stream(at) as f:
                            skip = header and i > 0  # a part's own header
                            while piece := f.read(8 << 20):
                                if skip:
                                    _, end, piece = piece.partition(b"\n")
                                    skip = not end
                                out.write(piece)
            yield pd.DataFrame({"n": [len(batch)]})

    spark.createDataFrame([(parts,)], "parts array<string>").mapInPandas(copy, "n long").collect()
    system.delete(target, False)
    if not system.rename(_path(spark, whole)[0], target):
        raise OSError(f"{path} can't be written")
    system.delete(folder, True)


def completed(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """``keys`` of the units that have a file with this ending; empty where the root doesn't exist yet."""
    if not exists(spark, root):
        return spark.createDataFrame([], T.StructType([T.StructField(k, T.StringType()) for k in KEYS]))
    files = _load(spark, "binaryFile", str(root), pathGlobFilter=f"*{ending}")
    return files.select(*folder_keys(F.col("path"))).where(F.col("location") != "").distinct()


def pending(units: DataFrame, done: DataFrame, force: bool = False, keys: list[str] | None = None) -> DataFrame:
    """The rows whose unit isn't done yet; all with ``force``."""
    return units if force else units.join(done, keys or KEYS, "left_anti")


def tree_path(ending: str | Column) -> Column:
    """Path of a unit's file below the root."""
    unit = F.concat(F.col("uid"), F.lit("_"), F.col("year").cast("string"))
    end = F.lit(ending) if isinstance(ending, str) else ending
    return F.concat(F.col("location"), F.lit("_"), F.col("sublocation"), F.lit("/"), F.col("uid"), F.lit("/"), F.col("year").cast("string"), F.lit("/"), unit, end)


def csv_body(header: list[str], order: str, values: list[Column]) -> Column:
    """Aggregate: a CSV file's text, rows in order; nulls are empty fields."""
    line = F.concat_ws(",", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda r: r["l"])
    return F.concat(F.lit(",".join(header) + "\n"), F.array_join(rows, "\n"), F.lit("\n"))


def write_observations(rows: DataFrame, columns: list[str], root: str) -> int:
    """One file a unit (``keys, ts`` and ``columns``), rows by time; returns their number."""
    body = csv_body(["datetime", *columns], "ts", [X.observation_key(F.col("ts")), *[F.col(c) for c in columns]])
    return write_files(rows.groupBy(*KEYS).agg(body.alias("body")).withColumn("path", tree_path("_raw-cc-data.csv")), root)


def write_files(files: DataFrame, root: str) -> int:
    """Writes ``path, body`` rows (text or bytes) below a root in any store that the workers reach; returns their number.

    A file appears whole or not at all (it is moved into place), so a task that runs again does no harm.
    """
    ship(files.sparkSession)
    root = str(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        for batch in batches:
            for path, body in zip(batch.path, batch.body, strict=True):
                target = f"{base}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(draft) as f:
                    f.write(body.encode("utf-8") if isinstance(body, str) else bytes(body))
                try:
                    store.move(draft, target)
                except OSError:  # a store that doesn't replace files
                    store.delete_file(target)
                    store.move(draft, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "body").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

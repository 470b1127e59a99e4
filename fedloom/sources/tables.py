"""Reading, landing, publishing and merging datasets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_size
from ..operators.columns import q, require
from ..operators.profile import profile

FORMATS = ("csv", "parquet")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A CSV with header (types inferred unless a schema is given) or Parquet, from any file system URI."""
    if fmt == "csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    raise ValueError(f"unsupported file type {fmt!r}, expected one of {FORMATS}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write Parquet; a ``.csv`` name becomes ``.parquet``."""
    target = path[: -len(".csv")] + ".parquet" if path.endswith(".csv") else path
    df.write.mode(mode).parquet(target)
    return target


def ingest_dataset(spark: SparkSession, source: str, fmt: str, raw_dir: str) -> tuple[DataFrame, str]:
    """Land a file in the raw zone; returns its profile and the landed path.

    The profile reads the landed columnar copy, so the source is parsed once.
    """
    landed = write_table(read_table(spark, source, fmt), f"{raw_dir.rstrip('/')}/{_base(source)}")
    return profile(spark.read.parquet(landed)), landed


def _base(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def publish_processed(df: DataFrame, name: str, processed_dir: str) -> tuple[DataFrame, str]:
    """Write a program's result under a fresh unique name; returns its profile and that name."""
    published = f"{name}_{uuid.uuid4().hex}.parquet"
    path = write_table(df, f"{processed_dir.rstrip('/')}/{published}")
    return profile(df.sparkSession.read.parquet(path)), published


def merge_datasets(parent: DataFrame, extra: DataFrame) -> DataFrame:
    """Union by column name, missing columns NULL; refused when either side is empty."""
    if parent.isEmpty() or extra.isEmpty():
        raise ValueError("a dataset to merge is empty")
    return parent.unionByName(extra, allowMissingColumns=True)


def merge_swap(spark: SparkSession, parent_path: str, extra_path: str, staging_dir: str | None = None) -> DataFrame:
    """Merge ``extra_path`` into ``parent_path`` and return the new profile.

    The merged rows go to a staging folder first, because the parent is being
    read.  The swap is two renames, with the old data kept until the new data
    is in place.
    """
    merged = merge_datasets(spark.read.parquet(parent_path), spark.read.parquet(extra_path))
    # without a folder given, beside the parent: a rename stays within one file system
    base = f"{staging_dir.rstrip('/')}/{_base(parent_path)}" if staging_dir else f"{parent_path.rstrip('/')}.staging"
    staging = f"{base}-{uuid.uuid4().hex}"
    try:
        merged.write.mode("errorifexists").parquet(staging)
        _swap(spark, staging, parent_path)
    except Exception:
        path = spark._jvm.org.apache.hadoop.fs.Path(staging)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        raise
    spark.catalog.refreshByPath(parent_path)
    return profile(spark.read.parquet(parent_path))


def _swap(spark: SparkSession, new: str, target: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{target.rstrip('/')}.replaced-{uuid.uuid4().hex}"
    if not fs.rename(path(target), path(old)):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(path(new), path(target)):
        fs.rename(path(old), path(target))
        raise OSError(f"cannot move the merged data to {target}")
    fs.delete(path(old), True)


def storage_inventory(spark: SparkSession, base: str) -> DataFrame:
    """Bytes, files and display size per entry below ``base``; file contents are not read.

    The file system counts each entry as a whole, with hidden files and empty
    folders; the driver holds one line per entry.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in fs.listStatus(path):
        whole = fs.getContentSummary(entry.getPath())
        found.append((entry.getPath().getName(), "DIRECTORY" if entry.isDirectory() else "FILE", whole.getLength(), whole.getFileCount()))
    entries = spark.createDataFrame(found, "dataset string, type string, bytes long, files long")
    return entries.withColumn("size", human_size(F.col("bytes")))


def export_features(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], path: str | None = None) -> DataFrame:
    """Inputs then targets for training; written as Parquet when a path is given."""
    require(df, [*outputs, *inputs])
    chosen = df.select(*[q(c) for c in [*inputs, *outputs]])
    if path is None:
        return chosen
    chosen.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# Fixed value: the folder of a session that holds what its clients sent.
SUBMITTED = "local"
METADATA_SCHEMA = "client_id long, submission_time string, user_id long, round_number int"


# Hadoop's name of a file system, where Arrow's is another; and of a folder or file without a key.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_client_files(documents: DataFrame, root: str) -> None:
    """``<client>.json`` beside ``<client>_metadata.json`` in the ``local`` folder of each session, as ``read_client_params`` reads them.

    ``documents`` holds ``session_id, client_id, parameters, metadata``, both documents as JSON text; those of one
    session and client go to one file, as its lines.  The tasks write the files, through Arrow's file systems.  A file
    gets its name when it is whole, so a task can be repeated.
    """
    spark = documents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    scheme = ARROW_SCHEMES.get(whole.getScheme(), whole.getScheme())
    base = f"{scheme}://{whole.getAuthority() or ''}{whole.getPath()}"
    session = F.coalesce(F.col("session_id").cast("string"), F.lit(NO_KEY)).alias("session")
    client = F.col("client_id").cast("string")
    both = documents.select(session, F.explode(F.array(
        F.struct(F.coalesce(client, F.lit(NO_KEY)).alias("name"), F.col("parameters").alias("text")),
        F.struct(F.coalesce(F.concat(client, F.lit("_metadata")), F.lit(NO_KEY)).alias("name"), F.col("metadata").alias("text")),
    )).alias("file")).select("session", "file.*")
    both.repartition("session", "name").sortWithinPartitions("session", "name", "text").foreachPartition(lambda rows: _write_files(rows, base))


def _write_files(rows: Iterator[Row], base: str) -> None:
    """One file for each run of rows with the same session and name."""
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(base)
    made = set()
    for (session, name), lines in groupby(rows, lambda r: (r["session"], r["name"])):
        folder = f"{root}/{session}/{SUBMITTED}"
        if folder not in made:
            fs.create_dir(folder, recursive=True)
            made.add(folder)
        unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(unfinished) as out:
            for line in lines:
                out.write(f"{line['text']}\n".encode())
        fs.move(unfinished, f"{folder}/{name}.json")


def read_client_params(spark: SparkSession, root: str, round_number: int | None = None, layout: str = "files") -> DataFrame:
    """Client parameter documents joined with their metadata, optionally of one round.

    ``layout="files"`` reads ``<client>.json`` beside ``<client>_metadata.json``, in a folder
    for each session or in its ``local`` folder.
    ``layout="lines"`` reads JSON lines with a ``client_id`` field from
    ``params/`` and ``metadata/``, the form for many clients: it needs no file
    per client.  One row per session and client: ``client_id, round_number,
    submission_time, parameters`` (JSON text), ``session_id``: the name of the
    folder with the client's files, or the field of that name in the lines.
    """
    keys = ["session_id", "client_id"]
    if layout == "lines":
        parameters = spark.read.schema("session_id string, client_id long, parameters string").json(f"{root}/params")
        metadata = spark.read.schema("session_id string, " + METADATA_SCHEMA).json(f"{root}/metadata")
    elif layout == "files":
        documents = (
            spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
            .select("value", F.col("_metadata.file_name").alias("file"), F.split(F.col("_metadata.file_path"), "/").alias("at"))
            # the submissions of a session may stand in a folder of their own below it
            .select("value", "file", F.when(F.element_at("at", -2) == SUBMITTED, F.element_at("at", -3)).otherwise(F.element_at("at", -2)).alias("session_id"))
        )
        number = F.regexp_extract("file", r"^(\d+)(?:_metadata)?\.json$", 1).try_cast("long")
        client = F.coalesce(number, F.raise_error(F.concat(F.lit("no client number: "), F.col("file"))).cast("long")).alias("client_id")
        is_metadata = F.col("file").endswith("_metadata.json")
        parsed = F.from_json("value", METADATA_SCHEMA.split(", ", 1)[1])
        metadata = documents.filter(is_metadata).select("session_id", client, parsed.alias("m")).select("session_id", "client_id", "m.*")
        parameters = documents.filter(~is_metadata).select("session_id", client, F.trim("value").alias("parameters"))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if round_number is not None:
        metadata = metadata.filter(F.col("round_number") == round_number)
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    joined = metadata.alias("m").join(parameters.alias("p"), same)
    return joined.select("m.client_id", "m.round_number", "m.submission_time", "p.parameters", "m.session_id")


def export_csv(df: DataFrame, path: str) -> str:
    """CSV files with header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path

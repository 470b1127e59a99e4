"""Datasets in versions: readers always find a whole one, and a merge costs what it adds.

A dataset is a folder of parts, which are never changed, and of version files ``_versions/<number>.json``, which name
the parts of a version, its schema and the stored profile state.  The newest version file is the pointer to what
readers see.  It appears by one rename, after all it names has been written.  Merging writes the new rows as one more
part and adds the states of both; nothing is read of the rows already there.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.columns import q
from ..operators.profile import profile_of_state
from ..operators.profile_state import merge_states, profile_state

VERSIONS = "_versions"


def _file_system(spark: SparkSession, path: str):
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def newest(spark: SparkSession, dataset: str) -> dict | None:
    """The current version: ``number``, ``parts``, ``schema``, ``state``; None where the folder holds no version."""
    fs, path_of = _file_system(spark, dataset)
    folder = path_of(f"{dataset.rstrip('/')}/{VERSIONS}")
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return None
    stream = fs.open(path_of(folder, f"{max(numbers)}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, dataset: str, version: dict) -> None:
    """Make a version the current one: its file is written under another name, then renamed."""
    fs, path_of = _file_system(spark, dataset)
    folder = f"{dataset.rstrip('/')}/{VERSIONS}"
    hidden, final = path_of(f"{folder}/.{uuid.uuid4().hex}"), path_of(f"{folder}/{version['number']}.json")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(json.dumps(version).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise OSError(f"version {version['number']} of {dataset} exists already: another writer was faster")


def _write(dataset: str, df: DataFrame, kind: str) -> str:
    name = f"{kind}-{uuid.uuid4().hex}"
    df.write.parquet(f"{dataset.rstrip('/')}/{name}")
    return name


def _rows(spark: SparkSession, dataset: str, parts: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{dataset.rstrip('/')}/{p}" for p in parts])


def create(spark: SparkSession, dataset: str, df: DataFrame) -> DataFrame:
    """Store a table as the first version of a dataset; returns its profile, which the state gives."""
    if newest(spark, dataset) is not None:
        raise ValueError(f"{dataset} holds a dataset already")
    part = _write(dataset, df, "part")
    rows = _rows(spark, dataset, [part], df.schema)
    state = _write(dataset, profile_state(rows).coalesce(1), "state")
    _publish(spark, dataset, {"number": 1, "parts": [part], "schema": df.schema.jsonValue(), "state": state})
    return profile_of(spark, dataset)


def _current(spark: SparkSession, dataset: str) -> tuple[dict, T.StructType]:
    version = newest(spark, dataset)
    if version is None:
        raise ValueError(f"{dataset} holds no dataset")
    return version, T.StructType.fromJson(version["schema"])


def read(spark: SparkSession, dataset: str) -> DataFrame:
    """The rows of the current version; a merge meanwhile does not touch them.  Columns a part lacks are NULL there."""
    version, schema = _current(spark, dataset)
    return _rows(spark, dataset, version["parts"], schema)


def profile_of(spark: SparkSession, dataset: str) -> DataFrame:
    """The current version's profile, from its stored state alone."""
    version, _ = _current(spark, dataset)
    return profile_of_state(spark.read.parquet(f"{dataset.rstrip('/')}/{version['state']}"))


def merge(spark: SparkSession, dataset: str, extra: DataFrame) -> DataFrame:
    """Add a table's rows by column name, missing columns NULL; returns the profile of the whole.

    Only ``extra`` is read.  Where a column the dataset has becomes wider by the merge (an int that meets a long, a
    long that meets a double), its parts are rewritten as one and profiled anew.  An empty ``extra`` is refused.
    """
    version, schema = _current(spark, dataset)
    if extra.isEmpty():
        raise ValueError("a dataset to merge is empty")
    united = spark.createDataFrame([], schema).unionByName(spark.createDataFrame([], extra.schema), allowMissingColumns=True).schema
    kinds = {f.name: f.dataType for f in united.fields}
    added = extra.select(*[q(f.name).cast(kinds[f.name]).alias(f.name) for f in extra.schema.fields])
    now = {"number": version["number"] + 1, "schema": united.jsonValue()}
    if all(kinds[f.name] == f.dataType for f in schema.fields):
        part = _write(dataset, added, "part")
        mine = _rows(spark, dataset, [part], T.StructType([f for f in united.fields if f.name in extra.columns]))
        state = merge_states(spark.read.parquet(f"{dataset.rstrip('/')}/{version['state']}"), profile_state(mine))
        now["parts"] = [*version["parts"], part]
    else:
        whole = _rows(spark, dataset, version["parts"], schema).unionByName(extra, allowMissingColumns=True)
        now["parts"] = [_write(dataset, whole, "part")]
        state = profile_state(_rows(spark, dataset, now["parts"], united))
    now["state"] = _write(dataset, state.coalesce(1), "state")
    _publish(spark, dataset, now)
    return profile_of(spark, dataset)


def compact(spark: SparkSession, dataset: str) -> None:
    """Rewrite the parts as one; readers of earlier versions go on with theirs."""
    version, schema = _current(spark, dataset)
    if len(version["parts"]) > 1:
        part = _write(dataset, _rows(spark, dataset, version["parts"], schema), "part")
        _publish(spark, dataset, version | {"number": version["number"] + 1, "parts": [part]})


def vacuum(spark: SparkSession, dataset: str, kept: int = 2) -> list[str]:
    """Remove what the last ``kept`` versions do not name; returns the names removed.  Not beside a running merge."""
    fs, path_of = _file_system(spark, dataset)
    base = dataset.rstrip("/")
    version, _ = _current(spark, dataset)
    used, old = set(), []
    for f in fs.listStatus(path_of(f"{base}/{VERSIONS}")):
        name = f.getPath().getName()
        if name.endswith(".json") and name[:-5].isdigit():
            if int(name[:-5]) > version["number"] - kept:
                stream = fs.open(f.getPath())
                named = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
                used |= {*named["parts"], named["state"]}
            else:
                old.append(f.getPath())
    for path in old:
        fs.delete(path, False)
    gone = [f.getPath() for f in fs.listStatus(path_of(base)) if f.getPath().getName().split("-")[0] in ("part", "state") and f.getPath().getName() not in used]
    for path in gone:
        fs.delete(path, True)
    return sorted(p.getName() for p in gone)

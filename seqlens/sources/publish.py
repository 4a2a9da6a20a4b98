"""Publication of tables: readers see the old state or the new one, whatever fails between.

A table is written to a folder of its own under the path, validated as it was written, and named in a manifest that replaces the one before by a rename. A failed or lost job leaves a folder that no manifest names; running it again writes another.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "_current.json"


def publish(df: DataFrame, path: str, validate: Callable[[DataFrame], None] = lambda written: None, by: tuple[str, ...] = (), form: str = "parquet") -> dict:
    """Write df in a form (partitioned by `by`), validate what was written (an exception refuses it) and make it the current state. Returns the manifest: version, form, rows, schema, previous."""
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    df.write.format(form).partitionBy(*by).save(f"{path}/{version}")
    written = spark.read.format(form).schema(df.schema).load(f"{path}/{version}")
    validate(written)
    before = manifest(path)
    found = {"version": version, "form": form, "rows": written.count(), "schema": df.schema.jsonValue(), "previous": before["version"] if before else None}
    store, folder = fs.FileSystem.from_uri(path)
    staged = f"{folder}/_staged-{version}.json"
    with store.open_output_stream(staged) as out:
        out.write(json.dumps(found).encode())
    store.move(staged, f"{folder}/{MANIFEST}")
    return found


def replace_folder(write: Callable[[str], None], validate: Callable[[str], None], path: str) -> None:
    """Write to a folder beside path, validate it, then let it take the place of path by renames. What fails before them leaves path as it was."""
    mark = uuid.uuid4().hex
    staged = f"{path}.staged-{mark}"
    store, folder = fs.FileSystem.from_uri(path)
    try:
        write(staged)
        validate(staged)
    except BaseException:
        store.delete_dir(f"{folder}.staged-{mark}") if store.get_file_info(f"{folder}.staged-{mark}").type == fs.FileType.Directory else None
        raise
    was = store.get_file_info(folder).type == fs.FileType.Directory
    if was:
        store.move(folder, f"{folder}.old-{mark}")
    store.move(f"{folder}.staged-{mark}", folder)
    if was:
        store.delete_dir(f"{folder}.old-{mark}")


def manifest(path: str) -> dict | None:
    """The manifest of the current state; None if nothing was published."""
    store, folder = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{folder}/{MANIFEST}") as source:
        return json.loads(source.read())


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current state."""
    found = manifest(path)
    if found is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.format(found["form"]).schema(StructType.fromJson(found["schema"])).load(f"{path}/{found['version']}")

"""JSON documents in files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions.json import json_or_null


def json_documents(wanted: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Adds payload (variant) to wanted names of files in a folder: null where the file is missing or malformed."""
    read = wanted.sparkSession.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    found = read.select(F.col("_metadata.file_name").alias(name), json_or_null(F.col("value")).alias("payload"))
    return wanted.join(found, name, "left")

"""Reports as JSON: one object per row, absent values written as null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Times are written to the microsecond, in UTC.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
}


def json_lines(report: DataFrame) -> DataFrame:
    """The rows of a report as JSON texts (column ``value``)."""
    return report.select(
        F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"} | TIME_FORMATS).alias("value")
    )


def write_json(report: DataFrame, path: str) -> None:
    json_lines(report).write.mode("overwrite").text(path)

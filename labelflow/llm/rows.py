"""Identity of a row by its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_identity(df: DataFrame) -> Column:
    """md5 over all columns, each with its length or the mark of a missing value.

    Values cannot run into each other and a null is told from every value, so two rows share it only if they are
    equal (nested columns go by their JSON, nulls kept).
    """
    parts = []
    for field in df.schema:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        nested = field.dataType.typeName() in ("array", "map", "struct", "variant")
        text = F.to_json(F.struct(column), {"ignoreNullFields": "false"}) if nested else column.cast("string")
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.when(column.isNull(), F.lit("-")).otherwise(sized))
    return F.md5(F.concat(*parts)) if parts else F.lit("")

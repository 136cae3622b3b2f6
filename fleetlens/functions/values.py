"""Normal forms of variable names and values, and sizes and names of backup files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(name: Column) -> Column:
    return F.translate(F.btrim(name), "-", "_")


def norm_value(value: Column) -> Column:
    """Upper case, with ON and TRUE, OFF and FALSE as one value each."""
    upper = F.upper(value)
    return F.when(upper.isin("ON", "TRUE"), "ON").when(
        upper.isin("OFF", "FALSE"), "OFF").otherwise(upper)


_SIZE = r"^\s*(\d+(?:\.\d+)?)\s*([KMGTP]?)i?B?\s*$"


def parse_size(text: Column) -> Column:
    """Bytes of a human size such as 12K or 1.5G (first tab field); NULL if unreadable."""
    field = F.substring_index(text, "\t", 1)
    number = F.when(field.rlike(_SIZE), F.regexp_extract(field, _SIZE, 1)
                    .try_cast("decimal(20,6)"))
    unit = F.regexp_extract(field, _SIZE, 2)
    power = (F.when(unit == "K", F.lit(1 << 10)).when(unit == "M", F.lit(1 << 20))
             .when(unit == "G", F.lit(1 << 30)).when(unit == "T", F.lit(1 << 40))
             .when(unit == "P", F.lit(1 << 50)).otherwise(F.lit(1)).cast("bigint"))
    return (number * power.cast("decimal(17,0)")).try_cast("bigint")


def backup_file_name(directory: Column, port: Column, started: Column,
                     backup_type: Column) -> Column:
    """dir/port/yyyymmdd/type-yyyymmdd_hhmmss.xbstream"""
    return F.concat(F.rtrim(directory, F.lit("/")), F.lit("/"), port.cast("string"),
                    F.lit("/"), F.date_format(started, "yyyyMMdd"), F.lit("/"), backup_type,
                    F.lit("-"), F.date_format(started, "yyyyMMdd_HHmmss"),
                    F.lit(".xbstream"))

"""Classification of locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes of remote stores.
REMOTE = ("s3://", "gcs://", "azure://")


def is_remote(uri: Column) -> Column:
    return F.coalesce(F.regexp_like(uri, F.lit("^(" + "|".join(REMOTE) + ")")), F.lit(False))


def scheme(uri: Column) -> Column:
    """The scheme in lower case; empty for plain paths and drive letters."""
    found = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(F.length(found) < 2, F.lit("")).otherwise(found)


def is_local(uri: Column) -> Column:
    return scheme(uri).isin("", "file")


def hadoop_options(settings: dict[str, str]) -> dict[str, str]:
    """Store settings (endpoint, key, secret, token, region) as Hadoop options for s3a."""
    names = {"endpoint": "endpoint", "key": "access.key", "secret": "secret.key", "token": "session.token", "region": "endpoint.region"}
    return {f"spark.hadoop.fs.s3a.{names[k]}": v for k, v in settings.items() if k in names and v}

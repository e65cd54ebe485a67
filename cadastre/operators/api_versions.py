"""API versions in import and resource paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a provider namespace and a version look like in a path.
API_PROVIDER = r"providers/([\w.]*)/"
API_VERSION = r"/(\d{4}-\d{2}-\d{2}(?:-preview)?)/"
HANDLE = r"(?i)^github\.com/[a-z0-9-_]+$"
ADDRESS = r"^(?:[^<>@]*<[^\s<>@]+@[^\s<>@]+>|[^\s<>@]+@[^\s<>@]+)$"
VERSION_KEY = ["module", "service", "version"]


def extract_versions(paths: DataFrame, modules: dict[str, str], column: str = "import_path") -> DataFrame:
    """Distinct (module, service, version), lower-cased, of paths below known modules.

    ``modules`` maps a module to a pattern with two groups, service and version.
    Paths repeat far more often than they differ, so they are folded before any
    pattern is tried.
    """
    hits = F.array(
        *(
            F.when(
                F.contains(column, F.lit(module)) & F.regexp_like(column, F.lit(pattern)),
                F.struct(
                    F.lit(module).alias("module"),
                    F.lower(F.regexp_extract(column, pattern, 1)).alias("service"),
                    F.lower(F.regexp_extract(column, pattern, 2)).alias("version"),
                ),
            )
            for module, pattern in modules.items()
        )
    )
    return paths.select(column).distinct().select(F.inline(F.array_compact(hits))).distinct()


def preview_not_excepted(versions: DataFrame, *exceptions: DataFrame) -> DataFrame:
    """Preview versions in use that no exception list names."""
    out = versions.where(F.col("version").endswith("-preview"))
    for rows in exceptions:
        out = out.join(rows.select(*VERSION_KEY), VERSION_KEY, "left_anti")
    return out


def unused_exceptions(exceptions: DataFrame, versions: DataFrame) -> DataFrame:
    """Exceptions that match no version in use."""
    return exceptions.join(versions.select(*VERSION_KEY), VERSION_KEY, "left_anti")


def validate_exceptions(exceptions: DataFrame) -> DataFrame:
    """Check target date and responsible person of current exceptions.

    Historical rows need neither. That both must be given is inferred.
    """
    date, owner = F.col("stableVersionTargetDate"), F.col("responsibleIndividual")
    good_date = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date, "yyyy-MM-dd").isNotNull()
    good_owner = owner.rlike(ADDRESS) | owner.rlike(HANDLE)
    return exceptions.select(
        "*",
        (F.col("historical") | F.coalesce(good_date, F.lit(False))).alias("valid_date"),
        (F.col("historical") | F.coalesce(good_owner, F.lit(False))).alias("valid_owner"),
    )


def rewrite_api_version(paths: DataFrame, service: str, old: str, new: str, column: str = "import_path") -> DataFrame:
    """Changed rows only, with ``service/old`` as ``service/new`` in a column ``rewritten``."""
    segment = f"/{service}/{old}"
    at = F.col(column)
    pattern = rf"/\Q{service}\E/\Q{old}\E(?=/|$)"
    return paths.where(F.contains(at, F.lit(segment))).withColumn(
        "rewritten", F.regexp_replace(at, pattern, f"/{service}/{new}")
    ).where(F.col("rewritten") != at)


def apis_by_resource(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct (resource, api, version) of resource-manager paths."""
    return (
        paths.select(
            "resource",
            F.regexp_extract(column, API_PROVIDER, 1).alias("api"),
            F.regexp_extract(column, API_VERSION, 1).alias("version"),
        )
        .where("api <> '' AND version <> ''")
        .distinct()
    )

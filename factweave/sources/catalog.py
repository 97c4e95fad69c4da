"""Dataset catalog and loader. A missing dataset raises; rows are never made up."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from factweave.operators.selection import DATE_COLUMNS, apply_filters


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    layer: str
    domains: tuple[str, ...]
    path: str
    format: str = "parquet"


# --- fixed values: layers and domains of the stored datasets -----------------
OPERATIONAL_DOMAINS = ("Commerce", "Fintech", "Ecosystem", "Ads", "Logistics")
DATASETS = {d.dataset_id: d for d in (
    Dataset("market_capitalization", "Gold", ("Market",), "gold/market_capitalization"),
    Dataset("financial_facts", "Silver", ("Financial",), "silver/financial_facts"),
    Dataset("market_prices", "Silver", ("Market",), "silver/market_prices"),
    Dataset("operational_kpis", "Silver", OPERATIONAL_DOMAINS, "silver/operational_kpis"),
    Dataset("extended_operational_kpis", "Silver", OPERATIONAL_DOMAINS, "silver/extended_operational_kpis"),
    Dataset("extended_operational_evidence", "Silver", OPERATIONAL_DOMAINS, "silver/extended_operational_evidence"),
    Dataset("macro_indicators", "Silver", ("Macro",), "silver/macro_indicators"),
    Dataset("macro_analytics", "Gold", ("Macro",), "gold/macro_analytics"),
    Dataset("macro_evidence", "Gold", ("Macro",), "gold/macro_evidence"),
    Dataset("evidence_registry", "Gold", (), "gold/evidence_registry"),
    Dataset("interpretations", "Gold", (), "gold/interpretations"),
    Dataset("pestel", "Gold", (), "gold/pestel"),
    Dataset("swot", "Gold", (), "gold/swot"),
    Dataset("product_evidence", "Gold", ("Ecosystem",), "gold/product_evidence"),
)}


class DatasetMissing(FileNotFoundError):
    pass


class DatasetInvalid(ValueError):
    """The dataset exists and cannot be read."""


def load(spark: SparkSession, dataset_id: str, root: str, datasets: Mapping[str, Dataset] = DATASETS, domain: str | None = None,
         start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Read a catalogued dataset and apply the shared filters."""
    if dataset_id not in datasets:
        raise KeyError(f"unknown dataset {dataset_id!r}")
    spec = datasets[dataset_id]
    try:
        frame = spark.read.format(spec.format).load(f"{root.rstrip('/')}/{spec.path}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise DatasetMissing(f"dataset {dataset_id!r} is missing") from error
        raise DatasetInvalid(f"dataset {dataset_id!r} has no readable schema") from error
    except Py4JJavaError as error:  # a broken file footer is not an analysis error
        raise DatasetInvalid(f"dataset {dataset_id!r} cannot be read") from error
    return apply_filters(frame, domain, start, end)


def load_or_status(spark: SparkSession, dataset_id: str, root: str, datasets: Mapping[str, Dataset] = DATASETS) -> DataFrame | str:
    """For health checks: MISSING or INVALID in place of a dataset that cannot be loaded."""
    try:
        return load(spark, dataset_id, root, datasets)
    except DatasetMissing:
        return "MISSING"
    except DatasetInvalid:
        return "INVALID"


def catalog_health(spark: SparkSession, root: str, datasets: Mapping[str, Dataset] = DATASETS) -> DataFrame:
    """Health of every catalogued dataset."""
    from factweave.operators.quality import dataset_health

    return dataset_health({d: load_or_status(spark, d, root, datasets) for d in datasets}, DATE_COLUMNS, spark)

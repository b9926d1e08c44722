"""The nested scam registry as one row per listed address."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def registry_addresses(documents: DataFrame) -> DataFrame:
    """``id, status, category, address`` from documents, or from their entries; an entry without addresses gives no row, the entry's map key is not used."""
    entries = documents if "entry" in documents.columns else documents.select(F.explode("result").alias("entry_key", "entry"))
    return entries.select("entry.id", "entry.status", "entry.category", F.explode("entry.addresses").alias("address"))

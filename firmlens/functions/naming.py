"""Schema-level name resolution and label rules."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model registry labels.
POOLED = "Pooled (Industry + Year FE)"
FIRM_RE = "Firm RE (Random Intercept + Year FE)"
FAMILIES = {
    "Jones-family": ["M01", "M02", "M03"],
    "Cash-flow/McNichols-family": ["M04", "M05", "M06"],
    "Ball-Shivakumar/asymmetry": ["M07"],
    "No-lookahead/real-time": ["M09"],
    "Secondary volatility": ["M08"],
    "Secondary operating-cycle": ["M10"],
}
# Accepted names of the firm key in a metadata table.
METADATA_KEYS = ["Mã", "Ma", "Mã CK", "Ma CK", "company", "Company", "ticker", "Ticker", "symbol", "Symbol"]


def normalise_name(name: str) -> str:
    """Lower-case ASCII form with runs of other characters folded to one underscore."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_")


def resolve_column(columns: list[str], candidates: list[str], label: str = "column") -> str:
    """Exact match first, then a unique normalised match; otherwise an error listing what exists."""
    exact = [c for c in candidates if c in columns]
    if exact:
        return exact[0]
    wanted = {normalise_name(c) for c in candidates}
    hits = [c for c in columns if normalise_name(c) in wanted]
    if len(hits) == 1:
        return hits[0]
    problem = "ambiguous" if hits else "not found"
    raise ValueError(f"{label} {problem}; candidates {candidates}; available columns: {', '.join(columns)}")


def first_existing(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    hit = next((c for c in candidates if c in columns), None)
    if hit is None and required:
        raise ValueError(f"none of {candidates} in {', '.join(columns)}")
    return hit


def rename_resolved(df: DataFrame, candidates: list[str], to: str) -> DataFrame:
    return df.withColumnRenamed(resolve_column(df.columns, candidates, to), to)


def model_family(model_id: Column, fallback: Column) -> Column:
    out = None
    for family, ids in FAMILIES.items():
        hit = model_id.isin(*ids)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise(fallback)


def variant_of(model_name: Column) -> Column:
    return F.when(model_name.rlike("Firm RE"), FIRM_RE).when(model_name.rlike("Pooled"), POOLED)


def base_model_name(model_name: Column) -> Column:
    return F.regexp_replace(model_name, r" \((Firm RE|Pooled).*$", "")


def metric_key(text: Column) -> Column:
    """Canonical name of a reported score; unknown names pass through, blank ones become NULL."""
    y = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "")
    y = F.regexp_replace(y, r"^abs\((.*)\)$", "$1")
    y = F.regexp_replace(y, r"_stacked$", "")
    return (
        F.when(y.rlike("^z_est$|^z_estimation$|da_z_est|estimation_scaled"), "DA_z_estimation")
        .when(y.rlike("^raw$|da_raw|^raw_magnitude$"), "DA_raw")
        .when(y != "", text)
    )


def sign_label(c: Column) -> Column:
    return F.when(c > 0, "positive").when(c < 0, "negative").when(c == 0, "zero")

"""Model names: buckets, keys for matching, and match scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.functions.keys import is_blank

#: Names that say nothing, and the label of a tool whose models go unnamed.
OPAQUE = ("", "unknown", "custom_model")
TOOL_LABELS = {
    "qoder_ide": "Qoder IDE",
    "qoder_ide_cn": "Qoder IDE CN",
    "qoder_cli": "Qoder CLI",
    "qoder_work": "Qoder Work",
    "qoder_work_cn": "Qoder Work CN",
}


def is_opaque(model: Column) -> Column:
    return is_blank(model) | F.lower(F.trim(model)).isin(*OPAQUE)


def model_bucket(tool: Column, model: Column) -> Column:
    """The trimmed model; for a name that says nothing, the tool's label or ``unknown``."""
    label = F.lit("unknown")
    for name, shown in TOOL_LABELS.items():
        label = F.when(tool == name, shown).otherwise(label)
    return F.when(is_opaque(model), label).otherwise(F.trim(model))


def model_id(model: Column) -> Column:
    """ASCII letters and digits, lower-cased."""
    return F.lower(F.regexp_replace(model, "[^A-Za-z0-9]", ""))


def dated_model(model: Column) -> Column:
    """Lower case without path and without a trailing date of either form."""
    bare = F.regexp_replace(F.lower(F.trim(model)), "^.*/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?<=.)-\d{4}-\d{2}-\d{2}$", ""), r"(?<=.)-\d{8}$", "")


def base_model(model: Column) -> Column:
    """Lower-case last part of a path."""
    return F.lower(F.regexp_replace(model, "^.*/", ""))


def match_score(model: Column, price_id: Column) -> Column:
    """0 equal, 1 equal but for case, 2 one within the other, 3 so after ``model_id``, else null."""
    a, b, x, y = F.lower(model), F.lower(price_id), model_id(model), model_id(price_id)
    return (
        F.when(model == price_id, 0)
        .when(a == b, 1)
        .when(a.contains(b) | b.contains(a), 2)
        .when(x.contains(y) | y.contains(x), 3)
    )

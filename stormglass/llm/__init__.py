"""Training-data operators: filters, joins, tokenisation, search and packing.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` list what the driver contract registers.
"""

from __future__ import annotations

from importlib import import_module

#: Modules that register a query, in the order of the operators' numbers.
MODULES = (
    "toxicity",
    "language_id",
    "jaccard_join",
    "warc_fixity",
    "bpe",
    "ann_forest",
    "license_scan",
    "packing",
    "quality_rules",
    "substring_dedup",
    "dataset_manifest",
    "source_divergence",
    "exact_dedup",
)


def queries() -> dict:
    out = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {}))
    return out

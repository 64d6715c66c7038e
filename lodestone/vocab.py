"""Closed vocabularies. All are fixed values that results depend on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trust level -> rank; unknown levels rank 0.
TRUST_RANK = {"confirmed": 70, "accepted": 60, "draft": 55, "known_risk": 50, "detected_mismatch": 45, "implementation": 40, "inferred": 20, "suggestion": 10}

# Kind -> weight of a record.
KIND_WEIGHT = {
    "agents": 100, "known_gaps": 90, "to_validate": 85, "contract": 80, "request_flow": 75, "frontend_contract": 75, "backend_contract": 75, "architecture": 70,
    "integrations": 70, "adr": 68, "touchpoint": 65, "workspace_doc": 60, "code_anchor": 58, "test_anchor": 57, "doc": 55, "openapi_spec": 50,
}

# Kinds whose records count as contracts.
CONTRACT_KINDS = ["contract", "request_flow", "frontend_contract", "backend_contract"]
CONTEXT_KINDS = ["contract", "integrations", "architecture"]

# Anchor type -> priority when anchors of a record are ranked, high first; others 10.
ANCHOR_PRIORITY = {
    "controller": 100, "ts_page": 96, "service": 92, "service_impl": 90, "filter": 84, "ts_store": 82, "client": 78, "support": 72,
    "multitenancy": 58, "java_type": 40, "config": 36, "entity": 20, "yaml_block": 18,
}

# Anchor type -> rank when anchors of a repository are capped, low first; others 50.
ANCHOR_KEEP_RANK = {
    "controller": 0, "service_impl": 1, "service": 2, "repository": 3, "client": 3, "filter": 4, "multitenancy": 5, "annotation": 6, "mapper": 6,
    "config": 7, "yaml_block": 8, "ts_service": 9, "ts_page": 9, "ts_store": 9, "ts_router": 9, "vue_component": 10, "go_type": 10, "go_func": 11,
    "python_type": 11, "specification": 11, "support": 12, "entity": 12, "java_type": 13, "ts_type": 14, "test": 40,
}

# Most anchors of a type among the anchors shown for one record.
ANCHOR_SOFT_CAP = {"entity": 2, "multitenancy": 2, "config": 1, "yaml_block": 1}

# Words of a query that carry no meaning.
STOPWORDS = (
    "a an the and or of to for in on by if what when where how does do is are be with from this that these those into over under vs versus "
    "about before after need needs change changes changing modify modifying rule rules behavior behaviour"
).split()


def lookup(table: Mapping[str, int], key: Column, default: int) -> Column:
    """Value of ``key`` in a small fixed table."""
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def sql_lookup(table: Mapping[str, int], key: str, default: int) -> str:
    """The same as a SQL expression."""
    return f"case {key} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"

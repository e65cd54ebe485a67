"""The registered queries; importing this package fills the registry."""

from cadastre.plans import (  # noqa: F401
    q_api,
    q_collections,
    q_compare,
    q_docs,
    q_ids,
    q_lint,
    q_migrate,
    q_registry,
    q_snapshots,
    q_sources,
    q_streaming,
    q_symbols,
    q_validate,
)
from cadastre.plans.registry import QUERIES, SQL  # noqa: F401

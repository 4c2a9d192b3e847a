"""Build, check and publish derived tables for many tenants, as Spark queries."""

from fleetgold.operators.changes import apply_changes, change_feed, net_changes, overwrite_feed
from fleetgold.operators.compatibility import contract_diff
from fleetgold.operators.conform import conform, conform_marked
from fleetgold.operators.latest import latest
from fleetgold.operators.lookup import contract_text, current_registrations, lookup_tables, merge_requests
from fleetgold.operators.shares import (
    dependency_gaps,
    share_locations,
    share_merge,
    share_readiness,
    visible_tables,
)
from fleetgold.plans.publish import Product, publish_standard, run_fleet, run_product
from fleetgold.plans.runplan import planned_runs, run_plan
from fleetgold.plans.store import Coordinates, Snapshot, Store
from fleetgold.sources.contracts import (
    contract_annotations,
    contract_columns,
    find_entity,
    match_entity,
    read_contracts,
)
from fleetgold.sources.launch import launch_products, launch_runs, linked_products, product_shares
from fleetgold.sources.listed import listed_table
from fleetgold.sources.tables import counted, load_table

__all__ = [
    "Coordinates",
    "Product",
    "Snapshot",
    "Store",
    "apply_changes",
    "change_feed",
    "conform",
    "conform_marked",
    "contract_annotations",
    "contract_columns",
    "contract_diff",
    "contract_text",
    "counted",
    "current_registrations",
    "dependency_gaps",
    "find_entity",
    "latest",
    "launch_products",
    "launch_runs",
    "linked_products",
    "listed_table",
    "load_table",
    "lookup_tables",
    "match_entity",
    "merge_requests",
    "net_changes",
    "overwrite_feed",
    "planned_runs",
    "product_shares",
    "publish_standard",
    "read_contracts",
    "run_fleet",
    "run_plan",
    "run_product",
    "share_locations",
    "share_merge",
    "share_readiness",
    "visible_tables",
]

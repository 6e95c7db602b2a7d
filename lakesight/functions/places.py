"""Labels derived from addresses and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakesight.functions.text import last_segment

# Cities that place an address in a sales region, in rule order.
REGION_CITIES = {
    "Northeast": ["New York", "Boston"],
    "Midwest": ["Chicago", "Detroit"],
    "West": ["Los Angeles", "San Francisco"],
    "South": ["Houston", "Miami"],
}


def sales_region(address: Column) -> Column:
    rule = None
    for region, cities in REGION_CITIES.items():
        hit = F.lit(False)
        for city in cities:
            hit = hit | address.contains(city)
        rule = F.when(hit, region) if rule is None else rule.when(hit, region)
    return rule.otherwise("Other")


def stack_scope(path: Column) -> Column:
    """Deployment scope named by a stack folder, else the folder's last segment."""
    nonkube, kube = path.contains("nonkube"), path.contains("kube")
    shared = path.contains("shared")
    return (
        F.when(nonkube & ~shared, "nonkube")
        .when(kube & ~nonkube, "kube")
        .when(shared & path.contains("nondurable"), "shared-nondurable")
        .otherwise(last_segment(path, "/"))
    )

"""All registered queries."""

from __future__ import annotations

from functools import cache

from lakesight.plans.adhoc import adhoc
from lakesight.plans.agent import agent
from lakesight.plans.batch import batch
from lakesight.plans.ops import ops
from lakesight.plans.refreshing import refreshing
from lakesight.plans.registry import Registry
from lakesight.plans.retail import retail
from lakesight.plans.searching import searching
from lakesight.plans.streams import streams
from lakesight.plans.textjobs import textjobs


@cache
def catalog() -> Registry:
    everything = Registry()
    for group in (retail, batch, agent, ops, textjobs, searching, adhoc, streams, refreshing):
        everything.include(group)
    return everything

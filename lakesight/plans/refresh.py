"""The batch partials of the raw table, kept up to date from its edits."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from lakesight.functions import cleaning
from lakesight.operators import maintained as M
from lakesight.plans.snapshot import Parts
from lakesight.session import materialize
from lakesight.sources import ranges
from lakesight.sources.store import TableStore

#: The folds of a batch run: keys and the columns they need.
FOLDS = {
    "models": ["brand", "fridge_model", "feedback_sentiment_category"],
    "stores": ["store_name"],
}
NARROW = ["brand", "fridge_model", "store_name", "feedback_sentiment_category", "price"]


def sales_of(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of the folds, filled as in a batch run."""
    return cleaning.batch_defaults(cleaning.add_missing_columns(rows)).select(*more, *NARROW)


def refreshed_parts(store: TableStore, name: str = "sales_raw", key: str = "id") -> Parts:
    """The partials of a table written by ``ranges.write_ranged``, with all its edits.

    They are kept under the version and edit they hold for. Of later edits only the keys are
    taken: what rows these keys had and what they have now is read from the key ranges they
    lie in, and goes into the groups it belongs to. The whole table is folded only once for
    each of its versions. A run that is repeated finds, or makes again, the same partials.
    """
    version, edit = store.version(name), store.last_edit(name)
    states = [ranges.newest_state(store, f"{name}_{fold}", version, edit) for fold in FOLDS]
    known = None if None in states else min(states)
    if known is None:
        sales = sales_of(store.current(name, key, edit))
        fresh = {fold: lambda keys=keys: M.build(sales, keys) for fold, keys in FOLDS.items()}
    elif known < edit:
        before, after, _ = ranges.changed_rows(store, name, key, known, edit)
        moved = materialize(M.changes(sales_of(before), sales_of(after)), "moved")
        present = sales_of(store.current(name, key, edit))

        def applied(fold: str, keys: list[str]) -> DataFrame:
            parts = store.read_run(f"{name}_{fold}", ranges.state_name(version, known))
            return M.apply_changes(parts, moved, keys, lambda groups: M.rows_in(present, groups, keys))

        fresh = {fold: lambda fold=fold, keys=keys: applied(fold, keys) for fold, keys in FOLDS.items()}
    else:
        fresh = {}
    # The folds are independent jobs of few rows.
    with ThreadPoolExecutor(len(FOLDS)) as pool:
        list(pool.map(lambda fold: store.append(f"{name}_{fold}", fresh[fold](), ranges.state_name(version, edit)), fresh))
    return Parts(*[
        M.as_partials(store.read_run(f"{name}_{fold}", ranges.state_name(version, edit)), keys) for fold, keys in FOLDS.items()])

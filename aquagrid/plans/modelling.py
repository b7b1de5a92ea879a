"""From feature table to scored model, pumping map and intervals."""

from __future__ import annotations

from aquagrid.operators import features as FE, metrics as M, modeling as L
from aquagrid.session import cut_lineage


def train_and_score(table, features, target, pixel="pixel_id", state="state_id", params=None):
    """Pixel-level split, fit, and the metrics of each part. Returns (model, metrics).

    The split table feeds every boosting iteration, so it is checkpointed once to shared
    storage: a lost executor re-reads files instead of redoing the split.
    """
    data = cut_lineage(FE.pixel_split(table, pixel, state))
    model = L.fit_trees(data.filter("split = 'train'"), features, target, params)
    scores = L.score_table(model, data, target, ["split"])
    return model, M.regression_metrics(scores, ["split"])


def pumping_with_bounds(models, best, table, mask, keys=("pixel_id", "year")):
    """Point prediction with lower and upper bound from the ensemble's spread."""
    point = L.predict_cells(best, table, mask, keys)
    members = L.member_columns(models, table.filter("valid"), keys)
    return L.confidence_bounds(point, L.row_spread(members, keys), keys)

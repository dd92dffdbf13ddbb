"""The two models behind one interface: budgets, validation, storage and scoring take either."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame

from tidemark.operators import joint_model as J
from tidemark.operators.forecast import predict_daily
from tidemark.operators.slice_model import fit_staged


@dataclass(frozen=True)
class Model:
    """How slices are fitted and predicted.

    ``fit`` takes (series, events, keys, settings, horizons, carry) and gives one row per slice;
    ``predict`` takes (models, events, keys, settings, horizon, budget, everyone) and gives days.
    ``name`` tells fits apart in a store.
    """

    name: str
    fit: Callable[..., DataFrame]
    predict: Callable[..., DataFrame]


STAGED = Model("staged", fit_staged, predict_daily)


def joint(design: J.Design = J.Design()) -> Model:
    return Model(f"joint {design}", partial(J.fit_with_guards, design=design), partial(J.predict_joint, design=design))

"""Normal forms of spellings, run inside Python tasks.

The module travels with the job (it is pickled by value); keep it free of imports
from this package.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def folded(values: pd.Series) -> pd.Series:
    """Normal form with full Unicode case folding."""
    return values.map(lambda v: " ".join(v.split()).casefold())


def forms(values: pd.Series) -> pd.DataFrame:
    """Normal form, the stripped text, and the stripped text with case folded."""
    stripped = values.map(str.strip)
    return pd.DataFrame({"norm": folded(values), "stripped": stripped, "fold": stripped.map(str.casefold)})

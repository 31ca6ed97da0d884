"""Every query of the reference-side operators, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from retort.functions import timeutil
from retort.operators import cluster, conformal, kernels, models, similarity, splits, stats
from retort.plans import compounds, molecules
from retort.streaming import streams

FLAGSHIP = "tanimoto_pairs"
QUERIES, ORACLE_SQL = {}, {}
for _m in (similarity, splits, stats, timeutil, conformal, kernels, cluster, molecules, compounds, models, streams):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL

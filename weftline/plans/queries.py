"""All queries of the library, without those of the subpackage for training corpora."""

from __future__ import annotations

from weftline.plans import join_queries, metric_queries, model_queries, more_queries, text_queries

PARTS = (text_queries.R, join_queries.R, metric_queries.R, more_queries.R, model_queries.R)
QUERIES = {k: v for r in PARTS for k, v in r.queries.items()}
SQL = {k: v for r in PARTS for k, v in r.sql.items()}

"""Every query of the engine proper: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from quill.plans import analytics, corpus, evaluation, files, folds, learning, release, retrieval, risk, search, selection, service, strings

QUERIES: dict = {**analytics.PLANS, **learning.PLANS, **risk.PLANS, **retrieval.PLANS, **corpus.PLANS, **service.PLANS, **evaluation.PLANS, **strings.PLANS, **release.PLANS, **files.PLANS, **folds.PLANS, **search.PLANS, **selection.PLANS}

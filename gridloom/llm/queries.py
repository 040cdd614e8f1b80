"""The queries of this subpackage and their SQL, as ``__spark_entry__.py`` adds them."""

from __future__ import annotations

import importlib
import re

#: Modules in the order of their operators. Each holds opN_<name> functions and may hold ORACLE_SQL.
MODULES = ["bpe", "shards", "exact_dedup", "language_id", "quality", "near_dedup", "packing", "token_files", "topk", "lm_score"]


def _modules():
    return [importlib.import_module(f"gridloom.llm.{m}") for m in MODULES]


def queries() -> dict:
    found = {k: f for m in _modules() for k, f in vars(m).items() if re.match(r"op\d+_", k) and callable(f)}
    import corpus_pipeline

    found["pipeline"] = corpus_pipeline.run
    return dict(sorted(found.items(), key=lambda x: int((re.match(r"op(\d+)", x[0]) or [0, 99])[1])))


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {k: v for m in _modules() for k, v in getattr(m, "ORACLE_SQL", {}).items()}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

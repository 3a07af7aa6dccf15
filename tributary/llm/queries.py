"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, jaccard_join, lang_id, licenses, quality, substring_dedup, token_files, url_filter

_MODULES = (url_filter, licenses, substring_dedup, bpe, quality, decontaminate, jaccard_join, fingerprint, lang_id, token_files)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}

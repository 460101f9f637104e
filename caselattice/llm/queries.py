"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import corpus_language, corpus_names, corpus_nearest, corpus_packing, corpus_personal, corpus_sentences, corpus_tokens

_MODULES = (corpus_personal, corpus_nearest, corpus_language, corpus_names, corpus_tokens, corpus_packing, corpus_sentences)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}

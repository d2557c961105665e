"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embeddings, langid, licenses, merkle, mixing, ngrams, periods, quality, secrets, substrings, suffixes, warc

MODULES = (bpe, mixing, embeddings, langid, licenses, warc, quality, ngrams, substrings, suffixes, merkle, secrets, periods)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

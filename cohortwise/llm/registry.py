"""The registered queries of this subpackage: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from cohortwise.llm import bpe, codes, fingerprints, forest, merkle, packing, quality, sharding, simhash, suffix_dedup, topk, url_filters, warc

LLM_REGISTRY = {**url_filters.QUERIES, **quality.QUERIES, **fingerprints.QUERIES, **simhash.QUERIES, **packing.QUERIES, **warc.QUERIES, **topk.QUERIES, **sharding.QUERIES, **bpe.QUERIES, **suffix_dedup.QUERIES, **forest.QUERIES, **codes.QUERIES, **merkle.QUERIES,
                "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}

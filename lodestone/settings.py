"""Settings of the engine, passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    chunk_words: int = 200
    chunk_overlap: int = 50
    flatten_lines: int = 500
    top_k: int = 6
    author_top_k: int = 24
    lines_per_hit: int = 3
    line_chars: int = 400
    rerank_top_k: int = 10
    max_evidence: int = 8
    author_bias_source: float = 0.8
    author_bias_text: float = 0.4
    domain_min_keyword_hits: int = 2
    claims_per_chunk: int = 5
    contradiction_window: int = 200
    contradiction_overlap: float = 0.6
    contradiction_floor: int = 3
    contradiction_cap: float = 0.6
    contradiction_penalty: float = 0.1
    contradiction_penalty_max: float = 0.5
    relation_boost: float = 0.05
    relation_boost_max: float = 0.2
    conflict_penalty: float = 0.15
    conflict_penalty_max: float = 0.5
    judge_non_json: float = 0.4
    judge_error: float = 0.3
    synthesis_confidence: float = 0.3
    graph_top: int = 10
    subgraph_pairs: int = 50
    strong_relation: int = 2
    min_results: int = 3
    min_top_score: float = -12.0
    floor_confidence: float = 0.55
    floor_top_score: float = -6.0
    rate_limit: int = 60
    page_default: int = 50
    page_max: int = 1000
    learning_min_rating: int = 4
    learning_limit: int = 1000
    jobs_kept: int = 200
    query_cache_ttl_s: int = 300
    ingest_batch: int = 128
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    freshness_days: float | None = None
    blocklist: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    source_types_allow: tuple[str, ...] = ()
    source_types_block: tuple[str, ...] = ()
    domains_allow: tuple[str, ...] = ()
    domains_block: tuple[str, ...] = ()
    rules: tuple[dict, ...] = ()
    domain_keywords: dict[str, list[str]] = field(default_factory=dict)
    domain_aliases: dict[str, list[str]] = field(default_factory=dict)
    domain_index_map: dict[str, str] = field(default_factory=dict)
    #: Whether questions search the indexes of their domains; else the whole corpus.
    domain_collections: bool = False
    domain_fallbacks: tuple[str, ...] = ()
    term_synonyms: dict[str, list[str]] = field(default_factory=dict)
    #: Whether author-expansion hits pass policy and freshness filters too.
    filter_author_hits: bool = False

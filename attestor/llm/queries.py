"""The queries of this folder: QUERIES by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from attestor.llm.bpe import op2_bpe
from attestor.llm.clustering import ORACLE as CENTROIDS_SQL
from attestor.llm.clustering import op12_centroids
from attestor.llm.language_mix import op13_languages
from attestor.llm.media import op1_media
from attestor.llm.mixing import op9_mixing
from attestor.llm.near_dedup import ORACLE as NEAR_DEDUP_SQL
from attestor.llm.near_dedup import op10_near_dedup
from attestor.llm.periodic_runs import op11_periodic_runs
from attestor.llm.quality import op7_quality
from attestor.llm.sharding import op8_sharding
from attestor.llm.token_counts import op6_token_counts
from attestor.llm.topk import ORACLE as TOP_K_SQL
from attestor.llm.topk import op4_top_k
from attestor.llm.toxicity import op5_toxicity
from attestor.llm.url_filters import op3_url_filters
from attestor.llm.url_filters import oracle as url_filters_sql

QUERIES = {f.__name__: f for f in (op1_media, op2_bpe, op3_url_filters, op4_top_k, op5_toxicity, op6_token_counts, op7_quality, op8_sharding, op9_mixing, op10_near_dedup, op11_periodic_runs, op12_centroids, op13_languages)}

ORACLE_SQL: dict[str, str] = {"op3_url_filters": url_filters_sql(), "op4_top_k": TOP_K_SQL, "op10_near_dedup": NEAR_DEDUP_SQL, "op12_centroids": CENTROIDS_SQL}

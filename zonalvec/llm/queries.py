"""The queries of this subpackage and, where SQL can express one, DuckDB SQL for its rows."""

from __future__ import annotations

from .archives import op5_warc_archives
from .chat import op8_chat_formatting
from .clustering import op13_centroid_clustering
from .decontaminate import op6_benchmark_decontamination
from .fingerprint import op1_document_fingerprints
from .jaccard import op11_jaccard_join
from .language import op9_language_id
from .lexical import op12_ranked_search
from .licenses import op3_license_scan
from .oracles import ORACLE_SQL
from .packing import op7_packing
from .quality import op4_quality_classifier
from .sharding import op2_sharding
from .simhash import op10_simhash_near_dedup

QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_sharding": op2_sharding,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc_archives": op5_warc_archives,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_packing": op7_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_ranked_search": op12_ranked_search,
    "op13_centroid_clustering": op13_centroid_clustering,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

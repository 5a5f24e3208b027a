"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .centroids import OP11_SQL, op11_centroids
from .chat import op4_chat_format
from .media import op3_media
from .mixing import op1_mixing
from .phrases import OP12_SQL, op12_phrases
from .pieces import op13_pieces
from .quality_rules import op6_quality_rules
from .sharding import FINE_BYTES, OP5_SQL, op5_sharding, sharding_fine, sharding_sql
from .simhash import op7_simhash
from .substrings import op9_substring_dedup
from .subword import op2_quality_classifier
from .toxicity import op10_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_media": op3_media,
    "op4_chat_format": op4_chat_format,
    "op5_sharding": op5_sharding,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_centroids": op11_centroids,
    "op12_phrases": op12_phrases,
    "op13_pieces": op13_pieces,
    "sharding_fine": sharding_fine,
}
SQL = {"op5_sharding": OP5_SQL, "op11_centroids": OP11_SQL, "op12_phrases": OP12_SQL, "sharding_fine": sharding_sql(FINE_BYTES)}

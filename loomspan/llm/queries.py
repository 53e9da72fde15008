"""Name to query and name to oracle SQL of this subpackage."""

from . import oracle
from .embedding_dedup import op4_embedding_dedup
from .language_id import op10_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .minhash_dedup import op1_minhash_dedup
from .packing import op2_best_fit_packing
from .quality import op7_quality_rules
from .substring_dedup import op6_substring_dedup
from .tokens import op3_bpe_round_trip, op8_token_counts
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
}
ORACLE: dict[str, str] = {
    "op1_minhash_dedup": oracle.OP1,
    "op4_embedding_dedup": oracle.OP4,
    "op5_url_filter": OP5_SQL,
    "op6_substring_dedup": oracle.OP6,
    "op9_line_dedup": OP9_SQL,
}

"""The queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op7_chat_format
from .decontaminate import OP9_SQL, op9_decontaminate
from .divergence import OP11_SQL, op11_divergence
from .language_id import op4_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .lm_scoring import op8_lm_scoring
from .near_dedup import OP5_SQL, op5_near_dedup
from .packing import op6_packing
from .pieces import op12_pieces
from .pii import op10_pii
from .sharding import op2_sharding
from .simhash import op3_simhash
from .variants import op13_variants

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_packing": op6_packing,
    "op7_chat_format": op7_chat_format,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_divergence": op11_divergence,
    "op12_pieces": op12_pieces,
    "op13_variants": op13_variants,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op5_near_dedup": OP5_SQL, "op9_decontaminate": OP9_SQL, "op11_divergence": OP11_SQL}

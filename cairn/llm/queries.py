"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard_join, lexical_rank, line_dedup, minhash_dedup, resampling
from .bpe import op5_byte_bpe
from .decontaminate import op3_decontamination
from .html_extract import op2_html_extraction
from .jaccard_join import op10_jaccard_join
from .kneser_ney import op9_quality_classifier
from .lang_id import op1_language_id
from .lexical_rank import op11_lexical_search
from .line_dedup import op8_line_dedup
from .minhash_dedup import op12_minhash_dedup
from .resampling import op13_importance_resampling
from .sharding import op4_sharding
from .suffix_dedup import op7_suffix_dedup
from .webp import op6_lossless_webp

QUERIES = {f.__name__: f for f in (op1_language_id, op2_html_extraction, op3_decontamination, op4_sharding, op5_byte_bpe, op6_lossless_webp, op7_suffix_dedup, op8_line_dedup, op9_quality_classifier, op10_jaccard_join, op11_lexical_search, op12_minhash_dedup, op13_importance_resampling)}

ORACLE_SQL = {"op3_decontamination": decontaminate.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE, "op11_lexical_search": lexical_rank.ORACLE, "op12_minhash_dedup": minhash_dedup.ORACLE, "op13_importance_resampling": resampling.ORACLE}

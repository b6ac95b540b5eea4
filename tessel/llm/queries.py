"""The queries opN_<name> and the SQL of those that SQL expresses on whole tables."""

from .impact_topk import OP5_SQL, op5_topk
from .mil_quality import op4_quality
from .mixing import op3_mixing
from .pii_feistel import op9_pii
from .quality_forest import op1_quality_rules
from .sentencepiece_ac import op10_sentencepiece
from .simhash_pivot import op7_simhash
from .suffix_dedup import op8_suffix_dedup
from .toxicity_cnn import op6_toxicity
from .url_tree import op2_url_filters

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pii": op9_pii,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL = {"op5_topk": OP5_SQL}

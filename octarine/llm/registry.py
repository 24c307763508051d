"""The queries of this folder, and SQL where it can express them."""

from octarine.llm.alignment import op12_cross_tokenizer
from octarine.llm.bpe import op6_bpe
from octarine.llm.centroids import OP11_SQL, op11_centroid_clustering
from octarine.llm.chat_format import OP5_SQL, op5_chat_format
from octarine.llm.decontamination import op10_decontamination
from octarine.llm.language_id import op4_language_id
from octarine.llm.line_dedup import OP9_SQL, op9_line_dedup
from octarine.llm.lm_scoring import op3_lm_scoring
from octarine.llm.quality_rules import op7_quality_rules
from octarine.llm.simhash import op8_simhash
from octarine.llm.suffix_dedup import op1_suffix_dedup
from octarine.llm.trie_bpe import op13_trie_bpe
from octarine.llm.url_filters import OP2_SQL, op2_url_filters

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_trie_bpe": op13_trie_bpe,
}
SQL = {"op2_url_filters": OP2_SQL, "op5_chat_format": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_centroid_clustering": OP11_SQL}

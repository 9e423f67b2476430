"""Registry of this subpackage: query name -> function of (spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from lacuna.llm.bayes_minhash import OP11_SQL, op11_bayes_minhash
from lacuna.llm.bin_packing import op9_best_fit_shards
from lacuna.llm.byte_bpe import op6_byte_bpe
from lacuna.llm.decontamination import op3_pigeonhole_decontamination
from lacuna.llm.golay_simhash import op8_golay_simhash
from lacuna.llm.huffman_tokens import op1_huffman_tokens
from lacuna.llm.importance_resampling import OP12_SQL, op12_importance_resampling
from lacuna.llm.lexical_search import OP13_SQL, op13_lexical_search
from lacuna.llm.neural_lm import op2_log_bilinear_lm
from lacuna.llm.quality_ledger import ABLATIONS_SQL, OP7_SQL, ledger_ablations, op7_quality_ledger
from lacuna.llm.quality_mil import op4_attention_quality
from lacuna.llm.url_rules import OP5_SQL, op5_url_trie
from lacuna.llm.warc_bundles import OP10_SQL, op10_warc_bundles
from lacuna.shipping import shipped

_ALL = {
    "op1_huffman_tokens": op1_huffman_tokens,
    "op5_url_trie": op5_url_trie,
    "op2_log_bilinear_lm": op2_log_bilinear_lm,
    "op3_pigeonhole_decontamination": op3_pigeonhole_decontamination,
    "op4_attention_quality": op4_attention_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_ledger": op7_quality_ledger,
    "ledger_ablations": ledger_ablations,
    "op8_golay_simhash": op8_golay_simhash,
    "op9_best_fit_shards": op9_best_fit_shards,
    "op10_warc_bundles": op10_warc_bundles,
    "op11_bayes_minhash": op11_bayes_minhash,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_lexical_search": op13_lexical_search,
}
QUERIES = {name: shipped(query) for name, query in _ALL.items()}

ORACLE_SQL = {
    "op5_url_trie": OP5_SQL,
    "op7_quality_ledger": OP7_SQL,
    "op10_warc_bundles": OP10_SQL,
    "ledger_ablations": ABLATIONS_SQL,
    "op11_bayes_minhash": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}

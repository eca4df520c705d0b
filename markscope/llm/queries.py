"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from markscope.llm.bpe import op7_byte_bpe_transducer
from markscope.llm.decontaminate import OP1_SQL, op1_decontaminate_winnowing
from markscope.llm.exact_dedup import OP9_SQL, op9_exact_dedup_stream
from markscope.llm.fuzzy_lines import op8_fuzzy_line_dedup
from markscope.llm.kn_lm import op5_kneser_ney_lm
from markscope.llm.langid import op6_langid_kneser_ney
from markscope.llm.pii import op2_pii_bootstrap
from markscope.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from markscope.llm.quality import op3_quality_ftrl
from markscope.llm.ranked_search import OP11_SQL, op11_ranked_search
from markscope.llm.simhash_dedup import op4_simhash_pivot_dedup
from markscope.llm.toxicity import op12_toxicity_gbt
from markscope.llm.warc_revisit import OP10_SQL, op10_warc_revisits

QUERIES = {
    "op1_decontaminate_winnowing": op1_decontaminate_winnowing,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_quality_ftrl": op3_quality_ftrl,
    "op4_simhash_pivot_dedup": op4_simhash_pivot_dedup,
    "op5_kneser_ney_lm": op5_kneser_ney_lm,
    "op6_langid_kneser_ney": op6_langid_kneser_ney,
    "op7_byte_bpe_transducer": op7_byte_bpe_transducer,
    "op8_fuzzy_line_dedup": op8_fuzzy_line_dedup,
    "op9_exact_dedup_stream": op9_exact_dedup_stream,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_ranked_search": op11_ranked_search,
    "op12_toxicity_gbt": op12_toxicity_gbt,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate_winnowing": OP1_SQL,
    "op9_exact_dedup_stream": OP9_SQL,
    "op10_warc_revisits": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}

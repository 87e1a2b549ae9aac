"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.bpe import op5_bpe
from spanloom.llm.embeddings import op3_embedding_dedup
from spanloom.llm.fingerprints import op2_fingerprints
from spanloom.llm.html import op10_html_extraction
from spanloom.llm.langid import op4_language_id
from spanloom.llm.minhash import op1_minhash_dedup
from spanloom.llm import mixing
from spanloom.llm.mixing import op6_mixing
from spanloom.llm.periodic import op12_periodic_runs
from spanloom.llm.pii import op9_pii
from spanloom.llm.prefixes import op11_token_counts
from spanloom.llm.repeats import op8_suffix_dedup
from spanloom.llm.tokenstore import op7_token_store
from spanloom.llm.tries import op13_prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_token_store": op7_token_store,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pii": op9_pii,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.SQL}

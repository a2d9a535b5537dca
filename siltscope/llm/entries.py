"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from siltscope.llm.bpe import op10_bpe
from siltscope.llm.dedup import OP2_SQL, op2_suffix_dedup
from siltscope.llm.licenses import op1_licenses
from siltscope.llm.packing import op8_best_fit
from siltscope.llm.pii import op4_pii
from siltscope.llm.quality import OP9_SQL, op9_quality_rules
from siltscope.llm.simhash import op5_simhash
from siltscope.llm.token_counts import op7_token_counts
from siltscope.llm.token_files import op3_token_files
from siltscope.llm.topk import OP6_SQL, op6_topk

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_files": op3_token_files,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_token_counts": op7_token_counts,
    "op8_best_fit": op8_best_fit,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
}
#: Licenses, pseudonyms, token ids, fingerprints and packings can't be stated in SQL; the tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op6_topk": OP6_SQL, "op9_quality_rules": OP9_SQL}

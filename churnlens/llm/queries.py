"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from churnlens.llm import lexical, minhash, sharding
from churnlens.llm.ann import op4_vptree_ann
from churnlens.llm.counts import op2_token_counts
from churnlens.llm.encoding import op1_bpe_encode
from churnlens.llm.langid import op8_language_id
from churnlens.llm.lexical import op13_lexical_search
from churnlens.llm.minhash import op11_minhash
from churnlens.llm.packing import op3_packing
from churnlens.llm.quality import op6_quality_classifier
from churnlens.llm.sharding import op10_sharding
from churnlens.llm.simhash import op9_simhash
from churnlens.llm.topk import op7_mtree_topk
from churnlens.llm.wavelet import op5_token_files
from churnlens.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (
    op1_bpe_encode, op2_token_counts, op3_packing, op4_vptree_ann, op5_token_files,
    op6_quality_classifier, op7_mtree_topk, op8_language_id, op9_simhash, op10_sharding,
    op11_minhash, op12_whitening, op13_lexical_search)}

ORACLE_SQL = {"op10_sharding": sharding.oracle(), "op11_minhash": minhash.oracle(),
              "op13_lexical_search": lexical.oracle()}

"""The queries of the corpus operators and the SQL that some of them must equal."""

from __future__ import annotations

from rowloom.llm.bpe import op6_bpe
from rowloom.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from rowloom.llm.media import op2_media
from rowloom.llm.minhash import op4_minhash
from rowloom.llm.mixing import OP1_SQL, op1_mixing
from rowloom.llm.pii import OP9_SQL, op9_pii
from rowloom.llm.quality import op7_quality
from rowloom.llm.suffix_dedup import op8_suffix_dedup
from rowloom.llm.token_counts import op3_token_counts
from rowloom.llm.toxicity import op10_toxicity

_ALL = (op1_mixing, op2_media, op3_token_counts, op4_minhash, op5_exact_dedup, op6_bpe, op7_quality, op8_suffix_dedup, op9_pii, op10_toxicity)
QUERIES = {f.__name__: f for f in _ALL}
#: The others are tested against brute force, round trips or held-out labels.
ORACLES = {"op1_mixing": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op9_pii": OP9_SQL}

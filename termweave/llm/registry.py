"""The queries of this subpackage, opN_<name>, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op6_bpe_roundtrip
from .hilbert import op10_hilbert_shards
from .jpeg import op4_progressive_jpeg
from .licenses import op8_license_scan
from .linededup import ORACLE_SQL as LINES_SQL
from .linededup import op7_line_dedup
from .metricjoin import ORACLE_SQL as JOIN_SQL
from .metricjoin import op9_jaccard_join
from .mixing import op2_mix_sources
from .secrets import op3_secret_scan
from .simhash import op5_simhash_edits
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mix_sources, op3_secret_scan, op4_progressive_jpeg, op5_simhash_edits, op6_bpe_roundtrip, op7_line_dedup, op8_license_scan, op9_jaccard_join, op10_hilbert_shards)}

#: Learned scores, random draws, media, fingerprints and greedy orders are no SQL; each is tested against brute force, a
#: round trip or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {"op7_line_dedup": LINES_SQL, "op9_jaccard_join": JOIN_SQL}

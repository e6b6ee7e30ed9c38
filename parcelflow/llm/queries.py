"""The registered queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import op1_perfect_hash_dedup as op1
from . import op2_page_differencing as op2
from . import op3_mil_toxicity as op3
from . import op4_pu_quality as op4
from . import op5_simhash_trie as op5
from . import op6_vector_packing as op6
from . import op7_mpeg_audio as op7
from . import op8_mix_sources as op8
from . import op9_compact_windows as op9
from . import op10_string_kernel_language as op10
from . import op11_periodic_runs as op11
from . import op12_line_dedup as op12
from . import op13_centroid_clustering as op13

QUERIES = {f.__name__: f for f in (
    op1.op1_perfect_hash_dedup, op2.op2_page_differencing, op3.op3_mil_toxicity, op4.op4_pu_quality, op5.op5_simhash_trie, op6.op6_vector_packing, op7.op7_mpeg_audio, op8.op8_mix_sources, op9.op9_compact_windows, op10.op10_string_kernel_language,
    op11.op11_periodic_runs, op12.op12_line_dedup, op13.op13_centroid_clustering,
)}
ORACLES = {"op1_perfect_hash_dedup": op1.SQL, "op8_mix_sources": op8.SQL, "op12_line_dedup": op12.SQL, "op13_centroid_clustering": op13.SQL}

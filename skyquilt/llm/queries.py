"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from . import exact_dedup, mixing, negatives, warc
from .binary_output import op4_binary_output
from .exact_dedup import op10_exact_dedup
from .language_id import op7_language_id
from .media import op2_media
from .mixing import op1_mixing
from .negatives import op12_hard_negatives
from .packing import op9_packing
from .runs import op13_periodic_runs
from .sharding import op8_sharding
from .simhash import op5_simhash
from .token_counts import op3_token_counts
from .toxicity import op6_toxicity
from .warc import op11_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_media, op3_token_counts, op4_binary_output, op5_simhash, op6_toxicity, op7_language_id, op8_sharding, op9_packing, op10_exact_dedup,
        op11_warc, op12_hard_negatives, op13_periodic_runs,
    )
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_warc": warc.ORACLE, "op12_hard_negatives": negatives.ORACLE}

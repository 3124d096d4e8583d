"""The contract queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op6_template_join
from .exact_dedup import OP2_SQL, op2_heavy_hitters
from .near_dup import op1_minhash_bayes
from .packing import op4_best_fit
from .pii import op3_candidate_boosting
from .quality import op10_boosted_trees
from .sst import op7_sorted_string_table
from .substring import op5_seed_extend
from .suffix_dedup import op9_suffix_array
from .toxicity import op8_nonnegative_pu

QUERIES = {
    "op1_minhash_bayes": op1_minhash_bayes,
    "op2_heavy_hitters": op2_heavy_hitters,
    "op3_candidate_boosting": op3_candidate_boosting,
    "op4_best_fit": op4_best_fit,
    "op5_seed_extend": op5_seed_extend,
    "op6_template_join": op6_template_join,
    "op7_sorted_string_table": op7_sorted_string_table,
    "op8_nonnegative_pu": op8_nonnegative_pu,
    "op9_suffix_array": op9_suffix_array,
    "op10_boosted_trees": op10_boosted_trees,
}

ORACLE_SQL = {"op2_heavy_hitters": OP2_SQL}

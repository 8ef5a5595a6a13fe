"""Queries of this subpackage, and the SQL of those that SQL can express."""

from .classifier import classifier_query
from .decontaminate import decontaminate_query
from .jaccard import jaccard_query
from .lines import lines_query
from .lm import lm_query
from .mixing import mixing_query
from .preference import PREFERENCE_SQL, preference_query
from .quality_rules import rules_query
from .sanitise import sanitise_query
from .secrets import secrets_query

QUERIES = {
    "op1_mixing": mixing_query,
    "op2_decontaminate": decontaminate_query,
    "op3_jaccard": jaccard_query,
    "op4_classifier": classifier_query,
    "op5_rules": rules_query,
    "op6_secrets": secrets_query,
    "op7_lm": lm_query,
    "op8_preference": preference_query,
    "op9_lines": lines_query,
    "op10_sanitise": sanitise_query,
}
ORACLE: dict[str, str] = {"op8_preference": PREFERENCE_SQL}

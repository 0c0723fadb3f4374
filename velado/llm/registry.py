"""The queries of the corpus operators, and SQL where it can express them."""

from .decontaminate import ORACLE as SQL6
from .decontaminate import op6_decontamination
from .exact_dedup import ORACLE as SQL7
from .exact_dedup import op7_exact_dedup
from .language import op4_language
from .lm_score import ORACLE as SQL5
from .lm_score import op5_lm_score
from .near_dedup import ORACLE as SQL3
from .near_dedup import op3_near_dedup
from .pieces import op2_sentencepiece
from .quality import op10_quality
from .substring_dedup import op9_substring_dedup
from .token_files import op1_token_files
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_token_files, op2_sentencepiece, op3_near_dedup, op4_language, op5_lm_score, op6_decontamination, op7_exact_dedup, op8_toxicity, op9_substring_dedup, op10_quality)}
SQL = {"op3_near_dedup": SQL3, "op5_lm_score": SQL5, "op6_decontamination": SQL6, "op7_exact_dedup": SQL7}

"""The queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import OP13_SQL, op13_vector_codes
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .fingerprints import op8_fingerprints
from .packing import op10_packing
from .perplexity import op12_quality_rules
from .personal import op7_personal_data
from .pieces import op4_sentencepiece
from .prefixes import OP11_SQL, op11_prefix_trie
from .secrets_scan import op6_secret_scan
from .sharding import op1_sharding
from .simhash import op2_simhash
from .suffixes import op9_repeated_passages
from .toxicity import op3_toxicity

OPERATORS = (
    op1_sharding,
    op2_simhash,
    op3_toxicity,
    op4_sentencepiece,
    op5_exact_dedup,
    op6_secret_scan,
    op7_personal_data,
    op8_fingerprints,
    op9_repeated_passages,
    op10_packing,
    op11_prefix_trie,
    op12_quality_rules,
    op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}

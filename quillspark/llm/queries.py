"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .decontamination import OP10_SQL, op10_decontamination
from .fingerprint import op3_fingerprint
from .importance import OP12_SQL, op12_importance
from .infill import OP13_SQL, op13_infill
from .language import op7_language
from .neardup import OP1_SQL, op1_neardup
from .packing import op6_packing
from .pii import op2_pii
from .prefixbpe import op11_prefixbpe
from .sharding import op8_sharding
from .substring import OP9_SQL, op9_substring
from .tokenfile import op5_tokenfile
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_neardup, op2_pii, op3_fingerprint, op4_toxicity, op5_tokenfile, op6_packing, op7_language, op8_sharding, op9_substring, op10_decontamination, op11_prefixbpe, op12_importance, op13_infill)}

ORACLE_SQL: dict[str, str] = {"op1_neardup": OP1_SQL, "op9_substring": OP9_SQL, "op10_decontamination": OP10_SQL, "op12_importance": OP12_SQL, "op13_infill": OP13_SQL}

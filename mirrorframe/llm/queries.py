"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from mirrorframe.llm.byte_bpe import op2_byte_bpe
from mirrorframe.llm.fingerprints import op10_fingerprints
from mirrorframe.llm.gram_join import ORACLE as JOIN_SQL
from mirrorframe.llm.gram_join import op11_gram_join
from mirrorframe.llm.infill import ORACLE as INFILL_SQL
from mirrorframe.llm.infill import op13_infill
from mirrorframe.llm.languages import op7_language
from mirrorframe.llm.licenses import ORACLE as LICENSES_SQL
from mirrorframe.llm.licenses import op9_licenses
from mirrorframe.llm.media import op1_media
from mirrorframe.llm.mixing import ORACLE as MIX_SQL
from mirrorframe.llm.mixing import op3_mix
from mirrorframe.llm.near_dedup import ORACLE as NEAR_SQL
from mirrorframe.llm.near_dedup import op8_near_dedup
from mirrorframe.llm.repeats import ORACLE as REPEATS_SQL
from mirrorframe.llm.repeats import op6_repeats
from mirrorframe.llm.token_files import op4_token_files
from mirrorframe.llm.toxicity import op5_toxicity
from mirrorframe.llm.vector_codes import ORACLE as CODES_SQL
from mirrorframe.llm.vector_codes import op12_vector_codes

QUERIES = {
    "op1_media": op1_media,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mix": op3_mix,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_repeats": op6_repeats,
    "op7_language": op7_language,
    "op8_near_dedup": op8_near_dedup,
    "op9_licenses": op9_licenses,
    "op10_fingerprints": op10_fingerprints,
    "op11_gram_join": op11_gram_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_infill": op13_infill,
}
ORACLES: dict[str, str] = {"op3_mix": MIX_SQL, "op6_repeats": REPEATS_SQL, "op8_near_dedup": NEAR_SQL, "op9_licenses": LICENSES_SQL, "op11_gram_join": JOIN_SQL, "op12_vector_codes": CODES_SQL, "op13_infill": INFILL_SQL}

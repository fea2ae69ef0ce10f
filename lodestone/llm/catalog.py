"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op13_byte_bpe
from .decontaminate import ORACLE_OP3, op3_decontaminate
from .language import op8_language_id
from .licences import op5_licence_scan
from .manifest import ORACLE_OP11, op11_merkle_manifest
from .neardup import ORACLE_OP7, op7_near_duplicates
from .oracles import ORACLE_OP2, ORACLE_OP5
from .packing import op1_pack
from .secrets import op2_secret_scan
from .tokenfile import op6_token_files
from .toxicity import op4_toxicity
from .vectorcodes import ORACLE_OP12, op12_vector_codes
from .warc import ORACLE_OP10, op10_warc_revisits
from .winnow import op9_fingerprints

QUERIES = {
    "op1_pack": op1_pack,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_licence_scan": op5_licence_scan,
    "op6_token_files": op6_token_files,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_language_id": op8_language_id,
    "op9_fingerprints": op9_fingerprints,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op2_secret_scan": ORACLE_OP2,
    "op3_decontaminate": ORACLE_OP3,
    "op5_licence_scan": ORACLE_OP5,
    "op7_near_duplicates": ORACLE_OP7,
    "op10_warc_revisits": ORACLE_OP10,
    "op11_merkle_manifest": ORACLE_OP11,
    "op12_vector_codes": ORACLE_OP12,
}

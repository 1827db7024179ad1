"""Registered queries of this package and the SQL stating their results."""

from __future__ import annotations

from .warc import op1_warc
from .centroids import OP13_SQL, op13_centroids
from .embeddings import OP3_SQL, op3_embeddings
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .licenses import OP12_SQL, op12_licenses
from .minhash import OP5_SQL, op5_minhash
from .mixing import OP4_SQL, op4_mixing
from .packing import op8_packing
from .pii import op9_surrogates
from .repetition import OP6_SQL, op6_repetition
from .resample import op10_resample
from .token_files import op2_token_files
from .toxicity import op7_toxicity

QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_files": op2_token_files,
    "op3_embeddings": op3_embeddings,
    "op4_mixing": op4_mixing,
    "op5_minhash": op5_minhash,
    "op6_repetition": op6_repetition,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_surrogates": op9_surrogates,
    "op10_resample": op10_resample,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_licenses": op12_licenses,
    "op13_centroids": op13_centroids,
}
ORACLE = {"op3_embeddings": OP3_SQL, "op5_minhash": OP5_SQL, "op4_mixing": OP4_SQL, "op6_repetition": OP6_SQL,
          "op11_fill_in_middle": OP11_SQL, "op12_licenses": OP12_SQL, "op13_centroids": OP13_SQL}

"""The training-data operators as queries over the shared tables."""

from __future__ import annotations

from .chat import op8_chat_format
from .decontamination import op4_decontamination
from .html_wrappers import op2_html_wrappers
from .iblt import op10_iblt_fingerprints
from .importance import OP11_SQL, op11_resample
from .language_id import op6_language_id
from .licenses import OP5_SQL, op5_license_scan
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP1_SQL, op1_mix_sources
from .neighbours import op13_nearest
from .sharding import op7_shuffle_shards
from .simhash import op9_simhash_components
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_html_wrappers,
        op3_toxicity,
        op4_decontamination,
        op5_license_scan,
        op6_language_id,
        op7_shuffle_shards,
        op8_chat_format,
        op9_simhash_components,
        op10_iblt_fingerprints,
        op11_resample,
        op12_merkle_manifest,
        op13_nearest,
    )
}

ORACLE_SQL = {"op1_mix_sources": OP1_SQL, "op5_license_scan": OP5_SQL, "op11_resample": OP11_SQL, "op12_merkle_manifest": OP12_SQL}

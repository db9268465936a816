"""The registered queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import flac, langid, minhash, packing, quality, repeats, slots, spcodec, sptransducer, vectors

QUERIES = {
    "op1_flac": flac.op1_flac,
    "op2_quality_fm": quality.op2_quality_fm,
    "op3_virtual_slots": slots.op3_virtual_slots,
    "op4_packing": packing.op4_packing,
    "op5_minhash": minhash.op5_minhash,
    "op6_suffix_repeats": repeats.op6_suffix_repeats,
    "op7_token_counts": sptransducer.op7_token_counts,
    "op8_sentencepiece": spcodec.op8_sentencepiece,
    "op9_vector_graph": vectors.op9_vector_graph,
    "op10_language_id": langid.op10_language_id,
}

ORACLE_SQL: dict[str, str] = {}

"""The queries of this folder, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from spendlens.llm import decontaminate, exactdedup, infill, minhash, packing, pii, quality, secrets, spelling, tokenfiles, toxicity, urls, vectors

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_minhash": minhash.op2_minhash,
    "op3_tokenfiles": tokenfiles.op3_tokenfiles,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secrets": secrets.op6_secrets,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_exactdedup": exactdedup.op9_exactdedup,
    "op10_urls": urls.op10_urls,
    "op11_infill": infill.op11_infill,
    "op12_vectors": vectors.op12_vectors,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL = {"op9_exactdedup": exactdedup.OP9_SQL, "op11_infill": infill.OP11_SQL, "op12_vectors": vectors.OP12_SQL}

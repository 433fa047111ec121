"""The operators' queries, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import embeddings, langid, licences, lm, mixing, packing, phrases, pii, rules, secrets, simhash, substrings, whitening

QUERIES = {
    f.__name__: f
    for f in (
        embeddings.op1_embedding_near_dedup,
        lm.op2_lm_scoring,
        simhash.op3_simhash_near_dedup,
        packing.op4_pack_windows,
        substrings.op5_substring_dedup,
        mixing.op6_mix_sources,
        langid.op7_language_id,
        pii.op8_personal_data,
        rules.op9_quality_rules,
        secrets.op10_secret_scan,
        phrases.op11_phrase_collocations,
        whitening.op12_embedding_whitening,
        licences.op13_license_scan,
    )
}
SQL: dict[str, str] = {"op6_mix_sources": mixing.OP6_SQL, "op9_quality_rules": rules.OP9_SQL, "op11_phrase_collocations": phrases.OP11_SQL}

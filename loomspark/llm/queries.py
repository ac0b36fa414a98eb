"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, language_cnn, lattice_lm, license_scan, line_dedup, merkle_manifest, near_dups, periodic_runs, quality_mcd, sentencepiece_stream, token_orc, toxicity_kn


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepiece_stream.op1_sentencepiece,
        "op2_quality_mcd": quality_mcd.op2_quality_mcd,
        "op3_token_orc": token_orc.op3_token_orc,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_toxicity_kn": toxicity_kn.op6_toxicity_kn,
        "op7_near_dups": near_dups.op7_near_dups,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_lattice_lm": lattice_lm.op9_lattice_lm,
        "op10_language_cnn": language_cnn.op10_language_cnn,
        "op11_runs": periodic_runs.op11_runs,
        "op12_merkle": merkle_manifest.op12_merkle,
        "op13_chat_format": chat_format.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.OP4_SQL, "op7_near_dups": near_dups.OP7_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op12_merkle": merkle_manifest.OP12_SQL, "op13_chat_format": chat_format.OP13_SQL}

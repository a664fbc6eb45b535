"""The queries of this subpackage and the SQL that some must agree with."""

from ridgeline.llm import decontaminate, imatch, langid, mixing, pii, quality, secrets, simhash, substrings, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_pii": pii.op2_pii,
    "op3_substrings": substrings.op3_substrings,
    "op4_quality": quality.op4_quality,
    "op5_secret_ledger": secrets.op5_secret_ledger,
    "op6_warc": warc.op6_warc,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_imatch": imatch.op8_imatch,
    "op9_simhash": simhash.op9_simhash,
    "op10_language": langid.op10_language,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_substrings": substrings.ORACLE,
    "op5_secret_ledger": secrets.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
}

"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from trigflow.llm import (
    crosstoken, decontaminate, kdshards, licenses, packing, quality, repeats, secrets, simhash, toxicity, urlfilter, warc,
    whitening,
)

QUERIES = {
    "op1_suffix_array_dedup": repeats.op1_suffix_array_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_simhash": simhash.op4_simhash,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_url_filters": urlfilter.op9_url_filters,
    "op10_warc": warc.op10_warc,
    "op11_whitening": whitening.op11_whitening,
    "op12_kd_sharding": kdshards.op12_kd_sharding,
    "op13_crosstoken": crosstoken.op13_crosstoken,
}

ORACLE = {
    "op1_suffix_array_dedup": repeats.ORACLE_SQL,
    "op2_quality_rules": quality.ORACLE_SQL,
    "op8_secret_scans": secrets.ORACLE_SQL,
    "op9_url_filters": urlfilter.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op12_kd_sharding": kdshards.ORACLE_SQL,
}

"""The queries of the thirteen operators and of the corpus pipeline, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from . import op1_repeats, op2_decontaminate, op3_packing, op4_frames, op5_jaccard, op6_quality, op7_urls, op8_secrets, op9_fingerprints, op10_language, op11_audit, op12_alignment, op13_simhash

QUERIES = {
    "op1_repeats": op1_repeats.query,
    "op2_decontaminate": op2_decontaminate.query,
    "op3_packing": op3_packing.query,
    "op4_frames": op4_frames.query,
    "op5_jaccard": op5_jaccard.query,
    "op6_quality": op6_quality.query,
    "op7_urls": op7_urls.query,
    "op8_secrets": op8_secrets.query,
    "op9_fingerprints": op9_fingerprints.query,
    "op10_language": op10_language.query,
    "op11_audit": op11_audit.query,
    "op12_alignment": op12_alignment.query,
    "op13_simhash": op13_simhash.query,
}
SQL = {"op2_decontaminate": op2_decontaminate.SQL, "op5_jaccard": op5_jaccard.SQL, "op7_urls": op7_urls.SQL, "op11_audit": op11_audit.SQL}


def pipeline(spark, sf_dir):
    """The corpus pipeline at the top of the repository, which stands and goes with this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

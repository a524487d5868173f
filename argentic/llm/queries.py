"""The queries of this subpackage and their SQL."""

from . import (
    decontamination,
    language_id,
    language_model,
    mixing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    simhash,
    substrings,
)


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_substrings": substrings.op4_substrings,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_secrets": secrets.op7_secrets,
    "op8_language_model": language_model.op8_language_model,
    "op9_quality": quality_classifier.op9_quality,
    "op10_language_id": language_id.op10_language_id,
    "pipeline": _pipeline,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_secrets": secrets.ORACLE,
}

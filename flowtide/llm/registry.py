"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from flowtide.session import ship

from . import decontam, langid, lm, media, mixing, neardup, negatives, ngramjoin, periods, sharding, suffixes, tokens, urls

_OPERATORS = [
    sharding.op1_flow_resharding,
    lm.op2_cross_entropy_difference,
    suffixes.op3_sparse_suffixes,
    langid.op4_language_id,
    urls.op5_url_filters,
    mixing.op6_apportioned_mix,
    neardup.op7_bag_minhash,
    media.op8_avi_mjpeg,
    tokens.op9_token_attribution,
    decontam.op10_decontamination,
    ngramjoin.op11_ngram_jaccard,
    periods.op12_periodic_runs,
    negatives.op13_hard_negatives,
]


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    run.__name__ = f.__name__
    return run


QUERIES = {f.__name__: _shipped(f) for f in _OPERATORS}
ORACLES = {
    "op5_url_filters": urls.OP5_SQL, "op6_apportioned_mix": mixing.OP6_SQL, "op11_ngram_jaccard": ngramjoin.OP11_SQL, "op12_periodic_runs": periods.OP12_SQL, "op13_hard_negatives": negatives.OP13_SQL,
}

"""The queries of the training-data operators."""

from __future__ import annotations

from cadastra.llm import alignment, exact, knn, language, mixing, near, packing, planes, quality, ranks, repair, urls, warc

QUERIES = {
    "op1_crf_quality": quality.op1_crf_quality,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op3_poisson_mix": mixing.op3_poisson_mix,
    "op4_best_fit": packing.op4_best_fit,
    "op5_url_ratio": urls.op5_url_ratio,
    "op6_superminhash": near.op6_superminhash,
    "op7_cross_parse": language.op7_cross_parse,
    "op8_extendible_hash": exact.op8_extendible_hash,
    "op9_bit_planes": planes.op9_bit_planes,
    "op10_voronoi_knn": knn.op10_voronoi_knn,
    "op11_rank_array": ranks.op11_rank_array,
    "op12_gallop_align": alignment.op12_gallop_align,
    "op13_path_ranks": repair.op13_path_ranks,
}
ORACLE_SQL = {
    "op2_warc_revisits": warc.OP2_SQL,
    "op3_poisson_mix": mixing.OP3_SQL,
    "op6_superminhash": near.OP6_SQL,
    "op8_extendible_hash": exact.OP8_SQL,
    "op10_voronoi_knn": knn.OP10_SQL,
}

"""The queries of the operators, each over its whole table, and their SQL where SQL can say them."""

from worksignal.llm.bagminhash import op3_bagminhash
from worksignal.llm.chunking import op10_chunking
from worksignal.llm.collocations import OP13_SQL, op13_collocations
from worksignal.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from worksignal.llm.interpolation import op6_interpolation
from worksignal.llm.language_id import op5_language_id
from worksignal.llm.license_scan import op2_license_scan
from worksignal.llm.mixing import OP8_SQL, op8_mixing
from worksignal.llm.nn_descent import op7_nn_descent
from worksignal.llm.pieces import op4_sentencepiece
from worksignal.llm.range_join import OP9_SQL, op9_range_join
from worksignal.llm.rule_ensemble import op11_rule_ensemble
from worksignal.llm.url_filter import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_license_scan": op2_license_scan,
    "op3_bagminhash": op3_bagminhash,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_interpolation": op6_interpolation,
    "op7_nn_descent": op7_nn_descent,
    "op8_mixing": op8_mixing,
    "op9_range_join": op9_range_join,
    "op10_chunking": op10_chunking,
    "op11_rule_ensemble": op11_rule_ensemble,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op8_mixing": OP8_SQL, "op9_range_join": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_collocations": OP13_SQL}

"""Queries of the corpus operators and their SQL counterparts."""

from facetry.llm.ann import op9_ann
from facetry.llm.chat import OP7_SQL, op7_chat_formatting
from facetry.llm.decontaminate import op6_decontamination
from facetry.llm.interpolation import op11_interpolation
from facetry.llm.licenses import op10_licenses
from facetry.llm.line_dedup import op4_line_dedup
from facetry.llm.near_dups import op5_near_dups
from facetry.llm.packing import op1_packing
from facetry.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from facetry.llm.quality import op2_quality
from facetry.llm.sharding import op3_sharding
from facetry.llm.spelling import OP13_SQL, op13_spelling
from facetry.llm.warc import op8_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dups": op5_near_dups,
    "op6_decontamination": op6_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_warc": op8_warc,
    "op9_ann": op9_ann,
    "op10_licenses": op10_licenses,
    "op11_interpolation": op11_interpolation,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}
SQL = {"op7_chat_formatting": OP7_SQL, "op12_prefix_trie": OP12_SQL, "op13_spelling": OP13_SQL}

"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fillgauge.llm import ship
from fillgauge.llm.bpe import op9_byte_bpe
from fillgauge.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from fillgauge.llm.hmm import op10_hmm
from fillgauge.llm.html_text import op6_html_text
from fillgauge.llm.language import op3_language_id
from fillgauge.llm.near_dup import op7_order_minhash
from fillgauge.llm.packing import op8_packing
from fillgauge.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from fillgauge.llm.quality import op4_quality_rules
from fillgauge.llm.repeats import op12_repeats
from fillgauge.llm.search import OP13_SQL, op13_ranked_search
from fillgauge.llm.sharding import op2_sharding
from fillgauge.llm.url_filter import OP1_SQL, op1_url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    run.__doc__ = query.__doc__
    return run


_ALL: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_text": op6_html_text,
    "op7_order_minhash": op7_order_minhash,
    "op8_packing": op8_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_hmm": op10_hmm,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_repeats": op12_repeats,
    "op13_ranked_search": op13_ranked_search,
}
QUERIES: dict[str, Query] = {name: _shipped(query) for name, query in _ALL.items()}
ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}

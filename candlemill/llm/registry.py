"""Queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from candlemill.llm.decontam import OP2_SQL, op2_benchmark_decontamination
from candlemill.llm.html import op1_html_extraction
from candlemill.llm.jaccard import OP12_SQL, op12_ngram_jaccard_join
from candlemill.llm.lines import op7_line_dedup
from candlemill.llm.packing import op4_best_fit_packing
from candlemill.llm.passages import op3_substring_dedup
from candlemill.llm.phrases import OP13_SQL, op13_phrase_collocations
from candlemill.llm.pii import op6_pii
from candlemill.llm.quality import op10_quality_rules
from candlemill.llm.simhash import op9_simhash_near_dedup
from candlemill.llm.spelling import OP11_SQL, op11_spelling_variants
from candlemill.llm.urls import OP8_SQL, op8_url_filter
from candlemill.llm.warc import OP5_SQL, op5_warc


def queries():
    return {
        f.__name__: f
        for f in (
            op1_html_extraction, op2_benchmark_decontamination, op3_substring_dedup, op4_best_fit_packing, op5_warc,
            op6_pii, op7_line_dedup, op8_url_filter, op9_simhash_near_dedup, op10_quality_rules,
            op11_spelling_variants, op12_ngram_jaccard_join, op13_phrase_collocations,
        )
    }


def oracle_sql():
    return {
        "op2_benchmark_decontamination": OP2_SQL, "op5_warc": OP5_SQL, "op8_url_filter": OP8_SQL, "op11_spelling_variants": OP11_SQL,
        "op12_ngram_jaccard_join": OP12_SQL, "op13_phrase_collocations": OP13_SQL,
    }

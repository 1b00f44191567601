"""Name -> query and name -> DuckDB SQL of this package."""

from __future__ import annotations

from barlane.llm import op01_sstable, op02_compression, op03_sentencepiece, op04_line_dedup, op05_jaccard, op06_language, op07_quality, op08_chat, op09_decontaminate, op10_toxicity, op11_mixing, op12_runs, op13_collocations

#: op N: (query name, module attribute).
QUERIES = {
    "op1_sstable": op01_sstable.op1_sstable,
    "op2_compression": op02_compression.op2_compression,
    "op3_sentencepiece": op03_sentencepiece.op3_sentencepiece,
    "op4_line_dedup": op04_line_dedup.op4_line_dedup,
    "op5_jaccard": op05_jaccard.op5_jaccard,
    "op6_language": op06_language.op6_language,
    "op7_quality": op07_quality.op7_quality,
    "op8_chat": op08_chat.op8_chat,
    "op9_decontaminate": op09_decontaminate.op9_decontaminate,
    "op10_toxicity": op10_toxicity.op10_toxicity,
    "op11_mixing": op11_mixing.op11_mixing,
    "op12_runs": op12_runs.op12_runs,
    "op13_collocations": op13_collocations.op13_collocations,
    # More of the same operator's results.
    "op5_jaccard_links": op05_jaccard.op5_jaccard_links,
    "op9_decontaminate_every_id": op09_decontaminate.op9_decontaminate_every_id,
}
SQL: dict[str, str] = {
    "op4_line_dedup": op04_line_dedup.SQL,
    "op5_jaccard": op05_jaccard.SQL,
    "op5_jaccard_links": op05_jaccard.SQL_LINKS,
    "op8_chat": op08_chat.SQL,
    "op9_decontaminate": op09_decontaminate.SQL,
    "op9_decontaminate_every_id": op09_decontaminate.SQL_EVERY_ID,
    "op11_mixing": op11_mixing.SQL,
    "op13_collocations": op13_collocations.SQL,
}


def queries() -> dict:
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

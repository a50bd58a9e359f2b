"""Names, queries and oracle SQL of the corpus operators."""

from __future__ import annotations

import corpus_pipeline
from quire.llm import bpe, chat, htmlcrf, langid, linededup, mips, packing, simhash, vamana, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_warc_zstd": warc.op2_warc_zstd,
        "op3_packing": packing.op3_packing,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_simhash": simhash.op5_simhash,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_vamana": vamana.op7_vamana,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_html_crf": htmlcrf.op9_html_crf,
        "op10_exact_mips": mips.op10_exact_mips,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_zstd": warc.OP2_SQL, "op6_line_dedup": linededup.OP6_SQL, "op8_chat_formatting": chat.OP8_SQL, "op10_exact_mips": mips.OP10_SQL}

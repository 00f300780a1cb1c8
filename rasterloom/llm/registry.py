"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from rasterloom.llm import bpe, collocations, decontaminate, embeddings, html, lines, lm, quality, resample, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_lm": lm.op1_lm,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_bpe": bpe.op3_bpe,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_simhash": simhash.op5_simhash,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secrets": secrets.op7_secrets,
    "op8_html": html.op8_html,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
    "op11_lines": lines.op11_lines,
    "op12_resample": resample.op12_resample,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL = {"op2_embeddings": embeddings.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op11_lines": lines.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}

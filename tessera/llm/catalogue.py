"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import licenses, mixing, neardup, passages, pieces, pii, quality, urls, vectors, warc


def queries() -> dict:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_passages": passages.op2_passages,
        "op3_neardup": neardup.op3_neardup,
        "op4_mixing": mixing.op4_mixing,
        "op5_warc": warc.op5_warc,
        "op6_vectors": vectors.op6_vectors,
        "op7_quality": quality.op7_quality,
        "op8_licenses": licenses.op8_licenses,
        "op9_pii": pii.op9_pii,
        "op10_url_filter": urls.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_neardup": neardup.SQL, "op4_mixing": mixing.SQL, "op5_warc": warc.SQL, "op6_vectors": vectors.SQL, "op7_quality": quality.SQL, "op9_pii": pii.SQL, "op10_url_filter": urls.SQL}

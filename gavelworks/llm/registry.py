"""Queries of this package for ``__spark_entry__``."""

from __future__ import annotations

from . import align, bytebpe, chat, fertility, jaccard, langid, license, media, merkle, mixing, pii, sitetree, unigram

QUERIES = {
    "op1_media_copies": media.op1,
    "op2_language_id": langid.op2,
    "op3_mixing": mixing.op3,
    "op4_ngram_jaccard_join": jaccard.op4,
    "op5_sentencepiece": unigram.op5,
    "op6_pii": pii.op6,
    "op7_quality_fertility": fertility.op7,
    "op8_license_scan": license.op8,
    "op9_html_site_tree": sitetree.op9,
    "op10_chat_format": chat.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_byte_bpe": bytebpe.op12,
    "op13_token_alignment": align.op13,
}
ORACLES = {
    "op3_mixing": mixing.oracle(),
    "op4_ngram_jaccard_join": jaccard.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
}

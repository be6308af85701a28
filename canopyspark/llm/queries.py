"""The queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, linededup, minhash, mixing, quality, sharding, suffixes, syncmers, tokenfile, topk, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_topk": topk.query,
    "op2_syncmer_fingerprints": syncmers.query,
    "op3_minhash_dedup": minhash.query,
    "op4_quality": quality.query,
    "op5_mix_sources": mixing.query,
    "op6_bpe": bpe.query,
    "op7_suffix_dedup": suffixes.query,
    "op8_shards": sharding.query,
    "op9_token_files": tokenfile.query,
    "op10_line_dedup": linededup.query,
    "op11_whitening": whitening.query,
    "op12_chat": chat.query,
}

ORACLES: dict[str, str] = {
    "op1_pivot_topk": topk.ORACLE,
    "op3_minhash_dedup": minhash.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
    "op12_chat": chat.ORACLE,
}

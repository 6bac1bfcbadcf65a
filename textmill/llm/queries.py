"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from textmill.llm import bpe, chroma, debruijn, exact, html, itq, language, minhash, mixing, secrets, spelling, suffixes, tournament

QUERIES = {f.__name__: f for f in (html.op1_main_text, mixing.op2_mix_sources, language.op3_language_id, itq.op4_embedding_near_dups, secrets.op5_secret_scans, bpe.op6_byte_bpe, suffixes.op7_suffix_dedup, chroma.op8_audio_fingerprints, minhash.op9_near_duplicates, debruijn.op10_repeated_spans, spelling.op11_spelling_variants, exact.op12_exact_dedup, tournament.op13_centroid_clusters)}
ORACLE = {"op2_mix_sources": mixing.OP2_SQL, "op12_exact_dedup": exact.OP12_SQL}

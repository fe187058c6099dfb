"""The queries of this subpackage by name, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import bpe, hilbert, langid, licenses, lines, lm, media, neardup, packing, quality, structure, trie, warc

QUERIES = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op10_bottom_k_dedup": neardup.op10_bottom_k_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_kneser_ney": lm.op3_kneser_ney,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_language_crf": langid.op6_language_crf,
    "op7_media": media.op7_media,
    "op9_line_quality": quality.op9_line_quality,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_structure_repair": structure.op13_structure_repair,
    "op8_hilbert_shards": hilbert.op8_hilbert_shards,
}
ORACLES: dict[str, str] = {
    "op1_warc_revisits": warc.oracle(),
    "op4_license_scan": licenses.oracle(),
    "op11_prefix_trie": trie.oracle(),
    "op12_line_dedup": lines.oracle(),
    "op13_structure_repair": structure.oracle(),
}

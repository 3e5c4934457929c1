"""The queries of this folder, with SQL where SQL can say the same."""

from __future__ import annotations

from keelson.llm import (
    chat,
    containment,
    hard_negatives,
    line_dedup,
    near_dups,
    packing,
    phrases,
    pitman_yor,
    secrets,
    syncmers,
    token_files,
    toxicity,
    url_rules,
)

QUERIES = {
    "op1_pitman_yor": pitman_yor.op1_pitman_yor,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_chat": chat.op3_chat,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_containment": containment.op5_containment,
    "op6_syncmers": syncmers.op6_syncmers,
    "op7_packing": packing.op7_packing,
    "op8_token_files": token_files.op8_token_files,
    "op9_near_dups": near_dups.op9_near_dups,
    "op10_secrets": secrets.op10_secrets,
    "op11_phrases": phrases.op11_phrases,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op2_url_rules": url_rules.SQL.strip(),
    "op3_chat": chat.SQL.strip(),
    "op5_containment": containment.SQL.strip(),
    "op11_phrases": phrases.SQL.strip(),
    "op12_line_dedup": line_dedup.SQL.strip(),
    "op13_hard_negatives": hard_negatives.SQL.strip(),
}

"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat, decontaminate, fim, licenses, linedup, lm, packing, resample, spelling, superminhash, toxicity, urlfilter, vectorgraph


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            toxicity.op1_counterfactual_toxicity,
            packing.op2_cutting_stock,
            resample.op3_gumbel_resampling,
            vectorgraph.op4_flat_graph,
            licenses.op5_license_dice,
            superminhash.op6_superminhash,
            decontaminate.op7_cgk_leaks,
            lm.op8_kneser_ney,
            chat.op9_event_chat,
            linedup.op10_line_chunks,
            urlfilter.op11_url_sweep,
            spelling.op12_half_dictionaries,
            fim.op13_chunked_fim,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_dice": licenses.SQL, "op9_event_chat": chat.SQL, "op11_url_sweep": urlfilter.SQL, "op13_chunked_fim": fim.SQL}

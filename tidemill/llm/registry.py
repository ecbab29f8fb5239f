"""The queries of this subpackage and their SQL."""

from tidemill.llm import chat, filteraudit, fingerprints, htmltext, langid, lexical, media, mixing, ngramjoin, packing, sharding, toxicity, winnowing


def queries() -> dict:
    return {
        "op1_media": media.op1_media,
        "op2_langid": langid.op2_langid,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_mixing": mixing.op4_mixing,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_chat": chat.op6_chat,
        "op7_sharding": sharding.op7_sharding,
        "op8_htmltext": htmltext.op8_htmltext,
        "op9_packing": packing.op9_packing,
        "op10_ngramjoin": ngramjoin.op10_ngramjoin,
        "op11_lexical": lexical.op11_lexical,
        "op12_filteraudit": filteraudit.op12_filteraudit,
        "op13_winnowing": winnowing.op13_winnowing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op7_sharding": sharding.op7_sql(),
        "op10_ngramjoin": ngramjoin.OP10_SQL,
        "op11_lexical": lexical.OP11_SQL,
        "op12_filteraudit": filteraudit.OP12_SQL,
        "op13_winnowing": winnowing.OP13_SQL,
    }

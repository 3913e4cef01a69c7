"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import de_bruijn, dual_tree, fill_middle, oracles
from .de_bruijn import op12_de_bruijn
from .decontamination import op4_decontamination
from .dual_tree import op13_dual_tree
from .fill_middle import op11_fill_in_middle
from .jaccard_join import op10_jaccard_join
from .language_id import op5_language_id
from .markov_lm import op8_markov_lm
from .packing import op3_best_fit_packing
from .secret_scan import op7_secret_scan
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op6_toxicity
from .warc import op1_warc_derivatives, oracle
from .weighted_fingerprint import op9_weighted_fingerprint

QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_markov_lm": op8_markov_lm,
    "op9_weighted_fingerprint": op9_weighted_fingerprint,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_de_bruijn": op12_de_bruijn,
    "op13_dual_tree": op13_dual_tree,
}

ORACLES: dict[str, str] = {
    "op1_warc_derivatives": oracle(),
    "op4_decontamination": oracles.decontamination(),
    "op10_jaccard_join": oracles.jaccard_join(),
    "op11_fill_in_middle": fill_middle.oracle(),
    "op12_de_bruijn": de_bruijn.oracle(),
    "op13_dual_tree": dual_tree.oracle(),
}

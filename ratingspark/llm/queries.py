"""The registered queries of the operators, and SQL that gives the same rows where SQL can."""

from ratingspark.llm.chat_format import OP13_SQL, op13_chat_format
from ratingspark.llm.collocations import OP11_SQL, op11_collocations
from ratingspark.llm.hmm_lm import op1_hmm_lm
from ratingspark.llm.language_id import op10_language_id
from ratingspark.llm.line_dedup import OP5_SQL, op5_line_dedup
from ratingspark.llm.mixing import op2_mixing
from ratingspark.llm.pieces import op3_sentencepiece
from ratingspark.llm.posting_lists import op7_posting_lists
from ratingspark.llm.quality import op9_quality_rules
from ratingspark.llm.secret_scan import op8_secret_scan
from ratingspark.llm.simhash_trie import op4_simhash_trie
from ratingspark.llm.toxicity import op6_toxicity
from ratingspark.llm.whitening import op12_whitening

QUERIES = {
    "op2_mixing": op2_mixing,
    "op1_hmm_lm": op1_hmm_lm,
    "op3_sentencepiece": op3_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op4_simhash_trie": op4_simhash_trie,
    "op5_line_dedup": op5_line_dedup,
    "op7_posting_lists": op7_posting_lists,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_chat_format": op13_chat_format,
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op11_collocations": OP11_SQL,
    "op13_chat_format": OP13_SQL,
}

"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from kilnwork.llm.cover_tree import OP10_SQL, op10_cover_tree
from kilnwork.llm.forest_join import OP9_SQL, op9_jaccard_join
from kilnwork.llm.language import op5_language
from kilnwork.llm.line_dedup import OP4_SQL, op4_line_dedup
from kilnwork.llm.mixing import op8_mixing
from kilnwork.llm.positional import OP3_SQL, op3_decontamination, op3_proximity
from kilnwork.llm.quality import op2_quality
from kilnwork.llm.secrets import op7_secrets
from kilnwork.llm.token_shards import op6_token_output
from kilnwork.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op3_proximity": op3_proximity,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_token_output": op6_token_output,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_cover_tree": op10_cover_tree,
}
SQL = {"op3_decontamination": OP3_SQL, "op4_line_dedup": OP4_SQL, "op9_jaccard_join": OP9_SQL, "op10_cover_tree": OP10_SQL}

"""Tokens of the public BERT basic tokenizer, as Java regular expressions.

Split at white space; each punctuation character (Unicode P and the other ASCII symbols) and each CJK ideograph is a
token of its own; control and format characters don't count and don't separate. Letters keep their case and accents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the tokenizer's character classes
PUNCT = r"\p{P}$+<=>^`|~"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
SPACE = r"\t\n\r\p{Z}"
SILENT = r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\p{Cf}\x{FFFD}"

OTHER = rf"[^{SPACE}{PUNCT}{CJK}{SILENT}]"
MORE = rf"[^{SPACE}{PUNCT}{CJK}]*+"
ASCII_PUNCT = r"!-/:-@\[-`{-~"
#: ASCII words and marks come first and take the spaces after them along: their classes are tables, those of other
#: characters long lists of tests, which spaces would go through otherwise.
TOKEN = rf"[a-zA-Z0-9]++(?:[ \n]++|{MORE})|[{ASCII_PUNCT}][ \n]*+|[{PUNCT}]|[{CJK}]|{OTHER}{MORE}"
TAIL = rf"[{SPACE}{SILENT}]*+"


def token_count(text: Column | str) -> Column:
    """Number of tokens; 0 for null and empty texts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0)).cast("bigint")


#: The same in DuckDB's dialect (RE2), for checks.
TOKEN_RE2 = TOKEN.replace("*+", "*").replace("++", "+")

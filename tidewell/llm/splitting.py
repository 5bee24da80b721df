"""Splitting long texts at natural boundaries, with overlap.

A text becomes a string of one letter a token, which tells the strongest boundary after that token: a section heading
follows (H), a paragraph ends (P), a claim follows (C), a sentence ends (S), a line ends (L), nothing (x). A regular
expression with bounded quantifiers consumes that string; its alternatives stand in the order of boundary strength and
end with the bare limit. Lengths of the matches are token counts, from which array functions slice the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tokens import ASCII_PUNCT, CJK, OTHER, PUNCT, SILENT, SPACE, TAIL, TOKEN, token_count

LIMIT, OVERLAP = 1000, 100
STRENGTHS = "HPCSLx"

#: A line that looks like a section heading: marked as one, or short, begun with a capital or an ideograph, and without
#: punctuation. Callers that know their headings give them instead.
HEADING = r"#{1,6} [^\n]++|\p{Lu}[^\n.!?;:,]{0,39}+|\p{Lo}[^\n.!?;:,。！？；：，、]{0,11}+"
#: Pieces of a text whose lengths are added up together.
BLOCK = 256

# boundaries are first put into the text as noncharacters; a text that holds one of these shows x in its place
_MARK = {s: chr(0xFDD0 + i) for i, s in enumerate(STRENGTHS)}
_MARKS = r"\x{FDD0}-\x{FDEF}"
_LETTER = {s: chr(0xE000 + i) for i, s in enumerate(STRENGTHS)}
_BLANK = rf"[{SPACE}{SILENT}]*+"
_MORE = rf"[^{SPACE}{PUNCT}{CJK}{_MARKS}]*+"
_TOK = rf"(?:[a-zA-Z0-9]++(?: ++|{_MORE})|[{ASCII_PUNCT}] *+|[{PUNCT}]|[{CJK}]|{OTHER[:-1]}{_MARKS}]{_MORE})"


def _marks(heading: str) -> list[tuple[str, str]]:
    """Patterns of the boundaries in the text, and what stands for each. All but the sentence start at a line end."""
    return [
        (rf"\n{_BLANK}(?=(?:{heading})[ \t\r]*+(?:\n|$))", _MARK["H"]),
        (rf"\n[ \t\r]*+(?:\n{_BLANK}|(?=\[\d+\]))", _MARK["P"]),
        (r"\n[ \t\r]*+(?=\d{1,3}[.)][ \t])", _MARK["C"]),
        (rf"([.!?][\"”’)\]]?)(?=[{SPACE}{_MARKS}]|$)|([。！？])", f"$1$2{_MARK['S']}"),
        (r"\n", _MARK["L"]),
    ]


def boundary_string(text: Column, heading: str = HEADING) -> Column:
    """One letter of ``STRENGTHS`` for each token: the strongest boundary between it and the next."""
    c = F.regexp_replace(text, f"[{_MARKS}]", "x")
    for pattern, mark in _marks(heading):
        c = F.regexp_replace(c, pattern, mark)
    c = F.regexp_replace(c, rf"{_TOK}{_BLANK}", "x")
    # left are x, marks and white space around them: short strings
    c = F.regexp_replace(F.regexp_replace(c, rf"[^x{_MARKS}]+", ""), rf"^[{_MARKS}]+", "")
    for s in STRENGTHS[:-1]:
        c = F.regexp_replace(c, rf"x[{_MARKS}]*?{_MARK[s]}[{_MARKS}]*+", _LETTER[s])
    return F.translate(c, "".join(_LETTER[s] for s in STRENGTHS[:-1]), STRENGTHS[:-1])


def cut_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """What one match consumes: the rest if it fits, else at least half of the limit up to the strongest boundary."""
    def upto(n: int, anchor: str) -> list[str]:
        return [f"{anchor}.{{1,{n}}}$", *(f"{anchor}.{{{max(n // 2 - 1, 0)},{n - 1}}}{s}" for s in STRENGTHS[:-1]), f"{anchor}.{{{n}}}"]

    return "|".join(upto(limit, "^") + upto(limit - overlap, ""))


def _ends(cuts: str) -> Column:
    """Where each piece ends, from 0 on: running sums of the lengths of ``cuts``, by blocks first, so that a text of very
    many pieces isn't added up from its start for each."""
    lengths = F.transform(cuts, lambda c: F.length(c))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)

    def running(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda k: total(F.slice(n, k * BLOCK + 1, F.lit(BLOCK))))
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

        def upto(start: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(n)), lambda i: F.get(start, F.floor(i / BLOCK).cast("int")) + total(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))

        return F.flatten(F.transform(F.array(before), upto))

    # a lambda's variable is computed once, however often it is used
    return F.flatten(F.transform(F.array(lengths), running))


def split_documents(documents: DataFrame, ident: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, heading: str = HEADING) -> DataFrame:
    """``(doc_id, piece_no, n_pieces, first_token, n_tokens, overlap, overlap_chars, boundary, piece)`` of documents beyond
    ``limit``.

    Every piece has at most ``limit`` tokens; each but the first begins with the last ``overlap`` tokens of the one
    before, its first ``overlap_chars`` characters. Leaving those out, the pieces joined are the text, character by
    character (``rejoined``). Null and empty texts and those within the limit have no pieces. Rows stand for themselves,
    so repeated documents give repeated pieces. Nothing is shuffled: a document is cut where it is read. ``overlap`` must
    be below half of the limit. ``heading`` is the pattern of a line that begins a section.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be below half of the limit")
    long = documents.select(F.col(ident).alias("doc_id"), F.col(text).alias("t")).where(F.length("t") > limit).where(token_count("t") > limit)
    whole = rf"(?:^[{SPACE}{SILENT}]+)?(?:{TOKEN}){TAIL}"
    parts = long.select("doc_id", F.regexp_extract_all("t", F.lit(whole), F.lit(0)).alias("tokens"), F.regexp_extract_all(boundary_string(F.col("t"), heading), F.lit(cut_pattern(limit, overlap)), F.lit(0)).alias("cuts"))
    parts = parts.withColumn("ends", _ends("cuts"))

    def piece(i: Column) -> Column:
        back = F.when(i > 0, overlap).otherwise(0)
        first = F.get("ends", i) - back
        n = F.get("ends", i + 1) - first
        again = F.length(F.array_join(F.slice("tokens", first + 1, back), ""))
        return F.struct(
            i.alias("piece_no"), F.size("cuts").alias("n_pieces"), first.alias("first_token"), n.alias("n_tokens"), back.alias("overlap"), again.alias("overlap_chars"),
            F.right(F.get("cuts", i), F.lit(1)).alias("boundary"), F.array_join(F.slice("tokens", first + 1, n), "").alias("piece"),
        )

    made = parts.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("cuts") - 1), piece)).alias("p"))
    return made.select("doc_id", "p.*")


def rejoined(pieces: DataFrame) -> DataFrame:
    """``(doc_id, text, most_tokens)``: the texts again, from what each piece adds to the one before. A task gathers one
    text at a time. Documents must have different identifiers."""
    adds = F.expr("substring(piece, overlap_chars + 1)")
    g = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", adds.alias("adds")))).alias("p"), F.max("n_tokens").alias("most_tokens"))
    return g.select("doc_id", F.array_join("p.adds", "").alias("text"), "most_tokens")

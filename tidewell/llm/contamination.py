"""Evaluation texts in training text: latent semantic retrieval, then word-exact and subsequence checks.

Words of all documents are counted and cut into passages of ``SPAN`` words in one pass: a passage is a window of which all
words but ``SLACK`` at most occur in the evaluation set: every window that can keep ``ORDERED`` words of an item is one. Passages become TF-IDF vectors
(document frequencies over all documents); a randomised SVD, whose products with the passage matrix are distributed,
gives a latent space; candidates are the pairs of passages and item windows whose latent vectors have a cosine of at
least ``COSINE``. A copied window has the vector of its original, so cosine 1, whatever the quality of the space.
Candidates are then checked word by word.

Only what is bounded by the evaluation items reaches the driver or is sent to all tasks: their vocabulary, their latent
vectors and matrices of one row for each of their words. Items come in blocks of ``BLOCK`` words, so that vectors and
matrices are bounded for any evaluation set; only its vocabulary is held whole.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import materialise, shipped

SPAN = 13
#: A paraphrase keeps so many of a passage's words in their order; so at most SPAN - ORDERED of them may be foreign.
ORDERED = 10
SLACK = SPAN - ORDERED
RANK, EXTRA = 64, 8
COSINE, ANSWER = 0.8, 0.7
#: A copy's cosine is 1 but for rounding.
COPIED = 0.99
#: Words in order, and part of the information, of a passage whose words were moved about.
SHUFFLED = 8, 0.9
CELLS, PAIRS = 256, 500_000
BLOCK = 200_000
SLICE = 256

_NUMERAL = re.compile(r"[(\[]\s*\d+(?:\s*[,;.–-]\s*\d+)*\s*[)\]]")
_BREAK = re.compile("[-\xad\u2010\u2011](?<=[^\\W_].)[^\\S\n]*\n\\s*(?=[^\\W_])")
#: Beyond the basic plane invisible characters are rare enough for a pattern of their own.
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: What isn't ASCII and no letter or digit.
_SIGN = re.compile(r"[^\x00-\x7f\w]+")
#: Bytes of UTF-8: ASCII letters become small, other ASCII but digits becomes a space, the rest stays.
_SMALL = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


@functools.cache
def _invisible() -> tuple[re.Pattern, re.Pattern]:
    """Format characters and the other characters that show nothing, but for the soft hyphen: those of the basic plane,
    for which a table is compiled, and the rest."""
    odd = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    every = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and c != 0xAD} | set(map(chr, odd))
    basic, rest = (sorted(c for c in every if (c < "\U00010000") == low) for low in (True, False))
    return tuple(re.compile("[" + "".join(map(re.escape, part)) + "]") for part in (basic, rest))


def _plain(line: str) -> str:
    """A line that isn't ASCII: compatibility forms resolved, small letters, and a control character for its signs but
    the dash, which may stand within a numeral."""
    line = unicodedata.normalize("NFKC", line).replace("\xad", "").replace("–", "-").lower()
    for gap in "\x85\u1680\u2028\u2029":  # the white space that has no compatible space
        line = line.replace(gap, " ")
    return _SIGN.sub("\x01", line)


def _shown(line: str) -> str:
    basic, rest = _invisible()
    line = basic.sub("", line)
    return rest.sub("", line) if _ASTRAL.search(line) else line


def utf8_words(text: str | None) -> list[bytes]:
    """``words`` as UTF-8. Only lines that aren't ASCII are looked at by character; tables do the rest."""
    if not text:
        return []
    if not text.isascii():
        text = "\n".join([x if x.isascii() else _shown(x) for x in text.split("\n")])
        text = "\n".join([x if x.isascii() else _plain(x) for x in _BREAK.sub("", text).split("\n")])
    elif "-" in text:
        text = _BREAK.sub("", text)
    if "(" in text or "[" in text:
        text = _NUMERAL.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_SMALL).split()


def words(text: str | None) -> list[str]:
    """The words that count: runs of letters and digits without regard to case, punctuation, compatibility forms,
    invisible characters, line layout and bracketed numerals. None for null and empty texts."""
    return [w.decode() for w in utf8_words(text)]


# --- passages --------------------------------------------------------------------------------------------------------


def stretches(known: np.ndarray, span: int, slack: int) -> list[tuple[int, int]]:
    """Begin and end of each part of a text whose every window of ``span`` words has at most ``slack`` unknown ones."""
    if len(known) < span:
        return []
    sums = np.r_[0, np.cumsum(known)]
    good = sums[span:] - sums[:-span] >= span - slack
    edge = np.flatnonzero(np.diff(np.r_[False, good, False]))
    return [(a, b - 1 + span) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def passages(documents: DataFrame, vocabulary: dict[str, int], span: int, slack: int) -> DataFrame:
    """``(doc_id, start, ids, freqs, n_docs)``: stretches of texts, and for each task a row of document frequencies.

    Unknown words have the identifier after the last known one.
    """
    size = len(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, freq, seen = {w.encode(): k for w, k in vocabulary.items()}.get, np.zeros(size, dtype=np.int64), 0
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("ids", pa.list_(pa.int32())), ("freqs", pa.list_(pa.int64())), ("n_docs", pa.int64())])
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ids = np.fromiter(map(get, utf8_words(text), itertools.repeat(size)), dtype=np.int32)
                known = ids < size
                freq[np.unique(ids[known])] += 1
                seen += 1
                for a, b in stretches(known, span, slack):
                    for column, v in zip(out, (doc, a, ids[a:b])):
                        column.append(v)
            n = len(out[0])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32())), pa.nulls(n, schema.field(3).type), pa.nulls(n, pa.int64())], schema=schema)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, schema.field(2).type), pa.array([freq], schema.field(3).type), pa.array([seen], pa.int64())], schema=schema)

    return documents.mapInArrow(cut, "doc_id bigint, start int, ids array<int>, freqs array<bigint>, n_docs bigint")


def windows(ids: np.ndarray, span: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, span) if len(ids) >= span else np.empty((0, span), dtype=np.int32)


def able_windows(texts: list[np.ndarray], idf: np.ndarray, span: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words one after the other, where the windows start that are searched, and the begin of each text.

    Searched are windows of known words only, and those whose known words weigh ``least`` or more.
    """
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    if len(ids) < span:
        return ids, np.empty(0, dtype=np.int64), begin
    known = np.r_[0, np.cumsum(ids < len(idf) - 1)]
    weight = np.r_[0.0, np.cumsum(idf[ids], dtype=np.float64)]
    able = (known[span:] - known[:-span] == span) | (weight[span:] - weight[:-span] >= least - 1e-6)
    left = np.repeat(begin + lengths, lengths) - np.arange(len(ids))  # a window ends within its text
    return ids, np.flatnonzero(able & (left[: len(able)] >= span)), begin


def latent(w: np.ndarray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit vectors in ``space`` (words x dimensions) of windows of word ids. Term counts add up by themselves."""
    x = np.zeros((len(w), space.shape[1]), dtype=np.float32)
    for k in range(w.shape[1]):
        x += space[w[:, k]] * idf[w[:, k], None]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


# --- randomised SVD --------------------------------------------------------------------------------------------------


PARTS = "slice int, words binary, z binary"


def _part(k: int, words_: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a matrix, one for each of the words of slice ``k``, as a record of ``PARTS``."""
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([words_.astype(np.int32).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], names=["slice", "words", "z"])


def _gram(parts: DataFrame, idf: np.ndarray, q: np.ndarray, span: int, least: float = 0.0) -> np.ndarray:
    """A'(A q) of the TF-IDF matrix A of all passages, rows of unit length: summed by tasks, then by slices of words."""
    size, rank = q.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, any_ = np.zeros((size, rank)), False
        for batch in batches:
            texts, k = batch.column(0).to_numpy(zero_copy_only=False), 0
            while k < len(texts):  # about 65,536 words at a time; a longer text by itself
                n, stop = len(texts[k]), k + 1
                while stop < len(texts) and n + len(texts[stop]) <= 65_536:
                    n, stop = n + len(texts[stop]), stop + 1
                part, k = texts[k:stop], stop
                ids, at, _ = able_windows(part, idf, span, least)
                if not len(at):
                    continue
                any_ = True
                # words outside of these windows are left out; the windows stay in one piece
                edge = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + span, -1)
                cover = np.cumsum(edge)[:-1] > 0
                place = np.cumsum(cover) - 1
                ids, at = ids[cover], place[at]
                norm = _lengths(windows(ids, span)[at], idf)
                each = _moving(q[ids] * idf[ids, None], span)[at] / (norm**2)[:, None]  # the sum over each window
                total = np.zeros((len(ids), rank))
                total[at] = each
                # each word collects the windows that hold it, then each term its words
                back = _moving(total[::-1], span)[::-1] * idf[ids, None]
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
                z[ids[order][first]] += np.add.reduceat(back[order], first, axis=0)
        if any_:  # the words the task has met, by slices
            met = np.flatnonzero(z.any(axis=1))
            for k in np.unique(met // SLICE).tolist():
                mine = met[met // SLICE == k]
                yield _part(k, mine, z[mine])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # of the slices of this task only, whatever number of tasks sent parts of them
        for batch in batches:
            for k, words_, part in zip(*(batch.column(c).to_pylist() for c in range(3))):
                at = np.frombuffer(words_, dtype=np.int32)
                total.setdefault(k, np.zeros((SLICE, rank)))[at - k * SLICE] += np.frombuffer(part).reshape(len(at), rank)
        for k, part in total.items():
            met = np.flatnonzero(part.any(axis=1))
            yield _part(k, met + k * SLICE, part[met])

    sums = parts.select("ids").mapInArrow(multiply, PARTS).repartition("slice").mapInArrow(add, PARTS)
    z = np.zeros((size, rank))
    for r in sums.select("words", "z").collect():  # one row for every 256 words of the evaluation set
        at = np.frombuffer(r["words"], dtype=np.int32)
        z[at] = np.frombuffer(r["z"]).reshape(len(at), rank)
    return z


def _moving(x: np.ndarray, span: int) -> np.ndarray:
    """Row k is the sum of rows k to k + span - 1, as far as there are any."""
    sums = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    end = np.minimum(np.arange(len(x)) + span, len(x))
    return sums[end] - sums[:-1]


def _lengths(w: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Lengths of the TF-IDF vectors of windows; a word that comes c times weighs c squared."""
    flat = np.sort(w, axis=1)
    total = np.zeros(len(w))
    run = np.zeros(len(w))
    for k in range(w.shape[1]):
        run = run + 1 if k == 0 else np.where(flat[:, k] == flat[:, k - 1], run + 1, 1)
        total += (2 * run - 1) * idf[flat[:, k]] ** 2  # squares are sums of odd numbers
    return np.sqrt(total)


def latent_space(parts: DataFrame, idf: np.ndarray, span: int, rank: int = RANK, seed: int = 5, least: float = 0.0) -> np.ndarray:
    """The leading right singular vectors of the passage matrix, words x ``rank``, beside a faint random projection.

    Randomised SVD: a Gaussian test matrix, one subspace iteration, and the small symmetric problem in its range. The
    random part keeps vectors from vanishing that the leading directions don't see.
    """
    rng = np.random.default_rng(seed)
    size = len(idf)
    width = min(size, rank + EXTRA)
    q, _ = np.linalg.qr(_gram(parts, idf, rng.standard_normal((size, width)), span, least))
    z = _gram(parts, idf, q, span, least)
    value, vector = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    lead = q @ vector[:, np.argsort(-value)[:rank]]
    faint = rng.standard_normal((size, 16)) * 0.02
    return np.hstack([lead, faint]).astype(np.float32)


# --- search ----------------------------------------------------------------------------------------------------------


def cells_of(x: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Centres of at most ``cells`` groups of unit vectors, by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    apart = np.unique(x.round(4), axis=0, return_index=True)[1]  # equal vectors make one centre
    centre = x[apart[rng.choice(len(apart), min(cells, len(apart)), replace=False)]]
    for _ in range(5):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    return centre


def members_of(x: np.ndarray, centre: np.ndarray) -> list[np.ndarray]:
    """The vectors of each cell: those nearest to its centre, or as near up to rounding.

    So the cell that a copy of a vector finds nearest always holds the vector, in whatever batch either was computed.
    """
    near: list[list[np.ndarray]] = [[] for _ in centre]
    for lo in range(0, len(x), 8192):
        score = x[lo : lo + 8192] @ centre.T
        row, col = np.nonzero(score >= score.max(1, keepdims=True) - 1e-4)
        for k in range(len(centre)):
            near[k].append(lo + row[col == k])
    return [np.concatenate(n) for n in near]


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for k, y in enumerate(b, 1):
            diagonal, row[k] = row[k], diagonal + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``lcs`` of each row of ``a`` and the same row of ``b``."""
    row = np.zeros((b.shape[1] + 1, len(a)), dtype=np.int32)
    for x in a.T:
        new = np.zeros_like(row)
        for k, y in enumerate(b.T):
            new[k + 1] = np.where(x == y, row[k] + 1, np.maximum(row[k + 1], new[k]))
        row = new
    return row[-1]


def repeated(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weight of the words of each row of ``a`` that the same row of ``b`` has."""
    there = np.zeros(a.shape, dtype=bool)
    for y in b.T:
        there |= a == y[:, None]
    return (there * idf[a]).sum(1)


def reach_of(vectors: np.ndarray, centre: np.ndarray, cosine: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The vectors of each cell, each in one, and the least cosine with its centre of a vector that may have ``cosine``
    or more with one of them: their angle is at most the cell's radius and that of ``cosine``."""
    near = np.concatenate([(vectors[lo : lo + 8192] @ centre.T).argmax(1) for lo in range(0, len(vectors), 8192)])
    members = [np.flatnonzero(near == k) for k in range(len(centre))]
    far = np.array([(vectors[m] @ c).min() if len(m) else 1.0 for m, c in zip(members, centre)])
    angle = np.arccos(np.clip(far, -1, 1)) + np.arccos(cosine)
    return members, np.where(angle < np.pi, np.cos(np.minimum(angle, np.pi)) - 1e-3, -2.0)


def pairs_within(x: np.ndarray, vectors: np.ndarray, centre: np.ndarray, members: list[np.ndarray], least: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x`` and of ``vectors`` whose cosine is ``cosine`` or more, with it; all of them if ``least`` comes from
    ``reach_of``, those of the nearest cell if it is None. So many pairs at a time, however many share a cell."""
    score = x @ centre.T
    near = score.argmax(1) if least is None else None
    for k, group in enumerate(members):
        rows = np.flatnonzero(near == k if least is None else score[:, k] >= least[k])
        step = max(1, PAIRS // max(1, len(group)))
        for c in range(0, len(rows) if len(group) else 0, step):
            mine = rows[c : c + step]
            cos = (x[mine] @ vectors[group].T).ravel()
            hit = np.flatnonzero(cos >= cosine)  # of one row after the other, which is found faster than in two dimensions
            yield mine[hit // len(group)], group[hit % len(group)], cos[hit]


def gathered(parts: Iterator[tuple[np.ndarray, ...]], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in fewer parts, of ``size`` rows or more but for the last."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


MATCH = "doc_id bigint, item bigint, cosine float, run int, lcs int, answer float, start int"


def _search(parts: DataFrame, items: list[np.ndarray], idf: np.ndarray, space: np.ndarray, span: int, cosine: float, answer: float, least: float, copies: bool) -> DataFrame:
    """For each stretch and item among the candidates: best cosine, longest common run and subsequence of words.

    Candidates are all pairs of ``cosine``; with ``copies`` only those of the nearest cell, where every copy is.
    """
    owner = np.repeat(np.arange(len(items)), [max(0, len(i) - span + 1) for i in items])
    begin = np.concatenate([np.arange(max(0, len(i) - span + 1)) for i in items])
    every = np.concatenate([windows(i, span) for i in items])
    vectors = latent(every, idf, space)
    centre = cells_of(vectors, CELLS)
    members, reach = (members_of(vectors, centre), None) if copies else reach_of(vectors, centre, cosine)
    weight = idf[every].sum(1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            docs, starts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            if not len(texts):
                continue
            ids, at, first = able_windows(list(texts), idf, span, least)
            which = np.searchsorted(first, at, side="right") - 1
            offset = at - first[which]
            w = windows(ids, span)[at]
            hits: dict[tuple[int, int], list] = {}
            for lo in range(0, len(w), 8192):
                x = latent(w[lo : lo + 8192], idf, space)
                for i, m, score in gathered(pairs_within(x, vectors, centre, members, reach, cosine), 65_536):
                    for c in range(0, len(i), 65_536):
                        p, n, cos = lo + i[c : c + 65_536], m[c : c + 65_536], score[c : c + 65_536]
                        # all candidates at once: equal word by word; weight of the item's words that are there
                        same = (w[p] == every[n]).all(1)
                        if copies:
                            p, n, cos, same = p[same], n[same], cos[same], same[same]
                        share = repeated(every[n], w[p], idf) / weight[n]
                        good = np.flatnonzero(same | (share >= answer))
                        longest = np.full(len(good), span)
                        other = np.flatnonzero(~same[good])
                        if len(other):
                            longest[other] = common(w[p[good[other]]], every[n[good[other]]])
                        for k, alike in zip(good, longest):
                            hits.setdefault((int(which[p[k]]), int(owner[n[k]])), []).append((int(p[k]), int(n[k]), float(cos[k]), bool(same[k]), float(share[k]), int(alike)))
            for (t, item), found in hits.items():
                # windows that are equal and consecutive on one diagonal make a longer run
                exact = sorted({(int(begin[m]) - int(offset[p]), int(offset[p])) for p, m, _, same, _, _ in found if same})
                longest, here, last = 0, 0, None
                for d, o in exact:
                    here = here + 1 if last == (d, o - 1) else 1
                    last, longest = (d, o), max(longest, here)
                best = max(found, key=lambda f: (f[5], f[2]))
                run = longest + span - 1 if longest else 0
                out.append((docs[t], item, max(f[2] for f in found), run, max(run, best[5]), best[4], starts[t] + int(offset[best[0]])))
            cols = list(zip(*out)) if out else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float32(), pa.int32(), pa.int32(), pa.float32(), pa.int32()))],
                names=["doc_id", "item", "cosine", "run", "lcs", "answer", "start"],
            )

    return parts.select("doc_id", "start", "ids").mapInArrow(find, MATCH)


def tokenised(items: DataFrame) -> DataFrame:
    """``(item_id, words)`` of the items that have words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.list_(pa.string()))], names=["item_id", "words"])

    return items.mapInArrow(split, "item_id bigint, words array<string>").where(F.size("words") > 0)


def recut(parts: DataFrame, block_of: np.ndarray, span: int, slack: int) -> DataFrame:
    """The passages of a block of items: identifiers of all words become those of the block's (``block_of``, where the
    greatest stands for the words it hasn't), and stretches are cut anew."""
    size = int(block_of.max())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, start, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)):
                ids = block_of[ids]
                for a, b in stretches(ids < size, span, slack):
                    for column, v in zip(out, (doc, start + a, ids[a:b])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return parts.mapInArrow(cut, "doc_id bigint, start int, ids array<int>")


def _block(spark: SparkSession, parts: DataFrame, items: list[tuple[int, np.ndarray]], freq: np.ndarray, n: int, span: int, slack: int, cosine: float, answer: float, copies: bool) -> DataFrame:
    mine = np.unique(np.concatenate([t for _, t in items]))
    if len(mine) < len(freq):
        block_of = np.full(len(freq) + 1, len(mine), dtype=np.int32)
        block_of[mine] = np.arange(len(mine))
        parts = materialise(recut(parts, block_of, span, slack), "block")
        items, freq = [(i, block_of[t]) for i, t in items], freq[mine]
    ids = [t for _, t in items]
    idf = np.append(np.log((1 + n) / (1 + freq)) + 1, 0.0)  # what is unknown weighs nothing
    # what a window must weigh to repeat the answer part of the lightest item window
    least = answer * min(float(idf[windows(i, span)].sum(1).min()) for i in ids)
    space = latent_space(parts, idf, span, least=least)
    matches = _search(parts, ids, idf.astype(np.float32), space, span, cosine, answer, least, copies)
    table = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item bigint, item_id bigint")
    return matches.join(F.broadcast(table), "item")  # a row an item of the block


def _blocks(items: DataFrame, vocabulary: dict[str, int], span: int, block: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word identifiers, so many words at a time; one beyond a block comes in overlapping parts."""
    batch, size = [], 0
    for r in items.toLocalIterator():  # the evaluation set, of which no more than a block is held
        ids = np.array([vocabulary[w] for w in r["words"]], dtype=np.int32)
        for at in range(0, max(1, len(ids) - span + 1), block - span + 1):
            part = ids[at : at + block]
            if len(part) < span:
                continue
            if batch and size + len(part) > block:
                yield batch
                batch, size = [], 0
            batch.append((r["item_id"], part))
            size += len(part)
    if batch:
        yield batch


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, slack: int = SLACK, cosine: float = COSINE, answer: float = ANSWER, block: int = BLOCK, copies: bool = False) -> DataFrame:
    """``(doc_id, item_id, run, lcs, answer, cosine, n_places, first_word)`` of every document and item that are candidates and
    share a run of ``span`` words or the ``answer`` part of a passage's information.

    ``run`` is the longest common run of words (0 if below ``span``; of an item beyond a block, within one part), ``lcs`` the longest common subsequence of
    any candidate passage, ``answer`` the share of that passage's information (IDF weight of its words: names and numbers weigh
    most) that the document repeats, ``first_word`` where the passage begins. Null and empty texts and items of fewer than ``span``
    words match nothing; documents with the same text match alike; items that share a passage are all found. The corpus is read
    once, whatever the number of blocks. ``slack`` words of a passage may be foreign to all items; ``span - slack`` is the least
    number of words that a passage found shares with an item. With ``copies`` only the runs are complete, and cost less to find,
    as a copy has no foreign word.
    """
    spark = shipped(documents.sparkSession)
    if copies:
        slack, cosine = 0, max(cosine, COPIED)
    docs = documents.select(F.col("doc_id").cast("bigint"), "text").where(F.length("text") > 0)
    chosen = materialise(tokenised(items.select(F.col("item_id").cast("bigint"), "text").where(F.length("text") > 0)), "items")
    distinct = chosen.select(F.explode(F.array_distinct("words")).alias("w")).distinct().collect()  # the vocabulary of the evaluation set
    vocabulary = {w: k for k, w in enumerate(sorted(r["w"] for r in distinct))}
    blocks = _blocks(chosen, vocabulary, span, block)
    batch = next(blocks, None)
    if batch is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, run int, lcs int, answer float, cosine float, n_places bigint, first_word int")
    cut = materialise(passages(docs, vocabulary, span, slack), "passages")
    stats = cut.where(F.col("n_docs").isNotNull())
    n = stats.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    freq = np.zeros(len(vocabulary))
    for r in stats.select(F.posexplode("freqs")).groupBy("pos").agg(F.sum("col").alias("df")).collect():  # a row a word
        freq[r["pos"]] = r["df"]
    parts = cut.where(F.col("ids").isNotNull()).select("doc_id", "start", "ids")
    found = []
    while batch is not None:
        found.append(_block(spark, parts, batch, freq, n, span, slack, cosine, answer, copies))
        batch = next(blocks, None)
    result = functools.reduce(DataFrame.unionByName, found)
    return result.groupBy("doc_id", "item_id").agg(
        F.max("run").alias("run"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.max("cosine").alias("cosine"), F.count(F.lit(1)).alias("n_places"), F.min("start").alias("first_word")
    )


PLANTED = 40
KINDS = {"copy": 0.0, "replaced_10": 0.1, "replaced_20": 0.2, "replaced_30": 0.3, "swapped": 0.0}


def planted(items: DataFrame, length: int = PLANTED) -> DataFrame:
    """``(doc_id, item_id, kind, text)``: the first ``length`` words of every item that has so many, once for each of
    ``KINDS``: as they are, with a share of the words replaced by others, or with two of every three words swapped.
    ``doc_id`` is negative, so that the texts can go among documents."""
    w = tokenised(items.select(F.col("item_id").cast("bigint"), "text").where(F.length("text") > 0)).where(F.size("words") >= length)
    w = w.select("item_id", F.slice("words", 1, length).alias("w"))

    def draw(kind: str, i: Column) -> Column:
        return F.md5(F.concat_ws("/", F.lit(kind), F.col("item_id").cast("string"), i.cast("string")))

    def text(kind: str, share: float) -> Column:
        if kind == "swapped":
            return F.transform("w", lambda x, i: F.get("w", F.when(i == length - 1, i).when(i % 3 == 0, i + 1).when(i % 3 == 1, i - 1).otherwise(i)))
        return F.transform("w", lambda x, i: F.when(F.conv(F.substring(draw(kind, i), 1, 7), 16, 10).cast("double") < share * 2**28, F.concat(F.lit("zq"), F.substring(draw(kind, i), 8, 8))).otherwise(x))

    made = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n + 1).alias("no"), F.array_join(text(k, share), " ").alias("text")) for n, (k, share) in enumerate(KINDS.items())))
    return w.select("item_id", F.explode(made).alias("m")).select((-(F.col("item_id") * len(KINDS) + F.col("m.no"))).alias("doc_id"), "item_id", "m.kind", "m.text")


def leaked(matches: DataFrame) -> DataFrame:
    """The pairs of ``leaks`` that count: a copied run; a paraphrase that keeps ``ORDERED`` words of a passage in order and
    the ``ANSWER`` part of what it says; or one that keeps fewer in order, but nearly all it says."""
    kept = (F.col("lcs") >= ORDERED) & (F.col("answer") >= ANSWER)
    shuffled = (F.col("lcs") >= SHUFFLED[0]) & (F.col("answer") >= SHUFFLED[1])
    return matches.where((F.col("run") >= SPAN) | kept | shuffled)


def recall(documents: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``(kind, n_planted, n_found)`` of passages planted among the documents, found with the item they come from."""
    texts = materialise(planted(items), "planted")
    docs = documents.select(F.col("doc_id").cast("bigint"), "text").unionByName(texts.select("doc_id", "text"))
    found = leaked(leaks(docs, items, **kw)).where("doc_id < 0").select("doc_id", "item_id").withColumn("hit", F.lit(1))
    both = texts.join(found, ["doc_id", "item_id"], "left")
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n_planted"), F.count("hit").alias("n_found"))

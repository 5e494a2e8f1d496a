"""Line-first cleaning.

Every line of a text is judged by itself: terminal punctuation, navigation
marks, boilerplate phrases, symbol load and repetition of an earlier line.
Failed lines are removed; a document that keeps too small a share of its words
is rejected. Lines without a word pass and carry no weight.

Defined results: a null text counts as empty (no words, base_failed, not
kept); lines, words and windows are equal if their bytes are, never by a hash
alone; equal rows are judged alike, each by itself; an empty table gives an
empty result; extra columns of the input are ignored. No row looks at another,
so nothing is shuffled and the cost is linear in bytes at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinweave.llm import common as C

#: Phrases of licences, notices and page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "copyright ©",
    "copyright (c)",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "accept cookies",
    "lorem ipsum",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "powered by",
    "click here",
    "read more",
    "share this",
    "follow us on",
    "back to top",
    "skip to content",
    "skip to main content",
)


#: Ends of a line besides . ! ? : ; " ) and '
ENDS = ("…", "”", "»", "。")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    max_symbol_share: float = 0.05  # of a line's bytes
    max_pipes_per_word: float = 0.2
    max_shouts_per_word: float = 0.3  # exclamation marks
    min_kept_share: float = 0.5  # of a document's words


_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_lines_removed", T.LongType()),
        T.StructField("n_words_removed", T.LongType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def clean_lines(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row per document: the base counts, the verdict, and the text of the lines that passed."""
    C.small_batches(docs.sparkSession)
    schema = T.StructType([f for f in _SCHEMA if with_text or f.name != "clean_text"])
    names = schema.fieldNames()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, body, off in C.sub_batches(batch.column("text")):
                got = judge(body, off, rules, with_text)
                got["doc_id"] = batch.column("doc_id").slice(first, len(off) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(got[c]) if not isinstance(got[c], pa.Array) else got[c] for c in names], names)

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def judge(body: np.ndarray, off: np.ndarray, rules: Rules, with_text: bool) -> dict:
    n = len(off) - 1
    start, end, row = C.words_of(body, off)
    word = C.exact_classes(body, start, end)
    n_words = np.bincount(row, minlength=n)
    in_word = np.zeros(len(body) + 1, np.int8)
    in_word[start] += 1
    in_word[end] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8) if len(body) else in_word[:-1]
    # a word may end where the next row's begins: the two steps cancel, as they should
    word_chars = C.per_row(((body & 0xC0) != 0x80) & (in_word > 0), off)
    table = np.zeros(256, bool)
    table[list(b"#*$%&|<>")] = True
    symbol = table[body]
    n_symbols = C.per_row(symbol, off)

    # lines
    newline = np.flatnonzero(body == 10)
    cut = np.concatenate((off[:-1], newline + 1))
    stop = np.concatenate((off[1:], newline))
    line_row = np.concatenate((np.arange(n), np.searchsorted(off, newline, "right") - 1))
    order = np.lexsort((cut, line_row))
    cut, line_row = cut[order], line_row[order]
    # a row's lines end at its newlines and then at its end
    stop_row = np.concatenate((np.arange(n), np.searchsorted(off, newline, "right") - 1))
    stop = stop[np.lexsort((stop, stop_row))]
    line_of_word = np.searchsorted(cut, start, "right") - 1
    # empty rows share their cut with the next row: the last line that begins there holds the word
    words_in = np.bincount(line_of_word, minlength=len(cut))
    real = np.flatnonzero(words_in > 0)
    repeat = np.zeros(len(cut), bool)
    if len(real):
        line = C.exact_classes(body, cut[real], stop[real])
        _, at = np.unique(line_row[real] * np.int64(line.max() + 1) + line, return_index=True)
        repeat[real] = True
        repeat[real[at]] = False
    n_dup = np.bincount(line_row[repeat], minlength=n)

    # windows of words found twice or more in a text
    w = rules.repeat_window
    n_repeat = np.zeros(n, np.int64)
    ws = np.arange(max(len(word) - w + 1, 0))
    ws = ws[row[ws] == row[ws + w - 1]] if len(ws) else ws
    if len(ws):
        odd = C.powers(w + 1, 0xC2B2AE3D27D4EB4F)
        k = C.mix(row[ws].astype(np.uint64) + np.uint64(7))
        for j in range(w):
            k += C.mix(word[ws + j].astype(np.uint64)) * odd[j]
        _, at, inv, count = np.unique(C.mix(k), return_index=True, return_inverse=True, return_counts=True)
        first = ws[at[inv]]
        if not all((word[ws + j] == word[first + j]).all() for j in range(w)) or (row[ws] != row[first]).any():  # windows that only share a hash
            _, inv, count = np.unique(np.column_stack([row[ws], *[word[ws + j] for j in range(w)]]), axis=0, return_inverse=True, return_counts=True)
            inv = inv.reshape(-1)
        twice = ws[count[inv] > 1]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + w, -1)
        n_repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)

    # each line by itself
    bad = repeat.copy()
    if len(real):
        last_word = np.searchsorted(line_of_word, real, "right") - 1
        at = end[last_word] - 1
        final = body[at]
        ends_well = np.zeros(256, bool)
        ends_well[list(b".!?:;\")'")] = True
        good = ends_well[final]
        for mark in ENDS:
            m = np.frombuffer(mark.encode(), np.uint8)
            fits = at - start[last_word] >= len(m) - 1
            for k in range(len(m)):
                fits &= body[np.maximum(at - k, 0)] == m[-1 - k]
            good |= fits
        unended = ~good
        span = lambda flags: C.per_row(flags, np.concatenate((cut, [off[-1]])))[real]
        size = np.maximum((stop - cut)[real], 1)
        words = words_in[real]
        pipes, shouts = span(body == 124), span(body == 33)
        bad[real] |= unended | (span(symbol) > rules.max_symbol_share * size) | (pipes > rules.max_pipes_per_word * words) | (shouts > np.maximum(1, rules.max_shouts_per_word * words))
        text = body.tobytes().lower()
        for phrase in BOILERPLATE:
            p, at = phrase.encode(), -1
            while (at := text.find(p, at + 1)) >= 0:
                i = int(np.searchsorted(cut, at, "right")) - 1
                if at + len(p) <= stop[i]:
                    bad[i] = True
    words_bad = np.bincount(line_row, weights=words_in * bad, minlength=n).astype(np.int64)
    kept = ~base_failed & (n_words - words_bad >= rules.min_kept_share * n_words)
    out = {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup.astype(np.int64),
        "n_repeat_words": n_repeat.astype(np.int64),
        "base_failed": base_failed,
        "kept": kept,
        "n_lines": np.bincount(line_row, minlength=n).astype(np.int64),
        "n_lines_removed": np.bincount(line_row[bad], minlength=n).astype(np.int64),
        "n_words_removed": words_bad,
    }
    if with_text:
        texts, at = [], np.searchsorted(line_row, np.arange(n + 1))
        whole = body.tobytes()
        for i in range(n):
            texts.append(b"\n".join(whole[cut[j] : stop[j]] for j in range(at[i], at[i + 1]) if not bad[j]).decode("utf-8", "replace"))
        out["clean_text"] = texts
    return out

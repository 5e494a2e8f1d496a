"""Cross-entropy difference: how much better a target model predicts a text than a background model.

Both models are interpolated word bigrams over one vocabulary, all words of the
corpus: a word (a run of other than the six ASCII spaces) and a bigram are known
by 63 bits of their hash, so unrelated ones share a count only by an accident of
the hash (safe to some billions of different ones). Smoothing and orders are the
same for both. The target model counts every text labelled quality = 1, the
background model every text; a text is scored with its own counts, and its words
of the totals, taken out of both: by the models of the other rows.
Counting covers all of every text, and the tables of counts grow with the
corpus; nobody holds them whole. Texts are dealt to chunks by hash. A chunk
sends its count of each of its different words and bigrams, sorted and dealt to
parts by hash; a part adds the counts up and answers each chunk in the order it
asked, and the chunk scores its texts by the answers.

score = mean over a text's words of -log p_target + log p_background; negative
is closer to the target.

Defined results: a null or empty text has no words and score null; without a
target text both models are uniform and background, and the score still is
defined; a null doc_id or quality is never a target; several labels of one id
make it a target if one does; equal texts get equal scores; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C


@dataclass(frozen=True)
class Entropy:
    vocabulary: int = 1 << 17  # words the uniform part is spread over, or all there are where these are more
    bigrams: int = 1 << 19  # about so many bigrams are looked up in one part of the tables
    bigram_share: float = 0.5
    unigram_share: float = 0.4  # the rest is uniform
    #: Ids of target texts that are sent to every task (16 bytes each or so); more meet the texts by a shuffle.
    sent_ids: int = 1 << 20


#: Bytes of text of which the words and bigrams are made distinct together.
CHUNK = 3 << 22


def tokens(body: np.ndarray, off: np.ndarray, how: Entropy):
    """(row, word, bigram or -1 at a text's first word), both as 63 bits of a hash."""
    start, end, row = C.words_of(body, off)
    full = C.segment_hash(body, start, end)
    pair = np.full(len(full), -1, np.int64)
    if len(full) > 1:
        both = C.mix(full[:-1] * np.uint64(0x9E3779B97F4A7C15) + full[1:] + np.uint64(1))
        pair[1:] = np.where(row[1:] == row[:-1], (both >> np.uint64(1)).astype(np.int64), -1)
    return row, (full >> np.uint64(1)).astype(np.int64), pair


def _tokens_of(texts: list, how: Entropy):
    """tokens() of Arrow text arrays together, rows numbered through; and the number of rows."""
    held, n = [(np.zeros(0, np.int64),) * 3], 0
    for array in texts:
        for i, body, off in C.sub_batches(array):
            row, word, pair = tokens(body, off, how)
            held.append((row + (n + i), word, pair))
        n += len(array)
    return *(np.concatenate(x) for x in zip(*held, strict=True)), n


def _firsts(pair: np.ndarray) -> np.ndarray:
    """Which tokens are the first word of a bigram."""
    return np.append(pair[1:] >= 0, False) if len(pair) else pair >= 0


def flagged(docs: DataFrame, labels: DataFrame, how: Entropy = Entropy()) -> DataFrame:
    """doc_id, text, own: whether the row is a target text."""
    C.small_batches(docs.sparkSession)
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("g")).distinct()
    if good.count() <= how.sent_ids:
        good = F.broadcast(good)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(good, F.col("doc_id") == F.col("g"), "left").select("doc_id", "text", F.col("g").isNotNull().alias("own"))


def _squeezed(arrays: list) -> bytes:
    """Arrays of whole numbers >= 0, each in the fewest bytes that hold its largest, after their number and width."""
    out = []
    for x in arrays:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        octets = np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :width]
        out += [len(x).to_bytes(4, "little"), bytes([width]), octets.tobytes()]
    return b"".join(out)


def _unsqueezed(body: bytes) -> list:
    out, i = [], 0
    while i < len(body):
        n, width = int.from_bytes(body[i : i + 4], "little"), body[i + 4]
        octets = np.frombuffer(body, np.uint8, n * width, i + 5)
        if width > 1:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = octets.reshape(n, width)
            octets = wide.view("<i8").reshape(n)
        out.append(octets)
        i += 5 + n * width
    return out


def _gaps(item: np.ndarray, parts: int) -> np.ndarray:
    """Sorted items of one part as differences of their quotients by parts: these need fewer bytes, at every number of parts."""
    return np.diff(item // parts, prepend=0)


def _items(gaps: np.ndarray, part: int, parts: int) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64) * parts + part


def _dealt(item: np.ndarray, parts: int):
    """Sorted items: the order that brings parts together, each sorted, and where each of the parts begins and the last ends."""
    part = item % parts
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _sizes(rows: DataFrame, how: Entropy) -> tuple[int, int]:
    """Numbers of chunks and parts, both by the bytes of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size // CHUNK + 1, size // (24 * how.bigrams) + 1


def _by_chunk(rows: DataFrame, chunks: int) -> DataFrame:
    """Rows with a column chunk, about one chunk to a task."""
    return rows.repartition(chunks, "chunk").sortWithinPartitions("chunk")


def _chunk(chunks: int):
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")


def counts(rows: DataFrame, how: Entropy = Entropy()) -> DataFrame:
    """part, chunk, body: what a chunk of texts counts of the items of a part; rows as of flagged().

    body has the number of parts; the words (as of _gaps), their counts among target texts and all texts and the same as
    the first of a bigram; the bigrams and their two counts.
    """
    chunks, parts = _sizes(rows, how)

    def run(batches):
        import pyarrow as pa

        for c, held in _chunks(batches):
            row, word, pair, _ = _tokens_of([b.column("text") for b in held], how)
            own = np.concatenate([b.column("own").to_numpy(zero_copy_only=False) for b in held])[row].astype(float)
            first, has = _firsts(pair), pair >= 0
            pairs, at = np.unique(pair[has], return_inverse=True)
            two = [pairs, np.bincount(at, own[has], len(pairs)), np.bincount(at, minlength=len(pairs))]
            del pair
            words, at = np.unique(word, return_inverse=True)
            one = [words, *(np.bincount(at[use], weight, len(words)) for use, weight in ((slice(None), own), (slice(None), None), (first, own[first]), (first, None)))]
            sent = []
            for table in (one, two):
                order, cut = _dealt(table[0], parts)
                sent.append(([x[order].astype(np.int64) for x in table], cut))
            some = [p for p in range(parts) if any(cut[p] < cut[p + 1] for _, cut in sent)]
            for i in range(0, len(some), 256):
                of = some[i : i + 256]
                body = [_squeezed([np.array([parts]), *(_gaps(x[cut[p] : cut[p + 1]], parts) if k == 0 else x[cut[p] : cut[p + 1]] for table, cut in sent for k, x in enumerate(table))]) for p in of]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([c] * len(of), pa.int32()), pa.array(body, pa.binary())], ["part", "chunk", "body"])

    return _by_chunk(rows.select(_chunk(chunks), "text", "own"), chunks).mapInArrow(run, "part int, chunk int, body binary")


@dataclass(frozen=True)
class Table:
    """One kind's counts (0 word, 1 bigram, 2 word as the first of a bigram) of one model (0 target, 1 background), in the cluster."""

    counted: DataFrame
    kind: int
    model: int

    def rows(self) -> DataFrame:
        """item, n: a row for each chunk that has the item."""
        kind, model = self.kind, self.model

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for part, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist(), strict=True):
                    x = _unsqueezed(body)
                    gaps, n = (x[6], x[7 + model]) if kind == 1 else (x[1], x[2 + kind + model])
                    yield pa.RecordBatch.from_arrays([pa.array(_items(gaps, part, int(x[0][0]))), pa.array(n.astype(np.int64))], ["item", "n"])

        return self.counted.select("part", "body").mapInArrow(run, "item long, n long")

    def sum(self) -> int:
        return self.rows().agg(F.sum("n")).first()[0] or 0

    def __getitem__(self, items: np.ndarray) -> np.ndarray:
        """Counts of a few items; scores() has them by way of the parts."""
        asked = [int(x) for x in np.unique(items)]
        found = dict(self.rows().where(F.col("item").isin(asked)).groupBy("item").agg(F.sum("n")).collect())
        return np.array([found.get(int(x), 0) for x in items], float)


def fit(counted: DataFrame, how: Entropy = Entropy()) -> list:
    """[(word, bigram, context) counts of the target model, the same of the background], as tables."""
    return [tuple(Table(counted, k, m) for k in range(3)) for m in range(2)]


def _answers(counted: DataFrame, parts: int) -> DataFrame:
    """chunk, part, body: the corpus' counts of what a chunk counted, in its order; and for each part one row of chunk -1 with
    the words of target texts and of all texts and the number of different words."""

    def run(batches):
        import pyarrow as pa

        for rows in C.groups(batches, "part"):
            sent = [_unsqueezed(r.pop("body")) for r in rows]
            told = []
            for first, last in ((1, 5), (6, 8)):
                at = np.concatenate([np.cumsum(x[first], dtype=np.int64) for x in sent])
                kinds, at = np.unique(at, return_inverse=True)
                total = [np.bincount(at, np.concatenate([x[c] for x in sent]), len(kinds)).astype(np.int64) for c in range(first + 1, last + 1)]
                told.append((at, total, np.cumsum([0, *(len(x[first]) for x in sent)])))
            del sent, kinds
            for i, r in enumerate(rows):
                body = _squeezed([x[at[cut[i] : cut[i + 1]]] for at, total, cut in told for x in total])
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int32()), pa.array([r["part"]], pa.int32()), pa.array([body], pa.binary()), *[pa.array([0], pa.int64())] * 3], ["chunk", "part", "body", "target", "background", "words"])
            words = told[0][1]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows[0]["part"]], pa.int32()), pa.array([None], pa.binary()), *[pa.array([int(x)], pa.int64()) for x in (words[0].sum(), words[1].sum(), len(words[0]))]], ["chunk", "part", "body", "target", "background", "words"])
            del told, at, total, words

    return counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "chunk int, part int, body binary, target long, background long, words long")


def _chunks(batches):
    """(chunk, its batches) of batches sorted by chunk."""
    held, now = [], None
    for b in batches:
        chunk = b.column("chunk").to_numpy()
        cut = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(chunk)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i < j:
                if held and chunk[i] != now:
                    yield now, held
                    held = []
                now = int(chunk[i])
                held.append(b.slice(i, j - i))
    if held:
        yield now, held


def _own_counts(row: np.ndarray, item: np.ndarray, ok: np.ndarray | None = None) -> np.ndarray:
    """How often each token's item occurs in its own row, tokens not ok left out."""
    key = row * np.int64(1 << 32) + item
    _, inverse = np.unique(key, return_inverse=True)
    return np.bincount(inverse, ok if ok is None else ok.astype(float))[inverse].astype(float)


def _loss(model, n: float, how: Entropy, row, word, pair, own, left) -> np.ndarray:
    """-log p of each token; own: the counts of its word, bigram and context in its text and the text's words; left: 1 where the text is among the model's and is taken out, else 0."""
    words, pairs, contexts = model
    before = np.concatenate(([0], word[:-1]))
    p_word = np.maximum(words[word] - left * own[0], 0) / np.maximum(n - left * own[3], 1.0)
    seen = np.maximum(contexts[before] - left * np.concatenate(([0.0], own[2][:-1])), 0)
    both = np.maximum(pairs[np.maximum(pair, 0)] - left * own[1], 0)
    follow = np.where((pair >= 0) & (seen > 0), both / np.maximum(seen, 1), p_word)
    return -np.log(how.unigram_share * p_word + how.bigram_share * follow + (1 - how.unigram_share - how.bigram_share) / how.vocabulary)


def scores(rows: DataFrame, models: list, how: Entropy = Entropy()) -> DataFrame:
    """Each text is scored by models that its own counts are taken out of; rows are those that were counted, by the same parameters."""
    chunks, parts = _sizes(rows, how)
    # what chunks send is long
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 24)
    answers = C.materialise(_answers(models[0][0].counted, parts), "entropy-answers")
    *totals, words = (x or 0 for x in answers.where("chunk < 0").agg(F.sum("target"), F.sum("background"), F.sum("words")).first())
    how = replace(how, vocabulary=max(how.vocabulary, words))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for _, held in _chunks(batches):
            texts = [b.filter(pc.less(b.column("part"), 0)) for b in held]
            told = {p: _unsqueezed(x) for b in held for p, x in zip(b.column("part").to_pylist(), b.column("body").to_pylist(), strict=True) if p >= 0}
            row, word, pair, n = _tokens_of([b.column("text") for b in texts], how)
            own_flag = np.concatenate([b.column("own").to_numpy(zero_copy_only=False) for b in texts]).astype(float)
            count = np.bincount(row, minlength=n)
            mean = [np.zeros(n)] * 2
            if len(word):
                # items as numbers of the chunk's different ones, and the counts of these
                words, word = np.unique(word, return_inverse=True)
                pairs, at = np.unique(pair[pair >= 0], return_inverse=True)
                pair[pair >= 0] = at
                known = []
                for item, which in ((words, slice(0, 4)), (pairs, slice(4, 6))):
                    order, cut = _dealt(item, parts)
                    table = np.zeros((which.stop - which.start, max(len(item), 1)))
                    for p in np.flatnonzero(cut[1:] > cut[:-1]):
                        table[:, order[cut[p] : cut[p + 1]]] = told[p][which]
                    known.append(table)
                first = _firsts(pair)
                own = (_own_counts(row, word), _own_counts(row, np.maximum(pair, 0), pair >= 0), _own_counts(row, word, first), count[row].astype(float))
                left = (own_flag[row], 1.0)
                losses = [_loss((known[0][i], known[1][i], known[0][2 + i]), float(totals[i]), how, row, word, pair, own, left[i]) for i in range(2)]
                mean = [np.bincount(row, x, n) / np.maximum(count, 1) for x in losses]
            none = count == 0
            ids = pa.chunked_array([b.column("doc_id") for b in texts], pa.int64()).combine_chunks()
            out = pa.table([ids, pa.array(count.astype(np.int64)), *[pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]], ["doc_id", "n_words", "target_loss", "background_loss", "score"])
            yield from out.to_batches(1 << 14)
            del held, texts, out

    none = F.lit(None)
    texts = rows.select(_chunk(chunks), F.lit(-1).alias("part"), "doc_id", "text", "own", none.cast("binary").alias("body"))
    told = answers.where("chunk >= 0").select("chunk", "part", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), none.cast("boolean").alias("own"), "body")
    return _by_chunk(texts.unionByName(told), chunks).mapInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, how: Entropy = Entropy()) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score."""
    rows = C.materialise(flagged(docs, labels, how), "entropy-rows")
    return scores(rows, fit(counts(rows, how), how), how)

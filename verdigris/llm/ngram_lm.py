"""Language-model scoring: a bigram model over hashed words, its counts in Elias-Fano tries, one per shard of contexts.

Texts are read once, into blocks of tokens with a vocabulary of their own. Blocks send what they need to know, each word and
each pair of words once, packed as sorted arrays, to the shard that owns it; the shard counts, builds its
level of the model, and answers in the order of the question. Nothing that grows with the corpus passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import blocks, filled, lowered, mixed, slices, span_hashes, text_bytes, word_spans
from verdigris.llm.elias_fano import Trie
from verdigris.session import settle, settle_in_buckets

#: Hashes of the end of a text, a token, and of its beginning, which is only a context.
_END, _BEGIN = np.uint64(0x5A17), np.uint64(0xBE61)


def _pack(values: np.ndarray) -> bytes:
    """The values' bytes by significance, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Even ranges of the hash space, so that the shards of sorted hashes are slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def token_blocks(docs: DataFrame, key: str, held_out: Column, text: str = "text", tokens_per_block: int = 1_000_000) -> DataFrame:
    """Blocks of whole texts: ``block``, keys, held-out flags and lengths of the texts, word hashes by falling frequency, their
    training counts, and every token as a place among them. A text longer than a block is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, base = 0, (task.partitionId() if task else 0) << 24
        ids: list = []
        held: list = []
        lengths: list = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            n = np.array(lengths, np.int64)
            words, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            rank = np.argsort(-counts, kind="stable")
            back = np.empty(len(rank), np.int64)
            back[rank] = np.arange(len(rank))
            tokens = back[place]
            trains = np.repeat(~np.array(held, bool), n)
            seen = np.bincount(tokens[trains], minlength=len(words))
            row = {
                "block": base + number, "ids": ids, "held": held, "lengths": lengths, "words": _pack(words[rank]),
                "seen": _pack(seen.astype("<u4")), "tokens": _pack(tokens.astype("<u4")), "n_words": len(words), "n_tokens": len(tokens),
                "train_tokens": int(trains.sum()) + int((~np.array(held, bool)).sum()), "train_texts": int((~np.array(held, bool)).sum()),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in slices(batches, "said"):
            texts = filled(batch.column("said"))
            for first, last in blocks(texts):
                data, begins = text_bytes(texts, first, last)
                data = lowered(data)
                starts, ends, firsts = word_spans(data, begins)
                if parts and size + len(starts) > tokens_per_block:
                    yield flush()
                    number, size = number + 1, 0
                    ids, held, lengths, parts = [], [], [], []
                parts.append(span_hashes(data, starts, ends))
                size += len(starts)
                lengths.extend(np.diff(firsts).tolist())
                ids.extend(batch.column("id")[first:last].to_pylist())
                held.extend(batch.column("held")[first:last].to_pylist())
        if ids:
            yield flush()

    schema = pa.schema(
        [
            ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
            ("words", pa.binary()), ("seen", pa.binary()), ("tokens", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
            ("train_tokens", pa.int64()), ("train_texts", pa.int64()),
        ]
    )
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("said"))
    return source.mapInArrow(
        run,
        "block long, ids array<long>, held array<boolean>, lengths array<long>, words binary, seen binary, tokens binary, n_words long, "
        "n_tokens long, train_tokens long, train_texts long",
    )


def _word_questions(block_rows: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, seen = np.sort(_unpack(row["words"], "<u8")), _unpack(row["seen"], "<u4")
                seen = seen[np.argsort(_unpack(row["words"], "<u8"), kind="stable")]
                cuts = np.searchsorted(_shard(words, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(some), pa.int64()), pa.array(some, pa.int64()),
                        pa.array([_pack(words[cuts[s] : cuts[s + 1]]) for s in some], pa.binary()),
                        pa.array([_pack(seen[cuts[s] : cuts[s + 1]]) for s in some], pa.binary()),
                    ],
                    names=["block", "shard", "words", "seen"],
                )

    return block_rows.select("block", "words", "seen").mapInArrow(run, "block long, shard long, words binary, seen binary")


def _count_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Training counts of a shard's words, for every block in its own order."""
    each = [_unpack(one, "<u8") for one in frame["words"]]
    seen = np.concatenate([_unpack(one, "<u4") for one in frame["seen"]]).astype(np.int64)
    words, place = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.bincount(place, seen, len(words)).astype(np.int64)
    ends = np.cumsum([0, *map(len, each)])
    return pd.DataFrame({
        "block": frame["block"], "shard": frame["shard"], "distinct": int((counts > 0).sum()),
        "counts": [_pack(counts[place[a:b]].astype("<i8")) for a, b in zip(ends[:-1], ends[1:], strict=True)],
    })


class _Block:
    """A block with the corpus counts of its words: its distinct pairs in the order in which shards are asked."""

    def __init__(self, row: dict, shards: int, pair_shards: int, total: int, texts: int, least: int):
        words, tokens = _unpack(row["words"], "<u8"), _unpack(row["tokens"], "<u4").astype(np.int64)
        order = np.argsort(words, kind="stable")
        counts = np.empty(len(words), np.int64)
        if len(words):
            counts[order] = np.concatenate([_unpack(one["counts"], "<i8") for one in sorted(row["counts"], key=lambda one: one["shard"])])
        self.hash = np.concatenate([words, [_END, _BEGIN]])
        self.counts = np.concatenate([counts, [texts, texts]])
        lengths = np.array(row["lengths"], np.int64)
        self.rows = len(lengths)
        held = np.array([bool(one) for one in row["held"]], bool)
        end, begin = len(words), len(words) + 1
        full = lengths + 1
        at = np.cumsum(full)
        self.doc = np.repeat(np.arange(self.rows), full)
        self.word = np.full(int(full.sum()), end, np.int64)
        inner = np.ones(len(self.word), bool)
        inner[at - 1] = False
        self.word[inner] = tokens
        self.context = np.empty(len(self.word), np.int64)
        self.context[1:] = self.word[:-1]
        self.context[np.concatenate([[0], at[:-1]]) if self.rows else []] = begin
        # Rare words have no pairs of their own: the lower order speaks for them.
        self.stored = np.flatnonzero((self.counts[self.context] >= least) & (self.counts[self.word] >= least))
        place = np.empty(len(self.hash), np.int64)
        by_hash = np.argsort(self.hash, kind="stable")
        place[by_hash] = np.arange(len(self.hash))
        short = (self.hash & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key = (place[self.context[self.stored]] << 32) | short[self.word[self.stored]]
        pairs, first, self.pair_of = np.unique(key, return_index=True, return_inverse=True)
        self.trained = np.bincount(self.pair_of, ~held[self.doc[self.stored]], len(pairs)).astype(np.int64)
        self.pair_context = self.context[self.stored][first]
        self.pair_word = pairs & 0xFFFFFFFF
        context_hash = self.hash[self.pair_context]
        hot = self.counts[self.pair_context] * 8 * pair_shards > max(total, 1)
        spread = mixed(self.pair_word.astype(np.uint64))
        self.shard = np.where(hot, _shard(spread, pair_shards), _shard(mixed(context_hash), pair_shards))
        self.by_shard = np.argsort(self.shard, kind="stable")
        self.cuts = np.searchsorted(self.shard[self.by_shard], np.arange(pair_shards + 1))


def _pair_questions(rows: DataFrame, **how: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                block = _Block(row, **how)
                for shard in np.flatnonzero(np.diff(block.cuts)):
                    mine = block.by_shard[block.cuts[shard] : block.cuts[shard + 1]]
                    context = block.pair_context[mine]
                    new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["block"]], pa.int64()), pa.array([shard], pa.int64()), pa.array([_pack(block.hash[context[new]])], pa.binary()),
                            pa.array([_pack(block.counts[context[new]])], pa.binary()),
                            pa.array([_pack(np.diff(np.r_[new, len(mine)]).astype("<u4"))], pa.binary()),
                            pa.array([_pack(block.pair_word[mine].astype("<u4"))], pa.binary()),
                            pa.array([_pack(block.trained[mine].astype("<u4"))], pa.binary()),
                        ],
                        names=["block", "shard", "contexts", "context_counts", "successors", "words", "trained"],
                    )

    return rows.mapInArrow(run, "block long, shard long, contexts binary, context_counts binary, successors binary, words binary, trained binary")


def _pairs_of(one) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of the pairs that a block asks a shard."""
    return np.repeat(_unpack(one.contexts, "<u8"), _unpack(one.successors, "<u4")), _unpack(one.words, "<u4")


def _shard_trie(frame: pd.DataFrame, prior: float, share: float) -> Trie:
    """The trie of a shard's training pairs. Questions stay packed but for one block's, and a context's count is kept once."""
    contexts, words, trained, heads, totals = [], [], [], [], []
    for one in frame.itertuples():
        context, word = _pairs_of(one)
        n = _unpack(one.trained, "<u4")
        known = n > 0
        contexts.append(context[known])
        words.append(word[known])
        trained.append(n[known])
        heads.append(_unpack(one.contexts, "<u8"))
        totals.append(_unpack(one.context_counts, "<i8"))
    head, first = np.unique(np.concatenate(heads), return_index=True)
    total = np.concatenate(totals)[first]
    del heads, totals, first
    context, word, n = _joined(contexts), _joined(words), _joined(trained)
    order = np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order]
    del order
    new = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])]) if len(context) else np.zeros(0, np.int64)
    counts = np.add.reduceat(n, new, dtype=np.int64) if len(new) else n
    context, word = context[new], word[new]
    return Trie.of(context, word, np.log10(counts / (total[np.searchsorted(head, context)] * (1 + share) + prior)))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is emptied."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def score(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", prior: float = 50.0, share: float = 2.0,
    least_count: int = 2, tokens_per_block: int = 1_000_000, entries_per_shard: int = 2_000_000,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of the whole text (runs without ASCII white space, A-Z lower-cased), then one end. The model learns
    from the rows where ``held_out`` is false (null is false). Base: each token's count plus 0.5 over N + 0.5 (V + 1). Score:
    log10 of P(w | c) = (n(c, w) + m base(w)) / (n(c) + m) with m = prior + share * n(c), c the token before or the beginning.
    The first term is what the tries store, one byte per pair; words seen less than ``least_count`` times have base terms only,
    and what their pairs would have is lost: only with 1 are all training pairs stored and do probabilities sum to one.
    Null and empty texts are one end token; without training rows every token has probability one. Equal rows count each and
    have equal scores; a null key stays null.

    The share of each shard follows the corpus: more text, more shards. A context with over an eighth of a shard's share of
    all tokens is spread over all shards by its successors.
    """
    read = settle_in_buckets(token_blocks(docs, key, held_out, text, tokens_per_block), "block", "token-blocks")
    totals = read.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("train_tokens"), F.sum("train_texts")).first()
    n_words, n_tokens, total, texts = (int(one or 0) for one in totals)
    shards = max(1, -(-n_words // entries_per_shard))
    pair_shards = max(1, -(-n_tokens // entries_per_shard))
    counted = settle(
        _word_questions(read, shards).groupBy("shard").applyInPandas(_count_words, "block long, shard long, distinct long, counts binary"),
        "word-counts",
    )
    kinds = counted.groupBy("shard").agg(F.max("distinct").alias("d")).agg(F.sum("d")).first()[0]
    distinct = int(kinds or 0) + (1 if texts else 0)
    by_block = counted.groupBy("block").agg(F.collect_list(F.struct("shard", "counts")).alias("counts"))
    # Blocks lie in buckets, so that only what they have been answered is shuffled, here and below.
    tokens = read.select("block", "ids", "held", "lengths", "words", "tokens")
    known = tokens.join(by_block, "block", "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<shard:long,counts:binary>>")))
    how = {"shards": shards, "pair_shards": pair_shards, "total": total, "texts": texts, "least": max(1, least_count)}

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        trie = Trie.open(_shard_trie(frame, prior, share).to_bytes())
        codes = [_pack(trie.codes_of(*_pairs_of(one))) for one in frame.itertuples()]
        table = np.asarray(trie.table, "<f8").tobytes()
        return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "codes": codes, "table": table})

    answers = _pair_questions(known.drop("ids"), **how).groupBy("shard").applyInPandas(answer, "block long, shard long, codes binary, table binary")
    answered = settle(answers, "pair-answers").groupBy("block").agg(F.collect_list(F.struct("shard", "codes", "table")).alias("answers"))
    none = F.array().cast("array<struct<shard:long,codes:binary,table:binary>>")
    joined = known.join(answered, "block", "left").withColumn("answers", F.coalesce("answers", none))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                block = _Block(row, **how)
                high = np.zeros(len(block.pair_word))
                for one in row["answers"]:
                    mine = block.by_shard[block.cuts[one["shard"]] : block.cuts[one["shard"] + 1]]
                    codes = _unpack(one["codes"], "u1")
                    high[mine] = np.where(codes > 0, 10.0 ** np.frombuffer(one["table"], "<f8")[codes], 0.0)
                base = (block.counts + 0.5) / (total + 0.5 * (distinct + 1))
                upper = np.zeros(len(block.word))
                upper[block.stored] = high[block.pair_of]
                weight = prior + share * block.counts
                lower = np.where(block.counts > 0, weight / (block.counts + weight), 1.0)
                p = upper + lower[block.context] * base[block.word]
                sums = lambda values: np.bincount(block.doc, values, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array([bool(one) for one in row["held"]], pa.bool_()),
                        pa.array(np.array(row["lengths"], np.int64) + 1), pa.array(sums(block.counts[block.word] > 0).astype(np.int64)),
                        pa.array(np.full(block.rows, total, np.int64)), pa.array(sums(np.log10(base)[block.word])), pa.array(sums(np.log10(p))),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(
        finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

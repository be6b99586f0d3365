"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised test items. Training
texts stream through it word by word; after each word it knows the longest run,
ending there, that some item contains. Where that length reaches the window,
the words are hit; the items come from the state that holds the window itself.

Items are few and bounded: their words are counted first, and beyond ``max_words``
they are dealt into several automata that the documents stream through in turn, a
written table between them, so neither the driver nor a task ever holds more than one.
An automaton has at most two states a word; a state was measured at 700 bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import forget, fresh, materialize

#: ASCII letters and digits, and everything beyond ASCII, in UTF-8.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words for the JVM, in texts that are not lower-cased.
_WORD_JVM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, then runs of letters, digits and non-ASCII characters."""
    return _WORDS.findall(text.lower()) if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the words of ``items``: pairs (item id, words)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = 10):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        n = len(self.step)
        order = sorted(range(n), key=self.length.__getitem__)
        #: For a state with a run of window words or more: the state that holds its last window words.
        self.at_window = [-1] * n
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.at_window[v] = self.at_window[up] if self.length[up] >= window else v
        self.window_items: dict[int, set] = {}
        own: dict[int, set] = {}
        for item, words in items:
            v = 0
            for at, word in enumerate(words, 1):
                v = self.step[v][word]
                if at >= window:
                    self.window_items.setdefault(self.at_window[v], set()).add(item)
            if len(words) < window:
                own.setdefault(v, set()).add((len(words), item))
        #: Whole short items that end where a state's runs end.
        self.short: list[tuple] = [()] * n
        for v in order[1:]:
            self.short[v] = self.short[self.link[v]] + tuple(own.get(v, ()))

    def _new(self, step: dict, link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the run of p followed by word: q itself, or a copy that takes over the shorter runs."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.step[last].get(word)) is not None:
            return self._split(last, word, q)
        now, p = self._new({}, 0, self.length[last] + 1), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = now
            p = self.link[p]
        if p >= 0:
            self.link[now] = self._split(p, word, self.step[p][word])
        return now

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans of words (start, end; merged), the items with occurring windows, the longest run found; every word is streamed."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        step, link, length, short, window = self.step, self.link, self.length, self.short, self.window
        begin = step[0]
        v = run = longest = 0
        for i, word in enumerate(words):
            if not v and word not in begin:
                continue
            while v and word not in step[v]:
                v = link[v]
                run = length[v]
            to = step[v].get(word)
            if to is None:
                run = 0
                continue
            v, run = to, run + 1
            if run > longest:
                longest = run
            if run >= window:
                spans.append((i - run + 1, i + 1))
                items |= self.window_items.get(self.at_window[v] if length[v] >= window else -1, ())
            for size, item in short[v]:
                if size <= run:
                    spans.append((i - size + 1, i + 1))
                    items.add(item)
        return merged(spans), items, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(bench: DataFrame, id_col: str, text_col: str, window: int, max_words: int) -> tuple[int, Iterator[ItemAutomaton]]:
    """The number of automata over all items, each of about ``max_words`` words, of one item at least, and they themselves: each is built when it is asked for."""
    items = bench.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.regexp_count("t", F.lit(_WORD_JVM)))).first()[0] or 0
    parts = max(1, math.ceil(total / max_words))

    def built() -> Iterator[ItemAutomaton]:
        for k in range(parts):
            part = items.where(F.pmod(F.xxhash64("t", F.lit(3)), F.lit(parts)) == k) if parts > 1 else items
            yield ItemAutomaton([(r.i, words_of(r.t.encode())) for r in part.collect()], window)

    return parts, built()


def find_overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 200_000) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items, longest``.

    ``spans`` are merged word ranges (start, end) inside windows of ``window``
    consecutive item words; an item of fewer words, but not none, is one window.
    ``items`` are the distinct ids of items with an occurring window (a null id
    hits but is not listed). ``longest`` is the longest run of words that some item contains.
    Item ids may have any type with an order.
    Null or wordless texts have no words and no hits; null or wordless items are
    ignored; repeated rows keep a row each; extra columns are ignored.
    """
    spark = docs.sparkSession
    kind, item_type = docs.schema[id_col].dataType.simpleString(), bench.schema[item_id].dataType
    item_kind, item_arrow = item_type.simpleString(), to_arrow_type(item_type)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = f"doc_id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<{item_kind}>, longest int"
    out, state = None, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scanner(shared, more: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                n_words, spans, items, longest = [], [], [], []
                for row, x in enumerate(batch.column(1).cast(pa.binary())):
                    words = words_of(x.as_py())
                    found, ids, most = automaton.scan(words)
                    if more:  # what earlier automata found
                        found = merged([*found, *((y["start"], y["end"]) for y in batch.column(2)[row].as_py())])
                        ids, most = ids | set(batch.column(3)[row].as_py()), max(most, batch.column(4)[row].as_py())
                    n_words.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted(y for y in ids if y is not None))
                    longest.append(most)
                found = [pa.array(spans, span), pa.array(items, pa.list_(item_arrow)), pa.array(longest, pa.int32())]
                if keep_text:
                    yield pa.record_batch([batch.column(0), batch.column(1), *found], names=["doc_id", "text", "spans", "items", "longest"])
                else:
                    yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), *found], names=["doc_id", "n_words", "spans", "items", "longest"])

        return run

    parts, made = automata(bench, id_col=item_id, text_col=item_text, window=window, max_words=max_words)
    for k in range(parts):
        last = k == parts - 1
        keep_text = not last
        shared = spark.sparkContext.broadcast(next(made))
        out = state.mapInArrow(scanner(shared, k > 0), schema if last else schema.replace("n_words long", "text string"))
        if not last:
            before, state = state, materialize(out)
            forget(before)
            shared.unpersist()
    return out


def _places(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text and where they stand."""
    low = text.lower()
    places = [m.span() for m in _WORDS.finditer(low)]
    return [low[a:b] for a, b in places], places


def _cut(text: bytes, places: list[tuple[int, int]], spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b" ".join([*parts, text[at:]])


def _verdict(text: bytes, places: list, spans: list[tuple[int, int]], max_span: int, max_coverage: float, first: bool) -> bytes | None:
    """The text without runs of hit words longer than ``max_span``; None if, the first time, their share exceeds ``max_coverage``."""
    spans = [(a, b) for a, b in spans if b - a > max_span]
    if first and sum(b - a for a, b in spans) > max_coverage * len(places):
        return None
    return _cut(text, places, spans) if spans else text


def clean_text(text: bytes, automaton: ItemAutomaton, max_span: int, max_coverage: float) -> bytes | None:
    """:func:`_verdict` until nothing is cut: what is left is streamed again, since the ends around a gap may form a new run."""
    first = True
    while True:
        words, places = _places(text)
        after = _verdict(text, places, automaton.scan(words)[0], max_span, max_coverage, first)
        if after is None or after is text:
            return after
        text, first = after, False


def remove_overlaps(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_span: int = 0, max_coverage: float = 0.5, length_col: str = "n_chars", max_words: int = 200_000) -> DataFrame:
    """``docs`` with benchmark runs of more than ``max_span`` hit words cut out, all columns kept.

    A document of whose words such runs cover more than ``max_coverage`` goes
    whole; cutting goes on until no such run is left. The spans of all automata are
    gathered before anything is decided, so the result does not depend on their number.
    ``length_col``, where there is one, gets the new length in characters
    for texts that changed; other texts and rows stay as they are, null texts too. Repeated
    rows are treated alike; an empty table gives an empty result.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    old, found, changed = fresh(docs, "length", "found", "changed")
    own = docs.withColumn(old, F.length(text_col))
    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    parts, made = automata(bench, item_id, item_text, window, max_words)

    def replaced(batch: pa.RecordBatch, texts: list, width: int) -> list:
        return [pa.array(texts, pa.binary()).cast(batch.column(j).type) if j == at else batch.column(j) for j in range(width)]

    def cleaner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = batch.column(at).cast(pa.binary()).to_pylist(), []
                for row, x in enumerate(texts):
                    if x:
                        texts[row] = clean_text(x, shared.value, max_span, max_coverage)
                    keep.append(x is None or texts[row] is not None)
                yield pa.record_batch(replaced(batch, texts, batch.num_columns), names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

        return run

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = []
                for x, known in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    new = shared.value.scan(words_of(x))[0]
                    spans.append([{"start": a, "end": b} for a, b in merged([*new, *((y["start"], y["end"]) for y in known)])])
                yield pa.record_batch([*batch.columns[:-1], pa.array(spans, to_arrow_type(span))], names=batch.schema.names)

        return run

    def cutter(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep, cut = batch.column(at).cast(pa.binary()).to_pylist(), [], []
                for row, (x, known) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                    after = _verdict(x, _places(x)[1], [(y["start"], y["end"]) for y in known], max_span, max_coverage, first) if x else x
                    keep.append(x is None or after is not None)
                    cut.append(after is not x)
                    texts[row] = after
                yield pa.record_batch([*replaced(batch, texts, batch.num_columns - 1), pa.array(cut, pa.bool_())], names=[*batch.schema.names[:-1], changed]).filter(pa.array(keep, pa.bool_()))

        return run

    if parts == 1:
        out = own.mapInArrow(cleaner(spark.sparkContext.broadcast(next(made))), own.schema)
    else:
        out, todo, first = None, own, True
        while True:
            state = todo.withColumn(found, F.array().cast(span))
            for automaton in automata(bench, item_id, item_text, window, max_words)[1]:
                shared = spark.sparkContext.broadcast(automaton)
                del automaton
                before, state = state, materialize(state.mapInArrow(finder(shared), state.schema))
                forget(before)
                shared.unpersist()
            done = materialize(state.mapInArrow(cutter(first), StructType([*own.schema.fields, StructField(changed, BooleanType())])))
            forget(state)
            settled = done.where(~F.col(changed)).drop(changed)
            out = settled if out is None else out.union(settled)
            todo, first = done.where(changed).drop(changed), False
            if todo.isEmpty():
                break
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.length(text_col) != F.col(old), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.drop(old)


def items_digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def op3_decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Contract digest of :func:`find_overlaps` with windows of ten words."""
    found = find_overlaps(docs, bench)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))

"""Spelling variants: words one edit apart, found with a bit-sliced position index.

1. Words are counted within tasks as Latin-1 bytes and summed.
2. Of two words one edit apart, either the first half of the shorter or what follows it is the same in
   both. So words meet in groups of (length of the shorter, side, half that is equal); groups of more
   than ``BLOCK`` words are cut into blocks, and each pair of blocks is a piece of work of its own.
3. Within a group each position has, for every letter, the set of words with that letter there, as the
   bits of one integer. For a word the sets of the others that agree with it so far with no error and
   with one error are carried from position to position, a whole group at a time: with the letter's
   set at that position for a replaced letter, at the next one for an inserted letter.
4. A pair that the first half brings together is left out of the other side's group. What a group adds to
   a word is its number of near words and the best of them, so no pairs leave a task.
5. A word's form has at least ``times`` its count, so chains of forms are short: their ends are found
   level by level from the words without a form. A word is the form of no more words than there are
   at one edit, so no key of that join is hot.

Defined results: a null or empty text has no words; a null id counts as an empty one. Rows that repeat
count each. Ties between near words go to the smallest in code-point order. Very long texts are
counted block by block, and of a long word only one position is indexed at a time. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

MIN_CHARS = 5
MIN_COUNT = 3
TIMES = 2
#: The rule that plants slips: one in so many occurrences by the hash of document and word.
SLIP = 97
#: Words of a group that are indexed together; rows of one piece of work.
BLOCK = 8192
ROWS = 40_000

#: Words and bytes that a task counts before it hands them on.
_HELD_WORDS, _HELD_BYTES = 1 << 18, 1 << 27
_CHUNK = 1 << 22
#: Latin-1: A-Z become a-z, other letters of ``[A-Za-zÀ-ÿ]`` stay, the rest are blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters, as Latin-1, some megabytes at a time."""
    data = text.encode("latin-1", "replace").translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data) if at + _CHUNK >= len(data) else data.find(b" ", at + _CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(min_chars: int, slip: int | None) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in total], pa.string()),
                 pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{batch.column(0)[at].as_py() or ''}:".encode())
                for found in runs(text):
                    for word, n in Counter(found).items():
                        if len(word) < min_chars:
                            continue
                        if slip:
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                            if h % slip == 0:
                                cut = h % len(word)
                                word = word[:cut] + word[cut + 1:]
                                if len(word) < min_chars:
                                    continue
                        total[word] += n
                held += len(text)
                if len(total) > _HELD_WORDS or held > _HELD_BYTES:
                    yield flush()
                    total.clear()
                    held = 0
        if total:
            yield flush()
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n) of words that are long and frequent enough; ``slip=None`` takes texts as they are."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(min_chars, slip), "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: list[str], at: int) -> dict[str, int]:
    """Letter -> the set of words that have it at a position."""
    found: dict[str, int] = defaultdict(int)
    for k, word in enumerate(words):
        found[word[at]] |= 1 << k
    return found


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def replaced(side: int, short: int, queries: list[str], words: list[str]) -> Iterator[tuple[int, int]]:
    """(query, word) with one replaced letter; all have ``short`` letters and one half in common."""
    half = short // 2
    active = [(k, (1 << len(words)) - 1, 0) for k in range(len(queries))]
    for at in range(half, short) if side == 0 else range(half):
        here, going = _letters(words, at), []
        for k, none, one in active:
            bits = here.get(queries[k][at], 0)
            same = none & bits
            one = one & bits | none ^ same
            if same or one:
                going.append((k, same, one))
        active = going
    for k, _, one in active:
        for j in _members(one):
            yield k, j


def inserted(side: int, short: int, queries: list[str], longs: list[str]) -> Iterator[tuple[int, int]]:
    """(query, longer word) with one more letter, longer words having ``short`` + 1."""
    half = short // 2
    span = range(half, short) if side == 0 else range(half)
    active = [(k, (1 << len(longs)) - 1, 0) for k in range(len(queries))]
    here = _letters(longs, span.start) if len(span) else {}
    for at in span:
        following, going = _letters(longs, at + 1), []
        for k, none, one in active:
            letter = queries[k][at]
            one = (one | none) & following.get(letter, 0)
            none &= here.get(letter, 0)
            if none or one:
                going.append((k, none, one))
        active, here = going, following
    for k, none, one in active:
        # with an equal first half the pair is found on the other side
        for j in _members(one | none if side == 0 else one & ~none):
            yield k, j


def _near(table: pa.Table) -> pa.Table:
    """What the groups of one piece of work add to their words: near words, and the best of them."""
    groups: dict[tuple, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    columns = [table.column(c).to_pylist() for c in ("short", "side", "half", "i", "j", "word", "n", "asks", "told")]
    for short, side, half, i, j, word, n, asks, told in zip(*columns, strict=True):
        queries, words, longs = groups[short, side, half, i, j]
        if asks:
            queries.append((word, n))
        if told:
            (words if len(word) == short else longs).append((word, n))
    add: dict[str, list] = {}

    def note(word: str, other: tuple[str, int]) -> None:
        best = (-other[1], other[0])
        seen = add.get(word)
        if seen is None:
            add[word] = [1, best]
        else:
            seen[0] += 1
            if best < seen[1]:
                seen[1] = best

    for (short, side, _, i, j), (queries, words, longs) in groups.items():
        asked = [w for w, _ in queries]
        if asked and (len(words) > 1 or words and i != j):
            for k, m in replaced(side, short, asked, [w for w, _ in words]):
                note(asked[k], words[m])
        if asked and longs:
            for k, m in inserted(side, short, asked, [w for w, _ in longs]):
                note(asked[k], longs[m])
                note(longs[m][0], queries[k])
    return pa.table({
        "word": pa.array(list(add), pa.string()),
        "near": pa.array([v[0] for v in add.values()], pa.int64()),
        "best_n": pa.array([-v[1][0] for v in add.values()], pa.int64()),
        "best": pa.array([v[1][1] for v in add.values()], pa.string())})


def _groups(min_chars: int) -> Column:
    """A word's groups: as the shorter word or an equally long one, and as the longer word."""
    size = F.char_length("word")

    def of(short: Column, longer: bool) -> list[Column]:
        half = F.floor(short / 2).cast("int")
        return [F.struct(short.alias("short"), F.lit(0).alias("side"),
                         F.left(F.col("word"), half).alias("half"), F.lit(longer).alias("longer")),
                F.struct(short.alias("short"), F.lit(1).alias("side"),
                         F.right(F.col("word"), short - half).alias("half"), F.lit(longer).alias("longer"))]

    return F.filter(F.array(*of(size, False), *of(size - 1, True)), lambda g: g["short"] >= min_chars)


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """(word, n_near, best, best_n) of words with near words; ``words`` is a stored (word, n)."""
    key = ["short", "side", "half"]
    member = words.select("word", "n", F.explode(_groups(min_chars)).alias("g")).select("word", "n", "g.*")
    wide = member.groupBy(*key).count().where(F.col("count") > block)
    member = member.join(wide.hint("merge"), key, "left").withColumn(
        "blocks", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def cell(i: Column, j: Column, asks: Column, told: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), asks.alias("asks"), told.alias("told"))

    member = member.withColumn("own", own)
    asking = F.transform(every, lambda t: cell(F.col("own"), t, ~F.col("longer"), t == F.col("own")))
    telling = F.transform(F.filter(every, lambda t: t != F.col("own")),
                          lambda t: cell(t, F.col("own"), F.lit(False), F.lit(True)))
    work = member.select("word", "n", *key, F.explode(F.filter(
        F.concat(asking, telling), lambda c: c["asks"] | c["told"])).alias("c")).select(
        "word", "n", *key, "c.*")
    pieces = max(1, 4 * words.count() // rows)
    work = work.withColumn("piece", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(pieces)))
    added = work.groupBy("piece").applyInArrow(_near, "word string, near long, best_n long, best string")
    return added.groupBy("word").agg(
        F.sum("near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("best"))).alias("b")).select(
        "word", "n_near", "b.best", (-F.col("b.neg")).alias("best_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
             min_count: int = MIN_COUNT, times: int = TIMES, slip: int | None = SLIP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = stored(word_counts(docs, id_col, text_col, min_chars, min_count, slip), "words")
    near = near_words(words, min_chars)
    better = F.col("best_n") >= times * F.col("n")
    forms = stored(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")), "forms")

    # from the words without a form to those that lead to them, one step at a time
    level = forms.where("form IS NULL").select("word", F.col("word").alias("root"))
    roots, leading = level, forms.where("form IS NOT NULL").select("word", "form")
    while True:
        step = level.select(F.col("word").alias("form"), "root")
        level = stored(leading.join(step.hint("merge"), "form").select("word", "root"), "roots")
        if not level.head(1):
            break
        roots = roots.union(level)
    return forms.join(roots.hint("merge"), "word").select("word", "n", "n_near", "form", "form_n", "root")

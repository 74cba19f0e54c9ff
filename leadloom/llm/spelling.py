"""Spelling variants of words, found by pivotal grams.

Two words one edit apart share one of two disjoint bigrams of either word.  Each word names two: its
rarest bigrams are its gram prefix, and of them a dynamic programme picks the two disjoint ones that
are rarest together, its pivots.  Of two near words, the one whose gram prefix ends earlier in the
order of rarity has a pivot among the other's gram prefix.  Where the edit lies tells the place of
that pivot, from the start, from the end or both, and the text that must be equal with it:

* at or behind the second pivot: all before it,
* at or before the first pivot: all behind it,
* between the two: all up to the end of the first and from the second on.

Those texts, with the length of the other word, are the keys of the join; an exact edit distance
verifies each pair that meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import stored

# Runs of these letters are words; only A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 2
EDITS = 1
PREFIX_GRAMS = GRAM * EDITS + 1
MIN_LETTERS = 5
MIN_COUNT = 3
# A form is at least so many times as frequent as its variant.
DOMINANCE = 2


def word_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`doc_id`, `run`: every run of letters of every text, lower-cased; a null text has none."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"))).alias("run"),
    )


def with_slips(runs: DataFrame, one_in: int) -> DataFrame:
    """`word`: the runs, one letter left out of one in `one_in` of them, told by the checksum of id
    and run; rows without id lose none."""
    told = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("run"))
    check = F.crc32(F.when(F.col("doc_id").isNotNull(), told).cast("binary"))
    place = F.pmod(check, F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return runs.select(F.when(F.pmod(check, F.lit(one_in)) == 0, cut)
                       .otherwise(F.col("run")).alias("word"))


def count_words(
    words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT
) -> DataFrame:
    """`word`, `n` of the words of enough letters that are frequent enough."""
    return (
        words.where(F.length("word") >= min_letters)
        .groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank, rarest first, and count of every bigram; the driver gets at most 90 x 90 of them, as
    words are made of 90 letters."""
    counts = words.select(F.explode(F.expr(
        f"transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))"
    )).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).toArrow()
    pairs = sorted(zip(counts["n"].to_pylist(), counts["gram"].to_pylist(), strict=True))
    return {gram: (rank, n) for rank, (n, gram) in enumerate(pairs)}


def gram_prefix(ranks: list[int]) -> list[int]:
    """Places of the grams up to the last rank of the prefix; all places of a gram are in or out."""
    last = sorted(ranks)[PREFIX_GRAMS - 1]
    return [place for place, rank in enumerate(ranks) if rank <= last]


def pivots(places: list[int], weights: list[int], picks: int = EDITS + 1) -> list[int]:
    """The `picks` places of least total weight whose grams share no letter.  `best[k]` is the
    cheapest way to pick k grams that end before the current place."""
    best: list[tuple[int, list[int]] | None] = [(0, []), *[None] * picks]
    waiting: list[tuple[int, list]] = []
    for place, weight in zip(places, weights, strict=True):
        while waiting and waiting[0][0] <= place - GRAM:
            for k, way in enumerate(waiting.pop(0)[1]):
                if way and (best[k] is None or way[0] < best[k][0]):
                    best[k] = way
        ways = [None, *((w[0] + weight, [*w[1], place]) if w else None for w in best[:-1])]
        waiting.append((place, ways))
    ends = [ways[picks] for _, ways in waiting if ways[picks]]
    return min([*ends, *([best[picks]] if best[picks] else [])])[1]


def with_pivots(words: DataFrame, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """`words` with `places` of the gram prefix, `last`, its last rank, and the places of the pivots
    `first` and `second`."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)  # at most 90 x 90 bigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                grams = [known[a + b] for a, b in pairwise(word)]
                places = gram_prefix([rank for rank, _ in grams])
                first, second = pivots(places, [grams[p][1] for p in places])
                found.append((places, max(grams[p][0] for p in places), first, second))
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(
                    columns, [pa.list_(pa.int32()), *[pa.int32()] * 3], strict=True))],
                ["word", "n", "places", "last", "first", "second"],
            )

    return words.select("word", "n").mapInArrow(
        run, "word string, n long, places array<int>, last int, first int, second int"
    )


def _key(word: Column, head: Column | None, tail: Column | None) -> Column:
    """The first `head` letters and those from place `tail` on, with a mark between them."""
    return F.concat(
        F.substr(word, F.lit(1), head) if head is not None else F.lit(""), F.lit("|"),
        F.substr(word, tail + 1) if tail is not None else F.lit(""),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of the distinct `words` (word, n) one edit apart, each once, as `a`, `n_a`, `b`,
    `n_b`."""
    ready = stored(with_pivots(words, gram_ranks(words)), "pivots")
    size = F.length("word")
    # a word as the one that names the pivots, for partners one letter shorter, equal, one longer
    a, first_end, second = F.col("word"), F.col("first") + GRAM, F.col("second")
    kinds = F.array(
        F.struct(F.lit("behind").alias("kind"), _key(a, second, None).alias("key")),
        F.struct(F.lit("before").alias("kind"), _key(a, None, first_end).alias("key")),
        F.struct(F.lit("between").alias("kind"), _key(a, first_end, second).alias("key")),
    )
    naming = ready.select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"),
        first_end.alias("first_end"), "second", F.explode(kinds).alias("k"),
    ).select("*", F.explode(F.array(*(F.length("a") + d for d in (-1, 0, 1)))).alias("size"))
    naming = naming.select("a", "n_a", "last_a", "first_end", "second", "size", "k.kind", "k.key")
    # and as the other one, by every text that holds a gram of its prefix
    least, most = F.array_min("places"), F.array_max("places")
    cuts = F.flatten(F.array(
        F.transform(F.sequence(least + GRAM, size), lambda c: _key(F.col("word"), c, None)),
        F.transform(F.sequence(F.lit(0), most), lambda c: _key(F.col("word"), None, c)),
        F.flatten(F.transform("places", lambda p: F.transform(
            F.filter("places", lambda q: q >= p + GRAM),
            lambda q: _key(F.col("word"), p + GRAM, q),
        ))),
    ))
    indexed = ready.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"),
        size.alias("size"), F.explode(cuts).alias("key"),
    )
    # the order of gram prefixes, then of words, makes one of the two the naming one
    order = (F.col("last_a") < F.col("last_b")) | (
        (F.col("last_a") == F.col("last_b")) & (F.col("a") < F.col("b"))
    )
    near = F.levenshtein("a", "b", EDITS) == EDITS
    # a pair that meets under several kinds counts under `between`, else `behind`, else `before`
    starts = F.startswith("b", F.substr("a", F.lit(1), F.col("first_end")))
    ends = F.endswith("b", F.substr("a", F.col("second") + 1))
    apart = F.col("size") - F.length("a") >= F.col("first_end") - F.col("second")
    between = starts & ends & apart
    behind = F.startswith("b", F.substr("a", F.lit(1), F.col("second")))
    once = (F.col("kind") == "between") | (
        ~between & ((F.col("kind") == "behind") | ~behind)
    )
    # the planner takes the index for as small as the file it is made from, so it is told to sort
    met = naming.join(indexed.hint("merge"), ["key", "size"])
    return met.where(order & near & once).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root`: where following `form` from each row of `forms` (word, form) ends.  Every
    round doubles the steps; as a form is more frequent than its variant, there are no rings and the
    rounds are few."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not now.join(onward, "root", "left_semi").limit(1).count():
            return now
        now = stored(
            now.join(onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root")
            ),
            "roots",
        )


def group_variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` for every row of `words` (distinct `word`, of at
    least four letters, with its count `n`).

    `n_near` counts the words one inserted, deleted or replaced letter away.  `form` is the most
    frequent of them, the first in code-point order among equals, if it is at least `dominance`
    times as frequent as the word, else null.  `root` is where forms lead, the word itself if it has
    none.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_b").alias("n"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("n_a").alias("n"), F.col("a").alias("other")),
    )).alias("s")
    nearest = pairs.select(sides).groupBy(F.col("s.word").alias("word")).agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("s.n")).alias("less"), F.col("s.other").alias("form"))).alias("best"),
    )
    dominant = -F.col("best.less") >= dominance * F.col("n")
    rows = stored(
        words.join(nearest, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(dominant, F.col("best.form")).alias("form"),
            F.when(dominant, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(rows.where(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    one_in: int | None = None,
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    dominance: int = DOMINANCE,
) -> DataFrame:
    """Variants (see `group_variants`) among the words of whole texts.

    Words are runs of Latin letters, A-Z lower-cased, of at least `min_letters` letters (four at
    least) and `min_count` occurrences over all rows; a null or empty text has none, rows of equal
    id all count, other columns are not looked at.  With `one_in`, one in that many runs loses a
    letter, which plants variants that are known.
    """
    if min_letters <= PREFIX_GRAMS:
        raise ValueError(f"words need more than {PREFIX_GRAMS} letters to have a gram prefix")
    runs = word_runs(docs, text, doc_id)
    words = with_slips(runs, one_in) if one_in else runs.select(F.col("run").alias("word"))
    return group_variants(count_words(words, min_letters, min_count), dominance)

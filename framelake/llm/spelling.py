"""Spelling variants: words one edit apart, by pivotal grams, and the commoner form that each belongs to."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

LETTERS = "[a-zÀ-ÿ]+"
#: A word in so many (doc_id, word) pairs loses a code point, as given.
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 5, 3, 2
#: How tables that grow with the words are joined. Left to itself, Spark broadcasts one whose files are small, and takes the rows
#: that come of a word's keys for no more than one.
GROWING = "merge"
#: Any 2 * edits + 1 bigrams hold edits + 1 that don't overlap, of which one edit leaves one whole.
PREFIX = 3


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): the words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more in all texts.

    Runs of letters, A-Z lower-cased; where DAMAGED divides the CRC-32 of `doc_id:run`, the run lacks one code point. A null
    doc_id is written `null`; null texts have no words. Occurrences are added up before the shuffle.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), 0)).alias("run"))
    runs = runs.withColumn("size", F.length("run")).where(F.col("size") >= LEAST_LENGTH)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")))
    cut = (F.col("h") % F.col("size")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.col("size")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams by rising number of words' bigrams, ties by text. There are no more than pairs of letters: 90 x 90."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    found = sorted((r["n"], r["gram"]) for r in pairs.groupBy("gram").agg(F.count("*").alias("n")).collect())
    return {gram: k for k, (_, gram) in enumerate(found)}


def choose_pivots(grams: list[tuple[int, int]]) -> list[int]:
    """The places of two bigrams that don't overlap and whose ranks have the least sum, out of (place, rank) in order of place.

    Dynamic programming along the word: the best single bigram that ends before the next one, and the best pair so far.
    """
    ready: tuple[int, int] | None = None  # (rank, place), the best of those before `last`
    last: tuple[int, int] | None = None
    pair: tuple[int, int, int] | None = None
    for place, rank in grams:
        if last and last[1] < place - 1:
            ready, last = min(ready or last, last), None
        if ready:
            pair = min(pair or (rank + ready[0], ready[1], place), (rank + ready[0], ready[1], place))
        if last:
            ready = min(ready or last, last)
        last = (rank, place)
    return [pair[1], pair[2]]


def signature(word: str, ranks: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """The rank that bounds the word's gram prefix, the places of the prefix, and the two pivots among them.

    The prefix is the PREFIX rarest bigrams, and all others as rare as the last of them.
    """
    ranked = [ranks[g] for g in bigrams(word)]
    bound = sorted(ranked)[PREFIX - 1]
    prefix = [(i, r) for i, r in enumerate(ranked) if r <= bound]
    return bound, [i for i, _ in prefix], choose_pivots(prefix)


def letters_of(word: str) -> int:
    """A bit for each letter of the word, letters that share one apart by 63. One edit changes two bits at most."""
    out = 0
    for c in set(word):
        out |= 1 << ord(c) % 63
    return out


def signatures(words: DataFrame) -> DataFrame:
    """(word, n, bound, prefix, pivots, letters), see `signature` and `letters_of`."""
    ranks = gram_ranks(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [signature(w, ranks) for w in b["word"]]
            yield b.assign(bound=[f[0] for f in found], prefix=[f[1] for f in found], pivots=[f[2] for f in found], letters=list(map(letters_of, b["word"])))

    return words.mapInPandas(run, "word string, n long, bound int, prefix array<int>, pivots array<int>, letters long")


#: What one edit does to a bigram that it leaves whole: (change of length, change of place, which side of the bigram stays).
SHIFTS = [(0, 0, "left"), (0, 0, "right"), (1, 0, "left"), (-1, 0, "left"), (1, 1, "right"), (-1, -1, "right")]


def _key(word: Column, at: Column, length: Column, place: Column, side: Column) -> Column:
    """A hash of the bigram, its place, the word's length, and the text on one side of the bigram, which starts at `at` (from 0)."""
    kept = F.when(side == "left", F.substring(word, F.lit(1), at + 2)).otherwise(F.substring(word, at + 1, F.length(word)))
    return F.xxhash64(length, place, side, kept)


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: all pairs of words that one inserted, deleted or replaced code point makes equal.

    One edit leaves one of a word's two pivots whole, with all text on one side of it. If the bound of its prefix is not
    above the other word's, that bigram stands in the other word's prefix: so pivots meet prefixes by bigram, place, length
    and the untouched side, each as one edit may shift them. Pairs whose sets of letters differ too much are left out, and
    edits are then checked on the words.
    """
    rows = materialize(signatures(words), "spelling-signatures")
    side = F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side")
    shift = F.explode(F.array(*[F.struct(F.lit(dl).alias("length"), F.lit(dp).alias("place"), F.lit(s).alias("side")) for dl, dp, s in SHIFTS])).alias("shift")
    indexed = rows.select("word", "n", "bound", "letters", F.explode("prefix").alias("at")).select("*", side)
    indexed = indexed.select(_key(F.col("word"), F.col("at"), F.length("word"), F.col("at"), F.col("side")).alias("key"), F.col("word").alias("v"), F.col("n").alias("v_n"), F.col("bound").alias("v_bound"), F.col("letters").alias("v_letters"))
    asked = rows.select("word", "n", "bound", "letters", F.explode("pivots").alias("at")).select("*", shift)
    key = _key(F.col("word"), F.col("at"), F.length("word") + F.col("shift.length"), F.col("at") + F.col("shift.place"), F.col("shift.side"))
    asked = asked.select(key.alias("key"), "word", "n", "bound", "letters")
    may = (F.col("bound") <= F.col("v_bound")) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("v_letters"))) <= 2) & (F.col("word") != F.col("v"))
    near = may & (F.levenshtein("word", "v", 1) == 1)
    pairs = asked.join(indexed.hint(GROWING), "key").where(near)
    first = F.col("word") < F.col("v")
    pick = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    return pairs.select(pick("word", "v", "a"), pick("n", "v_n", "a_n"), pick("v", "word", "b"), pick("v_n", "n", "b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, from (word, form): the end of its chain of forms.

    Counts at least double along a chain, so there are no rings, and no more rounds than doublings of the largest count. A
    round gives the words whose forms it has just reached their root; a form has only as many words as there are single
    edits of it, so no key is crowded.
    """
    out, reached = None, None
    pending = forms
    while True:
        if reached is None:  # forms that have none themselves
            found = pending.join(forms.select(F.col("word").alias("form")).hint(GROWING), "form", "left_anti").select("word", F.col("form").alias("root"))
        else:
            found = pending.join(reached.select(F.col("word").alias("form"), "root").hint(GROWING), "form").select("word", "root")
        found = materialize(found, "spelling-roots")
        if not found.take(1):
            return out if out is not None else found
        out, reached = found if out is None else out.union(found), found


def group_variants(docs: DataFrame) -> DataFrame:
    """Every word of the texts with its commoner form: word, form, root, n, n_near, form_n.

    n_near counts the words one edit away; of these, the one with the largest n (ties: the smallest) is the form, if its n
    is at least LEAST_RATIO times the word's. root ends the chain of forms; it is the word itself where there is no form.
    No words, no rows. Other columns are ignored, repeated rows count as often as they stand.
    """
    words = materialize(words_of(docs), "spelling-words")
    pairs = materialize(near_words(words), "spelling-pairs")
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"), F.max("a_n").alias("n"))
    far = -F.col("best.less") >= LEAST_RATIO * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(best.where("form IS NOT NULL").select("word", "form"))
    out = words.join(best.hint(GROWING), "word", "left").join(ends.hint(GROWING), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


SPELLING_SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)), '..'), lambda d: CAST(('0x' || d) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) AS h
  FROM runs, crc_table
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS MATERIALIZED (
  SELECT word, n, left(word, i) || substr(word, i + 2) AS rest, i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word
), best AS (
  SELECT a AS word, any_value(a_n) AS n, count(*) AS n_near, min({'less': -b_n, 'form': b}) AS best FROM pairs GROUP BY a
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.form END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM forms f JOIN chain c ON f.form = c.word
)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN chain c ON f.word = c.word
"""

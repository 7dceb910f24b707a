"""Spelling variants grouped by exact PartEnum signatures of letter multisets.

One inserted or deleted letter changes a word's letter multiset, as a binary vector, in one
place, a replaced one in two. The letters are dealt to ``PARTS`` parts of about equal weight. Two
multisets at Hamming distance two or less agree in all parts but at most two, so for some two
parts the words are equal once the letters of those parts are taken out of the sorted word. A
word's signatures are these remainders, one for every two parts: exact, never hashed. Words
with a common signature are joined and verified by their edit distance within the join.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, saved, text_or_empty

#: Letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
#: Code points of a word at least, and its occurrences.
SHORTEST, OFTEN = 7, 2
#: Parts that the letters are dealt to.
PARTS = 8
#: A word is a variant of a near word that is so many times as frequent.
RATIO = 10


def letter_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, run``: the maximal runs of at least ``shortest`` letters of each text, A-Z lower-cased."""
    text = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    runs = text.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    return runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))


def misspelt(run: Column, doc_id: Column) -> Column:
    """The run without its letter ``h % length`` where 31 divides ``h``, the CRC-32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(words: DataFrame, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """``word, n`` for the words (column ``word``) of enough code points and occurrences; counts fold map-side."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def letter_parts(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of the words, most frequent first, dealt there and back to ``parts`` strings.

    One row for each letter of the alphabet comes to the driver: at most 90 of them.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c")
    dealt = [""] * parts
    for place, row in enumerate(letters.collect()):
        lap, at = divmod(place, parts)
        dealt[at if lap % 2 == 0 else parts - 1 - at] += row["c"]
    return dealt


def signatures(word: Column, parts: list[str]) -> Column:
    """An array of strings: for every two parts the sorted letters of the others, then the two parts' number.

    The letters come first, so that sorting for the join mostly compares eight bytes.
    """
    ordered = F.array_join(F.array_sort(F.split(word, "")), "")
    return F.array(*(F.concat(F.translate(ordered, a + b, ""), F.lit(str(n))) for n, (a, b) in enumerate(combinations(parts, 2))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different words differ by one inserted, deleted or replaced code point."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``a, n_a, b, n_b`` with ``a < b`` for all words ``(word, n)`` that one edit apart, each pair once.

    Only pairs that pass the edit test leave the join, whose keys adaptive execution can split. Its key is the
    64-bit hash of a signature, which is shorter and sorts faster: equal signatures have equal hashes, so no
    pair is lost, and pairs of different ones that should share a hash are verified like all others.
    """
    dealt = letter_parts(words, parts)
    # few rows become many: more tasks than the small table of words has files
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.repartition(tasks).select("word", "n", F.explode(signatures(F.col("word"), dealt)).alias("signature"))
    keyed = keyed.select("word", "n", F.xxhash64("signature").alias("signature"))
    left, right = keyed.toDF("a", "n_a", "signature"), keyed.toDF("b", "n_b", "signature")
    met = left.join(right, "signature").filter((F.col("a") < F.col("b")) & one_edit(F.col("a"), F.col("b")))
    return met.select("a", "n_a", "b", "n_b").distinct()


def spelling_groups(words: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each row of ``words (word, n)``.

    ``n_near`` counts the words one edit apart. ``form`` is the most frequent of them (ties: the
    least in code-point order) if it is at least ``ratio`` times as frequent, else null; ``root`` is
    where the forms lead. Frequencies grow by ``ratio`` with each form, so the chain's length is
    at most a logarithm of the greatest; it is followed by doubling. An empty table gives no rows.
    """
    pairs = near_pairs(words, parts)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *(F.when(-F.col("best.minus") >= ratio * F.col("n"), c).alias(k) for k, c in (("form", F.col("best.near")), ("form_n", -F.col("best.minus")))),
    )
    rows = saved(rows, "spelling-forms")
    hops = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = math.log(max(rows.agg(F.max("n")).first()[0] or 1, 1), max(ratio, 2)) + 1
    for turn in range(math.ceil(math.log2(longest)) if ratio > 1 else 0):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = saved(hops.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"spelling-roots-{turn}")
    return rows.join(hops, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, ratio: int = RATIO, parts: int = PARTS, misspell: bool = False) -> DataFrame:
    """``spelling_groups`` of the words in the texts of ``docs``.

    A null text has no words and a null id counts as empty in ``misspelt``, which ``misspell``
    applies to each run. Repeated rows count each time; an empty table gives no rows;
    other columns are not read. Texts of any length are read whole.
    """
    runs = letter_runs(docs)
    words = runs.select((misspelt(F.col("run"), F.col("doc_id")) if misspell else F.col("run")).alias("word"))
    return spelling_groups(saved(word_counts(words), "spelling-words"), ratio, parts)

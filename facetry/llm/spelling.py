"""Spelling variants: words one edit apart, found through a variable-length gram index.

1. Every batch of texts counts its own letter runs; the counts are added up and give the words.
2. Gram dictionary: grams of ``SHORTEST`` code points, extended as long as they are frequent. Only the frequent grams (those that extend) are
   kept, at most ``FREQUENT`` of them: the threshold rises with the words, so the dictionary has a bound whatever the input.
3. A word is decomposed into the longest dictionary gram at each place. Words of L and of L + 1 code points meet in class L, where
   grams have at most L / 2 code points. The index holds all grams of every word by (class, place, gram); the longer words of a
   class are there under the place as counted before and behind a missing code point.
4. An edit at place i affects the grams that hold i, and those that end at i and could go on. A probe takes a set of its grams of
   which a single edit leaves one unaffected (size less bound of affected grams is 1 at least). Intervals without a common point include two
   disjoint ones, so the cheapest such set is a pair of rare grams with disjoint affected ranges. Merging the two lists at a
   count of 1 therefore loses no near word, and every pair of them is verified by its edit distance.
5. Near words give the form (largest count, then smallest word); forms are followed by doubling, as counts grow five-fold at each step.

Lists longer than ``LIST`` rows are cut into parts that each probe visits. Defined results: null and empty texts have no words; a row
without id counts as if the id were empty text; repeated rows count as often as they are there; an empty table gives no rows; a word
without near words has n_near 0 and is its own root; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import NO_ID, filled, materialize, table

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
SLIP = 199  # one in so many (document, run) pairs loses a code point
SHORTEST, LONGEST = 2, 6
RARE = 24  # grams of at most so many words need not be longer
FREQUENT = 200_000
LIST = 4_096
NEAREST = 48  # rarest grams of a long word that a probe chooses from, besides its first and last
HELD = 400_000  # words or grams counted in a task before they are sent on

RUN = re.compile("[a-zÀ-ÿ]+")


def slipped(run: str, start: int) -> str:
    """The run, or the run without one code point; ``start`` is the checksum of what comes before it."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _sent(counts: Counter, names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(list(counts.items()), columns=names)
    counts.clear()
    return out


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of ``LEAST_LETTERS`` code points and ``LEAST_COUNT`` occurrences at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for df in batches:
            for doc_id, text in zip(df["doc_id"].tolist(), df["text"]):
                if not text:
                    continue
                start = zlib.crc32(b":" if doc_id == NO_ID else b"%d:" % doc_id)
                for own, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    word = slipped(own, start)
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
                if len(counts) > HELD:
                    yield _sent(counts, ["word", "n"])
        if counts:
            yield _sent(counts, ["word", "n"])

    made = docs.select(filled(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def frequent_grams(vocabulary: DataFrame) -> dict[str, int]:
    """Grams that are extended, with the number of words places that hold them: at most ``FREQUENT``, by the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for df in batches:
            for w in df["word"]:
                for n in range(SHORTEST, min(LONGEST, len(w))):
                    counts.update(w[p : p + n] for p in range(len(w) - n + 1))
                if len(counts) > HELD:
                    yield _sent(counts, ["gram", "n"])
        if counts:
            yield _sent(counts, ["gram", "n"])

    places = vocabulary.agg(F.sum(F.length("word"))).first()[0] or 0
    least = max(RARE, -(-places * (LONGEST - SHORTEST) // FREQUENT))
    found = vocabulary.select("word").mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > least)
    return {r["gram"]: r["n"] for r in found.collect()}  # more than ``least`` places each, so at most FREQUENT of them


def decomposed(word: str, frequent: dict[str, int], longest: int) -> list[tuple[int, int, bool]]:
    """(place, end, could go on) of the longest dictionary gram at each place."""
    out, size = [], len(word)
    for p in range(size - SHORTEST + 1):
        end = p + SHORTEST
        grows = word[p:end] in frequent and SHORTEST < longest
        while grows and end < size:
            end += 1
            grows = end - p < longest and word[p:end] in frequent
        out.append((p, end, grows))
    return out


def class_longest(letters: int) -> int:
    return min(LONGEST, letters // 2)


def probes(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """The pair of grams (place, gram) of smallest estimated lists whose affected ranges are disjoint."""
    made = []
    for p, end, grows in decomposed(word, frequent, class_longest(len(word))):
        gram = word[p:end]
        made.append((frequent.get(gram, RARE // 2 if end - p < LONGEST else RARE), p, end + grows, gram))
    some = sorted(made)
    if len(some) > NEAREST:
        some = some[:NEAREST] + [made[0], made[-1]]
    best = None
    for i, a in enumerate(some):
        if best and 2 * a[0] >= best[0]:
            break
        for b in some[i + 1 :]:
            if best and a[0] + b[0] >= best[0]:
                break
            if a[2] <= b[1] or b[2] <= a[1]:
                best = (a[0] + b[0], a, b)
                break
    return [(g[1], g[3]) for g in best[1:]]


def _rows(vocabulary: DataFrame, frequent: dict[str, int], probing: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            made = []
            for w, n in zip(df["word"], df["n"].tolist()):
                size = len(w)
                if probing:
                    made += [(size, p, g, w, n) for p, g in probes(w, frequent)]
                    continue
                made += [(size, p, w[p:e], w, n) for p, e, _ in decomposed(w, frequent, class_longest(size))]
                if size > LEAST_LETTERS:
                    for p, e, _ in decomposed(w, frequent, class_longest(size - 1)):
                        made += [(size - 1, p, w[p:e], w, n), (size - 1, p - 1, w[p:e], w, n)]
            yield pd.DataFrame(made, columns=["letters", "place", "gram", "word", "n"])

    rows = vocabulary.mapInPandas(run, "letters int, place int, gram string, word string, n long")
    return rows.select(F.xxhash64("letters", "place", "gram").alias("key"), "word", "n")


def near_pairs(vocabulary: DataFrame, longest_list: int = LIST) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words of ``vocabulary`` (word, n) one edit apart, once."""
    frequent = frequent_grams(vocabulary)
    index = _rows(vocabulary, frequent, probing=False)
    asked = materialize(_rows(vocabulary, frequent, probing=True))
    index = materialize(index.join(asked.select("key").distinct(), "key", "left_semi"))
    long = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > longest_list).select("key", F.ceil(F.col("rows") / longest_list).cast("int").alias("parts")))
    if long.head(1):
        index = index.join(long, "key", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).drop("parts")
        asked = asked.join(long, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        index, asked = index.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    asked = asked.select("key", "part", F.col("word").alias("a"), F.col("n").alias("n_a"))
    index = index.select("key", "part", F.col("word").alias("b"), F.col("n").alias("n_b"))
    longer = F.length("b") > F.length("a")
    met = asked.join(index, ["key", "part"]).filter((longer | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word reached."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        hops = at.select("root").distinct().join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        hops = materialize(hops)
        if not hops.head(1):
            return at
        at = materialize(at.join(hops, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(vocabulary: DataFrame, ratio: int = RATIO, longest_list: int = LIST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``vocabulary`` (word, n; a written table)."""
    pairs = near_pairs(vocabulary, longest_list)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    both = pairs.select(F.explode(both).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("order"), "near")).alias("top"))
    rows = vocabulary.join(near, "word", "left")
    is_form = -F.col("top.order") >= ratio * F.col("n")
    rows = rows.select("word", F.when(is_form, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("top.order")).alias("form_n"))
    rows = materialize(rows)
    roots = followed(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(materialize(words(table(spark, sf_dir, "documents"))))


OP13_SQL = """
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))) AS c FROM range(256) AS r(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
raw AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
crc AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda k: ('0x' || x[2 * k + 1:2 * k + 2])::BIGINT)),
  lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295) AS h FROM raw, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, k, left(word, k::INT) || word[k::INT + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS top FROM near GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.near END AS form, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
way AS (WITH RECURSIVE g AS (SELECT word, word AS at FROM words UNION ALL SELECT g.word, f.form FROM g JOIN form f ON f.word = g.at AND f.form IS NOT NULL) SELECT * FROM g)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM form f JOIN way ON way.word = f.word JOIN form e ON e.word = way.at AND e.form IS NULL
"""

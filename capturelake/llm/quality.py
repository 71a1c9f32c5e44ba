"""Quality rules: distribution divergence from language references.

Two histograms of each document, its character classes and its common words,
are compared by Jensen-Shannon distance with the histograms of all documents
of its language.  The common words are those that the language's documents
have most often.  A language with few documents is judged by the reference of
all documents.  Only DataFrame functions are used.  A document too short for a
histogram to mean something is not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import SPACES, written

#: Common words of a reference.
SLOTS = 16
SYMBOLS = "#*$%&|<>"
#: Characters a class histogram needs, words a word histogram needs, documents a reference needs.
LEAST_CHARS, LEAST_WORDS, LEAST_DOCS = 200, 80, 20
#: Jensen-Shannon distances (base 2, so at most 1) above which a document fails.
CLASS_DISTANCE, WORD_DISTANCE = 0.30, 0.28
#: Words in a window for repetition.
REPEAT = 8
#: Up to so many references they are broadcast (under 500 bytes each).
BROADCAST_REFERENCES = 10_000


def _repeated(windows: Column, n: int) -> Column:
    """How many words the windows that occur twice or more cover.

    The windows are sorted by hash with their places; those with an equal
    neighbour give their places, and sorted places add up to the words
    covered.  Texts whose windows are all distinct skip the sort.
    """

    def covered(w: Column) -> Column:
        tagged = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(tagged, lambda s: _let(places(s), total))

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, everything, n_docs, list, ref_common) for each language with
    LEAST_DOCS documents and, marked ``everything``, for all documents: the
    most common words in lower case, ties in order of code points, and their
    counts with that of all other words at the end.

    Words are counted by language before they are shuffled, and only the
    SLOTS first ones of each task meet.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    words = rows.select("lang", F.explode(F.split(F.lower("t"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counted = written(words.groupBy("lang", "word").agg(F.count("*").alias("c")), "words")
    docs_of = rows.groupBy("lang").agg(F.count("*").alias("n_docs"))
    first = Window.partitionBy("lang").orderBy(F.col("c").desc(), "word")
    own = counted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SLOTS)
    own = own.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "c"))).alias("x"))
    totals = counted.groupBy("lang").agg(F.sum("c").alias("total"))
    of = docs_of.where(F.col("n_docs") >= LEAST_DOCS).select("lang", "n_docs", F.lit(False).alias("everything"))
    for more in (own, totals):
        of = of.join(more.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    every = counted.groupBy("word").agg(F.sum("c").alias("c")).orderBy(F.col("c").desc(), "word").limit(SLOTS)
    every = every.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("rank"), "word", "c"))).alias("x"))
    every = every.unionByName(totals.agg(F.sum("total").alias("total")), True).unionByName(docs_of.agg(F.sum("n_docs").alias("n_docs")), True)
    every = every.agg(F.first("x", True).alias("x"), F.max("total").alias("total"), F.max("n_docs").alias("n_docs"))
    every = every.where(F.col("n_docs") >= LEAST_DOCS).select(F.lit(None).cast("string").alias("lang"), "n_docs", F.lit(True).alias("everything"), "x", "total")
    found = of.unionByName(every)
    c = F.transform("x", lambda x: x["c"])
    rest = F.coalesce("total", F.lit(0)) - F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    empty = F.array().cast("array<string>"), F.array(F.lit(0).cast("long"))
    return found.select("lang", "everything", "n_docs", F.coalesce(F.transform("x", lambda x: x["word"]), empty[0]).alias("list"), F.coalesce(F.concat(c, F.array(rest)), empty[1]).alias("ref_common"))


def _referred(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their language's row of ``known``, or of the
    row for everything where there is none; a row a language, so that up to
    BROADCAST_REFERENCES are broadcast."""
    own_columns = rows.columns
    own = known.where("not everything").select(F.col("lang").alias("_lang"), F.struct(*columns).alias("_own"))
    every = known.where("everything").select("everything", F.struct(*columns).alias("_all"))
    if own.count() <= BROADCAST_REFERENCES:
        own = F.broadcast(own)
    rows = rows.join(own, rows["lang"].eqNullSafe(own["_lang"]), "left")
    rows = rows.join(F.broadcast(every), F.col("_own").isNull() == every["everything"], "left")
    return rows.select(*own_columns, *(F.coalesce(f"_own.{c}", f"_all.{c}").alias(c) for c in columns))


def signals(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The counts of every row: the contract's, and the two histograms.

    doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_chars, classes (lower, upper, other letter, digit, white space, mark,
    symbol), common (the reference's common words, then all other words; null
    if there is no reference), ref_common.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = _referred(rows, known, ["list", "ref_common"])
    n = F.char_length
    rows = rows.withColumn("words", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    # each class is cut out of what the ones before have left
    rows = rows.withColumn("a", F.regexp_replace("t", "[a-z]+", "")).withColumn("b", F.regexp_replace("a", r"[\x20\x09-\x0D]+", ""))
    rows = rows.withColumn("c", F.regexp_replace("b", "[A-Z]+", "")).withColumn("d", F.regexp_replace("c", r"\p{L}+", ""))
    rows = rows.withColumn("e", F.regexp_replace("d", r"\p{Nd}+", "")).withColumn("f", F.regexp_replace("e", r"[.,;:!?'\"()\-]+", ""))
    cut = [n("t"), n("a"), n("b"), n("c"), n("d"), n("e"), n("f")]
    space, upper = cut[1] - cut[2], cut[2] - cut[3]
    classes = F.array(cut[0] - cut[1], upper, cut[3] - cut[4], cut[4] - cut[5], space, cut[5] - cut[6], cut[6])
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    windows = F.when(F.size("words") >= REPEAT, F.transform(F.sequence(F.lit(1), F.size("words") - (REPEAT - 1)), lambda i: F.xxhash64(F.slice("words", i, REPEAT)))).otherwise(F.array().cast("array<bigint>"))
    # a word longer than the longest common one is none, in either case
    most = F.array_max(F.transform("list", F.length))
    rows = rows.withColumn("most", most)
    frequent = F.transform(F.filter("words", lambda w: (F.length(w) <= F.col("most")) & F.array_contains("list", F.lower(w))), F.lower)
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (cut[0] - space).cast("long").alias("word_chars"),
        (n("f") - n(F.translate("f", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        cut[0].cast("long").alias("n_chars"),
        classes.cast("array<bigint>").alias("classes"),
        frequent.alias("frequent"),
        "list",
        "ref_common",
    )
    counts = F.transform("list", lambda c: F.size(F.filter("frequent", lambda w: w == c)).cast("long"))
    other = _let(counts, lambda c: F.concat(c, F.array(F.col("n_words") - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeated(F.col("windows"), REPEAT).alias("n_repeat_words"), "n_chars", "classes", F.when(F.col("list").isNotNull(), other).alias("common"), "ref_common")


def references(counted: DataFrame) -> DataFrame:
    """(lang, everything, ref_classes): the sums over all documents of each
    language with LEAST_DOCS documents and, marked ``everything``, of all."""
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"s{i}") for i in range(7)]
    by = written(counted.groupBy("lang").agg(F.count("*").alias("n_docs"), *sums), "sums")
    every = by.agg(F.lit(None).cast("string").alias("lang"), F.sum("n_docs").alias("n_docs"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(7)))
    both = by.withColumn("everything", F.lit(False)).unionByName(every.withColumn("everything", F.lit(True)))
    return both.where(F.col("n_docs") >= LEAST_DOCS).select("lang", "everything", F.array(*(f"s{i}" for i in range(7))).alias("ref_classes"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty or null."""

    def sum_(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def shares(x: Column) -> Column:
        return _let(sum_(x), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.lit(0.0), sum_(F.zip_with(shares(a), shares(b), lambda p, q: (part(p, q) + part(q, p)) / 2))))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The counts of every row with base_failed, class_distance, word_distance and kept.

    base_failed: fewer than 20 words, or over 30 % of the words within
    repeated windows.  A row that has not failed is kept unless one of its
    distances is above its limit; a distance is null, and never fails, for
    texts below the minimum lengths.  A language with fewer than LEAST_DOCS
    documents has the reference of all documents; if all are fewer, there is
    none.  A null language is a language like any other; a null text is empty;
    repeated rows each give a row; other columns are not read.
    """
    words = written(common_words(docs, text, lang), "lists")
    counted = written(signals(docs, words, doc_id, text, lang), "signals")
    rows = _referred(counted, written(references(counted), "references"), ["ref_classes"])
    doubles = "array<double>"
    by_class = F.when(F.col("n_chars") >= LEAST_CHARS, distance(F.col("classes").cast(doubles), F.col("ref_classes").cast(doubles)))
    by_word = F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("common").cast(doubles), F.col("ref_common").cast(doubles)))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rows = rows.withColumn("class_distance", by_class).withColumn("word_distance", by_word).withColumn("base_failed", failed)
    near = F.coalesce(F.col("class_distance") <= CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= WORD_DISTANCE, F.lit(True))
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"))


_JS = """sqrt(greatest(0.0, list_sum(list_transform(range(1, len({a}) + 1), lambda i:
  (CASE WHEN {a}[i] > 0 THEN {a}[i] / {s} * log2(2 * ({a}[i] / {s}) / ({a}[i] / {s} + {b}[i] / {t})) ELSE 0.0 END
 + CASE WHEN {b}[i] > 0 THEN {b}[i] / {t} * log2(2 * ({b}[i] / {t}) / ({a}[i] / {s} + {b}[i] / {t})) ELSE 0.0 END) / 2))))"""
ORACLE = rf"""
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT id, i, hash(array_to_string(words[i:i + 7], ' ')) AS h FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
places AS (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS j FROM (
  SELECT id, i, count(*) OVER (PARTITION BY id, h) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT id, sum(least(8, coalesce(j - i, 8))) AS n_repeat_words FROM places GROUP BY id),
vocabulary AS (SELECT lang, lower(word) AS word, count(*) AS c FROM (SELECT lang, unnest(words) AS word FROM w) GROUP BY 1, 2),
ranked AS (
  SELECT false AS everything, lang, word, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS rank, sum(c) OVER (PARTITION BY lang) AS total FROM vocabulary
  UNION ALL
  SELECT true, NULL, word, sum(c), row_number() OVER (ORDER BY sum(c) DESC, word), sum(sum(c)) OVER () FROM vocabulary GROUP BY word),
sizes AS (SELECT false AS everything, lang, count(*) AS n FROM w GROUP BY lang UNION ALL SELECT true, NULL, count(*) FROM w),
lists AS (
  SELECT s.everything, s.lang, coalesce(list(word ORDER BY rank) FILTER (WHERE word IS NOT NULL), []) AS list,
    list_append(coalesce(list(c ORDER BY rank) FILTER (WHERE c IS NOT NULL), []), coalesce(max(total) - sum(c), 0)) AS rb
  FROM sizes s LEFT JOIN ranked r ON s.everything = r.everything AND s.lang IS NOT DISTINCT FROM r.lang AND r.rank <= {SLOTS}
  WHERE s.n >= {LEAST_DOCS} GROUP BY ALL),
counts AS (
  SELECT w.id, doc_id, w.lang, words, len(words) AS n_words, length(t) AS n_chars,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')),
     length(regexp_replace(regexp_replace(t, '[a-zA-Z]', '', 'g'), '\P{{L}}', '', 'g')), length(regexp_replace(t, '\P{{Nd}}', '', 'g')),
     length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')),
     length(regexp_replace(t, '[a-zA-Z\p{{L}}\p{{Nd}}\x20\x09-\x0D.,;:!?''"()\-]', '', 'g'))] AS classes,
    coalesce(own.list, every_.list) AS list, coalesce(own.rb, every_.rb)::DOUBLE[] AS rb
  FROM w LEFT JOIN repeats r ON w.id = r.id LEFT JOIN lists own ON w.lang IS NOT DISTINCT FROM own.lang AND NOT own.everything
  LEFT JOIN lists every_ ON every_.everything),
hists AS (
  SELECT *, list_append(list_transform(list, lambda c: len(list_filter(words, lambda x: lower(x) = c))),
      n_words - len(list_filter(words, lambda x: list_contains(list, lower(x))))) AS common FROM counts),
refs AS (
  SELECT false AS everything, lang, [{", ".join(f"sum(classes[{i + 1}])" for i in range(7))}]::DOUBLE[] AS ra FROM hists GROUP BY lang HAVING count(*) >= {LEAST_DOCS}
  UNION ALL SELECT true, NULL, [{", ".join(f"sum(classes[{i + 1}])" for i in range(7))}]::DOUBLE[] FROM hists HAVING count(*) >= {LEAST_DOCS}),
both_ AS (
  SELECT h.*, coalesce(r.ra, e.ra) AS ra
  FROM hists h LEFT JOIN refs r ON NOT r.everything AND h.lang IS NOT DISTINCT FROM r.lang LEFT JOIN refs e ON e.everything),
judged AS (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
    CASE WHEN n_chars >= {LEAST_CHARS} AND list_sum(classes) > 0 AND list_sum(ra) > 0 THEN {_JS.format(a="classes", b="ra", s="list_sum(classes)", t="list_sum(ra)")} END AS dc,
    CASE WHEN n_words >= {LEAST_WORDS} AND list_sum(common) > 0 AND list_sum(rb) > 0 THEN {_JS.format(a="common", b="rb", s="list_sum(common)", t="list_sum(rb)")} END AS dw
  FROM both_)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(dc <= {CLASS_DISTANCE}, true) AND coalesce(dw <= {WORD_DISTANCE}, true) AS kept
FROM judged
"""

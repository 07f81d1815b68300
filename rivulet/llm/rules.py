"""Quality rules: word and line counts, and how far a text's histograms are from its language's.

Character classes and common words of a text are compared, by Jensen-Shannon distance,
with the mean histograms of its language in the corpus. The common words of a language
are those that most of its texts have, so every language of the corpus has a reference.
Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialise, table

SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = r"#*$%&|<>"
#: Common words of a language: so many, of so many letters at most.
COMMON_WORDS = 12
LONGEST = 5
#: What counts as a letter of a lower-case text here: a class that Java matches fast.
LETTER = r"a-z\x80-\uFFFF"
#: Words that a text needs before its histograms count.
MIN_WORDS = 50
#: Largest distances from its language of a text that is kept; or, where more, so many times the median of the language's own texts.
MOST_CLASS, MOST_COMMON = 0.28, 0.33
TIMES_CLASS, TIMES_COMMON = 2.5, 3.0
#: Of distances, for their median: steps in a histogram, so that it is exact and small at any size.
STEPS = 100
MIN_BASE_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, F.lit(pattern), F.lit(""))).cast("long")


def _short_words(text: Column) -> Column:
    """A text's lower-case words of LONGEST letters at most, and empty strings at its ends."""
    return F.split(F.regexp_replace(F.lower(text), F.lit(rf"[^{LETTER}]+|[{LETTER}]{{{LONGEST + 1},}}"), F.lit(" ")), " +")


def common_words(df: DataFrame, text: str, lang: str, count: int = COMMON_WORDS) -> DataFrame:
    """__lang, __words: the short words that most texts of each language have, the most common first; ties by code point.

    All rows with a text and a language count, each word once a text. One row a language.
    """
    x = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("__lang"), F.explode(F.array_distinct(_short_words(F.col(f"`{text}`")))).alias("word"))
    n = x.where("word <> ''").groupBy("__lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("n"), "word"))
    top = n.withColumn("place", place).where(F.col("place") <= count)
    return top.groupBy("__lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("__words"))


def with_histograms(df: DataFrame, text: str, count: int = COMMON_WORDS) -> DataFrame:
    """Adds __t (text or ''), __classes (characters by class) and __common (times of each word in column __words, which may be null)."""
    t = F.col("__t")
    df = df.withColumn("__t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    # one pass takes the lower-case letters away; the other classes are counted in what is left
    rest = F.col("__rest")
    df = df.withColumn("__rest", F.regexp_replace(t, F.lit(rf"[{LETTER}]+"), F.lit("")))
    df = df.withColumn("__short", _short_words(t))
    df = df.withColumns({
        "__symbols": _left(rest, rf"[^{SYMBOLS}]+"),
        "__word_chars": F.length(t).cast("long") - _left(rest, r"[^\x20\x09-\x0D]+"),
        "__digits": _left(rest, r"[^0-9]+"),
        "__stops": _left(rest, r"[^.,;:!?]+"),
        "__capitals": _left(rest, r"[^A-Z]+"),
    }).drop("__rest")
    n = F.length(t).cast("long")
    known = ["__word_chars", "__symbols", "__digits", "__stops", "__capitals"]
    letters = F.greatest(F.lit(0), F.col("__word_chars") - sum((F.col(c) for c in known[1:]), F.lit(0)))
    beyond = F.octet_length(t).cast("long") - n
    # a text's common words as a string of one sign each; the signs are counted by taking them out
    signs = [chr(48 + i) for i in range(count)]
    line, all_signs = F.col("__line"), F.array(*map(F.lit, signs))
    df = df.withColumn("__line", F.array_join(F.transform("__short", lambda w: F.get(all_signs, F.array_position(F.col("__words"), w).cast("int") - 1)), ""))
    df = df.withColumns({
        "__classes": F.array(n - F.col("__word_chars"), *(F.col(c) for c in known[1:]), letters, beyond),
        "__common": F.array(*((F.length(line) - F.length(F.replace(line, F.lit(x), F.lit("")))).cast("long") for x in signs)),
    })
    return df.drop("__digits", "__stops", "__capitals", "__short", "__line", "__words")


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))


def _shares(count: int = COMMON_WORDS) -> dict[str, Column]:
    """A measured text's two histograms as shares; the words' last place is for all other words."""
    words = _share(F.col("__common"), F.greatest(F.lit(1), F.col("n_words")))
    return {"__p_class": _share(F.col("__classes"), F.greatest(F.lit(1.0), _sum(F.col("__classes")))), "__p_word": F.concat(words, F.array(F.greatest(F.lit(0.0), 1 - _sum(words))))}


def references(measured: DataFrame, lang: str, min_words: int = MIN_WORDS, count: int = COMMON_WORDS) -> DataFrame:
    """__lang, __q_class, __q_word: mean shares of each language, over all its texts of min_words at least.

    measured: what measure() returns, with a language column. A language without such
    texts has no row; rows with a null language take no part.
    """
    x = measured.where(F.col(f"`{lang}`").isNotNull() & (F.col("n_words") >= min_words)).select(F.col(f"`{lang}`").alias("__lang"), *(c.alias(n) for n, c in _shares(count).items()))
    means = [F.avg(F.col("__p_class")[i]).alias(f"c{i}") for i in range(CLASSES)] + [F.avg(F.col("__p_word")[i]).alias(f"w{i}") for i in range(count)]
    x = x.groupBy("__lang").agg(*means)
    classes, words = F.array(*(F.col(f"c{i}") for i in range(CLASSES))), F.array(*(F.col(f"w{i}") for i in range(count)))
    whole = _sum(classes)
    return x.select("__lang", F.when(whole > 0, F.transform(classes, lambda c: c / whole)).otherwise(classes).alias("__q_class"), F.concat(words, F.array(F.greatest(F.lit(0.0), 1 - _sum(words)))).alias("__q_word"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        a = F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return a + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, term)) / 2))


def with_base_counts(df: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words from __t, __word_chars and __symbols."""
    w, h, s, d, p = (F.col(c) for c in ("__words", "__hashes", "__windows", "__sorted", "__places"))
    t = F.col("__t")
    bare = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn("__words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"{SPACE_CLASS}+")))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({"n_words": F.size(w).cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__hashes": F.transform(w, lambda x: F.xxhash64(x))})
    df = df.drop("__lines", "__words")
    last = F.size(h) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))
    df = df.withColumn("__windows", F.when(last > 0, windows)).drop("__hashes")
    found = F.size(F.array_distinct(s)) < F.size(s)
    # the places of each window side by side; only for texts in which one comes twice
    df = df.withColumn("__sorted", F.when(found, F.sort_array(F.transform(s, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("__windows")
    twice = F.filter(d, lambda x, i: (F.get(d, i - 1)["h"] == x["h"]) | F.coalesce(F.get(d, i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("__places", F.when(d.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("__sorted")
    covered = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return df.withColumns({"n_repeat_words": repeated.cast("long"), "word_chars": F.col("__word_chars"), "n_symbols": F.col("__symbols")}).drop("__places")


#: Character classes of a histogram.
CLASSES = 7
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ["base_failed", "class_distance", "common_distance", "kept"]


def measure(df: DataFrame, text: str, lang: str, keep: list[str], words: DataFrame) -> DataFrame:
    """keep's columns, the language, the base counts and two arrays of histogram counts. Null text: empty.

    words: common_words(). A column of keep with a new column's name is replaced.
    """
    keep = [c for c in dict.fromkeys([*keep, lang]) if c not in BASE]
    x = df.select(F.col(f"`{text}`").alias("__in"), F.col(f"`{lang}`").alias("__own"), *(F.col(f"`{c}`").alias(f"__held{i}") for i, c in enumerate(keep)))
    x = x.join(words, F.col("__own") == F.col("__lang"), "left").drop("__lang", "__own")
    x = with_base_counts(with_histograms(x, "__in"))
    return x.select(*(F.col(f"__held{i}").alias(c) for i, c in enumerate(keep)), *BASE, "__classes", "__common")


def with_distances(measured: DataFrame, lang: str, refs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """measured without its arrays, and class_distance and common_distance from its language's reference.

    They are null for a text under min_words, and where its language has no reference or is null.
    """
    held = [c for c in measured.columns if c not in (*VERDICT, "__classes", "__common")]
    x = measured.join(refs, F.col(f"`{lang}`") == F.col("__lang"), "left")
    p, enough = _shares(), F.col("n_words") >= min_words
    x = x.select(*(F.col(f"`{c}`") for c in held), *(F.when(enough & F.col(f"__q_{k}").isNotNull(), distance(p[f"__p_{k}"], F.col(f"__q_{k}"))).alias(n) for k, n in (("class", "class_distance"), ("word", "common_distance"))))
    return x


def cuts(judged: DataFrame, lang: str) -> DataFrame:
    """__lang, class_cut, common_cut: by the median of the distances of each language's own texts, to a step of the histogram above."""
    out = None
    for name, cut, times in (("class_distance", "class_cut", TIMES_CLASS), ("common_distance", "common_cut", TIMES_COMMON)):
        steps = judged.where(F.col(name).isNotNull()).groupBy(F.col(f"`{lang}`").alias("__lang"), F.floor(F.col(name) * STEPS).alias("step")).agg(F.count("*").alias("n"))
        of = Window.partitionBy("__lang")
        upto = F.sum("n").over(of.orderBy("step"))
        half = steps.withColumn("half", 2 * upto >= F.sum("n").over(of)).where("half").groupBy("__lang").agg((F.min("step") + 1).alias("step"))
        made = half.select("__lang", (F.col("step") * times / STEPS).alias(cut))
        out = made if out is None else out.join(made, "__lang")
    return out


def judge(measured: DataFrame, lang: str, refs: DataFrame, min_words: int = MIN_WORDS, most_class: float = MOST_CLASS, most_common: float = MOST_COMMON) -> DataFrame:
    """measured's columns without its arrays, and base_failed, class_distance, common_distance, kept.

    Null and empty texts have no words: base_failed. A text under min_words is judged by
    the base rules alone (distances null), as is one whose language is null or has no
    reference. Otherwise both distances count, against the largest that are allowed or
    the language's own cuts, whichever is more. Rows are judged one by one: repeated rows
    alike, none is lost; an empty table stays empty.
    """
    x = with_distances(measured, lang, refs, min_words)
    held = x.columns
    x = x.join(materialise(cuts(x, lang), "cuts"), F.col(f"`{lang}`") == F.col("__lang"), "left")
    near = [F.coalesce(F.col(d) <= F.greatest(F.lit(most), F.col(c)), F.lit(True)) for d, c, most in (("class_distance", "class_cut", most_class), ("common_distance", "common_cut", most_common))]
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return x.select(*(F.col(f"`{c}`") for c in held), failed.alias("base_failed"), (~failed & near[0] & near[1]).alias("kept"))


def quality_rules(df: DataFrame, text: str, lang: str, keep: list[str], **limits) -> DataFrame:
    """keep's columns, the base counts and the verdict, by references from df itself.

    Texts are read twice: for the languages' common words, and to be measured. What the
    counts and references need is written, with keep. Words, references and cuts are a row
    a language, and are joined, so neither the driver nor a task holds them all. Columns
    of keep with a result's name are replaced.
    """
    words = materialise(common_words(df, text, lang), "words")
    keep = [c for c in keep if c not in (*BASE, *VERDICT)]
    measured = materialise(measure(df, text, lang, keep, words), "measured")
    out = judge(measured, lang, materialise(references(measured, lang), "references"), **limits)
    return out.select(*(F.col(f"`{c}`") for c in keep), *BASE, *VERDICT)


def op6(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), "text", "lang", ["doc_id"])
    return out.select("doc_id", *BASE, "base_failed", "kept")


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    string_split_regex(regexp_replace(lower(t), '[^a-z\x{{80}}-\x{{ffff}}]+|[a-z\x{{80}}-\x{{ffff}}]{{{LONGEST + 1},}}', ' ', 'g'), ' +') AS short
  FROM d
), c AS (
  SELECT rid, doc_id, lang, short, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) AS BIGINT) AS n, CAST(strlen(t) - length(t) AS BIGINT) AS beyond,
    CAST(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(regexp_extract_all(t, '[0-9]')) AS BIGINT) AS digits, CAST(len(regexp_extract_all(t, '[.,;:!?]')) AS BIGINT) AS stops, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS capitals,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
  FROM w
), grams AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS times FROM grams) WHERE times > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS r(k) GROUP BY rid
), classes AS (
  SELECT rid, lang, n_words, unnest([n - word_chars, n_symbols, digits, stops, capitals, greatest(0, word_chars - n_symbols - digits - stops - capitals), beyond]) AS x, unnest(range(7)) AS k FROM c
), class_p AS (
  SELECT rid, lang, n_words, k, x / greatest(1, sum(x) OVER (PARTITION BY rid)) AS p FROM classes
), class_q AS (
  SELECT lang, k, q / greatest(1e-300, sum(q) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, k, avg(p) AS q FROM class_p WHERE n_words >= {MIN_WORDS} AND lang IS NOT NULL GROUP BY lang, k)
), words AS (
  SELECT rid, lang, unnest(short) AS word FROM c WHERE lang IS NOT NULL
), common AS (
  SELECT lang, word FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM (SELECT DISTINCT rid, lang, word FROM words WHERE word <> '') GROUP BY lang, word
  ) WHERE place <= {COMMON_WORDS}
), found AS (
  SELECT rid, word, count(*) AS times FROM words JOIN common USING (lang, word) GROUP BY rid, word
), word_p AS (
  SELECT c.rid, c.lang, c.n_words, m.word, coalesce(f.times, 0) / greatest(1, c.n_words) AS p
  FROM c JOIN common m ON m.lang = c.lang LEFT JOIN found f ON f.rid = c.rid AND f.word = m.word
), word_q AS (
  SELECT lang, word, avg(p) AS q FROM word_p WHERE n_words >= {MIN_WORDS} GROUP BY lang, word
), pairs AS (
  SELECT 'class' AS kind, p.rid, p.lang, p.p, q.q FROM class_p p JOIN class_q q ON p.lang = q.lang AND p.k = q.k WHERE n_words >= {MIN_WORDS}
  UNION ALL SELECT 'word', p.rid, p.lang, p.p, q.q FROM word_p p JOIN word_q q ON p.lang = q.lang AND p.word = q.word WHERE n_words >= {MIN_WORDS}
  UNION ALL SELECT 'word', p.rid, p.lang, greatest(0, 1 - sum(p.p)), greatest(0, 1 - sum(q.q)) FROM word_p p JOIN word_q q ON p.lang = q.lang AND p.word = q.word WHERE n_words >= {MIN_WORDS} GROUP BY p.rid, p.lang
), distances AS (
  SELECT kind, rid, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS distance
  FROM pairs GROUP BY kind, rid, lang
), steps AS (
  SELECT kind, lang, floor(distance * {STEPS}) AS step, count(*) AS n FROM distances GROUP BY ALL
), halves AS (
  SELECT kind, lang, min(step) + 1 AS step FROM (SELECT *, 2 * sum(n) OVER (PARTITION BY kind, lang ORDER BY step) >= sum(n) OVER (PARTITION BY kind, lang) AS half FROM steps) WHERE half GROUP BY kind, lang
), far AS (
  SELECT DISTINCT rid FROM distances JOIN halves USING (kind, lang)
  WHERE distance > CASE kind WHEN 'class' THEN greatest({MOST_CLASS}, step * {TIMES_CLASS} / {STEPS}) ELSE greatest({MOST_COMMON}, step * {TIMES_COMMON} / {STEPS}) END
), judged AS (
  SELECT c.*, coalesce(v.n_repeat_words, 0) AS n_repeat_words, c.n_words < {MIN_BASE_WORDS} OR 100 * coalesce(v.n_repeat_words, 0) > {MOST_REPEATED_PERCENT} * c.n_words AS base_failed,
    far.rid IS NULL AS near
  FROM c LEFT JOIN covered v USING (rid) LEFT JOIN far USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM judged
"""

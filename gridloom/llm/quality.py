"""Quality rules, line first: rules drop lines, then a document that lost too much text is rejected.

DataFrame functions alone. Every measure is one pass over the text inside a row; nothing is
shuffled. Windows are compared by a 64-bit hash of their five words.

Nulls count as empty texts and are rejected (fewer than ten words). Lines without a word are
neither counted nor judged. Repeated rows are judged alike; other columns pass through untouched,
whatever their names. An empty table gives an empty result. A text is judged whole, whatever its
length, in memory some ten times its size. Ties can't arise: every rule looks at one row; a share
that equals its threshold passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import BLANKS, WORD, table, unused

#: Characters counted as symbols, for both engines.
SYMBOLS = "#*$%&|<>"
#: A line of these phrases is boilerplate.
BOILERPLATE = ("cookie", "javascript", "lorem ipsum", "all rights reserved", "privacy policy", "terms of use", "terms of service", "click here", "subscribe now", "subscribe to", "sign up for", "log in to", "licensed under", "released under the", "powered by")
#: How a sentence may end: one of these marks, then any closing signs.
MARKS, CLOSERS = ".!?\u2026:;", "\"'\u201d\u2019\u00bb)]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more."""
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])),
        )
        starts = lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"]))
        total = lambda p: F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(5), i - a["last"])).alias("sum"), i.alias("last")), lambda a: a["sum"])
        return _let(ordered, lambda s: _let(starts(s), total))

    none = F.lit(0).cast("bigint")
    return F.when(n < 6, none).otherwise(_let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def _count(text: Column, chars: str) -> Column:
    """Occurrences of single characters, by plain byte search: much cheaper than a regex or translate."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length(text) - F.length(left)


def _words(text: Column) -> Column:
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def line_fails(line: Column, symbol_share: float = 0.1, bars: int = 3) -> Column:
    """Punctuation (no sentence end), shouting, symbol, navigation (bars between items) and
    boilerplate rules."""

    def rules(lower: Column) -> Column:
        shouts = (lower != line) & (F.upper(line) == line)
        symbols = _count(line, SYMBOLS) > symbol_share * F.length(line)
        navigation = _count(line, "|»›") >= bars
        found = F.contains(lower, F.lit(BOILERPLATE[0]))
        for phrase in BOILERPLATE[1:]:
            found = found | F.contains(lower, F.lit(phrase))
        return shouts | symbols | navigation | found

    end = F.right(F.rtrim(F.rtrim(line, F.lit(BLANKS)), F.lit(CLOSERS)), F.lit(1))
    return (F.instr(F.lit(MARKS), end) == 0) | (end == "") | _let(F.lower(line), rules)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, text_col: str = "text", max_lost: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> tuple[DataFrame, str]:
    """docs with one struct column more, and its name: the base measures, base_failed, the text of
    the lines that stay, the characters lost with the others, and kept."""
    text, words, lines, stay, out = unused(docs, "q_text", "q_words", "q_lines", "q_stay", "rules")
    # each costly value is a column of its own: used more than once, it is not computed anew
    df = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = df.withColumns({words: _words(F.col(text)), lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))})
    df = df.withColumn(stay, F.filter(lines, lambda x: ~line_fails(x)))
    chars = lambda c: F.length(c) - _count(c, BLANKS)
    names = dict(zip(MEASURES, unused(docs, *(f"q_{m}" for m in MEASURES))))
    left, failed = unused(docs, "q_left", "q_failed")
    df = df.withColumns({
        names["n_words"]: F.size(words).cast("bigint"),
        names["word_chars"]: chars(F.col(text)).cast("bigint"),
        names["n_symbols"]: _count(F.col(text), SYMBOLS).cast("bigint"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        names["n_repeat_words"]: _repeat_words(F.col(words)),
        left: F.array_join(stay, "\n"),
    })
    df = df.withColumn(failed, (F.col(names["n_words"]) < min_words) | (100 * F.col(names["n_repeat_words"]) > max_repeat_percent * F.col(names["n_words"])))
    lost = F.col(names["word_chars"]) - chars(F.col(left))
    kept = ~F.col(failed) & (lost <= max_lost * F.col(names["word_chars"]))
    rules = F.struct(*(F.col(names[m]).alias(m) for m in MEASURES), F.col(failed).alias("base_failed"), F.col(left).alias("clean"), lost.alias("lost"), kept.alias("kept"))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), rules.alias(out)), out


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rules = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"{rules}.{c}" for c in (*MEASURES, "base_failed", "kept")))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the lines that failed removed and n_chars counted anew."""
    found, rules = judged(docs)
    # an explosion, not a filter: a filter would be pushed below and take every measure's expression with it
    kept = F.when(F.col(f"{rules}.kept"), F.array(F.col(f"{rules}.clean"))).otherwise(F.array().cast("array<string>"))
    found = found.select(*(f"`{c}`" for c in docs.columns if c not in ("text", "n_chars")), F.explode(kept).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*(f"`{c}`" for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, CASE WHEN lead(x, 4) OVER o IS NOT NULL THEN x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o END AS win
      FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY rid, win) > 1 THEN 1 ELSE 0 END AS rep FROM g),
v AS (SELECT rid, max(rep) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c),
r AS (SELECT rid, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM v GROUP BY rid),
l AS (SELECT rid, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT rid, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      len(regexp_replace(array_to_string(list_filter(lines, lambda x: NOT (
        NOT regexp_matches(x, '[.!?\x{2026}:;][\x{22}''\x{201D}\x{2019}\x{BB})\]]*[\x20\x09-\x0D]*$')
        OR (upper(x) = x AND lower(x) <> x)
        OR len(x) - len(translate(x, '#*$%&|<>', '')) > 0.1 * len(x)
        OR len(x) - len(translate(x, '|' || chr(187) || chr(8250), '')) >= 3
        OR regexp_matches(lower(x), '(cookie|javascript|lorem ipsum|all rights reserved|privacy policy|terms of (use|service)|click here|subscribe (now|to)|sign up for|log in to|licensed under|released under the|powered by)')
      )), ''), '[\x20\x09-\x0D]', '', 'g')) AS left_chars FROM l),
m AS (SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, left_chars
      FROM d JOIN w USING (rid) JOIN k USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars - left_chars <= 0.5 * word_chars AS kept FROM f
"""
